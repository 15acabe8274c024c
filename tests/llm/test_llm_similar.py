"""Near duplicates and nearest neighbours against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rivulet.llm import ann, neardup, queries

SF = "/root/testdata/sf0.001"


def shingles(text: str | None) -> set | None:
    if text is None:
        return None
    words = text.lower().encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_shingles_of_many_texts_at_once():
    texts = [None, "", "a b", "a b c d e", "a b c d e f a b c d e", "A B", "x", "", "a b c d e f"]
    hashes, sizes = neardup.Shingler()(texts)
    own = np.split(hashes, np.cumsum(sizes)[:-1])
    assert sizes.tolist() == [len(shingles(t) or ()) for t in texts]
    for a, x in zip(texts, own):
        for b, y in zip(texts, own):
            assert len(np.intersect1d(x, y)) == len((shingles(a) or set()) & (shingles(b) or set()))


def brute_classes(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a is None or b is None:
                continue
            same = rows[i][1] == rows[j][1]
            if same or (a and b and len(a & b) >= 0.8 * len(a | b)):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    return {rows[i][0]: min(members[find(i)]) for i in range(len(rows))}


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    found = queries.op3_dart_minhash_classes(spark, SF).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in found} == brute_classes(sorted(rows))


def test_planted_copies_in_a_large_group(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):  # near copies of one text
        words = list(base)
        words[rng.randrange(120)] = word()
        rows.append((i, " ".join(words)))
    passage = " ".join(word() for _ in range(60))
    rows += [(i, passage + " " + " ".join(word() for _ in range(60))) for i in range(100, 160)]  # no copies
    rows += [(i, "the same") for i in range(200, 240)]
    rows += [(300, None), (301, None), (302, ""), (303, ""), (304, " \n"), (305, "x y z"), (306, "x  y z")]
    rows += [(400, " ".join(word() for _ in range(60_000)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("copy", F.lit(1)).withColumn("key", F.lit(2))
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    expected = brute_classes(rows)
    assert expected[1] == expected[89] == 0 and expected[239] == 200 and expected[306] == 305
    assert [expected[i] for i in (300, 301, 302, 303, 304)] == [300, 301, 302, 302, 304]
    assert found == expected
    assert neardup.classes(df.limit(0)).collect() == []
    twice = neardup.classes(df.where("doc_id < 3").unionByName(df.where("doc_id < 3"))).collect()
    assert sorted(r["class_id"] for r in twice) == [0] * 6


def template_texts(n: int, pairs: int, seed: int) -> list[tuple[int, str]]:
    """Pages of one template, each 0.787 like every other; the last ``pairs`` pairs 0.818."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(374)]
    texts = [base + [word() for _ in range(50)] for _ in range(n)]
    for i in range(n - 2 * pairs, n, 2):
        texts[i + 1][374:382] = texts[i][374:382]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_each_round_has_another_hub(spark):
    # No text has copies, and the oldest of each bucket resembles none enough.
    rows = [(100 * g + i, t) for g in range(8) for i, t in template_texts(5, 1, g)]
    expected = brute_classes(rows)
    assert sum(i != c for i, c in expected.items()) == 8
    found = neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == expected


def test_links_in_a_large_template_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 40)  # several blocks for each bucket
    rows = template_texts(200, 20, 11)
    expected = brute_classes(rows)
    assert sum(i != c for i, c in expected.items()) == 20
    found = neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == expected


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = rng.random(300) * 3, rng.random(300) * 3
    wb[:120] = wa[:120]
    wa[250:], wb[200:250] = 0, 0
    k = 4000
    both = np.r_[elements, elements[::-1]]
    a, b = neardup.dart_signatures(both, np.r_[wa, wb[::-1]], np.array([300, 300]), k)
    similarity = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((a == b).mean() - similarity) < 4 * np.sqrt(similarity * (1 - similarity) / k)
    sizes = np.array([2, 0, 5])
    few = neardup.dart_signatures(elements[:7], np.ones(7), sizes, 120)
    assert few[0].all() and not few[1].any() and few[2].all()
    alone = neardup.dart_signatures(elements[2:7], np.ones(5), np.array([5]), 120)
    assert (few[2] == alone[0]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (200, 250)]
    found = neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    labels = {r["node"]: r["component"] for r in found}
    assert len(found) == 40 + 30 + 3
    assert {labels[i] for i in range(1, 41)} == {1} and {labels[i] for i in range(100, 130)} == {100}
    assert {labels[i] for i in (200, 250, 300)} == {200}


def test_size_estimates_stay_small_round_after_round(spark):
    chain = spark.range(40).selectExpr("cast(id AS string) a", "cast(id + 1 AS string) b")
    labels = neardup.components(chain)
    estimate = labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert estimate.bit_length() < 64  # as checkpoints: 4,958 bits
    assert {r["component"] for r in labels.collect()} == {"0"}


def brute_nearest(ids, matrix, query, k):
    own = np.flatnonzero(ids == query)[0]
    scores = [(-sum(x * y for x, y in zip(matrix[own], v)), int(i)) for i, v in zip(ids, matrix)]
    return [(i, -s) for s, i in sorted(scores) if i != query][:k]


def test_search_equals_brute_force_on_a_small_table(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet")
    ids = table["vec_id"].to_numpy()
    matrix = np.array(table["embedding"].to_pylist(), np.float64)
    rows = queries.op4_inverted_multi_index(spark, SF).orderBy("query_id", "rank").collect()
    found = defaultdict(list)
    for r in rows:
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    wanted = [int(i) for i in ids if i % 20 == 0]
    assert sorted(found) == sorted(wanted)
    for query in wanted:
        assert found[query] == brute_nearest(ids, matrix, query, 20)


def test_recall_where_cells_are_left_out(spark):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(6000, 32)).astype(np.float32)
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id bigint, embedding array<float>")
    found = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 200 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    exact = matrix.astype(np.float64)
    hits = 0
    for query in range(0, 6000, 200):
        scores = exact @ exact[query]
        scores[query] = -np.inf
        hits += len(found[query] & set(np.argsort(-scores)[:20].tolist()))
    assert hits / (30 * 20) >= 0.9


def test_ties_and_hard_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 0.0, 2.0, 0.5]) for i in range(40)]
    hard = [(50, None), (51, []), (52, [0.0] * 4), (53, [nan, 1.0, 1.0, 1.0]), (54, [inf, 1.0, 1.0, 1.0]), (55, [None, 1.0, 1.0, 1.0]), (56, [1.0]), (None, [1.0] * 4), (0, [1.0, 0.0, 2.0, 0.5])]
    df = spark.createDataFrame(same + hard, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    rows = ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [r["query_id"] for r in rows] == [0] * 20 + [20] * 20
    assert [r["vec_id"] for r in rows] == [*range(1, 21), *range(20)]
    assert [r["rank"] for r in rows] == [*range(1, 21)] * 2
    few = ann.search(df.where("vec_id < 5"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in few] == [1, 2, 3, 4]
    assert ann.search(df.limit(0), F.lit(True)).collect() == []
    assert ann.search(df.where("vec_id = 50"), F.lit(True)).collect() == []
