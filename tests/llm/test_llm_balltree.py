"""Ball-tree search against scores of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from rivulet.llm import balltree, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, ts, Counter(ts)) for d, ts in held if ts]
    n_docs, n_terms = len(held), sum(len(ts) for _, ts, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, ts, c in held:
            m = 100 - 90 + (90 * len(ts) * n_docs) // n_terms
            score = 0
            for t in wanted & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, missing, doc) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if missing else doc, -score))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_brute_force(spark):
    def read(name, key):
        return [(r[key], r["text"]) for r in pq.read_table(f"{SF}/{name}.parquet").to_pylist()]

    got = queries.op12_ball_tree_search(spark, SF)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


@pytest.mark.parametrize("leaf", [1, 5])
def test_many_trees_and_blocks(spark, monkeypatch, leaf):
    monkeypatch.setattr(balltree, "TREE_DOCS", 40)
    monkeypatch.setattr(balltree, "BLOCK_TERMS", 60)
    rng = random.Random(leaf)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "Ab"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(400)]
    docs += [(1000 + i, "w1 w2 w3") for i in range(60)]  # equal scores
    docs += [(2000, None), (2001, ""), (2002, " .-\x7f"), (2003, "AB ab aB"), (None, "w1 w2"), (7, "w1 w2 w3")]
    docs += [(3000, "w5 " * 30_000 + "日本")]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(25)]
    items += [(50, "w1 w2 w3"), (51, None), (52, "nowhere"), (53, "w4"), (53, "w9 W4"), (None, "é")]
    monkeypatch.setattr(balltree, "LEAF", leaf)
    left = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS term", "2 AS score")
    right = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id", "2 AS rank")
    assert found(balltree.search(left.repartition(3), right)) == brute(docs, items)
    assert balltree.search(left.limit(0), right).collect() == []
    assert balltree.search(left, right.limit(0)).collect() == []
