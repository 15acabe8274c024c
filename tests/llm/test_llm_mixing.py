"""The source mix against brute force subset sums and its own promises."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from rivulet.llm import mixing, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, source string, size bigint"


@pytest.mark.parametrize("seed", range(30))
def test_fill_is_the_best_subset_sum(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(1, 40), rng.randint(1, 6))
    counts = [rng.randint(0, 4) for _ in lengths]
    sums = {0}
    for length, count in zip(lengths, counts):
        sums = {s + length * k for s in sums for k in range(count + 1)}
    budget = rng.randint(0, max(sums) + 5)
    taken, words = mixing.fill(np.array(lengths), np.array(counts), budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts))
    assert words == sum(t * n for t, n in zip(taken, lengths)) == max(s for s in sums if s <= budget)


@pytest.mark.parametrize("window", [0, 50, 1 << 16])
def test_allot_comes_near_its_budget(monkeypatch, window):
    monkeypatch.setattr(mixing, "WINDOW", window)
    rng = random.Random(window)
    lengths = np.array(rng.sample(range(1, 900), 60))
    counts = np.array([rng.randint(1, 50) for _ in lengths])
    total = int((lengths * counts).sum())
    for share in (0, 0.001, 0.3, 0.999, 1):
        taken = mixing.allot(lengths, counts, int(total * share))
        assert ((0 <= taken) & (taken <= counts)).all()
        short = int(total * share) - int((taken * lengths).sum())
        assert 0 <= short <= (0 if window > 900 else 900)


def plain_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        words = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: Fraction(3 * sizes[s]) if s in capped else Fraction(words * weight[s], share) for s in names}
        above = {s for s in names if target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


def check(rows: list[tuple], found: list) -> None:
    """rows: (doc_id, source, size) as put in, found: what mix returned, with sources."""
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in found) == Counter(rows)
    sizes: dict = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    targets = plain_targets(sizes)
    taken: dict = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(targets[r["source"]]))
        assert r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in targets.items():
        longest = max(size for _, s, size in rows if s == source)
        assert 0 <= target - taken[source] < longest + 1


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    rows = [(d["doc_id"], d["source"], len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))) for d in docs]
    source = {r[0]: r[1] for r in rows}
    found = [{**r.asDict(), "source": source[r["doc_id"]]} for r in queries.op11_subset_sum_mix(spark, SF).collect()]
    check(rows, found)


def test_hot_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rng = random.Random(1)
    rows = [(i, rng.choice("aab"), rng.randint(1, 90)) for i in range(300)]
    rows += [(1000 + i, "hot", 11) for i in range(400)]  # one length
    rows += [(None, "hot", 11)] * 90 + [(5, None, 0), (6, None, 3), (7, "c", 0), (8, "é", 2)]
    rows += [(9, "z", 20)] * 40  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS target", "3 AS edge", "4 AS weight")
    found = [r.asDict() for r in mixing.mix(df).collect()]
    check(rows, found)
    again = [r.asDict() for r in mixing.mix(df.repartition(7)).collect()]
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(found, key=key) == sorted(again, key=key)
    assert len({r["taken"] for r in found if r["source"] == "hot"}) == 2


def test_nothing_to_mix(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    only = mixing.mix(spark.createDataFrame([(1, "a", 0), (2, None, None)], SCHEMA)).collect()
    assert [(r["target"], r["taken"]) for r in only] == [(0.0, 0)] * 2
