"""Random chains of steps against the same chain on a Python list."""

from __future__ import annotations

import random

import pytest

from conftest import rows
from rivulet import union

SCHEMA = "i bigint, k bigint, s string"


def records(rng: random.Random, start: int) -> list[dict]:
    made = []
    for i in range(start, start + rng.randint(0, 9)):
        record = {"i": i}
        if rng.random() < 0.8:
            record["k"] = rng.randint(0, 3)
        if rng.random() < 0.8:
            record["s"] = rng.choice(["b", "a", "Z", "10", "9"])
        made.append(record)
    return made


def model_sort(items, by, descending):
    present = [r for r in items if by in r]
    if by == "s" and not all(r["s"].isdigit() for r in present):
        key = lambda r: r["s"].encode()
    else:
        key = lambda r: float(r[by])
    ordered = sorted(present, key=key, reverse=descending)
    if descending:  # sorted(reverse=True) keeps ties in order, as is wanted
        assert ordered == sorted(present, key=key, reverse=True)
    return ordered + [r for r in items if by not in r]


def model_unique(items, by):
    seen, kept = set(), []
    for r in items:
        if by in r and r[by] in seen:
            continue
        seen.add(r.get(by))
        kept.append(r)
    return kept


def steps(rng):
    n = rng.randint(0, 6)
    by, down = rng.choice(["k", "s"]), rng.random() < 0.5
    return rng.choice(
        [
            (lambda x: x.limit(n), lambda x: x[:n]),
            (lambda x: x.tail(n), lambda x: x[max(len(x) - n, 0) :]),
            (lambda x: x.reverse(), lambda x: x[::-1]),
            (lambda x: x.unique(by), lambda x: model_unique(x, by)),
            (lambda x: x.sort(by, "desc" if down else "asc"), lambda x: model_sort(x, by, down)),
            (lambda x: union([x, x.reverse()]), lambda x: x + x[::-1]),
            (lambda x: x.filter(["k > 0"]), lambda x: [r for r in x if r.get("k", 0) > 0]),
            (
                lambda x: x.filter(["k > 0"], mode="block"),
                lambda x: [r for r in x if not r.get("k", 0) > 0],
            ),
        ]
    )


@pytest.mark.parametrize("seed", range(16))
def test_chains(make, seed):
    rng = random.Random(seed)
    left, right = records(rng, 0), records(rng, 100)
    build = make.dynamic if seed % 3 == 0 else lambda r: make.typed(r, SCHEMA)
    items, expected = union([build(left), build(right).reverse()]), left + right[::-1]
    for _ in range(rng.randint(1, 5)):
        on_spark, on_list = steps(rng)
        items, expected = on_spark(items), on_list(expected)
    assert rows(items) == expected
