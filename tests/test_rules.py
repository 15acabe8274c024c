from datetime import timedelta
from functools import reduce

import re

import pytest
from pyspark.sql import functions as F

from conftest import NOW, column
from rivulet.operators.rules import Rule, parse_rule, plain_number


@pytest.mark.parametrize(
    "text, rule",
    [
        ("points > 12", Rule("points", ">", 12.0)),
        ("  item.when   >=  now - 3d ", Rule("when", ">=", timedelta(days=-3))),
        ("name contains two words", Rule("name", "contains", "two words")),
        ('name == "Grace H"', Rule("name", "==", "Grace H")),
        ("name != 'x'", Rule("name", "!=", "x")),
        ("when < now + 2.5h", Rule("when", "<", timedelta(hours=2, minutes=30))),
        ("when == now", Rule("when", "==", timedelta())),
        ("when > now-1w", Rule("when", ">", timedelta(weeks=-1))),
        ("a == -1e3", Rule("a", "==", -1000.0)),
        ("a == 1_0", Rule("a", "==", "1_0")),
    ],
)
def test_rule_forms(text, rule):
    assert parse_rule(text) == rule


@pytest.mark.parametrize(
    "text, part",
    [
        ("", "rule"),
        ("name", "name"),
        ("name =~ x", "=~"),
        ("name <=", "name <="),
        ("name == 'open", "'open"),
        ("name == '", "quote"),
        ("when > now / 2d", "now / 2d"),
        ("when > now - 2y", "now - 2y"),
        ("when > now - h", "now - h"),
        ("when > now - infd", "now - infd"),
        ("name contains nowhere", "nowhere"),
    ],
)
def test_rule_errors(text, part):
    with pytest.raises(ValueError, match=re.escape(part)):
        parse_rule(text)


def test_rule_compile_errors(make):
    items = make.typed([{"a": "x"}], "a string")
    for rule, part in [("a matches (open", "bad regex"), ("a matches 7", "regex pattern")]:
        with pytest.raises(ValueError, match=part) as error:
            items.filter([rule])
        assert rule in str(error.value)


@pytest.mark.parametrize(
    "number, text",
    [(100.0, "100"), (0.25, "0.25"), (1e21, "1" + "0" * 21), (1e-7, "0.0000001"), (-3.5, "-3.5")],
)
def test_numbers_are_searched_in_plain_digits(number, text):
    assert plain_number(number) == text


RECORDS = [
    {"n": 150, "t": "150", "d": "2025-03-10T11:00:00Z", "b": True, "s": "Crate Ship"},
    {"n": 50, "t": "abc", "d": "Sat, 01 Mar 2025 10:00:00 GMT", "b": False, "s": "boat"},
    {"n": 100, "t": " 1e2 ", "d": "soon", "s": "100"},
    {"other": 1},
]
SCHEMA = "n bigint, t string, d string, b boolean, s string, other bigint"

HITS = [
    ("n > 100", [0]),
    ("n >= 100", [0, 2]),
    ("n < 100.5", [1, 2]),
    ("n != 50", [0, 2]),
    ("n == 50.5", []),
    ("n != 50.5", [0, 1, 2]),
    ("t >= 100", [0, 2]),
    ("t == 100", [2]),
    ("t != 100", [0]),
    ("t != nan", []),
    ("n < inf", [0, 1, 2]),
    ("d > now - 2d", [0]),
    ("d <= now - 1w", [1]),
    ("item.d != now", [0, 1]),
    ("b == true", [0]),
    ("b > 0", []),
    ("b contains FAL", [1]),
    ("s contains SHIP", [0]),
    ("s contains 100.0", [2]),
    ("s == boat", [1]),
    ("s > boat", []),
    ("s < boat", [0, 2]),
    ("s matches ^b", [1]),
    ("s matches (?i)^C.*p$", [0]),
    ("n matches ^1", [0, 2]),
    ("n == '50'", [1]),
    ("nope == 1", []),
    ("nope != 1", []),
    ("nope contains a", []),
    ("nope matches .", []),
    ("nope < now", []),
    ("s contains now", [0, 1, 2]),
    ("n.x == 1", []),
]


@pytest.mark.parametrize("form", ["typed", "dynamic"])
def test_predicates(make, form):
    items = make.typed(RECORDS, SCHEMA) if form == "typed" else make.dynamic(RECORDS)
    ids = {150: 0, 50: 1, 100: 2, None: 3}
    got = {}
    for start in range(0, len(HITS), 6):  # several rules per job, each its own branch
        branches = [
            items.filter([rule], mode=mode, now=NOW).to_typed("n bigint").to_df()
            if items.dynamic
            else items.filter([rule], mode=mode, now=NOW).df.select("n")
            for rule, _ in HITS[start : start + 6]
            for mode in ("permit", "block")
        ]
        tagged = [b.select(F.lit(i).alias("branch"), "n") for i, b in enumerate(branches)]
        for row in reduce(lambda x, y: x.unionByName(y), tagged).collect():
            key = (start + row["branch"] // 2, row["branch"] % 2)
            got.setdefault(key, []).append(ids[row["n"]])
    for i, (rule, expected) in enumerate(HITS):
        assert sorted(got.get((i, 0), [])) == expected, rule
        blocked = [j for j in range(4) if j not in expected]
        assert sorted(got.get((i, 1), [])) == blocked, rule


def test_all_any_and_no_rules(make):
    items = make.typed(RECORDS, SCHEMA)
    rules = ["n > 60", "s contains ship"]
    assert column(items.filter(rules), "n") == [150]
    assert column(items.filter(rules, match="any"), "n") == [150, 100]
    assert len(column(items.filter([], mode="block"), "n")) == 4
    assert column(items.filter(["n > 1"]).filter(["n < 0"]), "n") == []
    for bad in ({"mode": "keep"}, {"match": "some"}):
        with pytest.raises(ValueError, match="must be"):
            items.filter(["n > 1"], **bad)


def test_nan_in_a_column_matches_nothing(make):
    items = make.typed([{"x": float("nan")}, {"x": 1.0}], "x double")
    for rule, kept in [("x > 0", [1.0]), ("x != 5", [1.0]), ("x >= 1", [1.0]), ("x < 9", [1.0])]:
        assert column(items.filter([rule]), "x") == kept
