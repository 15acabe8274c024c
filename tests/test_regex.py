import re

import pytest
from pyspark.sql import functions as F

from conftest import column, rows
from rivulet.functions.dialect import spark_pattern, spark_replacement
from rivulet.operators.regex import replaced


def test_extract_named_groups(make):
    records = [{"t": f"order {i}: {i * 3} x part-{i % 4}"} for i in range(6)] + [{"t": "no order"}, {"o": 1}]
    for items in (make.typed(records, "t string, o bigint"), make.dynamic(records)):
        got = rows(items.regex("t", r": (?<count>[0-9]+) x (?<what>part-\d)$", mode="extract"))
        assert got == [
            r | ({"count": str(i * 3), "what": f"part-{i % 4}"} if i < 6 else {}) for i, r in enumerate(records)
        ]


def test_extract_tells_absent_groups_from_empty_ones(make):
    records = [{"t": "k=", "v": "old"}, {"t": "k", "v": "old"}, {"t": "k=5"}, {"t": "z"}]
    for items in (make.typed(records, "t string, v string"), make.dynamic(records)):
        got = column(items.regex("t", r"k(?:=(?P<v>\d*))?", mode="extract"), "v")
        assert got == ["", "old", "5", None]


def test_extract_uses_the_first_match_only(make):
    items = make.typed([{"t": "ab aXb"}, {"t": "a1b a2b"}], "t string")
    got = column(items.regex("t", r"a(?P<mid>.)?b", mode="extract"), "mid")
    assert got == [None, "1"]


def test_extract_group_names_with_underscores_and_over_a_number(make):
    items = make.typed([{"t": "x-9", "n_1": 4}, {"t": "none", "n_1": 4}], "t string, n_1 bigint")
    assert column(items.regex("t", r"x-(?P<n_1>\d)", mode="extract"), "n_1") == ["9", "4"]


def test_replace(make):
    records = [{"t": "Color, colour and COLOR"}, {"t": "col our"}, {"n": 10}]
    for items in (make.typed(records, "t string, n bigint"), make.dynamic(records)):
        got = column(items.regex("t", "(?i)colou?r", replacement="hue"), "t")
        assert got == ["hue, hue and hue", "col our", None]
        assert column(items.regex("n", "0", replacement="1"), "n") == [None, None, "11"]


def test_replace_in_a_nested_field(make, spark):
    items = make.typed([{"m": {"u": "http://a"}}], "m struct<u: string, v: int>")
    got = rows(items.regex("m.u", "^http:", replacement="https:"))
    assert got[0]["m"]["u"] == "https://a"
    assert rows(items.regex("m.nope", "x")) == rows(items)


def test_errors(make):
    items = make.typed([{"t": "x"}], "t string")
    for call, part in [
        (dict(pattern="[open"), "bad regex"),
        (dict(pattern="(open"), "bad regex"),
        (dict(pattern="shut)"), "bad regex"),
        (dict(pattern=r"\d+", mode="extract"), "names no group"),
        (dict(pattern="x", mode="swap"), "`mode`"),
        (dict(pattern=None), "`pattern`"),
    ]:
        with pytest.raises(ValueError, match=part):
            items.regex("t", **call)


@pytest.mark.parametrize(
    "pattern",
    ["(?=x)", "(?!x)", "(?<=x)y", "(?<!x)y", r"(a)\1", "(?>a)", r"\Qx\E", r"\Z", "a++", r"\k<n>"],
)
def test_constructs_outside_the_dialect_are_refused(spark, pattern):
    with pytest.raises(ValueError, match="bad regex"):
        spark_pattern(pattern)


MATCHES = [
    (r"^a$", "a", True),
    (r"^a$", "a\n", False),
    (r"(?m)^b$", "a\nb\nc", True),
    (r"(?m)^$", "a\n", True),
    (r"a.b", "a\rb", True),
    (r"a.b", "a\nb", False),
    (r"(?s)a.b", "a\nb", True),
    (r"^\d$", "٣", True),
    (r"^[[:digit:]]$", "٣", False),
    (r"^[[:alpha:]_]+$", "ab_c", True),
    (r"^[^[:space:]]$", " ", False),
    (r"^\w+$", "naïve", True),
    (r"(?i)^É$", "é", True),
    (r"^\p{Greek}$", "λ", True),
    (r"^\P{Greek}$", "λ", False),
    (r"^\pL+$", "aé", True),
    (r"\x{1F600}", "😀", True),
    (r"\u{e9}", "é", True),
    (r"^[]a]+$", "]a", True),
    (r"^[a\]]+$", "]a", True),
    (r"^[-a]$", "-", True),
    (r"^[a-f&&[^c]]+$", "abd", True),
    (r"^[a-f&&[^c]]+$", "abc", False),
    (r"(?x) ^ a \d # ( comment", "a1", True),
    (r"^\va$", "\x0ba", True),
    (r"\<cat\>", "a cat!", True),
    (r"\<cat\>", "concat", False),
    (r"^(?:ab|a)(c|bcd)$", "abcd", True),
    (r"^\$\.\^$", "$.^", True),
    (r"^a{2,3}?$", "aaa", True),
]


def test_dialect_matches(spark):
    for pattern, text, expected in MATCHES:
        java = spark_pattern(pattern).java
        hit = spark.range(1).select(F.lit(text).rlike(java)).first()[0]
        assert hit is expected, (pattern, text)


REPLACEMENTS = [
    ("(a)(b)?", "$2$1", "ab a", "ba a"),
    ("(?P<x>a)", "<$x>", "a", "<a>"),
    ("(?P<x>a)", "${x}1", "a", "a1"),
    ("(?P<x>a)", "$x1", "ab", "b"),
    ("(a)", "$1a", "ab", "b"),
    ("(a)", "${1}0", "a", "a0"),
    ("(a)", "$$1", "a", "$1"),
    ("(a)", r"\1\\", "a", r"\1\\"),
    ("(a)", "$9", "ab", "b"),
    ("a*", "X", "baac", "XbXcX"),
    ("", "-", "ab", "-a-b-"),
    ("a*?", "X", "aa", "XaXaX"),
    (r"\b", "|", "hi you", "|hi| |you|"),
    ("x", "$", "x", "$"),
]


def test_replacements(spark):
    for pattern, replacement, text, expected in REPLACEMENTS:
        compiled = spark_pattern(pattern)
        got = spark.range(1).select(replaced(F.lit(text), compiled, replacement)).first()[0]
        assert got == expected, (pattern, replacement, text)


def test_group_numbers_do_not_swallow_digits(spark):
    pattern = spark_pattern("(a)")
    assert spark_replacement(pattern, "${1}23") == r"$1\23"


def test_extraction_against_a_plain_search(spark):
    """Participation and text of groups, compared with Python's own engine."""
    pattern = r"(?P<a>x)?(?P<b>y*)(?:-(?P<c>z?))?"
    texts = ["", "x", "y", "xy", "xyy-", "-z", "q-x", "xx-z", "y-zz", "-", "z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from rivulet import Items

    items = Items.from_table(df, "t").regex("t", pattern, mode="extract")
    got = {r["t"]: (r["a"], r["b"], r["c"]) for r in items.to_df().collect()}
    for text in texts:
        assert got[text] == re.search(pattern, text).group("a", "b", "c"), text
