import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import NOW, rows
from rivulet import Items
from rivulet.functions import cards as card_functions
from rivulet.functions.profile import content_hash, key_list, key_union
from rivulet.functions.views import double_text, moment_from_text, moment_text, number_from_text


def apply(spark, values, kind, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    out = df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in out]


def test_numbers_in_text(spark):
    texts = ["1", "-1.5", " 2 ", ".5", "5.", "1e3", "+4E-1", "inf", "-Infinity", "NaN", " 7"]
    got = apply(spark, texts, "string", number_from_text)
    assert got[:9] == [1, -1.5, 2, 0.5, 5, 1000, 0.4, math.inf, -math.inf]
    assert math.isnan(got[9]) and got[10] == 7
    misfits = ["", " ", "1d", "2f", "0x1", "1_0", "1 2", "e5", ".", "+", "true", "٣", "1e", None]
    assert apply(spark, misfits, "string", number_from_text) == [None] * len(misfits)


def at(*parts):
    return datetime(*parts)


DATES = [
    ("2025-07-01T12:00:00Z", at(2025, 7, 1, 12)),
    ("2025-07-01 12:00:00+02:00", at(2025, 7, 1, 10)),
    ("2025-07-01t12:00:00.25z", at(2025, 7, 1, 12, 0, 0, 250_000)),
    ("2025-07-01T12:00:00.123456789-00:30", at(2025, 7, 1, 12, 30, 0, 123_456)),
    ("2025-07-01 12:00:00", at(2025, 7, 1, 12)),
    (" 2025-07-01\n", at(2025, 7, 1)),
    ("2025-7-1 3:04:5", at(2025, 7, 1, 3, 4, 5)),
    ("Tue, 01 Jul 2025 10:00:00 GMT", at(2025, 7, 1, 10)),
    ("tue,1 JUL 2025 10:00 EST", at(2025, 7, 1, 15)),
    ("1 Jul 25 10:00:00 +0530", at(2025, 7, 1, 4, 30)),
    ("1 Jul 125 10:00:00 PDT", at(2025, 7, 1, 17)),
    ("31 Dec 1999 23:59:59 -0000", at(1999, 12, 31, 23, 59, 59)),
    ("Tue, 1 Jul 2025 10:00:00 +0000 (noon, nearly)", at(2025, 7, 1, 10)),
    ("1 Jul 2025 10:00:00 A", at(2025, 7, 1, 10)),
    ("Wed, 1 Jul 2025 10:00:00 GMT", None),
    ("1 Jul 2025 10:00:00 CET", None),
    ("1 Jul 2025 10:00:00 J", None),
    ("31 Jun 2025 10:00:00 GMT", None),
    ("2025-02-30", None),
    ("2025-07-01T12:00:00", None),
    ("2025-07-01T12:00Z", None),
    ("2025", None),
    ("noon", None),
    ("", None),
    (None, None),
]


def test_dates_in_text(spark):
    read = lambda c: moment_from_text(c).cast("timestamp_ntz")
    got = apply(spark, [text for text, _ in DATES], "string", read)
    for (text, want), have in zip(DATES, got):
        assert have == want, text


def test_date_text(spark):
    texts = ["2025-07-01T12:00:00+00:00", "2025-07-01T12:00:00.500+00:00", "2025-07-01T12:00:00.000007+00:00"]
    assert apply(spark, texts, "string", lambda c: moment_text(moment_from_text(c))) == texts


def test_doubles_as_text(spark):
    doubles = [0.0, -0.0, 1.0, 0.1, 1e7, 12345678.25, -1e15, 1e16, 1.5e300, 1e-5, 2.5e-5, 1e-6, -3e-9]
    want = [
        "0.0", "-0.0", "1.0", "0.1", "10000000.0", "12345678.25", "-1000000000000000.0", "1e16",
        "1.5e300", "0.00001", "0.000025", "1e-6", "-3e-9",
    ]
    assert apply(spark, doubles, "double", double_text) == want


def test_text_of_every_type(spark):
    df = spark.sql(
        """SELECT 1 AS id, true AS b, 7 AS i, 2.5D AS d, date'2025-01-02' AS day,
        timestamp_ntz'2025-01-02 03:04:05' AS t, array(1, 2) AS a,
        named_struct('z', 1, 'a', named_struct('y', 'q', 'x', null)) AS s,
        map('k', 1) AS m, parse_json('{"b": [1, null], "a": "x"}') AS v"""
    )
    items = Items.from_table(df, "id")
    texts = {c: items.field(c).text.alias(c) for c in "b i d day t a s m v".split()}
    got = df.select(*texts.values()).first().asDict()
    assert got == {
        "b": "true", "i": "7", "d": "2.5", "day": "2025-01-02", "t": "2025-01-02T03:04:05+00:00",
        "a": "[1,2]", "s": '{"a":{"y":"q"},"z":1}', "m": '{"k":1}', "v": '{"a":"x","b":[1,null]}',
    }
    numbers = df.select(*[items.field(c).number.alias(c) for c in "b i d t a".split()]).first()
    assert tuple(numbers) == (None, 7.0, 2.5, None, None)
    looked = df.select(
        items.field("s.a.y").text, items.field("m.k").number, items.field("v.a").text,
        items.field("a.0").text, items.field("s.a.x").text,
    ).first()
    assert tuple(looked) == ("q", 1.0, "x", None, None)


def test_keys_and_fingerprints(make):
    records = [{"b": 1}, {"a": None, "c": 2}, {"c": 3}]
    dynamic = make.dynamic(records)
    assert key_list(dynamic) == ["a", "b", "c"]
    assert key_list(make.typed([{"x": 1}], "x int, never int")) == ["x"]
    counts = {r["key"]: r["items"] for r in key_union(dynamic).collect()}
    assert counts == {"a": 1, "b": 1, "c": 2}
    same = make.dynamic([{"p": 1, "q": "x"}, {"q": "x", "p": 1}, {"p": "1", "q": "x"}])
    hashes = [r[0] for r in same.df.select(content_hash(same)).collect()]
    assert hashes[0] == hashes[1] != hashes[2]


def test_forms_round_trip(make):
    records = [{"s": "x", "n": 1, "d": 2.5, "b": True}, {"n": 3}]
    schema = "s string, n bigint, d double, b string"
    dynamic = make.dynamic(records)
    typed = dynamic.to_typed(schema)
    assert rows(typed) == [{"s": "x", "n": 1, "d": 2.5, "b": "true"}, {"n": 3}]
    assert rows(typed.to_dynamic()) == rows(typed)
    with pytest.raises(ValueError):
        typed.to_typed(schema)


# --- cards -------------------------------------------------------------------

DOMAINS = [
    ("https://blog.x.dev/2024/a.html", "blog.x.dev"),
    ("http://www.x.dev", "www.x.dev"),
    ("ftp://me:pw@files.x.dev:21/a?b#c", "files.x.dev"),
    ("x.dev/path", "x.dev"),
    ("x.dev?u=http://other.dev/1", "other.dev"),
    ("  https://x.dev#top ", "x.dev"),
    ("https:///path", None),
    ("   ", None),
    (None, None),
]


def test_domains(spark):
    got = apply(spark, [url for url, _ in DOMAINS], "string", card_functions.url_domain)
    assert got == [domain for _, domain in DOMAINS]


def test_ages(spark):
    ages = [
        ("2025-03-10T12:00:30Z", "just now"), ("2025-03-10T11:59:01Z", "just now"),
        ("2025-03-10T11:59:00Z", "1m ago"), ("2025-03-10T11:00:01Z", "59m ago"),
        ("2025-03-10T11:00:00Z", "1h ago"), ("2025-03-09T12:00:01Z", "23h ago"),
        ("2025-03-09T12:00:00Z", "1d ago"), ("2025-03-03T12:00:01Z", "6d ago"),
        ("2025-03-03T12:00:00Z", "1w ago"), ("2024-03-10T12:00:00Z", "52w ago"),
    ]
    now = F.lit("2025-03-10 12:00:00+00:00").cast("timestamp")
    label = lambda c: card_functions.age_label(moment_from_text(c), now)
    assert apply(spark, [t for t, _ in ages], "string", label) == [want for _, want in ages]


SNIPPETS = [
    ('<p><a href="https://x.dev/s">More</a></p>', "More"),
    ("<p>a</p><p>b</p>", "a b"),
    ("kept > text <a hre", "kept > text"),
    ("Salt &amp; Vinegar &lt;3", "Salt & Vinegar <3"),
    ("&quot;q&quot; &apos;a&apos;", "\"q\" 'a'"),
    ("it&#39;s&#x2026; &#128512;", "it's… 😀"),
    ("a&nbsp;&nbsp;b", "a b"),
    ("&amp;lt;b&amp;gt;", "&lt;b&gt;"),
    ("&lt;p&gt;shown&lt;/p&gt;", "<p>shown</p>"),
    ("R&D; X & Y &nope; &#xzz; &#55357; &#9999999;", "R&D; X & Y &nope; &#xzz; &#55357; &#9999999;"),
    ("&muchtoolong; &#0000039; &#00000039;", "&muchtoolong; ' &#00000039;"),
    ("a & b &amp; c&", "a & b & c&"),
    (" \n\t spaced   out ", "spaced out"),
]


def test_snippets(spark):
    got = apply(spark, [html for html, _ in SNIPPETS], "string", card_functions.snippet)
    for (html, want), have in zip(SNIPPETS, got):
        assert have == want, html


def test_cards(make):
    records = [
        {"title": "T", "link": "https://x.dev/1", "description": "<b>B</b>\n c", "pubDate": "2025-03-10T10:00:00Z"},
        {"title": "", "pubDate": "never"},
        {"title": 5},
    ]
    for items in (
        make.dynamic(records),
        make.typed(records, "title string, link string, description string, pubDate string"),
    ):
        got = rows(card_functions.cards(items, NOW))
        assert got[0] == {"title": "T", "domain": "x.dev", "age": "2h ago", "snippet": "B c"}
        assert got[1] == {"title": "(untitled)", "domain": "", "age": "", "snippet": ""}
        assert got[2]["title"] == "5"


def test_summary(make):
    got = card_functions.feed_summary(make.dynamic([{}, {"a": 1}]), "T", "csv", now=NOW).first()
    assert (got["title"], got["format"], got["items"], got["updated"]) == ("T", "csv", 2, "12:00")
    with pytest.raises(ValueError, match="format"):
        card_functions.feed_summary(make.dynamic([]), "T", "xml")
