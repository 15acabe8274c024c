import json

import pytest
from pyspark.errors import PySparkException

from conftest import column, rows
from rivulet.sources import (
    csv_items,
    feed_items,
    json_items,
    landed_files,
    parse_csv_bodies,
    parse_feed_bodies,
    parse_json_bodies,
    read_csv,
    read_feeds,
    read_json,
)

RSS = """<?xml version="1.0"?><!-- made by hand -->
<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
  <title>Channel</title><link>https://x.dev</link>
  <item>
    <title>One &amp; only</title><link>https://x.dev/1</link><link>https://x.dev/other</link>
    <description><![CDATA[<b>Hi</b>]]></description><content:encoded>Body</content:encoded>
    <pubDate>Sat, 01 Mar 2025 10:00:00 GMT</pubDate>
    <guid isPermaLink="false">p-1</guid><author>Ann</author>
  </item>
  <item><title>Two</title><link>https://x.dev/2</link></item>
</channel></rss>"""

ATOM = """<?xml version="1.0" encoding="utf-8"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><id>urn:a</id>
  <entry><title type="html">Entry</title><id>urn:a:1</id>
    <link href="https://x.dev/a" rel="alternate"/><link href="https://x.dev/b"/>
    <updated>2025-03-01T10:00:00+01:00</updated><published>2025-02-01T00:00:00Z</published>
    <author><name>Bo</name></author><author><name>Cy</name></author>
    <summary>Short</summary><content type="html">Long</content></entry>
  <entry><title>Bare</title><id></id><updated>2025-03-02T00:00:00Z</updated></entry>
</feed>"""

RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"
  xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">
  <channel rdf:about="c"><title>c</title></channel>
  <item rdf:about="https://x.dev/r"><title>R</title><link>https://x.dev/r</link>
    <dc:date>2025-01-01T00:00:00Z</dc:date><dc:creator>Di</dc:creator></item></rdf:RDF>"""

JSON_FEED = json.dumps(
    {
        "version": "https://jsonfeed.org/version/1.1",
        "title": "J",
        "items": [
            {"id": "1", "url": "https://x.dev/j", "title": "J1", "content_text": "c",
             "date_published": "2025-01-01T00:00:00Z", "authors": [{"name": "Ed"}]}
        ],
    }
)


def bodies(spark, *pairs):
    return spark.createDataFrame(list(pairs), "url string, body string")


def test_rss(spark):
    one, two = rows(feed_items(bodies(spark, ("u", RSS))))
    assert one == {
        "guid": "p-1", "title": "One & only", "link": "https://x.dev/1", "description": "<b>Hi</b>",
        "content": "Body", "pubDate": "2025-03-01T10:00:00+00:00", "author": "Ann",
    }
    assert two == {"title": "Two", "link": "https://x.dev/2"}


def test_atom(spark):
    one, two = rows(feed_items(bodies(spark, ("u", ATOM))))
    assert one == {
        "guid": "urn:a:1", "title": "Entry", "link": "https://x.dev/a", "description": "Short",
        "content": "Long", "pubDate": "2025-02-01T00:00:00+00:00", "author": "Bo",
    }
    assert two == {"title": "Bare", "pubDate": "2025-03-02T00:00:00+00:00"}


def test_rdf_and_json_feed(spark):
    got = rows(feed_items(bodies(spark, ("1", RDF), ("2", JSON_FEED))))
    assert got[0] == {
        "guid": "https://x.dev/r", "title": "R", "link": "https://x.dev/r",
        "pubDate": "2025-01-01T00:00:00+00:00", "author": "Di",
    }
    assert got[1] == {
        "guid": "1", "title": "J1", "link": "https://x.dev/j", "content": "c",
        "pubDate": "2025-01-01T00:00:00+00:00", "author": "Ed",
    }


def test_malformed_feeds(spark):
    broken = [
        ("b1", "not a feed {"),
        ("b2", "<html><body/></html>"),
        ("b3", "<rss><channel><item>"),
        ("b4", '{"items": []}'),
        ("b5", ""),
        ("b6", None),
    ]
    parsed = parse_feed_bodies(bodies(spark, ("ok", RSS), *broken))
    assert len(rows(parsed.items)) == 2
    assert {r["url"] for r in parsed.rejects.collect()} == {url for url, _ in broken}
    assert {r["reason"] for r in parsed.rejects.collect()} == {"cannot parse feed"}
    with pytest.raises(PySparkException, match="cannot parse feed at b2"):
        feed_items(bodies(spark, ("b2", "<html/>"))).df.collect()
    assert rows(feed_items(bodies(spark, ("e", "<rss><channel></channel></rss>")))) == []


def test_json_roots(spark):
    got = rows(json_items(bodies(spark, ("1", '[{"t": 1}, 2, "x", null, [3]]'), ("2", '{"o": 1}'), ("3", "7"))))
    assert got == [{"t": 1}, {"value": 2}, {"value": "x"}, {"value": None}, {"value": [3]}, {"o": 1}, {"value": 7}]


DOC = {
    "data": {"posts": [{"id": 1, "t": "a"}, {"id": 2, "t": "b"}, {"id": "3"}], "n": 2},
    "odd name": [[1, 2]],
    "many": [[{"z": 1}], [{"z": 2}, {"z": 3}]],
}
PATHS = [
    ("$.data.posts", [1, 2, "3"], "id"),
    ("  ", [DOC], None),
    ("$", [DOC], None),
    ("$['data']['posts'][1]", [2], "id"),
    ("$.data.posts[-1]", ["3"], "id"),
    ("$.data.posts[9]", [], "id"),
    ("$.data.posts[*]", [1, 2, "3"], "id"),
    ("$.data.posts[*].t", ["a", "b"], "value"),
    ("$.data.posts[?(@.id > 1)]", [2], "id"),
    ("$.data.posts[?@.id != 1]", [2, "3"], "id"),
    ("$.data.posts[?(@.t == 'b')]", [2], "id"),
    ("$.data.posts[?(@.t)]", [1, 2], "id"),
    ("$.data.n", [2], "value"),
    ("$.nope", [], "id"),
    ('$["odd name"]', [[1, 2]], "value"),
    ("$['odd name'][*]", [1, 2], "value"),
    ("$.many[*][*].z", [1, 2, 3], "value"),
    ("$.many[*]", [[{"z": 1}], [{"z": 2}, {"z": 3}]], "value"),
]


def test_json_paths(spark):
    for path, expected, key in PATHS:
        got = rows(json_items(bodies(spark, ("u", json.dumps(DOC))), path))
        assert [r[key] if key else r for r in got] == expected, path


SHELF = {
    "rows": [{"id": i, "n": i * i % 5, "sub": {"id": 10 + i, "tags": ["t", i]}} for i in range(6)],
    "odd, name": {"id": 99},
}
IDS = lambda keep: [r["id"] for r in SHELF["rows"] if keep(r)]


@pytest.mark.parametrize(
    "path, expected",
    [
        ("$.rows[1:3].id", [1, 2]),
        ("$.rows[-2:].id", [4, 5]),
        ("$.rows[::2].id", [0, 2, 4]),
        ("$.rows[4:1:-2].id", [4, 2]),
        ("$.rows[::-1].id", [5, 4, 3, 2, 1, 0]),
        ("$.rows[:99].id", [0, 1, 2, 3, 4, 5]),
        ("$.rows[1:4:0].id", []),
        ("$.rows[0,-1,2].id", [0, 5, 2]),
        ("$.rows[0]['id','n']", [0, 0]),
        ("$.rows[1:3, 0].sub.id", [11, 12, 10]),
        ("$['odd, name'].id", [99]),
        ("$..id", sorted([*range(6), *range(10, 16), 99], key=lambda i: (i == 99, i % 10, i))),
        ("$.rows[2]..tags[1]", [2]),
        ("$..[?@.n > 3].id", IDS(lambda r: r["n"] > 3)),
        ("$.rows[?@.n > 0 && @.n < 4].id", IDS(lambda r: 0 < r["n"] < 4)),
        ("$.rows[?(@.n == 0 || !(@.sub.id < 14))].id", IDS(lambda r: r["n"] == 0 or r["id"] >= 4)),
        ("$.rows[?!@.nope && 3 <= @.id].id", IDS(lambda r: r["id"] >= 3)),
        ("$.rows[?@['sub'].id == 13].id", [3]),
    ],
)
def test_more_json_paths(spark, path, expected):
    found = [r["value"] for r in rows(json_items(bodies(spark, ("u", json.dumps(SHELF))), path))]
    assert sorted(found) == sorted(expected) if path == "$..id" else found == expected


HALL = {
    "top": 2,
    "names": ["Ann", "Bo"],
    "rows": [
        {"id": 0, "name": "Ann", "n": 1, "tags": [], "at": {"x": [1, 2]}},
        {"id": 1, "name": "Bo", "n": 2, "tags": ["a", "b"], "at": {"x": [2, 1]}},
        {"id": 2, "name": "Bob\nAnn", "n": 2.0, "tags": ["b"], "at": None},
        {"id": 3, "name": 5, "n": "2", "tags": {"a": 1, "b": 2, "c": 3}},
    ],
}


@pytest.mark.parametrize(
    "test, expected",
    [
        ("length(@.name) == 3", [0]),
        ("length(@.tags) >= 2", [1, 3]),
        ("length(@.n) == length(@.nope)", [0, 1, 2]),
        ("length(@.name) != 3", [1, 2, 3]),
        ("count(@.tags[*]) == 2", [1]),
        ("count(@..x[*]) > 0", [0, 1]),
        ("count(@['id','n']) == 2 && count(@.nope.*) < 1", [0, 1, 2, 3]),
        ("match(@.name, 'B.*')", [1]),
        ("match(@.name, 'A|Bo')", [1]),
        ("search(@.name, 'nn$')", [0, 2]),
        ("!search(@.name, 'B')", [0, 3]),
        ("value(@..x[0]) == 2", [1]),
        ("value(@.tags.*) == 'b'", [2]),
        ("value(@.tags[*]) == @.nope", [0, 1, 3]),
        ("@.n == $.top", [1, 2]),
        ("@.n < $.top", [0]),
        ("@.name == $.names[-1]", [1]),
        ("count($.rows[?@.n == 2]) == 2", [0, 1, 2, 3]),
        ("@.at.x[0] > @.at.x[1]", [1]),
        ("@.at.x == $.rows[0].at.x", [0]),
        ("@.tags == $.rows[2].tags", [2]),
        ("@.at == null", [2]),
        ("@.at", [0, 1, 2]),
        ("@.tags[?@ == 'a']", [1]),
        ("@.tags[1]", [1]),
        ("@.nope <= @.none", [0, 1, 2, 3]),
        ("@.nope == null", []),
        ("@.name == 'Bob\\nAnn'", [2]),
        ("1 < 2", [0, 1, 2, 3]),
    ],
)
def test_functions_and_queries_in_tests(spark, test, expected):
    found = json_items(bodies(spark, ("u", json.dumps(HALL))), f"$.rows[?{test}].id")
    assert [r["value"] for r in rows(found)] == expected


@pytest.mark.parametrize(
    "test, reason",
    [
        ("length(@.a)", "compares"),
        ("length(@.*) > 1", "one place"),
        ("count('a') > 1", "takes a query"),
        ("count(1, 2) > 1", "takes 1 argument"),
        ("match(@.a)", "takes 2 arguments"),
        ("match(@.a, @.b)", "in quotes"),
        ("match(@.a, '(')", "bad regex"),
        ("match(@.a, 'x') == true", "can be compared"),
        ("@.* == 1", "one place"),
        ("size(@.a) == 1", "no function `size`"),
        ("@.a == '\\q'", "bad escape"),
    ],
)
def test_bad_functions_are_reported_before_any_job(spark, test, reason):
    with pytest.raises(ValueError, match=f"bad JSONPath.*{reason}"):
        json_items(bodies(spark, ("u", "[]")), f"$[?{test}]")


def test_descent_order_and_depth(spark):
    tree = {"a": [{"b": 1}, [2, {"b": [3]}]], "c": {"b": 4}}
    found = [r["value"] for r in rows(json_items(bodies(spark, ("u", json.dumps(tree))), "$..b"))]
    assert found == [1, [3], 4]
    deep = 1
    for _ in range(40):
        deep = [deep]
    landed = bodies(spark, ("u", json.dumps({"x": deep, "y": [deep]})))
    for items in (json_items(landed, "$..[?@ == 1]"), parse_json_bodies(landed, "$..[?@ == 1]").items):
        assert [r["value"] for r in rows(items)] == [1, 1]


def test_descent_reaches_every_level(spark):
    chain = lambda n: '{"a":' * (n - 1) + '{"id":%d}' % n + "}" * (n - 1)
    landed = bodies(spark, *((str(n), chain(n)) for n in (3, 33, 34, 900, 1500)))
    parsed = parse_json_bodies(landed, "$..id")
    assert sorted(r["value"] for r in rows(parsed.items)) == [3, 33, 34, 900]
    assert [tuple(r) for r in parsed.rejects.collect()] == [("1500", "cannot parse JSON")]


@pytest.mark.parametrize("path", ["$$$nonsense", "data", "$.a[", "$..", "$.a[?(@.b ~ 1)]", "$[x]", "$[1,]", "$[?1]", "$[?@.a &&]", "$[?(@.a]", "$[1:2"])
def test_bad_json_path(spark, path):
    with pytest.raises(ValueError, match="bad JSONPath"):
        json_items(bodies(spark, ("u", "[]")), path)


def test_malformed_json(spark):
    broken = ["{not json", "", "1 2", "[1] x", "1], [2", '"a": 1}', None]
    pairs = [(f"b{i}", text) for i, text in enumerate(broken)]
    parsed = parse_json_bodies(bodies(spark, ("ok", ' [{"a": 1}] \n'), *pairs))
    assert rows(parsed.items) == [{"a": 1}]
    assert {r["url"] for r in parsed.rejects.collect()} == {url for url, _ in pairs}
    with pytest.raises(PySparkException, match="cannot parse JSON at b0"):
        json_items(bodies(spark, *pairs[:1])).df.collect()
    assert rows(json_items(bodies(spark, ("u", '{"a": 1, "a": 2}')))) == [{"a": 2}]


def test_csv_bodies(spark):
    text = 'title,link\n"Hi, ""you""\nthere",https://x.dev/1\nBye,\n\n'
    parsed = parse_csv_bodies(bodies(spark, ("1", text), ("2", ""), ("3", "a,b\n1,2\n1,2,3\n"), ("4", "x\n7\n")))
    assert rows(parsed.items) == [
        {"title": 'Hi, "you"\nthere', "link": "https://x.dev/1"}, {"title": "Bye", "link": ""}, {"x": "7"},
    ]
    assert [tuple(r) for r in parsed.rejects.collect()] == [("3", "bad CSV")]
    with pytest.raises(PySparkException, match="bad CSV at 3"):
        csv_items(bodies(spark, ("3", "a,b\n1\n"))).df.collect()


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n" + "".join(f"{i},n{i}\n" for i in range(500)))
    (tmp_path / "b.csv").write_text('id,name\n500,""\n501,\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        items = read_csv(spark, str(tmp_path))
        assert column(items, "id") == [str(i) for i in range(502)]
        assert column(items.tail(3), "name") == ["n499", "", ""]
        assert column(items.filter(["id > 498"]).reverse(), "id") == ["501", "500", "499"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "c.csv").write_text("id,name\n1,2,3\n")
    with pytest.raises(Exception, match="Malformed"):
        read_csv(spark, str(tmp_path)).df.select("id").collect()
    with pytest.raises(Exception, match="Malformed"):
        read_csv(spark, str(tmp_path)).df.count()


def test_files_as_bodies(spark, tmp_path):
    (tmp_path / "1.xml").write_text(RSS)
    (tmp_path / "2.xml").write_text(ATOM)
    assert landed_files(spark, str(tmp_path)).count() == 2
    assert column(read_feeds(spark, str(tmp_path)), "title") == ["One & only", "Two", "Entry", "Bare"]
    (tmp_path / "j.json").write_text(json.dumps(DOC, indent=1))
    assert column(read_json(spark, str(tmp_path / "j.json"), "$.data.posts"), "id") == [1, 2, "3"]


def test_bodies_need_their_columns(spark):
    with pytest.raises(ValueError, match="url and body"):
        feed_items(spark.range(1))
