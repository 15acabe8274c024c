import csv
import io
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rivulet.sinks import document_text, json_text, write_document, write_records
from rivulet.sources import feed_items, json_items

# Every key and every character to escape; then records that lack most keys.
POSTS = [
    {"title": "Tide & <moon>", "link": "https://sea.test/t?x=<1>&y='2'", "description": "high ]]> \"low\"",
     "guid": "tide/7", "author": "R & D", "pubDate": "2024-11-05T06:07:08.900+00:00", "score": -3},
    {"description": "only,\ntext", "guid": "n2"},
    {"link": "https://sea.test/3", "author": "Ana", "pubDate": "2024-12-24"},
    {"score": 0},
]
SCHEMA = (
    "title string, link string, description string, guid string, author string, "
    "pubDate string, score bigint"
)

RSS_TEXT = """<?xml version="1.0" encoding="utf-8"?>
<rss version="2.0">
  <channel>
    <title>My &amp; feed</title>
    <link></link>
    <description>Generated by rivulet</description>
    <item>
      <title>Tide &amp; &lt;moon&gt;</title>
      <link>https://sea.test/t?x=&lt;1&gt;&amp;y=&apos;2&apos;</link>
      <description><![CDATA[high ]]]]><![CDATA[> "low"]]></description>
      <author>R &amp; D</author>
      <guid isPermaLink="false">tide/7</guid>
      <pubDate>Tue, 5 Nov 2024 06:07:08 +0000</pubDate>
    </item>
    <item>
      <description><![CDATA[only,
text]]></description>
      <guid isPermaLink="false">n2</guid>
    </item>
    <item>
      <link>https://sea.test/3</link>
      <author>Ana</author>
      <pubDate>Tue, 24 Dec 2024 00:00:00 +0000</pubDate>
    </item>
    <item>
    </item>
  </channel>
</rss>
"""

ATOM_TEXT = """<?xml version="1.0"?>
<feed xmlns="http://www.w3.org/2005/Atom">
  <title>My &amp; feed</title>
  <id>My &amp; feed</id>
  <updated>2024-12-24T00:00:00+00:00</updated>
  <entry>
    <title>Tide &amp; &lt;moon&gt;</title>
    <id>tide/7</id>
    <updated>2024-11-05T06:07:08.900+00:00</updated>
    <author>
      <name>R &amp; D</name>
    </author>
    <link href="https://sea.test/t?x=&lt;1&gt;&amp;y=&apos;2&apos;" rel="alternate"/>
    <summary>high ]]&gt; &quot;low&quot;</summary>
  </entry>
  <entry>
    <title></title>
    <id>n2</id>
    <updated>1970-01-01T00:00:00+00:00</updated>
    <summary>only,
text</summary>
  </entry>
  <entry>
    <title></title>
    <id>https://sea.test/3</id>
    <updated>2024-12-24T00:00:00+00:00</updated>
    <author>
      <name>Ana</name>
    </author>
    <link href="https://sea.test/3" rel="alternate"/>
  </entry>
  <entry>
    <title></title>
    <id></id>
    <updated>1970-01-01T00:00:00+00:00</updated>
  </entry>
</feed>
"""


def both(make):
    return [make.typed(POSTS, SCHEMA).limit(9), make.dynamic(POSTS).limit(9)]


def test_rss_document(make):
    for items in both(make):
        assert document_text(items, "rss", "My & feed") == RSS_TEXT
    ET.fromstring(RSS_TEXT.encode())


def test_atom_document(make):
    for items in both(make):
        assert document_text(items, "atom", "My & feed") == ATOM_TEXT
    ET.fromstring(ATOM_TEXT.encode())


def test_json_document(make):
    want = json.dumps(POSTS, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    for items in both(make):
        assert document_text(items, "json") == want


def test_csv_document(make):
    for items in both(make):
        text = document_text(items, "csv")
        lines = list(csv.DictReader(io.StringIO(text, newline="")))
        keys = sorted(POSTS[0])
        assert text.splitlines()[0] == ",".join(keys)
        assert lines == [{k: str(p.get(k, "")) for k in keys} for p in POSTS]


def test_empty_documents(make):
    for items in (make.typed([], SCHEMA).limit(5), make.dynamic([]).limit(5)):
        assert document_text(items, "json") == "[]\n"
        assert document_text(items, "csv") == ""
        for name, entry in (("rss", "item"), ("atom", "entry")):
            text = document_text(items, name, "E")
            assert ET.fromstring(text.encode()) is not None and f"<{entry}>" not in text
        assert "<updated>1970-01-01T00:00:00+00:00</updated>" in document_text(items, "atom")


def test_numbers_in_json(make, spark):
    wanted = '{"big":10000000000.0,"i":7,"neg":-0.5,"s":"1E5","tiny":1e-9}'
    dynamic = make.dynamic([{"i": 7, "big": 1e10, "tiny": 1e-9, "neg": -0.5, "s": "1E5"}])
    dynamic = dynamic.with_df(
        dynamic.df.withColumn(
            "item",
            F.map_concat(
                F.map_filter("item", lambda k, _: k != "big"),
                F.create_map(F.lit("big"), F.lit(1e10).cast("variant")),
            ),
        )
    )
    typed = dynamic.to_typed("i bigint, big double, tiny double, neg double, s string")
    for items in (dynamic, typed):
        assert items.df.select(json_text(items)).first()[0] == wanted


def test_csv_of_one_empty_cell(make):
    items = make.dynamic([{"a": ""}, {"a": "x"}, {}]).limit(5)
    assert document_text(items, "csv") == 'a\n""\nx\n""\n'


def test_formats_and_bounds_are_checked(make):
    items = make.typed(POSTS, SCHEMA)
    with pytest.raises(ValueError, match="`xml`"):
        document_text(items.limit(1), "xml")
    with pytest.raises(ValueError, match="unbounded"):
        document_text(items, "rss")
    with pytest.raises(ValueError, match="one document"):
        write_records(items, "/nowhere", "rss")


def joined(path) -> str:
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


@pytest.mark.parametrize("name", ["rss", "atom", "json", "csv"])
def test_part_files_join_to_the_document(spark, make, tmp_path, name):
    many = [{"title": f"T{i}", "guid": f"g{i}", "n": i} for i in range(300)]
    items = make.dynamic(many).reverse()
    target = tmp_path / name
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_document(items, str(target), name, "Many")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(target.glob("part-*"))) > 1
    assert joined(target) == document_text(items.limit(300), name, "Many")


def test_records(spark, make, tmp_path):
    items = make.dynamic(POSTS).reverse()
    write_records(items, str(tmp_path / "json"), "json")
    lines = joined(tmp_path / "json").splitlines()
    assert [json.loads(line) for line in lines] == POSTS[::-1]
    write_records(make.typed(POSTS[:2], SCHEMA), str(tmp_path / "csv"), "csv")
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"', multiLine=True)
    assert {(r["guid"], r["description"]) for r in back.collect()} == {
        (p["guid"], p["description"]) for p in POSTS[:2]
    }


def test_round_trip_through_rss_and_atom(spark, make):
    keys = ["guid", "title", "link", "description", "author", "pubDate"]
    for name in ("rss", "atom"):
        text = document_text(make.typed(POSTS[:1], SCHEMA).limit(1), name, "t")
        bodies = spark.createDataFrame([("u", text)], "url string, body string")
        want = {k: POSTS[0][k] for k in keys}
        if name == "rss":  # its dates have no fractions
            want["pubDate"] = want["pubDate"].replace(".900", "")
        assert rows(feed_items(bodies)) == [want]


def test_round_trip_through_json(spark, make):
    text = document_text(make.dynamic(POSTS).limit(9), "json")
    bodies = spark.createDataFrame([("u", text)], "url string, body string")
    assert rows(json_items(bodies)) == POSTS
