"""RSS 2.0 / 0.9x / 1.0, Atom and JSON Feed bodies to items with the usual keys.

Stated subset: entry ids, titles, links, summaries, bodies, dates and authors.
An entry without an id gets no guid, relative links stay relative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rivulet.functions.views import let, moment_from_text, moment_text
from rivulet.items import Items
from rivulet.sources.landed import (
    ITEM_KEY,
    SOURCE_KEY,
    Parsed,
    landed_files,
    require_bodies,
)

# Element and field names of the feed formats.
FEED_KEYS = ("guid", "title", "link", "description", "content", "pubDate", "author")
_RSS_ITEM = (
    "struct<title: array<string>, link: array<string>, description: array<string>, "
    "`content:encoded`: array<string>, pubDate: array<string>, `dc:date`: array<string>, "
    "guid: array<struct<_VALUE: string>>, author: array<string>, "
    "`dc:creator`: array<string>, _about: string, `_rdf:about`: string>"
)
_ATOM_LINK = "struct<_href: string, _rel: string>"
_ATOM_ENTRY = (
    "struct<title: array<string>, id: array<string>, "
    f"link: array<{_ATOM_LINK}>, summary: array<string>, content: array<string>, "
    "published: array<string>, updated: array<string>, "
    "author: array<struct<name: array<string>>>>"
)
XML_SCHEMA = (
    f"channel struct<item: array<{_RSS_ITEM}>>, item array<{_RSS_ITEM}>, "
    f"entry array<{_ATOM_ENTRY}>, _corrupt_record string"
)
JSON_SCHEMA = (
    "version string, items array<struct<id: string, url: string, title: string, "
    "summary: string, content_html: string, content_text: string, "
    "date_published: string, date_modified: string, "
    "author: struct<name: string>, authors: array<struct<name: string>>>>"
)
ITEM_TYPE = "struct<" + ", ".join(f"{key}: string" for key in FEED_KEYS) + ">"
# The root element, after any declaration, comments and doctype.
ROOT_PATTERN = r"^(?s)\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<([A-Za-z:]+)[\s>/]"


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _date(*texts: Column) -> Column:
    """The first text that is a date, read once; texts after it are not read."""
    return let(F.coalesce(*[moment_from_text(t) for t in texts]), moment_text)


def _item(guid, title, link, description, content, date, author) -> Column:
    values = (guid, title, link, description, content, date, author)
    return F.struct(*[v.cast("string").alias(k) for k, v in zip(FEED_KEYS, values)])


def _rss_item(entry: Column) -> Column:
    return _item(
        F.coalesce(_first(entry["guid"])["_VALUE"], entry["_rdf:about"]),
        _first(entry["title"]),
        _first(entry["link"]),
        _first(entry["description"]),
        _first(entry["content:encoded"]),
        _date(_first(entry["pubDate"]), _first(entry["dc:date"])),
        F.coalesce(_first(entry["author"]), _first(entry["dc:creator"])),
    )


def _atom_item(entry: Column) -> Column:
    return _item(
        F.nullif(_first(entry["id"]), F.lit("")),
        _first(entry["title"]),
        _first(entry["link"])["_href"],
        _first(entry["summary"]),
        _first(entry["content"]),
        _date(_first(entry["published"]), _first(entry["updated"])),
        _first(_first(entry["author"])["name"]),
    )


def _json_item(entry: Column) -> Column:
    return _item(
        entry["id"],
        entry["title"],
        entry["url"],
        entry["summary"],
        F.coalesce(entry["content_html"], entry["content_text"]),
        _date(entry["date_published"], entry["date_modified"]),
        F.coalesce(_first(entry["authors"])["name"], entry["author"]["name"]),
    )


def _xml_entries(root: Column, feed: Column) -> Column:
    rss = F.coalesce(
        F.transform(feed["channel"]["item"], _rss_item), F.transform(feed["item"], _rss_item)
    )
    found = F.when(root == "feed", F.transform(feed["entry"], _atom_item)).otherwise(rss)
    return F.coalesce(found, _none())


def _json_entries(feed: Column) -> Column:
    return F.coalesce(F.transform(feed["items"], _json_item), _none())


def _none() -> Column:
    return F.array().cast(f"array<{ITEM_TYPE}>")


def _parsed(bodies: DataFrame) -> DataFrame:
    """url and the parsed form of each body, xml or json; both null if it is no feed. A
    byte-order mark in front is dropped."""
    body = F.regexp_replace(F.col("body"), "^\uFEFF", "")
    root = F.regexp_extract(body, ROOT_PATTERN, 1)
    parsed = F.struct(
        root.alias("root"),
        F.when(root.isin("rss", "rdf:RDF", "feed"), F.from_xml(body, XML_SCHEMA)).alias("xml"),
        F.when(body.rlike(r"^\s*\{"), F.from_json(body, JSON_SCHEMA)).alias("json"),
    )
    return require_bodies(bodies).select("url", parsed.alias("feed"))


def _is_feed(feed: Column) -> Column:
    """Told by the parsers alone, without building an entry."""
    xml = feed["xml"].isNotNull() & feed["xml"]["_corrupt_record"].isNull()
    return xml | F.coalesce(feed["json"]["version"].contains("jsonfeed.org"), F.lit(False))


def _entries(feed: Column) -> Column:
    """The entries of one parsed feed in order."""
    xml = _xml_entries(feed["root"], feed["xml"])
    return F.when(feed["xml"].isNotNull(), xml).otherwise(_json_entries(feed["json"]))


def _exploded(parsed: DataFrame, entries: Column) -> Items:
    df = parsed.select(
        F.col("url").alias(SOURCE_KEY), F.posexplode(entries).alias(ITEM_KEY, "entry")
    )
    columns = [F.col("entry")[key].alias(key) for key in FEED_KEYS]
    return Items.from_ordered(df.select(*columns, SOURCE_KEY, ITEM_KEY), [SOURCE_KEY, ITEM_KEY])


def parse_feed_bodies(bodies: DataFrame) -> Parsed:
    """Items of landed feeds in (url, entry) order, with the bodies that are no
    feed set aside."""
    parsed, feed = _parsed(bodies), F.col("feed")
    rejects = parsed.where(~_is_feed(feed)).select("url", F.lit("cannot parse feed").alias("reason"))
    return Parsed(_exploded(parsed.where(_is_feed(feed)), _entries(feed)), rejects)


def feed_items(bodies: DataFrame) -> Items:
    """Like ``parse_feed_bodies``, but a malformed body fails the run."""
    parsed, feed = _parsed(bodies), F.col("feed")
    failure = F.raise_error(F.concat(F.lit("cannot parse feed at "), F.col("url")))
    entries = F.when(_is_feed(feed), _entries(feed)).otherwise(failure.cast(f"array<{ITEM_TYPE}>"))
    return _exploded(parsed, entries)


def read_feeds(spark: SparkSession, files: str | list[str]) -> Items:
    return feed_items(landed_files(spark, files))
