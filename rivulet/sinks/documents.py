"""RSS, Atom, JSON and CSV text of items, built as Column expressions.

Every format has the same three parts: a head, one fragment per item and a
foot. Fragments are made where the items are; only head and foot are single
rows. What a format cannot express is left out, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rivulet.functions import views
from rivulet.functions.profile import key_list
from rivulet.items import DYNAMIC_COLUMN, Field, Items, quoted
from rivulet.operators.order import numbered
from rivulet.operators.union import union

# Format names, document parts and key names.
FORMATS = ("rss", "atom", "json", "csv")
CHANNEL_DESCRIPTION = "Generated by rivulet"
EPOCH = "1970-01-01T00:00:00+00:00"
RSS_HEAD = (
    '<?xml version="1.0" encoding="utf-8"?>\n<rss version="2.0">\n  <channel>\n'
    "    <title>{title}</title>\n    <link></link>\n"
    "    <description>{description}</description>"
)
RSS_FOOT = "  </channel>\n</rss>"
ATOM_HEAD = (
    '<?xml version="1.0"?>\n<feed xmlns="http://www.w3.org/2005/Atom">\n'
    "  <title>{title}</title>\n  <id>{title}</id>\n  <updated>"
)
ATOM_FOOT = "</feed>"


def check_format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"no such format: `{name}`; there are rss, atom, json and csv")
    return name


# --- escaping --------------------------------------------------------------


_XML_ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}


def _xml_literal(text: str) -> str:
    for char, entity in _XML_ENTITIES.items():
        text = text.replace(char, entity)
    return text


def xml_text(text: Column) -> Column:
    for char, entity in _XML_ENTITIES.items():
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def cdata(text: Column) -> Column:
    inner = F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(F.lit("<![CDATA["), inner, F.lit("]]>"))


def json_string(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    inner = F.substring(listed, F.lit(2), F.length(listed) - F.lit(2))
    return F.when(text.isNotNull(), inner)


def csv_cell(text: Column) -> Column:
    doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), doubled).otherwise(text)


# --- fragments -------------------------------------------------------------


def _line(depth: int, before: str, text: Column, after: str) -> Column:
    return F.concat(F.lit("  " * depth + before), text, F.lit(after))


def rss_fragment(items: Items) -> Column:
    """An ``<item>`` element with the six keys RSS has a place for."""

    def plain(key: str) -> Column:
        return _line(3, f"<{key}>", xml_text(items.field(key).text), f"</{key}>")

    return F.concat_ws(
        "\n",
        F.lit("    <item>"),
        plain("title"),
        plain("link"),
        _line(3, "<description>", cdata(items.field("description").text), "</description>"),
        plain("author"),
        _line(3, '<guid isPermaLink="false">', xml_text(items.field("guid").text), "</guid>"),
        _line(3, "<pubDate>", views.rfc2822_text(items.field("pubDate").moment), "</pubDate>"),
        F.lit("    </item>"),
    )


def atom_fragment(items: Items) -> Column:
    """An ``<entry>`` element; the link stands in for a missing id, the epoch for
    a missing date."""
    title, link = items.field("title").text, items.field("link").text
    entry_id = F.coalesce(items.field("guid").text, link, F.lit(""))
    updated = F.coalesce(views.moment_text(items.field("pubDate").moment), F.lit(EPOCH))
    author = _line(3, "<name>", xml_text(items.field("author").text), "</name>")
    return F.concat_ws(
        "\n",
        F.lit("  <entry>"),
        _line(2, "<title>", xml_text(F.coalesce(title, F.lit(""))), "</title>"),
        _line(2, "<id>", xml_text(entry_id), "</id>"),
        _line(2, "<updated>", updated, "</updated>"),
        F.concat(F.lit("    <author>\n"), author, F.lit("\n    </author>")),
        _line(2, '<link href="', xml_text(link), '" rel="alternate"/>'),
        _line(2, "<summary>", xml_text(items.field("description").text), "</summary>"),
        F.lit("  </entry>"),
    )


def _variant_json(value: Column) -> Column:
    def spelled(v: Column) -> Column:
        text = F.to_json(v)
        exponent = F.contains(text, F.lit("E")) & (F.schema_of_variant(v) == "DOUBLE")
        return F.when(exponent, views.variant_text(v)).otherwise(text)

    return views.let(value, spelled)


def _json_value(field: Field) -> Column:
    if isinstance(field.dtype, views.MOMENTS + (T.StringType,)):
        return json_string(field.text)
    if isinstance(field.dtype, T.VariantType):
        return _variant_json(field.value)
    if isinstance(field.dtype, views.FRACTIONAL):
        number = field.value.cast("double")
        finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
        return F.when(finite, field.text).otherwise(F.when(field.present, F.lit("null")))
    return field.text


def json_text(items: Items, joiner: str = ",", colon: str = ":") -> Column:
    """The whole item as one JSON object, keys in order, missing fields left out."""
    if items.dynamic:
        item = quoted(DYNAMIC_COLUMN)
        pairs = F.transform(
            F.array_sort(F.map_keys(item)),
            lambda k: F.concat(json_string(k), F.lit(colon), _variant_json(F.element_at(item, k))),
        )
        body = F.array_join(pairs, joiner)
    else:
        fields = [(name, items.field_of_column(name)) for name in sorted(items.columns)]
        body = F.concat_ws(
            joiner,
            *[
                F.concat(json_string(F.lit(name)), F.lit(colon), _json_value(field))
                for name, field in fields
            ],
        )
    return F.concat(F.lit("{"), body, F.lit("}"))


def json_block(items: Items) -> Column:
    """The object as a block of an indented array, one field per line."""
    text = json_text(items, joiner=",\n    ", colon=": ")
    inner = F.substring(text, F.lit(2), F.length(text) - F.lit(2))
    return F.when(inner == "", F.lit("  {}")).otherwise(
        F.concat(F.lit("  {\n    "), inner, F.lit("\n  }"))
    )


def csv_record(items: Items, keys: list[str]) -> Column:
    def cell(key: str) -> Column:
        if items.dynamic:
            value = F.element_at(quoted(DYNAMIC_COLUMN), F.lit(key))
            return csv_cell(F.coalesce(views.variant_text(value), F.lit("")))
        return csv_cell(F.coalesce(items.field_of_column(key).text, F.lit("")))

    cells = [cell(key) for key in keys]
    if len(cells) == 1:  # a lone empty cell would read back as no record
        return F.when(cells[0] == "", F.lit('""')).otherwise(cells[0])
    return F.concat_ws(",", *cells)


def csv_header(keys: list[str]) -> str:
    cells = []
    for key in keys:
        special = any(c in key for c in '",\r\n')
        cells.append('"' + key.replace('"', '""') + '"' if special else key)
    return '""' if cells == [""] else ",".join(cells)


def fragment(items: Items, format: str, keys: list[str] | None = None) -> Column:
    """The text one item contributes to a document of ``format``."""
    if check_format(format) == "rss":
        return rss_fragment(items)
    if format == "atom":
        return atom_fragment(items)
    if format == "json":
        return json_text(items)
    return csv_record(items, key_list(items) if keys is None else keys)


# --- documents -------------------------------------------------------------


def document_parts(
    items: Items, format: str, title: str = "", description: str = CHANNEL_DESCRIPTION
) -> Items:
    """A whole document as ordered text parts: head, one part per item, foot.

    The parts are items themselves (column ``text``), so they sort and write in
    parallel; joined by line breaks in order they are the document.
    """
    check_format(format)
    items.require_batch("a document")
    if format == "json":
        return _json_parts(items)
    if format == "csv":
        keys = key_list(items)
        if not keys:  # no field anywhere: an empty document
            return _assemble(items.with_df(items.df.where("false")), F.lit(""), None, None)
        head = _one_row(items).select(F.lit(csv_header(keys)).alias("text"))
        return _assemble(items, csv_record(items, keys), head, None)
    names = {"title": _xml_literal(title), "description": _xml_literal(description)}
    if format == "rss":
        head = _one_row(items).select(F.lit(RSS_HEAD.format(**names)).alias("text"))
        return _assemble(items, rss_fragment(items), head, RSS_FOOT)
    dated = F.max(F.coalesce(items.field("pubDate").moment, F.lit(EPOCH).cast("timestamp")))
    updated = F.coalesce(views.moment_text(F.col("latest")), F.lit(EPOCH))
    head = items.df.agg(dated.alias("latest")).select(
        F.concat(F.lit(ATOM_HEAD.format(**names)), updated, F.lit("</updated>")).alias("text")
    )
    return _assemble(items, atom_fragment(items), head, ATOM_FOOT)


def _one_row(items: Items) -> DataFrame:
    return items.df.sparkSession.range(1)


def _json_parts(items: Items) -> Items:
    """Only the first object has no comma before it, so places are needed."""
    pos = items.fresh_hidden(1)[0]
    placed = items.with_df(numbered(items, pos))
    block = json_block(placed)
    text = F.when(quoted(pos) == 1, F.concat(F.lit("[\n"), block)).otherwise(block)
    last = placed.df.agg(F.max(pos).alias("last"))
    ending = F.when(F.col("last").isNull(), F.lit("[]")).otherwise(F.lit("]"))
    foot = last.select(ending.alias("text"))
    comma = F.when(quoted(pos) == last.scalar(), F.lit("")).otherwise(F.lit(","))
    return _assemble(placed, F.concat(text, comma), None, foot)


def _assemble(
    items: Items, text: Column, head: DataFrame | None, foot: DataFrame | str | None
) -> Items:
    body = items.with_df(
        items.df.select(text.alias("text"), *[quoted(k.column) for k in items.order]),
        dynamic=False,
    )
    parts = [body]
    if isinstance(foot, str):
        foot = _one_row(items).select(F.lit(foot).alias("text"))
    if head is not None:
        parts.insert(0, Items(head, (), False, 1))
    if foot is not None:
        parts.append(Items(foot, (), False, 1))
    return union(parts)
