"""Writing items out: sharded files for any size, one string for bounded results."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions.profile import key_list
from rivulet.functions.views import text_view, variant_text
from rivulet.items import DYNAMIC_COLUMN, Items, quoted
from rivulet.sinks.documents import (
    CHANNEL_DESCRIPTION,
    check_format,
    document_parts,
    json_text,
)


def write_document(
    items: Items,
    path: str,
    format: str = "rss",
    title: str = "",
    description: str = CHANNEL_DESCRIPTION,
    mode: str = "errorifexists",
) -> None:
    """One document as ordered part files under ``path``: joined in name order
    they are the document. The parts are range partitioned by the item order, so
    no task sees more than its share."""
    parts = document_parts(items, format, title, description)
    keys = parts.sort_columns()
    ordered = parts.df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select("text").write.mode(mode).text(path)


def document_text(
    items: Items,
    format: str = "rss",
    title: str = "",
    description: str = CHANNEL_DESCRIPTION,
) -> str:
    """One document as a string. Only for items cut by ``limit`` or ``tail``,
    which bounds what reaches the driver."""
    if items.max_rows is None:
        raise ValueError("the result is unbounded: limit it first, or use write_document")
    rows = document_parts(items, format, title, description).ordered().collect()
    return "".join(row["text"] + "\n" for row in rows)


def write_records(
    items: Items, path: str, format: str = "json", mode: str = "errorifexists"
) -> None:
    """One record per line, in item order across the part files: JSON objects
    (NDJSON), or CSV with a header in every file."""
    check_format(format)
    keys = items.sort_columns()
    ranged = items.df if items.df.isStreaming or not keys else (
        items.df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    )
    ready = items.with_df(ranged)
    if format == "json":
        ready.df.select(json_text(ready).alias("value")).write.mode(mode).text(path)
    elif format == "csv":
        names = key_list(items)
        cells = [
            F.coalesce(_cell(ready, name), F.lit("")).alias(name) for name in names
        ]
        writer = ready.df.select(*cells).write.mode(mode).option("header", True)
        writer.option("emptyValue", "").option("escape", '"').csv(path)
    else:
        raise ValueError(f"`{format}` is one document: use write_document")


def _cell(items: Items, name: str):
    if items.dynamic:
        value = F.element_at(quoted(DYNAMIC_COLUMN), F.lit(name))
        return variant_text(value)
    return text_view(quoted(name), items.dtype(name))
