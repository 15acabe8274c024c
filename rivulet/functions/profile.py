"""Stream-level facts about fields: which keys occur, and row fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rivulet.items import DYNAMIC_COLUMN, Items, quoted


def key_union(items: Items) -> DataFrame:
    """The distinct top-level keys that occur on at least one item, with the
    number of items that have them."""
    if items.dynamic:
        keys = items.df.select(F.explode(F.map_keys(quoted(DYNAMIC_COLUMN))).alias("key"))
        return keys.groupBy("key").agg(F.count(F.lit(1)).alias("items"))
    if not items.columns:
        return items.df.select(F.lit("").alias("key"), F.lit(0).cast("bigint").alias("items")).limit(0)
    counts = items.df.agg(*[F.count(quoted(c)).alias(c) for c in items.columns])
    pairs = [
        F.struct(F.lit(c).alias("key"), quoted(c).alias("items")) for c in items.columns
    ]
    return counts.select(F.inline(F.array(*pairs))).where("items > 0")


def key_list(items: Items) -> list[str]:
    """``key_union`` on the driver: as many names as an item can have fields."""
    return sorted(row["key"] for row in key_union(items).select("key").collect())


def content_hash(items: Items) -> Column:
    """A fingerprint of each item's canonical JSON (keys in order)."""
    from rivulet.sinks.documents import json_text

    return F.sha2(json_text(items), 256)
