"""JSON bodies to dynamic items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rivulet.functions.views import let
from rivulet.items import DYNAMIC_COLUMN, Items
from rivulet.sources.jsonpath import parse_path, select_elements
from rivulet.sources.jsonvalues import elements, members
from rivulet.sources.landed import (
    ITEM_KEY,
    SOURCE_KEY,
    Parsed,
    landed_files,
    require_bodies,
)

END_MARK = "end of the landed body"


def to_item(node: Column) -> Column:
    """Objects are items; anything else is kept under the key ``value``."""
    return F.coalesce(members(node), F.create_map(F.lit("value"), node))


def json_root(body: Column) -> Column:
    """The document as a VARIANT, NULL if it is not exactly one JSON value.

    Spark's parser stops after the first value. The end mark shows whether that
    was the whole body.
    """
    marked = F.concat(F.lit("["), body, F.lit(f',"{END_MARK}"]'))
    return let(
        elements(F.try_parse_json(marked)),
        lambda parts: F.when(
            (F.size(parts) == 2)
            & (F.try_variant_get(F.get(parts, F.lit(1)), "$", "string") == END_MARK),
            F.get(parts, F.lit(0)),
        ),
    )


def parse_json_bodies(bodies: DataFrame, path: str | None = None) -> Parsed:
    """Items of landed JSON documents in (url, element) order, with the bodies
    that are no JSON set aside. ``..`` reaches every level of a body."""
    root = json_root(F.col("body"))
    rejects = _with_path(bodies, path).where(root.isNull()).select(
        "url", F.lit("cannot parse JSON").alias("reason")
    )
    return Parsed(_exploded(bodies, path, otherwise=F.lit(None)), rejects)


def json_items(bodies: DataFrame, path: str | None = None) -> Items:
    """Like ``parse_json_bodies``, but a malformed body fails the run."""
    failure = F.raise_error(F.concat(F.lit("cannot parse JSON at "), F.col("url")))
    return _exploded(_with_path(bodies, path), path, otherwise=failure)


def read_json(spark: SparkSession, files: str | list[str], path: str | None = None) -> Items:
    return json_items(landed_files(spark, files), path)


def _with_path(bodies: DataFrame, path: str | None) -> DataFrame:
    """Check the arguments before any job starts."""
    require_bodies(bodies)
    if path and path.strip():
        parse_path(path)
    # As in most parsers, the last of two equal keys counts.
    bodies.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return bodies


def _exploded(bodies: DataFrame, path: str | None, otherwise: Column) -> Items:
    selected = let(
        json_root(F.col("body")),
        lambda root: F.when(root.isNotNull(), select_elements(root, path)).otherwise(
            otherwise.cast("array<variant>")
        ),
    )
    df = bodies.select(
        F.col("url").alias(SOURCE_KEY), F.posexplode(selected).alias(ITEM_KEY, "node")
    )
    df = df.select(to_item(F.col("node")).alias(DYNAMIC_COLUMN), SOURCE_KEY, ITEM_KEY)
    return Items.from_ordered(df, [SOURCE_KEY, ITEM_KEY])
