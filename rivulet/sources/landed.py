"""Landed bodies: what a fetcher stored, one ``(url, body)`` row per document.

Fetching itself is not this library's job. A job reads bodies that have landed
as files or in a table, so one job parses many documents in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from rivulet.items import HIDDEN, Items
from rivulet.session import pin_utc

SOURCE_KEY = f"{HIDDEN}0"
ITEM_KEY = f"{HIDDEN}1"


@dataclass(frozen=True)
class Parsed:
    """Items of the bodies that parsed, and ``(url, reason)`` of those that did
    not."""

    items: Items
    rejects: DataFrame


def landed_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole files as bodies; the file path is the url."""
    pin_utc(spark)
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("body"))


def require_bodies(bodies: DataFrame) -> DataFrame:
    lacking = {"url", "body"} - set(bodies.columns)
    if lacking:
        raise ValueError(f"landed bodies need the columns url and body, not {bodies.columns}")
    pin_utc(bodies.sparkSession)
    return bodies
