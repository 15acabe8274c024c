"""Landed files picked up as they arrive, in place of re-running on a timer.

Sources, filter, regex, transform and union work on a stream as they are. Steps
that need the whole input (sort, limit, tail, reverse, unique, documents) raise
``ValueError`` there; run those over what the stream has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rivulet.items import Items
from rivulet.session import pin_utc
from rivulet.sinks.documents import json_text


def stream_landed_files(spark: SparkSession, path: str) -> DataFrame:
    """New files under ``path`` as ``(url, body)`` rows of a stream."""
    pin_utc(spark)
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("body"))


def append_records(
    bodies: DataFrame,
    parse: Callable[[DataFrame], Items],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Parse what has landed since the last call and append it to ``path`` as one
    JSON object per line. ``checkpoint`` remembers what has been read, so each
    file is written once."""
    items = parse(bodies)
    lines = items.df.select(json_text(items).alias("value"))
    return (
        lines.writeStream.format("text")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
