"""What the registered queries share: tables as items, and one fixed clock."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from rivulet import Items
from rivulet.session import pin_utc

Query = Callable[[SparkSession, str], DataFrame]

# The clock of every query that asks for one; events end the day before.
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)

# Column sets that identify and order the rows of each table.
KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Items:
    """A table as items in key order, narrowed to ``columns`` if any are given."""
    df = table(spark, sf_dir, name)
    if columns:
        df = df.select(*columns)
    return Items.from_table(df, KEYS[name])


def labelled_documents(spark: SparkSession, sf_dir: str, *columns: str) -> Items:
    """Documents with the quality label where there is one, missing elsewhere."""
    documents = table(spark, sf_dir, "documents").select("doc_id", *columns)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return Items.from_table(documents.join(labels, "doc_id", "left"), "doc_id")
