from __future__ import annotations

import json
import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession, functions as F, types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rivulet import Items  # noqa: E402
from rivulet.sources import json_items  # noqa: E402

NOW = datetime(2025, 3, 10, 12, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        # Many tiny queries: compiling less beats running fast.
        .config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Make:
    """Items from Python dicts, in list order, in either form."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def dynamic(self, rows: list[dict]) -> Items:
        body = json.dumps(rows)
        bodies = self.spark.createDataFrame([("mem", body)], "url string, body string")
        return json_items(bodies)

    def typed(self, rows: list[dict], schema: str) -> Items:
        wanted = T.StructType.fromDDL(schema + ", __n bigint")
        data = [tuple(r.get(f.name) for f in wanted.fields[:-1]) + (i,) for i, r in enumerate(rows)]
        df = self.spark.createDataFrame(data, wanted)
        made = Items.from_table(df, "__n")
        return made.with_df(made.df.drop("__n"))


@pytest.fixture(scope="session")
def make(spark):
    return Make(spark)


def rows(items: Items) -> list[dict]:
    """Items in order as dicts without the missing fields."""
    if items.dynamic:
        texts = items.ordered().select(F.to_json("item").alias("j")).collect()
        return [json.loads(r["j"]) for r in texts]
    return [
        {k: v for k, v in r.asDict(recursive=True).items() if v is not None}
        for r in items.ordered().collect()
    ]


def column(items: Items, name: str) -> list:
    return [r.get(name) for r in rows(items)]
