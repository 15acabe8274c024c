"""Session conventions: UTC everywhere, checkpoints in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Z", "+00:00"}


def pin_utc(spark: SparkSession) -> SparkSession:
    """Naive dates mean UTC, so the session must not shift them."""
    if spark.conf.get("spark.sql.session.timeZone") not in _UTC_NAMES:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local master may fall
    back to a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder that every executor can reach"
            )
        folder = tempfile.mkdtemp(prefix="rivulet-checkpoint-")
    context.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialize ``df`` reliably, keeping its partitions and row order."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
