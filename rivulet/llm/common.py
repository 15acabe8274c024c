"""What the operators share: text batches of bounded size, tables, storage that outlives executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rivulet.session import ensure_checkpoint_dir, pin_utc

# Text that a Python worker unpacks at once; a longer single text comes alone.
PART_BYTES = 2 << 20


# Bytes of a batch of rows on its way to and from a Python worker.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(spark: SparkSession) -> SparkSession:
    """Long texts must not pile up in a worker: rows travel in batches of a few MB. The
    setting is the session's and stays; a smaller one is left alone."""
    if int(spark.conf.get(_BATCH_SETTING).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return in_small_batches(pin_utc(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session's checkpoints go to."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder, so that later readers neither
    repeat the work nor depend on the executors that did it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compact(df: DataFrame, bound: int, rows: int = 250_000) -> tuple[DataFrame, int]:
    """Written once in as many files as ``bound``, the most rows it can have, needs, and
    counted. What comes of a shuffle may be much smaller than what went in, and every
    partition is a file here and in each shuffle that follows.

    A checkpoint keeps the planner's estimate of its size, for a join the product of
    both sides. Tables that are joined anew in every round would have estimates of so
    many digits that the driver's memory goes on them; the size of files is known."""
    path = f"{checkpoint_folder(df.sparkSession)}/compact-{uuid4()}"
    df.coalesce(max(1, -(-bound // rows))).write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    return written, written.count()


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which is cheap to read, marked for broadcast if it has at most ``rows``
    rows; beyond that Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def training_row(doc_id) -> Column:
    """Rows that models may learn labels from; the others are held out."""
    return fold(doc_id) != 2


def fold(doc_id) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about PART_BYTES of ``column``."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for row, size in enumerate(lengths):
        if held and held + size > PART_BYTES:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    text: str,
    keep: list[str],
    results: list[str],
    worker: Callable[[], Callable[[list[str | None]], list[pa.Array]]],
) -> DataFrame:
    """``keep`` columns and what ``worker`` makes of the texts, a row for a row.

    ``worker`` is called once in each task and returns the function from a list of
    texts to the result columns, declared in ``results`` as "name type". Every
    other column of ``df`` is left behind, so no name can clash with a result.
    """
    in_small_batches(df.sparkSession)
    kept = df.select(*keep, F.col(text).alias("__text"))
    columns = [(f.name, f.dataType.simpleString()) for f in kept.schema.fields[:-1]]
    columns += [tuple(r.split(" ", 1)) for r in results]
    names = [name for name, _ in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = worker()
        for batch in batches:
            for part in parts(batch, len(keep)):
                made = work(part.column(len(keep)).to_pylist())
                arrays = [part.column(i) for i in range(len(keep))] + made
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return kept.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in columns))
