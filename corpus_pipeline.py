"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from rivulet.llm import neardup, quality, rules
from rivulet.llm.common import checkpoint_folder, in_small_batches, small, stored, table
from rivulet.llm.queries import packed_pieces, quality_judged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that break a rule go, and documents that the rules reject. Null and empty
    texts are rejected."""
    in_small_batches(spark)
    judged = docs.withColumn("__rules", rules.clean_lines(F.col("text"), once=True)).where("__rules.kept")
    cleaned = judged.withColumn("text", F.col("__rules.clean_text"))
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior says low quality go."""
    judged = quality_judged(docs, table(spark, sf_dir, "labels"))
    return judged.where(F.col("__posterior") >= quality.THRESHOLD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: that of the smallest id (null
    last), then of the smallest text key; of rows that repeat both, the one whose other
    columns are smallest. Null texts are in no class and stay."""
    texts = stored(neardup.chosen(docs))
    keyed = docs.withColumn("__copy", neardup.copy_of(F.col("text")))

    def standing(of: DataFrame, how: str) -> DataFrame:
        """Rows that stand for their class, or with ``left`` have none to share."""
        named = of.toDF("__copy", "__best_id", "__best_copy", "__repeated")
        own = (F.col("__copy") == F.col("__best_copy")) & F.col("doc_id").eqNullSafe(F.col("__best_id"))
        joined = keyed.join(small(named, neardup.BROADCAST_ROWS), "__copy", how)
        return joined.where(F.col("__best_copy").isNull() | own)

    once = standing(texts, "left").where(~F.coalesce("__repeated", F.lit(False))).select(*docs.columns)
    repeated = texts.where(F.col("repeated") & (F.col("copy") == F.col("best_copy")))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # Each task leaves one row of those that repeat id and text.
    again = standing(repeated, "inner").groupBy("doc_id", "__copy").agg(
        F.first("text").alias("text"), F.min(F.struct(*rest)).alias("__rest")
    )
    return once.unionByName(again.select("doc_id", "text", *(F.col(f"__rest.{c}").alias(c) for c in rest)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packed_pieces(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

# Neither token ids nor signatures can be said in SQL; tests hold every stage against
# a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's rows are written as Parquet in the
    shared folder and read again, so no stage repeats the work of an earlier one."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid4()}"
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            path = f"{folder}/{place}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
