"""The registered queries: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rivulet.llm import (
    ann,
    balltree,
    bytebpe,
    chat,
    language,
    mixing,
    neardup,
    packing,
    quality,
    repair,
    rules,
    tokens,
    toxicity,
)
from rivulet.llm.common import fold, table, training_row

TOKEN_LIMIT = 2048


def op1_bitmask_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(training_row(F.col("doc_id"))))
    found = language.predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def held_out(doc_id) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


# A conversation whose texts say what another template would take for control.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op2_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    rows = table(spark, sf_dir, "conversations").select(*columns)
    hard = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema
    )
    return chat.read_back(chat.format_conversations(rows.union(hard)))


def op3_dart_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = neardup.classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op4_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    length = (F.octet_length("ids") / 4).cast("bigint")
    return pieces.select(
        "doc_id",
        "start",
        length.alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op6_hierarchical_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("__posterior").alias("score"),
        (F.col("__posterior") >= quality.THRESHOLD).alias("kept"),
    )


def quality_judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A source is the host, and its pages in one language are a path of it."""
    return quality.classify(docs, labels, host_col="source", path_col="lang")


def op7_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, models)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "documents").select(
        "doc_id", rules.clean_lines(F.col("text")).alias("rules")
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["n_lines", "n_failed_lines", "lost_chars"]
    return judged.select("doc_id", *(f"rules.{c}" for c in counts + ["base_failed", "kept"] + more))


# What a line-first rule says of one line, in DuckDB's words.
_FAILED = f"""
  CASE WHEN word_chars = 0 THEN false
       WHEN NOT regexp_matches(line, '[\\p{{L}}\\p{{N}}]') THEN true
       WHEN n_separators >= {rules.MENU_SEPARATORS}
            AND n_separators * 100 >= n_words * {rules.MENU_SHARE} THEN true
       WHEN n_symbols * 100 > word_chars * {rules.SYMBOL_SHARE} THEN true
       ELSE regexp_matches(lower(line), '{rules.BOILERPLATE}')
            AND n_words <= {rules.BOILERPLATE_WORDS} END"""

OP8_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), grams AS (
  SELECT doc_id, pos,
         count(*) OVER (PARTITION BY doc_id, words[pos], words[pos + 1], words[pos + 2]) AS times
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS pos FROM docs)
), repeated AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words
  FROM grams, (VALUES (0), (1), (2)) AS span(k) WHERE times > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
), measured AS (
  SELECT doc_id, line, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         len(list_filter(words, lambda w: regexp_full_match(w, '{rules.SEPARATORS}+'))) AS n_separators,
         len(regexp_extract_all(line, '[{rules.SYMBOLS}]')) AS n_symbols
  FROM lines
), judged AS (SELECT *, {_FAILED} AS failed FROM measured
), by_doc AS (
  SELECT doc_id, sum(n_words)::BIGINT AS n_words, sum(word_chars)::BIGINT AS word_chars,
         sum(n_symbols)::BIGINT AS n_symbols,
         (count(line) FILTER (n_words > 0) - count(DISTINCT line) FILTER (n_words > 0))::BIGINT AS n_dup_lines,
         count(*) AS n_lines, count(*) FILTER (failed) AS n_failed_lines,
         coalesce(sum(word_chars) FILTER (failed), 0)::BIGINT AS lost_chars
  FROM judged GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines,
       coalesce(n_repeat_words, 0) AS n_repeat_words,
       n_words < {rules.MIN_WORDS}
         OR coalesce(n_repeat_words, 0) * 100 > n_words * {rules.REPEAT_SHARE} AS base_failed,
       NOT base_failed AND lost_chars * 100 <= word_chars * {rules.LOST_SHARE} AS kept,
       n_lines, n_failed_lines, lost_chars
FROM by_doc LEFT JOIN repeated USING (doc_id)
"""


def op9_rank_synchronous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_piece_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bytebpe.encode(table(spark, sf_dir, "documents"), vocabulary)
    return bytebpe.decode(coded, vocabulary).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op12_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    query.__name__: query
    for query in (
        op1_bitmask_language_filters,
        op2_grammar_round_trip,
        op3_dart_minhash_classes,
        op4_inverted_multi_index,
        op5_sum_of_squares_packing,
        op6_hierarchical_bayes_quality,
        op7_kneser_ney_toxicity,
        op8_line_first_rules,
        op9_rank_synchronous_counts,
        op10_piece_bpe_round_trip,
        op11_subset_sum_mix,
        op12_ball_tree_search,
        op13_auction_repair,
    )
}

ORACLE = {"op8_line_first_rules": OP8_SQL}
