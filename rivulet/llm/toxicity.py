"""Toxicity by two class-conditional Kneser-Ney models that share their backoff."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rivulet.llm.common import fold, small, stored

DISCOUNT = 0.75
# Characters that a word's stem has: what a word is predicted from, and what stands
# for it where the word is rare.
STEM_CHARS = 5
# An entry stays in a model if its counts differ from what its backoff expects by this
# much of a likelihood-ratio statistic (about one chance in 10,000) and its ratio from
# the backoff's by this much, a factor of seven; the rest back off.
SIGNIFICANT = 15.0
MATERIAL = 2.0
# Larger tables than this are joined by a shuffle, not by a broadcast.
BROADCAST_ROWS = 1_000_000
# Steps on which the calibration is fitted.
BINS = 400
THRESHOLD = 0.3
# The part of the training rows that the models count, and the part that calibrates.
COUNTED_FOLDS, CALIBRATION_FOLD = (0, 1), 3


class Models(NamedTuple):
    """Log-likelihood ratios, toxic to ordinary, and what they mean."""

    words: DataFrame  # word, word_ratio
    stems: DataFrame  # stem, stem_ratio
    slope: float
    intercept: float


def words_of(text: Column) -> Column:
    """The different runs of letters in lower case: a text says a word once, so that
    one text that repeats a word a thousand times is one witness."""
    return F.filter(F.array_distinct(F.split(F.lower(text), "[^\\p{L}]+")), lambda w: w != "")


def _stem(word: Column) -> Column:
    return F.substring(word, 1, STEM_CHARS)


def _labelled(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, text, toxic and fold of the rows that may be learnt from. A label given more
    than once counts as toxic if it ever was."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(label_col).cast("int").alias("toxic"))
    )
    part = fold(F.col("__id"))
    docs = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    return docs.where(part != 2).join(small(known.where(part != 2), BROADCAST_ROWS), "__id").withColumn("fold", part)


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Models:
    """Count all labelled rows outside the held-out part, whole texts.

    A word is an event in two steps: its stem, then the word given the stem. Both are
    interpolated with absolute discounts,
        P(e) = (1 - g) * max(c(e) - D, 0) / sum of these  +  g * Q(e)
    where c are the counts of a class, e competes with all stems or with the words of
    its stem, and g is the mass that discounting frees, as a mean over the two classes:
    an event that neither class has seen then speaks for neither. Q is shared by the
    classes and made of Kneser-Ney continuation counts: in how many different contexts,
    here documents, the event occurs, as a share of all events it competes with.
    """
    rows = _labelled(df, labels, id_col, text_col, label_col)
    counted = rows.where(F.col("fold").isin(*COUNTED_FOLDS)).select(
        "toxic", F.explode(words_of(F.col("text"))).alias("word")
    )
    words = stored(
        counted.groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
        .withColumn("stem", _stem(F.col("word")))
    )
    stems = stored(words.groupBy("stem").agg(*_sums("t", "o")))
    total = stems.agg(*_sums("t_sum", "o_sum")).first()
    if not total["t_sum_sum"] or not total["o_sum_sum"]:  # at most one class: nothing to compare
        spark = df.sparkSession
        return Models(
            spark.createDataFrame([], "word string, word_ratio double"),
            spark.createDataFrame([], "stem string, stem_ratio double"),
            0.0,
            _base_rate(rows),
        )
    top = {name: F.lit(value) for name, value in total.asDict().items()}
    toxic_share = top["t_sum_sum"] / (top["t_sum_sum"] + top["o_sum_sum"])
    stem_ratio = _ratio(
        F.col("t_sum"), F.col("o_sum"), *(top[f"{c}_sum_{x}"] for x in ("sum", "left", "kinds") for c in "to")
    )
    significant = (_surprise(F.col("t_sum"), F.col("o_sum"), toxic_share) >= SIGNIFICANT) & (
        F.abs(F.col("stem_ratio")) >= MATERIAL
    )
    judged = stems.withColumn("stem_ratio", stem_ratio).withColumn("significant", significant)
    kept_stems = stored(judged.where("significant").select("stem", "stem_ratio"))
    given_stem = _ratio(
        F.col("t"), F.col("o"), *(F.col(f"{c}_{x}") for x in ("sum", "left", "kinds") for c in "to")
    )
    word_ratio = F.col("stem_ratio") + given_stem
    backoff = F.when(F.col("significant"), F.col("stem_ratio")).otherwise(0.0)
    expected = F.when(F.col("significant"), F.col("t_sum") / (F.col("t_sum") + F.col("o_sum"))).otherwise(toxic_share)
    kept_words = stored(
        words.join(small(judged, BROADCAST_ROWS), "stem")
        .where(_surprise(F.col("t"), F.col("o"), expected) >= SIGNIFICANT)
        .where(F.abs(word_ratio - backoff) >= MATERIAL)
        .select("word", word_ratio.alias("word_ratio"))
    )
    models = Models(kept_words, kept_stems, 1.0, 0.0)
    slope, intercept = _calibrated(models, rows.where(F.col("fold") == CALIBRATION_FOLD))
    return models._replace(slope=slope, intercept=intercept)


def _discounted(count: Column) -> Column:
    return F.greatest(count - DISCOUNT, F.lit(0.0))


def _sums(*counts: str) -> list[Column]:
    """Of each column: its sum, what discounts leave of it, and the distinct events."""
    of = []
    for c in counts:
        of.append(F.sum(c).alias(f"{c}_sum"))
        of.append(F.sum(_discounted(F.col(c))).alias(f"{c}_left"))
        of.append(F.count_if(F.col(c) > 0).alias(f"{c}_kinds"))
    return of


def _ratio(t, o, t_sum, o_sum, t_left, o_left, t_kinds, o_kinds) -> Column:
    """log P_t(e) - log P_o(e) from the counts of e and the sums of what it competes with."""
    freed = [F.when(n > 0, DISCOUNT * kinds / n) for n, kinds in ((t_sum, t_kinds), (o_sum, o_kinds))]
    gap = (F.coalesce(freed[0], freed[1]) + F.coalesce(freed[1], freed[0])) / 2
    shared = (t + o) / (t_sum + o_sum)

    def share(count, left) -> Column:
        own = F.when(left > 0, _discounted(count) / left).otherwise(shared)
        return (1 - gap) * own + gap * shared

    return F.log(share(t, t_left) / share(o, o_left))


def _surprise(t: Column, o: Column, toxic_share: Column) -> Column:
    """Likelihood-ratio statistic of the counts against the expected toxic share."""

    def part(seen, share) -> Column:
        return F.when((seen > 0) & (share > 0), seen * F.log(seen / ((t + o) * share))).otherwise(0.0)

    return 2 * (part(t, toxic_share) + part(o, 1 - toxic_share))


def _base_rate(rows: DataFrame) -> float:
    """Log-odds of a toxic label, smoothed."""
    seen = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    share = ((seen["t"] or 0) + 0.5) / (seen["n"] + 1)
    return float(np.log(share / (1 - share)))


def mean_ratio(df: DataFrame, models: Models, keys: list[str]) -> DataFrame:
    """``keys`` and x, the length-normalised log-likelihood ratio of each row's text
    (0 without words). Rows are scored where they are; only a sum per row moves."""
    numbered = df.select(*keys, "text").withColumn("__row", F.monotonically_increasing_id())
    exploded = numbered.select("__row", *keys, F.explode_outer(words_of(F.col("text"))).alias("word"))
    scored = (
        exploded.join(small(models.words, BROADCAST_ROWS), "word", "left")
        .withColumn("stem", _stem(F.col("word")))
        .join(small(models.stems, BROADCAST_ROWS), "stem", "left")
    )
    ratio = F.when(F.col("word").isNotNull(), F.coalesce("word_ratio", "stem_ratio", F.lit(0.0)))
    return scored.groupBy("__row", *keys).agg(F.coalesce(F.avg(ratio), F.lit(0.0)).alias("x"))


def _calibrated(models: Models, rows: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the log-odds of a toxic label on x, from at most BINS
    rows of sums, by Newton's method."""
    x = mean_ratio(rows, models, ["toxic"])
    low, high = x.agg(F.min("x"), F.max("x")).first()
    if low is None or low == high:
        return 0.0, _base_rate(rows)
    place = F.least(F.floor((F.col("x") - low) / (high - low) * BINS), F.lit(BINS - 1))
    binned = x.groupBy(place.alias("bin")).agg(F.avg("x").alias("x"), F.sum("toxic").alias("t"), F.count("*").alias("n")).orderBy("bin").toPandas()
    at, toxic, n = (binned[c].to_numpy(float) for c in ("x", "t", "n"))
    design = np.column_stack([at, np.ones_like(at)])
    beta = np.array([0.0, _base_rate(rows)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (toxic - n * p) - 1e-3 * beta * [1, 0]
        curve = design.T @ (design * (n * p * (1 - p))[:, None]) + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(curve, gradient)
        beta = beta + np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def score(df: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score (0 to 1, higher: a toxic label is likelier) and predicted.

    Null, empty and wordless texts have a ratio of 0 and so the score that 0 has.
    Repeated rows give a row each; an empty table gives none; other columns are
    ignored. Without labels of both classes every text gets the base rate.
    """
    docs = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    x = mean_ratio(docs, models, ["__id"])
    value = 1 / (1 + F.exp(-(F.col("x") * models.slope + models.intercept)))
    return x.select(
        F.col("__id").alias(id_col), value.alias("score"), (value >= THRESHOLD).cast("int").alias("predicted")
    )
