"""Quality by hierarchical empirical Bayes: the document's evidence, then its site's."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rivulet.functions.views import let
from rivulet.llm.common import in_small_batches, small, stored, training_row
from rivulet.llm.rules import clean_lines

# Shares of a text at which a feature's next step begins.
STEPS = (0.0, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.75)
# Rows of all training texts that are mixed into the counts of each class.
PSEUDO_ROWS = 2.0
# The features of a text partly say the same, so their evidence is tempered.
TEMPER = 0.7
# Strength of a prior in rows: where its level shows no spread, and its bounds.
STRENGTH, STRENGTH_BOUNDS = 100.0, (2.0, 10_000.0)
# A document stays at this posterior probability of good quality.
THRESHOLD = 0.5
BROADCAST_ROWS = 1_000_000
FEATURES = ("symbols", "lost", "repeats", "duplicates", "capitals", "exclaimed", "letters")


class Evidence(NamedTuple):
    """For every feature, the log-likelihood ratio of each of its steps, good to bad."""

    ratios: list[list[float]]
    prior: float


def steps(text: Column) -> Column:
    """The step of every feature of a text, an array in the order of FEATURES: symbols,
    characters of failed lines, words in repeated windows, repeated lines, capitals,
    exclamation marks, and letters among all word characters. A null text is empty,
    and a share of nothing is 0."""
    text = F.coalesce(text, F.lit(""))
    measured = F.struct(
        clean_lines(text).alias("judged"),
        F.length(F.regexp_replace(text, "\\P{Lu}+", "")).alias("capitals"),
        F.length(F.regexp_replace(text, "\\P{L}+", "")).alias("letters"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).alias("marks"),
    )

    def placed(m: Column) -> Column:
        j = m["judged"]
        pairs = (
            (j["n_symbols"], j["word_chars"]),
            (j["lost_chars"], j["word_chars"]),
            (j["n_repeat_words"], j["n_words"]),
            (j["n_dup_lines"], j["n_lines"]),
            (m["capitals"], m["letters"]),
            (m["marks"], j["n_words"]),
            (m["letters"], j["word_chars"]),
        )
        shares = F.array(*(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)) for part, whole in pairs))
        edges = F.array(*map(F.lit, STEPS))
        return F.transform(shares, lambda s: F.size(F.filter(edges, lambda edge: s > edge)))

    return let(measured, placed)


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Evidence:
    """Counts of all labelled rows outside the held-out part. A class that has few rows,
    or none, is filled up with the steps of all rows, so it says little, or nothing."""
    docs = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    labelled = docs.join(_known(labels, id_col, label_col), "__id").where(training_row(F.col("__id")))
    placed = labelled.select("good", F.posexplode(steps(F.col("__text"))).alias("feature", "step"))
    counts = np.zeros((len(FEATURES), len(STEPS) + 1, 2))
    for r in placed.groupBy("feature", "step", "good").count().collect():  # at most one row a cell
        counts[r["feature"], r["step"], r["good"]] = r["count"]
    by_class = counts.sum(1)[0]
    total = max(by_class.sum(), 1.0)
    ratios = []
    for feature in counts:
        overall = feature.sum(1) / total
        bad, good = ((feature[:, c] + PSEUDO_ROWS * overall) / (by_class[c] + PSEUDO_ROWS) for c in (0, 1))
        seen = overall > 0
        ratios.append(np.where(seen, np.log(np.where(seen, good, 1) / np.where(seen, bad, 1)), 0.0).tolist())
    return Evidence(ratios, float((by_class[1] + 1) / (by_class.sum() + 2)))


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """A label for each id; one that is given more than once counts as good if it ever was."""
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = given.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("good"))
    return small(known, BROADCAST_ROWS)


def log_ratio(text: Column, evidence: Evidence) -> Column:
    """What a text says for good quality by itself."""
    table = F.array(*(F.array(*map(F.lit, row)) for row in evidence.ratios))
    terms = F.zip_with(table, steps(text), lambda row, step: F.get(row, step))
    return TEMPER * F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(level: DataFrame, mean: Column) -> float:
    """Rows that the prior of a level is worth, by moments: the spread of the shares
    around ``mean`` beyond what so many rows show by chance."""
    noise = mean * (1 - mean)
    m = level.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("k") / F.col("n") - mean) ** 2).alias("spread"),
        F.sum(noise).alias("chance"),
        F.sum(F.col("n") * noise).alias("noise"),
    ).first()
    if not m["n"] or m["spread"] <= m["chance"]:
        return STRENGTH
    return float(np.clip(m["noise"] / (m["spread"] - m["chance"]) - 1, *STRENGTH_BOUNDS))


def site_posteriors(rows: DataFrame, prior: float) -> DataFrame:
    """host, path and site_log_odds from rows of (host, path, good), good being a label
    or a probability. A path is shrunk towards its host and a host towards ``prior``,
    each the more the fewer rows it has. Rows are summed before they move."""
    paths = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("k")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = F.lit(prior)
    by_host = _strength(hosts, overall)
    hosts = hosts.select("host", ((F.col("k") + by_host * overall) / (F.col("n") + by_host)).alias("host_share"))
    joined = paths.join(small(hosts, BROADCAST_ROWS), "host")
    by_path = _strength(joined, F.col("host_share"))
    share = (F.col("k") + by_path * F.col("host_share")) / (F.col("n") + by_path)
    return stored(joined.select("host", "path", _logit(share).alias("site_log_odds")))


def classify(
    df: DataFrame,
    labels: DataFrame,
    host_col: str,
    path_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """``df`` with ``__posterior``, the probability that a row's text is of good quality.

    Three levels: the evidence of the text itself, the posterior of its path given its
    host, and of its host given all hosts. All rows count for the sites, with their
    label where it may be learnt from and their own probability elsewhere. A null host
    or path is a site of its own, like an empty one; a null text is an empty text.
    Repeated rows count and are judged each. Without labels every row has the prior.
    An empty table gives no rows. Other columns pass through.
    """
    in_small_batches(df.sparkSession)
    evidence = fit(df, labels, id_col, text_col, label_col)
    prior = float(np.log(evidence.prior / (1 - evidence.prior)))
    site = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((host_col, "host"), (path_col, "path"))]
    own = df.select(*site, F.col(id_col).alias("__id"), _sigmoid(log_ratio(F.col(text_col), evidence) + prior).alias("own"))
    learnable = training_row(F.col("__id"))
    rows = own.join(_known(labels, id_col, label_col), "__id", "left").select(
        "host", "path", F.coalesce(F.when(learnable, F.col("good").cast("double")), "own").alias("good")
    )
    sites = site_posteriors(rows, evidence.prior)
    sites = sites.toDF("__host", "__path", "__site")
    keyed = df.withColumns({"__host": site[0], "__path": site[1]})
    judged = keyed.join(small(sites, BROADCAST_ROWS), ["__host", "__path"])
    posterior = _sigmoid(log_ratio(F.col(text_col), evidence) + F.col("__site"))
    return judged.select(*(F.col(f"`{c}`") for c in df.columns), posterior.alias("__posterior"))
