"""Mixing sources to target weights: subset sums over counted document lengths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rivulet.items import Items
from rivulet.llm.common import small, stored

# Words that whole lengths leave to the knapsack of a source.
WINDOW = 1 << 16
# Documents of a bucket that are ranked together; rows that one task repeats.
BUCKET_ROWS = 100_000
BROADCAST_ROWS = 250_000
_HASH_BITS = 31
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; a null one has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """How many of each length to take so that their words come to ``budget`` or, where
    no choice does, to the most below it that can be reached; and those words.

    A bounded knapsack over all sums: a sum is named once, by the length that first
    reaches it and how often that length is used on top of sums reached before.
    """
    taken = np.zeros(len(lengths), np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.zeros(budget + 1, np.int64)
    often = np.zeros(budget + 1, np.int64)
    for place, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        if reached[budget]:
            break
        if length > budget:
            continue
        new = np.flatnonzero(reached[: budget + 1 - length])
        for used in range(1, count + 1):
            new = new[new <= budget - length] + length
            new = new[~reached[new]]
            if not len(new):
                break
            reached[new] = True
            by[new], often[new] = place, used
    best = at = int(np.flatnonzero(reached)[-1])
    while at:
        taken[by[at]] = often[at]
        at -= int(often[at] * lengths[by[at]])
    return taken, best


def allot(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents of each length for ``budget`` words, at most those there are.

    Each length gives its share first, what rounding leaves going to the next shorter
    one, of all but WINDOW words; the knapsack fills what then remains.
    """
    order = np.argsort(-lengths, kind="stable")
    lengths, counts = lengths[order], counts[order]
    shared = max(0, budget - WINDOW)
    total = sum(n * c for n, c in zip(lengths.tolist(), counts.tolist()))
    taken = np.zeros(len(lengths), np.int64)
    passed = used = 0
    for place, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        passed += length * count
        taken[place] = min(count, max(0, shared * passed // total - used) // length)
        used += int(taken[place]) * length
    more, _ = fill(lengths, counts - taken, budget - used)
    out = np.empty(len(lengths), np.int64)
    out[order] = taken + more
    return out


def _targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``target`` and the whole words of it, ``budget``, for each (source, source_size).

    Sources are numbered in parallel, and a round of resharing is one aggregate over
    them, of which three sums come to the driver.
    """
    placed = Items.from_table(sizes, "source").positions("__place")
    given = F.array(*map(F.lit, weights))[((F.col("__place") - 1) % len(weights)).cast("int")]
    weighed = stored(placed.select("source", "source_size", given.cast("bigint").alias("weight")))
    limit = (F.col("source_size") * most).cast("decimal(19,0)")

    def over(words: int, share: int) -> Column:
        return limit * F.lit(share).cast("decimal(18,0)") < F.col("weight").cast("decimal(18,0)") * F.lit(words).cast("decimal(19,0)")

    total, share = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    total, words = int(total or 0), int(total or 0)
    share = int(share or 1)
    while True:
        above = over(words, share)
        capped, free = weighed.agg(
            F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        left = (total - int(capped or 0), int(free or 1))
        if left == (words, share):
            break
        words, share = left
    exact = F.col("weight").cast("decimal(18,0)") * F.lit(words).cast("decimal(19,0)")
    whole = F.floor(exact / F.lit(share).cast("decimal(18,0)")).cast("bigint")
    return weighed.select(
        "source",
        "source_size",
        F.when(above, limit.cast("double")).otherwise(F.lit(float(words)) * F.col("weight") / share).alias("target"),
        F.when(above, limit.cast("bigint")).otherwise(whole).alias("budget"),
    )


def _allotted(group: pd.DataFrame) -> pd.DataFrame:
    size = int(group["source_size"].iloc[0])
    whole, left = divmod(int(group["budget"].iloc[0]), size)
    lengths, counts = group["size"].to_numpy(np.int64), group["docs"].to_numpy(np.int64)
    extra = allot(lengths, counts, left) if left else np.zeros(len(group), np.int64)
    return group.assign(whole=whole, extra=extra)[list(_QUOTA)]


_QUOTA = {
    "source": "string",
    "size": "bigint",
    "docs": "bigint",
    "whole": "bigint",
    "extra": "bigint",
}


def mix(df: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """A row for each row of (doc_id, source, size): doc_id, source, size, source_size,
    target and taken, the words that the mix takes of it.

    Sources by code point, null last, take ``weights`` in turn and share all words by
    them; none gets more than ``most`` times its own, the excess is shared again. A
    source is passed over whole as often as its target allows; of the rest, documents
    are counted by exact length, a knapsack says how many of each length to take once
    more, and those of the smallest seeded hashes are taken. So a document is taken a
    whole number of times, at most ``most``, and sources meet their whole target
    wherever their lengths can add up to it.

    Null sizes are 0; a document without words is taken for 0 words. Rows that repeat
    id, source and size are told apart by nothing; as many of them are taken as are due.
    Null ids are ids like others. Ties of hashes go by id. Other columns are ignored; an
    empty table gives no rows. Reruns agree whatever the partitions.

    A source's histogram is one group: D different lengths take at least D * D / 2 words,
    so 10^13 words of one source have at most 4.5 million. A length that many documents
    share is dealt to hash buckets of about BUCKET_ROWS; whole buckets are taken or left
    by their counts and only the one at the edge is ranked.
    """
    rows = df.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size")
    )
    counted = stored(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    hist = stored(counted.groupBy("source", "size").agg(F.sum("n").alias("docs")))
    sources = stored(
        _targets(
            hist.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), weights, most
        )
    )

    def matched(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        """Inner join where nulls match; the right side's own columns are added."""
        named = right.withColumnsRenamed({c: f"__{c}" for c in on})
        same = F.lit(True)
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return left.join(small(named, BROADCAST_ROWS), same).drop(*(f"__{c}" for c in on))

    quota = stored(
        matched(hist.where("size > 0"), sources, "source")
        .groupBy("source")
        .applyInPandas(_allotted, ", ".join(f"{c} {t}" for c, t in _QUOTA.items()))
    )
    # Where a seeded document falls among those of its source and length.
    mark = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << _HASH_BITS))
    buckets = F.ceil(F.col("docs") / BUCKET_ROWS)
    bucket = F.floor(mark * buckets / float(1 << _HASH_BITS)).cast("bigint")
    split = quota.where("extra > 0 AND extra < docs")
    held = (
        matched(counted, split, "source", "size")
        .groupBy("source", "size", bucket.alias("edge"), "extra")
        .agg(F.sum("n").alias("held"))
    )
    upto = Window.partitionBy("source", "size").orderBy("edge")
    edges = stored(
        held.withColumn("upto", F.sum("held").over(upto))
        .where("upto >= extra AND upto - held < extra")
        .select("source", "size", "edge", (F.col("extra") - F.col("upto") + F.col("held")).alias("due"))
    )
    placed = quota.withColumnsRenamed({"source": "s", "size": "z"}).join(
        small(edges, BROADCAST_ROWS), F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")), "left"
    )
    quotas = stored(
        placed.select(F.col("s").alias("source"), F.col("z").alias("size"), "docs", "whole", "extra", "edge", "due")
    )
    dealt = matched(counted, quotas, "source", "size").select(
        "doc_id", "source", "size", "n", "whole", "extra", "edge", "due", mark.alias("mark"), bucket.alias("bucket")
    )
    # Without an edge all documents of the length are taken, or none.
    apart = F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))
    taken_whole = F.col("extra") > 0
    clear = dealt.where(apart).withColumn(
        "more", F.when(F.coalesce(F.col("bucket") < F.col("edge"), taken_whole), F.col("n")).otherwise(0)
    )
    ranks = Window.partitionBy("source", "size").orderBy("mark", "doc_id")
    before = F.sum("n").over(ranks.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    at_edge = dealt.where(~apart).withColumn(
        "more", F.least(F.greatest(F.col("due") - before, F.lit(0)), F.col("n"))
    )
    out = ["doc_id", "source", "size", "n", "whole", "more"]
    wordless = counted.where("size = 0").select(
        "doc_id", "source", "size", "n", F.lit(0).cast("bigint").alias("whole"), F.lit(0).cast("bigint").alias("more")
    )
    groups = clear.select(*out).unionByName(at_edge.select(*out)).unionByName(wordless)
    return matched(_a_row_each(groups), sources, "source").select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


def _a_row_each(groups: DataFrame) -> DataFrame:
    """``n`` rows of each group, ``more`` of them with one pass more. A group of many is
    dealt out in parts first."""
    few = groups.where(F.col("n") <= BUCKET_ROWS).withColumn("first", F.lit(0).cast("bigint"))
    parts = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(BUCKET_ROWS).cast("bigint"))
    many = groups.where(F.col("n") > BUCKET_ROWS).withColumn("first", F.explode(parts))
    many = many.repartition("doc_id", "source", "size", "first")
    last = F.least(F.col("n"), F.col("first") + BUCKET_ROWS) - 1
    each = few.unionByName(many).withColumn("row", F.explode(F.sequence("first", last)))
    times = F.col("whole") + F.when(F.col("row") < F.col("more"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", times.alias("times"))
