"""Nearest neighbours by inner product through an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# Vectors that the centroids are fitted to; all vectors are indexed.
SAMPLE_ROWS = 20_000
CENTROIDS = 64
ROUNDS = 12
# A query stops once the cells it has visited hold this share of all vectors, and this
# many. The share is high because vectors without clusters must still reach 0.9.
VISITED_SHARE = 0.5
VISITED_ROWS = 1_000
# What a task holds: entries of a chunk of the index against queries of a block.
CHUNK_ENTRIES = 4_096
BLOCK_QUERIES = 2_048
# Queries scored together.
SCORED_QUERIES = 128
# Scores this close to the k-th are worked out exactly before the cut.
ROUNDING = 1e-9


class MultiIndex(NamedTuple):
    """Centroids of the two halves, and the vectors in each pair's cell."""

    first: np.ndarray
    second: np.ndarray
    cells: np.ndarray

    @property
    def chunks(self) -> list[int]:
        return [max(1, math.ceil(n / CHUNK_ENTRIES)) for n in self.cells.sum(1)]


def usable(vector: Column, size: int) -> Column:
    """Vectors of ``size`` components, all finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0)


def _centroids(half: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    distinct = np.unique(half, axis=0)
    count = min(CENTROIDS, len(distinct))
    centers = distinct[rng.choice(len(distinct), count, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = _nearest(half, centers)
        members = np.bincount(nearest, minlength=count)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, half)
        filled = members > 0
        centers[filled] = sums[filled] / members[filled, None]
    return centers


def _nearest(half: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmax(half @ centers.T - 0.5 * (centers**2).sum(1), axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _assigned(vectors: DataFrame, first: np.ndarray, second: np.ndarray) -> DataFrame:
    """vec_id, vector, and the nearest centroid of either half."""
    cut = first.shape[1]

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                m = _matrix(frame["vector"])
                yield frame.assign(c1=_nearest(m[:, :cut], first), c2=_nearest(m[:, cut:], second))

    return vectors.mapInPandas(assign, "vec_id bigint, vector array<double>, c1 int, c2 int")


def visit(query: np.ndarray, index: MultiIndex, wanted: int) -> dict[int, list[int]]:
    """Second centroids by first centroid: the pairs of best summed inner product, in
    that order from a heap, until their cells hold ``wanted`` vectors."""
    cut = index.first.shape[1]
    scores = (index.first @ query[:cut], index.second @ query[cut:])
    order = tuple(np.argsort(-s, kind="stable") for s in scores)
    best = tuple(s[o] for s, o in zip(scores, order))
    heap, seen = [(-(best[0][0] + best[1][0]), 0, 0)], {(0, 0)}
    visited: dict[int, list[int]] = {}
    found = 0
    while heap and found < wanted:
        _, i, j = heapq.heappop(heap)
        c1, c2 = int(order[0][i]), int(order[1][j])
        if index.cells[c1, c2]:
            visited.setdefault(c1, []).append(c2)
            found += int(index.cells[c1, c2])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(best[0]) and b < len(best[1]) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (-(best[0][a] + best[1][b]), a, b))
    return visited


def _reranked(queries: pd.DataFrame, entries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest entries of this chunk for each query of this block."""
    out = []
    ids, matrix = entries["vec_id"].to_numpy(), _matrix(entries["vector"])
    second = entries["c2"].to_numpy()
    for start in range(0, len(queries), SCORED_QUERIES):
        block = queries.iloc[start : start + SCORED_QUERIES]
        own, vectors = block["query_id"].to_numpy(), _matrix(block["vector"])
        allowed = np.zeros((len(block), int(max(second.max(), max(map(max, block["cells"])))) + 1), bool)
        for row, cells in enumerate(block["cells"]):
            allowed[row, np.asarray(cells)] = True
        scores = np.where(allowed[:, second] & (ids != own[:, None]), vectors @ matrix.T, -np.inf)
        if scores.shape[1] > k:
            cut = np.partition(scores, -k, axis=1)[:, -k]
        else:
            cut = np.full(len(block), -np.inf)
        q, e = np.nonzero((scores >= cut[:, None] - ROUNDING) & (scores > -np.inf))
        # Component after component, so equal vectors have equal scores everywhere.
        exact = np.ascontiguousarray((vectors[q] * matrix[e]).T).sum(axis=0)
        found = pd.DataFrame({"query_id": own[q], "vec_id": ids[e], "score": exact})
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        out.append(found.groupby("query_id", sort=False).head(k))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for each row where ``is_query`` holds, the k
    nearest other rows found, by inner product in double precision, ties to the smaller
    id. All other rows, if there are at most k.

    Null vectors, vectors of zeros, with a null or non-finite component, or of another
    length than most of the sample take no part, as query or candidate. Rows that repeat an id and
    vector count once. Two different vectors under one id are both candidates. An
    empty table gives no rows; other columns are ignored. Results depend on the rows
    alone, not on their partitions.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("is_query")).where(
        F.col("vec_id").isNotNull()
    )
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    sizes = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).count()
    common = sizes.orderBy(F.desc("count"), "size").limit(1).collect()
    if not common:
        return spark.createDataFrame([], schema)
    vectors = rows.where(usable(F.col("vector"), common[0]["size"])).dropDuplicates(["vec_id", "vector"])
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").toPandas()
    if sample.empty:
        return spark.createDataFrame([], schema)
    fitted, rng = _matrix(sample["vector"]), np.random.default_rng(0)
    cut = fitted.shape[1] // 2
    first, second = _centroids(fitted[:, :cut], rng), _centroids(fitted[:, cut:], rng)

    entries = _assigned(vectors.select("vec_id", "vector"), first, second)
    cells = np.zeros((len(first), len(second)), np.int64)
    for r in entries.groupBy("c1", "c2").count().collect():  # a row for a pair at most
        cells[r["c1"], r["c2"]] = r["count"]
    index = MultiIndex(first, second, cells)
    chunks, total = index.chunks, int(cells.sum())
    wanted = max(VISITED_ROWS, math.ceil(VISITED_SHARE * total)) + 1

    def traverse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for query_id, vector in zip(frame["vec_id"], frame["vector"]):
                for c1, found in visit(np.asarray(vector), index, wanted).items():
                    out.append((query_id, vector, c1, found))
            yield pd.DataFrame(out, columns=["query_id", "vector", "c1", "cells"])

    asked = vectors.where("is_query").select("vec_id", "vector")
    blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    n_chunks = F.array(*map(F.lit, chunks))[F.col("c1")]
    visits = (
        asked.mapInPandas(traverse, "query_id bigint, vector array<double>, c1 int, cells array<int>")
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
    )
    chunked = entries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), n_chunks).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    key = ["c1", "chunk", "block"]

    def rerank(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or entries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _reranked(queries, entries, k)

    near = (
        visits.groupBy(key)
        .cogroup(chunked.groupBy(key))
        .applyInPandas(rerank, "query_id bigint, vec_id bigint, score double")
    )
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
