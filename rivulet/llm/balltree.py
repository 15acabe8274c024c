"""Ranked lexical search: exact inner products through ball trees of sparse vectors."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rivulet.llm.common import in_small_batches, parts, stored

# Documents of one tree, at most, and entries of their vectors; documents of a leaf.
TREE_DOCS = 2_048
TREE_ENTRIES = 1 << 19
LEAF = 24
# Terms of the items of one block, on average. A block is collected and broadcast.
BLOCK_TERMS = 100_000
# Bounds are raised by more than doubles can be wrong.
_ROUND = 1e-9

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# In UTF-8 every byte from 0x80 on belongs to a term.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order; a null one has none."""
    return text.translate(_FOLD).split() if text else []


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - 90 + (90 * n * n_docs) // n_terms


def impact(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """A ball tree over sparse vectors of integers: nodes in one list, children of inner
    nodes, centroid and radius of every one, leaves as slices of the reordered rows."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        sizes = np.fromiter((len(c) for c, _ in rows), np.int64, len(rows))
        terms = np.concatenate([c for c, _ in rows])
        self.terms, cols = np.unique(terms, return_inverse=True)
        vals = np.concatenate([v for _, v in rows])
        starts = np.concatenate(([0], np.cumsum(sizes)))
        self._cols = [cols[a:b] for a, b in zip(starts, starts[1:])]
        self._vals = [vals[a:b] for a, b in zip(starts, starts[1:])]
        self._norms = np.array([float(np.dot(v.astype(float), v)) for v in self._vals])
        self.kids: list[tuple[int, int] | None] = []
        self.leaf: list[tuple | None] = []
        self._centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.root = self._grow(np.arange(len(rows)))
        self.centres = np.array(self._centres)
        del self._cols, self._vals, self._centres

    def _flat(self, members: np.ndarray):
        cols = np.concatenate([self._cols[i] for i in members])
        vals = np.concatenate([self._vals[i] for i in members])
        sizes = np.fromiter((len(self._cols[i]) for i in members), np.int64, len(members))
        return cols, vals, np.cumsum(sizes) - sizes

    def _grow(self, members: np.ndarray) -> int:
        """The node over ``members``. A node of more than LEAF is halved by which of two
        documents far apart each is nearer to, the median between, so depth is bounded."""
        cols, vals, starts = self._flat(members)
        centre = np.bincount(cols, vals, len(self.terms)) / len(members)
        norms = self._norms[members]

        def apart(point: np.ndarray) -> np.ndarray:
            dots = np.add.reduceat(vals * point[cols], starts)
            return norms - 2 * dots + np.dot(point, point)

        away = apart(centre)
        slack = _ROUND * (norms.max() + np.dot(centre, centre))
        node = len(self.kids)
        self.kids.append(None)
        self.leaf.append(None)
        self._centres.append(centre)
        self.radii.append(math.sqrt(max(float(away.max()), 0.0) + slack))
        if len(members) <= LEAF:
            self.leaf[node] = (members, cols, vals, starts)
            return node

        def at(member: int) -> np.ndarray:
            point = np.zeros(len(self.terms))
            point[self._cols[member]] = self._vals[member]
            return point

        one = apart(at(members[int(away.argmax())]))
        other = apart(at(members[int(one.argmax())]))
        order = np.argsort(one - other, kind="stable")
        half = len(members) // 2
        self.kids[node] = (self._grow(members[order[:half]]), self._grow(members[order[half:]]))
        return node

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int, k: int) -> list[tuple[int, int]]:
        """(score, row) of every row that may be among the ``k`` best, all of at least
        ``least``; equal scores are all there, for the caller to order."""
        here = np.searchsorted(self.terms, terms)
        here[here == len(self.terms)] = 0
        known = self.terms[here] == terms
        if not known.any():
            return []
        here, weights = here[known], weights[known]
        norm = math.sqrt(float(np.dot(weights.astype(float), weights)))
        bounds = (self.centres[:, here] @ weights + norm * np.array(self.radii)) * (1 + _ROUND) + 1
        query = np.zeros(len(self.terms), np.int64)
        query[here] = weights
        best: list[int] = []
        found = []
        queue = [(-bounds[self.root], self.root)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < least:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bounds[kid] >= least:
                        heapq.heappush(queue, (-bounds[kid], kid))
                continue
            members, cols, vals, starts = self.leaf[node]
            scores = np.add.reduceat(vals * query[cols], starts)
            for i in np.flatnonzero(scores >= least).tolist():
                score = int(scores[i])
                found.append((score, int(members[i])))
                if len(best) < k:
                    heapq.heappush(best, score)
                else:
                    heapq.heappushpop(best, score)
            if len(best) == k and best[0] > least:
                least = best[0]
        return [f for f in found if f[0] >= least]


def _rank(entry: tuple) -> tuple:
    score, doc_id = entry
    return (-score, doc_id is None, 0 if doc_id is None else doc_id)


class _Searcher:
    """One task's trees, one after the other, and the best rows of each item so far."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], k: int):
        self.items, self.k = items, k
        self.best: list[list[tuple]] = [[] for _ in items]
        self.rows, self.ids, self.entries = [], [], 0

    def add(self, doc_id, cols: np.ndarray, vals: np.ndarray) -> None:
        self.rows.append((cols, vals))
        self.ids.append(doc_id)
        self.entries += len(cols)
        if len(self.rows) >= TREE_DOCS or self.entries >= TREE_ENTRIES:
            self.search()

    def search(self) -> None:
        if not self.rows:
            return
        tree = Tree(self.rows)
        for place, (terms, weights) in enumerate(self.items):
            best = self.best[place]
            least = best[-1][0] if len(best) == self.k else 1
            found = tree.search(terms, weights, least, self.k)
            if found:
                best = best + [(score, self.ids[row]) for score, row in found]
                self.best[place] = sorted(best, key=_rank)[: self.k]
        self.rows, self.ids, self.entries = [], [], 0


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: item_id, rank, doc_id,
    score. ``docs`` has doc_id and text, ``items`` item_id and text.

    Score, weight and length parts are those of ``term_weight``, ``length_part`` and
    ``impact``, in integers. Null, empty and term-free texts are no documents and find
    none. Rows that repeat an item_id are one item with the terms of all; a null item_id
    is an id. Every row of ``docs`` is a document, also one that repeats another; equal
    scores go by doc_id, null last. Texts are taken whole; other columns are ignored;
    empty tables give no rows.

    Each task turns its documents, TREE_DOCS at a time, into vectors over the terms that
    items have and these into a ball tree, searches it best node first for each item,
    and keeps ``k`` rows an item, whose last score prunes the trees that follow. Only
    those rows are shuffled. Items come in blocks of about BLOCK_TERMS terms, each
    block a job over the documents, so what is broadcast does not grow with the tables;
    the terms of one item are never split.
    """
    spark = in_small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    wanted = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    asked = stored(items.select("item_id", F.explode(wanted).alias("term")).distinct())
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    kinds = {c: s for c, s in (("item_id", asked), ("doc_id", docs))}
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c, df in kinds.items())
    ranked = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        found = _block(spark, texts, rows, k, f"{schema}, score bigint")
        ranked = found if ranked is None else ranked.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score"
    )


def _block(spark, texts: DataFrame, rows: DataFrame, k: int, schema: str) -> DataFrame:
    """The best of each task for the items of one block."""
    by_item: dict = {}
    for row in rows.collect():
        by_item.setdefault(row["item_id"], []).append(row["term"].encode())
    vocabulary = {t: i for i, t in enumerate(sorted({t for ts in by_item.values() for t in ts}))}
    names = sorted(by_item, key=lambda i: (i is None, 0 if i is None else i))
    shared = spark.sparkContext.broadcast(vocabulary)

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        seen = np.zeros(len(place) + 2, np.int64)
        for batch in batches:
            for part in parts(batch, 1):
                for text in part.column(1).to_pylist():
                    terms = terms_of(text)
                    if terms:
                        seen[-2] += 1
                        seen[-1] += len(terms)
                        for term in place.keys() & set(terms):
                            seen[place[term]] += 1
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], names=["place", "seen"])

    counted = texts.mapInArrow(statistics, "place bigint, seen bigint")
    seen = dict(map(tuple, counted.groupBy("place").agg(F.sum("seen")).collect()))
    n_docs, n_terms = seen.get(len(vocabulary), 0), seen.get(len(vocabulary) + 1, 0)
    weight = np.array([term_weight(n_docs, seen.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    queries = []
    for name in names:
        cols = np.array(sorted(vocabulary[t] for t in by_item[name]), np.int64)
        queries.append((cols, weight[cols]))
    asked = spark.sparkContext.broadcast((names, queries))
    item_kind, doc_kind = (t.split(" ", 1)[1] for t in schema.split(", ")[:2])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, (names, queries) = shared.value, asked.value
        searcher = _Searcher(queries, k)
        for batch in batches:
            for part in parts(batch, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    terms = terms_of(text)
                    held = Counter(i for i in map(place.get, terms) if i is not None)
                    if held:
                        m = length_part(len(terms), n_docs, n_terms)
                        cols = np.array(sorted(held), np.int64)
                        vals = np.array([impact(held[c], m) for c in cols.tolist()], np.int64)
                        searcher.add(doc_id, cols, vals)
        searcher.search()
        out = [(names[i], d, s) for i, rows in enumerate(searcher.best) for s, d in rows]
        for start in range(0, len(out), 10_000):
            columns = list(zip(*out[start : start + 10_000]))
            kinds = [_ARROW.get(item_kind, pa.string()), _ARROW.get(doc_kind, pa.string()), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "doc_id", "score"])

    return texts.mapInArrow(best, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
