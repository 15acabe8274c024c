"""Near duplicates by DartMinHash signatures, banded joining and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rivulet.llm.common import compact, map_texts, parts, small, stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# A pair of similarity 0.8 misses all bands with probability (1 - 0.8 ** 5) ** 24 < 1e-4.
BANDS, BAND_ROWS = 24, 5
COORDINATES = BANDS * BAND_ROWS
# Each round compares the members of every open bucket with one more of them; what is
# open after these rounds is compared in blocks, every pair of it.
ROUNDS = 4
# Texts of a block and their bytes, both on average.
BLOCK_TEXTS, BLOCK_BYTES = 256, 2 << 20
# Shingles whose occurrences are counted at once, a column each.
BLOCK_COLUMNS = 4096
BROADCAST_ROWS = 100_000
# Pairs that a task compares.
VERIFIED_PAIRS = 2_000
# Distinct words whose hashes a Python worker keeps before it starts anew.
MEMO_WORDS = 100_000
_U64 = np.uint64
_PRIME = 0x100000001B3


class Shingler:
    """Distinct hashes of all runs of five words in lower case, for many texts at once.
    A text with fewer words is one shingle, a text without words has none."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes, text after text and sorted within each, and how many each has."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo, coded, sizes = self.memo, [], []
        for text in texts:
            words = (text or "").lower().encode().split()
            for word in words:
                if word not in memo:
                    memo[word] = xxhash.xxh64_intdigest(word)
            coded += map(memo.__getitem__, words)
            sizes.append(len(words))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        words = np.array(coded, _U64)
        # Every run of up to five words; those that are cut short by the end of a text
        # count only where the text itself is as short.
        mixed = np.zeros(len(words), _U64)
        inside = np.zeros(len(words), np.int64)
        for place in range(SHINGLE_WORDS):
            there = slice(0, max(len(words) - place, 0))
            same = owner[there] == owner[place:]
            mixed[there] = np.where(same, mixed[there] * _U64(_PRIME) + words[place:], mixed[there])
            inside[there] += same
        starts = np.cumsum(sizes) - sizes
        first = np.arange(len(words)) == starts[owner] if len(words) else np.zeros(0, bool)
        full = (inside == SHINGLE_WORDS) | first
        hashes, owner = _mix(mixed[full], 0), owner[full]
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        return hashes[new], np.bincount(owner[new], minlength=len(sizes))


def _mix(values: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result hangs on every bit of the value."""
    v = values + _U64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    v = (v ^ v >> _U64(30)) * _U64(0xBF58476D1CE4E5B9)
    v = (v ^ v >> _U64(27)) * _U64(0x94D049BB133111EB)
    return v ^ v >> _U64(31)


def _uniform(values: np.ndarray) -> np.ndarray:
    return (values >> _U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def dart_signatures(
    elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, coordinates: int = COORDINATES
) -> np.ndarray:
    """The earliest dart in each coordinate, a row for each of the sets that stand one
    after the other: two rows agree in a coordinate with probability equal to the
    weighted Jaccard similarity of the two sets. A set without weight has zeros.

    The region of an element is as wide as its weight, in cells of width one. Darts
    fall on a cell one after the other as a Poisson process that hashing of element
    and cell decides, so all sets that hold the element see the same darts; a dart
    counts if it lies within the weight. Darts up to a time that fills all coordinates
    are thrown, which is about k ln k + 2 k of them whatever the size of the set.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    totals = np.bincount(owner, weights, minlength=len(sizes))
    cells = np.repeat(np.arange(len(elements)), np.ceil(weights).astype(np.int64))
    level = np.arange(len(cells)) - np.searchsorted(cells, cells)
    region = _mix(elements[cells] ^ _mix(level.astype(_U64), 1), 2)
    room, owner = weights[cells] - level, owner[cells]
    enough = coordinates * math.log(coordinates) + 2 * coordinates
    until = enough / np.where(totals > 0, totals, 1.0)
    signatures = np.zeros(len(sizes) * coordinates, _U64)
    waiting = totals > 0
    while waiting.any():
        mine = waiting[owner]
        darts, times, of = _thrown(region[mine], room[mine], owner[mine], until)
        place = of * coordinates + (_mix(darts, 3) % _U64(coordinates)).astype(np.int64)
        order = np.argsort(-times, kind="stable")
        signatures[place[order]] = darts[order]  # the earliest is written last
        filled = np.bincount(np.unique(place) // coordinates, minlength=len(sizes))
        waiting &= filled < coordinates
        until *= 2
    return signatures.reshape(len(sizes), coordinates)


def _thrown(
    region: np.ndarray, room: np.ndarray, owner: np.ndarray, until: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts on the cells up to their set's time, their times and sets."""
    found = []
    time, turn = np.zeros(len(region)), 0
    while len(region):
        turn += 1
        dart = _mix(region, 4 + turn)
        time = time - np.log(_uniform(_mix(dart, 5)))
        early = time < until[owner]
        region, room, owner, time, dart = (x[early] for x in (region, room, owner, time, dart))
        inside = _uniform(_mix(dart, 6)) < room
        found.append((dart[inside], time[inside], owner[inside]))
    return tuple(map(np.concatenate, zip(*found)))


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature, the band itself hashed in."""
    keys = np.zeros((len(signatures), BANDS), _U64) + np.arange(BANDS, dtype=_U64)
    for row in range(BAND_ROWS):
        keys = _mix(keys ^ signatures[:, row::BAND_ROWS], 7)
    return keys.view(np.int64)


def copy_of(text: Column) -> Column:
    """What exact copies of a text have in common, 16 bytes."""
    return F.unhex(F.md5(text))


def _bands(docs: DataFrame) -> DataFrame:
    """copy, bands, copies and first (id) of the different texts that have a word."""

    def worker():
        shingler = Shingler()

        def work(texts: list[str | None]) -> list[pa.Array]:
            shingles, sizes = shingler(texts)
            keys = band_keys(dart_signatures(shingles, np.ones(len(shingles)), sizes))
            rows = [own if n else [] for own, n in zip(keys.tolist(), sizes)]
            return [pa.array(rows, pa.list_(pa.int64()))]

        return work

    marked = map_texts(docs, "text", ["copy", "id"], ["bands array<bigint>"], worker)
    return marked.groupBy("copy").agg(
        F.first("bands").alias("bands"), F.count("*").alias("copies"), F.min("id").alias("first")
    )


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) and len(b) else 0.0


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (copy, hub) whose shingle sets are similar enough, worked out exactly."""
    wanted = pairs.select("copy").union(pairs.select(F.col("hub").alias("copy"))).distinct()
    texts = docs.join(small(wanted, BROADCAST_ROWS), "copy", "left_semi").groupBy("copy").agg(F.first("text").alias("text"))
    left = texts.withColumnRenamed("text", "own")
    right = texts.select(F.col("copy").alias("hub"), F.col("text").alias("other"))
    both = pairs.join(left, "copy").join(right, "hub").select("copy", "hub", "own", "other")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in parts(batch, 2):
                own, other = (np.split(h, np.cumsum(n)[:-1]) for h, n in (shingler(part.column(i).to_pylist()) for i in (2, 3)))
                similar = [jaccard(a, b) >= SIMILARITY for a, b in zip(own, other)]
                yield part.select(["copy", "hub"]).filter(pa.array(similar, pa.bool_()))

    return both.mapInArrow(check, "copy binary, hub binary")


def _together(hashes: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each of the sets ``left`` shares with each of ``right``."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times[place] > 1  # what one set has alone counts in no pair
    owner, place = owner[shared], np.unique(place[shared], return_inverse=True)[1]
    both = np.zeros((len(left), len(right)))
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, BLOCK_COLUMNS):
        here = slice(*np.searchsorted(place, (start, start + BLOCK_COLUMNS)))
        there = np.zeros((len(sizes), BLOCK_COLUMNS), np.float32)
        there[owner[here], place[here] - start] = 1
        both += there[left] @ there[right].T
    return both


def _block_links(table: pa.Table) -> pa.Table:
    """Links of one block with itself or another (columns copy, component, block, text),
    worked out exactly; of links that join the same components one is enough."""
    names, known = table["copy"].to_pylist(), table["component"].to_pylist()
    block = table["block"].to_numpy()
    hashes, sizes = Shingler()(table["text"].to_pylist())
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    both = _together(hashes, sizes, left, right)
    either = sizes[left][:, None] + sizes[right][None, :] - both
    similar = (either > 0) & (both / np.maximum(either, 1) >= SIMILARITY)
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    found = []
    for i, j in zip(*np.nonzero(similar)):
        a, b = left[i], right[j]
        x, y = root(known[a]), root(known[b])
        if x != y:
            parent[max(x, y)] = min(x, y)
            found.append((names[a], names[b]))
    columns = zip(*found) if found else ((), ())
    return pa.table([pa.array(c, pa.binary()) for c in columns], names=["copy", "hub"])


def _rest(known: DataFrame, docs: DataFrame, n_open: int) -> DataFrame | None:
    """Links (copy, hub) between all texts that meet in a bucket which is still open.

    A bucket is dealt into blocks of bounded size by hash, and each block meets itself
    and every other one of its bucket in a task of its own, so a large bucket is spread
    over as many tasks as it needs and no pair becomes a row.
    """
    spread = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    spread, n_buckets = compact(spread.where("low < high").select("key"), n_open // 2)
    if not n_buckets:
        return None
    members = known.join(small(spread, BROADCAST_ROWS), "key").select("key", "copy", "component")
    members, n_members = compact(members, n_open)
    wanted, _ = compact(members.select("copy").distinct(), n_members)
    texts = docs.join(small(wanted, BROADCAST_ROWS), "copy", "left_semi").groupBy("copy").agg(F.first("text").alias("text"))
    texts = stored(texts)
    sized = members.join(texts.select("copy", F.octet_length("text").alias("bytes")), "copy")
    enough = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1))
    blocks, _ = compact(sized.groupBy("key").agg(enough.cast("int").alias("blocks")), n_buckets)
    own = F.pmod(F.xxhash64("copy"), F.col("blocks")).cast("int")
    placed = members.join(small(blocks, BROADCAST_ROWS), "key").withColumn("block", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = placed.select(
        "key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "copy", "component"
    )
    return met.join(texts, "copy").groupBy("key", "a", "b").applyInArrow(_block_links, "copy binary, hub binary")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component, the smallest node it is linked to, for all nodes of the edges.

    In each round a node takes the smallest label around it and then that label's own
    label, until nothing changes. Labels are summed by node before they move.
    """
    both = edges.select(a, b).union(edges.select(b, a)).toDF("node", "near").distinct()
    links, n_links = compact(both, 2 * edges.count())
    first = links.groupBy("node").agg(F.least("node", F.min("near")).alias("component"))
    labels, n_nodes = compact(first, n_links)
    while True:
        around = links.join(labels.withColumnsRenamed({"node": "near", "component": "seen"}), "near")
        lowest = around.groupBy("node").agg(F.min("seen").alias("seen"))
        step = labels.join(lowest, "node").select("node", F.least("component", "seen").alias("near"), "component")
        jump = labels.withColumnsRenamed({"node": "near", "component": "jump"})
        moved, _ = compact(
            step.join(jump, "near", "left").select(
                "node", F.least("near", F.coalesce("jump", "near")).alias("to"), "component"
            ),
            n_nodes,
        )
        labels = moved.select("node", F.col("to").alias("component"))
        if moved.where(F.col("to") < F.col("component")).isEmpty():
            return labels


def _labelled(open_rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``open_rows`` and the component that each text is known to be in, at first its own."""
    if labels is None:
        return open_rows.withColumn("component", F.col("copy"))
    named = labels.withColumnRenamed("node", "copy")
    return open_rows.join(named, "copy", "left").withColumn("component", F.coalesce("component", "copy"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and class_id of every row: the smallest id of its near duplicates.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles is at
    least 0.8; classes are the linked components. Exact copies are one text from the
    first step on. The texts of a bucket are not paired with each other: each is
    compared with the bucket's hub, which then leaves the bucket, and buckets that still
    hold several classes choose another in the rounds that follow, so a round's work is
    linear in the rows. Buckets that are open after these rounds are compared in
    blocks, every pair of their texts, so no two texts that met are left out; that is
    quadratic in texts that share buckets and resemble each other too little.

    A null text is in a class of its own, empty texts are copies of each other, and a
    text of fewer than five words is one shingle. Every row has its own text's class,
    also if its id is repeated. An empty table gives no rows; other columns
    are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = _with_copy(rows)
    return _by_row(rows, docs, _by_text(docs), id_col)


def chosen(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class of several rows: copy, a row for each of its texts (``copy_of``),
    and the id and copy of the text that stands for the class. That is the smallest id
    and, of texts with one id, the smallest copy; a null id comes last. ``repeated`` says
    whether the text that stands for the class is on several rows, of any ids."""
    by_text = _by_text(_with_copy(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))))
    best = by_text.groupBy("component").agg(
        F.min_by(F.struct("first", "copy", "n"), F.struct(F.col("first").isNull(), "first", "copy")).alias("best"),
        F.sum("n").alias("rows"),
    )
    return by_text.join(best.where("rows > 1"), "component").select(
        "copy",
        F.col("best.first").alias("best_id"),
        F.col("best.copy").alias("best_copy"),
        (F.col("best.n") > 1).alias("repeated"),
    )


def _with_copy(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("text").isNotNull()).withColumn("copy", copy_of(F.col("text")))


def _components(docs: DataFrame) -> DataFrame | None:
    """node and component of the texts (columns copy, id, text) that are linked, if any."""
    banded = stored(_bands(docs))
    n_rows = banded.count() * BANDS
    bands = banded.select("copy", "copies", "first", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    # Only rows that meet another go on; this is the one join of all bands.
    shared, _ = compact(shared, n_rows // 2)
    open_rows, n_open = compact(bands.join(small(shared, BROADCAST_ROWS), "key", "left_semi"), n_rows)
    edges = tried = labels = None
    for turn in range(ROUNDS):
        known = _labelled(open_rows, labels)
        # What others were copied from is likely the text of most copies, or else the
        # first; later hubs differ from bucket to bucket, so a text meets several.
        hub_order = (
            F.struct(-F.col("copies"), "first", "copy"),
            F.struct("first", "copy"),
            F.xxhash64("copy", "key", F.lit(turn)),
        )[min(turn, 2)]
        hubs = (
            known.groupBy("key")
            .agg(
                F.min_by(F.struct("copy", "component"), hub_order).alias("hub"),
                F.min("component").alias("low"),
                F.max("component").alias("high"),
            )
            .where("low < high")
            .select("key", F.col("hub.copy").alias("hub"), F.col("hub.component").alias("hub_component"))
        )
        # Written first, so that the join can split the rows of a bucket.
        hubs, n_hubs = compact(hubs, n_open // 2)
        if not n_hubs:
            open_rows, n_open = open_rows.limit(0), 0
            break
        members = known.join(small(hubs, BROADCAST_ROWS), "key").where(F.col("copy") != F.col("hub"))
        pairs = (
            members.where(F.col("component") != F.col("hub_component"))
            .select(F.least("copy", "hub").alias("copy"), F.greatest("copy", "hub").alias("hub"))
            .distinct()
        )
        if tried is not None:
            pairs = pairs.join(tried, ["copy", "hub"], "left_anti")
        pairs, n_pairs = compact(pairs, n_open)
        # A hub that has met its whole bucket leaves it, so the next one is another.
        open_rows, n_open = compact(members.select(*open_rows.columns), n_open)
        if not n_pairs:
            continue
        tried = pairs if tried is None else tried.union(pairs)
        found, n_found = compact(_verified(pairs, docs), n_pairs, VERIFIED_PAIRS)
        if n_found:
            edges = found if edges is None else edges.union(found)
            labels = components(edges, "copy", "hub")
    rest = _rest(_labelled(open_rows, labels), docs, n_open)
    if rest is not None:
        found = stored(rest)
        if not found.isEmpty():
            labels = components(found if edges is None else edges.union(found), "copy", "hub")
    return labels


def _by_text(docs: DataFrame) -> DataFrame:
    """copy, first (id), n (rows) and component of each text."""
    labels = _components(docs)
    by_copy = docs.groupBy("copy").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    if labels is not None:
        by_copy = by_copy.join(labels.withColumnRenamed("node", "copy"), "copy", "left")
    else:
        by_copy = by_copy.withColumn("component", F.lit(None).cast("binary"))
    return stored(by_copy.withColumn("component", F.coalesce("component", "copy")))


def _by_row(rows: DataFrame, docs: DataFrame, by_copy: DataFrame, id_col: str) -> DataFrame:
    """The class of each row from the component of its text."""
    lowest = by_copy.groupBy("component").agg(
        F.min("first").alias("class_id"), F.sum("n").alias("rows"), F.count("*").alias("texts")
    )
    # Only texts that share their class with another row need looking up.
    shared = by_copy.join(lowest.where("rows > 1"), "component").select("copy", "class_id")
    named = docs.select("id", "copy").join(small(stored(shared), BROADCAST_ROWS), "copy", "left")
    with_text = named.select(F.col("id"), F.coalesce("class_id", "id").alias("class_id"))
    without = rows.where(F.col("text").isNull()).select("id", F.col("id").alias("class_id"))
    return with_text.union(without).withColumnRenamed("id", id_col)
