"""Conversation structure repair by shortest paths that an auction of node prices finds."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rivulet.llm.common import in_small_batches

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
# Where a repaired conversation may stand: nothing yet, after the system turn, after a
# user's, after an assistant's; it may end at START and ASSISTANT.
START, SYSTEM, USER, ASSISTANT = range(4)
# The role that an inserted or changed turn takes there.
FILLS = (USER, USER, ASSISTANT, USER)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
# Where a kept turn leads, by its initial.
KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
LEGAL = frozenset(("su", "ua", "au"))

# A row's code is its initial's place here plus 4 times what is wrong with it.
INITIALS = "sua"
FINE, CUT_OFF, MUST_GO = range(3)
END = 12
_FAR = 1 << 40
# Rows of one auction; the prices behind them are settled before it.
BLOCK = 64
_FLUSH = 2_000
# Characters that are no blank, and a text whose last such character ends a sentence.
WRITTEN = r"[^\x20\x09-\x0D]"
CLOSED = r"[.!?][\x20\x09-\x0D]*\z"


def _arcs_of(code: int) -> list[list[tuple[str, int, int]]]:
    """By state: edit, cost and how far its node is, in ASCII order of the edits."""
    out = []
    for state in range(4):
        fill = FILLS[state]
        if code == END:
            arcs = [("", 0, 4), ("I", INSERT, fill - state)]
        else:
            initial, fault = (INITIALS + "?")[code % 4], code // 4
            arcs = [("D", DELETE, 4), ("I", INSERT, fill - state)]
            if fault != MUST_GO:
                more = TRUNCATED if fault == CUT_OFF else 0
                if initial in KEEPS[state]:
                    arcs.append(("K", more, 4 + KEEPS[state][initial] - state))
                arcs.append(("R", REROLE + more, 4 + fill - state))
        out.append(arcs)
    return out


ARCS = [_arcs_of(code) for code in range(END + 1)]


def _auction(arcs: list, prices: array, origin: int, beyond: int) -> None:
    """Raise prices until that of ``origin`` is its distance to the destination, which
    every node from ``beyond`` on reaches at its own settled price.

    Every price stays at most the cost of any arc plus the price at its end. The path
    from the origin grows along an arc that is tight, and where none is, the last
    node's price rises to the cheapest and the path gives it up.
    """
    path = [origin]
    while True:
        node = path[-1]
        best, to = _FAR << 1, node
        for _, cost, step in arcs[node >> 2][node & 3]:
            reached = cost + prices[node + step]
            if reached < best:
                best, to = reached, node + step
        if prices[node] < best:
            prices[node] = best
            if len(path) > 1:
                path.pop()
        elif to >= beyond:
            return
        else:
            path.append(to)


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """The least cost of making the rows a legal conversation, and the edits of least
    cost in order; of several the ASCII-least.

    Node 4 i + s stands before row i in state s. Blocks of rows are settled from the
    last to the first, each by auctions from its four first nodes towards the prices
    behind it. The prices then allow no arc to be cheaper than its ends' difference, so
    every shortest path runs over tight arcs only.
    """
    arcs = [ARCS[c] for c in codes] + [ARCS[END]]
    n = len(arcs)
    prices = array("q", bytes(8 * 4 * n)) + array("q", (0, _FAR, _FAR, 0))
    for start in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        beyond = 4 * min(n, start + BLOCK)
        lowest = min(prices[beyond : beyond + 4])
        for node in range(4 * start, beyond):
            prices[node] = lowest
        for state in range(4):
            _auction(arcs, prices, 4 * start + state, beyond)
    # A tight arc may lead where no tight path goes on. Insertions lead at most 2 nodes on,
    # arcs to the next row at least 3.
    open_ = bytearray(4 * n) + bytearray((1, 0, 0, 1))
    for node in range(4 * n - 1, -1, -1):
        open_[node] = any(
            step > 2 and open_[node + step] and prices[node] == cost + prices[node + step]
            for _, cost, step in arcs[node >> 2][node & 3]
        )
        if not node & 3:
            # Insertions stay before the row: two of them lead anywhere.
            for state in (USER, ASSISTANT, SYSTEM, START) * 2:
                to = node + FILLS[state]
                if open_[to] and prices[node + state] == INSERT + prices[to]:
                    open_[node + state] = 1
    edits, node = [], START
    while node < 4 * n:
        for edit, cost, step in arcs[node >> 2][node & 3]:
            if open_[node + step] and prices[node] == cost + prices[node + step]:
                edits.append(edit)
                node += step
                break
    return prices[START], "".join(edits)


class _Conversation:
    """What is counted of one conversation while its rows pass by in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_turn = self.last_turn = self.last = None
        self.turns = 0
        self.initial: str | None = None

    def take(self, turn, role, initial, key, blank, closed, repeated) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.turns == 0 else self.first_turn
            self.last_turn = turn
            self.turns += 1
        fault = FINE
        if blank:
            self.blank += 1
            fault = MUST_GO
        elif repeated or (turn, role, key) == self.last:
            self.duplicate += 1
            fault = MUST_GO
        elif not closed:
            self.truncated += 1
            fault = CUT_OFF
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.last, self.initial = (turn, role, key), initial
        place = INITIALS.find(initial) if initial else -1
        self.codes.append(4 * fault + (place if place >= 0 else len(INITIALS)))

    def row(self) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        cost, audit = cheapest_edits(bytes(self.codes))
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost)
        return (self.conv_id, *counts, audit)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _emptied(rows: list, kind: pa.DataType, last: list[str]) -> pa.RecordBatch:
    types = [kind] + [pa.int64()] * len(_COUNTS) + [pa.string()] * len(last)
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    rows.clear()
    return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *_COUNTS, *last])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, rows, kind = None, [], None
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv_id, gone, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if at is None or at.conv_id != conv_id:
                if at is not None:
                    rows.append(at.row())
                at = _Conversation(conv_id)
            if not gone:
                at.take(*row)
        if len(rows) >= _FLUSH:
            yield _emptied(rows, kind, ["audit"])
    if at is not None:
        rows.append(at.row())
        yield _emptied(rows, kind, ["audit"])


class _Rewritten:
    """A conversation that its edits are applied to, row by row, into a running hash."""

    def __init__(self, conv_id, counts: tuple, audit: str):
        self.head, self.audit = (conv_id, *counts, audit), audit
        self.at, self.state, self.hash = 0, START, sha256()

    def _say(self, state: int, role: str, text: str) -> None:
        self.hash.update((("\n" if self.state != START else "") + role + ":").encode())
        self.hash.update(text.encode())
        self.state = state

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            fill = FILLS[self.state]
            self._say(fill, ROLES[fill], "")
            self.at += 1

    def take(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._say(KEEPS[self.state][role[0]], role, text)
        elif edit == "R":
            fill = FILLS[self.state]
            self._say(fill, ROLES[fill], text)

    def row(self) -> tuple:
        self._insert()
        return (*self.head, self.hash.hexdigest())


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, rows, kind = None, [], None
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv_id, role, text, audit, *counts in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                if at is not None:
                    rows.append(at.row())
                at = _Rewritten(conv_id, tuple(counts), audit)
            else:
                at.take(role, text)
        if len(rows) >= _FLUSH:
            yield _emptied(rows, kind, ["audit", "repaired_sha256"])
    if at is not None:
        rows.append(at.row())
        yield _emptied(rows, kind, ["audit", "repaired_sha256"])


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and whether the row is gone, after the damage that
    crc32 of ``conv_id:turn`` (null: one space) names: of 20 remainders 0 drops the
    row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a
    user's. Null roles and texts are one space."""

    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    named = F.concat(said("conv_id"), F.lit(":"), said("turn"))
    how = F.crc32(named.cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(said("text"), "[.!?]", ""))
    rows = df.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.when(how == 4, "user").otherwise(said("role")).alias("role"),
        text.otherwise(said("text")).alias("text"),
        (how == 0).alias("gone"),
        F.explode(F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    )
    return rows.drop("col")


def repair(df: DataFrame) -> DataFrame:
    """A row for each conv_id of (conv_id, turn, role, text, gone): what is wrong with
    it, the cheapest edits that make its roles ``(s?(ua)+)?``, and the hash of what it
    then says. Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.

    Rows go by turn (null first), then role, then the text's SHA-256, so ties and
    repeated rows have a place; each repeated row after the first is a duplicate. An
    empty or blank text is blank. A role is its first character; one that is not s, u
    or a, and an empty role, can be changed or deleted but not kept. Rows without
    conv_id are one conversation; one whose rows are all gone has zeros, no edits and
    the hash of nothing. Other columns are ignored, an empty table gives no rows.

    Where a text was said first is found by a pre-aggregated grouping over hashes.
    Conversations then stream through the tasks in order twice, once as hashes for the
    edits, once as texts for the hash of the repaired text; a task holds a byte and
    four prices for each row of one conversation, never its texts. One hash over one
    conversation is sequential by its nature, so that much of it is one task's.
    """
    in_small_batches(df.sparkSession)
    rows = df.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.coalesce("gone", F.lit(False)).alias("gone"),
    ).withColumn("key", F.unhex(F.sha2("text", 256)))
    kind = rows.schema["conv_id"].dataType.simpleString()
    marked = rows.select(
        "*",
        F.struct(F.col("turn").isNotNull(), "turn").alias("when"),
        (~F.col("text").rlike(WRITTEN)).alias("blank"),
        F.col("text").rlike(CLOSED).alias("closed"),
    ).drop("text")
    said = marked.where(~F.col("gone") & ~F.col("blank"))
    firsts = (
        said.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"))
        .agg(F.min("when").alias("first"))
    )
    own = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
    spoken = marked.join(firsts, own, "left").select(
        "conv_id",
        "gone",
        "turn",
        "role",
        F.substring("role", 1, 1).alias("initial"),
        "key",
        "blank",
        "closed",
        F.coalesce(F.col("when") != F.col("first"), F.lit(False)).alias("repeated"),
    )
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    audits = (
        spoken.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "key")
        .mapInArrow(_audits, f"conv_id {kind}, {counts}, audit string")
    )
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("role", "string"), ("key", "binary"), ("text", "string"))]
    heads = audits.select("conv_id", *nothing, "audit", *_COUNTS)
    texts = rows.where(~F.col("gone")).select(
        "conv_id", "turn", "role", "key", "text",
        F.lit(None).cast("string").alias("audit"),
        *(F.lit(None).cast("bigint").alias(c) for c in _COUNTS),
    )
    return (
        heads.unionByName(texts)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "key")
        .select("conv_id", "role", "text", "audit", *_COUNTS)
        .mapInArrow(_hashes, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")
    )
