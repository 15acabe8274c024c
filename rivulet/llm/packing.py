"""Sum-of-squares packing of documents into windows of tokens."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rivulet.llm.common import in_small_batches, parts
from rivulet.llm.pretokens import byte_letters

WINDOW = 1024
# Sequence ids of a partition start at its number times this.
PARTITION_SPAN = 1 << 33
_END = np.uint32(0)
# Rows that go out together, and the bytes of their ids.
_FLUSH_ROWS, _FLUSH_BYTES = 4096, 2 << 20


class Piece(NamedTuple):
    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int


class LevelArray:
    """Open windows by fill level, and the counts that the rule looks at."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put the piece where the sum of squared counts of partially filled windows
        ends up smallest (ties: the fullest window, a new one last). The window is
        returned if that fills it."""
        size = len(piece.ids)
        if size == self.window:
            return [piece]
        counts, top = self.counts, self.window - size
        # Moving a window from level h to h + size changes the sum of squares by
        # 2 (N[h + size] - N[h] + 1); full windows are not counted, N[window] is 0
        # and 2 goes to 1; a new window is N[size] -> N[size] + 1.
        change = 2 * (counts[size : self.window + 1] - counts[: top + 1]) + 2
        change[top] -= 1
        change[0] = 2 * counts[size] + 1
        change[1:][counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        lowest = change.min()
        fits = np.flatnonzero(change == lowest)
        level = int(fits[-1])
        window = self.open[level].pop() if level else []
        window.append(piece)
        if level:
            counts[level] -= 1
        if level + size == self.window:
            return window
        counts[level + size] += 1
        self.open[level + size].append(window)
        return None

    def leftovers(self) -> Iterator[list[Piece]]:
        """What is still open when no document is left, fullest first: strung
        together and cut anew at window ends, so only the last has a gap."""
        held, room = [], self.window
        for level in range(self.window - 1, 0, -1):
            for window in self.open[level]:
                for piece in window:
                    while len(piece.ids) >= room:
                        held.append(piece._replace(ids=piece.ids[:room]))
                        piece = piece._replace(start=piece.start + room, ids=piece.ids[room:])
                        yield held
                        held, room = [], self.window
                    if len(piece.ids):
                        held.append(piece)
                        room -= len(piece.ids)
        if held:
            yield held


@cache
def _encoder(path: str):
    """The vocabulary of a byte-level tokenizer file under the faster of the two
    libraries that read it: merges make ids in rank order, so an id is a rank."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {
        bytes(byte_of[c] for c in token): rank
        for token, rank in spec["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding(
        "byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )


def token_ids(path: str, text: str | None) -> np.ndarray:
    """The text's ids, special strings inside it included, then the end id 0."""
    found = _encoder(path).encode_to_numpy(text or "", allowed_special="all", disallowed_special=())
    return np.append(found, _END).astype("<u4", copy=False)


def pack(
    df: DataFrame,
    vocabulary: str,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Sequences of at most ``window`` tokens, a row for each piece of a document in one.

    Every partition packs its own documents online: whole windows of a long document
    stand alone, its rest goes to the fill level that the sum-of-squares rule names;
    what is open at the end is cut to full windows, so a partition leaves one gap.
    A task holds its open windows and a few MB of rows only. Columns: ``id_col``, start, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are packed each. An
    empty table gives no rows. Other columns are ignored. Ids of sequences follow the
    partitions and the order in them, so a retried task repeats its own if its input
    comes from files.
    """
    in_small_batches(df.sparkSession)
    kept = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    id_type = kept.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, rows, held = LevelArray(window), [], 0
        sequence = TaskContext.get().partitionId() * PARTITION_SPAN
        kind = None

        def take(pieces: list[Piece]) -> None:
            nonlocal sequence, held
            offset = 0
            for p in pieces:
                rows.append((p.doc, p.start, p.ids.tobytes(), p.doc_tokens, sequence, offset))
                offset += len(p.ids)
            held += 4 * offset
            sequence += 1

        def enough() -> bool:
            return len(rows) >= _FLUSH_ROWS or held >= _FLUSH_BYTES

        def flushed() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*rows))
            rows.clear()
            held = 0
            types = [kind, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = [id_col, "start", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            for part in parts(batch, 1):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = token_ids(vocabulary, text)
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        if len(piece) < window:
                            piece = piece.copy()  # a slice would keep all ids of the document
                        full = levels.place(Piece(doc, start, piece, len(ids)))
                        if full:
                            take(full)
                        if enough():
                            yield flushed()
        for pieces in levels.leftovers():
            take(pieces)
            if enough():
                yield flushed()
        if rows:
            yield flushed()

    return kept.mapInArrow(
        run,
        f"`{id_col}` {id_type}, start bigint, ids binary, doc_tokens bigint, "
        "sequence_id bigint, offset bigint",
    )
