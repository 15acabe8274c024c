"""Byte-level BPE through a sentencepiece model that is written from the vocabulary."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rivulet.llm.common import map_texts, parts
from rivulet.llm.pretokens import byte_level

MEMO_WORDS = 300_000
# Bytes are written as the characters from here on: no white space, no controls.
_FIRST = 0x100
_AS_LETTERS = {b: _FIRST + b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        pairs = (line.split() for line in file if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_AS_LETTERS)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The vocabulary as a serialised sentencepiece BPE model.

    Piece ids are ranks and scores their negatives, so the best-scored merge is the
    one of lowest rank. The normaliser is the identity. Field numbers are fixed
    values of the public model format.
    """
    ordered = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [
        _field(1, _field(1, _letters(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank))
        for rank, token in enumerate(ordered)
    ]
    unknown = _field(1, _field(1, b"<unk>") + _number(3, 2))
    trainer = _field(2, _number(3, 2) + _number(4, len(ordered) + 1) + _number(40, len(ordered)))
    normalizer = _field(3, _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return b"".join(pieces) + unknown + trainer + normalizer


class PieceBPE:
    def __init__(self, path: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.tokens = sorted(self.ranks, key=self.ranks.get)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.pattern = byte_level()
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t or "") for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        self._learn(list({w for words in split for w in words if w not in self.memo}))
        return [b"".join(map(self.memo.__getitem__, words)) for words in split]

    def _learn(self, words: list[str]) -> None:
        merged = []
        for word in words:
            # A pre-token that is itself a token is that token, merges or not.
            whole = self.ranks.get(word.encode())
            if whole is None:
                merged.append(word)
            else:
                self.memo[word] = whole.to_bytes(4, "little")
        ids = self.model.encode([_letters(w.encode()) for w in merged], num_threads=1)
        for word, found in zip(merged, ids):
            self.memo[word] = np.array(found, "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens, by the inverse mapping."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@cache
def _coder(path: str) -> PieceBPE:
    return PieceBPE(path)


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ids, the whole text's ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Strings that look like special tokens are text.
    Repeated rows and ids give a row each; an empty table gives none; other columns
    are ignored. ``vocabulary`` is the path of a rank file that executors can read.
    """

    def worker():
        coder = _coder(vocabulary)
        return lambda texts: [pa.array(coder.encode(texts), pa.binary())]

    return map_texts(df, text_col, [id_col], ["ids binary"], worker)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes behind the ids; null ids decode to null. A
    column that has that name already is replaced."""
    coded = df.drop("decoded")
    place = coded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for batch in batches:
            for part in parts(batch, place):
                ids = part.column(place).to_pylist()
                decoded = [None if i is None else coder.decode(i) for i in ids]
                yield part.append_column("decoded", pa.array(decoded, pa.binary()))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields]
    return coded.mapInArrow(run, ", ".join([*fields, "decoded binary"]))
