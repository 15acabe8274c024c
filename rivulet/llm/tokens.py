"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rivulet.llm.common import map_texts
from rivulet.llm.pretokens import byte_letters, word_level

# Distinct pre-tokens whose counts a Python worker keeps before it starts anew.
MEMO_WORDS = 400_000
# Symbols that are merged in one set of arrays; a longer pre-token comes alone.
ARRAY_SYMBOLS = 1 << 19
_NONE = np.iinfo(np.int32).max


class RankMerger:
    """The merges of a word-end BPE vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        products = [vocab[a + b] for a, b in merges]
        if len(set(products)) != len(products):
            # Then a later merge could give birth to a pair of lower rank, and one
            # pass over all occurrences would differ from merging one at a time.
            raise ValueError("two merges of this vocabulary make the same symbol")
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.products = np.array(products, np.int64)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = word_level(split)
        self.specials = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of the text and the number of special strings in it,
        each of which the library takes for one token."""
        pieces = self.specials.split(text)
        words = []
        for piece in pieces:
            # One character at a time, as the library lowers: no final sigma.
            lowered = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            words += self.words.findall(lowered)
        return words, len(pieces) - 1

    def counts(self, words: list[str]) -> np.ndarray:
        """Symbols that survive all merges in each of ``words``."""
        coded = [w.encode() for w in words]
        sizes = np.array([len(c) for c in coded], np.int64)
        found = np.empty(len(words), np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > ARRAY_SYMBOLS:
                found[start:i] = self._merged(coded[start:i], sizes[start:i])
                start, held = i, 0
            held += size
        if start < len(words):
            found[start:] = self._merged(coded[start:], sizes[start:])
        return found

    def _merged(self, coded: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """All sequences side by side; in each round every sequence merges all
        occurrences of its pair of lowest rank, and those without one leave."""
        flat = np.frombuffer(b"".join(coded), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[flat[ends]]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        survivors = np.zeros(len(sizes), np.int64)
        while symbols.size:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            ranks = self._pair_ranks(symbols, owner)
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.r_[starts, symbols.size])
            done = lowest == _NONE
            survivors[owner[starts[done]]] = lengths[done]
            best = np.repeat(lowest, lengths)
            at = np.flatnonzero((ranks == best) & (best != _NONE))
            at = _without_overlaps(at, symbols)
            symbols[at] = self.products[ranks[at]]
            stay = np.repeat(~done, lengths)
            stay[at + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return survivors

    def _pair_ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        ranks = np.full(symbols.size, _NONE, np.int32)
        if symbols.size > 1:
            pairs = symbols[:-1] * self.size + symbols[1:]
            place = np.minimum(np.searchsorted(self.keys, pairs), self.keys.size - 1)
            known = (self.keys[place] == pairs) & (owner[:-1] == owner[1:])
            ranks[:-1][known] = self.ranks[place[known]]
        return ranks


def _without_overlaps(at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """In a run like ``a a a`` the pairs overlap: take every other one from the left."""
    touching = np.r_[False, (at[1:] == at[:-1] + 1) & (symbols[at[1:]] == symbols[at[:-1]])]
    index = np.arange(at.size)
    run_start = np.maximum.accumulate(np.where(touching, 0, index))
    return at[(index - run_start) % 2 == 0]


@cache
def _merger(path: str) -> tuple[RankMerger, dict[str, int]]:
    return RankMerger(path), {}


def count_tokens(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, n_bytes (UTF-8) and n_tokens of every row's whole text.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and ids give a row
    each; an empty table gives none; other columns are ignored. ``vocabulary`` is
    the path of a tokenizer file that every executor can read. Counts depend on
    nothing but the text, so a retried task repeats them.
    """

    def worker():
        merger, memo = _merger(vocabulary)

        def work(texts: list[str | None]) -> list[pa.Array]:
            split = [merger.pretokens(t or "") for t in texts]
            if len(memo) > MEMO_WORDS:
                memo.clear()
            new = list({w for words, _ in split for w in words if w not in memo})
            memo.update(zip(new, merger.counts(new).tolist()))
            sizes = [len((t or "").encode()) for t in texts]
            tokens = [sum(map(memo.__getitem__, words)) + n for words, n in split]
            return [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())]

        return work

    return map_texts(df, text_col, [id_col], ["n_bytes bigint", "n_tokens bigint"], worker)
