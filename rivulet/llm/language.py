"""Language identification by n-gram filters that answer with a bitmask of languages."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rivulet.llm.common import map_texts, parts, stored

# Slots of the filter: 8 bytes each, whatever the corpus and its languages.
SLOTS_LOG2 = 20
# An n-gram belongs to the languages where its rate is at least this share of its
# highest rate: words that strayed in from another language do not count.
RATE_SHARE = 0.25
# A language's rarer n-grams are left out, so it has at most 1 / MIN_RATE of them.
MIN_RATE = 2e-6
MAX_LANGUAGES = 63
UNDETERMINED = "und"
# Characters that are looked at together.
BLOCK_CHARS = 1 << 20
# Distinct n-grams that a task holds before it hands them on.
HELD_GRAMS = 1 << 20
# One odd multiplier for each hash.
_MULTIPLIERS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SPACE = np.uint64(32)
_letters: np.ndarray | None = None


class LanguageFilter(NamedTuple):
    """Slot s has bit l set if an n-gram of language l falls on it."""

    languages: list[str]
    slots: np.ndarray
    fallback: str

    def false_positive_rates(self) -> np.ndarray:
        """By language, the chance that all slots of a foreign n-gram are set."""
        bits = [np.count_nonzero(self.slots >> np.uint64(l) & np.uint64(1)) for l in range(len(self.languages))]
        return (np.array(bits) / self.slots.size) ** len(_MULTIPLIERS)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters[codes]


def _blocks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Owners and pieces of about BLOCK_CHARS together; a longer text comes in several.
    Each piece has one more character of context on either side."""
    owners, pieces, held = [], [], 0
    for owner, text in enumerate(texts):
        for start in range(0, max(len(text), 1), BLOCK_CHARS):
            piece = (text[start - 1 : start] if start else "\n") + text[start : start + BLOCK_CHARS]
            piece += text[start + BLOCK_CHARS : start + BLOCK_CHARS + 1] or "\n"
            owners.append(owner)
            pieces.append(piece)
            held += len(piece)
            if held >= BLOCK_CHARS:
                yield owners, pieces
                owners, pieces, held = [], [], 0
    if pieces:
        yield owners, pieces


def letter_grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In blocks, the keys of all letter trigrams and the index of the text of each.

    Every letter in lower case stands in the middle of one; what is no letter counts
    as a space. A key holds the three characters, 21 bits each.
    """
    for owners, pieces in _blocks([(t or "").lower() for t in texts]):
        sizes = np.array([len(p) for p in pieces])
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        letters = _is_letter(codes)
        clean = np.where(letters, codes, _SPACE).astype(np.uint64)
        ends = np.cumsum(sizes)
        letters[ends - 1] = False
        letters[ends - sizes] = False
        middle = np.flatnonzero(letters)
        keys = clean[middle - 1] << np.uint64(42) | clean[middle] << np.uint64(21) | clean[middle + 1]
        yield keys, np.repeat(np.array(owners), sizes)[middle]


def _slots(keys: np.ndarray) -> Iterator[np.ndarray]:
    for multiplier in _MULTIPLIERS:
        mixed = (keys ^ keys >> np.uint64(29)) * multiplier
        mixed = (mixed ^ mixed >> np.uint64(32)) * multiplier
        yield mixed >> np.uint64(64 - SLOTS_LOG2)


def _gram_counts(texts: DataFrame) -> DataFrame:
    """language, gram, n over all rows of (language, text), pre-aggregated in the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(chunks):
            keys, place = np.unique(np.concatenate([k for k, _ in chunks]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in chunks])).astype(np.int64)

        def handed_on():
            for language, chunks in held.items():
                keys, counts = merged(chunks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(counts)],
                    names=["language", "gram", "n"],
                )

        for batch in batches:
            for part in parts(batch, 1):
                languages = part.column(0).to_pylist()
                names = sorted(set(languages))
                code = np.array([names.index(x) for x in languages])
                for keys, owners in letter_grams(part.column(1).to_pylist()):
                    for i, name in enumerate(names):
                        own, n = np.unique(keys[code[owners] == i], return_counts=True)
                        chunks = held.setdefault(name, [])
                        chunks.append((own, n))
                        size += len(own)
            if size > HELD_GRAMS:
                held = {name: [merged(chunks)] for name, chunks in held.items()}
                size = sum(len(chunks[0][0]) for chunks in held.values())
                if size > HELD_GRAMS // 2:
                    yield from handed_on()
                    held, size = {}, 0
        yield from handed_on()

    counted = texts.mapInArrow(count, "language string, gram bigint, n bigint")
    return counted.groupBy("language", "gram").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageFilter:
    """The filter of all rows with a language. What reaches the driver is a row for
    each language and for each slot of the filter, however large the corpus."""
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = stored(_gram_counts(known.select(F.col(lang_col).cast("string").alias("language"), text_col)))
    totals = counts.groupBy("language").agg(F.sum("n").alias("total")).limit(MAX_LANGUAGES + 1).collect()
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    size = {r["language"]: r["total"] for r in totals}
    languages = sorted(size)
    slots = np.zeros(1 << SLOTS_LOG2, np.uint64)
    if not languages:
        return LanguageFilter([], slots, UNDETERMINED)

    total = F.create_map(*(F.lit(x) for name in languages for x in (name, float(size[name]))))
    bit = F.create_map(*(F.lit(x) for i, name in enumerate(languages) for x in (name, 1 << i)))
    rated = counts.select(
        "gram", (F.col("n") / total[F.col("language")]).alias("rate"), bit[F.col("language")].alias("bit")
    ).where(F.col("rate") >= MIN_RATE)
    # At most a row for each language in a group.
    masks = (
        rated.groupBy("gram")
        .agg(F.max("rate").alias("top"), F.collect_list(F.struct("rate", "bit")).alias("rates"))
        .select(
            "gram",
            F.aggregate(
                F.filter("rates", lambda r: r["rate"] >= F.col("top") * RATE_SHARE),
                F.lit(0).cast("bigint"),
                lambda mask, r: mask.bitwiseOR(r["bit"].cast("bigint")),
            ).alias("mask"),
        )
    )

    def on_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.uint64)
            places = np.concatenate([s.astype(np.int64) for s in _slots(keys)])
            mask = np.tile(batch.column(1).to_numpy(), len(_MULTIPLIERS))
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(mask)], names=["slot", "mask"])

    filled = masks.mapInArrow(on_slots, "slot bigint, mask bigint")
    rows = filled.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    slots[rows["slot"].to_numpy()] = rows["mask"].to_numpy().astype(np.uint64)
    return LanguageFilter(languages, slots, max(languages, key=lambda name: size[name]))


def predict(
    df: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, lang_pred and score of every whole text.

    Each trigram is looked up once, for all languages together; a language's count of
    hits, less those that chance alone gives, is its evidence, and its share of all
    evidence the score. Ties go to the name that sorts first; a text none of whose
    trigrams is known gets the most frequent language with score 0. Null, empty and
    letterless texts, and all texts if the model has learnt no language, are ``und``
    with score 0. Repeated rows give a row each; an empty table gives none; other
    columns are ignored.
    """
    chance = model.false_positive_rates()
    n_languages = len(model.languages)

    def worker():
        def work(texts: list[str | None]) -> list[pa.Array]:
            grams = np.zeros(len(texts))
            hits = np.zeros((n_languages, len(texts)))
            for keys, owners in letter_grams(texts):
                grams += np.bincount(owners, minlength=len(texts))
                found = None
                for place in _slots(keys):
                    found = model.slots[place] if found is None else found & model.slots[place]
                for l in range(n_languages):
                    hits[l] += np.bincount(owners[(found >> np.uint64(l) & np.uint64(1)).astype(bool)], minlength=len(texts))
            evidence = np.maximum(0, hits - chance[:, None] * grams) / (1 - np.minimum(chance, 0.999))[:, None]
            total = evidence.sum(0)
            names, scores = [], []
            for i in range(len(texts)):
                if not grams[i] or not n_languages:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                elif not total[i]:
                    names.append(model.fallback)
                    scores.append(0.0)
                else:
                    best = int(evidence[:, i].argmax())
                    names.append(model.languages[best])
                    scores.append(float(evidence[best, i] / total[i]))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return work

    return map_texts(df, text_col, [id_col], ["lang_pred string", "score double"], worker)
