"""Token operators against the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from rivulet.llm import bytebpe, packing, queries
from rivulet.llm.tokens import RankMerger

SF = "/root/testdata/sf0.001"


def awkward_texts(n: int) -> list[str]:
    rng = random.Random(5)
    pool = [chr(c) for c in range(0x250)] * 2 + [chr(rng.randrange(0x300, 0x3000)) for _ in range(300)]
    pool += [chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(100)] + list(" \n\t\r\x0b\x1c\x85 　") * 20
    pool += list("aaaaeeeeabcabcthethe") * 20 + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "ΟΔΟΣ", "İ", "½", "Ⅷ"] * 6
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return awkward_texts(1500) + ["", "a" * 4000, "ab" * 3000, "ha " * 2000]


@pytest.fixture(scope="module")
def documents():
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def test_rank_synchronous_counts(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    merger, library = RankMerger(path), Tokenizer.from_file(path)
    for text in texts:
        words, specials = merger.pretokens(text)
        expected = len(library.encode(text, add_special_tokens=False).ids)
        assert int(merger.counts(words).sum()) + specials == expected, text


def test_overlapping_pairs_merge_from_the_left():
    from rivulet.llm.tokens import _without_overlaps

    symbols = np.array([7, 7, 7, 7, 7, 1, 7, 7, 7])
    assert _without_overlaps(np.array([0, 1, 2, 3, 6, 7]), symbols).tolist() == [0, 2, 6]


def test_piece_model_equals_ranks(texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coder = bytebpe.PieceBPE(path)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={}
    )
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert coder.decode(ids) == text.encode()


def test_packing_ids_equal_the_tokenizer_file(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for text in texts:
        assert packing.token_ids(path, text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_every_token_is_found_by_both(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    strings = library.decode_batch([[i] for i in range(0, 50256, 7)])
    for text in strings:
        assert packing.token_ids(path, text)[:-1].tolist() == library.encode(text, add_special_tokens=False).ids


def test_count_query(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.op9_rank_synchronous_counts(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        text = documents[r["doc_id"]]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_round_trip_query(spark, documents):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={}
    )
    rows = queries.op10_piece_bpe_round_trip(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        text = documents[r["doc_id"]]
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_packing_query(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    by_doc, by_sequence = {}, {}
    for r in queries.op5_sum_of_squares_packing(spark, SF).collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == documents.keys()
    for doc_id, text in documents.items():
        ids, at = packing.token_ids(path, text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    gaps = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= packing.WINDOW
        gaps += at < packing.WINDOW
    assert gaps <= 1  # one partition


def test_packing_hands_rows_on_in_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    runs = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run))
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    # One long document alone, and many that leave open windows.
    texts = [" ".join(map(str, range(400_000)))] + [f"{i} " * 700 for i in range(1_200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["__id", "__text"])
    made = list(runs[0](iter([batch])))
    sizes = [sum(len(x) for x in b.column("ids").to_pylist()) for b in made]
    assert max(sizes) < 2 * packing._FLUSH_BYTES < sum(sizes)
    rows = pa.Table.from_batches(made).to_pylist()
    lengths = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert sum(sizes) == 4 * sum(lengths.values()) and len(lengths) == len(texts)


def test_levels_follow_the_rule():
    window, rng = 16, random.Random(3)
    levels, open_windows = packing.LevelArray(window), []
    for n in range(600):
        size = rng.randrange(1, window + 1)
        fullest, best = None, None
        for level in sorted({0, *open_windows}):
            if level + size > window:
                continue
            after = list(open_windows)
            if level:
                after.remove(level)
            if level + size < window:
                after.append(level + size)
            cost = sum(after.count(x) ** 2 for x in set(after))
            if best is None or cost <= best:
                fullest, best, chosen = level, cost, after
        assert fullest is not None
        open_windows = chosen
        levels.place(packing.Piece(n, 0, np.zeros(size, "<u4"), size))
        assert [levels.counts[h] for h in range(1, window)] == [open_windows.count(h) for h in range(1, window)]
    left = sum(open_windows)
    rest = [sum(len(p.ids) for p in w) for w in levels.leftovers()]
    assert sum(rest) == left and all(x == window for x in rest[:-1])
