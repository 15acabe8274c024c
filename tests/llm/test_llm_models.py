"""Models: held-out accuracy, and their sums against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import language, quality, queries, toxicity
from rivulet.llm.common import table

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    found = queries.op1_bitmask_language_filters(spark, SF)
    docs = table(spark, SF, "documents").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_trigrams_are_those_of_a_plain_loop():
    texts = ["Über ß3x", None, "", "a", "12 !", "x" * 50 + " y"]
    plain = []
    for owner, text in enumerate(texts):
        letters = [c if c.isalpha() else " " for c in f" {(text or '').lower()} "]
        plain += [("".join(letters[i - 1 : i + 2]), owner) for i in range(1, len(letters) - 1) if letters[i] != " "]
    for size in (7, 1 << 20):
        language.BLOCK_CHARS, before = size, language.BLOCK_CHARS
        found = []
        for keys, owners in language.letter_grams(texts):
            for key, owner in zip(keys.tolist(), owners.tolist()):
                found.append(("".join(chr(key >> s & 0x1FFFFF) for s in (42, 21, 0)), owner))
        language.BLOCK_CHARS = before
        assert sorted(found) == sorted(plain)


def test_filter_forgets_no_language(spark):
    texts = [(1, "der die das und", "de"), (2, "the and with", "en"), (3, "the und", "en"), (4, "x", None)]
    model = language.train(spark.createDataFrame(texts, "doc_id bigint, text string, lang string"))
    assert model.languages == ["de", "en"]
    for _, text, lang in texts[:2]:
        for keys, _ in language.letter_grams([text]):
            mask = np.bitwise_and.reduce([model.slots[s] for s in language._slots(keys)])
            assert ((mask >> np.uint64(model.languages.index(lang))) & np.uint64(1)).all()


def test_language_of_hard_rows(spark):
    schema = "doc_id bigint, text string, lang string, score string"
    rows = [(1, "der die das", "de", ""), (2, "the and with", "en", ""), (2, "the and with", "en", "")]
    model = language.train(spark.createDataFrame(rows, schema))
    hard = [(5, None, "", ""), (6, "", "", ""), (7, "123 !?", "", ""), (8, "漢字", "", ""), (9, "das " * 400_000, "", "")]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(spark.createDataFrame(hard, schema), model).collect()}
    assert found[5] == found[6] == found[7] == ("und", 0.0)
    assert found[8] == ("en", 0.0) and found[9][0] == "de"
    none = language.train(spark.createDataFrame([], schema))
    assert {r["lang_pred"] for r in language.predict(spark.createDataFrame(hard, schema), none).collect()} == {"und"}
    assert language.predict(spark.createDataFrame([], schema), model).collect() == []


def test_toxicity_held_out(spark):
    labels = table(spark, SF_MORE, "labels").select("doc_id", "toxic")
    rows = queries.op7_kneser_ney_toxicity(spark, SF_MORE).join(labels, "doc_id", "left").collect()
    assert len(rows) == table(spark, SF_MORE, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    toxic, other = ([r["score"] for r in held if r["toxic"] == t] for t in (1, 0))
    better = sum((a > b) + 0.5 * (a == b) for a in toxic for b in other)
    assert better / (len(toxic) * len(other)) >= 0.8


def test_class_models_sum_to_one(spark):
    """Over all events that a class competes with, its shares add up."""
    rng = random.Random(1)
    rows = [(w, rng.randrange(4), rng.randrange(1, 40)) for w in map(str, range(300))]
    df = spark.createDataFrame(rows, "word string, t bigint, o bigint")
    sums = df.agg(*toxicity._sums("t", "o")).first()
    counts = {c: [r[i] for r in rows] for c, i in (("t", 1), ("o", 2))}
    gap = sum(toxicity.DISCOUNT * sum(x > 0 for x in v) / sum(v) for v in counts.values()) / 2
    total = sum(map(sum, counts.values()))

    def share(c, i):
        left = sum(max(x - toxicity.DISCOUNT, 0) for x in counts[c])
        return (1 - gap) * max(counts[c][i] - toxicity.DISCOUNT, 0) / left + gap * (counts["t"][i] + counts["o"][i]) / total

    for c in "to":
        assert math.isclose(sum(share(c, i) for i in range(len(rows))), 1)
    ratio = toxicity._ratio(
        F.col("t"), F.col("o"), *(F.lit(sums[f"{c}_{x}"]) for x in ("sum", "left", "kinds") for c in "to")
    )
    for i, r in enumerate(df.select(ratio.alias("r")).collect()):
        assert math.isclose(r["r"], math.log(share("t", i) / share("o", i)), abs_tol=1e-9)


def test_a_rare_word_speaks_through_its_stem(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("aeioubdgklmn") for _ in range(6)) for _ in range(200)]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(40)]
        if toxic:
            words[3] = "vilex" + rng.choice(plain)
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic), 7))
    docs += [(1000, " ".join(plain[:40]) + " vilexunseen", "x"), (1001, " ".join(plain[:40]), "x"), (1002, None, "x"), (1003, "", "x"), (1001, " ".join(plain[:40]), "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, word string")
    models = toxicity.train(df, spark.createDataFrame(labels, "doc_id bigint, toxic int, text int"))
    rows = toxicity.score(df, models).collect()
    assert len(rows) == len(docs)
    found = {r["doc_id"]: r["predicted"] for r in rows}
    assert [found[i] for i in (1000, 1001, 1002, 1003)] == [1, 0, 0, 0]
    none = toxicity.train(df, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r["predicted"] for r in toxicity.score(df, none).collect()} == {int(0.5 / 1 >= 0.3)}
    assert toxicity.score(df.limit(0), models).collect() == []


def test_quality_held_out(spark):
    labels = table(spark, SF_MORE, "labels").select("doc_id", "quality")
    rows = queries.op6_hierarchical_bayes_quality(spark, SF_MORE).join(labels, "doc_id", "left").collect()
    assert len(rows) == table(spark, SF_MORE, "documents").count()
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert all(r["kept"] for r in held if r["quality"] == 1)
    assert sum(r["kept"] == (r["quality"] == 1) for r in held) >= 0.95 * len(held)


def test_sparse_sites_shrink(spark):
    rows = [("a", "x", 1.0)] * 400 + [("b", "x", 0.0)] * 400 + [("c", "x", 0.0)] * 2 + [("a", "y", 0.0)] * 2
    sites = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, good double"), 0.5)
    odds = {(r["host"], r["path"]): r["site_log_odds"] for r in sites.collect()}
    assert odds["b", "x"] < odds["c", "x"] < odds["a", "y"] < odds["a", "x"]
    assert odds["b", "x"] < -5 and -3 < odds["c", "x"] < 0


def test_quality_of_hard_rows(spark):
    schema = "doc_id bigint, text string, source string, lang string, host string, good int"
    rows = [(1, None, None, None, "h", 0), (2, "", "s", None, "h", 0), (2, "", "s", None, "h", 0), (3, "word " * 100_000, "s", "l", "h", 0)]
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id bigint, quality int")
    judged = quality.classify(df, labels, "source", "lang").collect()
    assert sorted(r["doc_id"] for r in judged) == [1, 2, 2, 3]
    assert all(0 < r["__posterior"] < 1 and r["host"] == "h" for r in judged)
    assert quality.classify(df.limit(0), labels, "source", "lang").collect() == []
    assert quality.classify(df, labels.limit(0), "source", "lang").count() == 4
