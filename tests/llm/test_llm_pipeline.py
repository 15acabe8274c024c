"""Line rules, and the pipeline against plain versions of its stages."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rivulet.llm import bytebpe, packing, queries, rules, tokens
from rivulet.llm.common import table
from test_llm_similar import brute_classes

SF = "/root/testdata/sf0.001"


def plain_counts(text: str | None) -> tuple:
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {p + k for p, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall("[#*$%&|<>]", text or "")),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
        failed,
    )


CLEAN = "\n".join(" ".join(f"word{i * 11 + k}" for k in range(11)) + "." for i in range(20))
MENU = "\n".join(f"Home {i} | News {i} | About {i} | Help {i} | Terms {i}" for i in range(20))
NOISE = "\n".join(" ".join(f"w{i}x{k}$$$" for k in range(9)) for i in range(20))


@pytest.mark.parametrize(
    "text",
    [None, "", " \n\n ", CLEAN, MENU, NOISE, CLEAN + "\n" + MENU, "a b c " * 40, "x\x1cy\x85z\xa0q\x0bk", "same\nsame\nother\nsame", "|", CLEAN * 300],
)
def test_base_counts(text):
    judged = rules.judge(text)
    found = tuple(getattr(judged, f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert found == plain_counts(text)


def test_verdicts():
    assert rules.judge(CLEAN).kept and rules.judge(CLEAN).clean_text == CLEAN
    assert not rules.judge(MENU).kept and not rules.judge(NOISE).kept and not rules.judge(None).kept
    spotted = rules.judge(CLEAN + "\nAll rights reserved. Privacy policy\n***\nHome | News | About | Help")
    assert spotted.kept and spotted.clean_text == CLEAN and spotted.n_failed_lines == 3
    longer = "The court held that all rights reserved by the treaty of that year remain with the people who had signed it then."
    assert longer in rules.judge(CLEAN + "\n" + longer).clean_text


def hard_documents(spark):
    texts = [None, "", " ", "short", CLEAN, CLEAN, MENU, NOISE, CLEAN.replace("word33", "verb33"), "long " * 120_000]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(4, CLEAN, "en", "s", 1), (None, CLEAN + " More.", None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_operators_on_hard_documents(spark):
    docs = hard_documents(spark)
    extra = docs.withColumns({c: F.lit("x") for c in ("n_tokens", "n_bytes", "ids", "decoded", "start", "kept", "copy")})
    n = docs.count()
    words, ranks = (public_tokenizers.path(p) for p in ("word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))
    for df in (docs, extra):
        counted = tokens.count_tokens(df, words)
        coded = bytebpe.decode(bytebpe.encode(df, ranks), ranks)
        packed = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"))
        judged = df.select("doc_id", rules.clean_lines(F.col("text")).alias("r"))
        assert (counted.count(), coded.count(), judged.count()) == (n, n, n)
        assert packed.agg(F.sum(F.octet_length("ids") / 4)).first()[0] == packed.groupBy("doc_id", "doc_tokens").agg(
            F.count_if(F.col("start") == 0).alias("times")
        ).agg(F.sum(F.col("doc_tokens") * F.col("times"))).first()[0]
        assert counted.where("doc_id = 0").first()[1:] == (0, 0)
        for out in (tokens.count_tokens(df.limit(0), words), bytebpe.encode(df.limit(0), ranks), packing.pack(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")), df.limit(0).select(rules.clean_lines(F.col("text")))):
            assert out.collect() == []


def test_stages_on_hard_documents(spark):
    docs = hard_documents(spark)
    columns = docs.columns
    ruled = corpus_pipeline.quality_rules(spark, docs, SF)
    assert ruled.columns == columns
    assert sorted(str(r["doc_id"]) for r in ruled.collect()) == ["4", "4", "5", "8", "None"]
    judged = corpus_pipeline.quality_classifier(spark, ruled, SF)
    assert judged.columns == columns and judged.count() == 5
    kept = corpus_pipeline.near_dedup(spark, judged, SF)
    assert kept.columns == columns
    assert {r["doc_id"] for r in kept.collect()} <= {4, None}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_the_rules_read_a_text_once(spark):
    docs = table(spark, SF, "documents")
    plan = corpus_pipeline.quality_rules(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # before: again below the filter


def test_one_row_of_each_class_stays(spark):
    words = [f"word{i}" for i in range(100)]
    a, near, other = " ".join(words), " ".join(words[:99] + ["x"]), "quite another text of more than five words"
    rows = [(4, a, "en", "s", 1)] * 30 + [(4, a, "de", "r", 2), (4, other, "en", "s", 1), (5, near, "en", "s", 1)]
    rows += [(None, near, "en", "s", 1), (None, a, "en", "s", 1), (7, "only here, with nothing like it", "en", "s", 1)]
    rows += [(None, "no id and twice", "en", "s", 1)] * 2 + [(9, None, "en", "s", 1), (9, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(
        [(4, a, "de", "r", 2), (4, other, "en", "s", 1), rows[35], rows[36], rows[38], rows[38]]
    )


def test_pipeline_equals_plain_stages(spark):
    docs = table(spark, SF, "documents")
    rows = [r.asDict() for r in docs.collect()]
    ruled = [r | {"text": rules.judge(r["text"]).clean_text} for r in rows if rules.judge(r["text"]).kept]
    frame = corpus_pipeline.quality_rules(spark, docs, SF)
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in frame.collect()} == {(r["doc_id"], r["text"], len(r["text"])) for r in ruled}
    judged = queries.quality_judged(frame, table(spark, SF, "labels")).collect()
    kept = {r["doc_id"]: r["text"] for r in judged if r["__posterior"] >= 0.5}
    classes = brute_classes(sorted(kept.items()))
    left = {i: t for i, t in kept.items() if classes[i] == i}
    packed = corpus_pipeline.run(spark, SF).collect()
    lengths = Counter()
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert lengths == {i: len(packing.token_ids(path, t)) for i, t in left.items()}
