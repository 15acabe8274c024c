"""The grammar round trip."""

from __future__ import annotations

import hashlib

import pyarrow.parquet as pq
from hypothesis import given, settings, strategies as st

from rivulet.llm import chat, queries

SF = "/root/testdata/sf0.001"
FRAGMENTS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "/s>", "INST]", "a", "é", " ", "\n"]
content = st.lists(st.sampled_from(FRAGMENTS), max_size=12).map("".join)
roles = st.one_of(st.sampled_from(["user", "assistant", "system", ""]), content)
turns = st.lists(st.builds(chat.Turn, roles, content), min_size=1, max_size=5)


@settings(max_examples=600, deadline=None)
@given(turns)
def test_round_trip(own):
    rendered, spans = chat.format_turns(own)
    assert chat.parse(rendered) == own
    learned = [t.text for t in own if t.role == chat.LEARNED_ROLE]
    assert [chat.unescape(rendered[a:b]) for a, b in spans] == learned


@settings(max_examples=300, deadline=None)
@given(content)
def test_escape_is_reversible_and_disarms(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not chat._ARMED.search(chat.escape(text))


def test_harmless_text_is_left_alone():
    rendered, _ = chat.format_turns([chat.Turn("user", "a <b> [c] \\ d"), chat.Turn("assistant", "e")])
    assert rendered == "<s>[INST]a <b> [c] \\ d</s><s>[/INST]e</s>"


def test_text_that_breaks_the_grammar_is_no_conversation():
    for text in ("<s>", "<s>[INST]a", "a<s>[INST]b</s>", "<s>[INST]a</s>b", "<s>[INST]a[SYS]b</s>", "</s>"):
        assert chat.parse(text) is None


def expected(turns: list[tuple[str, str]]) -> tuple:
    whole = "".join(f"{role}\n{text}\n" for role, text in turns)
    learned = "".join(text for role, text in turns if role == "assistant")
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, learned)]
    return len(turns), digest[0], len(learned), digest[1]


def test_query(spark):
    source = {-1: [("user", queries.CONTROL_TEXT), ("assistant", queries.CONTROL_TEXT)]}
    for r in sorted(pq.read_table(f"{SF}/conversations.parquet").to_pylist(), key=lambda r: (r["conv_id"], r["turn"])):
        source.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    rows = queries.op2_grammar_round_trip(spark, SF).collect()
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}
    assert len(rows) == len(source)
    assert found == {c: expected(t) for c, t in source.items()}


def test_nulls_ties_and_other_columns(spark):
    rows = [
        (1, 0, None, "b", "x"),
        (1, 0, None, "b", "x"),
        (1, 0, None, "a", "x"),
        (1, None, "user", None, "x"),
        (None, 0, "tool", "t" * 300_000, "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert found[1]["turns_sha256"] == expected([("user", ""), ("", "a"), ("", "b"), ("", "b")])[1]
    assert found[None]["turns_sha256"] == expected([("tool", "t" * 300_000)])[1]
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []
