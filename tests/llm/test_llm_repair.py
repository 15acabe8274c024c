"""Conversation repair against every edit script that costs least."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pyarrow.parquet as pq
import pytest

from rivulet.llm import queries, repair

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows: list[tuple[str, str]]) -> tuple:
    """(cost, audit, repaired) by dynamic programming over automaton states; rows: (role, fault)."""
    done = {"": 0, "s": 1, "u": 2, "a": 3}
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {("", 0): (0, "", ())}
    result = None
    # Costs are small: settle states in order of (cost, audit) like Dijkstra.
    seen = set()
    while best:
        key = min(best, key=lambda k: best[k][:2])
        cost, audit, out = best.pop(key)
        if key in seen:
            continue
        seen.add(key)
        state, i = key
        assert state in done
        if i == len(rows) and state in ("", "a"):
            if result is None or (cost, audit) < result[:2]:
                result = (cost, audit, out)
        moves = [("I", 5, step[(state, r)], i, (r, None)) for r in "ua" if (state, r) in step]
        if i < len(rows):
            role, fault = rows[i]
            moves.append(("D", 2, state, i + 1, None))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] and (state, role[:1]) in step:
                    moves.append(("K", more, step[(state, role[:1])], i + 1, (None, i)))
                moves += [("R", 1 + more, step[(state, r)], i + 1, (r, i)) for r in "ua" if (state, r) in step]
        for edit, price, to, at, said in moves:
            new = (cost + price, audit + edit, out + ((said,) if said else ()))
            if (to, at) not in seen and ((to, at) not in best or new[:2] < best[(to, at)][:2]):
                best[(to, at)] = new
    return result


def brute(rows: list[tuple]) -> dict:
    after, ids = defaultdict(list), []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        ids.append(conv)
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        after[conv] += [(turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    out = {}
    for conv in dict.fromkeys(ids):
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
        here = sorted(after[conv], key=key)
        faults, said = [], set()
        for _, role, text in here:
            written = BLANK.findall(text)
            fault = "blank" if not written else "duplicate" if (role, text) in said else ""
            faults.append(fault or ("truncated" if written[-1] not in ".!?" else ""))
            said.add((role, text))
        turns = {t for t, _, _ in here if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(here, here[1:]))
        cost, audit, said = cheapest([(r, f) for (_, r, _), f in zip(here, faults)])
        full = {"u": "user", "a": "assistant", None: None}
        lines = [f"{full[r] or here[i][1]}:{'' if i is None else here[i][2]}" for r, i in said]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out


@pytest.mark.parametrize("length", range(5))
def test_every_short_conversation(length):
    kinds = list(product("suax", ("", "truncated", "blank")))
    rng = random.Random(length)
    cases = list(product(kinds, repeat=length)) if length < 3 else [rng.choices(kinds, k=length) for _ in range(400)]
    place = {"": repair.FINE, "truncated": repair.CUT_OFF, "blank": repair.MUST_GO}
    for case in cases:
        codes = bytes(4 * place[f] + "suax".index(r) for r, f in case)
        assert repair.cheapest_edits(codes) == cheapest(list(case))[:2], case


@pytest.mark.parametrize("n", [63, 64, 65, 129, 500])
def test_long_conversations_cross_blocks(n):
    rng = random.Random(n)
    faults = ["", "", "", "truncated", "blank"]
    case = [(rng.choice("suax"), rng.choice(faults)) for _ in range(n)]
    place = {"": repair.FINE, "truncated": repair.CUT_OFF, "blank": repair.MUST_GO}
    codes = bytes(4 * place[f] + "suax".index(r) for r, f in case)
    assert repair.cheapest_edits(codes) == cheapest(case)[:2]


def test_query_equals_brute_force(spark):
    columns = ["conv_id", "turn", "role", "text"]
    rows = [tuple(r[c] for c in columns) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    found = {r[0]: tuple(r)[1:] for r in queries.op13_auction_repair(spark, SF).collect()}
    assert found == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(3)
    texts = ["Yes.", "no", "", None, " \t", "Why?  ", "Stop!", "é.", "ok. then"]
    roles = ["user", "assistant", "system", "", None, "tool", "umpire"]
    rows = [
        (rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts))
        for _ in range(150)
    ]
    rows += [(i, i, "user", "Alone.") for i in range(100, 160)]
    rows += rows[:20] + [(9, i, "user" if i % 2 else "assistant", "x" * 9000 + ".") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    clash = df.selectExpr("*", "1 AS key", "2 AS audit", "3 AS gone", "4 AS first")
    found = {r[0]: tuple(r)[1:] for r in repair.repair(repair.damaged(clash)).collect()}
    assert found == brute(rows)
    assert any(f == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for f in found.values())
    assert repair.repair(repair.damaged(df.limit(0))).collect() == []
