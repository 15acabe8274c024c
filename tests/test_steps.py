from datetime import datetime

import pytest

from conftest import column, rows
from rivulet import Items, union

# Scores as numbers and as text, one of them missing, in no order at all.
MIXED = [
    {"title": f"n{i}", **({} if i == 5 else {"score": v if i % 2 else str(v)})}
    for i, v in enumerate([31, 4, 159, 26, 5, 35, 8, 97, 9, -3])
]
RANKED = sorted((m for m in MIXED if "score" in m), key=lambda m: float(m["score"]))


def both(make, records, schema):
    return [make.typed(records, schema), make.dynamic(records)]


# --- sort, cuts, reverse -----------------------------------------------------


def test_sort_auto_numeric_over_numbers_and_numeric_text(make):
    up = [m["title"] for m in RANKED]
    for items in both(make, MIXED, "title string, score string"):
        assert column(items.sort("score"), "title") == [*up, "n5"]
        assert column(items.sort("score", "desc"), "title") == [*up[::-1], "n5"]


def test_sort_auto_falls_back_to_bytes(make):
    words = [f"{c}{i % 3}{'é' * (i % 2)}" for i, c in enumerate("mZaQ9z_éA~0K")]
    for items in both(make, [{"w": w} for w in words], "w string"):
        assert column(items.sort("w"), "w") == sorted(words, key=str.encode)


def test_sort_auto_dates_in_mixed_forms(make):
    moments = [datetime(2023, 1 + i % 12, 1 + 5 * i % 27, i % 24) for i in range(0, 40, 3)]
    forms = ("%Y-%m-%dT%H:00:00Z", "%d %b %Y %H:00:00 +0000", "%Y-%m-%d %H:00:00")
    dates = [{"d": m.strftime(forms[i % 3]), "i": i} for i, m in enumerate(moments)]
    late_first = sorted(range(len(moments)), key=lambda i: (moments[i], -i), reverse=True)
    for items in both(make, dates, "d string, i bigint"):
        assert column(items.sort("d", "desc"), "i") == late_first


def test_sort_mode_counts_what_does_not_parse_as_missing(make):
    items = make.typed([{"x": "2"}, {"x": "ten"}, {"x": "1"}], "x string")
    assert column(items.sort("x", compare="numeric"), "x") == ["1", "2", "ten"]
    assert column(items.sort("x", "desc", compare="numeric"), "x") == ["2", "1", "ten"]
    assert column(items.sort("x", compare="lexical"), "x") == ["1", "2", "ten"]


def test_sort_is_stable_and_survives_dropping_its_key(make):
    records = [{"k": k, "i": i} for i, k in enumerate([2, 1, 2, 1, 2])]
    for items in both(make, records, "k bigint, i bigint"):
        ordered = items.sort("k").transform(["drop k"])
        assert column(ordered, "i") == [1, 3, 0, 2, 4]
        assert column(items.sort("k", "desc"), "i") == [0, 2, 4, 1, 3]
        assert column(items.sort("k").reverse(), "i") == [4, 2, 0, 3, 1]


def test_sort_missing_field_and_bad_arguments(make):
    items = make.typed(MIXED, "title string, score string")
    assert column(items.sort("nope"), "title") == [m["title"] for m in MIXED]
    for bad in ({"order": "up"}, {"compare": "smart"}):
        with pytest.raises(ValueError, match=f"`{next(iter(bad))}`"):
            items.sort("score", **bad)
    with pytest.raises(ValueError, match="`by`"):
        items.sort(None)


def test_cuts(make):
    letters = [{"l": c} for c in "abcd"]
    for items in both(make, letters, "l string"):
        assert column(items.limit(2), "l") == ["a", "b"]
        assert column(items.tail(2), "l") == ["c", "d"]
        assert column(items.limit(0), "l") == []
        assert column(items.tail(0), "l") == []
        assert column(items.limit(9), "l") == list("abcd")
        assert column(items.tail(9), "l") == list("abcd")
        assert column(items.reverse().limit(2).reverse(), "l") == ["c", "d"]
        assert column(items.limit(3).tail(2), "l") == ["b", "c"]
        assert column(items.tail(3).limit(1), "l") == ["b"]


@pytest.mark.parametrize("n", [None, -1, 1.5, "3", True])
def test_bad_cut(make, n):
    with pytest.raises(ValueError, match="`n`"):
        make.typed([{"l": "a"}], "l string").limit(n)


def test_cuts_of_every_size(spark):
    df = spark.range(3_000).selectExpr("id", "id % 7 AS k")
    items = Items.from_table(df, "id")
    want = sorted(range(3_000), key=lambda i: (i % 7, i))
    for n in (1, 99, 1_700):
        assert column(items.sort("k").limit(n), "id") == want[:n]
        assert column(items.sort("k").tail(n), "id") == want[-n:]
    same = Items.from_table(spark.range(300).selectExpr("id", "0 AS k"), "k").limit(250)
    assert len(set(column(same, "id"))) == 250
    numbered = items.sort("k", "desc").positions().orderBy("pos").collect()
    assert [r["pos"] for r in numbered] == list(range(1, 3_001))
    assert [r["id"] for r in numbered] == sorted(range(3_000), key=lambda i: (-(i % 7), i))
    few = items.sort("k").limit(30).positions().orderBy("pos").collect()
    assert [(r["pos"], r["id"]) for r in few] == list(enumerate(want[:30], 1))


@pytest.mark.parametrize("n", [10, 1_000, 1_001, 50_000])
def test_a_cut_is_one_lazy_top_k(spark, n):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    before = jobs()
    cut = Items.from_table(spark.range(90_000).toDF("id"), "id").sort("id", "desc").limit(n)
    plan = cut.df._jdf.queryExecution().executedPlan().toString()
    assert jobs() == before
    assert f"TakeOrderedAndProject(limit={n}," in plan and "rangepartitioning" not in plan


def test_checkpoint_keeps_items_and_order(make):
    items = make.typed(MIXED, "title string, score string").sort("score").checkpoint()
    assert column(items.reverse(), "title") == ["n5", *(m["title"] for m in RANKED[::-1])]


# --- unique ------------------------------------------------------------------


def test_unique_first_wins_and_missing_stay(make):
    # Every third record has no link, the others share seven.
    records = [{"t": f"r{i}", **({"u": f"x{i * i % 7}"} if i % 3 else {})} for i in range(30)]

    def firsts(rows):
        seen, out = set(), []
        for r in rows:
            if "u" not in r or r["u"] not in seen:
                seen |= {r["u"]} if "u" in r else set()
                out.append(r["t"])
        return out

    for items in both(make, records, "t string, u string"):
        assert column(items.unique("u"), "t") == firsts(records)
        assert column(items.reverse().unique("u").reverse(), "t") == firsts(records[::-1])[::-1]
        assert column(items.unique("nope"), "t") == [r["t"] for r in records]


def test_unique_goes_by_text(make):
    records = [{"v": 1}, {"v": "1"}, {"v": True}, {"v": "true"}, {"v": 1.5}, {"v": [1, 2]}, {"v": [1, 2]}]
    assert column(make.dynamic(records).unique("v"), "v") == [1, True, 1.5, [1, 2]]
    nulls = make.dynamic([{"v": None}, {"v": "null"}, {}])
    assert len(rows(nulls.unique("v"))) == 2


def test_unique_loses_nothing_where_places_repeat(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "x"), (1, "x"), (2, "x")], "p int, u string")
    got = Items.from_table(df, "p").unique("u").to_df().collect()
    assert sorted((r["p"], r["u"] or "") for r in got) == [(1, ""), (1, ""), (1, "x")]


# --- union -------------------------------------------------------------------


def test_union_keeps_wire_order_and_duplicates(make):
    first = make.typed([{"t": "b"}, {"t": "a"}], "t string")
    second = make.typed([{"t": "a", "n": 1}], "t string, n bigint")
    merged = union([first.reverse(), second, first])
    assert column(merged, "t") == ["a", "b", "a", "b", "a"]
    assert column(merged.reverse(), "t") == ["a", "b", "a", "b", "a"]
    assert column(union([merged, merged.reverse()]).tail(6), "t") == ["a", "a", "b", "a", "b", "a"]
    assert column(union([first]), "t") == ["b", "a"]
    with pytest.raises(ValueError, match="at least one"):
        union([])


def test_union_shares_order_columns_between_like_streams(make):
    streams = [make.typed([{"t": str(i)}], "t string") for i in range(6)]
    merged = union(streams + [streams[0].reverse()])
    assert len(merged.order) == 3  # stream number, ascending key, descending key
    assert column(merged, "t") == ["0", "1", "2", "3", "4", "5", "0"]


def test_union_of_clashing_types_meets_as_text(make):
    numbers = make.typed([{"x": 7, "d": 2.0}], "x int, d double")
    texts = make.typed([{"x": "seven", "d": 2}], "x string, d bigint")
    assert rows(numbers.union(texts)) == [{"x": "7", "d": "2.0"}, {"x": "seven", "d": "2"}]
    wide = make.typed([{"x": 2**40}], "x bigint")
    assert column(numbers.union(wide), "x") == [7, 2**40]


def test_union_with_dynamic_items_keeps_types(make):
    merged = make.dynamic([{"x": "seven"}]).union(make.typed([{"x": 7}, {}], "x int"))
    assert rows(merged) == [{"x": "seven"}, {"x": 7}, {}]


# --- transform ---------------------------------------------------------------


def test_transform_in_order(make):
    for items in both(make, [{"a": 1, "b": 2, "c": 3}], "a bigint, b bigint, c bigint"):
        got = items.transform(["rename a x", "copy b y", "drop c", "rename item.y item.z"])
        assert rows(got) == [{"x": 1, "b": 2, "z": 2}]


def test_transform_touches_only_items_with_the_field(make):
    records = [{"a": 1, "b": 5}, {"b": 6}, {"a": 3}]
    for items in both(make, records, "a bigint, b bigint"):
        assert rows(items.transform(["rename a b"])) == [{"b": 1}, {"b": 6}, {"b": 3}]
        assert column(items.transform(["copy a b"]), "b") == [1, 6, 3]
        assert rows(items.transform(["rename a a", "drop nope"])) == records
        assert rows(items.transform([])) == records


def test_transform_swap(make):
    for items in both(make, [{"a": 1, "b": 2}], "a bigint, b bigint"):
        assert rows(items.transform(["rename a t", "rename b a", "rename t b"])) == [{"a": 2, "b": 1}]


@pytest.mark.parametrize("op", ["explode a", "rename a", "drop", "copy a b c", "", 5])
def test_bad_transform(make, op):
    with pytest.raises(ValueError, match="op `"):
        make.typed([{"a": 1}], "a bigint").transform([op])


def test_fields_that_differ_in_case(make):
    items = make.typed([{"Name": "x"}], "Name string")
    assert rows(items.transform(["rename name other"])) == [{"Name": "x"}]
    with pytest.raises(ValueError, match="differ only in case"):
        items.transform(["copy Name name"])
    with pytest.raises(ValueError, match="differ only in case"):
        items.union(make.typed([{"name": "x"}], "name string"))
    with pytest.raises(ValueError, match="differ only in case"):
        items.regex("Name", "(?<name>x)", mode="extract")
    assert rows(make.dynamic([{"Name": "x"}]).transform(["copy Name name"])) == [
        {"Name": "x", "name": "x"}
    ]


def test_tables_need_an_order(spark):
    for order_by in ([], "nope", "id up"):
        with pytest.raises(ValueError, match="order_by"):
            Items.from_table(spark.range(3), order_by)
    with pytest.raises(ValueError, match="reserved"):
        Items.from_table(spark.range(3).withColumnRenamed("id", "__rv_0"), "__rv_0")
    assert column(Items.from_table(spark.range(3), "id desc"), "id") == [2, 1, 0]


# --- empty input -------------------------------------------------------------


def test_every_step_on_empty_input(make):
    for items in (make.typed([], "a string, d string"), make.dynamic([])):
        for step in (
            lambda i: i.filter(["a > 1"]),
            lambda i: i.regex("a", "x", replacement="y"),
            lambda i: i.regex("a", "(?<z>x)", mode="extract"),
            lambda i: i.transform(["rename a b"]),
            lambda i: i.sort("a"),
            lambda i: i.limit(3),
            lambda i: i.tail(3),
            lambda i: i.reverse(),
            lambda i: i.unique("a"),
            lambda i: i.union(i),
        ):
            assert rows(step(items)) == []
        assert items.positions().count() == 0
