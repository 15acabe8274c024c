"""The physical plans that make the steps scale."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from conftest import NOW, column
from rivulet import Items, union
from rivulet.operators import order
from workload import filters, ordering, pipes

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    text = plan(filters.filter_numeric(spark, SF))
    assert "GreaterThan(l_quantity,45.0)" in text
    assert "GreaterThanOrEqual(l_discount,0.05)" in text
    assert re.search(r"ReadSchema: struct<l_orderkey:\w+,l_linenumber:\w+,l_quantity:\w+,l_discount", text)
    assert "GreaterThan(p_size,24)" in plan(filters.filter_integer_bounds(spark, SF))
    text = plan(filters.filter_relative_date(spark, SF))
    assert "GreaterThan(ts,2024-01-29T00:00)" in text and "Exchange" not in text


def test_steps_that_need_no_shuffle(spark, make):
    records = make.typed([{"a": "1", "b": 2}], "a string, b bigint")
    merged = union([records.reverse(), records.transform(["rename a c"])])
    df = merged.regex("c", "x").filter(["b > 1"], now=NOW).sort("b").reverse().df
    assert "Exchange" not in plan(df) and "Python" not in plan(df)


def test_cuts_are_top_k(spark):
    df = Items.from_table(spark.range(100), "id").sort("id", "desc").limit(5).df
    assert "TakeOrderedAndProject(limit=5" in plan(df)
    assert "TakeOrderedAndProject(limit=5" in plan(Items.from_table(spark.range(9), "id").tail(5).df)


@pytest.mark.parametrize("n", [101, 1000])
def test_larger_cuts_never_meet_in_one_task(spark, monkeypatch, n):
    monkeypatch.setattr(order, "TOP_ROWS", 100)
    for cut in (Items.limit, Items.tail):
        items = cut(Items.from_table(spark.range(0, 9_000, 1, 6), "id"), n)
        text = plan(items.df)
        assert "TakeOrdered" not in text and "GlobalLimit" not in text
        # The rows themselves are filtered where they are read.
        assert "Exchange" not in text.split("Subquery")[0]
        want = range(n) if cut is Items.limit else range(9_000 - n, 9_000)
        assert column(items, "id") == list(want)


@pytest.mark.parametrize("n", [13, 38, 100])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_larger_cuts_with_ties_and_missing(spark, make, monkeypatch, n, direction):
    records = [{"a": (i * 7) % 5 if i % 3 else None, "b": i} for i in range(60)]
    typed = make.typed(records, "a bigint, b bigint").sort("a", direction)
    small = [column(typed.limit(n), "b"), column(typed.reverse().limit(n), "b"), column(typed.tail(n), "b")]
    monkeypatch.setattr(order, "TOP_ROWS", 0)
    assert [column(typed.limit(n), "b"), column(typed.reverse().limit(n), "b"), column(typed.tail(n), "b")] == small
    tied = Items.from_table(typed.to_df(), "a").limit(n)
    assert tied.df.count() == min(n, 60)


def test_unique_reads_its_input_once(spark):
    text = plan(ordering.unique_missing_kept(spark, SF))
    assert text.count("FileScan") == 2  # documents and labels
    assert text.count("Exchange hashpartitioning") == 1


def test_unique_keeps_one_row_per_task_and_key(spark):
    text = plan(ordering.unique_first(spark, SF))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_sort_mode_stays_in_the_plan(spark, make):
    items = make.typed([{"a": "1"}], "a string").sort("a")
    assert "Subquery" in plan(items.df)
    assert "Subquery" not in plan(make.typed([{"a": 1}], "a int").sort("a").df)


@pytest.mark.parametrize("name", sorted(pipes.QUERIES) + sorted(ordering.QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    text = plan((pipes.QUERIES | ordering.QUERIES)[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


# --- skew --------------------------------------------------------------------


def test_one_key_with_most_rows(spark):
    """A hot key, hot missing values and equal sort keys spread over tasks."""
    hot = F.when(F.col("id") % 3 != 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.col("id").cast("string"))
    df = spark.range(0, 60_000, 1, 6).select("id", hot.alias("k"))
    items = Items.from_table(df, "id")
    kept = column(items.unique("k"), "id")
    want = [i for i in range(60_000) if (i % 3 == 0) or i == 1]
    assert kept == want

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = items.sort("k").positions()
        sizes = placed.groupBy(F.spark_partition_id()).count().select(F.max("count")).first()[0]
        assert sizes < 30_000  # 40,000 rows share one key
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = [r["id"] for r in placed.orderBy("pos").collect()]
    def key(i):
        return (1, "", i) if i % 3 == 0 and i % 2 else (0, "hot" if i % 3 else str(i), i)

    assert got == sorted(range(60_000), key=key)
