"""Sort modes, cuts, reverse, union and unique.

The order is part of the result here, so it is shown as ``pos``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet import Items, union
from workload.common import items, labelled_documents, table


def _extracted(spark, sf):
    events = items(spark, sf, "events", "event_id", "user_id", "props")
    found = events.regex("props", r'"k": (?P<k>\d+)', mode="extract")
    return found.transform(["drop props"])


def sort_auto_numeric(spark, sf):
    return _extracted(spark, sf).sort("k").positions()


def sort_auto_date(spark, sf):
    """Three text forms of a date in one field."""
    ts = F.col("ts")
    rss = F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    posted = (
        F.when(F.col("event_type") == "view", rss)
        .when(F.col("event_type") == "click", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    events = events.select("event_id", posted.alias("posted"))
    return Items.from_table(events, "event_id").sort("posted", order="desc").positions()


def sort_auto_lexical(spark, sf):
    parts = items(spark, sf, "part", "p_partkey", "p_name")
    return parts.sort("p_name").positions()


def sort_numeric_strict(spark, sf):
    """Numeric on purpose: what is no number counts as missing and comes last."""
    brand = F.regexp_replace("p_brand", "^Brand#([0-9]+)$", "$1")
    mixed = F.when(F.col("p_size") > 10, brand).otherwise(F.col("p_brand"))
    parts = table(spark, sf, "part").select("p_partkey", mixed.alias("mixed"))
    return Items.from_table(parts, "p_partkey").sort("mixed", compare="numeric").positions()


def sort_missing_last_desc(spark, sf):
    return labelled_documents(spark, sf).sort("quality", order="desc").positions()


def sort_stable(spark, sf):
    """Ties keep the order of the sort before."""
    orders = items(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    by_price = orders.sort("o_totalprice", order="desc")
    return by_price.sort("o_orderpriority", compare="lexical").positions()


def limit_top(spark, sf):
    orders = items(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return orders.sort("o_totalprice", order="desc").limit(25).positions()


def limit_large(spark, sf):
    lines = items(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return lines.sort("l_extendedprice", order="desc").limit(20_000).positions()


def limit_middle(spark, sf):
    lines = items(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return lines.sort("l_extendedprice", order="desc").limit(500).positions()


def limit_zero(spark, sf):
    """Nothing of one table before all of another."""
    regions = items(spark, sf, "region", "r_regionkey").transform(["rename r_regionkey key"])
    nations = items(spark, sf, "nation", "n_nationkey").transform(["rename n_nationkey key"])
    return nations.limit(0).union(regions).positions()


def tail_large(spark, sf):
    lines = items(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return lines.sort("l_extendedprice").tail(20_000).positions()


def tail_last(spark, sf):
    orders = items(spark, sf, "orders", "o_orderkey", "o_orderdate")
    return orders.sort("o_orderdate").tail(40).positions()


def reverse_positions(spark, sf):
    return items(spark, sf, "nation").reverse().positions()


def reverse_missing(spark, sf):
    """Reversing puts the missing ones first."""
    return labelled_documents(spark, sf).sort("quality").reverse().positions()


def union_wires(spark, sf):
    customers = items(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey")
    suppliers = items(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey")
    first = customers.transform(["rename c_name name", "rename c_nationkey nation"])
    second = suppliers.transform(["rename s_name name", "rename s_nationkey nation"])
    return union([first, second.reverse(), first]).positions()


def union_type_clash(spark, sf):
    """One key, an integer in one stream and text in another."""
    parts = items(spark, sf, "part", "p_partkey", "p_size").transform(["rename p_size label"])
    nations = items(spark, sf, "nation", "n_nationkey", "n_name")
    merged = parts.union(nations.transform(["rename n_name label"]))
    return merged.unique("label").positions()


def union_dynamic(spark, sf):
    """The same merge without a schema: every value keeps its own type."""
    parts = items(spark, sf, "part", "p_partkey", "p_size").transform(["rename p_size label"])
    nations = items(spark, sf, "nation", "n_nationkey", "n_name")
    merged = parts.to_dynamic().union(nations.transform(["rename n_name label"]))
    kept = merged.filter(["label > 20"]).sort("label", order="desc")
    return kept.to_typed("p_partkey bigint, n_nationkey int, label string").positions()


def union_documents(spark, sf):
    """Long texts of two tables merged, copies dropped, first one kept."""
    documents = items(spark, sf, "documents", "doc_id", "text")
    benchmark = items(spark, sf, "benchmark", "item_id", "text")
    return benchmark.union(documents).unique("text").to_df()


def unique_first(spark, sf):
    events = items(spark, sf, "events", "event_id", "user_id", "event_type")
    return events.unique("user_id").to_df()


def unique_latest(spark, sf):
    """The last event per user: reversed, deduplicated, reversed back."""
    events = items(spark, sf, "events", "event_id", "user_id", "value")
    return events.reverse().unique("user_id").reverse().to_df()


def unique_text(spark, sf):
    return items(spark, sf, "documents", "doc_id", "text").unique("text").to_df()


def unique_missing_kept(spark, sf):
    return labelled_documents(spark, sf).unique("quality").to_df()


def unique_hot_key(spark, sf):
    """A few values hold all rows."""
    lines = items(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    return lines.unique("l_returnflag").positions()


QUERIES = {
    f.__name__: f
    for f in (
        sort_auto_numeric,
        sort_auto_date,
        sort_auto_lexical,
        sort_numeric_strict,
        sort_missing_last_desc,
        sort_stable,
        limit_top,
        limit_large,
        limit_middle,
        limit_zero,
        tail_large,
        tail_last,
        reverse_positions,
        reverse_missing,
        union_wires,
        union_type_clash,
        union_dynamic,
        union_documents,
        unique_first,
        unique_latest,
        unique_text,
        unique_missing_kept,
        unique_hot_key,
    )
}

ORACLE = {
    "sort_auto_numeric": """
        WITH e AS (SELECT event_id, user_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS k
                   FROM events)
        SELECT row_number() OVER (ORDER BY CAST(k AS DOUBLE), event_id) AS pos, * FROM e""",
    "sort_auto_date": """
        SELECT row_number() OVER (ORDER BY date_trunc('second', ts) DESC, event_id) AS pos, event_id,
               CASE event_type WHEN 'view' THEN strftime(ts, '%a, %-d %b %Y %H:%M:%S GMT')
                               WHEN 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                               ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS posted
        FROM events""",
    "sort_auto_lexical": """
        SELECT row_number() OVER (ORDER BY p_name, p_partkey) AS pos, p_partkey, p_name FROM part""",
    "sort_numeric_strict": """
        WITH p AS (SELECT p_partkey, CASE WHEN p_size > 10
                          THEN regexp_replace(p_brand, '^Brand#([0-9]+)$', '\\1')
                          ELSE p_brand END AS mixed FROM part)
        SELECT row_number() OVER (ORDER BY try_cast(mixed AS DOUBLE) NULLS LAST, p_partkey) AS pos, *
        FROM p""".replace("\\\\", "\\"),
    "sort_missing_last_desc": """
        SELECT row_number() OVER (ORDER BY quality DESC NULLS LAST, doc_id) AS pos, doc_id, quality
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "sort_stable": """
        SELECT row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS pos,
               o_orderkey, o_orderpriority, o_totalprice
        FROM orders""",
    "limit_top": """
        SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos,
               o_orderkey, o_totalprice
        FROM orders QUALIFY pos <= 25""",
    "limit_large": """
        SELECT row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS pos,
               l_orderkey, l_linenumber, l_extendedprice
        FROM lineitem QUALIFY pos <= 20000""",
    "limit_middle": """
        SELECT row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS pos,
               l_orderkey, l_linenumber, l_extendedprice
        FROM lineitem QUALIFY pos <= 500""",
    "limit_zero": """
        SELECT row_number() OVER (ORDER BY r_regionkey) AS pos, r_regionkey AS key FROM region""",
    "tail_large": """
        SELECT row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS pos,
               l_orderkey, l_linenumber, l_extendedprice
        FROM (SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey DESC,
                                             l_linenumber DESC LIMIT 20000)""",
    "tail_last": """
        SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos, o_orderkey, o_orderdate
        FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40)""",
    "reverse_positions": """
        SELECT row_number() OVER (ORDER BY n_nationkey DESC) AS pos, * FROM nation""",
    "reverse_missing": """
        SELECT row_number() OVER (ORDER BY quality DESC NULLS FIRST, doc_id DESC) AS pos,
               doc_id, quality
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "union_wires": """
        WITH c AS (SELECT 0 AS w, row_number() OVER (ORDER BY c_custkey) AS i, c_custkey,
                          CAST(NULL AS BIGINT) AS s_suppkey, c_name AS name, c_nationkey AS nation
                   FROM customer),
        s AS (SELECT 1 AS w, row_number() OVER (ORDER BY s_suppkey DESC) AS i, NULL AS c_custkey,
                     s_suppkey, s_name AS name, s_nationkey AS nation FROM supplier),
        u AS (SELECT * FROM c UNION ALL SELECT * FROM s
              UNION ALL SELECT 2, i, c_custkey, s_suppkey, name, nation FROM c)
        SELECT row_number() OVER (ORDER BY w, i) AS pos, c_custkey, s_suppkey, name, nation FROM u""",
    "union_type_clash": """
        WITH u AS (SELECT 0 AS w, p_partkey AS i, p_partkey, CAST(NULL AS INTEGER) AS n_nationkey,
                          CAST(p_size AS VARCHAR) AS label FROM part
                   UNION ALL SELECT 1, n_nationkey, NULL, n_nationkey, n_name FROM nation),
        f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY label ORDER BY w, i) = 1)
        SELECT row_number() OVER (ORDER BY w, i) AS pos, p_partkey, n_nationkey, label FROM f""",
    "union_dynamic": """
        SELECT row_number() OVER (ORDER BY p_size DESC, p_partkey) AS pos, p_partkey,
               CAST(NULL AS INTEGER) AS n_nationkey, CAST(p_size AS VARCHAR) AS label
        FROM part WHERE p_size > 20""",
    "union_documents": """
        WITH u AS (SELECT 0 AS w, item_id AS i, item_id, CAST(NULL AS BIGINT) AS doc_id, text
                   FROM benchmark
                   UNION ALL SELECT 1, doc_id, NULL, doc_id, text FROM documents)
        SELECT item_id, doc_id, text FROM u
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY w, i) = 1""",
    "unique_first": """
        SELECT event_id, user_id, event_type FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
    "unique_latest": """
        SELECT event_id, user_id, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "unique_text": """
        SELECT doc_id, text FROM documents
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "unique_missing_kept": """
        WITH d AS (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id))
        SELECT * FROM d
        QUALIFY quality IS NULL OR row_number() OVER (PARTITION BY quality ORDER BY doc_id) = 1""",
    "unique_hot_key": """
        WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem
                   QUALIFY row_number() OVER (PARTITION BY l_returnflag
                                              ORDER BY l_orderkey, l_linenumber) = 1)
        SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS pos, * FROM f""",
}
