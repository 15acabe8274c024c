"""Filter modes, rule operators and rule values."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from rivulet import Items
from workload.common import NOW, items, labelled_documents, table


def filter_numeric(spark, sf):
    lines = items(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return lines.filter(["l_quantity > 45", "l_discount >= 0.05"]).to_df()


def filter_integer_bounds(spark, sf):
    parts = items(spark, sf, "part", "p_partkey", "p_size")
    return parts.filter(["p_size >= 24.5", "p_size != 30", "p_size < 40.5"]).to_df()


def filter_numeric_text(spark, sf):
    events = items(spark, sf, "events", "event_id", "props")
    found = events.regex("props", r'"k": (?P<k>\d+)', mode="extract")
    return found.filter(["k > 50"]).transform(["drop props"]).to_df()


def filter_any_block(spark, sf):
    orders = items(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    rules = ["o_orderstatus == F", "o_totalprice > 250000"]
    return orders.filter(rules, mode="block", match="any").to_df()


def filter_all_block(spark, sf):
    orders = items(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    rules = ["o_orderstatus == F", "o_totalprice > 250000"]
    return orders.filter(rules, mode="block", match="all").to_df()


def filter_any_permit(spark, sf):
    orders = items(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    rules = ["o_orderstatus == P", "o_totalprice <= 5000"]
    return orders.filter(rules, match="any").to_df()


def filter_missing_ne(spark, sf):
    return labelled_documents(spark, sf).filter(["quality != 1"]).to_df()


def filter_missing_block(spark, sf):
    return labelled_documents(spark, sf).filter(["quality == 1"], mode="block").to_df()


def filter_no_rules_block(spark, sf):
    return items(spark, sf, "supplier").filter([], mode="block").to_df()


def filter_contains(spark, sf):
    documents = items(spark, sf, "documents", "doc_id", "lang", "text")
    return documents.filter(["text contains The AND"]).transform(["drop text"]).to_df()


def filter_contains_number(spark, sf):
    orders = items(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return orders.filter(["o_totalprice contains 99.0"]).to_df()


def filter_matches(spark, sf):
    pages = items(spark, sf, "pages", "page_id", "url")
    return pages.filter([r"url matches ^https://(?P<sub>blog|m)\.\w+\.example\.(?:com|org)/"]).to_df()


def filter_text_order(spark, sf):
    parts = items(spark, sf, "part", "p_partkey", "p_brand")
    return parts.filter(['p_brand >= "Brand#2"', "p_brand < 'Brand#5'"]).to_df()


def filter_relative_date(spark, sf):
    events = items(spark, sf, "events", "event_id", "ts", "event_type")
    return events.filter(["item.ts > now - 2d"], now=NOW).to_df()


def filter_date_text(spark, sf):
    """The same kind of rule on dates that are text in the RSS form."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    stamp = F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss")
    posted = orders.select("o_orderkey", F.concat(stamp, F.lit(" EST")).alias("posted"))
    now = datetime(1998, 1, 1, tzinfo=timezone.utc)
    rules = ["posted >= now - 52w", "posted < now + 1.5d"]
    return Items.from_table(posted, "o_orderkey").filter(rules, now=now).to_df()


def filter_dynamic(spark, sf):
    """Rules over records without a schema, with a dotted path and a bool."""
    events = table(spark, sf, "events").select(
        "event_id",
        F.parse_json("props").alias("meta"),
        (F.col("event_type") == "error").alias("bad"),
    )
    dynamic = Items.from_table(events, "event_id").to_dynamic()
    kept = dynamic.filter(["meta.k >= 40", "bad != true", "bad contains FALSE"])
    return kept.filter(["bad > 0"], mode="block").to_typed("event_id bigint, bad string").to_df()


QUERIES = {
    f.__name__: f
    for f in (
        filter_numeric,
        filter_integer_bounds,
        filter_numeric_text,
        filter_any_block,
        filter_all_block,
        filter_any_permit,
        filter_missing_ne,
        filter_missing_block,
        filter_no_rules_block,
        filter_contains,
        filter_contains_number,
        filter_matches,
        filter_text_order,
        filter_relative_date,
        filter_date_text,
        filter_dynamic,
    )
}

ORACLE = {
    "filter_numeric": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
        WHERE l_quantity > 45 AND l_discount >= 0.05""",
    "filter_integer_bounds": """
        SELECT p_partkey, p_size FROM part
        WHERE p_size >= 24.5 AND p_size <> 30 AND p_size < 40.5""",
    "filter_numeric_text": """
        SELECT event_id, k FROM (
            SELECT event_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS k FROM events)
        WHERE try_cast(k AS DOUBLE) > 50""",
    "filter_any_block": """
        SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
        WHERE NOT (coalesce(o_orderstatus = 'F', false) OR coalesce(o_totalprice > 250000, false))""",
    "filter_all_block": """
        SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
        WHERE NOT (coalesce(o_orderstatus = 'F', false) AND coalesce(o_totalprice > 250000, false))""",
    "filter_any_permit": """
        SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
        WHERE o_orderstatus = 'P' OR o_totalprice <= 5000""",
    "filter_missing_ne": """
        SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)
        WHERE quality IS NOT NULL AND quality <> 1""",
    "filter_missing_block": """
        SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)
        WHERE quality IS NULL OR quality <> 1""",
    "filter_no_rules_block": "SELECT * FROM supplier",
    "filter_contains": """
        SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the and')""",
    "filter_contains_number": """
        SELECT o_orderkey, o_totalprice FROM orders
        WHERE contains(CAST(o_totalprice AS VARCHAR), '99')""",
    "filter_matches": r"""
        SELECT page_id, url FROM pages
        WHERE regexp_matches(url, '^https://(blog|m)\.[\pL\pN_]+\.example\.(com|org)/')""",
    "filter_text_order": """
        SELECT p_partkey, p_brand FROM part
        WHERE p_brand >= 'Brand#2' AND p_brand < 'Brand#5'""",
    "filter_relative_date": """
        SELECT event_id, ts, event_type FROM events WHERE ts > TIMESTAMP '2024-01-29 00:00:00'""",
    "filter_date_text": """
        SELECT o_orderkey, strftime(o_orderdate, '%a, %-d %b %Y %H:%M:%S') || ' EST' AS posted
        FROM orders
        WHERE o_orderdate + INTERVAL 5 HOUR >= TIMESTAMP '1998-01-01' - INTERVAL 364 DAY
          AND o_orderdate + INTERVAL 5 HOUR < TIMESTAMP '1998-01-02 12:00:00'""",
    "filter_dynamic": """
        SELECT event_id, 'false' AS bad FROM events
        WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 40 AND event_type <> 'error'""",
}
