"""Whole pipelines over tables that stand in for landed feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet import Items
from rivulet.plans import Context, Param, Pipeline
from workload.common import NOW, table

EVENTS, PURCHASES = "https://feeds.test/events", "https://feeds.test/purchases"


def _context(spark, sf) -> Context:
    """Tables as the items that each url gives."""
    events = table(spark, sf, "events")
    kind = F.col("event_type")
    entry = [
        F.concat(kind, F.lit(" "), "event_id").alias("title"),
        F.concat(F.lit("https://x.dev/"), "user_id").alias("link"),
        F.col("ts").alias("pubDate"),
        F.col("props").alias("description"),
    ]
    posts = Items.from_table(events.select("event_id", *entry), "event_id").transform(
        ["drop event_id"]
    )
    bought = events.where(kind == "purchase").select("event_id", *entry, F.col("value").alias("score"))
    purchases = Items.from_table(bought, "event_id").transform(["drop event_id"])
    found = {EVENTS: posts, PURCHASES: purchases}
    return Context(spark, NOW, found)


def _digest_pipeline() -> Pipeline:
    """Recent entries with a high score, merged with a second feed, newest first."""
    return (
        Pipeline("digest", params=(Param("min_score", "number", 60),))
        .add("fetch_feed", url=EVENTS)
        .add("filter", 1, rules=["pubDate > now - 2d"])
        .add("regex", 2, field="description", pattern=r'"k":\s*(?<score>\d+)', mode="extract")
        .add("filter", 3, rules=["score > ${min_score}"])
        .add("fetch_feed", url=PURCHASES)
        .add("union", 4, 5)
        .add("sort", 6, by="pubDate", order="desc")
        .add("output", 7, format="rss", destination="")
    )


def news_digest(spark, sf):
    run = _digest_pipeline().compose(_context(spark, sf))
    run.require_ok()
    return run.output.limit(25).positions()


def news_digest_all(spark, sf):
    """The same without the cut, every item in its place."""
    return _digest_pipeline().compose(_context(spark, sf), {"min_score": "90"}).output.positions()


def run_upto(spark, sf):
    """Only what feeds one node: the scored entries before the merge."""
    run = _digest_pipeline().compose(_context(spark, sf), upto=4)
    return run.items(4).to_df()


def node_counts(spark, sf):
    """Items per node, counted as they stream by in one run."""
    return _report(spark, _digest_pipeline().compose(_context(spark, sf), observe=True))


def _report(spark, run):
    rows = [(r["node"], r["kind"], r["status"], r["items"]) for r in run.report()]
    return spark.createDataFrame(rows, "node int, kind string, status string, items bigint")


def node_counts_failed(spark, sf):
    """One branch cannot be composed; the other runs, and so does what feeds the first."""
    pipeline = (
        Pipeline("half")
        .add("fetch_feed", url=EVENTS)
        .add("filter", 1, rules=["title ~ view"])
        .add("limit", 2, n=5)
        .add("fetch_feed", url=PURCHASES)
        .add("tail", 4, n=7)
        .add("output", 3)
    )
    return _report(spark, pipeline.compose(_context(spark, sf), observe=True))


def node_counts_empty(spark, sf):
    """Nodes that nothing passes, for a cut to nothing and for a field that is nowhere."""
    pipeline = (
        Pipeline("nothing")
        .add("fetch_feed", url=EVENTS)
        .add("limit", 1, n=0)
        .add("filter", 1, rules=["nowhere == x"])
        .add("union", 2, 3)
        .add("output", 4)
    )
    return _report(spark, pipeline.compose(_context(spark, sf), observe=True))


def node_counts_lazy(spark, sf):
    return _digest_pipeline().compose(_context(spark, sf)).counts()


REGIONS, NATIONS, SUPPLIERS = (
    "https://trade.test/regions.rss",
    "https://trade.test/nations.json",
    "https://trade.test/suppliers.csv",
)


def _landed(spark, sf):
    """One RSS, one JSON and one CSV document, as a fetcher would store them."""

    def lines(name, key, *parts):
        """A line of text for each row of a table, in key order."""
        line = F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])
        rows = table(spark, sf, name).agg(F.array_sort(F.collect_list(F.struct(key, line.alias("line")))).alias("rows"))
        return rows.select(F.col("rows.line").alias("lines"))

    region = lines("region", "r_regionkey", "<item><title>", "$r_name", "</title><guid>r", "$r_regionkey", "</guid></item>")
    nation = lines("nation", "n_nationkey", '{"key": ', "$n_nationkey", ', "label": "', "$n_name", '", "region": ', "$n_regionkey", "}")
    supplier = lines("supplier", "s_suppkey", "$s_suppkey", ",\"", "$s_name", "\",", "$s_nationkey", ",", "$s_acctbal")
    text = lambda url, head, df, by, foot: df.select(
        F.lit(url).alias("url"), F.concat(F.lit(head), F.array_join("lines", by), F.lit(foot)).alias("body")
    )
    return (
        text(REGIONS, '<rss version="2.0"><channel>', region, "", "</channel></rss>")
        .union(text(NATIONS, '{"nations": [', nation, ",", "]}"))
        .union(text(SUPPLIERS, "id,name,nation,balance\n", supplier, "\n", "\n"))
    )


def trade_review(spark, sf):
    """Every kind of node, over landed documents of three formats: regions last to first,
    nations of some regions, then the best supplier of each nation not named yet."""
    pipeline = (
        Pipeline("trade", params=(Param("least", "number", 0),))
        .add("fetch_csv", url=SUPPLIERS)
        .add("filter", 1, rules=["balance >= ${least}", "name contains supplier"])
        .add("sort", 2, by="balance", order="desc", compare="numeric")
        .add("regex", 3, field="name", mode="extract", pattern="#0*(?<number>[0-9]+)$")
        .add("transform", 4, ops=["copy nation guid", "rename number title", "drop id"])
        .add("fetch_json", url=NATIONS, path="$.nations[?(@.region > 1)]")
        .add("transform", 6, ops=["rename key guid", "rename label title", "drop region"])
        .add("fetch_feed", url=REGIONS)
        .add("reverse", 8)
        .add("union", 9, 7, 5)
        .add("unique", 10, by="guid")
        .add("tail", 11, n=21)
        .add("limit", 12, n=17)
        .add("output", 13, format="csv", destination="")
    )
    context = Context(spark, NOW, {})
    context.landed = _landed(spark, sf)
    run = pipeline.compose(context)
    run.require_ok()
    return run.output.to_typed("title string, guid string, name string, balance double").positions()


QUERIES = {
    f.__name__: f
    for f in (
        news_digest,
        news_digest_all,
        run_upto,
        node_counts,
        node_counts_failed,
        node_counts_empty,
        node_counts_lazy,
        trade_review,
    )
}

ENTRY = """e AS (
    SELECT event_id, event_type || ' ' || event_id AS title, 'https://x.dev/' || user_id AS link,
           ts AS "pubDate", props AS description,
           regexp_extract(props, '"k":\\s*([0-9]+)', 1) AS k, event_type, value FROM events)"""


def _digest(min_score: float) -> str:
    return f"""{ENTRY}, scored AS (
        SELECT 0 AS w, event_id, title, link, "pubDate", description, k AS score FROM e
        WHERE "pubDate" > TIMESTAMP '2024-01-29' AND CAST(k AS DOUBLE) > {min_score}),
    bought AS (
        SELECT 1 AS w, event_id, title, link, "pubDate", description,
               CAST(value AS VARCHAR) AS score
        FROM e WHERE event_type = 'purchase'),
    merged AS (SELECT * FROM scored UNION ALL SELECT * FROM bought),
    placed AS (
        SELECT row_number() OVER (ORDER BY epoch_ms("pubDate") DESC, w, event_id) AS pos,
               title, link, "pubDate", description, score
        FROM merged)"""


COUNTS = f"""WITH {_digest(60)}, counts AS (
    SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS node,
           unnest(['fetch_feed', 'filter', 'regex', 'filter', 'fetch_feed', 'union', 'sort',
                   'output']) AS kind,
           unnest([n1, n2, n2, n4, n5, n4 + n5, n4 + n5, n4 + n5]) AS items
    FROM (SELECT (SELECT count(*) FROM e) AS n1,
                 (SELECT count(*) FROM e WHERE "pubDate" > TIMESTAMP '2024-01-29') AS n2,
                 (SELECT count(*) FROM scored) AS n4, (SELECT count(*) FROM bought) AS n5))"""

ORACLE = {
    "news_digest": f"WITH {_digest(60)} SELECT * FROM placed WHERE pos <= 25",
    "news_digest_all": f"WITH {_digest(90)} SELECT * FROM placed",
    "run_upto": f"""
        WITH {_digest(60)} SELECT title, link, "pubDate", description, score FROM scored""",
    "node_counts": f"{COUNTS} SELECT node, kind, 'ok' AS status, items FROM counts",
    "node_counts_failed": """
        SELECT * FROM (VALUES
            (1, 'fetch_feed', 'ok', (SELECT count(*) FROM events)), (2, 'filter', 'failed', NULL),
            (3, 'limit', 'unready', NULL),
            (4, 'fetch_feed', 'ok', (SELECT count(*) FROM events WHERE event_type = 'purchase')),
            (5, 'tail', 'ok', (SELECT least(7, count(*)) FROM events WHERE event_type = 'purchase')),
            (6, 'output', 'unready', NULL)) AS t(node, kind, status, items)""",
    "node_counts_empty": """
        SELECT * FROM (VALUES
            (1, 'fetch_feed', 'ok', (SELECT count(*) FROM events)), (2, 'limit', 'ok', 0),
            (3, 'filter', 'ok', 0), (4, 'union', 'ok', 0), (5, 'output', 'ok', 0))
            AS t(node, kind, status, items)""",
    "node_counts_lazy": f"{COUNTS} SELECT node, kind, items FROM counts",
    "trade_review": """
        WITH merged AS (
            SELECT 0 AS w, CAST(-r_regionkey AS DOUBLE) AS a, 0 AS b, r_name AS title,
                   'r' || r_regionkey AS guid, CAST(NULL AS VARCHAR) AS name,
                   CAST(NULL AS DOUBLE) AS balance
            FROM region
            UNION ALL
            SELECT 1, n_nationkey, 0, n_name, CAST(n_nationkey AS VARCHAR), NULL, NULL
            FROM nation WHERE n_regionkey > 1
            UNION ALL
            SELECT 2, -s_acctbal, s_suppkey, regexp_extract(s_name, '#0*([0-9]+)$', 1),
                   CAST(s_nationkey AS VARCHAR), s_name, s_acctbal
            FROM supplier WHERE s_acctbal >= 0),
        firsts AS (
            SELECT *, row_number() OVER (ORDER BY w, a, b) AS place FROM (
                SELECT * FROM merged
                QUALIFY row_number() OVER (PARTITION BY guid ORDER BY w, a, b) = 1)),
        ends AS (SELECT * FROM firsts ORDER BY place DESC LIMIT 21)
        SELECT row_number() OVER (ORDER BY place) AS pos, title, guid, name, balance
        FROM ends QUALIFY pos <= 17""",
}
