"""Views of a field, paths, key profiles, fingerprints, transform and regex."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet import Items
from rivulet.functions.profile import content_hash, key_union
from workload.common import items, labelled_documents, table


def text_view(spark, sf):
    orders = items(spark, sf, "orders")
    fields = {c: orders.field(c).text.alias(c) for c in ("o_totalprice", "o_orderdate", "o_custkey")}
    return orders.df.select("o_orderkey", *fields.values())


def number_view(spark, sf):
    """The number view of every word of every document, summed per document."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    words = documents.select("doc_id", F.explode(F.split("text", r"[ \n]")).alias("word"))
    number = Items.from_table(words, "doc_id").field("word").number
    return words.groupBy("doc_id").agg(
        F.count("word").alias("words"),
        F.count(number).alias("numbers"),
        F.max(number).alias("largest"),
    )


def date_view(spark, sf):
    """Every accepted text form of each event's time, read back."""
    ts = F.col("ts")
    forms = {
        "rfc3339": F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("-03:30")),
        "rfc2822": F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" PST")),
        "naive": F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        "day": F.date_format(ts, "yyyy-MM-dd"),
        "none": F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(" noon")),
    }
    texts = table(spark, sf, "events").select("event_id", "ts").select(
        "event_id", *[form.alias(name) for name, form in forms.items()]
    )
    read = Items.from_table(texts, "event_id")
    views = [read.field(name).moment.cast("timestamp_ntz").alias(name) for name in forms]
    return read.df.select("event_id", *views)


def path_lookup(spark, sf):
    """Dotted paths into a nested object, through an array and to nowhere."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.struct(
            F.struct("l_quantity", "l_returnflag").alias("line"), F.array("l_tax").alias("taxes")
        ).alias("meta"),
    )
    nested = Items.from_table(lines, ["l_orderkey", "l_linenumber"])
    return nested.df.select(
        "l_orderkey",
        "l_linenumber",
        nested.field("item.meta.line.l_quantity").number.alias("quantity"),
        nested.field("meta.line.l_returnflag").text.alias("flag"),
        nested.field("meta.taxes.l_tax").text.alias("in_array"),
        nested.field("meta.line.nope").text.alias("nowhere"),
    )


def key_profile(spark, sf):
    """Which keys occur in records of several shapes."""
    events = table(spark, sf, "events").select("event_id", "event_type", "props")
    shaped = events.select(
        "event_id",
        F.when(F.col("event_type") == "error", F.col("event_type")).alias("failure"),
        F.when(F.col("event_type") == "purchase", F.col("props")).alias("basket"),
        F.lit(None).cast("string").alias("never"),
    )
    typed = Items.from_table(shaped, "event_id")
    return key_union(typed.to_dynamic())


def key_profile_typed(spark, sf):
    return key_union(labelled_documents(spark, sf, "lang", "source"))


def content_hashes(spark, sf):
    documents = items(spark, sf, "documents")
    return documents.df.select("doc_id", content_hash(documents).alias("hash"))


def transform_fields(spark, sf):
    customers = items(spark, sf, "customer")
    ops = ["rename c_name title", "copy c_acctbal score", "drop c_mktsegment", "drop nothing"]
    return customers.transform(ops + ["rename item.c_nationkey item.nation"]).to_df()


def transform_overwrite(spark, sf):
    """Renaming onto a field replaces it only where the old field is present."""
    documents = labelled_documents(spark, sf, "lang", "source", "n_chars")
    ops = ["copy quality n_chars", "rename quality source", "rename lang lang"]
    return documents.transform(ops).to_df()


def transform_dynamic(spark, sf):
    documents = labelled_documents(spark, sf, "lang", "source").to_dynamic()
    moved = documents.transform(["copy doc_id id", "rename quality source", "drop lang"])
    return moved.to_typed("doc_id bigint, id bigint, source string, lang string").to_df()


def regex_extract(spark, sf):
    events = items(spark, sf, "events", "event_id", "props")
    return events.regex("props", r'"k": (?<k>\d+)', mode="extract").to_df()


URL_PATTERN = (
    r"^(?P<scheme>https?)://(?P<host_name>[^/?#]+)(?P<path>/[^?#]*)?"
    r"(?:\?(?P<query>[^#]*))?(?:#(?P<part>.*))?$"
)


def regex_extract_optional(spark, sf):
    """Groups that took no part leave their field missing, not empty."""
    pages = items(spark, sf, "pages", "page_id", "url")
    return pages.regex("url", URL_PATTERN, mode="extract").to_df()


def regex_extract_over(spark, sf):
    """Extraction overwrites an existing field on matching items only."""
    pages = items(spark, sf, "pages", "page_id", "url")
    return pages.regex("url", r"^(?P<url>[^?#]+)[?#]", mode="extract").to_df()


def regex_extract_dynamic(spark, sf):
    pages = items(spark, sf, "pages", "page_id", "url").to_dynamic()
    found = pages.regex("url", r"\?(?:(?P<page>page=\d+)|(?P<other>.*))", mode="extract")
    return found.to_typed("page_id bigint, page string, other string").to_df()


def regex_replace(spark, sf):
    pages = items(spark, sf, "pages", "page_id", "url")
    return pages.regex("url", "^http://", replacement="https://").to_df()


def regex_replace_groups(spark, sf):
    documents = items(spark, sf, "documents", "doc_id", "text")
    pattern = r"(?P<first>[A-Za-z]+), (?P<second_word>[A-Za-z]+)"
    return documents.regex("text", pattern, replacement="${second_word} $first$$1").to_df()


def regex_replace_empty(spark, sf):
    """Empty matches count, except right behind another match."""
    parts = items(spark, sf, "part", "p_partkey", "p_name")
    return parts.regex("p_name", "(?i)[AL]*", replacement="-").to_df()


def regex_replace_number(spark, sf):
    """A rewritten number is text, also where nothing matched."""
    parts = items(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    return parts.regex("p_size", "^1", replacement="0").regex("p_retailprice", r"\.0$").to_df()


def regex_replace_nested(spark, sf):
    """A dotted field is rewritten where it is."""
    pages = table(spark, sf, "pages").select("page_id", F.struct("url").alias("meta"))
    nested = Items.from_table(pages, "page_id")
    return nested.regex("meta.url", r"[?#].*$").df.select("page_id", F.col("meta.url").alias("url"))


QUERIES = {
    f.__name__: f
    for f in (
        text_view,
        number_view,
        date_view,
        path_lookup,
        key_profile,
        key_profile_typed,
        content_hashes,
        transform_fields,
        transform_overwrite,
        transform_dynamic,
        regex_extract,
        regex_extract_optional,
        regex_extract_over,
        regex_extract_dynamic,
        regex_replace,
        regex_replace_groups,
        regex_replace_empty,
        regex_replace_number,
        regex_replace_nested,
    )
}

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

ORACLE = {
    "text_view": """
        SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS o_orderdate,
               CAST(o_custkey AS VARCHAR) AS o_custkey
        FROM orders""",
    "number_view": f"""
        WITH words AS (
            SELECT doc_id, unnest(string_split_regex(text, '[ \n]')) AS word FROM documents),
        numbers AS (
            SELECT doc_id, CASE WHEN regexp_matches(word, '{NUMBER}')
                                THEN try_cast(word AS DOUBLE) END AS number FROM words)
        SELECT doc_id, count(*) AS words, count(number) AS numbers, max(number) AS largest
        FROM numbers GROUP BY doc_id""",
    "date_view": """
        SELECT event_id, ts + INTERVAL 210 MINUTE AS rfc3339,
               date_trunc('second', ts) + INTERVAL 8 HOUR AS rfc2822,
               date_trunc('second', ts) AS naive,
               CAST(date_trunc('day', ts) AS TIMESTAMP) AS day,
               CAST(NULL AS TIMESTAMP) AS none
        FROM events""",
    "path_lookup": """
        SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_returnflag AS flag,
               CAST(NULL AS VARCHAR) AS in_array, CAST(NULL AS VARCHAR) AS nowhere
        FROM lineitem""",
    "key_profile": """
        SELECT 'event_id' AS key, count(*) AS items FROM events
        UNION ALL SELECT 'failure', count(*) FROM events WHERE event_type = 'error'
        UNION ALL SELECT 'basket', count(*) FROM events WHERE event_type = 'purchase'""",
    "key_profile_typed": """
        SELECT unnest(['doc_id', 'lang', 'source', 'quality']) AS key,
               unnest([count(doc_id), count(lang), count(source), count(quality)]) AS items
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "content_hashes": """
        SELECT doc_id, sha256(CAST(json_object(
            'doc_id', doc_id, 'lang', lang, 'n_chars', n_chars, 'source', source, 'text', text
        ) AS VARCHAR)) AS hash FROM documents""",
    "transform_fields": """
        SELECT c_custkey, c_name AS title, c_acctbal, c_acctbal AS score, c_nationkey AS nation
        FROM customer""",
    "transform_overwrite": """
        SELECT doc_id, lang, coalesce(CAST(quality AS VARCHAR), source) AS source,
               coalesce(CAST(quality AS BIGINT), n_chars) AS n_chars
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "transform_dynamic": """
        SELECT doc_id, doc_id AS id, coalesce(CAST(quality AS VARCHAR), source) AS source,
               CAST(NULL AS VARCHAR) AS lang
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "regex_extract": """
        SELECT event_id, props, regexp_extract(props, '"k": (?P<k>[0-9]+)', 1) AS k FROM events""",
    "regex_extract_optional": r"""
        SELECT page_id, url,
               regexp_extract(url, '^(https?)://', 1) AS scheme,
               regexp_extract(url, '^https?://([^/?#]+)', 1) AS host_name,
               nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '') AS path,
               CASE WHEN regexp_matches(url, '^[^#]*\?')
                    THEN regexp_extract(url, '^[^?]*\?([^#]*)', 1) END AS query,
               CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS part
        FROM pages""",
    "regex_extract_over": """
        SELECT page_id, CASE WHEN regexp_matches(url, '^[^?#]+[?#]')
                             THEN regexp_extract(url, '^[^?#]+') ELSE url END AS url
        FROM pages""",
    "regex_extract_dynamic": r"""
        SELECT page_id, nullif(regexp_extract(url, '\?(page=[0-9]+)', 1), '') AS page,
               CASE WHEN contains(url, '?') AND NOT regexp_matches(url, '\?page=[0-9]+')
                    THEN regexp_extract(url, '\?(.*)', 1) END AS other
        FROM pages""",
    "regex_replace": """
        SELECT page_id, regexp_replace(url, '^http://', 'https://', 'g') AS url FROM pages""",
    "regex_replace_groups": r"""
        SELECT doc_id, regexp_replace(text, '([A-Za-z]+), ([A-Za-z]+)', '\2 \1$1', 'g') AS text
        FROM documents""",
    "regex_replace_empty": """
        SELECT p_partkey, regexp_replace(p_name, '(?i)[AL]*', '-', 'g') AS p_name FROM part""",
    "regex_replace_number": r"""
        SELECT p_partkey, regexp_replace(CAST(p_size AS VARCHAR), '^1', '0', 'g') AS p_size,
               regexp_replace(CAST(p_retailprice AS VARCHAR), '\.0$', '', 'g') AS p_retailprice
        FROM part""",
    "regex_replace_nested": """
        SELECT page_id, regexp_replace(url, '[?#].*$', '', 'g') AS url FROM pages""",
}
