"""Cards, emitted text and parsed bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet import Items
from rivulet.functions.cards import age_label, cards, feed_summary, snippet, url_domain
from rivulet.sinks import document_parts, fragment
from rivulet.sources import (
    csv_items,
    feed_items,
    json_items,
    parse_csv_bodies,
    parse_feed_bodies,
    parse_json_bodies,
)
from workload.common import NOW, items, table


def url_domains(spark, sf):
    pages = table(spark, sf, "pages")
    # With a user, a port and no scheme as well.
    bare = F.regexp_replace("url", "^https?://([^/?#]+)", "me@$1:8443")
    return pages.select(
        "page_id", url_domain(F.col("url")).alias("domain"), url_domain(bare).alias("bare")
    )


def page_snippet(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return pages.select("page_id", snippet(F.col("html")).alias("snippet"))


def age_labels(spark, sf):
    events = table(spark, sf, "events")
    now = F.lit("2024-01-30 12:00:00+00:00").cast("timestamp")
    return events.select("event_id", age_label(F.col("ts").cast("timestamp"), now).alias("age"))


def _page_items(spark, sf) -> Items:
    pages = Items.from_table(table(spark, sf, "pages"), "page_id")
    return pages.transform(["rename url link", "rename html description", "copy link guid"])


def item_cards(spark, sf):
    """Titles are missing, dates and links present on some of the cards."""
    pages = _page_items(spark, sf)
    events = items(spark, sf, "events", "event_id", "event_type", "ts")
    dated = events.transform(["rename event_type title", "rename ts pubDate"])
    return cards(pages.union(dated), NOW).to_df()


def feed_summaries(spark, sf):
    return feed_summary(items(spark, sf, "documents"), "All documents", "atom", now=NOW)


def _posts(spark, sf) -> Items:
    """Events with the keys of a feed entry, on part of them each."""
    kind = F.col("event_type")
    posts = table(spark, sf, "events").select(
        "event_id",
        kind.alias("title"),
        F.when(kind != "error", F.concat(F.lit("https://x.dev/?a=1&b="), "event_id")).alias("link"),
        F.when(kind == "click", F.col("props")).alias("description"),
        F.when(kind == "view", F.concat(F.lit("g-"), "event_id")).alias("guid"),
        F.when(kind == "signup", F.concat(F.lit("User <"), "user_id", F.lit(">"))).alias("author"),
        F.when(kind != "purchase", F.col("ts").cast("timestamp_ntz")).alias("pubDate"),
    )
    return Items.from_table(posts, "event_id")


def emit_json_rows(spark, sf):
    documents = items(spark, sf, "documents")
    return documents.df.select("doc_id", fragment(documents, "json").alias("line"))


def emit_json_numbers(spark, sf):
    orders = items(spark, sf, "orders")
    return orders.df.select("o_orderkey", fragment(orders, "json").alias("line"))


def emit_json_dynamic(spark, sf):
    posts = _posts(spark, sf).to_dynamic()
    return posts.df.select(fragment(posts, "json").alias("line"))


def emit_csv_rows(spark, sf):
    documents = items(spark, sf, "documents")
    keys = sorted(documents.columns)
    return documents.df.select("doc_id", fragment(documents, "csv", keys).alias("line"))


def emit_rss_fragments(spark, sf):
    posts = _posts(spark, sf)
    return posts.df.select("event_id", fragment(posts, "rss").alias("line"))


def emit_rss_pages(spark, sf):
    """Whole pages as descriptions."""
    pages = _page_items(spark, sf)
    return pages.df.select("page_id", fragment(pages, "rss").alias("line"))


def emit_atom_fragments(spark, sf):
    posts = _posts(spark, sf)
    return posts.df.select("event_id", fragment(posts, "atom").alias("line"))


def atom_document(spark, sf):
    """A whole document in order, with the head that dates it."""
    return document_parts(_posts(spark, sf), "atom", "All events").positions()


def csv_document(spark, sf):
    return document_parts(_posts(spark, sf), "csv").positions()


def json_document(spark, sf):
    return document_parts(_posts(spark, sf), "json").positions()


def _rss_bodies(spark, sf):
    """Every page as an RSS document of its own."""
    pages = _page_items(spark, sf)
    head, foot = '<?xml version="1.0"?><rss version="2.0"><channel>', "</channel></rss>"
    body = F.concat(F.lit(head), fragment(pages, "rss"), F.lit(foot))
    return pages.df.select(F.col("page_id").cast("string").alias("url"), body.alias("body"))


def feed_bodies_rss(spark, sf):
    return feed_items(_rss_bodies(spark, sf)).to_df()


def feed_bodies_atom(spark, sf):
    posts = _posts(spark, sf)
    head = '<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>'
    body = F.concat(F.lit(head), fragment(posts, "atom"), F.lit("</feed>"))
    bodies = posts.df.select(F.col("event_id").cast("string").alias("url"), body.alias("body"))
    return feed_items(bodies).to_df()


def _stamp_text():
    """A moment as a feed may write it, with its fraction."""
    return F.date_format(F.col("pubDate"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def feed_bodies_rdf(spark, sf):
    """RSS 1.0: items beside the channel, named by rdf:about, dated and signed by dc."""
    posts = _posts(spark, sf).df
    link = F.coalesce(F.concat(F.lit("<link>"), F.replace("link", F.lit("&"), F.lit("&amp;")), F.lit("</link>")), F.lit(""))
    date = F.coalesce(F.concat(F.lit("<dc:date>"), _stamp_text(), F.lit("</dc:date>")), F.lit(""))
    body = F.concat(
        F.lit('<?xml version="1.0"?><rdf:RDF><channel/><item rdf:about="'), F.col("event_id"), F.lit('"><title>'), F.col("title"),
        F.lit("</title>"), link, F.lit("<content:encoded>long "), F.col("title"), F.lit("</content:encoded>"), date,
        F.lit("<dc:creator>someone</dc:creator></item></rdf:RDF>"),
    )
    return feed_items(posts.select(F.col("event_id").cast("string").alias("url"), body.alias("body"))).to_df()


def feed_bodies_json(spark, sf):
    """JSON Feed, with a byte-order mark in front."""
    posts = _posts(spark, sf).df
    entry = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.col("link").alias("url"),
        "title",
        F.col("description").alias("summary"),
        F.concat(F.lit("long "), "title").alias("content_html"),
        _stamp_text().alias("date_published"),
        F.array(F.struct(F.col("author").alias("name"))).alias("authors"),
    )
    feed = F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.array(entry).alias("items"))
    body = F.concat(F.lit("\ufeff"), F.to_json(feed))
    return feed_items(posts.select(F.col("event_id").cast("string").alias("url"), body.alias("body"))).to_df()


def feed_bodies_rejected(spark, sf):
    """Pages are no feeds: all of them are set aside, none is lost."""
    bodies = table(spark, sf, "pages").select("url", F.col("html").alias("body"))
    parsed = parse_feed_bodies(bodies.unionByName(_rss_bodies(spark, sf)))
    return parsed.rejects


def json_bodies(spark, sf):
    """The array a path lands on gives its elements."""
    turns = table(spark, sf, "conversations")
    post = F.struct("role", "text", "turn")
    echo = F.struct(F.lit("echo").alias("role"), F.col("role").alias("text"), "turn")
    body = F.to_json(F.struct(F.struct(F.array(post, echo).alias("posts")).alias("data")))
    bodies = turns.select(F.concat_ws("/", "conv_id", "turn").alias("url"), body.alias("body"))
    return json_items(bodies, "$.data.posts").to_typed("role string, text string, turn bigint").to_df()


def json_bodies_filter(spark, sf):
    """A filter in the path gives each match."""
    turns = table(spark, sf, "conversations")
    post = F.struct("role", "text", "turn")
    later = F.struct("role", F.lit("later").alias("text"), (F.col("turn") + 10).alias("turn"))
    body = F.to_json(F.struct(F.array(post, later).alias("posts")))
    bodies = turns.select(F.concat_ws("/", "conv_id", "turn").alias("url"), body.alias("body"))
    found = json_items(bodies, "$.posts[?(@.turn > 1)]")
    return found.to_typed("role string, text string, turn bigint").to_df()


def _turn_bodies(spark, sf):
    """Two posts and a count in each document."""
    turns = table(spark, sf, "conversations")
    later = F.struct(F.lit("later").alias("role"), "text", (F.col("turn") + 10).alias("turn"))
    posts = F.array(F.struct("role", "text", "turn"), later).alias("posts")
    meta = F.struct((F.col("turn") + 100).alias("turn")).alias("meta")
    return turns.select(F.concat_ws("/", "conv_id", "turn").alias("url"), F.to_json(F.struct(posts, meta)).alias("body"))


def json_path_slice(spark, sf):
    found = json_items(_turn_bodies(spark, sf), "$.posts[-1:]")
    return found.to_typed("role string, text string, turn bigint").to_df()


def json_path_union(spark, sf):
    return json_items(_turn_bodies(spark, sf), "$.posts[0]['text', 'role']").to_typed("value string").to_df()


def json_path_descent(spark, sf):
    return json_items(_turn_bodies(spark, sf), "$..turn").to_typed("value bigint").to_df()


def json_path_tests(spark, sf):
    path = "$.posts[?@.turn > 2 && !(@.turn == 11 || @.role == 'user')]"
    return json_items(_turn_bodies(spark, sf), path).to_typed("role string, turn bigint").to_df()


def json_path_deep(spark, sf):
    """A turn in a document that nests it more than 40 deep."""
    turns = table(spark, sf, "conversations")
    depth = (F.col("turn") + 40).cast("int")
    leaf = F.to_json(F.struct("role", "turn"))
    body = F.concat(F.expr("repeat('{\"in\":[', turn + 40)"), leaf, F.repeat(F.lit("]}"), depth))
    bodies = turns.select(F.concat_ws("/", "conv_id", "turn").alias("url"), body.alias("body"))
    return json_items(bodies, "$..[?@.role]").to_typed("role string, turn bigint").to_df()


def _posts_where(spark, sf, test):
    return json_items(_turn_bodies(spark, sf), f"$.posts[?{test}]").to_typed("role string, turn bigint").to_df()


def json_path_length(spark, sf):
    return _posts_where(spark, sf, "length(@.role) > 4 && length(@) == 3")


def json_path_count(spark, sf):
    return _posts_where(spark, sf, "count(@.*) == count($.posts[0].*) && count($..turn) == 3")


def json_path_value(spark, sf):
    return _posts_where(spark, sf, "value($.meta.*) > 102 && value(@..role) == 'later'")


def json_path_match(spark, sf):
    return _posts_where(spark, sf, r"match(@.role, '[a-z]+er') && !match(@.text, '.*')")


def json_path_search(spark, sf):
    return _posts_where(spark, sf, r"search(@.text, '[0-9]|\\bthe\\b')")


def json_path_across(spark, sf):
    """Posts that the first one of their document comes before."""
    return _posts_where(spark, sf, "@.turn > $.posts[0].turn && $.meta.turn > @.turn")


def json_scalars(spark, sf):
    """Elements that are no objects are kept under ``value``; counted by word."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    body = F.to_json(F.struct(F.split("text", " ").alias("words")))
    bodies = documents.select(F.col("doc_id").cast("string").alias("url"), body.alias("body"))
    words = json_items(bodies, "$['words'][*]").to_typed("value string").to_df()
    return words.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def json_rejected(spark, sf):
    events = table(spark, sf, "events")
    cut = F.when(F.col("event_type") == "error", F.substring("props", 2, 99)).otherwise(F.col("props"))
    bodies = events.select(F.col("event_id").cast("string").alias("url"), cut.alias("body"))
    return parse_json_bodies(bodies).rejects


def csv_bodies(spark, sf):
    """Every document as a CSV document of its own, texts with line breaks,
    commas and quotes included."""
    narrow = table(spark, sf, "documents").select("doc_id", "lang", "text")
    documents = Items.from_table(narrow, "doc_id")
    record = fragment(documents, "csv", ["doc_id", "lang", "text"])
    body = F.concat(F.lit("doc_id,lang,text\n"), record, F.lit("\n"))
    bodies = documents.df.select(F.col("doc_id").cast("string").alias("url"), body.alias("body"))
    return csv_items(bodies).to_typed("doc_id string, lang string, text string").to_df()


def csv_rejected(spark, sf):
    """Bodies with a row of another length are set aside, the others are not."""
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    row = F.when(F.col("lang") == "en", "1,2").otherwise("1,2,3")
    body = F.concat(F.lit('a,"b ""c"""\n'), row, F.lit("\n"))
    bodies = documents.select(F.col("doc_id").cast("string").alias("url"), body.alias("body"))
    return parse_csv_bodies(bodies).rejects


def csv_long_cell(spark, sf):
    """Cells of hundreds of thousands of characters with thousands of quotes."""
    cell = F.repeat(F.concat(F.col("text"), F.lit(' ""')), F.lit(2_000))
    body = F.concat(F.lit('id,cell\n'), F.col("item_id"), F.lit(',"'), cell, F.lit('"\n'))
    bodies = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("url"), body.alias("body"))
    return csv_items(bodies).to_typed("id string, cell string").to_df()


QUERIES = {
    f.__name__: f
    for f in (
        url_domains,
        page_snippet,
        age_labels,
        item_cards,
        feed_summaries,
        emit_json_rows,
        emit_json_numbers,
        emit_json_dynamic,
        emit_csv_rows,
        emit_rss_fragments,
        emit_rss_pages,
        emit_atom_fragments,
        atom_document,
        csv_document,
        json_document,
        feed_bodies_rss,
        feed_bodies_atom,
        feed_bodies_rdf,
        feed_bodies_json,
        feed_bodies_rejected,
        json_bodies,
        json_bodies_filter,
        json_path_slice,
        json_path_union,
        json_path_descent,
        json_path_tests,
        json_path_deep,
        json_path_length,
        json_path_count,
        json_path_value,
        json_path_match,
        json_path_search,
        json_path_across,
        json_scalars,
        json_rejected,
        csv_bodies,
        csv_rejected,
        csv_long_cell,
    )
}


def _domain(url: str) -> str:
    host = f"regexp_extract({url}, '^(?:[^\\n]*?://)?([^/?#]*)', 1)"
    return f"regexp_replace(regexp_replace({host}, '^.*@', ''), ':.*$', '')"


def _snippet(html: str) -> str:
    stripped = (
        f"regexp_replace(regexp_replace({html}, '<[^>]*>', ' ', 'g'), '<[^>]*$', '')"
    )
    names = [("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " ")]
    cases = " ".join(
        f"WHEN starts_with(p, '{n};') THEN '{c}' || substr(p, {len(n) + 2})" for n, c in names
    )
    # No numeric entity occurs in the pages; the query would raise on one.
    decoded = (
        f"list_aggregate(list_transform(string_split({stripped}, '&'), lambda p, i: CASE "
        f"WHEN i = 1 THEN p {cases} "
        r"WHEN regexp_matches(p, '^#(\+?[0-9]+|[xX]\+?[0-9a-fA-F]+);') THEN error('numeric entity') "
        "ELSE '&' || p END), 'string_agg', '')"
    )
    space = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return f"trim(regexp_replace({decoded}, '{space}', ' ', 'g'))"


AGE = """CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago'
              WHEN s < 86400 THEN (s // 3600) || 'h ago'
              WHEN s < 604800 THEN (s // 86400) || 'd ago'
              ELSE (s // 604800) || 'w ago' END"""


def _age(ts: str, now: str) -> str:
    """Whole seconds between the two, floored towards zero."""
    seconds = f"trunc(date_diff('microsecond', {ts}, TIMESTAMP '{now}') / 1000000)::BIGINT"
    return AGE.replace("s <", f"{seconds} <").replace("(s ", f"({seconds} ")


def _xml(text: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = f"replace({text}, '{char}', '{entity}')"
    return f"replace({text}, '''', '&apos;')"


POSTS = """posts AS (
    SELECT event_id, event_type AS title,
           CASE WHEN event_type <> 'error' THEN 'https://x.dev/?a=1&b=' || event_id END AS link,
           CASE WHEN event_type = 'click' THEN props END AS description,
           CASE WHEN event_type = 'view' THEN 'g-' || event_id END AS guid,
           CASE WHEN event_type = 'signup' THEN 'User <' || user_id || '>' END AS author,
           CASE WHEN event_type <> 'purchase' THEN ts END AS stamp
    FROM events)"""

RSS_LINE = f"""concat_ws(chr(10), '    <item>',
    '      <title>' || {_xml('title')} || '</title>',
    '      <link>' || {_xml('link')} || '</link>',
    '      <description><![CDATA[' || replace(description, ']]>', ']]]]><![CDATA[>')
        || ']]></description>',
    '      <author>' || {_xml('author')} || '</author>',
    '      <guid isPermaLink="false">' || {_xml('guid')} || '</guid>',
    '      <pubDate>' || strftime(stamp, '%a, %-d %b %Y %H:%M:%S +0000') || '</pubDate>',
    '    </item>')"""

# The fraction of a second shows as far as it is needed, to three or six digits.
MOMENT = """strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE
    WHEN strftime({0}, '%f') = '000000' THEN ''
    WHEN strftime({0}, '%f') LIKE '%000' THEN '.' || left(strftime({0}, '%f'), 3)
    ELSE '.' || strftime({0}, '%f') END || '+00:00'"""
STAMP = f"coalesce({MOMENT}, '1970-01-01T00:00:00+00:00')"

ATOM_LINE = f"""concat_ws(chr(10), '  <entry>',
    '    <title>' || {_xml("coalesce(title, '')")} || '</title>',
    '    <id>' || {_xml("coalesce(guid, link, '')")} || '</id>',
    '    <updated>' || {STAMP.format('stamp')} || '</updated>',
    '    <author>' || chr(10) || '      <name>' || {_xml('author')} || '</name>'
        || chr(10) || '    </author>',
    '    <link href="' || {_xml('link')} || '" rel="alternate"/>',
    '    <summary>' || {_xml('description')} || '</summary>',
    '  </entry>')"""


def _cell(text: str) -> str:
    quoted = f"""'"' || replace({text}, '"', '""') || '"'"""
    special = f"""regexp_matches({text}, '[",\\n\\r]')"""
    return f"coalesce(CASE WHEN {special} THEN {quoted} ELSE {text} END, '')"


NO_TEXT = "CAST(NULL AS VARCHAR)"

ORACLE = {
    "url_domains": f"""
        SELECT page_id, {_domain('url')} AS domain,
               {_domain("regexp_replace(url, '^https?://([^/?#]+)', 'me@' || chr(92) || '1:8443')")}
                   AS bare
        FROM pages""".replace("'me@' || chr(92) || '1:8443'", r"'me@\1:8443'"),
    "page_snippet": f"SELECT page_id, {_snippet('html')} AS snippet FROM pages",
    "age_labels": f"""
        SELECT event_id, {_age('ts', '2024-01-30 12:00:00')} AS age FROM events""",
    "item_cards": f"""
        SELECT '(untitled)' AS title, {_domain('url')} AS domain, '' AS age,
               {_snippet('html')} AS snippet
        FROM pages
        UNION ALL
        SELECT event_type, '', {_age('ts', '2024-01-31')}, '' FROM events""",
    "feed_summaries": """
        SELECT 'All documents' AS title, 'Generated by rivulet' AS description, 'atom' AS format,
               count(*) AS items, '00:00' AS updated
        FROM documents""",
    "emit_json_rows": """
        SELECT doc_id, CAST(json_object('doc_id', doc_id, 'lang', lang, 'n_chars', n_chars,
                                        'source', source, 'text', text) AS VARCHAR) AS line
        FROM documents""",
    "emit_json_numbers": """
        SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderdate":"'
               || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') || '","o_orderkey":' || o_orderkey
               || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus
               || '","o_totalprice":' || o_totalprice || '}' AS line
        FROM orders""",
    "emit_json_dynamic": f"""
        WITH {POSTS}
        SELECT '{{' || concat_ws(',', '"author":' || to_json(author),
               '"description":' || to_json(description), '"event_id":' || event_id,
               '"guid":' || to_json(guid), '"link":' || to_json(link),
               '"pubDate":"' || {MOMENT.format('stamp')} || '"',
               '"title":' || to_json(title)) || '}}' AS line
        FROM posts""",
    "emit_csv_rows": f"""
        SELECT doc_id, concat_ws(',', doc_id, {_cell('lang')}, n_chars, {_cell('source')},
                                 {_cell('text')}) AS line
        FROM documents""",
    "emit_rss_fragments": f"WITH {POSTS} SELECT event_id, {RSS_LINE} AS line FROM posts",
    "emit_rss_pages": f"""
        WITH posts AS (SELECT page_id, {NO_TEXT} AS title, url AS link, html AS description,
                              url AS guid, {NO_TEXT} AS author, CAST(NULL AS TIMESTAMP) AS stamp
                       FROM pages)
        SELECT page_id, {RSS_LINE} AS line FROM posts""",
    "emit_atom_fragments": f"WITH {POSTS} SELECT event_id, {ATOM_LINE} AS line FROM posts",
    "atom_document": f"""
        WITH {POSTS}, parts AS (
            SELECT 0 AS part, 0 AS event_id, '<?xml version="1.0"?>' || chr(10)
                   || '<feed xmlns="http://www.w3.org/2005/Atom">' || chr(10)
                   || '  <title>All events</title>' || chr(10) || '  <id>All events</id>' || chr(10)
                   || '  <updated>' || {STAMP.format('max(stamp)')} || '</updated>' AS text
            FROM posts
            UNION ALL SELECT 1, event_id, {ATOM_LINE} FROM posts
            UNION ALL SELECT 2, 0, '</feed>')
        SELECT row_number() OVER (ORDER BY part, event_id) AS pos, text FROM parts""",
    "csv_document": f"""
        WITH {POSTS}, parts AS (
            SELECT 0 AS part, 0 AS event_id,
                   'author,description,event_id,guid,link,pubDate,title' AS text
            UNION ALL
            SELECT 1, event_id, concat_ws(',', {_cell('author')}, {_cell('description')}, event_id,
                   {_cell('guid')}, {_cell('link')},
                   coalesce({MOMENT.format('stamp')}, ''), {_cell('title')})
            FROM posts)
        SELECT row_number() OVER (ORDER BY part, event_id) AS pos, text FROM parts""",
    "json_document": f"""
        WITH {POSTS}, lines AS (
            SELECT event_id, event_id = max(event_id) OVER () AS last,
                   event_id = min(event_id) OVER () AS first,
                   '  {{' || chr(10) || '    ' || concat_ws(',' || chr(10) || '    ',
                       '"author": ' || to_json(author), '"description": ' || to_json(description),
                       '"event_id": ' || event_id, '"guid": ' || to_json(guid),
                       '"link": ' || to_json(link),
                       '"pubDate": "' || {MOMENT.format('stamp')} || '"',
                       '"title": ' || to_json(title))
                   || chr(10) || '  }}' AS block
            FROM posts),
        parts AS (
            SELECT 1 AS part, event_id, CASE WHEN first THEN '[' || chr(10) ELSE '' END || block
                   || CASE WHEN last THEN '' ELSE ',' END AS text FROM lines
            UNION ALL SELECT 2, 0, ']')
        SELECT row_number() OVER (ORDER BY part, event_id) AS pos, text FROM parts""",
    "feed_bodies_rss": f"""
        SELECT url AS guid, {NO_TEXT} AS title, url AS link, html AS description,
               {NO_TEXT} AS content, {NO_TEXT} AS "pubDate", {NO_TEXT} AS author FROM pages""",
    "feed_bodies_rdf": f"""
        WITH {POSTS}
        SELECT CAST(event_id AS VARCHAR) AS guid, title, link, {NO_TEXT} AS description,
               'long ' || title AS content, {MOMENT.format('stamp')} AS "pubDate", 'someone' AS author
        FROM posts""",
    "feed_bodies_json": f"""
        WITH {POSTS}
        SELECT CAST(event_id AS VARCHAR) AS guid, title, link, description, 'long ' || title AS content,
               {MOMENT.format('stamp')} AS "pubDate", author FROM posts""",
    "csv_rejected": """
        SELECT CAST(doc_id AS VARCHAR) AS url, 'bad CSV' AS reason FROM documents WHERE lang <> 'en'""",
    "csv_long_cell": """
        SELECT CAST(item_id AS VARCHAR) AS id, repeat(text || ' ""', 2000) AS cell FROM benchmark""".replace('""', '"'),
    "feed_bodies_atom": f"""
        WITH {POSTS}
        SELECT coalesce(guid, link) AS guid, title, link, description,
               {NO_TEXT} AS content, {STAMP.format('stamp')} AS "pubDate", author
        FROM posts""",
    "feed_bodies_rejected": "SELECT url, 'cannot parse feed' AS reason FROM pages",
    "json_bodies": """
        SELECT role, text, turn FROM conversations
        UNION ALL SELECT 'echo', role, turn FROM conversations""",
    "json_bodies_filter": """
        SELECT role, text, turn FROM conversations WHERE turn > 1
        UNION ALL SELECT role, 'later', turn + 10 FROM conversations""",
    "json_path_slice": "SELECT 'later' AS role, text, turn + 10 AS turn FROM conversations",
    "json_path_union": """
        SELECT text AS value FROM conversations UNION ALL SELECT role FROM conversations""",
    "json_path_descent": """
        SELECT turn + more AS value FROM conversations, (VALUES (0), (10), (100)) AS v(more)""",
    "json_path_tests": """
        SELECT role, turn FROM (SELECT role, turn FROM conversations
                                UNION ALL SELECT 'later', turn + 10 FROM conversations)
        WHERE turn > 2 AND NOT (turn = 11 OR role = 'user')""",
    "json_path_deep": "SELECT role, turn FROM conversations",
    **{
        f"json_path_{name}": f"""
        SELECT role, turn
        FROM (SELECT role, text, turn, turn AS own FROM conversations
              UNION ALL SELECT 'later', text, turn + 10, turn FROM conversations)
        WHERE {holds}"""
        for name, holds in {
            "length": "length(role) > 4",
            "count": "true",
            "value": "own > 2 AND role = 'later'",
            "match": r"regexp_full_match(role, '[a-z]+er') AND contains(text, chr(10))",
            "search": r"regexp_matches(text, '[0-9]|\bthe\b')",
            "across": "role = 'later' AND turn < own + 100",
        }.items()
    },
    "json_scalars": """
        SELECT value, count(*) AS n
        FROM (SELECT unnest(string_split(text, ' ')) AS value FROM documents) GROUP BY value""",
    "json_rejected": """
        SELECT CAST(event_id AS VARCHAR) AS url, 'cannot parse JSON' AS reason
        FROM events WHERE event_type = 'error'""",
    "csv_bodies": """
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, text FROM documents""",
}
