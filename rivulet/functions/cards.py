"""Card columns: what a reader shows for one item, as text derived from it."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from rivulet.items import Items

# The named entities that are decoded; others stay as they are.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
ENTITY_NAME_BYTES = 8
UNTITLED = "(untitled)"


def url_domain(link: Column) -> Column:
    """Host of a URL without user, port and path; ``www.`` stays and a missing
    scheme is fine. NULL if there is none."""
    host = F.regexp_extract(link, r"(?U)^\s*(?:[\s\S]*?://)?([^/?#]*)", 1)
    host = F.substring_index(F.substring_index(host, "@", -1), ":", 1)
    host = F.regexp_replace(host, F.lit(r"(?U)^\s+|\s+\z"), F.lit(""))
    return F.when(host != "", host)


def age_label(when: Column, now: Column) -> Column:
    """``just now``, ``5m ago``, ``3h ago``, ``2d ago`` or ``4w ago``, floored."""
    seconds = ((F.unix_micros(now) - F.unix_micros(when)) / F.lit(1_000_000)).cast("bigint")

    def ago(unit_seconds: int, letter: str) -> Column:
        return F.concat(F.floor(seconds / unit_seconds).cast("string"), F.lit(f"{letter} ago"))

    return F.when(
        when.isNotNull(),
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3_600, ago(60, "m"))
        .when(seconds < 86_400, ago(3_600, "h"))
        .when(seconds < 7 * 86_400, ago(86_400, "d"))
        .otherwise(ago(7 * 86_400, "w")),
    )


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, F.lit(r"(?U)\s+"), F.lit(" ")))


def strip_tags(html: Column) -> Column:
    """Every ``<...>`` becomes a space; a tag that never ends takes the rest."""
    closed = F.regexp_replace(html, F.lit("<[^>]*>"), F.lit(" "))
    return F.regexp_replace(closed, F.lit(r"<[^>]*\z"), F.lit(""))


def _character(code: Column) -> Column:
    """The character of a code point, NULL for what is none."""
    valid = code.between(0, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    octets = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return F.when(valid, F.decode(octets, "UTF-32"))


def _decoded(piece: Column) -> Column:
    """What followed an ampersand, with the entity it starts decoded."""
    name = F.regexp_extract(piece, r"^([^;]*);", 1)
    known = F.lit(None).cast("string")
    for entity, char in ENTITIES.items():
        known = F.when(name == entity, F.lit(char)).otherwise(known)
    decimal = F.regexp_extract(name, r"^#\+?([0-9]+)\z", 1)
    hexadecimal = F.regexp_extract(name, r"^#[xX]\+?([0-9a-fA-F]+)\z", 1)
    code = F.when(decimal != "", decimal.try_cast("bigint")).when(
        hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("bigint")
    )
    char = F.when(
        F.octet_length(name) <= ENTITY_NAME_BYTES,
        F.coalesce(known, _character(code)),
    )
    rest = F.substring(piece, F.length(name) + F.lit(2), F.length(piece))
    return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece))


def decode_entities(text: Column) -> Column:
    """Decode entities in one pass: what a decoded entity spells is not decoded
    again. Text without an ampersand skips the work."""
    pieces = F.split(text, "&")
    later = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    decoded = F.array_join(F.transform(later, _decoded), "")
    return F.when(F.contains(text, F.lit("&")), F.concat(pieces[0], decoded)).otherwise(text)


def snippet(html: Column) -> Column:
    return collapse_whitespace(decode_entities(strip_tags(html)))


def cards(items: Items, now: datetime | None = None) -> Items:
    """One card per item: title, domain, age, snippet; '' where absent."""
    now = now or datetime.now(timezone.utc)
    stamp = now.astimezone(timezone.utc) if now.tzinfo else now
    clock = F.lit(stamp.strftime("%Y-%m-%d %H:%M:%S.%f") + "+00:00").cast("timestamp")
    title = items.field("title").text
    blank = F.lit("")
    card = {
        "title": F.coalesce(F.when(title != "", title), F.lit(UNTITLED)),
        "domain": F.coalesce(url_domain(items.field("link").text), blank),
        "age": F.coalesce(age_label(items.field("pubDate").moment, clock), blank),
        "snippet": F.coalesce(snippet(items.field("description").text), blank),
    }
    columns = [col.alias(name) for name, col in card.items()]
    df = items.df.select(*columns, *[F.col(h) for h in items.hidden])
    return items.with_df(df, dynamic=False)


def feed_summary(
    items: Items,
    title: str,
    format: str = "rss",
    description: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """One row about the whole stream: title, description, format, item count
    and the clock time it was read at."""
    from rivulet.sinks.documents import CHANNEL_DESCRIPTION, check_format

    now = now or datetime.now(timezone.utc)
    return items.df.agg(F.count(F.lit(1)).alias("items")).select(
        F.lit(title).alias("title"),
        F.lit(description or CHANNEL_DESCRIPTION).alias("description"),
        F.lit(check_format(format)).alias("format"),
        "items",
        F.lit(now.strftime("%H:%M")).alias("updated"),
    )
