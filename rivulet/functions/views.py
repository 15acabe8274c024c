"""Text, number and date views of a value, as plain Column expressions.

A field has no declared meaning: the same value is read as text, as a number or
as a date depending on what a rule or sort asks for. Each view is NULL where the
value cannot be read that way. Nothing here needs a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FRACTIONAL + (T.DecimalType,)
MOMENTS = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.StructType, T.ArrayType, T.MapType)

# The number grammar accepted in text (decimal, exponent,
# inf / infinity / nan in any case), with surrounding white space.
NUMBER_PATTERN = (
    r"(?U)^\s*(?:[+-](?=(?i:nan)))?"
    r"((?i)[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?"
    r"|[+-]?inf(?:inity)?|nan)\s*\z"
)

# The accepted date forms, white space around them allowed.
RFC3339_PATTERN = (
    r"(?U)^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}:[0-9]{2})"
    r"(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})\s*\z"
)
NAIVE_PATTERN = (
    r"(?U)^\s*([0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})\s*\z"
)
DAY_PATTERN = r"(?U)^\s*([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})\s*\z"
RFC2822_PATTERN = (
    r"(?Ui)^\s*(?:(mon|tue|wed|thu|fri|sat|sun)\s*,)?\s*([0-9]{1,2})\s+"
    r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+([0-9]{2,4})\s+"
    r"([0-9]{1,2})\s*:\s*([0-9]{2})(?:\s*:\s*([0-9]{2}))?\s+"
    r"([+-][0-9]{4}|[a-z]{1,3})(?:\s*\(.*\))?\s*\z"
)
RFC2822_PARTS = "$1|$2|$3|$4|$5|$6|$7|$8"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
WEEKDAYS = "montuewedthufrisatsun"

# Named zones of RFC 2822 with their constant offsets. The single
# letter zones (all but J) mean an unknown offset and count as UTC.
ZONES = {
    "ut": "+00:00",
    "gmt": "+00:00",
    "est": "-05:00",
    "edt": "-04:00",
    "cst": "-06:00",
    "cdt": "-05:00",
    "mst": "-07:00",
    "mdt": "-06:00",
    "pst": "-08:00",
    "pdt": "-07:00",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often it is used.
    Plain columns do not need it; costly expressions do."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- text ------------------------------------------------------------------


def double_text(col: Column) -> Column:
    """Shortest decimal text of a double: plain digits for magnitudes from 1e-5
    up to 1e16, otherwise ``1.5e16`` style. Spark's own cast switches to
    ``1.0E7`` style much earlier."""
    raw = col.cast("string")
    size = F.abs(col)
    # 16 digits before the point and 22 after hold every double in that range.
    digits = raw.try_cast("decimal(38,22)").cast("string")
    plain = F.regexp_replace(digits, F.lit(r"(\.[0-9]+?)0+$"), F.lit("$1"))
    scientific = F.lower(F.regexp_replace(raw, F.lit(r"\.0E"), F.lit("E")))
    return (
        F.when(~F.contains(raw, F.lit("E")), raw)
        .when((size >= 1e-5) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def moment_text(col: Column) -> Column:
    """RFC 3339 text in UTC; the fraction shows only as far as it is needed."""
    fraction = F.date_format(col, "SSSSSS")
    shown = (
        F.when(fraction == "000000", F.lit(""))
        .when(fraction.endswith("000"), F.concat(F.lit("."), F.substring(fraction, 1, 3)))
        .otherwise(F.concat(F.lit("."), fraction))
    )
    return F.concat(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"), shown, F.lit("+00:00"))


def rfc2822_text(col: Column) -> Column:
    return F.concat(F.date_format(col, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def sorted_keys(col: Column, dtype: T.DataType) -> Column:
    """The same nested value with object keys in order, for canonical JSON."""
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        rebuilt = F.struct(
            *[sorted_keys(col.getField(f.name), f.dataType).alias(f.name) for f in fields]
        )
        return F.when(col.isNotNull(), rebuilt)
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, NESTED):
        return F.transform(col, lambda e: sorted_keys(e, dtype.elementType))
    if isinstance(dtype, T.MapType):
        keys = F.array_sort(F.map_keys(col))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(col, k)))
    return col


def variant_text(col: Column) -> Column:
    raw = col.cast("string")
    exponent = F.contains(raw, F.lit("E")) & (F.schema_of_variant(col) == "DOUBLE")
    return F.when(exponent, double_text(F.try_variant_get(col, "$", "double"))).otherwise(
        F.coalesce(raw, F.when(F.is_variant_null(col), F.lit("null")))
    )


def text_view(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, FRACTIONAL):
        return double_text(col.cast("double"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return moment_text(col)
    if isinstance(dtype, T.VariantType):
        return let(col, variant_text)
    if isinstance(dtype, NESTED):
        return F.to_json(sorted_keys(col, dtype))
    return col.cast("string")


# --- number ----------------------------------------------------------------


def number_from_text(text: Column) -> Column:
    # A misfit is NULL before the cast, where it would cost an exception.
    found = F.regexp_extract(text, NUMBER_PATTERN, 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def number_view(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, NUMERIC):
        return col.cast("double")
    if isinstance(dtype, T.StringType):
        return number_from_text(col)
    if isinstance(dtype, T.VariantType):
        return let(text_view(col, dtype), number_from_text)
    return F.lit(None).cast("double")


# --- date ------------------------------------------------------------------


def _rfc2822_moment(parts: Column) -> Column:
    """The moment of a split RFC 2822 date; NULL if the weekday is not that
    day's or the zone is unknown."""
    weekday, day, month, year, hour, minute, second, zone = (
        F.get(parts, F.lit(i)) for i in range(8)
    )
    month = ((F.position(month, F.lit(MONTHS)) + 2) / 3).cast("int")
    number = year.cast("int")
    century = F.when(number < 50, 2000).when(number < 1000, 1900).otherwise(0)
    named = F.create_map(*[F.lit(text) for pair in ZONES.items() for text in pair])
    offset = (
        F.when(
            zone.rlike("^[+-]"),
            F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)),
        )
        .when(zone.rlike("^[a-ik-z]$"), F.lit("+00:00"))
        .otherwise(F.try_element_at(named, zone))
    )
    date = F.concat_ws("-", (number + century).cast("string"), month.cast("string"), day)
    told = ((F.position(weekday, F.lit(WEEKDAYS)) - 1) / 3).cast("int")
    agrees = (weekday == "") | (told == F.weekday(date.try_cast("date")))
    seconds = F.when(second == "", F.lit("00")).otherwise(second)
    moment = F.concat(date, F.lit("T"), F.concat_ws(":", hour, minute, seconds), offset)
    return F.when(agrees, moment.try_cast("timestamp"))


def moment_from_text(text: Column) -> Column:
    """First of: RFC 3339, RFC 2822, ``Y-m-d H:M:S``, ``Y-m-d``; naive is UTC."""
    return let(text, _moment_by_shape)


def _moment_by_shape(text: Column) -> Column:
    """The shape is tested first so that a value is parsed once, by the one
    parser that fits, and misfits cost no exceptions inside the parser."""

    def rewritten(pattern: str, form: str) -> Column:
        return F.regexp_replace(text, F.lit(pattern), F.lit(form))

    rfc3339 = F.upper(rewritten(RFC3339_PATTERN, "$1T$2$3$4"))
    rfc2822 = F.split(F.lower(rewritten(RFC2822_PATTERN, RFC2822_PARTS)), r"\|")
    return (
        F.when(text.rlike(RFC3339_PATTERN), rfc3339.try_cast("timestamp"))
        .when(
            text.rlike(DAY_PATTERN),
            rewritten(DAY_PATTERN, "$1 00:00:00+00:00").try_cast("timestamp"),
        )
        .when(
            text.rlike(NAIVE_PATTERN), rewritten(NAIVE_PATTERN, "$1+00:00").try_cast("timestamp")
        )
        .when(text.rlike(RFC2822_PATTERN), let(rfc2822, _rfc2822_moment))
    )


def moment_view(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, MOMENTS):
        return col.cast("timestamp")
    if isinstance(dtype, (T.StringType, T.VariantType)):
        return moment_from_text(text_view(col, dtype))
    return F.lit(None).cast("timestamp")


# --- types -----------------------------------------------------------------


def common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """The type two branches of one key share without changing any text view;
    text where there is none."""
    if left == right:
        return left
    if isinstance(left, T.NullType):
        return right
    if isinstance(right, T.NullType):
        return left
    if isinstance(left, INTEGRAL) and isinstance(right, INTEGRAL):
        return T.LongType()
    if isinstance(left, FRACTIONAL) and isinstance(right, FRACTIONAL):
        return T.DoubleType()
    stamps = (T.TimestampType, T.TimestampNTZType)
    if isinstance(left, stamps) and isinstance(right, stamps):
        return T.TimestampType()
    return T.StringType()


def as_type(col: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return col
    if isinstance(want, T.StringType):
        return text_view(col, have)
    return col.cast(want)
