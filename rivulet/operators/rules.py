"""Filter rules: ``field op value`` text, turned into a Column predicate.

Values are numbers, quoted or bare text, or ``now`` plus or minus a duration in
m, h, d or w. A missing field never matches, not even with ``!=``.
"""

from __future__ import annotations

import math
import operator
import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T

from rivulet.functions import views
from rivulet.functions.dialect import spark_pattern
from rivulet.items import Field, Items, strip_item

# The operators and the duration units in seconds.
OPERATORS = ("==", "!=", ">", "<", ">=", "<=", "contains", "matches")
UNITS = {"m": 60.0, "h": 3_600.0, "d": 86_400.0, "w": 604_800.0}

COMPARE = {
    "==": operator.eq,
    "!=": operator.ne,
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
}
PLAIN_NUMBER = re.compile(
    r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?|nan)", re.I
)
EXACT_DOUBLE = 2**53


@dataclass(frozen=True)
class Rule:
    field: str
    op: str
    value: float | str | timedelta


def parse_float(text: str) -> float | None:
    return float(text) if PLAIN_NUMBER.fullmatch(text) else None


def parse_rule(text: str) -> Rule:
    words = text.split(maxsplit=2)
    if len(words) < 3:
        raise ValueError(f"a rule is `field operator value`, which `{text.strip()}` is not")
    field, op, value = words
    if op not in OPERATORS:
        raise ValueError(f"no such operator: `{op}`; use one of {' '.join(OPERATORS)}")
    return Rule(strip_item(field), op, rule_value(value.rstrip()))


# The three forms of a value that are not bare text.
QUOTED = re.compile(r"""(["'])(?P<inside>.*)\1""", re.DOTALL)
CLOCK = re.compile(r"now(?:\s*(?P<sign>[+-])\s*(?P<amount>[^\s].*?)\s*(?P<unit>[mhdw]))?")


def rule_value(text: str) -> float | str | timedelta:
    """Quoted text, a date by the clock, a number, or else the text as it stands."""
    if text.startswith(("'", '"')):
        quoted = QUOTED.fullmatch(text)
        if quoted is None:
            raise ValueError(f"value {text} needs its closing quote")
        return quoted["inside"]
    if text.startswith("now"):
        return _clock_offset(text)
    number = parse_float(text)
    return text if number is None else number


def _clock_offset(text: str) -> timedelta:
    """How far from ``now`` the date lies, cut to whole seconds."""
    found = CLOCK.fullmatch(text)
    amount = parse_float(found["amount"] or "0") if found else None
    if amount is None or not math.isfinite(amount):
        raise ValueError(f"date `{text}` must look like now, now + 2d or now - 1.5h (units: {' '.join(UNITS)})")
    seconds = math.trunc(amount * UNITS[found["unit"] or "m"])
    return timedelta(seconds=-seconds if found["sign"] == "-" else seconds)


def plain_number(value: float) -> str:
    """A number in plain digits, as ``contains`` searches for it."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "inf" if value > 0 else "-inf"
    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def predicate(
    items: Items, text: str, now: datetime, item: Column | None = None
) -> Column:
    """The rule as a predicate over ``items``. True on a match; false or NULL
    otherwise, so callers that negate it must treat NULL as false."""
    try:
        rule = parse_rule(text)
        return _predicate(items.field(rule.field, item), rule, now)
    except (ValueError, OverflowError) as problem:
        raise ValueError(f"rule `{text}`: {problem}") from None


def _predicate(field: Field, rule: Rule, now: datetime) -> Column:
    if rule.op == "matches":
        if not isinstance(rule.value, str):
            raise ValueError("`matches` needs a regex pattern, not a number or date")
        return field.text.rlike(spark_pattern(rule.value).java)
    if rule.op == "contains":
        needle = rule.value
        if isinstance(needle, float):
            needle = plain_number(needle)
        elif isinstance(needle, timedelta):
            needle = ""  # a date has no text to look for: true wherever present
        return F.contains(F.lower(field.text), F.lower(F.lit(needle)))
    if isinstance(rule.value, timedelta):
        return _compare_moment(field, rule.op, now + rule.value)
    if isinstance(rule.value, float):
        return _compare_number(field, rule.op, rule.value)
    return COMPARE[rule.op](field.text, F.lit(rule.value))


def _compare_number(field: Field, op: str, value: float) -> Column:
    if math.isnan(value):
        return F.lit(False)
    compare = COMPARE[op]
    if isinstance(field.dtype, views.INTEGRAL) and abs(value) < EXACT_DOUBLE:
        return _compare_integer(field.value, field.dtype, op, value)

    def hit(number: Column) -> Column:
        found = compare(number, F.lit(value))
        # NaN compares with nothing; Spark ranks it above every number.
        return found & ~F.isnan(number) if op in (">", ">=", "!=") else found

    if isinstance(field.dtype, T.DoubleType):
        return hit(field.value)  # compared as it is, so that the scan can use it
    if isinstance(field.dtype, T.StringType):
        # The text may be costly, such as what a pattern has extracted; take it once.
        return views.let(
            field.value, lambda text: views.let(views.number_view(text, field.dtype), hit)
        )
    return hit(field.number)


def _compare_integer(col: Column, dtype: T.DataType, op: str, value: float) -> Column:
    """Compare an integer column with an integer literal of its own type, which
    reaches the scan; a fraction is rounded to the bound it implies."""
    if not value.is_integer():
        if op in ("==", "!="):
            return F.lit(False) if op == "==" else col.isNotNull()
        # c > 4.5 and c >= 4.5 mean c > 4; c < 4.5 and c <= 4.5 mean c < 5.
        value = math.floor(value) if op in (">", ">=") else math.ceil(value)
        op = op[0]
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(dtype)]
    bound = int(value)
    fits = -(2 ** (bits - 1)) <= bound < 2 ** (bits - 1)
    return COMPARE[op](col, F.lit(bound).cast(dtype) if fits else F.lit(bound).cast("bigint"))


def _compare_moment(field: Field, op: str, bound: datetime) -> Column:
    naive = bound.astimezone(timezone.utc).replace(tzinfo=None)
    if isinstance(field.dtype, T.TimestampNTZType):
        literal = F.lit(naive.isoformat(sep=" ")).cast("timestamp_ntz")
        return COMPARE[op](field.value, literal)
    literal = F.lit(naive.isoformat(sep=" ") + "+00:00").cast("timestamp")
    return COMPARE[op](field.moment, literal)
