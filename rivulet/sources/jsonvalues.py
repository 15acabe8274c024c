"""What the tests of a JSON path compare: values of one kind each, as columns.

Values of different kinds are never equal and never in order; "nothing", what a path
without a match has, equals only itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Value:
    """``kind`` is NULL for nothing. ``parts`` has, for each kind that the value may be
    of, what it compares by; ``node`` is the JSON itself where there is one."""

    kind: Column
    parts: dict[str, Column]
    node: Column | None = None


def elements(node: Column) -> Column:
    """Elements of a JSON array, NULL for anything else."""
    return F.try_variant_get(node, "$", "array<variant>")


def members(node: Column) -> Column:
    """Members of a JSON object, NULL for anything else."""
    return F.try_variant_get(node, "$", "map<string,variant>")


def literal_value(value: object) -> Value:
    if value is None:
        return Value(F.lit("null"), {"null": F.lit(True)})
    if isinstance(value, bool):
        return Value(F.lit("boolean"), {"boolean": F.lit(value)})
    if isinstance(value, str):
        return Value(F.lit("text"), {"text": F.lit(value)})
    return Value(F.lit("number"), {"number": F.lit(float(value))})


def number_value(number: Column) -> Value:
    """A count, or nothing where it is NULL."""
    return Value(F.when(number.isNotNull(), "number"), {"number": number.cast("double")})


def node_value(node: Column) -> Value:
    """The value of a VARIANT, nothing where it is NULL. Numbers compare as doubles,
    arrays and objects by their JSON text, in which keys are sorted."""
    shown = F.schema_of_variant(node)
    kind = (
        F.when(shown == "VOID", "null")
        .when(shown == "BOOLEAN", "boolean")
        .when(shown == "STRING", "text")
        .when(shown.rlike("^(BIGINT|DOUBLE|DECIMAL)"), "number")
        .when(node.isNotNull(), "nested")
    )
    parts = {
        "null": F.lit(True),
        "boolean": F.try_variant_get(node, "$", "boolean"),
        "text": F.try_variant_get(node, "$", "string"),
        "number": F.try_variant_get(node, "$", "double"),
        "nested": F.to_json(node),
    }
    return Value(kind, parts, node)


def length_of(value: Value) -> Column:
    """Characters of a text, elements of an array, members of an object, else NULL."""
    size = F.lit(None).cast("int")
    if "text" in value.parts:
        size = F.when(value.kind == "text", F.length(value.parts["text"]))
    if value.node is not None:
        held = F.coalesce(F.array_size(elements(value.node)), F.array_size(F.map_keys(members(value.node))))
        size = size.when(value.kind == "nested", held)
    return size


def has_text(value: Value, pattern: str) -> Column:
    """Whether a (Java) pattern is found in the value; only texts have any."""
    if "text" not in value.parts:
        return F.lit(False)
    return F.coalesce((value.kind == "text") & value.parts["text"].rlike(pattern), F.lit(False))


def _of_one_kind(
    left: Value, right: Value, kinds: tuple[str, ...], holds: Callable[[Column, Column], Column]
) -> Column:
    """True where both are of one of the kinds and it holds; never NULL."""
    found = [
        F.coalesce((left.kind == k) & (right.kind == k) & holds(left.parts[k], right.parts[k]), F.lit(False))
        for k in kinds
        if k in left.parts and k in right.parts
    ]
    return reduce(lambda a, b: a | b, found, F.lit(False))


def equal(left: Value, right: Value) -> Column:
    same = _of_one_kind(left, right, ("null", "boolean", "number", "text", "nested"), lambda a, b: a == b)
    return same | (left.kind.isNull() & right.kind.isNull())


def less(left: Value, right: Value) -> Column:
    return _of_one_kind(left, right, ("number", "text"), lambda a, b: a < b)


COMPARISONS: dict[str, Callable[[Value, Value], Column]] = {
    "==": equal,
    "!=": lambda a, b: ~equal(a, b),
    "<": less,
    ">": lambda a, b: less(b, a),
    "<=": lambda a, b: less(a, b) | equal(a, b),
    ">=": lambda a, b: less(b, a) | equal(a, b),
}
