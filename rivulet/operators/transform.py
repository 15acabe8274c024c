"""transform: rename, copy and drop top-level fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

from rivulet.functions import views
from rivulet.items import DYNAMIC_COLUMN, Items, quoted, refuse_case_twins, strip_item

# Operation names and how many field names each takes.
OPERATIONS = {"rename": 2, "copy": 2, "drop": 1}


def parse_op(text: str) -> tuple[str, list[str]]:
    if not isinstance(text, str):
        raise ValueError(f"op `{text}` is not a string")
    name, *fields = text.split() or [""]
    if OPERATIONS.get(name) != len(fields):
        raise ValueError(
            f"op `{text}`: expected `rename <field> <new>`, `copy <field> <new>`, "
            "or `drop <field>`"
        )
    return name, [strip_item(f) for f in fields]


def transform(items: Items, ops: str | Sequence[str] | None) -> Items:
    """Apply ``rename a b``, ``copy a b`` and ``drop a`` in order. An op touches
    only items that have the field: ``rename a b`` replaces ``b`` only there."""
    parsed = [parse_op(op) for op in ([ops] if isinstance(ops, str) else ops or [])]
    if not parsed:
        return items
    return _dynamic(items, parsed) if items.dynamic else _typed(items, parsed)


def _typed(items: Items, parsed: list[tuple[str, list[str]]]) -> Items:
    """One projection, however many ops."""
    columns = {name: (quoted(name), items.dtype(name)) for name in items.columns}
    for op, fields in parsed:
        source = columns.get(fields[0])
        if source is None:
            continue
        if op == "drop":
            del columns[fields[0]]
            continue
        old, new = fields
        if old == new:
            continue
        columns[new] = _over(source, columns.get(new))
        if op == "rename":
            del columns[old]
    refuse_case_twins(items.df.sparkSession, columns)
    data = [col.alias(name) for name, (col, _) in columns.items()]
    return items.with_df(items.df.select(*data, *[quoted(h) for h in items.hidden]))


def _over(
    source: tuple[Column, T.DataType], target: tuple[Column, T.DataType] | None
) -> tuple[Column, T.DataType]:
    if target is None:
        return source
    dtype = views.common_type(source[1], target[1])
    return F.coalesce(views.as_type(*source, dtype), views.as_type(*target, dtype)), dtype


def _dynamic(items: Items, parsed: list[tuple[str, list[str]]]) -> Items:
    df = items.df
    item = quoted(DYNAMIC_COLUMN)
    for op, fields in parsed:
        if op == "drop":
            changed = _without(item, fields)
        elif fields[0] == fields[1]:
            continue
        else:
            replaced = fields if op == "rename" else fields[1:]
            moved = F.create_map(F.lit(fields[1]), F.element_at(item, F.lit(fields[0])))
            changed = F.when(
                F.map_contains_key(item, fields[0]),
                F.map_concat(_without(item, replaced), moved),
            ).otherwise(item)
        df = df.withColumn(DYNAMIC_COLUMN, changed)
    return items.with_df(df)


def _without(item: Column, names: list[str]) -> Column:
    return F.map_filter(item, lambda k, _: ~k.isin(*names))
