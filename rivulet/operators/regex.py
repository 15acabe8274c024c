"""regex: rewrite a field, or pull named groups into fields of their own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from rivulet.functions import views
from rivulet.functions.dialect import Pattern, spark_pattern, spark_replacement
from rivulet.items import DYNAMIC_COLUMN, Items, quoted, refuse_case_twins, strip_item


def regex(
    items: Items, field: str, pattern: str, mode: str = "replace", replacement: str = ""
) -> Items:
    """``replace`` rewrites every match in ``field``, which becomes text.
    ``extract`` takes the first match and stores each named group that took part
    in it as a text field. Items without the field, or without a match to
    extract from, stay as they are."""
    if field is None:
        raise ValueError("regex needs `field`, where to look")
    if pattern is None:
        raise ValueError("regex needs `pattern`, what to look for")
    if mode not in ("replace", "extract"):
        raise ValueError(f"regex `mode`: replace or extract, not `{mode}`")
    compiled = spark_pattern(pattern)
    if mode == "replace":
        return _replace(items, strip_item(field), compiled, replacement)
    if not compiled.groups:
        raise ValueError(
            f"`{pattern}` names no group to extract, as in `(?<size>[0-9]+)`"
        )
    return _extract(items, strip_item(field), compiled)


def replaced(text: Column, pattern: Pattern, replacement: str) -> Column:
    # An empty match right after another match does not count in this dialect:
    # \G is the end of the previous match, and the atomic group keeps the engine
    # from stretching the match to get past it.
    guarded = rf"(?>{pattern.java})(?:(?!\G)|\A)"
    return F.regexp_replace(
        text, F.lit(guarded), F.lit(spark_replacement(pattern, replacement))
    )


def _replace(items: Items, path: str, pattern: Pattern, replacement: str) -> Items:
    field = items.field(path)
    value = replaced(field.text, pattern, replacement)
    if items.dynamic:
        # Written back under the literal name, also for a dotted path.
        return items.with_df(_put(items.df, field.present, path, value))
    head, *rest = path.split(".")
    if head not in items.columns:
        return items
    if not rest:
        return items.with_df(items.df.withColumn(head, value))
    if not isinstance(items.dtype(head), T.StructType):
        raise ValueError(f"cannot write `{path}`: `{head}` is not a nested object")
    if not _has_path(items.dtype(head), rest):
        return items
    nested = quoted(head).withField(".".join(f"`{r}`" for r in rest), value)
    return items.with_df(items.df.withColumn(head, nested))


def _has_path(dtype: T.DataType, rest: list[str]) -> bool:
    for name in rest:
        if not isinstance(dtype, T.StructType) or name not in dtype.names:
            return False
        dtype = dtype[name].dataType
    return True


def _extract(items: Items, path: str, pattern: Pattern) -> Items:
    text = items.field(path).text
    groups = {name: _group(text, pattern, index) for name, index in pattern.groups.items()}
    if len(groups) > 1:  # one cheap test spares the groups of what does not match
        matched = text.rlike(pattern.java)
        groups = {name: F.when(matched, value) for name, value in groups.items()}
    if items.dynamic:
        df = items.df
        names = items.fresh_hidden(len(groups))
        df = df.select("*", *[col.alias(tmp) for col, tmp in zip(groups.values(), names)])
        for name, tmp in zip(groups, names):
            df = _put(df, quoted(tmp).isNotNull(), name, quoted(tmp))
        return items.with_df(df.drop(*names))
    refuse_case_twins(items.df.sparkSession, [*items.columns, *groups])
    columns = {}
    for name, value in groups.items():
        if name in items.columns:
            old = views.text_view(quoted(name), items.dtype(name))
            value = F.coalesce(value, old)
        columns[name] = value
    return items.with_df(items.df.withColumns(columns))


def _group(text: Column, pattern: Pattern, index: int) -> Column:
    """The text of a group in the first match, NULL if it took no part.

    ``regexp_extract`` says '' both for an empty group and for one that took no
    part. A backreference tells them apart: it fails for a group that took no
    part. The atomic group pins the check to the first match.
    """
    took_part = rf"\A(?>[\s\S]*?(?:{pattern.java}))(?:\{index})"
    found = F.nullif(F.regexp_extract(text, pattern.java, index), F.lit(""))
    return F.coalesce(found, F.when(text.rlike(took_part), F.lit("")))


def _put(df, when: Column, name: str, text: Column):
    """Set one key of dynamic items where ``when`` holds."""
    item = quoted(DYNAMIC_COLUMN)
    rest = F.map_filter(item, lambda k, _: k != name)
    changed = F.map_concat(rest, F.create_map(F.lit(name), text.cast("variant")))
    return df.withColumn(DYNAMIC_COLUMN, F.when(when, changed).otherwise(item))
