"""Steps that read or change the order: sort, limit, tail, reverse, numbering."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rivulet.functions import views
from rivulet.items import Field, Items, OrderKey, quoted
from rivulet.session import checkpointed

# monotonically_increasing_id() is (partition << 33) + row within the partition.
ROW_BITS = 33
# Items that may meet in one task from every other.
TOP_ROWS = 10_000


def sort(items: Items, by: str, order: str = "asc", compare: str = "auto") -> Items:
    """Stable sort by one field; items without a usable key come last in both
    directions. Lazy: the new key is put in front of the existing order, which
    thereby breaks ties."""
    items.require_batch("sort")
    if by is None:
        raise ValueError("sort needs `by`, the field to go by")
    if order not in ("asc", "desc"):
        raise ValueError(f"sort `order`: asc or desc, not `{order}`")
    if compare not in ("auto", "numeric", "lexical", "date"):
        raise ValueError(
            f"sort `compare`: auto, numeric, date or lexical, not `{compare}`"
        )
    keys = _sort_keys(items, items.field(by), compare)
    names = items.fresh_hidden(len(keys))
    df = items.df.select("*", *[key.alias(name) for key, name in zip(keys, names)])
    front = tuple(OrderKey(name, order == "desc", nulls_last=True) for name in names)
    return items.with_df(df, order=front + items.order)


def _number_key(field: Field) -> Column:
    if isinstance(field.dtype, views.INTEGRAL):
        return field.value
    number = field.number
    return F.when(F.isnan(number), None).when(number == 0, F.lit(0.0)).otherwise(number)


def _date_key(field: Field) -> Column:
    return F.unix_millis(field.moment)


def _sort_keys(items: Items, field: Field, compare: str) -> list[Column]:
    if compare == "auto":
        if isinstance(field.dtype, views.NUMERIC):
            compare = "numeric"
        elif isinstance(field.dtype, views.MOMENTS):
            compare = "date"
        elif not isinstance(field.dtype, (T.StringType, T.VariantType)):
            compare = "lexical"
    if compare == "numeric":
        return [_number_key(field)]
    if compare == "date":
        return [_date_key(field)]
    if compare == "lexical":
        return [field.text]
    mode = _detected_mode(items, field)
    return [
        F.when(mode == "numeric", _number_key(field)),
        F.when(mode == "date", _date_key(field)),
        F.when(mode == "lexical", field.text),
    ]


def _detected_mode(items: Items, field: Field) -> Column:
    """What every present value can be read as, from one aggregate over the
    column. It stays in the plan as a scalar subquery, so sort stays lazy."""
    present = items.df.where(field.present)
    return present.agg(
        F.when(F.bool_and(field.number.isNotNull()), F.lit("numeric"))
        .when(F.bool_and(field.moment.isNotNull()), F.lit("date"))
        .otherwise(F.lit("lexical"))
        .alias("mode")
    ).scalar()


def reverse(items: Items) -> Items:
    """Flip the order. Metadata only."""
    items.require_batch("reverse")
    return replace(items, order=tuple(key.flipped() for key in items.order))


def _row_count(n) -> int:
    if isinstance(n, float) and n.is_integer():
        n = int(n)
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError(f"`n` is a number of items, 0 or more, not `{n}`")
    return n


def limit(items: Items, n: int) -> Items:
    """The first ``n`` items. Up to TOP_ROWS each task keeps its own first ``n`` and
    those meet in one; beyond that the key of the ``n``-th item is looked up in the
    sorted keys alone, and the items up to it stay where they are."""
    items.require_batch("limit")
    n = _row_count(n)
    if items.max_rows is not None and items.max_rows <= n:
        return items
    if n <= TOP_ROWS or not items.order:
        return items.with_df(items.df.orderBy(*items.sort_columns()).limit(n), max_rows=n)
    return items.with_df(_upto(items, n), max_rows=n)


def _upto(items: Items, n: int) -> DataFrame:
    """The first ``n`` rows without meeting in a task: those before the ``n``-th row's
    key, and of those that share it as many as are due."""
    names = [key.column for key in items.order]
    keys = replace(items, df=items.df.select(*map(quoted, names)))
    place = items.fresh_hidden(1)[0]
    placed = numbered(keys, place)
    edge = placed.where(quoted(place) == n).select(F.struct(*map(quoted, names)).alias("edge"))
    pivot = checkpointed(edge).scalar()  # one row
    before, same = _before(items.order, pivot), F.lit(True)
    for name in names:
        same = same & quoted(name).eqNullSafe(pivot.getField(name))
    counts = keys.df.agg(F.count_if(before), F.count_if(same & pivot.isNotNull())).first()
    if not counts[1]:  # fewer rows than n
        return items.df
    due = n - counts[0]
    if due == counts[1]:
        return items.df.where(before | same)
    return items.df.where(before).union(items.df.where(same).limit(due))


def _before(order: tuple[OrderKey, ...], pivot: Column) -> Column:
    """Whether a row comes before ``pivot``, a struct of the keys, in ``order``."""
    out = F.lit(False)
    for key in reversed(order):
        own, edge = quoted(key.column), pivot.getField(key.column)
        less = own > edge if key.descending else own < edge
        less = (
            F.when(own.isNull(), edge.isNotNull() & F.lit(not key.nulls_last))
            .when(edge.isNull(), F.lit(key.nulls_last))
            .otherwise(less)
        )
        out = less | (own.eqNullSafe(edge) & out)
    return out


def tail(items: Items, n: int) -> Items:
    """The last ``n`` items, in their original order."""
    items.require_batch("tail")
    return reverse(limit(reverse(items), n))


def numbered(items: Items, name: str) -> DataFrame:
    """All columns plus the 1-based place in the order.

    The input is range partitioned by the order and checkpointed, so that partitions
    and the rows in them stay fixed; then the number is the rows in earlier partitions
    plus the row's place in its own. Only one row per partition meets in one task.
    """
    keys = items.sort_columns()
    sorted_parts = checkpointed(
        items.df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    )
    part, row, before = (f"{name}_part", f"{name}_row", f"{name}_before")
    tagged = sorted_parts.withColumn(row, F.monotonically_increasing_id())
    tagged = tagged.withColumn(part, F.shiftright(row, ROW_BITS)).withColumn(
        row, quoted(row).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    )
    sizes = tagged.groupBy(part).agg((F.max(row) + 1).alias("size"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias(before))
    # One row per partition: small by construction.
    return (
        tagged.join(F.broadcast(starts), part)
        .withColumn(name, quoted(before) + quoted(row) + 1)
        .drop(part, row, before)
    )
