"""unique: the first item per field value."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F, types as T

from rivulet.functions import views
from rivulet.items import Field, Items, quoted, strip_item


def unique(items: Items, by: str) -> Items:
    """Keep the first item of each text value of ``by``; items without the field
    are all kept.

    One pass over the input. Each map task keeps only its first rows per group
    before the shuffle (Spark plans ``rank = 1`` as a window group limit), so a
    value held by a third of the rows costs one row per task. An item without
    the field is a group of its own, by its place in the order, so that these
    items spread over the tasks like any others.
    """
    items.require_batch("unique")
    if by is None:
        raise ValueError("param `by` is required")
    path = strip_item(by)
    field = items.field(by)
    key, rank, row, *places = items.fresh_hidden(3 + len(items.order))
    df = items.df
    if not items.dynamic and path in df.columns and isinstance(field.dtype, _AS_THEY_ARE):
        key_column = path  # long texts are not carried twice
    else:
        key_column, df = key, df.withColumn(key, _group_key(field))
    absent = quoted(key_column).isNull()
    df = df.withColumns(
        {
            place: F.when(absent, quoted(order.column))
            for place, order in zip(places, items.order)
        }
    )
    groups = [quoted(key_column), *map(quoted, places)]
    window = Window.partitionBy(*groups).orderBy(*items.sort_columns())
    # Rows at the same place share a rank, so no item without the field is lost
    # where places repeat; the row number then settles ties between the others.
    firsts = df.withColumn(rank, F.rank().over(window)).where(quoted(rank) == 1)
    settled = firsts.withColumn(row, F.row_number().over(window))
    kept = settled.where((quoted(row) == 1) | absent)
    return items.with_df(kept.drop(key, rank, row, *places))


# Types whose values are equal exactly if their texts are.
_AS_THEY_ARE = views.INTEGRAL + views.MOMENTS + (T.StringType, T.BooleanType)


def _group_key(field: Field) -> Column:
    return field.value if isinstance(field.dtype, _AS_THEY_ARE) else field.text
