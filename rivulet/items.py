"""``Items``: a DataFrame of records plus the order those records arrive in.

Spark rows have no order, but limit, tail, reverse, unique and stable sort all
depend on one. ``Items`` keeps it as data: hidden key columns and a list of
``OrderKey`` saying how to compare them. Steps edit that list (reverse only
flips flags, sort only prepends a key), so nothing is shuffled until a step or
an output really needs the order.

Two physical forms share every step:

* typed: ordinary columns, SQL NULL means the field is missing;
* dynamic: one column ``item MAP<STRING, VARIANT>`` for records that share no
  schema; a missing field is a key that is not there, JSON null is a value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rivulet.functions import views
from rivulet.session import pin_utc

HIDDEN = "__rv_"
DYNAMIC_COLUMN = "item"
DYNAMIC_TYPE = T.MapType(T.StringType(), T.VariantType())


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def refuse_case_twins(spark: SparkSession, names: Iterable[str]) -> None:
    """Field names are exact, but Spark by default cannot tell two columns apart
    that differ only in case."""
    if spark.conf.get("spark.sql.caseSensitive") == "true":
        return
    seen: dict[str, str] = {}
    for name in names:
        twin = seen.setdefault(name.lower(), name)
        if twin != name:
            raise ValueError(
                f"fields `{twin}` and `{name}` differ only in case: set "
                "spark.sql.caseSensitive=true or use dynamic items"
            )


def strip_item(path: str) -> str:
    return path.removeprefix("item.")


@dataclass(frozen=True)
class OrderKey:
    column: str
    descending: bool = False
    nulls_last: bool = True

    def sort_column(self) -> Column:
        col = quoted(self.column)
        if self.descending:
            return col.desc_nulls_last() if self.nulls_last else col.desc_nulls_first()
        return col.asc_nulls_last() if self.nulls_last else col.asc_nulls_first()

    def flipped(self) -> OrderKey:
        return OrderKey(self.column, not self.descending, not self.nulls_last)


@dataclass(frozen=True)
class Field:
    """One field of an item under each view; all NULL where it is missing."""

    value: Column
    dtype: T.DataType

    @cached_property
    def present(self) -> Column:
        return self.value.isNotNull()

    @cached_property
    def text(self) -> Column:
        return views.text_view(self.value, self.dtype)

    @cached_property
    def number(self) -> Column:
        return views.number_view(self.value, self.dtype)

    @cached_property
    def moment(self) -> Column:
        return views.moment_view(self.value, self.dtype)


def missing() -> Field:
    return Field(F.lit(None).cast("string"), T.StringType())


def variant_path(segments: Sequence[str]) -> str:
    parts = []
    for segment in segments:
        quote = '"' if '"' not in segment else "'"
        if quote in segment:
            raise ValueError(f"field name `{segment}` mixes both quote characters")
        parts.append(f"[{quote}{segment}{quote}]")
    return "$" + "".join(parts)


def _descend(value: Column, dtype: T.DataType, segments: Sequence[str]) -> Field:
    if not segments:
        return Field(value, dtype)
    head, rest = segments[0], segments[1:]
    if isinstance(dtype, T.StructType):
        for field in dtype.fields:
            if field.name == head:
                return _descend(value.getField(head), field.dataType, rest)
    elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        return _descend(F.element_at(value, F.lit(head)), dtype.valueType, rest)
    elif isinstance(dtype, T.VariantType):
        found = F.try_variant_get(value, variant_path(segments), "variant")
        return Field(found, dtype)
    return missing()


@dataclass(frozen=True)
class Items:
    df: DataFrame
    order: tuple[OrderKey, ...] = ()
    dynamic: bool = False
    max_rows: int | None = None

    # --- construction ------------------------------------------------------

    @staticmethod
    def from_table(df: DataFrame, order_by: str | Iterable[str]) -> Items:
        """Items from a DataFrame. ``order_by`` names the columns that give the
        arrival order (``"ts"`` or ``"ts desc"``); together they should be
        unique, or ties have no defined order."""
        pin_utc(df.sparkSession)
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        if not keys:
            raise ValueError("order_by needs at least one column")
        if any(name.startswith(HIDDEN) for name in df.columns):
            raise ValueError(f"column names that start with `{HIDDEN}` are reserved")
        order, hidden = [], []
        for i, key in enumerate(keys):
            name, _, direction = key.partition(" ")
            if direction not in ("", "asc", "desc"):
                raise ValueError(f"order_by `{key}`: direction must be asc or desc")
            if name not in df.columns:
                raise ValueError(f"order_by `{key}`: no such column")
            column = f"{HIDDEN}{i}"
            hidden.append(quoted(name).alias(column))
            order.append(OrderKey(column, direction == "desc"))
        dynamic = _is_dynamic(df)
        return Items(df.select("*", *hidden), tuple(order), dynamic)

    @staticmethod
    def from_ordered(df: DataFrame, hidden: Sequence[str]) -> Items:
        """Items from a DataFrame that already carries hidden key columns."""
        order = tuple(OrderKey(name) for name in hidden)
        return Items(df, order, _is_dynamic(df))

    def with_df(self, df: DataFrame, **changes) -> Items:
        return replace(self, df=df, **changes)

    # --- shape -------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(HIDDEN)]

    def dtype(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def field(self, path: str, item: Column | None = None) -> Field:
        """Look up a dotted path; a leading ``item.`` is dropped. Names match
        exactly, arrays are opaque, anything not there is missing. ``item``
        stands in for the column of a dynamic item."""
        segments = strip_item(path).split(".")
        if self.dynamic:
            root = quoted(DYNAMIC_COLUMN) if item is None else item
            return _descend(root, DYNAMIC_TYPE, segments)
        if segments[0] not in self.columns:
            return missing()
        return _descend(quoted(segments[0]), self.dtype(segments[0]), segments[1:])

    def fresh_hidden(self, count: int) -> list[str]:
        taken = set(self.df.columns)
        names, i = [], 0
        while len(names) < count:
            if f"{HIDDEN}{i}" not in taken:
                names.append(f"{HIDDEN}{i}")
            i += 1
        return names

    def sort_columns(self) -> list[Column]:
        return [key.sort_column() for key in self.order]

    def require_batch(self, step: str) -> None:
        if self.df.isStreaming:
            raise ValueError(f"{step} needs the whole input and cannot run on a stream")

    # --- results -----------------------------------------------------------

    def to_df(self) -> DataFrame:
        """The records in no particular order (no sort, no shuffle)."""
        return self.df.select(*[quoted(c) for c in self.columns])

    def ordered(self) -> DataFrame:
        """The records sorted by the arrival order."""
        df = self.df.orderBy(*self.sort_columns()) if self.order else self.df
        return df.select(*[quoted(c) for c in self.columns])

    def positions(self, name: str = "pos") -> DataFrame:
        """The records with their 1-based place in the order as a column."""
        from rivulet.operators.order import numbered

        return numbered(self, name).select(name, *[quoted(c) for c in self.columns])

    def checkpoint(self) -> Items:
        """The same items, computed now and kept in the cluster's checkpoint
        folder, for a costly result that several later steps read."""
        from rivulet.session import checkpointed

        return self.with_df(checkpointed(self.df))

    # --- steps -------------------------------------------------------------

    def pipe(self, step: Callable[..., Items], *args, **kwargs) -> Items:
        return step(self, *args, **kwargs)

    def filter(self, rules, mode="permit", match="all", now=None) -> Items:
        from rivulet.operators.filter import filter_items

        return filter_items(self, rules, mode, match, now)

    def regex(self, field, pattern, mode="replace", replacement="") -> Items:
        from rivulet.operators.regex import regex

        return regex(self, field, pattern, mode, replacement)

    def transform(self, ops) -> Items:
        from rivulet.operators.transform import transform

        return transform(self, ops)

    def sort(self, by, order="asc", compare="auto") -> Items:
        from rivulet.operators.order import sort

        return sort(self, by, order, compare)

    def limit(self, n) -> Items:
        from rivulet.operators.order import limit

        return limit(self, n)

    def tail(self, n) -> Items:
        from rivulet.operators.order import tail

        return tail(self, n)

    def reverse(self) -> Items:
        from rivulet.operators.order import reverse

        return reverse(self)

    def unique(self, by) -> Items:
        from rivulet.operators.unique import unique

        return unique(self, by)

    def union(self, *others: Items) -> Items:
        from rivulet.operators.union import union

        return union([self, *others])

    # --- forms -------------------------------------------------------------

    def to_dynamic(self) -> Items:
        """The same items as ``item MAP<STRING, VARIANT>``; NULL columns become
        absent keys."""
        if self.dynamic:
            return self
        entries = []
        for name in self.columns:
            field = self.field_of_column(name)
            value = field.value
            if isinstance(field.dtype, views.MOMENTS):
                value = field.text
            elif isinstance(field.dtype, (T.StructType, T.MapType)):
                value = F.parse_json(field.text)
            if not isinstance(field.dtype, T.VariantType):
                value = value.cast("variant")
            entries.append(
                F.when(
                    field.present, F.struct(F.lit(name).alias("key"), value.alias("value"))
                )
            )
        item = F.map_from_entries(F.array_compact(F.array(*entries)))
        df = self.df.select(item.alias(DYNAMIC_COLUMN), *[quoted(h) for h in self.hidden])
        return self.with_df(df, dynamic=True)

    def to_typed(self, schema: str | T.StructType) -> Items:
        """Typed columns picked from dynamic items. Text columns take the text
        view, numeric columns the number view, timestamps the date view."""
        if not self.dynamic:
            raise ValueError("items are typed already")
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        columns = []
        for wanted in schema.fields:
            field = _descend(quoted(DYNAMIC_COLUMN), DYNAMIC_TYPE, [wanted.name])
            kind = wanted.dataType
            if isinstance(kind, T.StringType):
                value = field.text
            elif isinstance(kind, views.INTEGRAL):
                exact = F.try_variant_get(field.value, "$", "bigint")
                value = F.coalesce(exact, field.number.try_cast("bigint")).try_cast(kind)
            elif isinstance(kind, views.NUMERIC):
                value = field.number.try_cast(kind)
            elif isinstance(kind, views.MOMENTS):
                value = field.moment.cast(kind)
            elif isinstance(kind, T.VariantType):
                value = field.value
            else:
                value = F.try_variant_get(field.value, "$", kind.simpleString())
            columns.append(value.alias(wanted.name))
        df = self.df.select(*columns, *[quoted(h) for h in self.hidden])
        return self.with_df(df, dynamic=False)

    def field_of_column(self, name: str) -> Field:
        return Field(quoted(name), self.dtype(name))


def _is_dynamic(df: DataFrame) -> bool:
    data = [f for f in df.schema.fields if not f.name.startswith(HIDDEN)]
    return len(data) == 1 and data[0].name == DYNAMIC_COLUMN and data[0].dataType == DYNAMIC_TYPE
