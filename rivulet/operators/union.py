"""union: concatenate streams in wire order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from rivulet.functions import views
from rivulet.items import HIDDEN, Items, OrderKey, quoted, refuse_case_twins


@dataclass(frozen=True)
class _Slot:
    dtype: T.DataType
    descending: bool
    nulls_last: bool


def union(streams: Sequence[Items]) -> Items:
    """All items of every stream, first stream first; duplicates stay.

    No shuffle: the order becomes (stream number, that stream's own order).
    Keys are matched by name. Where one key has different types, integers and
    floats each widen among themselves, and all else meets as text; streams of
    dynamic items keep every value as it is.
    """
    if not streams:
        raise ValueError("union needs at least one stream")
    if len(streams) == 1:
        return streams[0]
    if any(s.dynamic for s in streams):
        streams = [s.to_dynamic() for s in streams]

    slots, places = _order_slots(streams)
    wire = f"{HIDDEN}0"
    slot_names = [f"{HIDDEN}{i + 1}" for i in range(len(slots))]
    columns = _merged_columns(streams)
    refuse_case_twins(streams[0].df.sparkSession, columns)

    merged = None
    for number, (stream, place) in enumerate(zip(streams, places)):
        data = [_aligned(stream, name, dtype) for name, dtype in columns.items()]
        own = dict(zip(place, stream.order))
        keys = [
            (quoted(own[i].column) if i in own else F.lit(None)).cast(slot.dtype).alias(name)
            for i, (slot, name) in enumerate(zip(slots, slot_names))
        ]
        df = stream.df.select(*data, F.lit(number).alias(wire), *keys)
        merged = df if merged is None else merged.unionByName(df)

    order = (OrderKey(wire),) + tuple(
        OrderKey(name, slot.descending, slot.nulls_last)
        for slot, name in zip(slots, slot_names)
    )
    bounds = [s.max_rows for s in streams]
    bound = None if None in bounds else sum(bounds)
    return Items(merged, order, streams[0].dynamic, bound)


def _order_slots(streams: Sequence[Items]) -> tuple[list[_Slot], list[list[int]]]:
    """Order columns of the merged stream. Rows of different streams never
    compare beyond the stream number, so streams whose keys have the same type
    and direction share a column; within a stream unused columns are all NULL."""
    slots: list[_Slot] = []
    places = []
    for stream in streams:
        place, start = [], 0
        for key in stream.order:
            want = _Slot(stream.dtype(key.column), key.descending, key.nulls_last)
            at = next((i for i in range(start, len(slots)) if slots[i] == want), None)
            if at is None:
                slots.append(want)
                at = len(slots) - 1
            place.append(at)
            start = at + 1
        places.append(place)
    return slots, places


def _merged_columns(streams: Sequence[Items]) -> dict[str, T.DataType]:
    columns: dict[str, T.DataType] = {}
    for stream in streams:
        for name in stream.columns:
            have = stream.dtype(name)
            columns[name] = views.common_type(columns.get(name, have), have)
    return columns


def _aligned(stream: Items, name: str, dtype: T.DataType) -> Column:
    if name not in stream.columns:
        return F.lit(None).cast(dtype).alias(name)
    return views.as_type(quoted(name), stream.dtype(name), dtype).alias(name)
