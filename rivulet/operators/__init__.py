"""Steps: functions from items to items."""

from rivulet.operators.filter import filter_items
from rivulet.operators.order import limit, numbered, reverse, sort, tail
from rivulet.operators.regex import regex
from rivulet.operators.transform import transform
from rivulet.operators.union import union
from rivulet.operators.unique import unique

__all__ = [
    "filter_items",
    "limit",
    "numbered",
    "regex",
    "reverse",
    "sort",
    "tail",
    "transform",
    "union",
    "unique",
]
