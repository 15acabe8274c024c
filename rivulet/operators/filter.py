"""filter: keep or drop items by rules."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from rivulet.functions.views import let
from rivulet.items import DYNAMIC_COLUMN, Items, quoted
from rivulet.operators.rules import predicate


def filter_items(
    items: Items,
    rules: str | Sequence[str] | None,
    mode: str = "permit",
    match: str = "all",
    now: datetime | None = None,
) -> Items:
    """Keep (``permit``) or drop (``block``) the items that satisfy all or any of
    ``rules``. No rules at all keep everything, even under ``block``.

    ``now`` is read once, when the step is composed, and becomes a literal.
    """
    if isinstance(rules, str):
        rules = [rules]
    now = now or datetime.now(timezone.utc)
    if now.tzinfo is None:
        now = now.replace(tzinfo=timezone.utc)
    for rule in rules or []:
        if not isinstance(rule, str):
            raise ValueError(f"rule `{rule}` is not a string")
    if not rules:
        return items
    if mode not in ("permit", "block"):
        raise ValueError(f"mode must be `permit` or `block`, not `{mode}`")
    if match not in ("all", "any"):
        raise ValueError(f"match must be `all` or `any`, not `{match}`")
    combine = and_ if match == "all" else or_

    def satisfied(item: Column | None) -> Column:
        return reduce(combine, [predicate(items, rule, now, item) for rule in rules])

    # Spark evaluates a pushed-down predicate on what makes up the item, once
    # per mention, so a dynamic item is put together once for all rules.
    hit = let(quoted(DYNAMIC_COLUMN), satisfied) if items.dynamic else satisfied(None)
    if mode == "block":
        hit = ~F.coalesce(hit, F.lit(False))
    return items.with_df(items.df.where(hit))
