"""Ordered item pipelines on Spark DataFrames."""

from rivulet.items import Items, OrderKey
from rivulet.operators import union

__all__ = ["Items", "OrderKey", "union"]
