"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as registered
from check_oracle import compare, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query(spark, con, name):
    problem, _ = compare(spark, con, SF, name)
    assert problem is None, problem


def test_every_query_has_sql():
    plain = {name for module in registered.MODULES for name in module.QUERIES if module not in registered.EXTRA}
    assert plain <= set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    assert registered.entry(spark).count() == 25
