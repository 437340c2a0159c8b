"""Every registered query beside its SQL check, and the shape of the registry."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
CORPUS = r"op\d+_|pipeline$"
SQL = {name: sql for name, sql in entry.oracle_sql().items() if not re.match(CORPUS, name)}
# Operators per group in the blueprint.
GROUPS = {"a": 12, "b": 8, "c": 6, "d": 6, "e": 10, "f": 7, "g": 15, "h": 5, "i": 5, "j": 17, "l": 1}


@pytest.fixture(scope="module")
def duck():
    return check.duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert re.match(r"ok \d+", check.compare(spark, duck, SF, name, entry.queries()[name], SQL[name]))


def test_every_operator_is_registered():
    have = {re.match(r"[a-l]\d+", name).group() for name in entry.queries() if not re.match(CORPUS, name)}
    assert have == {f"{g}{i}" for g, n in GROUPS.items() for i in range(1, n + 1)}


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:5] == ["symbol", "date", "close", "adj_close", "volume"]
    assert df.count() > 4000
