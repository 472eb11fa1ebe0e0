"""Every registered query against its SQL on a second engine."""

from __future__ import annotations

import pytest
from compare import as_frame, database, rows_of, sql_frame

import __spark_entry__ as entry_points
from evalspark.plans.queries import REGISTRY

ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return database(sf_dir)


def test_every_query_has_sql():
    assert set(ORACLES) >= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, duck, sf_dir, name):
    ours = as_frame(entry_points.queries()[name](spark, sf_dir))
    theirs = sql_frame(duck, ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
