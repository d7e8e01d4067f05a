"""Registered queries against their SQL. All of them with MASKWEAVE_ALL=1, else every ninth."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

FOLDER = os.environ.get("MASKWEAVE_SF_DIR", "/root/testdata/sf0.001")
NAMES = list(entry.queries())
CHOSEN = NAMES if os.environ.get("MASKWEAVE_ALL") else NAMES[::9]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name)) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
