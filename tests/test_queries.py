"""Every registered query against its SQL on the driver's small tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from tests.compare import differences, duck
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) == []


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows[-1]["agency"] == "Column_Total"
    assert sum(r["Row_Total"] for r in rows[:-1]) == rows[-1]["Row_Total"] > 0
