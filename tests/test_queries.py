import duckdb
import pytest

import check
from __spark_entry__ import entry
from oracle.sql import ORACLE
from payouts.plans.star_queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


def test_entry_runs(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["machine_base", "commission_rules", "paid_summary", "incentive_summary", "cen_report",
                                  "receivable_lookup", "invoice_lookup", "source_reconciliation"])
def test_query_equals_sql(spark, con, name):
    verdict, _ = check.compare(spark, con, name, FOLDER)
    assert verdict.startswith("ok"), verdict
