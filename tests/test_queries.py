"""Every registered core query beside its SQL on the smallest dataset; those without SQL have their expectations in test_expectations."""

import pytest
from pyspark.sql import functions as F

from tallyfold.plans import catalogue

from .harness import oracle_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, name):
    columns, rows = spark_rows(catalogue.QUERIES[name](spark, FOLDER))
    expected_columns, expected = oracle_rows(FOLDER, catalogue.ORACLES[name])
    assert columns == expected_columns
    assert rows == expected


def test_p3_found_beyond_gaps(spark, tmp_path):
    """Numbers that never came hold nothing: the ledger twice, the second time under other ids, and without some of its events."""
    ledger = spark.read.parquet(f"{FOLDER}/ledger.parquet")
    ids = [c for c in ledger.columns if c.startswith("truth_") or c == "supersedes_event_id"]
    again = ledger.withColumns({c: F.when(F.col(c) != 0, F.col(c) + 2**32) for c in ids})
    ledger.unionByName(again).where(F.col("truth_event_id") % 50 != 7).write.parquet(f"{tmp_path}/ledger.parquet")
    _, rows = spark_rows(catalogue.QUERIES["p3_found"](spark, str(tmp_path)))
    _, expected = oracle_rows(str(tmp_path), catalogue.ORACLES["p3_found"])
    assert len(rows) > 100
    assert rows == expected


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p3_found", "p4_found", "p5_found", "p6_found"} <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["level", "unit", "persons", "households", "children", "elders", "median_income", "mean_income", "tertiary_share"]
