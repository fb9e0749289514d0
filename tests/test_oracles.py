"""Every registered query against its DuckDB oracle (sf0.001; the driver uses sf0.01)."""

import pytest

import __spark_entry__ as E
from caseflow.plans import catalog
from harness import compare, duck, spark_pdf

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    got = spark_pdf(df)
    if name not in ORACLES:
        pytest.skip("no SQL oracle (rows-only)")
    ok, msg = compare(got, duck(ORACLES[name], SF))
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["ben_country_of_birth", "quarter", "approved_within_6", "approved_within_12",
                          "approved_within_18"]


def test_every_library_query_has_an_oracle():
    """Queries added by an optional subpackage may have no SQL (trained models); the library's own all do."""
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(ORACLES) <= set(QUERIES)
