"""Invariants over the derived test views (sf0.001): plan equivalences and counts."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from caseflow.functions.text import repair_mojibake
from caseflow.operators.episodes import flag_duplicates
from caseflow.operators.lookup import lookup_left
from caseflow.operators.ranking import row_number_within
from caseflow.plans import person_panel as PP
from caseflow.plans.bindings import cases, nation_code_table, staged_cases, table
from caseflow.functions.dates import fiscal_year
from caseflow.sources.sinks import fiscal_year_units

SF = "/root/testdata/sf0.001"


def test_sweep_equals_explode(spark):
    c = cases(spark, SF)
    for mode in ("faithful", "strict"):
        a = PP.quarterly_panel(c, "sweep", mode)
        b = PP.quarterly_panel(c, "explode", mode)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_thresholds_nest(spark):
    p = PP.quarterly_panel(cases(spark, SF))
    bad = p.filter((F.col("approved_within_6") > F.col("approved_within_12"))
                   | (F.col("approved_within_12") > F.col("approved_within_18")))
    assert p.count() > 0 and bad.count() == 0


def test_lookup_keeps_row_count(spark):
    s = staged_cases(spark, SF)
    assert lookup_left(s, nation_code_table(spark, SF), "ben_country_of_birth").count() == s.count()


def test_drop_count_equals_group_surplus(spark):
    f = flag_duplicates(cases(spark, SF, monthly=True))
    groups = (f.filter(F.col("duplicate_likely"))
               .groupBy("unique_identifier", "duplicate_identifier").count()
               .agg(F.sum(F.col("count") - 1)).first()[0])
    assert f.filter("duplicate_drop_row").count() == groups


def test_repair_inverts_corruption(spark):
    d = table(spark, SF, "documents")
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    assert d.filter(repair_mojibake(broken) != F.col("text")).count() == 0


@pytest.mark.parametrize("buckets,rows_per_bucket", [(["f"], 1_000_000), (["o_orderpriority", "f"], 1_000_000),
                                                     (["f"], 7), (["o_orderpriority", "f"], 3)])
def test_row_number_within_matches_window(spark, buckets, rows_per_bucket):
    o = table(spark, SF, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority",
                                         (F.col("o_custkey") % 7).cast("string").alias("f"))
    a = row_number_within(o, ["o_orderstatus"], buckets, "o_orderkey", out="rn", rows_per_bucket=rows_per_bucket)
    w = Window.partitionBy("o_orderstatus").orderBy(*[F.col(b).asc_nulls_last() for b in buckets], "o_orderkey")
    b = o.withColumn("rn", F.row_number().over(w))
    assert a.count() == b.count() and a.select(b.columns).exceptAll(b).count() == 0


def chunk_window_reference(df, max_rows):
    """The single-window form of W8 (one task per fiscal year): an oracle only."""
    w = Window.partitionBy("fy").orderBy("file_original", "row_original")
    return (df.withColumn("fy", fiscal_year("rec_date"))
              .withColumn("chunk", F.ceil(F.row_number().over(w) / F.lit(max_rows)).cast("int")))


def test_fiscal_chunks_match_window(spark):
    c = cases(spark, SF)
    a = fiscal_year_units(c, max_rows=100).select("row_original", "fy", "chunk")
    b = chunk_window_reference(c, max_rows=100).select("row_original", "fy", "chunk")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
