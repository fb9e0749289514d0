"""Property tests on random small case tables: many NULLs, ties, one hot person.

* the sweep panel equals the explode panel (both modes);
* the aggregate-and-join episode flags equal the reference's single sorted window
  (lag + running sum per person, then row_number/count per episode);
* skew-safe running approvals equal a plain per-person running window.
"""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import CASE_SCHEMA
from caseflow.operators import panel as P
from caseflow.operators.episodes import flag_duplicates, running_approvals

BASE = dt.date(2020, 1, 1)
maybe_day = st.one_of(st.none(), st.integers(0, 40))
row = st.tuples(
    st.one_of(st.none(), st.sampled_from(["hot", "a", "b", "c"])),   # person
    maybe_day,                                                      # rec_date offset
    maybe_day,                                                      # decision_date offset
    st.one_of(st.none(), st.sampled_from(["Approved", "Denied", "Pending"])),
    st.one_of(st.none(), st.sampled_from(["X", "Y"])),              # country
    st.sampled_from(["f1", "f2"]),                                  # source file
)
tables = st.lists(row, min_size=1, max_size=40)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def to_df(spark, rows):
    def d(o):
        return None if o is None else BASE + dt.timedelta(days=o)
    data = [(p, d(r), d(x), dec, c, "C3", None, f, i + 1) for i, (p, r, x, dec, c, f) in enumerate(rows)]
    return spark.createDataFrame(data, CASE_SCHEMA)


def window_flags(df, within):
    """The reference's formulation, as one sorted window per person."""
    nona = F.coalesce("unique_identifier", F.concat(F.lit("noid_"), "file_original", F.lit("#"),
                                                    F.col("row_original").cast("string")))
    order = [F.col("rec_date").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in within],
             "file_original", "row_original"]
    w = Window.partitionBy("_nona").orderBy(*order)
    x = df.withColumn("_nona", nona)
    x = x.withColumn("_chg", F.when(F.col("rec_date").isNotNull() & F.lag("rec_date").over(w).isNotNull()
                                    & (F.col("rec_date") == F.lag("rec_date").over(w)), 0).otherwise(1))
    x = x.withColumn("duplicate_identifier",
                     F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    we = Window.partitionBy("_nona", "duplicate_identifier")
    x = (x.withColumn("duplicate_last", F.row_number().over(we.orderBy(*order)) == F.count("*").over(we))
          .withColumn("duplicate_likely", F.when(F.col("unique_identifier").isNull() | F.col("rec_date").isNull(),
                                                 F.lit(None)).otherwise(F.count("*").over(we) > 1)))
    return x.select("row_original", "duplicate_identifier", "duplicate_last", "duplicate_likely")


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@SETTINGS
@given(rows=tables)
def test_sweep_equals_explode(spark, rows):
    df = to_df(spark, rows)
    dates = spark.createDataFrame([(BASE + dt.timedelta(days=k),) for k in range(0, 45, 4)], "report_date date")
    for mode in ("faithful", "strict"):
        assert same(P.snapshot_panel(df, dates, method="sweep", mode=mode),
                    P.snapshot_panel(df, dates, method="explode", mode=mode))


@SETTINGS
@given(rows=tables)
def test_episode_flags_equal_single_window(spark, rows):
    df = to_df(spark, rows)
    for order, within in (("tps", ["decision_date"]), ("daca", [])):
        got = flag_duplicates(df, order=order).select("row_original", "duplicate_identifier",
                                                      "duplicate_last", "duplicate_likely")
        assert same(got, window_flags(df, within))


@SETTINGS
@given(rows=tables)
def test_running_approvals_equal_person_window(spark, rows):
    df = to_df(spark, rows)
    w = (Window.partitionBy("unique_identifier")
         .orderBy(F.col("decision_date").asc_nulls_last(), F.col("rec_date").asc_nulls_last(),
                  "file_original", "row_original").rowsBetween(Window.unboundedPreceding, 0))
    nulls = F.sum(F.col("decision").isNull().cast("long")).over(w)
    appr = F.sum(F.coalesce((F.col("decision") == "Approved").cast("long"), F.lit(0))).over(w)
    ref = df.select("row_original", F.when(F.col("unique_identifier").isNull() | (nulls > 0), F.lit(None))
                    .otherwise(appr).alias("n_approvals"))
    assert same(running_approvals(df).select("row_original", "n_approvals"), ref)
