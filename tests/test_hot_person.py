"""One person with a third of the rows: values equal one sorted window per person, and no window of the
plans holds that person's history."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import CASE_SCHEMA
from caseflow.operators import ranking
from caseflow.operators.episodes import flag_duplicates, initial_renewal, running_approvals
from test_properties import same, window_flags

N, FILES, DAYS, R = 3000, 3, 25, 40


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(9)
    day = [None, *(dt.date(2021, 1, 1) + dt.timedelta(days=d) for d in range(DAYS))]
    rows = []
    for i in range(N):
        person = "hot" if i % 3 == 0 else rng.choice([None, *map(str, range(N // 4))])
        late = dt.date(2023, 1, 1) if rng.random() < 0.01 else rng.choice(day)
        decision = rng.choice(["Approved", "Denied", "Pending"]) if late != dt.date(2023, 1, 1) else None
        rows.append((person, rng.choice(day), late, decision, "X", rng.choice(["C3", "C3", "ELIS", None]), "f",
                     f"f{rng.randrange(FILES)}", i))
    return spark.createDataFrame(rows, CASE_SCHEMA).repartition(6)


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", R)
    for f in (ranking.running_within, ranking.row_range, ranking.row_number_within):
        names = f.__code__.co_varnames[:f.__code__.co_argcount]
        at = names.index("rows_per_bucket") - f.__code__.co_argcount
        monkeypatch.setattr(f, "__defaults__", tuple(R if i == at % len(f.__defaults__) else d
                                                     for i, d in enumerate(f.__defaults__)))


def reference(df):
    w = (Window.partitionBy("unique_identifier")
         .orderBy(F.col("decision_date").asc_nulls_last(), F.col("rec_date").asc_nulls_last(), "file_original", "row_original")
         .rowsBetween(Window.unboundedPreceding, 0))
    c3 = df.filter("data_source = 'C3' AND unique_identifier IS NOT NULL")
    c3 = c3.select("row_original", "data_source", F.sum(F.col("decision").isNull().cast("int")).over(w).alias("n"),
                   F.sum(F.coalesce((F.col("decision") == "Approved").cast("int"), F.lit(0))).over(w).alias("a"))
    filled = c3.select("row_original", F.expr("CASE WHEN n > 0 THEN NULL WHEN a <= 1 THEN 'DACA - Initial' "
                                              "ELSE 'DACA - Renewal' END").alias("form_type_filled_in"))
    return filled.unionAll(df.filter("data_source = 'ELIS' OR unique_identifier IS NULL").select("row_original", "form_type"))


def test_values(cases):
    for order, within in (("tps", ["decision_date"]), ("daca", [])):
        got = flag_duplicates(cases, order=order)
        assert same(got.select("row_original", "duplicate_identifier", "duplicate_last", "duplicate_likely"),
                    window_flags(cases, within))
    assert same(initial_renewal(cases).select("row_original", "form_type_filled_in"), reference(cases))
    flagged = flag_duplicates(cases, order="daca", history=cases)
    assert same(initial_renewal(flagged, history=cases).select("row_original", "form_type_filled_in"), reference(cases))


def windows(df):
    """Partition keys of every window of the plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.sub(r"#\d+L?", "", m) for m in re.findall(r"Window \[.*?\], \[([^\]]*)\]", plan)]


def test_no_window_holds_a_history(cases):
    plans = [flag_duplicates(cases, order="tps"), running_approvals(cases), initial_renewal(cases)]
    for df in plans:
        for keys in windows(df):
            # rows only inside a bucket; else a table of one row per bucket or per leading key
            assert keys in ("_bkey", "i", "i, d", "g0", "g0, b0"), keys
    # what those windows hold, the hot person's: all bounded by days, files and row ranges, not by rows
    ranges = N // R + 1
    hot = cases.filter("unique_identifier = 'hot'").withColumn("r", ranking.row_range("row_original", R))
    assert hot.count() >= N / 3
    bucket = hot.groupBy("rec_date", "decision_date", "file_original", "r").count()
    assert bucket.agg(F.max("count")).first()[0] <= R
    assert hot.groupBy("decision_date").count().count() <= DAYS + 2
    per_date = (hot.select("decision_date", "rec_date", "file_original", "r").distinct().groupBy("decision_date").count()
                .agg(F.max("count")).first()[0])
    assert per_date <= (DAYS + 1) * FILES * ranges and per_date < hot.count() / 5


def test_plans_read_their_input_twice(cases):
    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans(flag_duplicates(cases)) == 2
    assert scans(running_approvals(cases)) <= 3          # totals of dates and of buckets share one exchange
    assert "Union" not in initial_renewal(cases)._jdf.queryExecution().optimizedPlan().toString()
