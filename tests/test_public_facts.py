"""The report-to-facts plan: few splits, rows and order."""

from pyspark.sql import functions as F

from caseflow.columns import REPORT_CELL_COLS
from caseflow.operators.reshape import unpivot_compound
from caseflow.plans import bindings
from caseflow.plans.public_facts import public_facts


def _rows(n):
    return [(f"{name} " + " ".join(str(i * 1000 + c) if c % 5 else "D" for c in range(20)), f"i821_fy2{i % 2}.txt")
            for i in range(n) for name in ("Haiti", "Peru")]


def test_lines_of_one_split_are_parsed_once_and_sorted(spark):
    seen = spark.sparkContext.accumulator(0)
    lines = spark.sparkContext.parallelize(_rows(30), 1).map(lambda r: (seen.add(1), r)[1]).toDF("line string, source_file string")
    got = [tuple(r) for r in public_facts(lines, sort=True).collect()]
    assert seen.value == 60                                  # the sort's sample doesn't read and parse the lines again
    plain = [tuple(r) for r in public_facts(spark.createDataFrame(_rows(30), "line string, source_file string")).collect()]
    assert len(got) == 60 * 20 and sorted(got, key=str) == sorted(plain, key=str)
    keys = [(r[0], r[1] is None, r[1] or 0, r[3], r[4]) for r in got]
    assert keys == sorted(keys)
    assert (2020, 1, "Q1", "Haiti", "approved", 1.0, None, "i821_fy20.txt") in got
    assert (2020, None, "FY", "Peru", "approved", 17.0, None, "i821_fy20.txt") in got
    assert (2021, 1, "Q1", "Peru", "received", None, "D", "i821_fy21.txt") in got


def test_report_rows_of_one_file_go_to_many_tasks(spark, tmp_path):
    (spark.range(2000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), F.col("id") % 7).alias("p_name"),
                              (F.col("id") % 50).cast("int").alias("p_size"))
          .coalesce(1).write.parquet(f"{tmp_path}/part.parquet"))
    for frame in (bindings.report_lines(spark, str(tmp_path)), bindings.report_grid(spark, str(tmp_path))):
        per_task = [r["count"] for r in frame.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(per_task) == 2000 and max(per_task) < 1000


def test_names_are_split_in_the_plan(spark):
    df = spark.createDataFrame([("x", *map(str, range(20)))], ["id", *REPORT_CELL_COLS])
    long = unpivot_compound(df, ["id"], derive={"n": lambda period, metric: F.length(F.concat(period, metric))})
    assert "split(" not in long._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.period, r.metric): (r.n, r.value) for r in long.collect()}
    assert got == {tuple(c.split(".")): (len(c) - 1, str(i)) for i, c in enumerate(REPORT_CELL_COLS)}
