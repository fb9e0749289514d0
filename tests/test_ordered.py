"""Global positions against a sort in the driver."""

import random

from pyspark.sql import functions as F

from caseflow.operators.ordered import blocks_in_order, with_position


def test_positions_are_those_of_a_global_sort(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2, 2, 2, 3]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(7)
    got = {r.i: r.position for r in with_position(df, [F.col("k").desc_nulls_last(), F.col("i")]).collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [got[i] for _, i in want] == list(range(5000))


def test_a_hot_key_is_split_over_blocks(spark):
    df = spark.range(0, 20000, 1, 6).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # small blocks stay apart
    try:
        b = blocks_in_order(df.filter("k = 1").unionByName(df.filter("k = 0").limit(10)), [F.col("k"), F.col("id")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in b.groupBy("_block").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < sum(sizes) / 2


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "k int, i int")
    assert with_position(df, [F.col("k")]).collect() == []
