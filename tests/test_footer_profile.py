"""P1 from Parquet footers: answers equal the data scan's, and that scan reads undecided columns only."""

import re

from pyspark.sql import functions as F

from caseflow.operators.profile import drop_uninformative, footer_counts, footer_profile, informative_columns
from caseflow.plans.bindings import staged_cases

SF = "/root/testdata/sf0.001"


def test_footers_agree_with_the_scan(spark, tmp_path):
    path = f"{tmp_path}/staged"
    staged_cases(spark, SF).withColumn("nothing", F.lit(None).cast("date")).withColumn("list", F.array("decision")) \
        .repartition(5).write.parquet(path)
    df = spark.read.parquet(path)
    known = footer_profile(spark, path, df.schema)
    scanned = informative_columns(df)
    assert known == {c: scanned[c] for c in known}
    assert known["notes_blank"] is False and known["nothing"] is False and known["rec_date"] is True
    assert "decision" not in known and "notes_redacted" not in known and "list" not in known
    assert drop_uninformative(df, known=known).columns == drop_uninformative(df).columns


def test_an_empty_dataset(spark, tmp_path):
    path = f"{tmp_path}/none"
    spark.createDataFrame([], "a string, b int").write.parquet(path)
    df = spark.read.parquet(path)
    assert footer_profile(spark, path, df.schema) == {"a": False, "b": False}
    assert drop_uninformative(df, keep=["b"], known=footer_profile(spark, path, df.schema)).columns == ["b"]


def test_counts_come_from_footers_and_the_scan_is_pruned(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/staged"
    staged_cases(spark, SF).write.parquet(path)
    df = spark.read.parquet(path)
    s = spark.newSession()
    s.conf.set("spark.sql.sources.useV1SourceList", "")
    s.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    plan = footer_counts(s, path, df.schema, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "count(notes_blank)" in plan.lower() and "BatchScan" in plan
    known, plans = footer_profile(spark, path, df.schema), []
    agg = type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *a: (lambda r: plans.append(r) or r)(agg(self, *a)))
    drop_uninformative(df, known=known)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    read = re.search(r"ReadSchema: struct<(.*?)>", plans[-1]._jdf.queryExecution().executedPlan().toString()).group(1)
    names = {c.split(":")[0] for c in read.split(",")}
    assert names and not names & known.keys()
