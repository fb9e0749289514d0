"""End to end: release files -> stage -> clean -> panel -> facts, on data derived from
the sf0.001 tables (written under pytest's temporary folder)."""

from pyspark.sql import functions as F

from caseflow.columns import FORMS
from caseflow.plans import workflow as W
from caseflow.plans.bindings import published_wide, report_lines, staged_cases, table

SF = "/root/testdata/sf0.001"


def test_stage_clean_panel_facts(spark, tmp_path):
    root = str(tmp_path)
    # a release: staged-like rows as text, split over two TPS files
    raw = staged_cases(spark, SF).drop("file_original", "row_original")
    raw = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns], F.col("unique_alien_id").alias("_k"))
    prefix = FORMS["i821"][0]
    part = F.coalesce(F.length("_k"), F.lit(0)) % 2 == 0
    raw.filter(part).drop("_k").write.parquet(f"{root}/release/{prefix}1 redacted.parquet")
    raw.filter(~part).drop("_k").write.parquet(f"{root}/release/{prefix}2 redacted.parquet")
    n_raw = raw.count()

    W.stage(spark, f"{root}/release", f"{root}/staging")
    staged = spark.read.parquet(f"{root}/staging/form_id=i821")
    assert staged.count() == n_raw
    assert dict(staged.dtypes)["rec_date"] == "date"

    nation = table(spark, SF, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"),
                                              F.col("n_name").alias("name"))
    nation.write.option("header", True).csv(f"{root}/codes")
    names = W.clean(spark, f"{root}/staging", "i821", f"{root}/codes", f"{root}/out")
    cleaned = spark.read.parquet(f"{root}/out/tps-latest")
    kept = ["unique_alien_id", "rec_date", "decision_date", "decision", "data_source", "ben_country_of_birth",
            "ben_gender", "form_type", "ben_year_of_birth", "notes_one"]
    empty = F.lit(True)
    for c in kept:
        empty = empty & F.col(c).isNull()
    n_empty = raw.filter(empty).count()
    assert n_empty > 0
    assert cleaned.count() == n_raw - n_empty
    assert names and all(n.startswith("TPS FY") for n in names)

    published_wide(spark, SF).write.option("header", True).csv(f"{root}/published")
    W.panel(spark, f"{root}/out/tps-latest", f"{root}/published", f"{root}/panel")
    assert spark.read.parquet(f"{root}/panel/panel_quarterly").count() > 0
    sources = {r[0] for r in spark.read.parquet(f"{root}/panel/panel_vs_published").select("source").distinct().collect()}
    assert sources == {"CRS", "approved_within_6", "approved_within_12", "approved_within_18"}

    quarterly = spark.read.parquet(f"{root}/panel/quarterly_vs_published")
    panel = spark.read.parquet(f"{root}/panel/panel_quarterly")
    total = F.sum("approved_within_12").cast("double")
    want = {r[0]: r[1] for r in panel.groupBy("quarter").agg(total).collect()}
    got = {r[0]: r[1] for r in quarterly.filter("source = 'approved_within_12'").groupBy("report_date")
           .agg(F.sum("value")).collect()}
    assert got == want and quarterly.filter("source = 'CRS'").count() > 0

    report_lines(spark, SF).select("line", "source_file").write.partitionBy("source_file").text(f"{root}/reports")
    W.facts(spark, f"{root}/reports", f"{root}/facts")
    f = spark.read.parquet(f"{root}/facts")
    assert f.count() > 0 and set(f.columns) >= {"fiscal_year", "quarter", "country", "metric", "value", "code"}
