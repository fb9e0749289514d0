"""Write-audit-publish: lost rows leave no output and keep the earlier one; verbs logged from one write; order read back."""

import os

import pytest
from pyspark.sql import functions as F

from caseflow.operators.quality import ChangeLog, CountMismatch
from caseflow.plans import clean
from caseflow.plans.bindings import nation_code_table, staged_cases
from caseflow.plans.clean import clean_cases, output_order
from caseflow.sources.sinks import publish, read_ordered, write_ordered, write_parquet

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("staged"))
    write_parquet(staged_cases(spark, SF), path)
    return spark.read.parquet(path)


def rows(spark, path):
    return spark.read.parquet(path).count()


@pytest.mark.parametrize("form", ["tps", "daca"])
def test_published_with_its_log(spark, staged, tmp_path, form):
    log, out = ChangeLog(), f"{tmp_path}/out"
    df = clean_cases(staged, nation_code_table(spark, SF), form=form, check=False, log=log)
    publish(df, out, log)
    want = clean_cases(staged, nation_code_table(spark, SF), form=form)
    got = spark.read.parquet(out)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == want.count()
    steps = {r["verb"]: r for r in log.rows()}
    assert steps["staged"]["rows_out"] == staged.count() and steps["drop_empty_rows"]["rows_out"] == got.count()
    assert steps["flag_duplicates"]["added"].startswith("duplicate_drop_row")
    assert (form == "daca") == ("initial_renewal" in steps)
    assert os.listdir(tmp_path) == ["out"]


@pytest.mark.parametrize("form,verb", [("tps", "flag_duplicates"), ("daca", "flag_duplicates"), ("daca", "initial_renewal")])
def test_lost_rows_leave_no_output(spark, staged, tmp_path, monkeypatch, form, verb):
    right = getattr(clean, verb)
    monkeypatch.setattr(clean, verb, lambda df, **k: right(df, **k).filter("coalesce(row_original, 0) % 50 <> 1"))
    out = f"{tmp_path}/out"
    for earlier in (False, True):
        if earlier:
            spark.range(3).write.parquet(out)
        log = ChangeLog()
        df = clean_cases(staged, nation_code_table(spark, SF), form=form, check=False, log=log)
        with pytest.raises(CountMismatch, match=verb):
            publish(df, out, log)
        assert os.listdir(tmp_path) == (["out"] if earlier else [])
        assert not earlier or rows(spark, out) == 3


def test_rows_of_no_branch_are_caught_by_the_audit(spark, staged, tmp_path):
    odd = staged.withColumn("data_source", F.when(F.col("row_original") % 7 == 0, "PAPER").otherwise(F.col("data_source")))
    odd = odd.filter("unique_alien_id IS NOT NULL")
    log = ChangeLog()
    with pytest.raises(CountMismatch, match="initial_renewal"):
        publish(clean_cases(odd, nation_code_table(spark, SF), form="daca", check=False, log=log), f"{tmp_path}/out", log)


def test_counts_of_a_retried_task_are_counted_anew(spark, tmp_path):
    log = ChangeLog()
    df = spark.range(100)
    first = log.step(df, "read")
    publish(log.step(first.unionAll(first).filter("id >= 0").limit(100), "keep"), f"{tmp_path}/out", log)     # observed twice
    assert [r["rows_out"] for r in log.rows()] == [100, 100]


def test_retyped_columns_are_logged(spark, tmp_path):
    log = ChangeLog()
    a = log.step(spark.range(4).withColumn("x", F.lit("1")), "read")
    b = log.step(a.withColumn("x", F.col("x").cast("int")).withColumn("y", F.lit(1)).drop("id"), "cast")
    publish(b, f"{tmp_path}/out", log)
    assert log.rows()[1] == {"verb": "cast", "rows_in": 4, "rows_out": 4, "added": "y", "dropped": "id", "retyped": "x: string -> int"}


@pytest.mark.parametrize("form", ["tps", "daca"])
def test_published_in_the_reference_order(spark, staged, tmp_path, form):
    log, out = ChangeLog(), f"{tmp_path}/out"
    publish(clean_cases(staged, nation_code_table(spark, SF), form=form, check=False, log=log), out, log, output_order(form))
    got = read_ordered(spark, out).collect()

    def late(v):
        return v is None, v
    def key(r):
        c3 = form == "daca" and r.data_source == "C3" and r.unique_identifier is not None
        person = r.unique_identifier or f"noid_{r.file_original}#{r.row_original}"
        decided = r.decision_date if form == "tps" or c3 else None
        dates = [late(r.rec_date), late(decided)] if form == "tps" else [late(decided), late(r.rec_date)]
        return [c3, person, *[(a, str(b)) for a, b in dates], r.file_original, r.row_original]
    got.sort(key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(got)))
    assert got == sorted(got, key=key)


def test_a_hot_key_is_written_over_several_files(spark, tmp_path):
    df = spark.range(30000).select((F.col("id") % 3 == 0).alias("hot"), "id").filter("hot OR id < 60").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_ordered(df, f"{tmp_path}/o", [F.col("hot"), F.col("id").desc()])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(f.endswith(".parquet") for f in os.listdir(f"{tmp_path}/o")) >= 4
    got = sorted((r.position, r.hot, -r.id) for r in read_ordered(spark, f"{tmp_path}/o").collect())
    assert [p for p, _, _ in got] == list(range(len(got))) and [g[1:] for g in got] == sorted(g[1:] for g in got)
