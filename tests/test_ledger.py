"""Incremental staging against staging everything at once: new, rewritten, removed, empty and mixed files."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from caseflow.columns import FORMS
from caseflow.operators.profile import informative_columns, narrow_datetime
from caseflow.sources.staging import read_forms, schema_groups, stage_forms
from caseflow.streaming import ledger as L

TPS, DACA = FORMS["i821"][0], FORMS["i821d"][0]


def put(root, name, text):
    path = root / name
    fresh = not path.exists()
    path.write_text(text)
    if not fresh:                                  # a rewrite of the same length still has another time
        t = time.time() + 5
        os.utime(path, (t, t))


def opened(spark, out, form="i821"):
    df, informative = L.open_staged(spark, out, form)
    return df, informative


def same_as_batch(spark, release, out, tmp_path, form="i821", fmt="csv"):
    batch = str(tmp_path / f"batch-{time.time_ns()}")
    stage_forms(spark, release, batch, fmt)
    want = spark.read.parquet(f"{batch}/form_id={form}").drop("label")
    got, informative = opened(spark, out, form)
    assert dict(got.dtypes) == dict(want.dtypes)
    got = got.select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    cols = [c for c in want.columns if c not in ("file_original", "row_original")]
    assert {c: informative[c] for c in cols} == informative_columns(want, cols)


@pytest.fixture
def release(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    put(root, f"{TPS}1 redacted.csv", "case_number,status,rec_date,notes\n1,F,2020-01-02,(b)(6)\n2,null,45292,\n")
    put(root, f"{TPS}2 redacted.csv", "rec_date,case_number\n2020-01-03,3\n2020-01-04,4\n")
    put(root, f"{DACA}1 redacted.csv", "case_number,rec_date\n9,2020-01-02 03:04:05\n")
    return root


def test_runs_follow_the_release(spark, release, tmp_path):
    out = str(tmp_path / "out")
    first = L.sync_release(spark, str(release), out)
    assert len(first.staged) == 3 and not first.kept
    same_as_batch(spark, str(release), out, tmp_path)
    same_as_batch(spark, str(release), out, tmp_path, "i821d")
    assert dict(opened(spark, out)[0].dtypes)["rec_date"] == "date"

    assert L.sync_release(spark, str(release), out) == L.Run([], first.staged, [])        # nothing to do
    versions = L._versions(spark, out)

    # a new file whose datetimes are not midnights: the whole dataset opens as timestamps
    put(release, f"{TPS}3 redacted.csv", "case_number,rec_date,notes\n5,2020-05-05 10:00:00,kept\n")
    run = L.sync_release(spark, str(release), out)
    assert len(run.staged) == 1 and len(run.kept) == 3
    assert dict(opened(spark, out)[0].dtypes)["rec_date"] == "timestamp_ntz" and opened(spark, out)[1]["notes"]
    same_as_batch(spark, str(release), out, tmp_path)

    # rewritten in place: its rows are replaced and the dataset narrows again
    put(release, f"{TPS}3 redacted.csv", "case_number,rec_date\n6,2020-05-05\n7,2020-05-06\n8,\n")
    run = L.sync_release(spark, str(release), out)
    assert len(run.staged) == 1 and len(run.kept) == 3
    same_as_batch(spark, str(release), out, tmp_path)
    assert dict(opened(spark, out)[0].dtypes)["rec_date"] == "date"
    assert sorted(r.case_number for r in opened(spark, out)[0].collect()) == list("1234678")

    # gone: forgotten, or kept as it was staged
    os.remove(release / f"{TPS}2 redacted.csv")
    assert L.sync_release(spark, str(release), out, forget_missing=False).staged == []
    assert opened(spark, out)[0].count() == 7
    assert len(L.sync_release(spark, str(release), out).forgotten) == 1
    same_as_batch(spark, str(release), out, tmp_path)
    assert L._versions(spark, out)[-1] == versions[-1] + 3

    # nothing that is read goes with the vacuum
    before = sorted(map(tuple, opened(spark, out)[0].collect()), key=str)
    assert L.vacuum(spark, out) > 0 and L.vacuum(spark, out) == 0
    assert sorted(map(tuple, opened(spark, out)[0].collect()), key=str) == before
    assert L.sync_release(spark, str(release), out).staged == []


def test_old_files_are_not_read_again(spark, release, tmp_path):
    out = str(tmp_path / "out")
    L.sync_release(spark, str(release), out)
    for name in (f"{TPS}1 redacted.csv", f"{TPS}2 redacted.csv"):             # unreadable now, same time and length
        path = release / name
        t, n = os.stat(path).st_mtime_ns, len(path.read_bytes())
        path.write_bytes(b"\0" * n)
        os.utime(path, ns=(t, t))
    put(release, f"{TPS}3 redacted.csv", "case_number,rec_date\n5,2020-05-05\n")
    L.sync_release(spark, str(release), out)
    assert sorted(r.case_number for r in opened(spark, out)[0].collect()) == list("12345")


def test_a_failed_run_changes_nothing(spark, release, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    L.sync_release(spark, str(release), out)
    before = sorted(map(tuple, opened(spark, out)[0].collect()), key=str)
    put(release, f"{TPS}1 redacted.csv", "case_number,status\n1,new\n")

    def lost(*_):
        raise RuntimeError("lost driver")
    with monkeypatch.context() as m:
        m.setattr(L, "_commit", lost)
        with pytest.raises(RuntimeError, match="lost driver"):
            L.sync_release(spark, str(release), out)
    assert sorted(map(tuple, opened(spark, out)[0].collect()), key=str) == before
    assert len(L.sync_release(spark, str(release), out).staged) == 1
    same_as_batch(spark, str(release), out, tmp_path)


def test_two_runs_at_once(spark, release, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    L.sync_release(spark, str(release), out)
    ledger = L.read_ledger(spark, out)
    monkeypatch.setattr(L, "_versions", lambda *_: [])                          # sees the state before the other run
    with pytest.raises(RuntimeError, match="committed by another run"):
        L._commit(spark, out, ledger)


def test_files_without_rows(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    put(root, f"{TPS}1 redacted.csv", "case_number,status\n")
    put(root, f"{TPS}2 redacted.csv", "case_number\n1\n")
    out = str(tmp_path / "out")
    assert len(L.sync_release(spark, str(root), out).staged) == 2
    assert L.sync_release(spark, str(root), out).staged == []
    assert [r.case_number for r in opened(spark, out)[0].collect()] == ["1"]
    with pytest.raises(FileNotFoundError):
        L.open_staged(spark, out, "i821d")


def test_parquet_files_of_different_types(spark, tmp_path):
    root = str(tmp_path / "in")
    rows = {"1": ([("1", dt.date(2020, 1, 1), 1980)], "case_number string, rec_date date, ben_year_of_birth int"),
            "2": ([("2", dt.datetime(2020, 1, 2), "1981.0")], "case_number string, rec_date timestamp, ben_year_of_birth string"),
            "3": ([(3, "45294", 1982.0, "x")], "case_number int, rec_date string, ben_year_of_birth double, extra string"),
            "4": ([("4", dt.date(2020, 1, 4), None)], "case_number string, rec_date date, ben_year_of_birth int"),
            "5": ([(5, None)], "case_number bigint, extra string")}
    for k, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{root}/{TPS}{k} redacted.parquet")
    stage_forms(spark, root, f"{tmp_path}/out")
    df = spark.read.parquet(f"{tmp_path}/out/form_id=i821")
    assert dict(df.dtypes)["rec_date"] == "date" and dict(df.dtypes)["ben_year_of_birth"] == "int"
    got = sorted((r.case_number, r.rec_date, r.ben_year_of_birth, r.extra, r.row_original) for r in df.collect())
    assert got == [("1", dt.date(2020, 1, 1), 1980, None, 1), ("2", dt.date(2020, 1, 2), 1981, None, 1),
                   ("3", dt.date(2024, 1, 3), 1982, "x", 1), ("4", dt.date(2020, 1, 4), None, None, 1), ("5", None, None, None, 1)]
    out = str(tmp_path / "ledger")
    L.sync_release(spark, root, out, "parquet")
    same_as_batch(spark, root, out, tmp_path, fmt="parquet")


def test_schema_groups_take_few_jobs(spark, tmp_path):
    paths = []
    for k in range(12):
        path = f"{tmp_path}/p{k:02}.parquet"
        spark.range(1).select(F.lit("1").alias("a") if k in (5, 6) else F.lit(1).alias("a"), F.lit(k).alias(f"c{k % 2}")).write.parquet(path)
        paths.append(path)
    groups = schema_groups(spark, paths)
    assert sorted(map(len, groups)) == [2, 10] and sorted(sum(groups, [])) == paths
    assert [len(g) for g in schema_groups(spark, [p for p in paths if p[-10:-8] not in ("05", "06")])] == [10]


def test_narrowing_agrees_with_the_batch_rule(spark, release, tmp_path):
    out = str(tmp_path / "out")
    L.sync_release(spark, str(release), out)
    raw = read_forms(spark, str(release), "csv")["i821"]
    assert "rec_date" in raw.columns
    df, _ = opened(spark, out)
    assert narrow_datetime(df).dtypes == df.dtypes
