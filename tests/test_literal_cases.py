"""The literal cases every operator must get right (FIXTURES.md, last table)."""

import datetime as dt

from conftest import D, case_rows
from pyspark.sql import functions as F

from caseflow.columns import OTHER_COUNTRIES, UNLISTED_COUNTRY
from caseflow.functions.dates import add_months_rolling, fiscal_year, quarter_sequence, serial_to_date
from caseflow.functions.reports import fiscal_year_from_name, parse_report_line, quarter_from_period
from caseflow.functions.text import repair_mojibake, resolve_country, squish, suppressed_value, suppression_code
from caseflow.operators import panel as P
from caseflow.operators.episodes import flag_duplicates, initial_renewal, running_approvals
from caseflow.operators.lookup import country_code_table, lookup_left
from caseflow.operators.profile import drop_uninformative, flag_empty_rows

F1 = "f1.parquet"


def by_row(df, *cols):
    return {r["row_original"]: tuple(r[c] for c in cols) for r in df.collect()}


# ---- episodes -------------------------------------------------------------------------

def test_episodes_same_date_null_dates_and_null_ids(spark):
    df = case_rows(spark, [
        ("p", "2020-01-01", "2020-02-01", "Approved", None, "C3", None, F1, 1),
        ("p", "2020-01-01", "2020-03-01", "Approved", None, "C3", None, F1, 2),
        ("p", None, None, "Denied", None, "C3", None, F1, 3),
        ("p", None, None, "Denied", None, "C3", None, F1, 4),
        ("p", "2020-05-01", None, "Denied", None, "C3", None, F1, 5),
        (None, "2020-01-01", None, "Denied", None, "C3", None, F1, 6),
        (None, "2020-01-01", None, "Denied", None, "C3", None, F1, 7),
    ])
    got = by_row(flag_duplicates(df, order="tps"),
                 "duplicate_identifier", "duplicate_last", "duplicate_likely", "duplicate_drop_row")
    assert got[1] == (1, False, True, True)
    assert got[2] == (1, True, True, False)
    assert got[5] == (2, True, False, False)
    # each NULL rec_date opens its own run after the dated ones
    assert got[3] == (3, True, None, False)
    assert got[4] == (4, True, None, False)
    # id-less rows are never duplicates of each other
    assert got[6] == (1, True, None, False)
    assert got[7] == (1, True, None, False)


def test_last_flag_tps_vs_daca(spark):
    df = case_rows(spark, [
        ("p", "2020-01-01", None, "Pending", None, "C3", None, F1, 1),
        ("p", "2020-01-01", "2020-01-05", "Approved", None, "C3", None, F1, 2),
    ])
    tps = by_row(flag_duplicates(df, order="tps"), "duplicate_last")
    daca = by_row(flag_duplicates(df, order="daca"), "duplicate_last")
    assert tps == {1: (True,), 2: (False,)}     # undecided row is last in the TPS order
    assert daca == {1: (False,), 2: (True,)}    # file/row order decides in the DACA order


# ---- running approvals ----------------------------------------------------------------

def test_running_approvals_and_initial_renewal(spark):
    df = case_rows(spark, [
        ("a", "2020-01-01", "2020-01-01", "Approved", None, "C3", None, F1, 1),
        ("a", "2020-01-01", "2020-02-01", "Denied", None, "C3", None, F1, 2),
        ("a", "2020-01-01", "2020-03-01", "Approved", None, "C3", None, F1, 3),
        ("a", "2020-01-01", "2020-04-01", "Approved", None, "C3", None, F1, 4),
        ("b", "2020-01-01", "2020-01-01", "Approved", None, "C3", None, F1, 5),
        ("b", "2020-01-01", "2020-02-01", None, None, "C3", None, F1, 6),
        ("b", "2020-01-01", "2020-03-01", "Approved", None, "C3", None, F1, 7),
        ("c", "2020-01-01", "2020-01-01", "Approved", None, "ELIS", "DACA - Renewal", F1, 8),
        (None, "2020-01-01", "2020-01-01", "Approved", None, "C3", "x", F1, 9),
    ])
    n = by_row(running_approvals(df), "n_approvals")
    assert [n[i][0] for i in (1, 2, 3, 4)] == [1, 1, 2, 3]
    assert [n[i][0] for i in (5, 6, 7)] == [1, None, None]
    f = by_row(initial_renewal(df), "form_type_filled_in")
    assert [f[i][0] for i in (1, 2, 3, 4)] == ["DACA - Initial", "DACA - Initial", "DACA - Renewal", "DACA - Renewal"]
    assert [f[i][0] for i in (5, 6, 7)] == ["DACA - Initial", None, None]
    assert f[8] == ("DACA - Renewal",) and f[9] == ("x",)


# ---- person state and thresholds ---------------------------------------------------------

def test_ever_approved_faithful_and_strict(spark):
    df = case_rows(spark, [
        ("p", "2020-01-01", "2020-01-10", "Denied", None, "C3", None, F1, 1),
        ("p", "2020-02-01", "2020-02-10", "Approved", None, "C3", None, F1, 2),
        ("p", "2020-03-01", "2020-03-10", "Denied", None, "C3", None, F1, 3),
        ("q", "2020-01-01", "2020-01-10", "Denied", None, "C3", None, F1, 4),
    ])
    faithful = {r[0]: (r[1], r[2]) for r in P.person_summary(df, mode="faithful").collect()}
    strict = {r[0]: (r[1], r[2]) for r in P.person_summary(df, mode="strict").collect()}
    assert faithful["p"] == (D("2020-01-10"), D("2020-03-10"))
    assert strict["p"] == (D("2020-02-10"), D("2020-02-10"))
    assert faithful["q"] == (None, None) and strict["q"] == (None, None)


def test_threshold_inclusive(spark):
    v = dt.date(2025, 3, 31)
    df = case_rows(spark, [
        ("in", "2024-01-01", str(v - dt.timedelta(days=182)), "Approved", "X", "C3", None, F1, 1),
        ("out", "2024-01-01", str(v - dt.timedelta(days=183)), "Approved", "X", "C3", None, F1, 2),
    ])
    row = P.cross_section(df, str(v)).collect()[0]
    assert row["approved_within_6"] == 1 and row["approved_within_12"] == 2


def test_country_of_person_and_lump(spark):
    df = case_rows(spark, [
        ("p", "2020-02-01", "2020-02-10", "Approved", "Haiti", "C3", None, F1, 1),
        ("p", "2020-01-01", "2020-03-10", "Approved", "Nepal", "C3", None, F1, 2),
        ("p", None, "2020-01-05", "Approved", "Syria", "C3", None, F1, 3),
        ("q", "2020-01-01", "2020-01-10", "Approved", None, "C3", None, F1, 4),
    ])
    first = {r[0]: r[1] for r in P.first_row_per_key(df, cols=["ben_country_of_birth"]).collect()}
    assert first == {"p": "Nepal", "q": None}
    dates = spark.createDataFrame([(dt.date(2020, 6, 30),)], "report_date date")
    for method in ("sweep", "explode"):
        panel = P.snapshot_panel(df, dates, method=method)
        got = {r["ben_country_of_birth"]: r["approved_within_6"] for r in panel.collect()}
        assert got == {"Nepal": 1, None: 1}
        keep = spark.createDataFrame([("Nepal",)], "country string")
        lumped = {r["country"]: r["approved_within_6"] for r in P.lump_other(panel, keep).collect()}
        assert lumped == {"Nepal": 1, OTHER_COUNTRIES: 1}


def test_panel_upper_bound_and_presence(spark):
    # at 2020-01-31 only the first decision counts; the person is present before approval
    df = case_rows(spark, [
        ("p", "2020-01-01", "2020-01-10", "Denied", "A", "C3", None, F1, 1),
        ("p", "2020-01-02", "2020-02-10", "Approved", "B", "C3", None, F1, 2),
    ])
    dates = spark.createDataFrame([(dt.date(2020, 1, 31),), (dt.date(2020, 3, 1),)], "report_date date")
    for method in ("sweep", "explode"):
        got = sorted((r["report_date"], r["ben_country_of_birth"], r["approved_within_6"])
                     for r in P.snapshot_panel(df, dates, method=method).collect())
        assert got == [(dt.date(2020, 1, 31), "A", 0), (dt.date(2020, 3, 1), "A", 1)]


# ---- lookups --------------------------------------------------------------------------

def test_lookup_layers(spark):
    base = spark.createDataFrame([("ELSAL", "El Salvador"), ("US", "USA"), ("HAITI", "Haiti")],
                                 "code string, name string")
    codes = country_code_table(spark, base)
    rows = spark.createDataFrame([
        (1, "C3", "US"), (2, "C3", "SOSUD"), (3, "C3", "ESAL"), (4, "C3", "ZZZZ"), (5, "C3", None),
        (6, "ELIS", "HAITI"), (7, "ELIS", "CÃ´te d'Ivoire"), (8, None, "HAITI"),
    ], "row_original long, data_source string, raw string")
    j = lookup_left(rows, codes, "raw", check_unique=True)
    assert j.count() == rows.count()
    tps = j.select("row_original", resolve_country("raw", "data_source", "country", UNLISTED_COUNTRY).alias("c"))
    daca = j.select("row_original", resolve_country("raw", "data_source", "country", None).alias("c"))
    t = {r[0]: r[1] for r in tps.collect()}
    d = {r[0]: r[1] for r in daca.collect()}
    assert t[1] == "United States"        # overlay replaces the base name
    assert t[2] == "South Sudan"          # overlay inserts a code
    assert t[3] == "El Salvador"          # alias takes its canonical code's name
    assert t[4] == UNLISTED_COUNTRY and d[4] is None   # unknown code: default label vs NULL
    assert t[5] == UNLISTED_COUNTRY and d[5] is None   # NULL code
    assert t[6] == "HAITI"                # ELIS keeps its value even when it equals a code
    assert t[7] == "Côte d'Ivoire"        # ELIS values are repaired
    assert t[8] == "Haiti"                # NULL source falls through to the lookup


# ---- text -------------------------------------------------------------------------------

def test_mojibake(spark):
    vals = ["CÃ´te d'Ivoire", "Côte d'Ivoire", "Haiti", "Łódź", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(repair_mojibake("s")).collect()]
    assert got == ["Côte d'Ivoire", "Côte d'Ivoire", "Haiti", "Łódź", None]


def test_squish(spark):
    df = spark.createDataFrame([("  a \t\n b  c  ",)], "s string")
    assert df.select(squish("s")).first()[0] == "a b c"


# ---- schema shaping ---------------------------------------------------------------------

def test_drop_uninformative_and_empty_rows(spark):
    df = spark.createDataFrame([
        (None, "", "(b)(6)", "x", None, "f", 1),
        (None, "NA", " B(7)c ", "(b)(6)", None, "f", 2),
        (None, "  ", "b(3) and more", "(B)(7)", None, "f", 3),
    ], "all_null string, blanks string, redacted string, one_value string, n int, "
       "file_original string, row_original long")
    kept = drop_uninformative(df, keep=("file_original", "row_original")).columns
    assert kept == ["one_value", "file_original", "row_original"]
    flagged = {r["row_original"]: r["row_redacted"] for r in
               flag_empty_rows(df.select("n", "file_original", "row_original")).collect()}
    assert flagged == {1: True, 2: True, 3: True}
    empty = df.limit(0)
    assert drop_uninformative(empty, keep=("file_original", "row_original")).columns == [
        "file_original", "row_original"]


# ---- dates -------------------------------------------------------------------------------

def test_quarter_steps_roll_forward(spark):
    b = spark.createDataFrame([(dt.date(1998, 11, 30), dt.date(1999, 9, 1))], "start date, end date")
    got = [r[0] for r in quarter_sequence(b).orderBy("quarter").collect()]
    assert got == [dt.date(1998, 11, 30), dt.date(1999, 3, 2), dt.date(1999, 5, 30), dt.date(1999, 8, 30)]
    one = spark.createDataFrame([(dt.date(2020, 1, 31),)], "s date")
    assert one.select(add_months_rolling("s", 1)).first()[0] == dt.date(2020, 3, 2)


def test_serial_dates_and_fiscal_year(spark):
    df = spark.createDataFrame([("45000",), ("45000.7",), ("2023-03-15",), ("2023/03/15",), ("junk",)], "s string")
    assert [r[0] for r in df.select(serial_to_date("s")).collect()] == [dt.date(2023, 3, 15)] * 4 + [None]
    fy = spark.createDataFrame([(D("2023-09-30"),), (D("2023-10-01"),), (None,)], "d date")
    assert [r[0] for r in fy.select(fiscal_year("d")).collect()] == [2023, 2024, None]


# ---- report cells -----------------------------------------------------------------------

def test_report_cells(spark):
    df = spark.createDataFrame([("1,200",), ("-",), ("D",), ("H",)], "v string")
    got = df.select(suppressed_value("v"), suppression_code("v")).collect()
    assert [tuple(r) for r in got] == [(1200.0, None), (0.0, None), (None, "D"), (None, "H")]
    names = spark.createDataFrame([("FY22_report.pdf", "Q3"), ("i821_fy2024.xlsx", "FY")], "f string, p string")
    assert [tuple(r) for r in names.select(fiscal_year_from_name("f"), quarter_from_period("p")).collect()] == [
        (2022, 3), (2024, None)]


def test_report_lines_token_counts(spark):
    t20 = " ".join(["1,200"] * 19 + ["D"])
    lines = spark.createDataFrame([
        ("El Salvador " + t20, "a"),                      # 20 tokens: parsed
        ("Haiti " + " ".join(["5"] * 19), "a"),             # 19 tokens: dropped
        ("Nepal 7 " + t20, "a"),                            # 21, first ends in a digit: dropped
        ("Sudan D " + t20, "a"),                            # 21, first is a code: joins the label
        ("  Syria \t  " + t20 + "  ", "a"),                 # whitespace squished
    ], "line string, source_file string")
    got = {r["country"]: r["Q1.received"] for r in parse_report_line(lines).collect()}
    assert got == {"El Salvador": "1,200", "Sudan D": "1,200", "Syria": "1,200"}


def test_published_csv_to_long(spark, tmp_path):
    from caseflow.plans.person_panel import published_from_csv
    p = tmp_path / "published.csv"
    p.write_text("Country,2015-07-01,2016-02-18\n"
                 "El Salvador,204000,204000\n"
                 '"Korea, South",,7\n')
    got = sorted((r["country"], str(r["report_date"]), r["value"], r["source"])
                 for r in published_from_csv(spark, str(p)).collect())
    assert got == [("El Salvador", "2015-07-01", 204000.0, "CRS"), ("El Salvador", "2016-02-18", 204000.0, "CRS"),
                   ("Korea, South", "2015-07-01", 0.0, "CRS"), ("Korea, South", "2016-02-18", 7.0, "CRS")]


def test_write_by_fiscal_year_names(spark, tmp_path):
    from caseflow.sources.sinks import write_by_fiscal_year
    rows = [("a", D("2023-09-30"), "f", i) for i in range(1, 6)] + [("b", D("2023-10-01"), "f", 6), ("c", None, "f", 7)]
    df = spark.createDataFrame(rows, "unique_identifier string, rec_date date, file_original string, row_original long")
    names = write_by_fiscal_year(df, str(tmp_path / "out"), label="TPS", max_rows=2)
    assert names == ["TPS FY2023", "TPS FY2023 (2)", "TPS FY2023 (3)", "TPS FY2024", "TPS FY unknown"]
    back = {r["sheet"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("sheet").count().collect()}
    assert back == {"TPS FY2023": 2, "TPS FY2023 (2)": 2, "TPS FY2023 (3)": 1, "TPS FY2024": 1, "TPS FY unknown": 1}


def test_lookup_keys_must_be_unique(spark):
    import pytest
    from caseflow.operators.lookup import rows_upsert
    base = spark.createDataFrame([("ELSAL", "El Salvador"), ("US", "USA"), ("HAITI", "Haiti")],
                                 "code string, name string")
    codes = country_code_table(spark, base)
    rows = spark.createDataFrame([(1, "US"), (2, "ESAL"), (3, "ZZ"), (4, None)], "row_original long, raw string")
    assert lookup_left(rows, codes, "raw").count() == 4
    # the check is part of the plan: building it runs no job, running it raises
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    twice = lookup_left(rows, codes.unionAll(codes), "raw")
    upserted = rows_upsert(base, base.unionAll(base), "code")
    assert len(tracker.getJobIdsForGroup()) == before
    with pytest.raises(Exception, match="lookup table repeats a key"):
        twice.collect()
    with pytest.raises(Exception, match="lookup table repeats a key"):
        twice.select("row_original").count()              # no column of the table is read
    with pytest.raises(Exception, match="overlay repeats a key"):
        upserted.collect()
    null_codes = spark.createDataFrame([(None, "x"), (None, "y"), ("US", "USA")], "code string, country string")
    assert [r.country for r in lookup_left(rows, null_codes, "raw").orderBy("row_original").collect()] == ["USA", None, None, None]


def test_fixed_code_tables_have_unique_keys():
    from caseflow.operators.lookup import COUNTRY_CODE_ALIASES, COUNTRY_CODE_OVERLAY
    assert len(dict(COUNTRY_CODE_OVERLAY)) == len(COUNTRY_CODE_OVERLAY)
    assert len(dict(COUNTRY_CODE_ALIASES)) == len(COUNTRY_CODE_ALIASES)
    assert not dict(COUNTRY_CODE_OVERLAY).keys() & dict(COUNTRY_CODE_ALIASES).keys()


def test_junk_cells_become_null(spark):
    from caseflow.functions.dates import serial_to_date
    from caseflow.sources.staging import null_markers, parse_datetime
    cells = ["20240101120000", "1e20", "3e9", "NaN", "Infinity", "-1", "45292", "2024-01-01", "\t(b)(6)\n", " \t"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = df.select(serial_to_date("c").cast("string").alias("d"), parse_datetime("c").cast("string").alias("t"),
                    null_markers("c", ["(b)(6)"]).alias("m")).collect()
    assert [r.d for r in got] == [None] * 6 + ["2024-01-01"] * 2 + [None] * 2
    assert [r.t and r.t[:10] for r in got] == [None] * 6 + ["2024-01-01"] * 2 + [None] * 2
    assert [r.m for r in got] == cells[:8] + [None, None]


def test_changed_since_picks_only_newer_files(spark, tmp_path):
    import time
    from caseflow.streaming.incremental import changed_since, text_schema
    src = tmp_path / "src"
    src.mkdir()
    (src / "old.csv").write_text("case_number,status\n1,F\n2,O\n")
    time.sleep(1.5)
    cut = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    time.sleep(1.5)
    (src / "new.csv").write_text("case_number,status\n3,P\n")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = changed_since(spark, str(src), cut, text_schema(["case_number", "status"]))
    assert [r["case_number"] for r in got.collect()] == ["3"]


def test_daca_rows_in_no_branch_raise(spark):
    import pytest
    from caseflow.operators.quality import CountMismatch
    from caseflow.plans.clean import clean_cases
    staged = spark.createDataFrame([
        ("p1", D("2020-01-01"), D("2020-01-05"), "Approved", "C3", "N1", "F", None, F1, 1),
        ("p2", D("2020-01-01"), D("2020-01-05"), "Approved", None, "N1", "F", None, F1, 2),
    ], "unique_alien_id string, rec_date date, decision_date date, decision string, data_source string, "
       "ben_country_of_birth string, ben_gender string, form_type string, file_original string, row_original long")
    codes = spark.createDataFrame([("N1", "Nowhere")], "code string, country string")
    with pytest.raises(CountMismatch):
        clean_cases(staged, codes, form="daca")
    assert clean_cases(staged, codes, form="tps").count() == 2


def test_narrow_datetime_precondition_and_all_null(spark):
    import pytest
    from caseflow.operators.profile import narrow_datetime
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1), None, "x")], "a timestamp_ntz, b timestamp_ntz, c string")
    with pytest.raises(TypeError):
        narrow_datetime(df, ["c"])
    out = narrow_datetime(df)
    assert dict(out.dtypes) == {"a": "date", "b": "date", "c": "string"}   # all-NULL narrows too


def test_clean_names_headers(spark):
    from caseflow.operators.reshape import clean_name, clean_names
    assert [clean_name(c) for c in ("Country", "2015-07-01", "Ben Country of Birth", "caseNumber", " x ")] == [
        "country", "x2015_07_01", "ben_country_of_birth", "case_number", "x"]
    df = spark.createDataFrame([(1, 2)], "`A b` int, `a_b` int")
    assert clean_names(df).columns == ["a_b", "a_b_2"]


def test_sort_order_nulls_last_and_descending(spark):
    from caseflow.operators.reshape import sort_nulls_last
    df = spark.createDataFrame([(1, None), (None, "a"), (2, "b"), (1, "b"), (2, None), (1, "a")], "n int, s string")
    rows = [tuple(r) for r in sort_nulls_last(df, "n", "s").collect()]
    assert rows == [(1, "a"), (1, "b"), (1, None), (2, "b"), (2, None), (None, "a")]
    rows = [tuple(r) for r in sort_nulls_last(df, "n", "s", descending=["n"]).collect()]
    assert rows == [(2, "b"), (2, None), (1, "a"), (1, "b"), (1, None), (None, "a")]


def test_panels_over_daily_and_no_dates_without_nested_loops(spark):
    df = case_rows(spark, [
        ("p", "2020-01-01", "2020-01-10", "Denied", "A", "C3", None, F1, 1),
        ("p", "2020-01-02", "2020-02-10", "Approved", "B", "C3", None, F1, 2),
        ("q", "2020-01-01", "2021-03-01", "Approved", None, "C3", None, F1, 3),
    ])
    days = spark.sql("SELECT explode(sequence(date'2000-01-01', date'2027-05-18')) AS day")      # 10,000 dates
    state = P.asof_state(df, days)
    panel = P.snapshot_panel(df, days)
    for x in (state, panel):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    end = dt.date(2027, 5, 18)
    assert state.count() == (end - D("2020-01-10")).days + 1 + (end - D("2021-03-01")).days + 1
    held = {r["ben_country_of_birth"]: r["n"] for r in
            panel.filter("approved_within_6 > 0").groupBy("ben_country_of_birth").agg(F.count("*").alias("n")).collect()}
    assert held == {"A": 183, None: 183}
    none = days.filter("false")
    assert P.asof_state(df, none).count() == 0 and P.snapshot_panel(df, none).count() == 0
