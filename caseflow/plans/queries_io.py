"""Source/sink round trips (S3-S6, S8-S11, Q2) over data derived from the test tables.

Each query writes into a fresh folder under the session's shared checkpoint
directory (never a machine-local temp folder), then reads it back.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from caseflow.columns import FORMS, PROVENANCE, SERIAL_DATE_ORIGIN
from caseflow.operators.quality import ChangeLog, observe_stage
from caseflow.operators.reshape import clean_names
from caseflow.plans.bindings import PUBLISHED_DATES, cases, cases_sql, published_wide, published_wide_sql, \
    report_facts_sql, report_lines, staged_cases, staged_cases_sql, nation_code_table
from caseflow.plans.catalog import register
from caseflow.plans.clean import clean_cases
from caseflow.plans.public_facts import public_facts
from caseflow.session import scratch_folder
from caseflow.sources.files import file_system
from caseflow.sources.sinks import publish, read_ordered, write_by_fiscal_year, write_ordered, write_parquet
from caseflow.sources.staging import open_dataset, read_release, released_files, stage_forms
from caseflow.sources.text import scan_report_lines
from caseflow.streaming.incremental import incremental_stage, text_schema
from caseflow.streaming.ledger import open_staged, sync_release


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run under the shared checkpoint directory."""
    return scratch_folder(spark, name)


@register("roundtrip_zstd", f"WITH c AS ({cases_sql()}) SELECT * FROM c")
def q_roundtrip_zstd(spark, sf_dir):
    """S8 + S7: zstd Parquet write and scan give back the same rows."""
    path = scratch(spark, "zstd")
    write_parquet(cases(spark, sf_dir), path)
    return spark.read.parquet(path)


_I821, _I821D = FORMS["i821"][0], FORMS["i821d"][0]


def _write_release(spark, sf_dir) -> str:
    """A release folder: two TPS files, one DACA file and one unrelated file."""
    root = scratch(spark, "release")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("case_number"), F.col("o_orderstatus").alias("status"),
        F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd").alias("rec_date"),
        F.col("o_orderkey").alias("_k"))
    k = F.col("_k")
    parts = {f"{_I821}1 redacted.parquet": k % 4 == 0, f"sub/{_I821}2 redacted.parquet": k % 4 == 2,
             f"{_I821D}1 redacted.parquet": k % 4 == 1, "notes_other.parquet": k % 4 == 3}
    for name, cond in parts.items():
        write_parquet(o.filter(cond).drop("_k"), f"{root}/{name}")
    return root


_FORM_SQL = f"""SELECT CAST(o_orderkey AS VARCHAR) AS case_number,
  CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'i821' ELSE 'i821d' END AS form_id,
  CASE WHEN o_orderkey % 4 IN (0, 2) THEN '{FORMS['i821'][1]}' ELSE '{FORMS['i821d'][1]}' END AS label
FROM orders WHERE o_orderkey % 4 <> 3"""


@register("route_files", _FORM_SQL)
def q_route_files(spark, sf_dir):
    """S3 (+U4): files found recursively, routed to a form by name prefix; unrelated
    files dropped."""
    return read_release(spark, _write_release(spark, sf_dir)).select("case_number", "form_id", "label")


@register("with_provenance", f"""WITH f AS ({_FORM_SQL})
SELECT form_id, count(*) AS n_rows, count(*) AS n_distinct_rows, 1 AS first_row FROM f GROUP BY form_id""")
def q_with_provenance(spark, sf_dir):
    """(file, 1-based row) from the scan's metadata is unique and starts at 1."""
    r = read_release(spark, _write_release(spark, sf_dir))
    return r.groupBy("form_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("file_original", "row_original").alias("n_distinct_rows"),
        F.min("row_original").cast("int").alias("first_row"))


@register("open_dataset", f"""SELECT CAST(o_orderkey AS VARCHAR) AS case_number, o_orderstatus AS status,
  CAST(o_orderdate AS DATE) AS rec_date FROM orders WHERE o_orderkey % 4 IN (0, 2)""")
def q_open_dataset(spark, sf_dir):
    """S5 (+ the staging step): stage the release per form, reopen one form's parts
    as one dataset without the form columns."""
    out = scratch(spark, "staging")
    stage_forms(spark, _write_release(spark, sf_dir), out)
    return open_dataset(spark, f"{out}/form_id=i821").select("case_number", "status", "rec_date")


def _orders_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("case_number"), F.col("o_orderstatus").alias("status"),
        F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd").alias("rec_date"),
        F.col("o_orderpriority").alias("extra"), F.col("o_orderkey").alias("_k"))


def _staged_forms(spark, staging: str):
    """Both staged datasets, each with its own columns, as one frame."""
    a, b = (open_dataset(spark, f"{staging}/form_id={f}").withColumn("form_id", F.lit(f)) for f in ("i821", "i821d"))
    return a.unionByName(b, allowMissingColumns=True)


@register("stage_two_layouts", """SELECT CASE WHEN o_orderkey % 3 = 2 THEN 'i821d' ELSE 'i821' END AS form_id,
  CAST(o_orderkey AS VARCHAR) AS case_number,
  CASE WHEN o_orderkey % 3 <> 2 THEN o_orderstatus END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS tps_only,
  CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS daca_only FROM orders""")
def q_stage_two_layouts(spark, sf_dir):
    """S1+S3: forms, and files of one form, with different columns; none is lost."""
    root, o, k = scratch(spark, "layouts"), _orders_text(spark, sf_dir), F.col("_k") % 3
    write_parquet(o.filter(k == 0).select("case_number", "status", F.col("extra").alias("tps_only")),
                  f"{root}/in/{_I821}1 redacted.parquet")
    write_parquet(o.filter(k == 1).select("status", "case_number"), f"{root}/in/{_I821}2 redacted.parquet")
    write_parquet(o.filter(k == 2).select("case_number", F.col("extra").alias("daca_only")),
                  f"{root}/in/{_I821D}1 redacted.parquet")
    stage_forms(spark, f"{root}/in", f"{root}/out")
    return _staged_forms(spark, f"{root}/out").select("form_id", "case_number", "status", "tps_only", "daca_only")


@register("stage_csv_reordered", """SELECT CASE WHEN o_orderkey % 3 = 2 THEN 'i821d' ELSE 'i821' END AS form_id,
  CAST(o_orderkey AS VARCHAR) AS case_number, o_orderstatus AS status,
  CASE WHEN o_orderkey % 3 <> 1 THEN CAST(o_orderdate AS DATE) END AS rec_date FROM orders""")
def q_stage_csv_reordered(spark, sf_dir):
    """S1+S3 over CSV: each file under its own header, whatever the order of its columns; a copy with
    another extension is not read."""
    root, o, k = scratch(spark, "reordered"), _orders_text(spark, sf_dir), F.col("_k") % 3
    files = {f"{_I821}1 redacted.csv": (k == 0, ["case_number", "status", "rec_date"]),
             f"{_I821}2 redacted.csv": (k == 1, ["status", "case_number"]),
             f"{_I821D}1 redacted.csv": (k == 2, ["rec_date", "case_number", "status"])}
    for name, (cond, cols) in files.items():
        o.filter(cond).select(*cols).write.option("header", True).csv(f"{root}/in/{name}")
    o.select("case_number").write.text(f"{root}/in/{_I821}1 redacted.csv.bak")
    stage_forms(spark, f"{root}/in", f"{root}/out", "csv")
    return _staged_forms(spark, f"{root}/out").select("form_id", "case_number", "status", "rec_date")


@register("csv_row_index", """SELECT CAST(o_orderkey AS VARCHAR) AS case_number,
  row_number() OVER (PARTITION BY o_orderkey // 20000 ORDER BY o_orderkey) AS row_original FROM orders""")
def q_csv_row_index(spark, sf_dir):
    """S4 over CSV: the 1-based data row within each file (files of 20,000 consecutive keys)."""
    root = scratch(spark, "csvrows")
    o = _orders_text(spark, sf_dir).withColumn("part", F.floor(F.col("_k") / 20000))
    (o.repartition("part").sortWithinPartitions("part", "_k").select("case_number", "status", "part")
      .write.option("header", True).partitionBy("part").csv(f"{root}/{_I821}1 redacted.csv"))
    return read_release(spark, root, "csv").select("case_number", "row_original")


def _csv_parts(df, per_file: int, root: str) -> None:
    """One CSV file for each ``per_file`` consecutive keys ``_k``, in order of the key; file paths sort by key."""
    part = F.format_string("%09d", F.floor(F.col("_k") / per_file))
    (df.withColumn("part", part).repartition("part").sortWithinPartitions("part", "_k").drop("_k")
       .write.option("header", True).option("escape", '"').partitionBy("part").csv(root))


@register("stage_quoted_csv", """SELECT CAST(doc_id AS VARCHAR) AS case_number, text AS notes, lang AS status,
  row_number() OVER (PARTITION BY doc_id // 400 ORDER BY doc_id) AS row_original FROM documents""")
def q_stage_quoted_csv(spark, sf_dir):
    """S1+S6 over CSV with line ends, quotes and commas inside cells: whole texts and row numbers come back."""
    root = scratch(spark, "quoted")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("case_number"), F.col("text").alias("notes"), F.col("lang").alias("status"),
        F.col("doc_id").alias("_k"))
    _csv_parts(docs, 400, f"{root}/{_I821}1 redacted.csv")
    return read_release(spark, root, "csv").select("case_number", "notes", "status", "row_original")


@register("stage_mixed_types", """SELECT CAST(o_orderkey AS VARCHAR) AS case_number, CAST(o_orderdate AS DATE) AS rec_date,
  CAST(1950 + o_custkey % 50 AS INTEGER) AS ben_year_of_birth,
  CASE WHEN o_orderkey % 4 = 3 THEN o_orderstatus END AS status FROM orders""")
def q_stage_mixed_types(spark, sf_dir):
    """S1 over Parquet files that type one column differently (DATE, TIMESTAMP, text, serial number; int,
    bigint, double, text): all are staged under the types that column names give."""
    root, k = scratch(spark, "mixed"), F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day, year = F.col("o_orderdate").cast("date"), F.lit(1950) + F.col("o_custkey") % 50
    serial = F.datediff(day, F.lit(SERIAL_DATE_ORIGIN).cast("date")).cast("double")
    layouts = [(k, day, year.cast("int")), (k.cast("string"), day.cast("timestamp_ntz"), year.cast("bigint")),
               (k, day.cast("string"), year.cast("double")), (k.cast("int"), serial, year.cast("string"))]
    for i, (number, rec, born) in enumerate(layouts):
        cols = [number.alias("case_number"), rec.alias("rec_date"), born.alias("ben_year_of_birth")]
        write_parquet(o.filter(k % 4 == i).select(*cols, *([F.col("o_orderstatus").alias("status")] if i == 3 else [])),
                      f"{root}/in/{_I821}{i} redacted.parquet")
    stage_forms(spark, f"{root}/in", f"{root}/out")
    return open_dataset(spark, f"{root}/out/form_id=i821").select("case_number", "rec_date", "ben_year_of_birth", "status")


def _rewrite_in_place(spark, path: str, df) -> None:
    """Give the CSV file at ``path`` the rows of ``df`` (a few thousand)."""
    fs, old = file_system(spark, path)
    new = scratch(spark, "rewritten")
    _csv_parts(df, 1 << 40, new)
    _, folder = file_system(spark, f"{new}/part=000000000")
    made = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".csv"))
    fs.delete(old, False)
    fs.rename(made, old)


def _staged_in_runs(spark, rows, per_file: int) -> str:
    """Text ``rows`` (with ``_k``) as a release staged in three runs: the first files, one of them wrong; all files; the
    wrong one rewritten in place. Returns the folder of the staged data."""
    root = scratch(spark, "runs")
    first = F.col("_k") < per_file
    wrong = rows.filter(first).select(*[F.reverse(c).alias(c) if c != "_k" else F.col(c) for c in rows.columns])
    release = f"{root}/{_I821}1 redacted"
    _csv_parts(wrong, per_file, f"{release}/a.csv")
    sync_release(spark, root, f"{root}/out")
    _csv_parts(rows.filter(~first), per_file, f"{release}/b.csv")
    sync_release(spark, root, f"{root}/out")
    wrong_file = next(r["path"] for r in released_files(spark, root, "csv") if "/a.csv/" in r["path"])
    _rewrite_in_place(spark, wrong_file, rows.filter(first))
    done = sync_release(spark, root, f"{root}/out")
    if len(done.staged) != 1:
        raise AssertionError(f"one file was rewritten, {len(done.staged)} were staged")
    return f"{root}/out"


@register("incremental_rewrite", """SELECT CAST(o_orderkey AS VARCHAR) AS case_number, o_orderstatus AS status,
  CAST(o_orderdate AS DATE) AS rec_date,
  row_number() OVER (PARTITION BY o_orderkey // 20000 ORDER BY o_orderkey) AS row_original FROM orders""")
def q_incremental_rewrite(spark, sf_dir):
    """S10 by ledger: a file that is rewritten in place replaces its rows, others are kept as they were staged; row
    numbers, and types narrowed from the profiles of all files (C8)."""
    rows = _orders_text(spark, sf_dir).select("case_number", "status", "rec_date", "_k")
    df, _ = open_staged(spark, _staged_in_runs(spark, rows, 20000), "i821")
    return df.select("case_number", "status", "rec_date", "row_original")


_CLEAN_HEADER = ", ".join(['"Country" AS country'] + [f'"{d}" AS x{d.replace("-", "_")}' for d in PUBLISHED_DATES])


@register("clean_names", f"WITH pw AS ({published_wide_sql()}) SELECT {_CLEAN_HEADER} FROM pw")
def q_clean_names(spark, sf_dir):
    """The published table through a header CSV; header snake_cased, dates x-prefixed."""
    from caseflow.sources.text import read_header_csv
    path = scratch(spark, "csv")
    published_wide(spark, sf_dir).write.option("header", True).csv(path)
    df = read_header_csv(spark, path)
    return df.select("country", *[F.col(c).cast("long").alias(c) for c in df.columns if c != "country"])


@register("report_lines", "WITH" + report_facts_sql("lines") + """
SELECT fiscal_year, quarter, period, country, metric, value, code, source_file FROM facts""")
def q_report_lines(spark, sf_dir):
    """Report text files written one per source name, scanned back with their
    file names, then parsed into facts."""
    path = scratch(spark, "reports")
    report_lines(spark, sf_dir).select("line", "source_file").write.partitionBy("source_file").text(path)
    return public_facts(scan_report_lines(spark, path))


@register("incremental_stage", """SELECT CAST(o_orderkey AS VARCHAR) AS case_number, o_orderstatus AS status,
  CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS rec_date FROM orders""")
def q_incremental_stage(spark, sf_dir):
    """Two runs of the incremental stager over a growing folder; every source row
    lands exactly once."""
    root = scratch(spark, "incremental")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("case_number"), F.col("o_orderstatus").alias("status"),
        F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd").alias("rec_date"),
        F.col("o_orderkey").alias("_k"))
    schema = text_schema(["case_number", "status", "rec_date"])
    src, out, ckpt = f"{root}/src", f"{root}/out", f"{root}/_checkpoint"
    o.filter(F.col("_k") % 2 == 0).drop("_k").write.option("header", True).csv(f"{src}/batch1")
    incremental_stage(spark, src, out, ckpt, schema)
    o.filter(F.col("_k") % 2 == 1).drop("_k").write.option("header", True).csv(f"{src}/batch2")
    incremental_stage(spark, src, out, ckpt, schema)
    return spark.read.parquet(out).select("case_number", "status", "rec_date")


def _clean_incremental_sql() -> str:
    from caseflow.plans.queries_clean import _clean_sql
    return ("SELECT * EXCLUDE (file_original, row_original) REPLACE (nullif(notes_one, '(b)(6)') AS notes_one) "
            f"FROM ({_clean_sql('tps')})")


@register("clean_tps_incremental", _clean_incremental_sql())
def q_clean_tps_incremental(spark, sf_dir):
    """The TPS cleaning plan over records staged in several runs: as over one staging, and P1 is answered by
    the ledger's profiles."""
    raw = staged_cases(spark, sf_dir)
    rows = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns if c not in PROVENANCE],
                      F.col("row_original").alias("_k"))
    df, informative = open_staged(spark, _staged_in_runs(spark, rows, 20000), "i821")
    return clean_cases(df, nation_code_table(spark, sf_dir), form="tps", informative=informative).drop(*PROVENANCE)


@register("write_by_fiscal_year", f"""WITH c AS ({cases_sql()}),
y AS (SELECT CASE WHEN rec_date IS NULL THEN 'TPS FY unknown'
  ELSE 'TPS FY' || CAST(year(rec_date) + CASE WHEN month(rec_date) >= 10 THEN 1 ELSE 0 END AS VARCHAR) END AS sheet FROM c)
SELECT sheet, count(*) AS n_rows FROM y GROUP BY sheet""")
def q_write_by_fiscal_year(spark, sf_dir):
    """S9 sink: one output directory per fiscal-year unit; read back and counted."""
    path = scratch(spark, "fy")
    write_by_fiscal_year(cases(spark, sf_dir), path, label="TPS")
    return spark.read.parquet(path).groupBy("sheet").agg(F.count(F.lit(1)).alias("n_rows"))


@register("stage_metrics", """SELECT 'staged' AS stage, count(*) AS n_rows FROM orders
UNION ALL SELECT 'cleaned', count(*) FROM orders WHERE o_orderkey % 97 <> 0""")
def q_stage_metrics(spark, sf_dir):
    """Q2: row counts observed at stage borders while the cleaned table is written
    (no extra pass over the data)."""
    staged, o_in = observe_stage(staged_cases(spark, sf_dir), "staged")
    cleaned, o_out = observe_stage(clean_cases(staged, nation_code_table(spark, sf_dir), "tps", check=False),
                                   "cleaned")
    write_parquet(cleaned, scratch(spark, "cleaned"))
    rows = [("staged", o_in.get["rows"]), ("cleaned", o_out.get["rows"])]
    return spark.createDataFrame(rows, "stage string, n_rows long")


def _change_log_sql() -> str:
    from caseflow.plans.queries_clean import _REDACTED
    steps = [("staged", "", ""), ("drop_uninformative", "", "notes_blank, notes_redacted"), ("flag_empty_rows", "row_redacted", ""),
             ("rename", "unique_identifier", "unique_alien_id"), ("resolve_country", "", ""), ("recode_values", "", ""),
             ("flag_duplicates", "duplicate_drop_row, duplicate_identifier, duplicate_last, duplicate_likely", ""),
             ("drop_empty_rows", "", "row_redacted")]
    values = ", ".join(f"({i}, '{v}', '{a}', '{d}')" for i, (v, a, d) in enumerate(steps))
    return f"""WITH s AS ({staged_cases_sql()}), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE {_REDACTED}) AS e FROM s)
SELECT step, verb, n.n AS rows_in, n.n - CASE WHEN verb = 'drop_empty_rows' THEN n.e ELSE 0 END AS rows_out, added, dropped,
  '' AS retyped FROM (VALUES {values}) v(step, verb, added, dropped), n"""


@register("change_log", _change_log_sql())
def q_change_log(spark, sf_dir):
    """Q2 per verb, Q1: rows and columns before and after every verb of the TPS cleaning plan, from the one audited
    write that publishes it."""
    log = ChangeLog()
    df = clean_cases(staged_cases(spark, sf_dir), nation_code_table(spark, sf_dir), form="tps", check=False, log=log)
    publish(df, scratch(spark, "published"), log)
    return log.frame(spark)


@register("write_ordered", f"""WITH c AS ({cases_sql()})
SELECT row_original, row_number() OVER (ORDER BY data_source, rec_date NULLS LAST, file_original, row_original) - 1 AS position
FROM c""")
def q_write_ordered(spark, sf_dir):
    """O1+S8: rows written in an order whose first key has two values, read back with their places in it."""
    path = scratch(spark, "ordered-sink")
    write_ordered(cases(spark, sf_dir), path, [F.col("data_source"), F.col("rec_date").asc_nulls_last(),
                                               F.col("file_original"), F.col("row_original")])
    return read_ordered(spark, path).select("row_original", "position")
