"""Case-record shaped views derived from the TPC-H-like test tables.

The test tables carry no NULLs and no domain columns, so these views inject
them deterministically from keys; every view reads whole tables and grows with
them. Each Spark view has a SQL twin (DuckDB dialect) used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.columns import TPS_FORM_TYPE_LABELS
from caseflow.operators.reshape import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from caseflow.sources.staging import scan_parquet
    return scan_parquet(spark, f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str, monthly: bool = False) -> DataFrame:
    """One application row per order; ``monthly`` truncates rec_date to the month so
    that same-person same-date duplicates are common. (One SQL projection: the
    expressions are parsed JVM-side in a single call.)"""
    rec = "trunc(CAST(o_orderdate AS DATE), 'MM')" if monthly else "CAST(o_orderdate AS DATE)"
    return table(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_custkey % 40 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS unique_identifier",
        f"CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE {rec} END AS rec_date",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL "
        "ELSE date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey * 7 % 400 AS INT)) END AS decision_date",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CASE o_orderstatus WHEN 'F' THEN 'Approved' "
        "WHEN 'O' THEN 'Denied' ELSE 'Pending' END END AS decision",
        "nullif(o_orderpriority, '5-LOW') AS ben_country_of_birth",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'ELIS' ELSE 'C3' END AS data_source",
        "CASE WHEN o_orderkey % 3 <> 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'DACA - Initial' "
        "ELSE 'DACA - Renewal' END AS form_type",
        "element_at(array('F', 'M', 'U', 'Female'), CAST(o_orderkey % 4 + 1 AS INT)) AS ben_gender",
        "'orders.parquet' AS file_original",
        "o_orderkey AS row_original",
    )


def cases_sql(monthly: bool = False) -> str:
    rec = "CAST(date_trunc('month', o_orderdate) AS DATE)" if monthly else "CAST(o_orderdate AS DATE)"
    return f"""
SELECT
  CASE WHEN o_custkey % 40 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS unique_identifier,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE {rec} END AS rec_date,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL
       ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey * 7 % 400 AS INTEGER) END AS decision_date,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL
       ELSE CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Denied' ELSE 'Pending' END END
       AS decision,
  NULLIF(o_orderpriority, '5-LOW') AS ben_country_of_birth,
  CASE WHEN o_orderkey % 3 = 0 THEN 'ELIS' ELSE 'C3' END AS data_source,
  CASE WHEN o_orderkey % 3 <> 0 THEN NULL
       WHEN o_orderkey % 2 = 0 THEN 'DACA - Initial' ELSE 'DACA - Renewal' END AS form_type,
  (['F', 'M', 'U', 'Female'])[CAST(o_orderkey % 4 + 1 AS INTEGER)] AS ben_gender,
  'orders.parquet' AS file_original,
  o_orderkey AS row_original
FROM orders"""


# Snapshot dates of the derived "published" table (inside the orders date span).
PUBLISHED_DATES = (
    "1995-07-01", "1996-02-18", "1996-10-12", "1997-11-29", "1998-05-07",
    "1998-11-11", "1999-03-31", "1999-11-07", "2000-03-31", "2001-03-31",
)


def published_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published-counts table shaped like the public CSV: ``Country`` + one column
    per report date (ISO name), blank when not reported. Counts are filled orders in
    the year before each date, per priority; one priority is left unpublished."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") != "4-NOT SPECIFIED")
    d = F.col("o_orderdate").cast("date")
    cols = []
    for v in PUBLISHED_DATES:
        hit = (F.col("o_orderstatus") == "F") & (d <= F.lit(v).cast("date")) & \
              (d > F.date_sub(F.lit(v).cast("date"), 365))
        cols.append(F.nullif(F.count_if(hit), F.lit(0)).alias(v))
    return o.groupBy(F.col("o_orderpriority").alias("Country")).agg(*cols)


def published_wide_sql() -> str:
    cols = ",\n  ".join(
        f"NULLIF(count(*) FILTER (WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) <= DATE '{v}' "
        f"AND CAST(o_orderdate AS DATE) > DATE '{v}' - 365), 0) AS \"{v}\""
        for v in PUBLISHED_DATES)
    return f"""
SELECT o_orderpriority AS "Country",
  {cols}
FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'
GROUP BY o_orderpriority"""


MOJIBAKE_IVORY = "Côte d'Ivoire".encode("utf-8").decode("latin-1")   # "CÃ´te d'Ivoire"
TPS_FORM_LONG = tuple(TPS_FORM_TYPE_LABELS)                          # re-registration, first application


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def staged_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged-like raw records (orders x customer x nation): C3 rows carry codes
    (base, alias, overlay, unknown, NULL), ELIS rows names (some double-encoded);
    every 97th row is fully empty; three note columns are all-NULL, all-redacted
    and redacted but for one value."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left")
    k = F.col("o_orderkey")
    od = F.col("o_orderdate").cast("date")
    nk = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    status = F.col("o_orderstatus")
    blank = (k % 97 == 0)

    def cell(e):
        return F.when(blank, F.lit(None)).otherwise(e)

    elis_name = (F.when(k % 4 == 0, F.lit(MOJIBAKE_IVORY)).when(k % 4 == 1, F.lit("Côte d'Ivoire"))
                  .when(k % 4 == 2, F.lit(None)).otherwise(F.col("n_name")))
    c3_code = (F.when(k % 7 == 1, F.lit("USA")).when(k % 7 == 2, F.lit("COTED")).when(k % 7 == 3, F.lit("ESAL"))
                .when(k % 7 == 4, F.lit(None)).when(k % 7 == 5, F.concat(F.lit("XX"), F.col("c_nationkey").cast("string")))
                .otherwise(nk))
    form = (F.when(k % 5 == 0, F.lit(TPS_FORM_LONG[0])).when(k % 5 == 1, F.lit(TPS_FORM_LONG[1]))
             .when(k % 5 == 2, F.lit(None)).otherwise(F.lit("TPS - Initial")))
    return j.select(
        cell(F.when(F.col("o_custkey") % 40 == 0, F.lit(None)).otherwise(F.col("o_custkey").cast("string")))
        .alias("unique_alien_id"),
        cell(F.when(k % 13 == 0, F.lit(None)).otherwise(F.trunc(od, "MM"))).alias("rec_date"),
        cell(F.when(k % 11 == 0, F.lit(None)).otherwise(F.date_add(od, (k * 7 % 400).cast("int")))).alias("decision_date"),
        cell(F.when(k % 17 == 0, F.lit(None)).otherwise(
            F.when(status == "F", "Approved").when(status == "O", "Denied").otherwise("Pending"))).alias("decision"),
        cell(F.when(k % 3 == 0, F.lit("ELIS")).otherwise(F.lit("C3"))).alias("data_source"),
        cell(F.when(k % 3 == 0, elis_name).otherwise(c3_code)).alias("ben_country_of_birth"),
        cell(F.element_at(F.array(F.lit("F"), F.lit("M"), F.lit("U"), F.lit("Female")), (k % 4 + 1).cast("int")))
        .alias("ben_gender"),
        cell(form).alias("form_type"),
        cell((F.lit(1940) + F.col("o_custkey") % 50).cast("int")).alias("ben_year_of_birth"),
        F.lit(None).cast("string").alias("notes_blank"),
        F.when(k % 3 == 0, F.lit("(b)(6)")).when(k % 3 == 1, F.lit(" B(7)c ")).otherwise(F.lit("NA"))
         .alias("notes_redacted"),
        cell(F.when(k == 7, F.lit("kept")).otherwise(F.lit("(b)(6)"))).alias("notes_one"),
        F.lit("orders.parquet").alias("file_original"),
        k.alias("row_original"),
    )


def staged_cases_sql() -> str:
    def cell(e):
        return f"CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {e} END"
    nk = "'N' || CAST(c_nationkey AS VARCHAR)"
    elis = (f"CASE o_orderkey % 4 WHEN 0 THEN {_q(MOJIBAKE_IVORY)} WHEN 1 THEN {_q("Côte d'Ivoire")} "
            f"WHEN 2 THEN NULL ELSE n_name END")
    c3 = (f"CASE o_orderkey % 7 WHEN 1 THEN 'USA' WHEN 2 THEN 'COTED' WHEN 3 THEN 'ESAL' WHEN 4 THEN NULL "
          f"WHEN 5 THEN 'XX' || CAST(c_nationkey AS VARCHAR) ELSE {nk} END")
    form = (f"CASE o_orderkey % 5 WHEN 0 THEN {_q(TPS_FORM_LONG[0])} WHEN 1 THEN {_q(TPS_FORM_LONG[1])} "
            f"WHEN 2 THEN NULL ELSE 'TPS - Initial' END")
    return f"""
SELECT
  {cell("CASE WHEN o_custkey % 40 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END")} AS unique_alien_id,
  {cell("CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END")} AS rec_date,
  {cell("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey * 7 % 400 AS INTEGER) END")} AS decision_date,
  {cell("CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Denied' ELSE 'Pending' END END")} AS decision,
  {cell("CASE WHEN o_orderkey % 3 = 0 THEN 'ELIS' ELSE 'C3' END")} AS data_source,
  {cell(f"CASE WHEN o_orderkey % 3 = 0 THEN {elis} ELSE {c3} END")} AS ben_country_of_birth,
  {cell("(['F', 'M', 'U', 'Female'])[CAST(o_orderkey % 4 + 1 AS INTEGER)]")} AS ben_gender,
  {cell(form)} AS form_type,
  {cell("CAST(1940 + o_custkey % 50 AS INTEGER)")} AS ben_year_of_birth,
  CAST(NULL AS VARCHAR) AS notes_blank,
  CASE o_orderkey % 3 WHEN 0 THEN '(b)(6)' WHEN 1 THEN ' B(7)c ' ELSE 'NA' END AS notes_redacted,
  {cell("CASE WHEN o_orderkey = 7 THEN 'kept' ELSE '(b)(6)' END")} AS notes_one,
  'orders.parquet' AS file_original,
  o_orderkey AS row_original
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"""


def nation_code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-layer code table with a base list of nation codes plus one code per
    customer (so it grows with the data; beyond the broadcast limit the lookup
    switches to a shuffle join)."""
    from caseflow.operators.lookup import country_code_table
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"))
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"), F.col("c_name").alias("name"))
    return country_code_table(spark, nations.unionByName(customers))


def nation_code_table_sql() -> str:
    """CTEs ``up`` (base upserted with the overlay) and ``codes`` (+ aliases)."""
    from caseflow.operators.lookup import COUNTRY_CODE_ALIASES, COUNTRY_CODE_OVERLAY
    ov = ", ".join(f"({_q(a)}, {_q(b)})" for a, b in COUNTRY_CODE_OVERLAY)
    al = ", ".join(f"({_q(a)}, {_q(b)})" for a, b in COUNTRY_CODE_ALIASES)
    return f"""
base AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS code, n_name AS country FROM nation
         UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), c_name FROM customer),
ov AS (SELECT * FROM (VALUES {ov}) t(code, country)),
up AS (SELECT * FROM base WHERE code NOT IN (SELECT code FROM ov) UNION ALL SELECT * FROM ov),
al AS (SELECT * FROM (VALUES {al}) t(code, canonical)),
codes AS (SELECT al.code, up.country FROM al LEFT JOIN up ON al.canonical = up.code
          UNION ALL SELECT code, country FROM up)"""


# ---- published report text, built from `part` ---------------------------------------

REPORT_FILES = ("i821_radp_fy22.txt", "I821_RADP_FY2023_Q4.txt")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, over many tasks: the table is short, but each row becomes 20 cells."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))


def _tokens() -> list[Column]:
    """The 20 value tokens of a part's report line."""
    k = F.col("p_partkey")

    def tok(i):
        m = (k + i) % 23
        num = F.format_number((k * (i + 1) * 37) % 100000, 0)
        return F.when(m == 0, F.lit("D")).when(m == 1, F.lit("H")).when(m == 2, F.lit("-")).otherwise(num)
    return [tok(i) for i in range(20)]


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text line per part: the part name, then 20 value tokens. Some lines have
    19 tokens, some 21 (a leading count, or a leading ``D`` that belongs to the
    label); spacing varies (tabs, runs of spaces)."""
    p = _parts(spark, sf_dir).select("*", F.array(*_tokens()).alias("_toks"))
    k, size, toks = F.col("p_partkey"), F.col("p_size"), F.col("_toks")
    sep = F.when(k % 5 == 0, F.lit("  \t ")).otherwise(F.lit(" "))
    body = (F.when(size % 10 == 0, F.slice(toks, 1, 19))
             .when(size % 10 == 1, F.concat(F.array(F.lit("7")), toks))
             .when(size % 10 == 2, F.concat(F.array(F.lit("D")), toks))
             .otherwise(toks))
    line = F.concat(F.when(k % 7 == 0, F.lit(" ")).otherwise(F.lit("")), F.col("p_name"), sep,
                    F.array_join(body, " "))
    src = F.when(k % 2 == 0, F.lit(REPORT_FILES[0])).otherwise(F.lit(REPORT_FILES[1]))
    return p.select(k.alias("p_partkey"), line.alias("line"), src.alias("source_file"))


def report_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 21-cell text grid per part (as read from a sheet with no header typing):
    data rows, plus title/header/footnote rows whose 2nd cell is not a value."""
    p = _parts(spark, sf_dir)
    k, size, toks = F.col("p_partkey"), F.col("p_size"), _tokens()
    second = (F.when(size % 10 == 3, F.lit("Received")).when(size % 10 == 4, F.lit(None))
               .otherwise(toks[0]))
    cells = [F.col("p_name").alias("c1"), second.alias("c2")] + [toks[i].alias(f"c{i + 2}") for i in range(1, 20)]
    src = F.when(k % 2 == 0, F.lit("i821_radp_fy2024_q4.xlsx")).otherwise(F.lit("i821_radp_fy2025_q4_v1.xlsx"))
    return p.select(k.alias("p_partkey"), *cells, src.alias("source_file"))


def report_facts_sql(kind: str = "lines") -> str:
    """Arithmetic oracle for the tidy facts of ``report_lines``/``report_grid``: which
    parts yield a data row, and each cell's value/code -- no regex involved."""
    if kind == "lines":
        keep = "p_size % 10 NOT IN (0, 1)"
        country = "p_name || CASE WHEN p_size % 10 = 2 THEN ' D' ELSE '' END"
        src = f"CASE WHEN p_partkey % 2 = 0 THEN '{REPORT_FILES[0]}' ELSE '{REPORT_FILES[1]}' END"
        fy = "CASE WHEN p_partkey % 2 = 0 THEN 2022 ELSE 2023 END"
    else:
        keep = "p_size % 10 NOT IN (3, 4)"
        country = "p_name"
        src = "CASE WHEN p_partkey % 2 = 0 THEN 'i821_radp_fy2024_q4.xlsx' ELSE 'i821_radp_fy2025_q4_v1.xlsx' END"
        fy = "CASE WHEN p_partkey % 2 = 0 THEN 2024 ELSE 2025 END"
    return f"""
facts AS (
  SELECT CAST({fy} AS INTEGER) AS fiscal_year,
    CAST(CASE WHEN i < 16 THEN i // 4 + 1 END AS INTEGER) AS quarter,
    (['Q1', 'Q2', 'Q3', 'Q4', 'FY'])[CAST(i // 4 + 1 AS INTEGER)] AS period,
    {country} AS country,
    (['received', 'approved', 'denied', 'pending'])[CAST(i % 4 + 1 AS INTEGER)] AS metric,
    CAST(CASE (p_partkey + i) % 23 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 0
         ELSE (p_partkey * (i + 1) * 37) % 100000 END AS DOUBLE) AS value,
    CASE (p_partkey + i) % 23 WHEN 0 THEN 'D' WHEN 1 THEN 'H' END AS code,
    {src} AS source_file,
    CASE (p_partkey + i) % 23 WHEN 0 THEN 'D' WHEN 1 THEN 'H' WHEN 2 THEN '-'
         ELSE format('{{:,}}', (p_partkey * (i + 1) * 37) % 100000) END AS cell
  FROM part, range(0, 20) r(i)
  WHERE {keep})"""
