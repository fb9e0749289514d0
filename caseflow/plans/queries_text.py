"""Scalar, report and profiling queries (C3-C5, C8-C10, C14, C16, X1, X2, U3, S1,
S2, A9, P3, P5, P6, O1, O2) and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.columns import REPORT_CELL_COLS
from caseflow.functions.dates import serial_to_date
from caseflow.functions.reports import fiscal_year_from_name, grid_data_rows, parse_report_line, quarter_from_period
from caseflow.functions.text import redaction_flag, repair_mojibake, squish, suppressed_value, suppression_code, to_int
from caseflow.operators.profile import narrow_datetime, profile_all
from caseflow.operators.reshape import across, columns_of, explode_list, sort_nulls_last, union_by_name, unpivot_compound
from caseflow.plans.bindings import (cases, cases_sql, report_facts_sql, report_grid, report_lines,
                                     table)
from caseflow.plans.catalog import register
from caseflow.plans.public_facts import public_facts
from caseflow.sources.staging import null_markers, stage_typed

_WS_SQL = r"[\t\n\f\r\p{Z}]+"


@register("squish", rf"""SELECT doc_id, trim(regexp_replace(text, '{_WS_SQL}', ' ', 'g')) AS text FROM documents""")
def q_squish(spark, sf_dir):
    """Whole document texts with whitespace runs collapsed and trimmed."""
    return table(spark, sf_dir, "documents").select("doc_id", squish("text").alias("text"))


@register("repair_mojibake", "SELECT doc_id, text FROM documents")
def q_repair_mojibake(spark, sf_dir):
    """C4: even documents are double-encoded (UTF-8 read as Latin-1), then repaired;
    odd ones pass through. The result must be every original text."""
    d = table(spark, sf_dir, "documents")
    broken = F.when(F.col("doc_id") % 2 == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return d.select("doc_id", repair_mojibake(broken).alias("text"))


@register("redaction_flag", r"""SELECT doc_id, coalesce(regexp_matches(text, '(?i)\(b\)|b\([0-9]\)'), false)
  AS redacted FROM documents""")
def q_redaction_flag(spark, sf_dir):
    """FOIA redaction code anywhere in a document (NULL -> false)."""
    return table(spark, sf_dir, "documents").select("doc_id", redaction_flag("text").alias("redacted"))


_SERIAL_SRC = """CASE WHEN o_orderkey % 4 = 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y/%m/%d')
     WHEN o_orderkey % 4 = 1 THEN 'not a date'
     ELSE CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) + (o_orderkey % 10) / 10.0 AS VARCHAR) END"""


@register("serial_to_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN NULL
  ELSE CAST(o_orderdate AS DATE) END AS d FROM orders""")
def q_serial_to_date(spark, sf_dir):
    """Spreadsheet serials (with a time fraction) and slash dates -> DATE."""
    o = table(spark, sf_dir, "orders")
    od = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey")
    serial = (F.datediff(od, F.lit("1899-12-30").cast("date")) + (k % 10) / 10.0).cast("string")
    src = (F.when(k % 4 == 0, F.date_format(od, "yyyy/MM/dd")).when(k % 4 == 1, F.lit("not a date"))
            .otherwise(serial))
    return o.select("o_orderkey", serial_to_date(src).alias("d"))


@register("year_to_int", """SELECT o_orderkey, CAST(trunc(o_totalprice / 1000 - 150) AS INTEGER) AS y FROM orders""")
def q_year_to_int(spark, sf_dir):
    """Numeric text -> int, truncating toward zero (-1.9 -> -1)."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", to_int((F.col("o_totalprice") / 1000 - 150).cast("string")).alias("y"))


_LINES_FACTS = "WITH" + report_facts_sql("lines")
_GRID_FACTS = "WITH" + report_facts_sql("grid")


@register("parse_report_line", _LINES_FACTS + """
SELECT country, source_file, period || '.' || metric AS cell_name, cell FROM facts""")
def q_parse_report_line(spark, sf_dir):
    """Label + exactly 20 value tokens per line; other lines dropped. Shown long
    (one row per cell) so the oracle can state it arithmetically."""
    wide = parse_report_line(report_lines(spark, sf_dir))
    return wide.unpivot(["country", "source_file"], [F.col(f"`{c}`").alias(c) for c in REPORT_CELL_COLS],
                        "cell_name", "cell")


@register("unpivot_compound", _LINES_FACTS + """
SELECT country, source_file, period, metric, cell AS value FROM facts""")
def q_unpivot_compound(spark, sf_dir):
    """``Q1.received``-style columns -> (period, metric, value)."""
    return unpivot_compound(parse_report_line(report_lines(spark, sf_dir)), ["country", "source_file"])


@register("grid_data_rows", _GRID_FACTS + """
SELECT country, source_file, period || '.' || metric AS cell_name, cell FROM facts""")
def q_grid_data_rows(spark, sf_dir):
    """Only grid rows whose 2nd cell is a count or code (title/header rows dropped)."""
    g = grid_data_rows(report_grid(spark, sf_dir), [f"c{i}" for i in range(1, 22)])
    return g.unpivot(["country", "source_file"], [F.col(f"`{c}`").alias(c) for c in REPORT_CELL_COLS],
                     "cell_name", "cell")


@register("suppressed_value", _LINES_FACTS + "\nSELECT country, source_file, period, metric, value, code FROM facts")
def q_suppressed_value(spark, sf_dir):
    """Counts with thousands commas; ``-`` = 0; D/H -> NULL value + code."""
    long = unpivot_compound(parse_report_line(report_lines(spark, sf_dir)), ["country", "source_file"])
    return long.select("country", "source_file", "period", "metric",
                       suppressed_value("value").alias("value"), suppression_code("value").alias("code"))


@register("extract_fy_quarter", _LINES_FACTS + "\nSELECT DISTINCT source_file, period, fiscal_year, quarter FROM facts")
def q_extract_fy_quarter(spark, sf_dir):
    """Fiscal year from the file name (FY22 -> 2022), quarter from the period."""
    long = unpivot_compound(parse_report_line(report_lines(spark, sf_dir)), ["country", "source_file"])
    return long.select("source_file", "period", fiscal_year_from_name("source_file").alias("fiscal_year"),
                       quarter_from_period("period").alias("quarter")).distinct()


@register("public_facts", """WITH""" + report_facts_sql("lines").replace("facts AS", "f1 AS", 1) + "," +
          report_facts_sql("grid").replace("facts AS", "f2 AS", 1) + """
SELECT fiscal_year, quarter, period, country, metric, value, code, source_file FROM f1
UNION ALL SELECT fiscal_year, quarter, period, country, metric, value, code, source_file FROM f2""")
def q_public_facts(spark, sf_dir):
    """The report-to-facts plan end to end: text lines and sheet grids, stacked."""
    return public_facts(report_lines(spark, sf_dir), report_grid(spark, sf_dir), sort=True)


# ---- staging, typing and profiling over text versions of `orders` ---------------------

def _raw_orders(spark, sf_dir):
    """`orders` as an all-text extract with reference column names and markers."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    od = F.col("o_orderdate").cast("date")
    serial = F.datediff(od, F.lit("1899-12-30").cast("date")).cast("string")
    return o.select(
        k.cast("string").alias("case_number"),
        F.when(k % 4 == 0, serial).when(k % 4 == 1, F.lit("null"))
         .otherwise(F.date_format(od, "yyyy-MM-dd")).alias("rec_date"),
        F.when(k % 3 == 0, F.lit("(b)(6)"))
         .otherwise(F.concat(F.date_format(od, "yyyy-MM-dd"), F.lit(" 09:30:00"))).alias("decision_date"),
        F.when(k % 5 == 0, F.lit("-1.9")).otherwise((F.lit(1900) + F.col("o_custkey") % 100 + 0.5).cast("string"))
         .alias("ben_year_of_birth"),
        F.when(k % 6 == 0, F.lit("null")).when(k % 6 == 1, F.lit(" (b)(6) "))
         .when(k % 6 == 2, F.lit("(b)(3) (b)(6) (b)(7)(c)")).when(k % 6 == 3, F.lit("   "))
         .otherwise(F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


_RAW_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS case_number,
  CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS rec_date,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + INTERVAL 9 HOUR + INTERVAL 30 MINUTE END
    AS decision_date,
  CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE CAST(1900 + o_custkey % 100 AS INTEGER) END AS ben_year_of_birth,
  CASE WHEN o_orderkey % 6 IN (0, 1, 2, 3) THEN NULL ELSE o_orderpriority END AS priority,
  o_orderstatus AS status
FROM orders"""


@register("null_markers", """SELECT CAST(o_orderkey AS VARCHAR) AS case_number,
  CASE WHEN o_orderkey % 6 IN (0, 1, 2, 3) THEN NULL ELSE o_orderpriority END AS priority FROM orders""")
def q_null_markers(spark, sf_dir):
    """Marker cells (``null``, redaction codes) and blanks -> NULL, others trimmed."""
    return _raw_orders(spark, sf_dir).select("case_number", null_markers("priority").alias("priority"))


@register("stage_typed", f"""WITH r AS ({_RAW_SQL})
SELECT case_number, CAST(rec_date AS DATE) AS rec_date, decision_date, ben_year_of_birth, priority, status FROM r""")
def q_stage_typed(spark, sf_dir):
    """S1 (+S2, C8): typed by column name; rec_date all-midnight -> DATE, decision_date
    keeps its times -> TIMESTAMP; year text -> int."""
    return stage_typed(_raw_orders(spark, sf_dir))


@register("narrow_datetime", """SELECT event_id, ts, CAST(date_trunc('day', ts) AS DATE) AS day FROM events""")
def q_narrow_datetime(spark, sf_dir):
    """Of two timestamp columns only the all-midnight one becomes DATE."""
    e = table(spark, sf_dir, "events")
    return narrow_datetime(e.select("event_id", "ts", F.date_trunc("DAY", "ts").alias("day")))


@register("profile_all", """SELECT
  coalesce(bool_and(o_totalprice > 0), true) AS price_positive,
  coalesce(bool_and(o_orderstatus IN ('F', 'O', 'P')), true) AS status_known,
  coalesce(bool_and(o_orderkey < 0) FILTER (WHERE o_orderkey < 0), true) AS empty_is_true
FROM orders""")
def q_profile_all(spark, sf_dir):
    """all(...) per predicate, NULL ignored, TRUE on no rows."""
    o = table(spark, sf_dir, "orders")
    return profile_all(o, {
        "price_positive": F.col("o_totalprice") > 0,
        "status_known": F.col("o_orderstatus").isin("F", "O", "P"),
        "empty_is_true": F.when(F.col("o_orderkey") < 0, F.col("o_orderkey") < 0),
    })


@register("across_typed", f"""WITH c AS ({cases_sql()})
SELECT row_original, upper(unique_identifier) AS unique_identifier, upper(decision) AS decision,
  upper(ben_country_of_birth) AS ben_country_of_birth, upper(data_source) AS data_source,
  upper(form_type) AS form_type, upper(ben_gender) AS ben_gender, upper(file_original) AS file_original,
  rec_date + 1 AS rec_date, decision_date + 1 AS decision_date FROM c""")
def q_across_typed(spark, sf_dir):
    """One expression over every column of a type (text upper-cased, dates +1 day)."""
    c = cases(spark, sf_dir)
    c = across(c, columns_of(c, T.StringType), F.upper)
    return across(c, columns_of(c, T.DateType), lambda d: F.date_add(d, 1))


@register("explode_list", """SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL""")
def q_explode_list(spark, sf_dir):
    """U4: one row per element of a list column (the lines of a text)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    return explode_list(docs, "lines", "line").select("doc_id", "line")


@register("filter_multi", f"""WITH c AS ({cases_sql()})
SELECT row_original, ben_country_of_birth, decision_date FROM c
WHERE ben_country_of_birth = '2-HIGH' AND decision_date <= DATE '1998-01-01' AND unique_identifier IS NOT NULL""")
def q_filter_multi(spark, sf_dir):
    """Conjunctive filter; NULL predicates drop the row (pushed into the scan)."""
    c = cases(spark, sf_dir)
    return c.filter((F.col("ben_country_of_birth") == "2-HIGH") & (F.col("decision_date") <= F.lit("1998-01-01"))
                    & F.col("unique_identifier").isNotNull()).select("row_original", "ben_country_of_birth",
                                                                     "decision_date")


@register("rename_relocate", f"""WITH c AS ({cases_sql()})
SELECT unique_identifier AS unique_alien_id, decision, rec_date, file_original, row_original FROM c""")
def q_rename_relocate(spark, sf_dir):
    """P5: rename a column, move provenance last."""
    c = cases(spark, sf_dir).select("file_original", "row_original", "unique_identifier", "decision", "rec_date")
    c = c.withColumnRenamed("unique_identifier", "unique_alien_id")
    tail = ["file_original", "row_original"]
    return c.select(*[x for x in c.columns if x not in tail], *tail)


@register("sort_nulls_last", f"""WITH c AS ({cases_sql()})
SELECT row_original, rec_date, decision_date FROM c""")
def q_sort_nulls_last(spark, sf_dir):
    """O1: multi-key sort with NULLs last (rows compared order-insensitively here;
    the unit tests check the order)."""
    c = cases(spark, sf_dir).select("row_original", "rec_date", "decision_date")
    return sort_nulls_last(c, "rec_date", "decision_date", "row_original")


@register("union_by_name", f"""WITH c AS ({cases_sql()})
SELECT row_original, data_source, decision FROM c""")
def q_union_by_name(spark, sf_dir):
    """O2: ELIS and C3 subsets with different column orders stacked by name."""
    c = cases(spark, sf_dir)
    a = c.filter(F.col("data_source") == "ELIS").select("decision", "row_original", "data_source")
    b = c.filter(F.col("data_source") == "C3").select("row_original", "data_source", "decision")
    return union_by_name([a, b])
