"""Cleaning queries (W0-W6, W8, C1, C2, C7, J3, P1, P2, Q1, S9) and SQL oracles.

The oracles use the reference's own formulation -- one sorted window per person
with lag/cumsum -- so they check the aggregate-and-join plans independently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.columns import GENDER_LABELS, PROVENANCE, UNLISTED_COUNTRY
from caseflow.functions.dates import fiscal_year
from caseflow.functions.text import recode_values, resolve_country
from caseflow.operators.episodes import (flag_duplicates, initial_renewal, no_branch_rows,
                                          running_approvals, surrogate_key)
from caseflow.operators.lookup import lookup_left
from caseflow.operators.profile import drop_uninformative, flag_empty_rows, footer_profile
from caseflow.operators.quality import count_checks
from caseflow.plans.bindings import (MOJIBAKE_IVORY, TPS_FORM_LONG, _q, cases, cases_sql,
                                     nation_code_table, nation_code_table_sql, staged_cases,
                                     staged_cases_sql)
from caseflow.plans.catalog import register
from caseflow.plans.clean import clean_cases
from caseflow.sources.sinks import fiscal_year_units

_TPS_ORDER = "rec_date ASC NULLS LAST, decision_date ASC NULLS LAST, file_original, row_original"
_DACA_ORDER = "rec_date ASC NULLS LAST, file_original, row_original"
_W5_ORDER = "decision_date ASC NULLS LAST, rec_date ASC NULLS LAST, file_original, row_original"


def _episodes_sql(src: str, order: str) -> str:
    """CTE chain over ``src`` ending in ``f`` with nona, dup_id, rn, cnt."""
    return f"""
n AS (SELECT *, coalesce(unique_identifier,
        'noid_' || file_original || '#' || CAST(row_original AS VARCHAR)) AS nona FROM {src}),
l AS (SELECT *, lag(rec_date) OVER (PARTITION BY nona ORDER BY {order}) AS prev FROM n),
e AS (SELECT *, sum(CASE WHEN rec_date IS NOT NULL AND prev IS NOT NULL AND rec_date = prev THEN 0 ELSE 1 END)
        OVER (PARTITION BY nona ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS dup_id FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY nona, dup_id ORDER BY {order}) AS rn,
        count(*) OVER (PARTITION BY nona, dup_id) AS cnt FROM e)"""


_FLAGS = """CAST(dup_id AS INTEGER) AS duplicate_identifier, rn = cnt AS duplicate_last,
  CASE WHEN unique_identifier IS NULL OR rec_date IS NULL THEN NULL ELSE cnt > 1 END AS duplicate_likely,
  coalesce(CASE WHEN unique_identifier IS NULL OR rec_date IS NULL THEN NULL ELSE cnt > 1 END, false)
    AND NOT (rn = cnt) AS duplicate_drop_row"""


def _flags_sql(order: str, cols: str) -> str:
    return f"WITH c AS ({cases_sql(monthly=True)}),{_episodes_sql('c', order)}\nSELECT row_original, {cols} FROM f"


def _monthly(spark, sf_dir):
    return cases(spark, sf_dir, monthly=True)


@register("surrogate_key", f"""WITH c AS ({cases_sql(monthly=True)})
SELECT row_original, coalesce(unique_identifier, 'noid_' || file_original || '#' || CAST(row_original AS VARCHAR))
  AS unique_identifier_nona FROM c""")
def q_surrogate_key(spark, sf_dir):
    """Id-less rows become their own person."""
    return surrogate_key(_monthly(spark, sf_dir)).select("row_original", "unique_identifier_nona")


@register("episode_id", _flags_sql(_TPS_ORDER, "CAST(dup_id AS INTEGER) AS duplicate_identifier"))
def q_episode_id(spark, sf_dir):
    """Filing episode number per person (runs of equal rec_date; NULL dates alone)."""
    return flag_duplicates(_monthly(spark, sf_dir), order="tps").select("row_original", "duplicate_identifier")


@register("dup_last_tps", _flags_sql(_TPS_ORDER, "rn = cnt AS duplicate_last"))
def q_dup_last_tps(spark, sf_dir):
    """W2, TPS order: decision_date (NULL last) before provenance."""
    return flag_duplicates(_monthly(spark, sf_dir), order="tps").select("row_original", "duplicate_last")


@register("dup_last_daca", _flags_sql(_DACA_ORDER, "CAST(dup_id AS INTEGER) AS duplicate_identifier, "
                                                   "rn = cnt AS duplicate_last"))
def q_dup_last_daca(spark, sf_dir):
    """W2, DACA order: provenance decides inside an episode."""
    return flag_duplicates(_monthly(spark, sf_dir), order="daca").select(
        "row_original", "duplicate_identifier", "duplicate_last")


@register("dup_likely", _flags_sql(_TPS_ORDER, "CASE WHEN unique_identifier IS NULL OR rec_date IS NULL "
                                               "THEN NULL ELSE cnt > 1 END AS duplicate_likely"))
def q_dup_likely(spark, sf_dir):
    """Likely duplicate (NULL when undecidable)."""
    return flag_duplicates(_monthly(spark, sf_dir), order="tps").select("row_original", "duplicate_likely")


@register("dup_drop_row", _flags_sql(_TPS_ORDER, _FLAGS))
def q_dup_drop_row(spark, sf_dir):
    """W1-W4 together: all four duplicate columns."""
    return flag_duplicates(_monthly(spark, sf_dir), order="tps").select("row_original", *(
        "duplicate_identifier", "duplicate_last", "duplicate_likely", "duplicate_drop_row"))


_W5_SQL = f"""WITH c AS ({cases_sql(monthly=True)}),
c3 AS (SELECT *,
  sum(CASE WHEN decision = 'Approved' THEN 1 ELSE 0 END) OVER w AS n_appr,
  sum(CASE WHEN decision IS NULL THEN 1 ELSE 0 END) OVER w AS n_null
  FROM c WHERE data_source = 'C3' AND unique_identifier IS NOT NULL
  WINDOW w AS (PARTITION BY unique_identifier ORDER BY {_W5_ORDER} ROWS UNBOUNDED PRECEDING))"""


@register("running_approvals", _W5_SQL + """
SELECT row_original, CASE WHEN n_null > 0 THEN NULL ELSE CAST(n_appr AS BIGINT) END AS n_approvals FROM c3""")
def q_running_approvals(spark, sf_dir):
    """NULL-sticky running approvals per person (C3 rows with an id)."""
    c = _monthly(spark, sf_dir)
    c3 = c.filter((F.col("data_source") == "C3") & F.col("unique_identifier").isNotNull())
    return running_approvals(c3).select("row_original", "n_approvals")


@register("initial_renewal", _W5_SQL + """
SELECT row_original, CASE WHEN n_null > 0 THEN NULL WHEN n_appr <= 1 THEN 'DACA - Initial'
                          ELSE 'DACA - Renewal' END AS form_type_filled_in FROM c3
UNION ALL
SELECT row_original, form_type FROM c WHERE data_source = 'ELIS' OR unique_identifier IS NULL""")
def q_initial_renewal(spark, sf_dir):
    """First-time vs renewal filings inferred from running approvals."""
    return initial_renewal(_monthly(spark, sf_dir)).select("row_original", "form_type_filled_in")


@register("fiscal_year", f"""WITH c AS ({cases_sql()})
SELECT row_original, CAST(year(rec_date) + CASE WHEN month(rec_date) >= 10 THEN 1 ELSE 0 END AS INTEGER)
  AS fiscal_year FROM c""")
def q_fiscal_year(spark, sf_dir):
    """Federal fiscal year of rec_date (Oct-Sep), NULL unknown."""
    return _monthly(spark, sf_dir).select("row_original", fiscal_year("rec_date").alias("fiscal_year"))


def _units_sql(max_rows: int, label: str) -> str:
    return f"""WITH c AS ({cases_sql()}),
y AS (SELECT *, CAST(year(rec_date) + CASE WHEN month(rec_date) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fy FROM c),
r AS (SELECT *, CAST(ceil(row_number() OVER (PARTITION BY fy ORDER BY file_original, row_original)
                          / {max_rows}.0) AS INTEGER) AS chunk FROM y),
u AS (SELECT *, '{label} ' || CASE WHEN fy IS NULL THEN 'FY unknown' ELSE 'FY' || CAST(fy AS VARCHAR) END
              || CASE WHEN chunk > 1 THEN ' (' || CAST(chunk AS VARCHAR) || ')' ELSE '' END AS sheet FROM r)"""


@register("fiscal_year_units", _units_sql(1048575, "TPS") + "\nSELECT DISTINCT fy, chunk, sheet FROM u")
def q_fiscal_year_units(spark, sf_dir):
    """Output unit names, one per fiscal year (default 1,048,575-row cap)."""
    return fiscal_year_units(cases(spark, sf_dir), label="TPS").select("fy", "chunk", "sheet").distinct()


@register("fiscal_year_chunks", _units_sql(1000, "DACA") + "\nSELECT row_original, fy, chunk, sheet FROM u")
def q_fiscal_year_chunks(spark, sf_dir):
    """Every row's unit when a year holds more rows than one unit (cap 1,000 here
    so chunking happens at test scale); positions come from the skew-safe ranking."""
    return fiscal_year_units(cases(spark, sf_dir), label="DACA", max_rows=1000).select(
        "row_original", "fy", "chunk", "sheet")


@register("recode_values", f"""WITH c AS ({cases_sql()})
SELECT row_original, CASE ben_gender WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' WHEN 'U' THEN 'Unknown'
  ELSE ben_gender END AS ben_gender FROM c""")
def q_recode_values(spark, sf_dir):
    """Exact-match value recode; other values kept."""
    return cases(spark, sf_dir).select("row_original", recode_values("ben_gender", GENDER_LABELS).alias("ben_gender"))


def _resolve_sql(default: str) -> str:
    return f"""WITH s AS ({staged_cases_sql()}),
{nation_code_table_sql()[1:]}
SELECT s.row_original, s.ben_country_of_birth AS raw_code, codes.country,
  CASE WHEN s.data_source = 'ELIS' THEN (CASE WHEN s.ben_country_of_birth = {_q(MOJIBAKE_IVORY)}
                                              THEN {_q("Côte d'Ivoire")} ELSE s.ben_country_of_birth END)
       WHEN codes.country IS NOT NULL THEN codes.country ELSE {default} END AS ben_country_of_birth
FROM s LEFT JOIN codes ON s.ben_country_of_birth = codes.code"""


def _resolved(spark, sf_dir, default):
    s = staged_cases(spark, sf_dir)
    j = lookup_left(s, nation_code_table(spark, sf_dir), "ben_country_of_birth")
    return j.select("row_original", F.col("ben_country_of_birth").alias("raw_code"), "country",
                    resolve_country("ben_country_of_birth", "data_source", "country", default)
                    .alias("ben_country_of_birth"))


@register("lookup_left", f"""WITH s AS ({staged_cases_sql()}),
{nation_code_table_sql()[1:]}
SELECT s.row_original, s.ben_country_of_birth, codes.country
FROM s LEFT JOIN codes ON s.ben_country_of_birth = codes.code""")
def q_lookup_left(spark, sf_dir):
    """Row-count preserving code lookup (base, overlay, alias, unknown, NULL)."""
    s = staged_cases(spark, sf_dir)
    return lookup_left(s, nation_code_table(spark, sf_dir), "ben_country_of_birth", check_unique=True) \
        .select("row_original", "ben_country_of_birth", "country")


@register("country_resolve_tps", _resolve_sql(_q(UNLISTED_COUNTRY)))
def q_country_resolve_tps(spark, sf_dir):
    """C2, TPS: unresolved codes (and NULL) -> the "Unlisted" label."""
    return _resolved(spark, sf_dir, UNLISTED_COUNTRY)


@register("country_resolve_daca", _resolve_sql("NULL"))
def q_country_resolve_daca(spark, sf_dir):
    """C2, DACA: unresolved codes -> NULL."""
    return _resolved(spark, sf_dir, None)


_KEPT = ("unique_alien_id", "rec_date", "decision_date", "decision", "data_source", "ben_country_of_birth",
         "ben_gender", "form_type", "ben_year_of_birth", "notes_one")
_REDACTED = " AND ".join(f"{c} IS NULL" for c in _KEPT)


@register("drop_uninformative", f"""WITH s AS ({staged_cases_sql()})
SELECT {", ".join(_KEPT)}, file_original, row_original FROM s""")
def q_drop_uninformative(spark, sf_dir):
    """All-NULL and all-redacted columns removed; one informative value keeps a column."""
    return drop_uninformative(staged_cases(spark, sf_dir), keep=PROVENANCE)


@register("footer_profile", f"""WITH s AS ({staged_cases_sql()})
SELECT {", ".join(_KEPT)}, file_original, row_original FROM s""")
def q_footer_profile(spark, sf_dir):
    """P1 by metadata: Parquet footers decide columns without values and those of other types than text; the data
    scan of the profile reads the others only."""
    df = _staged_on_disk(spark, sf_dir)
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    return drop_uninformative(df, keep=PROVENANCE, known=footer_profile(spark, path, df.schema))


@register("flag_empty_rows", f"""WITH s AS ({staged_cases_sql()})
SELECT row_original, {_REDACTED} AS row_redacted FROM s""")
def q_flag_empty_rows(spark, sf_dir):
    """Rows empty in every column but provenance (after P1)."""
    d = drop_uninformative(staged_cases(spark, sf_dir), keep=PROVENANCE)
    return flag_empty_rows(d).select("row_original", "row_redacted")


@register("reconcile_counts", f"""WITH s AS ({staged_cases_sql()})
SELECT count(*) AS n_rows,
  count(*) FILTER (WHERE {_REDACTED}) AS n_redacted,
  count(*) FILTER (WHERE NOT ({_REDACTED}) AND NOT coalesce(data_source = 'C3' AND unique_alien_id IS NOT NULL, false)
                   AND NOT coalesce(data_source = 'ELIS' OR unique_alien_id IS NULL, false)) AS rows_in_no_branch
FROM s""")
def q_reconcile_counts(spark, sf_dir):
    """Q1: the counts the cleaning plan reconciles (rows, empty rows, rows no branch keeps)."""
    d = flag_empty_rows(drop_uninformative(staged_cases(spark, sf_dir), keep=PROVENANCE))
    d = d.withColumnRenamed("unique_alien_id", "unique_identifier")
    return count_checks(d, {"n_redacted": F.col("row_redacted"),
                            "rows_in_no_branch": ~F.col("row_redacted") & no_branch_rows()})


def _clean_sql(form: str) -> str:
    tps = form == "tps"
    order = _TPS_ORDER if tps else _DACA_ORDER
    default = _q(UNLISTED_COUNTRY) if tps else "NULL"
    form_expr = (f"CASE form_type WHEN {_q(TPS_FORM_LONG[0])} THEN 'TPS - Re-registration' "
                 f"WHEN {_q(TPS_FORM_LONG[1])} THEN 'TPS - Initial' ELSE form_type END") if tps else "form_type"
    body = f"""WITH s AS ({staged_cases_sql()}),
{nation_code_table_sql()[1:]},
j AS (SELECT s.*, codes.country AS _country FROM s LEFT JOIN codes ON s.ben_country_of_birth = codes.code),
r AS (SELECT unique_alien_id AS unique_identifier,
  CASE WHEN data_source = 'ELIS' THEN (CASE WHEN ben_country_of_birth = {_q(MOJIBAKE_IVORY)}
                                            THEN {_q("Côte d'Ivoire")} ELSE ben_country_of_birth END)
       WHEN _country IS NOT NULL THEN _country ELSE {default} END AS ben_country_of_birth,
  CASE ben_gender WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' WHEN 'U' THEN 'Unknown' ELSE ben_gender END AS ben_gender,
  {form_expr} AS form_type,
  data_source, decision, rec_date, decision_date, ben_year_of_birth, notes_one, file_original, row_original,
  {_REDACTED} AS row_redacted
  FROM j),{_episodes_sql('r', order)},
g AS (SELECT unique_identifier, ben_country_of_birth, ben_gender, form_type, data_source, decision, rec_date,
        decision_date, ben_year_of_birth, notes_one, {_FLAGS}, file_original, row_original
      FROM f WHERE NOT row_redacted)"""
    if tps:
        return body + "\nSELECT * FROM g"
    return body + f""",
c3 AS (SELECT *,
  sum(CASE WHEN decision = 'Approved' THEN 1 ELSE 0 END) OVER w AS n_appr,
  sum(CASE WHEN decision IS NULL THEN 1 ELSE 0 END) OVER w AS n_null
  FROM g WHERE data_source = 'C3' AND unique_identifier IS NOT NULL
  WINDOW w AS (PARTITION BY unique_identifier ORDER BY {_W5_ORDER} ROWS UNBOUNDED PRECEDING))
SELECT * EXCLUDE (n_appr, n_null), CASE WHEN n_null > 0 THEN NULL WHEN n_appr <= 1 THEN 'DACA - Initial'
  ELSE 'DACA - Renewal' END AS form_type_filled_in FROM c3
UNION ALL SELECT *, form_type AS form_type_filled_in FROM g WHERE data_source = 'ELIS' OR unique_identifier IS NULL"""


def _staged_on_disk(spark, sf_dir):
    """The staging boundary, as in the real workflow: staged records are written once
    as zstd Parquet and the cleaner reads them back (profile, checks and the plan
    then scan Parquet instead of re-deriving the fixture). Several files, as a release has
    them: the one row group of the test table would otherwise be one task throughout."""
    from caseflow.plans.queries_io import scratch
    from caseflow.sources.sinks import write_parquet
    from caseflow.sources.staging import scan_parquet
    path = scratch(spark, "staged")
    files = spark.sparkContext.defaultParallelism
    write_parquet(staged_cases(spark, sf_dir).repartition(files, "row_original"), path)
    return scan_parquet(spark, path)


@register("clean_tps", _clean_sql("tps"))
def q_clean_tps(spark, sf_dir):
    """The TPS cleaning plan end to end (P1, P2, J3, C1, C2, W0-W4, Q1) on staged Parquet."""
    return clean_cases(_staged_on_disk(spark, sf_dir), nation_code_table(spark, sf_dir), form="tps")


@register("clean_daca", _clean_sql("daca"))
def q_clean_daca(spark, sf_dir):
    """The DACA cleaning plan end to end (adds W5/W6 initial vs renewal) on staged Parquet."""
    return clean_cases(_staged_on_disk(spark, sf_dir), nation_code_table(spark, sf_dir), form="daca")
