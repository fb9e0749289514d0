"""Panel queries (W7, W9, J4, J6-J8, A1-A8, U1, U2, C12) and their SQL oracles.

Oracles compute each snapshot by brute force (every row paired with every date,
first/last row by ``row_number``), independently of the sweep plan.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.columns import THRESHOLDS
from caseflow.operators import panel as P
from caseflow.operators.lookup import semi_filter
from caseflow.operators.reshape import unpivot_measures
from caseflow.plans import person_panel as PP
from caseflow.plans.bindings import PUBLISHED_DATES, cases, cases_sql, published_wide, published_wide_sql
from caseflow.plans.catalog import register

AS_OF = "1998-06-30"
AS_OF_STRICT = "1999-12-31"

_ORDER = "rec_date ASC NULLS LAST, decision_date ASC NULLS LAST, file_original, row_original"
_ORDER_DESC = "rec_date DESC NULLS FIRST, decision_date DESC NULLS FIRST, file_original DESC, row_original DESC"

_QUARTERS = """
b AS (SELECT min(rec_date) AS s, max(rec_date) AS e FROM p),
qi AS (SELECT s, e, unnest(generate_series(0, CAST(date_diff('month', s, e) / 3 AS BIGINT) + 1)) AS i FROM b),
qs AS (SELECT CAST(CAST(date_trunc('month', s) AS DATE) + to_months(CAST(3 * i AS INTEGER)) AS DATE)
              + CAST(day(s) - 1 AS INTEGER) AS v, e FROM qi),
dates AS (SELECT v FROM qs WHERE v <= e)"""

_PUB_DATES = "dates AS (SELECT CAST(v AS DATE) AS v FROM (VALUES {}) t(v))".format(
    ", ".join(f"('{d}')" for d in PUBLISHED_DATES))


def _counts(latest: str, v: str) -> str:
    return ",\n  ".join(
        f"CAST(sum(CASE WHEN {latest} >= {v} - {n} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"
        for name, n in THRESHOLDS)


def _brute_panel(dates_cte: str, date_name: str) -> str:
    """Per (person, v): rows decided by v; country of the first row, latest decision
    of the last row if any row is approved; then counts per country."""
    return f"""
WITH c AS ({cases_sql()}),
p AS (SELECT * FROM c WHERE unique_identifier IS NOT NULL),
{dates_cte},
ev AS (SELECT p.*, d.v FROM p JOIN dates d ON p.decision_date <= d.v),
r AS (SELECT unique_identifier, v, ben_country_of_birth, decision_date,
        row_number() OVER (PARTITION BY unique_identifier, v ORDER BY {_ORDER}) AS rf,
        row_number() OVER (PARTITION BY unique_identifier, v ORDER BY {_ORDER_DESC}) AS rl,
        max(CASE WHEN decision = 'Approved' THEN 1 ELSE 0 END) OVER (PARTITION BY unique_identifier, v) AS ok
      FROM ev),
per AS (SELECT unique_identifier, v,
          max(CASE WHEN rf = 1 THEN ben_country_of_birth END) AS ben_country_of_birth,
          max(CASE WHEN rl = 1 AND ok = 1 THEN decision_date END) AS latest
        FROM r GROUP BY unique_identifier, v)
SELECT ben_country_of_birth, v AS {date_name},
  {_counts('latest', 'v')}
FROM per GROUP BY ben_country_of_birth, v"""


_PANEL_Q_SQL = _brute_panel(_QUARTERS, "quarter")
_PANEL_PUB_SQL = _brute_panel(_PUB_DATES, "report_date")

def _pub_sql_body() -> str:
    """CTEs ``pw`` (wide), ``pubc`` (published countries), ``pub`` (long, blank -> 0)."""
    cells = "\n  UNION ALL ".join(
        f"SELECT \"Country\" AS country, DATE '{d}' AS report_date, "
        f"CAST(coalesce(\"{d}\", 0) AS DOUBLE) AS value, 'CRS' AS source FROM pw"
        for d in PUBLISHED_DATES)
    return f"""
pw AS ({published_wide_sql()}),
pubc AS (SELECT DISTINCT "Country" AS country FROM pw),
pub AS ({cells})"""


_LUMPED_SQL = f"""
WITH pp AS ({_PANEL_PUB_SQL}),
{_pub_sql_body()[1:]},
lumped AS (
  SELECT CASE WHEN pubc.country IS NOT NULL THEN pp.ben_country_of_birth ELSE 'All other countries' END AS country,
         pp.report_date,
         CAST(sum(approved_within_6) AS BIGINT) AS approved_within_6,
         CAST(sum(approved_within_12) AS BIGINT) AS approved_within_12,
         CAST(sum(approved_within_18) AS BIGINT) AS approved_within_18
  FROM pp LEFT JOIN pubc ON pp.ben_country_of_birth = pubc.country
  GROUP BY 1, 2)"""


def _cases(spark, sf_dir):
    return cases(spark, sf_dir)


def _pub_long(spark, sf_dir):
    return PP.published_long(published_wide(spark, sf_dir))


@register("snapshot_panel_quarterly", _PANEL_Q_SQL)
def snapshot_panel_quarterly(spark, sf_dir):
    """A7 flagship: quarterly snapshots, interval-sweep plan."""
    return PP.quarterly_panel(_cases(spark, sf_dir), method="sweep")


@register("snapshot_panel_quarterly_explode", _PANEL_Q_SQL)
def snapshot_panel_quarterly_explode(spark, sf_dir):
    """A7 with the explode plan (rows x dates); must equal the sweep."""
    return PP.quarterly_panel(_cases(spark, sf_dir), method="explode")


@register("snapshot_panel_published", _PANEL_PUB_SQL)
def snapshot_panel_published(spark, sf_dir):
    """A7 at the published report dates (taken from the published table's header)."""
    return PP.published_panel(_cases(spark, sf_dir), _pub_long(spark, sf_dir))


@register("unpivot_dates", f"WITH {_pub_sql_body()[1:]}\nSELECT country, report_date, value, source FROM pub")
def q_unpivot_dates(spark, sf_dir):
    """U2 (+S6 clean_names): wide published counts -> long, blanks as 0."""
    return _pub_long(spark, sf_dir)


@register("lump_other", _LUMPED_SQL + "\nSELECT * FROM lumped")
def q_lump_other(spark, sf_dir):
    """A8 + J5: unpublished countries and NULL lumped into "All other countries"."""
    pub = _pub_long(spark, sf_dir)
    return P.lump_other(PP.published_panel(_cases(spark, sf_dir), pub), PP.published_countries(pub))


_EST_LONG = """
est AS (SELECT country, report_date, 'approved_within_6' AS source, approved_within_6 AS v FROM lumped
        UNION ALL SELECT country, report_date, 'approved_within_12', approved_within_12 FROM lumped
        UNION ALL SELECT country, report_date, 'approved_within_18', approved_within_18 FROM lumped)"""


@register("panel_vs_published", _LUMPED_SQL + "," + _EST_LONG + """
SELECT country, report_date, source, CAST(v AS DOUBLE) AS value FROM est
UNION ALL SELECT country, report_date, source, value FROM pub""")
def q_panel_vs_published(spark, sf_dir):
    """Estimates (unpivoted) stacked on the published series."""
    return PP.compare_to_published(_cases(spark, sf_dir), published_wide(spark, sf_dir))


_LUMPED_Q_SQL = f"""
WITH pp AS ({_PANEL_Q_SQL}),
{_pub_sql_body()[1:]},
lumped AS (
  SELECT CASE WHEN pubc.country IS NOT NULL THEN pp.ben_country_of_birth ELSE 'All other countries' END AS country,
         pp.quarter AS report_date, {", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n, _ in THRESHOLDS)}
  FROM pp LEFT JOIN pubc ON pp.ben_country_of_birth = pubc.country
  GROUP BY 1, 2)"""


@register("quarterly_vs_published", _LUMPED_Q_SQL + "," + _EST_LONG + """
SELECT country, report_date, source, CAST(v AS DOUBLE) AS value FROM est
UNION ALL SELECT country, report_date, source, value FROM pub""")
def q_quarterly_vs_published(spark, sf_dir):
    """The quarterly panel, lumped and unpivoted, stacked on the published series."""
    return PP.compare_quarters_to_published(PP.quarterly_panel(_cases(spark, sf_dir)), _pub_long(spark, sf_dir))


@register("reconcile_published", _LUMPED_SQL + "," + _EST_LONG + """
SELECT coalesce(est.country, pub.country) AS country, coalesce(est.report_date, pub.report_date) AS report_date, est.source,
       CAST(est.v AS BIGINT) AS estimate, pub.value AS published, CAST(est.v AS DOUBLE) - pub.value AS difference,
       CAST(est.v AS DOUBLE) / nullif(pub.value, 0) AS ratio
FROM est FULL OUTER JOIN pub ON est.country = pub.country AND est.report_date = pub.report_date""")
def q_reconcile_published(spark, sf_dir):
    """Each estimate next to the published value for its country and date."""
    pub = _pub_long(spark, sf_dir)
    lumped = P.lump_other(PP.published_panel(_cases(spark, sf_dir), pub), PP.published_countries(pub))
    return P.reconcile_published(lumped, pub)


_PERSON = f"""
WITH c AS ({cases_sql()}),
p AS (SELECT * FROM c WHERE unique_identifier IS NOT NULL),
r AS (SELECT *,
        row_number() OVER (PARTITION BY unique_identifier ORDER BY {_ORDER}) AS rf,
        row_number() OVER (PARTITION BY unique_identifier ORDER BY {_ORDER_DESC}) AS rl,
        max(CASE WHEN decision = 'Approved' THEN 1 ELSE 0 END) OVER (PARTITION BY unique_identifier) AS ok,
        row_number() OVER (PARTITION BY unique_identifier, coalesce(decision = 'Approved', false)
                           ORDER BY {_ORDER}) AS af,
        row_number() OVER (PARTITION BY unique_identifier, coalesce(decision = 'Approved', false)
                           ORDER BY {_ORDER_DESC}) AS al
      FROM p),
per AS (SELECT unique_identifier,
          max(CASE WHEN rf = 1 THEN ben_country_of_birth END) AS ben_country_of_birth,
          max(CASE WHEN rf = 1 AND ok = 1 THEN decision_date END) AS first_faithful,
          max(CASE WHEN rl = 1 AND ok = 1 THEN decision_date END) AS last_faithful,
          max(CASE WHEN af = 1 AND decision = 'Approved' THEN decision_date END) AS first_strict,
          max(CASE WHEN al = 1 AND decision = 'Approved' THEN decision_date END) AS last_strict
        FROM r GROUP BY unique_identifier)"""


@register("ever_approved_first_last", _PERSON + """
SELECT unique_identifier, first_faithful AS first_approved_decision, last_faithful AS latest_approved_decision
FROM per""")
def q_ever_approved_first_last(spark, sf_dir):
    """W9 as published: first/last decision date of anyone ever approved."""
    return P.person_summary(_cases(spark, sf_dir), mode="faithful")


@register("approved_first_last_strict", _PERSON + """
SELECT unique_identifier, first_strict AS first_approved_decision, last_strict AS latest_approved_decision
FROM per""")
def q_approved_first_last_strict(spark, sf_dir):
    """W9 strict: first/last decision date among approved rows."""
    return P.person_summary(_cases(spark, sf_dir), mode="strict")


@register("cross_section", _PERSON + f"""
SELECT ben_country_of_birth, {_counts('last_faithful', f"DATE '{AS_OF}'")}
FROM per GROUP BY ben_country_of_birth""")
def q_cross_section(spark, sf_dir):
    """One-date cross-section, no upper date bound (as published)."""
    return P.cross_section(_cases(spark, sf_dir), AS_OF)


POINT_IN_TIME = PUBLISHED_DATES[5]


@register("point_in_time_vs_published", _PERSON + f""",
cs AS (SELECT ben_country_of_birth AS country, {_counts('last_faithful', f"DATE '{POINT_IN_TIME}'")}
       FROM per GROUP BY ben_country_of_birth),
{_pub_sql_body()[1:]},
shown AS (SELECT country, source, value FROM pub WHERE report_date = DATE '{POINT_IN_TIME}' AND value > 0),
est AS (""" + " UNION ALL ".join(f"SELECT country, '{n}' AS source, CAST({n} AS DOUBLE) AS value FROM cs"
                                  for n, _ in THRESHOLDS) + """)
SELECT * FROM shown UNION ALL SELECT * FROM est WHERE country IN (SELECT country FROM shown)""")
def q_point_in_time_vs_published(spark, sf_dir):
    """One date: the published counts above zero and the estimates for the same countries."""
    return PP.compare_at_date(_cases(spark, sf_dir), _pub_long(spark, sf_dir), POINT_IN_TIME)


@register("within_counts", _PERSON + f"""
SELECT ben_country_of_birth, {_counts('last_strict', f"DATE '{AS_OF_STRICT}'")}
FROM per GROUP BY ben_country_of_birth""")
def q_within_counts(spark, sf_dir):
    """A1: three look-back counts at once, on strict per-person latest approvals."""
    c = _cases(spark, sf_dir)
    per = P.person_summary(c, mode="strict").join(
        P.first_row_per_key(PP.panel_input(c), cols=["ben_country_of_birth"]), "unique_identifier")
    return P.within_counts(per, AS_OF_STRICT, ["ben_country_of_birth"])


@register("unpivot_measures", _PERSON + f"""
, cs AS (SELECT ben_country_of_birth, {_counts('last_faithful', f"DATE '{AS_OF}'")}
        FROM per GROUP BY ben_country_of_birth)
SELECT ben_country_of_birth AS country, 'approved_within_6' AS source, approved_within_6 AS value FROM cs
UNION ALL SELECT ben_country_of_birth, 'approved_within_12', approved_within_12 FROM cs
UNION ALL SELECT ben_country_of_birth, 'approved_within_18', approved_within_18 FROM cs""")
def q_unpivot_measures(spark, sf_dir):
    """The cross-section's measures -> (country, source, value)."""
    cs = P.cross_section(_cases(spark, sf_dir), AS_OF).withColumnRenamed("ben_country_of_birth", "country")
    return unpivot_measures(cs, ["country"])


@register("first_row_per_key", f"""
WITH c AS ({cases_sql()}),
r AS (SELECT *, row_number() OVER (PARTITION BY unique_identifier ORDER BY {_ORDER}) AS rf
      FROM c WHERE unique_identifier IS NOT NULL)
SELECT unique_identifier, ben_country_of_birth, rec_date, decision_date, row_original FROM r WHERE rf = 1""")
def q_first_row_per_key(spark, sf_dir):
    """Each person's first row (decides the person's country)."""
    c = PP.panel_input(_cases(spark, sf_dir))
    return P.first_row_per_key(c, cols=["ben_country_of_birth", "rec_date", "decision_date", "row_original"])


@register("asof_state", f"""
WITH c AS ({cases_sql()}),
p AS (SELECT * FROM c WHERE unique_identifier IS NOT NULL),
{_QUARTERS[1:]},
ev AS (SELECT p.*, d.v FROM p JOIN dates d ON p.decision_date <= d.v),
r AS (SELECT *,
        row_number() OVER (PARTITION BY unique_identifier, v ORDER BY {_ORDER}) AS rf,
        row_number() OVER (PARTITION BY unique_identifier, v ORDER BY {_ORDER_DESC}) AS rl,
        max(CASE WHEN decision = 'Approved' THEN 1 ELSE 0 END) OVER (PARTITION BY unique_identifier, v) AS ok
      FROM ev)
SELECT unique_identifier, v AS quarter,
  max(CASE WHEN rf = 1 THEN ben_country_of_birth END) AS ben_country_of_birth,
  max(CASE WHEN rl = 1 THEN decision_date END) AS latest_decision_date,
  max(ok) = 1 AS ever_approved,
  max(CASE WHEN rl = 1 AND ok = 1 THEN decision_date END) AS latest_approved_decision
FROM r GROUP BY unique_identifier, v""")
def q_asof_state(spark, sf_dir):
    """Every person's state at every quarterly date."""
    c = _cases(spark, sf_dir)
    return P.asof_state(PP.panel_input(c), PP.quarterly_dates(c))


@register("snapshot_join", f"""
WITH c AS ({cases_sql()}),
p AS (SELECT * FROM c WHERE unique_identifier IS NOT NULL),
{_QUARTERS[1:]}
SELECT d.v AS quarter, count(*) AS n_rows,
       CAST(sum(CASE WHEN decision = 'Approved' THEN 1 ELSE 0 END) AS BIGINT) AS n_approved
FROM p JOIN dates d ON p.decision_date <= d.v GROUP BY d.v""")
def q_snapshot_join(spark, sf_dir):
    """Rows decided by each snapshot date (range join), counted per date."""
    c = _cases(spark, sf_dir)
    j = P.snapshot_join(PP.panel_input(c), PP.quarterly_dates(c))
    return j.groupBy("quarter").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.count_if(F.col("decision") == "Approved").alias("n_approved"))


@register("quarter_sequence", f"""
WITH c AS ({cases_sql()}),
p AS (SELECT * FROM c WHERE unique_identifier IS NOT NULL),
{_QUARTERS[1:]}
SELECT v AS quarter FROM dates""")
def q_quarter_sequence(spark, sf_dir):
    """Quarterly dates from the first to the last rec_date, day rolling forward."""
    return PP.quarterly_dates(_cases(spark, sf_dir))


@register("date_bounds", f"""
WITH c AS ({cases_sql()})
SELECT min(rec_date) AS start, max(rec_date) AS "end" FROM c WHERE unique_identifier IS NOT NULL""")
def q_date_bounds(spark, sf_dir):
    """A4: first and last rec_date, NULLs ignored."""
    return P.date_bounds(PP.panel_input(_cases(spark, sf_dir)))


@register("daily_counts", f"""
WITH c AS ({cases_sql()})
SELECT decision_date, decision, count(*) AS n FROM c WHERE ben_country_of_birth = '1-URGENT'
GROUP BY decision_date, decision""")
def q_daily_counts(spark, sf_dir):
    """A3: decisions per day for one country."""
    return P.daily_counts(_cases(spark, sf_dir), "1-URGENT")


@register("distinct_values", f"""
WITH c AS ({cases_sql()})
SELECT DISTINCT ben_country_of_birth FROM c""")
def q_distinct_values(spark, sf_dir):
    """A5: distinct countries (NULL included)."""
    return _cases(spark, sf_dir).select("ben_country_of_birth").distinct()


@register("semi_filter", f"""
WITH c AS ({cases_sql()}),
{_pub_sql_body()[1:]}
SELECT row_original, ben_country_of_birth FROM c
WHERE ben_country_of_birth IN (SELECT country FROM pubc)""")
def q_semi_filter(spark, sf_dir):
    """Rows whose country is in the published list."""
    pub = _pub_long(spark, sf_dir)
    return semi_filter(_cases(spark, sf_dir), PP.published_countries(pub), "ben_country_of_birth") \
        .select("row_original", "ben_country_of_birth")


_PROFILE_COLS = ("form_type", "decision", "rec_date", "decision_date")


@register("person_summary", f"""
WITH c AS ({cases_sql()}),
p AS (SELECT * FROM c WHERE unique_identifier IS NOT NULL),
r AS (SELECT *,
        row_number() OVER (PARTITION BY unique_identifier ORDER BY {_ORDER}) AS rf,
        row_number() OVER (PARTITION BY unique_identifier ORDER BY {_ORDER_DESC}) AS rl
      FROM p)
SELECT unique_identifier,
""" + ",\n".join(f"  max(CASE WHEN rf = 1 THEN {c} END) AS first_{c}, max(CASE WHEN rl = 1 THEN {c} END) AS latest_{c}"
                  for c in _PROFILE_COLS) + """,
  coalesce(bool_or(decision = 'Approved'), false) AS ever_approved
FROM r GROUP BY unique_identifier""")
def q_person_summary(spark, sf_dir):
    """W9 generalised: first/latest form type, decision and dates per person, ever approved."""
    return P.person_profile(_cases(spark, sf_dir), _PROFILE_COLS)
