"""Person-level panel reconciled to published totals (the third stage of the
reference workflow), as one lazy Spark plan: no per-date loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.dates import quarter_sequence
from caseflow.operators import panel as P
from caseflow.operators.reshape import clean_names, unpivot_dates


def panel_input(cases: DataFrame, id_col: str = "unique_identifier") -> DataFrame:
    """Rows of people with an id (the published script drops id-less rows)."""
    return cases.filter(F.col(id_col).isNotNull())


def quarterly_dates(cases: DataFrame, id_col: str = "unique_identifier", date_col: str = "rec_date",
                    out: str = "quarter") -> DataFrame:
    """Quarterly snapshot dates from the first to the last ``rec_date``."""
    bounds = P.date_bounds(panel_input(cases, id_col), date_col)
    return quarter_sequence(bounds, "start", "end", out=out)


def published_long(published_wide: DataFrame) -> DataFrame:
    """Wide published counts (Country, <ISO date>...) -> (country, report_date, value, source)."""
    return unpivot_dates(clean_names(published_wide), "country")


def published_from_csv(spark, path: str) -> DataFrame:
    """The published-counts CSV (``Country`` + one column per ISO date, blanks for
    not reported) as the long (country, report_date, value, source) table."""
    from caseflow.sources.text import read_header_csv
    return published_long(read_header_csv(spark, path, clean=False))


def published_dates(pub_long: DataFrame, out: str = "report_date") -> DataFrame:
    return pub_long.select(F.col("report_date").alias(out)).distinct()


def published_countries(pub_long: DataFrame) -> DataFrame:
    return pub_long.select("country").distinct()


def quarterly_panel(cases: DataFrame, method: str = "sweep", mode: str = "faithful") -> DataFrame:
    dates = quarterly_dates(cases)
    return P.snapshot_panel(panel_input(cases), dates, method=method, mode=mode)


def published_panel(cases: DataFrame, pub_long: DataFrame, method: str = "sweep",
                    mode: str = "faithful") -> DataFrame:
    return P.snapshot_panel(panel_input(cases), published_dates(pub_long), method=method, mode=mode)


def compare_to_published(cases: DataFrame, published_wide: DataFrame, method: str = "sweep") -> DataFrame:
    """Estimates per published country (others lumped), unpivoted and stacked on the
    published series: (country, report_date, source, value)."""
    pub = published_long(published_wide)
    lumped = P.lump_other(published_panel(cases, pub, method), published_countries(pub))
    return P.panel_vs_published(lumped, pub)


def compare_quarters_to_published(quarters: DataFrame, pub_long: DataFrame) -> DataFrame:
    """The quarterly panel (others lumped), its dates named ``report_date``, stacked on the published series."""
    lumped = P.lump_other(quarters, published_countries(pub_long), group_cols=["quarter"])
    return P.panel_vs_published(lumped.withColumnRenamed("quarter", "report_date"), pub_long)


def compare_at_date(cases: DataFrame, pub_long: DataFrame, as_of: str, mode: str = "faithful") -> DataFrame:
    """The one-date cross-section beside the counts published for that date."""
    return P.point_in_time_vs_published(P.cross_section(panel_input(cases), as_of, mode=mode), pub_long, as_of)
