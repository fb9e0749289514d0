"""Published quarterly report text/grids -> tidy facts (the fourth stage of the
reference workflow). Narrow transformations only; the optional sort shuffles the
parsed lines once and the facts once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.reports import (fiscal_year_from_name, grid_data_rows, parse_report_line,
                                        quarter_from_period)
from caseflow.functions.text import squish, suppressed_value, suppression_code
from caseflow.operators.reshape import sort_nulls_last, spread, union_by_name, unpivot_compound

FACT_COLS = ("fiscal_year", "quarter", "period", "country", "metric", "value", "code", "source_file")


def public_facts(lines: DataFrame | None = None, grid: DataFrame | None = None,
                 grid_cols=None, sort: bool = False) -> DataFrame:
    """``lines``: (line, source_file) report text; ``grid``: 21 text cells + source_file.
    Output: fiscal_year, quarter (NULL for FY totals), period, country, metric,
    value (NULL when suppressed), code (D/H), source_file."""
    parts = []
    if lines is not None:
        parts.append(parse_report_line(lines))
    if grid is not None:
        parts.append(grid_data_rows(grid, grid_cols or [f"c{i}" for i in range(1, 22)]))
    wide = union_by_name(parts)
    # per-line work once per line, before one line becomes 20 rows
    cells = [c for c in wide.columns if c not in ("country", "source_file")]
    wide = wide.select(squish("country").alias("country"),
                       fiscal_year_from_name("source_file").alias("fiscal_year"), "source_file",
                       *[F.col(f"`{c}`").alias(c) for c in cells])
    if sort:
        # a range sort reads its input twice, once for a sample: parsed lines are shuffled in between, so that both read those
        wide = spread(wide)
    long = unpivot_compound(wide, ["country", "fiscal_year", "source_file"], names=("period", "metric"),
                            derive={"quarter": lambda period, _: quarter_from_period(period)})
    if sort:
        long = sort_nulls_last(long, "fiscal_year", "quarter", "country", "metric")
    # after the sort, whose rows are then the short text cells
    return long.select(
        "fiscal_year", "quarter", "period", "country", "metric",
        suppressed_value("value").alias("value"), suppression_code("value").alias("code"),
        "source_file")
