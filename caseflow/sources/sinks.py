"""Sinks (S8, S9, O1, Q1): zstd Parquet, ordered and audited outputs, fiscal-year output units."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.columns import MAX_ROWS_PER_UNIT, PROVENANCE
from caseflow.functions.dates import fiscal_year
from caseflow.operators.ordered import in_blocks, positions
from caseflow.operators.quality import ChangeLog
from caseflow.operators.ranking import row_number_within
from caseflow.sources.files import file_system, replace_folder


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] = ()) -> None:
    """Columnar sink, zstd."""
    w = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_ordered(df: DataFrame, path: str, by: Sequence[Column]) -> None:
    """O1+S8: ``df`` in the order of ``by``: files of sorted ranges, each row with its range and its place in
    it. ``read_ordered`` gives the order back, however files are listed or split. End ``by`` with the provenance,
    so that a hot key is cut into several ranges and the order is total."""
    write_parquet(in_blocks(df, by), path)


def read_ordered(spark, path: str, position: str = "position") -> DataFrame:
    """What ``write_ordered`` wrote, with each row's ``position`` (from 0) over all files: one aggregate of
    one row per range, no sort."""
    return positions(spark.read.parquet(path), position)


def publish(df: DataFrame, path: str, log: ChangeLog, order_by: Sequence[Column] = ()) -> None:
    """Q1, write-audit-publish: write ``df`` beside ``path`` under a temporary name, compare the row counts that ``log``
    observed during this one write (``ChangeLog.reconcile``), and only then give the output its name. If rows were lost or
    added, or the write fails, nothing is left behind and an earlier output stays as it was. ``order_by`` sorts the
    audited output (``write_ordered``)."""
    spark = df.sparkSession
    pending = [f"{path.rstrip('/')}-pending-{uuid.uuid4().hex}"]
    try:
        write_parquet(df, pending[0])
        log.reconcile(spark.read.parquet(pending[0]).count())              # footers only
        if order_by:
            pending.append(f"{pending[0]}-ordered")
            write_ordered(spark.read.parquet(pending[0]), pending[1], order_by)
        replace_folder(spark, pending[-1], path)
    finally:
        for p in pending:
            fs, left = file_system(spark, p)
            fs.delete(left, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage at a point several branches read: write ``df`` once as zstd Parquet
    into the cluster's shared ``spark.checkpoint.dir`` (a new folder per call) and
    continue from the scan. Later branches re-scan columnar files (with pruning)
    instead of re-running the shuffles above; a lost executor re-reads, not re-computes."""
    from caseflow.session import scratch_folder
    from caseflow.sources.staging import scan_parquet
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    write_parquet(df, path)
    return scan_parquet(spark, path)


def fiscal_year_units(df: DataFrame, date_col: str = "rec_date", label: str | None = None,
                      max_rows: int = MAX_ROWS_PER_UNIT, provenance: Sequence[str] = PROVENANCE) -> DataFrame:
    """Add ``fy`` (NULL = unknown), ``chunk`` (1-based, at most ``max_rows`` rows
    each, in provenance order) and the unit name ``sheet`` ("<label> FY2024 (2)").

    A fiscal year is a hot group by design (a handful of keys for the whole table),
    so a year is never one window partition: ``row_number_within`` numbers rows
    inside (year, source file, row range) buckets of bounded size and shifts them
    by the row counts of the year's earlier buckets.
    """
    file_col, row_col = provenance
    x = row_number_within(df.withColumn("fy", fiscal_year(date_col)), ["fy"], [file_col], row_col, out="_rn")
    chunk = F.ceil(F.col("_rn") / F.lit(max_rows)).cast("int")
    prefix = f"{label} " if label else ""
    name = F.concat(F.lit(prefix),
                    F.when(F.col("fy").isNull(), F.lit("FY unknown"))
                     .otherwise(F.concat(F.lit("FY"), F.col("fy").cast("string"))),
                    F.when(F.col("chunk") > 1, F.concat(F.lit(" ("), F.col("chunk").cast("string"), F.lit(")")))
                     .otherwise(F.lit("")))
    return x.withColumn("chunk", chunk).withColumn("sheet", name).drop("_rn")


def unit_name(label: str | None, fy: int | None, chunk: int) -> str:
    """The name of one output unit, as ``fiscal_year_units`` spells it."""
    prefix = f"{label} " if label else ""
    year = "FY unknown" if fy is None else f"FY{fy}"
    return prefix + year + (f" ({chunk})" if chunk > 1 else "")


def write_by_fiscal_year(df: DataFrame, path: str, date_col: str = "rec_date", label: str | None = None,
                         max_rows: int = MAX_ROWS_PER_UNIT) -> list[str]:
    """One output directory per fiscal-year unit (``sheet=<name>``), zstd Parquet.
    Returns the unit names in order (fy, unknown last; chunk). The names follow from
    the row count per fiscal year -- one row per year, read from a date-only scan --
    so the ranked units are computed once, by the write."""
    units = fiscal_year_units(df, date_col, label, max_rows)
    write_parquet(units.drop("fy", "chunk"), path, partition_by=["sheet"])
    per_year = df.groupBy(fiscal_year(date_col).alias("fy")).agg(F.count(F.lit(1)).alias("n")).collect()
    names = []
    for r in sorted(per_year, key=lambda r: (r["fy"] is None, r["fy"] or 0)):
        n_chunks = -(-r["n"] // max_rows)
        names += [unit_name(label, r["fy"], c) for c in range(1, n_chunks + 1)]
    return names
