"""Data-dependent schema decisions.

A column's fate depends on all of its values, so these need a profile job. Every
column is profiled in **one** aggregate pass (partial aggregation per task, one
row back to the driver), then the plan continues lazily with a plain ``select``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.columns import PROVENANCE
from caseflow.functions.text import is_informative


def _informative(df: DataFrame, name: str) -> Column:
    dt = df.schema[name].dataType
    if isinstance(dt, T.StringType):
        return is_informative(F.col(name))
    return F.col(name).isNotNull()


def informative_columns(df: DataFrame, cols: Sequence[str] | None = None,
                        counts: Mapping[str, Column] | None = None) -> dict[str, bool | int]:
    """One job: does each column hold at least one informative value? ``counts``
    adds ``count_if`` results to the same pass (reconciliation counts)."""
    cols = list(cols) if cols is not None else df.columns
    counts = dict(counts or {})
    if not cols and not counts:
        return {}
    aggs = [F.coalesce(F.max(_informative(df, c).cast("int")), F.lit(0)).alias(f"_{i}")
            for i, c in enumerate(cols)]
    aggs += [F.count_if(F.coalesce(p, F.lit(False))).alias(f"_n{i}") for i, p in enumerate(counts.values())]
    row = df.agg(*aggs).first()
    out: dict[str, bool | int] = {c: bool(row[f"_{i}"]) for i, c in enumerate(cols)}
    out.update({n: int(row[f"_n{i}"]) for i, n in enumerate(counts)})
    return out


def footer_profile(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> dict[str, bool]:
    """What the footers of Parquet files decide of P1 without reading data: a column without a value is not
    informative, one of another type than text with a value is. Text columns with values are left out (their cells have
    to be read). The files are of one schema, as a staging step writes them. Counts are aggregates pushed into the scan, in a session of their own whose Parquet source can do that."""
    s = spark.newSession()
    s.conf.set("spark.sql.sources.useV1SourceList", "")
    s.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    plain = [f.name for f in schema.fields if isinstance(f.dataType, T.AtomicType)]
    counts = footer_counts(s, paths, schema, plain).first() if plain else []
    text = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}
    return {c: bool(n) for c, n in zip(plain, counts) if not n or c not in text}      # no footer at all: NULL


def footer_counts(s: SparkSession, paths: str | Sequence[str], schema: T.StructType, cols: Sequence[str]) -> DataFrame:
    """One row: how many values each column has."""
    df = s.read.schema(schema).option("recursiveFileLookup", "true").parquet(*([paths] if isinstance(paths, str) else paths))
    return df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(cols)])


def drop_uninformative(df: DataFrame, keep: Sequence[str] = (),
                       must_be_zero: Mapping[str, Column] | None = None,
                       known: Mapping[str, bool] | None = None) -> DataFrame:
    """Drop every column whose values are all NULL / blank / ``NA`` / redacted
    (text) or all NULL (other types). Zero rows drops everything not in ``keep``.
    ``must_be_zero`` counts are taken in the same pass; a non-zero one raises
    ``quality.CountMismatch``. Columns whose answer is ``known`` (from the profiles of an incremental
    staging) are not read, and if all are, no job runs."""
    from caseflow.operators.quality import CountMismatch
    must_be_zero = dict(must_be_zero or {})
    prof = dict(known or {})
    prof |= informative_columns(df, [c for c in df.columns if c not in keep and c not in prof], must_be_zero)
    bad = {n: prof[n] for n in must_be_zero if prof[n]}
    if bad:
        raise CountMismatch(f"row-count reconciliation failed: {bad}")
    return df.select(*[c for c in df.columns if c in keep or prof.get(c, False)])


def flag_empty_rows(df: DataFrame, except_cols: Sequence[str] = PROVENANCE,
                    out: str = "row_redacted") -> DataFrame:
    """``out`` = every column except ``except_cols`` is NULL."""
    cols = [c for c in df.columns if c not in except_cols]
    cond = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cols], F.lit(True))
    return df.withColumn(out, cond)


def profile_all(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """One row; each predicate holds on every row (NULLs ignored, TRUE on empty)."""
    return df.agg(*[F.coalesce(F.bool_and(p), F.lit(True)).alias(n) for n, p in predicates.items()])


def narrow_datetime(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A TIMESTAMP column whose every value is at midnight becomes DATE (decided
    once per dataset, so all files agree). Q3: naming a non-timestamp column raises."""
    ts_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    if cols is None:
        cols = ts_cols
    else:
        bad = [c for c in cols if c not in ts_cols]
        if bad:
            raise TypeError(f"not datetime columns: {bad}")
    if not cols:
        return df
    row = df.agg(*[F.coalesce(F.bool_and(F.date_trunc("DAY", F.col(c)) == F.col(c)), F.lit(True))
                   .alias(f"_{i}") for i, c in enumerate(cols)]).first()
    midnight = {c for i, c in enumerate(cols) if row[f"_{i}"]}
    return df.select(*[(F.to_date(F.col(c)).alias(c) if c in midnight else F.col(c)) for c in df.columns])
