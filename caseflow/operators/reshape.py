"""Sort, stack and unpivot (O1, O2, U1-U4), many columns at once (P6), header normalisation."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_nulls_last(df: DataFrame, *cols: str, descending: Sequence[str] = ()) -> DataFrame:
    """O1: ``arrange`` semantics -- NULLs after values on every key. Use at a sink
    only; Spark rows have no order between operators."""
    keys = [(F.col(c).desc_nulls_last() if c in descending else F.col(c).asc_nulls_last()) for c in cols]
    return df.orderBy(*keys)


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all tasks of a shuffle, where a few tasks would do heavy work: rows of one file with few row
    groups, before each of them becomes many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def union_by_name(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """O2: bag union matching columns by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def clean_name(name: str) -> str:
    """snake_case a header the way ``janitor::clean_names`` does for plain ASCII:
    lower case, non-alphanumerics -> ``_``, no leading/trailing ``_``, ``x`` before
    a leading digit."""
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    s = re.sub(r"[^0-9a-zA-Z]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column with ``clean_name``; repeated names get ``_2``, ``_3``."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        n = clean_name(c)
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*out)


def unpivot_measures(df: DataFrame, ids: Sequence[str], name_col: str = "source",
                     value_col: str = "value") -> DataFrame:
    """Every non-id column becomes (``name_col``, ``value_col``) rows."""
    values = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), values, name_col, value_col)


def unpivot_dates(df: DataFrame, id_col: str = "country", prefix: str = "x",
                  out_date: str = "report_date", source: str = "CRS") -> DataFrame:
    """Date-named columns (``x2015_07_01``) -> (report_date DATE, value); a blank
    value is 0 and every row is tagged with ``source``."""
    values = [c for c in df.columns if c != id_col]
    long = df.unpivot([id_col], [F.col(c).cast("double").alias(c) for c in values], "_name", "value")
    d = F.regexp_replace(F.regexp_replace(F.col("_name"), f"^{re.escape(prefix)}", ""), "_", "-")
    return long.select(F.col(id_col), F.to_date(d).alias(out_date),
                       F.coalesce(F.col("value"), F.lit(0.0)).alias("value"),
                       F.lit(source).alias("source"))


def unpivot_compound(df: DataFrame, ids: Sequence[str], sep: str = ".",
                     names: Sequence[str] = ("period", "metric"), value_col: str = "value",
                     derive: Mapping[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Columns named ``<a><sep><b>`` -> rows (a, b, value). ``derive`` adds columns made from (a, b). All these are
    expressions of the column's name alone, so they are constants of the plan: no row splits a name."""
    def row(c: str) -> Column:
        parts = F.split(F.lit(c), re.escape(sep), 2)
        more = [fn(parts[0], parts[1]).alias(n) for n, fn in (derive or {}).items()]
        return F.struct(parts[0].alias(names[0]), parts[1].alias(names[1]), *more, F.col(f"`{c}`").alias(value_col))
    return df.select(*ids, F.inline(F.array(*[row(c) for c in df.columns if c not in ids])))


def columns_of(df: DataFrame, *types: type, but: Sequence[str] = ()) -> list[str]:
    """The columns of ``df`` whose type is one of ``types``, in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types) and f.name not in but]


def each(cols: Sequence[str], fn: Callable[[str], Column], names: str = "{}") -> list[Column]:
    """``fn`` of every column, under its name (or one made from it)."""
    return [fn(c).alias(names.format(c)) for c in cols]


def across(df: DataFrame, cols: Sequence[str], fn: Callable[[str], Column], names: str = "{}") -> DataFrame:
    """One expression over many columns: each of ``cols`` that ``df`` has becomes ``fn(column)`` in its place, or
    with ``names`` other than ``{}`` gets a new column beside the old ones."""
    mine = [c for c in df.columns if c in set(cols)]
    if names != "{}":
        return df.select("*", *each(mine, fn, names))
    return df.select(*[fn(c).alias(c) if c in set(mine) else F.col(c) for c in df.columns])


def explode_list(df: DataFrame, list_col: str, out: str | None = None) -> DataFrame:
    """U4: one row per element of an array column (rows with empty lists vanish)."""
    return df.withColumn(out or list_col, F.explode(F.col(list_col)))
