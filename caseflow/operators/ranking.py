"""Positions and running sums inside groups that may be hot.

``row_number() OVER (PARTITION BY g ORDER BY ...)`` sends every row of a group to
one task. When one group can hold a third of the table (a fiscal year, one
person's history), that task is the whole job.

Every order used in this engine ends with the row's provenance -- source file,
then row within the file. So the order is cut into *buckets*: (group, leading
order keys..., file, row range), where a row range is ``floor(row / R)`` -- at
most R rows, however large one file, key or group is. Inside a bucket rows are
numbered (or summed) by their row number with a window that never holds more
than R rows. What comes before a bucket is a hierarchical prefix sum over a table of
one row per bucket (an aggregate with map-side combine):

* totals per (group, leading key), summed up over the group's earlier leading keys;
* plus totals of the earlier buckets of the same (group, leading key).

So no window holds a group's rows, nor all of its buckets: the first holds a group's distinct
leading keys (for dates: bounded by the calendar), the second the buckets of one of them.

Everything is deterministic (no sampling, no ``monotonically_increasing_id``),
so a lost executor recomputes exactly the same values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ROWS_PER_BUCKET = 1_000_000


def row_range(row_col: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> Column:
    """The part of its file a row lies in."""
    return F.floor(F.col(row_col) / F.lit(rows_per_bucket))


def _before(window_of: Sequence[str], order: Sequence[str], c: str) -> Column:
    w = (Window.partitionBy(*window_of).orderBy(*[F.col(o).asc_nulls_last() for o in order])
         .rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.sum(c).over(w), F.lit(0))


def running_within(df: DataFrame, group: Sequence[str], buckets: Sequence[str], row_col: str,
                   measures: Mapping[str, Column], rows_per_bucket: int = ROWS_PER_BUCKET,
                   where: Column | None = None, history: DataFrame | None = None) -> DataFrame:
    """Add, for each ``name -> expr`` in ``measures``, the running (inclusive) sum of
    ``expr`` inside ``group`` in the order (``buckets`` ascending NULLs last, then
    ``row_col``); (buckets, row_col) must be unique inside a group (end ``buckets``
    with the source file).

    ``where`` limits the sums to some rows; others get NULL and cost no more than the shuffle that
    all rows go through. ``history`` is a frame of the same rows that is cheaper to
    compute (before joins and windows that only add columns): bucket totals are taken from it.

    The bucket is one struct key (never NULL itself; NULL fields compare equal), so the window inside
    the bucket and the join with what comes before it share one hash partitioning: the rows are
    shuffled once, and the totals are taken from a second, narrow scan.
    """
    group, buckets = list(group), list(buckets)
    g, b = [f"g{i}" for i in range(len(group))], [f"b{i}" for i in range(len(buckets))]
    own = where if where is not None else F.lit(True)
    keys = [*[F.col(c) for c in group + buckets], row_range(row_col, rows_per_bucket)]
    names = [*g, *b, "r"]
    keys = [c.alias(n) for c, n in zip(keys, names)]
    bkey = F.struct(*keys)
    sums = [f"_t_{n}" for n in measures]

    leaf = ((history if history is not None else df).filter(own).groupBy(*keys)
            .agg(*[F.sum(e).alias(t) for e, t in zip(measures.values(), sums)]))
    lead = leaf.groupBy(*g, b[0]).agg(*[F.sum(t).alias(t) for t in sums])
    lead = lead.select(F.struct(*g, b[0]).alias("_lkey"), *[_before(g, b[:1], t).alias(f"{t}_a") for t in sums])
    leaf = leaf.select(F.struct(*names).alias("_okey"), F.struct(*g, b[0]).alias("_lead"),
                       *[_before([*g, b[0]], [*b[1:], "r"], t).alias(f"{t}_b") for t in sums])
    offsets = (leaf.join(lead, F.col("_lead") == F.col("_lkey"))
               .select("_okey", *[(F.col(f"{t}_a") + F.col(f"{t}_b")).alias(t) for t in sums]))

    named = df.select("*", bkey.alias("_bkey"), *[F.when(own, e).alias(f"_m_{n}") for n, e in measures.items()])
    inside = Window.partitionBy("_bkey").orderBy(F.col(row_col).asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    j = named.join(offsets, F.col("_bkey") == F.col("_okey"), "left")
    # outside ``where`` the measure is NULL, and so is its sum
    return j.select(*df.columns, *[F.when(F.col(f"_m_{n}").isNotNull(),
                                          F.col(f"_t_{n}") + F.sum(f"_m_{n}").over(inside)).alias(n) for n in measures])


def row_number_within(df: DataFrame, group: Sequence[str], buckets: Sequence[str], row_col: str,
                      out: str = "rn", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """1-based position of each row in ``group`` by (``buckets`` NULLs last, ``row_col``)."""
    return running_within(df, group, buckets, row_col, {out: F.lit(1).cast("long")}, rows_per_bucket)
