"""Global positions in a total order, without a window over all rows.

``row_number() OVER (ORDER BY ...)`` sends a table to one task. Here rows are range-partitioned and
sorted by the key, written once with their block (the partition) and their place in it, and each
block is shifted by the rows of the blocks before it: a table of one row per block. The written
table makes block and place the same for every later reader and retried task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PLACE = (1 << 33) - 1     # monotonically_increasing_id: partition above these bits, row in it below


def in_blocks(df: DataFrame, by: Sequence[Column]) -> DataFrame:
    """``df`` sorted by ``by`` over range partitions, with ``_block`` and ``_place`` (both from 0): row order is
    (_block, _place). To be written before it is read twice: another evaluation may cut the ranges elsewhere."""
    return (df.repartitionByRange(*by).sortWithinPartitions(*by)
            .select("*", F.spark_partition_id().alias("_block"),
                    F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("_place")))


def blocks_in_order(df: DataFrame, by: Sequence[Column], name: str = "ordered") -> DataFrame:
    """``in_blocks``, written once. Rows equal in ``by`` share a block, so end ``by`` with
    something that tells rows apart where one key may be hot."""
    from caseflow.sources.sinks import materialize
    return materialize(in_blocks(df, by), name)


def positions(rows: DataFrame, out: str = "position") -> DataFrame:
    """Written blocks with ``out``, each row's place (from 0) over all of them, instead of block and place."""
    # one row per block, so the window and the broadcast are bounded by the number of partitions
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
              .select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return (rows.join(F.broadcast(starts), "_block")
            .select(*[c for c in rows.columns if c not in ("_block", "_place")],
                    (F.col("_start") + F.col("_place")).alias(out)))


def with_position(df: DataFrame, by: Sequence[Column], out: str = "position", name: str = "ordered") -> DataFrame:
    """Add ``out``, each row's place (from 0) in the order of ``by`` over the whole table."""
    return positions(blocks_in_order(df, by, name), out)
