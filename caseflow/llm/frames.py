"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import ctypes
import ctypes.util

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.session import scratch_folder


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null for a null id)."""
    return F.crc32(F.col(col).cast("string")) % F.lit(n)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and go on from its files: later readers
    (and a task retried after a lost executor) read files instead of computing it again."""
    path = scratch_folder(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SPREAD = 32      # parts of a key's rows


def onto(rows: DataFrame, facts: DataFrame, keys: list[str], salt: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row a key). Facts are first joined to the parts that a
    key's rows are spread over by column ``salt``, so no task gets all rows of a hot key. ``rows`` is read twice."""
    part = F.pmod(F.xxhash64(salt), F.lit(SPREAD)).alias("part")
    spread = rows.select(*keys, part).distinct().join(facts, keys)
    return rows.withColumn("part", part).join(spread, [*keys, "part"], how).drop("part")


def slices(lengths, limit: int):
    """(from, to) row ranges whose lengths sum to at most ``limit``; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)


def texts_in_slices(batch: pa.RecordBatch, column: str, limit: int, binary: bool = False):
    """(rows of the batch, their texts as a list), about ``limit`` bytes at a time."""
    a = batch.column(batch.schema.get_field_index(column))
    a = a.cast(pa.large_binary() if pa.types.is_large_string(a.type) else pa.binary())
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(a), 0).to_pylist()
    for i, j in slices(sizes, limit):
        part = a.slice(i, j - i)
        if not binary:
            part = part.cast(pa.large_string() if pa.types.is_large_binary(a.type) else pa.string())
        yield i, j, part.to_pylist()


def released(run):
    """``run``, a function over a task's batches, which at its end hands memory that its worker no longer
    uses back to the system: glibc and Arrow keep it otherwise, in every idle worker of an executor."""
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(ctypes.util.find_library("c"))
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)
    return whole
