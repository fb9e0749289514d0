"""Folders of any file system Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system of ``path``, the path in it)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Give the folder ``new`` the name ``path``; one that has it already is set aside first and deleted
    afterwards, so there is a whole output at every moment but between two renames."""
    fs, src = file_system(spark, new)
    _, dst = file_system(spark, path)
    _, aside = file_system(spark, f"{new}-replaced")
    fs.mkdirs(dst.getParent())
    old = fs.exists(dst)
    if old and not fs.rename(dst, aside):
        raise RuntimeError(f"{path} can't be set aside")
    if not fs.rename(src, dst):
        if old:
            fs.rename(aside, dst)
        raise RuntimeError(f"{new} can't be renamed to {path}")
    if old:
        fs.delete(aside, True)
