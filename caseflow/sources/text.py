"""Text sources (S6, S11): header CSVs and report text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators.reshape import clean_names


def read_header_csv(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """A header CSV read as text (quoted fields may hold commas); optionally
    snake_case the header (date headers get an ``x`` prefix)."""
    df = (spark.read.option("header", True).option("inferSchema", False)
               .option("quote", '"').option("escape", '"').csv(path))
    return clean_names(df) if clean else df


def scan_report_lines(spark: SparkSession, path: str, source_col: str = "source_file") -> DataFrame:
    """Every line of the report text files under ``path`` with its file name.
    A ``source_file=<name>`` directory (partitioned write) names the file; otherwise
    the file's base name does."""
    df = spark.read.option("recursiveFileLookup", False).text(path)
    base = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    src = F.col(source_col) if source_col in df.columns else base
    return df.select(F.col("value").alias("line"), src.alias(source_col))
