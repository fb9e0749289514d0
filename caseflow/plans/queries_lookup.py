"""Lookup-table queries (J1, J2, the three-layer code table) and SQL oracles.

Code tables grow with the data here: customers are codes, suppliers overlay them
and every customer also has an alias code pointing at its nation's code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators.lookup import resolve_aliases, rows_upsert
from caseflow.operators.reshape import sort_nulls_last
from caseflow.plans.bindings import nation_code_table, nation_code_table_sql, table
from caseflow.plans.catalog import register


def _customer_codes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"),
                    F.col("c_name").alias("country"))


def _supplier_overlay(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("C"), (F.col("s_suppkey") * 20).cast("string")).alias("code"),
                    F.col("s_name").alias("country"))


@register("rows_upsert", """WITH base AS (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS code, c_name AS country FROM customer),
ov AS (SELECT 'C' || CAST(s_suppkey * 20 AS VARCHAR) AS code, s_name AS country FROM supplier)
SELECT * FROM base WHERE code NOT IN (SELECT code FROM ov) UNION ALL SELECT * FROM ov""")
def q_rows_upsert(spark, sf_dir):
    """Supplier rows replace customer codes they share and append the rest."""
    return rows_upsert(_customer_codes(spark, sf_dir), _supplier_overlay(spark, sf_dir), "code")


@register("resolve_aliases", """WITH t AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS code, n_name AS country FROM nation),
al AS (SELECT 'A' || CAST(c_custkey AS VARCHAR) AS code,
              'N' || CAST(CASE WHEN c_custkey % 9 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS VARCHAR) AS canonical
       FROM customer)
SELECT al.code, t.country FROM al LEFT JOIN t ON al.canonical = t.code
UNION ALL SELECT code, country FROM t""")
def q_resolve_aliases(spark, sf_dir):
    """Each customer's alias code takes its nation's name (dangling ones NULL)."""
    c = table(spark, sf_dir, "customer")
    nk = F.when(F.col("c_custkey") % 9 == 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey"))
    aliases = c.select(F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("code"),
                       F.concat(F.lit("N"), nk.cast("string")).alias("canonical"))
    n = table(spark, sf_dir, "nation")
    t = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"),
                 F.col("n_name").alias("country"))
    return sort_nulls_last(resolve_aliases(aliases, t), "code")


@register("country_code_table", "WITH " + nation_code_table_sql()[1:] + "\nSELECT code, country FROM codes")
def q_country_code_table(spark, sf_dir):
    """The three-layer code table (base list, fixed overlay, fixed aliases)."""
    return sort_nulls_last(nation_code_table(spark, sf_dir), "code")
