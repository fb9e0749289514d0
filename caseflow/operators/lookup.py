"""Layered code lookup (J1-J4): base table, upserted overlay, aliases, left lookup.

A lookup is a plain equi join: no size is assumed, and the plan itself checks that keys are unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- FIXED VALUES: country-code corrections layered over the 2001 code list ----
# (code, country): codes missing from the list, or whose listed name is wrong or
# not the spelling the ELIS records use. Applied with rows_upsert.
COUNTRY_CODE_OVERLAY = [
    ("SOSUD", "South Sudan"),
    ("ETMOR", "East Timor"),
    ("MONTE", "Montenegro"),
    ("KV", "Kosovo"),
    ("SRBIA", "Serbia"),
    ("SERBI", "Serbia and Montenegro"),
    ("BELAR", "Belarus"),
    ("COTED", "Côte d'Ivoire"),
    ("ANGUI", "Anguilla"),
    ("FRGUI", "French Guiana"),
    ("SAMOA", "Samoa"),
    ("STMAF", "Saint Martin"),
    ("MAYOT", "Mayotte"),
    ("YEMEN", "Yemen"),
    ("PALES", "Palestine, State of"),
    ("CAMBO", "Cambodia"),
    ("BYELA", "Belarus"),
    ("IVORY", "Côte d'Ivoire"),
    ("CHINA", "China"),
    ("TIBET", "Tibet"),
    ("SKORE", "South Korea"),
    ("NKORE", "North Korea"),
    ("US", "United States"),
    ("USSR", "Soviet Union"),
    ("DECON", "Democratic Republic of the Congo"),
    ("CONGO", "Congo-Brazzaville"),
    ("STVIN", "St. Vincent-Grenadines"),
    ("BRUNE", "Brunei Darussalam"),
    ("WGERM", "West Germany"),
    ("FSM", "Micronesia, Federated States of"),
    ("TURKE", "Turkiye"),
    ("POLYN", "Polynesia"),
    ("FPOLY", "Polynesia"),
    ("SOCIE", "Polynesia"),
    ("TUBAU", "Polynesia"),
    ("AUSTR", "Polynesia"),
]

# (code, canonical code): data-entry variants that take their canonical code's name.
COUNTRY_CODE_ALIASES = [
    ("ESAL", "ELSAL"),
    ("ELSA", "ELSAL"),
    ("EL", "ELSAL"),
    ("EL SA", "ELSAL"),
    ("ELAL", "ELSAL"),
    ("ELASL", "ELSAL"),
    ("ELSA;", "ELSAL"),
    ("ELSAV", "ELSAL"),
    ("ELSLA", "ELSAL"),
    ("ESSAL", "ELSAL"),
    ("UELSA", "ELSAL"),
    ("HODNU", "HONDU"),
    ("HOUDU", "HONDU"),
    ("HONOD", "HONDU"),
    ("HONUD", "HONDU"),
    ("HONU", "HONDU"),
    ("HOUND", "HONDU"),
    ("HOND", "HONDU"),
    ("HODU", "HONDU"),
    ("HNDU", "HONDU"),
    ("HONDI", "HONDU"),
    ("2HOND", "HONDU"),
    ("H0NDU", "HONDU"),
    ("UHOND", "HONDU"),
    ("YORO", "HONDU"),
    ("NICA", "NICAR"),
    ("BANAM", "PANAM"),
    ("SOMOL", "SOMAL"),
    ("USA", "US"),
    ("U.S", "US"),
    ("U.S.", "US"),
    ("UNKN", "UNKNO"),
    ("WAFRI", "AFRIC"),
]
# ---- end FIXED VALUES -------------------------------------------------------------


def unique_by(df: DataFrame, key: Sequence[str], what: str) -> DataFrame:
    """``df`` with its keys checked where the plan runs: a key that repeats raises on execution. One
    aggregate over the key, whose partitioning a following join on the key shares; no job of its own.
    The check sits in the key itself, so no pruning of unused columns can remove it."""
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*(rest or key))).alias("_row"))
    repeated = F.raise_error(F.concat(F.lit(f"{what} repeats a key: "), F.to_json(F.struct(*key))))

    def checked(c: str) -> Column:
        return F.when(F.col("_n") > 1, repeated.cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return g.select(*[checked(c) if c in key else F.col("_row")[c].alias(c) for c in df.columns])


def rows_upsert(base: DataFrame, overlay: DataFrame, key: Sequence[str] | str,
                check_unique: bool = True) -> DataFrame:
    """Overlay rows replace base rows with the same key; new keys are appended.
    With ``check_unique`` an overlay that repeats a key raises when the plan runs.
    (For a table at rest this is a MERGE; here the result is a new frame.)"""
    key = [key] if isinstance(key, str) else list(key)
    if check_unique:
        overlay = unique_by(overlay, key, "overlay")
    kept = base.join(overlay.select(*key), key, "left_anti")
    return kept.unionByName(overlay.select(*base.columns))


def resolve_aliases(aliases: DataFrame, table: DataFrame, code_col: str = "code",
                    canonical_col: str = "canonical", value_col: str = "country") -> DataFrame:
    """Each alias takes the value its canonical code resolves to (NULL if none),
    then aliases and table are stacked. Sort at the sink with ``sort_nulls_last``."""
    t = table.select(F.col(code_col).alias("_canon"), F.col(value_col))
    resolved = (aliases.join(t, aliases[canonical_col] == t["_canon"], "left")
                       .select(aliases[code_col].alias(code_col), F.col(value_col)))
    return resolved.unionByName(table.select(code_col, value_col))


def semi_filter(df: DataFrame, values: DataFrame, col: str, values_col: str | None = None) -> DataFrame:
    """Keep rows whose ``col`` occurs in ``values`` (NULL never matches)."""
    vc = values_col or values.columns[0]
    v = values.select(F.col(vc).alias("_v")).filter(F.col("_v").isNotNull())
    return df.join(v, df[col] == v["_v"], "left_semi")


def lookup_left(df: DataFrame, table: DataFrame, left_col: str, code_col: str = "code",
                check_unique: bool = True) -> DataFrame:
    """Row-count preserving equi left join to a code table. The optimiser chooses the join by the
    table's size at run time. With ``check_unique`` a code that repeats (the join would fan out) raises
    when the plan runs; rows of a NULL code match nothing and are left out."""
    if check_unique:
        table = unique_by(table.filter(F.col(code_col).isNotNull()), [code_col], "lookup table")
    t = table.withColumnRenamed(code_col, "_code")
    return df.join(t, df[left_col] == t["_code"], "left").drop("_code")


def country_code_table(spark: SparkSession, base: DataFrame | str) -> DataFrame:
    """The three-layer code table: base list (``code``, ``name``) upserted with the
    overlay, plus aliases resolved against the result. Columns (code, country)."""
    if isinstance(base, str):
        base = spark.read.option("header", True).csv(base)
    b = base.select(F.col("code"), F.col("name").alias("country"))
    overlay = spark.createDataFrame(COUNTRY_CODE_OVERLAY, "code string, country string")
    aliases = spark.createDataFrame(COUNTRY_CODE_ALIASES, "code string, canonical string")
    return resolve_aliases(aliases, rows_upsert(b, overlay, "code", check_unique=False))      # fixed values, tested
