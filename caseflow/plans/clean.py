"""Clean / recode / deduplicate staged application records (the second stage of
the reference workflow) as one lazy plan plus two cheap profile/check jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.columns import C3, GENDER_LABELS, PROVENANCE, TPS_FORM_TYPE_LABELS, UNLISTED_COUNTRY
from caseflow.functions.text import recode_values, resolve_country
from caseflow.operators.episodes import flag_duplicates, initial_renewal, no_branch_rows
from caseflow.operators.lookup import lookup_left
from caseflow.operators.profile import drop_uninformative, flag_empty_rows
from caseflow.operators.quality import ChangeLog

# columns later steps name; kept even when the profile finds them empty (defect D6)
REQUIRED = ("unique_alien_id", "ben_country_of_birth", "data_source", "ben_gender", "form_type",
            "decision", "rec_date", "decision_date")


def clean_cases(staged: DataFrame, codes: DataFrame, form: str = "tps", raw_id: str = "unique_alien_id",
                keep: Sequence[str] = REQUIRED, check: bool = True,
                informative: Mapping[str, bool] | None = None, log: ChangeLog | None = None) -> DataFrame:
    """Staged rows of one form -> cleaned rows with duplicate flags.

    Steps: drop form columns; drop uninformative columns (profile job); flag fully
    empty rows; resolve country codes (left lookup, keys checked in the plan); recode
    gender (and TPS form type); id rename; episodes and duplicate flags; drop empty
    rows; DACA also fills in initial/renewal. ``check`` adds the row-count
    reconciliation to the profile pass (no extra job). ``informative`` holds answers of the profile that are
    known already, as ``ledger.open_staged`` returns them. ``log`` gets a step for every verb; with it
    (``sinks.publish`` reconciles its counts) ``check`` is not needed.
    """
    if form not in ("tps", "daca"):
        raise ValueError(f"form must be 'tps' or 'daca', got {form!r}")
    step = log.step if log is not None else lambda frame, verb, **_: frame
    plain = staged.drop(*[c for c in ("form_id", "label") if c in staged.columns])
    df = step(plain, "staged")
    # The DACA split loses rows that are in neither branch. Such a row has an id, and
    # the id column is always kept, so it is never an empty row: the count needs no
    # profile result and rides in the profile's own pass.
    checks = {}
    if check and form == "daca":
        checks["rows_in_no_branch"] = no_branch_rows(raw_id)
    plain = drop_uninformative(plain, keep=[*PROVENANCE, *[c for c in keep if c in plain.columns]],
                               must_be_zero=checks, known=informative)
    df = step(df.select(*plain.columns), "drop_uninformative")
    df = step(flag_empty_rows(df, except_cols=PROVENANCE), "flag_empty_rows", empty=F.col("row_redacted"))
    df = step(df.withColumnRenamed(raw_id, "unique_identifier"), "rename")
    # the same rows before the flags and the lookup: totals per person are taken from this narrow scan
    history = plain.withColumnRenamed(raw_id, "unique_identifier")

    if "ben_country_of_birth" in df.columns:
        df = lookup_left(df, codes.select("code", F.col("country").alias("_country")), "ben_country_of_birth")
        default = UNLISTED_COUNTRY if form == "tps" else None
        df = step(df.withColumn("ben_country_of_birth",
                                resolve_country("ben_country_of_birth", "data_source", "_country", default))
                  .drop("_country"), "resolve_country")
    if "ben_gender" in df.columns:
        df = df.withColumn("ben_gender", recode_values("ben_gender", GENDER_LABELS))
    if form == "tps" and "form_type" in df.columns:
        df = df.withColumn("form_type", recode_values("form_type", TPS_FORM_TYPE_LABELS))
    df = step(df, "recode_values")

    df = step(flag_duplicates(df, order=form, history=history), "flag_duplicates")
    df = step(df.filter(~F.col("row_redacted")).drop("row_redacted"), "drop_empty_rows", drops="empty")
    if form == "daca":
        # a flagged empty row has no id and counts for no person, so the history needs no filter
        df = step(initial_renewal(df, history=history), "initial_renewal")
    tail = list(PROVENANCE)
    return df.select(*[c for c in df.columns if c not in tail], *tail)


def output_order(form: str) -> list[Column]:
    """The order of the reference's output rows, for ``sinks.write_ordered``: by person (rows without an id by
    themselves), date and provenance; DACA puts C3 rows after the others, by person and decision date."""
    file_col, row_col = PROVENANCE
    person = F.coalesce(F.col("unique_identifier"),
                        F.concat(F.lit("noid_"), F.col(file_col), F.lit("#"), F.col(row_col).cast("string")))
    rec, decided = F.col("rec_date").asc_nulls_last(), F.col("decision_date")
    if form == "tps":
        return [person, rec, decided.asc_nulls_last(), F.col(file_col), F.col(row_col)]
    c3 = F.coalesce(F.col("data_source") == F.lit(C3), F.lit(False)) & F.col("unique_identifier").isNotNull()
    return [c3, person, F.when(c3, decided).asc_nulls_last(), rec, F.col(file_col), F.col(row_col)]
