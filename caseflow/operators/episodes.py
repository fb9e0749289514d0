"""Filing episodes, duplicate flags and running approvals per person.

The reference sorts the whole table and runs grouped ``cumsum``/``row_number``.
Here rows are joined once with a table of bucket totals, so a person with a huge history is
combined map-side and split by row range instead of landing in one task:

* a bucket is (person, rec_date, other order columns, file, row range), at most 1M rows; its
  count and last row are one hash aggregate;
* episode of a dated row = rank of its ``rec_date`` among the person's dates, last in the
  episode = the row whose order key equals the greatest one: windows over buckets;
* undated rows each open their own episode after all dated ones, numbered by the rows
  of the buckets before and the position in their own;
* rows without an id are one-row persons: they ride along and match no bucket;
* so the input is read twice, once for the narrow totals, and its rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.columns import APPROVED, C3, DACA_INITIAL, DACA_RENEWAL, ELIS, PROVENANCE
from caseflow.operators.ranking import row_range, running_within

DUP_COLS = ("duplicate_identifier", "duplicate_last", "duplicate_likely", "duplicate_drop_row")


def nulls_last_key(cols: Sequence[str]) -> list[Column]:
    """Struct fields that order like ``arrange(c1, c2, ...)``: NULLs after values."""
    out = []
    for c in cols:
        out += [F.col(c).isNull(), F.col(c)]
    return out


def order_key(null_last_cols: Sequence[str], tiebreak: Sequence[str] = PROVENANCE) -> Column:
    """A comparable struct for a total order: NULL-last columns, then ``tiebreak``."""
    fields = nulls_last_key(null_last_cols) + [F.col(c) for c in tiebreak]
    return F.struct(*[f.alias(f"k{i}") for i, f in enumerate(fields)])


def surrogate_key(df: DataFrame, id_col: str = "unique_identifier",
                  out: str = "unique_identifier_nona",
                  provenance: Sequence[str] = PROVENANCE) -> DataFrame:
    """Rows with no id become their own person. Unique per row without a global
    ``row_number``, and spreads NULL ids over partitions instead of one hot key."""
    file_col, row_col = provenance
    return df.withColumn(out, F.coalesce(
        F.col(id_col),
        F.concat(F.lit("noid_"), F.col(file_col), F.lit("#"), F.col(row_col).cast("string"))))


def flag_duplicates(df: DataFrame, id_col: str = "unique_identifier", date_col: str = "rec_date",
                    order: str = "tps", provenance: Sequence[str] = PROVENANCE,
                    history: DataFrame | None = None) -> DataFrame:
    """Add ``duplicate_identifier`` (episode number, 1-based), ``duplicate_last``,
    ``duplicate_likely`` (NULL when id or date is NULL) and ``duplicate_drop_row``.

    ``order='tps'`` breaks ties inside an episode by ``decision_date`` (NULL last)
    before provenance, so an undecided row is the last one; ``order='daca'`` uses
    provenance only. ``history`` is a frame of the same rows that is cheaper to compute, for the totals.
    """
    within = ["decision_date"] if order == "tps" else []
    if order not in ("tps", "daca"):
        raise ValueError(f"order must be 'tps' or 'daca', got {order!r}")
    file_col, row_col = provenance
    has_id, has_date = F.col(id_col).isNotNull(), F.col(date_col).isNotNull()
    names = ["i", "d", *[f"w{i}" for i in range(len(within))], "f", "r"]
    cut = [F.col(c) for c in (id_col, date_col, *within, file_col)] + [row_range(row_col)]

    # one row per bucket: partial aggregation absorbs hot groups map-side
    totals = ((history if history is not None else df).filter(has_id)
              .groupBy(*[c.alias(n) for c, n in zip(cut, names)])
              .agg(F.count(F.lit(1)).alias("_c"), F.max(row_col).alias("_m")))
    person = Window.partitionBy("i").orderBy(F.col("d").asc_nulls_last())
    date = Window.partitionBy("i", "d")
    earlier = date.orderBy(*[F.col(n).asc_nulls_last() for n in names[2:]]).rowsBetween(Window.unboundedPreceding, -1)
    buckets = (totals.withColumn("_ep", F.dense_rank().over(person))
               .select(F.struct(*names, F.lit(None).cast("long").alias("alone")).alias("_okey"), "_ep",
                       F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
                       F.sum("_c").over(date).alias("_n"), F.max(order_key(names[2:-2], ("f", "_m"))).over(date).alias("_last")))

    # a row without an id has a key of its own, which matches no bucket and makes no hot one
    bkey = F.struct(*[c.alias(n) for c, n in zip(cut, names)], F.when(~has_id, F.col(row_col)).alias("alone"))
    j = (df.withColumn("_bkey", bkey).withColumn("_key", order_key(within, provenance))
         .join(buckets, F.col("_bkey") == F.col("_okey"), "left"))
    dated = has_id & has_date
    place = F.row_number().over(Window.partitionBy("_bkey").orderBy(F.col(row_col).asc_nulls_last()))
    likely = F.when(dated, F.col("_n") > 1)
    last = F.when(dated, F.col("_key") == F.col("_last")).otherwise(F.lit(True))
    return j.select(
        *df.columns,
        F.when(dated, F.col("_ep")).when(has_id, F.col("_ep") - 1 + F.col("_before") + place)
         .otherwise(F.lit(1)).cast("int").alias("duplicate_identifier"),
        last.alias("duplicate_last"), likely.alias("duplicate_likely"),
        (F.coalesce(likely, F.lit(False)) & ~last).alias("duplicate_drop_row"))


def running_approvals(df: DataFrame, id_col: str = "unique_identifier",
                      decision_col: str = "decision", order_cols: Sequence[str] = ("decision_date", "rec_date"),
                      provenance: Sequence[str] = PROVENANCE, out: str = "n_approvals",
                      where: Column | None = None, history: DataFrame | None = None) -> DataFrame:
    """Running count of approvals per person in ``order_cols`` (NULL last, ties by
    provenance). NULL-sticky like R's ``cumsum``: from the first NULL decision on, NULL.
    Rows without an id get NULL (the reference never counts them), and so do rows outside ``where``,
    which count for nobody.

    The state is a pair of sums (approvals, NULL decisions), so it adds up over row ranges, dates and persons:
    see ``ranking.running_within``. No window holds one person's history.
    """
    file_col, row_col = provenance
    own = F.col(id_col).isNotNull() if where is None else F.col(id_col).isNotNull() & F.coalesce(where, F.lit(False))
    r = running_within(df, [id_col], [*order_cols, file_col], row_col, {
        "_appr": F.coalesce((F.col(decision_col) == F.lit(APPROVED)).cast("long"), F.lit(0)),
        "_nulls": F.col(decision_col).isNull().cast("long"),
    }, where=own, history=history)
    return r.select(*df.columns, F.when(F.col("_nulls") == 0, F.col("_appr")).cast("long").alias(out))


def initial_renewal(df: DataFrame, id_col: str = "unique_identifier", source_col: str = "data_source",
                    form_col: str = "form_type", out: str = "form_type_filled_in",
                    provenance: Sequence[str] = PROVENANCE, history: DataFrame | None = None) -> DataFrame:
    """C3 rows with an id get "Initial" while their running approvals are <= 1,
    "Renewal" after; ELIS rows and id-less rows keep ``form_type``.

    Rows in neither branch (id present, source neither ELIS nor C3) are dropped,
    exactly as the reference's split does; ``no_branch_rows`` counts them.
    """
    c3 = F.coalesce(F.col(source_col) == F.lit(C3), F.lit(False)) & F.col(id_col).isNotNull()
    r = running_approvals(df.filter(~no_branch_rows(id_col, source_col)), id_col=id_col, provenance=provenance,
                          out="_n_appr", where=c3, history=history)
    filled = (F.when(~c3, F.col(form_col)).when(F.col("_n_appr") <= 1, F.lit(DACA_INITIAL))
              .when(F.col("_n_appr") > 1, F.lit(DACA_RENEWAL)))
    return r.withColumn(out, filled).drop("_n_appr")


def no_branch_rows(id_col: str = "unique_identifier", source_col: str = "data_source") -> Column:
    """Predicate for rows ``initial_renewal`` would lose (for the count check)."""
    in_c3 = (F.col(source_col) == F.lit(C3)) & F.col(id_col).isNotNull()
    in_other = (F.col(source_col) == F.lit(ELIS)) | F.col(id_col).isNull()
    return ~F.coalesce(in_c3, F.lit(False)) & ~F.coalesce(in_other, F.lit(False))
