"""Person-level state and point-in-time panels.

Order of a person's rows everywhere: ``rec_date`` then ``decision_date`` (both
NULL last), then provenance -- the order the cleaned table is written in.

``mode='faithful'`` reproduces the published script: a person ever approved
gets the first/last ``decision_date`` of *any* row; ``mode='strict'`` uses
approved rows only.

The snapshot panel has two plans:

* ``explode`` -- broadcast range join of rows to snapshot dates, then a group
  per (person, date). Work is rows x dates.
* ``sweep`` (default) -- one aggregate per (person, day), running state over the
  person's distinct decision days (bounded by the calendar), +1/-1 deltas per
  (country, measure, day), pre-aggregated; their running sums per country hold from
  one day with a delta to the next, and each such interval is written out at the
  snapshot dates inside it. Work is linear in rows; no join.

The dates inside an interval are a slice of the sorted date array, found by two
look-ups in a calendar (``snapshot_calendar``), so work equals output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.columns import APPROVED, OTHER_COUNTRIES, PROVENANCE, THRESHOLDS
from caseflow.functions.dates import days_before
from caseflow.operators.episodes import order_key
from caseflow.operators.reshape import columns_of, each

PERSON_ORDER = ("rec_date", "decision_date")
MEASURES = tuple(name for name, _ in THRESHOLDS)
# order_key(PERSON_ORDER) fields: k0 rec null, k1 rec, k2 dd null, k3 dd, k4 file, k5 row
_DD_FIELD = "k3"


def _approved(decision_col: str) -> Column:
    return F.coalesce(F.col(decision_col) == F.lit(APPROVED), F.lit(False))


def _person_key(provenance: Sequence[str]) -> Column:
    return order_key(PERSON_ORDER, provenance)


def first_row_per_key(df: DataFrame, id_col: str = "unique_identifier",
                      cols: Sequence[str] | None = None,
                      provenance: Sequence[str] = PROVENANCE) -> DataFrame:
    """One row per person -- the first in person order. Deterministic, unlike
    ``dropDuplicates``; an aggregate, so a hot person is combined map-side."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c != id_col]
    return (df.groupBy(id_col)
              .agg(F.min_by(F.struct(*cols), _person_key(provenance)).alias("_r"))
              .select(id_col, "_r.*"))


def person_summary(df: DataFrame, id_col: str = "unique_identifier", decision_col: str = "decision",
                   date_col: str = "decision_date", mode: str = "faithful",
                   provenance: Sequence[str] = PROVENANCE) -> DataFrame:
    """Per person ``first_approved_decision`` / ``latest_approved_decision``.

    faithful: ever approved -> first/last ``decision_date`` of any row in person
    order (may be NULL when that row is undecided); never approved -> NULL.
    strict: first/last ``decision_date`` among approved rows.
    """
    k = _person_key(provenance)
    appr = _approved(decision_col)
    if mode == "faithful":
        ever = F.bool_or(appr)
        first = F.when(ever, F.min_by(F.col(date_col), k))
        last = F.when(ever, F.max_by(F.col(date_col), k))
    elif mode == "strict":
        ka = F.when(appr, k)
        first = F.min_by(F.col(date_col), ka)
        last = F.max_by(F.col(date_col), ka)
    else:
        raise ValueError(f"mode must be 'faithful' or 'strict', got {mode!r}")
    return (df.filter(F.col(id_col).isNotNull()).groupBy(id_col)
              .agg(first.alias("first_approved_decision"), last.alias("latest_approved_decision")))


def within_counts(per_person: DataFrame, as_of, group_cols: Sequence[str],
                  latest_col: str = "latest_approved_decision",
                  thresholds=THRESHOLDS) -> DataFrame:
    """A1: per group, how many people had their latest approval within each window
    before ``as_of`` (``as_of - n <= latest``, inclusive; NULL never counts)."""
    as_of = F.col(as_of) if isinstance(as_of, str) and as_of in per_person.columns else (
        F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of)
    aggs = [F.count_if(days_before(as_of, n) <= F.col(latest_col)).alias(name) for name, n in thresholds]
    return per_person.groupBy(*group_cols).agg(*aggs)


def cross_section(df: DataFrame, as_of: str, id_col: str = "unique_identifier",
                  country_col: str = "ben_country_of_birth", decision_col: str = "decision",
                  date_col: str = "decision_date", mode: str = "faithful", bound: bool = False,
                  provenance: Sequence[str] = PROVENANCE) -> DataFrame:
    """Counts per country at one date. Country = the person's first row;
    latest approval over *all* rows (no upper bound, as published) unless
    ``bound=True``, which first keeps rows decided on or before ``as_of``."""
    rows = df.filter(F.col(id_col).isNotNull())
    if bound:
        rows = rows.filter(F.col(date_col) <= F.lit(as_of).cast("date"))
    k = _person_key(provenance)
    appr = _approved(decision_col)
    if mode == "faithful":
        latest = F.when(F.bool_or(appr), F.max_by(F.col(date_col), k))
    else:
        latest = F.max_by(F.col(date_col), F.when(appr, k))
    per = rows.groupBy(id_col).agg(F.min_by(F.col(country_col), k).alias(country_col),
                                   latest.alias("latest_approved_decision"))
    return within_counts(per, as_of, [country_col])


def _events(df: DataFrame, id_col, country_col, decision_col, date_col, provenance) -> DataFrame:
    return (df.filter(F.col(id_col).isNotNull() & F.col(date_col).isNotNull())
              .select(F.col(id_col), F.col(date_col), F.col(country_col),
                      _approved(decision_col).alias("_appr"), _person_key(provenance).alias("_k")))


def snapshot_calendar(dates: DataFrame) -> Column:
    """The sorted snapshot dates ``at`` and, for each day from the first of them to the last, the 1-based
    place ``place`` of the first one on or after it: one value (a scalar subquery) of a size that the
    calendar bounds. Without dates both are empty."""
    v = F.col(dates.columns[0]).cast("date")
    at = dates.agg(F.sort_array(F.collect_set(v)).alias("at"))
    n = F.size("at")
    # the k-th date answers for the days after the date before it
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_repeat(
        k, F.when(n == 0, 0).when(k == 1, 1).otherwise(F.datediff(F.get("at", k - 1), F.get("at", k - 2)))))
    return at.select(F.struct("at", F.flatten(runs).alias("place"))).scalar()


def dates_between(calendar: Column, start: Column, end: Column) -> Column:
    """The dates of ``snapshot_calendar`` in [start, end), to the last one where ``end`` is NULL."""
    at, place = calendar.getField("at"), calendar.getField("place")
    first, last, n = F.get(at, F.lit(0)), F.get(at, F.size(at) - 1), F.size(at)

    def place_of(day: Column) -> Column:
        return (F.when(day <= first, F.lit(1)).when(day > last, n + 1)
                 .otherwise(F.get(place, F.datediff(day, first))))

    stop = F.when(end.isNull(), n + 1).otherwise(place_of(end))
    return F.slice(at, place_of(start), F.greatest(stop - place_of(start), F.lit(0)))


def with_dates_between(df: DataFrame, dates: DataFrame, start: Column, end: Column, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` of each row, once for every snapshot date in [start, end). The calendar is bound by one
    projection, so the plan holds its subquery once."""
    bound = df.select("*", snapshot_calendar(dates).alias("_calendar"))
    return bound.select(*keep, F.explode(dates_between(F.col("_calendar"), start, end)).alias(dates.columns[0]))


def snapshot_join(df: DataFrame, dates: DataFrame, date_col: str = "decision_date") -> DataFrame:
    """Every row paired with each snapshot date on or after its decision date
    (NULL dates never pair). The dates are a slice of the sorted calendar, so rows are neither shuffled
    nor compared with dates that they don't pair with."""
    decided = df.filter(F.col(date_col).isNotNull())
    return with_dates_between(decided, dates, F.col(date_col), F.lit(None).cast("date"), df.columns)


def _day_states(ev: DataFrame, id_col: str, country_col: str, date_col: str, mode: str) -> DataFrame:
    """Running person state after each distinct decision day, valid on [day, next_day)."""
    if mode == "faithful":
        kmax = F.max("_k")
    else:
        kmax = F.max(F.when(F.col("_appr"), F.col("_k")))
    day = (ev.groupBy(id_col, date_col)
             .agg(kmax.alias("_kmax"),
                  F.min(F.struct(F.col("_k"), F.col(country_col).alias("c"))).alias("_kmin"),
                  F.max(F.col("_appr").cast("int")).alias("_ok")))
    w = Window.partitionBy(id_col).orderBy(date_col)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    L = F.max("_kmax").over(run).getField(_DD_FIELD)
    ok = F.max("_ok").over(run) == 1
    latest = F.when(ok, L) if mode == "faithful" else L
    return day.select(
        F.col(id_col), F.col(date_col).alias("_from"), F.lead(date_col).over(w).alias("_to"),
        F.min("_kmin").over(run).getField("c").alias(country_col),
        L.alias("latest_decision_date"), ok.alias("ever_approved"),
        latest.alias("latest_approved_decision"))


def asof_state(df: DataFrame, dates: DataFrame, id_col: str = "unique_identifier",
               country_col: str = "ben_country_of_birth", decision_col: str = "decision",
               date_col: str = "decision_date", mode: str = "faithful",
               provenance: Sequence[str] = PROVENANCE) -> DataFrame:
    """Each person's state at each snapshot date ``v`` from rows decided by ``v``:
    country of the first such row, latest decision date, ever approved."""
    states = _day_states(_events(df, id_col, country_col, decision_col, date_col, provenance),
                         id_col, country_col, date_col, mode)
    rest = [c for c in states.columns if c not in ("_from", "_to")]
    return with_dates_between(states, dates, F.col("_from"), F.col("_to"), rest)


def _panel_explode(ev: DataFrame, dates: DataFrame, id_col, country_col, date_col, mode, thresholds):
    v = dates.columns[0]
    j = snapshot_join(ev, dates, date_col)
    if mode == "faithful":
        latest = F.when(F.bool_or("_appr"), F.max_by(F.col(date_col), F.col("_k")))
    else:
        latest = F.max_by(F.col(date_col), F.when(F.col("_appr"), F.col("_k")))
    per = (j.groupBy(id_col, v)
            .agg(F.min_by(F.col(country_col), F.col("_k")).alias(country_col),
                 latest.alias("latest_approved_decision")))
    return within_counts(per, v, [country_col, v], thresholds=thresholds)


def _panel_sweep(ev: DataFrame, dates: DataFrame, id_col, country_col, date_col, mode, thresholds):
    v = dates.columns[0]
    st = _day_states(ev, id_col, country_col, date_col, mode)
    # intervals [from, to) on which each measure counts this person
    ivs = [F.struct(F.lit("_present").alias("m"), F.col("_from").alias("s"), F.col("_to").alias("e"))]
    for name, n in thresholds:
        end = F.date_add(F.col("latest_approved_decision"), n + 1)
        end = F.when(F.col("_to").isNull(), end).otherwise(F.least(F.col("_to"), end))
        ivs.append(F.when(F.col("latest_approved_decision").isNotNull(),
                          F.struct(F.lit(name).alias("m"), F.col("_from").alias("s"), end.alias("e"))))
    iv = (st.select(F.col(country_col), F.inline(F.array(*ivs)))
            .filter(F.col("m").isNotNull() & (F.col("e").isNull() | (F.col("s") < F.col("e")))))
    # +1 where an interval starts, -1 where it ends; summed per (country, measure, day)
    ends = F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")),
                   F.when(F.col("e").isNotNull(), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d"))))
    deltas = (iv.select(country_col, "m", F.inline(ends))
                .filter(F.col("t").isNotNull())
                .groupBy(country_col, "m", "t").agg(F.sum("d").alias("d")))
    # one row per (country, day with a delta), its running sums hold until the country's next such day
    names = ["_present", *[name for name, _ in thresholds]]
    days = deltas.groupBy(country_col, "t").agg(
        *[F.sum(F.when(F.col("m") == name, F.col("d"))).alias(name) for name in names])
    w = Window.partitionBy(country_col).orderBy("t")          # a country's days: the calendar bounds them
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = days.select(F.col(country_col), F.col("t"), F.lead("t").over(w).alias("_next"),
                       *[F.coalesce(F.sum(name).over(run), F.lit(0)).cast("long").alias(name) for name in names])
    panel = with_dates_between(held.filter(F.col("_present") > 0), dates, F.col("t"), F.col("_next"),
                               [country_col, *[name for name, _ in thresholds]])
    return panel.select(country_col, v, *[name for name, _ in thresholds])


def snapshot_panel(df: DataFrame, dates: DataFrame, id_col: str = "unique_identifier",
                   country_col: str = "ben_country_of_birth", decision_col: str = "decision",
                   date_col: str = "decision_date", method: str = "sweep", mode: str = "faithful",
                   thresholds=THRESHOLDS, provenance: Sequence[str] = PROVENANCE) -> DataFrame:
    """For every snapshot date ``v`` in ``dates`` (one DATE column), per country of
    the person's first row decided by ``v``: people whose latest decision by ``v`` is
    within 182/364/546 days before ``v`` and who were approved by ``v``.
    A country appears at ``v`` once any of its people has a decided row by ``v``."""
    ev = _events(df, id_col, country_col, decision_col, date_col, provenance)
    if method == "sweep":
        return _panel_sweep(ev, dates, id_col, country_col, date_col, mode, thresholds)
    if method == "explode":
        return _panel_explode(ev, dates, id_col, country_col, date_col, mode, thresholds)
    raise ValueError(f"method must be 'sweep' or 'explode', got {method!r}")


def lump_other(panel: DataFrame, keep: DataFrame, country_col: str = "ben_country_of_birth",
               group_cols: Sequence[str] = ("report_date",), out_col: str = "country",
               other: str = OTHER_COUNTRIES, measures: Sequence[str] | None = None) -> DataFrame:
    """A8 (+J5, A2): countries outside ``keep`` (and NULL) become ``other``; then every
    integer measure is re-summed (NULLs ignored). ``measures`` defaults to all
    integral columns that are not keys, chosen from the schema."""
    if measures is None:
        measures = columns_of(panel, T.IntegerType, T.LongType, T.ShortType, T.ByteType,
                              but=[country_col, *group_cols])
    k = keep.select(F.col(keep.columns[0]).alias("_keep")).filter(F.col("_keep").isNotNull()).distinct()
    j = panel.join(k, panel[country_col] == k["_keep"], "left")
    country = F.when(F.col("_keep").isNotNull(), F.col(country_col)).otherwise(F.lit(other))
    return (j.withColumn(out_col, country)
             .groupBy(out_col, *group_cols)
             .agg(*each(measures, lambda m: F.coalesce(F.sum(m), F.lit(0)).cast("long"))))


def person_profile(df: DataFrame, cols: Sequence[str], id_col: str = "unique_identifier",
                   decision_col: str = "decision", provenance: Sequence[str] = PROVENANCE) -> DataFrame:
    """W9 generalised: per person, ``first_<c>`` and ``latest_<c>`` for each column in
    person order (values may be NULL), and ``ever_approved``. One aggregate."""
    k = _person_key(provenance)
    aggs = []
    for c in cols:
        aggs += [F.min_by(F.col(c), k).alias(f"first_{c}"), F.max_by(F.col(c), k).alias(f"latest_{c}")]
    aggs.append(F.bool_or(_approved(decision_col)).alias("ever_approved"))
    return df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(*aggs)


def panel_vs_published(lumped: DataFrame, published_long: DataFrame, date_col: str = "report_date",
                       measures: Sequence[str] = MEASURES) -> DataFrame:
    """Estimates unpivoted to (country, date, source, value) and stacked on the
    published series (source 'CRS'), as the published comparison does."""
    est = lumped.unpivot(["country", date_col], list(measures), "source", "value")
    est = est.select("country", date_col, "source", F.col("value").cast("double").alias("value"))
    pub = published_long.select("country", F.col("report_date").alias(date_col), "source",
                                F.col("value").cast("double").alias("value"))
    return est.unionByName(pub)


def point_in_time_vs_published(estimate: DataFrame, published_long: DataFrame, as_of: str,
                               country_col: str = "ben_country_of_birth",
                               measures: Sequence[str] = MEASURES) -> DataFrame:
    """(country, source, value) at one date: the published counts above zero, and the estimates of a
    cross-section at that date (``cross_section``) for the countries that have one."""
    pub = (published_long.filter((F.col("report_date") == F.lit(as_of).cast("date")) & (F.col("value") > 0))
                         .select("country", "source", F.col("value").cast("double").alias("value")))
    est = (estimate.withColumnRenamed(country_col, "country").join(pub.select("country"), "country", "left_semi")
                   .unpivot(["country"], list(measures), "source", "value")
                   .withColumn("value", F.col("value").cast("double")))
    return pub.unionByName(est)


def reconcile_published(lumped: DataFrame, published_long: DataFrame, date_col: str = "report_date",
                        measures: Sequence[str] = MEASURES) -> DataFrame:
    """Estimates beside the published value for the same country and date, and those that stand
    on one side only: ``estimate``, ``published``, ``difference`` and ``ratio`` (estimate / published;
    NULL where either is missing or published is 0)."""
    est = lumped.unpivot(["country", date_col], list(measures), "source", "estimate")
    pub = published_long.select("country", F.col("report_date").alias(date_col),
                                F.col("value").cast("double").alias("published"))
    e = F.col("estimate").cast("double")
    return (est.join(pub, ["country", date_col], "full")
               .withColumn("difference", e - F.col("published"))
               .withColumn("ratio", F.try_divide(e, F.col("published"))))


def daily_counts(df: DataFrame, country: str, country_col: str = "ben_country_of_birth",
                 date_col: str = "decision_date", decision_col: str = "decision") -> DataFrame:
    """A3: rows per (decision date, decision) for one country."""
    return (df.filter(F.col(country_col) == F.lit(country))
              .groupBy(date_col, decision_col).agg(F.count(F.lit(1)).alias("n")))


def date_bounds(df: DataFrame, col: str = "rec_date") -> DataFrame:
    """A4: one row (start, end) = min/max ignoring NULLs."""
    return df.agg(F.min(col).alias("start"), F.max(col).alias("end"))
