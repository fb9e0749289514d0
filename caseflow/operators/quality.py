"""Row-count reconciliation and stage metrics (Q1, Q2)."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class CountMismatch(AssertionError):
    """A reconciliation count that must be zero is not."""


def count_checks(df: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    """One-row frame with ``n_rows`` and ``count_if`` of each named predicate."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.count_if(F.coalesce(p, F.lit(False))).alias(n) for n, p in counts.items()])


def observe_stage(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Q2: attach a named row counter that fills in when the frame is next written or
    collected (no extra job). Read it with ``obs.get`` after the action."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


class ChangeLog:
    """Q2: what every verb of a plan did to rows and columns, filled in by the one write that runs the plan.

    ``step`` marks the frame after a verb: its row count (and other counts) is observed when the plan runs,
    without a job of its own, and its columns are compared with those of the step before. The frame must be read
    once by the plan: an observation on two branches would count twice. So would a task that runs again after a
    lost executor; ``reconcile`` therefore counts anew, by plain aggregates, before it calls counts unequal."""

    def __init__(self) -> None:
        self._steps: list[tuple[str, Observation, DataFrame, dict[str, Column], str | None]] = []
        self._recounted: list[dict[str, int]] | None = None
        self._id = uuid.uuid4().hex

    def step(self, df: DataFrame, verb: str, drops: str | None = None, **counts: Column) -> DataFrame:
        """``drops`` names the count (of an earlier step) of the rows that this verb removes; a verb without
        it keeps all."""
        obs = Observation(f"{self._id}-{len(self._steps)}-{verb}")
        self._steps.append((verb, obs, df, counts, drops))
        return df.observe(obs, *self._aggregates(counts))

    @staticmethod
    def _aggregates(counts: Mapping[str, Column]) -> list[Column]:
        return [F.count(F.lit(1)).alias("rows"),
                *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()]]

    def _counts(self) -> list[dict[str, int]]:
        return self._recounted or [obs.get for _, obs, _, _, _ in self._steps]

    def rows(self) -> list[dict]:
        """Per verb: rows_in, rows_out, and the columns added, dropped and retyped. After the action only."""
        out, before = [], None
        for (verb, _, df, _, _), n in zip(self._steps, self._counts()):
            cols = dict(df.dtypes)
            before = cols if before is None else before
            out.append({
                "verb": verb, "rows_in": out[-1]["rows_out"] if out else n["rows"], "rows_out": n["rows"],
                "added": ", ".join(sorted(cols.keys() - before.keys())),
                "dropped": ", ".join(sorted(before.keys() - cols.keys())),
                "retyped": ", ".join(f"{c}: {before[c]} -> {cols[c]}" for c in sorted(cols.keys() & before.keys())
                                     if cols[c] != before[c])})
            before = cols
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *r.values()) for i, r in enumerate(self.rows())],
                                     "step int, verb string, rows_in long, rows_out long, added string, dropped string, "
                                     "retyped string")

    def _mismatch(self, written: int | None) -> str | None:
        counts = self._counts()
        known = {k: v for c in counts for k, v in c.items() if k != "rows"}
        for r, (verb, _, _, _, drops) in zip(self.rows(), self._steps):
            expected = r["rows_in"] - (known[drops] if drops else 0)
            if r["rows_out"] != expected:
                return f"{verb}: {r['rows_in']} rows in, {r['rows_out']} out, {expected} expected"
        if written is not None and counts and written != counts[-1]["rows"]:
            return f"{counts[-1]['rows']} rows out, {written} written"
        return None

    def reconcile(self, written: int | None = None) -> None:
        """Q1: raise ``CountMismatch`` if a verb lost or added rows beyond those that were counted for it, or if
        not as many rows as the last one left are ``written``."""
        if self._mismatch(written):
            self._recounted = [df.agg(*self._aggregates(c)).first().asDict() for _, _, df, c, _ in self._steps]
            if bad := self._mismatch(written):
                raise CountMismatch(bad)
