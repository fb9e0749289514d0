"""Quality rules: robust multivariate outliers per language and source.

Every text becomes a vector of transformed statistics. Per (language, source) group the minimum
covariance determinant estimate is found by concentration steps that run as Spark aggregates: the
rows' squared Mahalanobis distances fall into fixed logarithmic bins, moments are summed per
(group, start, bin), and the bins up to the one that reaches the share ``H`` of the group, that one
in part, are the next subset. So a step is one aggregate whose size is groups x starts x bins,
however large a group is, and no row is sampled. Four deterministic starts (quartile scales, the
correlation of tanh scores, that of spatial signs, the covariance of all rows) go through the steps
until their determinant falls no more; the least determinant of a group is its estimate. Rows whose
robust distance exceeds a chi-square quantile are rejected. A statistic that does not vary in the
subset (rates are zero in most texts) has the deviation ``FLOOR``, a resolution, instead of a smaller one.

Defined results: a null text has no words. Null language or source count as the empty string.
Groups of under ``MIN_GROUP`` usable rows use the estimate of all rows; if those are under
``MIN_GROUP`` too, only the base rule decides. Texts that fail the base rule are not used for the
estimates. Ties in distance share a bin and enter the subset together. Repeated rows count as often
as they occur.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.frames import keep, texts_in_slices

H = 0.75                      # share of a group that the subset holds
FALL = 1e-3                   # least fall of the log determinant that a step must bring
STEPS = 50                    # concentration steps at most; they end by themselves before
MIN_GROUP = 50
BINS_PER_OCTAVE = 8
CUT_PROBABILITY = 0.999       # of the chi-square distribution
# least standard deviations, where a subset's is smaller: rates that are zero in most texts have none
FLOOR = (0.10, 0.04, 0.04, 0.06, 0.045)
DIM = len(FLOOR)
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(set(range(256)) - set(_SYMBOLS))
_SPACES = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words inside a window of ``k`` words that occurs twice or more (exact, by word numbers)."""
    if len(words) <= k:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    m, key, base = len(words) - k + 1, ids, len(number)
    acc = key[:m].copy()
    span = base
    for i in range(1, k):
        if span * base >= 1 << 62:                 # renumber, so that numbers stay exact
            _, acc = np.unique(acc, return_inverse=True)
            span = int(acc.max()) + 1
            if span * base >= 1 << 62:
                raise OverflowError("text too long for exact window numbers")
        acc = acc * base + key[i:i + m]
        span *= base
    order = np.argsort(acc, kind="stable")
    same = acc[order][1:] == acc[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(m, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    cover[:m] += hit
    np.subtract.at(cover, at + k, 1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def counts(data: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a UTF-8 text."""
    words = data.split()
    chars = len(data.translate(None, _SPACES + _CONTINUATION))
    symbols = len(data.translate(None, _NOT_SYMBOL))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words), lines


def vector(c: np.ndarray) -> np.ndarray:
    """Transformed statistics of rows of ``counts``: sizes by logarithm, rates by square root."""
    c = c.astype(float)
    w = np.maximum(c[:, 0], 1)
    return np.column_stack([np.log1p(c[:, 0]) / 2, c[:, 1] / w / 4, np.sqrt(c[:, 2] / np.maximum(c[:, 1], 1)),
                            np.sqrt(c[:, 3] / np.maximum(c[:, 5], 1)) / 2, np.sqrt(c[:, 4] / w) / 2])


def chi2_quantile(p: float, df: int) -> float:
    """Quantile by bisection on the regularised lower incomplete gamma series."""
    def cdf(x: float) -> float:
        a, x = df / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-14:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    lo, hi = 1e-9, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_X = [f"x{i}" for i in range(DIM)]
_XX = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, group columns, the counts and the vector of every whole text."""
    names = ["doc_id", "g_lang", "g_source", *_COUNTS, *_X]
    schema = ("doc_id long, g_lang string, g_source string, " + ", ".join(f"{c} long" for c in _COUNTS)
              + ", " + ", ".join(f"{x} double" for x in _X))

    def run(batches):
        for batch in batches:
            for i, j, texts in texts_in_slices(batch, "text", 1 << 22, binary=True):
                c = np.array([counts(t or b"") for t in texts], np.int64).reshape(-1, 6)
                v = vector(c)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1).cast(pa.string()), part.column(2).cast(pa.string())]
                    + [pa.array(c[:, k]) for k in range(5)] + [pa.array(v[:, k]) for k in range(DIM)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("g_lang"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("g_source"),
                       "text").mapInArrow(run, schema)


def _distance(shape: str = "shape") -> "F.Column":
    """Squared distance of x0.. under the group's struct (mean, inverse as arrays)."""
    d = [F.col(x) - F.col(f"{shape}.mean")[i] for i, x in enumerate(_X)]
    terms = [(1 if i == j else 2) * F.col(f"{shape}.inverse")[i * DIM + j] * d[i] * d[j] for i, j in _XX]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.greatest(out, F.lit(0.0))


def _moments(x: list = _X, name: str = "") -> list:
    """Sums and summed products of five columns."""
    c = [F.col(v) if isinstance(v, str) else v for v in x]
    return ([F.sum(v).alias(f"{name}s{i}") for i, v in enumerate(c)]
            + [F.sum(c[i] * c[j]).alias(f"{name}q{i}_{j}") for i, j in _XX])


_SUMS = ["n", *[f"s{i}" for i in range(DIM)], *[f"q{i}_{j}" for i, j in _XX]]
_SHAPE = "g_lang string, g_source string, start int, mean array<double>, inverse array<double>, logdet double"


def _mean_cov(r, name: str = "") -> tuple[np.ndarray, np.ndarray]:
    m = np.array([getattr(r, f"{name}s{i}") for i in range(DIM)]) / r.n
    c = np.zeros((DIM, DIM))
    for i, j in _XX:
        c[i, j] = c[j, i] = getattr(r, f"{name}q{i}_{j}") / r.n - m[i] * m[j]
    return m, c


def _shape(m: np.ndarray, c: np.ndarray) -> tuple[list, list, float]:
    """Mean, inverse and log determinant of a scatter whose least variances are the floor's."""
    c = c + np.diag(np.maximum(np.square(FLOOR) - np.diag(c), 0))
    sd = np.sqrt(np.diag(c))
    c = c + np.diag(1e-6 * sd ** 2)                     # statistics that determine one another
    return m.tolist(), np.linalg.inv(c).ravel().tolist(), float(np.linalg.slogdet(c)[1])


def _with_shape(sums: DataFrame, consistency: float) -> DataFrame:
    """A concentration step's estimate from a subset's summed moments."""
    def run(frames):
        import pandas as pd
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                m, c = _mean_cov(r)
                rows.append((r.g_lang, r.g_source, r.start, *_shape(m, consistency * c)))
            yield pd.DataFrame(rows, columns=["g_lang", "g_source", "start", "mean", "inverse", "logdet"])
    return sums.mapInPandas(run, _SHAPE)


def _starts(sums: DataFrame) -> DataFrame:
    """Every group's starts, from its medians, quartile scales and moments."""
    def correlation(c):
        sd = np.sqrt(np.maximum(np.diag(c), 0))
        r = np.where(np.outer(sd, sd) > 1e-12, c / np.maximum(np.outer(sd, sd), 1e-12), 0.0)
        np.fill_diagonal(r, 1.0)
        return r

    def run(frames):
        import pandas as pd
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                median, scale = np.array(r.median, float), np.array(r.scale, float)
                by_scale = np.outer(scale, scale)
                everything = _mean_cov(r)
                for i, (m, c) in enumerate([(median, np.eye(DIM) * by_scale),
                                            (median, correlation(_mean_cov(r, "t")[1]) * by_scale),
                                            (median, correlation(_mean_cov(r, "u")[1]) * by_scale), everything]):
                    mean, inverse, _ = _shape(m, c)
                    rows.append((r.g_lang, r.g_source, i, mean, inverse, float("inf")))
            yield pd.DataFrame(rows, columns=["g_lang", "g_source", "start", "mean", "inverse", "logdet"])
    return sums.mapInPandas(run, _SHAPE)


def estimate(stats: DataFrame, steps: int = STEPS) -> DataFrame:
    """One row per group (and one, ``g_source`` null, for all rows): mean and inverse scatter."""
    a = chi2_quantile(H, DIM)
    # the subset's scatter is too small by this factor for normal rows
    cf = H / max(1e-9, _chi2_cdf(a, DIM + 2))
    use = stats.filter(~F.col("base_failed"))
    # aggregates of groups x starts x bins need few tasks, however many partitions a shuffle has
    few = stats.sparkSession.sparkContext.defaultParallelism
    # every group's rows and their overall copy share one aggregate
    both = lambda df: df.withColumn("g", F.explode(F.array(
        F.struct("g_lang", "g_source"), F.struct(F.lit(None).cast("string").alias("g_lang"), F.lit(None).cast("string").alias("g_source")))))
    group = [F.col("g.g_lang").alias("g_lang"), F.col("g.g_source").alias("g_source")]

    def rows_with(shape: DataFrame, *columns: str) -> DataFrame:
        """The rows of each group beside the group's ``columns``."""
        s = shape.select(F.col("g_lang").alias("k_lang"), F.col("g_source").alias("k_source"), *columns)
        return both(use).join(s, F.col("g.g_lang").eqNullSafe(F.col("k_lang")) & F.col("g.g_source").eqNullSafe(F.col("k_source")))

    quart = [F.percentile_approx(x, F.lit([0.25, 0.5, 0.75]).cast("array<double>"), F.lit(2000)).alias(f"m{i}") for i, x in enumerate(_X)]
    first = both(use).groupBy(*group).agg(F.count("*").alias("n"), *quart).filter(F.col("n") >= MIN_GROUP)
    first = keep(first.select("g_lang", "g_source", F.array(*[F.col(f"m{i}")[1] for i in range(DIM)]).alias("median"),
                              F.array(*[F.greatest((F.col(f"m{i}")[2] - F.col(f"m{i}")[0]) * 0.7413, F.lit(FLOOR[i]))
                                        for i in range(DIM)]).alias("scale")).coalesce(few), "mcd")
    z = [(F.col(x) - F.col("median")[i]) / F.col("scale")[i] for i, x in enumerate(_X)]
    scored = rows_with(first, "median", "scale").select(*group, "median", "scale", *_X, *[v.alias(f"z{i}") for i, v in enumerate(z)])
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIM)), F.lit(1e-12)))
    scored = scored.select("*", *[F.tanh(f"z{i}").alias(f"t{i}") for i in range(DIM)],
                           *[(F.col(f"z{i}") / length).alias(f"u{i}") for i in range(DIM)])
    moving = keep(_starts(scored.groupBy("g_lang", "g_source", "median", "scale").agg(
        F.count("*").alias("n"), *_moments(), *_moments([f"t{i}" for i in range(DIM)], "t"),
        *_moments([f"u{i}" for i in range(DIM)], "u")).coalesce(few)), "mcd")
    done = None
    same = ["g_lang", "g_source", "start"]
    for _ in range(steps):
        d = (rows_with(moving, "start", F.struct("mean", "inverse").alias("shape"))
             .withColumn("bin", F.floor(F.log2(_distance() + 1e-6) * BINS_PER_OCTAVE).cast("int")))
        sums = d.groupBy(*group, "start", "bin").agg(F.count("*").alias("n"), *_moments()).coalesce(few)
        by = Window.partitionBy(*same)                           # at most a few hundred bins a start
        upto = sums.select(*same, "bin", F.sum("n").over(by).alias("all"), F.sum("n").over(by.orderBy("bin")).alias("upto"), *_SUMS)
        # the bin that reaches the share counts in part, so that all subsets are of one size
        part = F.least(F.lit(1.0), (H * F.col("all") - F.col("upto") + F.col("n")) / F.col("n"))
        inside = upto.withColumn("part", part).filter("part > 0")
        new = _with_shape(inside.groupBy(*same).agg(*[F.sum(F.col(c) * F.col("part")).alias(c) for c in _SUMS]).coalesce(few), cf)
        old = moving.select(*[F.col(c).alias(f"o_{c}") for c in same], F.struct("mean", "inverse", "logdet").alias("old"))
        step = keep(new.join(old, F.col("g_lang").eqNullSafe(F.col("o_g_lang")) & F.col("g_source").eqNullSafe(F.col("o_g_source"))
                             & (F.col("start") == F.col("o_start")))
                    .select(*same, F.struct("mean", "inverse", "logdet").alias("new"), "old",
                            (F.col("logdet") < F.col("old.logdet") - FALL).alias("falls")), "mcd")
        still = step.filter(~F.col("falls")).select(*same, "old.*")
        done = still if done is None else done.unionAll(still)
        moving = step.filter("falls").select(*same, "new.*")
        if moving.isEmpty():
            break
    found = moving if done is None else done.unionAll(moving)
    best = found.groupBy("g_lang", "g_source").agg(F.min(F.struct("logdet", "start", "mean", "inverse")).alias("b"))
    return keep(best.select("g_lang", "g_source", "b.mean", "b.inverse").coalesce(few), "mcd")


def _chi2_cdf(x: float, df: int) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_quantile(mid, df) < x else (lo, mid)
    return (lo + hi) / 2


def judge(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """doc_id, the five counts, base_failed, robust distance and kept for every document."""
    stats = keep(statistics(docs).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))), "stats")
    shape = estimate(stats, steps)
    own = shape.filter(F.col("g_source").isNotNull()).select(
        F.col("g_lang").alias("k_lang"), F.col("g_source").alias("k_source"), F.struct("mean", "inverse").alias("own"))
    everyone = shape.filter(F.col("g_source").isNull()).collect()     # one row at most
    kind = "struct<mean:array<double>,inverse:array<double>>"
    rest = (F.struct(F.array(*map(F.lit, everyone[0]["mean"])).alias("mean"),
                     F.array(*map(F.lit, everyone[0]["inverse"])).alias("inverse")) if everyone
            else F.lit(None)).cast(kind)
    cut = chi2_quantile(CUT_PROBABILITY, DIM)
    d = (stats.join(own, (F.col("g_lang") == F.col("k_lang")) & (F.col("g_source") == F.col("k_source")), "left")
         .withColumn("shape", F.coalesce(F.col("own").cast(kind), rest)))
    return (d.withColumn("distance2", F.when(F.col("shape").isNotNull(), _distance()))
            .select("doc_id", *_COUNTS, "base_failed", "distance2",
                    (~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= cut)).alias("kept")))
