"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A document's utility is linear in its standardised statistics. Pairs (a document labelled good,
one labelled bad) train it: logistic loss on the difference of the two feature vectors, by
gradient descent in numpy. The cut is a quantile of the training scores: the share of bad
documents among all labelled rows. Utilities map to scores in (0, 1) by a logistic curve
fitted on the labels and shifted so that the cut lies at 0.3.

Defined results: null and empty texts have the statistics of an empty text and get a score like
any other; without both labels every score is 0.5. Repeated rows score alike; scores depend on
the text only. Statistics read whole texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.frames import keep, texts_in_slices

CUT = 0.3
# byte classes: 0 other, 1 white space, 2 symbol, 3 upper case, 4 lower case, 5 digit,
# 6 exclamation or question mark, 7 other ASCII punctuation, 8 non-ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
for _c in range(33, 127):
    _s = chr(_c)
    _CLASS[_c] = (3 if _s.isupper() else 4 if _s.islower() else 5 if _s.isdigit() else 2 if _s in "#*$%&|<>~^_=\\@"
                  else 6 if _s in "!?" else 7)
_CLASS[128:] = 8
N_FEATURES = 12


def features(data: bytes) -> np.ndarray:
    """Statistics of a text in UTF-8 (words: runs of non-space bytes)."""
    words = data.split()
    if not words:
        return np.zeros(N_FEATURES)
    a = np.frombuffer(data, np.uint8)
    n = np.zeros(9)
    for i in range(0, a.size, 1 << 22):
        n += np.bincount(_CLASS[a[i:i + (1 << 22)]], minlength=9)
    chars = max(a.size - n[1], 1)
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    w = len(words)
    lines = data.split(b"\n")
    marks = sum(v for k, v in count.items() if len(k) == 1 and _CLASS[k[0]] == 2)
    return np.array([
        np.log1p(w), n[2] / chars, n[6] / w, n[3] / max(n[3] + n[4], 1), n[5] / chars, n[7] / w,
        np.log1p(len(count)) / np.log1p(w), min(chars / w, 30), n[8] / chars, max(count.values()) / (w + 4),
        marks / w, 1 - len({x for x in lines if x}) / max(sum(1 for x in lines if x), 1)])


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    slope: float
    cut: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * (self.utility(x) - self.cut), -30, 30) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def learn(x: np.ndarray, y: np.ndarray, bad_share: float, pairs: int = 20000, steps: int = 400, rate: float = 0.5,
          l2: float = 1e-3, seed: int = 11, cut: Callable[[Ranker], float] | None = None) -> Ranker | None:
    """Fit on feature rows ``x`` with labels ``y`` (1 good, 0 bad); None without both labels. ``cut`` gives the threshold
    for the weights; without it, it is the weighted quantile of the rows themselves."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return None
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    r = Ranker(mean, scale, np.zeros(x.shape[1]), 1.0, 0.0)
    std = lambda v: np.clip((v - mean) / scale, -8, 8)
    d = std(good[rng.integers(0, len(good), pairs)]) - std(bad[rng.integers(0, len(bad), pairs)])
    speed = np.zeros_like(r.weight)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ r.weight, -30, 30)))         # probability of the wrong order
        speed = 0.9 * speed + (p @ d) / pairs - l2 * r.weight
        r.weight = r.weight + rate * 0.1 * speed
    u = r.utility(x)
    # quantile at the share of bad rows among all labelled ones, whatever the sample's own shares are
    w = np.where(y == 0, bad_share / len(bad), (1 - bad_share) / len(good))
    if cut is None:
        o = np.argsort(u, kind="stable")
        at = int(np.searchsorted(np.cumsum(w[o]), bad_share))
        at = min(max(at, 0), len(o) - 2) if len(o) > 1 else 0
        r.cut = float((u[o[at]] + u[o[min(at + 1, len(o) - 1)]]) / 2)
    else:
        r.cut = cut(r)
    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 40))

    def loss(s: float) -> float:
        q = 1 / (1 + np.exp(-np.clip(s * (u - r.cut), -30, 30)))
        return float((w * -np.log(np.where(y == 1, q, 1 - q) + 1e-9)).sum())

    r.slope = float(min(grid, key=loss))
    return r


def _feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, dice (a hash of id and text) and the features of every whole text."""
    names = [f"f{k}" for k in range(N_FEATURES)]

    def run(batches):
        for batch in batches:
            for i, j, part in texts_in_slices(batch, "text", 1 << 22, binary=True):
                x = np.array([features(t or b"") for t in part])
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in (0, 1)] + [pa.array(x[:, k]) for k in range(N_FEATURES)],
                                                 names=["doc_id", "dice", *names])

    dice = F.pmod(F.xxhash64("doc_id", "text", F.lit(31)), F.lit(1 << 52))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), dice.alias("dice"), "text").mapInArrow(
        run, f"doc_id long, dice long, {', '.join(f'{c} double' for c in names)}")


def fit(docs: DataFrame, labels: DataFrame, not_learned: "F.Column", per_class: int = 1500, **kw) -> Ranker | None:
    """Learn from labelled documents outside the held-out fold. One label per id: the largest.

    Weights come from about ``per_class`` documents of either label, drawn by a hash of id and text (copies of a
    row with its id count once; the hash's order cuts the sample at twice the size, which it does not reach but by chance).
    The threshold is the quantile of the scores of all labelled documents outside the fold at the share of bad ones among
    them, an aggregate of bounded size over all of them (``percentile_approx``, ranks right to 1 in 10,000). Labels meet
    features, not texts, so the join moves a hundred bytes a document."""
    names = [f"f{k}" for k in range(N_FEATURES)]
    lab = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~not_learned)
           .groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")))
    every = keep(_feature_rows(docs).join(lab, "doc_id").select("dice", "y", *names), "quality-features")
    counts = {r["y"]: r["n"] for r in every.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("y") == 1, per_class / counts[1]).otherwise(per_class / counts[0])
    rows = (every.filter(F.col("dice") < share * F.lit(float(1 << 52))).distinct()
            .orderBy("dice", "y", *names).limit(4 * per_class).collect())
    if not rows:
        return None
    x, y = np.array([r[2:] for r in rows], float), np.array([r[1] for r in rows])
    bad_share = counts[0] / (counts[0] + counts[1])

    def cut(r: Ranker) -> float:
        parts = [F.greatest(F.least((F.col(c) - float(m)) / float(s), F.lit(8.0)), F.lit(-8.0)) * float(w)
                 for c, m, s, w in zip(names, r.mean, r.scale, r.weight)]
        at = F.percentile_approx(reduce(lambda a, b: a + b, parts), F.lit(bad_share), F.lit(10000))
        return float(every.agg(at.alias("at")).first()["at"])

    return learn(x, y, bad_share, cut=cut, **kw)


def rate(docs: DataFrame, model: Ranker | None) -> DataFrame:
    """doc_id, score, predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)   # a few dozen numbers

    def run(batches):
        m = shared.value
        for batch in batches:
            for i, j, texts in texts_in_slices(batch, "text", 1 << 22, binary=True):
                x = np.array([features(t or b"") for t in texts])
                s = m.score(x) if m else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(s),
                     pa.array((s >= CUT).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
