"""Language ID: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed 3- and 4-character subwords
(lower-cased; every non-letter reads as a space), put through a linear softmax. The model is
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows, its
temperature is fitted on a part of that sample that training never saw. A prediction is rejected
where its calibrated confidence, or the share of its letters whose 4-character subword occurs in
the training part, is below a floor. Both floors are fitted on that same part, for each class of
text length (``SIZES``) by itself; they are the ``reject_share`` quantile of correct predictions,
continued beyond the part's own values by an exponential tail.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected.
Rows with a null label are not learned from; without any labelled row every text is ``und``.
Ties between languages go to the one first in alphabetical order. Repeated rows are predicted
alike. Prediction reads whole texts, in pieces that overlap by a subword.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.frames import released, texts_in_slices
from caseflow.llm.textops import codepoints

UNDETERMINED = "und"
SIZES = (0, 32, 128, 512)          # least letters of each class of text length
MIN_HELD = 40                      # correct predictions that a class's floors are fitted on
SEEN_BITS = 24                     # of the hashes of the subwords that training saw
_MULT = np.uint32(0x9E3779B1)
_SEP = "   "                       # subwords around a letter never reach over three spaces
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def subwords(text: str, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position of each letter, hash of the 3-gram around it, hash of the 4-gram from before it,
    that in ``SEEN_BITS`` bits)."""
    cp = codepoints(text)
    letter = _letter_table()[cp]
    at = np.flatnonzero(letter)
    c = np.where(letter, cp, np.uint32(32))
    c = np.concatenate((c, np.full(3, 32, np.uint32)))
    h = (c[at - 1] * np.uint32(0x85EBCA6B) + c[at]) * np.uint32(0xC2B2AE35) + c[at + 1]
    g3 = (h * _MULT) >> np.uint32(32 - bits)
    wide = ((h * np.uint32(0x27D4EB2F) + c[at + 2]) * _MULT ^ np.uint32(0x5BD1E995)) * _MULT
    return at, g3, wide >> np.uint32(32 - bits), wide >> np.uint32(32 - SEEN_BITS)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray                      # bucket x language: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    score_floor: np.ndarray = field(default_factory=lambda: np.zeros(len(SIZES)))   # by class of text length
    seen_floor: np.ndarray = field(default_factory=lambda: np.zeros(len(SIZES)))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(1 << SEEN_BITS - 3, np.uint8))   # packed bits
    bits: int = 16
    stats: dict = field(default_factory=dict)

    def logits(self, texts: list[str], piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Logits of every text and its number of letters."""
        return self._read(texts, piece)[:2]

    def _read(self, texts: list[str], piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, number of letters and how many of them have a subword that training saw. Texts longer than ``piece`` are read in
        overlapping pieces; every letter is the centre of its subwords in exactly one."""
        k = len(self.languages)
        sums, counts, known = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        owner, parts = [], []
        for i, t in enumerate(texts):
            t = t.lower()
            for a in range(0, len(t), piece):
                # one character before the piece and two after it, blank at the text's ends
                body = t[max(0, a - 1):a + piece + 2]
                owner.append((i, a > 0, min(piece, len(t) - a)))
                parts.append(body)
        if not parts:
            return sums + self.bias, counts, known
        lead = np.array([o[1] for o in owner], np.int64)
        core = np.array([o[2] for o in owner], np.int64)
        size = np.array([len(p) for p in parts], np.int64) + len(_SEP)
        begin = np.concatenate(([0], np.cumsum(size)[:-1])) + len(_SEP)
        at, g3, g4, wide = subwords(_SEP + _SEP.join(parts) + _SEP, self.bits)
        lo = np.searchsorted(at, begin + lead)
        hi = np.searchsorted(at, begin + lead + core)
        rows = np.array([o[0] for o in owner])
        for j in range(k):
            col = np.ascontiguousarray(self.table[:, j])
            acc = np.concatenate(([0.0], np.cumsum(col[g3].astype(np.float64) + col[g4])))
            np.add.at(sums[:, j], rows, acc[hi] - acc[lo])
        np.add.at(counts, rows, hi - lo)
        acc = np.concatenate(([0], np.cumsum(self.seen[wide >> 3] >> (wide & 7) & 1, dtype=np.int64)))
        np.add.at(known, rows, acc[hi] - acc[lo])
        return sums / np.maximum(2 * counts, 1)[:, None] + self.bias, counts, known

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated confidence, and whether the prediction is accepted."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        z, letters, seen = self._read([t or "" for t in texts])
        p = _softmax(z / self.temperature)
        best = p.argmax(1)
        score = np.where(letters > 0, p[np.arange(len(texts)), best], 0.0)
        lang = [self.languages[b] if n else UNDETERMINED for b, n in zip(best, letters)]
        size = _size(letters)
        return lang, score, ((letters > 0) & (score >= self.score_floor[size])
                             & (seen >= self.seen_floor[size] * letters))


def _size(letters: np.ndarray) -> np.ndarray:
    return np.searchsorted(SIZES, letters, "right") - 1


def _low_quantile(x: np.ndarray, share: float, tail: float = 0.05) -> float:
    """The value that a ``share`` of the population lies below; where the sample is too small to hold
    it, by an exponential tail through its lowest values."""
    x = np.sort(x)
    k = min(max(5, int(tail * x.size)), x.size - 1)
    if k <= share * x.size:
        return float(x[int(share * x.size)])
    return float(x[k] - (x[k] - x[:k].mean()) * np.log(k / (share * x.size)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], bits: int = 16, dim: int = 12, epochs: int = 6, rate: float = 0.6,
          reject_share: float = 0.0005, seed: int = 7) -> Model:
    """SGD over single texts. Every labelled text gives itself and a short excerpt, so that short
    texts are calibrated too; every fifth row is kept for calibration."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), bits=bits)
    index = {lang: i for i, lang in enumerate(languages)}
    emb = rng.normal(0, 1 / dim, (1 << bits, dim)).astype(np.float32)
    w, b = np.zeros((len(languages), dim), np.float32), np.zeros(len(languages), np.float32)
    fit, held = [], []
    seen = np.zeros(1 << SEEN_BITS, bool)
    for i, (text, lang) in enumerate(rows):
        words = text.split()
        cut = rng.integers(0, max(1, len(words) - 6))
        for t in (text, " ".join(words[cut:cut + int(rng.integers(2, 9))])):
            _, g3, g4, wide = subwords(_SEP + t.lower() + _SEP, bits)
            if g3.size:
                u, n = np.unique(np.concatenate((g3, g4)), return_counts=True)
                (held if i % 5 == 4 else fit).append((u, (n / n.sum()).astype(np.float32), index[lang], t))
                if i % 5 != 4:
                    seen[wide] = True
    steps, total = 0, max(1, epochs * len(fit))
    for _ in range(epochs):
        for j in rng.permutation(len(fit)):
            u, share, y, _ = fit[j]
            x = share @ emb[u]
            g = _softmax(w @ x + b)
            g[y] -= 1
            lr = rate * (1 - steps / total)
            gx = w.T @ g
            w -= lr * np.outer(g, x)
            b -= lr * 0.1 * g
            emb[u] -= lr * share[:, None] * gx * min(u.size, 64)   # rows of an average learn with its size
            steps += 1
    model = Model(languages, (emb @ w.T).astype(np.float32), b.astype(np.float64), bits=bits,
                  seen=np.packbits(seen, bitorder="little"))
    held = held or fit
    if not held:                                        # no labelled row has a letter
        return model
    z, letters, known = model._read([h[3] for h in held])
    y = np.array([h[2] for h in held])
    grid = np.exp(np.linspace(np.log(0.05), np.log(8), 60))
    at = np.arange(len(held))
    model.temperature = float(min(grid, key=lambda t: -np.log(_softmax(z / t)[at, y] + 1e-12).mean()))
    p = _softmax(z / model.temperature)
    right = p.argmax(1) == y
    score, share, size = p[at, y], known / letters, _size(letters)
    for i in range(len(SIZES)):
        # a class with few held texts takes in the shorter ones, whose floors are lower
        near = next((c for j in range(i, -1, -1) if (c := right & (size <= i) & (size >= j)).sum() >= MIN_HELD), right)
        if near.any():
            odds = np.log(score[near] + 1e-12) - np.log1p(-score[near] + 1e-12)
            model.score_floor[i] = 1 / (1 + np.exp(-_low_quantile(odds, reject_share)))
            model.seen_floor[i] = _low_quantile(share[near], reject_share)
    # a shorter text meets no higher floor than a longer one, and no confidence whose error is under reject_share fails
    model.score_floor = np.minimum(np.minimum.accumulate(model.score_floor[::-1])[::-1], 1 - reject_share)
    model.seen_floor = np.minimum.accumulate(model.seen_floor[::-1])[::-1]
    model.stats = {"held": len(held), "accuracy": float((p.argmax(1) == y).mean())}
    return model


def labelled_sample(df: DataFrame, label: str, learn: Column, per_class: int, window: int) -> list[tuple[str, str]]:
    """About ``per_class`` labelled rows of every label, each a window of at most ``window`` characters.

    Row and window are chosen by a hash of id and text, so an id that many texts share is drawn like
    others, and copies of a row with its id count once. The order of the hash cuts the sample at twice the size, which
    it does not reach but by chance; it is the same in every run."""
    rows = df.filter(learn & F.col(label).isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "text", F.col(label).cast("string").alias("label"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).collect()      # every label has its column in the model
    if not counts:
        return []
    shares = df.sparkSession.createDataFrame([(r["label"], float(per_class << 52) / r["n"]) for r in counts], "label string, _most double")

    def dice(seed: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 52))
    place = dice(29) % F.greatest(F.length("text") - window + 1, F.lit(1)) + 1
    drawn = rows.withColumn("_dice", dice(17)).join(F.broadcast(shares), "label").filter(F.col("_dice") < F.col("_most"))
    got = (drawn.select("_dice", F.substring("text", place.cast("int"), F.lit(window)).alias("text"), "label").distinct()
           .orderBy("_dice", "text", "label").limit(2 * per_class * len(counts)).collect())
    return [(r["text"], r["label"]) for r in got]


def fit(df: DataFrame, learn: Column, per_class: int = 500, window: int = 1200, **kw) -> Model:
    """Learn from ``text`` and ``lang`` of the rows where ``learn`` holds (sample bounds: see
    ``labelled_sample``)."""
    return train(labelled_sample(df.select("doc_id", "text", "lang"), "lang", learn, per_class, window), **kw)


def identify(df: DataFrame, model: Model, pass_through: list[str], schema: str) -> DataFrame:
    """``pass_through`` columns, then lang_pred, score, accepted. ``schema`` is the DDL of the result."""
    shared = df.sparkSession.sparkContext.broadcast(model)   # buckets x languages, a fixed size

    def run(batches):
        m = shared.value
        for batch in batches:
            for i, j, texts in texts_in_slices(batch, "text", 1 << 20):
                lang, score, ok = m.predict(texts)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in pass_through]
                    + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok)],
                    names=pass_through + ["lang_pred", "score", "accepted"])

    return df.mapInArrow(released(run), schema)


def keep_identified(df: DataFrame, model: Model) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose language prediction is accepted."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            one = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            for i, j, texts in texts_in_slices(one, "text", 1 << 20):
                yield batch.slice(i, j - i).filter(pa.array(m.predict(texts)[2]))

    return df.mapInArrow(released(run), df.schema)
