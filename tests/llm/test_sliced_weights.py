"""Importance resampling against a plain sum per feature, on texts with nulls, long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import sliced_weights as sw

DOCS = "doc_id long, text string, lang string, rank long, score double, weight string, n long, _text string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "xx", 5, 0.5, "w", 1, "clash") for i, t in texts], DOCS)


def target(spark, texts):
    return spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "item_id long, text string, bucket int")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def brute(texts, items):
    def counts(all_texts):
        n = [0] * 10000
        for t in all_texts:
            for f in features(t):
                n[bucket(f)] += 1
        return n, sum(n)
    (s, all_s), (t, all_t) = counts(x for _, x in texts), counts(items)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for i, x in texts:
        f = features(x)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fits = sorted((r for r in rows if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fits[:25 * len(fits) // 100]):
        r[4] = k + 1
    return gain, [tuple(r) for r in rows]


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [a + b for a in ("ba", "dé", "ki", "Lo", "MU", "日本", "x9") for b in ("ra", "te", "ñi", "", "7")]
    out = [(i, "  ".join(rng.choice(words) for _ in range(rng.randrange(1, 90)))) for i in range(60)]
    out += [(100, None), (101, ""), (102, " \n.,;!\t"), (103, "one"), (104, "One-TWO"), (105, "ÀÉ İ ß ſ K")]
    out += [(7, out[7][1]), (7, out[7][1]), (7, out[9][1]), (None, out[3][1]), (None, out[4][1] * 3)]   # repeated and null ids
    out += [(110 + i, "same words " * 15) for i in range(8)]                                           # ties
    out += [(130, "long " * 70000 + "tail"), (131, "z" * 300000), (132, "a " * 19 + "b"), (133, "a " * 18 + "b")]
    return out


def test_ranked_weights_are_the_plain_sums(spark, texts, monkeypatch):
    items = [texts[0][1], texts[1][1], None, "", "long tail"]
    gain, want = brute(texts, items)
    assert sw.gains(frame(spark, texts), target(spark, items)).tolist() == gain
    for df in (frame(spark, texts), frame(spark, texts[::-1]).repartition(5)):
        got = sw.rank(sw.weigh(df, np.array(gain))).collect()
        assert got[0].asDict().keys() == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank")).keys()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_pieces_do_not_change_the_features(monkeypatch):
    text = ("Ab cd-ef " * 50 + "ü9 " * 20 + "w" * 40 + " ..... ").encode()
    whole = np.sort(np.concatenate(list(sw.feature_buckets(text))))
    assert whole.tolist() == sorted(map(bucket, features(text.decode())))
    for size in (1, 7, 64):
        monkeypatch.setattr(sw, "PIECE", size)
        assert np.sort(np.concatenate(list(sw.feature_buckets(text)))).tolist() == whole.tolist()


def test_planes_sum_exactly():
    rng = np.random.default_rng(3)
    gain = rng.integers(-20000, 20000, sw.BUCKETS)
    gain[:50] = 0
    counts = (rng.integers(0, 5, (9, sw.BUCKETS)) * (rng.random((9, sw.BUCKETS)) < 0.01)).astype(np.uint32)
    counts[3] = 0
    counts[4, 17] = 3_000_000_000
    assert sw.weighted_sums(counts, sw.gain_planes(gain)).tolist() == (counts.astype(np.int64) @ gain).tolist()


def test_resample_returns_whole_rows(spark, texts):
    df = frame(spark, texts)
    items = target(spark, [texts[0][1]])
    got = sw.resample(df, items)
    assert got.columns == df.columns
    n = sum(len(features(t)) >= 39 for _, t in texts)
    assert got.count() == 25 * n // 100
    assert got.exceptAll(df).count() == 0


def test_the_draw_leans_to_the_target(spark):
    rng = random.Random(5)
    near, far = [f"n{i}" for i in range(40)], [f"f{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(near if i % 4 == 0 else far) for _ in range(60))) for i in range(400)]
    drawn = sw.resample(frame(spark, rows), target(spark, [" ".join(rng.choice(near) for _ in range(500))])).collect()
    assert len(drawn) == 100 and sum(r.doc_id % 4 == 0 for r in drawn) >= 50      # 25 without weights


def test_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a b c " * 20), (2, None)])
    items = target(spark, [])
    assert sw.rank(sw.weigh(none, sw.gains(none, items))).collect() == []
    assert sw.resample(none, items).collect() == []
    assert sorted(map(tuple, sw.rank(sw.weigh(some, sw.gains(some, items))).collect()), key=key) == \
        sorted(brute([(1, "a b c " * 20), (2, None)], [])[1], key=key)
    assert sw.bucket_counts(none).filter(F.col("n") > 0).count() == 0
