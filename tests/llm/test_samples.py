"""Learning samples: every label, every id, the same rows in every run; a threshold over all labelled rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import langid, pair_quality

WORDS = [a + b for a in "ba de ki lo mu na pe ri so tu".split() for b in "ra te mi no pu".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_every_label_is_sampled(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 12), f"l{i % 300}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.labelled_sample(df, "lang", F.lit(True), 500, 40)
    assert len({label for _, label in got}) == 300 and len(got) == 1500
    some = langid.labelled_sample(df, "lang", F.lit(True), 2, 40)
    assert 300 < len(some) < 900


def test_one_id_may_hold_a_third_of_the_rows(spark):
    rng = random.Random(2)
    for hot in range(6):
        rows = [(hot if i % 3 == 0 else 1000 + i, prose(rng, 30), "ab"[i % 2]) for i in range(3000)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = langid.labelled_sample(df, "lang", F.lit(True), 300, 10_000)
        mine = {t for i, t, _ in rows if i == hot}
        share = sum(t in mine for t, _ in got) / len(got)
        assert 450 < len(got) < 750 and 0.2 < share < 0.47
        again = langid.labelled_sample(df.repartition(7), "lang", F.lit(True), 300, 10_000)
        assert again == got


def test_copies_of_a_row_do_not_fill_the_sample(spark):
    rng = random.Random(3)
    same = prose(rng, 30)
    rows = [(7, same, "a") for _ in range(2000)] + [(i, prose(rng, 30), "ab"[i % 2]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.labelled_sample(df, "lang", F.lit(True), 200, 10_000)
    assert sum(t == same for t, _ in got) <= 1 and len({label for _, label in got}) == 2


def test_empty_and_unlabelled_tables(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, "x")], "doc_id long, text string, lang string")
    assert langid.labelled_sample(df, "lang", F.lit(True), 10, 10) == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert pair_quality.fit(df, labels, F.lit(False)) is None


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1200):
        good = i % 4 != 0
        t = prose(rng, 60) + "." if good else " ".join(rng.choice(["buy", "NOW", "$$$", "###", "win!!!"]) for _ in range(40))
        rows.append((5 if i % 3 == 0 else i + 10, t, int(good)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] != 5] + [(5, 1), (5, 0)], "doc_id long, quality int")
    return docs, labels


def test_the_threshold_is_the_quantile_of_all_labelled_rows(spark, rated):
    docs, labels = rated
    model = pair_quality.fit(docs, labels, F.col("doc_id") % 5 == 4, per_class=60)
    lab = {}
    for r in labels.collect():
        if r.doc_id % 5 != 4:
            lab[r.doc_id] = max(lab.get(r.doc_id, 0), r.quality)
    x = [(pair_quality.features(r.text.encode()), lab[r.doc_id]) for r in docs.collect() if r.doc_id in lab]
    u = np.sort(model.utility(np.array([f for f, _ in x])))
    bad = sum(y == 0 for _, y in x) / len(x)
    assert abs(np.searchsorted(u, model.cut, "right") / len(u) - bad) < 0.01
    again = pair_quality.fit(docs.repartition(7), labels.repartition(3), F.col("doc_id") % 5 == 4, per_class=60)
    assert again.cut == model.cut and (again.weight == model.weight).all() and again.slope == model.slope
