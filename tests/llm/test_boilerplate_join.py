"""N-gram Jaccard join on many texts that share one passage."""

import random

from pyspark.sql import functions as F

from caseflow.llm import ngram_join


def sets(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_members_that_cannot_link_never_meet(spark):
    """One list with 200,000 members: 46 of 54 shingles left are too few, so the list yields no pair."""
    lists = spark.range(200_000).select(F.lit(1).alias("key"), F.col("id").alias("node"), (54 + F.col("id") % 3).alias("n"),
                                        F.lit(46).cast("long").alias("left"), F.col("id").alias("label"), F.lit(0).cast("long").alias("main"),
                                        F.lit(False).alias("heavy"), F.lit(ngram_join.PAIR).alias("kind"))
    assert ngram_join.open_pairs(lists).isEmpty()
    # of single frequent tokens' lists only heavy members meet others
    light = lists.withColumns({"left": F.col("n"), "kind": F.lit(ngram_join.SINGLE), "heavy": F.col("node") == 7})
    got = ngram_join.open_pairs(light)
    assert got.count() == 199_999 and got.filter("a != 7 and b != 7").isEmpty()


def test_open_pairs_are_those_of_all_members(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        n = rng.randrange(4, 40)
        rows.append((rng.randrange(3), i, n, rng.randrange(max(1, n - n // 4), n + 1), rng.randrange(60), rng.randrange(2) == 0, rng.randrange(3)))
    main = 5
    df = spark.createDataFrame([(*r, main) for r in rows], "key int, node long, n long, left long, label long, heavy boolean, kind int, main long")
    got = {(r.a, r.b) for r in ngram_join.open_pairs(df).collect()}
    want = set()
    for kx, x, nx, rx, lx, hx, tx in rows:
        for ky, y, ny, ry, ly, hy, ty in rows:
            if (kx == ky and lx != main and lx != ly and 4 * min(nx, ny) >= 3 * max(nx, ny)
                    and 7 * min(rx, ry) >= 3 * (nx + ny) and (tx != ngram_join.SINGLE or hx or hy)):
                want.add((min(x, y), max(x, y)))
    assert got == want and want


def test_shared_passages_around_the_threshold_equal_brute_force(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [passage + " " + " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(7, 13))) for _ in range(240)]
    texts += [t + " x" for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    own, parent = [sets(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(own[i] & own[j])
            if 100 * both >= 75 * (len(own[i]) + len(own[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert 1 < len(set(got.values())) < len(texts)
