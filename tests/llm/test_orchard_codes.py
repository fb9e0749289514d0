"""Orchard search and vector codes against all distances, with bad vectors, ties, repeated and few rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import orchard_codes as oc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, entry long, _id long, _v int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, b, "clash", 1, 2, 3) for i, v, b in rows], SCHEMA)


def brute(rows, parts=4, entries=256, rounds=4):
    """code, error per kept row and the digest, with Python integers only."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and abs(x) < INF for x in r[1])]
    sizes = [len(v) for _, v, _ in rows]
    dim = max(sizes, key=lambda n: (sizes.count(n), n), default=0)
    rows = sorted((r for r in rows if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, list(map(np.float32, r[1]))))
    w = dim // parts
    x = [[int(np.floor(1024 * float(np.float32(c)))) for c in v] for _, v, _ in rows]
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for v in x]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def near(q, book):
        return min((sum((a - b) ** 2 for a, b in zip(q, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for v in cut:
                got.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(got[i]) for c in zip(*got[i])] if i in got else e for i, e in enumerate(books[p])]
    out = []
    for (i, _, label), v in zip(rows, cut):
        best = [near(v[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{b:02x}" for _, b in best), sum(d for d, _ in best)))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, code, err, sum(e for _, k, _, e in out if k == label)) for i, label, code, err in out], digest


def run(df):
    codes, books = oc.compress(df)
    got = oc.with_label_error(codes)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"]
    return [(r.vec_id, r.code, r.error, r.label_error) for r in got.collect()], books.sha256()


def key(r):
    return tuple((x is None, x) for x in r)


def vectors(rng, n, dim, spread=0.3):
    return [(i, [rng.gauss(0, spread) for _ in range(dim)], rng.choice([0, 0, 0, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("kind", ["spread", "few values", "int64"])
def test_search_finds_the_nearest_with_ties_to_the_lower_index(kind):
    rng = np.random.default_rng(7)
    for n in (1, 2, 15, 16, 17, 100, 256):
        scale = {"spread": 500, "few values": 2, "int64": 2 ** 26}[kind]
        book = rng.integers(-scale, scale + 1, (n, 4)).astype(np.float64)
        q = np.concatenate((rng.integers(-scale, scale + 1, (700, 4)), book)).astype(np.float64)
        d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)) for e in book] for v in q[:150]]
        at, best = oc.nearest(q, book)
        assert at[:150].tolist() == [r.index(min(r)) for r in d]
        assert best[:150].tolist() == [min(r) for r in d]
        assert (best[-n:] == 0).all()


def test_clustered_search_measures_few_entries():
    rng = np.random.default_rng(1)
    book = np.round(rng.normal(0, 4000, (256, 16)))
    q = book[rng.integers(0, 256, 2000)] + np.round(rng.normal(0, 100, (2000, 16)))
    near, _, measured = oc.Lists(book).search(q)
    assert measured < 2000 * 140 and (near == oc.nearest(q, book)[0]).all()


def test_codes_are_the_brute_force_ones(spark):
    rng = random.Random(12)
    rows = vectors(rng, 330, 8)
    same = rows[5][1]
    rows += [(1000 + i, same, 1) for i in range(120)]                          # a group of copies
    rows += [(7, rows[7][1], 1), (7, rows[8][1], 2), (None, same, None), (None, rows[9][1], 0)]
    rows += [(-5, None, 1), (-4, [NAN] * 8, 1), (-3, [0.1] * 7 + [None], 1), (-2, [0.1] * 7 + [INF], 1), (-1, [-INF] * 8, 1),
             (-9, [], 1), (-8, [0.5] * 4, 1)]
    want, digest = brute(rows)
    for df in (frame(spark, rows), frame(spark, rows[::-1]).repartition(5)):
        got, sha = run(df)
        assert sha == digest
        assert sorted(got, key=key) == sorted(want, key=key)


def test_few_rows_and_equal_vectors(spark):
    rows = [(i, [0.25, -0.25, 1.0, 0.0], i % 2) for i in range(5)] + [(9, [0.5, -0.3, 1.0, 300.0], None)]
    got, sha = run(frame(spark, rows))
    want, digest = brute(rows)
    assert (sorted(got, key=key), sha) == (sorted(want, key=key), digest)


def test_large_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-1, 1)) * 2.0 ** rng.randrange(-10, 17) for _ in range(4)], 1) for i in range(40)]
    got, sha = run(frame(spark, rows))
    assert (sorted(got), sha) == (sorted(brute(rows)[0]), brute(rows)[1])
    with pytest.raises(ValueError, match="64 bits"):
        oc.nearest(np.array([[2.0 ** 31]]), np.array([[-2.0 ** 31]]))


def test_empty_tables_and_lengths(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert run(frame(spark, [])) == ([], empty)
    assert run(frame(spark, [(1, None, 1), (2, [NAN], 1)])) == ([], empty)
    assert run(frame(spark, [(1, [], 1), (2, [], None)])) == ([(1, "00000000", 0, 0), (2, "00000000", 0, 0)], empty)
    with pytest.raises(ValueError, match="4 equal parts"):
        oc.compress(frame(spark, [(1, [0.5] * 6, 1)]))


def test_decoding_gives_vectors_at_the_reported_distance(spark):
    rows = vectors(random.Random(2), 300, 8)
    codes, books = oc.compress(frame(spark, rows))
    got = codes.collect()
    back = books.decode([r.code for r in got])
    x = {i: oc.to_integers(np.array(v, np.float32)) for i, v, _ in rows}
    assert [int(((x[r.vec_id] - b) ** 2).sum()) for r, b in zip(got, back)] == [r.error for r in got]


def test_usable_vectors(spark):
    df = frame(spark, [(1, [1.0, 2.0], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [1.0, NAN], 1), (5, [INF, 1.0], 1), (6, [], 1)])
    assert sorted(r.vec_id for r in df.filter(oc.usable(F.col("embedding"))).collect()) == [1, 6]
