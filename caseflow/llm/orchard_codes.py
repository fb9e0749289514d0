"""Vector code compression: product codes whose nearest entries are found by Orchard search.

Components become integers (``floor(1024 * x)``) and vectors are cut into ``PARTS`` equal parts. Each part
position has a codebook of at most ``ENTRIES`` entries, started from the vectors of the least ids and
refined by ``ROUNDS`` of assignment and floored means. Sums per (part, entry) are formed in every task
and then added by Spark; only the codebooks, whose size is fixed, reach the driver and the tasks.

Orchard search: every entry holds the list of all entries by their distance from it. A query starts at the
nearest of a few spread entries and walks the current entry's list; entries it has seen are marked and not
measured again. A nearer entry (or an equal one of a lower index) becomes the current one and its list is walked
from the start. An entry farther from the current one than twice the query's distance can't be nearer, so the walk
ends there; at exactly twice it can tie and is still measured. Lists are walked in steps of ``STEP`` entries
for all queries of a chunk at once. All distances are exact integers.

Defined results: rows whose vector is null, or holds a null or non-finite component, are dropped, and so are
rows of another length than the most frequent one (the longer one on ties). A length that ``PARTS`` doesn't divide
raises, and so do components whose squared distances could exceed 64 bits. Rows with equal ids start codebooks in the order
of their vectors, null ids last; repeated rows are coded each on their own; fewer rows than ``ENTRIES`` start a
smaller codebook; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.frames import keep, released

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
STEP = 16                 # list entries measured at once
PIVOTS = 16               # spread entries measured first
CHUNK = 1024              # queries searched at once
SALTS = 32                # shares of a label's rows in the join with its total


def usable(v: Column) -> Column:
    """True where the vector and all its components are there and finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


def to_integers(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x.astype(np.float64))


def _exact(*arrays: np.ndarray) -> str:
    """A number type that holds squared distances between rows of the arrays (whole numbers) exactly."""
    most = max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)
    largest = max(arrays[0].shape[1], 1) * (2 * most) ** 2
    if largest >= 2.0 ** 60:
        raise ValueError(f"components of {most / SCALE:.3g}: four times a squared distance can exceed 64 bits")
    return "float64" if largest < 2.0 ** 50 else "int64"


class Lists:
    """A codebook with each entry's neighbours by distance (ties by index), cut into steps."""

    def __init__(self, book: np.ndarray):
        self.book = book
        n, width = book.shape
        size = (book * book).sum(axis=1)
        between = size[:, None] + size[None] - 2 * (book @ book.T)
        order = np.argsort(between, axis=1, kind="stable")
        far = np.take_along_axis(between, order, 1)
        self.steps = -(-n // STEP)
        pad = self.steps * STEP - n
        self.pivots = np.unique(np.linspace(0, n - 1, min(PIVOTS, n)).astype(np.int64))
        # entry n is a filler behind the end of every list; it is marked from the start
        order = np.pad(order, ((0, 0), (0, pad)), constant_values=n)
        self.first = np.pad(far, ((0, 0), (0, pad)), constant_values=np.inf if book.dtype.kind == "f" else np.iinfo(np.int64).max)[:, ::STEP]
        # in a step, by index: the first least distance is then that of the lowest index
        self.names = np.sort(order.reshape(n * self.steps, STEP), axis=1)
        filled = np.concatenate((book, np.zeros((1, width), book.dtype)))
        self.places = filled[self.names].reshape(n * self.steps, STEP * width)
        self.size = (filled * filled).sum(axis=1)[self.names]

    def search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest entry, squared distance) of every query, and how many distances were measured."""
        n, (m, width) = len(q), self.book.shape
        seen = np.zeros((n, m + 1), bool)
        seen[:, m] = True
        seen[:, self.pivots] = True
        own = (q * q).sum(axis=1)
        d = q[:, None, :] - self.book[self.pivots][None]
        d = (d * d).sum(axis=2)
        at = d.argmin(axis=1)                                   # pivots are in order of index
        best, near = d[np.arange(n), at], self.pivots[at]
        step = np.zeros(n, np.int64)
        measured = n * self.pivots.size
        huge = np.inf if best.dtype.kind == "f" else np.iinfo(np.int64).max
        live, marks, first = np.arange(n), seen.reshape(-1), self.first.reshape(-1)
        while True:
            live = live[step[live] < self.steps]
            part = near[live] * self.steps + step[live]
            on = first[part] <= 4 * best[live]
            live, part = live[on], part[on]
            if not live.size:
                return near, best, measured
            step[live] += 1
            names = self.names.take(part, axis=0)
            mark = names + (live * (m + 1))[:, None]
            old = marks.take(mark)
            some = ~old.all(axis=1)
            if not some.all():
                names, mark, old, part = names[some], mark[some], old[some], part[some]
            mine = live[some]
            measured += old.size - int(np.count_nonzero(old))
            marks[mark] = True
            # |e|^2 - 2 e.q, which differs from the squared distance by the query's |q|^2 only
            d = np.matmul(self.places.take(part, axis=0).reshape(-1, STEP, width), q[mine][:, :, None])[:, :, 0]
            d *= -2
            d += self.size.take(part, axis=0)
            d[old] = huge
            row = np.arange(mine.size)
            at = d.argmin(axis=1)
            least, name = d[row, at], names[row, at]
            seen_now = least < huge
            least = np.where(seen_now, least, 0) + own[mine]
            better = seen_now & ((least < best[mine]) | ((least == best[mine]) & (name < near[mine])))
            to = mine[better]
            best[to], near[to], step[to] = least[better], name[better], 0


@lru_cache(maxsize=PARTS)
def _lists(book: bytes, width: int, kind: str) -> Lists:
    """Built once per codebook in a worker, whose tasks follow each other."""
    return Lists(np.frombuffer(book, np.float64).reshape(-1, width).astype(kind))


def nearest(q: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each query's nearest entry, ties to the lower index."""
    if not q.shape[1]:
        return np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    kind = _exact(q, book)
    lists = _lists(book.tobytes(), book.shape[1], kind)
    near, d = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    for i in range(0, len(q), CHUNK):
        near[i:i + CHUNK], d[i:i + CHUNK], _ = lists.search(np.ascontiguousarray(q[i:i + CHUNK], kind))
    return near, d


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return to_integers(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dim)


class Codebooks:
    """One codebook (entries x width, whole numbers) per part position."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    @property
    def dim(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def sha256(self) -> str:
        """Of all components by part, entry and position, as decimal integers joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.ravel()).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, squared distances) of vectors x, both rows x parts."""
        width = self.books[0].shape[1]
        found = [nearest(x[:, p * width:(p + 1) * width], b) for p, b in enumerate(self.books)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def decode(self, codes: list[str]) -> np.ndarray:
        """The integer vectors that the codes stand for."""
        index = np.array([[int(c[2 * p:2 * p + 2], 16) for p in range(len(self.books))] for c in codes], np.int64)
        index = index.reshape(len(codes), len(self.books))
        return np.concatenate([b[index[:, p]] for p, b in enumerate(self.books)], 1).astype(np.int64)


def kept(rows: DataFrame, vector_col: str = "embedding", parts: int = PARTS) -> tuple[DataFrame, int]:
    """The rows that can be coded, and their vectors' length."""
    rows = rows.filter(usable(F.col(vector_col)))
    size = F.size(vector_col)
    most = (rows.groupBy(size.alias("_size")).agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.col("_n").desc(), F.col("_size").desc()).first())
    dim = most["_size"] if most else 0
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    return rows.filter(size == dim), dim


def fit(rows: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding",
        parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks from all ``rows`` (as ``kept`` returns them)."""
    width = dim // parts
    vectors = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))
    start = vectors.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).collect()
    x = to_integers(np.array([r["_v"] for r in start], np.float64).reshape(len(start), dim))
    books = Codebooks([x[:, p * width:(p + 1) * width] for p in range(parts)])
    for _ in range(rounds if start else 0):
        books = _means(vectors.select("_v"), books)
    return books


def _means(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floored mean of the parts assigned to it."""
    parts, dim = len(books.books), books.dim
    width, entries = dim // parts, len(books.books[0])

    @released
    def run(batches):
        sums = np.zeros((parts * entries, width), np.int64)
        n = np.zeros(parts * entries, np.int64)
        for x in _chunks(batches, dim):
            index, _ = books.assign(x)
            for p in range(parts):
                order = np.argsort(index[:, p], kind="stable")
                names, at, count = np.unique(index[order, p], return_index=True, return_counts=True)
                part = x[order, p * width:(p + 1) * width].astype(np.int64)
                if width:
                    sums[p * entries + names] += np.add.reduceat(part, at, axis=0)
                n[p * entries + names] += count
        used = np.flatnonzero(n)
        cols = {"entry": pa.array(used, pa.int64()), "n": pa.array(n[used])}
        cols |= {f"s{i}": pa.array(sums[used, i]) for i in range(width)}
        yield pa.RecordBatch.from_pydict(cols)

    names = [f"s{i}" for i in range(width)]
    part = vectors.mapInArrow(run, "entry long, n long" + "".join(f", {c} long" for c in names))
    total = part.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect()
    new = [b.copy() for b in books.books]
    for r in total:                                             # at most parts x entries rows
        new[r["entry"] // entries][r["entry"] % entries] = [r[c] // r["n"] for c in names]
    return Codebooks(new)


def _chunks(batches, dim: int, column: int = 0):
    """Integer vectors of several batches together, so that a chunk is worth its set-up."""
    held, size = [], 0
    for b in batches:
        held.append(_matrix(b.column(column), dim))
        size += len(held[-1])
        if size >= CHUNK:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def encode(rows: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding",
           label_col: str = "label") -> DataFrame:
    """id, label, code (two hex digits per part) and error (squared distance) of all ``rows``."""
    dim = books.dim

    @released
    def run(batches):
        for b in batches:
            index, d = books.assign(_matrix(b.column(2), dim))
            text = index.astype(np.uint8).tobytes().hex()
            k = 2 * index.shape[1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([text[i:i + k] for i in range(0, len(text), k)], pa.string()),
                 pa.array(d.sum(axis=1, dtype=np.int64))], names=["_id", "_label", "code", "error"])

    inner = rows.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_v"))
    schema = inner.drop("_v").schema.add("code", "string").add("error", "long")
    return inner.mapInArrow(run, schema).toDF(id_col, label_col, "code", "error")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error of every usable row, written once; the codebooks)."""
    rows, dim = kept(vectors, vector_col, parts)
    books = fit(rows, dim, id_col, vector_col, parts, entries, rounds)
    return keep(encode(rows, books, id_col, vector_col, label_col), "vector-codes"), books


def with_label_error(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """Add ``label_error``, the error summed over rows of an equal label (nulls together)."""
    totals = (codes.groupBy(F.col(label_col).alias("_of")).agg(F.sum("error").alias("label_error"))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = codes.withColumn("_at", F.pmod(F.xxhash64(*codes.columns), F.lit(SALTS)).cast("int"))
    return (salted.join(totals, F.col(label_col).eqNullSafe(F.col("_of")) & (F.col("_at") == F.col("_salt")))
            .drop("_of", "_at", "_salt"))


def oracle() -> str:
    """The contract of the query in DuckDB: every distance of every round."""
    width = f"(SELECT max(len(embedding)) // {PARTS} FROM kept)"
    sql = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, embedding, label FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT rid, (i - 1) // {width} AS part, (i - 1) % {width} AS place, CAST(floor({SCALE} * embedding[i]::DOUBLE) AS BIGINT) AS v
  FROM (SELECT rid, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
b0 AS (SELECT part, rid - 1 AS entry, place, v FROM x WHERE rid <= {ENTRIES})"""
    for r in range(ROUNDS + 1):
        sql += f""",
a{r} AS MATERIALIZED (SELECT rid, part, min(d * {ENTRIES} + entry) AS m FROM (
  SELECT rid, part, entry, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d FROM x JOIN b{r} b USING (part, place) GROUP BY rid, part, entry)
  GROUP BY rid, part)"""
        if r < ROUNDS:
            sql += f""",
s{r} AS (SELECT part, a.m % {ENTRIES} AS entry, place, sum(v)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} a USING (rid, part) GROUP BY 1, 2, 3),
b{r + 1} AS MATERIALIZED (SELECT part, entry, place, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v
  FROM b{r} LEFT JOIN s{r} USING (part, entry, place))"""
    return sql + f""",
codes AS (SELECT rid, string_agg(lower(printf('%02x', m % {ENTRIES})), '' ORDER BY part) AS code, sum(m // {ENTRIES})::BIGINT AS error
  FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(coalesce(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place), '')) FROM b{ROUNDS}) AS codebooks_sha256
FROM codes JOIN kept USING (rid)"""
