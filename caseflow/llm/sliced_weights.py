"""Importance resampling towards a target distribution, by bit-sliced aggregation.

Features are runs of one and two words, hashed into ``BUCKETS`` buckets. A bucket's gain is the
(scaled, floored) log ratio of its smoothed share in the target texts and in the corpus. A document's
weight is the floored mean gain of its features. With Gumbel noise keyed by the id added, the highest
scores are a draw without replacement in proportion to the weights.

The sums are exact and bit-sliced: bit j of a document's bucket counts is a plane of ``BUCKETS`` bits, bit i of
the gains' magnitudes is two planes (positive and negative gains), and

    sum of count * gain = sum over j, i of 2^(i+j) * (popcount(C_j & G+_i) - popcount(C_j & G-_i)).

Corpus counts are summed per task and then per bucket over all documents; only the ``BUCKETS`` gains reach the
driver. Ranks come from a range-partitioned sort with the positions of its blocks, not from one window.

Defined results: null and empty texts have no features, weight 0 and no rank, and take part in no count;
a null id is the empty string in the noise's key and the last in ties; repeated rows count and
rank each on their own; an empty table gives an empty result, an empty target or corpus gives the
smoothed gains. Texts are read whole, in pieces cut between words. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.frames import keep, released, texts_in_slices
from caseflow.operators.ordered import with_position

BUCKETS = 10000
SCALE = 1000
SALT = 7
MIN_WORDS = 20
PERCENT = 25
PIECE = 1 << 20            # bytes of text handled at once
GROUP = 64                 # documents whose planes are formed together
_WORDS64 = -(-BUCKETS // 64)
# one byte to one: A-Z lower-cased, all ASCII but letters and digits to a space (the only separator left)
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def feature_buckets(text: bytes):
    """Bucket numbers of the text's features, as arrays of bounded size."""
    last, at = None, 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):                                   # go on to the next separator
            while end < len(text) and _FOLD[text[end]] != 32:
                end += 1
        words = text[at:end].translate(_FOLD).split()
        at = end
        if words:
            single = list(map(zlib.crc32, words))
            left, right = ([last, *single], words) if last is not None else (single, words[1:])
            pairs = [zlib.crc32(b" " + w, c) for c, w in zip(left, right)]       # crc32 of left + b" " + w
            last = single[-1]
            yield np.array(single + pairs, np.uint32) % np.uint32(BUCKETS)


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """bucket, n: how often each bucket's features occur in all texts."""
    @released
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, part in texts_in_slices(batch, "text", PIECE, binary=True):
                for t in part:
                    for b in feature_buckets(t or b""):
                        total += np.bincount(b, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    part = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text") -> np.ndarray:
    """The gain of every bucket (``BUCKETS`` long integers)."""
    s = bucket_counts(docs, text_col).withColumnRenamed("n", "s")
    t = bucket_counts(target, text_col).withColumnRenamed("n", "t")
    both = s.join(t, "bucket", "full").na.fill(0, ["s", "t"]).toPandas()      # at most BUCKETS rows
    n = np.zeros((2, BUCKETS))
    n[:, both["bucket"].to_numpy()] = both["s"], both["t"]
    (s, t), (all_s, all_t) = n, n.sum(axis=1)
    return np.floor(SCALE * np.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))).astype(np.int64)


def _planes(bits: np.ndarray) -> np.ndarray:
    """Rows of ``BUCKETS`` zeros and ones as rows of 64-bit words."""
    out = np.zeros((len(bits), _WORDS64 * 8), np.uint8)
    out[:, :-(-BUCKETS // 8)] = np.packbits(bits, axis=1)
    return out.view(np.uint64)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane) of every plane that has a bit set."""
    out = []
    for sign in (1, -1):
        size = np.maximum(sign * gain, 0)
        for i in range(int(size.max(initial=0)).bit_length()):
            bits = (size >> i & 1).astype(np.uint8)
            if bits.any():
                out.append((sign << i, _planes(bits[None])[0]))
    return out


def weighted_sums(counts: np.ndarray, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum over buckets of count * gain, for each row of counts (rows x BUCKETS, unsigned)."""
    out = np.zeros(len(counts), np.int64)
    most = counts.max(axis=1, initial=0)
    for j in range(int(most.max(initial=0)).bit_length()):
        rows = np.flatnonzero(most >> np.uint32(j))
        c = _planes((counts[rows] >> np.uint32(j) & np.uint32(1)).astype(np.uint8))
        for power, g in planes:
            out[rows] += (power << j) * np.bitwise_count(c & g).sum(axis=1, dtype=np.int64)
    return out


def noise(key: Column, salt: int = SALT) -> Column:
    """Scaled, floored Gumbel noise of a key: the same in every run."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          carry: tuple[str, ...] = ()) -> DataFrame:
    """id, n_features, weight, score of every row (and the columns named in ``carry``)."""
    planes = gain_planes(gain)

    @released
    def run(batches):
        for batch in batches:
            n, total = [], []
            for _, _, part in texts_in_slices(batch, "_text", PIECE, binary=True):
                for i in range(0, len(part), GROUP):
                    group = part[i:i + GROUP]
                    counts = np.zeros((len(group), BUCKETS), np.uint32)
                    for k, t in enumerate(group):
                        for b in feature_buckets(t or b""):
                            counts[k] += np.bincount(b, minlength=BUCKETS).astype(np.uint32)
                    size = counts.sum(axis=1, dtype=np.int64)
                    n.append(size)
                    total.append(weighted_sums(counts, planes) // np.maximum(size, 1))     # floors down
            empty = [np.zeros(0, np.int64)]
            cols = {c: batch.column(c) for c in names}
            cols["n_features"] = pa.array(np.concatenate(n or empty))
            cols["weight"] = pa.array(np.concatenate(total or empty))
            yield pa.RecordBatch.from_pydict(cols)

    # other names inside, so that columns of the table can't clash
    names = ["_id", *[f"_c{i}" for i in range(len(carry))]]
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
                       F.col(text_col).cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("n_features", "long").add("weight", "long")
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
                      "n_features", "weight", (F.col("weight") + noise(F.col("_id"))).alias("score"))


def rank(weighed: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Add ``rank``: 1, 2, 3... by score (ties to the smaller id) of the ``percent`` drawn rows, else null."""
    rows = keep(weighed.withColumn("_row", F.monotonically_increasing_id()), "weights")
    long_enough = F.col("n_features") >= F.lit(2 * min_words - 1)        # w words have 2w - 1 features
    drawn = percent * rows.filter(long_enough).count() // 100
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("n_features"), F.col("_row")]
    ranked = with_position(rows.filter(long_enough), order, "_at", "weights-ordered")
    ranked = ranked.select(*weighed.columns, F.when(F.col("_at") < drawn, F.col("_at") + 1).cast("long").alias("rank"))
    rest = rows.filter(~long_enough).select(*weighed.columns, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The drawn rows of ``docs``, all their columns as they are."""
    names = [f"_d{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    of = dict(zip(docs.columns, names))
    w = weigh(inner, gains(docs, target, text_col), of[id_col], of[text_col], tuple(n for n in names if n != of[id_col]))
    return (rank(w, of[id_col], percent, min_words).filter(F.col("rank").isNotNull())
            .select(*names).toDF(*docs.columns))


def oracle() -> str:
    """The contract of the query in DuckDB, with crc32 as a byte-wise reduction."""
    return f"""
WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS crc
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
texts AS (SELECT 0 AS side, row_number() OVER () AS rid, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT side, rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
feats AS (SELECT side, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM feats)),
buckets AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(h), 2),
      lambda i: CAST(16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT))),
    lambda c, x: xor(c // 256, crc[xor(c % 256, x) + 1])), 4294967295) % {BUCKETS} AS b FROM hexed, tab),
counts AS (SELECT side, b, count(*) AS n FROM feats JOIN buckets USING (f) GROUP BY side, b),
totals AS (SELECT coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM counts),
gain AS (SELECT b, CAST(floor({SCALE} * ln((coalesce(sum(n) FILTER (side = 1), 0) + 1)::DOUBLE * (any_value(totals.s) + {BUCKETS})::DOUBLE
    / ((coalesce(sum(n) FILTER (side = 0), 0) + 1)::DOUBLE * (any_value(totals.t) + {BUCKETS})::DOUBLE))) AS BIGINT) AS g
  FROM counts, totals GROUP BY b),
sums AS (SELECT rid, count(*) AS n, sum(g) AS total FROM feats JOIN buckets USING (f) JOIN gain USING (b) WHERE side = 0 GROUP BY rid),
weighed AS (SELECT rid, doc_id, coalesce(n, 0) AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
    CAST('0x' || sha256('{SALT}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT)::DOUBLE AS h
  FROM texts LEFT JOIN sums USING (rid) WHERE side = 0),
scored AS (SELECT rid, doc_id, n_features, weight,
    weight + floor(-{SCALE}.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS score,
    n_features >= {2 * MIN_WORDS - 1} AS fits FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k,
    count(*) OVER (PARTITION BY fits) AS all_k FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN fits AND k <= {PERCENT} * all_k // 100 THEN k END AS rank FROM placed"""
