"""Benchmark decontamination by q-gram lemma filtering.

Segments are the parts of ``SEGMENT`` characters of a benchmark item, at every ``stride``-th place of
it and at its end. With ``stride`` 1, the default, every part is one; a larger
one is faster and misses copied regions that hold no whole segment. A document region within ``k`` edits of a segment of ``m`` characters shares at least
``m - q + 1 - k*q`` character q-grams with it, all on diagonals (document place minus item place)
that differ by at most ``k``. Every q-gram of an item is indexed once. Shared ones are collected per
item in overlapping diagonal bands, and each segment that holds enough of a band's is verified by a
banded alignment; the regions that pass are reported.

Both sides are compared with A-Z lower-cased and runs of ASCII white space as one space; places
are reported in code points of the original text. Benchmark items go to the tasks in blocks of a
bounded number of characters, all documents against each block.

Defined results: null or empty texts match nothing; items of under ``Q`` normalised characters
match nothing (no q-gram); shorter items than a segment are one segment. Repeated items are all
reported, repeated rows each on their own. Null ids stay null. Texts are read whole, in pieces that
overlap by more than a segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.frames import released, slices, texts_in_slices
from caseflow.llm.textops import codepoints

Q = 12                 # q-gram length
SEGMENT = 64           # characters of a segment
EDIT_RATE = 0.05       # k = 3 edits a segment
BLOCK_CHARS = 4 << 20  # benchmark characters per block
PIECE = 1 << 18        # characters of document text handled at once
STRIDE = 1             # of callers that name none: a segment at every place of an item
GAP = 2 * SEGMENT      # places between texts that are handled together
ALIGNED = 1 << 13      # segments that are aligned at once
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BITS = 20


def normalise(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points and the original place of each."""
    ascii_ = cp < 256
    space = np.zeros(cp.size, bool)
    space[ascii_] = _SPACE[cp[ascii_]]
    out = np.where(space, np.uint32(32), cp)
    upper = (out >= 65) & (out <= 90)
    out = np.where(upper, out | np.uint32(32), out)
    keep = ~space
    if cp.size:
        keep[0] = True
        keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    return out[at], at


def qgrams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of every q-gram, by doubling."""
    if c.size < q:
        return np.empty(0, np.uint64)
    out, have, m = None, 0, 0x9E3779B97F4A7C15
    power, size = c.astype(np.uint64), 1
    left = q
    while left:
        if left & size:
            if out is None:
                out, have = power, size
            else:
                n = min(out.size, power.size - have)
                out, have = out[:n] * np.uint64(m) + power[have:have + n], have + size
            left -= size
        if left:
            n = power.size - size
            power = power[:n] * np.uint64(m) + power[size:size + n]
            size *= 2
            m = (m * m + 2) & 0xFFFFFFFFFFFFFFFF | 1
    return out[:c.size - q + 1] * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Index:
    """Items of one block and their q-grams."""
    chars: np.ndarray              # the items' texts side by side, ...
    begin: np.ndarray              # ... their first places
    size: np.ndarray               # their lengths
    length: np.ndarray             # of an item's segments
    edits: np.ndarray              # that a segment's region may have
    need: np.ndarray               # q-grams that it must share
    keys: np.ndarray               # sorted q-gram hashes, with ...
    item: np.ndarray               # ... their item and place
    place: np.ndarray
    probe: np.ndarray              # bit table over the hashes' top bits


def index(texts: list[str]) -> Index:
    chars, keys, item, place = [], [], [], []
    for i, t in enumerate(texts):
        c, _ = normalise(codepoints(t or ""))
        g = qgrams(c)
        chars.append(c)
        keys.append(g)
        item.append(np.full(g.size, i))
        place.append(np.arange(g.size))
    cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    size = np.array([c.size for c in chars], np.int64)
    length = np.minimum(size, SEGMENT)
    edits = np.minimum((EDIT_RATE * length).astype(np.int64), np.maximum(length - Q, 0) // Q)
    keys, item, place = cat(keys, np.uint64), cat(item, np.int64), cat(place, np.int64)
    o = np.argsort(keys, kind="stable")
    probe = np.zeros(1 << _BITS, bool)
    probe[keys >> np.uint64(64 - _BITS)] = True
    return Index(cat(chars, np.uint32), np.cumsum(size) - size, size, length, edits, length - Q + 1 - edits * Q,
                 keys[o], item[o], place[o], probe)


def align(patterns: np.ndarray, regions: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern (rows) against any part of its region (rows), on diagonals 0..band, and
    the place where that part ends. Cells a diagonal apart are one array place apart."""
    n, m = patterns.shape
    width = band + 1
    cost = np.zeros((n, width), np.int32)               # free start on every diagonal of the band
    step = np.arange(width, dtype=np.int32)
    for i in range(m):
        stay = cost + (regions[:, i:i + width] != patterns[:, i:i + 1])
        skip = np.full_like(cost, 1 << 20)
        skip[:, :-1] = cost[:, 1:] + 1                  # a pattern character without partner
        cost = np.minimum(stay, skip)
        cost = np.minimum.accumulate(cost - step, axis=1) + step    # text characters without partner
    best = cost.argmin(1)
    return cost[np.arange(n), best], best + m


def matches(ix: Index, c: np.ndarray, stride: int = STRIDE) -> list[tuple[int, int, int, int, int]]:
    """(item, segment's place in it, from, to, edits) of the verified regions in normalised text ``c``."""
    g = qgrams(c)
    hit = np.flatnonzero(ix.probe[g >> np.uint64(64 - _BITS)]) if g.size and ix.keys.size else np.empty(0, np.int64)
    if not hit.size:
        return []
    lo, hi = np.searchsorted(ix.keys, g[hit], "left"), np.searchsorted(ix.keys, g[hit], "right")
    n = hi - lo
    hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
    if not hit.size:
        return []
    entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(hit, n)
    item, place = ix.item[entry], ix.place[entry]
    longest = int(ix.size.max())
    diagonal = at - place + longest                     # never negative
    width = 16
    # a band holds `width` diagonals and starts every width - k: k + 1 neighbouring ones share a band
    k = ix.edits[item]
    pace = width - k
    band = diagonal // pace
    lower = (diagonal - band * pace < k) & (band > 0)
    item, band, place = (np.concatenate((item, item[lower])), np.concatenate((band, band[lower] - 1)),
                         np.concatenate((place, place[lower])))
    span = int(band.max()) + 1
    key = item * span + band
    # the same q-gram of the item counts once a band
    o = np.lexsort((place, key))
    key, place = key[o], place[o]
    first = np.ones(key.size, bool)
    first[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
    key, place = key[first], place[first]
    # places of a band that are followed by enough others within a segment's q-grams
    i = key // span
    reach = ix.length[i] - Q
    last = np.arange(key.size) + ix.need[i] - 1
    inside = np.minimum(last, key.size - 1)
    ok = (last < key.size) & (key[inside] == key) & (place[inside] - place <= reach)
    i, key, place, end, reach = i[ok], key[ok], place[ok], place[inside[ok]], reach[ok]
    if not i.size:
        return []
    # the segments that hold such a run, each once: ranges of their places, ascending within a band
    lo, hi = np.maximum(end - reach, 0), np.minimum(place, ix.size[i] - ix.length[i])
    same = key[1:] == key[:-1]
    lo[1:] = np.where(same, np.maximum(lo[1:], hi[:-1] + 1), lo[1:])
    n = np.maximum(hi - lo + 1, 0)
    s = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, band = np.repeat(i, n), np.repeat(key % span, n)
    grid = (s % stride == 0) | (s == ix.size[i] - ix.length[i])
    s, i, band = s[grid], i[grid], band[grid]
    pad = SEGMENT + 2 * width
    padded = np.concatenate((np.full(pad, 0xFFFFFFFF, np.uint32), c, np.full(2 * SEGMENT + 4 * width, 0xFFFFFFFF, np.uint32)))
    out = []
    for m in np.unique(ix.length[i]):
        of = np.flatnonzero(ix.length[i] == m)
        for a in range(0, of.size, ALIGNED):
            part = of[a:a + ALIGNED]
            own, k = i[part], int(ix.edits[i[part[0]]])
            # the band's diagonals, and k more on either side
            begin = band[part] * (width - k) - longest + s[part] - k
            across = width + 2 * k
            rows = padded[(begin + pad)[:, None] + np.arange(m + across)[None, :]]
            patterns = ix.chars[(ix.begin[own] + s[part])[:, None] + np.arange(m)[None, :]]
            edits, to = align(patterns, rows, across - 1)
            good = np.flatnonzero(edits <= k)
            to = begin[good] + to[good]
            out += zip(own[good].tolist(), s[part][good].tolist(), np.maximum(0, to - m).tolist(),
                       np.minimum(to, c.size).tolist(), edits[good].tolist())
    return out


def scan(ix: Index, texts: list[str | None], stride: int = STRIDE) -> list[tuple[int, int, int, int, int, int]]:
    """(text number, item, start, end, segments, least edits) of every matched region, in code points
    of the text. Matches of an item less than a segment apart are one region."""
    found: dict[tuple[int, int], list] = {}
    for i, j in slices([len(t or "") + GAP for t in texts], PIECE):
        # texts side by side, kept apart by more places than a band reaches
        begin = np.cumsum([0] + [len(t or "") + GAP for t in texts[i:j - 1]])
        c, at = normalise(codepoints(("\uffff" * GAP).join(t or "" for t in texts[i:j])))
        for a in range(0, max(1, c.size), PIECE):
            part = c[a:a + PIECE + 2 * SEGMENT]
            for item, s, f, t, e in matches(ix, part, stride):
                f, t = int(at[a + f]), int(at[a + t - 1]) + 1
                k = int(np.searchsorted(begin, f + SEGMENT // 2, "right")) - 1
                found.setdefault((i + k, item), []).append((f - int(begin[k]), t - int(begin[k]), s, e))
    out = []
    for (k, item), hits in sorted(found.items()):
        hits.sort()
        size = len(texts[k])
        at = 0
        while at < len(hits):
            f, t, s, e = hits[at]
            seen = {s}
            while at + 1 < len(hits) and hits[at + 1][0] <= t + SEGMENT:
                at += 1
                t, e = max(t, hits[at][1]), min(e, hits[at][3])
                seen.add(hits[at][2])
            at += 1
            out.append((k, item, max(0, f), min(t, size), len(seen), e))
    return out


def blocks(bench: DataFrame, block_chars: int = BLOCK_CHARS) -> list[list[tuple[list[int], str]]]:
    """Distinct item texts with their ids, in blocks of about ``block_chars`` characters. Each block is
    fetched by itself; its size is bounded by the parameter (and by one item's length)."""
    items = bench.filter(F.length("text") > 0).groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    return ([sorted((list(r["ids"]), r["text"]) for r in items.filter(part == i).collect()) for i in range(n)]
            if total else [])


class _Lazy:
    """A block's index, built where it is used."""

    def __init__(self, texts: list[str]):
        self.texts, self.built = texts, None

    def get(self) -> Index:
        if self.built is None:
            self.built = index(self.texts)
        return self.built

    def __reduce__(self):
        return _Lazy, (self.texts,)


def search(docs: DataFrame, bench: DataFrame, block_chars: int = BLOCK_CHARS, stride: int = STRIDE) -> DataFrame:
    """doc_id, item_id, start_at, end_at, n_segments, edits: a row for every region that a document
    shares with a benchmark item; documents without one have no row."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start_at long, end_at long, n_segments long, edits long"
    out = None
    for block in blocks(bench, block_chars):
        ids, shared = [b[0] for b in block], spark.sparkContext.broadcast(_Lazy([b[1] for b in block]))

        def run(batches, ids=ids, shared=shared):
            ix = shared.value.get()
            for batch in batches:
                rows = []
                for i, j, texts in texts_in_slices(batch, "text", 1 << 22):
                    doc = batch.column(0).slice(i, j - i).to_pylist()
                    for at, item, f, e, n, k in scan(ix, texts, stride):
                        rows += [(doc[at], one, f, e, n, k) for one in ids[item]]
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols],
                                                 names=[x.split()[0] for x in schema.split(", ")])

        got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), schema)
        out = got if out is None else out.unionAll(got)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, bench: DataFrame, block_chars: int = BLOCK_CHARS, stride: int = STRIDE) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that share no region with any item."""
    for block in blocks(bench, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(_Lazy([b[1] for b in block]))
        at = docs.columns.index("text")

        def run(batches, shared=shared, at=at):
            ix = shared.value.get()
            for batch in batches:
                one = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
                for i, j, texts in texts_in_slices(one, "text", 1 << 22):
                    clean = np.ones(j - i, bool)
                    clean[[x[0] for x in scan(ix, texts, stride)]] = False
                    yield batch.slice(i, j - i).filter(pa.array(clean))

        docs = docs.mapInArrow(released(run), docs.schema)
    return docs
