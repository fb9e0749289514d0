"""N-gram Jaccard join on token-combination prefixes.

Two documents link when the Jaccard similarity of their sets of word 5-grams is at least 3/4. Equal
sets form one class (a *node*); classes are joined exactly:

1. Tokens (hashed shingles) are ordered rare before frequent. A set of ``n`` tokens has the prefix
   ``n - ceil(3n/4) + 1`` tokens long; linked sets share a token of their prefixes, and ``K`` = 2
   tokens of the prefixes extended by ``K - 1``.
2. Rare prefix tokens are indexed alone. If linked sets share no rare prefix token, all tokens shared
   by their extended prefixes are frequent; so frequent tokens are indexed as combinations of two. A
   set with more than ``LIGHT`` of them indexes them alone, and meets every other set there.
   At the first token they share, linked sets have enough tokens left on both sides; pairs of a list
   that don't are left out there (they come up again at their first common token).
3. In every list of the index all members are first paired with one pivot (the one with the smallest
   share of rare tokens, so in a group of near copies about the original). Verified pairs make
   components; a list whose members are then in one component is done, in the others the members
   outside the largest component are paired with those of other components. A pair left out lies
   within a component already, so no link between components is lost, and a large group of near
   copies costs a pair a member, not all pairs. Size and tokens left of two members tell whether they
   may link, so a list is first reduced to its distinct (size, left), these are compared, and members
   meet only where theirs passed: many texts that share a passage just under the threshold never meet.
4. Pairs are verified by size, then by parity bitmaps (the bits that differ are at most the
   symmetric difference, so no link is lost), then by intersecting the whole sets.

Which tokens are frequent only decides the order, never the result: any fixed order is valid.

Defined results: A-Z is lower-cased; fewer than five words make one shingle; a null text or one
without words has no shingle, links with nothing and is its own component. Repeated rows are copies
of each other. Null ids are never a component's id unless it has no other. Shingles and sets are
identified by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.frames import keep, onto, released, texts_in_slices
from caseflow.llm.textops import mix, shingle_sets

SHINGLE = 5
K = 2
LIGHT = 32
BLOCK = 1 << 22           # tokens whose counts are taken together
LOCAL = 2                 # a token counts towards being frequent where a block has so many sets with it
FREQUENT = 16
MAX_FREQUENT = 200_000    # the most frequent tokens are put last; the bound only affects the order
SLOTS = 22                # bits of the table of frequent tokens (a byte a slot)
RARE, PAIR, SINGLE = 0, 1, 2
_C1, _C2 = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xAAAAAAAA55555555)


def node_of(s: np.ndarray) -> int:
    """The set's identity as a signed 64-bit number; 0 for the empty set."""
    if not s.size:
        return 0
    return int(mix(np.array([mix(s ^ _C2).sum(dtype=np.uint64) + np.uint64(s.size)], np.uint64)).view(np.int64)[0])


def parity(s: np.ndarray) -> bytes:
    """Bit i: whether an odd number of tokens falls on place i (about a place a token, a power of two)."""
    bits = 64
    while bits < s.size:
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, n: int) -> bool:
    """Whether two sets of together ``n`` tokens may link, by their parity bitmaps."""
    if len(a) < len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return 7 * (x ^ y).bit_count() <= n


def _sets(batch: pa.RecordBatch):
    """(row number, set) of every text of a batch."""
    for i, j, texts in texts_in_slices(batch, "text", 1 << 20, binary=True):
        yield from zip(range(i, j), shingle_sets(texts, SHINGLE))


def profile(docs: DataFrame) -> DataFrame:
    """kind 0: id (document), node, n, sig (parity bitmap, once per node and task at least), hash (of the
    text); kind 1: id (token), n (sets of a block that have it)."""
    names = ["kind", "id", "node", "n", "sig", "hash"]

    def table(kind, ids, nodes, n, sigs, hashes):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.int8()), pa.array(ids, pa.int64()),
                                           pa.array(nodes, pa.int64()), pa.array(n, pa.int64()),
                                           pa.array(sigs, pa.binary()), pa.array(hashes, pa.int64())], names=names)

    def frequent(parts):
        u = np.concatenate(parts)
        parts.clear()
        u.sort()
        u, c = np.unique(u[1:][u[1:] == u[:-1]], return_counts=True)      # the repeats only: few
        u, c = u[c + 1 >= LOCAL], c[c + 1 >= LOCAL] + 1
        return table(1, u.view(np.int64), [None] * u.size, c, [None] * u.size, [None] * u.size)

    def run(batches):
        seen: set[int] = set()
        parts, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            nodes, n, sigs = [], [], []
            for _, s in _sets(batch):
                node = node_of(s)
                nodes.append(node)
                n.append(s.size)
                new = node not in seen and s.size > 0
                sigs.append(parity(s) if new else None)
                if new:
                    seen.add(node)
                    parts.append(s)
                    size += s.size
                    if size >= BLOCK:
                        yield frequent(parts)
                        parts, size = [], 0
            yield table(0, ids, nodes, n, sigs, batch.column(2))
        if parts:
            yield frequent(parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash")).mapInArrow(
        released(run), "kind byte, id long, node long, n long, sig binary, hash long")


def frequency_classes(prof: DataFrame) -> np.ndarray:
    """Class of the tokens in each slot: 0 rare, else growing with the frequency."""
    top = (prof.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
           .orderBy(F.desc("n"), "id").limit(MAX_FREQUENT).toPandas())
    out = np.zeros(1 << SLOTS, np.uint8)
    if len(top):
        at = top["id"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - SLOTS)
        cls = np.minimum(250, 1 + 4 * np.log2(top["n"].to_numpy(float) / FREQUENT)).astype(np.uint8)
        np.maximum.at(out, at, cls)
    return out


def index_keys(s: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set is indexed, and for each key: set size (from bit 37), the key's place in
    the set's order (26 bits), share of rare tokens (8), whether the set is heavy, the key's kind (2)."""
    n = s.size
    if n < 2:                       # a single token links with equal sets only
        return s[:0], np.empty(0, np.int64)
    cls = classes[s >> np.uint64(64 - SLOTS)]
    rare, often = s[cls == 0], s[cls > 0]
    prefix = n - -(-3 * n // 4) + 1
    alone = rare[:prefix]
    keys, kinds, places, heavy = [alone], [np.full(alone.size, RARE)], [np.arange(alone.size)], False
    g = often[np.lexsort((often, cls[cls > 0]))][:max(0, prefix + K - 1 - rare.size)]
    if g.size:
        heavy = g.size > LIGHT
        keys.append(mix(g + _C1))
        kinds.append(np.full(g.size, SINGLE))
        places.append(rare.size + np.arange(g.size))
        if not heavy and g.size > 1:
            i, j = np.triu_indices(g.size, 1)
            keys.append(mix(mix(g[i] ^ _C1) + g[j] * _C1))
            kinds.append(np.full(i.size, PAIR))
            places.append(rare.size + i)
    return np.concatenate(keys), ((n << 37) + (np.concatenate(places) << 11) + (255 * rare.size // n << 3)
                                  + (int(heavy) << 2) + np.concatenate(kinds))


def postings(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """key, node, meta (see ``index_keys``): the index; rare keys of one node are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)      # a fixed size

    def run(batches):
        cls = shared.value
        seen: set[int] = set()
        for batch in batches:
            keys, nodes, meta = [], [], []
            for _, s in _sets(batch):
                node = node_of(s)
                if node in seen:
                    continue
                seen.add(node)
                k, m = index_keys(s, cls)
                keys.append(k)
                nodes.append(np.full(k.size, node, np.int64))
                meta.append(m)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)),
                     pa.array(np.concatenate(meta), pa.int64())], names=["key", "node", "meta"])

    def shared_keys(batches):
        """Rows come sorted by key and node: drop repeated rows and rare keys with one node."""
        held = None                                                # the last row, and whether its key is shared
        for batch in batches:
            k, n, m = (batch.column(c).to_numpy() for c in range(3))
            if held is not None:
                k, n, m = (np.concatenate(([h], x)) for h, x in zip(held[:3], (k, n, m)))
            if not k.size:
                continue
            first = np.ones(k.size, bool)
            first[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
            k, n, m = k[first], n[first], m[first]
            same = k[1:] == k[:-1]
            ok = np.zeros(k.size, bool)
            ok[1:] |= same
            ok[:-1] |= same
            if held is not None:
                ok[0] |= held[3]
            held = (k[-1], n[-1], m[-1], bool(ok[-1]))
            ok |= (m & 3) != RARE
            ok[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (k, n, m)], names=["key", "node", "meta"])
        if held is not None and (held[3] or held[2] & 3 != RARE):
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in held[:3]], names=["key", "node", "meta"])

    schema = "key long, node long, meta long"
    raw = docs.select("text").mapInArrow(released(run), schema)
    # rare keys meet in one partition; those of frequent tokens are spread, as they stay in any case
    place = F.when(F.col("meta").bitwiseAND(3) == RARE, F.col("key")).otherwise(F.xxhash64("key", "node"))
    return raw.repartition(place).sortWithinPartitions("key", "node").mapInArrow(released(shared_keys), schema)


def _fits() -> Column:
    """Whether sets of nx and ny tokens, of which rx and ry are left from the shared one on, may link: they
    need 3/7 of nx + ny in common."""
    return (4 * F.least("nx", "ny") >= 3 * F.greatest("nx", "ny")) & (7 * F.least("rx", "ry") >= 3 * (F.col("nx") + F.col("ny")))


def _as_pairs(df: DataFrame) -> DataFrame:
    """Distinct pairs a < b of columns x, y that may link by nx, ny, rx and ry."""
    return (df.filter((F.col("x") != F.col("y")) & _fits()).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def open_pairs(lists: DataFrame) -> DataFrame:
    """Pairs a < b that may link, of members of different components of a list, one of them outside its
    main component. ``lists`` has key, node, n, left, label, main, heavy, kind."""
    # sizes that may link, a factor of 4/3 apart at most, lie in neighbouring bands; one more against rounding
    band = F.floor(F.log(F.col("n")) / math.log(4 / 3))
    near = F.explode(F.sequence(band - 2, band + 2)).alias("band")
    alike = ["n", "left", "heavy", "kind"]
    groups = lists.groupBy("key", *alike).agg(F.max(F.col("label") != F.col("main")).alias("other"))
    one = lambda c: [F.col(x).alias(f"{x[0] if x != 'left' else 'r'}{c}") for x in alike]
    meet = (groups.filter("other").select("key", near, *one("x")).join(groups.select("key", band.alias("band"), *one("y")), ["key", "band"])
            .filter(_fits() & ((F.col("kx") != SINGLE) | F.col("hx") | F.col("hy"))).drop("band"))
    side = lambda df, c: df.select("key", F.col("node").alias(c), *one(c), F.col("label").alias(f"l{c}"))
    x = side(lists.filter("label != main"), "x").join(meet, ["key", "nx", "rx", "hx", "kx"])
    return _as_pairs(x.join(side(lists, "y"), ["key", "ny", "ry", "hy", "ky"]).filter("lx != ly"))


def _by_parity(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))

    def run(batches):
        for t in batches:
            d = t.to_pydict()
            ok = [may_link(x, y, i + j) for x, y, i, j in zip(d["sa"], d["sb"], d["na"], d["nb"])]
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(released(run), "a long, b long")


def _whole_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """node, set of (at least) the documents that ``reps`` names. A bit table over hashed ids, of a size
    bounded by 2 MB, keeps most other texts from being hashed; it never leaves out a wanted one."""
    bits = 24
    slot = lambda df: F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    rows = (reps.select(slot(reps).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect())
    table = np.zeros((1 << bits) // 8 + 4096, np.uint8)
    for r in rows:                                                  # buckets count from 1, 4096 bytes each
        at = (r["bucket"] - 1) * 4096
        at = max(at, 0)
        table[at:at + 4096] |= np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        bit = shared.value
        for batch in batches:
            # bucket b, position p of slot s: (b - 1) * 32768 + p = s - 1 for s > 0 (slot 0 has bucket 0, position 0)
            s = np.maximum(batch.column(0).to_numpy() - 1, 0)
            wanted = (bit[s >> 3] >> (s & 7)) & 1 == 1
            part = batch.filter(pa.array(wanted))
            if not part.num_rows:
                continue
            sets = [s for _, s in _sets(part)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (ids.select(slot(ids).alias("slot"), "text").mapInArrow(released(run), "node long, set binary")
            .groupBy("node").agg(F.first("set").alias("set")))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs a, b that link."""
    likely = keep(_by_parity(pairs, nodes), "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    reps = wanted.join(nodes.select("node", "rep"), "node").select(F.col("rep").alias("doc_id"))
    sets = keep(_whole_sets(docs, reps).join(wanted, "node", "left_semi"), "sets")

    def run(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = x.size + y.size
                common = both - np.unique(np.concatenate((x, y))).size
                ok.append(100 * common >= 75 * (both - common))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}"))
    return likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(released(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the component's least node) of every node with an edge: least labels spread along
    the edges and along the labels themselves until nothing changes. Every round is written and
    reread, so a round's plan never grows."""
    both = keep(edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")),
                                               F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e"))
                .select("e.*").distinct(), "edges")
    labels = keep(both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node")
                .agg(F.min("label").alias("near")))
        one = keep(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "near")
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = keep(onto(one, up, ["label"], "node").select("node", "old", F.least("label", "up").alias("label")), "labels")
        if labels.filter("label != old").isEmpty():
            return labels.select("node", "label")


def nodes_of(prof: DataFrame) -> DataFrame:
    """node, n, sig, rep (the least id) of every class with a shingle."""
    return (prof.filter("kind = 0 and n > 0").groupBy("node")
            .agg(F.max("n").alias("n"), F.max("sig").alias("sig"), F.min("id").alias("rep")))


def link_components(docs: DataFrame, prof: DataFrame) -> DataFrame:
    """node, label of every class that links with another."""
    nodes = keep(nodes_of(prof), "nodes")
    meta = F.col("meta")
    size = F.shiftright(meta, 37)
    index = keep(postings(docs, frequency_classes(prof)), "postings").select(
        "key", "node", size.alias("n"), (size - F.shiftright(meta, 11).bitwiseAND((1 << 26) - 1)).alias("left"),
        F.shiftright(meta, 3).bitwiseAND(255).alias("share"), meta.bitwiseAND(3).alias("kind"),
        (meta.bitwiseAND(4) > 0).alias("heavy"))
    # a list of single frequent tokens serves its heavy members only
    pivot = (index.groupBy("key").agg(
        F.min(F.when((F.col("kind") != SINGLE) | F.col("heavy"), F.struct("share", "n", "node", "left"))).alias("p"),
        F.min("node").alias("least"), F.max("node").alias("most"))
        .filter("p is not null and least != most")
        .select("key", F.col("p.node").alias("y"), F.col("p.n").alias("ny"), F.col("p.left").alias("ry")))
    star = _as_pairs(index.join(pivot, "key").select(F.col("node").alias("x"), F.col("n").alias("nx"),
                                                     F.col("left").alias("rx"), "y", "ny", "ry"))
    first = keep(_verified(star, nodes, docs), "links")
    label = components(first)
    now = keep(index.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    count = now.groupBy("key", "label").agg(F.count("*").alias("c"), F.max("heavy").alias("h"), F.max("kind").alias("kind"))
    main = (count.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("groups"),
                                     F.max("h").alias("h"), F.max("kind").alias("kind"))
            .filter(f"groups > 1 and (kind != {SINGLE} or h)").select("key", "main"))
    rest = open_pairs(now.join(main, "key"))
    second = _verified(keep(rest, "rest"), nodes, docs)
    return components(first.unionAll(second))


def _labelled(prof: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node, label (of the component), hash (of the text) of every document."""
    labels = link_components(docs, prof)
    ids = prof.filter("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "node", "hash")
    return ids.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, node (equal for equal sets) of every document."""
    ids = keep(_labelled(keep(profile(docs), "profile"), docs), "components")
    least = ids.filter("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return onto(ids, least, ["label"], "doc_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"), "node")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without all but one document of each component:
    the one with the least id (null after all others), then the least hash of its text, stays. Of rows
    that repeat an id and its text the least by all columns stays; rows that repeat an id with texts that
    don't link all stay. Documents without words stay; of those that repeat an id and its text, one."""
    ids = keep(_labelled(keep(profile(docs), "profile"), docs).filter("n_shingles > 0 or doc_id is not null")
               .groupBy("doc_id", "hash", "n_shingles", "label").agg(F.count("*").alias("c")), "joined")
    words = ids.filter("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    first = words.groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("of")).filter("of > 1")
    gone = (onto(words, first, ["label"], "doc_id").filter(~order.eqNullSafe(F.col("first")))
            .select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    out = docs.join(gone, same, "left_anti")
    twice = ids.filter("c > 1").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    if twice.isEmpty():
        return out
    least = (out.join(twice, same, "left_semi").groupBy("doc_id", F.xxhash64("text").alias("_hash"))
             .agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*"))
    return out.join(twice, same, "left_anti").unionByName(least)
