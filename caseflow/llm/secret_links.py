"""Secret scans: multipart credentials linked by an interval join. DataFrame functions only.

Base kinds (assign, access, hex) are always reported. Weak candidates are reported only where a
complementary part stands within ``SCOPE`` code points in the same text:
``id`` (a short or temporary access identifier) with a secret, ``key`` (a long mixed token) with an
access identifier, ``endpoint`` (a web address) with both. Parts are joined by text and by place in
bins of ``SCOPE`` code points, so a candidate meets only the few spans around it.

Spans come from splitting a text at a pattern's matches: the lengths of the pieces between matches and
of the matches add up to the places.

Defined results: a null text is empty and has no spans; the digest is then that of the empty string.
Places are code points, ends exclusive. A weak candidate that overlaps a base span is dropped. Texts
with the same id and content are scanned alike, each row gets its result; null ids stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.frames import keep

SCOPE = 200


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


# fixed values: the base patterns (letters of the names in either case), then the weak ones. A run of hex
# digits is greedy, so asking for 16 gives the same spans as dropping shorter ones; likewise access.
_NAMES = "|".join([_either_case("password"), _either_case("passwd"), _either_case("secret"), _either_case("token"),
                   _either_case("api") + "_?" + _either_case("key")])
PATTERNS = {
    "assign": f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{14,}",
    "hex": "[0-9a-f]{16,}",
    "id": "A[KS]IA[A-Z0-9]{8,}",
    "key": "[A-Za-z0-9/+]{32,}",
    "endpoint": "https?://[A-Za-z0-9][A-Za-z0-9.:/_-]*",
}
BASE = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate(PATTERNS)}
PART = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "id": "id", "endpoint": "endpoint"}


def _matches(kind: str) -> Column:
    """Array of (kind, at, gap, size, ok) of a pattern's matches in ``text``; ``gap`` code points stand
    before a match. The piece after the last match is one more entry, of size 0."""
    pattern = PATTERNS[kind]
    hits = lambda group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), hits(0).alias("hit"),
                          hits(2 if kind == "assign" else 0).alias("value"))

    def entry(z, at):
        hit = F.coalesce(z["hit"], F.lit(""))
        ok = {"assign": F.length(z["value"]) >= 12,
              "key": hit.rlike("[a-z]") & hit.rlike("[A-Z]") & hit.rlike("[0-9]")}.get(kind, F.lit(True))
        return F.struct(F.lit(kind).alias("kind"), at.alias("at"), F.length(z["gap"]).alias("gap"), F.length(hit).alias("size"),
                        ((F.length(hit) > 0) & F.coalesce(ok, F.lit(False))).alias("ok"))

    return F.when(F.col("text").rlike(pattern), F.transform(zipped, entry))       # most texts stop at the test


def spans(docs: DataFrame) -> DataFrame:
    """id, h, kind, start, end: all matches, from one pass over the texts. One text's matches of a kind
    are one window group."""
    none = F.array().cast("array<struct<kind:string,at:int,gap:int,size:int,ok:boolean>>")
    found = [F.coalesce(_matches(kind), none) for kind in PATTERNS]
    rows = docs.select("id", "h", F.explode(F.concat(*found)).alias("m")).select("id", "h", "m.*")
    rows = rows.distinct()                                        # rows that repeat an id and a text
    by = Window.partitionBy("id", "h", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(by)
    return (rows.withColumn("end", end).filter("ok")
            .select("id", "h", "kind", (F.col("end") - F.col("size")).alias("start"), "end"))


def _bins(lo, hi):
    return F.explode(F.sequence(F.greatest(F.floor(lo / SCOPE), F.lit(0)), F.floor(hi / SCOPE)))


def linked(found: DataFrame) -> DataFrame:
    """The weak candidates of ``found`` that stand near their complementary parts."""
    part = F.create_map(*[F.lit(x) for kv in PART.items() for x in kv])[F.col("kind")]
    weak = found.filter(~F.col("kind").isin(*BASE))
    probe = weak.select("id", "h", "kind", "start", "end", _bins(F.col("start") - SCOPE, F.col("end") + SCOPE).alias("bin"))
    parts = found.select(F.col("id").alias("pid"), F.col("h").alias("ph"), F.col("kind").alias("pkind"), part.alias("part"),
                         F.col("start").alias("a"), F.col("end").alias("b"), _bins(F.col("start"), F.col("end")).alias("pbin"))
    base = F.col("pkind").isin(*BASE)
    apart = (F.col("a") >= F.col("end")) | (F.col("b") <= F.col("start"))
    near = (F.col("a") <= F.col("end") + SCOPE) & (F.col("b") >= F.col("start") - SCOPE)
    met = (probe.join(parts, F.col("id").eqNullSafe(F.col("pid")) & (F.col("h") == F.col("ph")) & (F.col("bin") == F.col("pbin")) & near)
           .groupBy("id", "h", "kind", "start", "end")
           .agg(F.max(base & ~apart).alias("covered"), F.max((F.col("part") == "id") & apart).alias("with_id"),
                F.max((F.col("part") == "secret") & apart).alias("with_secret")))
    say = (F.when(F.col("kind") == "id", F.col("with_secret")).when(F.col("kind") == "key", F.col("with_id"))
           .otherwise(F.col("with_id") & F.col("with_secret")))
    return met.filter(~F.col("covered") & say).select("id", "h", "kind", "start", "end")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and spans (kind:start:end by start, then kind) of every row."""
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("h"), "text")
    found = keep(spans(rows), "spans")
    all_spans = found.filter(F.col("kind").isin(*BASE)).unionAll(linked(found))
    order = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])[F.col("kind")]
    said = F.struct(F.col("start"), order.alias("o"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    got = all_spans.groupBy("id", "h").agg(                      # one text's spans
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE],
        F.sort_array(F.collect_list(said)).alias("all"))
    text = lambda arr: F.concat_ws(",", F.transform(arr, lambda x: x["s"]))
    got = got.select(F.col("id").alias("gid"), F.col("h").alias("gh"), *[f"n_{k}" for k in BASE],
                     text(F.filter("all", lambda x: x["o"] < len(BASE))).alias("base"), text(F.col("all")).alias("spans"))
    return (rows.select("id", "h").join(got, F.col("id").eqNullSafe(F.col("gid")) & (F.col("h") == F.col("gh")), "left")
            .select(F.col("id").alias("doc_id"), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
                    F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans")))


def oracle() -> str:
    """The same in DuckDB SQL; the base patterns as they were given, failing matches dropped."""
    q = lambda s: s.replace("'", "''")
    given = PATTERNS | {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    test = {"assign": "length(value) >= 12", "access": "length(hit) >= 18", "hex": "length(hit) >= 16",
            "key": "regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[0-9]')"}
    one = [f"""SELECT doc_id, '{k}' AS kind, {i} AS o, pos, hit, value, length(gap) AS g, {test.get(k, 'true')} AS ok FROM (
  SELECT doc_id, unnest(range(len(h))) AS pos, unnest(h) AS hit, unnest(v) AS value, unnest(g[1:len(h)]) AS gap FROM (
    SELECT doc_id, regexp_extract_all(text, '{q(p)}') AS h, regexp_extract_all(text, '{q(p)}', {2 if k == 'assign' else 0}) AS v,
      string_split_regex(text, '{q(p)}') AS g FROM t))""" for i, (k, p) in enumerate(given.items())]
    part = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in PART.items()) + " END"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(one)}),
e AS (SELECT *, sum(g + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS e FROM m),
s AS (SELECT doc_id, kind, o, {part} AS part, CAST(e - length(hit) AS BIGINT) AS a, CAST(e AS BIGINT) AS b FROM e WHERE ok),
near AS (SELECT w.doc_id, w.kind, w.o, w.a, w.b, bool_or(p.o < 3 AND p.a < w.b AND p.b > w.a) AS covered,
    bool_or(p.part = 'id' AND (p.a >= w.b OR p.b <= w.a)) AS i, bool_or(p.part = 'secret' AND (p.a >= w.b OR p.b <= w.a)) AS c
  FROM s w JOIN s p ON w.doc_id = p.doc_id AND p.a <= w.b + {SCOPE} AND p.b >= w.a - {SCOPE} WHERE w.o >= 3 GROUP BY ALL),
r AS (SELECT doc_id, kind, o, a, b FROM s WHERE o < 3 UNION ALL SELECT doc_id, kind, o, a, b FROM near
  WHERE NOT covered AND CASE kind WHEN 'id' THEN c WHEN 'key' THEN i ELSE i AND c END),
x AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS spans,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER (o < 3), '') AS base,
  count(*) FILTER (o = 0) AS na, count(*) FILTER (o = 1) AS nc, count(*) FILTER (o = 2) AS nh FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN x USING (doc_id)"""
