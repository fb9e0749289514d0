"""URL filters: rules, and a path-template tree per host.

Per host, the segments of paths make a tree, built a level at a time by aggregates until every path
has ended; no path is cut. At every node, children that are rare (under 1/``RARE`` of the node's pages, or
a single page) are variable and become the wildcard ``WILD``. The other children, ``RARE`` at most, are
branches, and similar ones are merged by runs of neighbours that a two-sided z-test of two shares doesn't
tell apart: first by structure, the share of a branch's pages that end there; then, within such a run,
labelled branches by the share of blocked pages, and unlabelled ones with each other. A merged branch is
named after all its members.

A leaf is a template of its host. Its purity is (blocked + M * prior) / (labelled + M). The prior comes from
other hosts: of those with labelled pages under the same wildcard path, (hosts with at least ``PURITY``
blocked + 1) / (hosts + 2), so no host counts more than another, and an unlabelled host is judged by what is
known of its paths elsewhere. Hosts whose pages are all labelled alike don't count: their label says nothing
about paths. M is 2 and a quarter of the template's unlabelled pages. Templates of purity ``PURITY`` or more
are rejected. Labels come from the rules: pages that a rule blocks or allows.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule, and is judged
by the template of empty paths. Segments are what stands between slashes, empty ones left out. Repeated rows
count as often as they occur.

Tables of totals are joined to rows by (key, ``frames.SPREAD`` parts of it), so a host or path with a third of all
rows is spread; windows hold the branches of one node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.frames import keep, onto

# fixed values: (verdict, host, path) rules
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
RARE = 20
Z = 2.0
PURITY = 0.9
WILD = "?*"          # no segment holds ? or #
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.expr(f"substring({url}, locate('://', {url}) + 3)")
    has = F.coalesce(F.col(url).contains("://"), F.lit(False))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return (F.when(has, host).otherwise(""), F.when(has, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(""))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits columns host and path, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):       # later, longer ones win
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def different(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Whether the shares x1/n1 and x2/n2 differ by more than ``Z`` standard errors; written without a
    division, so that equal counts give equal answers everywhere."""
    x1, n1, x2, n2 = (c.cast("double") for c in (x1, n1, x2, n2))
    gap, x, n = x1 * n2 - x2 * n1, x1 + x2, n1 + n2
    return F.coalesce(gap * gap * n > Z * Z * x * (n - x) * n1 * n2, F.lit(False))


def branches(child: DataFrame) -> DataFrame:
    """host, t, name, to (template of the merged branch), alone (whether one path goes on below it), from
    the children of all nodes: host, t, name, c, b, a, e (pages that end there), more (paths that go on)."""
    node = Window.partitionBy("host", "t", "wild")
    branch = (child.groupBy("host", "t", "name").agg(*[F.sum(x).alias(x) for x in ("c", "b", "a", "e", "more")])
              .withColumns({"wild": F.col("name") == WILD, "n": F.col("b") + F.col("a")}))
    by_end = node.orderBy(F.try_divide("e", "c"), "name")
    branch = branch.withColumn("cut", different(F.lag("e").over(by_end), F.lag("c").over(by_end), F.col("e"), F.col("c")).cast("int"))
    branch = branch.withColumn("run", F.sum("cut").over(by_end.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("host", "t", "wild", "run", F.col("n") > 0)
    by_share = within.orderBy(F.try_divide("b", "n"), "name")
    branch = branch.withColumn("cut", different(F.lag("b").over(by_share), F.lag("n").over(by_share), F.col("b"), F.col("n")).cast("int"))
    branch = branch.withColumn("sub", F.sum("cut").over(by_share.rowsBetween(Window.unboundedPreceding, 0)))
    merged = Window.partitionBy("host", "t", "wild", "run", F.col("n") > 0, "sub")
    return branch.select("host", "t", "name",
                         F.concat("t", F.lit("/"), F.array_join(F.sort_array(F.collect_list("name").over(merged)), "#")).alias("to"),
                         (F.sum("more").over(merged) == 1).alias("alone"))


def templates(paths: DataFrame) -> DataFrame:
    """host, path, c, b, a, t (template) and w (the path with wildcards, unmerged), from host, path, c
    (pages), b (blocked ones), a (allowed ones)."""
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    counts = ["host", "path", "c", "b", "a"]
    df = keep(paths.select(*counts, segs.alias("segs"), F.lit("").alias("t"), F.lit("").alias("w")), "paths")
    ended = [df.filter(F.size("segs") == 0).drop("segs")]
    df, level = df.filter(F.size("segs") > 0), 0
    while not df.isEmpty():
        df = df.withColumns({"seg": F.col("segs")[level], "last": F.size("segs") == level + 1})
        child = df.groupBy("host", "t", "seg").agg(
            *[F.sum(x).alias(x) for x in "cba"], F.sum(F.when(F.col("last"), F.col("c")).otherwise(0)).alias("e"),
            F.count_if(~F.col("last")).alias("more"))
        node = child.groupBy("host", "t").agg(F.sum("c").alias("nc"))
        rare = (RARE * F.col("c") < F.col("nc")) | (F.col("c") < 2)
        child = keep(onto(child, node, ["host", "t"], "seg")
                     .withColumn("name", F.when(rare, WILD).otherwise(F.col("seg"))).drop("nc"), "children")
        to = onto(child.select("host", "t", "seg", "name"), branches(child), ["host", "t", "name"], "seg")
        df = onto(df, to, ["host", "t", "seg"], "path")
        # below a node with one path nothing varies or merges: its segments stand, a single page's are wild
        left = F.slice("segs", level + 2, F.size("segs"))
        rest = F.when(F.col("alone"), F.concat_ws("", F.transform(
            left, lambda x: F.concat(F.lit("/"), F.when(F.col("c") < 2, WILD).otherwise(x))))).otherwise("")
        df = keep(df.select(*counts, "segs", F.concat("to", rest).alias("t"), F.concat("w", F.lit("/"), "name", rest).alias("w"),
                            (F.col("last") | F.col("alone")).alias("end")), "level")
        ended.append(df.filter("end").drop("segs", "end"))
        df, level = df.filter("not end").drop("end"), level + 1
    return reduce(DataFrame.unionByName, ended)


def rejected(t: DataFrame) -> DataFrame:
    """host, t, w of the templates (columns of ``templates``) whose purity is ``PURITY`` or more."""
    sums = [F.sum(x).alias(x) for x in "cba"]
    n = F.col("b") + F.col("a")
    hosts = t.groupBy("host").agg(*sums).filter("b < c and a < c").select("host")
    says = t.groupBy("host", "w").agg(*sums).filter(n > 0).join(hosts, "host", "left_semi")
    prior = says.groupBy("w").agg(((F.count_if(F.col("b") >= PURITY * n) + 1) / (F.count("*") + 2)).alias("prior"))
    m = 2 + (F.col("c") - n) / 4
    leaf = onto(t.select("host", "t", "w").distinct(), t.groupBy("host", "t").agg(*sums), ["host", "t"], "w")
    leaf = onto(leaf, prior, ["w"], "host", "left").withColumn("prior", F.coalesce("prior", F.lit(0.5)))
    return leaf.filter((F.col("b") + m * F.col("prior")) / (n + m) >= PURITY).select("host", "t", "w")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = host_and_path()
    rule, verdict = rule_of(rules)
    p = (pages.select("page_id", "url").withColumns({"host": host, "path": path})
         .withColumns({"rule": rule, "said": verdict}).drop("url"))
    # equal paths of a host are counted first, so the tree's joins see each once
    paths = p.groupBy("host", "path").agg(F.count("*").alias("c"), F.count_if(F.col("said") == "block").alias("b"),
                                          F.count_if(F.col("said") == "allow").alias("a"))
    t = keep(templates(paths), "templates")
    bad = (onto(t.select("host", "path", "t", "w"), rejected(t), ["host", "t", "w"], "path")
           .select("host", "path", F.lit(True).alias("bad")))
    return onto(p, bad, ["host", "path"], "page_id", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce(F.col("said"), F.when(F.col("bad"), "block"), F.lit("allow")).alias("verdict"))


def oracle() -> str:
    """The same in DuckDB SQL: a level is a step of the recursion, and a node's rows are windows."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1]))
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(r[1], r[2])} THEN '{r[0] if i else r[1] + r[2]}'" for r in order) + " END"
    num = lambda *c: [f"CAST({x} AS DOUBLE)" for x in c]

    def cut(x: str, n: str, w: str) -> str:
        x1, n1, x2, n2 = num(f"lag({x}) OVER {w}", f"lag({n}) OVER {w}", x, n)
        gap, s, t = f"({x1} * {n2} - {x2} * {n1})", f"({x1} + {x2})", f"({n1} + {n2})"
        return f"CASE WHEN {gap} * {gap} * {t} > {Z * Z} * {s} * ({t} - {s}) * {n1} * {n2} THEN 1 ELSE 0 END"

    return f"""WITH RECURSIVE u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
j AS (SELECT *, {case(0)} AS rule, {case(1)} AS said FROM p),
d0 AS (SELECT host, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs, CAST(count(*) AS BIGINT) AS c,
  count(*) FILTER (said = 'block') AS b, count(*) FILTER (said = 'allow') AS a FROM j GROUP BY ALL),
d AS (SELECT 0 AS level, *, '' AS t, '' AS w FROM d0
  UNION ALL
  SELECT s.level + 1, s.host, s.path, s.segs, s.c, s.b, s.a, s.t || '/' || m.merged, s.w || '/' || s.name
  FROM (SELECT *, CASE WHEN {RARE} * cc < nc OR cc < 2 THEN '{WILD}' ELSE seg END AS name
        FROM (SELECT *, segs[level + 1] AS seg, sum(c) OVER (PARTITION BY host, t, segs[level + 1]) AS cc,
                sum(c) OVER (PARTITION BY host, t) AS nc FROM d WHERE level < len(segs))) s
  JOIN (SELECT host, t, name, array_to_string(list_sort(list(name) OVER (PARTITION BY host, t, wild, run, n > 0, sub)), '#') AS merged
        FROM (SELECT *, sum(cut2) OVER (PARTITION BY host, t, wild, run, n > 0 ORDER BY b / n NULLS FIRST, name ROWS UNBOUNDED PRECEDING) AS sub
        FROM (SELECT *, {cut('b', 'n', '(PARTITION BY host, t, wild, run, n > 0 ORDER BY b / n NULLS FIRST, name)')} AS cut2
        FROM (SELECT *, sum(cut1) OVER (PARTITION BY host, t, wild ORDER BY e / c, name ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, {cut('e', 'c', '(PARTITION BY host, t, wild ORDER BY e / c, name)')} AS cut1
        FROM (SELECT host, t, name, name = '{WILD}' AS wild, sum(c) AS c, sum(b) AS b, sum(b + a) AS n,
                sum(CASE WHEN level + 1 = len(segs) THEN c ELSE 0 END) AS e
              FROM (SELECT *, CASE WHEN {RARE} * cc < nc OR cc < 2 THEN '{WILD}' ELSE seg END AS name
                    FROM (SELECT *, segs[level + 1] AS seg, sum(c) OVER (PARTITION BY host, t, segs[level + 1]) AS cc,
                            sum(c) OVER (PARTITION BY host, t) AS nc FROM d WHERE level < len(segs)))
              GROUP BY host, t, name)))))) m ON s.host = m.host AND s.t = m.t AND s.name = m.name),
l AS (SELECT * FROM d WHERE level = len(segs)),
says AS (SELECT host, w, sum(b) AS b, sum(b + a) AS n FROM l GROUP BY host, w HAVING sum(b + a) > 0),
prior AS (SELECT w, (count(*) FILTER (b >= CAST({PURITY} AS DOUBLE) * n) + 1) / (count(*) + 2) AS prior FROM says
  WHERE host IN (SELECT host FROM l GROUP BY host HAVING sum(b) < sum(c) AND sum(a) < sum(c)) GROUP BY w),
g AS (SELECT host, t, CAST(sum(c) AS DOUBLE) AS c, CAST(sum(b) AS DOUBLE) AS b, CAST(sum(b + a) AS DOUBLE) AS n FROM l GROUP BY host, t),
z AS (SELECT l.host, l.path FROM l JOIN g ON l.host = g.host AND l.t = g.t LEFT JOIN prior ON prior.w = l.w
  WHERE (g.b + (2 + (g.c - g.n) / 4) * coalesce(prior, 0.5::DOUBLE)) / (g.n + (2 + (g.c - g.n) / 4)) >= CAST({PURITY} AS DOUBLE))
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.said, CASE WHEN z.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN z ON j.host = z.host AND j.path = z.path"""
