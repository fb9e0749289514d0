"""Incremental staging by file (S10): convert what is new or was rewritten, keep the rest.

The reference skips a source whose converted output is newer. Here a ledger beside the staged data has one
row per source file: its modification time and length when it was staged, the folder of its output,
and a profile of its columns. A run lists the sources, stages the files whose time or length is
not the ledger's into folders of their own, and then writes the next version of the ledger under a temporary
name and renames it. That rename is the commit: readers follow the ledger, so a rewritten file's old rows
give way to the new ones at once, and a run that fails before it leaves nothing behind that is read.

Profiles add up: a column is all-midnight (C8) or informative (P1) in the dataset by what it is in each
file. So the staged data opens with the types that staging all files at once would give them, and P1 is decided,
without reading old files again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.columns import DATE_COLS, FORMS, PROVENANCE
from caseflow.operators.profile import _informative
from caseflow.sources.files import file_system
from caseflow.sources.staging import read_files_with_columns, released_files, stage_typed

LEDGER = "_ledger"
_SCHEMA = ("form_id string, file string, modified timestamp, length long, folder string, n_rows long, "
           "profile array<struct<name: string, type: string, midnight: boolean, informative: boolean>>")


@dataclass(frozen=True)
class Run:
    """What one run did: files by name."""
    staged: list[str]
    kept: list[str]
    forgotten: list[str]


def _versions(spark: SparkSession, out_dir: str) -> list[int]:
    fs, path = file_system(spark, f"{out_dir.rstrip('/')}/{LEDGER}")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def read_ledger(spark: SparkSession, out_dir: str) -> DataFrame:
    """The committed ledger, one row per source file (empty before the first run)."""
    v = _versions(spark, out_dir)
    if not v:
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(f"{out_dir.rstrip('/')}/{LEDGER}/v={v[-1]}")


def _commit(spark: SparkSession, out_dir: str, ledger: DataFrame) -> None:
    """Write the next version whole, then give it its name; a run that another one overtook raises."""
    n = (_versions(spark, out_dir) or [0])[-1] + 1
    root = f"{out_dir.rstrip('/')}/{LEDGER}"
    pending = f"{root}/_pending-{uuid.uuid4().hex}"
    ledger.write.parquet(pending)
    fs, final = file_system(spark, f"{root}/v={n}")
    if fs.exists(final) or not fs.rename(file_system(spark, pending)[1], final):
        raise RuntimeError(f"version {n} of the ledger in {out_dir} was committed by another run")


def _profile(df: DataFrame, cols: list[str]) -> Column:
    """Array of column states, as one aggregate."""
    def midnight(c: str) -> Column:
        if not isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.lit(None).cast("boolean")
        return F.coalesce(F.bool_and(F.date_trunc("DAY", F.col(c)) == F.col(c)), F.lit(True))
    return F.array(*[F.struct(F.lit(c).alias("name"), F.lit(df.schema[c].dataType.simpleString()).alias("type"),
                              midnight(c).alias("midnight"),
                              F.coalesce(F.max(_informative(df, c).cast("int")), F.lit(0)).cast("boolean")
                              .alias("informative")) for c in cols])


def sync_release(spark: SparkSession, release_dir: str, out_dir: str, fmt: str = "csv",
                 forget_missing: bool = True) -> Run:
    """Bring the staged data in ``out_dir`` up to date with the files below ``release_dir``.

    ``forget_missing`` takes files that are gone out of the ledger, so that the staged data is what staging the
    release anew would give; otherwise their rows stay. Row numbers and columns are those of ``stage_forms``."""
    old = {(r["form_id"], r["file"]): r for r in read_ledger(spark, out_dir).collect()}
    found = released_files(spark, release_dir, fmt)
    now = {(r["form_id"], r["uri"]): r for r in found}
    todo = {k for k, r in now.items()
            if k not in old or (old[k]["modified"], old[k]["length"]) != (r["modified"], r["length"])}
    gone = [k for k in old if k not in now] if forget_missing else []

    run = uuid.uuid4().hex
    fresh = []
    for form_id in FORMS:
        files = {uri: now[f, uri]["path"] for f, uri in sorted(todo) if f == form_id}
        if not files:
            continue
        folder = f"form_id={form_id}/run={run}"
        raw, own = read_files_with_columns(spark, files, fmt)
        # narrowing needs the whole dataset: it is decided at the opening, from all profiles
        typed = stage_typed(raw, keep=PROVENANCE, narrow=False).withColumn("label", F.lit(FORMS[form_id][1]))
        file_col = PROVENANCE[0]
        # a file's output stands apart, so that replacing it leaves the others as they are
        path = f"{out_dir.rstrip('/')}/{folder}"
        (typed.withColumn("_file", F.sha1(F.col(file_col))).write.option("compression", "zstd").partitionBy("_file")
         .parquet(path))
        written = spark.read.schema(typed.schema).parquet(path)
        profile = written.groupBy(F.col(file_col).alias("file")).agg(
            F.count(F.lit(1)).alias("n_rows"), _profile(written, [c for c in typed.columns if c not in PROVENANCE]).alias("_p"))
        types = {c.lower(): (c, t) for c, t in typed.dtypes}
        files_done = spark.createDataFrame(
            [(form_id, u, now[form_id, u]["modified"], now[form_id, u]["length"],
              [types[c.lower()] for c in [*own.get(u, []), "label"]]) for u in files],
            "form_id string, file string, modified timestamp, length long, _own array<struct<name: string, type: string>>")

        def state(c):
            found = F.filter(F.col("_p"), lambda p: p["name"] == c["name"])
            unknown = F.struct(c["name"].alias("name"), c["type"].alias("type"), F.lit(None).cast("boolean").alias("midnight"),
                               F.lit(False).alias("informative"))
            return F.coalesce(F.try_element_at(found, F.lit(1)), unknown)
        # a file without rows has no output folder, but its columns count
        fresh.append(files_done.join(profile, "file", "left").select(
            "form_id", "file", "modified", "length",
            F.when(F.col("n_rows") > 0, F.concat(F.lit(f"{folder}/_file="), F.sha1("file"))).alias("folder"),
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.transform("_own", state).alias("profile")))
    if fresh or gone:
        kept = spark.createDataFrame([r for k, r in old.items() if k not in todo and k not in gone], _SCHEMA)
        _commit(spark, out_dir, reduce(DataFrame.unionByName, fresh, kept))
    return Run(sorted(u for _, u in todo), sorted(u for _, u in old if (_, u) not in todo and (_, u) not in gone),
               sorted(u for _, u in gone))


def open_staged(spark: SparkSession, out_dir: str, form_id: str,
                drop: tuple[str, ...] = ("label",)) -> tuple[DataFrame, dict[str, bool]]:
    """(all staged rows of a form with the types of a full staging, column -> informative). Schema, types and
    the answers of P1 come from the ledger; no data is read."""
    files = read_ledger(spark, out_dir).filter(F.col("form_id") == form_id).orderBy("file").collect()
    if not files:
        raise FileNotFoundError(f"no staged file of {form_id} in {out_dir}")
    types, midnight, informative = {}, {}, {}
    for r in files:
        for p in r["profile"]:
            c = p["name"]
            types.setdefault(c, p["type"])
            midnight[c] = midnight.get(c, True) and p["midnight"] is not False
            informative[c] = informative.get(c, False) or p["informative"]
    file_col, row_col = PROVENANCE
    label = types.pop("label", None)
    schema = ", ".join([*[f"`{c.replace('`', '``')}` {t}" for c, t in types.items()],
                        f"{file_col} string, {row_col} long", *(["label string"] if label else [])])
    folders = [f"{out_dir.rstrip('/')}/{r['folder']}" for r in files if r["folder"]]
    df = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    df = df.select(*[F.to_date(c).alias(c) if c in DATE_COLS and t.startswith("timestamp") and midnight[c] else F.col(c)
                     for c, t in df.dtypes if c not in drop])
    return df, {c: v for c, v in informative.items() if c in df.columns}


def vacuum(spark: SparkSession, out_dir: str) -> int:
    """Delete output folders and ledger versions that the committed ledger doesn't name; returns how
    many. For a time when no run or reader of an older version is active."""
    named = {r["folder"] for r in read_ledger(spark, out_dir).select("folder").collect() if r["folder"]}
    root = out_dir.rstrip("/")
    n = 0
    for form_id in FORMS:
        fs, top = file_system(spark, f"{root}/form_id={form_id}")
        for run in fs.listStatus(top) if fs.exists(top) else []:
            parts = [s.getPath() for s in fs.listStatus(run.getPath()) if s.isDirectory()]
            dead = [p for p in parts if f"form_id={form_id}/{run.getPath().getName()}/{p.getName()}" not in named]
            for p in [run.getPath()] if len(dead) == len(parts) else dead:
                fs.delete(p, True)
                n += 1
    fs, top = file_system(spark, f"{root}/{LEDGER}")
    last = (_versions(spark, out_dir) or [0])[-1]
    for s in fs.listStatus(top) if fs.exists(top) else []:
        if s.getPath().getName() != f"v={last}":
            fs.delete(s.getPath(), True)
            n += 1
    return n
