"""WARC: deterministic sharded writer, and a reader.

Records are sorted by page id over the whole archive: the range of ids is cut into equal bins, bytes
are counted per bin, and neighbouring bins fill shards of about ``shard_bytes``; shards and bins
depend on the data only, so the files are the same on every run and retry. Within a shard, files are
rolled by compressed size. Headers, lengths and digests are made anew from the payloads. A task writes
files under temporary names; when all have reported, the driver renames the reported ones and writes
the manifest, last of all. A lost executor's files are never renamed.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the largest page id is
a response, and the others are revisits of it.

Defined results: a null html is an empty payload, a null url has no target header. Rows that repeat an
id and a payload: the first is the response (or a revisit of a larger id), the rest revisit that id.
Records with a null id come first, in order of their payload digest; they are revisits only of a
record with an id. An empty table makes an archive with no file. Every record is a gzip member of its own.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.frames import keep

MIN_REVISIT = 1000
BINS = 1 << 14
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"        # the table has no crawl time; a fixed one keeps files reproducible
READ = 1 << 20


def _fs(folder: str):
    """(file system, path) of a folder URI, for tasks and driver alike."""
    from pyarrow import fs
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _clean(s: str) -> str:
    return s.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record: a response, or a revisit without payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
             f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of one record; digests and lengths
    are computed from what is there and must agree with the headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    if fields["WARC-Block-Digest"] != "sha1:" + hashlib.sha1(block).hexdigest():
        raise ValueError("block digest differs")
    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != length:
            raise ValueError("payload digest or length differs")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "payload_bytes": length, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page")}


def _shards(sizes: DataFrame, shard_bytes: int) -> tuple[list[int], int, int]:
    """(shard of each bin, least id, ids per bin), from bytes counted per bin."""
    lo, hi = sizes.agg(F.min("page_id"), F.max("page_id")).first()
    if lo is None:
        return [0], 0, 1
    width = (hi - lo) // BINS + 1
    rows = (sizes.filter("page_id is not null").groupBy(F.floor((F.col("page_id") - lo) / width).cast("int").alias("bin"))
            .agg(F.sum("size").alias("size")).collect())           # BINS rows at most
    total = {r["bin"]: r["size"] for r in rows}
    out, done = [], 0
    for b in range(max(total) + 1):
        out.append(done // shard_bytes)
        done += total.get(b, 0)
    return out, lo, width


def write(pages: DataFrame, folder: str, shard_bytes: int = 16 << 20, roll_bytes: int = 64 << 20, level: int = 4) -> list[dict]:
    """Write ``page_id, url, html`` of every row as an archive in ``folder`` (shared by all executors);
    returns the manifest's entries, one per file."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    small = keep(pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size")), "payloads")
    shards, lo, width = _shards(small, shard_bytes)
    n = shards[-1] + 1
    # rows without an id go to the first shard
    shard = F.when(F.col("page_id").isNull(), F.lit(0)).otherwise(
        F.element_at(F.lit(shards) if len(shards) < 64 else F.from_json(F.lit(json.dumps(shards)), "array<int>"),
                     F.floor((F.col("page_id") - lo) / width).cast("int") + 1))
    same = (small.filter(F.col("size") >= MIN_REVISIT).groupBy("digest")
            .agg(F.count("*").alias("c"), F.max("page_id").alias("ref")).filter("c > 1 and ref is not null"))
    said = small.join(same.select("digest", "ref"), "digest").select("page_id", "digest", "ref").distinct()
    # decisions travel beside the pages to their place in the order, so payloads are shuffled once
    rows = (pages.select(shard.alias("shard"), "page_id", F.sha1("html").alias("digest"), F.lit(1).alias("kind"), "url", "html",
                         F.lit(None).cast("long").alias("ref"))
            .unionAll(said.select(shard.alias("shard"), "page_id", "digest", F.lit(0).alias("kind"),
                                  F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "ref")))
    rows = rows.repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def run(batches):
        fs, base = _fs(folder)
        temp = f"{base}/_temporary"
        fs.create_dir(temp)
        done, out, name, state = [], None, None, None
        files: dict[int, int] = {}

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((*name, state["n"], state["bytes"], state["sha1"].hexdigest(), state["first"], state["last"]))
                out = None

        before = ref = decided = None
        for batch in batches:
            cols = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                s, page, digest, kind, url, html, r = (c[i].as_py() for c in cols)
                if kind == 0:
                    decided, ref = (page, digest), r
                    continue
                to = ref if decided == (page, digest) else None
                if to is not None and to == page and before != (page, digest):
                    to = None                                  # the response itself; a repeat of it revisits it
                before = (page, digest)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = member.compress(record(page, url, html.encode("utf-8", "surrogatepass"), to)) + member.flush()
                if out is not None and (s != state["shard"] or state["bytes"] + len(data) > roll_bytes):
                    close()
                if out is None:
                    files[s] = files.get(s, -1) + 1
                    final = f"part-{s:06d}-{files[s]:05d}.warc.gz"
                    name = (final, f"{final}.{uuid.uuid4().hex}")   # another name for each attempt
                    out = fs.open_output_stream(f"{temp}/{name[1]}", compression=None)
                    state = {"n": 0, "bytes": 0, "sha1": hashlib.sha1(), "first": page, "shard": s, "last": page}
                out.write(data)
                state["n"] += 1
                state["bytes"] += len(data)
                state["sha1"].update(data)
                state["last"] = page
        close()
        c = list(zip(*done)) or [()] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()),
             pa.array(c[4], pa.string()), pa.array(c[5], pa.int64()), pa.array(c[6], pa.int64())],
            names=["name", "temporary", "records", "bytes", "sha1", "first", "last"])

    got = rows.mapInArrow(run, "name string, temporary string, records long, bytes long, sha1 string, first long, last long").collect()
    return _commit(folder, [r.asDict() for r in sorted(got, key=lambda r: r["name"])])


def _commit(folder: str, entries: list[dict]) -> list[dict]:
    fs, base = _fs(folder)
    fs.create_dir(base)
    for e in entries:
        fs.move(f"{base}/_temporary/{e.pop('temporary')}", f"{base}/{e['name']}")
    with fs.open_output_stream(f"{base}/_manifest.tmp", compression=None) as f:
        f.write("".join(json.dumps(e) + "\n" for e in entries).encode())
    fs.move(f"{base}/_manifest.tmp", f"{base}/manifest.jsonl")
    from pyarrow.fs import FileType
    if fs.get_file_info(f"{base}/_temporary").type == FileType.Directory:
        fs.delete_dir(f"{base}/_temporary")           # what failed attempts left
    return entries


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the archive's committed files, a task per file."""
    fs, base = _fs(folder)
    with fs.open_input_stream(f"{base}/manifest.jsonl", compression=None) as f:
        names = [json.loads(x)["name"] for x in f.read().decode().splitlines()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not names:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(list(enumerate(names)), "at int, name string").repartitionById(len(names), F.col("at"))

    def members(stream):
        inflate, parts = zlib.decompressobj(31), []
        data = stream.read(READ)
        while data:
            parts.append(inflate.decompress(data))
            data = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts = zlib.decompressobj(31), []
            data = data or stream.read(READ)
        if any(parts):
            raise ValueError("archive file is cut short")

    def run(batches):
        fs, base = _fs(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        cols = [x.split()[0] for x in schema.split(", ")]
        table = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], k) for c, k in zip(cols, kinds)], names=cols)
        for batch in batches:
            for name in batch.column(1).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for m in members(stream):
                        rows.append(parse(m))
                        if len(rows) == 2000:
                            yield table(rows)
                            rows = []
                yield table(rows)

    return files.mapInArrow(run, schema)
