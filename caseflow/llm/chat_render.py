"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string; nothing about its inside is known. Successive
prefixes of a conversation are rendered and consecutive outputs compared: what the longer one adds is the new
turn's span. If the longer one doesn't begin with the shorter one, the template rewrites history; ``rewritten``
tells how many of the earlier characters the turn replaced, so that the output can still be put together. The
place of a learned turn's text inside its span is found by rendering the same prefix with a probe character for the text:
what stands before and after the probe frames the text.

Prefixes are rendered over a sliding window: once it holds ``WINDOW`` turns, it is cut to the last
``CONTEXT``, and the last turn, rendered in the cut window, must come out as before. A template that looks
farther back and shows it there sets ``drifted``. Conversations of up to ``WINDOW`` turns are rendered whole, all
others at a cost in proportion to their length.

Rows are dealt by conversation and sorted once, and a task streams through them: it holds a window of turns, never
a conversation. The digests of a conversation run over its text in order, so one task reads it from end to end.

Defined results: a null text or role is empty; turns go by number, null last, then role and text, so repeated
rows are turns of their own; rows without a conversation id form one conversation without an id; an
empty table gives an empty result. Texts are read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.frames import released

WINDOW = 32
CONTEXT = 4
PROBE = "\ue000"                     # a private-use character: no template writes it
LEARNED = "assistant"
SEGMENTS = "position long, segment string, loss_start long, loss_end long, rewritten long, drifted boolean"
Turn = tuple[str, str]

# --- the registered template: "### role: text</turn>\n" -------------------------------------------------

_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(s: str) -> str:
    """``s`` with a backslash before backslashes and control strings."""
    return s.replace("\\", "\\\\").replace("### ", "\\### ").replace("</turn>", "\\</turn>")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL)


def markup(turns: list[Turn]) -> str:
    return "".join(f"### {escape(role).replace(':', chr(92) + ':')}: {escape(text)}</turn>\n" for role, text in turns)


def parse(text: str) -> tuple[list[Turn], str]:
    """The whole turns at the start of formatted text, and what is left."""
    out, at = [], 0
    while m := _TURN.match(text, at):
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out, text[at:]


# --- rendering of any template ----------------------------------------------------------------------------

def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def spans(turns: Iterator[Turn], template: Callable[[list[Turn]], str], learned: str = LEARNED):
    """(segment, loss start, loss end, rewritten, drifted) of every turn, read one by one."""
    window: list[Turn] = []
    before = template([])
    lead = before                                       # what stands before any turn belongs to the first one
    for role, text in turns:
        turn, drifted = (role, text), False
        after = template([*window, turn])
        same = _shared(before, after)
        segment = lead[:same] + after[same:] if lead else after[same:]
        start = end = None
        if role == learned and same == len(before):
            start, end = _framed(after[same:], template([*window, (role, PROBE)]), before)
            if start is not None:
                start, end = start + len(lead), end + len(lead)
        rewritten = 0 if lead else len(before) - same
        lead = ""
        window.append(turn)
        before = after
        if len(window) == WINDOW:
            window = window[-CONTEXT:]
            before = template(window)
            shorter = template(window[:-1])
            drifted = not (before.startswith(shorter) and after[same:] == before[len(shorter):])
        yield segment, start, end, rewritten, drifted


def _framed(new: str, probed: str, before: str) -> tuple[int | None, int | None]:
    """Where the text lies in the turn's new part, given the output with a probe in its place."""
    if probed.startswith(before) and probed.count(PROBE, len(before)) == 1:
        head, tail = probed[len(before):].split(PROBE)
        if len(new) >= len(head) + len(tail) and new.startswith(head) and new.endswith(tail):
            return len(head), len(new) - len(tail)
    return None, None


def _grouped(batches, column: int, rows: Callable[[pa.RecordBatch], list]) -> Iterator[tuple]:
    """(key, rows read one by one) of every run of equal keys in sorted batches."""
    def every():
        for b in batches:
            yield from zip(b.column(column).to_pylist(), rows(b))
    stream = every()
    held = next(stream, None)
    while held is not None:
        key = held[0]

        def run():
            nonlocal held
            while held is not None and held[0] == key:
                row = held[1]
                yield row
                held = next(stream, None)
        yield key, run()


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4 << 20, of: int = 2) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` characters of column ``of``."""
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[of] or "") + 64
        if size >= limit:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def render(conversations: DataFrame, template: Callable[[list[Turn]], str] = markup, learned: str = LEARNED) -> DataFrame:
    """conv_id, position, segment, loss_start, loss_end (places in the segment), rewritten, drifted of every turn.

    A conversation's output is its segments one after the other (each cutting off ``rewritten`` characters
    first). A learned turn whose text can't be located has no loss span. Rows of a conversation are together and in order.
    """
    rows = (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"),
                                 F.coalesce(F.col("role").cast("string"), F.lit("")).alias("_role"),
                                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
            .repartition("conv_id")
            .sortWithinPartitions("conv_id", F.col("_turn").asc_nulls_last(), "_role", "_text"))
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int64()),
                        ("loss_end", pa.int64()), ("rewritten", pa.int64()), ("drifted", pa.bool_())])

    @released
    def run(batches):
        def out():
            for conv, turns in _grouped(batches, 0, lambda b: list(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))):
                for i, s in enumerate(spans(turns, template, learned)):
                    yield conv, i, *s
        yield from _in_batches(out(), schema)

    return rows.mapInArrow(run, f"conv_id long, {SEGMENTS}")


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation from segments of ``markup``, in the order of ``render``: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. Turns are parsed out of the text as it comes, wherever segments
    end; the loss text is what lies in the loss spans. Output that doesn't parse raises."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(conv, rows):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = n_loss = size = 0
        rest = ""
        for segment, start, end, rewritten, drifted in rows:
            if rewritten or drifted:
                raise ValueError(f"conversation {conv}: the template rewrites history")
            found, rest = parse(rest + segment)
            for role, text in found:
                turns.update(f"{role}\n{text}\n".encode())
            n += len(found)
            size += len(segment)
            if start is not None:
                text = unescape(segment[start:end])
                loss.update(text.encode())
                n_loss += len(text)
        if rest:
            raise ValueError(f"conversation {conv}: {len(rest)} characters are no turn")
        return conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), size

    @released
    def run(batches):
        def rows(b):
            return list(zip(*(b.column(i).to_pylist() for i in range(2, 7))))
        yield from _in_batches((digest(k, r) for k, r in _grouped(batches, 0, rows)), schema)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                    "loss_sha256 string, formatted_chars long")


#: A conversation whose texts look like the template's own marks.
HOSTILE = (-7, ("user", "assistant"), "\\### Assistant: </turn> ok")


def with_hostile(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of all rows and of the two turns of ``HOSTILE``."""
    conv, roles, text = HOSTILE
    extra = conversations.sparkSession.createDataFrame([(conv, i, r, text) for i, r in enumerate(roles)],
                                                       "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def oracle() -> str:
    esc = "replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '### ', chr(92) || '### '), '</turn>', chr(92) || '</turn>')"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {HOSTILE[0]}, i, r, '{HOSTILE[2]}' FROM (VALUES (0, '{HOSTILE[1][0]}'), (1, '{HOSTILE[1][1]}')) v(i, r)),
o AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = '{LEARNED}'), '') AS loss,
    sum(length('### : </turn>') + 1 + length(replace({esc.format("role")}, ':', chr(92) || ':')) + length({esc.format("text")})) AS n
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(n AS BIGINT) AS formatted_chars FROM o"""
