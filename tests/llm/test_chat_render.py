"""Black-box rendering: spans against whole renderings, exact round trips, templates that rewrite history."""

import hashlib
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from caseflow.llm import chat_render as cr

cloudpickle.register_pickle_by_value(sys.modules[__name__])      # templates of this file, which workers can't import
SCHEMA = "conv_id long, turn long, role string, text string, segment string, position int, _text string"
MARKS = ["### ", "</turn>", "\\", "\n", ": ", "### assistant: ", "\\### user: x</turn>\n", "</turn", "#", "é", "日", "", "a b"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def wild(rng, n):
    return "".join(rng.choice(MARKS) for _ in range(rng.randrange(n)))


def brute(rows):
    def order(r):
        return r[1] is None, r[1] or 0, r[2] or "", r[3] or ""
    out = []
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(cr.markup(turns))))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    out = [(c, k, rng.choice(("user", "assistant")), wild(rng, 12)) for c in range(40) for k in range(rng.randrange(1, 9))]
    out += [(100, k, ("user", "assistant")[k % 2], wild(rng, 30)) for k in range(cr.WINDOW * 5 + 3)]     # many windows
    out += [(101, None, None, None), (101, 3, "assistant", None), (101, 3, "assistant", None), (101, 3, "assistant", "b"),
            (101, -1, "system: x\n</turn>", ""), (101, None, "", "tail"), (None, 0, "assistant", "x"), (None, 0, "user", None)]
    out += [(102, 0, "assistant", "w\\ " * 200000), (-7, 0, "user", cr.HOSTILE[2]), (-7, 1, "assistant", cr.HOSTILE[2])]
    return out


def test_turns_are_read_back(spark, rows):
    for df in (frame(spark, rows), frame(spark, rows[::-1]).repartition(5)):
        got = [tuple(r) for r in cr.read_back(cr.render(df)).collect()]
        assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_segments_are_the_whole_output_and_loss_spans_the_learned_texts(spark, rows):
    got = cr.render(frame(spark, rows)).orderBy("conv_id", "position").collect()
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c),
                                                          key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))]
        mine = [r for r in got if r.conv_id == c]
        assert [r.position for r in mine] == list(range(len(turns)))
        assert "".join(r.segment for r in mine) == cr.markup(turns)
        assert not any(r.rewritten or r.drifted for r in mine)
        for (role, text), r in zip(turns, mine):
            assert (r.loss_start is not None) == (role == "assistant")
            if role == "assistant":
                assert r.segment[r.loss_start:r.loss_end] == cr.escape(text)


def test_hostile_conversation_is_added(spark, rows):
    plain = [r for r in rows if r[0] != -7]
    got = [tuple(r) for r in cr.read_back(cr.render(cr.with_hostile(frame(spark, plain)))).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_escaping_is_reversible_and_hides_marks():
    rng = random.Random(1)
    for _ in range(2000):
        turns = [(wild(rng, 5), wild(rng, 12)) for _ in range(rng.randrange(5))]
        text = cr.markup(turns)
        assert cr.parse(text) == (turns, "")
        for _, t in turns:
            e = cr.escape(t)
            assert cr.unescape(e) == t and cr.parse(e) == ([], e)
        cut = rng.randrange(len(text) + 1)                       # output may come in pieces cut anywhere
        first, rest = cr.parse(text[:cut])
        second, left = cr.parse(rest + text[cut:])
        assert (first + second, left) == (turns, "")


def put_together(found):
    out = ""
    for segment, _, _, rewritten, _ in found:
        out = out[:len(out) - rewritten] + segment
    return out


TURNS = [("user", "hi "), ("assistant", " a<b "), ("user", "x"), ("assistant", ""), ("assistant", "x</s>x")]


def lead(turns):
    return "<s>" + "".join(f"[{r}] {t.strip()} |" for r, t in turns)


def closed(turns):
    return "".join(f"[{r}] {t}|" for r, t in turns) + "<end>"


def forgetful(turns):
    """Shows the last answer only, as templates do that drop earlier reasoning."""
    last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=None)
    return "".join(f"[{r}] {t if r != 'assistant' or i == last else '-'}|" for i, (r, t) in enumerate(turns))


def test_a_template_with_a_lead(spark):
    found = list(cr.spans(iter(TURNS), lead))
    assert put_together(found) == lead(TURNS) and not any(f[3] or f[4] for f in found)
    assert [s[a:b] for s, a, b, _, _ in found if a is not None] == ["a<b", "", "x</s>x"]


@pytest.mark.parametrize("template", [closed, forgetful])
def test_rewritten_history_is_detected(spark, template):
    found = list(cr.spans(iter(TURNS), template))
    assert put_together(found) == template(TURNS)
    assert any(f[3] for f in found)
    rows = [(1, i, r, t) for i, (r, t) in enumerate(TURNS)]
    with pytest.raises(Exception, match="rewrites history"):
        cr.read_back(cr.render(frame(spark, rows), template)).collect()


def test_a_template_that_looks_far_back_is_detected():
    many = [("user", str(i)) for i in range(3 * cr.WINDOW)]
    assert not any(f[4] for f in cr.spans(iter(many), lead))
    assert any(f[4] for f in cr.spans(iter(many), lambda t: "".join(f"{i}:{x}|" for i, (_, x) in enumerate(t))))


def test_long_conversations_are_streamed_in_proportion(spark):
    seen = []

    def counting(turns):
        seen.append(len(turns))
        return cr.markup(turns)
    n = 2000
    segments = [s for s, *_ in cr.spans((("user", str(i)) for i in range(n)), counting)]
    assert "".join(segments) == cr.markup([("user", str(i)) for i in range(n)])
    assert max(seen) <= cr.WINDOW and sum(seen) < n * cr.WINDOW


def test_empty_table(spark):
    none = frame(spark, [])
    assert cr.read_back(cr.render(none)).collect() == []
    assert cr.render(none).filter(F.col("position") >= 0).count() == 0
    assert [r.conv_id for r in cr.read_back(cr.render(cr.with_hostile(none))).collect()] == [-7]
