"""The operators against brute-force versions, on small tables with nulls, empty and long texts, ties,
repeated rows, extra columns with clashing names, and empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import langid, ngram_join, pair_quality, pii_tagger, qgram_filter, robust_rules, secret_links, \
    sp_tokens, url_templates, warc_writer
from caseflow.llm.textops import shingle_sets

WORDS = [a + b for a in "ba de ki lo mu na pe ri so tu".split() for b in "ra te mi no pu".split()]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, score double, label int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(texts):
    return [(i, t, "xx", "s", len(t or ""), "clash", 0.5, 1) for i, t in texts]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    base = [prose(rng, n) for n in (60, 60, 200, 40, 9, 4, 1)]
    texts = list(enumerate(base))
    texts += [(10, base[0]), (11, base[0].upper()), (12, base[0] + " extra words here"), (13, "x " + base[2][:-30])]
    near = base[1].split()
    near[30] = "zzz"
    texts += [(14, " ".join(near)), (15, None), (16, ""), (17, " \n\t "), (18, prose(rng, 30000)), (0, base[0]),
              (19, "one two"), (20, "ONE\ttwo"), (21, "[*#$] !!" * 30), (None, base[3])]
    return texts


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), DOCS)


# --- 9 ------------------------------------------------------------------------------------------------

def brute_components(texts):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    sets = [grams(t) for _, t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    out = []
    for i, (d, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if label[j] == label[i] and texts[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_ngram_join_is_the_brute_force_one(spark, corpus):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(frame(spark, corpus)).collect()]
    assert sorted(got, key=key) == sorted(brute_components(corpus), key=key)


def test_ngram_join_with_frequent_tokens(spark, monkeypatch):
    """Near copies and a shared passage, with tokens called frequent early, so that combinations and heavy sets occur."""
    rng = random.Random(8)
    start, passage = prose(rng, 80).split(), prose(rng, 50)
    texts = []
    for i in range(60):
        w = list(start)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"e{i}"
        texts.append((i, " ".join(w)))
    texts += [(100 + i, passage + " " + prose(rng, rng.choice((8, 14, 25)))) for i in range(40)]
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    for light in (3, 32):
        monkeypatch.setattr(ngram_join, "LIGHT", light)
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(frame(spark, texts)).collect()]
        assert sorted(got) == sorted(brute_components(texts))


def test_keep_one_leaves_a_row_of_each_component(spark, corpus):
    kept = ngram_join.keep_one(frame(spark, corpus))
    assert kept.columns == frame(spark, corpus).columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for d, _, c in brute_components(corpus) if d is not None and d == c})


def test_keep_one_with_repeated_and_null_ids(spark):
    rng = random.Random(31)
    t = [prose(rng, 40) for _ in range(7)]
    near = t[2].split()
    near[5] = "zzz"
    texts = [(1, t[0]), (1, t[1]), (1, t[2]), (1, t[2]),             # an id with three texts, one of them twice
             (0, " ".join(near)),                                    # ... and one of them a copy of a lower id's
             (2, t[3]), (None, t[3]),                                # a copy without an id goes
             (None, t[4]), (None, t[4].upper()), (None, t[4]),       # one of several copies without an id stays
             (None, t[5]), (None, None), (None, ""), (3, ""), (3, ""), (3, None), (4, t[6]), (5, t[6])]
    want = sorted([(1, t[0]), (1, t[1]), (0, " ".join(near)), (2, t[3]), (None, t[4]), (None, t[5]),
                   (None, None), (None, ""), (3, ""), (3, None), (4, t[6])], key=key)
    for df in (frame(spark, texts), frame(spark, texts[::-1]).repartition(3)):
        kept = ngram_join.keep_one(df).collect()
        assert sorted(((r.doc_id, r.text and r.text.lower()) for r in kept), key=key) == want


def test_parity_never_rules_out_a_link():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2 ** 63, int(rng.integers(2, 400))).astype(np.uint64))
        b = np.concatenate((a[int(rng.integers(0, a.size // 7 + 1)):], rng.integers(0, 2 ** 63, int(rng.integers(0, a.size // 8 + 1))).astype(np.uint64)))
        b = np.unique(b)
        both = np.intersect1d(a, b).size
        if 4 * both >= 3 * (a.size + b.size - both):
            assert ngram_join.may_link(ngram_join.parity(a), ngram_join.parity(b), a.size + b.size)


def test_shingles_equal_words_in_any_chunk():
    texts = [b"A b c d e f", b"", None, b"a B c D e F", "é ß".encode(), b"w" * 9000 + b" x", b"w" * 4999 + b"v" + b"w" * 4000 + b" x"]
    s = shingle_sets(texts)
    assert [x.size for x in s] == [2, 0, 0, 2, 1, 1, 1]
    assert (s[0] == s[3]).all() and s[5][0] != s[6][0]
    assert (shingle_sets(texts[4:5])[0] == s[4]).all()


# --- 7 ------------------------------------------------------------------------------------------------

def least_edits(p, t):
    """Edits of p against the best part of t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_qgram_filter_finds_what_alignment_finds(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, 30)) for i in range(6)] + [(6, "short one here ok"), (7, None), (8, ""), (9, "tiny")]
    items.append((10, items[0][1]))
    docs = []
    for i in range(40):
        t = prose(rng, 20)
        if i % 2:
            s = list(items[rng.randrange(6)][1][rng.randrange(10):][:rng.choice((50, 64, 90, 140))])
            for _ in range(rng.randrange(6)):
                s[rng.randrange(len(s))] = rng.choice(["", "q", "zz", " ", "\n "])
            t = t + " " + "".join(s).upper() + " " + prose(rng, 30)
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "say SHORT  one here\nok now"), (None, items[1][1]), (103, prose(rng, 60000) + items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = qgram_filter.search(frame(spark, docs), bench, block_chars=300, stride=32)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    flat = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t.lower())
    want = set()
    for d, t in docs[:-1]:
        for i, x in items:
            x = flat(x or "")
            if len(x) < qgram_filter.Q or not t:
                continue
            m = qgram_filter.SEGMENT
            parts = [x] if len(x) <= m else [x[s:s + m] for s in [*range(0, len(x) - m, 32), len(x) - m]]
            for p in parts:
                k = int(qgram_filter.EDIT_RATE * len(p))
                while k and len(p) - 11 - 12 * k < 1:
                    k -= 1
                if least_edits(p, flat(t)) <= k:
                    want.add((d, i))
    assert {f for f in found if f[0] != 103} == want and (103, 2) in found
    clean = qgram_filter.drop_contaminated(frame(spark, docs), bench, stride=32)
    assert clean.columns == frame(spark, docs).columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want} - {103}


def test_qgram_filter_finds_fragments_at_every_place(spark):
    """Fragments of a segment's length from every place of the items, exact and edited, against the alignment of every segment."""
    rng = random.Random(21)
    items = [(i, prose(rng, 40)) for i in range(3)] + [(3, "only a short item, " + prose(rng, 3))]
    docs = []
    for i, x in items[:3]:
        for s in range(0, len(x) - 64, 7):
            f = list(x[s:s + 64 + s % 5])
            for _ in range(s % 6):
                f[rng.randrange(len(f))] = rng.choice(["", "q", "zz"])
            docs.append((len(docs), prose(rng, 12) + " " + "".join(f) + " " + prose(rng, 12)))
    docs += [(len(docs) + i, x) for i, x in enumerate([items[3][1], prose(rng, 10) + items[3][1].upper() + "x", prose(rng, 80)])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in qgram_filter.search(frame(spark, docs), bench).collect()}
    clean = {r.doc_id for r in qgram_filter.drop_contaminated(frame(spark, docs), bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in found}

    def edits(k, x):
        m, t = min(64, len(x)), docs[k][1].lower()
        return min(least_edits(x[s:s + m], t) for s in range(len(x) - m + 1))
    # all texts against their own item, and some against the others
    for d, text in docs:
        for i, x in items:
            if any(x[s:s + 12] in text.lower() for s in range(0, len(x) - 11)) or d % 40 == 0:
                k = min(int(0.05 * min(64, len(x))), (min(64, len(x)) - 12) // 12)
                assert ((d, i) in found) == (edits(d, x) <= k), (d, i)
    assert {d for d, _ in found} >= {d for d, t in docs if any(t.lower().find(x[s:s + 64]) >= 0 for _, x in items for s in range(max(1, len(x) - 63)))}


# --- 6 ------------------------------------------------------------------------------------------------

def brute_pii(t):
    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split("."))
                    or k == 2 and 13 <= len(digits) <= 19 and luhn or k == 3 and 9 <= len(digits) <= 15):
                out.append((k, m.start(), m.end()))
    return out


PIECES = ["a", "b.", "@", "1", "23", ".", "-", "+", "(", ")", " ", "255", "256", "4", "é", "\n", "@x.y", "0", "4111111111111111", "+1 (555) 010-9999"]


def test_pii_base_spans_are_the_patterns():
    rng = random.Random(1)
    for _ in range(8000):
        t = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 30)))
        assert pii_tagger.base_spans(t) == brute_pii(t)


def test_pii_tagger_gradients_and_decoding():
    rng = np.random.default_rng(0)
    m = pii_tagger.Tagger.fresh()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    codes, tags = pii_tagger.examples(["mail bob.x@a.example.com now", "no data in here"], copies=1)
    codes, tags = codes[:, :32], tags[:, :32]
    _, g = m.gradients(codes, tags)
    for name in ("wf", "ub", "out", "move", "first", "emb"):
        at = tuple(int(rng.integers(s)) for s in m.p[name].shape)
        if name == "move":
            at = (0, 1)
        old, eps = m.p[name][at], 1e-3
        m.p[name][at] = old + eps
        up, _ = m.gradients(codes, tags)
        m.p[name][at] = old - eps
        down, _ = m.gradients(codes, tags)
        m.p[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-2 * max(1, abs(g[name][at]))


def test_pii_tagger_learns_adds_and_redacts(spark):
    rng = random.Random(6)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    windows = []
    for i in range(300):
        what = (f"{prose(rng, 1)}.{d(2)}@mail{d(1)}.example.com", f"+1 ({d(3)}) 555-{d(4)}", f"10.{d(2)}.1.{d(2)}")[i % 3]
        windows.append((prose(rng, 3) + " " + what + " " + prose(rng, 6))[:pii_tagger.WINDOW])
    model = pii_tagger.train(windows, steps=150)
    texts = ["call 1 (555) 555-1234 or +1 (555) 555-1234 today", "mail a.b@x.example.com", None, "", "no data here at all " * 4000]
    base, more = pii_tagger.spans_of(texts, model)
    assert [b for b in base] == [brute_pii(t or "") for t in texts]
    for b, x, t in zip(base, more, texts):
        for k, s, e in x:
            assert t and all(e <= a or s >= z for _, a, z in b)
    codes, tags = pii_tagger.examples(windows[:60], copies=0)
    found = model.decode(codes)
    assert (found[tags > 0] == tags[tags > 0]).mean() > 0.9 and (found[tags == 0] > 0).mean() < 0.05
    df = frame(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in pii_tagger.redact(df, None).collect()}
    assert got[1].text == "mail <EMAIL>" and got[1].n_chars == len(got[1].text) and got[2].text is None and got[3].text == ""
    assert got[4].text == texts[4]
    out = {r.doc_id: r for r in pii_tagger.find(df, model).collect()}
    assert out[1].n_email == 1 and out[1].base == "email:5:22" and out[2].spans == "" and out[0].n_phone == 1


def test_pii_without_spans_has_no_tagger():
    assert pii_tagger.train(["nothing here"]) is None


# --- 1, 3, 5 ------------------------------------------------------------------------------------------

def test_langid_learns_and_rejects(spark):
    rng = random.Random(3)
    sound = {"aa": "ka ro mi ta ne", "bb": "sch ung icht ein ver", "cc": "eau oui tre ment que"}
    docs = [(i, " ".join("".join(rng.choice(sound[g].split()) for _ in range(2)) for _ in range(rng.randrange(3, 40))), g, "s", 1, "", 0.1, 1)
            for i in range(450) for g in [("aa", "bb", "cc")[i % 3]]]
    docs += [(900, None, "aa", "s", 1, "", 0.1, 1), (901, "", None, "s", 1, "", 0.1, 1), (902, "123 !!", "aa", "s", 1, "", 0.1, 1),
             (903, "kami " * 400000, "aa", "s", 1, "", 0.1, 1)]
    df = spark.createDataFrame(docs, DOCS)
    model = langid.fit(df, F.col("doc_id") % 4 != 2)
    out = {r.doc_id: r for r in langid.identify(df.select("doc_id", "text"), model, ["doc_id"],
                                                "doc_id long, lang_pred string, score double, accepted boolean").collect()}
    held = [d for d in docs[:450] if d[0] % 4 == 2]
    assert sum(out[d[0]].lang_pred == d[2] for d in held) / len(held) > 0.95
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and not out[i].accepted for i in (900, 901, 902))
    assert out[903].lang_pred == "aa" and all(0 <= r.score <= 1 for r in out.values())
    z, n = model.logits(["kami roka " * 50], piece=37)
    y, k = model.logits(["kami roka " * 50])
    assert np.allclose(z, y) and (n == k).all()                       # pieces change nothing
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect())
    empty = langid.fit(df.limit(0), F.lit(True))
    assert empty.predict(["abc", None])[0] == ["und", "und"]


def test_langid_rejects_unlearned_gibberish_and_mixed_texts(spark):
    rng = random.Random(12)
    sound = {"aa": "ka ro mi ta ne po", "bb": "sch ung icht ein ver ach", "cc": "eau oui tre ment que ion"}
    say = lambda g, n: " ".join("".join(rng.choice(sound[g].split()) for _ in range(2)) for _ in range(n))
    docs = [(i, say(g, rng.randrange(3, 60)), g, "s", 1, "", 0.1, 1) for i in range(900) for g in [("aa", "bb", "cc")[i % 3]]]
    sound["dd"] = "wyk gdz szc prz olu ibj"
    odd = [say("dd", 40) for _ in range(30)]
    odd += [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)) for _ in range(30)]
    odd += ["мы не учили этого языка никогда " * 3] * 10
    mixed = [say("aa", 40) + " " + say("bb", 40) + " " + say("cc", 40) for _ in range(30)]
    df = spark.createDataFrame(docs + [(1000 + i, t, None, "s", 1, "", 0.1, 1) for i, t in enumerate(odd + mixed)], DOCS)
    model = langid.fit(df, F.col("doc_id") % 4 != 2)
    kept = {r.doc_id for r in langid.keep_identified(df, model).collect()}
    held = [d[0] for d in docs if d[0] % 4 == 2]
    assert len(kept & set(held)) / len(held) > 0.95
    assert not any(1000 + i in kept for i in range(len(odd)))
    assert sum(1000 + len(odd) + i in kept for i in range(len(mixed))) < len(mixed) / 2


def test_pair_quality_ranks_and_cuts(spark):
    rng = random.Random(5)
    docs = [(i, prose(rng, 60) if i % 4 else prose(rng, 30).replace(" ", "*** ").upper(), "xx", "s", 1, "", 0.1, 1) for i in range(400)]
    docs += [(1000, None, "xx", "s", 1, "", 0.1, 1), (1001, "", "xx", "s", 1, "", 0.1, 1)]
    df = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)] + [(3, None, 0), (None, 1, 0), (4, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    model = pair_quality.fit(df, labels, F.col("doc_id") % 5 == 0)
    out = {r.doc_id: r for r in pair_quality.rate(df, model).collect()}
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    assert all(out[i].predicted == int(i % 4 > 0) for i in range(300, 400))
    assert pair_quality.fit(df, labels.limit(0), F.lit(False)) is None
    assert {r.score for r in pair_quality.rate(df.limit(3), None).collect()} == {0.5}


def brute_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    win = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(win) if win.count(w) > 1 for k in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))


def test_robust_rules_counts_and_outliers(spark):
    rng = random.Random(7)
    few = WORDS[:4]
    texts = [(i, "\n".join(" ".join(rng.choice(few + ["é", "a b", "#x"]) for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(1, 9))))
             for i in range(150)]
    texts += [(200, None), (201, ""), (202, "a b c d e " * 3), (203, "\n\n x\n x")]
    plain = [(1000 + i, prose(rng, rng.randrange(30, 90))) for i in range(150)]
    odd = [(2000, prose(rng, 60).replace(" ", "*** ")), (2001, " ".join(w * 9 for w in prose(rng, 60).split()))]
    out = {r.doc_id: r for r in robust_rules.judge(frame(spark, texts + plain + odd)).collect()}
    for i, t in texts:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert all(out[i].kept for i, _ in plain) and not out[2000].kept and not out[2001].kept
    assert robust_rules.judge(frame(spark, texts).limit(0)).count() == 0


def test_robust_rules_reject_a_cluster_in_each_statistic(spark):
    """A fifth of a group are outliers; each of them in one statistic only."""
    rng = random.Random(9)
    lines = lambda t, n: "\n".join(" ".join(w) for w in np.array_split(t.split(), n))
    plain = [(i, lines(prose(rng, rng.randrange(200, 400)), 10)) for i in range(200)]
    odd = [(1000 + i, " ".join(w + "xyz" for w in prose(rng, 300).split())) for i in range(10)]        # word length
    odd += [(1100 + i, prose(rng, 14)) for i in range(10)]                                             # size
    odd += [(1200 + i, prose(rng, 240) + " " + " ".join([prose(rng, 27)] * 2)) for i in range(10)]     # 18% repeated
    odd += [(1300 + i, prose(rng, 280) + "\nso\nna" * 8) for i in range(10)]                           # duplicate lines
    odd += [(1400 + i, re.sub("r", "#", prose(rng, 300), count=70)) for i in range(10)]                # symbols
    out = {r.doc_id: r for r in robust_rules.judge(frame(spark, plain + odd)).collect()}
    assert sum(out[i].kept for i, _ in plain) >= 0.98 * len(plain)
    assert not any(out[i].base_failed for i, _ in odd)
    assert [i for i, _ in odd if out[i].kept] == []


def test_chi_square_quantiles():
    assert abs(robust_rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(robust_rules.chi2_quantile(0.5, 2) - 1.38629) < 1e-4


# --- 2, 4, 8 ------------------------------------------------------------------------------------------

def test_warc_round_trip_is_deterministic(spark, tmp_path):
    big = "x" * 1500
    pages = [(i, f"http://h/{i}", big if i % 3 == 0 else f"<p>{i}</p>é" * (i + 1)) for i in range(60)]
    pages += [(5, None, None), (None, "http://n/\r\nX: y", "z" * 3000), (59, "u", ""), (57, "again", big), (-7, "n", big)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    folders = [str(tmp_path / x) for x in "ab"]
    made = [warc_writer.write(d, f, shard_bytes=20000, roll_bytes=3000) for d, f in zip((df, df.repartition(5)), folders)]
    assert made[0] == made[1] and len(made[0]) > 3 and sum(e["records"] for e in made[0]) == len(pages)
    got = [tuple(r) for r in warc_writer.read(spark, folders[0]).collect()]
    size = lambda h: len((h or "").encode())
    assert sorted((x[0], x[1], x[2]) for x in got if x[0] is not None) == sorted(
        (p, size(h), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in pages if p is not None)
    same = [x for x in got if x[1] == 1500]
    assert [x[0] for x in same if x[3] == "response"] == [57] and {x[4] for x in same if x[3] == "revisit"} == {57}
    assert all(x[3] == "response" for x in got if x[1] != 1500)
    assert warc_writer.write(df.limit(0), str(tmp_path / "c")) == [] and warc_writer.read(spark, str(tmp_path / "c")).count() == 0
    with pytest.raises(ValueError):
        warc_writer.parse(warc_writer.record(1, "u", b"abc").replace(b"abc", b"abd"))


def test_secret_links(spark):
    key_id, hexes, mixed = "AKIA" + "Z9" * 8, "0123456789abcdef" * 2, "aB3" * 12
    texts = [f"é PassWord = \"{'p' * 12}\" and {hexes}", f"{key_id} then {mixed}", f"{mixed} alone", "ASIAABCDEFGH alone",
             f"ASIAABCDEFGH near {hexes}", f"{key_id} {hexes} https://a.example.com/x", "https://a.example.com/x only",
             f"{key_id} {'w ' * 120} {mixed}", "secret=token:abcdefghijklmn", "token=short", None, "", f"token={mixed}"]
    docs = frame(spark, list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])])
    got = secret_links.scan(docs).collect()
    r = {x.doc_id: x for x in got}
    kinds = {i: [s.split(":")[0] for s in x.spans.split(",") if s] for i, x in r.items()}
    assert r[0].spans == f"assign:2:{2 + len('PassWord = ') + 13},hex:{texts[0].index(hexes)}:{len(texts[0])}"
    assert kinds[1] == ["access", "key"] and kinds[2] == [] and kinds[3] == [] and kinds[4] == ["id", "hex"]
    assert kinds[5] == ["access", "hex", "endpoint"] and kinds[6] == [] and kinds[7] == ["access"] and kinds[8] == []
    assert kinds[9] == kinds[10] == kinds[11] == [] and kinds[12] == ["assign"]
    assert len(got) == 15 and sum(x.doc_id == 0 and x.n_hex == 1 for x in got) == 2 and kinds[None] == ["access", "key"]
    assert secret_links.scan(docs.limit(0)).count() == 0


def test_url_templates(spark):
    urls = [f"http://a.example.com/de/{i}" for i in range(30)] + [f"http://a.example.com/en/{i}" for i in range(60)]
    urls += ["https://X.NET/p", "https://x.net", "http://m.example.net/en/1?q", "http://w.org/fr/1", "no scheme", None, "", "http://a.example.com"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    r = {x.page_id: x for x in url_templates.judge(pages.select("page_id", "url", F.col("host").alias("rule"))).collect()}
    assert all(r[i].rule == "example.com/de/" and r[i].verdict == "block" for i in range(30))
    assert all(r[i].rule is None and r[i].verdict == "allow" for i in range(30, 90))
    assert [r[i].rule for i in range(90, 98)] == ["net/", None, "example.net/en/", "org/fr/", None, None, None, None]
    assert (r[90].host, r[90].path, r[91].path, r[92].path, r[94].host) == ("x.net", "/p", "", "/en/1", "")
    assert url_templates.judge(pages.limit(0)).count() == 0


def test_url_templates_reject_by_purity(spark):
    """Pages that no rule names fall under a template that is almost always blocked."""
    rules = (("block", "h", "/x/"),)
    urls = [f"http://h/x/{i}/a" for i in range(40)] + ["http://h//x/7/a", "http://h/y/1/a", "http://h/y/2/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    r = {x.page_id: x for x in url_templates.judge(pages, rules).collect()}
    assert r[40].rule is None and r[40].verdict == "block" and r[41].verdict == r[42].verdict == "allow"


# --- 10 -----------------------------------------------------------------------------------------------

ODD = ["", None, "  a  b ", "日本語🎉 ok\n\n tab\t\x00x ▁▁a ▁", " ", "aaa aaaa aaaaaaa", "<s> </s> <0x0A> <unk>", "é" * 50, "======= ...\n\n --"]


def test_sp_tokens_parity(spark, corpus):
    import sentencepiece
    theirs = sentencepiece.SentencePieceProcessor(model_file=sp_tokens.DEFAULT_MODEL)
    texts = [(i, t) for i, t in enumerate([t for _, t in corpus] + ODD)]
    out = {r.doc_id: r for r in sp_tokens.tokenize(frame(spark, texts), sp_tokens.read_model()).collect()}
    for i, t in texts:
        assert out[i].ids == theirs.encode(t or "") and out[i].n_tokens == len(out[i].ids) and out[i].round_trip


def unigram_model(squeeze):
    """A small unigram model in the format, with byte pieces."""
    def field(n, v):
        if isinstance(v, int):
            return bytes([n << 3]) + (bytes([v]) if v < 128 else bytes([v & 127 | 128, v >> 7])) if n < 16 else bytes([n << 3 & 127 | 128, n >> 4, v])
        if isinstance(v, float):
            import struct
            return bytes([n << 3 | 5]) + struct.pack("<f", v)
        return bytes([n << 3 | 2]) + (bytes([len(v)]) if len(v) < 128 else bytes([len(v) & 127 | 128, len(v) >> 7])) + v
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, -s, 1) for p, s in (("▁", 3.0), ("a", 4.0), ("b", 4.5), ("ab", 5.0), ("▁a", 5.5), ("▁ab", 6.0), ("ba", 7.0), ("▁▁", 6.5))]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    out += field(2, field(3, 1) + field(4, len(pieces)) + field(35, 1))
    return out + field(3, field(1, b"identity") + field(3, 1) + field(4, int(squeeze)) + field(5, 1))


@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_parity(squeeze):
    import sentencepiece
    data = unigram_model(squeeze)
    theirs, ours = sentencepiece.SentencePieceProcessor(model_proto=data), sp_tokens.Encoder(data)
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "b", " ", "ab", "  ", "é", "\n"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    normal = [ours.normalise(t) for t in texts]
    ids = ours.encode(normal)
    assert ids == [theirs.encode(t) for t in texts]
    assert ours.decode(ids) == [theirs.decode(i) for i in ids] == [ours.expected(n) for n in normal]


def test_decode_equals_the_library():
    """Any ids, among them byte pieces that are no valid text, the unknown piece and markers in a row."""
    ours = sp_tokens.Encoder(sp_tokens.read_model())
    rng = random.Random(4)
    n = len(ours.spec.pieces)
    lists = [[rng.choice([rng.randrange(n), rng.randrange(260), rng.randrange(3, 259)]) for _ in range(rng.randrange(9))]
             for _ in range(400)] + [[], [0], [ours.library.token_to_id(sp_tokens.SPACE)] * 3]
    lists += ours.encode([ours.normalise(t) for t in ("a\nb", "  x  ", "漢字 ▁ é", "")])
    for x in lists:
        assert ours.decode([x]) == ours.library.decode_batch([x], skip_special_tokens=False)
    assert ours.decode(lists) == ours.library.decode_batch(lists, skip_special_tokens=False)


def test_long_texts_are_cut_at_word_starts(corpus):
    ours = sp_tokens.Encoder(sp_tokens.read_model(), cached_words=50)
    plain = sp_tokens.Encoder(sp_tokens.read_model())
    for t in [" ".join(t or "" for _, t in corpus)[:30000], "x" * 3000, " " * 3000, "a  b   c " * 300, ""]:
        normal = plain.normalise(t)
        cut = list(ours.pieces(normal, 40))
        assert "".join(cut) == normal
        assert sum(plain.encode(cut), []) == plain.encode([normal])[0] == ours.encode([normal])[0]
