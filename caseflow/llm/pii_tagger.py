"""PII: rules, and a character-level bidirectional LSTM with CRF transitions.

The base rules (e-mail, IP address, payment card, phone) find spans in whole texts. A small
bidirectional LSTM with a CRF over B/I tags is trained in numpy on labelled spans: those of the base
rules in a bounded sample of windows, with their digits and letters redrawn, so that the tagger learns
shapes and contexts. It adds spans that the rules miss (a phone number without its plus sign, a card
number with other separators); an added card number must pass its check digit too.

The tagger is constrained: a span holds an ``@`` or four digits or more, and never crosses a line. So
only places near a run of digits or an ``@`` need decoding: every other window is all outside by that
constraint. Windows of ``WINDOW`` characters overlap by half; each place takes its tag from the window
where it is farthest from an edge, and the spans of a text are then reconciled as a whole: base spans
stay, added ones must not touch them, or an added one that starts earlier.

Defined results: a null or empty text has no spans. Places are code points, ends exclusive. Repeated
rows are tagged alike. Rows of a null id stay. Texts are read whole, however long. Without a single
labelled span there is no tagger and only base spans are found.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.frames import released, texts_in_slices

KINDS = ("email", "ip", "card", "phone")
WINDOW, HALF = 64, 32
HIDDEN, EMBED, CHARS = 12, 8, 64
MIN_DIGITS = 4

# fixed values: the base patterns. Possessive runs and the look-behind change no match: within a run a
# later start meets the same end.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_ANCHOR = re.compile("[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:                                   # leftmost match: the longest local part before an @
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((0, a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# --- characters and tags: 0 outside, 1 + 2k begins kind k, 2 + 2k continues it -------------------------
_CODE = np.ones(256, np.int64)                       # 0 padding, 1 anything else
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CODE[ord(_c)] = 2 + _i
    _CODE[ord(_c.upper())] = 28 + _i % 4             # capitals need no more than a few codes
for _i, _c in enumerate("0123456789"):
    _CODE[ord(_c)] = 32 + _i % 5
for _i, _c in enumerate(" \n\t.,;:!?@+-()_%/\\'\"#*=<>[]{}|&$"):
    _CODE[ord(_c)] = 37 + min(_i, 26)
TAGS = 1 + 2 * len(KINDS)


def encode(text: str, size: int) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(size, np.int64)
    out[:cp.size] = np.where(cp < 256, _CODE[np.minimum(cp, 255)], 1)
    return out


def _allowed() -> np.ndarray:
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False                     # I-k follows B-k or I-k only
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


_BLOCKED = np.where(_allowed(), 0.0, -1e4).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Tagger:
    """Weights; ``forward`` holds what training needs for the gradients."""
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 5) -> "Tagger":
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        p = {"emb": f(CHARS, EMBED) * 4}
        for d in "fb":
            p["w" + d], p["u" + d] = f(EMBED, 4 * HIDDEN), f(HIDDEN, 4 * HIDDEN)
            p["c" + d] = np.zeros(4 * HIDDEN, np.float32)
            p["c" + d][HIDDEN:2 * HIDDEN] = 1        # remember at first
        p["out"], p["bias"] = f(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32)
        p["bias"][0] = 2
        p["move"], p["first"] = np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32)
        p["last"] = np.zeros(TAGS, np.float32)
        return cls(p)

    def _direction(self, x: np.ndarray, d: str, keep: list | None):
        """x: time x batch x EMBED, in the direction's own order."""
        t, n, _ = x.shape
        z_in = (x.reshape(-1, EMBED) @ self.p["w" + d]).reshape(t, n, -1) + self.p["c" + d]
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((t, n, HIDDEN), np.float32)
        u = self.p["u" + d]
        for i in range(t):
            z = z_in[i] + h @ u
            g = _sigmoid(z[:, :3 * HIDDEN])
            a = np.tanh(z[:, 3 * HIDDEN:])
            before = c
            c = g[:, HIDDEN:2 * HIDDEN] * c + g[:, :HIDDEN] * a
            tc = np.tanh(c)
            if keep is not None:
                keep.append((g, a, before, tc, h))
            h = g[:, 2 * HIDDEN:] * tc
            out[i] = h
        return out

    def emissions(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """batch x time codes -> time x batch x TAGS scores."""
        x = self.p["emb"][codes.T]
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self._direction(x, "f", kf)
        hb = self._direction(x[::-1], "b", kb)[::-1]
        h = np.concatenate((hf, hb), 2)
        if keep is not None:
            keep.update(x=x, h=h, f=kf, b=kb)
        return h @ self.p["out"] + self.p["bias"]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tag sequence of every row (Viterbi)."""
        e = self.emissions(codes)
        move = self.p["move"] + _BLOCKED
        score = e[0] + self.p["first"]
        score[:, 2::2] -= 1e4                        # a window's first place may only begin a span
        back = np.empty((e.shape[0], codes.shape[0], TAGS), np.int8)
        for i in range(1, e.shape[0]):
            s = score[:, :, None] + move
            back[i] = s.argmax(1)
            score = s.max(1) + e[i]
        tag = (score + self.p["last"]).argmax(1)
        out = np.empty(codes.shape, np.int8)
        rows = np.arange(codes.shape[0])
        for i in range(e.shape[0] - 1, -1, -1):
            out[:, i] = tag
            if i:
                tag = back[i, rows, tag]
        return out

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood per row under the CRF, and its gradients."""
        kept: dict = {}
        e = self.emissions(codes, kept).astype(np.float64)
        t, n, _ = e.shape
        y = tags.T.astype(np.int64)
        move = self.p["move"].astype(np.float64) + _BLOCKED
        rows = np.arange(n)
        lse = lambda v, ax: v.max(ax) + np.log(np.exp(v - v.max(ax, keepdims=True)).sum(ax))
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[0] = e[0] + self.p["first"]
        for i in range(1, t):
            alpha[i] = lse(alpha[i - 1][:, :, None] + move, 1) + e[i]
        beta[-1] = self.p["last"]
        for i in range(t - 2, -1, -1):
            beta[i] = lse(move + (e[i + 1] + beta[i + 1])[:, None, :], 2)
        z = lse(alpha[-1] + self.p["last"], 1)
        gold = e[np.arange(t)[:, None], rows, y].sum(0) + self.p["first"][y[0]] + self.p["last"][y[-1]]
        ge = np.exp(alpha + beta - z[:, None])
        g = {"first": ge[0].sum(0), "last": np.exp(alpha[-1] + self.p["last"] - z[:, None]).sum(0)}
        gm = np.zeros((TAGS, TAGS))
        for i in range(1, t):
            gold = gold + move[y[i - 1], y[i]]
            gm += np.exp(alpha[i - 1][:, :, None] + move + (e[i] + beta[i])[:, None, :] - z[:, None, None]).sum(0)
            np.subtract.at(gm, (y[i - 1], y[i]), 1)
        ge[np.arange(t)[:, None], rows, y] -= 1
        np.subtract.at(g["first"], y[0], 1)
        np.subtract.at(g["last"], y[-1], 1)
        g["move"] = gm
        ge = ge.astype(np.float32)
        h = kept["h"]
        g["out"] = h.reshape(t * n, -1).T @ ge.reshape(t * n, -1)
        g["bias"] = ge.sum((0, 1))
        gh = ge @ self.p["out"].T
        gx = self._back("f", gh[:, :, :HIDDEN], kept["x"], kept["f"], g)
        gx += self._back("b", gh[::-1, :, HIDDEN:], kept["x"][::-1], kept["b"], g)[::-1]
        g["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(g["emb"], codes.T, gx)
        return float((z - gold).mean()), {k: (v / n).astype(np.float32) for k, v in g.items()}

    def _back(self, d: str, gh: np.ndarray, x: np.ndarray, kept: list, g: dict) -> np.ndarray:
        t, n, _ = gh.shape
        u = self.p["u" + d]
        gz = np.empty((t, n, 4 * HIDDEN), np.float32)
        gu = np.zeros_like(u)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for i in range(t - 1, -1, -1):
            gate, a, before, tc, h = kept[i]
            dh = dh + gh[i]
            gi, gf, go = gate[:, :HIDDEN], gate[:, HIDDEN:2 * HIDDEN], gate[:, 2 * HIDDEN:]
            dc = dc + dh * go * (1 - tc * tc)
            z = gz[i]
            z[:, :HIDDEN] = dc * a * gi * (1 - gi)
            z[:, HIDDEN:2 * HIDDEN] = dc * before * gf * (1 - gf)
            z[:, 2 * HIDDEN:3 * HIDDEN] = dh * tc * go * (1 - go)
            z[:, 3 * HIDDEN:] = dc * gi * (1 - a * a)
            gu += h.T @ z
            dh = z @ u.T
            dc = dc * gf
        g["u" + d] = gu
        g["w" + d] = x.reshape(t * n, -1).T @ gz.reshape(t * n, -1)
        g["c" + d] = gz.sum((0, 1))
        return (gz.reshape(t * n, -1) @ self.p["w" + d].T).reshape(t, n, -1)


_KIND_TEXT = {"letters": "abcdefghijklmnopqrstuvwxyz", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789"}


def _redraw(s: str, rng: np.random.Generator) -> str:
    """The same shape with other letters and digits (a span keeps its kind, though not its check digit)."""
    out = []
    for ch in s:
        for pool in _KIND_TEXT.values():
            if ch in pool:
                ch = pool[int(rng.integers(len(pool)))]
                break
        out.append(ch)
    return "".join(out)


def examples(windows: list[str], copies: int = 2, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of windows: as they are, and ``copies`` times with their spans redrawn, in one of
    them a phone number without its plus sign."""
    rng = np.random.default_rng(seed)
    codes, tags = [], []
    for w in windows:
        w = w[:WINDOW]
        spans, last = [], 0
        for k, a, b in sorted(base_spans(w), key=lambda s: (s[1], -s[2])):
            if a >= last:
                spans.append((k, a, b))
                last = b
        for copy in range(1 + (copies if spans else 0)):
            text, marks, at = "", [], 0
            for k, a, b in spans:
                s = w[a:b]
                if copy:
                    s = _redraw(s, rng)
                    s = s[1:] if k == 3 and copy == 2 and s[0] == "+" else s
                text += w[at:a]
                marks.append((k, len(text), len(text) + len(s)))
                text, at = text + s, b
            text = (text + w[at:])[:WINDOW]
            y = np.zeros(WINDOW, np.int64)
            for k, a, b in marks:
                y[a:b] = 2 + 2 * k
                y[a] = 1 + 2 * k
            codes.append(encode(text, WINDOW))
            tags.append(y)
    return np.array(codes).reshape(-1, WINDOW), np.array(tags).reshape(-1, WINDOW)


def train(windows: list[str], steps: int = 200, batch: int = 48, rate: float = 0.02, seed: int = 9) -> Tagger | None:
    """Adam on batches of windows; None if no window has a span."""
    codes, tags = examples(windows)
    if not len(codes) or not tags.any():
        return None
    rng = np.random.default_rng(seed)
    model = Tagger.fresh()
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        at = rng.integers(0, len(codes), batch)
        _, g = model.gradients(codes[at], tags[at])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * v
            s[k] = 0.999 * s[k] + 0.001 * v * v
            model.p[k] = model.p[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def sample_windows(docs: DataFrame, rows: int = 1500) -> list[str]:
    """At most ``rows`` windows of ``WINDOW`` characters, one from each of as many texts with an anchor,
    chosen by a hash of the text: a random shift places the first anchor somewhere in the window."""
    shift = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(HALF))
    at = F.regexp_instr("text", F.lit("@|[0-9]{4}|[0-9]+[.][0-9]+[.][0-9]"))
    got = (docs.select("text").filter(F.col("text").rlike("@|[0-9]{4}|[0-9]+[.][0-9]+[.][0-9]"))
           .select(F.substring("text", F.greatest(at - shift, F.lit(1)).cast("int"), F.lit(WINDOW)).alias("w"))
           .distinct().orderBy(F.xxhash64("w"), "w").limit(rows).collect())
    return [r["w"] for r in got]


def fit(docs: DataFrame, rows: int = 1500, **kw) -> Tagger | None:
    return train(sample_windows(docs, rows), **kw)


def _starts(text: str, first: int, last: int) -> range:
    return range(first, max(first + 1, last - HALF + 1), HALF)


def _regions(text: str) -> list[tuple[int, int]]:
    """Places near an anchor (an @, or a run that holds four digits), merged where they meet."""
    out: list[list[int]] = []
    for m in _NEAR.finditer(text):
        a, b = max(0, m.start() - HALF), min(len(text), m.end() + HALF)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_NEAR = re.compile(r"@|[0-9](?:[ ().+-]{0,3}[0-9]){3,}+|[0-9]+(?:\.[0-9]+){3}")


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], model: Tagger | None,
                batch: int = 512) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of each text, reconciled with its base spans."""
    if model is None:
        return [[] for _ in texts]
    jobs = []                                          # (text, region start, region end, window start)
    for i, t in enumerate(texts):
        if _ANCHOR.search(t):
            for a, b in _regions(t):
                jobs += [(i, a, b, s) for s in _starts(t, a, b)]
    tags: dict[tuple[int, int], np.ndarray] = {}
    for k in range(0, len(jobs), batch):
        part = jobs[k:k + batch]
        got = model.decode(np.array([encode(texts[i][s:min(s + WINDOW, b)], WINDOW) for i, a, b, s in part]))
        for (i, a, b, s), y in zip(part, got):
            line = tags.setdefault((i, a), np.zeros(b - a, np.int8))
            # overlapping windows: a place's tag comes from the window where it is farthest from an edge
            lo = s if s == a else s + HALF // 2
            hi = min(s + WINDOW, b) if s + WINDOW >= b else s + WINDOW - HALF // 2
            line[lo - a:hi - a] = y[lo - s:hi - s]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, a), line in sorted(tags.items()):
        t = texts[i]
        at = 0
        on = np.flatnonzero(line)
        while at < on.size:
            j = int(on[at])
            kind = (int(line[j]) - 1) // 2
            e = j + 1
            while e < line.size and line[e] == 2 + 2 * kind:
                e += 1
            at = int(np.searchsorted(on, e))
            s, f = a + j, a + e
            piece = t[s:f]
            if "\n" in piece or line[j] % 2 == 0:      # a tail without its beginning
                continue
            digits = sum(c.isdigit() and c.isascii() for c in piece)
            good = ("@" in piece[1:-1] if kind == 0 else piece.count(".") >= 3 and digits >= MIN_DIGITS if kind == 1
                    else 13 <= digits <= 19 and _luhn("".join(_DIGIT.findall(piece))) if kind == 2
                    else 9 <= digits <= 15 and digits < len(piece))
            edge = (s and t[s - 1].isalnum()) or (f < len(t) and t[f].isalnum())
            taken = base[i] + out[i]
            if good and not edge and all(f <= x or s >= y for _, x, y in taken):
                out[i].append((kind, s, f))
    return out


def spans_of(texts: list[str | None], model: Tagger | None):
    known = [t or "" for t in texts]
    base = [base_spans(t) for t in known]
    return base, added_spans(known, base, model)


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (kind:start:end, comma-joined), spans (with added ones)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)      # a few thousand weights
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"]
    line = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))

    def run(batches):
        m = shared.value
        for batch in batches:
            for i, j, texts in texts_in_slices(batch, "text", 1 << 21):
                base, more = spans_of(texts, m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i)]
                    + [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
                    + [pa.array([line(b) for b in base], pa.string()),
                       pa.array([line(b + x) for b, x in zip(base, more)], pa.string())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        released(run), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")


def redact(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """All rows and columns of ``docs``, every span of ``text`` replaced by ``<KIND>`` (overlapping ones by the
    first's kind) and ``n_chars``, where there is such a column, set to the new length."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, schema = docs.columns.index("text"), docs.schema
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def mask(text, spans):
        if text is None or not spans:
            return text
        out, last, done = [], 0, 0
        for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [text[last:a], f"<{KINDS[k].upper()}>"]
            last = done = max(done, b)
        return "".join(out) + text[last:]

    def run(batches):
        m = shared.value
        for batch in batches:
            one = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            for i, j, texts in texts_in_slices(one, "text", 1 << 21):
                base, more = spans_of(texts, m)
                new = [mask(t, b + x) for t, b, x in zip(texts, base, more)]
                part = batch.slice(i, j - i)
                cols = list(part.columns)
                cols[at] = pa.array(new, cols[at].type)
                if size is not None and pa.types.is_integer(cols[size].type):
                    old = cols[size].to_pylist()
                    cols[size] = pa.array([o if n == t or o is None else len(n) for o, n, t in zip(old, new, texts)],
                                          cols[size].type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(released(run), schema)
