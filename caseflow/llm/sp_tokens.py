"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (its wire format needs a few lines), and an equal tokenizer is
rebuilt: the character map and white-space rules of the normaliser, the metaspace marker, unigram
scores or, for byte-pair models, the merges implied by the scores, and byte fallback. Batches are
encoded by the library's threads. Where no piece of the vocabulary has the marker after another
character, no merge can cross a word's start, so texts are split there, the words not met lately
are encoded in multithreaded batches, and the others come from a bounded cache (same tokens). Ids are
kept as packed 32-bit integers, and a long text is cut into words piece by piece.

Defined results: a null or empty text has no tokens and decodes to the empty string. Bytes of
characters outside the vocabulary become byte pieces where the model has them, else the unknown
piece. Repeated rows are encoded alike; texts are encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseflow.llm.frames import released, texts_in_slices

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6      # fixed values: piece types of the format


def _fields(data: bytes):
    """(field number, value) of a protobuf message; nested messages and strings as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, data[at:at + size]
            at += size
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at:at + size]
            at += size
        else:
            raise ValueError(f"unknown wire type {kind}")


@dataclass
class Spec:
    """What encoding needs of a model file."""
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = 1                    # 1 unigram, 2 byte-pair
    byte_fallback: bool = False
    suffix_marker: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True


def parse(data: bytes) -> Spec:
    s = Spec()
    for number, value in _fields(data):
        if number == 1:
            m = dict(_fields(value))
            s.pieces.append((m.get(1, b"").decode(), struct.unpack("<f", m[2])[0] if 2 in m else 0.0, m.get(3, NORMAL)))
        elif number == 2:
            m = dict(_fields(value))
            s.model_type = m.get(3, 1)
            s.byte_fallback = bool(m.get(35, 0))
            s.suffix_marker = bool(m.get(24, 0))
        elif number == 3:
            m = dict(_fields(value))
            s.charsmap = m.get(2, b"")
            s.dummy_prefix = bool(m.get(3, 1))
            s.squeeze_spaces = bool(m.get(4, 1))
            s.escape_spaces = bool(m.get(5, 1))
    if s.model_type not in (1, 2):
        raise ValueError("only unigram and byte-pair models are supported")
    if s.suffix_marker or not s.escape_spaces:
        raise ValueError("models that mark the end of words, or keep spaces, are not supported")
    return s


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs that make a piece, best score first (a piece's own pairs in order of their left part)."""
    score = {p: v for p, v, kind in pieces if kind in (NORMAL, USER)}
    rank = {p: i for i, (p, _, _) in enumerate(pieces)}
    found = [(-score[p], rank[p], i, p[:i], p[i:]) for p in score for i in range(1, len(p))
             if p[:i] in score and p[i:] in score]
    return [(a, b) for _, _, _, a, b in sorted(found)]


def build(spec: Spec):
    """A ``tokenizers.Tokenizer`` equal to the model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    unk = next(i for i, p in enumerate(spec.pieces) if p[2] == UNKNOWN)
    if spec.model_type == 1:
        model = models.Unigram([(p, v) for p, v, _ in spec.pieces], unk_id=unk, byte_fallback=spec.byte_fallback)
    else:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges(spec.pieces),
                           unk_token=spec.pieces[unk][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    t = Tokenizer(model)
    steps = []
    if spec.charsmap:
        steps.append(normalizers.Precompiled(spec.charsmap))
    if spec.squeeze_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    steps.append(normalizers.Replace(" ", SPACE))
    t.normalizer = normalizers.Sequence(steps)
    if not any(SPACE in p.lstrip(SPACE) for p, _, _ in spec.pieces):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
                                  + [decoders.Strip(" ", 1, 0)] * spec.dummy_prefix)
    if user := [p for p, _, kind in spec.pieces if kind == USER]:
        t.add_tokens([AddedToken(p, normalized=True) for p in user])
    return t


class Encoder:
    """The tokenizer of a model file with its rules, and the word cache."""

    def __init__(self, data: bytes, cached_words: int = 1 << 18):
        self.spec = parse(data)
        self.library = build(self.spec)
        self.splits = self.library.pre_tokenizer is not None
        self.library.normalizer = None             # texts are normalised here, then cut into words
        self.library.pre_tokenizer = None
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.start = re.compile(f"(?<!{SPACE}){SPACE}")
        self.charsmap = None
        if self.spec.charsmap:
            from tokenizers import normalizers
            self.charsmap = normalizers.Precompiled(self.spec.charsmap)
        self.cache: dict[str, bytes] = {}          # a word's ids, four bytes each
        self.cached_words = cached_words
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode()
                         for p, _, kind in self.spec.pieces]

    def normalise(self, text: str | None) -> str:
        text = text or ""
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.spec.squeeze_spaces:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if text and self.spec.dummy_prefix:
            text = SPACE + text
        return text.replace(" ", SPACE)

    def pieces(self, text: str, limit: int = 1 << 18):
        """The text in pieces of about ``limit`` characters, each from a word's start."""
        at = 0
        while (cut := self.start.search(text, at + limit)) is not None:
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, normal: list[str]) -> list[list[int]]:
        """Ids of normalised texts."""
        return [x.tolist() for x in self.packed(normal)]

    def packed(self, normal: list[str], batch: int = 1 << 12) -> list[np.ndarray]:
        """Ids of normalised texts, as arrays."""
        if not self.splits:
            return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(normal, add_special_tokens=False)]
        return [np.frombuffer(b"".join(self._words(p, batch) for p in self.pieces(x)), np.int32) for x in normal]

    def _words(self, piece: str, batch: int) -> bytes:
        cache = self.cache
        words = self.cut.findall(piece)
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if len(cache) + len(new) > self.cached_words:
            cache.clear()
            new = list(dict.fromkeys(words))
        for k in range(0, len(new), batch):
            part = new[k:k + batch]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                cache[w] = array("i", e.ids).tobytes()
        return b"".join(map(cache.__getitem__, words))

    def decode(self, ids: list[list[int]] | list[np.ndarray]) -> list[str]:
        """The texts of lists of ids: the bytes of their pieces; the library decodes all lists if the
        byte pieces of one are no valid text (it shows each such byte as a replacement character)."""
        try:
            texts = [b"".join(map(self.bytes_of.__getitem__, _ints(x))).decode() for x in ids]
        except UnicodeDecodeError:
            return self.library.decode_batch([_ints(x) for x in ids], skip_special_tokens=False)
        return [x[1:] if self.spec.dummy_prefix and x.startswith(" ") else x for x in texts]

    def expected(self, normal: str) -> str:
        """What decoding gives back: the normalised text with markers as spaces."""
        out = normal.replace(SPACE, " ")
        return out[1:] if self.spec.dummy_prefix and out.startswith(" ") else out


def _ints(x: list[int] | np.ndarray) -> list[int]:
    return x.tolist() if isinstance(x, np.ndarray) else x


_built: dict[bytes, Encoder] = {}


def encoder(data: bytes, threads: int = 2) -> Encoder:
    """The encoder of a model file's bytes, built once per process."""
    if data not in _built:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))   # an executor's cores, not the host's
        _built.clear()
        _built[data] = Encoder(data)
    return _built[data]


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def tokenize(df: DataFrame, model: bytes, id_col: str = "doc_id", slice_bytes: int = 1 << 20) -> DataFrame:
    """id, n_tokens, ids, round_trip (decoding gives the normalised text) and n_decoded (its length)."""
    shared = df.sparkSession.sparkContext.broadcast(model)    # one model file, a fixed size

    def run(batches):
        model_of = encoder(shared.value)
        for batch in batches:
            for i, j, texts in texts_in_slices(batch, "text", slice_bytes):
                normal = [model_of.normalise(t) for t in texts]
                ids = model_of.packed(normal)
                back = model_of.decode(ids)
                ok = [b == model_of.expected(t) for b, t in zip(back, normal)]
                sizes = np.array([x.size for x in ids], np.int64)
                places = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(sizes), lists, pa.array(ok),
                     pa.array([len(b) for b in back], pa.int64())],
                    names=[id_col, "n_tokens", "ids", "round_trip", "n_decoded"])
        model_of.cache.clear()                     # an idle worker holds no words

    return df.select(id_col, "text").mapInArrow(
        released(run), f"{id_col} long, n_tokens long, ids array<int>, round_trip boolean, n_decoded long")
