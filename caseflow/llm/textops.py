"""Vectorised text helpers shared by the operators: word hashes, shingle sets, code points.

Words are runs of bytes other than space and \\t\\n\\v\\f\\r (``bytes.split()`` semantics).
Everything works on one bounded chunk of texts at a time.
"""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1          # odd multipliers: invertible modulo 2**64
_Q = 0xC2B2AE3D27D4EB4F | 1
_M = (1 << 64) - 1
CHUNK = 1 << 20                      # bytes (or characters) handled at once
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (every input bit reaches every output bit)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


_FWD = _powers(_P, 4096)
_COL = _powers(_Q, 8)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte's place) of every word of ``data``, in order."""
    a = np.frombuffer(data, np.uint8)
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    if not a.size:
        return none
    ws = _WS[a]
    edge = np.flatnonzero(ws[1:] != ws[:-1]) + 1
    if not ws[0]:
        edge = np.concatenate(([0], edge))
    if not ws[-1]:
        edge = np.concatenate((edge, [a.size]))
    start, end = edge[0::2], edge[1::2]
    if not start.size:
        return none
    n = end - start
    # a byte's weight goes by its place inside its word; places wrap at 4096, with the round mixed in
    at = np.flatnonzero(~ws)
    pos = at - np.repeat(start, n)
    val = (a[at].astype(np.uint64) + np.uint64(1)) * _FWD[pos & 4095]
    if n.max() > 4096:
        val = val * (np.uint64(2) * (pos >> 12).astype(np.uint64) + np.uint64(1))
    h = np.add.reduceat(val, np.cumsum(n) - n)
    return mix(h + n.astype(np.uint64) * np.uint64(_Q)), start


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` words (of the whole sequence when it is shorter)."""
    if not h.size:
        return h
    if h.size < k:
        k = h.size
    m = h.size - k + 1
    out = np.zeros(m, np.uint64)
    for i in range(k):
        out += h[i:i + m] * _COL[i]
    return mix(out + np.uint64(k))


def shingle_sets(texts: list[bytes | None], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each UTF-8 text's k-word shingles (A-Z lower-cased)."""
    data = b"\n".join(t or b"" for t in texts).lower()        # bytes.lower() changes A-Z only
    h, start = word_hashes(data)
    begin = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    cut = np.searchsorted(start, begin)
    w = windows(h, k) if h.size >= k else np.empty(0, np.uint64)
    out = []
    for i, j in zip(cut[:-1], cut[1:]):
        if j - i >= k:
            s = np.sort(w[i:j - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(windows(h[i:j], k))                    # one shingle, or none without words
    return out


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
