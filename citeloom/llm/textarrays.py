"""Vectorised text kernels over Arrow string buffers: words, hashes and windows without Python strings.

A word is a run of bytes outside ASCII white space. Its hash is a polynomial over randomised byte
values modulo 2**64, finished with a multiply-xorshift mixer; a window's hash is the same polynomial
over its words' hashes. Equal words and windows always hash alike, on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE = 1 << 19
_BYTE = np.random.Generator(np.random.PCG64(20240117)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE, _WORD_BASE, _SECOND_BASE = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95), U(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    held = _TABLES.get(int(base))
    if held is None or len(held[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(size, base, U), np.full(size, U(_inverse(int(base))), U)
        up[0] = down[0] = 1
        held = (np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))
        if size <= 1 << 22:
            _TABLES[int(base)] = held
    return held[0][:n], held[1][:n]


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def cuts(data: np.ndarray, at: np.ndarray) -> list[int]:
    """Where to cut the bytes into pieces of about SLICE: at white space or at a text's start."""
    out, pos, n = [0], 0, len(data)
    while n - pos > SLICE:
        end = pos + SLICE
        while end < n and not SPACE[data[end]] and at[np.searchsorted(at, end)] != end:
            stop = min(n, end + 4096)
            ahead = np.flatnonzero(SPACE[data[end:stop]])
            first = end + int(ahead[0]) if len(ahead) else stop
            nxt = int(at[np.searchsorted(at, end)])
            end = min(first, nxt)
        out.append(end)
        pos = end
    return [*out, n] if n > out[-1] else out


class Words:
    """The words of many texts: byte spans, hashes, and where each text's words start."""

    __slots__ = ("data", "text_at", "start", "end", "hash", "at")

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False, hashes: bool = True, between: np.ndarray = SPACE):
        """between: the bytes that separate words; white space is always among them."""
        data, at = buffers(texts)
        self.data, self.text_at = (LOWER[data] if lower else data), at
        starts, ends, hashed = [], [], []
        pieces = cuts(self.data, at)
        for lo, hi in zip(pieces[:-1], pieces[1:], strict=True):
            part = self.data[lo:hi]
            here = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo
            space = between[part]
            before = np.empty(hi - lo, bool)
            before[0], before[1:] = True, space[:-1]
            before[here] = True
            s = np.flatnonzero(~space & before)
            after = np.empty(hi - lo, bool)
            after[-1], after[:-1] = True, space[1:]
            after[here[here > 0] - 1] = True
            e = np.flatnonzero(~space & after) + 1
            if hashes:
                up, down = powers(_BASE, hi - lo)
                total = np.zeros(hi - lo + 1, U)
                np.cumsum(_BYTE[part] * up, out=total[1:])
                hashed.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U)))
            starts.append(s + lo)
            ends.append(e + lo)
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.start, self.end, self.hash = join(starts, np.int64), join(ends, np.int64), join(hashed, U)
        self.at = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def text_of(self) -> np.ndarray:
        """The text's number, for each word."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts())


def windows(hashes: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """The hash of each run of k hashes; there are len - k + 1 of them. second: an independent lane."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U)
    base = _SECOND_BASE if second else _WORD_BASE
    up, down = powers(base, n)
    total = np.zeros(n + 1, U)
    np.cumsum((mix(hashes + U(0x632BE59BD9B4E019)) if second else hashes) * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1] + U(k))


def inside(at: np.ndarray, k: int) -> np.ndarray:
    """Start positions of the windows of k words that lie within one text."""
    n = int(at[-1])
    good = np.zeros(max(0, n - k + 1), bool)
    mark = np.zeros(n + 1, np.int32)
    has = np.diff(at) >= k
    np.add.at(mark, at[:-1][has], 1)
    np.add.at(mark, at[1:][has] - k + 1, -1)
    good[:] = np.cumsum(mark)[: len(good)] > 0
    return np.flatnonzero(good)


def joined(words: Words, keep: np.ndarray, text: int) -> bytes:
    """The kept words of one text, joined by one space."""
    a, b = words.at[text], words.at[text + 1]
    chosen = np.flatnonzero(keep[a:b]) + a
    if not len(chosen):
        return b""
    size = words.end[chosen] - words.start[chosen]
    out = np.full(int(size.sum()) + len(chosen) - 1, 32, np.uint8)
    to = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + step] = words.data[np.repeat(words.start[chosen], size) + step]
    return out.tobytes()
