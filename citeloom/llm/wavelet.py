"""A wavelet matrix of token ids as one compressed file: succinct bit planes with rank and select.

File: magic, numbers, header, directory, blocks. The header is a compressed Arrow stream with a row for each
text (its key and token count). Each plane holds one bit of every id, highest bit first, in the order left by
stable partitions on the planes above. A plane is cut into blocks of BLOCK bits that are compressed one by one;
the directory has each plane's number of zeros and, for each block, the ones of its plane before it and its
place in the file. Access, rank and select read the directory and unpack only the blocks that they touch.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

MAGIC = b"WMX2"
#: Bits of a block: 4 KiB unpacked.
BLOCK = 1 << 15
_HEAD = "<QQIQ"


def build(ids: np.ndarray, table: pa.Table) -> bytes:
    """The file for ids (below 2**32); table: a row for each text, in order."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    n_blocks = -(-len(ids) // BLOCK)
    zeros, before, offsets = np.zeros(bits, "<u8"), np.zeros((bits, n_blocks), "<u4"), np.zeros(bits * n_blocks + 1, "<u8")
    blocks, at = [], 0
    for level in range(bits):
        ones = (now & now.dtype.type(1 << (bits - 1 - level))) != 0
        high, low = now[ones], now[~ones]
        now, zeros[level] = np.concatenate((low, high)), len(low)
        raw = np.packbits(ones, bitorder="little")
        counts = np.bitwise_count(raw).astype(np.int64)
        per = np.add.reduceat(counts, np.arange(0, len(raw), BLOCK // 8)) if len(raw) else np.zeros(0, np.int64)
        before[level] = np.cumsum(per) - per
        for b in range(n_blocks):
            part = raw[b * (BLOCK // 8) : (b + 1) * (BLOCK // 8)].tobytes()
            packed = pa.compress(part, "zstd", asbytes=True)
            blocks.append(packed if len(packed) < len(part) else part)  # a block as long as its bits is not packed
            at += len(blocks[-1])
            offsets[level * n_blocks + b + 1] = at
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    head = sink.getvalue().to_pybytes()
    directory = pa.compress(zeros.tobytes() + before.tobytes() + offsets.tobytes(), "zstd", asbytes=True)
    return b"".join([MAGIC, struct.pack(_HEAD, len(head), len(ids), bits, len(directory)), head, directory, *blocks])


class WaveletMatrix:
    """Reads a file lazily: the directory on opening, texts and blocks when they are asked for."""

    def __init__(self, file: bytes, held: int = 256):
        """held: unpacked blocks that are kept, 4 KiB each."""
        if file[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        self.file, self.held, self._cache = memoryview(file), held, {}
        head, self.n, self.bits, size = struct.unpack_from(_HEAD, file, 4)
        self._head = (4 + struct.calcsize(_HEAD), head)
        at = sum(self._head)
        self.n_blocks = -(-self.n // BLOCK)
        raw = pa.decompress(self.file[at : at + size], 8 * self.bits + 4 * self.bits * self.n_blocks + 8 * (self.bits * self.n_blocks + 1), "zstd", asbytes=True)
        self.zeros = np.frombuffer(raw, "<u8", self.bits).astype(np.int64)
        self.before = np.frombuffer(raw, "<u4", self.bits * self.n_blocks, 8 * self.bits).reshape(self.bits, self.n_blocks).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", offset=8 * self.bits + 4 * self.bits * self.n_blocks).astype(np.int64) + at + size
        self.unpacked = 0  # blocks unpacked so far

    @property
    def texts(self) -> pa.Table:
        at, size = self._head
        return pa.ipc.open_stream(pa.py_buffer(self.file[at : at + size])).read_all()

    def _block(self, level: int, b: int) -> np.ndarray:
        """A block's bytes."""
        i = level * self.n_blocks + b
        if i not in self._cache:
            part = self.file[self.offsets[i] : self.offsets[i + 1]]
            size = -(-min(BLOCK, self.n - b * BLOCK) // 8)
            if len(self._cache) >= self.held:
                self._cache.pop(next(iter(self._cache)))
            self._cache[i] = np.frombuffer(part if len(part) == size else pa.decompress(part, size, "zstd", asbytes=True), np.uint8)
            self.unpacked += 1
        return self._cache[i]

    def all(self) -> np.ndarray:
        """Every id, in order."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            raw = np.concatenate([self._block(level, b) for b in range(self.n_blocks)]) if self.n_blocks else np.zeros(0, np.uint8)
            ones = np.unpackbits(raw, count=self.n, bitorder="little").view(bool)
            z, up = self.zeros[level], np.empty(self.n, kind)
            up[~ones] = now[:z]
            up[ones] = now[z:] | kind(1 << (self.bits - 1 - level))
            now = up
        return now

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        b, rest = divmod(i, BLOCK)
        if b == self.n_blocks:
            return self.n - int(self.zeros[level])
        whole, bit = divmod(rest, 8)
        block = self._block(level, b) if rest else None
        inside = int(np.bitwise_count(block[:whole]).sum()) if whole else 0
        return int(self.before[level, b]) + inside + (int(block[whole] & ((1 << bit) - 1)).bit_count() if bit else 0)

    def _places(self, level: int, bit: int, ranks: np.ndarray) -> np.ndarray:
        """Where a plane has this bit for the ranks-th time (from 0; sorted): by the counts to a block, then inside it."""
        start = np.arange(self.n_blocks) * BLOCK
        before = self.before[level] if bit else start - self.before[level]
        at = np.searchsorted(before, ranks, side="right") - 1
        out = np.empty(len(ranks), np.int64)
        for b in np.unique(at).tolist():
            mine = at == b
            bits = np.unpackbits(self._block(level, b), count=min(BLOCK, self.n - b * BLOCK), bitorder="little")
            out[mine] = start[b] + np.flatnonzero(bits == bit)[ranks[mine] - before[b]]
        return out

    def access(self, i: int) -> int:
        """The i-th id."""
        value = 0
        for level in range(self.bits):
            b, rest = divmod(i, BLOCK)
            one = int(self._block(level, b)[rest >> 3] >> (rest & 7) & 1)
            ones = self._ones(level, i)
            i = int(self.zeros[level]) + ones if one else i - ones
            value = value << 1 | one
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Below the last plane, where the copies of a token among the first i ids start and end."""
        lo, hi = 0, i
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often the token is among the first i ids."""
        if token < 0 or token >> self.bits:
            return 0
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def places(self, token: int, first: int = 0, most: int | None = None) -> np.ndarray:
        """Where the token comes, in order, from its first-th time on: down the planes to its copies, and up again by select."""
        if token < 0 or token >> self.bits:
            return np.zeros(0, np.int64)
        lo, hi = self._range(token, self.n)
        at = np.arange(min(hi, lo + first), hi if most is None else min(hi, lo + first + most))
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._places(level, bit, at - int(self.zeros[level]) if bit else at)
        return at

    def select(self, token: int, k: int) -> int:
        """Where the token comes for the k-th time (from 0); -1 if it does not."""
        found = self.places(token, k, 1) if k >= 0 else ()
        return int(found[0]) if len(found) else -1
