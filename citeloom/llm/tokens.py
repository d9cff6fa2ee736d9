"""Token ids of whole texts by a tokenizers file, with the ids of distinct words computed once.

The tokenizer's normaliser and pre-tokeniser never join or compose across ASCII white space, so a
text's ids are its words' ids in order (tests hold this against encode() of whole texts). Plain
words (ASCII and Latin-1 letters, digits and signs) are cut into the pre-tokeniser's pieces here and
only new pieces go to the model; every other word goes through encode_batch().
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of these characters only are cut here; an apostrophe may start one of the tokenizer's contractions.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
ENCODERS: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """One tokenizer file in one worker. most: pieces, and as many whole words, that are remembered, about 150 bytes each."""

    def __init__(self, path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.pieces, self.words = Tokenizer.from_file(path), most, {}, {}
        letters = _byte_letters()
        self.letter = [letters[b] for b in range(256)]
        self.model = self.tokenizer.model
        # only the layout that PLAIN and PIECES mirror takes the short way
        shown = repr(self.tokenizer.normalizer) + repr(self.tokenizer.pre_tokenizer)
        self.short = "Lowercase" in shown and "NFC" in shown and "ByteLevel" in shown and "Split" in shown

    def _piece(self, piece: str) -> tuple[int, ...]:
        # visible ASCII characters stand for themselves
        shown = piece if piece.isascii() else "".join([self.letter[b] for b in piece.encode()])
        ids = tuple([t.id for t in self.model.tokenize(shown)])
        if len(self.pieces) < self.most:
            self.pieces[piece] = ids
        return ids

    def word_ids(self, words: list[str]) -> list:
        out = list(map(self.words.get, words))
        other, known, plain, split = [], self.pieces, PLAIN.fullmatch, PIECES.findall
        room = self.most - len(self.words)
        for i in [i for i, ids in enumerate(out) if ids is None]:
            word = words[i]
            if not self.short or not plain(word) or "<|" in word:
                other.append(i)
                continue
            parts = split(word.lower())
            if len(parts) == 1:
                ids = known.get(parts[0]) or self._piece(parts[0])
            else:
                ids = ()
                for part in parts:
                    ids += known.get(part) or self._piece(part)
            out[i] = ids
            if room > 0:
                self.words[word] = ids
                room -= 1
        if other:
            for i, found in zip(other, self.tokenizer.encode_batch([words[i] for i in other], add_special_tokens=False), strict=True):
                out[i] = found.ids
        return out

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) with `end` after each text, and where each text starts (one more offset than texts)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        # the end is one more word, after the last of each text
        ids = [*self.word_ids(words.dictionary.to_numpy(zero_copy_only=False).tolist()), (end,)]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum()))
        at = np.cumsum(size, dtype=np.int32) - size  # all below 2**31 in a slice of some megabytes
        lists = split.offsets.to_numpy()
        lists = lists - lists[0]
        use = np.insert(words.indices.to_numpy(), lists[1:], len(ids) - 1)
        size_of = size[use]
        before = np.zeros(len(use) + 1, np.int32)
        np.cumsum(size_of, out=before[1:])
        out = flat[np.repeat(at[use] - before[:-1], size_of) + np.arange(before[-1], dtype=np.int32)]
        return out, before[lists + np.arange(len(lists))].astype(np.int64)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a path; kept between tasks."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def forget() -> None:
    """Free what a worker remembers of tokenizers; for steps of a pipeline that need the memory."""
    if ENCODERS:
        ENCODERS.clear()


def slices(batch: pa.RecordBatch, text: int, most: int = 8 << 20):
    """Row ranges of a batch with about `most` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
