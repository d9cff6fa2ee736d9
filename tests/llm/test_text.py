"""Kernels, the encoder, the wavelet matrix and best-fit against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import citeloom.llm.textarrays as X
from citeloom.llm.packing import best_fit
from citeloom.llm.textarrays import Words, inside, joined, windows
from citeloom.llm.tokens import encoder
from citeloom.llm.wavelet import WaveletMatrix, build


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\x0bé日", max_size=30)), max_size=8), st.sampled_from([3, 1 << 19]))
def test_words(texts, piece):
    held, X.SLICE = X.SLICE, piece
    try:
        w = Words(pa.array(texts, pa.string()))
    finally:
        X.SLICE = held
    got = [[w.data[w.start[i] : w.end[i]].tobytes() for i in range(w.at[t], w.at[t + 1])] for t in range(len(texts))]
    assert got == [(t or "").encode().split() for t in texts]
    flat = [x for t in got for x in t]
    assert len(set(flat)) == len(set(w.hash.tolist()))
    assert [joined(w, np.ones(len(w), bool), t) for t in range(len(texts))] == [b" ".join(x) for x in got]
    starts = inside(w.at, 2)
    pairs = [(a, b) for t in got for a, b in zip(t[:-1], t[1:])]
    assert len(starts) == len(pairs)
    hashed = windows(w.hash, 2)[starts].tolist()
    assert len(set(hashed)) == len(set(pairs))


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_encoder_equals_library():
    e = encoder(tokenizer_path())
    rng = random.Random(5)
    pool = "abcXYZ'sSltTdD019 \t\n.,!<|>éÉßøØ×÷ÿÀªµ́İẞ 日ﬁΣς"
    odd = ["", None, "don't I'll 's'tIT'S", "ﬁ Ａ İstanbul ΣΑΣ", "<|endoftext|> x<|startoftext|>y <|", "日本語 привет", "\x00\x01 \x7f", "K Å ẞ"]
    texts = odd + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    ids, at = e.encode(pa.array(texts, pa.string()), 7)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 7]


@pytest.mark.parametrize("n", [0, 1, 7, 513, 3000])
def test_wavelet(n):
    x = (np.random.default_rng(n).zipf(1.3, n) % 49408).astype(np.uint32)
    w = WaveletMatrix(build(x, pa.table({"n_tokens": [n]})))
    assert (w.all() == x).all()
    for i in range(0, n, max(1, n // 15)):
        k = int((x[:i] == x[i]).sum())
        assert (w.access(i), w.rank(int(x[i]), i), w.count(int(x[i])), w.select(int(x[i]), k)) == (x[i], k, (x == x[i]).sum(), i)
    assert w.count(1 << 20) == 0 and w.select(3, 10**6) == -1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(lengths):
    bins, offsets, fills = best_fit(np.array(lengths, np.int64), 50)
    for b in range(len(fills)):
        at = sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        end = 0
        for o, n in at:
            assert o == end
            end += n
        assert end == fills[b] <= 50
    assert len(fills) <= max(1, 2 * -(-sum(lengths) // 50)) or not lengths
