"""Statistics of whole texts, in one pass: exact counts for the base rules and ratios for the learned methods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import distinct_names
from citeloom.llm.textarrays import SPACE, Words, inside, windows
from citeloom.llm.tokens import slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "shout_share", "bar_share",
    "other_share", "distinct_share", "top_word_share", "same_next_share", "line_words", "short_line_share", "stop_share", "log_words", "wide_share",
)
#: The symbols of the base rule.
SYMBOLS = b"#*$%&|<>"


def _mask(values: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _MARK = _mask(SYMBOLS), _mask(range(65, 91)), _mask(range(48, 58)), _mask(b".,;:?")
_FOLLOWS, _WIDE = _mask(range(128, 192)), _mask(range(192, 256))
_ASCII_LETTER = _mask([*range(65, 91), *range(97, 123)])
_OTHER = ~(_SYMBOL | _DIGIT | _MARK | SPACE | _ASCII_LETTER | _mask(range(128, 256)) | _mask(b"!"))


def repeated_words(hashes: np.ndarray, k: int) -> int:
    """Words covered by windows (given by their hashes, one for each start) that come twice or more."""
    again = np.sort(hashes)
    twice = again[1:][again[1:] == again[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(hashes, twice))
    cover = np.zeros(len(hashes) + k, np.int32)
    cover[starts] += 1
    cover[starts + k] -= 1
    return int((np.cumsum(cover) > 0).sum())


def batch_stats(texts: pa.Array, k: int = 5) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """COUNTS (long) and RATIOS (double) of every text; a null text counts as empty."""
    words = Words(texts)
    n, at = len(words.at) - 1, words.at
    counts = words.counts()
    grams = windows(words.hash, k)
    starts = np.zeros(max(0, len(words) - k + 1) + 1, bool)
    starts[inside(at, k)] = True
    used = np.zeros((n, 256), np.int64)
    dup_lines, lines, repeats, distinct, top, short = (np.zeros(n, np.int64) for _ in range(6))
    same = np.zeros(len(words), bool)
    if len(words):
        same[1:] = words.hash[1:] == words.hash[:-1]
        same[at[:-1][counts > 0]] = False
    for i in range(n):
        data = words.data[words.text_at[i] : words.text_at[i + 1]]
        used[i] = np.bincount(data, minlength=256)
        a, b = int(at[i]), int(at[i + 1])
        if b > a:
            filled = [x for x in data.tobytes().split(b"\n") if x.strip()]
            lines[i], dup_lines[i] = len(filled), len(filled) - len(set(filled))
            short[i] = sum(len(x) < 30 for x in filled)
            ordered = np.sort(words.hash[a:b])
            change = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            distinct[i], top[i] = len(change), np.diff(np.append(change, b - a)).max()
        if b - a >= k:
            repeats[i] = repeated_words(grams[a : b - k + 1], k)
    total = used.sum(axis=1)
    per = lambda mask: used[:, mask].sum(axis=1)
    chars = total - per(_FOLLOWS)
    word_chars = chars - per(SPACE)
    exact = dict(zip(COUNTS, (counts, word_chars, per(_SYMBOL), dup_lines, repeats), strict=True))
    share = lambda x, of: np.divide(x, of, out=np.zeros(n), where=of > 0)
    size = words.end - words.start
    sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at])
    values = (
        share(word_chars, counts), share(per(_SYMBOL), word_chars), share(dup_lines, lines), share(repeats, counts), share(per(_UPPER), word_chars), share(per(_DIGIT), word_chars),
        share(per(_MARK), counts), share(used[:, 33], counts), share(used[:, 124], counts), share(per(_OTHER), word_chars), share(distinct, counts), share(top, counts),
        share(sums(same), counts), share(counts, lines), share(short, lines), share(sums(size <= 3), counts), np.log1p(counts), share(per(_WIDE), word_chars),
    )
    return exact, dict(zip(RATIOS, (np.asarray(v, float) for v in values), strict=True))


def text_stats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Per row: the id, COUNTS and RATIOS of the whole text; and the whole input row as a struct, if a name is given for it.

    Only texts go to the Python workers; other columns stay in the JVM. Other columns are not read without `row`; an id
    column named like a statistic is an error.
    """
    distinct_names({id_col}, (*COUNTS, *RATIOS, "base_failed", "kept", "rule"))
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.DoubleType()) for c in RATIOS)])
    kinds = pa.struct([*((c, pa.int64()) for c in COUNTS), *((c, pa.float64()) for c in RATIOS)])

    def measure(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0, 2 << 20):
            exact, ratios = batch_stats(part.column(0))
            out.append(pa.StructArray.from_arrays([*(pa.array(exact[c].astype(np.int64)) for c in COUNTS), *(pa.array(ratios[c]) for c in RATIOS)], fields=list(kinds)))
        return pa.concat_arrays(out) if out else pa.array([], kinds)

    found = F.arrow_udf(measure, schema)(F.col(text)).alias("__stats")
    rows = docs.select(F.col(id_col), *([F.struct(*docs.columns).alias(row)] if row else []), found)
    return rows.select(id_col, *(F.col(f"__stats.{c}").alias(c) for c in (*COUNTS, *RATIOS)), *([row] if row else []))
