"""Many terms in many token sequences: a trie in flat arrays walked from all places of a batch at once.

A term is a run of tokens. The trie's edges of one depth are a sorted array of (node, token) numbers, so a step of all
places that are still inside the trie is one binary search; a place leaves with its first token that no term has. Nothing is
built for a run that is not a term. The trie goes to every task only up to a stated number of tokens; a larger
vocabulary is joined with the runs of its terms' lengths instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of a batch that are walked at a time; a longer row is walked alone.
AT_A_TIME = 1 << 20


def words_of(c: Column | str, split: str = "\\s+") -> Column:
    """The non-empty parts between matches of `split`."""
    return F.filter(F.split(c, split), lambda t: t != "")


def ngrams(tokens: Column, lengths: Column) -> Column:
    """All runs of `lengths` (an array of ints) tokens, joined by a space, as struct(n, first, gram)."""
    fit = F.filter(lengths, lambda n: n <= F.size(tokens))
    runs = F.transform(fit, lambda n: F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.struct(n.alias("n"), (i - 1).alias("first"), F.array_join(F.slice(tokens, i, n), " ").alias("gram"))))
    return F.flatten(runs)


class Trie:
    """Terms in flat arrays, depth by depth.

    tokens: the distinct tokens; edges[d]: sorted node * len(tokens) + token of depth d, whose place in the array is the
    number of the node that it leads to; ends[d]: for each of these nodes, the term that ends there or -1.
    """

    def __init__(self, terms: list[list[str]]):
        flat = pa.array([t for term in terms for t in term], pa.string()).dictionary_encode()
        self.terms, self.tokens = terms, flat.dictionary
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.array([len(t) for t in terms], np.int64)
        at = np.cumsum(size) - size
        self.edges: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        alive, node = np.flatnonzero(size > 0), np.zeros(int((size > 0).sum()), np.int64)
        for depth in range(int(size.max(initial=0))):
            edges, node = np.unique(node * len(self.tokens) + code[at[alive] + depth], return_inverse=True)
            done = size[alive] == depth + 1
            ends = np.full(len(edges), -1, np.int64)
            ends[node[done]] = alive[done]
            self.edges.append(edges)
            self.ends.append(ends)
            alive, node = alive[~done], node[~done]

    def places(self, tokens: pa.Array, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, term) of every run of tokens that is a term, by place and then length. end: where each token's row ends; null tokens are no term's."""
        code = pc.fill_null(pc.index_in(tokens, value_set=self.tokens, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.flatnonzero(code >= 0)
        node = np.zeros(len(start), np.int64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for depth, (edges, ends) in enumerate(zip(self.edges, self.ends, strict=True)):
            inside = start + depth < end[start]
            start, node = start[inside], node[inside]
            step = code[start + depth]
            key = np.where(step >= 0, node * len(self.tokens) + step, -1)
            node = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
            on = edges[node] == key
            start, node = start[on], node[on]
            term = ends[node]
            found.append((start[term >= 0], term[term >= 0]))
        place, term = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place, kind="stable")
        return place[order], term[order]


def token_slices(batch: pa.RecordBatch, column: int, most: int = AT_A_TIME) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Parts of a batch of about `most` tokens: the rows, where each one's tokens begin (and the last one's end), and all tokens."""
    size = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + most, side="right")) - 1)
        part = batch.slice(lo, hi - lo)
        yield part, begin[lo : hi + 1] - begin[lo], pc.list_flatten(part.column(column))
        lo = hi


def _known(terms: DataFrame, raw: str, split: str, most_tokens: int) -> Trie | None:
    """The trie of the terms; None if they have more tokens than that."""
    each = terms.select(words_of(raw, split).alias("t")).filter(F.size("t") > 0).distinct()
    if (each.agg(F.sum(F.size("t"))).first()[0] or 0) > most_tokens:
        return None
    return Trie(sorted(r[0] for r in each.collect()))


def term_places(rows: DataFrame, terms: DataFrame, key: list[str], tokens: str = "tokens", raw: str = "raw", split: str = "\\s+", most_tokens: int = 2_000_000) -> DataFrame:
    """key columns, gram (a term's tokens joined by a space), n (their number) and first (the place of the first one, from 0): every run of a row's tokens that is a term.

    Terms that overlap or lie within others are all found, each place a row. A term's tokens are the parts of `raw`; terms
    without any are left out. Rows with a null or empty list have no places, and a null token is no term's. Terms of at
    most `most_tokens` tokens in all are collected and go to each task; more are joined with all runs of their
    lengths, which shuffles those runs.
    """
    trie = _known(terms, raw, split, most_tokens)
    if trie is None:
        each = terms.select(words_of(raw, split).alias("t")).filter(F.size("t") > 0)
        lengths = each.agg(F.array_sort(F.collect_set(F.size("t"))).alias("__lengths"))  # one row
        # a null token is in no term, and must not vanish from a run
        whole = F.transform(tokens, lambda t: F.coalesce(t, F.lit(" ")))
        runs = rows.select(*key, whole.alias("__tokens")).crossJoin(F.broadcast(lengths)).select(*key, F.explode(ngrams(F.col("__tokens"), F.col("__lengths"))).alias("g"))
        wanted = each.select(F.array_join("t", " ").alias("gram")).distinct()
        return runs.select(*key, "g.gram", "g.n", "g.first").join(wanted, "gram", "left_semi")
    grams, sizes = pa.array([" ".join(t) for t in trie.terms], pa.string()), pa.array([len(t) for t in trie.terms], pa.int32())
    schema = T.StructType([*(rows.schema[c] for c in key), T.StructField("gram", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("first", T.IntegerType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, begin, flat in token_slices(batch, len(key)):
                row_of = np.repeat(np.arange(part.num_rows), np.diff(begin))
                place, term = trie.places(flat, begin[1:][row_of])
                row = row_of[place]
                at, which = pa.array(row), pa.array(term)
                columns = [*(part.column(i).take(at) for i in range(len(key))), grams.take(which), sizes.take(which), pa.array((place - begin[row]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select(*key, F.col(tokens).cast("array<string>")).mapInArrow(walk, schema)


def leftmost_longest(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the runs (by place, then size) stay if each, from the left, is the longest of its place and the next one begins at its end or later."""
    last = np.flatnonzero(np.append(np.diff(place) > 0, True)[: len(place)])
    kept, end = [], -1
    for i, a, n in zip(last.tolist(), place[last].tolist(), size[last].tolist(), strict=True):
        if a >= end:
            kept.append(i)
            end = a + n
    return np.array(kept, np.int64)


def without_terms(rows: DataFrame, terms: list[str], tokens: str = "tokens", name: str = "masked", sentinel: str = "\u0001", split: str = "\\s+") -> DataFrame:
    """rows with `name`: the tokens, each run that is a term (leftmost, then longest) replaced by one sentinel.

    A word list's counterpart of a regular expression of all its phrases: its time does not grow with their number. Null
    lists stay null; null tokens stay and part their neighbours. Only `tokens` goes to the Python workers.
    """
    import re

    trie = Trie(sorted({tuple(w for w in re.split(split, t) if w) for t in terms} - {()}))
    sizes = np.array([len(t) for t in trie.terms], np.int64)

    @F.arrow_udf("array<string>")
    def masked(lists: pa.Array) -> pa.Array:
        out = []
        for part, begin, flat in token_slices(pa.RecordBatch.from_arrays([lists], names=["t"]), 0):
            row_of = np.repeat(np.arange(part.num_rows), np.diff(begin))
            place, term = trie.places(flat, begin[1:][row_of])
            kept = leftmost_longest(place, sizes[term])
            first, size = place[kept], sizes[term[kept]]
            # the tokens of a run but its first go, and its first is the sentinel
            change = np.zeros(len(flat) + 1, np.int64)
            np.add.at(change, first + 1, 1)
            np.add.at(change, first + size, -1)
            stays = np.cumsum(change)[:-1] == 0
            is_first = np.zeros(len(flat), bool)
            is_first[first] = True
            text = pc.if_else(pa.array(is_first), pa.scalar(sentinel), flat).filter(pa.array(stays))
            offsets = np.concatenate(([0], np.cumsum(stays)))[begin]
            null = part.column(0).is_null().to_numpy(zero_copy_only=False)
            out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), text, mask=pa.array(null)))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return rows.withColumn(name, masked(F.col(tokens)))
