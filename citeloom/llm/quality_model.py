"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits a small tree to one feature at a time on binned values, so every feature ends as
one lookup table; then the pairs with most left to explain get tables of their own the same way. Scoring
looks up a feature's bin and adds: no model library and no row loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import distinct_names
from citeloom.llm.quality_rules import labelled_sample, sampled
from citeloom.llm.textstats import COUNTS, RATIOS, text_stats

FEATURES = (*RATIOS, *(c for c in COUNTS if c != "n_words"))


@dataclass
class Additive:
    """bias, cut points and a table for each feature, coarse cut points and a table for each pair."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, j], side="right")]
        bins = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for p in self.pairs for j in p[:2]}
        for i, j, table in self.pairs:
            total += table[bins[i], bins[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _quantiles(x: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Steps of a best-first tree over bins, from their gradients and curvatures."""
    G, H = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    worth = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
    spans = [(0, len(g))]
    while len(spans) < leaves:
        best = (1e-9, None)
        for s, (a, b) in enumerate(spans):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = worth(a, cut) + worth(cut, b) - worth(a, b)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), (s, int(cut[i])))
        if best[1] is None:
            break
        s, cut = best[1]
        a, b = spans.pop(s)
        spans += [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = -(G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a table into four, with its gain."""
    G = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    H = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    best, out = -1.0, np.zeros_like(g)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            quads = [(slice(0, a), slice(0, b), G[a, b], H[a, b]), (slice(0, a), slice(b, None), G[a, -1] - G[a, b], H[a, -1] - H[a, b])]
            quads += [(slice(a, None), slice(0, b), G[-1, b] - G[a, b], H[-1, b] - H[a, b]), (slice(a, None), slice(b, None), G[-1, -1] - G[a, -1] - G[-1, b] + G[a, b], H[-1, -1] - H[a, -1] - H[-1, b] + H[a, b])]
            gain = sum(q[2] ** 2 / (q[3] + ridge) for q in quads)
            if gain > best:
                best, out = gain, np.zeros_like(g)
                for r, c, x, y in quads:
                    out[r, c] = -x / (y + ridge)
    return best, out


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 8, rounds: int = 120, pair_rounds: int = 20, n_pairs: int = 8, rate: float = 0.15, leaves: int = 4, ridge: float = 1.0) -> Additive:
    """A model for labels y (0 or 1). One class only, or no rows, gives a constant model."""
    if not len(y) or y.min() == y.max():
        return Additive(0.0 if not len(y) else (4.0 if y[0] else -4.0), [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    d = x.shape[1]
    model = Additive(float(np.log(y.mean() / (1 - y.mean()))), [_quantiles(x[:, j], bins) for j in range(d)], [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    margin = np.full(len(y), model.bias)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(d):
            g, h = slope()
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size), leaves, ridge)
            model.tables[j] += step
            margin += step[at[j]]
    model.coarse = [_quantiles(x[:, j], coarse_bins) for j in range(d)]
    wide = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell = wide[i] * shape[1] + wide[j]
        g, h = slope()
        return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_quadrants(*grid(i, j)[1:], ridge)[0], i, j) for i in range(d) for j in range(i + 1, d)), key=lambda t: (-t[0], t[1], t[2]))
    tables = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for _, i, j in ranked[:n_pairs]}
    for _ in range(pair_rounds):
        for (i, j), table in tables.items():
            cell, g, h = grid(i, j)
            step = rate * _quadrants(g, h, ridge)[1]
            table += step
            margin += step.ravel()[cell]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 8_000, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """Per row: the id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold` on).

    held_out rows (crc32 of the id as text divisible by `folds`) teach nothing; the model is fitted on at most
    sample_rows of the other labelled documents, and an id with unlike labels teaches nothing. Inputs are
    statistics of the whole text only, whatever its length. Null and empty texts have statistics of 0 and get a
    score like any others; a null id is not held out. Without labels every score is 0.5. Repeated rows get equal
    scores; an empty table gives an empty table. Other columns, whatever their names, are not read; an id column
    named like an output or a statistic is an error.
    """
    distinct_names({id_col}, ("held_out", "score", "predicted"))
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    data, marks = sampled(labelled_sample(docs, labels.filter(fold != 0), label, id_col, text, sample_rows), FEATURES)
    x = np.column_stack([data[c].astype(float) for c in FEATURES]) if len(marks) else np.zeros((0, len(FEATURES)))
    model = fit_additive(x, marks.astype(float))
    stats = text_stats(docs, id_col, text)
    rows = stats.select(id_col, F.coalesce(fold == 0, F.lit(False)).alias("held_out"), *FEATURES)
    schema = T.StructType([stats.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.column_stack([batch.column(c + 2).to_numpy(zero_copy_only=False).astype(float) for c in range(len(FEATURES))])) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(score, schema)
