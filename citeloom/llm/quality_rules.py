"""Quality rules: a base rule on exact counts, and a decision list learned by sequential covering.

Rules are conjunctions of thresholds that mark low quality. Each is grown on two thirds of the labelled
sample by the gain in information, and pruned on the rest; it joins the list only if it is precise there.
The list becomes an ordered conditional expression that Spark evaluates on the statistics of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import free_name
from citeloom.llm.textstats import COUNTS, RATIOS, text_stats


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    value: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return data[self.feature] >= self.value if self.above else data[self.feature] <= self.value

    def column(self) -> Column:
        return F.col(self.feature) >= self.value if self.above else F.col(self.feature) <= self.value


Rule = tuple[Test, ...]


def covers(rule: Rule, data: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.holds(data)
    return out


def _best_test(data: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, features: tuple[str, ...], cuts: int) -> tuple[float, Test | None]:
    """The test with the most FOIL gain among the covered rows."""
    p, n = bad[rows].sum(), (~bad[rows]).sum()
    base, best = np.log2(p / (p + n)), (0.0, None)
    for name in features:
        x = data[name][rows]
        order = np.argsort(x, kind="stable")
        x, y = x[order], bad[rows][order]
        edges = np.flatnonzero(x[1:] > x[:-1])
        if not len(edges):
            continue
        edges = edges[np.unique(np.linspace(0, len(edges) - 1, min(cuts, len(edges))).astype(int))]
        below = np.cumsum(y)[edges]
        size = edges + 1
        for above in (True, False):
            tp = p - below if above else below
            all_ = len(x) - size if above else size
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(tp > 0, tp * (np.log2(tp / all_) - base), -np.inf)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-12:
                best = (float(gain[i]), Test(name, above, float((x[edges[i]] + x[edges[i] + 1]) / 2)))
    return best


def learn_rules(data: dict[str, np.ndarray], bad: np.ndarray, features: tuple[str, ...] = RATIOS, precision: float = 0.9, least: int = 3, most_rules: int = 24, most_tests: int = 4, cuts: int = 200, seed: int = 7) -> list[Rule]:
    """An ordered list of rules for the bad rows; empty if there are none of a kind, or too few."""
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules and bad[left & part].sum() >= least:
        rule, rows = [], np.flatnonzero(left & part)
        while len(rule) < most_tests and (~bad[rows]).any() and bad[rows].any():
            _, test = _best_test(data, bad, rows, features, cuts)
            if test is None:
                break
            rule.append(test)
            rows = rows[test.holds(data)[rows]]
        check = left & ~part
        worth = []
        for end in range(len(rule), 0, -1):
            hit = covers(tuple(rule[:end]), data, len(bad)) & check
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            worth.append(((p - n) / (p + n) if p + n else -1.0, p, end))
        if not worth:
            break
        value, p, end = max(worth)
        if p < least or (value + 1) / 2 < precision:
            break
        rules.append(tuple(rule[:end]))
        left &= ~covers(rules[-1], data, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), else 0."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for more in rule[1:]:
            test = test & more.column()
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text: str, rows: int) -> DataFrame:
    """Statistics (text_stats) and label of at most `rows` labelled documents, the first in the order of a hash of the id.

    An id with unlike labels teaches nothing. Of documents that share an id the one with the least text stands for
    all, chosen in the tasks that read them, so the sample has one row an id. The same rows come on every run.
    """
    given = labels.select(F.col(id_col).alias("__id"), F.col(label).alias("__label")).filter("__label is not null and __id is not null")
    given = given.groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__other")).filter("__label = __other").drop("__other")
    some = given.orderBy(F.xxhash64(F.lit(3), "__id"), "__id").limit(rows)
    # `rows` bounds the broadcast side and, after the grouping, the result
    met = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(some), "__id").groupBy("__id").agg(F.min("__text").alias("__text"), F.first("__label").alias("__label"))
    return text_stats(met, "__id", "__text", "__row")


def sampled(sample: DataFrame, features: tuple[str, ...], passed: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The sample's features by name, and its labels; in the order of the id. passed: only of rows that pass the base rule.

    Sorted here, since a sort in Spark measures the texts once for its ranges and once for its rows. The rule is applied to what was collected: a filter in Spark would be pushed below the columns and measure the texts once more.
    """
    got = sample.select(*features, base_failed().alias("__failed"), F.col("__row.__label").alias("__label"), "__id").toPandas().sort_values("__id")  # bounded by the sample
    got = got[~got["__failed"].astype(bool)] if passed else got
    return {c: got[c].to_numpy() for c in features}, got["__label"].to_numpy()


def base_failed() -> Column:
    """Fewer than 10 words, or more than 20 % of them in repeated 5-word windows."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 12_000, precision: float = 0.9, row: str | None = None) -> DataFrame:
    """text_stats() with base_failed and rule (0: none holds; -1: the base rule). Texts are read twice: the sample's, then all; nothing is written."""
    data, marks = sampled(labelled_sample(docs, labels, label, id_col, text, sample_rows), RATIOS, passed=True)
    bad = np.asarray(marks == 0, bool)
    rules = learn_rules(data, bad, precision=precision) if bad.any() and not bad.all() else []
    stats = text_stats(docs, id_col, text, row).withColumn("base_failed", base_failed())
    return stats.withColumn("rule", F.when(F.col("base_failed"), -1).otherwise(verdict(rules)))


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row: the id, COUNTS, base_failed, kept and rule (0: none; -1: the base rule).

    base_failed: fewer than 10 words, or more than 20 % of them in repeated 5-word windows. Rules are learned
    from at most sample_rows documents whose label is given (label 0: bad) and that pass the base rule; without
    labels only the base rule rejects, and an id with unlike labels teaches nothing. Null, empty and blank texts
    have no words and fail; a text of any length is measured whole. Repeated rows get equal verdicts; an empty
    table gives an empty table. Other columns, whatever their names, are not read; an id column named like an
    output is an error. options: those of judged().
    """
    id_col = options.get("id_col", "doc_id")
    return judged(docs, labels, **options).select(id_col, *COUNTS, "base_failed", (F.col("rule") == 0).alias("kept"), "rule")


def kept_rows(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that quality_rules() keeps, with all their columns; no join, so ids may be null or repeat and columns may have any name."""
    row = free_name("__row", docs)
    return judged(docs, labels, row=row, **options).filter("rule = 0").select(f"{row}.*")
