"""Filter interaction audit: what each filter removes, repeats and costs in every order of the filters.

Each filter has one stored relation of the rows that fail it. Only rows that fail something are looked at further:
left-anti joins with these relations, one filter after the other, give the survivors of every set of filters (an
order's prefix is a set, so 2**n sets stand for all orders). The failing rows of a filter semi-joined with the survivors
of a set are what it removes after that set; anti-joined, they are redundant there. Marks of labels come by
semi-joins as well. The counts of a part, one row for each (set, next filter), are joined to the table of orders last.

Rows have numbers of their own, so null and repeated ids count as what they are. All joins are on row numbers, or on
(digest of a text, id): no key is hot, however many copies a text has. They are sort-merge joins by hint: stored tables of
row numbers and marks take a byte or two a row on disk, so to the planner tables of all rows look small enough to broadcast.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import Scratch, scratch_of
from citeloom.llm.textarrays import Words
from citeloom.llm.tokens import slices

MEASURES = ("n_words", "n_distinct", "n_upper", "n_chars", "n_marks")
#: Characters of filter D.
MARKS = b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

#: Row filters of the audit, by letter: the failure condition on MEASURES, in whole numbers.
RULES: dict[str, Callable[[], Column]] = {
    "A": lambda: F.col("n_words") < 200,
    "B": lambda: F.col("n_distinct") * 100 < F.col("n_words") * 50,
    "C": lambda: F.col("n_upper") * 100 > F.col("n_chars") * 2,
    "D": lambda: F.col("n_marks") > 0,
}


def merged(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str) -> DataFrame:
    """A join that never sends a side through the driver, however small its files are."""
    return left.join(right.hint("merge"), on, how)


def measured(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The named columns with MEASURES of the whole text: words, distinct words, [A-Z], code points, and MARKS."""
    schema = T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(n, T.LongType()) for n in MEASURES)])
    table = np.zeros((3, 256), np.int64)
    table[0, 65:91] = 1
    table[1] = 1
    table[1, 128:192] = 0  # bytes that go on with a character
    table[2, list(MARKS)] = 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, 4 << 20):
                words = Words(part.column(part.num_columns - 1))
                used = np.zeros((part.num_rows, 256), np.int64)
                distinct = np.zeros(part.num_rows, np.int64)
                for i in range(part.num_rows):
                    used[i] = np.bincount(words.data[words.text_at[i] : words.text_at[i + 1]], minlength=256)
                    own = np.sort(words.hash[words.at[i] : words.at[i + 1]])
                    distinct[i] = len(own) and 1 + np.count_nonzero(own[1:] != own[:-1])
                found = (words.counts().astype(np.int64), distinct, *(used @ table.T).T)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(np.ascontiguousarray(x)) for x in found)], names=schema.names)

    return docs.select(*columns, F.col(text)).mapInArrow(count, schema)


def later_copies(rows: DataFrame, id_col: str, digest: str) -> DataFrame:
    """The rows whose id is larger than the least id of their digest. A row without an id is none, and no copy of one.

    The join's key holds the id, so a text with many copies is no hot key.
    """
    first = rows.groupBy(digest).agg(F.min(id_col).alias(id_col)).filter(F.col(id_col).isNotNull())
    return merged(rows.filter(F.col(id_col).isNotNull()), first, [digest, id_col], "left_anti")


def survivors(touched: DataFrame, fails: list[DataFrame]) -> DataFrame:
    """(row, part, done): the touched rows that pass all filters of the set `done` (a bit mask), for every set."""
    state = touched.withColumn("done", F.lit(0))
    for i, failing in enumerate(fails):
        both = state.withColumn("applied", F.explode(F.array(F.lit(False), F.lit(True))))
        gone = failing.select(F.col("row").alias("gone"))
        left = merged(both, gone, (F.col("row") == F.col("gone")) & F.col("applied"), "left_anti")
        state = left.select("row", "part", F.when(F.col("applied"), F.col("done") + (1 << i)).otherwise(F.col("done")).alias("done"))
    return state


def orders(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, filter, the set before it as a bit mask) of all orders of the filters."""
    out = []
    for order in itertools.permutations(range(len(letters))):
        name, done = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            out.append((name, step, i, done))
            done |= 1 << i
    return out


def audited(rows: DataFrame, fails: dict[str, DataFrame], scratch: Scratch) -> DataFrame:
    """(part, filter_order, step, COUNTS) from rows (row, part, good, toxic) and the failing rows (row) of each filter."""
    letters = "".join(fails)
    n = len(letters)
    # one id table a filter, with the marks that losses need
    tables = [scratch.stored(merged(rows, f.select("row"), "row", "left_semi"), f"fails-{c}") for c, f in fails.items()]
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    touched = scratch.stored(union([t.select("row", "part") for t in tables]).dropDuplicates(["row"]), "touched")
    alive = scratch.stored(survivors(touched, tables), "survivors")
    clean = merged(rows, touched.select("row"), "row", "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("clean"))
    failing = union([t.withColumn("f", F.lit(i)).withColumn("done", F.explode(F.array(*(F.lit(m) for m in range(1 << n) if not m >> i & 1)))) for i, t in enumerate(tables)])
    here = alive.select("row", "done")
    count = F.count(F.lit(1))
    one = lambda c: F.sum(F.col(c).cast("long"))
    removed = merged(failing, here, ["row", "done"], "left_semi").groupBy("part", "f", "done").agg(count.alias("removed"), one("good").alias("good_lost"), one("toxic").alias("toxic_lost"))
    redundant = merged(failing, here, ["row", "done"], "left_anti").groupBy("part", "f", "done").agg(count.alias("redundant"))
    alone = []
    for i, t in enumerate(tables):
        others = [o.select("row") for j, o in enumerate(tables) if j != i]
        only = reduce(lambda left, o: merged(left, o, "row", "left_anti"), others, t)
        alone.append(only.withColumn("f", F.lit(i)))
    unique = union(alone).groupBy("part", "f").agg(count.alias("unique_fails"))
    left = alive.groupBy("part", "done").agg(count.alias("left"))
    # per part: one row for each (next filter, set before it), zeros included; all that follows is as small as the parts
    parts = rows.select("part").distinct()
    cells = parts.withColumn("f", F.explode(F.array(*map(F.lit, range(n))))).withColumn("done", F.explode(F.array(*map(F.lit, range(1 << n)))))
    cells = cells.filter("(done & shiftleft(1, f)) = 0")
    cells = cells.withColumn("after", F.expr("done | shiftleft(1, f)"))
    for counts, on in ((removed, ["part", "f", "done"]), (redundant, ["part", "f", "done"]), (unique, ["part", "f"]), (clean, "part"), (left.withColumnRenamed("done", "after"), ["part", "after"])):
        cells = merged(cells, counts, on, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    cells = cells.select("part", "f", "done", (zero("clean") + zero("left")).alias("kept"), *(zero(c).alias(c) for c in COUNTS[1:-1]))
    cells = scratch.stored(cells, "cells")
    # a set of m filters stands before a filter in m! * (n - 1 - m)! orders
    weights = [math.factorial(m) * math.factorial(n - 1 - m) for m in range(n)]
    weight = F.element_at(F.array(*map(F.lit, weights)), F.bit_count("done") + 1)
    shapley = cells.groupBy("part", "f").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    steps = rows.sparkSession.createDataFrame(orders(letters), "filter_order string, step int, f int, done int")
    out = merged(cells, shapley, ["part", "f"], "inner").join(F.broadcast(steps), ["f", "done"])  # the table of orders: n * n! rows, 600 of five filters
    return out.select("part", "filter_order", "step", *COUNTS)


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", rules: dict[str, Callable[[], Column]] = RULES, copies: str = "E", scratch: Scratch | None = None
) -> DataFrame:
    """Per part (value of source, null as ''), order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    rules: letter and failure condition on MEASURES; copies: the letter of one more filter, on rows whose whole text (null
    as '') comes with a smaller id anywhere in the table. Words are runs outside ASCII white space; a null text is empty. A
    null id is not smaller than any and never fails `copies`; repeated rows are counted each. Labels with a null
    id, or an id that is in no row, mark nothing; of several labels of an id any 1 counts. A source without failures
    has rows of zeros; an empty table gives an empty table. A text of any length is measured whole. Other columns are
    not read, whatever their names.
    """
    scratch = scratch_of(docs, scratch, "audit")
    part = F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part")
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), part, F.unhex(F.sha2(whole, 256)).alias("digest"), whole.alias("__text"))
    rows = scratch.stored(measured(plain, ["row", "id", "part", "digest"], "__text"), "measures")
    marked = rows.select("row", "id", "part")
    for name, column in (("good", "quality"), ("toxic", "toxic")):
        ids = labels.filter(F.col(column) == 1).select(F.col(id_col).alias("id"))
        hit = merged(marked, ids, "id", "left_semi").select("row").withColumn(name, F.lit(True))
        marked = merged(marked, hit, "row", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    marked = scratch.stored(marked.drop("id"), "marked")
    fails = {letter: rows.filter(rule()).select("row") for letter, rule in rules.items()}
    fails[copies] = later_copies(rows.select("row", "id", "digest"), "id", "digest").select("row")
    return audited(marked, fails, scratch)
