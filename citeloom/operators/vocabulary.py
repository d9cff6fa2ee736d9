"""Curation of a closed vocabulary: merging, conflicts, audits, rule tables, n-gram counts and gap candidates.

vocab: category, canonical, raw, is_canonical, ord.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import match_key
from citeloom.operators.terms import token_slices


def merged_terms(source: DataFrame, separator: str = " ؛ ") -> DataFrame:
    """term and its distinct non-blank meanings in first-seen order. source: ord, term, meaning."""
    rows = source.withColumn("meaning", F.trim("meaning"))
    kept = F.collect_list(F.when(F.col("meaning") != "", F.struct("ord", "meaning")))
    return rows.groupBy("term").agg(F.min("ord").alias("ord"), F.array_join(F.array_distinct(F.transform(F.array_sort(kept), lambda x: x["meaning"])), separator).alias("meaning"))


def last_records(checkpoint: DataFrame, key: str = "term", order: str = "seq") -> DataFrame:
    """The last record of each key."""
    rest = [c for c in checkpoint.columns if c not in (key, order)]
    return checkpoint.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def conflicts(checkpoint: DataFrame) -> DataFrame:
    """Terms with more than one (category, root)."""
    return checkpoint.groupBy("term").agg(F.count_distinct("category", "root").alias("n")).filter("n > 1")


def failed_batches(asked: DataFrame, answered: DataFrame, labels: list[str]) -> DataFrame:
    """Batches whose answers differ in terms or order, or hold an unknown label or a blank root. Both: batch, pos, term."""
    both = asked.select("batch", "pos", F.col("term").alias("want")).join(answered, ["batch", "pos"], "full")
    bad = F.col("want").isNull() | F.col("term").isNull() | (F.col("want") != F.col("term")) | ~F.coalesce(F.col("category").isin(labels), F.lit(False)) | (F.coalesce(F.trim("root"), F.lit("")) == "")
    return both.filter(bad).groupBy("batch").agg(F.count(F.lit(1)).alias("n_bad"))


def exported(records: DataFrame, skip: str = "skip") -> DataFrame:
    """category, root, sorted aliases, n; skipped terms are left out."""
    return records.filter(F.col("category") != skip).groupBy("category", "root").agg(F.array_sort(F.collect_set("term")).alias("aliases"), F.count_distinct("term").alias("n"))


def cross_category(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("raw").agg(F.count_distinct("category").alias("n")).filter("n > 1")


def corrupted(vocab: DataFrame, pattern: str = "[a-zA-Z]") -> DataFrame:
    return vocab.filter(F.col("raw").rlike(pattern)).select("category", "raw").distinct()


def near_duplicates(vocab: DataFrame, key: Column | None = None) -> DataFrame:
    """Groups of terms of a category that share a match key."""
    key = match_key(F.col("raw")) if key is None else key
    return vocab.select("category", key.alias("key"), "raw").distinct().groupBy("category", "key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("raw")).alias("terms")).filter("n > 1")


def skip_overlap(skipped: DataFrame, vocab: DataFrame) -> DataFrame:
    return skipped.select("term").intersect(vocab.select(F.col("raw").alias("term")))


def lost_markers(vocab: DataFrame, markers: list[str]) -> DataFrame:
    """Aliases that are a marker plus their root, or the root plus a marker."""
    row = vocab.filter(F.col("raw") != F.col("canonical")).withColumn("marker", F.explode(F.array(*map(F.lit, markers))))
    return row.filter((F.col("raw") == F.concat_ws(" ", "marker", "canonical")) | (F.col("raw") == F.concat_ws(" ", "canonical", "marker"))).select("category", "canonical", "raw", "marker")


def corrected(vocab: DataFrame, rules: DataFrame) -> DataFrame:
    """vocab after rules (category, action, term, keep), all judged on the state before.

    remove, skip: the canonical goes with its aliases; merge: it and its aliases move to `keep`; remove_if_elsewhere:
    it goes if another category has the term.
    """
    r = rules.select("category", F.col("term").alias("canonical"), "action", "keep")
    elsewhere = vocab.select(F.col("raw").alias("canonical"), F.col("category").alias("other")).distinct()
    held = r.filter("action = 'remove_if_elsewhere'").join(elsewhere, "canonical").filter("other != category").select("category", "canonical").distinct()
    gone = r.filter("action in ('remove', 'skip')").select("category", "canonical").unionByName(held)
    moves = r.filter("action = 'merge'").select("category", "canonical", "keep")
    rows = vocab.join(gone, ["category", "canonical"], "left_anti").join(moves, ["category", "canonical"], "left")
    moved = F.col("keep").isNotNull()
    rows = rows.select("category", F.coalesce("keep", "canonical").alias("canonical"), "raw", (F.col("is_canonical") & ~moved).alias("is_canonical"), "ord")
    return rows.groupBy("category", "canonical", "raw").agg(F.max("is_canonical").alias("is_canonical"), F.min("ord").alias("ord"))


def reviewed(candidates: DataFrame, vocab: DataFrame, categories: list[str]) -> DataFrame:
    """candidates (term, decision) with kind (new, alias, skipped, invalid), category and canonical."""
    alias = F.when(F.col("decision").startswith("alias:"), F.trim(F.expr("substring(decision, 7)")))
    homes = vocab.filter("is_canonical").groupBy("canonical").agg(F.min(F.struct("ord", "category"))["category"].alias("home"))
    rows = candidates.withColumn("decision", F.trim(F.coalesce("decision", F.lit("")))).withColumn("of", alias).join(homes, F.col("of") == F.col("canonical"), "left").drop("canonical")
    kind = F.when(F.col("decision").isin("", "REMOVE"), "skipped").when(F.col("decision").isin(categories), "new").when(F.col("home").isNotNull(), "alias").otherwise("invalid")
    rows = rows.withColumn("kind", kind)
    return rows.select("term", "decision", "kind", F.when(F.col("kind") == "new", F.col("decision")).when(F.col("kind") == "alias", F.col("home")).alias("category"), F.when(F.col("kind") == "new", F.col("term")).when(F.col("kind") == "alias", F.col("of")).alias("canonical"))


def grams(tokens: Column, stopwords: list[str]) -> Column:
    """Unigrams and bigrams of true neighbours; grams of stopwords alone are dropped, a one-letter token parts its neighbours."""
    real = lambda t: F.length(t) > 1
    stop = lambda t: t.isin(stopwords) if stopwords else F.lit(False)
    ones = F.filter(tokens, lambda t: real(t) & ~stop(t))
    pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.when(b.isNotNull() & real(a) & real(b) & ~(stop(a) & stop(b)), F.concat_ws(" ", a, b)))
    return F.concat(ones, F.array_compact(pairs))


def _partial_counts(tokens: pa.Array, stopwords: frozenset[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The grams (as grams() gives them) of some documents' tokens: gram, how often it comes, and in how many documents."""
    size = np.diff(tokens.offsets.to_numpy())
    size[np.asarray(tokens.is_null())] = 0
    codes = tokens.flatten().dictionary_encode()
    words = codes.dictionary.cast(pa.string())
    n = max(1, len(words))
    code = codes.indices.fill_null(n).to_numpy().astype(np.int64)
    real = np.append(np.asarray(pc.greater(pc.utf8_length(words), 1)), False)  # the last: a null
    stop = np.append(np.asarray(pc.is_in(words, pa.array(sorted(stopwords), pa.string()))), False)
    row = np.repeat(np.arange(len(size)), size)
    ones = np.flatnonzero(real[code] & ~stop[code])
    left, right = code[:-1], code[1:]
    pairs = np.flatnonzero((row[1:] == row[:-1]) & real[left] & real[right] & ~(stop[left] & stop[right]))
    # a gram's number: its only word's, or n and up for two words
    gram = np.concatenate((code[ones], n + left[pairs] * n + right[pairs]))
    held, which = np.unique(gram, return_inverse=True)
    of_row, times = np.unique(np.concatenate((row[ones], row[pairs])) * max(1, len(held)) + which, return_counts=True)
    at = of_row % max(1, len(held))
    single = np.searchsorted(held, n)
    double = held[single:] - n
    names = pa.concat_arrays([words.take(pa.array(held[:single])), pc.binary_join_element_wise(words.take(pa.array(double // n)), words.take(pa.array(double % n)), " ")])
    return names, np.bincount(at, times, len(held)).astype(np.int64), np.bincount(at, minlength=len(held))


def gram_counts(docs: DataFrame, stopwords: list[str], most: int = 1 << 18) -> DataFrame:
    """gram, total and n_docs. docs: tokens, one row a document; null tokens part their neighbours.

    The words of a part of a batch are numbered and its grams counted as pairs of numbers, so what leaves a task is one row for each gram of a
    part; one shuffle adds them up. A part is `most` tokens, or one longer document: its arrays have a place for each token.
    """
    stops = frozenset(stopwords)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in token_slices(batch, 0, most):
                names, total, n_docs = _partial_counts(part.column(0), stops)
                yield pa.RecordBatch.from_arrays([names, pa.array(total), pa.array(n_docs.astype(np.int64))], names=["gram", "total", "n_docs"])

    parts = docs.select("tokens").mapInArrow(count, "gram string, total long, n_docs long")
    return parts.groupBy("gram").agg(F.sum("total").alias("total"), F.sum("n_docs").alias("n_docs"))


def gap_candidates(counts: DataFrame, vocab: DataFrame, least: int = 50, key=match_key) -> DataFrame:
    """Grams of at least `least` documents whose key the vocabulary lacks."""
    rows = counts.filter(F.col("n_docs") >= least).withColumn("key", key(F.col("gram")))
    return rows.join(vocab.select(key(F.col("raw")).alias("key")).distinct(), "key", "left_anti")


def gap_report(candidates: DataFrame, nearest: DataFrame, bar: float = 0.87) -> DataFrame:
    """candidates with the nearest term and a verdict: alias from `bar` on, else new. nearest: gram, nearest, score."""
    return candidates.join(nearest, "gram", "left").withColumn("verdict", F.when(F.col("score") >= bar, "alias").otherwise("new"))


def coverage(counts: DataFrame, vocab: DataFrame, candidates: DataFrame, key=match_key) -> DataFrame:
    """Share of single-token occurrences that the vocabulary covers, before and after approving all candidates."""
    known = vocab.select(key(F.col("raw")).alias("key")).distinct().withColumn("known", F.lit(1))
    more = candidates.select("gram").distinct().withColumn("more", F.lit(1))
    rows = counts.filter(~F.col("gram").contains(" ")).withColumn("key", key(F.col("gram"))).join(known, "key", "left").join(more, "gram", "left")
    share = lambda c: F.try_divide(F.sum(F.when(c, F.col("total")).otherwise(0)), F.sum("total"))
    return rows.agg(share(F.col("known").isNotNull()).alias("before"), share(F.col("known").isNotNull() | F.col("more").isNotNull()).alias("after"))


def lost_phrases(before: DataFrame, after: DataFrame, vocab: DataFrame, expected: DataFrame) -> DataFrame:
    """Vocabulary phrases among the grams before cleaning and not after; expected: those within the given phrases."""
    gone = before.select("gram").join(vocab.select(F.col("raw").alias("gram")).distinct(), "gram", "left_semi").join(after.select("gram"), "gram", "left_anti").distinct()
    return gone.join(expected.select(F.col("phrase").alias("gram")).distinct().withColumn("e", F.lit(True)), "gram", "left").select("gram", F.coalesce("e", F.lit(False)).alias("expected"))


def index(vocab: DataFrame, key=match_key) -> DataFrame:
    """category, key and canonical: a canonical entry beats aliases; the last canonical and the first alias win."""
    order = F.when(F.col("is_canonical"), -F.col("ord")).otherwise(F.col("ord"))
    r = F.row_number().over(Window.partitionBy("category", "key").orderBy(F.desc("is_canonical"), order))
    return vocab.withColumn("key", key(F.col("raw"))).withColumn("r", r).filter("r = 1").select("category", "key", "canonical", "ord")
