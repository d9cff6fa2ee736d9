"""Features on rulings: resolving values, cleaning extracted rows, locating quotes, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import match_key
from citeloom.operators.terms import term_places, words_of
from citeloom.operators.vocabulary import index


def resolved(values: DataFrame, vocab: DataFrame, key=match_key, split: str = "\\s+") -> DataFrame:
    """values (category, value, ...) with canonical: the exact key, else the longest token run in the value, ties to the first term; else null."""
    exact = index(vocab, key).select("category", F.col("key").alias("k"), F.col("canonical").alias("exact"))
    terms = vocab.select("category", F.array_join(words_of("raw", split), " ").alias("gram"), F.col("canonical").alias("term"), "ord").groupBy("category", "gram").agg(F.min(F.struct("ord", "term")).alias("t"))
    keys = values.select("category", "value").distinct()
    runs = term_places(keys.select("category", "value", words_of("value", split).alias("tokens")), vocab, ["category", "value"], split=split)
    found = runs.join(terms, ["category", "gram"]).groupBy("category", "value").agg(F.max(F.struct("n", (-F.col("t.ord")).alias("o"), F.col("t.term").alias("term")))["term"].alias("contained"))
    known = keys.withColumn("k", key(F.col("value"))).join(exact, ["category", "k"], "left").join(found, ["category", "value"], "left").select("category", "value", F.coalesce("exact", "contained").alias("canonical"))
    return values.join(known, ["category", "value"], "left")


def parsed_json(answers: DataFrame, schema: str, raw: str = "raw", name: str = "parsed") -> DataFrame:
    """answers with the struct that a (possibly fenced) JSON answer holds; null where it is not JSON."""
    return answers.withColumn(name, F.from_json(F.regexp_replace(raw, "(?s)^\\s*```(?:json)?\\s*|\\s*```\\s*$", ""), schema, {"mode": "PERMISSIVE"}))


def _first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches without rows that have the key of a row with a smaller pos (or the same, earlier) in their batch. Columns: ruling_id, category, value, pos, more."""
    for batch in batches:
        number = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns[:3]:
            codes = column.dictionary_encode(null_encoding="encode")
            number = number * len(codes.dictionary) + codes.indices.to_numpy()
            number = np.unique(number, return_inverse=True)[1] if number.max(initial=0) >> 40 else number
        place = np.asarray(pc.sort_indices(batch.column(3), null_placement="at_start"))  # as in Spark, nulls come first
        kept = np.sort(place[np.unique(number[place], return_index=True)[1]])
        yield batch.take(pa.array(kept))


def cleaned(rows: DataFrame) -> DataFrame:
    """Blank values go; the first row of each (ruling, category, value) by pos stays; then rows without a quote go.

    Rows of a batch that another one of it rules out never leave their task, and nothing is sorted before the shuffle.
    """
    key = ["ruling_id", "category", "value"]
    known = rows.filter(F.trim("value") != "").select(*key, "pos", *(c for c in rows.columns if c not in (*key, "pos")))
    sent = known.mapInArrow(_first_of_batch, known.schema).repartition(*key)
    r = F.row_number().over(Window.partitionBy(*key).orderBy("pos"))
    return sent.withColumn("r", r).filter("r = 1").select(*rows.columns).filter(F.coalesce(F.trim("quote"), F.lit("")) != "")


#: White space of all scripts and invisible characters, which a quote and its text may have unlike.
SKIPPED = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200f\\u2028-\\u202f\\u205f\\u2060\\u3000\\ufeff]"


def located(rows: DataFrame, texts: DataFrame, key: str = "ruling_id", most: int = 1024) -> DataFrame:
    """rows with start_char and end_char of the quote in the text: exact, else ignoring white space and invisible characters, else null.

    The quotes of a text go to it together, `most` at a time, so a text is not copied to each of them. Where one is not
    there exactly, the text's normal form, without what is skipped, is searched, and an array of the places that
    its characters had maps back. texts: key (distinct), text. Quotes that are null or hold nothing to search for,
    and quotes of a missing text, are nowhere.
    """
    own = rows.columns
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select(F.col(key).alias("__key"), F.ceil(F.col("__n") / most).cast("int").alias("__parts"))
    dealt = rows.join(many, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn("__part", F.pmod(F.xxhash64(*own), F.coalesce("__parts", F.lit(1))))
    per = dealt.groupBy(key, "__part").agg(F.collect_list(F.struct(*own)).alias("__rows"))
    both = per.join(texts.select(key, F.col("text").alias("__text")), key, "left")
    text = F.coalesce("__text", F.lit(""))
    normal = lambda c: F.regexp_replace(c, SKIPPED, "")
    quote = lambda r: F.coalesce(r["quote"], F.lit(""))
    exact = F.transform("__rows", lambda r: F.struct(r.alias("row"), F.instr(text, quote(r)).alias("at")))
    both = both.withColumn("__found", exact)
    loose = F.exists("__found", lambda f: f["at"] == 0)
    # one place for each character, also for those that take two units
    letters = F.split(F.regexp_replace(text, "[\\x{10000}-\\x{10ffff}]", "x"), "")
    kept = F.filter(F.transform(letters, lambda c, i: F.when(c.rlike(f"^{SKIPPED}$"), -1).otherwise(i)), lambda i: i >= 0)
    both = both.withColumn("__places", F.when(loose, kept)).withColumn("__normal", F.when(loose, normal(text)))
    out = both.select("__places", "__normal", F.explode("__found").alias("f"))
    bare = F.when(F.col("f.at") == 0, normal(F.coalesce("f.row.quote", F.lit(""))))
    near = F.when(F.coalesce(bare, F.lit("")) != "", F.instr("__normal", bare)).otherwise(0)
    out = out.select("f.row.*", F.col("f.at").alias("__at"), near.alias("__near"), F.length(bare).alias("__size"), "__places")
    at, size = F.col("__at"), F.length("quote")
    start = F.when((at > 0) & (size > 0), at - 1).when(F.col("__near") > 0, F.try_element_at("__places", F.col("__near")))
    end = F.when((at > 0) & (size > 0), at - 1 + size).when(F.col("__near") > 0, F.try_element_at("__places", F.col("__near") + F.col("__size") - 1) + 1)
    return out.select(*own, start.cast("int").alias("start_char"), end.cast("int").alias("end_char"))


def feature_nodes(features: DataFrame) -> DataFrame:
    """Distinct (category, value); facts are never merged and stay out."""
    return features.filter("category != 'fact'").select("category", "value").distinct()


def feature_edges(features: DataFrame) -> DataFrame:
    """One edge a mention: ruling_id, node, category, value, quote, start_char, end_char, confidence.

    node: `category:value` for a closed category, so all mentions share it; a fact is a node of its own, named by its
    ruling and pos.
    """
    node = F.when(F.col("category") == "fact", F.concat_ws(":", F.lit("fact"), "ruling_id", F.col("pos").cast("string"))).otherwise(F.concat_ws(":", "category", "value"))
    return features.select("ruling_id", node.alias("node"), "category", "value", "quote", "start_char", "end_char", "confidence")


def orphans(features: DataFrame, rulings: DataFrame) -> DataFrame:
    """ruling_id of features without a ruling, with matches_as_int: whether a ruling has the same number in another spelling."""
    lost = features.select(F.col("ruling_id").cast("string").alias("ruling_id")).distinct().join(rulings.select(F.col("ruling_id").cast("string").alias("ruling_id")), "ruling_id", "left_anti")
    numbers = rulings.select(F.col("ruling_id").cast("string").try_cast("long").alias("as_int")).filter("as_int is not null").distinct().withColumn("m", F.lit(True))
    return lost.withColumn("as_int", F.col("ruling_id").try_cast("long")).join(numbers, "as_int", "left").select("ruling_id", F.coalesce("m", F.lit(False)).alias("matches_as_int"))


def extraction_stats(features: DataFrame, required: list[str]) -> DataFrame:
    """One row: rows, rulings, unlocated share, low, middle and high confidences, rulings without any required role."""
    need = F.max(((F.col("category") == "role") & F.col("value").isin(required)).cast("int"))
    c = F.col("confidence")
    counts = {"low": c < 0.5, "middle": (c >= 0.5) & (c < 0.8), "high": c >= 0.8, "__unlocated": F.col("start_char").isNull()}
    # the sums of rulings are summed, so the features are read once
    per = features.groupBy("ruling_id").agg(need.alias("has"), F.count(F.lit(1)).alias("__n"), *(F.sum(x.cast("long")).alias(n) for n, x in counts.items()))
    n = F.coalesce(F.sum("__n"), F.lit(0))
    return per.agg(n.alias("n"), F.try_divide(F.sum("__unlocated"), n).alias("unlocated"), *(F.sum(x).alias(x) for x in ("low", "middle", "high")), F.count(F.lit(1)).alias("n_rulings"), F.sum(1 - F.col("has")).alias("n_lacking"))


def top_values(features: DataFrame, category: str, k: int = 15) -> DataFrame:
    return features.filter(F.col("category") == category).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def confidence_histogram(features: DataFrame, digits: int | None = None) -> DataFrame:
    """confidence, n and share of each value of the features' confidence, null among them; digits: values are rounded to so many first."""
    value = F.col("confidence") if digits is None else F.round("confidence", digits)
    counts = features.groupBy(value.alias("confidence")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select("confidence", "n", (F.col("n") / F.col("__all")).alias("share"))  # one row
