"""Evaluation metrics over tables of scores, labels and reference sets, for any number of groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import to_latin_digits

#: The edges of ten equal bins as doubles, as linspace gives them.
EDGES = tuple(i * 0.1 if i not in (3, 6, 7) else {3: 0.30000000000000004, 6: 0.6000000000000001, 7: 0.7000000000000001}[i] for i in range(11))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right's other columns on keys, where a null key is a key of its own. Without keys right is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(named, on, how).drop(*(f"__right_{k}" for k in keys))


def cumulative(df: DataFrame, by: list[str], order: str, values: list[str], ranges: int | None = None) -> DataFrame:
    """df with before_<value>: the sum over rows of the group with a smaller `order` (unique within a group, not null).

    Each group (a null is one) is cut at its own quantiles, so an outlier does not crowd the rest into one range; sums of
    ranges, then sums within a range. No task sees more than a range of one group, or the range sums of one group.
    ranges: as many as there are shuffle partitions, 128 to 1,024, if not given. Without `by` the quantiles are one
    row, which is broadcast.
    """
    ranges = ranges or min(1024, max(128, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    edges = _total(df, by, F.array_distinct(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges)).alias("__edges"))
    part = F.size(F.filter("__edges", lambda e: e < F.col(order))).alias("__range")
    cut = null_safe_join(df, edges, by).select(*df.columns, part)
    sums = cut.groupBy(*by, "__range").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__range", *(F.coalesce(F.sum(f"__{v}").over(w), F.lit(0)).alias(f"__{v}") for v in values))
    inner = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = null_safe_join(cut, sums, [*by, "__range"])
    return out.select(*df.columns, *((F.col(f"__{v}") + F.coalesce(F.sum(v).over(inner), F.lit(0))).alias(f"before_{v}") for v in values))


def _total(df: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def _by_score(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("neg", F.col("n") - F.col("pos"))


def auroc(df: DataFrame, score: str, label: str, by: list[str] = ()) -> DataFrame:
    """auroc of each group, ties counting one half; null for one class only. Rows without a score or label do not count."""
    by = list(by)
    ranked = cumulative(_by_score(df, by, score, label), by, score, ["neg"])
    area = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return _total(ranked, by, F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str, by: list[str] = ()) -> DataFrame:
    """Precision at each score, weighted by the recall it adds; null without positives. Rows without a score or label do not count."""
    by = list(by)
    rows = _by_score(df, by, score, label).withColumn("falling", -F.col(score))
    ranked = cumulative(rows, by, "falling", ["pos", "n"])
    at = (F.col("before_pos") + F.col("pos")) / (F.col("before_n") + F.col("n"))
    return _total(ranked, by, F.try_divide(F.sum(at * F.col("pos")), F.sum("pos")).alias("average_precision"))


def mid_ranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Each distinct value of a group with its average rank."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return cumulative(counts, by, value, ["n"]).select(*by, value, (F.col("before_n") + (F.col("n") + 1) / 2).alias(name))


def spearman(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Correlation of average ranks; 0 where it is undefined. Rows without both values do not count."""
    by = list(by)
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = null_safe_join(null_safe_join(df, mid_ranks(df, x, by, "__rx"), [*by, x]), mid_ranks(df, y, by, "__ry"), [*by, y])
    r = F.try_divide(F.covar_pop("__rx", "__ry"), F.stddev_pop("__rx") * F.stddev_pop("__ry"))
    return _total(both, by, F.coalesce(r, F.lit(0.0)).alias("spearman"))


def bin_of(score: Column, mode: str) -> Column:
    """The bin (from 0) of a score in 0..1, null if it has none.

    "left": ten bins [lo, hi), the last closed; "right": ten bins (lo, hi], the first closed on both sides;
    "five": five bins [lo, hi), where 1.0 has no bin.
    """
    if mode == "five":
        edges = (0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0)
        return F.coalesce(*(F.when((score >= lo) & (score < hi), i) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))))
    pairs = list(enumerate(zip(EDGES[:-1], EDGES[1:], strict=True)))
    if mode == "left":
        return F.coalesce(*(F.when((score >= lo) & ((score < hi) if i < 9 else (score <= hi)), i) for i, (lo, hi) in pairs))
    return F.coalesce(*(F.when(((score > lo) if i else (score >= lo)) & (score <= hi), i) for i, (lo, hi) in pairs))


def reliability(df: DataFrame, score: str, label: str, mode: str = "left", by: list[str] = ()) -> DataFrame:
    """bin, n, confidence and accuracy of each non-empty bin."""
    cut = df.withColumn("bin", bin_of(F.col(score), mode)).filter("bin is not null")
    return cut.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))


def ece(df: DataFrame, score: str, label: str, mode: str = "left", by: list[str] = ()) -> DataFrame:
    """Expected calibration error; rows without a bin still count in the whole. "left" is in percent."""
    by = list(by)
    total = _total(df, by, F.count(F.lit(1)).alias("total"))
    bins = reliability(df, score, label, mode, by)
    joined = null_safe_join(bins, total, by)
    error = F.sum(F.col("n") / F.col("total") * F.abs(F.col("accuracy") - F.col("confidence")))
    return _total(joined, by, (error * (100 if mode == "left" else 1)).alias("ece"))


def brier(df: DataFrame, score: str, label: str, by: list[str] = ()) -> DataFrame:
    return _total(df, list(by), F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier"))


def confusion(df: DataFrame, predicted: str, label: str, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 (0 where undefined) of two 0/1 columns."""
    p, y = F.col(predicted) == 1, F.col(label) == 1
    count = lambda c: F.sum(c.cast("long"))
    out = _total(df, list(by), count(p & y).alias("tp"), count(p & ~y).alias("fp"), count(~p & y).alias("fn"), count(~p & ~y).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def set_scores(predicted: Column, gold: Column, empty: str = "both") -> Column:
    """struct(precision, recall, f1) of two arrays of references, digits folded and repeats dropped.

    empty "both": two empty sets score 1 and one empty set 0; "prediction": an empty prediction scores 0.
    """
    fold = lambda a: F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), to_latin_digits))
    p, g = fold(predicted), fold(gold)
    hits = F.size(F.array_intersect(p, g))
    precision = F.coalesce(F.try_divide(hits, F.size(p)), F.lit(0.0))
    recall = F.coalesce(F.try_divide(hits, F.size(g)), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    none = (F.size(p) == 0) & (F.size(g) == 0) & F.lit(empty == "both")
    one = lambda c: F.when(none, 1.0).otherwise(c)
    return F.struct(one(precision).alias("precision"), one(recall).alias("recall"), one(f1).alias("f1"))


def recall_at(ranked: DataFrame, gold: DataFrame, ks: list[int], key: str = "query_id", item: str = "article_ref", by: list[str] = (), empty: float = 1.0) -> DataFrame:
    """Recall of every query (and `by` group, such as a channel) at each k. Queries without gold score `empty`.

    ranked: key, item, rank (from 1); gold: key, item, with a null item for a query without gold.
    """
    spark = ranked.sparkSession
    cuts = F.broadcast(spark.range(len(ks)).select(F.element_at(F.array(*map(F.lit, ks)), (F.col("id") + 1).cast("int")).alias("k")))
    goals = gold.groupBy(key).agg(F.count_distinct(item).alias("n_gold"))
    groups = ranked.select(*by).distinct() if by else None
    frame = (goals.crossJoin(groups) if by else goals).crossJoin(cuts)  # every query in every channel at each of the ks given
    best = ranked.groupBy(key, item, *by).agg(F.min("rank").alias("rank")).join(gold.select(key, item).distinct(), [key, item], "left_semi")
    hits = best.join(cuts, F.col("rank") <= F.col("k")).groupBy(key, *by, "k").agg(F.count(F.lit(1)).alias("hits"))
    out = frame.join(hits, [key, *by, "k"], "left")
    return out.select(key, *by, "k", F.when(F.col("n_gold") == 0, empty).otherwise(F.coalesce("hits", F.lit(0)) / F.col("n_gold")).alias("recall"))


def correct_any_all(agreed: Column, gold: Column) -> Column:
    """struct(any, all) as 0/1: some gold reference is agreed; all are."""
    return F.struct(F.coalesce(F.arrays_overlap(agreed, gold), F.lit(False)).cast("int").alias("any"), (F.size(F.array_except(gold, agreed)) == 0).cast("int").alias("all"))


def signal_comparison(df: DataFrame, signals: dict[str, tuple[str, str]], mode: str = "five") -> DataFrame:
    """auroc, ece, brier, mean and std of several confidences, each with its own label. signals: name -> (score, label)."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(s).cast("double").alias("score"), F.col(y).cast("int").alias("label")) for n, (s, y) in signals.items()))).alias("x")).select("x.*").filter("score is not null and label is not null")
    stats = long.groupBy("signal").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count(F.lit(1)).alias("n"))
    for part in (auroc(long, "score", "label", ["signal"]), ece(long, "score", "label", mode, ["signal"]), brier(long, "score", "label", ["signal"])):
        stats = stats.join(part, "signal", "left")
    return stats


def split_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """One row a split: sizes, accuracies, calibration, consensus, means and deviations of the e2e table.

    Rows with an error or without a final confidence count as errors only. auroc is null for one class only.
    """
    valid = F.col("error").isNull() & F.col("final_confidence").isNotNull()
    ok = df.filter(valid)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    out = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("correct_any").alias("accuracy_any"), F.avg("correct_all").alias("accuracy_all"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("f1").alias("mean_f1"),
        share(F.col("consensus").isin("full", "majority")).alias("consensus_rate"), share(F.col("consensus") == "full").alias("full_consensus_rate"), share(F.col("consensus") == "split").alias("split_rate"),
        F.avg("final_confidence").alias("mean_confidence"), F.stddev_pop("final_confidence").alias("std_confidence"), share(F.col("uncertainty_flag")).alias("flag_rate"), F.avg(F.coalesce("gold_in_applicable", F.lit(0))).alias("gold_in_applicable_rate"),
    )
    out = df.groupBy(*by).agg(F.sum((~valid).cast("long")).alias("n_errors")).join(out, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    for kind in ("any", "all"):
        out = out.join(auroc(ok, "final_confidence", f"correct_{kind}", by).withColumnRenamed("auroc", f"auroc_{kind}"), by, "left")
        out = out.join(ece(ok, "final_confidence", f"correct_{kind}", "five", by).withColumnRenamed("ece", f"ece_{kind}"), by, "left")
    return out


def mean_f1(scores: DataFrame, by: list[str] = (), f1: str = "f1") -> DataFrame:
    """mean_f1, zero_f1 and n of the queries of a channel (or each of several)."""
    return _total(scores, list(by), F.avg(f1).alias("mean_f1"), F.sum((F.col(f1) == 0).cast("long")).alias("zero_f1"), F.count(F.lit(1)).alias("n"))


def consensus_breakdown(df: DataFrame) -> DataFrame:
    """Per consensus level: n, percent, accuracies, mean confidence, and what raised the flag."""
    split, wide = F.col("consensus") == "split", F.col("agent_conf_std") > 0.20
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    out = df.groupBy("consensus").agg(
        F.count(F.lit(1)).alias("n"), F.avg("correct_any").alias("accuracy_any"), F.avg("correct_all").alias("accuracy_all"), F.avg("final_confidence").alias("mean_confidence"),
        count(split & ~wide).alias("flag_split"), count(~split & wide).alias("flag_std"), count(split & wide).alias("flag_both"),
    )
    total = df.agg(F.count(F.lit(1)).alias("all"))
    return out.crossJoin(F.broadcast(total)).withColumn("percent", 100.0 * F.col("n") / F.col("all")).drop("all")  # one row


def verdict_distribution(df: DataFrame, verdict: str = "majority_verdict") -> DataFrame:
    """Rows by verdict with a total row; a null verdict counts as 'missing'."""
    named = df.select(F.coalesce(verdict, F.lit("missing")).alias("verdict"))  # no null is left, so a null is the total row
    return named.rollup("verdict").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("verdict", F.lit("total")).alias("verdict"), "n")


def pass_report(df: DataFrame, recall: str, case_type: str, bar: float = 0.7) -> DataFrame:
    """Counts by passed (recall at least bar) and case type, with subtotals ('all'); null recalls and case types are 'missing'."""
    named = df.select((F.col(recall) >= bar).cast("string").alias("p"), F.col(case_type).alias("c"))
    table = named.cube("p", "c").agg(F.count(F.lit(1)).alias("n"), F.grouping("p").alias("gp"), F.grouping("c").alias("gc"))
    name = lambda c, g: F.when(F.col(g) == 1, "all").otherwise(F.coalesce(c, F.lit("missing")))
    return table.select(name("p", "gp").alias("passed"), name("c", "gc").alias("case_type"), "n")


def miss_buckets(gold: DataFrame, nodes: DataFrame, articles: DataFrame, citations: DataFrame, near: int = 20, deep: int = 100) -> DataFrame:
    """sample_id and its worst bucket over gold references not found within `near`.

    Severity: not_in_graph > deep_miss (beyond `deep` or nowhere) > near_miss (within `deep`) > found. gold: sample_id,
    ref; nodes: ref; articles and citations: sample_id, ref, rank.
    """
    best = lambda df, name: df.groupBy("sample_id", "ref").agg(F.min("rank").alias(name))
    rows = gold.select("sample_id", "ref").distinct().join(nodes.select("ref").distinct().withColumn("known", F.lit(True)), "ref", "left")
    rows = rows.join(best(articles, "a"), ["sample_id", "ref"], "left").join(best(citations, "c"), ["sample_id", "ref"], "left")
    rank = F.least("a", "c")
    level = F.when(F.col("known").isNull(), 3).when(rank.isNull() | (rank > deep), 2).when(rank > near, 1).otherwise(0)
    names = F.array(*map(F.lit, ("found", "near_miss", "deep_miss", "not_in_graph")))
    return rows.groupBy("sample_id").agg(F.max(level).alias("level")).select("sample_id", F.element_at(names, F.col("level") + 1).alias("bucket"))


def best_rank(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """Best rank and its channel; ties go to the earlier channel number."""
    return ranked.groupBy(key).agg(F.min(F.struct("rank", "channel_no", "channel")).alias("b")).select(key, "b.rank", "b.channel")


def query_rollup(audited: DataFrame, key: str = "query_id") -> DataFrame:
    """Per query: score (mean confidence of applicable rows), prune ratio, precision, recall and f1 against gold flags."""
    kept = F.col("is_applicable")
    tp = F.sum((kept & F.col("gold")).cast("long"))
    out = audited.groupBy(key).agg(
        F.coalesce(F.avg(F.when(kept, F.col("auditor_confidence"))), F.lit(0.0)).alias("score"), F.avg((~kept).cast("double")).alias("prune_ratio"),
        F.coalesce(F.try_divide(tp, F.sum(kept.cast("long"))), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp, F.sum(F.col("gold").cast("long"))), F.lit(0.0)).alias("recall"),
    )
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
