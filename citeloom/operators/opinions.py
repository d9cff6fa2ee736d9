"""Fusion of several opinions on a case into one verdict and confidence.

opinions: case_id, pos, role, verdict, confidence, cited_articles (array).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.retrieval import leveled


def completed(opinions: DataFrame) -> DataFrame:
    """Cases of two opinions get a copy of the last one as a neutral filler of confidence 0.5; its citations count again."""
    w = Window.partitionBy("case_id")
    rows = opinions.withColumns({"n": F.count(F.lit(1)).over(w), "r": F.row_number().over(w.orderBy(F.desc("pos")))})
    filler = rows.filter("n = 2 and r = 1").withColumns({"pos": F.col("pos") + 1, "role": F.lit("filler"), "verdict": F.lit("neutral"), "confidence": F.lit(0.5)})
    return rows.unionByName(filler).drop("n", "r")


def wrong_sized(opinions: DataFrame, size: int = 3) -> DataFrame:
    """Cases with another number of opinions, for the error table."""
    return opinions.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != size)


def majority(opinions: DataFrame) -> DataFrame:
    """case_id, majority_verdict and consensus (full, majority, or split: then neutral) of cases of exactly three opinions."""
    votes = opinions.groupBy("case_id", "verdict").agg(F.count(F.lit(1)).alias("votes"))
    per = votes.groupBy("case_id").agg(F.sum("votes").alias("n"), F.max("votes").alias("most"), F.max_by("verdict", "votes").alias("top")).filter("n = 3")
    level = F.when(F.col("most") == 3, "full").when(F.col("most") == 2, "majority").otherwise("split")
    return per.select("case_id", F.when(F.col("most") == 1, "neutral").otherwise(F.col("top")).alias("majority_verdict"), level.alias("consensus"))


def _mean(values: Column) -> Column:
    """The mean of an array of doubles, summed from the left; null if it is empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values))


def _deviation(values: Column) -> Column:
    """The sample deviation of an array of doubles by Welford's sums from the left; null for fewer than two."""

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (x - mean) * (x - s["mean"])).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(values, start, step, lambda s: F.when(s["n"] > 1, F.sqrt(s["m2"] / (s["n"] - 1))))


def fused(opinions: DataFrame, priors: DataFrame, prior_weight: float = 0.4, split_penalty: float = 0.1, wide: float = 0.2, digits: int | None = 4) -> DataFrame:
    """majority() with final_confidence, level, uncertainty_flag and notes. priors: case_id, score, prune_ratio.

    Mean and deviation are taken one opinion after the other by pos, so that neither depends on how rows were dealt.
    """
    voted = majority(opinions)  # cases of three, so no list is long
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("confidence").isNotNull(), F.struct("pos", F.col("confidence").cast("double").alias("c"))))), lambda x: x["c"])
    stats = opinions.join(voted.select("case_id"), "case_id", "left_semi").groupBy("case_id").agg(listed.alias("l")).select("case_id", _mean(F.col("l")).alias("agent_conf_mean"), _deviation(F.col("l")).alias("agent_conf_std"))
    rows = voted.join(stats, "case_id").join(priors, "case_id")
    split = F.col("consensus") == "split"
    raw = F.col("score") * prior_weight + F.col("agent_conf_mean") * (1 - prior_weight)
    raw = F.least(F.lit(1.0), F.when(split, F.greatest(F.lit(0.0), raw - split_penalty)).otherwise(raw))
    flag = split | (F.col("agent_conf_std") > wide)
    notes = F.array_compact(F.array(F.when(flag, "uncertain"), F.when(F.col("prune_ratio") > 0.5, "pruned")))
    rows = rows.withColumn("final_confidence", raw if digits is None else F.round(raw, digits))
    return rows.withColumns({"level": leveled(F.col("final_confidence"), 0.7, 0.45), "uncertainty_flag": flag, "notes": notes})


def agreed_refs(opinions: DataFrame, least: int = 2) -> DataFrame:
    """case_id, agreed (references of at least two opinions), all_cited and verdict_spread (by role)."""
    once = opinions.select("case_id", "role", F.explode_outer(F.array_distinct("cited_articles")).alias("ref"))
    counts = once.groupBy("case_id", "ref").agg(F.count("ref").alias("n"))
    refs = counts.groupBy("case_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") >= least, F.col("ref")))).alias("agreed"), F.array_sort(F.collect_list("ref")).alias("all_cited"))
    spread = opinions.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("role", "verdict")))).alias("verdict_spread"))
    return refs.join(spread, "case_id")


def case_summary(cases: DataFrame, labels: dict[str, str], actions: dict[str, list[str]]) -> DataFrame:
    """cases (majority_verdict, checklist) with label, reason (first failed necessary item, else first satisfied) and actions."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    steps = F.create_map(*[x for k, v in actions.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    failed = F.filter("checklist", lambda i: i["necessary"] & ~i["satisfied"])
    met = F.filter("checklist", lambda i: i["satisfied"])
    reason = F.coalesce(F.try_element_at(failed, F.lit(1))["condition"], F.try_element_at(met, F.lit(1))["condition"])
    return cases.withColumns({"label": table[F.col("majority_verdict")], "reason": reason, "actions": F.coalesce(steps[F.col("majority_verdict")], F.array().cast("array<string>"))})


def citation_leaks(opinions: DataFrame, audited: DataFrame) -> DataFrame:
    """case_id, role, ref: references cited although neither applicable nor topical. audited: case_id, article_ref, flags."""
    bad = audited.filter(~F.col("is_applicable") & ~F.col("topically_relevant")).select("case_id", F.col("article_ref").alias("ref")).distinct()
    return opinions.select("case_id", "role", F.explode("cited_articles").alias("ref")).distinct().join(bad, ["case_id", "ref"], "left_semi")
