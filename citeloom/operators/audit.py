"""Checklist audits of query-article pairs and the confidence they give a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.retrieval import leveled

ITEM = "array<struct<condition:string,necessary:boolean,satisfied:boolean>>"
#: Words of doubt that count as not satisfied, and the words, numbers and spellings that are booleans.
DOUBT = ("unknown", "unclear", "uncertain", "insufficient", "n/a", "none", "null")
TRUE, FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")


def _boolean(item: Column, path: str, doubt: bool = False) -> Column:
    """A JSON value as a boolean: itself, 0 or 1, or a word for either; null for anything else. doubt: words of doubt are false."""
    kind = F.schema_of_variant(F.try_variant_get(item, path, "variant"))
    text, number = F.lower(F.try_variant_get(item, path, "string")), F.try_variant_get(item, path, "double")
    word = F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)
    word = F.when(F.trim(text).isin(*DOUBT), False).otherwise(word) if doubt else word
    return F.when(kind == "BOOLEAN", F.try_variant_get(item, path, "boolean")).when(kind == "STRING", word).when(number == 1, True).when(number == 0, False)


def parsed_answers(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """answers with topically_relevant, checklist and parse_error.

    Code fences go wherever they stand. A topical flag that is no JSON boolean is true. An item needs a condition (a
    string, which may be blank) and two booleans: true or false, 0 or 1, or a word for one (TRUE, FALSE); a satisfied
    flag of doubt is false. Items that lack one of these are dropped. An answer that is no JSON object, or keeps no
    item, is an error with an empty checklist.
    """
    body = F.try_parse_json(F.trim(F.replace(F.replace(F.col(raw), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))))
    items = F.try_variant_get(body, "$.checklist", "array<variant>")
    text = lambda i: F.when(F.schema_of_variant(F.try_variant_get(i, "$.condition", "variant")) == "STRING", F.try_variant_get(i, "$.condition", "string"))
    made = F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda i: F.struct(text(i).alias("condition"), _boolean(i, "$.necessary").alias("necessary"), _boolean(i, "$.satisfied", True).alias("satisfied")))
    good = F.filter(made, lambda i: i["condition"].isNotNull() & i["necessary"].isNotNull() & i["satisfied"].isNotNull())
    topical = F.when(F.schema_of_variant(F.try_variant_get(body, "$.topically_relevant", "variant")) == "BOOLEAN", F.try_variant_get(body, "$.topically_relevant", "boolean"))
    return answers.withColumn("topically_relevant", F.coalesce(topical, F.lit(True))).withColumn("checklist", good.cast(ITEM)).withColumn("parse_error", F.size("checklist") == 0)


def decided(checklist: Column, bar: float = 0.6) -> Column:
    """struct(ratio, is_applicable, confidence): necessary items if there are any, else all with the bar."""
    need = F.filter(checklist, lambda i: i["necessary"])
    has = F.size(need) > 0
    used = F.when(has, need).otherwise(checklist)
    ratio = F.coalesce(F.try_divide(F.size(F.filter(used, lambda i: i["satisfied"])), F.size(used)), F.lit(0.0))
    fits = (F.size(used) > 0) & F.when(has, ratio == 1.0).otherwise(ratio >= bar)
    return F.struct(ratio.alias("ratio"), fits.alias("is_applicable"), F.round(ratio, 3).alias("confidence"))


def query_audit(audited: DataFrame) -> DataFrame:
    """Per query: auditor_score (mean confidence of applicable rows, 0 if none), prune_ratio and the sorted pruned references."""
    fits = F.col("is_applicable")
    return audited.groupBy("query_id").agg(
        F.coalesce(F.avg(F.when(fits, F.col("confidence"))), F.lit(0.0)).alias("auditor_score"), F.avg((~fits).cast("double")).alias("prune_ratio"), F.array_sort(F.collect_list(F.when(~fits, F.col("article_ref")))).alias("pruned")
    )


def combined_confidence(df: DataFrame, retrieval: str, auditor: str, prune: str, digits: int = 3) -> DataFrame:
    raw = F.lit(0.5) * F.col(retrieval) + F.lit(0.5) * F.col(auditor) - F.lit(0.2) * F.col(prune)
    return df.withColumn("combined", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), digits)).withColumn("level", leveled(F.col("combined"), 0.8, 0.6))


def with_fallback(audited: DataFrame, least: int = 3) -> DataFrame:
    """Rows for the next step: all rows, and below `least` applicable ones the best topical others once more (added = true).

    Rows are ranked and written out in one pass over them, in as many tasks as there are shuffle partitions: rows shrink so
    much in a shuffle that tasks joined by its bytes would sort many at once.
    """
    w = Window.partitionBy("query_id")
    n = F.sum(F.col("is_applicable").cast("int")).over(w)
    spare = ~F.col("is_applicable") & F.col("topically_relevant")
    rank = F.row_number().over(Window.partitionBy("query_id", spare).orderBy(F.desc("confidence"), "article_ref"))
    again = spare & (F.col("__rank") <= F.lit(least) - F.col("__n"))
    tasks = int(audited.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = audited.repartition(tasks, "query_id").withColumns({"__n": n, "__rank": rank})
    return placed.withColumn("added", F.explode(F.when(again, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))).drop("__n", "__rank")


def formatted(audited: DataFrame) -> DataFrame:
    """Applicable or topical rows with a text of their satisfied and failed necessary conditions."""
    names = lambda keep: F.array_join(F.transform(F.filter("checklist", lambda i: i["necessary"] & (i["satisfied"] if keep else ~i["satisfied"])), lambda i: i["condition"]), "; ")
    return audited.filter(F.col("is_applicable") | F.col("topically_relevant")).withColumn("block", F.concat(F.col("article_ref"), F.lit(" | met: "), names(True), F.lit(" | not met: "), names(False)))


def checklist_refs(samples: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct references of gold, excluded and checklist keys in first-seen order (position), minus the known ones."""
    gold = F.transform("gold_articles", lambda r, i: F.struct(F.lit(0).alias("part"), i.alias("i"), r.alias("ref")))
    excluded = F.transform("excluded_articles", lambda r, i: F.struct(F.lit(1).alias("part"), i.alias("i"), r.alias("ref")))
    keys = F.transform(F.map_keys("gold_checklist"), lambda r, i: F.struct(F.lit(2).alias("part"), i.alias("i"), r.alias("ref")))
    rows = samples.select("ord", F.explode(F.concat(*(F.coalesce(c, F.array().cast("array<struct<part:int,i:int,ref:string>>")) for c in (gold, excluded, keys)))).alias("x"))
    first = rows.groupBy("x.ref").agg(F.min(F.struct("ord", "x.part", "x.i")).alias("at")).join(known.select("ref"), "ref", "left_anti")
    return first.select("ref", "at.*")


def gold_pairs(samples: DataFrame) -> DataFrame:
    """ruling_id, ref, checklist, gold_applicable for every non-empty gold checklist."""
    rows = samples.select("ruling_id", F.explode("gold_checklist").alias("ref", "checklist")).filter(F.size("checklist") > 0)
    return rows.withColumn("gold_applicable", F.forall("checklist", lambda i: i["satisfied"]))


def checklist_accuracy(pairs: DataFrame, predicted: str = "predicted", gold: str = "checklist") -> DataFrame:
    """item_accuracy and all_satisfied of a predicted checklist; rejected if the lengths differ."""
    same = F.size(predicted) == F.size(gold)
    hits = F.size(F.filter(F.zip_with(predicted, gold, lambda p, g: p["satisfied"] == g["satisfied"]), lambda x: x))
    return pairs.withColumn("rejected", ~same).withColumn("item_accuracy", F.when(same, F.try_divide(hits, F.size(gold)))).withColumn("all_satisfied", F.forall(predicted, lambda p: p["satisfied"]))


def audit_from_gold(samples: DataFrame) -> DataFrame:
    """Gold references as applicable rows with confidence 1, excluded ones as not applicable with 0.5; all topical."""

    def side(refs: str, fits: bool, sure: float) -> DataFrame:
        rows = samples.select("ruling_id", F.explode(F.array_distinct(refs)).alias("article_ref"), "gold_checklist")
        return rows.withColumn("is_applicable", F.lit(fits)).withColumn("confidence", F.lit(sure))

    rows = side("gold_articles", True, 1.0).unionByName(side("excluded_articles", False, 0.5))
    items = F.coalesce(F.try_element_at("gold_checklist", F.col("article_ref")), F.array().cast(ITEM))
    return rows.withColumn("topically_relevant", F.lit(True)).withColumn("checklist", items).drop("gold_checklist")
