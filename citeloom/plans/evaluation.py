"""Queries of the metric, calibration and conformal operators.

Scores are text lengths, labels the quality marks, strata the languages; embeddings give ranked lists
whose gold is the same label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.operators import calibration as C
from citeloom.operators import metrics as M
from citeloom.operators import vectors as V
from citeloom.plans.tables import table


def scored(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return rows.select("doc_id", F.col("lang").alias("stratum"), (F.least(F.lit(100), F.floor(F.col("n_chars") / 50)) / 100.0).alias("score"), F.col("quality").alias("label"), "toxic", (F.col("doc_id") % 7).alias("other"))


SCORED = """with scored as (select doc_id, lang as stratum, least(100, n_chars // 50) / 100.0::double as score, quality as label, toxic, doc_id % 7 as other from documents join labels using (doc_id))
"""


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def pool(s: SparkSession, d: str) -> DataFrame:
    """The vectors whose id is divisible by 100 against all: their 20 nearest others and a score; gold(): the first three others of their label by id."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 100 = 0")
    return V.cosine_top_k(e.select(F.col("vec_id").alias("id"), "embedding"), q.select(F.col("vec_id").alias("query_id"), "embedding"), 21).filter("id != query_id").select("query_id", F.col("id").alias("ref"), "rank", F.round("score", 6).alias("score"))


def gold(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # the first four of each label hold every query's first three others
    few = e.select(F.col("vec_id").alias("ref"), "label").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("ref"))).filter("r <= 4").drop("r")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("ref"))
    return q.join(few, "label").filter("ref != query_id").withColumn("r", first).filter("r <= 3").select("query_id", "ref")


POOL = """with v as (select vec_id, embedding::double[] as e from embeddings),
pairs as (select q.vec_id as query_id, c.vec_id as ref, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) as score from v q join v c on true where q.vec_id % 100 = 0),
pool as (select query_id, ref, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, ref)::int as rank from pairs) where rank <= 21 and ref <> query_id),
gold as (select query_id, ref from (select q.vec_id as query_id, c.vec_id as ref, row_number() over (partition by q.vec_id order by c.vec_id) as r from embeddings q join embeddings c on q.label = c.label and q.vec_id <> c.vec_id where q.vec_id % 100 = 0) where r <= 3),
queries as (select vec_id as query_id from embeddings where vec_id % 100 = 0)
"""
ALPHAS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]


def thresholds(s: SparkSession, d: str) -> DataFrame:
    return C.conformal_quantiles(C.calibration_scores(C.normalised(pool(s, d)), gold(s, d), "any"), ALPHAS)


NORM = POOL + """, norm as (select query_id, ref, rank, case when hi = lo then 1.0 else (score - lo) / (hi - lo) end as score from (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from pool)),
cal as (select query_id, min(coalesce(1 - norm.score, 'infinity'::double)) as s from gold left join norm using (query_id, ref) group by query_id),
alphas as (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])::double as alpha),
ks as (select alpha, ceil(((select count(*) from cal) + 1) * (1 - alpha))::bigint as k from alphas),
thresholds as (select alpha, coalesce((select s from (select s, row_number() over (order by s) as r from cal where s < 'infinity') where r = k), 'infinity'::double) as threshold, k <= (select count(*) from cal) as achievable from ks)
"""


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("majority_verdict"), F.element_at(F.array(F.lit("full"), F.lit("majority"), F.lit("split")), (F.col("event_id") % 3 + 1).cast("int")).alias("consensus"),
        (F.floor(F.col("value")) % 2).cast("int").alias("correct_any"), (F.floor(F.col("value")) % 4 == 3).cast("int").alias("correct_all"), (F.least(F.lit(100), F.floor(F.col("value"))) / 100.0).alias("final_confidence"),
        ((F.col("event_id") % 5) / 10.0).alias("agent_conf_std"), (F.col("event_id") % 4 == 0).alias("uncertainty_flag"), (F.col("event_id") % 2).alias("part"), F.when(F.col("event_id") % 17 == 0, "failed").alias("error"),
        (F.col("user_id") / 150.0).alias("precision"), (F.col("event_id") % 10 / 10.0).alias("recall"), (F.col("event_id") % 8 / 8.0).alias("f1"), F.col("user_id").alias("case_type_id"), F.when(F.col("event_id") % 6 != 5, (F.col("event_id") % 6 < 2).cast("int")).alias("gold_in_applicable"),
        F.when(F.col("event_id") % 10 != 3, F.col("event_id") % 10 / 10.0).alias("some_recall"),
    )


VERDICTS = """with e2e as (select case when event_id % 11 <> 0 then event_type end as majority_verdict, ['full', 'majority', 'split'][event_id % 3 + 1] as consensus, (floor(value)::bigint % 2)::int as correct_any, (floor(value)::bigint % 4 = 3)::int as correct_all,
least(100, floor(value)::bigint) / 100.0::double as final_confidence, (event_id % 5) / 10.0::double as agent_conf_std, event_id % 4 = 0 as uncertainty_flag, event_id % 2 as part, case when event_id % 17 = 0 then 'failed' end as error,
user_id / 150.0::double as precision, (event_id % 10) / 10.0::double as recall, (event_id % 8) / 8.0::double as f1, user_id as case_type_id, case when event_id % 6 <> 5 then (event_id % 6 < 2)::int end as gold_in_applicable, case when event_id % 10 <> 3 then (event_id % 10) / 10.0::double end as some_recall from events)
"""
# the area under the curve of `score` for `label` in `t`, by `g`
_AUROC = """(select {g}, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) as auroc from (select *, coalesce(sum(neg) over (partition by {g} order by score rows between unbounded preceding and 1 preceding), 0) as below
  from (select {g}, score, sum(label) as pos, count(*) - sum(label) as neg from {t} group by {g}, score)) group by {g})"""
_BINS = "select {g}, bin, count(*) as n, avg(score) as confidence, avg(label) as accuracy from (select *, {b} as bin from {t}) where bin is not null group by {g}, bin"
_FIVE = "case when score >= 0 and score < 0.2 then 0 when score < 0.4 then 1 when score < 0.6000000000000001 then 2 when score < 0.8 then 3 when score < 1.0 then 4 end"


def _folds(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).withColumn("fold", F.col("doc_id") % 5)


def _grid(s: SparkSession, d: str) -> DataFrame:
    weights = s.range(30).select(F.col("id").alias("config_id"), (F.col("id") % 6 / 5.0).alias("a"), (F.floor(F.col("id") / 6) / 4.0).alias("b"))
    out = C.grid_search(_folds(s, d), weights, F.round(F.col("a") * F.col("score") + F.col("b") * F.col("other") / 6.0, 9), "label")
    return r6(out, "mean_score")


QUERIES = {
    "m1_set_scores": lambda s, d: r6(pool(s, d).groupBy("query_id").agg(F.collect_set(F.col("ref").cast("string")).alias("p")).join(gold(s, d).groupBy("query_id").agg(F.collect_set(F.col("ref").cast("string")).alias("g")), "query_id").select("query_id", M.set_scores(F.col("p"), F.col("g")).alias("m")).select("query_id", "m.*"), "precision", "recall", "f1"),
    "m2_recall_at_k": lambda s, d: r6(M.recall_at(pool(s, d), gold(s, d), [1, 3, 5, 10, 20], item="ref"), "recall"),
    "m3_spearman": lambda s, d: r6(M.spearman(scored(s, d), "score", "other", ["stratum"]), "spearman"),
    "m4_auroc": lambda s, d: r6(M.auroc(scored(s, d), "score", "label"), "auroc"),
    "m4_auroc_by_stratum": lambda s, d: r6(M.auroc(scored(s, d), "score", "label", ["stratum"]), "auroc"),
    "m5_average_precision": lambda s, d: r6(M.average_precision(scored(s, d), "score", "label", ["stratum"]), "average_precision"),
    "m6_ece_five": lambda s, d: r6(M.ece(scored(s, d), "score", "label", "five", ["stratum"]), "ece"),
    "m6_ece_left": lambda s, d: r6(M.ece(scored(s, d), "score", "label", "left", ["stratum"]), "ece"),
    "m6_ece_right": lambda s, d: r6(M.ece(scored(s, d), "score", "label", "right", ["stratum"]), "ece"),
    "m7_reliability": lambda s, d: r6(M.reliability(scored(s, d), "score", "label", "five", ["stratum"]), "confidence", "accuracy"),
    "m8_brier": lambda s, d: r6(M.brier(scored(s, d), "score", "label", ["stratum"]), "brier"),
    "m9_confusion": lambda s, d: r6(M.confusion(scored(s, d).withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "predicted", "label", ["stratum"]), "precision", "recall", "f1"),
    "m10_correct_any_all": lambda s, d: pool(s, d).filter("rank <= 6").groupBy("query_id").agg(F.collect_set("ref").alias("p")).join(gold(s, d).groupBy("query_id").agg(F.collect_set("ref").alias("g")), "query_id").select("query_id", M.correct_any_all(F.col("p"), F.col("g")).alias("m")).select("query_id", F.col("m.any").alias("any_correct"), F.col("m.all").alias("all_correct")),
    "m11_split_summary": lambda s, d: r6(M.split_summary(_verdicts(s, d), ["part"]), "accuracy_any", "accuracy_all", "mean_confidence", "std_confidence", "flag_rate", "mean_precision", "mean_recall", "mean_f1", "consensus_rate", "full_consensus_rate", "split_rate", "gold_in_applicable_rate", "auroc_any", "ece_any", "auroc_all", "ece_all"),
    "m12_consensus": lambda s, d: r6(M.consensus_breakdown(_verdicts(s, d)), "accuracy_any", "accuracy_all", "mean_confidence", "percent"),
    "m13_verdicts": lambda s, d: M.verdict_distribution(_verdicts(s, d)),
    "m14_signals": lambda s, d: r6(M.signal_comparison(_verdicts(s, d), {"final": ("final_confidence", "correct_any"), "precision": ("precision", "correct_all"), "recall": ("recall", "correct_any")}), "mean", "std", "auroc", "ece", "brier"),
    "m15_pass_report": lambda s, d: M.pass_report(_verdicts(s, d), "some_recall", "majority_verdict"),
    "m17_best_rank": lambda s, d: M.best_rank(pool(s, d).join(gold(s, d), ["query_id", "ref"]).select("query_id", "rank", (F.col("ref") % 2).alias("channel_no"), F.when(F.col("ref") % 2 == 0, "article").otherwise("citation").alias("channel"))),
    "n1_stratified_split": lambda s, d: C.stratified_split(scored(s, d), "doc_id", "stratum", 0.2).groupBy("stratum", "is_test").agg(F.count(F.lit(1)).alias("n")),
    "n2_stratified_folds": lambda s, d: C.stratified_folds(scored(s, d), "doc_id", "stratum", 5).groupBy("stratum", "fold").agg(F.count(F.lit(1)).alias("n")),
    "n3_grid_search": _grid,
    "n4_weight_sweep": lambda s, d: r6(C.weight_sweep(scored(s, d).withColumn("other", F.col("other") / 6.0), "score", "other", "label", [i / 20 for i in range(2, 19)]), "auroc"),
    "n7_normalised": lambda s, d: r6(C.normalised(pool(s, d)), "score"),
    "n8_calibration_scores": lambda s, d: r6(C.calibration_scores(C.normalised(pool(s, d)), gold(s, d), "any"), "s"),
    "n9_quantiles": lambda s, d: r6(thresholds(s, d), "threshold"),
    "n10_conformal_report": lambda s, d: r6(C.conformal_report(C.normalised(pool(s, d)), gold(s, d), gold(s, d), thresholds(s, d), "any"), "coverage", "ecr", "mean_size", "worst_coverage"),
    "n11_pooled_auroc": lambda s, d: r6(M.auroc(C.pooled(C.normalised(pool(s, d)).withColumn("score", F.round("score", 9)), gold(s, d)), "score", "label"), "auroc"),
}


def _ece(b: str, pct: str = "") -> str:
    return SCORED + f"select stratum, round({pct} sum(n / total * abs(accuracy - confidence)), 6) as ece from ({_BINS.format(g='stratum', b=b, t='scored')}) join (select stratum, count(*)::double as total from scored group by stratum) using (stratum) group by stratum"


_RIGHT = "case when score <= 0.1 then 0 when score <= 0.2 then 1 when score <= 0.30000000000000004 then 2 when score <= 0.4 then 3 when score <= 0.5 then 4 when score <= 0.6000000000000001 then 5 when score <= 0.7000000000000001 then 6 when score <= 0.8 then 7 when score <= 0.9 then 8 else 9 end"
_LEFT = "case when score < 0.1 then 0 when score < 0.2 then 1 when score < 0.30000000000000004 then 2 when score < 0.4 then 3 when score < 0.5 then 4 when score < 0.6000000000000001 then 5 when score < 0.7000000000000001 then 6 when score < 0.8 then 7 when score < 0.9 then 8 else 9 end"
_RANKS = "(select *, rank() over (partition by {p} order by {v}) + (count(*) over (partition by {p}, {v}) - 1) / 2.0 as {n} from {t})"
ORACLE = {
    "m1_set_scores": POOL + """select query_id, round(h / p, 6) as precision, round(h / g, 6) as recall, case when h = 0 then 0.0 else round(2 * (h / p) * (h / g) / (h / p + h / g), 6) end as f1 from (select query_id, count(*)::double as p, count(gold.ref)::double as h, any_value(g)::double as g from pool left join gold using (query_id, ref) join (select query_id, count(*) as g from gold group by query_id) using (query_id) group by query_id)""",
    "m2_recall_at_k": POOL + "select query_id, k, round(count(pool.ref) filter (where rank <= k) / count(*)::double, 6) as recall from gold left join pool using (query_id, ref), (select unnest([1, 3, 5, 10, 20])::int as k) group by query_id, k",
    "m3_spearman": SCORED + f"select stratum, round(corr(rx, ry), 6) as spearman from {_RANKS.format(p='stratum', v='other', n='ry', t=_RANKS.format(p='stratum', v='score', n='rx', t='scored'))} group by stratum",
    "m4_auroc": SCORED + f"select round(auroc, 6) as auroc from {_AUROC.format(g='one', t='(select 1 as one, * from scored)')}",
    "m4_auroc_by_stratum": SCORED + f"select stratum, round(auroc, 6) as auroc from {_AUROC.format(g='stratum', t='scored')}",
    "m5_average_precision": SCORED + "select stratum, round(sum(cum / alln * pos) / sum(pos), 6) as average_precision from (select stratum, pos, sum(pos) over w as cum, sum(n) over w as alln from (select stratum, score, sum(label)::double as pos, count(*)::double as n from scored group by stratum, score) window w as (partition by stratum order by score desc)) group by stratum",
    "m6_ece_five": _ece(_FIVE), "m6_ece_left": _ece(_LEFT, "100 *"), "m6_ece_right": _ece(_RIGHT),
    "m7_reliability": SCORED + f"select stratum, bin, n, round(confidence, 6) as confidence, round(accuracy, 6) as accuracy from ({_BINS.format(g='stratum', b=_FIVE, t='scored')})",
    "m8_brier": SCORED + "select stratum, round(avg((score - label) ** 2), 6) as brier from scored group by stratum",
    "m9_confusion": SCORED + """select * exclude (p, r), round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from (select stratum, tp, fp, fn, tn, round(p, 6) as precision, round(r, 6) as recall, p, r from (select *, coalesce(tp / nullif(tp + fp, 0), 0.0) as p, coalesce(tp / nullif(tp + fn, 0), 0.0) as r from
 (select stratum, count(*) filter (where score >= 0.5 and label = 1) as tp, count(*) filter (where score >= 0.5 and label = 0) as fp, count(*) filter (where score < 0.5 and label = 1) as fn, count(*) filter (where score < 0.5 and label = 0) as tn from scored group by stratum)))""",
    "m10_correct_any_all": POOL + "select query_id, (count(pool.ref) > 0)::int as any_correct, (count(pool.ref) = count(*))::int as all_correct from gold left join (select * from pool where rank <= 6) pool using (query_id, ref) group by query_id",
    "m11_split_summary": VERDICTS + f""", ok as (select *, final_confidence as score, correct_any as label from e2e where error is null), al as (select part, final_confidence as score, correct_all as label from e2e where error is null),
bins as ({_BINS.format(g='part', b=_FIVE, t='ok')}), abins as ({_BINS.format(g='part', b=_FIVE, t='al')}), total as (select part, count(*)::double as total from ok group by part)
select part, any_value(n_errors) as n_errors, count(*) as n, round(avg(correct_any), 6) as accuracy_any, round(avg(correct_all), 6) as accuracy_all, round(avg(final_confidence), 6) as mean_confidence, round(stddev_pop(final_confidence), 6) as std_confidence, round(avg(uncertainty_flag::int), 6) as flag_rate,
round(avg(precision), 6) as mean_precision, round(avg(recall), 6) as mean_recall, round(avg(f1), 6) as mean_f1, round(avg((consensus in ('full', 'majority'))::int), 6) as consensus_rate, round(avg((consensus = 'full')::int), 6) as full_consensus_rate, round(avg((consensus = 'split')::int), 6) as split_rate,
round(avg(coalesce(gold_in_applicable, 0)), 6) as gold_in_applicable_rate, any_value(round(a.auroc, 6)) as auroc_any, any_value(round(e.ece, 6)) as ece_any, any_value(round(b.auroc, 6)) as auroc_all, any_value(round(f.ece, 6)) as ece_all
from ok join (select part, count(error) as n_errors from e2e group by part) using (part) join {_AUROC.format(g='part', t='ok')} a using (part) join {_AUROC.format(g='part', t='al')} b using (part)
join (select part, sum(n / total * abs(accuracy - confidence)) as ece from bins join total using (part) group by part) e using (part) join (select part, sum(n / total * abs(accuracy - confidence)) as ece from abins join total using (part) group by part) f using (part) group by part""",
    "m12_consensus": VERDICTS + "select consensus, count(*) as n, round(avg(correct_any), 6) as accuracy_any, round(avg(correct_all), 6) as accuracy_all, round(avg(final_confidence), 6) as mean_confidence, count(*) filter (where consensus = 'split' and agent_conf_std <= 0.2) as flag_split, count(*) filter (where consensus <> 'split' and agent_conf_std > 0.2) as flag_std, count(*) filter (where consensus = 'split' and agent_conf_std > 0.2) as flag_both, round(100.0 * count(*) / (select count(*) from e2e), 6)::double as percent from e2e group by consensus",
    "m13_verdicts": VERDICTS + "select coalesce(majority_verdict, 'missing') as verdict, count(*) as n from e2e group by 1 union all select 'total', count(*) from e2e",
    "m14_signals": VERDICTS + f""", long as (select 'final' as signal, final_confidence as score, correct_any as label from e2e union all select 'precision', precision, correct_all from e2e union all select 'recall', recall, correct_any from e2e), bins as ({_BINS.format(g='signal', b=_FIVE, t='long')})
select signal, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std, count(*) as n, any_value(round(a.auroc, 6)) as auroc, any_value(round(e.ece, 6)) as ece, round(avg((score - label) ** 2), 6) as brier from long join {_AUROC.format(g='signal', t='long')} a using (signal)
join (select signal, sum(n / total * abs(accuracy - confidence)) as ece from bins join (select signal, count(*)::double as total from long group by signal) using (signal) group by signal) e using (signal) group by signal""",
    "m15_pass_report": VERDICTS + ", x as (select coalesce((some_recall >= 0.7)::varchar, 'missing') as p, coalesce(majority_verdict, 'missing') as c from e2e) select case when grouping(p) = 1 then 'all' else p end as passed, case when grouping(c) = 1 then 'all' else c end as case_type, count(*) as n from x group by cube (p, c)",
    "m17_best_rank": POOL + "select query_id, rank, case when ref % 2 = 0 then 'article' else 'citation' end as channel from (select query_id, ref, rank, row_number() over (partition by query_id order by rank, ref % 2) as r from pool join gold using (query_id, ref)) where r = 1",
    "n1_stratified_split": SCORED + "select stratum, is_test, n from (select stratum, true as is_test, round_even(count(*) * 0.2, 0)::bigint as n from scored group by stratum union all select stratum, false, count(*) - round_even(count(*) * 0.2, 0)::bigint from scored group by stratum) where n > 0",
    "n2_stratified_folds": SCORED + "select stratum, fold::int as fold, (c + 4 - fold) // 5 as n from (select stratum, count(*) as c from scored group by stratum), range(5) as r(fold) where (c + 4 - fold) // 5 > 0",
    "n3_grid_search": SCORED + f""", rows as (select config_id, doc_id % 5 as fold, label as y, round((config_id % 6 / 5.0::double) * score + (config_id // 6 / 4.0::double) * other / 6.0::double, 9) as x from scored, range(30) as r(config_id))
select config_id, round(avg(sp), 6) as mean_score from (select config_id, fold, coalesce(case when isnan(corr(rx, ry)) then 0 else corr(rx, ry) end, 0) as sp from {_RANKS.format(p='config_id, fold', v='y', n='ry', t=_RANKS.format(p='config_id, fold', v='x', n='rx', t='rows'))} group by all) group by config_id""",
    "n4_weight_sweep": SCORED + f", rows as (select w / 20.0::double as weight, label, round(w / 20.0::double * score + (1 - w / 20.0::double) * (other / 6.0::double), 12) as score from scored, range(2, 19) as r(w)) select weight, round(auroc, 6) as auroc from {_AUROC.format(g='weight', t='rows')}",
    "n7_normalised": NORM + "select query_id, ref, rank, round(score, 6) as score from norm",
    "n8_calibration_scores": NORM + "select query_id, round(s, 6) as s from cal",
    "n9_quantiles": NORM + "select alpha, round(threshold, 6) as threshold, achievable from thresholds",
    "n10_conformal_report": NORM + """, members as (select alpha, query_id, ref from norm join thresholds on 1 - score <= threshold), per as (select alpha, q.query_id, count(distinct m.ref) as size, max((g.ref is not null)::int) as hit from (select distinct alpha, query_id from alphas, gold) q left join members m using (alpha, query_id) left join gold g on g.query_id = q.query_id and g.ref = m.ref group by alpha, q.query_id)
select alpha, round(avg(hit), 6) as coverage, round(100 * avg(hit), 6) as ecr, round(avg(size), 6) as mean_size, count(*) as n, any_value(worst) as worst_coverage
from per left join (select alpha, round(min(c), 6) as worst from (select alpha, size, 100 * avg(hit) as c, count(*) as k from per where size > 0 group by alpha, size) join (select alpha, count(*) as n from per group by alpha) using (alpha) where k >= n * 0.1 group by alpha) using (alpha) group by alpha""",
    "n11_pooled_auroc": NORM + f", pooled as (select 1 as one, round(score, 9) as score, (gold.ref is not null)::int as label from norm left join gold using (query_id, ref)) select round(auroc, 6) as auroc from {_AUROC.format(g='one', t='pooled')}",
}
