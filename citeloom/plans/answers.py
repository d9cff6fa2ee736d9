"""Queries of the routed, fallback and bundled retrieval, and of gold checklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import audit as A
from citeloom.operators import calibration as C
from citeloom.operators import channels as CH
from citeloom.operators import metrics as M
from citeloom.operators import retrieval as R
from citeloom.plans.evaluation import _RANKS, POOL, gold, pool, r6
from citeloom.plans.retrieval import CHANNEL, HITS, _hits, _quality
from citeloom.plans.tables import table


def _routed(s: SparkSession, d: str) -> DataFrame:
    """A fenced router answer for each customer: some name no channel, some an unknown one, some are no JSON."""
    k = F.col("c_custkey") % 5
    names = F.when(k == 0, "[]").when(k == 1, '["feature", "web"]').when(k == 2, '["ruling", "article"]').otherwise('["web"]')
    raw = F.when(k == 4, F.lit("sorry")).otherwise(F.concat(F.lit('```json\n{"channels": '), names, F.lit(', "case_type": "'), "c_mktsegment", F.lit('"}\n```')))
    out = R.routed(table(s, d, "customer").select("c_custkey", raw.alias("raw")), "raw", ["feature", "ruling", "article"], ["BUILDING", "MACHINERY"])
    return out.select("c_custkey", F.array_join("channels", ",").alias("channels"), "case_type")


def _fallback(s: SparkSession, d: str) -> DataFrame:
    """Queries are vectors divisible by 100, half of them with an exact hit; nodes are vectors, and lines their features."""
    e = table(s, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    nodes = e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).cast("string").alias("category"), F.concat(F.lit("v"), "vec_id").alias("value"), "embedding")
    feats = table(s, d, "lineitem").select(F.col("l_orderkey").alias("ruling_id"), (F.col("l_partkey") % 3).cast("string").alias("category"), F.concat(F.lit("v"), "l_partkey").alias("value"), F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("quote"))
    return r6(CH.feature_fallback(q, q.filter("query_id % 200 = 0"), nodes, feats, 10), "score")


def _bundles(s: SparkSession, d: str) -> DataFrame:
    """References are hours of a user's events; texts, rulings, features and grounded features come with them."""
    h = _hits(s, d)
    ref = F.concat(F.lit("h"), F.col("event_id") % 30)
    refs = R.article_refs(h.filter("list_no = 1").select("query_id", F.lit(0).alias("tier"), "rank", F.array(ref).alias("refs")))
    rulings = h.filter("list_no = 2").select("query_id", ref.alias("ref"), "rank", F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("r"), "event_id")).alias("text"))
    feats = h.filter("list_no = 1").select("query_id", "rank", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("f"), "event_id")).alias("text"))
    texts = h.select((F.col("event_id") % 30).alias("k")).distinct().filter("k < 20").select(F.concat(F.lit("h"), "k").alias("ref"), F.concat(F.lit("text "), "k").alias("text"))
    known = h.select((F.col("event_id") % 30).alias("k")).distinct().filter("k % 2 = 0").select(F.concat(F.lit("h"), "k").alias("ref"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("rank"), "k")
    grounded = known.select("ref", "rank", F.concat(F.lit("g"), F.col("k") * F.col("rank")).alias("value"))
    out = R.bundles(refs, texts, rulings, feats, grounded, 8, 3, 4, "known: ", ", ")
    return out.select("query_id", "ref", "position", "article_text", F.array_join("supporting_texts", " | ").alias("supporting"))


def _gated(s: SparkSession, d: str) -> DataFrame:
    """Hits of the channels that each query asks for."""
    h = _hits(s, d).withColumn("channel", F.concat(F.lit("c"), "list_no"))
    asks = h.select("query_id").distinct().withColumn("channels", F.when(F.col("query_id") % 3 == 0, F.array(F.lit("c1"))).when(F.col("query_id") % 3 == 1, F.array(F.lit("c1"), F.lit("c2"))))
    parts = [h.filter(F.col("channel") == c).join(CH.gated(asks, c).select("query_id"), "query_id", "left_semi") for c in ("c1", "c2")]
    return parts[0].unionByName(parts[1]).groupBy("query_id", "channel").agg(F.count(F.lit(1)).alias("n"))


def _samples(s: SparkSession, d: str) -> DataFrame:
    """An order is a sample: its lines' articles are gold or excluded, and its odd lines have a checklist of two items."""
    item = F.struct(F.concat(F.lit("c"), "l_linenumber").alias("condition"), (F.col("l_returnflag") == "A").alias("necessary"), (F.col("l_linestatus") == "O").alias("satisfied"))
    more = F.struct(F.lit("d").alias("condition"), F.lit(True).alias("necessary"), (F.col("l_quantity") > 25).alias("satisfied"))
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), F.col("l_partkey") % 20).alias("ref"), (F.col("l_quantity") <= 30).alias("gold"), F.when(F.col("l_linenumber") % 2 == 1, F.array(item, more)).otherwise(F.array().cast(A.ITEM)).alias("checklist"))
    x = F.array_sort(F.collect_list(F.struct("l_linenumber", "ref", "gold", "checklist")))
    per = line.groupBy(F.col("l_orderkey").alias("ruling_id")).agg(x.alias("x"))
    # the first line of an article keeps its checklist
    first = F.filter("x", lambda a, i: ~F.exists(F.slice("x", F.lit(1), i), lambda b: b["ref"] == a["ref"]))
    return per.withColumn("first", first).select(
        "ruling_id", F.col("ruling_id").alias("ord"), F.transform(F.filter("x", lambda a: a["gold"]), lambda a: a["ref"]).alias("gold_articles"), F.transform(F.filter("x", lambda a: ~a["gold"]), lambda a: a["ref"]).alias("excluded_articles"),
        F.map_from_entries(F.transform("first", lambda a: F.struct(a["ref"], a["checklist"]))).alias("gold_checklist"),
    )


SAMPLES = """with line as (select l_orderkey as ruling_id, l_linenumber as ln, 'p' || (l_partkey % 20) as ref, l_quantity <= 30 as gold, l_linenumber % 2 = 1 as listed, l_linestatus = 'O' as s1, l_quantity > 25 as s2, l_returnflag = 'A' as n1 from lineitem),
firsts as (select * from (select *, row_number() over (partition by ruling_id, ref order by ln, gold, n1, s1, s2) as r from line) where r = 1)
"""


def _checklist(s: SparkSession, d: str) -> DataFrame:
    """Gold pairs with a prediction that turns the second item, or drops it."""
    pairs = A.gold_pairs(_samples(s, d))
    turned = F.transform("checklist", lambda i, k: F.struct(i["condition"].alias("condition"), i["necessary"].alias("necessary"), F.when(k == 1, ~i["satisfied"]).otherwise(i["satisfied"]).alias("satisfied")))
    out = A.checklist_accuracy(pairs.withColumn("predicted", F.when(F.col("ruling_id") % 4 == 0, F.slice(turned, 1, 1)).otherwise(turned)))
    return out.select("ruling_id", "ref", "gold_applicable", "rejected", "item_accuracy", "all_satisfied")


def _weight_grid(s: SparkSession, d: str) -> DataFrame:
    """The whole search grid on the channel qualities of all users."""
    c, f = F.col, F.lit
    rows = _quality(s, d).select("query_id", (c("query_id") % 5).alias("fold"), *(f"{x}_quality" for x in ("feature", "ruling", "article")), F.size("missing").alias("n_missing"), F.when(c("query_id") % 4 != 0, c("query_id") % 10 / 10.0).alias("support"), (c("query_id") % 7 / 7.0).alias("route"), (c("query_id") % 2).alias("vague"), (c("query_id") * 13 % 11 / 10.0).alias("recall"))
    norm = c("feature_weight") + c("ruling_weight") + c("article_weight")
    base = (c("feature_quality") * c("feature_weight") + c("ruling_quality") * c("ruling_weight") + c("article_quality") * c("article_weight")) / norm
    base = F.when(c("support").isNull(), base).otherwise((1 - c("graph_support_weight")) * base + c("graph_support_weight") * c("support"))
    out = base - c("n_missing") * c("missing_channel_penalty") - c("route") * c("routing_uncertainty_weight") - c("vague") * c("ambiguity_penalty")
    return r6(C.grid_search(rows, C.weight_configs(s), F.round(F.greatest(f(0.0), F.least(f(1.0), out)), 6), "recall"), "mean_score")


def _mean_f1(s: SparkSession, d: str) -> DataFrame:
    refs = lambda df: df.groupBy("query_id").agg(F.collect_set(F.col("ref").cast("string")).alias("refs"))
    both = refs(gold(s, d)).withColumnRenamed("refs", "g").join(refs(pool(s, d).filter("rank <= 5")), "query_id", "left")
    return r6(M.mean_f1(both.select(M.set_scores(F.col("refs"), F.col("g"))["f1"].alias("f1"))), "mean_f1")


QUERIES = {
    "j3_fallback": _fallback,
    "j12_bundles": _bundles,
    "j13_routed": _routed,
    "j16_gated": _gated,
    "k8_checklist_refs": lambda s, d: A.checklist_refs(_samples(s, d), table(s, d, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("p"), F.col("p_partkey") % 7).alias("ref"))).select("ref", "ord", "part"),
    "k9_gold_pairs": lambda s, d: A.gold_pairs(_samples(s, d)).select("ruling_id", "ref", "gold_applicable", F.size("checklist").alias("n")),
    "k10_checklist_accuracy": _checklist,
    "k11_audit_from_gold": lambda s, d: A.audit_from_gold(_samples(s, d)).select("ruling_id", "article_ref", "is_applicable", "confidence", "topically_relevant", F.size("checklist").alias("n")),
    "m20_mean_f1": _mean_f1,
    "n3_weight_grid": _weight_grid,
}
_N = "[0.3, 0.4, 0.5]"
ORACLE = {
    "j3_fallback": """with v as (select vec_id, vec_id % 3 as category, embedding::double[] as e from embeddings), x as (select q.vec_id as query_id, c.category, c.vec_id as id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) as score from v q join v c on q.vec_id % 100 = 0 and q.vec_id % 200 <> 0),
near as (select * from (select *, row_number() over (partition by query_id, category order by round(score, 9) desc, id) as r from x) where r <= 10),
rows as (select query_id, l_orderkey as ruling_id, 'v' || id as value, round(score, 9) as score, category::varchar as category, case when l_linenumber > 2 then l_returnflag end as quote from near join lineitem on l_partkey = id and l_partkey % 3 = category),
best as (select * from (select *, row_number() over (partition by query_id, ruling_id, value order by score desc, category desc, quote desc nulls last) as r from rows) where r = 1),
y as (select *, row_number() over (partition by query_id order by score desc, ruling_id, value)::int as rank from best)
select query_id, rank, ruling_id, category, value, coalesce(quote, value) as text, round(score, 6) as score from y where rank <= 10""",
    "j12_bundles": HITS + """, refs as (select query_id, 'h' || k as ref, k, row_number() over (partition by query_id order by pos_at)::int as position from (select query_id, event_id % 30 as k, min(rank) as pos_at from hits where list_no = 1 group by 1, 2)),
ru as (select query_id, k, string_agg(t, ' | ' order by r) as t from (select query_id, event_id % 30 as k, 'r' || event_id as t, row_number() over (partition by query_id, event_id % 30 order by rank, 'r' || event_id) as r from hits where list_no = 2 and event_id % 5 <> 0) where r <= 3 group by 1, 2),
fe as (select query_id, string_agg('f' || event_id, ' | ' order by rank) filter (where event_id % 3 <> 0) as t from hits where list_no = 1 and rank <= 4 group by 1)
select query_id, ref, position, case when k < 20 then 'text ' || k else '' end as article_text, concat_ws(' | ', case when k % 2 = 0 then 'known: g' || k || ', g' || (k * 2) end, ru.t, fe.t) as supporting from refs left join ru using (query_id, k) left join fe using (query_id) where position <= 8""",
    "j13_routed": "select c_custkey, case c_custkey % 5 when 1 then 'feature' when 2 then 'ruling,article' else 'feature,ruling,article' end as channels, case when c_custkey % 5 <> 4 and c_mktsegment in ('BUILDING', 'MACHINERY') then c_mktsegment end as case_type from customer",
    "j16_gated": HITS + "select query_id, 'c' || list_no as channel, count(*) as n from hits where query_id % 3 = 0 and list_no = 1 or query_id % 3 = 1 group by 1, 2",
    "k8_checklist_refs": SAMPLES + """, x as (select ruling_id as ord, 0 as part, ref from line where gold union all select ruling_id, 1, ref from line where not gold), f as (select ref, min(ord * 10 + part) as pos_at from x group by ref)
select ref, pos_at // 10 as ord, (pos_at % 10)::int as part from f where ref not in (select 'p' || (p_partkey % 7) from part where p_partkey % 3 = 0)""",
    "k9_gold_pairs": SAMPLES + "select ruling_id, ref, s1 and s2 as gold_applicable, 2 as n from firsts where listed",
    "k10_checklist_accuracy": SAMPLES + "select ruling_id, ref, s1 and s2 as gold_applicable, ruling_id % 4 = 0 as rejected, case when ruling_id % 4 <> 0 then 0.5::double end as item_accuracy, case when ruling_id % 4 = 0 then s1 else s1 and not s2 end as all_satisfied from firsts where listed",
    "k11_audit_from_gold": SAMPLES + "select distinct line.ruling_id, line.ref as article_ref, line.gold as is_applicable, case when line.gold then 1.0 else 0.5 end::double as confidence, true as topically_relevant, case when firsts.listed then 2 else 0 end as n from line join firsts using (ruling_id, ref)",
    "m20_mean_f1": POOL + ", s as (select query_id, count(*)::double as g, count(pool.ref)::double as h from gold left join (select * from pool where rank <= 5) pool using (query_id, ref) group by query_id), p as (select query_id, count(*)::double as p from pool where rank <= 5 group by query_id), f as (select case when h = 0 then 0.0 else 2 * (h / p) * (h / g) / (h / p + h / g) end as f1 from s join p using (query_id)) select round(avg(f1), 6) as mean_f1, count(*) filter (where f1 = 0) as zero_f1, count(*) as n from f",
    "n3_weight_grid": CHANNEL + f""", cfg as (select i as config_id, {_N}[i // 324 % 3 + 1]::double as fw, {_N}[i // 108 % 3 + 1]::double as rw, [0.0, 0.1, 0.15, 0.2][i // 27 % 4 + 1]::double as gw, [0.1, 0.15, 0.2][i // 9 % 3 + 1]::double as mp, [0.1, 0.15, 0.2][i // 3 % 3 + 1]::double as uw, [0.05, 0.1, 0.15][i % 3 + 1]::double as ap from range(972) as r(i)),
q2 as (select query_id, coalesce(f, 0) as f, coalesce(r, 0) as r, coalesce(a, 0) as a, (f is null)::int + (r is null)::int + (a is null)::int as nm, case when query_id % 4 <> 0 then query_id % 10 / 10.0::double end as sup, query_id % 7 / 7.0::double as route, query_id % 2 as vague, query_id * 13 % 11 / 10.0::double as y, query_id % 5 as fold from quality),
b as (select *, round(1 - fw - rw, 3) as aw from q2, cfg), c as (select *, (f * fw + r * rw + a * aw) / (fw + rw + aw) as base from b),
rows as (select config_id, fold, y, round(greatest(0.0, least(1.0, case when sup is null then base else (1 - gw) * base + gw * sup end - nm * mp - route * uw - vague * ap)), 6) as x from c)
select config_id, round(avg(sp), 6) as mean_score from (select config_id, fold, coalesce(case when isnan(corr(rx, ry)) then 0 else corr(rx, ry) end, 0) as sp from {_RANKS.format(p='config_id, fold', v='y', n='ry', t=_RANKS.format(p='config_id, fold', v='x', n='rx', t='rows'))} group by all) group by config_id""",
}
