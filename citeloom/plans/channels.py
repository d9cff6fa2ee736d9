"""Queries of the retrieval channels and of further audit, opinion and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import audit as A
from citeloom.operators import calibration as C
from citeloom.operators import channels as CH
from citeloom.operators import features as FE
from citeloom.operators import graph as GR
from citeloom.operators import metrics as M
from citeloom.operators import opinions as O
from citeloom.operators import retrieval as R
from citeloom.operators import vectors as V
from citeloom.operators import vocabulary as VO
from citeloom.plans.curation import VOCAB, _vocab
from citeloom.plans.evaluation import POOL, gold, pool, r6
from citeloom.plans.retrieval import AUDIT, CASES, _audited, _cases
from citeloom.plans.tables import cites, table


def _matches(s: SparkSession, d: str) -> DataFrame:
    """Supplier-like queries: two part names in a row are a query's text."""
    p = table(s, d, "part")
    q = p.select(F.floor(F.col("p_partkey") / 2).alias("query_id"), "p_partkey", "p_name").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), " and ").alias("t"))
    return CH.vocabulary_matches(q.select("query_id", F.split("t", " ").alias("tokens")), _vocab(s, d), ["small ring"])


MATCHES = VOCAB + """, q as (select p_partkey // 2 as query_id, string_agg(p_name, ' and ' order by p_partkey) as t from part group by 1),
m as (select query_id, category, canonical, min(ord) as ord from q join vocab on contains(' ' || t || ' ', ' ' || raw || ' ') where canonical <> 'small ring' group by all),
matches as (select query_id, category, canonical, row_number() over (partition by query_id order by ord, category, canonical)::int as position from m)
"""


def _part_features(s: SparkSession, d: str) -> DataFrame:
    line = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return line.select(F.col("l_orderkey").alias("ruling_id"), F.col("p_type").alias("category"), F.col("p_name").alias("value"), F.when(F.col("l_linenumber") > 3, F.concat("p_name", F.lit("!"))).alias("quote"))


def _articles(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    near = CH.article_channel(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), e.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("id")), 20)
    return r6(near, "score")


def _rulings(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    units = e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 50).alias("ruling_id"), F.col("label").cast("string").alias("text"), "embedding")
    cited = R.cited_by(units.select("ruling_id").distinct(), cites(s, d).select("ruling_id", F.concat_ws("-", "law", "article_number").alias("ref")))
    out = CH.ruling_channel(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), units, cited, 5)
    return r6(out.withColumn("refs", F.array_join("refs", ",")), "score")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    ids = table(s, d, "embeddings").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), (F.col("vec_id") % 2 == 0).alias("expected"))
    return r6(V.pair_check(ids, table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.1), "cosine")


def _e2e(s: SparkSession, d: str) -> DataFrame:
    """Queries with a confidence and whether their gold is covered, as one all-or-none set."""
    covered = pool(s, d).filter("rank <= 8").join(gold(s, d), ["query_id", "ref"]).select("query_id").distinct().withColumn("ok", F.lit(True))
    base = gold(s, d).select("query_id").distinct().join(covered, "query_id", "left")
    return base.select("query_id", F.when(F.col("ok"), 1 - (F.col("query_id") % 10) / 10.0).otherwise(F.lit(float("inf"))).alias("s"))


def _methods(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select((F.col("event_id") % 4 / 10.0).alias("alpha"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("method"), "value")
    return C.compare_methods(e.groupBy("alpha", "method").agg(F.round(F.avg(F.least(F.lit(1.0), F.floor("value") / 100)), 4).alias("coverage"), F.round(F.avg(F.floor("value")), 4).alias("mean_size")), "m0")


def _summary(s: SparkSession, d: str) -> DataFrame:
    cases = O.majority(_cases(s, d)).join(_audited(s, d).groupBy(F.col("query_id").alias("case_id")).agg(F.min_by("checklist", "article_ref").alias("checklist")), "case_id")
    out = O.case_summary(cases, {"click": "accept", "view": "reject", "neutral": "open"}, {"click": ["file", "close"], "neutral": ["review"]})
    return out.select("case_id", "label", "reason", F.array_join("actions", ",").alias("actions"))


def _leaks(s: SparkSession, d: str) -> DataFrame:
    audited = table(s, d, "events").select(F.floor(F.col("event_id") / 3).alias("case_id"), F.concat(F.lit("a"), F.col("user_id") % 4).alias("article_ref"), (F.col("event_id") % 2 == 0).alias("is_applicable"), (F.col("user_id") % 3 == 0).alias("topically_relevant"))
    return O.citation_leaks(_cases(s, d), audited)


QUERIES = {
    "e2_upsert_notes": lambda s, d: GR.upserted(table(s, d, "lineitem").select(F.col("l_suppkey").alias("law"), (F.col("l_partkey") % 10).alias("article_number"), F.col("l_linenumber").alias("note_number"), F.struct("l_orderkey", "l_partkey", "l_extendedprice").alias("o"), "l_extendedprice"), ["law", "article_number", "note_number"], "o"),
    "e5_related": lambda s, d: GR.related_edges(table(s, d, "orders").select((F.col("o_orderkey") % 500).alias("ruling_id"), F.array(F.col("o_custkey") % 500, F.col("o_orderkey") % 500).alias("related_ruling_ids"))),
    "e8_cited_by": lambda s, d: R.cited_by(table(s, d, "orders").select(F.col("o_orderkey").alias("ruling_id")), cites(s, d).select("ruling_id", F.concat_ws("-", "law", "article_number").alias("ref"))).withColumn("refs", F.array_join("refs", ",")),
    "e9_texts": lambda s, d: R.texts_of(table(s, d, "lineitem").select((F.col("l_partkey") + F.col("l_suppkey")).alias("ref")).distinct(), table(s, d, "part").select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("text"))),
    "e10_existing": lambda s, d: GR.existing(table(s, d, "lineitem").select((F.col("l_partkey") + F.col("l_suppkey")).alias("k")).distinct(), table(s, d, "part").select(F.col("p_partkey").alias("k")), ["k"]),
    "f6_nodes": lambda s, d: FE.feature_nodes(_part_features(s, d).withColumn("category", F.when(F.col("category") == "SMALL", "fact").otherwise(F.col("category")))),
    "g5_exported": lambda s, d: VO.exported(table(s, d, "part").select(F.col("p_name").alias("term"), F.when(F.col("p_type") == "SMALL", "skip").otherwise(F.col("p_type")).alias("category"), F.col("p_brand").alias("root"))).withColumn("aliases", F.array_join("aliases", ",")),
    "g7_corrupted": lambda s, d: VO.corrupted(_vocab(s, d), "gr"),
    "g9_skip_overlap": lambda s, d: VO.skip_overlap(table(s, d, "part").filter("p_type = 'SMALL'").select(F.col("p_name").alias("term")), _vocab(s, d).filter("category = 'LARGE'")),
    "g10_lost_markers": lambda s, d: VO.lost_markers(_vocab(s, d).withColumn("canonical", F.element_at(F.split("raw", " "), -1)), ["red", "small"]).distinct(),
    "h7_pair_check": _pairs,
    "j1_matches": _matches,
    "j2_feature_channel": lambda s, d: CH.feature_channel(_matches(s, d), _part_features(s, d), 10),
    "j4_ruling_channel": _rulings,
    "j5_article_channel": _articles,
    "k3_pruned": lambda s, d: _audited(s, d).filter("NOT is_applicable").select("query_id", "article_ref"),
    "k5_combined": lambda s, d: r6(A.combined_confidence(A.query_audit(_audited(s, d)).withColumn("retrieval", (F.col("query_id") % 10) / 10.0), "retrieval", "auditor_score", "prune_ratio", 6), "combined").select("query_id", "combined", "level"),
    "k7_formatted": lambda s, d: A.formatted(_audited(s, d)).select("query_id", "article_ref", "block"),
    "l3_uncertain": lambda s, d: O.fused(_cases(s, d), _cases(s, d).groupBy("case_id").agg(F.max("confidence").alias("score"), F.lit(0.0).alias("prune_ratio"))).filter("uncertainty_flag").select("case_id"),
    "l6_case_summary": _summary,
    "l7_citation_leaks": _leaks,
    "m16_miss_buckets": lambda s, d: M.miss_buckets(gold(s, d).select(F.col("query_id").alias("sample_id"), "ref"), table(s, d, "embeddings").filter("vec_id % 5 != 0").select(F.col("vec_id").alias("ref")), pool(s, d).filter("ref % 2 = 0").select(F.col("query_id").alias("sample_id"), "ref", "rank"), pool(s, d).filter("ref % 3 = 0").select(F.col("query_id").alias("sample_id"), "ref", (F.col("rank") + 2).alias("rank")), 5, 15),
    "m18_query_rollup": lambda s, d: r6(M.query_rollup(_audited(s, d).select("query_id", "is_applicable", F.col("ratio").alias("auditor_confidence"), F.col("topically_relevant").alias("gold"))), "score", "prune_ratio", "precision", "recall", "f1"),
    "n12_e2e_conformal": lambda s, d: r6(C.conformal_quantiles(_e2e(s, d), [0.2, 0.4, 0.6, 0.8]), "threshold"),
    "n13_methods": lambda s, d: r6(_methods(s, d), "size_ratio"),
}
ORACLE = {
    "e2_upsert_notes": "select law, article_number, note_number, l_extendedprice from (select *, row_number() over (partition by law, article_number, note_number order by l_orderkey desc, l_partkey desc, l_extendedprice desc) as r from (select l_suppkey as law, l_partkey % 10 as article_number, l_linenumber as note_number, l_orderkey, l_partkey, l_extendedprice from lineitem)) where r = 1",
    "e5_related": "select distinct src_id, dst_id from (select o_orderkey % 500 as src_id, o_custkey % 500 as dst_id from orders) where src_id <> dst_id",
    "e8_cited_by": "select o_orderkey as ruling_id, coalesce(refs, '') as refs from orders left join (select l_orderkey, string_agg(ref, ',' order by ref) as refs from (select distinct l_orderkey, p_brand || '-' || p_size as ref from lineitem join part on l_partkey = p_partkey) group by l_orderkey) on l_orderkey = o_orderkey",
    "e9_texts": "select ref, coalesce(p_name, '') as text from (select distinct l_partkey + l_suppkey as ref from lineitem) left join part on p_partkey = ref",
    "e10_existing": "select k, k in (select p_partkey from part) as exists from (select distinct l_partkey + l_suppkey as k from lineitem)",
    "f6_nodes": "select distinct p_type as category, p_name as value from lineitem join part on l_partkey = p_partkey where p_type <> 'SMALL'",
    "g5_exported": "select category, root, string_agg(term, ',' order by term) as aliases, count(*) as n from (select distinct p_type as category, p_brand as root, p_name as term from part where p_type <> 'SMALL') group by all",
    "g7_corrupted": "select distinct p_type as category, p_name as raw from part where contains(p_name, 'gr')",
    "g9_skip_overlap": "select distinct p_name as term from part where p_type = 'SMALL' and p_name in (select p_name from part where p_type = 'LARGE')",
    "g10_lost_markers": "select distinct p_type as category, string_split(p_name, ' ')[-1] as canonical, p_name as raw, string_split(p_name, ' ')[1] as marker from part where len(string_split(p_name, ' ')) = 2 and string_split(p_name, ' ')[1] in ('red', 'small')",
    "h7_pair_check": "with v as (select vec_id, embedding::double[] as e from embeddings), x as (select a.vec_id as a, b.vec_id as b, a.vec_id % 2 = 0 as expected, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) as c from v a join v b on b.vec_id = a.vec_id + 1) select a, b, expected, round(c, 6) as cosine, (c > 0.1) = expected as agrees from x",
    "j1_matches": MATCHES + "select * from matches",
    "j2_feature_channel": MATCHES + """, f as (select l_orderkey as ruling_id, p_type as category, p_name as value, case when l_linenumber > 3 then p_name || '!' end as quote from lineitem join part on l_partkey = p_partkey),
x as (select query_id, ruling_id, value, position, m.category, quote, row_number() over (partition by query_id, ruling_id, value order by position, m.category, quote nulls first) as r from matches m join f on f.category = m.category and f.value = m.canonical),
y as (select *, row_number() over (partition by query_id order by position, ruling_id, value)::int as rank from x where r = 1) select query_id, rank, ruling_id, category, value, coalesce(quote, value) as text, 1.0::double as score from y where rank <= 10""",
    "j4_ruling_channel": POOL + """, r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, ref)::int as rank from pairs), c as (select l_orderkey as ruling_id, string_agg(ref, ',' order by ref) as refs from (select distinct l_orderkey, p_brand || '-' || p_size as ref from lineitem join part on l_partkey = p_partkey where l_orderkey < 50) group by 1)
select query_id, rank, ref as id, ref % 50 as ruling_id, label::varchar as text, round(score, 6) as score, coalesce(refs, '') as refs from r join embeddings on vec_id = ref left join c on c.ruling_id = ref % 50 where rank <= 5""",
    "j5_article_channel": POOL + ", r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, ref)::int as rank from pairs) select query_id, ref as id, round(score, 6) as score, rank from r where rank <= 20 and ref % 3 = 0",
    "k3_pruned": AUDIT + "select query_id, article_ref from audited where not is_applicable",
    "k5_combined": AUDIT + """, q as (select query_id, coalesce(avg(confidence) filter (where is_applicable), 0.0) as a, avg((not is_applicable)::int) as p from audited group by query_id),
c as (select query_id, round(greatest(0.0, least(1.0, 0.5 * (query_id % 10) / 10.0::double + 0.5 * a - 0.2 * p)), 6) as combined from q) select *, case when combined >= 0.8 then 'high' when combined >= 0.6 then 'medium' else 'low' end as level from c""",
    "k7_formatted": AUDIT + """, b as (select l_orderkey as query_id, (l_partkey % 4)::varchar as article_ref, string_agg(l_linenumber::varchar, '; ' order by l_linenumber) filter (where l_returnflag = 'A' and l_linestatus = 'O') as met, string_agg(l_linenumber::varchar, '; ' order by l_linenumber) filter (where l_returnflag = 'A' and l_linestatus <> 'O') as failed from lineitem group by all)
select query_id, article_ref, article_ref || ' | met: ' || coalesce(met, '') || ' | not met: ' || coalesce(failed, '') as block from audited join b using (query_id, article_ref) where is_applicable or topically_relevant""",
    "l6_case_summary": CASES + """, a as (select l_orderkey as case_id, l_partkey % 4 as ref, min(l_linenumber) filter (where l_returnflag = 'A' and l_linestatus <> 'O') as failed, min(l_linenumber) filter (where l_linestatus = 'O') as met from lineitem group by all),
f as (select * from (select *, row_number() over (partition by case_id order by ref) as r from a) where r = 1)
select case_id, case majority_verdict when 'click' then 'accept' when 'view' then 'reject' when 'neutral' then 'open' end as label, coalesce(failed, met)::varchar as reason, case majority_verdict when 'click' then 'file,close' when 'neutral' then 'review' else '' end as actions from voted join f using (case_id)""",
    "l3_uncertain": CASES + "select case_id from voted join (select case_id, stddev_samp(confidence) as sd from o group by case_id) using (case_id) where consensus = 'split' or sd > 0.2",
    "l7_citation_leaks": CASES + """, x as (select distinct event_id // 3 as case_id, 'a' || (user_id % 4) as ref from events where event_id % 2 <> 0 and user_id % 3 <> 0)
select distinct case_id, role, ref from (select case_id, role, unnest(cited) as ref from o) join x using (case_id, ref)""",
    "m16_miss_buckets": POOL + "select query_id as sample_id, case max(case when gold.ref % 5 = 0 then 3 when k is null or k > 15 then 2 when k > 5 then 1 else 0 end) when 3 then 'not_in_graph' when 2 then 'deep_miss' when 1 then 'near_miss' else 'found' end as bucket from gold left join (select query_id, ref, case when ref % 2 = 0 then rank when ref % 3 = 0 then rank + 2 end as k from pool) using (query_id, ref) group by query_id",
    "m18_query_rollup": AUDIT + """select query_id, round(score, 6) as score, round(prune_ratio, 6) as prune_ratio, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from (select query_id, coalesce(avg(ratio) filter (where is_applicable), 0.0) as score, avg((not is_applicable)::int) as prune_ratio,
coalesce(count(*) filter (where is_applicable and topically_relevant) / nullif(count(*) filter (where is_applicable), 0), 0.0) as p, coalesce(count(*) filter (where is_applicable and topically_relevant) / nullif(count(*) filter (where topically_relevant), 0), 0.0) as r from audited group by query_id)""",
    "n12_e2e_conformal": POOL + """, ok as (select distinct query_id from pool join gold using (query_id, ref) where rank <= 8), c as (select query_id, case when query_id in (select query_id from ok) then 1 - (query_id % 10) / 10.0::double else 'infinity'::double end as s from (select distinct query_id from gold)),
ks as (select a::double as alpha, ceil(((select count(*) from c) + 1) * (1 - a::double))::bigint as k from (select unnest([0.2, 0.4, 0.6, 0.8]) as a))
select alpha, round(coalesce((select s from (select s, row_number() over (order by s) as r from c where s < 'infinity') where r = k), 'infinity'::double), 6) as threshold, k <= (select count(*) from c) as achievable from ks""",
    "n13_methods": """with r as (select event_id % 4 / 10.0::double as alpha, 'm' || (event_id % 3) as method, round(avg(least(1.0, floor(value) / 100)), 4) as coverage, round(avg(floor(value)), 4) as mean_size from events group by all),
x as (select a.alpha, a.method, a.coverage >= b.coverage as maintained, a.mean_size / b.mean_size as size_ratio from r a join r b on a.alpha = b.alpha and b.method = 'm0' and a.method <> 'm0') select alpha, method, maintained, round(size_ratio, 6) as size_ratio, first_value(method) over (partition by alpha order by size_ratio, method) as best from x""",
}
