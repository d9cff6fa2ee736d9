"""Queries of the retrieval, audit and opinion operators.

A user of `events` is a query; its 20 largest and its 20 latest events are two ranked lists; an event's hour is its ruling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.text import tokens
from citeloom.operators import audit as A
from citeloom.operators import opinions as O
from citeloom.operators import pivots as PV
from citeloom.operators import postings as P
from citeloom.operators import retrieval as R
from citeloom.operators import vectors as V
from citeloom.plans.evaluation import r6
from citeloom.plans.tables import table
from citeloom.sources.records import shared_folder

CHANNELS = ["feature", "ruling", "article"]


def _tokens(c: str):
    return tokens(F.lower(F.coalesce(F.col(c), F.lit(""))), "\\p{L}+")


def _pruned(s: SparkSession, d: str) -> DataFrame:
    """The search of h5_cosine_top_k from a stored pivot table."""
    e, path = table(s, d, "embeddings"), shared_folder(s, "pivots")
    PV.write_pivots(e.select(F.col("vec_id").alias("id"), "embedding", "label"), path, ["label"])
    return r6(PV.search(s, path, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5), "score")


def _bm25(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), _tokens("text").alias("tokens"))
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), _tokens("text").alias("tokens"))
    return r6(R.bm25(docs, q, 10), "score")


def _stored_bm25(s: SparkSession, d: str) -> DataFrame:
    """The search of h8_bm25 from a stored index."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), _tokens("text").alias("tokens"))
    q, path = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), _tokens("text").alias("tokens")), shared_folder(s, "postings")
    P.write_postings(docs, path)
    return r6(P.search(s, path, q, 10), "score")


def _bm25_words(s: SparkSession, d: str) -> DataFrame:
    """Short queries: the two words of every hundredth part's name against all names."""
    docs = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), " ").alias("tokens"))
    q = table(s, d, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.slice(F.split(F.lower("p_name"), " "), 1, 2).alias("tokens"))
    path = shared_folder(s, "postings")
    P.write_postings(docs, path)
    return r6(P.search(s, path, q, 5), "score")


def _hits(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("user_id").alias("query_id"), "event_id", "event_type", "value", (F.col("event_id") % 40).alias("ruling_id"))
    by = lambda n, *o: e.withColumns({"list_no": F.lit(n), "rank": F.row_number().over(Window.partitionBy("query_id").orderBy(*o))}).filter("rank <= 20")
    return by(1, F.desc("value"), "event_id").unionByName(by(2, F.desc("event_id")))


HITS = """with e as (select user_id as query_id, event_id, event_type, value, event_id % 40 as ruling_id from events),
hits as (select * from (select *, 1 as list_no, row_number() over (partition by query_id order by value desc, event_id)::int as rank from e) where rank <= 20
 union all select * from (select *, 2, row_number() over (partition by query_id order by event_id desc)::int as rank from e) where rank <= 20)
"""


def _fused(s: SparkSession, d: str) -> DataFrame:
    rows = _hits(s, d).withColumn("key", F.concat_ws(":", "event_type", F.col("ruling_id").cast("string")))
    return r6(R.reciprocal_rank_fusion(rows.select("query_id", "key", "list_no", "rank", "event_id"), 15), "rrf_score").select("query_id", "key", "rrf_score", "rank", "event_id")


def _refs(s: SparkSession, d: str) -> DataFrame:
    rows = _hits(s, d).select("query_id", (F.col("list_no") - 1).alias("tier"), "rank", F.array(F.concat(F.lit("a"), F.col("event_id") % 9), F.concat(F.lit("b"), F.col("event_id") % 5)).alias("refs"))
    return R.article_refs(rows)


def _channel_hits(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").filter("event_type in ('view', 'click', 'error') and user_id % 7 != 0 or event_type = 'click' and event_id % 2 = 0")
    name = F.when(F.col("event_type") == "view", "feature").when(F.col("event_type") == "click", "ruling").when(F.col("event_type") == "error", "article")
    rank = F.row_number().over(Window.partitionBy("query_id", "channel").orderBy(F.desc("score"), "event_id"))
    return e.select(F.col("user_id").alias("query_id"), name.alias("channel"), (F.least(F.lit(100), F.floor("value")) / 100.0).alias("score"), "event_id").withColumn("rank", rank)


CHANNEL = """with h as (select user_id as query_id, case event_type when 'view' then 'feature' when 'click' then 'ruling' when 'error' then 'article' end as channel, least(100, floor(value)::bigint) / 100.0::double as score, event_id from events
 where event_type in ('view', 'click', 'error') and user_id % 7 <> 0 or event_type = 'click' and event_id % 2 = 0),
ranked as (select *, row_number() over (partition by query_id, channel order by score desc, event_id) as rank from h),
q as (select distinct user_id as query_id from events),
quality as (select query_id, avg(score) filter (where channel = 'feature') as f, avg(score) filter (where channel = 'ruling') as r, avg(score) filter (where channel = 'article') as a from q left join (select * from ranked where rank <= 3) x using (query_id) group by query_id)
"""


def _quality(s: SparkSession, d: str) -> DataFrame:
    """Means are summed from the first rank, as the SQL does on tables with as many events a user as the given ones."""
    return R.channel_quality(table(s, d, "events").select(F.col("user_id").alias("query_id")).distinct(), _channel_hits(s, d), CHANNELS, from_last=False)


def _confidence(s: SparkSession, d: str) -> DataFrame:
    out = R.confidence(_quality(s, d), {"feature": 1 / 6, "ruling": 2 / 3, "article": 1 / 6}, digits=None)
    return r6(out, "score").select("query_id", F.size("missing").alias("n_missing"), "score", "level")


def _gated(s: SparkSession, d: str) -> DataFrame:
    q = _quality(s, d).withColumn("queried", F.when(F.col("query_id") % 3 == 0, F.array(F.lit("ruling"))).otherwise(F.array(F.lit("ruling"), F.lit("article"))))
    q = q.withColumn("support", F.when(F.col("query_id") % 4 != 0, (F.col("query_id") % 10) / 10.0))
    return r6(R.blended_confidence(q, "queried", {"feature": 0.2, "ruling": 0.5, "article": 0.3}, support_weight=0.25), "score").select("query_id", "score")


def _candidates(s: SparkSession, d: str) -> DataFrame:
    h = _hits(s, d)
    direct = h.filter("list_no = 1 and rank <= 5").select("query_id", (F.col("event_id") % 30).alias("ref"), "rank")
    cited = h.filter("list_no = 2").select("query_id", (F.col("event_id") % 30).alias("ref"), F.round("value", 2).alias("score"), "rank")
    return R.ranked_candidates(direct, cited).select("query_id", "ref", "position")


def _audited(s: SparkSession, d: str) -> DataFrame:
    """An order is a query, a part an article, a line a checklist item."""
    items = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("condition"), (F.col("l_returnflag") == "A").alias("necessary"), (F.col("l_linestatus") == "O").alias("satisfied"))))
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") % 4).cast("string").alias("article_ref")).agg(items.alias("checklist"))
    return rows.select("query_id", "article_ref", "checklist", A.decided(F.col("checklist")).alias("x")).select("query_id", "article_ref", "checklist", "x.*").withColumn("topically_relevant", F.col("query_id") % 3 != 0)


AUDIT = """with raw as (select l_orderkey as query_id, (l_partkey % 4)::varchar as article_ref, count(*) as n, count(*) filter (where l_returnflag = 'A') as need, count(*) filter (where l_linestatus = 'O') as sat, count(*) filter (where l_returnflag = 'A' and l_linestatus = 'O') as hit from lineitem group by all),
audited as (select query_id, article_ref, n, ratio, case when need > 0 then ratio = 1 else ratio >= 0.6 end as is_applicable, round(ratio, 3) as confidence, query_id % 3 <> 0 as topically_relevant from (select *, case when need > 0 then hit / need::double else sat / n::double end as ratio from raw))
"""


def _cases(s: SparkSession, d: str) -> DataFrame:
    """Three events in a row are a case; each is an opinion."""
    e = table(s, d, "events")
    return e.select(F.floor(F.col("event_id") / 3).alias("case_id"), (F.col("event_id") % 3).alias("pos"), F.concat(F.lit("r"), F.col("event_id") % 3).alias("role"), F.col("event_type").alias("verdict"), (F.least(F.lit(100), F.floor("value")) / 100.0).alias("confidence"), F.array(F.concat(F.lit("a"), F.col("user_id") % 4), F.concat(F.lit("b"), F.floor("value") % 3)).alias("cited_articles"))


CASES = """with o as (select event_id // 3 as case_id, event_id % 3 as pos, 'r' || (event_id % 3) as role, event_type as verdict, least(100, floor(value)::bigint) / 100.0::double as confidence, ['a' || (user_id % 4), 'b' || (floor(value)::bigint % 3)] as cited from events),
per as (select case_id, count(*) as n, max(c) as most, arg_max(verdict, c) as top, sum(c) as total from (select case_id, verdict, count(*) as c from o group by all) group by case_id),
voted as (select case_id, case when most = 1 then 'neutral' else top end as majority_verdict, case most when 3 then 'full' when 2 then 'majority' else 'split' end as consensus from per where total = 3)
"""


def _fusion(s: SparkSession, d: str) -> DataFrame:
    cases = _cases(s, d)
    priors = cases.groupBy("case_id").agg(F.max("confidence").alias("score"), (F.min("confidence") * 2).alias("prune_ratio"))
    out = O.fused(cases, priors, digits=None)
    return r6(out, "final_confidence", "agent_conf_std").select("case_id", "majority_verdict", "consensus", "final_confidence", "agent_conf_std", "uncertainty_flag", F.array_join("notes", ",").alias("notes"))


QUERIES = {
    "h5_cosine_top_k": lambda s, d: r6(V.cosine_top_k(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label"), table(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, ["label"]), "score"),
    "h5_pruned_top_k": _pruned,
    "h8_bm25": _bm25,
    "h8_bm25_words": _bm25_words,
    "h8_stored_bm25": _stored_bm25,
    "j6_rrf": _fused,
    "j7_article_refs": _refs,
    "j8_confidence": _confidence,
    "j10_without_self": lambda s, d: R.without_self(_hits(s, d).withColumn("self_ruling_id", F.col("query_id") % 40).withColumn("ruling_id", F.when(F.col("event_id") % 6 != 0, F.col("ruling_id")))).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("ruling_id").alias("with_ruling")),
    "j11_candidates": _candidates,
    "j14_hit_report": lambda s, d: R.hit_report(_hits(s, d).select("query_id", F.concat(F.lit("c"), "list_no").alias("channel"), F.when(F.col("event_id") % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("event_id") % 11)).alias("refs"))),
    "j15_differences": lambda s, d: R.differences(_fused(s, d), _fused(s, d).filter("rank <= 14"), ["query_id", "key"], "rrf_score"),
    "j16_gated_confidence": _gated,
    "k2_decided": lambda s, d: r6(_audited(s, d), "ratio", "confidence").select("query_id", "article_ref", "ratio", "is_applicable", "confidence"),
    "k4_query_audit": lambda s, d: r6(A.query_audit(_audited(s, d).withColumn("confidence", F.col("ratio"))).withColumn("pruned", F.array_join("pruned", ",")), "auditor_score", "prune_ratio"),
    "k6_fallback": lambda s, d: A.with_fallback(_audited(s, d)).groupBy("query_id", "added").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("article_ref")), ",").alias("refs")),
    "l1_majority": lambda s, d: O.majority(_cases(s, d)),
    "l2_fused": _fusion,
    "l4_agreed": lambda s, d: O.agreed_refs(_cases(s, d)).select("case_id", F.array_join("agreed", ",").alias("agreed"), F.array_join("all_cited", ",").alias("all_cited")),
    "l5_completed": lambda s, d: O.completed(_cases(s, d).filter("NOT (case_id % 2 = 0 AND pos = 1)")).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("pos", "verdict"))["verdict"].alias("last_verdict")),
}
ORACLE = {
    "h5_cosine_top_k": """with v as (select vec_id, label, embedding::double[] as e from embeddings) select query_id, label, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id, label order by round(score, 9) desc, id)::int as rank from (select q.vec_id as query_id, c.label, c.vec_id as id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) as score from v q join v c on true where q.vec_id % 100 = 0)) where rank <= 5""",
    "h5_pruned_top_k": """with v as (select vec_id, label, embedding::double[] as e from embeddings) select query_id, label, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id, label order by round(score, 9) desc, id)::int as rank from (select q.vec_id as query_id, c.label, c.vec_id as id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) as score from v q join v c on true where q.vec_id % 100 = 0)) where rank <= 5""",
    "h8_bm25": """with d as (select doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') as t from documents), s as (select count(*)::double as n, avg(len(t)) as m from d),
tf as (select id, len, term, count(*)::double as tf from (select id, len(t) as len, unnest(t) as term from d) group by all), raw as (select term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) as raw from tf, s group by term, n),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw), q as (select query_id, term, count(*) as times from (select item_id as query_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) as term from benchmark) group by all),
met as (select query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))) as score from tf join idf using (term) join q using (term), s group by query_id, id),
sc as (select query_id, id, coalesce(score, 0) as score from (select item_id as query_id, id from benchmark, d) left join met using (query_id, id))
select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int as rank from sc) where rank <= 10""",
    "h8_stored_bm25": """with d as (select doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') as t from documents), s as (select count(*)::double as n, avg(len(t)) as m from d),
tf as (select id, len, term, count(*)::double as tf from (select id, len(t) as len, unnest(t) as term from d) group by all), raw as (select term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) as raw from tf, s group by term, n),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw), q as (select query_id, term, count(*) as times from (select item_id as query_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) as term from benchmark) group by all),
met as (select query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))) as score from tf join idf using (term) join q using (term), s group by query_id, id),
sc as (select query_id, id, coalesce(score, 0) as score from (select item_id as query_id, id from benchmark, d) left join met using (query_id, id))
select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int as rank from sc) where rank <= 10""",
    "h8_bm25_words": """with d as (select p_partkey as id, string_split(lower(p_name), ' ') as t from part), asked as (select p_partkey as query_id, string_split(lower(p_name), ' ')[1:2] as t from part where p_partkey % 100 = 0), s as (select count(*)::double as n, avg(len(t)) as m from d),
tf as (select id, len, term, count(*)::double as tf from (select id, len(t) as len, unnest(t) as term from d) group by all), raw as (select term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) as raw from tf, s group by term, n),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw), q as (select query_id, term, count(*) as times from (select query_id, unnest(t) as term from asked) group by all),
met as (select query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))) as score from tf join idf using (term) join q using (term), s group by query_id, id),
sc as (select query_id, id, coalesce(score, 0) as score from (select query_id, id from asked, d) left join met using (query_id, id))
select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int as rank from sc) where rank <= 5""",
    "j6_rrf": HITS + """, f as (select query_id, event_type || ':' || ruling_id as key, sum(1.0::double / (rank + 60)) as s, min(list_no * 1000 + rank) as pos_at, arg_min(event_id, list_no * 1000 + rank) as event_id from hits group by 1, 2)
select query_id, key, round(s, 6) as rrf_score, rank, event_id from (select *, row_number() over (partition by query_id order by round(s, 12) desc, pos_at)::int as rank from f) where rank <= 15""",
    "j7_article_refs": HITS + ", x as (select query_id, list_no, rank, 0 as i, 'a' || (event_id % 9) as ref from hits union all select query_id, list_no, rank, 1, 'b' || (event_id % 5) from hits) select query_id, ref, row_number() over (partition by query_id order by pos_at)::int as position from (select query_id, ref, min(list_no * 10000 + rank * 10 + i) as pos_at from x group by query_id, ref)",
    "j8_confidence": CHANNEL + """select query_id, n_missing, round(s, 6) as score, case when s >= 0.7 then 'high' when s >= 0.5 then 'medium' else 'low' end as level from (select query_id, (f is null)::int + (r is null)::int + (a is null)::int as n_missing,
greatest(0.0, least(1.0, coalesce(f, 0) / 6 + coalesce(r, 0) * 2 / 3 + coalesce(a, 0) / 6 - 0.1 * ((f is null)::int + (r is null)::int + (a is null)::int))) as s from quality)""",
    "j10_without_self": HITS + ", x as (select query_id, case when event_id % 6 <> 0 then ruling_id end as ruling_id from hits) select query_id, count(*) as n, count(ruling_id) as with_ruling from x where ruling_id is null or ruling_id <> query_id % 40 group by query_id",
    "j11_candidates": HITS + """, d as (select query_id, event_id % 30 as ref, min(rank) as pos_at, 0 as tier, 0.0::double as w from hits where list_no = 1 and rank <= 5 group by 1, 2), c as (select query_id, event_id % 30 as ref, min(rank) as pos_at, 1 as tier, round(sum(round(value, 2)), 9) as w from hits where list_no = 2 group by 1, 2)
select query_id, ref, row_number() over (partition by query_id order by tier, w desc, pos_at, ref)::int as position from (select * from d union all select * from c anti join d using (query_id, ref))""",
    "j14_hit_report": HITS + "select query_id, 'c' || list_no as channel, count(*) as hits, count(*) filter (where event_id % 4 <> 0) as with_refs, count(distinct event_id % 11) filter (where event_id % 4 <> 0) as refs from hits group by 1, 2",
    "j16_gated_confidence": CHANNEL + """select query_id, round(greatest(0.0, least(1.0, case when sup is null then b else 0.75 * b + 0.25 * sup end - 0.1 * m)), 6) as score from (select query_id, case when query_id % 3 = 0 then coalesce(r, 0) * 0.5 / 0.5 else (coalesce(r, 0) * 0.5 + coalesce(a, 0) * 0.3) / 0.8 end as b,
case when query_id % 4 <> 0 then (query_id % 10) / 10.0::double end as sup, (r is null)::int + case when query_id % 3 = 0 then 0 else (a is null)::int end as m from quality)""",
    "k2_decided": AUDIT + "select query_id, article_ref, round(ratio, 6) as ratio, is_applicable, confidence from audited",
    "k4_query_audit": AUDIT + "select query_id, round(coalesce(avg(ratio) filter (where is_applicable), 0.0), 6) as auditor_score, round(avg((not is_applicable)::int), 6) as prune_ratio, coalesce(string_agg(article_ref, ',' order by article_ref) filter (where not is_applicable), '') as pruned from audited group by query_id",
    "k6_fallback": AUDIT + """, r as (select *, count(*) filter (where is_applicable) over (partition by query_id) as ok, row_number() over (partition by query_id, not is_applicable and topically_relevant order by confidence desc, article_ref) as k from audited),
x as (select query_id, false as added, article_ref from audited union all select query_id, true, article_ref from r where not is_applicable and topically_relevant and k <= 3 - ok) select query_id, added, count(*) as n, string_agg(article_ref, ',' order by article_ref) as refs from x group by query_id, added""",
    "l1_majority": CASES + "select * from voted",
    "l2_fused": CASES + """, p as (select case_id, avg(confidence) as m, stddev_samp(confidence) as sd, max(confidence) as score, min(confidence) * 2 as prune from o group by case_id)
select case_id, majority_verdict, consensus, round(least(1.0, case when consensus = 'split' then greatest(0.0, 0.4 * score + 0.6 * m - 0.1) else 0.4 * score + 0.6 * m end), 6) as final_confidence, round(sd, 6) as agent_conf_std, consensus = 'split' or sd > 0.2 as uncertainty_flag,
concat_ws(',', case when consensus = 'split' or sd > 0.2 then 'uncertain' end, case when prune > 0.5 then 'pruned' end) as notes from voted join p using (case_id)""",
    "l4_agreed": CASES + ", x as (select case_id, ref, count(*) as n from (select case_id, unnest(cited) as ref from o) group by all) select case_id, coalesce(string_agg(ref, ',' order by ref) filter (where n >= 2), '') as agreed, string_agg(ref, ',' order by ref) as all_cited from x group by case_id",
    "l5_completed": CASES + ", x as (select * from o where not (case_id % 2 = 0 and pos = 1)) select case_id, case when count(*) = 2 then 3 else count(*) end as n, case when count(*) = 2 then 'neutral' else arg_max(verdict, pos) end as last_verdict from x group by case_id",
}
ORACLE["j15_differences"] = HITS + """, f as (select query_id, event_type || ':' || ruling_id as key, sum(1.0::double / (rank + 60)) as s, min(list_no * 1000 + rank) as pos_at from hits group by 1, 2)
select query_id, key, round(s, 6) as rrf_score, 'a' as side from (select *, row_number() over (partition by query_id order by round(s, 12) desc, pos_at) as rank from f) where rank = 15"""
