"""Queries of the remaining text, vocabulary, vector, audit and regression operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import audit as A
from citeloom.operators import calibration as C
from citeloom.operators import features as FE
from citeloom.operators import metrics as M
from citeloom.operators import terms as TE
from citeloom.operators import vectors as V
from citeloom.operators import vocabulary as VO
from citeloom.plans.curation import GRAMS, STOP, TOK, VOCAB, _counts, _tokens, _vocab
from citeloom.plans.evaluation import POOL, SCORED, gold, pool, r6, scored
from citeloom.plans.tables import table

SEGMENTS = {"HOUSEHOLD": "home", "MACHINERY": "plant", "BUILDING": "plant"}


def _answers(s: SparkSession, d: str) -> DataFrame:
    """A fenced JSON answer for each line item."""
    item = F.concat(F.lit('{"condition": "c'), F.col("l_linenumber"), F.lit('", "necessary": '), F.when(F.col("l_returnflag") == "A", "true").otherwise("false"), F.lit(', "satisfied": '), F.when(F.col("l_linestatus") == "O", "true").otherwise('"unknown"'), F.lit("}"))
    raw = F.concat(F.lit('```json\n{"topically_relevant": '), F.when(F.col("l_orderkey") % 2 == 0, "false").otherwise('"perhaps"'), F.lit(', "checklist": ['), item, F.lit("]}\n```"))
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 == 0, "not json").otherwise(raw).alias("raw"))
    out = A.parsed_answers(rows)
    first = F.try_element_at("checklist", F.lit(1))
    return out.select("l_orderkey", "l_linenumber", "topically_relevant", "parse_error", first["condition"].alias("condition"), first["necessary"].alias("necessary"), first["satisfied"].alias("satisfied"))


def _reviewed(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    k = F.col("p_partkey") % 5
    decision = F.when(k == 0, F.col("p_type")).when(k == 1, F.concat(F.lit("alias:"), "p_name")).when(k == 2, "REMOVE").when(k == 3, "alias:nothing such").otherwise("?")
    out = VO.reviewed(p.select(F.col("p_partkey").cast("string").alias("term"), decision.alias("decision")), _vocab(s, d), ["LARGE", "SMALL", "MEDIUM", "STANDARD", "ECONOMY"])
    return out.select("term", "kind", "category", "canonical")


def _gaps(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    near = V.cosine_top_k(e.filter("vec_id % 100 != 0").select(F.col("vec_id").alias("id"), "embedding"), e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 1)
    nearest = near.select(F.col("query_id").alias("gram"), F.col("id").alias("nearest"), "score")
    return r6(VO.gap_report(e.select(F.col("vec_id").alias("gram")), nearest, 0.5), "score")


def _lost(s: SparkSession, d: str) -> DataFrame:
    """Cleaning drops words that begin with e; the benchmark's words among them are lost."""
    words = table(s, d, "benchmark").select(F.explode(X.tokens(F.lower("text"), "\\p{L}+")).alias("raw")).distinct()
    after = VO.gram_counts(_tokens(s, d).withColumn("tokens", F.filter("tokens", lambda t: ~F.startswith(t, F.lit("e")))), STOP)
    return VO.lost_phrases(_counts(s, d), after, words, words.filter("length(raw) > 6").select(F.col("raw").alias("phrase")))


#: Runs of two and three words and single ones that the masked texts lose.
MASKED = ["the", "the and", "that", "in the", "of the", "en", "in", "and in the", "er"]


def _term_places(s: SparkSession, d: str) -> DataFrame:
    """Every run of one to three words of the benchmark, in all documents."""
    words = table(s, d, "benchmark").select("item_id", X.tokens(F.lower(F.coalesce("text", F.lit(""))), "\\p{L}+").alias("w"))
    runs = words.select(F.explode(TE.ngrams(F.col("w"), F.array(*map(F.lit, (1, 2, 3))))).alias("g")).select(F.col("g.gram").alias("raw")).distinct()
    per = TE.term_places(_tokens(s, d), runs, ["doc_id"]).groupBy("gram", "n", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    return per.groupBy("gram", "n").agg(F.sum("times").alias("n_places"), F.count(F.lit(1)).alias("n_docs"))


def _without_terms(s: SparkSession, d: str) -> DataFrame:
    out = TE.without_terms(_tokens(s, d), MASKED, sentinel="~")
    return out.select("doc_id", F.size("masked").cast("long").alias("n_tokens"), F.md5(F.array_join("masked", " ")).alias("h"))


def _ridge(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).select(F.col("score"), (F.col("other") + F.col("label")).cast("double").alias("y"))
    m = C.fit_ridge(rows, ["score"], "y", 2.0)
    return rows.limit(1).select(F.round(F.lit(float(m.coefficients[0])), 5).alias("slope"), F.round(F.lit(float(m.intercept)), 5).alias("intercept"))


def _logistic(s: SparkSession, d: str) -> DataFrame:
    """Held-out AUROC by fold of a balanced regression on two features."""
    rows = C.stratified_folds(scored(s, d), "doc_id", "stratum", 5).withColumn("other", F.col("other") / 6.0)
    m = C.fit_logistic(rows.filter("fold != 0"), ["score", "other"], "label", 0.5, True)
    out = C.apply_logistic(rows, ["score", "other"], [float(w) for w in m.coefficients], float(m.intercept))
    return r6(M.auroc(out, "probability", "label", ["fold"]), "auroc")


def _raw_pruned(s: SparkSession, d: str) -> DataFrame:
    """Set scores of all retrieved references and of those left after pruning the lower half."""
    p = pool(s, d).select("query_id", F.col("ref").cast("string").alias("ref"), "rank")
    sides = p.groupBy("query_id").agg(F.collect_set("ref").alias("raw"), F.collect_set(F.when(F.col("rank") <= 10, F.col("ref"))).alias("kept")).join(gold(s, d).groupBy("query_id").agg(F.collect_set(F.col("ref").cast("string")).alias("g")), "query_id")
    rows = sides.select(M.set_scores(F.col("raw"), F.col("g")).alias("a"), M.set_scores(F.col("kept"), F.col("g")).alias("b"))
    return r6(rows.agg(F.avg("a.recall").alias("raw_recall"), F.avg("b.recall").alias("kept_recall"), F.avg("a.precision").alias("raw_precision"), F.avg("b.precision").alias("kept_precision"), F.sum((F.col("b.f1") == 0).cast("long")).alias("zero_f1")), "raw_recall", "kept_recall", "raw_precision", "kept_precision")


def _embedded(s: SparkSession, d: str) -> DataFrame:
    """The mean vectors of all documents' chunks by the test embedder."""
    chunks = table(s, d, "documents").select("doc_id", F.explode(X.chunks(F.coalesce("text", F.lit("")))).alias("chunk"))
    m = V.mean_vectors(V.embedded(chunks, V.hashing_embedder(8)), "doc_id")
    return m.select("doc_id", *(F.round(F.col("embedding")[i], 6).alias(f"x{i}") for i in range(8)))


QUERIES = {
    "b2_strip_invisible": lambda s, d: table(s, d, "customer").select("c_custkey", X.strip_invisible(F.concat(F.lit(" ​"), "c_name", F.lit("‌\t"))).alias("name")),
    "b4_match_key": lambda s, d: table(s, d, "part").select("p_partkey", X.match_key(F.concat(F.lit("أ إ ة ك ي ء‌ "), "p_name")).alias("key")),
    "b10_joined": lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(X.joined_sections(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_returnflag").alias("text")))), "|").alias("text")),
    "b11_without_noise": lambda s, d: table(s, d, "part").select("p_partkey", X.without_noise(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")), ["red", "red ring"], ["[0-9]{3,}"], "~").alias("text")),
    "b11_without_terms": _without_terms,
    "b13_case_type": lambda s, d: table(s, d, "part").select("p_partkey", X.mapped(F.col("p_type"), {t: t.lower() for t in ("LARGE", "SMALL", "MEDIUM", "STANDARD", "ECONOMY", "PROMO")}).alias("case_type")),
    "b14_mapped": lambda s, d: table(s, d, "customer").select("c_custkey", X.mapped(F.col("c_mktsegment"), SEGMENTS).alias("segment")),
    "f1_term_places": _term_places,
    "f3_parsed_json": lambda s, d: FE.parsed_json(table(s, d, "events"), "k long", "props").select("event_id", F.col("parsed.k").alias("k")),
    "f5_located": lambda s, d: FE.located(table(s, d, "part").select(F.col("p_partkey").alias("ruling_id"), F.when(F.col("p_partkey") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.element_at(F.split("p_name", " "), -1)).alias("quote")), table(s, d, "part").select(F.col("p_partkey").alias("ruling_id"), F.col("p_name").alias("text"))),
    "g4_failed_batches": lambda s, d: VO.failed_batches(table(s, d, "part").select((F.col("p_partkey") % 50).alias("batch"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("term")), table(s, d, "part").filter("p_partkey % 97 != 0").select((F.col("p_partkey") % 50).alias("batch"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("term"), F.col("p_type").alias("category"), F.when(F.col("p_partkey") % 89 != 0, F.col("p_brand")).alias("root")), ["LARGE", "SMALL", "MEDIUM", "STANDARD", "ECONOMY", "PROMO"]),
    "g12_reviewed": _reviewed,
    "g15_gap_report": _gaps,
    "g17_lost_phrases": _lost,
    "h2_embedded": _embedded,
    "h4_attached": lambda s, d: V.attached(table(s, d, "labels").select("doc_id"), table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), ["doc_id"]).select("doc_id", F.round(F.try_element_at("embedding", F.lit(1)).cast("double"), 6).alias("first")),
    "h6_vocabulary": lambda s, d: r6(V.relevant_vocabulary(table(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("section_id"), (F.col("vec_id") % 600).alias("case_id"), "embedding"), table(s, d, "embeddings").filter("vec_id % 100 != 0").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).alias("category"), "embedding"), 4, 6), "score"),
    "k1_parsed_answers": _answers,
    "m19_raw_and_pruned": _raw_pruned,
    "n5_logistic": _logistic,
    "n6_ridge": _ridge,
}
ORACLE = {
    "b2_strip_invisible": "select c_custkey, c_name as name from customer",
    "b4_match_key": "select p_partkey, 'ااهکی' || replace(p_name, ' ', '') as key from part",
    "b10_joined": "select l_orderkey, string_agg(l_returnflag, '|' order by l_linenumber, l_partkey, l_returnflag) as text from lineitem group by l_orderkey",
    "b11_without_noise": "select p_partkey, regexp_replace(p_name || ' ' || p_partkey, 'red ring|red|[0-9]{3,}', '~', 'g') as text from part",
    "b11_without_terms": TOK + "m as (select doc_id, regexp_replace(array_to_string(list_transform(w, lambda x: '<' || x || '>'), ''), '" + "|".join(sorted(("".join(f"<{w}>" for w in t.split()) for t in MASKED), key=len, reverse=True)) + "', '<~>', 'g') as t from t) select doc_id, len(t) - len(replace(t, '<', '')) as n_tokens, md5(replace(replace(replace(t, '><', ' '), '<', ''), '>', '')) as h from m",
    "b13_case_type": "select p_partkey, case when p_type in ('LARGE', 'SMALL', 'MEDIUM', 'STANDARD', 'ECONOMY', 'PROMO') then lower(p_type) else p_type end as case_type from part",
    "b14_mapped": "select c_custkey, case c_mktsegment when 'HOUSEHOLD' then 'home' when 'MACHINERY' then 'plant' when 'BUILDING' then 'plant' else c_mktsegment end as segment from customer",
    "f1_term_places": TOK + """b as (select regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') as w from benchmark),
terms as (select distinct array_to_string(w[i:i + n - 1], ' ') as gram, n from (select w, unnest(range(1, len(w) + 1)) as i from b), (select unnest([1, 2, 3]) as n) where i + n - 1 <= len(w)),
runs as (select doc_id, array_to_string(w[i:i + n - 1], ' ') as gram, n from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from t), (select unnest([1, 2, 3]) as n) where i + n - 1 <= len(w))
select gram, n::int as n, count(*) as n_places, count(distinct doc_id) as n_docs from runs join terms using (gram, n) group by gram, n""",
    "f3_parsed_json": "select event_id, regexp_extract(props, '\"k\": *([0-9]+)', 1)::bigint as k from events",
    "f5_located": "select p_partkey as ruling_id, case when p_partkey % 3 = 0 then replace(p_name, ' ', '') else q end as quote, case when p_partkey % 3 = 0 then 0 else instr(p_name, q) - 1 end::int as start_char, case when p_partkey % 3 = 0 then length(p_name) else instr(p_name, q) - 1 + length(q) end::int as end_char from (select *, string_split(p_name, ' ')[-1] as q from part)",
    "g4_failed_batches": "select p_partkey % 50 as batch, count(*) as n_bad from part where p_partkey % 97 = 0 or p_partkey % 89 = 0 group by 1",
    "g12_reviewed": VOCAB + """, home as (select canonical, arg_min(category, ord * 1000) as home from vocab where is_canonical group by canonical), c as (select p_partkey::varchar as term, p_partkey % 5 as k, p_type, p_name, home from part left join home on p_name = canonical)
select term, case k when 0 then case when p_type in ('LARGE', 'SMALL', 'MEDIUM', 'STANDARD', 'ECONOMY') then 'new' else 'invalid' end when 1 then case when home is not null then 'alias' else 'invalid' end when 2 then 'skipped' else 'invalid' end as kind,
case when k = 0 and p_type in ('LARGE', 'SMALL', 'MEDIUM', 'STANDARD', 'ECONOMY') then p_type when k = 1 then home end as category, case when k = 0 and p_type in ('LARGE', 'SMALL', 'MEDIUM', 'STANDARD', 'ECONOMY') then term when k = 1 and home is not null then p_name end as canonical from c""",
    "g15_gap_report": """with v as (select vec_id, embedding::double[] as e from embeddings), x as (select q.vec_id as gram, c.vec_id as nearest, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) as score from v q join v c on q.vec_id % 100 = 0 and c.vec_id % 100 <> 0),
r as (select *, row_number() over (partition by gram order by round(score, 9) desc, nearest) as r from x) select v.vec_id as gram, nearest, round(score, 6) as score, case when score >= 0.5 then 'alias' else 'new' end as verdict from v left join (select * from r where r = 1) r on r.gram = v.vec_id""",
    "g17_lost_phrases": GRAMS + ", words as (select distinct raw from (select unnest(regexp_extract_all(lower(text), '\\p{L}+')) as raw from benchmark)) select gram, length(gram) > 6 as expected from counts where gram in (select raw from words) and gram like 'e%'",
    "h4_attached": "select doc_id, round(embedding[1]::double, 6) as first from labels left join embeddings on vec_id = doc_id",
    "h6_vocabulary": """with v as (select vec_id, embedding::double[] as e from embeddings), x as (select q.vec_id as section, q.vec_id % 600 as case_id, c.vec_id as id, c.vec_id % 3 as category, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) as score from v q join v c on q.vec_id % 100 = 0 and c.vec_id % 100 <> 0),
t as (select case_id, category, id, max(score) as score from (select *, row_number() over (partition by section, category order by round(score, 9) desc, id) as r from x) where r <= 4 group by all)
select case_id, category, id, round(score, 6) as score from (select *, row_number() over (partition by case_id, category order by round(score, 9) desc, id) as r from t) where r <= 6""",
    "k1_parsed_answers": """select l_orderkey, l_linenumber, l_orderkey % 7 = 0 or l_orderkey % 2 <> 0 as topically_relevant, l_orderkey % 7 = 0 as parse_error, case when l_orderkey % 7 <> 0 then 'c' || l_linenumber end as condition,
case when l_orderkey % 7 <> 0 then l_returnflag = 'A' end as necessary, case when l_orderkey % 7 <> 0 then l_linestatus = 'O' end as satisfied from lineitem""",
    "m19_raw_and_pruned": POOL + """, s as (select query_id, count(*)::double as g, count(pool.ref)::double as h, count(pool.ref) filter (where rank <= 10)::double as hk from gold left join pool using (query_id, ref) group by query_id), n as (select query_id, count(*)::double as p, count(*) filter (where rank <= 10)::double as pk from pool group by query_id)
select round(avg(h / g), 6) as raw_recall, round(avg(hk / g), 6) as kept_recall, round(avg(h / p), 6) as raw_precision, round(avg(hk / pk), 6) as kept_precision, count(*) filter (where hk = 0) as zero_f1 from s join n using (query_id)""",
    "n6_ridge": SCORED + ", x as (select score, (other + label)::double as y from scored), m as (select avg(score) as mx, avg(y) as my, count(*) as n, covar_pop(score, y) * count(*) / (var_pop(score) * count(*) + 2.0) as slope from x) select round(slope, 5) as slope, round(my - slope * mx, 5) as intercept from m",
}
