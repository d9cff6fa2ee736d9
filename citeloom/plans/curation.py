"""Queries of the text, vocabulary, feature and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import features as FE
from citeloom.operators import graph as GR
from citeloom.operators import vectors as V
from citeloom.operators import vocabulary as VO
from citeloom.plans.evaluation import r6
from citeloom.plans.tables import articles, cites, table

STOP = ["the", "of", "and", "to", "in"]
FOLD = lambda c: F.translate(F.lower(c), "e ", "a")  # noqa: E731  e becomes a, spaces go


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _chunks(s: SparkSession, d: str, cap: int | None = None) -> DataFrame:
    return _docs(s, d).select("doc_id", F.posexplode(X.chunks(F.col("text"), cap=cap)).alias("i", "c")).select("doc_id", "i", F.md5("c").alias("h"))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.tokens(F.lower(F.coalesce("text", F.lit(""))), "\\p{L}+").alias("tokens"))


def _vocab(s: SparkSession, d: str) -> DataFrame:
    """Part names as terms; the type is the category, and the brand's first name is the canonical of all its names."""
    p = table(s, d, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("raw"), F.col("p_partkey").alias("ord"), "p_brand")
    first = p.groupBy("category", "p_brand").agg(F.min_by("raw", "ord").alias("canonical"), F.min("ord").alias("o"))
    return p.join(first, ["category", "p_brand"]).select("category", "canonical", "raw", (F.col("ord") == F.col("o")).alias("is_canonical"), "ord")


VOCAB = """with p as (select p_type as category, p_name as raw, p_partkey as ord, p_brand from part),
vocab as (select p.category, canonical, raw, ord = o as is_canonical, ord from p join (select category, p_brand, arg_min(raw, ord) as canonical, min(ord) as o from p group by all) f on p.category = f.category and p.p_brand = f.p_brand)
"""
TOK = "with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') as w from documents),\n"
GRAMS = TOK + """g as (select doc_id, gram from (select doc_id, unnest(w) as gram from t) where length(gram) > 1 and gram not in ('the', 'of', 'and', 'to', 'in')
 union all select doc_id, a || ' ' || b from (select doc_id, unnest(w[1:len(w) - 1]) as a, unnest(w[2:]) as b from t where len(w) > 1) where length(a) > 1 and length(b) > 1 and not (a in ('the', 'of', 'and', 'to', 'in') and b in ('the', 'of', 'and', 'to', 'in'))),
counts as (select gram, count(*) as total, count(distinct doc_id) as n_docs from g group by gram)
"""


def _counts(s: SparkSession, d: str) -> DataFrame:
    return VO.gram_counts(_tokens(s, d), STOP)


def _terms(s: SparkSession, d: str) -> DataFrame:
    """Words of the benchmark as a vocabulary."""
    w = table(s, d, "benchmark").select(F.explode(X.tokens(F.lower("text"), "\\p{L}+")).alias("raw")).distinct()
    return w.filter(F.length("raw") % 2 == 0)


_TERMS = "terms as (select distinct raw from (select unnest(regexp_extract_all(lower(text), '\\p{L}+')) as raw from benchmark) where length(raw) % 2 = 0)"


def _rules(s: SparkSession, d: str) -> DataFrame:
    v = _vocab(s, d).select("category", "canonical").distinct()
    n = F.length("canonical") % 5
    action = F.when(n == 0, "remove").when(n == 1, "merge").when(n == 2, "remove_if_elsewhere")
    return v.select("category", action.alias("action"), F.col("canonical").alias("term"), F.when(n == 1, F.lit("merged")).alias("keep")).filter("action is not null")


def _upserts(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select((F.col("l_partkey") % 100).alias("law"), F.col("l_suppkey").alias("article_number"), "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("load_seq"), "l_extendedprice")
    return GR.upserted(rows.withColumn("o", F.struct("load_seq", "l_extendedprice", "l_quantity")).drop("load_seq"), ["law", "article_number"], "o")


def _refs(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").filter("o_orderkey % 3 != 0")
    return GR.reference_edges(o.select((F.col("o_custkey") % 10).alias("law"), F.col("o_orderkey").alias("article_number"), F.array(F.col("o_orderkey") + 10, F.col("o_orderkey") + 20, F.col("o_orderkey") + 10).alias("references")))


def _mean_vectors(s: SparkSession, d: str) -> DataFrame:
    m = V.mean_vectors(table(s, d, "embeddings").select("label", "embedding"), "label")
    return r6(m.select("label", F.posexplode("embedding").alias("i", "x")), "x")


def _extract(s: SparkSession, d: str) -> DataFrame:
    """The words of all documents as extracted values, every fourth without a quote."""
    return table(s, d, "documents").select(F.col("doc_id").alias("ruling_id"), F.posexplode(X.tokens(F.lower("text"), "\\p{L}+")).alias("pos", "value")).withColumns({"category": F.when(F.length("value") > 3, "role").otherwise("fact"), "quote": F.when(F.col("pos") % 4 != 0, F.col("value"))})


EXTRACT = """with x as (select doc_id as ruling_id, i - 1 as pos, w[i] as value, case when length(w[i]) > 3 then 'role' else 'fact' end as category, case when (i - 1) % 4 <> 0 then w[i] end as quote from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from (select doc_id, regexp_extract_all(lower(text), '\\p{L}+') as w from documents)))
"""
QUERIES = {
    "b1_digits": lambda s, d: _docs(s, d).select("doc_id", X.to_latin_digits(X.to_persian_digits(F.col("doc_id").cast("string"))).alias("latin"), X.to_persian_digits(F.col("doc_id").cast("string")).alias("persian")),
    "b3_clean": lambda s, d: _docs(s, d).select("doc_id", F.md5(X.clean_free_text(F.col("text"))).alias("h")),
    "b5_search_tokens": lambda s, d: _docs(s, d).select("doc_id", F.md5(F.array_join(X.search_tokens(F.concat(X.to_persian_digits(F.col("doc_id").cast("string")), F.lit(" قانون‌مدنی ماده 12 "), "text")), "|")).alias("h")),
    "b6_vocabulary_tokens": lambda s, d: _docs(s, d).select("doc_id", F.array_join(X.vocabulary_tokens(F.concat(X.to_persian_digits(F.col("doc_id").cast("string")), F.lit(" قانون‌مدنی و "), "text")), "|").alias("t")),
    "b5_tokens": lambda s, d: _docs(s, d).select("doc_id", F.size(X.tokens(F.lower("text"), "\\p{L}+", 2)).alias("n")),
    "b7_head_and_tail": lambda s, d: _docs(s, d).select("doc_id", F.md5(X.head_and_tail(F.col("text"), 1000)).alias("h")),
    "b8_truncated": lambda s, d: _docs(s, d).select("doc_id", F.md5(X.truncated(F.col("text"), 300)).alias("h")),
    "b9_chunks": lambda s, d: _chunks(s, d, 20_000),
    "b9_whole_chunks": lambda s, d: _chunks(s, d),
    "b12_refs": lambda s, d: cites(s, d).select("law", "article_number").distinct().withColumn("ref", X.article_ref(F.col("law"), F.col("article_number"))).withColumn("p", X.parsed_ref(F.col("ref"))).select("ref", F.col("p.law").alias("law"), F.col("p.article_number").alias("article_number")),
    "b15_value_in_quote": lambda s, d: table(s, d, "part").select("p_partkey", X.value_in_quote(F.col("p_name"), F.lit("small red widget")).alias("found")),
    "e1_upserted": _upserts,
    "e3_references": _refs,
    "e4_stubs": lambda s, d: GR.stub_articles(cites(s, d), articles(s, d).filter("domain != 'LARGE'")).select("law", "article_number"),
    "e7_extra_values": lambda s, d: GR.extra_values(table(s, d, "supplier").select(F.col("s_nationkey").alias("law")), table(s, d, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("law"))),
    "a6_missing": lambda s, d: GR.missing_from(table(s, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", (F.col("o_orderkey") % 3).alias("n")), table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linestatus").alias("o_orderstatus"), F.count(F.lit(1)).alias("n")), ["k"], ["o_orderstatus"], "n"),
    "f1_resolved": lambda s, d: FE.resolved(table(s, d, "part").select(F.col("p_type").alias("category"), F.concat_ws(" ", F.lit("old"), "p_name", F.lit("set")).alias("value"), "p_partkey"), _vocab(s, d), FOLD).select("p_partkey", "canonical"),
    "f2_index": lambda s, d: VO.index(_vocab(s, d), FOLD),
    "f4_cleaned": lambda s, d: FE.cleaned(_extract(s, d)),
    "f7_orphans": lambda s, d: FE.orphans(table(s, d, "customer").select(F.col("c_custkey").alias("ruling_id")), table(s, d, "orders").select(F.col("o_custkey").alias("ruling_id"))),
    "f8_top_values": lambda s, d: FE.top_values(_extract(s, d), "role"),
    "g1_merged": lambda s, d: VO.merged_terms(table(s, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("term"), F.col("p_name").alias("meaning"))),
    "g2_last_records": lambda s, d: VO.last_records(table(s, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("term"), F.col("p_type").alias("category"), F.col("p_brand").alias("root"))),
    "g3_conflicts": lambda s, d: VO.conflicts(table(s, d, "part").select(F.col("p_name").alias("term"), F.col("p_type").alias("category"), F.col("p_brand").alias("root"))),
    "g6_cross_category": lambda s, d: VO.cross_category(_vocab(s, d)),
    "g8_near_duplicates": lambda s, d: VO.near_duplicates(_vocab(s, d), FOLD(F.col("raw"))).withColumn("terms", F.array_join("terms", ",")),
    "g11_corrected": lambda s, d: VO.corrected(_vocab(s, d), _rules(s, d)),
    "g13_gram_counts": _counts,
    "g14_gap_candidates": lambda s, d: VO.gap_candidates(_counts(s, d), _terms(s, d), 20, lambda c: c).select("gram", "total", "n_docs"),
    "g16_coverage": lambda s, d: r6(VO.coverage(_counts(s, d), _terms(s, d), VO.gap_candidates(_counts(s, d), _terms(s, d), 20, lambda c: c), lambda c: c), "before", "after"),
    "h1_pending": lambda s, d: V.pending(table(s, d, "documents").withColumn("status", F.when(F.col("doc_id") % 5 == 0, "abolished").when(F.col("doc_id") % 5 == 1, "active")), table(s, d, "embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "text", "status").select("doc_id"),
    "h3_mean_vectors": _mean_vectors,
}
_FOLD = "translate(replace(lower({c}), ' ', ''), 'e', 'a')"
ORACLE = {
    "b1_digits": "select doc_id, doc_id::varchar as latin, translate(doc_id::varchar, '0123456789', '۰۱۲۳۴۵۶۷۸۹') as persian from documents",
    "b5_search_tokens": lambda s, d: _docs(s, d).select("doc_id", F.md5(F.array_join(X.search_tokens(F.concat(X.to_persian_digits(F.col("doc_id").cast("string")), F.lit(" قانون‌مدنی ماده 12 "), "text")), "|")).alias("h")),
    "b6_vocabulary_tokens": lambda s, d: _docs(s, d).select("doc_id", F.array_join(X.vocabulary_tokens(F.concat(X.to_persian_digits(F.col("doc_id").cast("string")), F.lit(" قانون‌مدنی و "), "text")), "|").alias("t")),
    "b3_clean": "select doc_id, md5(trim(regexp_replace(regexp_replace(translate(coalesce(text, ''), '۰۱۲۳۴۵۶۷۸۹', '0123456789'), '[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}\\x{FEFF}]', ' ', 'g'), '[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) as h from documents",
    "b5_search_tokens": "select doc_id, md5(array_to_string(regexp_extract_all(translate(doc_id::varchar, '0123456789', '۰۱۲۳۴۵۶۷۸۹') || ' قانون مدنی ماده 12 ' || coalesce(text, ''), '[\\x{0600}-\\x{06FF}]+|\\p{Nd}+'), '|')) as h from documents",
    "b6_vocabulary_tokens": "select doc_id, array_to_string(list_filter(regexp_extract_all(translate(doc_id::varchar, '0123456789', '۰۱۲۳۴۵۶۷۸۹') || ' قانون‌مدنی و ' || coalesce(text, ''), '[\\x{0600}-\\x{06FF}\\x{200C}]+'), lambda x: length(x) >= 2), '|') as t from documents",
    "b5_tokens": "select doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+'), lambda x: length(x) >= 2))::int as n from documents",
    "b7_head_and_tail": "select doc_id, md5(case when length(text) > 1000 then text[1:400] || chr(10) || '...' || chr(10) || right(text, 600) else text end) as h from documents",
    "b8_truncated": "select doc_id, md5(case when length(trim(text)) > 300 then rtrim(trim(text)[1:300]) || ' ...' else trim(text) end) as h from documents",
    "b9_chunks": "select doc_id, (o // 2800)::int as i, md5(t[o + 1:o + 3000]) as h from (select doc_id, coalesce(text, '')[1:20000] as t from documents), range(0, 20000, 2800) as r(o) where o = 0 or length(t) > 3000 and o <= length(t) - 1",
    "b9_whole_chunks": "select doc_id, (o // 2800)::int as i, md5(t[o + 1:o + 3000]) as h from (select doc_id, t, unnest(range(0, greatest(length(t), 1), 2800)) as o from (select doc_id, coalesce(text, '') as t from documents)) where o = 0 or length(t) > 3000",
    "b12_refs": "select distinct p_brand || ' - ماده ' || translate(p_size::varchar, '0123456789', '۰۱۲۳۴۵۶۷۸۹') as ref, p_brand as law, p_size as article_number from part join lineitem on p_partkey = l_partkey",
    "b15_value_in_quote": "select p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: length(x) > 1 and contains('small red widget', x))) > 0 as found from part",
    "e1_upserted": "select law, article_number, l_quantity, l_extendedprice from (select *, row_number() over (partition by law, article_number order by o desc, l_extendedprice desc, l_quantity desc) as r from (select l_partkey % 100 as law, l_suppkey as article_number, l_quantity, l_extendedprice, l_orderkey * 10 + l_linenumber as o from lineitem)) where r = 1",
    "e3_references": "with a as (select o_custkey % 10 as law, o_orderkey as n from orders where o_orderkey % 3 <> 0) select distinct a.law, a.n as src_number, b.n as dst_number from a join a b on a.law = b.law and b.n in (a.n + 10, a.n + 20)",
    "e4_stubs": "with a as (select p_brand as law, p_size as article_number, arg_max(p_type, p_partkey) as domain from part group by all) select distinct p_brand as law, p_size as article_number from lineitem join part on l_partkey = p_partkey where (p_brand, p_size) not in (select (law, article_number) from a where domain <> 'LARGE')",
    "e7_extra_values": "select distinct s_nationkey as law from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey < 2)",
    "a6_missing": "select o_orderkey as k, o_orderstatus, o_orderkey % 3 as n from orders where not exists (select 1 from (select l_orderkey, min(l_linestatus) as s, count(*) as c from lineitem group by l_orderkey) where l_orderkey = o_orderkey and s = o_orderstatus and c >= o_orderkey % 3)",
    "f2_index": VOCAB + f"select category, key, canonical, ord from (select *, row_number() over (partition by category, key order by is_canonical desc, case when is_canonical then -ord else ord end) as r from (select *, {_FOLD.format(c='raw')} as key from vocab)) where r = 1",
    "f1_resolved": VOCAB + """, best as (select p_partkey, arg_min(canonical, (-n) * 1000000 + ord) as canonical from (select p_partkey, len(string_split(raw, ' ')) as n, canonical, ord from part join vocab on category = p_type and contains(' old ' || p_name || ' set ', ' ' || raw || ' ')) group by p_partkey)
select part.p_partkey, canonical from part left join best using (p_partkey)""",
    "f4_cleaned": EXTRACT + "select ruling_id, pos::int as pos, value, category, quote from (select *, row_number() over (partition by ruling_id, category, value order by pos) as r from x) where r = 1 and quote is not null",
    "f7_orphans": "select distinct c_custkey::varchar as ruling_id, false as matches_as_int from customer where c_custkey not in (select o_custkey from orders)",
    "f8_top_values": EXTRACT + "select value, count(*) as n from x where category = 'role' group by value order by n desc, value limit 15",
    "g1_merged": "select term, min(o) as ord, string_agg(meaning, ' ؛ ' order by o) as meaning from (select p_brand as term, p_name as meaning, min(p_partkey) as o from part group by all) group by term",
    "g2_last_records": "select p_name as term, arg_max(p_type, p_partkey) as category, arg_max(p_brand, p_partkey) as root from part group by p_name",
    "g3_conflicts": "select p_name as term, count(distinct p_type || '|' || p_brand) as n from part group by p_name having n > 1",
    "g6_cross_category": VOCAB + "select raw, count(distinct category) as n from vocab group by raw having n > 1",
    "g8_near_duplicates": VOCAB + f"select category, key, count(*) as n, string_agg(raw, ',' order by raw) as terms from (select distinct category, {_FOLD.format(c='raw')} as key, raw from vocab) group by category, key having n > 1",
    "g11_corrected": VOCAB + """, marked as (select *, length(canonical) % 5 as k, exists (select 1 from vocab w where w.raw = vocab.canonical and w.category <> vocab.category) as elsewhere from vocab)
select category, canonical, raw, bool_or(is_canonical) as is_canonical, min(ord) as ord from (select category, case when k = 1 then 'merged' else canonical end as canonical, raw, is_canonical and k <> 1 as is_canonical, ord from marked where k <> 0 and not (k = 2 and elsewhere)) group by category, canonical, raw""",
    "g13_gram_counts": GRAMS + "select * from counts",
    "g14_gap_candidates": GRAMS + f", {_TERMS} select gram, total, n_docs from counts where n_docs >= 20 and gram not in (select raw from terms)",
    "g16_coverage": GRAMS + f""", {_TERMS} select round(sum(total) filter (where gram in (select raw from terms)) / sum(total), 6) as before, round(sum(total) filter (where gram in (select raw from terms) or n_docs >= 20) / sum(total), 6) as after from counts where not contains(gram, ' ')""",
    "h1_pending": "select doc_id from documents where trim(text) <> '' and doc_id % 5 <> 0 and doc_id not in (select vec_id from embeddings where vec_id % 2 = 0)",
    "h3_mean_vectors": "select label, (i - 1)::int as i, round(avg(embedding[i]::double), 6) as x from embeddings, range(1, 65) as r(i) group by label, i",
}
