"""Queries of the page and citation operators over raw pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import citations as CI
from citeloom.operators import pages as PG
from citeloom.operators import rulings as RU
from citeloom.plans.tables import table

WORDS = PG.StatuteWords(article="(?U)^[A-M]\\w*?(\\d*)\\b", note="(?U)^[N-Z]\\w*?(\\d*)\\b", reference="(\\d+)", amended="the", abolished="of", interpreted="and")
LAWS = {"law of the": "law of the", "the ere": "law of the"}
LATIN = CI.Grammar(law="law", article="article", articles="articles", note="note", of="of", joins=("and", ","), letters="a-z", said=("said", "above"), that=("that", "same"))


def _cited_docs(s: SparkSession, d: str) -> DataFrame:
    """Documents whose line items write citations: each part of an order as an article of one of three laws."""
    line = table(s, d, "lineitem")
    law = F.when(F.col("l_suppkey") % 3 == 0, "law of the").when(F.col("l_suppkey") % 3 == 1, "said law above").otherwise("law")
    part = F.concat(F.lit("note 2 of article "), (F.col("l_partkey") % 99).cast("string"), F.lit(" "), law)
    return line.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", part.alias("p")))), lambda x: x["p"]), ". ").alias("text"))


def _box(s: SparkSession, d: str) -> DataFrame:
    number = F.concat(F.lit("ماده "), (F.col("l_partkey") % 99).cast("string"))
    k = F.col("l_partkey") % 3
    part = F.concat(F.when(k == 0, F.concat(F.lit("تبصره 4 از "), number)).when(k == 1, F.concat(number, F.lit(" ماده 7"))).otherwise(number), F.lit(" قانون "), F.col("l_suppkey").cast("string"))
    box = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", part.alias("p")))), lambda x: x["p"]), "-")
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("ruling_id")).agg(box.alias("box"))
    x = rows.select("ruling_id", F.explode(CI.official_citations(F.col("box"))).alias("x"))
    return x.select("ruling_id", "x.article_number", "x.law_name", "x.note_number")


def _ruling_pages(s: SparkSession, d: str) -> DataFrame:
    """An order as a ruling page of the court's site."""
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    summary = F.when(k % 3 != 0, text("<span><b>پیام</b>: about ", F.col("o_orderstatus"), "</span>")).otherwise(F.lit(""))
    box = text('<td class="font-size-small">شماره دادنامه قطعی : ', k, "<br>تاریخ دادنامه قطعی : 1393/0", k % 9 + 1, "<br>گروه رأی : ", F.when(k % 2 == 0, "حقوقی").otherwise("کیفری"), "</td>")
    rest = text("<span><b>مستندات:</b> ماده ", k % 50, ' قانون مدنی-</span><select id="Judge_ID"><option value="">-</option><option value="', k % 7, '">a</option><option value="', k % 11, '">b</option></select></div>')
    cites = F.when(k % 4 == 0, F.lit("ماده ۵ قانون تجارت")).otherwise(F.lit("متن"))
    body = text('<div id="treeText"><h1>بدوی</h1>', cites, "<br>x<h1>تجدیدنظر</h1>y<div>z</div></div>")
    return o.select(k.alias("page_id"), text('<div class="container"><h1 class="Title3D">عنوان : ', F.col("o_orderpriority"), "</h1>", summary, box, rest, body).alias("html"))


def _assembled(s: SparkSession, d: str) -> DataFrame:
    r = RU.parsed_rulings(_ruling_pages(s, d))
    first = lambda c: F.try_element_at(c, F.lit(1))["article_number"]
    return r.select("ruling_id", first(F.col("cited_articles")).alias("official"), first(F.col("text_cited_articles")).alias("in_text"), F.size("sections").alias("n_sections"))


#: The texts between the tags of paragraphs and headings, in order; a word of A to M opens an article, one of N to Z a note.
_SEGMENTED = r"""with e as (select page_id, unnest(l) as raw, unnest(range(len(l))) as pos from (select page_id, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(p|h1)>') as l from pages)),
t as (select page_id, pos, replace(replace(replace(replace(replace(array_to_string(list_filter(list_transform(string_split_regex(raw, '<[^>]*>'), lambda x: trim(x)), lambda x: x <> ''), ' '), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as text from e),
k as (select *, regexp_matches(text, '^[A-M]')::int as a, regexp_matches(text, '^[N-Z]')::int as n from t where text <> ''),
s as (select *, sum(a) over (partition by page_id order by pos) as article_seq from k), u as (select *, sum(n) over (partition by page_id, article_seq order by pos) as note_seq from s where article_seq > 0),
g as (select page_id, article_seq, note_seq, arg_min(text, pos) as head, string_agg(text, ' ' order by pos) as content from u group by all)
select page_id, article_seq::bigint as article_seq, note_seq::bigint as note_seq, 1 as number, content, case when contains(head, 'the') then 'amended' when contains(head, 'of') then 'abolished' when contains(head, 'and') then 'interpreted' else 'active' end as status,
case when note_seq = 0 then array_to_string(list_filter(list_transform(regexp_extract_all(head, '[0-9]+'), lambda x: try_cast(x as int)), lambda x: x <> 1), ',') else '' end as "references" from g"""
#: The same with a number behind the first word of each paragraph.
_NUMBERED = (
    _SEGMENTED.replace("from pages)", r"from (select page_id, regexp_replace(html, '<p>([A-Z]\pL*)', '<p>\1' || (page_id % 7 + 2), 'g') as html from pages))")
    .replace("1 as number", r"number").replace("x <> 1", "x <> number").replace("from g", r"from (select *, coalesce(try_cast(regexp_extract(head, '^[A-Z]\pL*([0-9]*)', 1) as int), 1) as number from g)")
)


def _numbered(s: SparkSession, d: str) -> DataFrame:
    html = F.regexp_replace(F.col("html"), F.lit("<p>([A-Z]\\pL*)"), F.concat(F.lit("<p>$1"), (F.col("page_id") % 7 + 2).cast("string")))
    found = PG.segmented(PG.elements(table(s, d, "pages").withColumn("html", html), ["p", "h1"]), WORDS)
    return found.withColumn("references", F.array_join(F.col("references").cast("array<string>"), ","))


QUERIES = {
    "c1_elements": lambda s, d: PG.elements(table(s, d, "pages"), ["p", "h1", "a"]),
    "c2_segmented": lambda s, d: PG.segmented(PG.elements(table(s, d, "pages"), ["p", "h1"]), WORDS).withColumn("references", F.array_join(F.col("references").cast("array<string>"), ",")),
    "c3_numbered": _numbered,
    "c6_boxes": lambda s, d: PG.ruling_boxes(_ruling_pages(s, d)).withColumn("related_ruling_ids", F.array_join("related_ruling_ids", ",")),
    "c8_rulings": _assembled,
    "c5_references": lambda s, d: table(s, d, "pages").select("page_id", F.explode(PG.references_in(F.col("url"), F.lit(2), PG.StatuteWords(reference="(\\d+)"))).alias("n")).groupBy("page_id", "n").agg(F.count(F.lit(1)).alias("times")),
    "c7_sections": lambda s, d: PG.ruling_sections(table(s, d, "pages"), "h1", "footer"),
    "c9_link_ids": lambda s, d: PG.link_ids(table(s, d, "pages"), '/([^"/?#]+)[^"]*'),
    "c10_page_health": lambda s, d: PG.page_health(PG.elements(table(s, d, "pages"), ["title", "p", "div", "a"])).withColumn("classes", F.array_join("classes", ",")),
    "d1_official": _box,
    "d2_free_text": lambda s, d: CI.free_text_citations(_cited_docs(s, d), laws=LAWS, grammar=LATIN, clean=False).select("doc_id", F.explode("text_cited_articles").alias("x")).select("doc_id", "x.*"),
}
ORACLE = {
    "c5_references": "select page_id, n::int as n, count(*) as times from (select page_id, unnest(regexp_extract_all(url, '[0-9]+')) as n from pages) where n::int <> 2 group by page_id, n::int",
    "c9_link_ids": """select page_id, id, row_number() over (partition by page_id order by pos_at)::int as position from (select page_id, id, min(i) as pos_at from (select page_id, unnest(m) as id, unnest(range(len(m))) as i from (select page_id, regexp_extract_all(html, 'href="/([^"/?#]+)[^"]*"', 1) as m from pages)) group by page_id, id)""",
    "c2_segmented": _SEGMENTED,
    "c3_numbered": _NUMBERED,
    "c6_boxes": """select o_orderkey as page_id, o_orderpriority as title, case when o_orderkey % 3 <> 0 then 'about ' || o_orderstatus else '' end as legal_factual_summary, o_orderkey::varchar as verdict_number, '1393/0' || (o_orderkey % 9 + 1) as verdict_date, case when o_orderkey % 2 = 0 then 'حقوقی' else 'کیفری' end as case_type,
'ماده ' || (o_orderkey % 50) || ' قانون مدنی-' as cited, (o_orderkey % 7) || ',' || (o_orderkey % 11) as related_ruling_ids from orders""",
    "c7_sections": """select page_id, 1 as section_no, replace(replace(replace(replace(replace(trim(regexp_replace(h, '<[^>]*>', '', 'g')), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as court_level, replace(replace(replace(replace(replace(array_to_string(list_filter(list_transform(string_split_regex(b, '<[^>]*>'), lambda x: trim(x, chr(32) || chr(10) || chr(9) || chr(13))), lambda x: x <> ''), ' '), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as text
from (select page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) as h, regexp_extract(html, '(?s)</h1>(.*?)</article>', 1) as b from pages) where h <> ''""",
    "c8_rulings": """select o_orderkey::varchar as ruling_id, o_orderkey % 50 as official, case when o_orderkey % 4 = 0 then 5 end::int as in_text, 2 as n_sections from orders""",
    "d1_official": """with x as (select l_orderkey as ruling_id, (l_partkey % 99)::int as n, 'قانون ' || l_suppkey as law_name, l_partkey % 3 as k from lineitem)
select ruling_id, n as article_number, law_name, case when k = 0 then 4 end::int as note_number from x union all select ruling_id, 7, law_name, null from x where k = 1""",
    "d2_free_text": """with l as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, case l_suppkey % 3 when 0 then 'law of the' when 1 then 'said law above' else 'law' end) as i, l_partkey % 99 as n, l_suppkey % 3 as k from lineitem),
m as (select *, max((k = 0)::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as seen from l), o as (select *, k = 0 or k = 1 and coalesce(seen, 0) = 1 as own from m),
p as (select *, coalesce(lag(own) over (partition by doc_id order by i), false) as before from o)
select doc_id, n::int as article_number, 'law of the' as law_name, 2 as note_number from p where own or before""",
}
