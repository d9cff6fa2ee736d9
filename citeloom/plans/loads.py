"""Queries of the sources and sinks: tables are written to the shared folder as the files that are read, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import features as FE
from citeloom.operators import graph as GR
from citeloom.plans.tables import table
from citeloom.sources import records as S
from citeloom.sources.keyed import KeyedTable


def _rulings(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An order is a record with its lines as sections; every fiftieth has no id."""
    line = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))), lambda x: F.struct(x["l_returnflag"].alias("court_level"), x["l_linestatus"].alias("text"))).alias("sections"))
    rows = table(s, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    out = rows.select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey").cast("string")).alias("ruling_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("case_type"), "sections")
    path = S.shared_folder(s, "records")
    S.write_records(out, path)
    return S.read_records(s, path)


def _sections(s: SparkSession, d: str) -> DataFrame:
    return GR.sections(_rulings(s, d)[0].filter("sections is not null")).select("ruling_id", "section_no", "court_level", "text")


def _features(s: SparkSession, d: str) -> DataFrame:
    """The parts of an order are its roles, and those of many units its facts."""
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_quantity") > 40, "fact").otherwise("role")
    item = F.struct(kind.alias("category"), F.col("p_name").alias("value"), F.struct(F.when(F.col("l_linenumber") > 1, F.col("p_brand")).alias("quote"), F.col("l_linenumber").alias("start_char"), (F.col("l_linenumber") + 5).alias("end_char"), (F.col("l_linenumber") / 10.0).alias("confidence")).alias("evidence"))
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("item"))))
    of = lambda k: F.filter(F.transform("items", lambda x: x["item"]), lambda i: i["category"] == k)
    per = rows.groupBy(F.col("l_orderkey").cast("string").alias("ruling_id")).agg(ordered.alias("items"))
    path = S.shared_folder(s, "features")
    S.write_records(per.select("ruling_id", of("role").alias("roles"), of("fact").alias("facts")), path)
    return S.flattened_features(S.read_records(s, path, S.FEATURES)[0])


FEATURES = """with x as (select l_orderkey, l_linenumber, l_partkey, case when l_quantity > 40 then 'fact' else 'role' end as category, p_name as value, case when l_linenumber > 1 then p_brand end as quote, l_linenumber as start_char, l_linenumber + 5 as end_char, l_linenumber / 10.0::double as confidence from lineitem join part on l_partkey = p_partkey),
features as (select l_orderkey::varchar as ruling_id, category, (row_number() over (partition by l_orderkey, category order by l_linenumber, l_partkey) - 1)::int as pos, value, quote, start_char::int as start_char, end_char::int as end_char, confidence from x)
"""


def _page_files(s: SparkSession, d: str) -> DataFrame:
    """Pages written as one file each and read back; every tenth file is of no bytes but for its end of line.

    Making a file costs more than its bytes, so few large splits are dealt to many tasks. A task has a folder of its own, so the driver commits folders and not files one after another; its files' names differ.
    """
    path = S.shared_folder(s, "pages")
    pages = table(s, d, "pages").repartition(int(s.conf.get("spark.sql.shuffle.partitions")))
    pages.select(F.when(F.col("page_id") % 10 != 0, F.col("html")).otherwise("").alias("value"), F.spark_partition_id().alias("folder")).write.option("maxRecordsPerFile", 1).partitionBy("folder").text(path)
    back = S.read_pages(s, path).withColumn("html", F.regexp_replace("html", "\n$", ""))
    return back.filter("html != '' and page_id != ''").groupBy("html").agg(F.count_distinct("page_id").alias("n"))


def _reviewed(s: SparkSession, d: str) -> DataFrame:
    path = S.shared_folder(s, "reviewed")
    p = table(s, d, "part").select(F.col("p_name").alias("term"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("alias:"), "p_brand")).when(F.col("p_partkey") % 3 == 1, F.col("p_type")).alias("decision"))
    S.write_table(p, path, kind="csv")
    return S.read_reviewed(s, path).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("terms"))


def _written(s: SparkSession, d: str) -> DataFrame:
    """Articles by law in three formats, each read back."""
    rows, out = table(s, d, "part").select(F.col("p_brand").alias("law"), F.col("p_size").alias("article_number"), "p_name"), None
    for kind in ("parquet", "csv", "json"):
        path = S.shared_folder(s, "articles")
        S.write_table(rows, path, ["law"], kind)
        back = s.read.option("header", True).format(kind).load(path)
        part = back.groupBy("law").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("article_number").cast("long")).alias("total")).select(F.lit(kind).alias("kind"), "law", "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


def _stored(s: SparkSession, d: str) -> DataFrame:
    """The last order of each customer, loaded in two steps: a customer's odd orders come later and stand for the even ones."""
    rows = table(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("last_order"), "o_orderpriority", "o_totalprice")
    held = KeyedTable(s, S.shared_folder(s, "customers"), ["o_custkey"])
    held.load(rows.filter("o_orderkey % 2 = 0"), "o_orderkey")
    held.load(rows.filter("o_orderkey % 2 = 1"), "o_orderkey")
    return held.read()


QUERIES = {
    "e1_stored": _stored,
    "a1_records": lambda s, d: _rulings(s, d)[0].select("ruling_id", "title", "case_type", F.coalesce(F.size("sections"), F.lit(0)).alias("n_sections")),
    "a1_errors": lambda s, d: _rulings(s, d)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    "a2_features": _features,
    "a3_pages": _page_files,
    "a4_reviewed": _reviewed,
    "a5_written": _written,
    "a7_load_report": lambda s, d: GR.load_report(table(s, d, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, "error").when(F.col("o_orderkey") % 7 < 3, "already there").otherwise("new").alias("status"), F.col("o_orderpriority").alias("case_type"))),
    "e6_sections": _sections,
    "f6_edges": lambda s, d: FE.feature_edges(_features(s, d)),
    "f8_confidences": lambda s, d: FE.confidence_histogram(_features(s, d)).withColumn("share", F.round("share", 6)),
    "f8_stats": lambda s, d: FE.extraction_stats(_features(s, d).withColumn("start_char", F.when(F.col("pos") != 1, F.col("start_char"))), ["red widget", "small bolt"]).withColumn("unlocated", F.round("unlocated", 6)),
}
_SECTIONS = "sections as (select o_orderkey, l_returnflag, l_linestatus, (row_number() over (partition by o_orderkey order by l_linenumber, l_returnflag, l_linestatus) - 1)::int as section_no from orders join lineitem on o_orderkey = l_orderkey where o_orderkey % 50 <> 0)"
ORACLE = {
    "e1_stored": "select o_custkey, max(o_orderkey) as last_order, arg_max(o_orderpriority, o_orderkey) as o_orderpriority, arg_max(o_totalprice, o_orderkey) as o_totalprice from (select *, max(o_orderkey % 2) over (partition by o_custkey) as odd from orders) where o_orderkey % 2 = odd group by o_custkey",
    "a1_records": "select o_orderkey::varchar as ruling_id, o_orderpriority as title, o_orderstatus as case_type, coalesce(n, 0)::int as n_sections from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on o_orderkey = l_orderkey where o_orderkey % 50 <> 0",
    "a1_errors": "select 'no key' as reason, count(*) as n from orders where o_orderkey % 50 = 0 having count(*) > 0",
    "a2_features": FEATURES + "select * from features",
    "a3_pages": "select html, count(*) as n from pages where page_id % 10 <> 0 group by html",
    "a4_reviewed": "select case when p_partkey % 3 = 0 then 'alias:' || p_brand when p_partkey % 3 = 1 then p_type end as decision, count(*) as n, count(distinct p_name) as terms from part group by 1",
    "a5_written": "select kind, p_brand as law, count(*) as n, sum(p_size)::bigint as total from part, (select unnest(['parquet', 'csv', 'json']) as kind) group by 1, 2",
    "a7_load_report": "select case when o_orderkey % 7 = 0 then 'error' when o_orderkey % 7 < 3 then 'already there' else 'new' end as status, o_orderpriority as case_type, count(*) as n from orders group by 1, 2",
    "e6_sections": f"with {_SECTIONS} select o_orderkey::varchar as ruling_id, section_no, l_returnflag as court_level, l_linestatus as text from sections",
    "f6_edges": FEATURES + "select ruling_id, case when category = 'fact' then 'fact:' || ruling_id || ':' || pos else category || ':' || value end as node, category, value, quote, start_char, end_char, confidence from features",
    "f8_confidences": FEATURES + "select confidence, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from features group by confidence",
    "f8_stats": FEATURES + """select n, round(unlocated, 6) as unlocated, low, middle, high, n_rulings, n_lacking from (select count(*) as n, avg((pos = 1)::int) as unlocated, count(*) filter (where confidence < 0.5) as low, count(*) filter (where confidence >= 0.5 and confidence < 0.8) as middle, count(*) filter (where confidence >= 0.8) as high from features),
(select count(*) as n_rulings, count(*) filter (where has = 0) as n_lacking from (select ruling_id, max((category = 'role' and value in ('red widget', 'small bolt'))::int) as has from features group by 1))""",
}
