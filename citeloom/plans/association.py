"""Queries of the citation and association operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import grounding as G
from citeloom.plans.tables import SQL, articles, cites, ruling_features, table

PROCEDURAL = ["SMALL"]


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.citation_edges(cites(spark, sf))


def _grounded(spark: SparkSession, sf: str) -> DataFrame:
    return G.cooccurrence(ruling_features(spark, sf), _edges(spark, sf), articles(spark, sf), PROCEDURAL)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return G.pmi(ruling_features(spark, sf), _edges(spark, sf), _grounded(spark, sf), n)


def _round(df: DataFrame) -> DataFrame:
    return df.withColumns({"pmi": F.round("pmi", 6), "npmi": F.round("npmi", 6)}).select("category", "value", "law", "article_number", "official_count", "text_count", "n_joint", "pmi", "npmi")


def support(spark: SparkSession, sf: str) -> DataFrame:
    """A user is a query: its events name parts, whose articles and a hashed priority and segment it retrieves."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), "event_id")
    queries = events.select("query_id").distinct()
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("law"), F.col("p_size").alias("article_number"))
    found = events.filter("event_id % 5 < 2").join(part, F.col("event_id") % 200 == F.col("p_partkey")).select("query_id", "law", "article_number")
    orders = table(spark, sf, "orders").select("o_orderkey", F.lit("priority").alias("category"), F.col("o_orderpriority").alias("value"))
    feats = events.filter("event_id % 3 = 0").join(orders, F.col("event_id") % 50 == F.col("o_orderkey")).select("query_id", "category", "value")
    return G.graph_support(queries, feats, found, scored(spark, sf)).withColumn("support", F.round("support", 6))


QUERIES = {
    "d3_citation_edges": _edges,
    "d4_source_counts": lambda s, d: G.source_counts(_edges(s, d)),
    "i1_cooccurrence": lambda s, d: _grounded(s, d).drop("n_joint"),
    "i2_pmi": lambda s, d: _round(scored(s, d)),
    "i3_top_count": lambda s, d: G.top_by_count(_grounded(s, d).drop("n_joint")),
    "i3_top_npmi": lambda s, d: _round(G.top_by_npmi(scored(s, d))),
    "i4_top_features": lambda s, d: G.top_features(scored(s, d), articles(s, d).filter("domain = 'LARGE'")).select("law", "article_number", "rank", "category", "value", F.round("npmi", 6).alias("npmi")),
    "i5_graph_support": support,
}
_COLS = "category, value, law, article_number, official_count, text_count, n_joint, round(pmi, 6) as pmi, round(npmi, 6) as npmi"
ORACLE = {
    "d3_citation_edges": SQL + "select * from edges",
    "d4_source_counts": SQL + "select source, count(*) as n from edges group by source",
    "i1_cooccurrence": SQL + "select * from grounded",
    "i2_pmi": SQL + f"select {_COLS} from scored",
    "i3_top_count": SQL + "select *, official_count + text_count as total from grounded order by total desc, category, value, law, article_number limit 15",
    "i3_top_npmi": SQL + f"select {_COLS} from scored where official_count + text_count >= 3 and npmi is not null order by round(scored.npmi, 9) desc, category, value, law, article_number limit 15",
    "i4_top_features": SQL + """select law, article_number, rank, category, value, round(npmi, 6) as npmi from (
  select *, row_number() over (partition by law, article_number order by round(npmi, 9) desc, category, value)::int as rank
  from scored semi join (select * from articles where domain = 'LARGE') w using (law, article_number) where official_count + text_count >= 3 and npmi is not null) where rank <= 10""",
    "i5_graph_support": SQL + """, e as (select user_id as query_id, event_id from events), q as (select distinct query_id from e),
a as (select distinct query_id, p_brand as law, p_size as article_number from e join part on event_id % 200 = p_partkey where event_id % 5 < 2),
f as (select distinct query_id, 'priority' as category, o_orderpriority as value from e join orders on event_id % 50 = o_orderkey where event_id % 3 = 0),
m as (select query_id, avg(npmi) as mean from f join (select * from scored where official_count + text_count >= 3 and npmi is not null) using (category, value) join a using (query_id, law, article_number) group by query_id)
select q.query_id, case when q.query_id in (select query_id from a) and q.query_id in (select query_id from f) then round(greatest(0.0, coalesce(mean, 0.0)), 6) end as support from q left join m using (query_id)""",
}
