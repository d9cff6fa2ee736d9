"""The driver tables seen as the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order = ruling, part brand = law, part size = article; an open line is an official citation."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("law"), F.col("p_size").alias("article_number"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ruling_id"), F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_linestatus") == "O", "official").otherwise("text").alias("source"))
    return line.join(part, "p_partkey").drop("p_partkey")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last part of each brand and size gives the domain."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("law"), F.col("p_size").alias("article_number")).agg(F.max_by("p_type", "p_partkey").alias("domain"))


def ruling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pair = lambda c, v: F.struct(F.lit(c).alias("category"), F.col(v).alias("value"))
    return orders.select(F.col("o_orderkey").alias("ruling_id"), F.explode(F.array(pair("priority", "o_orderpriority"), pair("segment", "c_mktsegment"))).alias("f")).select("ruling_id", "f.*")


#: The same as SQL, to start a query with.
SQL = """
with cites as (select l_orderkey as ruling_id, p_brand as law, p_size as article_number, case when l_linestatus = 'O' then 'official' else 'text' end as source from lineitem join part on l_partkey = p_partkey),
edges as (select ruling_id, law, article_number, case when max(case when source = 'text' then 1 else 0 end) = 1 then 'text' else 'official' end as source from cites group by all),
articles as (select p_brand as law, p_size as article_number, arg_max(p_type, p_partkey) as domain from part group by all),
features as (
  select o_orderkey as ruling_id, 'priority' as category, o_orderpriority as value from orders join customer on o_custkey = c_custkey
  union all select o_orderkey, 'segment', c_mktsegment from orders join customer on o_custkey = c_custkey
),
grounded as (
  select category, value, law, article_number, count(*) filter (where source = 'official') as official_count, count(*) filter (where source = 'text') as text_count
  from features join edges using (ruling_id) join articles using (law, article_number) where domain not in ('SMALL') group by all
),
joint as (select category, value, law, article_number, count(distinct ruling_id) as n_joint from features join edges using (ruling_id) group by all),
nf as (select category, value, count(distinct ruling_id) as n_feature from features group by all),
na as (select law, article_number, count(distinct ruling_id) as n_article from edges group by all),
scored as (
  select *, case when n_joint < n then pmi / -ln(n_joint / n) end as npmi
  from (select *, ln(n_joint * n / (n_feature * n_article)) as pmi from grounded join joint using (category, value, law, article_number) join nf using (category, value) join na using (law, article_number), (select count(*)::double as n from orders))
)
"""
