"""Citation edges and feature-article association.

cites: ruling_id, law, article_number, source ('official' or 'text'); features: ruling_id, category, value;
articles: law, article_number, domain. All functions are lazy DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ARTICLE = ["law", "article_number"]
FEATURE = ["category", "value"]


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt by the keys to as many tasks as there are shuffle partitions.

    Rows of keys shrink so much in a shuffle that tasks joined by its bytes would hold many groups in several hash maps.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def citation_edges(cites: DataFrame, policy: str = "last") -> DataFrame:
    """One edge for each (ruling, law, article). policy "last": source `text` replaces `official`; "both": an edge for each source."""
    if policy == "both":
        return cites.select("ruling_id", *ARTICLE, "source").distinct()
    text = F.max((F.col("source") == "text").cast("int")) == 1
    return _dealt(cites.select("ruling_id", *ARTICLE, "source"), ["ruling_id", *ARTICLE]).groupBy("ruling_id", *ARTICLE).agg(F.when(text, "text").otherwise("official").alias("source"))


def source_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _mentions(features: DataFrame) -> DataFrame:
    """One row a ruling and feature; the same plan wherever it is used, so its shuffle is used again."""
    return _dealt(features.select("ruling_id", *FEATURE), ["ruling_id", *FEATURE]).groupBy("ruling_id", *FEATURE).agg(F.count(F.lit(1)).alias("m"))


#: Pairs of one ruling that a task joins.
CELL = 1 << 22


def celled(mentions: DataFrame, cited: DataFrame, most: int = CELL) -> tuple[DataFrame, DataFrame]:
    """Both sides with __row and __column: a ruling of more than `most` pairs of a feature and an article is a grid of cells of about `most` pairs.

    A mention has one row of the grid and is copied to its columns, an article one column and is copied to its rows, so
    each pair lies in one cell and no cell is much larger than the others.
    """
    side = math.isqrt(most)
    m = mentions.groupBy("ruling_id").agg(F.count(F.lit(1)).alias("__m"))
    n = cited.groupBy("ruling_id").agg(F.count(F.lit(1)).alias("__n"))
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / side)).cast("int")
    heavy = m.join(n, "ruling_id").filter(F.col("__m") * F.col("__n") > most).select("ruling_id", parts("__m").alias("__rows"), parts("__n").alias("__columns"))
    one = lambda c: F.coalesce(F.col(c), F.lit(1))

    def dealt(side: DataFrame, keys: list[str], own: str, count: str, other: str, others: str) -> DataFrame:
        rows = side.join(heavy, "ruling_id", "left").withColumn(own, F.pmod(F.xxhash64(*keys), one(count)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), one(others) - 1))).drop("__rows", "__columns")

    return dealt(mentions, FEATURE, "__row", "__rows", "__column", "__columns"), dealt(cited, ARTICLE, "__column", "__columns", "__row", "__rows")


def cooccurrence(features: DataFrame, edges: DataFrame, articles: DataFrame, procedural: list[str], most: int = CELL) -> DataFrame:
    """Paths between a feature and an article through a ruling, by the source of the citation, and the rulings that have both (n_joint).

    Both sides shrink to one row a ruling and feature or article before the join, so repeated mentions never multiply
    rows, and each joined row is one ruling of the pair; heavy rulings are joined cell by cell (celled()). Articles of
    procedural domains fall out, and so do those without a domain (a null is never outside a list).
    """
    mentions = _mentions(features)
    wanted = articles.filter(~F.col("domain").isin(procedural)).select(*ARTICLE)
    cited = edges.join(wanted, ARTICLE).groupBy("ruling_id", *ARTICLE).agg(
        F.sum((F.col("source") == "official").cast("long")).alias("o"), F.sum((F.col("source") == "text").cast("long")).alias("t")
    )
    left, right = celled(mentions, cited, most)
    paths = left.join(right, ["ruling_id", "__row", "__column"])
    return paths.groupBy(*FEATURE, *ARTICLE).agg(F.sum(F.col("m") * F.col("o")).alias("official_count"), F.sum(F.col("m") * F.col("t")).alias("text_count"), F.count(F.lit(1)).alias("n_joint"))


def pmi(features: DataFrame, edges: DataFrame, grounded: DataFrame, n_rulings: DataFrame) -> DataFrame:
    """grounded (of cooccurrence()) with n_feature, n_article, pmi and npmi, from distinct rulings.

    n_rulings has a column n, the number of all rulings, stubs included; its largest value counts. npmi is null where
    every ruling has the pair.
    """
    nf = _mentions(features).groupBy(*FEATURE).agg(F.count(F.lit(1)).alias("n_feature"))
    na = edges.select("ruling_id", *ARTICLE).distinct().groupBy(*ARTICLE).agg(F.count(F.lit(1)).alias("n_article"))
    n = n_rulings.agg(F.max("n").cast("double").alias("n"))  # one row
    out = grounded.join(nf, FEATURE).join(na, ARTICLE).crossJoin(F.broadcast(n))
    score = F.log(F.col("n_joint") * F.col("n") / (F.col("n_feature") * F.col("n_article")))
    return out.withColumn("pmi", score).withColumn("npmi", F.try_divide(F.col("pmi"), -F.log(F.col("n_joint") / F.col("n")))).drop("n")


def top_by_count(grounded: DataFrame, k: int = 15) -> DataFrame:
    total = F.col("official_count") + F.col("text_count")
    return grounded.withColumn("total", total).orderBy(F.desc("total"), *FEATURE, *ARTICLE).limit(k)


def top_by_npmi(scored: DataFrame, k: int = 15, least: int = 3, digits: int = 9) -> DataFrame:
    """The k highest npmi among edges of at least `least` paths; equal values (to `digits`) by name."""
    total = F.col("official_count") + F.col("text_count")
    return scored.withColumn("total", total).filter((F.col("total") >= least) & F.col("npmi").isNotNull()).orderBy(F.desc(F.round("npmi", digits)), *FEATURE, *ARTICLE).limit(k)


def top_features(scored: DataFrame, articles: DataFrame, k: int = 10, least: int = 3, digits: int = 9) -> DataFrame:
    """For each wanted article its k best grounded features, as rank (from 1) and as rows."""
    total = F.col("official_count") + F.col("text_count")
    good = scored.filter((total >= least) & F.col("npmi").isNotNull()).join(articles.select(*ARTICLE).distinct(), ARTICLE, "left_semi")
    rank = F.row_number().over(Window.partitionBy(*ARTICLE).orderBy(F.desc(F.round("npmi", digits)), *FEATURE))
    return good.withColumn("rank", rank).filter(F.col("rank") <= k)


def graph_support(queries: DataFrame, query_features: DataFrame, query_articles: DataFrame, scored: DataFrame, least: int = 3) -> DataFrame:
    """query_id and support: mean npmi over the query's feature-article pairs that have an edge, at least 0.

    Null if the query has no feature or no article; 0 if no pair has an edge. Pairs come from the edge table, never
    from a product of the two sides, and start at the articles: a generic feature has an edge to nearly every article.
    """
    f = query_features.select("query_id", *FEATURE).distinct()
    a = query_articles.select("query_id", *ARTICLE).distinct()
    edges = scored.filter((F.col("official_count") + F.col("text_count") >= least) & F.col("npmi").isNotNull())
    hit = a.join(edges.select(*FEATURE, *ARTICLE, "npmi"), ARTICLE).join(f, ["query_id", *FEATURE]).groupBy("query_id").agg(F.avg("npmi").alias("mean"))
    sides = f.select("query_id").distinct().join(a.select("query_id").distinct(), "query_id").withColumn("both", F.lit(True))
    out = queries.select("query_id").join(sides, "query_id", "left").join(hit, "query_id", "left")
    return out.select("query_id", F.when(F.col("both"), F.greatest(F.lit(0.0), F.coalesce("mean", F.lit(0.0)))).alias("support"))
