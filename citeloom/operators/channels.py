"""The retrieval channels for many queries at once: exact features, their vector fallback, rulings, articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.terms import term_places, words_of
from citeloom.operators.vectors import cosine_top_k


def vocabulary_matches(queries: DataFrame, vocab: DataFrame, stop_terms: list[str] = ()) -> DataFrame:
    """query_id, category, canonical, position: vocabulary terms that occur in the query as whole token runs, in vocabulary order.

    queries: query_id (distinct), tokens; vocab: category, canonical, raw, ord. Over-generic canonicals are left out. Rows of
    the vocabulary that say the same meet a query once, and queries of the same tokens are matched once.
    """
    lists = queries.groupBy("tokens").agg(F.min("query_id").alias("list"))
    terms = vocab.groupBy(F.array_join(words_of("raw"), " ").alias("gram"), "category", "canonical").agg(F.min("ord").alias("ord"))
    if stop_terms:
        terms = terms.filter(~F.col("canonical").isin(list(stop_terms)))
    hit = term_places(lists, vocab.select("raw").distinct(), ["list"]).select("list", "gram").distinct().join(terms, "gram")
    first = hit.groupBy("list", "category", "canonical").agg(F.min("ord").alias("ord"))
    placed = first.withColumn("position", F.row_number().over(Window.partitionBy("list").orderBy("ord", "category", "canonical"))).drop("ord")
    return queries.join(lists, "tokens").select("query_id", "list").join(placed, "list").drop("list")


def feature_channel(matches: DataFrame, features: DataFrame, k: int) -> DataFrame:
    """query_id, rank, ruling_id, category, value, text, score 1: rulings with a matched feature, one row for each (ruling, value).

    Order: the match's position, then the ruling. features: ruling_id, category, value, quote.
    """
    one = features.groupBy("category", "value", "ruling_id").agg(F.min(F.struct("quote"))["quote"].alias("quote"))
    # A match gives k rows at most, and fewer than k of its rulings can have come by an earlier match of the same value.
    first = F.row_number().over(Window.partitionBy("category", "value").orderBy("ruling_id"))
    few = one.withColumn("r", first).filter(F.col("r") <= 2 * k).drop("r")
    few = few.withColumnRenamed("value", "canonical")
    # Behind a match of k rulings no later one of the query can give any of its k rows.
    sized = matches.join(few.groupBy("category", "canonical").agg(F.count(F.lit(1)).alias("n")), ["category", "canonical"])
    before = Window.partitionBy("query_id").orderBy("position").rangeBetween(Window.unboundedPreceding, -1)
    needed = sized.withColumn("most", F.coalesce(F.max("n").over(before), F.lit(0))).filter(F.col("most") < k).drop("n", "most")
    rows = needed.join(few, ["category", "canonical"])
    one = rows.groupBy("query_id", "ruling_id", F.col("canonical").alias("value")).agg(F.min(F.struct("position", "category", "quote")).alias("x"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("x.position", "ruling_id", "value"))
    out = one.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "ruling_id", F.col("x.category").alias("category"), "value", F.coalesce("x.quote", "value").alias("text"), F.lit(1.0).alias("score"))


def feature_fallback(queries: DataFrame, exact: DataFrame, nodes: DataFrame, features: DataFrame, k: int) -> DataFrame:
    """The feature channel by vector, for queries without an exact hit.

    nodes: id, category, value, embedding. The k nearest nodes of each category expand to their rulings; one row for
    each (ruling, value), the best score first.
    """
    bare = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    near = cosine_top_k(nodes.select("id", "embedding", "category"), bare.select("query_id", "embedding"), k, ["category"])
    rows = near.join(nodes.select("id", "value"), "id").join(features.select("ruling_id", "category", "value", "quote"), ["category", "value"])
    best = rows.groupBy("query_id", "ruling_id", "value").agg(F.max(F.struct(F.round("score", 9).alias("score"), "category", "quote")).alias("x"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("x.score"), "ruling_id", "value"))
    out = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "ruling_id", F.col("x.category").alias("category"), "value", F.coalesce("x.quote", "value").alias("text"), F.col("x.score").alias("score"))


def ruling_channel(queries: DataFrame, units: DataFrame, cited: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, ruling_id, text, score, refs: the k nearest summaries or sections with what their rulings cite.

    units: id, ruling_id, text, embedding; cited: ruling_id, refs.
    """
    near = cosine_top_k(units.select("id", "embedding"), queries.select("query_id", "embedding"), k)
    out = near.join(units.select("id", "ruling_id", "text"), "id").join(cited, "ruling_id", "left")
    return out.select("query_id", "rank", "id", "ruling_id", "text", "score", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))


def article_channel(queries: DataFrame, articles: DataFrame, contained: DataFrame, k: int) -> DataFrame:
    """The k nearest articles, then only those inside a law: fewer than k may stay. articles: id, embedding; contained: id."""
    near = cosine_top_k(articles.select("id", "embedding"), queries.select("query_id", "embedding"), k)
    return near.join(contained.select("id").distinct(), "id", "left_semi")


def gated(queries: DataFrame, channel: str, channels: str = "channels") -> DataFrame:
    """Queries that ask for the channel."""
    return queries.filter(F.array_contains(channels, channel))
