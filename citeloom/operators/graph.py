"""The graph as keyed tables: upserts, edges, stubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(rows: DataFrame, keys: list[str], order: str, old: DataFrame | None = None) -> DataFrame:
    """The last row of each key by `order`; rows of an old table stand where no new row has their key."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    new = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")
    return new if old is None else new.unionByName(old.select(*new.columns).join(new.select(*keys), keys, "left_anti"))


def reference_edges(articles: DataFrame) -> DataFrame:
    """law, src_number, dst_number of references to existing articles of the same law. articles: law, article_number, references."""
    edges = articles.select("law", F.col("article_number").alias("src_number"), F.explode("references").alias("dst_number"))
    return edges.join(articles.select("law", F.col("article_number").alias("dst_number")), ["law", "dst_number"], "left_semi").select("law", "src_number", "dst_number").distinct()


def stub_articles(cites: DataFrame, articles: DataFrame) -> DataFrame:
    """Cited articles that no statute has, with null content and domain."""
    keys = ["law", "article_number"]
    return cites.select(*keys).distinct().join(articles.select(*keys), keys, "left_anti").withColumns({"content": F.lit(None).cast("string"), "domain": F.lit(None).cast("string")})


def related_edges(rulings: DataFrame) -> DataFrame:
    """src_id, dst_id without self loops. rulings: ruling_id, related_ruling_ids."""
    return rulings.select(F.col("ruling_id").alias("src_id"), F.explode("related_ruling_ids").alias("dst_id")).filter("src_id != dst_id").distinct()


def stub_rulings(edges: DataFrame, rulings: DataFrame) -> DataFrame:
    return edges.select(F.col("dst_id").alias("ruling_id")).distinct().join(rulings.select("ruling_id"), "ruling_id", "left_anti")


def sections(rulings: DataFrame) -> DataFrame:
    """One row a section, numbered from 0. rulings: ruling_id, sections."""
    return rulings.select("ruling_id", F.posexplode("sections").alias("section_no", "s")).select("ruling_id", "section_no", "s.*")


def extra_values(articles: DataFrame, core: DataFrame, column: str = "law") -> DataFrame:
    return articles.select(column).distinct().join(core.select(column), column, "left_anti")


def existing(refs: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """refs with exists."""
    return refs.join(nodes.select(*keys).distinct().withColumn("exists", F.lit(True)), keys, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def missing_from(rows: DataFrame, target: DataFrame, keys: list[str], same: list[str] = (), at_least: str | None = None) -> DataFrame:
    """Rows that the target does not hold completely: by key, equal columns `same`, and a count at least as large."""
    t = target.select(*(F.col(c).alias(f"__{c}") for c in (*keys, *same, *([at_least] if at_least else []))))
    match = [F.col(c) == F.col(f"__{c}") for c in keys] + [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same]
    if at_least:
        match.append(F.col(f"__{at_least}") >= F.col(at_least))
    return rows.join(t, match, "left_anti")


def load_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status", "case_type").agg(F.count(F.lit(1)).alias("n"))
