"""Whole ruling rows from raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import joined_sections
from citeloom.operators.citations import LAWS, Grammar, free_text_citations, official_citations
from citeloom.operators.pages import RulingWords, ruling_parts


def parsed_rulings(pages: DataFrame, words: RulingWords = RulingWords(), laws: dict[str, str] = LAWS, grammar: Grammar = Grammar(), root_id: str | None = "treeText", key: str = "page_id", html: str = "html") -> DataFrame:  # noqa: B008
    """Raw ruling pages (key, html, and a url if there is one) to ruling rows: boxes, sections in order, official and free-text citations, related ids.

    A page is parsed once and no row leaves its partition. Rulings without sections have an empty array. Free-text
    citations are read from all sections joined by a space.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = ruling_parts(pages.select(F.col(key).cast("string").alias("ruling_id"), url.alias("url"), F.col(html).alias("html")), words, root_id)
    rows = rows.withColumn("cited_articles", official_citations(F.col("cited"), laws, grammar)).withColumn("__text", joined_sections(F.col("sections"), " "))
    return free_text_citations(rows, "__text", laws, grammar).drop("__text", "cited")
