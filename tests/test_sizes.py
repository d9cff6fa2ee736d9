"""What one task or one shuffle holds does not grow with the tables; results stay as they were."""

import pyarrow as pa
from pyspark.sql import functions as F

from citeloom.operators import audit as A
from citeloom.operators import calibration as C
from citeloom.operators import features as FE
from citeloom.operators import grounding as G
from citeloom.operators import pivots as PV
from citeloom.operators import retrieval as R
from citeloom.operators import terms as T
from citeloom.operators import vocabulary as VO
from citeloom.plans import loads
from citeloom.sources import records as S


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_is_dealt_by_pairs(spark):
    """Small tables that meet many configs are not one task's: 400 rows, 30 configs and at most 1,000 pairs are 12 tasks."""
    rows = spark.range(400).selectExpr("id % 7 / 7.0d a", "id % 11 / 1.0d y", "id % 2 fold")
    configs = spark.range(30).selectExpr("id config_id", "id / 30.0d w")
    score = F.round(F.col("w") * F.col("a"), 6)
    small = C.grid_search(rows, configs, score, "y", most=1000)
    assert "RoundRobinPartitioning(12)" in plan(small)
    assert small.collect() == C.grid_search(rows, configs, score, "y").collect()


def test_fallback_in_one_pass(spark):
    """A query's rows are read once, by a stated number of tasks; a null verdict adds nothing."""
    rows = [(1, "a", False, True, 0.5), (1, "b", False, True, 0.9), (1, "c", True, True, 1.0), (1, "d", False, True, 0.1), (2, "a", None, True, 0.3), (3, "a", False, False, 0.3)]
    audited = spark.createDataFrame(rows, "query_id long, article_ref string, is_applicable boolean, topically_relevant boolean, confidence double")
    out = A.with_fallback(audited)
    said = plan(out)
    assert said.count("Scan ") == 1 and "REPARTITION_BY_NUM" in said
    want = [(q, a, False) for q, a, *_ in rows] + [(1, "a", True), (1, "b", True)]
    assert sorted((r.query_id, r.article_ref, r.added) for r in out.collect()) == sorted(want)


def test_groups_are_dealt_by_number(spark):
    """Mentions and citations are grouped by a stated number of tasks, and come to the same counts."""
    cites = spark.createDataFrame([(1, "x", 1, "official"), (1, "x", 1, "text"), (1, "x", 2, "official"), (2, "x", 1, "official")], "ruling_id long, law string, article_number int, source string")
    features = spark.createDataFrame([(1, "role", "v"), (1, "role", "v"), (2, "role", "v")], "ruling_id long, category string, value string")
    articles = spark.createDataFrame([("x", 1, "d"), ("x", 2, "d")], "law string, article_number int, domain string")
    out = G.cooccurrence(features, G.citation_edges(cites), articles, [])
    assert plan(out).count("REPARTITION_BY_NUM") >= 2
    assert {(r.article_number, r.official_count, r.text_count, r.n_joint) for r in out.collect()} == {(1, 1, 2, 2), (2, 2, 0, 1)}


def test_visits_are_not_broadcast(spark, tmp_path):
    """Packed visits meet the blocks by a shuffle, however small they look."""
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0], i % 2) for i in range(50)], "id long, embedding array<double>, label int")
    PV.write_pivots(rows, f"{tmp_path}/p", ["label"], 4)
    asked = rows.filter("id < 3").select(F.col("id").alias("query_id"), "embedding")
    table = PV.Table(spark, f"{tmp_path}/p")
    assert "Broadcast" not in plan(PV._scored(table, PV._visits(table, asked, 2, False), 2, 9, 16))
    assert PV.search(spark, f"{tmp_path}/p", asked, 2).count() == 12


def test_packed_queries_are_not_broadcast(spark):
    """The packed queries, once a part of the documents, meet the parts by a shuffle, however small they look."""
    postings = spark.createDataFrame([(i, t, 1.0 + i % 3) for i in range(40) for t in ("a", "b")[: 1 + i % 2]], "id long, term string, w double")
    asked = spark.sql("select * from values (1L, 'a', 1L), (2L, 'b', 2L) as t(query_id, term, times)")
    found = R.best_documents(postings, postings.select("id").distinct(), asked.select("query_id"), asked, 2, part_rows=8)
    said = plan(found)
    assert "SortMergeJoin" in said and "Broadcast" not in said
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in found.collect()) == [(1, 1, 2, 3.0), (1, 2, 5, 3.0), (2, 1, 5, 6.0), (2, 2, 11, 6.0)]


def test_grams_by_tokens(spark):
    """Parts of a batch are cut by tokens, not by documents, and give the same counts."""
    lists = [["a1", "b1"] * n for n in (5, 0, 3, 40, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], names=["tokens"])
    assert [p.num_rows for p, _, _ in T.token_slices(batch, 0, 20)] == [3, 1, 1]
    docs = spark.createDataFrame([(x,) for x in lists], "tokens array<string>").coalesce(1)
    assert sorted(VO.gram_counts(docs, [], 20).collect()) == sorted(VO.gram_counts(docs, []).collect())


def test_features_are_read_once(spark):
    """The five arrays and the statistics are one pass over the records; no records at all are none of each."""
    item = "struct(1 as x, 'v' as value, struct('q' as quote, 2 as start_char, 3 as end_char, 0.6d as confidence) as evidence)"
    none = "cast(null as array<struct<x:int,value:string,evidence:struct<quote:string,start_char:int,end_char:int,confidence:double>>>)"
    rows = spark.range(2).selectExpr("cast(id as string) ruling_id", f"array({item}, null) roles", f"array({item}) facts", *(f"{none} as {c}" for c in ("concepts", "actions", "objects")))
    flat = S.flattened_features(rows)
    stats = FE.extraction_stats(flat, ["v"])
    assert plan(stats).count("Range (") == 1
    assert sorted((r.ruling_id, r.category, r.pos, r.value or "") for r in flat.collect())[:3] == [("0", "fact", 0, "v"), ("0", "role", 0, "v"), ("0", "role", 1, "")]
    assert stats.collect() == [(6, 2 / 6, 0, 4, 0, 2, 0)]
    assert FE.extraction_stats(flat.filter("false"), ["v"]).collect() == [(0, None, None, None, None, 0, None)]


def test_cleaned_sorts_after_the_shuffle(spark):
    """Repeats in a batch go before the shuffle without a sort; nulls are values, and the smallest pos stays in any order of rows."""
    rows = [(1, 3, "a", "role", "late"), (1, 0, "a", "role", "first"), (1, 1, "a", "fact", None), (1, 2, "a", "fact", "after"), (None, 5, "b", None, "x"), (None, 4, "b", None, "y"), (2, 0, " ", "role", "blank"), (2, None, "c", "role", "null"), (2, 0, "c", "role", "z")]
    for order in (rows, rows[::-1]):
        for parts in (1, 4):
            out = FE.cleaned(spark.createDataFrame(order, "ruling_id long, pos int, value string, category string, quote string").repartition(parts))
            said = plan(out)
            assert said.index("MapInArrow") > said.rindex("Sort ") and out.columns == ["ruling_id", "pos", "value", "category", "quote"]
            assert {tuple(r) for r in out.collect()} == {(1, 0, "a", "role", "first"), (None, 4, "b", None, "y"), (2, None, "c", "role", "null")}


def test_pages_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """One split of pages is written by as many tasks as there are shuffle partitions, each to its own folder, and every page is read back."""
    spark.range(40).selectExpr("id page_id", "concat('page ', id % 4) html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(loads.S, "shared_folder", lambda s, name: f"{tmp_path}/{name}")
    got = {r.html: r.n for r in loads._page_files(spark, str(tmp_path)).collect()}
    assert got == {"page 0": 8, "page 1": 10, "page 2": 8, "page 3": 10}
    assert len(list(tmp_path.glob("pages/folder=*"))) == 4
