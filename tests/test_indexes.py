"""Stored indexes: pivot tables and posting blocks against brute force, and what they skip."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import pivots as PV
from citeloom.operators import postings as P
from citeloom.operators import retrieval as R
from citeloom.operators import vectors as V


def best(rows, queries, k, by=True):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    out = []
    for q, v in queries:
        for g in {r[2] if by else None for r in rows}:
            found = sorted((-round(float(unit(v) @ unit(e)), 9), i) for i, e, c in rows if not by or c == g)[:k]
            out += [(q, i, g, n + 1, round(-s, 4) + 0.0) for n, (s, i) in enumerate(found)]
    return sorted(out, key=str)


def clustered(n, dim=12, centers=40, seed=1):
    g = np.random.default_rng(seed)
    middle = g.normal(size=(centers, dim))
    return [(int(i), [float(x) for x in middle[i % centers] + 0.05 * g.normal(size=dim)], "ab"[i % 2] if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("k", [1, 7, 400])
def test_pivot_search(spark, tmp_path, k):
    """Clusters, ties, zero vectors and repeated ones; more wanted than a group has; groups with a null."""
    rows = clustered(600) + [(9000 + i, [0.0] * 12, "a") for i in range(3)] + [(9100 + i, [1.0] + [0.0] * 11, "b") for i in range(5)]
    df = spark.createDataFrame([*rows, (9999, None, "a")], "id long, embedding array<double>, g string").repartition(3)
    queries = [(int(i), rows[i][1]) for i in range(0, 600, 60)] + [(7000, [0.0] * 12), (7001, [-x for x in rows[0][1]])]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    PV.write_pivots(df, f"{tmp_path}/p", ["g"], n_pivots=50, block_rows=16)
    found = PV.search(spark, f"{tmp_path}/p", asked, k, query_rows=5)
    got = sorted(((r.query_id, r.id, r.g, r["rank"], round(r.score, 4) + 0.0) for r in found.collect()), key=str)
    assert got == best(rows, queries, k)


def test_pivot_search_skips_most_pairs(spark, tmp_path):
    """On clustered vectors under a third of all pairs is scored, and the result is that of all pairs."""
    rows = clustered(4000)
    df = spark.createDataFrame(rows, "id long, embedding array<double>, g string")
    asked = df.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    PV.write_pivots(df.drop("g"), f"{tmp_path}/p", n_pivots=128)
    assert 0 < PV.scored_share(spark, f"{tmp_path}/p", asked, 10) < 1 / 3
    plain = lambda d: sorted((r.query_id, r.id, r["rank"]) for r in d.collect())
    assert plain(PV.search(spark, f"{tmp_path}/p", asked, 10)) == plain(V.cosine_top_k(df.select("id", "embedding"), asked, 10))


def test_pivot_table_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    PV.write_pivots(none, f"{tmp_path}/p")
    assert PV.search(spark, f"{tmp_path}/p", none.select(F.col("id").alias("query_id"), "embedding"), 3).count() == 0
    zeros = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "id long, embedding array<double>")
    PV.write_pivots(zeros, f"{tmp_path}/z")
    assert [(r.id, r.score) for r in PV.search(spark, f"{tmp_path}/z", zeros.select(F.col("id").alias("query_id"), "embedding").limit(1), 1).collect()] == [(1, 0.0)]


def okapi(docs, queries, k):
    docs = {i: [t for t in (d or []) if t is not None] for i, d in docs}
    n, df = len(docs), collections.Counter(t for d in docs.values() for t in set(d))
    mean = sum(map(len, docs.values())) / n
    raw = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    low = 0.25 * sum(raw.values()) / max(1, len(raw))
    out = []
    for q, tokens in queries:
        score = {i: sum((low if raw[t] < 0 else raw[t]) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in tokens if t in raw and t in d) for i, d in docs.items()}
        out += [(q, i, n + 1, round(score[i], 6) + 0.0) for n, i in enumerate(sorted(docs, key=lambda i: (-round(score[i], 9), i))[:k])]
    return sorted(out)


def words(n, seed=3):
    g = np.random.default_rng(seed)
    return [(int(3 * i), [f"t{int(x)}" for x in np.minimum(g.zipf(1.4, g.integers(0, 40)), 300)]) for i in range(n)]


@pytest.mark.parametrize("k", [1, 5, 60])
def test_stored_bm25(spark, tmp_path, k):
    """Two query sets from one index against brute force; empty documents, unknown and repeated terms, queries without a match."""
    docs = [*words(400), (5000, None), (5001, []), (5002, ["t1", None, "zz"])]
    queries = [(1, ["t1", "t2", "t1"]), (2, ["t7"]), (3, ["no"]), (4, []), (5, ["zz", "t250", "no"]), (6, [f"t{i}" for i in range(30)])]
    df = spark.createDataFrame(docs, "id long, tokens array<string>").repartition(3)
    ask = lambda q: spark.createDataFrame(q, "query_id long, tokens array<string>")
    P.write_postings(df, f"{tmp_path}/i", block_rows=8, part_rows=64)
    plain = lambda d: sorted((r.query_id, r.id, r["rank"], round(r.score, 6) + 0.0) for r in d.collect())
    assert plain(P.search(spark, f"{tmp_path}/i", ask(queries), k)) == okapi(docs, queries, k)
    more = [(10, ["t3", "t9"]), (11, ["t299"])]
    found = P.search(spark, f"{tmp_path}/i", ask(more), k)
    assert plain(found) == okapi(docs, more, k) and all("/i/" in f for f in found.inputFiles())
    clean = df.withColumn("tokens", F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: t.isNotNull()))
    assert plain(R.bm25(clean, ask(queries), k)) == okapi(docs, queries, k)


def test_blocks_are_skipped(spark, tmp_path):
    docs = words(3000)
    P.write_postings(spark.createDataFrame(docs, "id long, tokens array<string>"), f"{tmp_path}/i", block_rows=16)
    asked = spark.createDataFrame([(1, ["t5"]), (2, ["t3", "t200"]), (3, ["t4", "t6"])], "query_id long, tokens array<string>")
    visits = {(r.query_id, r.wanted): r["count"] for r in P.block_visits(spark, f"{tmp_path}/i", asked, 5).groupBy("query_id", "wanted").count().collect()}
    assert visits[1, False] > 5 * visits[1, True] and sum(n for (_, wanted), n in visits.items() if not wanted) > 100


def test_negative_idf(spark, tmp_path):
    """Terms that most documents have: documents with them score below those without, which take their place by id."""
    docs = [(i, ["a", "b", "c"] if i not in (4, 9, 30) else ["d"] if i == 30 else []) for i in range(40)]
    queries = [(1, ["a"]), (2, ["b", "d"]), (3, ["x"])]
    df, ask = spark.createDataFrame(docs, "id long, tokens array<string>"), spark.createDataFrame(queries, "query_id long, tokens array<string>")
    P.write_postings(df, f"{tmp_path}/i")
    for k in (2, 6, 40):
        for found in (P.search(spark, f"{tmp_path}/i", ask, k), R.bm25(df, ask, k)):
            assert sorted((r.query_id, r.id, r["rank"], round(r.score, 6) + 0.0) for r in found.collect()) == okapi(docs, queries, k)


def test_repeated_queries_are_searched_once(spark, tmp_path):
    """Queries of the same tokens, in any order, stand as one; each still gets its rows, and a document beyond the parts' k best makes none."""
    docs = words(200)
    queries = [(i, [["t1", "t2"], ["t2", "t1"], ["t5", "t5"], None][i % 4]) for i in range(40)]
    df, ask = spark.createDataFrame(docs, "id long, tokens array<string>"), spark.createDataFrame(queries, "query_id long, tokens array<string>")
    asked, same = R.distinct_queries(ask)
    assert sorted(map(tuple, asked.collect())) == [(0, "t1", 1), (0, "t2", 1), (2, "t5", 2)] and {(r.query_id % 4, r.first) for r in same.collect()} == {(0, 0), (1, 0), (2, 2), (3, 3)}
    got = sorted((r.query_id, r.id, r["rank"], round(r.score, 6) + 0.0) for r in R.bm25(df, ask, 3).collect())
    assert got == okapi(docs, [(q, t or []) for q, t in queries], 3)
    posts = spark.createDataFrame([(i, t, 1.0 + i % 7) for i in range(500) for t in ("a", "b")], "id long, term string, w double")
    most = R.best_documents(posts, posts.select("id").distinct(), spark.createDataFrame([(1,)], "query_id long"), spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, term string, times long"), 2, part_rows=50)
    assert [(r.id, r.score, r["rank"]) for r in most.orderBy("rank").collect()] == [(6, 21.0, 1), (13, 21.0, 2)]
