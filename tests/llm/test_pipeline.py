"""The pipeline stage by stage against brute force on the smallest driver tables, and the SQL of the queries."""

import collections
import os

import duckdb
import pytest

import corpus_pipeline
from citeloom.llm.common import Scratch
from citeloom.llm.queries import ORACLE, QUERIES
from tests.llm.test_operators import jaccard_brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_stages(spark):
    docs, seen, scratch = spark.read.parquet(f"{SF}/documents.parquet"), [], Scratch(spark, "test")
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.stored(stage(spark, docs, SF), "t")
        seen.append([r.asDict() for r in docs.collect()])
    first, second, third, fourth, last = seen
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(list(rows[0]) == columns for rows in seen[:4])
    rows = [(r["doc_id"], r["text"], None) for r in first]
    assert {r["doc_id"] for r in second} == {c for _, c in jaccard_brute(rows).values()}
    words, k = {r["doc_id"]: r["text"].encode().split() for r in second}, 35
    count = collections.Counter(tuple(w[i : i + k]) for w in words.values() for i in range(len(w) - k + 1))
    for r in third:
        w, gone = words[r["doc_id"]], [False] * len(words[r["doc_id"]])
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        assert r["text"].encode().split() == [x for x, g in zip(w, gone) if not g]
    text = {r["doc_id"]: r["text"] for r in third}
    assert all(r["text"] == text[r["doc_id"]] for r in fourth) and max(collections.Counter(r["doc_id"] for r in fourth).values()) <= 3
    assert collections.Counter((r["doc_id"]) for r in last if r["piece"] == 0) == collections.Counter(r["doc_id"] for r in fourth)
    assert corpus_pipeline.run(spark, SF).count() == len(last)


def test_near_copies_at_five_words_and_four_fifths(spark):
    """Four isolated words of 200 changed: 176 / 216 of the 5-word shingles are shared, a copy; five changed: 171 / 221, none."""
    words = [f"w{i}" for i in range(200)]
    near = ["x" if i in (30, 70, 110, 150) else w for i, w in enumerate(words)]
    apart = ["y" if i in (30, 70, 110, 150, 190) else w for i, w in enumerate(f"v{i}" for i in range(200))]
    rows = [(1, " ".join(words), "en", "a", 1), (2, " ".join(near), "en", "a", 1), (3, " ".join(f"v{i}" for i in range(200)), "en", "a", 1), (4, " ".join(apart), "en", "a", 1)]
    got = corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert {r.doc_id for r in got.collect()} == {1, 3, 4}


def test_two_runs_in_one_session(spark):
    """Each run owns its tables: a second one leaves the first one's lazy rows alone, and both are the same."""
    first = corpus_pipeline.run(spark, SF)
    second = corpus_pipeline.run(spark, SF)
    columns = [c for c in first.columns if c not in ("sequence_id", "offset")]
    a, b = (sorted(map(tuple, df.select(columns).collect())) for df in (first, second))
    assert a == b and first.count() == second.count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, n_words string, __row int, kept_text string, bucket int"


def odd_documents(spark):
    """Null and repeated ids, null and empty texts, one huge text, one huge word, and columns named like those of the steps."""
    words = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(None, None), (None, None), (1, ""), (2, "aa " * 40), (2, "aa " * 40), (3, words), (4, "z" * 2_000_000), (5, " ".join(f"v{i}" for i in range(80))), (None, " ".join(f"u{i}" for i in range(80)))]
    return spark.createDataFrame([(i, t, "en", None if i == 5 else "a", len(t or ""), "mine", 7, "own", 9) for i, t in rows], ODD)


def test_stages_on_odd_rows(spark, tmp_path):
    """No stage fails, and what it does not change stays as it was, whatever the columns are called."""
    spark.createDataFrame([(3, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, scratch = odd_documents(spark), Scratch(spark, "test")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.stored(stage(spark, docs, str(tmp_path)), "t")
        assert out.columns == docs.columns and all((r["n_words"], r["__row"], r["kept_text"], r["bucket"]) == ("mine", 7, "own", 9) for r in out.collect())
        docs = out
    assert {r.doc_id for r in docs.collect()} <= {3, 5, None}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_documents(spark).limit(0), str(tmp_path)).count() == 0
    every = corpus_pipeline.pack(spark, odd_documents(spark), "")
    assert every.filter("piece = 0").count() == 9


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    said = con.execute(ORACLE[name])
    columns = [c[0] for c in said.description]
    got = QUERIES[name](spark, SF).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(said.fetchall(), key=str)
