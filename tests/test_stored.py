"""Keyed tables that are loaded in steps, and joins of heavy rulings cell by cell."""

import collections
import glob
import random

import pytest

from citeloom.operators import grounding as G
from citeloom.sources.keyed import KeyedTable

ROWS = "k long, o int, v string"


def held(table):
    return sorted(((r.k, r.v) for r in table.read().collect()), key=str)


def test_loads_in_steps(spark, tmp_path):
    """New, changed, equal and null keys; untouched buckets keep their files; a load of what is there rewrites nothing."""
    df = lambda rows: spark.createDataFrame(rows, ROWS)
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"], buckets=16)
    assert table.read() is None
    table.load(df([(i, 1, f"a{i}") for i in range(100)] + [(7, 2, "later"), (None, 1, "none")]), "o")
    want = {i: f"a{i}" for i in range(100)} | {7: "later", None: "none"}
    assert held(table) == sorted(want.items(), key=str)
    before = {r.bucket: r.folder for r in table.manifest()}
    assert table.load(df([(3, 1, "b"), (500, 1, "new"), (4, 9, "a4"), (None, 5, None)]), "o") <= 3
    want |= {3: "b", 500: "new", None: None}
    assert held(table) == sorted(want.items(), key=str)
    after = {r.bucket: r.folder for r in table.manifest()}
    assert 13 <= sum(after[b] == f for b, f in before.items()) < 16
    files = set(glob.glob(f"{tmp_path}/t/data/**/*.parquet", recursive=True))
    assert table.load(df([(3, 7, "b"), (4, 8, "a4")]), "o") == 0 and files == set(glob.glob(f"{tmp_path}/t/data/**/*.parquet", recursive=True))
    assert table.load(df([]), "o") == 0 and held(table) == sorted(want.items(), key=str)


def test_a_broken_load_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"], buckets=4)
    table.load(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], ROWS), "o")
    broken = spark.range(50).selectExpr("id k", "1 o", "if(id = 49, raise_error('broken'), 'x') v")
    with pytest.raises(Exception, match="broken"):
        table.load(broken, "o")
    assert held(KeyedTable(spark, f"{tmp_path}/t", ["k"], buckets=4)) == [(1, "a"), (2, "b")]
    empty = KeyedTable(spark, f"{tmp_path}/e", ["k"])
    empty.load(spark.createDataFrame([], ROWS), "o")
    assert empty.read().count() == 0
    empty.load(spark.createDataFrame([(1, 1, "a")], ROWS), "o")
    assert held(empty) == [(1, "a")]


def test_heavy_rulings_in_cells(spark):
    """One ruling with most of all pairs: equal counts, and no cell over twice what a cell may hold."""
    rng = random.Random(2)
    feats = [("big", "c", f"v{i}") for i in range(700) for _ in range(1 + i % 2)] + [(f"r{i}", "c", f"v{rng.randrange(20)}") for i in range(60)]
    cites = {("big", i, "text" if i % 3 else "official") for i in range(500)} | {(f"r{i}", rng.randrange(20), "text") for i in range(60)}
    f = spark.createDataFrame(feats, "ruling_id string, category string, value string")
    e = spark.createDataFrame([(r, "l", a, s) for r, a, s in cites], "ruling_id string, law string, article_number int, source string")
    art = spark.createDataFrame([("l", a, "civil") for a in range(500)], "law string, article_number int, domain string")
    key = lambda most: sorted(map(tuple, G.cooccurrence(f, e, art, ["x"], most).collect()))
    got = key(10_000)
    assert got == key(1 << 22)
    n, joint = collections.Counter(feats), collections.Counter()
    for (r, _, v), _ in n.items():
        for c in cites:
            if c[0] == r:
                joint[v, c[1]] += 1
    assert {(row[1], row[3]): row[6] for row in got} == joint
    mentions = f.groupBy("ruling_id", "category", "value").count()
    left, right = G.celled(mentions, e, 10_000)
    cells = left.groupBy("ruling_id", "__row", "__column").count().withColumnRenamed("count", "m").join(right.groupBy("ruling_id", "__row", "__column").count(), ["ruling_id", "__row", "__column"])
    pairs = [r.m * r["count"] for r in cells.filter("ruling_id = 'big'").collect()]
    assert sum(pairs) == 700 * 500 and len(pairs) == 35 and max(pairs) <= 20_000
