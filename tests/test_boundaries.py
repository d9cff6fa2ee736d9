"""Values that fall on a boundary, pages cut within a reference, and repeated rows of vocabularies and queries."""

import duckdb
from pyspark.sql import functions as F

from citeloom.operators import channels as CH
from citeloom.operators import opinions as O
from citeloom.operators import pages as PG
from citeloom.operators import retrieval as R
from citeloom.plans.registry import ORACLE, QUERIES


def test_deviation_on_the_bound(spark):
    """A deviation of 0.2 up to the last digit is the one of sums in the order of the opinions, however rows are dealt."""
    cases = {105: [36, 56, 16], 173: [48, 88, 68]}
    rows = [(c, i, f"r{i}", "yes", x / 100, ["a"]) for c, xs in cases.items() for i, x in enumerate(xs)]
    priors = spark.createDataFrame([(c, 0.5, 0.0) for c in cases], "case_id long, score double, prune_ratio double")
    schema = "case_id long, pos int, role string, verdict string, confidence double, cited_articles array<string>"
    for order in (rows, rows[::-1]):
        out = O.fused(spark.createDataFrame(order, schema).repartition(3), priors)
        assert {r.case_id: r.uncertainty_flag for r in out.collect()} == {105: False, 173: True}


def test_confidence_on_the_bound(spark):
    """Sixths and thirds are divided once, and a mean is summed from the last rank."""
    scores = {"article": [0.73, 0.35, 0.19], "feature": [1.0, 0.56, 0.09], "ruling": [0.74, 0.62, 0.16]}
    hits = spark.createDataFrame([(1, c, i, x) for c, xs in scores.items() for i, x in enumerate(xs, 1)], "query_id long, channel string, rank int, score double")
    quality = R.channel_quality(hits.select("query_id").distinct(), hits, list(scores))
    out = R.confidence(quality, {"feature": 1 / 6, "ruling": 2 / 3, "article": 1 / 6}, digits=None).first()
    assert (out.score, out.level) == (0.5, "medium")


def test_level_of_the_query(spark, tmp_path):
    """On a table with as many events a user as the given ones the query sums a mean from the first rank, as its SQL does."""
    scores = {1: {"view": [1.0, 0.71, 0.28], "click": [1.0, 0.53, 0.52], "error": [1.0, 0.84, 0.57]}, 2: {"view": [1.0, 0.44, 0.4], "click": [1.0, 0.56, 0.38], "error": [1.0, 1.0, 1.0]}}
    hits = [(100_000 + i, u, t, 100.0 * x) for u, kinds in scores.items() for t, xs in kinds.items() for i, x in enumerate(xs)]
    schema = "event_id long, user_id long, event_type string, value double"
    rest = spark.range(100_000).select(F.col("id").alias("event_id"), (F.col("id") % 1500).alias("user_id"), F.lit("purchase").alias("event_type"), F.lit(1.0).alias("value"))
    kinds = rest.withColumn("event_type", F.when(F.col("user_id") < 3, "purchase").otherwise(F.element_at(F.array(*map(F.lit, ("view", "click", "error", "purchase", "signup"))), (F.col("event_id") % 5 + 1).cast("int"))))
    kinds.unionByName(spark.createDataFrame(hits, schema).withColumn("value", F.round("value"))).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.query_id: (r.score, r.level) for r in QUERIES["j8_confidence"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got[1] == got[2] == (0.7, "medium") and got == {r[0]: (r[2], r[3]) for r in con.execute(ORACLE["j8_confidence"]).fetchall()}


def test_reference_cut_short(spark):
    """What a cut left of a reference stays as it is written; whole references are read, in attributes too."""
    pages = spark.createDataFrame([(1, '<h1>a &lt;b&gt; &amp</h1><p>c &#x27;d &am e&amp;amp;</p><a id="x?a=1&amp;b&copy=2">f &</a>')], "page_id long, html string")
    assert [(r.id, r.text) for r in PG.elements(pages, ["h1", "p", "a"]).orderBy("pos").collect()] == [(None, "a <b> &amp"), (None, "c 'd &am e&amp;"), ("x?a=1&b&copy=2", "f &")]


def test_repeated_vocabulary_and_queries(spark):
    """Repeats of a vocabulary's rows and of a query's tokens change no position, and a query's rows behind its first full match do not come."""
    vocab = [("c", "one", "red", 5), ("c", "two", "blue", 3), ("d", "one", "red", 4)] * 40
    v = spark.createDataFrame([(c, k, r, False, o + i) for i, (c, k, r, o) in enumerate(vocab)], "category string, canonical string, raw string, is_canonical boolean, ord int")
    q = spark.createDataFrame([(i, ["red", "and", "blue"] if i % 2 else ["blue"]) for i in range(6)] + [(9, None)], "query_id long, tokens array<string>")
    matches = CH.vocabulary_matches(q, v)
    want = [("two", "c", 1), ("one", "c", 2), ("one", "d", 3)]
    assert sorted((r.query_id, r.position, r.canonical, r.category) for r in matches.collect()) == sorted((i, n, k, c) for i in range(6) for k, c, n in (want if i % 2 else want[:1]))
    features = spark.createDataFrame([(n, c, k, None) for n in range(12) for c, k in (("c", "one"), ("d", "one"), ("c", "two"))] + [(50, "d", "one", "q")], "ruling_id long, category string, value string, quote string")
    for k in (5, 12, 14, 40):
        got = [(r["rank"], r.ruling_id, r.category, r.value) for r in CH.feature_channel(matches.filter("query_id = 1"), features, k).orderBy("rank").collect()]
        full = [*((n, "c", "two") for n in range(12)), *((n, "c", "one") for n in range(12)), (50, "d", "one")]
        assert got == [(i, *x) for i, x in enumerate(full[:k], 1)]


def test_plain_pages_read_by_one_split():
    """A page of plain tags is read without the parser and gives the parser's tree; any other page goes to the parser."""
    dump = lambda n: (n.tag, n.attrs, [x if isinstance(x, str) else dump(x) for x in n.inner])

    class Parsed(PG.Tree):
        def _plain(self, page):
            return False

    plain = ["", "a &amp b", "<p>a<p>b</P>c<br/>d<BR>e", 'x &lt; y <a HREF="q" class="r s" href="t">z</a >w', "</br>h<p/>m</p>", '<a\tb="c"\n d="e" />f']
    odd = ["<a href=x>1</a>", "<!-- <p> --><p>q", "<script>a<b</script>c", "a < b", '<p class="x"title="y">u', '</p class="a">v', '<p x="a&amp;b">g', '<a b="1" /c="2">i', "<a></ a>"]
    for page in plain + odd:
        assert dump(PG.Tree(page).root) == dump(Parsed(page).root)
        assert PG.Tree("")._plain(page) == (page in plain)
