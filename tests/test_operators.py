"""Small hand-written tables for the cases that the driver tables lack."""

import math
import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import audit as A
from citeloom.operators import calibration as C
from citeloom.operators import channels as CH
from citeloom.operators import citations as CI
from citeloom.operators import features as FE
from citeloom.operators import graph as GR
from citeloom.operators import grounding as G
from citeloom.operators import metrics as M
from citeloom.operators import opinions as O
from citeloom.operators import pages as PG
from citeloom.operators import retrieval as R
from citeloom.operators import vectors as V
from citeloom.operators import vocabulary as VO
from citeloom.sources import records as S


def values(spark, **columns):
    """One row of column expressions."""
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_text(spark):
    r = values(
        spark, latin=X.to_latin_digits(F.lit("۱۲ x")), key=X.match_key(F.lit("أب ة‌ء")), clean=X.clean_free_text(F.lit(" a‌‌ ۳  b ")), tokens=X.search_tokens(F.lit("قانون‌مدنی ab ۱۲ 34")),
        ref=X.parsed_ref(F.lit("قانون - ماده ۵ - ماده ۱۲")), bad=X.parsed_ref(F.lit("قانون - ماده x")), cut=X.truncated(F.lit("  abcdef  "), 3), short=X.truncated(F.lit(" ab "), 3), parts=X.chunks(F.lit("x" * 3001)), one=X.chunks(F.lit("")),
    )
    assert (r.latin, r.key, r.clean, r.tokens) == ("12 x", "ابه", "a 3 b", ["قانون", "مدنی", "۱۲", "34"])
    assert (r.ref.law, r.ref.article_number, r.bad, r.cut, r.short) == ("قانون - ماده ۵", 12, None, "abc ...", "ab")
    assert [len(p) for p in r.parts] == [3000, 201] and r.one == [""]
    with pytest.raises(Exception, match="unknown value"):
        spark.range(1).select(X.mapped(F.lit("q"), {"a": "b"}, strict=True)).collect()


def test_free_text_citations(spark):
    rows = [
        (1, "طبق ماده ۱۰ قانون مدنی و مواد 5 و 6 قانون تجارت"), (2, "قانون مدنی، ماده ۱۹۹"), (3, "تبصره 2 از ماده 7 قانون مدنی و ماده 8 قانون مذکور"), (4, "ماده 3 قانون ناشناس و ماده 4 قانون مدنی"),
        (5, "ماده 9 همان قانون"), (6, "مواد 348 آیین دادرسی مدنی"), (7, None), (8, "ماده 1 " + "x " * 250 + "قانون مدنی"), (9, "ماده 2 قانون مدنی و 12 قانون تجارت"),
    ]
    out = CI.free_text_citations(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: [(c.article_number, c.law_name, c.note_number) for c in r.text_cited_articles] for r in out}
    civil, trade = "قانون مدنی", "قانون تجارت"
    assert got[1] == [(10, civil, None), (5, trade, None), (6, trade, None)] and got[2] == [(199, civil, None)]
    assert got[3] == [(7, civil, 2), (8, civil, None)] and got[4] == [(4, civil, None)]
    assert got[5] == [] and got[6] == [(348, "قانون آیین دادرسی مدنی", None)] and got[7] == [] and got[8] == []
    assert got[9] == [(2, civil, None), (12, trade, None)]


def test_official_box(spark):
    box = "ماده ۳۱۲ قانون تجارت-تبصره 1 از ماده 2 قانون صدور چک-ماده 399 ماده 401 قانون مدنی-"
    got = values(spark, x=CI.official_citations(F.lit(box)), none=CI.official_citations(F.lit(None).cast("string")))
    assert [(c.article_number, c.law_name, c.note_number) for c in got.x] == [(312, "قانون تجارت", None), (2, "قانون صدور چک", 1), (399, "قانون مدنی", None), (401, "قانون مدنی", None)] and got.none == []


def test_statute_page(spark):
    html = "<p>پیش</p><p>‌ماده ۱ - متن ماده ۱ و ماده ۲</p><p>ادامه</p><p>تبصره - یک</p><p>دنباله</p><p> </p><p>ماده 2 (اصلاحي) منسوخ</p><p>تبصره ۳ - سه</p>"
    e = PG.elements(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), ["p"])
    got = {(r.article_seq, r.note_seq): (r.number, r.content, r.status) for r in PG.segmented(e).collect()}
    assert got[1, 0][:2] == (1, "ماده 1 - متن ماده 1 و ماده 2 ادامه") and got[1, 1][:2] == (1, "تبصره - یک دنباله")
    assert got[2, 0][0] == 2 and got[2, 0][2] == "amended" and got[2, 1][0] == 3 and len(got) == 4
    assert values(spark, r=PG.references_in(F.lit("ماده ۱ و ماده ۲ و ماده 2"), F.lit(1))).r == [2, 2]


def test_elements_and_sections(spark):
    html = "<script>var t='<p>no</p>';</script><div class='box a'>x<b>y</b></div><h1>One</h1><p>a &amp; ۲<p>b</p><h1>Two</h1><p>c</p><div>end</div><p>gone</p>"
    page = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(r["class"], r.text) for r in PG.elements(page, ["div"], "a").collect()] == [("box a", "x y")]
    s = PG.ruling_sections(page).orderBy("section_no").collect()
    assert [(r.section_no, r.court_level, r.text) for r in s] == [(1, "One", "a & 2 b"), (2, "Two", "c")]
    assert [(r.id, r.position) for r in PG.link_ids(spark.createDataFrame([(1, '<a href="/r/5"><a href="/r/2"><a href="/r/5">')], "page_id long, html string"), "/r/(\\d+)").orderBy("position").collect()] == [("5", 1), ("2", 2)]


def test_association_edges(spark):
    cites = spark.createDataFrame([(1, "l", 1, "official"), (1, "l", 1, "text"), (2, "l", 1, "official"), (2, "l", 9, "text")], "ruling_id long, law string, article_number int, source string")
    f = spark.createDataFrame([(1, "role", "a"), (1, "role", "a"), (2, "role", "a"), (3, "role", "b")], "ruling_id long, category string, value string")
    art = spark.createDataFrame([("l", 1, "civil"), ("l", 9, None)], "law string, article_number int, domain string")
    e = G.citation_edges(cites)
    assert {(r.ruling_id, r.article_number): r.source for r in e.collect()} == {(1, 1): "text", (2, 1): "official", (2, 9): "text"} and G.citation_edges(cites, "both").count() == 4
    g = G.cooccurrence(f, e, art, ["proc"])
    assert [(r.value, r.article_number, r.official_count, r.text_count) for r in g.collect()] == [("a", 1, 1, 2)]
    n = lambda k: spark.createDataFrame([(float(k),)], "n double")
    assert G.pmi(f, e, g, n(2)).first().npmi is None and abs(G.pmi(f, e, g, n(4)).first().npmi - 1) < 1e-9


def test_rrf(spark):
    rng = random.Random(1)
    rows = [(q, n, r, f"k{rng.randint(0, 8)}") for q in range(3) for n in (1, 2) for r in range(1, 7)]
    got = {}
    for r in R.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id long, list_no int, rank int, key string"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.key))
    for q in range(3):
        score, seen = {}, {}
        for _, n, r, k in sorted(x for x in rows if x[0] == q):
            score[k] = score.get(k, 0) + 1 / (60 + r)
            seen.setdefault(k, (n, r))
        want = sorted(score, key=lambda k: (-round(score[k], 12), seen[k]))[:5]
        assert [k for _, k in sorted(got[q])] == want


def test_channels(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame([(1, "a", r, s) for r, s in ((1, 0.9), (2, 0.6), (3, 0.3), (4, 0.0))], "query_id long, channel string, rank int, score double")
    out = {r.query_id: r for r in R.confidence(R.channel_quality(q, hits, ["a", "b"]), {"a": 1.0, "b": 1.0}).collect()}
    assert (out[1].score, out[1].level, out[1].missing) == (0.5, "medium", ["b"]) and (out[2].score, out[2].level) == (0.0, "low")
    own = spark.createDataFrame([(1, "x", "x"), (1, None, "x"), (1, "y", "x")], "query_id long, ruling_id string, self_ruling_id string")
    assert R.without_self(own).count() == 2
    router = spark.createDataFrame([('```json\n{"channels": ["a", "zz"], "case_type": "civil"}\n```',), ("nope",)], "raw string")
    assert [(r.channels, r.case_type) for r in R.routed(router, "raw", ["a", "b"], ["civil"]).collect()] == [(["a"], "civil"), (["a", "b"], None)]


def test_audit(spark):
    item = "struct<condition:string,necessary:boolean,satisfied:boolean>"
    cases = [[("a", True, True), ("b", False, False)], [("a", True, True), ("b", True, False)], [("a", False, True)] * 3 + [("b", False, False)] * 2, [("a", False, True), ("b", False, False)], []]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, checklist array<{item}>")
    got = {r.i: (round(r.x.ratio, 3), r.x.is_applicable) for r in df.select("i", A.decided(F.col("checklist")).alias("x")).collect()}
    assert got == {0: (1.0, True), 1: (0.5, False), 2: (0.6, True), 3: (0.5, False), 4: (0.0, False)}
    raw = [
        '```json\n{"topically_relevant": "perhaps", "checklist": [{"condition": "c", "necessary": true, "satisfied": " Unknown "}, {"condition": "", "necessary": 1, "satisfied": "yes"}]}\n```', "not json",
        '{"topically_relevant": false, "checklist": [{"condition": "c", "necessary": "off", "satisfied": 1.0}, {"condition": 5, "necessary": true, "satisfied": true}, {"condition": "d", "necessary": "odd", "satisfied": true}]}',
        '{"checklist": [{"condition": "c", "necessary": true, "satisfied": "maybe"}, {"condition": "d", "necessary": true, "satisfied": 7}, {"condition": "e", "satisfied": true}, {"condition": "f", "necessary": null, "satisfied": true}, 3]}',
        '["x"]', '{"checklist": {}}', None,
    ]
    out = [(r.topically_relevant, [tuple(i) for i in r.checklist], r.parse_error) for r in A.parsed_answers(spark.createDataFrame([(x,) for x in raw], "raw string")).collect()]
    assert out == [(True, [("c", True, False), ("", True, True)], False), (True, [], True), (False, [("c", False, True)], False), *[(True, [], True)] * 4]


def test_opinions(spark):
    cases = {1: "aaa", 2: "aab", 3: "abc", 4: "ab", 5: "abcd"}
    rows = [(c, i, f"r{i}", v, 0.9 if i else 0.3, ["x", "x", f"y{i}"]) for c, vs in cases.items() for i, v in enumerate(vs)]
    o = spark.createDataFrame(rows, "case_id int, pos int, role string, verdict string, confidence double, cited_articles array<string>")
    assert {r.case_id: (r.majority_verdict, r.consensus) for r in O.majority(o).collect()} == {1: ("a", "full"), 2: ("a", "majority"), 3: ("neutral", "split")}
    assert sorted(r.case_id for r in O.wrong_sized(o).collect()) == [4, 5] and O.completed(o).filter("case_id = 4").count() == 3
    p = spark.createDataFrame([(c, 0.5, 0.6) for c in cases], "case_id int, score double, prune_ratio double")
    f = {r.case_id: r for r in O.fused(o, p).collect()}
    assert (f[1].final_confidence, f[1].uncertainty_flag, f[1].notes) == (0.62, True, ["uncertain", "pruned"]) and f[3].final_confidence == 0.52
    g = {r.case_id: r for r in O.agreed_refs(o).collect()}
    assert g[1].agreed == ["x"] and g[1].all_cited == ["x", "y0", "y1", "y2"]


def test_metric_edges(spark):
    one = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert M.auroc(one, "s", "y").first().auroc is None
    edges = spark.createDataFrame([(x, 1) for x in (0.0, 0.2, 0.6, 1.0)], "s double, y int")
    assert [r.b for r in edges.select(M.bin_of(F.col("s"), "five").alias("b")).collect()] == [0, 1, 2, None]
    assert [r.b for r in edges.select(M.bin_of(F.col("s"), "left").alias("b")).collect()][-1] == 9
    assert M.spearman(edges, "s", "y").first().spearman == 0.0
    s = values(spark, both=M.set_scores(F.array().cast("array<string>"), F.array().cast("array<string>")), one=M.set_scores(F.array(F.lit("م ۱")), F.array(F.lit("م 1"))))
    assert s.both.f1 == 1.0 and s.one.f1 == 1.0
    rng = random.Random(3)
    rows = [(rng.randint(0, 20) / 20, rng.randint(0, 1)) for _ in range(150)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(M.auroc(df, "s", "y").first().auroc - want) < 1e-12 and abs(M.auroc(df.withColumn("s", -F.col("s")), "s", "y").first().auroc - (1 - want)) < 1e-12


def test_conformal(spark):
    scores = spark.createDataFrame([(x,) for x in (0.1, 0.3, 0.3, float("inf"))], "s double")
    got = {r.alpha: (r.threshold, r.achievable) for r in C.conformal_quantiles(scores, [0.1, 0.4, 0.9]).collect()}
    assert got == {0.1: (float("inf"), False), 0.4: (0.3, True), 0.9: (0.1, True)}


def test_regressions(spark):
    rng = random.Random(5)
    rows = [(x, rng.random(), int(x + 0.3 * rng.random() > 0.6)) for x in (rng.random() for _ in range(200))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    m = C.fit_logistic(df, ["a", "b"], "y", balanced=True)
    out = C.apply_logistic(df, ["a", "b"], list(m.coefficients), m.intercept)
    assert M.auroc(out, "probability", "y").first().auroc > 0.9
    assert C.fit_ridge(df.withColumn("y", F.col("a") * 2), ["a", "b"], "y", 1e-6).coefficients[0] == pytest.approx(2, abs=1e-3)


def test_vocabulary(spark):
    v = spark.createDataFrame([("role", "x", "x", True, 1), ("role", "y", "x", False, 0), ("role", "y", "y z", True, 2), ("act", "y z", "y z", True, 3)], "category string, canonical string, raw string, is_canonical boolean, ord int")
    idx = {(r.category, r.key): r.canonical for r in VO.index(v, lambda c: c).collect()}
    assert idx["role", "x"] == "x"
    vals = spark.createDataFrame([("role", "a y z b"), ("role", "x"), ("role", "none")], "category string, value string")
    assert {r.value: r.canonical for r in FE.resolved(vals, v, lambda c: c).collect()} == {"a y z b": "y", "x": "x", "none": None}
    review = spark.createDataFrame([("t1", "role"), ("t2", "alias:x"), ("t3", "alias:q"), ("t4", " "), ("t5", "zz"), ("t6", "REMOVE")], "term string, decision string")
    assert {r.term: (r.kind, r.category, r.canonical) for r in VO.reviewed(review, v, ["role", "act"]).collect()} == {"t1": ("new", "role", "t1"), "t2": ("alias", "role", "x"), "t3": ("invalid", None, None), "t4": ("skipped", None, None), "t5": ("invalid", None, None), "t6": ("skipped", None, None)}
    toks = values(spark, g=VO.grams(F.array(*map(F.lit, ["aa", "the", "b", "cc", "dd"])), ["the"]))
    assert sorted(toks.g) == ["aa", "aa the", "cc", "cc dd", "dd"]
    merged = VO.merged_terms(spark.createDataFrame([(2, "t", "m2"), (1, "t", "m1"), (3, "t", "m2"), (4, "t", " ")], "ord long, term string, meaning string")).first()
    assert merged.meaning == "m1 ؛ m2"


def test_quotes_and_orphans(spark):
    texts = spark.createDataFrame([("1", "ab cd‌ef gh")], "ruling_id string, text string")
    rows = spark.createDataFrame([("1", "cd"), ("1", "cdef  gh"), ("1", "zz"), ("2", "ab")], "ruling_id string, quote string")
    got = {(r.ruling_id, r.quote): (r.start_char, r.end_char) for r in FE.located(rows, texts).collect()}
    assert got == {("1", "cd"): (3, 5), ("1", "cdef  gh"): (3, 11), ("1", "zz"): (None, None), ("2", "ab"): (None, None)}
    odd = spark.createDataFrame([("1", "\U0001f600a b\u200fc\xa0d 😀 e"), ("2", None), ("3", "  ")], "ruling_id string, text string")
    asked = spark.createDataFrame([("1", "bcd"), ("1", "a bc"), ("1", "😀e"), ("1", ""), ("1", None), ("1", " \u200f"), ("2", "x"), ("3", "y"), (None, "z"), ("1", "bcd")], "ruling_id string, quote string")
    for most in (1024, 2):
        found = FE.located(asked, odd, most=most)
        got = sorted(map(tuple, found.collect()), key=str)
        assert got == sorted([("1", "bcd", 3, 8), ("1", "a bc", 1, 6), ("1", "😀e", 9, 12), ("1", "", None, None), ("1", None, None, None), ("1", " \u200f", None, None), ("2", "x", None, None), ("3", "y", None, None), (None, "z", None, None), ("1", "bcd", 3, 8)], key=str)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    lost = FE.orphans(spark.createDataFrame([("007",), ("9",)], "ruling_id string"), spark.createDataFrame([("7",)], "ruling_id string")).collect()
    assert {r.ruling_id: r.matches_as_int for r in lost} == {"007": True, "9": False}


def test_graph(spark):
    r = spark.createDataFrame([("1", ["1", "2", "2"]), ("3", ["1"])], "ruling_id string, related_ruling_ids array<string>")
    e = GR.related_edges(r)
    assert sorted(map(tuple, e.collect())) == [("1", "2"), ("3", "1")] and [x.ruling_id for x in GR.stub_rulings(e, r).collect()] == ["2"]
    up = GR.upserted(spark.createDataFrame([("a", 1, "new"), ("a", 0, "old")], "k string, o int, v string"), ["k"], "o", spark.createDataFrame([("a", "older"), ("b", "kept")], "k string, v string"))
    assert {x.k: x.v for x in up.collect()} == {"a": "new", "b": "kept"}


def test_vectors(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "b"), (2, "")], "id long, chunk string")
    e = V.embedded(docs, V.hashing_embedder(8))
    assert len(V.mean_vectors(e, "id").filter("id = 1").first().embedding) == 8
    top = V.cosine_top_k(e.select(F.col("id"), "embedding"), e.filter("id = 2").select(F.col("id").alias("query_id"), "embedding"), 2)
    assert [(r.id, r.score) for r in top.orderBy("rank").collect()] == [(1, 0.0), (1, 0.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.json").write_text('{"ruling_id": "1", "title": "t"}')
    (tmp_path / "a/2.json").write_text("{broken")
    (tmp_path / "a/3.json").write_text("")
    good, bad = S.read_records(spark, str(tmp_path / "a"))
    assert [r.ruling_id for r in good.collect()] == ["1"] and sorted(r.reason for r in bad.collect()) == ["corrupt", "empty"]
    (tmp_path / "r.csv").write_text("term\nx\n")
    with pytest.raises(ValueError, match="decision"):
        S.read_reviewed(spark, str(tmp_path / "r.csv"))


RULING = """<html><body><div class="nav">x</div><div class="container main"><h1 class="Title3D">عنوان : ابطال سند</h1>
<table><tr><td class="font-size-small"> شماره دادنامه قطعی : ۹۳۰۹۹۷ <br> تاریخ دادنامه قطعی : ۱۳۹۳/۰۸/۲۵ <br>گروه رأی: حقوقی - شعبه ۱۲ </td></tr></table>
<span><b>پیام:</b> سند رسمی معتبر است <b>x</b></span><div><b>مستندات:</b> ماده ۳ قانون مدنی-تبصره 1 از ماده 2 قانون صدور چک-</div>
<select id="Judge_ID"><option value="">-</option><option value="77">a</option><option value="76">b</option></select></div>
<div class="container"><h1 class="Title3D">other</h1></div>
<div id="treeText">before<h1>رأی <b>بدوی</b></h1>متن ماده ۵ قانون تجارت<br>دو<script>no()</script><h1>رأی تجدیدنظر</h1> سه <i>چهار</i><div>فهرست</div>پنج</div></body></html>"""


def test_ruling_pages(spark):
    """A page as the court's site has it, one without any part, and none at all."""
    from citeloom.operators.rulings import parsed_rulings

    one = parsed_rulings(spark.range(5).selectExpr("id page_id", "'<h1>x</h1>' html", "'u' url"))
    assert "Exchange" not in one._jdf.queryExecution().toString() and {r.url for r in one.collect()} == {"u"}

    pages = spark.createDataFrame([("12", RULING, "http://x/12"), ("13", "<p>x</p>", None), ("14", None, None)], "page_id string, html string, url string")
    r = {x.ruling_id: x for x in parsed_rulings(pages).collect()}
    a = r["12"]
    assert (a.title, a.legal_factual_summary, a.url) == ("ابطال سند", "سند رسمی معتبر است x", "http://x/12")
    assert (a.verdict_number, a.verdict_date, a.case_type, a.related_ruling_ids) == ("930997", "1393/08/25", "حقوقی", ["77", "76"])
    assert [(s.court_level, s.text) for s in a.sections] == [("رأیبدوی", "متن ماده 5 قانون تجارت دو"), ("رأی تجدیدنظر", "سه چهار")]
    assert [(c.article_number, c.law_name, c.note_number) for c in a.cited_articles] == [(3, "قانون مدنی", None), (2, "قانون صدور چک", 1)]
    assert [(c.article_number, c.law_name) for c in a.text_cited_articles] == [(5, "قانون تجارت")]
    for x in (r["13"], r["14"]):
        assert (x.title, x.verdict_number, x.case_type, x.related_ruling_ids, x.sections, x.cited_articles, x.text_cited_articles) == ("", "", "", [], [], [], [])


@pytest.mark.parametrize("text, status", [("اصلاحي 1380", "amended"), ("الحاقي", "amended"), ("اصلاحى", "amended"), ("موقوف الاجرا", "abolished"), ("منسوخ و اصلاحي", "amended"), ("الحاقی", "active"), ("تفسير", "interpreted"), ("تفسیر", "interpreted"), ("اصلاح شده", "active"), ("حذف شده", "active")])
def test_status(spark, text, status):
    assert values(spark, s=PG.status_of(F.lit(text))).s == status


def test_references_need_a_space(spark):
    r = values(spark, a=PG.references_in(F.lit("ماده۳ و ماده ۴ و ماده  5"), F.lit(5)))
    assert r.a == [4]


def fences_brute(tokens, laws, known_words):
    """Citations of a token list, read token by token: nearest law ahead, else the law just behind."""
    law_at, known = {}, None
    for i, t in enumerate(tokens):
        if t == "law":
            name = next((laws[k] for k in sorted(laws, key=len, reverse=True) if " ".join(tokens[i : i + len(k.split())]) == k), None)
            size = len(next((k for k in sorted(laws, key=len, reverse=True) if " ".join(tokens[i : i + len(k.split())]) == k), "law").split())
            refers = 0
            if not name:
                for gap in range(5):
                    if i + gap + 1 < len(tokens) and tokens[i + gap + 1] in known_words and all(x.isalpha() for x in tokens[i + 1 : i + gap + 1]):
                        refers = gap + 2
                        break
            known = name or known
            back = i and tokens[i - 1] == "that"
            law_at[i] = (i + (size if name else refers or 1), name or (known if refers or back else None))
    marks = sorted(law_at.items())
    behind, after = {i: [] for i, _ in marks}, {i: [] for i, _ in marks}
    i = 0
    while i < len(tokens):
        if tokens[i] in ("article", "articles") and i + 1 < len(tokens) and tokens[i + 1].isdigit():
            j, numbers = i + 1, []
            while j < len(tokens) and (tokens[j].isdigit() or (tokens[j] == "and" and tokens[j - 1].isdigit())):
                numbers += [int(tokens[j])] if tokens[j].isdigit() else []
                j += 1
            before = tokens[:i][:-1] if i and tokens[i - 1] == "of" else tokens[:i]
            start = len(before) - 2
            note = int(before[-1]) if len(numbers) == 1 and start >= 0 and before[-2] == "note" and before[-1].isdigit() else None
            ahead = next((m for m in marks if m[0] > i), None)
            last = next((m for m in reversed(marks) if m[0] < i), None)
            lo = last[1][0] if last else 0
            note = note if start >= lo else None
            if i >= lo:
                if ahead and ahead[1][1]:
                    behind[ahead[0]] += [(n, note) for n in numbers]
                elif last and last[1][1]:
                    after[last[0]] += [(n, note) for n in numbers]
            i = j
        else:
            i += 1
    tied = set()
    for k, (at, (_, law)) in enumerate(marks):
        lo = marks[k - 1][1][0] if k else 0
        if law and lo + 1 < at and tokens[lo] == "and" and tokens[lo + 1].isdigit():
            behind[at].append((int(tokens[lo + 1]), None))
            tied.add(lo)
    for k, (at, (end, law)) in enumerate(marks):
        hi = marks[k + 1][0] if k + 1 < len(marks) else len(tokens)
        if law and end not in tied and end + 1 < hi and tokens[end] == "and" and tokens[end + 1].isdigit():
            after[at].append((int(tokens[end + 1]), None))
    return [(n, law, note) for side in (behind, after) for at, (_, law) in marks for n, note in side[at]]


def test_free_text_against_tokens():
    g = CI.Grammar(law="law", article="article", articles="articles", note="note", of="of", joins=("and", ","), letters="a-z", said=("said", "above"), that=("that",), back=10**6, ahead=10**6, reach=10**6)
    laws = {"law of trade": "trade", "law of trade courts": "courts", "law civil": "civil"}
    reader, rng = CI.FenceReader(laws, g), random.Random(6)
    words = ["law", "law of trade", "law of trade courts", "law civil", "said", "above", "that", "article", "articles", "note", "of", "and", "5", "12", "7", "x", "court"]
    found = 0
    for _ in range(4000):
        tokens = " ".join(rng.choice(words) for _ in range(rng.randint(1, 25))).split()
        got = [(c["article_number"], c["law_name"], c["note_number"]) for c in reader.read(" ".join(tokens))]
        assert got == fences_brute(tokens, laws, {"said", "above"}), " ".join(tokens)
        found += len(got)
    assert found > 1000


def test_free_text_limits():
    """A law inside a reference counts as the last law; windows end at 400 characters before a law and 60 after it."""
    read = lambda t: [(c["article_number"], c["law_name"], c["note_number"]) for c in CI.FenceReader(CI.LAWS, CI.Grammar()).read(t)]
    civil, trade, procedure = "قانون مدنی", "قانون تجارت", "قانون آیین دادرسی مدنی"
    assert read(f"{civil} و قانون جدید آیین دادرسی مدنی مذکور. ماده 9 قانون مذکور")[-1] == (9, procedure, None)
    assert read("ماده 7 " + "x" * 392 + " " + civil) == [(7, civil, None)] and read("ماده 7 " + "x" * 394 + " " + civil) == []
    assert read(civil + " " + "x" * 50 + " ماده 12345") == [(123, civil, None)] and read(civil + " " + "x" * 58 + " ماده 12345") == []
    assert read(f"ماده 1 {civil} و 3 {trade}") == [(1, civil, None), (3, trade, None)]


def test_page_of_vocabulary_rules(spark):
    v = spark.createDataFrame([("a", "x", "x", True, 1), ("a", "x", "x1", False, 2), ("b", "x", "x", True, 3), ("a", "y", "y", True, 4), ("a", "z", "z", True, 5)], "category string, canonical string, raw string, is_canonical boolean, ord int")
    rules = spark.createDataFrame([("a", "remove_if_elsewhere", "x", None), ("a", "merge", "y", "z"), ("b", "remove_if_elsewhere", "q", None)], "category string, action string, term string, keep string")
    got = sorted((r.category, r.canonical, r.raw, r.is_canonical) for r in VO.corrected(v, rules).collect())
    assert got == [("a", "z", "y", False), ("a", "z", "z", True), ("b", "x", "x", True)]


def test_fallback_and_leak(spark):
    item = "array<struct<condition:string,necessary:boolean,satisfied:boolean>>"
    rows = [(1, "a", True, True, 1.0), (1, "b", False, True, 0.4), (1, "c", False, True, 0.5), (1, "d", False, False, 0.9)]
    df = spark.createDataFrame([(*r, []) for r in rows], f"query_id int, article_ref string, is_applicable boolean, topically_relevant boolean, confidence double, checklist {item}")
    assert sorted(r.article_ref for r in A.with_fallback(df).filter("added").collect()) == ["b", "c"]
    samples = spark.createDataFrame([("r", ["a", "a"], ["b"], {"a": [("c", True, True)]})], f"ruling_id string, gold_articles array<string>, excluded_articles array<string>, gold_checklist map<string,{item}>")
    assert sorted((r.article_ref, r.is_applicable, len(r.checklist)) for r in A.audit_from_gold(samples).collect()) == [("a", True, 1), ("b", False, 0)]
    assert [(r.ref, r.gold_applicable) for r in A.gold_pairs(samples).collect()] == [("a", True)]
    assert sorted(r.ref for r in A.checklist_refs(samples.withColumn("ord", F.lit(1)), spark.createDataFrame([("b",)], "ref string")).collect()) == ["a"]


def test_chunks_of_whole_texts(spark):
    """Texts over 20,000 characters are cut into pieces to their end; a cap is the caller's choice."""
    text = "".join(chr(97 + i % 26) for i in range(30_001))
    row = spark.createDataFrame([(text, "ab", "")], "long string, short string, empty string").select(X.chunks(F.col("long")).alias("t"), X.chunks(F.col("short")).alias("s"), X.chunks(F.col("empty")).alias("e"), X.chunks(F.col("long"), cap=20_000).alias("cut")).first()
    assert row.t == [text[o : o + 3000] for o in range(0, 30_001, 2800)] and (row.s, row.e) == (["ab"], [""])
    assert row.cut == [text[:20_000][o : o + 3000] for o in range(0, 20_000, 2800)]


def test_association_by_hand(spark):
    """PMI from one join against counts of sets."""
    rng = random.Random(4)
    cites = {(r, a) for r in range(40) for a in range(5) if rng.random() < 0.4}
    feats = [(r, "role", f"v{v}") for r in range(40) for v in range(4) for _ in range(rng.randint(0, 2))]
    edges = spark.createDataFrame([(r, "l", a, rng.choice(["official", "text"])) for r, a in sorted(cites)], "ruling_id long, law string, article_number int, source string")
    f = spark.createDataFrame(feats, "ruling_id long, category string, value string")
    art = spark.createDataFrame([("l", a, "civil" if a else "proc") for a in range(5)], "law string, article_number int, domain string")
    got = {(r.value, r.article_number): r for r in G.pmi(f, edges, G.cooccurrence(f, edges, art, ["proc"]), spark.createDataFrame([(50,)], "n long")).collect()}
    has, cited = {(r, v) for r, _, v in feats}, {a: {r for r, x in cites if x == a} for a in range(5)}
    for v in {v for _, _, v in feats}:
        for a in range(1, 5):
            rulings = {r for r, x in has if x == v}
            joint = len(rulings & cited[a])
            if not joint:
                assert (v, a) not in got
                continue
            r, pmi = got[v, a], math.log(joint * 50 / (len(rulings) * len(cited[a])))
            assert r.n_joint == joint and abs(r.pmi - pmi) < 1e-9 and abs(r.npmi - pmi / -math.log(joint / 50)) < 1e-9
            assert r.official_count + r.text_count == sum(1 for x, _, y in feats if y == v and x in cited[a])
    assert (0 not in {a for _, a in got}) and G.graph_support(spark.createDataFrame([(1,)], "query_id long"), f.select(F.lit(1).alias("query_id"), "category", "value"), edges.select(F.lit(1).alias("query_id"), "law", "article_number"), G.pmi(f, edges, G.cooccurrence(f, edges, art, ["proc"]), spark.createDataFrame([(50,)], "n long"))).count() == 1


def test_bm25_fills_up(spark):
    """A query with fewer than k matches gets the first other documents with score 0."""
    docs = spark.createDataFrame([(i, ["a", "b"] if i == 7 else ["c", f"d{i}"]) for i in range(12)], "id long, tokens array<string>")
    q = spark.createDataFrame([(1, ["a"]), (2, ["zz"])], "query_id long, tokens array<string>")
    got = {(r.query_id, r["rank"]): (r.id, r.score > 0) for r in R.bm25(docs, q, 3).collect()}
    assert got == {(1, 1): (7, True), (1, 2): (0, False), (1, 3): (1, False), (2, 1): (0, False), (2, 2): (1, False), (2, 3): (2, False)}


def test_long_terms(spark):
    """Terms of any number of tokens are found in values and queries."""
    six = "a b c d e f g"
    v = spark.createDataFrame([("role", "long", six, True, 1), ("role", "short", "c d", True, 2)], "category string, canonical string, raw string, is_canonical boolean, ord int")
    vals = spark.createDataFrame([("role", f"x {six} y"), ("role", "q c d")], "category string, value string")
    assert {r.value: r.canonical for r in FE.resolved(vals, v, lambda c: c).collect()} == {f"x {six} y": "long", "q c d": "short"}
    q = spark.createDataFrame([(1, f"x {six}".split())], "query_id long, tokens array<string>")
    assert [(r.canonical, r.position) for r in CH.vocabulary_matches(q, v).orderBy("position").collect()] == [("long", 1), ("short", 2)]
    long_alias = "alias:" + "z" * 20_000
    vz = spark.createDataFrame([("role", "z" * 20_000, "z" * 20_000, True, 1)], "category string, canonical string, raw string, is_canonical boolean, ord int")
    assert VO.reviewed(spark.createDataFrame([("t", long_alias)], "term string, decision string"), vz, ["role"]).first().kind == "alias"


def test_many_configs_and_alphas(spark):
    """No config or alpha is dropped for its number."""
    rows = spark.createDataFrame([(float(i), float(i), i % 2) for i in range(4)], "x double, y double, fold int")
    out = C.grid_search(rows, spark.range(100_001).withColumnRenamed("id", "config_id"), F.col("x") * 1, "y")
    assert out.count() == 100_001
    t = spark.range(10_001).select((F.col("id") / 20_000.0).alias("alpha"), F.lit(0.5).alias("threshold"))
    pool = spark.createDataFrame([(1, "a", 0.9)], "query_id int, ref string, score double")
    assert C.conformal_report(pool, pool.select("query_id", "ref"), pool, t).count() == 10_001
    assert C.weight_configs(spark).count() == 972 and C.weight_configs(spark).filter("article_weight < 0").count() == 0


def test_ranges_follow_the_data(spark):
    """One outlier does not crowd the other rows into one range, and sums stay exact."""
    xs = [random.Random(i).random() for i in range(3000)] + [1e12]
    df = spark.createDataFrame([(x, 1) for x in xs], "x double, n long")
    got = {r.x: r.before_n for r in M.cumulative(df, [], "x", ["n"]).collect()}
    assert got == {x: i for i, x in enumerate(sorted(xs))}


def test_null_scores_and_types(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 1), (None, 1), (0.5, None)], "s double, y int")
    assert M.auroc(df, "s", "y").first().auroc == 1.0 and M.average_precision(df, "s", "y").first().average_precision == 1.0
    rows = spark.createDataFrame([(0.9, "civil"), (0.1, None), (None, "civil")], "r double, c string")
    got = {(r.passed, r.case_type): r.n for r in M.pass_report(rows, "r", "c").collect()}
    assert got[("all", "all")] == 3 and got[("all", "missing")] == 1 and got[("missing", "all")] == 1 and got[("true", "civil")] == 1


def test_stratified_in_buckets(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(3000)], "k long, s string")
    folds = C.stratified_folds(df, "k", "s", 5).groupBy("s", "fold").count().collect()
    assert sorted((str(r.s), r["count"]) for r in folds) == sorted([("None", 200)] * 5 + [("a", 400)] * 5)
    split = {(r.s, r.is_test): r["count"] for r in C.stratified_split(df, "k", "s", 0.2).groupBy("s", "is_test").count().collect()}
    assert split == {("a", True): 400, ("a", False): 1600, (None, True): 200, (None, False): 800}


def test_logistic_against_newton(spark):
    """The fitted weights solve the penalised likelihood's equations."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((300, 2))
    y = (x[:, 0] + 0.4 * rng.random(300) > 0.7).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    c, m = 0.5, None
    m = C.fit_logistic(df, ["a", "b"], "y", c)
    full, w = np.column_stack((x, np.ones(300))), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ w))
        pen = np.array([1.0, 1.0, 0.0])
        w = w - np.linalg.solve(c * (full.T * (p * (1 - p))) @ full + np.diag(pen), c * full.T @ (p - y) + pen * w)
    assert np.allclose([*m.coefficients, m.intercept], w, atol=1e-4)


def test_evidence_bundles(spark):
    refs = spark.createDataFrame([(1, "r1", 1), (1, "r2", 2), (1, "r3", 3)], "query_id int, ref string, position int")
    texts = spark.createDataFrame([("r1", "text one")], "ref string, text string")
    rulings = spark.createDataFrame([(1, "r1", 2, "b"), (1, "r1", 1, "a"), (1, "r1", 3, None), (1, "r2", 1, "")], "query_id int, ref string, rank int, text string")
    features = spark.createDataFrame([(1, 1, "f1"), (1, 2, None), (1, 3, "f3")], "query_id int, rank int, text string")
    grounded = spark.createDataFrame([("r1", 2, "w"), ("r1", 1, "v")], "ref string, rank int, value string")
    got = {r.ref: (r.article_text, r.supporting_texts) for r in R.bundles(refs, texts, rulings, features, grounded, most_refs=2, most_features=2).collect()}
    assert got == {"r1": ("text one", [R.GROUNDED + "v، w", "a", "b", "f1"]), "r2": ("", ["f1"])}
    assert R.bundles(refs, texts, rulings, features).filter("ref = 'r3'").first().supporting_texts == ["f1", "f3"]


def test_gated_and_routed(spark):
    q = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, None)], "query_id int, channels array<string>")
    assert [r.query_id for r in CH.gated(q, "a").collect()] == [1] and CH.gated(q, "b").count() == 2
    vector = spark.createDataFrame([(1, 0.8, 0.4, [], ["a", "b"], 0.2, 1.0), (2, 0.0, 0.6, ["a"], ["a", "b"], None, None)], "query_id int, a_quality double, b_quality double, missing array<string>, queried array<string>, route double, amb double")
    got = [round(r.score, 6) for r in R.blended_confidence(vector, "queried", {"a": 0.5, "b": 0.5}, routing="route", routing_weight=0.5, ambiguity="amb", ambiguity_weight=0.1).orderBy("query_id").collect()]
    assert got == [round(0.6 - 0.1 - 0.1, 6), round(0.3 - 0.1, 6)]


def test_feature_edges(spark):
    f = spark.createDataFrame([("1", "role", 0, "a", "q", 1, 2, 0.5), ("1", "role", 1, "a", "r", None, None, None), ("1", "fact", 0, "x", "s", 3, 4, 0.9), ("2", "fact", 0, "x", "s", 3, 4, 0.9)], "ruling_id string, category string, pos int, value string, quote string, start_char int, end_char int, confidence double")
    e = FE.feature_edges(f).collect()
    assert sorted(r.node for r in e) == ["fact:1:0", "fact:2:0", "role:a", "role:a"] and FE.feature_nodes(f).count() == 1
    stats = FE.extraction_stats(f, ["zz"]).first()
    assert (stats.n, stats.unlocated, stats.low, stats.middle, stats.high, stats.n_rulings, stats.n_lacking) == (4, 0.25, 0, 1, 2, 2, 2)


def test_worst_coverage(spark):
    sized = spark.createDataFrame([(0.1, q, 2 if q < 10 else 1 if q < 19 else 5, int(q % 2)) for q in range(20)] + [(0.2, 1, 0, 1)], "alpha double, query_id int, size int, covered int")
    assert {r.alpha: r.worst_coverage for r in C.coverage_by_size(sized).collect()} == {0.1: pytest.approx(4 / 9)}


def test_incremental_sources(spark, tmp_path):
    """Pages, features and reports written and read back."""
    item = "array<struct<category:string,value:string,evidence:struct<quote:string,start_char:int,end_char:int,confidence:double>>>"
    (tmp_path / "f").mkdir()
    (tmp_path / "f/1.json").write_text('{"ruling_id": "1", "roles": [{"category": "role", "value": "v", "evidence": {"quote": "q", "start_char": 1, "end_char": 2, "confidence": 0.5}}], "facts": [{"category": "fact", "value": "w", "evidence": {}}]}')
    good, _ = S.read_records(spark, str(tmp_path / "f"), S.FEATURES)
    assert sorted((r.category, r.pos, r.value, r.quote) for r in S.flattened_features(good).collect()) == [("fact", 0, "w", None), ("role", 0, "v", "q")] and item in S.FEATURES
    (tmp_path / "p").mkdir()
    (tmp_path / "p/12.html").write_text("<p>a\nb</p>")
    assert [tuple(r) for r in S.read_pages(spark, str(tmp_path / "p")).collect()] == [("12", "<p>a\nb</p>")]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    for kind in ("parquet", "csv", "json"):
        S.write_table(df, str(tmp_path / kind), ["k"], kind)
        assert spark.read.option("header", True).format(kind).load(str(tmp_path / kind)).count() == 2
    assert {(r.status, r.n) for r in GR.load_report(spark.createDataFrame([("new", "civil"), ("new", "civil"), ("error", None)], "status string, case_type string")).collect()} == {("new", 2), ("error", 1)}
    s = GR.sections(spark.createDataFrame([("1", [("x", "t"), ("y", "u")]), ("2", [])], "ruling_id string, sections array<struct<court_level:string,text:string>>"))
    assert [(r.ruling_id, r.section_no, r.court_level) for r in s.orderBy("section_no").collect()] == [("1", 0, "x"), ("1", 1, "y")]


def test_vector_fallback(spark):
    """Queries without an exact hit get the rulings of the nearest nodes, one row a ruling and value."""
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<double>")
    nodes = spark.createDataFrame([(1, "role", "a", [1.0, 0.1]), (2, "role", "b", [0.0, 1.0]), (3, "act", "a", [1.0, 0.0])], "id long, category string, value string, embedding array<double>")
    feats = spark.createDataFrame([(10, "role", "a", "q"), (10, "act", "a", "w"), (11, "act", "a", None), (12, "role", "b", "z")], "ruling_id long, category string, value string, quote string")
    got = [(r.query_id, r["rank"], r.ruling_id, r.value, r.text) for r in CH.feature_fallback(q, spark.createDataFrame([(2,)], "query_id long"), nodes, feats, 2).orderBy("rank").collect()]
    assert got == [(1, 1, 10, "a", "w"), (1, 2, 11, "a", "a")]


FUSION = [
    # verdicts, confidences, citations, prior score, prune ratio -> majority, consensus, final, level, flag, notes, agreed
    ("aaa", (0.90, 0.85, 0.88), "||", 0.5, 0.0, "a", "full", 0.726, "high", False, [], []),
    ("aba", (0.70, 0.60, 0.65), "||", 0.5, 0.0, "a", "majority", 0.59, "medium", False, [], []),
    ("abn", (0.80, 0.80, 0.50), "||", 0.5, 0.0, "neutral", "split", 0.52, "medium", True, ["uncertain"], []),
    ("aaa", (0.70, 0.70, 0.70), "||", 0.8, 0.0, "a", "full", 0.74, "high", False, [], []),
    ("abn", (0.70, 0.70, 0.70), "||", 0.75, 0.0, "neutral", "split", 0.62, "medium", True, ["uncertain"], []),
    ("abn", (0.01, 0.01, 0.01), "||", 0.01, 0.0, "neutral", "split", 0.0, "low", True, ["uncertain"], []),
    ("aaa", (0.75, 0.73, 0.74), "||", 0.5, 0.0, "a", "full", 0.644, "medium", False, [], []),
    ("aaa", (0.95, 0.95, 0.10), "||", 0.5, 0.0, "a", "full", 0.6, "medium", True, ["uncertain"], []),
    ("aaa", (0.70, 0.65, 0.68), "1,2|2,3|3", 0.5, 0.2, "a", "full", 0.606, "medium", False, [], ["2", "3"]),
    ("aaa", (0.70, 0.65, 0.68), "1|2|3", 0.5, 0.5, "a", "full", 0.606, "medium", False, [], []),
    ("nnn", (0.50, 0.50, 0.50), "1,1||", 0.5, 0.7, "n", "full", 0.5, "medium", False, ["pruned"], []),
    ("aaa", (0.90, 0.88, 0.89), "||", 0.9, 0.0, "a", "full", 0.894, "high", False, [], []),
    ("nnn", (0.20, 0.22, 0.21), "||", 0.2, 0.0, "n", "full", 0.206, "low", False, [], []),
    ("aaa", (1.0, 1.0, 1.0), "||", 1.5, 0.9, "a", "full", 1.0, "high", False, ["pruned"], []),
    ("abn", (0.1, 0.9, 0.5), "x|x|x", 0.4, 0.6, "neutral", "split", 0.36, "low", True, ["uncertain", "pruned"], ["x"]),
]


def test_fusion_cases(spark):
    """Every kind of vote, blend, flag, note and agreement, as one table."""
    rows = [(c, i, f"r{i}", v, x, [r for r in cites.split(",") if r]) for c, (vs, confs, allc, *_) in enumerate(FUSION) for i, (v, x, cites) in enumerate(zip(vs, confs, allc.split("|"), strict=True))]
    o = spark.createDataFrame(rows, "case_id int, pos int, role string, verdict string, confidence double, cited_articles array<string>")
    p = spark.createDataFrame([(c, f[3], f[4]) for c, f in enumerate(FUSION)], "case_id int, score double, prune_ratio double")
    got, agreed = {r.case_id: r for r in O.fused(o, p).collect()}, {r.case_id: r for r in O.agreed_refs(o).collect()}
    for c, (vs, _, allc, _, _, *want, refs) in enumerate(FUSION):
        r = got[c]
        assert [r.majority_verdict, r.consensus, r.final_confidence, r.level, r.uncertainty_flag, r.notes] == want, c
        assert agreed[c].agreed == refs and agreed[c].all_cited == sorted({x for x in allc.replace("|", ",").split(",") if x})
        assert agreed[c].verdict_spread == {f"r{i}": v for i, v in enumerate(vs)}


def test_confidence_histogram(spark):
    df = spark.createDataFrame([(0.9,), (0.9,), (0.94,), (None,)], "confidence double")
    assert {r.confidence: (r.n, r.share) for r in FE.confidence_histogram(df).collect()} == {0.9: (2, 0.5), 0.94: (1, 0.25), None: (1, 0.25)}
    assert {r.confidence: r.n for r in FE.confidence_histogram(df, 1).collect()} == {0.9: 3, None: 1} and FE.confidence_histogram(df.limit(0)).count() == 0


def test_gram_counts_by_batches(spark):
    """Counts of words and pairs over several documents: stopwords, one-letter words, nulls, empty and missing arrays, words of other scripts."""
    docs = [["aa", "the", "bb", "aa", "the", "of"], ["aa", "x", "bb"], [], None, ["aa", None, "bb", "bb", "bb"], ["ماده", "é", "éé", "ماده"], ["the"]]
    total, n_docs = {}, {}
    for d in docs:
        d, mine = d or [], []
        ok = lambda t: t is not None and len(t) > 1
        mine += [t for t in d if ok(t) and t not in ("the", "of")]
        mine += [f"{a} {b}" for a, b in zip(d, d[1:]) if ok(a) and ok(b) and not (a in ("the", "of") and b in ("the", "of"))]
        for g in mine:
            total[g] = total.get(g, 0) + 1
        for g in set(mine):
            n_docs[g] = n_docs.get(g, 0) + 1
    df = spark.createDataFrame([(d,) for d in docs], "tokens array<string>").repartition(2)
    assert {r.gram: (r.total, r.n_docs) for r in VO.gram_counts(df, ["the", "of"]).collect()} == {g: (n, n_docs[g]) for g, n in total.items()}
    assert VO.gram_counts(df.limit(0), []).count() == 0
