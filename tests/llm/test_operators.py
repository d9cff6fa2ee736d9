"""Every operator against brute force on small tables, with nulls, empty texts, repeats and clashing columns."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.llm.common import Scratch, shared_dir
from citeloom.llm.components import components
from citeloom.llm.licenses import PHRASES, TEMPLATES, Index, Templates, _words, scan_licenses
from citeloom.llm.mixing import LANDING, flight, large_first, mixed, mixed_rows
from citeloom.llm.ngram_join import jaccard_components, without_copies
from citeloom.llm.packing import best_fit, packed, pieces
from citeloom.llm.quality_model import fit_additive, quality_scores
from citeloom.llm.quality_rules import kept_rows, labelled_sample, learn_rules, quality_rules
from citeloom.llm.sharding import bucket_of, sharded
from citeloom.llm.substring_dedup import remove_repeats
from citeloom.llm.token_files import read_token_files, token_counts, token_places, write_token_files
from citeloom.llm.topk import top_k
from citeloom.llm.wavelet import BLOCK, WaveletMatrix, build

DOCS = "doc_id long, text string, source string"
TOKENIZERS = pytest.importorskip("public_tokenizers")
PATH = TOKENIZERS.path("word_bpe_49k.json")


def corpus(n=120, seed=3):
    """Texts with copies, near copies, shared passages, a long one, and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage, base, rows = text(60), text(90), []
    for i in range(n):
        kind = i % 6
        t = text(rng.randint(0, 120))
        if kind == 1:
            t = base
        elif kind == 2:
            w = base.split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 3:
            t = f"{t[: len(t) // 2]} {passage}\n{t[len(t) // 2 :]}"
        rows.append((i, t, f"s{i % 3}" if i % 5 else None))
    return [*rows, (n, None, None), (n + 1, "", "s0"), (n + 2, " \n\t ", "s1"), (n + 3, text(9000), "s2"), (n + 4, "One two", "s1"), (n + 5, "one TWO", "s1")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


ODD = [(None, None, None), (None, None, None), (1, "", None), (2, "x y", "a"), (2, "x y", "a"), (3, "x  Y", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_substring_dedup(docs, rows):
    k = 35
    words = {i: (t or "").encode().split() for i, t, _ in rows}
    seen = collections.Counter(tuple(w[i : i + k]) for w in words.values() for i in range(len(w) - k + 1))
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert len(got) == len(rows)
    for i, w in words.items():
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if seen[tuple(w[a : a + k])] > 1:
                gone[a : a + k] = [True] * k
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
        covered = [p for s in got[i].removed_spans for p in range(s.start, s.end)]
        assert covered == [p for p, g in enumerate(gone) if g]


def test_substring_dedup_small_chunks_and_clashes(docs, odd):
    a = sorted(map(tuple, remove_repeats(docs, chunk_bytes=200).select("doc_id", "n_removed", "kept_text").collect()), key=str)
    assert a == sorted(map(tuple, remove_repeats(docs).select("doc_id", "n_removed", "kept_text").collect()), key=str)
    r = remove_repeats(odd.withColumn("n_words", F.lit("x")).withColumn("chunk_id", F.lit(7)), window=2)
    assert sorted((x.n_words, x.n_removed, x.chunk_id) for x in r.collect()) == [(0, 0, 7)] * 3 + [(2, 0, 7), (2, 2, 7), (2, 2, 7)]
    assert remove_repeats(odd.limit(0)).count() == 0


def test_sharding(docs, rows, odd):
    got = sharded(docs, 7).collect()
    text = {i: (t or "").encode() for i, t, _ in rows}
    assert sorted(r.doc_id for r in got) == sorted(text)
    slots = collections.defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(7)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {r.doc_id: (r.shard, r.slot) for r in sharded(docs.repartition(2), 7).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}
    a = sorted(tuple(r) for r in sharded(odd, 4).select("size", "text_crc32", "shard", "slot", "place").collect())
    assert sorted(r[4] for r in a) == list(range(6)) and sharded(odd.limit(0), 4).count() == 0
    assert sorted((s, c) for s, c, *_ in a) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in ODD)
    assert all((p % 4, p // 4) == (h, s) for _, _, h, s, p in a)
    clash = docs.withColumn("row_number", F.lit("x")).withColumn("place", F.lit("y"))
    assert {r.doc_id: (r.shard, r.slot) for r in sharded(clash, 7).collect()} == again
    with pytest.raises(ValueError, match="rename"):
        sharded(docs.withColumnRenamed("doc_id", "size"), 4, id_col="size")


def test_permutation_is_a_feistel_network(spark):
    """The places against a plain Feistel network with the same round function, walked until they are in range."""
    n, seed = 101, 17
    side_a, side_b = 11, 10
    assert side_a * side_b >= n
    table = {(r, x): h for r in range(6) for x, h in enumerate(row.h for row in spark.range(side_a).select(F.xxhash64(F.lit(seed), F.lit(r), F.col("id")).alias("h")).collect())}

    def once(x):
        left, right = divmod(x, side_b)
        for r in range(6):
            if r % 2 == 0:
                left = (left + table[r, right] % side_a) % side_a
            else:
                right = (right + table[r, left] % side_b) % side_b
        return left * side_b + right

    def walk(x):
        x = once(x)
        while x >= n:
            x = once(x)
        return x

    got = sharded(spark.range(n).selectExpr("id doc_id", "'' text"), 3).collect()
    assert all(r.place == walk(r.row_number) for r in got)


def test_numbers_of_a_hot_id(spark):
    """An id with most of the rows is dealt in pieces; numbers stay gapless."""
    from citeloom.llm.sharding import numbered

    df = spark.range(1000).selectExpr("if(id < 700, null, id) doc_id", "cast(id % 2 as long) size")
    rows = numbered(df, F.col("doc_id"), [F.col("size")], buckets=8, piece=32).collect()
    assert sorted(r.row_number for r in rows) == list(range(1000)) and sum(r.doc_id is None for r in rows) == 700


@pytest.mark.parametrize("n", [1, 2, 3, 6, 50, 101])
def test_permutation(spark, n):
    assert sorted(r.place for r in sharded(spark.range(n).selectExpr("id doc_id", "'' text"), 3).collect()) == list(range(n))


def test_top_k(spark):
    g = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in g.integers(-2, 3, 4) / 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(df, df.filter("vec_id % 20 = 0"), candidate_rows=37, query_rows=4).collect()))
    v = np.array([[math.floor(64 * x) for x in r[1]] for r in rows])
    want = []
    for q in range(0, 200, 20):
        s = v @ v[q]
        best = sorted((-int(s[i]), i) for i in range(200) if i != q)[:20]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(best)]
    assert got == sorted(want)
    nan = float("nan")
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (None, [1.0]), (5, [1e12, 1e12]), (6, [-3.0]), (7, [])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k(few, few.filter("vec_id % 20 = 0"), 3).orderBy("rank").collect()] == [(0, 1, 5, 64 * 64 * 3 * 10**12), (0, 2, 1, 20480), (0, 3, 7, 0)]
    assert top_k(few.limit(0), few).count() == 0 and top_k(few, few.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    """Large finite components take part exactly; what no long can hold is an error, never a wrong score."""
    big = spark.createDataFrame([(0, [1.0]), (1, [2.0**48]), (2, [-(2.0**48)]), (3, [2.0**47 + 1])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in top_k(big, big.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 64 * 2**54), (3, 64 * (2**53 + 64)), (2, -64 * 2**54)]
    for rows in ([(0, [1e300]), (1, [1.0])], [(0, [2.0**40]), (1, [2.0**40])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="too large|does not fit"):
            top_k(df, df.filter("vec_id = 0")).collect()
    same = spark.createDataFrame([(i % 3, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<double>").withColumn("block", F.lit("x"))
    got = top_k(same, same.filter("vec_id = 0"), 5, candidate_rows=16).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got)] == [(i, 1, 20480) for i in range(1, 6)]


def test_mixing(docs, rows, odd):
    size = {i: len((t or "").encode().split()) for i, t, _ in rows}
    per = collections.Counter()
    for i, _, s in rows:
        per[s] += size[i]
    order = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        free = sum(per.values()) - sum(3 * per[s] for s in capped)
        target = {s: 3.0 * per[s] if s in capped else free * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * per[s]}
        if not over:
            break
        capped |= over
    got = mixed(docs, block_rows=64, fan_in=2).collect()
    taken = collections.Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == per[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        # what any choice must miss where one document is most of a source, and a landing within a few words or 0.2 % beyond it
        most, due = max(r.size for r in got if r.source == s), (target[s] / per[s] - int(target[s] / per[s] + 1e-9)) * per[s]
        least = min(abs(due - t * most - min(max(due - t * most, 0), per[s] - most)) for t in (0, 1))
        assert abs(taken[s] - target[s]) <= least + max(0.002 * target[s], 12)
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in mixed(docs.repartition(3), block_rows=64, fan_in=2).collect())
    copies = {r.doc_id: r.copies for r in mixed(docs).collect()}
    assert collections.Counter(r.doc_id for r in mixed_rows(docs).collect()) == {i: c for i, c in copies.items() if c}
    got = sorted(((r.doc_id, r.size, r.source_size, r.copies <= 3) for r in mixed(odd).collect()), key=str)
    assert got == sorted([(None, 0, 0, True), (None, 0, 0, True), (1, 0, 0, True), (2, 2, 6, True), (2, 2, 6, True), (3, 2, 6, True)], key=str)
    assert mixed(odd.limit(0)).count() == 0 and mixed(odd.withColumn("prob", F.lit("x")).withColumn("size", F.lit("y"))).count() == 6
    many = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert mixed(many, block_rows=16, fan_in=2).count() == len(rows)


@pytest.mark.parametrize("seed", range(8))
def test_large_documents_first(seed):
    """Documents far above the mean are 0 or 1 after their steps; the words due stay the same."""
    g = np.random.default_rng(seed)
    size = np.concatenate((g.integers(50, 400, 900), [20_000, 12_000, 9_000])).astype(float)
    for p in (0.1, 0.37, 0.9):
        prob = np.full(len(size), p)
        out, waiting = large_first(size, prob, np.random.default_rng(seed))
        assert ((out >= 0) & (out <= 1)).all() and set(out[-3:]) <= {0.0, 1.0} and not waiting.any()
        # of documents they give up a few only where the others cannot make up for both
        assert abs(out @ size - prob @ size) < 1e-6 * size.sum() and abs(out.sum() - prob.sum()) < 12


@pytest.mark.parametrize("seed", range(6))
def test_flight_decides_all_but_the_landing(seed):
    """On sizes with a heavy tail the flight leaves at most the landing open, and words and documents unchanged; draws are fair."""
    g = np.random.default_rng(seed)
    size = np.sort(np.exp(g.normal(5, 1.5, 700)).round())[::-1].copy()
    prob, rest = np.full(700, 0.3), LANDING - 2
    late = np.linspace(700 // 6, 699, rest).astype(int)
    size = np.concatenate((np.delete(size, late), size[late]))
    rng = np.random.default_rng(seed)
    out = flight(size, large_first(size, prob, rng)[0], rng, rest)
    assert np.sum((out > 0) & (out < 1)) <= LANDING
    assert abs(out @ size - prob @ size) < 1e-5 * size.sum() and abs(out.sum() - prob.sum()) < 1e-5 * 700
    tries = [large_first(size, prob, np.random.default_rng(i))[0][0] for i in range(200)]
    assert 0.2 < np.mean(tries) < 0.4


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mix_of_the_driver_tables(spark, sf):
    """Every source of the driver's documents, also those with one huge text, comes within 0.2 % of its words and two documents of its copies."""
    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no driver tables")
    per = mixed(spark.read.parquet(path)).groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"), F.sum("copies").alias("copies"), (F.count(F.lit(1)) * F.max("target") / F.max("source_size")).alias("due")).collect()
    assert all(abs(r.taken - r.target) <= 0.002 * r.target and abs(r.copies - r.due) <= 2 for r in per)


def test_mix_of_rows_without_ids(spark, tmp_path):
    """A third of all ids null, some repeated: each source's rows come near its target, and another partitioning takes the same texts."""
    rng = random.Random(8)
    rows = [(i if i % 3 else None, " ".join("w" * rng.randint(1, 3) for _ in range(int(rng.expovariate(1 / 60)) + 1)), f"s{i % 4}") for i in range(2400)]
    rows += [(None, "one two three", "s1")] * 150 + [(5, "four five", "s2")] * 90
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    target = {r.source: r.target for r in mixed(df, block_rows=200).groupBy("source").agg(F.max("target").alias("target")).collect()}
    taken = lambda d: collections.Counter((r.source, r.text) for r in mixed_rows(d, block_rows=200).collect())
    got, words = taken(df), collections.Counter()
    for (source, text), n in got.items():
        words[source] += n * len(text.split())
    assert all(abs(words[s] - t) <= 0.002 * t + 2 for s, t in target.items())
    df.write.parquet(f"{tmp_path}/d")
    assert got == taken(df.repartition(2)) == taken(spark.read.parquet(f"{tmp_path}/d"))


def test_one_of_several_copies_without_ids(spark):
    """Near copies of which most have no id: one stays; exact copies under one id too."""
    words = [f"w{i}" for i in range(120)]
    near = lambda at: " ".join("x" if i == at else w for i, w in enumerate(words))
    rows = [(None, near(5), "a"), (None, near(50), "a"), (9, near(90), "a"), (None, near(50), "a"), (4, "p q r s t", "a"), (4, "p q r s t", "a"), (None, "u v", "b"), (None, None, "b")]
    got = sorted(((r.doc_id, r.text) for r in without_copies(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(9, near(90)), (4, "p q r s t"), (None, "u v"), (None, None)], key=str)


def test_buckets_of_rows_without_ids(spark):
    """Unlike texts under a null id are spread over the buckets that number the rows."""
    df = spark.range(20_000).selectExpr("if(id < 15000, null, id) doc_id", "crc32(cast(id as string)) c", "id % 50 size")
    counts = [r["count"] for r in df.groupBy(bucket_of(F.col("doc_id"), [F.col("c"), F.col("size")], 64).alias("b")).count().collect()]
    assert len(counts) == 64 and max(counts) <= 2 * 20_000 / 64


def shingles(text, k=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def jaccard_brute(rows, percent=85):
    sets, root = [(i, shingles(t)) for i, t, _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(i, least.get(find(n), i))
    return {i: (len(s), least[find(n)]) for n, (i, s) in enumerate(sets)}


@pytest.mark.parametrize("options", [{}, {"near_rounds": 0, "block": 5}])
def test_ngram_join(docs, rows, options):
    want = jaccard_brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, **options).collect()} == want


def test_ngram_join_odd(docs, rows, odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(odd).collect()), key=str)
    assert got == sorted([(None, 0, None), (None, 0, None), (1, 0, 1), (2, 1, 2), (2, 1, 2), (3, 1, 2)], key=str)
    assert sorted((r.doc_id for r in without_copies(odd).collect()), key=str) == [1, 2, None, None]
    want = {c for _, c in jaccard_brute(rows).values()}
    assert {r.doc_id for r in without_copies(docs).collect()} == want
    assert jaccard_components(odd.limit(0)).count() == 0


def test_components_that_do_not_settle(spark):
    with pytest.raises(RuntimeError, match="settled"):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"), most_rounds=2)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, 5), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def base_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = [False] * len(w)
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit)


def test_quality_rules(spark, docs, rows, odd):
    rng = random.Random(1)
    noisy = [(1000 + i, " ".join(rng.choice(["aa#", "b$$", "cé&", "d"]) for _ in range(40)) + "\nx\nx", "s") for i in range(60)]
    good = [(2000 + i, " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 99)}" for _ in range(50)), "s") for i in range(120)]
    every = spark.createDataFrame([*rows, *noisy, *good], DOCS)
    labels = spark.createDataFrame([(i, 0, 0) for i, _, _ in noisy[:40]] + [(i, 1, 0) for i, _, _ in good[:90]] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(every, labels).collect()}
    for i, t, _ in [*rows, *noisy, *good]:
        s = base_stats(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == s
        assert got[i].base_failed == (s[0] < 10 or 100 * s[4] > 20 * s[0]) and not (got[i].base_failed and got[i].kept)
    assert not any(got[i].kept for i, _, _ in noisy) and all(got[i].kept for i, _, _ in good)
    clash = every.withColumn("n_words", F.lit("mine")).withColumn("rule", F.lit(5))
    assert {r.doc_id for r in kept_rows(clash, labels).collect()} == {i for i, r in got.items() if r.kept}
    none = labels.limit(0)
    assert sorted(r.kept for r in quality_rules(odd, none).collect()) == [False] * 6 and quality_rules(odd.limit(0), none).count() == 0


def test_decision_list():
    g = np.random.default_rng(0)
    x = {"a": g.random(900), "b": g.random(900)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["a"] < 0.5))
    rules = learn_rules(x, bad, ("a", "b"))
    hit = np.zeros(900, bool)
    for rule in rules:
        hit |= np.logical_and.reduce([t.holds(x) for t in rule])
    assert (hit == bad).mean() > 0.97 and learn_rules(x, np.zeros(900, bool), ("a", "b")) == []


def test_licenses(spark, rows, odd):
    texts = ["Under THE mit-license! under the MIT license", "Released under the MIT License.", "cc-by,nc 4", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved", "rights reserved all", "Licensed under CC BY-NC 4.0. x", "ab licensed apache", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files, to deal in the software without restriction"]
    every = [*rows, *((500 + i, t, "s") for i, t in enumerate(texts))]
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(every, DOCS)).collect()}
    for i, t, _ in every:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        starts = [(a, label) for p, label in PHRASES.items() for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
        base, found = {x for _, x in starts}, []
        for label, template in TEMPLATES:
            found += [(label, *m) for m in blocks_brute(w, template.split(), 0.9, 1.5)]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(starts), min((a for a, _ in starts), default=None), max((a for a, _ in starts), default=None))
        assert sorted((m.label, m.first_word, m.end_word, round(m.containment, 9)) for m in r.matches) == sorted((k, a, b, round(x, 9)) for k, a, b, x in found)
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(base | {m[0] for m in found}))) and abs(r.score - (1.0 if base else max((m[3] for m in found), default=0.0))) < 1e-12
    got = sorted(((r.doc_id, r.n_words, r.labels, r.score, r.matches) for r in scan_licenses(odd.withColumn("labels", F.lit(1))).collect()), key=str)
    assert got == sorted([(None, 0, "", 0.0, []), (None, 0, "", 0.0, []), (1, 0, "", 0.0, []), (2, 2, "", 0.0, []), (2, 2, "", 0.0, []), (3, 2, "", 0.0, [])], key=str)
    assert scan_licenses(odd.limit(0)).count() == 0


def blocks_brute(w, template, threshold, stretch):
    """Every block of a text around every place of a template word that holds enough; overlapping ones as one."""
    own, span, out = set(template), math.ceil(len(template) * stretch), []
    for a in range(len(w)):
        if w[a] in own:
            ends = [b for b in range(a, min(len(w), a + span)) if w[b] in own]
            share = len({w[b] for b in ends}) / len(own)
            if len({w[b] for b in ends}) >= math.ceil(threshold * len(own) - 1e-9):
                if out and a < out[-1][1]:
                    out[-1] = (out[-1][0], max(out[-1][1], ends[-1] + 1), max(out[-1][2], share))
                else:
                    out.append((a, ends[-1] + 1, share))
    return out


def test_license_tables(spark):
    """Templates as a table of random word sets; every place in long texts; several scans give what one gives."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    table = [(f"t{k}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for k in range(40)] + [("none", ""), ("null", None)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 40, 600]))) + " " + " ".join(rng.choice(table[:40])[1] for _ in range(4))) for i in range(30)]
    docs, templates = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(table, "label string, words string")
    want = {i: sorted((label, a, b, round(x, 9)) for label, t in table if t for a, b, x in blocks_brute(text.split(), t.split(), 0.75, 1.5)) for i, text in texts}
    for most in (2_000_000, 30):
        got = {r.doc_id: sorted((m.label, m.first_word, m.end_word, round(m.containment, 9)) for m in r.matches) for r in scan_licenses(docs, templates=templates, threshold=0.75, most_words=most).collect()}
        assert got == want
    many = [(f"m{k}", " ".join(f"{rng.choice('abc')}{rng.randrange(4000)}" for _ in range(rng.randint(3, 9)))) for k in range(10_000)]
    texts = [(i if i % 3 else None, " ".join(rng.choice(many)[1] for _ in range(3))) for i in range(20)]
    docs, templates = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(many, "label string, words string").repartition(3)
    got = [sorted((r.doc_id or 0, r.n_words, r.labels) for r in scan_licenses(docs, templates=templates, most_words=most).collect()) for most in (2_000_000, 25_000)]
    assert got[0] == got[1] and all(n for _, n, _ in got[0]) and all(len(labels.split(",")) >= 3 for *_, labels in got[0])
    forty = spark.createDataFrame([(1, "x " * 50 + ("all rights reserved " + "y " * 9) * 40)], "doc_id long, text string")
    assert len(scan_licenses(forty).first().matches) == 40


def test_license_positions():
    """The positional filter: meetings it rules out are counted, pairs of a text and a template go, and no block is lost."""
    rng = random.Random(4)
    words = [f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(5000)]
    table = [(f"t{k}", " ".join(words[i : i + rng.randint(4, 12)])) for k, i in enumerate(range(0, 2400, 60))]
    thin = lambda w: [x if rng.random() < 0.3 else f"p{rng.randrange(900)}" for x in w]
    texts = [" ".join([*thin(words[i : i + 100]), *words[i + 100 : i + 150], *thin(words[i : i + 100])]) for i in range(0, 5000, 150)]
    known, batch = Templates.of(table, 1.5), _words(pa.array(texts))
    number = known.numbers(batch.hash)
    place = np.flatnonzero(number >= 0)
    text_of = np.searchsorted(batch.at, place, side="right") - 1
    index = Index(known, collections.Counter(number[place].tolist()), 0.8)
    text, template, _, ruled_out = index.met(text_of, place, number[place])
    every = {(t, k) for t, w in zip(text_of.tolist(), number[place].tolist(), strict=True) for k in index.template[index.first[w] : index.first[w + 1]].tolist()}
    left = set(zip(text.tolist(), template.tolist(), strict=True))
    assert ruled_out > 100 and left < every
    got = [sorted((m["label"], m["first_word"], m["end_word"], m["containment"]) for m in f) for f in index.found(batch, len(texts))]
    assert got == [sorted((label, *m) for label, t in table for m in blocks_brute(w.split(), t.split(), 0.8, 1.5)) for w in texts] and sum(map(len, got)) > 5
    # three of four words, within six: r alone in reach; r among words of an earlier rank only; r with two later ones
    known, batch = Templates.of([("t", "r a b c"), ("u", "q a b c")], 1.5), _words(pa.array(["r x x x x x a b c", "q q r q q", "x r a b y"]))
    often = dict(zip(known.numbers(_words(pa.array(["q r a b c"])).hash).tolist(), (5, 6, 9, 9, 9), strict=True))
    index, number = Index(known, often, 0.75), known.numbers(batch.hash)
    place = np.flatnonzero(number >= 0)
    text, template, _, ruled_out = index.met(np.searchsorted(batch.at, place, side="right") - 1, place, number[place])
    assert {(t, known.labels[k]) for t, k in zip(text.tolist(), template.tolist(), strict=True)} == {(0, "t"), (0, "u"), (1, "u"), (2, "t")} and ruled_out >= 2
    assert [sorted(m["label"] for m in f) for f in index.found(batch, 3)] == [["t", "u"], [], ["t"]]


def encoded(rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for i, x, _ in rows}


def test_token_files(docs, rows, odd):
    ids, want, at = encoded(rows, 1), [], 0
    for i in sorted(ids):
        want.append((i, at, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        at += len(ids[i])
    files = write_token_files(docs, PATH, shard_bytes=3000, partitions=3)
    assert files.count() > 3
    got = read_token_files(files, docs.schema["doc_id"])
    assert sorted(tuple(r)[:4] for r in got.collect()) == want
    again = read_token_files(write_token_files(odd, PATH), odd.schema["doc_id"])
    assert sorted(r.start for r in again.collect()) == [0, 1, 2, 3, 6, 9]
    assert read_token_files(write_token_files(odd.limit(0), PATH), odd.schema["doc_id"]).count() == 0


def test_lookup_in_token_files(docs, rows):
    """Counts and places of ids from the files' rank and select, against the ids themselves."""
    ids = encoded(rows, 1)
    files, field = write_token_files(docs, PATH, shard_bytes=3000, partitions=3), docs.schema["doc_id"]
    often = collections.Counter(x for v in ids.values() for x in v.tolist())
    tokens = (1, 0, 49_151, 70_000, *(t for t, _ in often.most_common(5)), *(t for t, _ in often.most_common()[-5:]))
    assert {r.token: r.n for r in token_counts(files, tokens).collect()} == {t: often[t] for t in tokens}
    want = sorted((i, t, p) for i, v in ids.items() for t in set(tokens) for p in np.flatnonzero(v == t).tolist())
    assert sorted(map(tuple, token_places(files, field, tuple(set(tokens))).collect())) == want


@pytest.mark.parametrize("n, top", [(0, 5), (1, 1), (7, 3), (BLOCK - 1, 2), (BLOCK, 50), (BLOCK + 9, 70_000), (3 * BLOCK, 4)])
def test_wavelet(n, top):
    g = np.random.default_rng(n)
    ids = (g.integers(0, top, n) * g.integers(0, 2, n)).astype(np.uint32)
    file = build(ids, pa.table({"n_tokens": pa.array([n])}))
    w = WaveletMatrix(file)
    assert w.n == n and w.unpacked == 0 and w.texts["n_tokens"].to_pylist() == [n]
    for i in g.integers(0, n, min(n, 20)).tolist():
        assert w.access(i) == ids[i]
    assert w.unpacked <= w.bits * w.n_blocks
    for t in {0, 1, top, int(ids[0]) if n else 0, 1 << 20}:
        at = np.flatnonzero(ids == t)
        assert w.count(t) == len(at) and w.places(t).tolist() == at.tolist() and w.select(t, len(at)) == -1 == w.select(t, -1)
        assert all(w.select(t, k) == at[k] for k in {0, len(at) // 2, len(at) - 1} if len(at)) and w.places(t, 1, 2).tolist() == at[1:3].tolist()
        assert all(w.rank(t, i) == int((ids[:i] == t).sum()) for i in {0, n // 3, n})
    assert w.all().tolist() == ids.tolist()
    if n > 2 * BLOCK:
        one = WaveletMatrix(file)
        one.access(5)
        assert one.unpacked <= 2 * one.bits  # a block or two a plane, not the file


@pytest.mark.parametrize("block", [16384, 20])
def test_packing(docs, rows, odd, block):
    ids, want = encoded(rows, 0), {}
    for i, x in ids.items():
        for p, a in enumerate(range(0, len(x), 256)):
            want[i, p] = (a, len(x[a : a + 256]), zlib.crc32(x[a : a + 256].tobytes()))
    got = packed(pieces(docs, PATH, capacity=256), capacity=256, full=250, block_rows=block).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= 256
    assert len(bins) <= 1.03 * len(best_fit(np.array([v[1] for v in want.values()]), 256)[2]) + 2
    got = packed(pieces(odd.withColumn("bin", F.lit("x")).withColumn("length", F.lit(1)), PATH)).collect()
    assert sorted((str(r.doc_id), r.piece, r.length) for r in got) == sorted([("None", 0, 1), ("None", 0, 1), ("1", 0, 1), ("2", 0, 3), ("2", 0, 3), ("3", 0, 3)])
    assert len({r.sequence_id for r in got}) == 1 and sorted(r.offset for r in got) == [0, 3, 6, 9, 10, 11]
    assert packed(pieces(odd.limit(0), PATH)).count() == 0
    with pytest.raises(ValueError, match="rename"):
        pieces(odd.withColumnRenamed("doc_id", "piece"), PATH, id_col="piece")


def test_additive_model(spark, odd):
    g = np.random.default_rng(4)
    x = g.random((3000, 4))
    y = ((x[:, 0] > 0.6) | ((x[:, 1] > 0.5) != (x[:, 2] > 0.5)) & (x[:, 3] > 0.3)).astype(float)
    m = fit_additive(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= 0.5) == (y[2000:] == 1)).mean() > 0.9
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["aa#", "b$$", "c&"]) if i % 3 == 0 else rng.choice(["one", "two", "three", "four"]) for _ in range(30)), "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = quality_scores(spark.createDataFrame(rows, DOCS), labels).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.held_out)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted((r.doc_id, r.score) for r in quality_scores(spark.createDataFrame(rows, DOCS), flipped).collect()) == sorted((r.doc_id, r.score) for r in got)
    assert sorted(((r.doc_id, r.held_out, r.score, r.predicted) for r in quality_scores(odd.withColumn("score", F.lit("x")), labels.limit(0)).collect()), key=str) == sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, 0.5, 1) for i, _, _ in ODD), key=str)
    assert quality_scores(odd.limit(0), labels).count() == 0


def test_sample_of_labels(spark):
    """One row an id however many documents share it, and none of an id with unlike labels."""
    docs = spark.createDataFrame([(1, f"a b {i}") for i in range(500)] + [(2, "c"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (9, 1)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", "doc_id", "text", 100).select("__id", "n_words", "__row.__label").collect()
    assert sorted(map(tuple, got)) == [(1, 3, 1), (3, 0, 0)]


@pytest.mark.parametrize("threshold, held", [(0.3, True)])
def test_quality_of_the_driver_tables(spark, threshold, held):
    """Held-out labels of the driver's documents: the classifier ranks them, and the learned rules agree with most."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no driver tables")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r.doc_id: r for r in quality_scores(docs, labels, threshold=threshold).collect()}
    y = [(r.quality, out[r.doc_id].score) for r in labels.collect() if out[r.doc_id].held_out == held]
    good, bad = [s for q, s in y if q == 1], [s for q, s in y if q == 0]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad) > 0.98
    # rules learned without the held-out labels
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    kept = {r.doc_id: r for r in quality_rules(docs, labels.filter(fold != 0)).collect()}
    told = [(r.quality, kept[r.doc_id]) for r in labels.filter(fold == 0).collect()]
    assert sum(k.kept for q, k in told if q == 0) <= 0.1 * sum(q == 0 for q, _ in told)
    assert sum(not k.kept and not k.base_failed for q, k in told if q == 1) <= 0.02 * sum(q == 1 for q, _ in told)


def test_scratch(spark):
    """A scratch removes its own tables only, and the session's batch size comes back."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    a, b = Scratch(spark, "x"), Scratch(spark, "x")
    one, two = a.stored(spark.range(3), "t"), b.stored(spark.range(4), "t")
    a.remove()
    assert two.count() == 4 and a.path != b.path and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        one.collect()
    assert shared_dir(spark) in b.path


def test_long_texts(spark):
    """One text of megabytes and one word of a megabyte go through the operators that no pipeline stage covers."""
    long = " ".join(f"w{i % 5000}" for i in range(300_000)) + " all rights reserved"
    rows = [(1, long), (2, "z" * 1_000_000), (3, "all rights reserved"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("x")).withColumn("part", F.lit("y"))
    size = {i: len((t or "").encode()) for i, t in rows}
    assert {r.doc_id: (r.size, r.text_crc32) for r in sharded(docs, 2).collect()} == {i: (size[i] + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    found = {r.doc_id: (r.n_words, [(m.first_word, m.end_word) for m in r.matches]) for r in scan_licenses(docs).collect()}
    assert found == {1: (300_003, [(300_000, 300_003)]), 2: (1, []), 3: (3, [(0, 3)]), 4: (0, [])}
    ids = encoded([(i, t, None) for i, t in rows], 1)
    read = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in read_token_files(write_token_files(docs, PATH), docs.schema["doc_id"]).collect()}
    assert read == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()}
    scores = {r.doc_id: r.score for r in quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert scores == dict.fromkeys((1, 2, 3, 4), 0.5)
