"""Importance resampling, SimHash components and the filter audit against plain versions, with odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from citeloom.llm.common import Scratch
from citeloom.llm.filter_audit import filter_audit
from citeloom.llm.importance import LONG, RUN, batch_features, crc32_of, importance_resample
from citeloom.llm.simhash import budgets, fingerprint, near_links, simhash_components
from tests.llm.test_operators import DOCS, corpus

#: Null and repeated ids, null, empty and blank texts, ties, one long text and one long word.
ODD = [(None, None, None), (None, None, None), (None, "a b c " * 9, "a"), (1, "", None), (2, "x y", "a"), (2, "x y", "a"), (3, "x  Y", ""), (4, " \n\t", "b"), (5, "Wört " * 30_000, "a"), (6, "z" * 300_000, "b"), (7, "Q#A " * 60, "b"), (8, "Q#A " * 60, "b")]


@pytest.fixture(scope="module")
def rows():
    return [*corpus(), *((1000 + i if d is not None else None, t, s) for i, (d, t, s) in enumerate(ODD))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


# importance resampling


def features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return w, [zlib.crc32(f) % 10_000 for f in (*w, *(a + b" " + b for a, b in zip(w, w[1:])))]


def importance_brute(rows, target):
    held = [(i, *features(t)) for i, t, *_ in rows]
    own, want = collections.Counter(b for _, _, f in held for b in f), collections.Counter(b for t in target for b in features(t)[1])
    s_all, t_all = sum(own.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * float(s_all + 10_000) / ((own[b] + 1) * float(t_all + 10_000))))
    out = []
    for i, w, f in held:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawable = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, drawable[: 25 * len(drawable) // 100]


def test_importance(spark, docs, rows):
    target = ["a b c fa gb", None, "", "Bca DE dd bca", "Wört wört"]
    every, drawn = importance_brute(rows, target)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resample(docs, wanted).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(every, key=str)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [tuple(r)[:5] for r in ranked] == drawn and len(drawn) > 20
    again = importance_resample(docs.repartition(2).withColumn("score", F.lit("own")).withColumn("bucket", F.lit(1)), wanted).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    kept = importance_resample(docs, wanted, keep=("text", "source")).filter("rank <= 3").orderBy("rank").collect()
    texts = collections.Counter((i, t) for i, t, _ in rows)
    assert len(kept) == 3 and all((r.doc_id, r.text) in texts for r in kept)
    with pytest.raises(ValueError, match="rename"):
        importance_resample(docs.withColumnRenamed("doc_id", "rank"), wanted, id_col="rank")


def test_importance_of_copies_and_nothing(spark, docs):
    """Equal rows get ranks one after the other, undrawn ones none; empty tables on either side."""
    wanted = spark.createDataFrame([("a b",)], "text string")
    same = spark.createDataFrame([(5, "a b " * 15)] * 100 + [(None, "c d " * 15)] * 101, "doc_id long, text string")
    got = importance_resample(same, wanted).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51)) and len(got) == 201 and len({r.doc_id for r in got if r["rank"]}) == 1
    assert importance_resample(docs.limit(0), wanted).count() == 0
    assert importance_resample(docs, wanted.limit(0)).filter("rank is not null").count() > 0
    assert importance_resample(same.limit(3), wanted).filter("rank is not null").count() == 0


def test_features_across_runs():
    """More words than a run holds, words over and under the hashed length, and no pair across two texts."""
    words = [f"w{i % 999}" for i in range(RUN + 7)]
    texts = [" ".join(words), "", None, "x" * (LONG - 1) + " " + "y" * LONG + "-" + "é" * LONG, "one", "two"]
    found = [collections.Counter() for _ in texts]
    for _, doc, bucket in batch_features(pa.array(texts), 10_000):
        for d, b in zip(doc.tolist(), bucket.tolist()):
            found[d][b] += 1
    assert found == [collections.Counter(features(t)[1]) for t in texts]
    data = np.frombuffer(b"abcabc", np.uint8)
    assert crc32_of(data, np.array([0, 3, 3]), np.array([3, 6, 3])).tolist() == [zlib.crc32(b"abc"), zlib.crc32(b"abc"), 0]


# SimHash


def fingerprint_brute(text):
    w = (text or "").encode().lower().split()
    shingles = [w[i : i + 4] for i in range(len(w) - 3)] if len(w) > 3 else [w] if w else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_brute(fps, distance=4):
    a, label = np.array(fps, np.uint64), list(range(len(fps)))
    near = [np.flatnonzero(np.bitwise_count(a ^ x) <= distance).tolist() for x in a]
    for start in range(len(fps)):
        todo = [start] if label[start] == start else []
        while todo:
            for j in near[todo.pop()]:
                if label[j] > start:
                    label[j] = start
                    todo.append(j)
    return label


def test_simhash(spark, docs, rows):
    fps = [fingerprint_brute(t) for _, t, _ in rows]
    label, least = linked_brute(fps), {}
    for (i, *_), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = [(i, f"{f:016x}", least.get(c)) for (i, *_), f, c in zip(rows, fps, label)]
    got = simhash_components(docs.withColumn("key", F.lit("x")).withColumn("text2", F.lit(1)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(set(label)) < len(rows) - 20
    assert sorted(map(tuple, simhash_components(docs.repartition(2), block=3).collect()), key=str) == sorted(want, key=str)
    assert simhash_components(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="rename"):
        simhash_components(docs.withColumnRenamed("doc_id", "component_id"), id_col="component_id")


def clusters(centers, members, most, seed=5):
    rng, out = random.Random(seed), set()
    for _ in range(centers):
        center = rng.getrandbits(64)
        for _ in range(members):
            out.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most))))
    return sorted(out)


@pytest.mark.parametrize("block, distance", [(8192, 4), (40, 4), (9, 4), (40, 3), (40, 0)])
def test_links_of_dense_clusters(spark, block, distance):
    """Chains of links through dense clusters, also where keys are cut into blocks and meet block by block."""
    fps = clusters(4, 220, 7)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {r.node: r.component for r in near_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), distance, Scratch(spark, "test"), block).collect()}
    mine, plain = collections.defaultdict(set), collections.defaultdict(set)
    for x, c in zip(fps, linked_brute(fps, distance)):
        mine[got.get(signed(x), signed(x))].add(x)
        plain[c].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, plain.values()))


def test_pigeonring_budgets():
    """A chain within its budgets exists for every way to put four bits on five segments."""
    assert budgets(4) == [0, 1, 2, 3, 4]
    for where in itertools.combinations_with_replacement(range(5), 4):
        bits = [where.count(s) for s in range(5)]
        assert any(all(sum(bits[(i + j) % 5] for j in range(n)) <= budgets(4)[n - 1] for n in range(1, 6)) for i in range(5))
    text = " ".join(f"w{i}" for i in range(40_000))
    assert fingerprint(text.encode()) == fingerprint_brute(text) and fingerprint(b" \n") == 0


# filter audit


def audit_brute(rows, labels):
    least, out = {}, []
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    held = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = dict(A=len(w) < 200, B=100 * len(set(w)) < 50 * len(w), C=100 * len(re.findall("[A-Z]", t)) > 2 * len(t), D=bool(re.search("[#$%&*|]", t)), E=i is not None and i > least[t])
        held.append((s or "", fails, i in good, i in toxic))
    for part in {p for p, *_ in held}:
        mine, shapley, steps = [h[1:] for h in held if h[0] == part], collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [h for h in alive if h[0][f]]
                alive = [h for h in alive if not h[0][f]]
                failing = sum(h[0][f] for h in mine)
                only = sum(h[0][f] and sum(h[0].values()) == 1 for h in mine)
                steps.append((f, (part, "".join(order), step, len(alive), len(gone), failing - len(gone), only, sum(h[1] for h in gone), sum(h[2] for h in gone))))
                shapley[f] += len(gone)
        out += [(*r, shapley[f]) for f, r in steps]
    return out


def test_filter_audit(spark, docs, rows):
    rng = random.Random(4)
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i, *_ in rows if rng.random() < 0.6] + [(None, 1, 1), (999_999, 1, 1), (2, 0, 1), (2, 1, 0), (3, None, None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = sorted(audit_brute(rows, labels))
    assert sorted(map(tuple, filter_audit(docs, marks).collect())) == want and len({r[0] for r in want}) >= 5
    clash = docs.withColumn("row", F.lit("x")).withColumn("part", F.lit("y")).withColumn("done", F.lit(3)).withColumn("kept", F.lit(1)).repartition(2)
    assert sorted(map(tuple, filter_audit(clash, marks).collect())) == want
    assert filter_audit(docs.limit(0), marks).count() == 0
    none = filter_audit(docs, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("removed")).first()
    assert tuple(none)[:2] == (0, 0) and none[2] == sum(r[4] for r in want)


def test_audit_of_clean_parts(spark):
    """A part where nothing fails has rows of zeros, with all kept."""
    text = " ".join(f"w{i}" for i in range(250))
    got = filter_audit(spark.createDataFrame([(1, text, "s"), (2, text + " more", "s")], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600 and all((r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) == (2, 0, 0, 0, 0) for r in got)


def test_audit_sends_no_rows_through_the_driver(spark, docs, rows):
    """Tables of rows are never broadcast, however small their files are: only the orders are."""
    plans = []

    class Told(Scratch):
        def stored(self, df, name, compression="zstd"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().stored(df, name, compression)

    marks = spark.createDataFrame([(r[0], i % 2, 1) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    out = filter_audit(docs, marks, scratch=Told(spark, "told"))
    assert len(plans) > 8 and not any("Broadcast" in x for x in plans)
    assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1
