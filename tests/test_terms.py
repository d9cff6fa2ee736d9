"""The term trie against brute force, its way for large vocabularies, and masking against a regular expression."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators.terms import leftmost_longest, term_places, without_terms

WORDS = list("abcd")


def brute(tokens, terms):
    runs = {tuple(t.split()) for t in terms if t and t.split()}
    return sorted((" ".join(r), len(r), i) for r in runs for i in range(len(tokens or ())) if tuple(tokens[i : i + len(r)]) == r)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(2)
    run = lambda n: [rng.choice(WORDS) for _ in range(n)]
    terms = ["", "  ", None, "a", "a  b", *(" ".join(run(rng.randint(1, 5))) for _ in range(30)), "a a a a a a a a a a a a"]
    rows = [(i, run(rng.randint(0, 40))) for i in range(60)] + [(100, None), (101, []), (None, ["a", None, "b"]), (None, ["a", "b"]), (102, ["a"] * 300), (103, ["", "a", "zz"])]
    return rows, terms, spark.createDataFrame(rows, "id long, tokens array<string>"), spark.createDataFrame([(t,) for t in terms], "raw string")


@pytest.mark.parametrize("most_tokens", [2_000_000, 0])
def test_places(case, most_tokens):
    """Overlaps, runs within runs, null tokens, equal keys: the same by the trie and by the join of runs."""
    rows, terms, df, vocab = case
    got = sorted(((r.gram, r.n, r.first, r.id) for r in term_places(df, vocab, ["id"], most_tokens=most_tokens).collect()), key=str)
    assert got == sorted(((*x, i) for i, t in rows for x in brute(t, terms)), key=str)


def test_nothing(spark, case):
    _, _, df, vocab = case
    for most in (10, 0):
        assert term_places(df, vocab.limit(0), ["id"], most_tokens=most).count() == 0
        assert term_places(df.limit(0), vocab, ["id"], most_tokens=most).count() == 0
    assert without_terms(df, []).filter("not (masked <=> tokens)").count() == 0


def test_many_long_terms(spark):
    """100,000 terms of up to 12 tokens; every place of every one, and no row that is not a term's."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    terms = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 12))) for _ in range(100_000)]
    used = [[t for x in rng.sample(terms, 4) for t in (*x.split(), rng.choice(words))] for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(used)), "id long, tokens array<string>")
    out = term_places(df, spark.createDataFrame([(t,) for t in terms], "raw string"), ["id"])
    known = set(terms)
    want = {(i, " ".join(t[a:b]), a) for i, t in enumerate(used) for a in range(len(t)) for b in range(a + 2, min(a + 12, len(t)) + 1) if " ".join(t[a:b]) in known}
    got = [(r.id, r.gram, r.first) for r in out.collect()]
    assert len(got) == len(set(got)) >= 200 and set(got) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_masked(spark, case):
    """Leftmost, then longest, as a regular expression with the longest phrases first has it; other columns and nulls stay."""
    rows, terms, df, _ = case
    phrases = [t for t in terms if t]
    form = lambda t: "".join(f"<{'-' if x is None else x}>" for x in t)
    pattern = re.compile("|".join(sorted((form(t.split()) for t in phrases if t.split()), key=len, reverse=True)))
    for most in (1, 30, len(phrases)):
        some = phrases[:most]
        pattern = re.compile("|".join(sorted((form(t.split()) for t in some if t.split()), key=len, reverse=True)) or "(?!)")
        got = without_terms(df.withColumn("masked_not", F.lit(1)), some, sentinel="~").collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.masked is None if r.tokens is None else form(r.masked) == pattern.sub("<~>", form(r.tokens))


def test_leftmost_longest():
    place, size = np.array([0, 0, 1, 3, 3, 4]), np.array([1, 3, 9, 1, 2, 1])
    assert leftmost_longest(place, size).tolist() == [1, 4]
    assert leftmost_longest(place[:0], size[:0]).tolist() == []
