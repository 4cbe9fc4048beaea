"""Next-token model: candidate sets under a hot context, sampling, perplexity and generation."""

import hashlib
import math
import random
from fractions import Fraction
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from taleweave.functions.text import whitespace_tokens
from taleweave.operators import ngram, tokens
from taleweave.session import hand_over_by


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def hot_counts(seed=0):
    """One context with most of the candidates, many of them tied, and a few small ones."""
    rng = random.Random(seed)
    rows = [("the", f"w{i}", 1 if i > 40 else rng.randint(1, 400)) for i in range(900)]
    rows += [("a", "x", 9), ("a", "y", 1), ("b", "z", 3)] + [("c", f"t{i}", 1) for i in range(10)]
    return rows


def plain_nucleus(rows, per_mille=900):
    by = defaultdict(list)
    for prev, nxt, n in rows:
        by[prev].append((-n, md5(nxt), nxt))
    kept = {}
    for prev, items in by.items():
        total = -sum(i[0] for i in items)
        before = 0
        for minus, _, nxt in sorted(items):
            if before * 1000 < per_mille * total:
                kept[(prev, nxt)] = (-minus, before)
            before -= minus
    return kept


@pytest.mark.parametrize("p", [0.5, 0.9, 1.0])
def test_nucleus_against_loops(spark, p):
    rows = hot_counts()
    df = spark.createDataFrame(rows, "prev string, next string, n long").repartition(6)
    got = {(r.prev, r.next): (r.n, r.before) for r in ngram.nucleus(df, p).collect()}
    assert got == plain_nucleus(rows, round(p * 1000))


@pytest.mark.parametrize("p", ["0.9995", "0.0004", "0.3333", "1", "0"])
def test_nucleus_is_exact_for_any_decimal(spark, p):
    """Shares are compared as fractions; the first candidate of a context stays whatever ``p`` is."""
    rows = [("x", f"t{i}", 1) for i in range(2_000)] + [("x", "top", 2_000), ("y", "only", 5), ("z", "a", 9_995), ("z", "b", 5)]
    df = spark.createDataFrame(rows, "prev string, next string, n long")
    kept = {}
    for context in "xyz":
        own = sorted((-n, md5(t), t) for c, t, n in rows if c == context)
        before, total = 0, -sum(n for n, _, _ in own)
        for n, _, t in own:
            if before == 0 or Fraction(before, total) < Fraction(p):
                kept[(context, t)] = (-n, before)
            before -= n
    assert {(r.prev, r.next): (r.n, r.before) for r in ngram.nucleus(df, float(p)).collect()} == kept


def test_kept_total_is_the_weight_of_the_kept_set(spark):
    df = spark.createDataFrame(hot_counts(), "prev string, next string, n long")
    off = ngram.nucleus(df).groupBy("prev").agg(F.sum("n").alias("s"), F.max("kept_total").alias("k")).filter("s <> k")
    assert off.count() == 0


def test_sample_draws_one_kept_candidate_per_context(spark):
    df = spark.createDataFrame(hot_counts(), "prev string, next string, n long")
    kept = ngram.nucleus(df)
    members = {(r.prev, r.next) for r in kept.collect()}
    drawn = [(r.prev, r.next) for r in ngram.sample_next(kept, 7).collect()]
    assert sorted(c for c, _ in drawn) == ["a", "b", "c", "the"] and set(drawn) <= members


def test_sampling_follows_the_weights(spark):
    rows = [(f"c{i}", t, n) for i in range(800) for t, n in (("x", 3), ("y", 1))]
    kept = ngram.nucleus(spark.createDataFrame(rows, "prev string, next string, n long"), 1.0)
    share = ngram.sample_next(kept, 1).filter("next = 'x'").count() / 800
    assert 0.68 < share < 0.82


def test_top_k(spark):
    df = spark.createDataFrame(hot_counts(), "prev string, next string, n long")
    got = Counter(r.prev for r in ngram.top_k(df, 2).collect())
    assert got == {"the": 2, "a": 2, "b": 1, "c": 2}
    assert ngram.top_k(df, 0) is df


def test_adjust_scores(spark):
    row = spark.range(1).select(
        ngram.adjust_scores(F.array(F.lit(2.0), F.lit(-2.0), F.lit(1.0)), F.array(F.lit(0), F.lit(1)), 0.5, 2.0)
    ).first()
    assert list(row[0]) == [2.0, -8.0, 2.0]


def test_perplexity_against_loops(spark):
    rng = random.Random(3)
    blocks = [([rng.choice("abcd") for _ in range(12)], s) for s in ["train"] * 6 + ["test"] * 3]
    df = spark.createDataFrame(blocks, "input_ids array<string>, split string")
    train = df.filter("split = 'train'")
    held = tokens.pair_counts(df.filter("split = 'test'"), "input_ids", by=("split",))
    size = ngram.vocabulary_size(ngram.train_counts(train)).select("v").scalar()
    got = ngram.lm_perplexity(held, ngram.train_counts(train), size, by=["split"]).first()
    pairs = Counter((a, b) for t, s in blocks if s == "train" for a, b in zip(t, t[1:]))
    prev = Counter()
    for (a, _), n in pairs.items():
        prev[a] += n
    v = len({x for t, s in blocks if s == "train" for x in t})
    nll = [-math.log((pairs[(a, b)] + 1) / (prev[a] + v)) for t, s in blocks if s == "test" for a, b in zip(t, t[1:])]
    assert got.pairs == len(nll) and got.perplexity == pytest.approx(math.exp(sum(nll) / len(nll)))


def test_generate_walks_the_candidate_table(spark):
    rows = hot_counts(2) + [(f"w{i}", "the" if i % 3 else "</s>", 2) for i in range(900)]
    df = spark.createDataFrame(rows, "prev string, next string, n long")
    kept = ngram.nucleus(df)
    edges = {(r.prev, r.next) for r in kept.collect()}
    prompts = spark.createDataFrame([(i, ["once", "the"]) for i in range(40)] + [(40, ["unseen"])], "id int, p array<string>")
    run = lambda: {r.id: r.text for r in ngram.generate(prompts, kept, "id", "p", "</s>", 12).collect()}
    got = run()
    assert len(got) == 41 and got[40] == ""
    for i in range(40):
        walk = ["the"] + got[i].split()
        assert all(step in edges for step in zip(walk, walk[1:]))
        assert len(walk) - 1 <= 12 and "</s>" not in walk
        assert len(walk) - 1 == 12 or (walk[-1], "</s>") in edges or all(a != walk[-1] for a, _ in edges)
    assert len({t for t in got.values()}) > 5
    assert run() == got


def test_batches_restart_in_each_split(spark):
    df = spark.range(25).withColumn("split", F.when(F.col("id") < 5, "b").otherwise("a"))
    got = {r.id: r.batch for r in tokens.batches_of(df, "id", 10, within="split").collect()}
    assert [got[i] for i in range(5)] == [0] * 5 and [got[i] for i in range(5, 25)] == [0] * 10 + [1] * 10


def test_table_in_buckets_does_not_move(spark):
    cells = hand_over_by(spark.range(500).selectExpr("cast(id % 50 as string) as f", "id % 10 as slot", "id"), "cells", "f", "slot")
    state = spark.range(40).selectExpr("cast(id as string) as prev", "id % 10 as at", "id as row")
    joined = state.hint("shuffle_hash").join(cells, (F.col("prev") == F.col("f")) & (F.col("at") == F.col("slot")), "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ShuffledHashJoin" in plan
    assert joined.filter("id is not null").count() == 400


def test_generation_keeps_prompts_with_equal_keys(spark):
    kept = ngram.nucleus(spark.createDataFrame([("a", "b", 3), ("b", "c", 1), ("c", "</s>", 2)], "prev string, next string, n long"), 1)
    prompts = spark.createDataFrame([(1, ["a"]), (1, ["b"]), (None, ["c"]), (3, ["x"])], "id int, prompt array<string>")
    rows = ngram.generate(prompts, kept, "id", "prompt", "</s>", max_new_tokens=7, checkpoint_every=2).collect()
    assert sorted((r["id"] or 0, r["text"]) for r in rows) == [(0, ""), (1, "b c"), (1, "c"), (3, "")]


def test_candidates_of_few_and_of_many_are_ranked_alike(spark):
    rows = [("a", f"t{i}", 1 + i % 3) for i in range(60)] + [("b", "x", 5), ("b", "y", 5), ("c", "z", 1), (None, "z", 2), ("b", None, 3)]
    df = spark.createDataFrame(rows, "prev string, next string, n long")
    got = [sorted(map(tuple, ngram.nucleus(df, wide=wide).collect())) for wide in (0, 10, 1000)]
    assert got[0] == got[1] == got[2] and {r[0] for r in got[0]} == {"a", "b", "c"}


def test_tokens_of_pairs_are_made_once(spark):
    df = spark.createDataFrame([("a b  a b",), ("",), ("a",), (None,)], "text string").repartition(2)
    pairs = tokens.pair_counts(df.select(whitespace_tokens(F.col("text")).alias("t")), "t")
    assert sorted(map(tuple, pairs.collect())) == [("a", "b", 2), ("b", "a", 1)]
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    spaced = spark.createDataFrame([("a", ["x", None, "y"])], "k string, t array<string>")
    assert {(r["prev"], r["next"]) for r in tokens.pair_counts(spaced, "t").collect()} == {("x", None), (None, "y")}
