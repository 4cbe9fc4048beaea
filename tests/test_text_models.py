"""Stems, resampling, subword pieces and the repetition penalty against fixed values and plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taleweave.functions.stemmer import stem
from taleweave.operators import ngram, pieces, textmetrics

# Examples of the published description of the stemmer.
STEMS = (
    "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing "
    "conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail "
    "filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit "
    "digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog "
    "vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope "
    "callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form "
    "formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow "
    "inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit "
    "replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun "
    "activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate "
    "cease ceas controll control roll roll generalizations gener oscillators oscil"
).split()


def test_stems_are_the_published_ones(spark):
    words, stems = STEMS[::2], STEMS[1::2]
    rows = spark.createDataFrame(list(zip(words, stems)), "word string, stem string")
    got = {r.word: r.got for r in rows.select("word", stem(F.col("word")).alias("got")).collect()}
    assert got == dict(zip(words, stems))
    odd = spark.createDataFrame([(w,) for w in ("", "a", "is", "ed", "ing", "yes", "été", "日本", "7s", "*")], "word string")
    assert odd.select(stem(F.col("word")).alias("s")).filter("s is null").count() == 0


def test_stem_stage_matches_what_equal_words_left(spark):
    rows = [(1, "the cats run".split(), "the cat runs".split()), (2, ["running"], ["walk"]), (3, [], ["a"]), (4, "hope hopes".split(), "hoping hope".split())]
    df = spark.createDataFrame(rows, "id int, c array<string>, r array<string>")
    got = {r.id: (r.m, r.chunks) for r in textmetrics.meteor_rows(df, "id", "c", "r", stems=True).collect()}
    assert got == {1: (3, 1), 2: (0, 0), 3: (0, 0), 4: (2, 2)}
    exact = {r.id: r.m for r in textmetrics.meteor_rows(df, "id", "c", "r").collect()}
    assert exact == {1: 1, 2: 0, 3: 0, 4: 1}


def test_interval_is_that_of_a_resampled_table(spark):
    rng = np.random.default_rng(0)
    values = rng.gamma(2.0, size=400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(-1, None)], "id int, v double")
    low, mid, high = textmetrics.bootstrap(df, "id", "v").first()
    means = [rng.choice(values, len(values)).mean() for _ in range(2_000)]
    want = np.percentile(means, [2.5, 50, 97.5])
    width = want[2] - want[0]
    assert np.abs(np.array([low, mid, high]) - want).max() < 0.15 * width and low < mid < high
    assert textmetrics.bootstrap(df.filter("id < 0"), "id", "v").first() == (None, None, None)


def test_resampling_weights_have_mean_and_variance_one():
    cuts = np.array(textmetrics.resample_cuts())
    w = (np.arange(4096)[:, None] >= cuts).sum(1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def plain_merges(counts, merges):
    words = {w: (w[0], *("##" + c for c in w[1:])) for w in counts}
    found = []
    while len(found) < merges:
        pairs = {}
        for w, n in counts.items():
            for pair in zip(words[w], words[w][1:]):
                pairs[pair] = pairs.get(pair, 0) + n
        rank = sorted(pairs, key=lambda p: (-pairs[p], p))
        best = {}
        for p in rank:
            for s in p:
                best.setdefault(s, p)
        chosen = [p for p in rank if all(best[s] == p for s in p)][: merges - len(found)]
        if not chosen:
            break
        found += [(*p, pairs[p]) for p in chosen]
        for w, symbols in words.items():
            out, i = [], 0
            while i < len(symbols):
                if symbols[i : i + 2] in chosen:
                    out.append(symbols[i] + symbols[i + 1][2:])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            words[w] = tuple(out)
    return found


def test_merges_and_pieces(spark):
    rng = np.random.default_rng(1)
    parts = ["lo", "low", "er", "est", "new", "wid", "aaaa", "é日", "$.", "##"]
    counts = {"".join(rng.choice(parts, rng.integers(1, 4))): int(rng.integers(1, 40)) for _ in range(120)}
    df = spark.createDataFrame([(w, n) for w, n in counts.items()] + [("", 5), ("two words", 5)], "word string, n long")
    got = sorted(pieces.learn_merges(df, 40).collect(), key=lambda r: r.rank)
    assert [(r.left, r.right, r.n) for r in got] == plain_merges(counts, 40)
    learned = [r.piece for r in got]
    rows = spark.createDataFrame([(list(counts),), ([],), (["", "zz", "😀x"],)], "w array<string>")
    cut = rows.select("w", pieces.to_pieces(F.col("w"), learned).alias("p"))
    vocabulary = set(learned)
    for r in cut.select("w", "p", pieces.joined_words(F.col("p")).alias("back")).collect():
        whole = "".join(r.w)
        assert "".join(p.removeprefix("##") if p != "##" else p for p in r.p).replace("##", "") == whole.replace("##", "")
    # longest match, from left to right
    for word in ["lower", "newest", "widlow", "qqq"]:
        want, at = [], 0
        while at < len(word):
            mark = "##" if at else ""
            size = max([n for n in range(1, len(word) - at + 1) if mark + word[at : at + n] in vocabulary] or [1])
            want.append(mark + word[at : at + size])
            at += size
        one = spark.createDataFrame([([word],)], "w array<string>").select(pieces.to_pieces(F.col("w"), learned).alias("p")).first().p
        assert one == want
        back = spark.createDataFrame([(one + ["x"],)], "p array<string>").select(pieces.joined_words(F.col("p")).alias("b")).first().b
        assert back == [word, "x"]


def test_no_merges_to_learn(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert pieces.learn_merges(none).count() == 0
    one = spark.createDataFrame([(["ab"],)], "w array<string>").select(pieces.to_pieces(F.col("w"), []).alias("p")).first().p
    assert one == ["a", "##b"]


def test_penalty_draws_in_proportion_to_corrected_weights(spark):
    """One step from one context: said tokens lose weight, others keep their proportions."""
    kept = spark.createDataFrame(
        [("x", "a", 64_000, 0, 100_000, 4), ("x", "b", 27_000, 64_000, 100_000, 4), ("x", "c", 8_000, 91_000, 100_000, 4), ("x", "d", 1_000, 99_000, 100_000, 4)],
        "prev string, next string, n long, before long, kept_total long, kept_count long",
    )
    prompts = spark.range(20_000).select("id", F.array(F.lit("a"), F.lit("c"), F.lit("x")).alias("p"))
    out = ngram.generate(prompts, kept, "id", "p", "</s>", max_new_tokens=1, penalty=1.5)
    got = {r.text: r.n / 20_000 for r in out.groupBy("text").agg(F.count("*").alias("n")).collect()}
    weights = {"a": 64 ** (1 / 1.5), "b": 27.0, "c": 8 ** (1 / 1.5), "d": 1.0}
    total = sum(weights.values())
    assert all(got[t] == pytest.approx(w / total, abs=0.015) for t, w in weights.items())


def test_words_are_cut_together_as_one_by_one(spark):
    learned = ["ab", "##cd", "##c", "a\x01"]
    said = ["abcd", "ab", "b", "", "\x01", "a\x01b", "cab"]
    df = spark.createDataFrame([(said,), (said[:4] + said[6:],), ([],), (None,)], "w array<string>")
    for r in df.select("w", pieces.to_pieces(F.col("w"), learned).alias("p")).collect():
        alone = [] if r.w is None else [x for w in r.w for x in df.limit(1).select(pieces.to_pieces(F.array(F.lit(w)), learned).alias("p")).first().p]
        assert (r.p or []) == alone and (r.p is None) == (r.w is None)
    counts = pieces.word_counts(df.select(F.split(F.array_join("w", " "), " ").alias("w")), "w")
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("array_join") == 1
