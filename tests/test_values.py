"""Fixed values and plain-Python third opinions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from taleweave.functions import arrays, phonetic, text
from taleweave.operators import evaluate, losses, similarity, stats, textmetrics, tokens
from taleweave.sources.readers import multihot, multihot_bad, parse_prediction_lines


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def words(spark, values):
    return spark.createDataFrame([(v,) for v in values], "w string")


@pytest.mark.parametrize(
    "word,code",
    [("testing", "T6036084"), ("Braz", "B1905"), ("hayers", "H093"), ("", ""), (".", "")],
)
def test_refined_soundex(spark, word, code):
    assert words(spark, [word]).select(phonetic.refined_soundex(F.col("w"))).first()[0] == code


@pytest.mark.parametrize(
    "word,code",
    [("Robert", "R163"), ("Rupert", "R163"), ("Ashcraft", "A261"), ("Tymczak", "T522"), ("Honeyman", "H555"), ("", "")],
)
def test_soundex(spark, word, code):
    assert words(spark, [word]).select(phonetic.soundex(F.col("w"))).first()[0] == code


@pytest.mark.parametrize(
    "word,code",
    [
        ("thumb", "0M"),
        ("knight", "NT"),
        ("school", "SXL"),
        ("Thompson", "0MPSN"),
        ("which", "WX"),
        ("judge", "JJ"),
        ("phone", "FN"),
        ("élan", "ELN"),
        ("", ""),
    ],
)
def test_metaphone(spark, word, code):
    assert words(spark, [word]).select(phonetic.metaphone(F.col("w"))).first()[0] == code


def test_phonetic_distance(spark):
    row = one(spark, phonetic.phonetic_distance(F.lit("night"), F.lit("knight")), phonetic.phonetic_distance(F.lit("dog"), F.lit("cat")))
    assert row[0] == 0 and row[1] > 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similarity_matrix_against_loops(spark):
    texts = ["I am a dog You aren't a cat", "bruh yee", "## #", "a " * 30]
    length = 12
    df = words(spark, texts)
    marked = similarity.marked_tokens(text.whitespace_tokens(F.col("w")), length)
    codes = similarity.codes(marked)
    out = df.select(
        "w",
        codes.alias("codes"),
        similarity.distance_matrix(codes, length).alias("d"),
        similarity.matrix_softmax(similarity.inverted(similarity.distance_matrix(codes, length))).alias("p"),
        similarity.similarity_matrix(codes, length).alias("q"),
    ).collect()
    for r in out:
        c = list(r.codes) + [None] * (length - len(r.codes))
        d = [[0 if a is None or b is None else levenshtein(a, b) for b in c] for a in c]
        assert [list(x) for x in r.d] == d
        top = max(map(max, d))
        s = [[top - x + 1 for x in row] for row in d]
        e = [[math.exp(x - max(map(max, s))) for x in row] for row in s]
        total = sum(map(sum, e))
        for i in range(length):
            assert r.p[i] == pytest.approx([x / total for x in e[i]], abs=1e-12)
            assert r.q[i] == pytest.approx(list(r.p[i]), abs=1e-12)
            assert [row[i] for row in r.d] == list(r.d[i])
        assert sum(map(sum, r.q)) == pytest.approx(1, abs=1e-9)


def test_pair_similarity_joins_with_a_space(spark):
    df = spark.createDataFrame([("a b", "c")], "a string, b string")
    two = similarity.pair_similarity(df, "a", "b", 8).first().similarity
    joined = similarity.pair_similarity(df.select(F.lit("a b c").alias("t")), "t", None, 8).first().similarity
    assert two == joined and len(two) == 8 and len(two[0]) == 8


def test_stop_truncate_habit(spark):
    row = one(
        spark,
        text.stop_truncate(F.lit("ab</s>cd"), "</s>"),
        text.stop_truncate(F.lit("abcd"), "</s>"),
        text.stop_truncate(F.lit("abcd"), "</s>", compat=False),
        text.stop_truncate(F.lit("</s>x"), "</s>"),
        text.stop_truncate(F.lit(""), "</s>"),
    )
    assert list(row) == ["ab", "abc", "abcd", "", ""]


def test_wrap_special(spark):
    row = one(spark, text.wrap_special(F.array(*map(F.lit, ["##a#", "b#c", "##"])), length=7))
    assert list(row[0]) == ["[CLS]", "a", "b#c", "", "[SEP]", "", ""]
    cut = one(spark, text.wrap_special(F.array(*map(F.lit, ["a", "b"])), length=3))
    assert list(cut[0]) == ["[CLS]", "a", "b"]


def test_multihot_flags(spark):
    df = words(spark, ["0,2", "3", "-1", "4", "x", ""])
    rows = df.select("w", multihot(F.col("w")).alias("v"), multihot_bad(F.col("w")).alias("bad")).collect()
    assert {r.w: r.bad for r in rows} == {"0,2": False, "3": False, "-1": True, "4": True, "x": True, "": True}
    assert list(rows[0].v) == [1, 0, 1, 0]


def test_prediction_pattern_has_no_digits_or_lists(spark):
    lines = spark.createDataFrame(
        [("index\tprediction",), ("0: goal_driven / emotional_based",), ("1: ending1 / ending2",), ("2: ['sentence1'] / []",)],
        "value string",
    )
    assert [tuple(r) for r in parse_prediction_lines(lines).collect()] == [("goal_driven", "emotional_based")]


def test_word_counts_differ_by_definition(spark):
    row = one(spark, text.words_by_single_space(F.lit("a  b ")), text.words_by_any_space(F.lit(" a  \t b　c ")))
    assert list(row) == [4, 3]


def test_position_ids_and_last_token(spark):
    a = lambda *x: F.array(*[F.lit(i) for i in x])
    row = one(
        spark,
        text.position_ids(a(1, 1, 0, 1, 0)),
        text.last_token_value(a(7, 8, 9), a(5, 5, 0), F.lit(0)),
        text.last_token_value(a(7, 8, 9), a(0, 0, 0), F.lit(0)),
    )
    assert list(row[0]) == [0, 1, 1, 2, 1] and row[1] == 8 and row[2] == 9


def test_softmax_and_losses(spark):
    row = one(spark, arrays.softmax(F.array(F.lit(1000.0), F.lit(1000.0))), arrays.nll(F.array(F.lit(0.0), F.lit(0.0)), F.lit(1)))
    assert list(row[0]) == [0.5, 0.5] and row[1] == pytest.approx(math.log(2))
    df = spark.createDataFrame([([800.0, -800.0], [1, 0])], "z array<double>, label array<int>")
    assert losses.bce_with_logits(df).first()[0] == 0
    both = one(spark, losses.joint(F.lit(1.0), F.lit(None).cast("double")), losses.joint(F.lit(None).cast("double"), F.lit(None).cast("double")))
    assert both[0] == 1.0 and both[1] is None


def test_histogram_last_bin_closed_and_empty_bins_kept(spark):
    df = spark.createDataFrame([(x,) for x in (0, 0, 1, 4)], "x int")
    rows = sorted((r.bin, r.n) for r in stats.histogram(df, F.col("x"), 4).collect())
    assert rows == [(0, 2), (1, 1), (2, 0), (3, 1)]
    same = spark.createDataFrame([(3,), (3,)], "x int")
    assert sum(r.n for r in stats.histogram(same, F.col("x"), 4).collect()) == 2


def test_class_weights_sum_to_rows(spark):
    df = spark.createDataFrame([(0,)] * 5 + [(1,)] * 3 + [(3,)], "label int")
    rows = stats.class_weights(df).collect()
    assert sum(r.n * r.weight for r in rows) == pytest.approx(9)
    assert {r.label: round(r.weight, 6) for r in rows} == {0: 0.6, 1: 1.0, 3: 3.0}
    done = stats.weights_complete(df, 4).first()
    assert (done.n_present, done.missing, done.complete) == (3, "2", 0)


def plain_report(pairs):
    classes = sorted({y for y, _ in pairs} | {p for _, p in pairs})
    n = len(pairs)
    out = {"precision": 0.0, "recall": 0.0, "f1": 0.0}
    recalls = []
    for c in classes:
        tp = sum(y == c == p for y, p in pairs)
        sup = sum(y == c for y, _ in pairs)
        pp = sum(p == c for _, p in pairs)
        pr = tp / pp if pp else 0.0
        rc = tp / sup if sup else 0.0
        f = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        if sup:
            recalls.append(rc)
        for k, v in (("precision", pr), ("recall", rc), ("f1", f)):
            out[k] += sup * v / n
    out["accuracy"] = sum(y == p for y, p in pairs) / n
    out["balanced_accuracy"] = sum(recalls) / len(recalls)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_classification_report_against_loops(spark, seed):
    rng = random.Random(seed)
    # Class 5 is only ever predicted, class 4 is never predicted.
    pairs = [(rng.choice([0, 0, 0, 1, 2, 4]), rng.choice([0, 1, 2, 5])) for _ in range(200)]
    got = evaluate.classification_report(spark.createDataFrame(pairs, "label int, pred int")).first()
    for k, v in plain_report(pairs).items():
        assert got[k] == pytest.approx(v, abs=1e-12), k
    assert got.samples == 200


def test_multilabel_report_against_loops(spark):
    rng = random.Random(4)
    rows = [([rng.randint(0, 1) for _ in range(3)] + [0], [rng.randint(0, 1) for _ in range(4)]) for _ in range(60)]
    got = evaluate.multilabel_report(spark.createDataFrame(rows, "label array<int>, pred array<int>"), 4).first()
    assert got.accuracy == pytest.approx(sum(y == p for y, p in rows) / 60)
    assert got.hamming_loss == pytest.approx(sum(a != b for y, p in rows for a, b in zip(y, p)) / 240)
    total = f1 = 0.0
    for i in range(4):
        tp = sum(y[i] * p[i] for y, p in rows)
        sup, pp = sum(y[i] for y, _ in rows), sum(p[i] for _, p in rows)
        f1 += sup * (2 * tp / (sup + pp) if sup + pp else 0.0)
        total += sup
    assert got.f1 == pytest.approx(f1 / total)


def test_combined_score(spark):
    df = spark.createDataFrame([(0.5, 0.7)], "a double, b double")
    assert evaluate.with_combined_score(df, ["a", "b"]).first().combined_score == pytest.approx(0.6)
    assert "combined_score" not in evaluate.with_combined_score(df, ["a"]).columns


def test_next_token_loss_against_loops(spark):
    rng = random.Random(1)
    rows = [(s, p, rng.randint(0, 3), [rng.uniform(-2, 2) for _ in range(4)]) for s in range(5) for p in range(6)]
    df = spark.createDataFrame(rows, "s int, p int, t int, z array<double>")
    at = {(s, p): t for s, p, t, _ in rows}
    expected = [
        math.log(sum(math.exp(x) for x in z)) - z[at[(s, p + 1)]] for s, p, _, z in rows if (s, p + 1) in at
    ]
    got = losses.mean_loss(losses.next_token_nll(df, "s", "p", "t")).first()
    assert got.n == 25 and got.loss == pytest.approx(sum(expected) / 25)


def text_pairs(seed, n=25):
    rng = random.Random(seed)
    make = lambda: " ".join(rng.choice("the cat is blue on a mat , dog".split()) for _ in range(rng.randint(0, 15)))
    return [(i, make(), make()) for i in range(n)]


def plain_bleu(pairs):
    m, t, c_len, r_len = [0] * 4, [0] * 4, 0, 0
    for _, c, r in pairs:
        c, r = c.split(), r.split()
        c_len, r_len = c_len + len(c), r_len + len(r)
        for n in range(1, 5):
            grams = Counter(tuple(c[i : i + n]) for i in range(len(c) - n + 1))
            known = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
            m[n - 1] += sum(min(k, known[g]) for g, k in grams.items())
            t[n - 1] += sum(grams.values())
    logs, zeros = 0.0, 0
    for a, b in zip(m, t):
        zeros += a == 0
        logs += math.log(100 * a / b) if a else math.log(100 / (2**zeros * b))
    return (1 if c_len >= r_len else math.exp(1 - r_len / c_len)) * math.exp(logs / 4)


def token_pairs(spark, pairs):
    df = spark.createDataFrame(pairs, "id int, a string, b string")
    return df.select("id", text.whitespace_tokens(F.col("a")).alias("c"), text.whitespace_tokens(F.col("b")).alias("r"))


@pytest.mark.parametrize("seed", [0, 1])
def test_bleu_against_loops(spark, seed):
    pairs = text_pairs(seed)
    assert textmetrics.bleu(token_pairs(spark, pairs), "id", "c", "r").first().bleu == pytest.approx(plain_bleu(pairs))


def test_bleu_bounds(spark):
    same = [(0, "the cat is blue today", "the cat is blue today")]
    assert textmetrics.bleu(token_pairs(spark, same), "id", "c", "r").first().bleu == pytest.approx(100)
    nothing = [(0, "x y z w v", "a b c d e")]
    assert textmetrics.bleu(token_pairs(spark, nothing), "id", "c", "r").first().bleu == 0
    # Two of four orders without a match: halved, then quartered.
    close = [(0, "the cat is bleu", "the cat is blue")]
    assert textmetrics.bleu(token_pairs(spark, close), "id", "c", "r").first().bleu == pytest.approx(plain_bleu(close))


def test_mt_tokens(spark):
    row = one(spark, textmetrics.mt_tokens(F.lit("Hello, world! It costs 3.50-ish &amp; \"more\".")))
    assert list(row[0]) == ["Hello", ",", "world", "!", "It", "costs", "3.50", "-", "ish", "&", '"', "more", '"', "."]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_rouge_l_against_loops(spark):
    pairs = text_pairs(3) + [(100, " ".join(map(str, range(300))), " ".join(map(str, range(299, -1, -3))))]
    got = {r.id: r for r in textmetrics.rouge_l_rows(token_pairs(spark, pairs), "id", "c", "r").collect()}
    for i, a, b in pairs:
        a, b = a.split(), b.split()
        lcs = plain_lcs(a, b)
        assert got[i].lcs == lcs
        assert got[i].rouge_l == pytest.approx(2 * lcs / (len(a) + len(b)) if lcs else 0.0)


def plain_meteor(a, b):
    left, right, matches = list(enumerate(a)), list(enumerate(b)), []
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            if left[i][1] == right[j][1]:
                matches.append((left[i][0], right[j][0]))
                left.pop(i)
                right.pop(j)
                break
    if not matches:
        return 0.0
    matches.sort()
    chunks = 1 + sum(
        (x[0] + 1, x[1] + 1) != y for x, y in zip(matches, matches[1:])
    )
    m = len(matches)
    p, r = m / len(a), m / len(b)
    return p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / m) ** 3)


def test_meteor_against_loops(spark):
    pairs = text_pairs(5) + [(99, "", "")]
    got = {r.id: r.meteor for r in textmetrics.meteor_rows(token_pairs(spark, pairs), "id", "c", "r").collect()}
    assert len(got) == len(pairs)
    for i, a, b in pairs:
        assert got[i] == pytest.approx(plain_meteor(a.split(), b.split())), (a, b)


def test_meteor_of_identical_text(spark):
    same = [(0, "the cat is blue", "the cat is blue")]
    got = textmetrics.meteor(token_pairs(spark, same), "id", "c", "r").first().meteor
    assert got == pytest.approx(1 - 0.5 / 64)


@pytest.mark.parametrize("block", [1, 4, 7])
def test_pack_blocks_against_loops(spark, block):
    rng = random.Random(block)
    texts = [(i, i // 10, [f"{i}_{k}" for k in range(rng.choice([0, 1, 3, 25]))]) for i in range(37)]
    df = spark.createDataFrame(texts, "id int, batch int, tokens array<string>").repartition(5)
    got = {(r.batch, r.block): list(r.input_ids) for r in tokens.pack_blocks(df, "id", "tokens", "batch", block).collect()}
    expected = {}
    for batch in range(4):
        flat = [t for _, b, ts in texts if b == batch for t in ts]
        for k in range(len(flat) // block):
            expected[(batch, k)] = flat[k * block : (k + 1) * block]
    assert got == expected


def test_encode_with_unknown_and_empty_text(spark):
    df = spark.createDataFrame([(0, ["a", "b", "a"]), (1, []), (2, ["c", "a", "zz"])], "id int, t array<string>")
    vocab = tokens.build_vocab(df, "t", 2)
    assert {r.token: r.token_id for r in vocab.collect()} == {"a": 2, "b": 3}
    got = {r.id: list(r.input_ids) for r in tokens.encode(df, "id", "t", vocab).collect()}
    assert got == {0: [2, 3, 2], 1: [], 2: [1, 2, 1]}


def test_pad_batches_rounds_up_to_eight(spark):
    df = spark.createDataFrame([(0, [1] * 3), (0, [1] * 9), (1, [1])], "b int, t array<int>")
    got = sorted((r.b, len(r.t), sum(r.attention_mask)) for r in tokens.pad_batches(df, "b", "t").collect())
    assert got == [(0, 16, 3), (0, 16, 9), (1, 8, 1)]


def test_above_on_scores_and_on_probabilities(spark):
    z = F.array(F.lit(0.3), F.lit(-0.1), F.lit(0.7))
    row = one(spark, arrays.above(z), arrays.above(z, on_probabilities=True))
    assert list(row[0]) == [0, 0, 1] and list(row[1]) == [1, 0, 1]


def test_words_are_coded_together_as_one_by_one(spark):
    said = ["Knight", "xylophone", "gh", "ough", "lamb", "dodge", "the", "", None, " ", "a\nb", "Straße", "aegis", "wy", "whey", "schism", "gnome", "signed", "h"]
    r = one(
        spark,
        phonetic.metaphones(F.array(*[F.lit(w) for w in said])),
        F.array(*[phonetic.metaphone(F.lit(w)) for w in said]),
        phonetic.metaphones(F.array().cast("array<string>")),
    )
    assert list(r[0]) == list(r[1]) and list(r[2]) == []


def test_matrix_by_its_different_rows(spark):
    """As many rows as there are codes are made, and they stand for the whole square."""
    df = words(spark, ["no snow no know", "a " * 30, "x"])
    for length in (4, 12):
        codes = similarity.codes(similarity.marked_tokens(text.whitespace_tokens(F.col("w")), length))
        parts = similarity.distance_matrix(codes, length, whole=False)
        softmax = similarity.matrix_softmax(similarity.inverted(parts["cells"]), parts["often"])
        for r in df.select(parts.alias("m"), softmax.alias("p"), similarity.distance_matrix(codes, length).alias("d"), similarity.similarity_matrix(codes, length).alias("q")).collect():
            assert len(r.m.cells) == len(r.m.often) == len(set(r.m.slots)) <= 4 and sum(r.m.often) == length
            assert [[r.m.cells[i][j] for j in r.m.slots] for i in r.m.slots] == [list(x) for x in r.d]
            for i, row in zip(r.m.slots, r.q):
                assert [r.p[i][j] for j in r.m.slots] == pytest.approx(list(row), abs=1e-12)
