"""Corpus metrics of generated text against one reference text per row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from taleweave.functions.stemmer import stem
from taleweave.functions.text import ngrams, whitespace_tokens
from taleweave.operators.evaluate import safe_ratio
from taleweave.session import dealt

# The standard machine-translation evaluation tokenizer, as (pattern, replacement) in order.
MT_RULES = (
    (r"<skipped>", ""),
    (r"-\n", ""),
    (r"\n", " "),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
)
MT_SPLITS = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
)
MAX_ORDER = 4


def mt_tokens(text: Column) -> Column:
    """Tokens of the translation-evaluation tokenizer (case kept)."""
    line = text
    for pattern, replacement in MT_RULES:
        line = F.regexp_replace(line, pattern, replacement)
    line = F.concat(F.lit(" "), line, F.lit(" "))
    for pattern, replacement in MT_SPLITS:
        line = F.regexp_replace(line, pattern, replacement)
    return whitespace_tokens(line)


def overlap_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def lower_words(text: Column) -> Column:
    return whitespace_tokens(F.lower(text))


def ngram_overlap(df: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """Per order 1..4: clipped matches, candidate n-grams and reference n-grams over the corpus.

    ``candidate`` and ``reference`` are token arrays. Candidate and reference n-grams of a row meet in one grouping
    (no join); rows are spread by key before they are exploded, so texts are shuffled and n-grams are not.
    """

    def side(name: str, n: int, c: int) -> Column:
        return F.transform(
            ngrams(F.col(name), n),
            lambda g: F.struct(F.lit(n).alias("order"), g.alias("gram"), F.lit(c).alias("c"), F.lit(1 - c).alias("r")),
        )

    parts = [side(candidate, n, 1) for n in range(1, MAX_ORDER + 1)]
    parts += [side(reference, n, 0) for n in range(1, MAX_ORDER + 1)]
    grams = (
        dealt(df.select(key, candidate, reference), key)
        .select(key, F.inline(F.concat(*parts)))
        .groupBy(key, "order", "gram")
        .agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    )
    return grams.groupBy("order").agg(
        F.sum(F.least("c", "r")).alias("matches"),
        F.sum("c").alias("candidate_total"),
        F.sum("r").alias("reference_total"),
    )


def bleu(df: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """Corpus BLEU on a 0-100 scale with exponential smoothing of empty orders and a brevity penalty."""
    return bleu_of(ngram_overlap(df, key, candidate, reference))


def bleu_of(counts: DataFrame) -> DataFrame:
    """The score of (order, matches, candidate_total, reference_total)."""

    def of(column: str, n: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("order") == n, F.col(column))), F.lit(0))

    wide = counts.agg(
        *[of("matches", n).alias(f"m{n}") for n in range(1, MAX_ORDER + 1)],
        *[of("candidate_total", n).alias(f"t{n}") for n in range(1, MAX_ORDER + 1)],
        of("reference_total", 1).alias("ref_len"),
    )
    log_sum: Column = F.lit(0.0)
    zeros: Column = F.lit(0)
    for n in range(1, MAX_ORDER + 1):
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        zeros = zeros + (m == 0).cast("int")
        log_sum = log_sum + F.when(
            t > 0,
            F.when(m > 0, F.log(100.0 * m / F.when(t > 0, t))).otherwise(
                F.log(100.0 / (F.pow(F.lit(2.0), zeros) * F.when(t > 0, t)))
            ),
        )
    penalty = F.when(F.col("t1") >= F.col("ref_len"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("ref_len") / F.when(F.col("t1") > 0, F.col("t1")))
    )
    score = F.when(
        (F.col("t4") > 0) & (F.col("m1") > 0), penalty * F.exp(log_sum / MAX_ORDER)
    ).otherwise(F.lit(0.0))
    return wide.select(score.alias("bleu"), F.col("t1").alias("candidate_tokens"), F.col("ref_len").alias("reference_tokens"))


def lcs_length(candidate: Column, reference: Column) -> Column:
    """Length of the longest common subsequence of two token arrays.

    The table of the textbook recurrence is kept as one integer with a bit per reference position, so a row costs one
    pass over its candidate tokens and texts of any length stay whole.
    """

    def one(a: list[str], b: list[str]) -> int:
        at: dict[str, int] = {}
        for i, token in enumerate(b):
            at[token] = at.get(token, 0) | (1 << i)
        full = (1 << len(b)) - 1
        row = full
        for token in a:
            hit = row & at.get(token, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(b) - row.bit_count()

    @F.pandas_udf("int")
    def lcs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([one(a, b) for a, b in zip(left, right)], dtype="int32")

    return lcs(candidate, reference)


def rouge_l_rows(df: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """ROUGE-L F-measure of each row; ``candidate`` and ``reference`` are token arrays."""
    scored = dealt(df, key).select(
        key,
        F.size(candidate).alias("nc"),
        F.size(reference).alias("nr"),
        lcs_length(F.col(candidate), F.col(reference)).alias("lcs"),
    )
    p = safe_ratio(F.col("lcs"), F.col("nc"))
    r = safe_ratio(F.col("lcs"), F.col("nr"))
    return scored.withColumns({"p": p, "r": r}).select(
        key, "lcs", safe_ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")).alias("rouge_l")
    )


def rouge_l(df: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    return rouge_l_rows(df, key, candidate, reference).agg(F.avg("rouge_l").alias("rouge"))


# Samples of the interval and the percentiles of their means.
REPLICATES, PERCENTILES = 1000, (0.025, 0.5, 0.975)
# A resampled row's weight comes from so many hexadecimal digits of a hash, so many weights from one hash.
_DIGITS, _PER_HASH = 3, 10


def resample_cuts() -> list[int]:
    """Places in 0..4095 from which a weight of one, two, ... is drawn: a Poisson distribution with mean one."""
    grid, cuts, p, total, k = 16**_DIGITS, [], math.exp(-1), 0.0, 0
    while True:
        total += p
        if math.floor(grid * total) >= grid - 1 or k > 20:
            return cuts
        cuts.append(math.floor(grid * total))
        k += 1
        p /= k


def bootstrap(df: DataFrame, key: str, value: str, replicates: int = REPLICATES, seed: int | str = 690) -> DataFrame:
    """Low, mid and high percentile of the mean over resampled rows, in one row.

    No resampled table is made: in each replicate a row has a weight, drawn from a hash of seed, key and replicate, that
    follows the number of times a resampled table would hold it. A replicate is two sums, added up where the rows are.
    """
    block = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // _PER_HASH) - 1))).alias("_block")
    name = F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"), F.col("_block").cast("string"))
    rows = df.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v"), block)
    rows = rows.select("_v", "_block", F.md5(name).alias("_h"))

    def weight(j: Column) -> Column:
        at = F.conv(F.substring(F.col("_h"), j * _DIGITS + 1, F.lit(_DIGITS)), 16, 10).cast("int")
        return sum(((at >= cut).cast("int") for cut in resample_cuts()), F.lit(0))

    drawn = F.transform(
        F.sequence(F.lit(0), F.lit(_PER_HASH - 1)),
        lambda j: F.struct((F.col("_block") * _PER_HASH + j).alias("replicate"), weight(j).alias("w")),
    )
    drawn = rows.select("_v", F.inline(drawn)).filter((F.col("w") > 0) & (F.col("replicate") < replicates))
    means = drawn.groupBy("replicate").agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias("mean"))
    at = [F.percentile("mean", F.lit(p)).alias(n) for p, n in zip(PERCENTILES, ("low", "mid", "high"))]
    return means.agg(*at)


def _stem_slots(slots: DataFrame, key: str) -> DataFrame:
    """What exact matching left over, matched by stem: the k-th last one left of each side."""
    left = slots.withColumn("word", F.when(F.col("hit"), F.col("token")).otherwise(stem(F.col("token"))))
    side = F.col("c").isNotNull()
    place = F.row_number().over(W.partitionBy(key, "hit", "word", side).orderBy(F.desc(F.coalesce("c", "r"))))
    left = left.withColumn("nth", F.when(F.col("hit"), F.col("nth")).otherwise(place))
    met = left.groupBy(key, "hit", "word", "nth").agg(
        F.first("nc").alias("nc"), F.first("nr").alias("nr"), F.max("c").alias("c"), F.max("r").alias("r")
    )
    return met.withColumn("hit", F.col("c").isNotNull() & F.col("r").isNotNull())


def meteor_rows(df: DataFrame, key: str, candidate: str, reference: str, stems: bool = False) -> DataFrame:
    """METEOR of each row from its exact-match stage and, with ``stems``, from a second stage over equal stems.

    The k-th last occurrence of a word in the candidate is aligned with its k-th last occurrence in the reference;
    chunks are runs of matches that are adjacent on both sides. Texts are shuffled once by key and all windows and
    groupings after that stay in place.
    """
    sides = F.concat(
        F.transform(candidate, lambda t, i: F.struct(t.alias("token"), F.lit(1).alias("side"), i.alias("pos"))),
        F.transform(reference, lambda t, i: F.struct(t.alias("token"), F.lit(0).alias("side"), i.alias("pos"))),
    )
    words = (
        dealt(df.select(key, candidate, reference), key)
        .select(
            key, F.size(candidate).alias("nc"), F.size(reference).alias("nr"), F.inline_outer(sides)
        )
    )
    nth = F.row_number().over(W.partitionBy(key, "token", "side").orderBy(F.desc("pos")))
    slots = (
        words.withColumn("nth", nth)
        .groupBy(key, "token", "nth")
        .agg(
            F.first("nc").alias("nc"),
            F.first("nr").alias("nr"),
            F.max(F.when(F.col("side") == 1, F.col("pos"))).alias("c"),
            F.max(F.when(F.col("side") == 0, F.col("pos"))).alias("r"),
        )
        .withColumn("hit", F.col("c").isNotNull() & F.col("r").isNotNull())
    )
    if stems:
        slots = _stem_slots(slots, key)
    order = W.partitionBy(key, "hit").orderBy("c")
    follows = (F.col("c") == F.lag("c").over(order) + 1) & (F.col("r") == F.lag("r").over(order) + 1)
    rows = (
        slots.withColumn("starts", F.col("hit") & ~F.coalesce(follows, F.lit(False)))
        .groupBy(key)
        .agg(
            F.first("nc").alias("nc"),
            F.first("nr").alias("nr"),
            F.count_if("hit").alias("m"),
            F.count_if("starts").alias("chunks"),
        )
    )
    p = safe_ratio(F.col("m"), F.col("nc"))
    r = safe_ratio(F.col("m"), F.col("nr"))
    mean = safe_ratio(F.col("p") * F.col("r"), 0.9 * F.col("p") + 0.1 * F.col("r"))
    penalty = 0.5 * F.pow(safe_ratio(F.col("chunks"), F.col("m")), F.lit(3.0))
    return rows.withColumns({"p": p, "r": r}).select(
        key, "m", "chunks", (mean * (1 - penalty)).alias("meteor")
    )


def meteor(df: DataFrame, key: str, candidate: str, reference: str, stems: bool = False) -> DataFrame:
    return meteor_rows(df, key, candidate, reference, stems).agg(F.avg("meteor").alias("meteor"))


def metric_bundle(df: DataFrame, key: str, candidate: str, reference: str, stems: bool = False) -> DataFrame:
    """One row of bleu, rouge and meteor for two text columns."""
    tokens = df.select(
        key,
        mt_tokens(F.col(candidate)).alias("mc"),
        mt_tokens(F.col(reference)).alias("mr"),
        overlap_tokens(F.col(candidate)).alias("oc"),
        overlap_tokens(F.col(reference)).alias("or"),
        lower_words(F.col(candidate)).alias("wc"),
        lower_words(F.col(reference)).alias("wr"),
    )
    return bleu(tokens, key, "mc", "mr").select(
        "bleu",
        rouge_l(tokens, key, "oc", "or").scalar().alias("rouge"),
        meteor(tokens, key, "wc", "wr", stems).scalar().alias("meteor"),
    )
