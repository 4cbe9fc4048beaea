"""Next-token model over packed blocks: training counts, perplexity, candidate sets and generation."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from taleweave.operators.ranking import unit_interval
from taleweave.operators.tokens import pair_counts
from taleweave.operators.walk import NONE, Blocks
from taleweave.session import hand_over, with_entries

# Decoding defaults.
TOP_P, TOP_K, TEMPERATURE, REPETITION_PENALTY, MAX_NEW_TOKENS = 0.9, 0, 1.0, 1.0, 50
TIE_DIGITS = 2
# Most candidates of a context that meet in one task.
WIDE = 1 << 18
# Weight of a count of one where weights have a fraction.
WEIGHT = 1000


def train_counts(blocks: DataFrame, tokens: str = "input_ids") -> DataFrame:
    """(prev, next, n) over training blocks."""
    return pair_counts(blocks, tokens)


def vocabulary_size(counts: DataFrame) -> DataFrame:
    """Number of different tokens, from the pair counts: a token of a block of two or more is in a pair."""
    tokens = counts.select(F.explode(F.array("prev", "next")).alias("token"))
    return tokens.agg(F.count_distinct("token").alias("v"))


def lm_perplexity(
    held: DataFrame, counts: DataFrame, vocab_size: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Add-one smoothed perplexity of held-out pair counts (by..., prev, next, n).

    -ln p(next | prev) is ln(count(prev) + V) - ln(count(prev, next) + 1). The first part needs one row per context and
    the second only pairs seen in training, so the sums are taken apart: no row of a frequent context waits for its
    context's total.
    """
    nothing = F.lit(0.0)
    seen = held.join(counts.select("prev", "next", F.col("n").alias("seen")), ["prev", "next"])
    pairs = seen.groupBy(*by).agg(
        F.lit(0).cast("long").alias("n"), F.sum(-F.col("n") * F.log(F.col("seen") + 1.0)).alias("nll")
    )
    totals = counts.groupBy("prev").agg(F.sum("n").alias("total"))
    contexts = (
        held.groupBy(*by, "prev")
        .agg(F.sum("n").alias("n"))
        .join(totals, "prev", "left")
        .withColumn("v", vocab_size)
        .groupBy(*by)
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.log(F.coalesce("total", nothing) + F.col("v"))).alias("nll"),
        )
    )
    mean = F.sum("nll") / F.sum("n")
    return pairs.unionByName(contexts).groupBy(*by).agg(
        F.sum("n").alias("pairs"), mean.alias("loss"), F.exp(mean).alias("perplexity")
    )


def top_k(candidates: DataFrame, k: int, context: str = "prev", token: str = "next", n: str = "n") -> DataFrame:
    """The ``k`` heaviest candidates of each context; 0 switches the restriction off.

    Spark limits each task to ``k`` rows per context before the shuffle, so a hot context stays small.
    """
    if k == 0:
        return candidates
    order = W.partitionBy(context).orderBy(F.desc(n), F.md5(F.col(token)), token)
    return candidates.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def nucleus(
    candidates: DataFrame, p: float = TOP_P, context: str = "prev", token: str = "next", n: str = "n", wide: int = WIDE
) -> DataFrame:
    """Smallest set of the heaviest candidates whose share reaches ``p``, an exact decimal; the first always stays.

    Candidates come in order of count, ties by hash. Those of a context meet in one task, which moves each once, unless
    there are more than ``wide``. Adds ``before``, the weight ranked ahead of the candidate, and ``kept_total`` and
    ``kept_count``, the weight and size of the context's kept set. ``candidates`` is read more than once, so hand over a
    table at rest rather than a long computation.
    """
    rows = candidates.select(context, token, n)
    large = F.broadcast(rows.groupBy(context).agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > wide).select(context))
    gathered = _ranked(rows.join(large, context, "left_anti"), p, context, token, n)
    return gathered.unionByName(_spread(rows.join(large, context, "left_semi"), p, context, token, n))


def _ranked(candidates: DataFrame, p: float, context: str, token: str, n: str) -> DataFrame:
    """:func:`nucleus` by the running total over a context's candidates."""
    share = Fraction(str(p))
    whole = W.partitionBy(context)
    order = whole.orderBy(F.desc(n), "_h", token)
    limit = F.sum(n).over(whole) * F.lit(share.numerator).cast("long")
    # the hash is made where the candidates have met
    met = candidates.repartition(context).withColumn("_h", F.unhex(F.md5(token)))
    placed = met.withColumn("before", F.coalesce(F.sum(n).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    kept = placed.withColumn("_limit", limit).filter((F.col("before") * share.denominator < F.col("_limit")) | (F.col("before") == 0))
    return (
        kept.withColumn("kept_total", F.sum(n).over(whole).cast("long"))
        .withColumn("kept_count", F.count(F.lit(1)).over(whole))
        .filter(F.col(context).isNotNull() & F.col(token).isNotNull())
        .select(context, token, n, "before", "kept_total", "kept_count")
    )


def _spread(candidates: DataFrame, p: float, context: str, token: str, n: str) -> DataFrame:
    """:func:`nucleus` of contexts with any number of candidates.

    The running total is built from (context, count, hash prefix) sums, so a context's candidates lie in many tasks.
    """
    tied = candidates.select(context, token, n, F.substring(F.md5(token), 1, TIE_DIGITS).alias("_b"))
    whole = W.partitionBy(context)
    ahead = whole.orderBy(F.desc(n), "_b").rowsBetween(W.unboundedPreceding, -1)
    share = Fraction(str(p))
    den = share.denominator
    limit = F.col("_total") * F.lit(share.numerator).cast("long")
    # Rows of a bucket that start below the limit: the rounded-up quotient, in whole numbers.
    inside = F.expr(f"(_limit - _ahead * {den} + {n} * {den} - 1) div ({n} * {den})")
    kept = F.least(F.col("_m"), F.greatest(inside, F.when(F.col("_ahead") == 0, F.lit(1)).otherwise(F.lit(0))))
    buckets = (
        tied.groupBy(context, n, "_b")
        .agg(F.count(F.lit(1)).alias("_m"))
        .withColumn("_weight", F.col(n) * F.col("_m"))
        .withColumn("_ahead", F.coalesce(F.sum("_weight").over(ahead), F.lit(0)))
        .withColumn("_total", F.sum("_weight").over(whole))
        .withColumn("_limit", limit)
        .withColumn("_kept", kept)
        .withColumn("kept_total", F.sum(F.col("_kept") * F.col(n)).over(whole).cast("long"))
        .withColumn("kept_count", F.sum("_kept").over(whole).cast("long"))
        .filter((F.col("_ahead") * den < F.col("_limit")) | (F.col("_ahead") == 0))
        .select(context, n, "_b", "_ahead", "_limit", "kept_total", "kept_count")
    )
    rank = F.row_number().over(W.partitionBy(context, n, "_b").orderBy("_h", token))
    return (
        tied.join(buckets, [context, n, "_b"])
        .withColumn("_h", F.md5(token))
        .withColumn("before", F.col("_ahead") + (rank - 1) * F.col(n))
        .filter((F.col("before") * den < F.col("_limit")) | (F.col("before") == 0))
        .select(context, token, n, "before", "kept_total", "kept_count")
    )


def candidate_set(
    counts: DataFrame, p: float = TOP_P, k: int = TOP_K, temperature: float = TEMPERATURE, fine: bool = False
) -> DataFrame:
    """What may follow each token and with which weight: temperature, then the ``k`` heaviest, then top-p.

    A temperature other than one raises each context's counts to its inverse, in thousandths and at least one of them.
    ``fine`` gives thousandths in any case, as a repetition penalty needs them.
    """
    if temperature != 1.0:
        counts = counts.withColumn("n", F.greatest(F.lit(1), F.round(F.pow("n", F.lit(1 / temperature)) * WEIGHT)).cast("long"))
    elif fine:
        counts = counts.withColumn("n", F.col("n") * WEIGHT)
    return nucleus(hand_over(top_k(counts, k), "pairs"), p)


def draw(u: Column, total: Column) -> Column:
    """A whole number in [0, total) from a uniform number in [0, 1)."""
    return F.least(F.floor(u * total).cast("long"), total - 1)


def sample_next(kept: DataFrame, seed: int | str, context: str = "prev", token: str = "next", n: str = "n") -> DataFrame:
    """One candidate per context, drawn in proportion to its weight and reproducible from the seed."""
    at = draw(unit_interval(F.col(context), seed), F.col("kept_total"))
    return kept.filter((F.col("before") <= at) & (at < F.col("before") + F.col(n))).select(context, token)


def adjust_scores(
    scores: Column, seen: Column, temperature: float = TEMPERATURE, penalty: float = REPETITION_PENALTY
) -> Column:
    """Repetition penalty on the scores of tokens already seen, then temperature."""
    return F.transform(
        scores,
        lambda z, i: F.when(
            F.array_contains(seen, i), F.when(z > 0, z / penalty).otherwise(z * penalty)
        ).otherwise(z)
        / temperature,
    )


def penalised(weight: Column, penalty: float) -> Column:
    """A candidate's weight once its token has been said: its score, the log of its count, divided by the penalty."""
    return F.greatest(F.lit(1), F.round(F.pow(weight / WEIGHT, F.lit(1 / penalty)) * WEIGHT)).cast("long")


def generate(
    prompts: DataFrame,
    kept: DataFrame,
    key: str,
    prompt: str,
    end: str,
    max_new_tokens: int = MAX_NEW_TOKENS,
    seed: int | str = 690,
    checkpoint_every: int = 5,
    penalty: float = REPETITION_PENALTY,
) -> DataFrame:
    """Continue every prompt token by token until the end marker, all prompts in step.

    A ``penalty`` other than one divides the scores of tokens that the prompt or its continuation holds already (see
    ``penalised``); the candidate sets, of ``candidate_set(..., fine=True)``, are those of the unchanged weights.

    ``prompt`` is a token array and ``kept`` the output of :func:`nucleus`. The candidate sets lie in blocks (see
    ``walk``) that never move. A step sends each prompt to the block of the token it stands at, with the numbers of its
    own tokens if they lose weight and of those of the last few steps; those of all steps meet once at the end.
    """
    repeated = penalty != 1.0
    sets = Blocks(kept, penalised(F.col("n"), penalty) if repeated else None)
    end_number = sets.number_of(end)
    # Keys may repeat; each prompt has a number of its own, at rest before anything is drawn.
    begun = hand_over(
        prompts.select(F.monotonically_increasing_id().alias("_row"), key, F.element_at(F.col(prompt), -1).alias("_last"), F.array_distinct(prompt).alias("_own")),
        "prompts",
    )
    state = sets.looked_up(begun.select("_row", key, "_last"), "_last", "left", context=True)
    copy = F.col("_row") % F.col("_spread")
    none, by_row = F.lit(NONE).cast("long"), sets.block(F.col("_row"), F.lit(0))
    state = state.select(
        "_row", key, F.coalesce("_id", none).alias("_context"), F.coalesce(sets.block(F.col("_id"), copy), by_row).alias("_block")
    )
    if repeated:
        words = begun.select("_row", F.explode("_own").alias("_word"))
        own = sets.looked_up(words, "_word").groupBy("_row").agg(F.collect_list("_id").alias("_seen"))
        # as before, a prompt's tokens count once for each prompt of its key, and not where the key is null
        times = begun.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_times"))
        state = state.join(own, "_row", "left").join(times, F.col(key) == F.col("_key"), "left").drop("_key")
        state = state.withColumns({"_seen": F.coalesce("_seen", F.array().cast("array<bigint>")), "_times": F.coalesce("_times", F.lit(0))})
    parts = []
    state = hand_over(state, "endings").filter(F.col("_context") >= 0)
    for step in range(max_new_tokens):
        u = unit_interval(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(step))), seed)
        state = sets.step(state.withColumn("_u", u), end_number, f"_said_{step}")
        if (step + 1) % checkpoint_every == 0 or step + 1 == max_new_tokens:
            state = hand_over(state, "endings")
            said = [c for c in state.columns if c.startswith("_said_")]
            parts.append(state.select("_row", F.lit(step).alias("_step"), F.posexplode(F.array(*said)).alias("_i", "_id")).filter("_id >= 0"))
            state = state.filter(F.col("_context") >= 0)
            if repeated:
                state = state.withColumn("_seen", F.array_union("_seen", F.array(*said)))
            state = state.drop(*said)
            if state.isEmpty():
                break
    ends = begun.select("_row", key)
    if not parts:
        return ends.select(key, F.lit("").alias("text"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    words = with_entries(every, sets.tokens.select("_id", "token", "_total"), ["_id"], F.coalesce("_total", F.lit(0)))
    order = F.sort_array(F.collect_list(F.struct("_step", "_i", "token")))
    texts = words.groupBy("_row").agg(F.array_join(F.transform(order, lambda s: s["token"]), " ").alias("text"))
    return ends.join(texts, "_row", "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
