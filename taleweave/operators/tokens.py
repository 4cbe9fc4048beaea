"""Vocabulary, encoding, padding per batch and packing into fixed blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from taleweave.functions.text import attention_mask, next_pairs, pad
from taleweave.operators.ranking import row_index
from taleweave.session import COMMON, hand_over

PAD_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2


def token_rows(df: DataFrame, tokens: str) -> DataFrame:
    """One row per token.

    A plain explode lets the optimizer infer a "not empty" filter on the array, which computes the array a second time
    below whatever shuffle comes first; the outer form does not.
    """
    return df.select(F.explode_outer(tokens).alias("token")).filter("token is not null")


def token_counts(df: DataFrame, tokens: str) -> DataFrame:
    """Corpus frequency of each token, summed inside each task before anything is shuffled."""
    return token_rows(df, tokens).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def build_vocab(df: DataFrame, tokens: str, size: int | None = None) -> DataFrame:
    """Tokens with ids by (count desc, token), all of them or the ``size`` most frequent; 0 is padding, 1 unknown.

    Ids come from a range sort and the sizes of its partitions, so the vocabulary is never in one task.
    """
    counts = token_counts(df, tokens).withColumn("_back", -F.col("n"))
    ranked = row_index(counts, ["_back", "token"], "_i").select("token", "n", (F.col("_i") + FIRST_ID).alias("token_id"))
    ranked = ranked.withColumn("token_id", F.col("token_id").cast("int"))
    return ranked if size is None else ranked.filter(F.col("token_id") < size + FIRST_ID)


def encode(df: DataFrame, key: str, tokens: str, vocab: DataFrame) -> DataFrame:
    """Token ids per text.

    Texts are dealt out by key, taken apart and put together without moving again. The vocabulary's first ids, which are its
    most frequent tokens, are looked up where the texts lie; only the other tokens meet their entry in a shuffle.
    """
    ids = hand_over(vocab.select("token", "token_id"), "vocabulary")
    first = F.col("token_id") < COMMON
    apart = df.select(key, tokens).repartition(key).select(key, F.posexplode_outer(tokens).alias("pos", "token"))
    near = apart.join(F.broadcast(ids.filter(first)), "token", "left")
    pair = F.struct("pos", F.col("token_id").alias("id"))
    known = near.groupBy(key).agg(F.collect_list(F.when(F.col("token_id").isNotNull(), pair)).alias("_known"))
    rest = near.filter("token_id is null and pos is not null").select(F.col(key).alias("_key"), "pos", "token")
    one = F.struct("pos", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("id"))
    other = rest.join(ids.filter(~first), "token", "left").groupBy("_key").agg(F.collect_list(one).alias("_other"))
    whole = F.concat("_known", F.coalesce("_other", F.array().cast("array<struct<pos:int,id:int>>")))
    return known.join(other, F.col(key).eqNullSafe(F.col("_key")), "left").select(
        key, F.transform(F.sort_array(whole), lambda s: s["id"]).alias("input_ids")
    )


def fixed_input(df: DataFrame, tokens: str, length: int, filler: object = PAD_ID) -> DataFrame:
    """Padded token column of fixed length with its mask (tokens must be cut to ``length`` before)."""
    return df.withColumns(
        {
            "attention_mask": attention_mask(F.size(tokens), length),
            tokens: pad(F.col(tokens), length, F.lit(filler)),
        }
    )


def pad_batches(
    df: DataFrame, batch: str, tokens: str, filler: object = PAD_ID, multiple: int = 8
) -> DataFrame:
    """Pad to the longest text of the batch, rounded up to a multiple of ``multiple``."""
    longest = F.max(F.size(tokens)).over(W.partitionBy(batch))
    width = (F.ceil(longest / multiple) * multiple).cast("int")
    return df.withColumn("padded_length", width).withColumns(
        {
            "attention_mask": attention_mask(F.size(tokens), F.col("padded_length")),
            tokens: pad(F.col(tokens), F.col("padded_length"), F.lit(filler)),
        }
    )


def overlength(df: DataFrame, tokens: str, limit: int) -> DataFrame:
    """How many texts are longer than the limit, and the longest."""
    return df.agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.size(tokens) > limit).alias("too_long"),
        F.max(F.size(tokens)).cast("long").alias("longest"),
    )


def batches_of(df: DataFrame, key: str, size: int = 1000, within: str | None = None) -> DataFrame:
    """Number the batches of ``size`` consecutive rows in key order, separately for each value of ``within``.

    Only the keys are sorted and checkpointed; the batch number then joins the rows by their unique key.
    """
    groups = [] if within is None else [within]
    index = row_index(df.select(*groups, key), key, "_i", within)
    return df.join(index.select(key, F.floor(F.col("_i") / size).alias("batch")), key)


def pack_blocks(
    df: DataFrame, key: str, tokens: str, batch: str, block_size: int, by: tuple[str, ...] = ()
) -> DataFrame:
    """Concatenate the tokens of each batch of texts and cut them into full blocks; each batch drops its rest.

    ``by`` names columns, such as the split, inside which batches are numbered.

    Texts meet their batch in one shuffle. They are then cut at block boundaries as slices, not as single tokens, and
    the pieces of a block are already where their batch is, so joining them moves nothing.
    """
    group = [*by, batch]
    before = W.partitionBy(*group).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    placed = (
        df.select(*group, key, tokens, F.size(tokens).cast("long").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter("_n > 0")
    )
    size = F.lit(block_size).cast("long")
    first = F.floor(F.col("_start") / size)
    last = F.floor((F.col("_start") + F.col("_n") - 1) / size)
    pieces = placed.select(*group, tokens, "_start", "_n", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("block") * size - F.col("_start"), F.lit(0))
    hi = F.least((F.col("block") + 1) * size - F.col("_start"), F.col("_n"))
    cut = pieces.select(
        *group,
        "block",
        (F.col("_start") + lo).alias("_at"),
        F.slice(tokens, (lo + 1).cast("int"), (hi - lo).cast("int")).alias("_piece"),
    )
    joined = cut.groupBy(*group, "block").agg(
        F.flatten(
            F.transform(F.sort_array(F.collect_list(F.struct("_at", "_piece"))), lambda s: s["_piece"])
        ).alias("input_ids")
    )
    return joined.filter(F.size("input_ids") == block_size)


def with_lm_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("labels", F.col("input_ids"))


def pair_counts(df: DataFrame, tokens: str, by: tuple[str, ...] = ()) -> DataFrame:
    """How often each token follows each other inside a sequence; the tokens are made once, as in :func:`token_rows`."""
    pairs = df.select(*by, F.explode_outer(next_pairs(F.col(tokens))).alias("pair")).filter("pair is not null").select(*by, "pair.prev", "pair.next")
    return pairs.groupBy(*by, "prev", "next").agg(F.count(F.lit(1)).alias("n"))
