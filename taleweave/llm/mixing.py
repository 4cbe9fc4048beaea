"""Mixing sources to target weights by Poisson replication.

A source's mean rate of repetition is what brings its share of bytes to its target. Each document draws the number of its
copies by inverting the Poisson distribution of that mean at a point that a hash of the document sets, and all copies are
put in the order of another hash over the whole mixture. Documents and their copies move once.

Without given weights a source aims at the square root of its bytes, and the mixture as a whole keeps its expected size;
given weights need not sum to one, and a source without a weight is left out. Rows without a source form a source of
their own. A null text is an empty one; a text weighs its UTF-8 bytes and one more. Rows that repeat an id draw by their
text as well; rows that repeat both draw alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from taleweave.llm.common import boxed, whole_text
from taleweave.session import hand_over

SEED = "mix"
#: Bits of the point at which the distribution is inverted, and of the key of the final order.
_POINT_BITS, _ORDER_BITS = 48, 60


def _hashed(bits: int, *parts: Column) -> Column:
    digest = F.md5(F.concat_ws("-", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, bits // 4), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Each source's bytes and mean number of copies (source, bytes, rate)."""
    sizes = docs.groupBy("source").agg(F.sum(F.octet_length(whole_text()).cast("long") + 1).alias("bytes"))
    if weights is None:
        goal = F.sqrt(F.col("bytes").cast("double"))
    else:
        pairs = [x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))]
        goal = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = hand_over(sizes.withColumn("goal", goal), "source-sizes")
    whole = sizes.agg(F.sum("bytes"), F.sum("goal")).first()  # two numbers
    all_bytes, all_goals = (F.lit(x or 0).cast("double") for x in whole)
    rate = F.round(F.col("goal") / all_goals * all_bytes / F.col("bytes"), 6)
    return sizes.select("source", "bytes", rate.alias("rate"))


def distribution(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... as far as they can be told from one by the points drawn."""
    far = (rate + 12 * F.sqrt(rate) + 40).cast("int")
    first = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def add(state: Column, k: Column) -> Column:
        log = state["log"] + F.log(rate) - F.log(k.cast("double"))
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(state["all"], F.array(total)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), far), first, add)["all"]).otherwise(F.array(F.lit(1.0)))


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, seed: str = SEED, report: bool = False
) -> DataFrame:
    """All copies of all documents in their final order, with the columns of ``docs``.

    With ``report``, doc_id, source, copies (of the document), copy (its number) and shuffle_key instead. Partitions follow
    each other in the order of shuffle_key and are sorted by it.
    """
    known = [F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed")]
    # at rest its size is known, so a table of few sources is broadcast and texts need not meet their source
    rates = source_rates(docs, weights).select(*known, distribution(F.col("rate")).alias("upto"))
    rates = hand_over(rates, "rates")
    text = F.md5(whole_text().cast("binary"))
    key = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    point = _hashed(_POINT_BITS, F.lit(seed), key) / F.lit(float(1 << _POINT_BITS))
    rows = docs.select(boxed(docs), *known, key.alias("key"), point.alias("point")).join(rates, ["name", "unnamed"])
    rows = rows.withColumn("copies", F.size(F.filter("upto", lambda p: p <= F.col("point")))).filter("copies > 0")
    rows = rows.select("doc", "key", "copies", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    order = _hashed(_ORDER_BITS, F.lit(f"{seed}-order"), F.col("key"), F.col("copy").cast("string"))
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.lit(count - 1), F.floor(F.col("shuffle_key") / F.lit(float(1 << _ORDER_BITS)) * count).cast("int"))
    rows = rows.select("doc", "copies", "copy", order.alias("shuffle_key"))
    rows = rows.repartitionById(count, part).sortWithinPartitions("shuffle_key", "copy")
    if report:
        return rows.select("doc.doc_id", "doc.source", "copies", "copy", "shuffle_key")
    return rows.select("doc.*")
