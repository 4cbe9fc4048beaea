"""Candidate sets packed for walks: all that a context may go on with lies in one block, as numbers.

Tokens are numbered. A block holds some 2^18 candidates as arrays in one row, so a step reads bytes rather than
rows, and a prompt that stands at a context finds its candidate, and which of its own tokens are candidates, by binary
search in the context's block. The blocks lie in buckets and never move; prompts do. A context with more than a block's
share of all weight has its candidates in several blocks, and its prompts are dealt over them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from taleweave.operators.ranking import row_index
from taleweave.session import hand_over, hand_over_by, with_entries

# Candidates that a block should have.
BLOCK = 1 << 18
# Number of no token.
NONE = -1

_BYTES = ("contexts", "totals", "sizes", "token", "before", "n")
_PENALTY_BYTES = ("low", "by_token")


def numbered(kept: DataFrame, blocks: int) -> DataFrame:
    """Tokens of the candidate sets: (token, _id, _total, _spread); ``_total`` is null where a token is no context.

    ``_spread`` is the number of blocks that a context needs, by its share of all weight, so that none has more than its
    part of the prompts."""
    heads = kept.filter("before = 0").select(F.col("prev").alias("token"), F.col("kept_total").alias("_total"))
    others = kept.select(F.col("next").alias("token"), F.lit(None).cast("long").alias("_total"))
    tokens = hand_over(row_index(heads.unionByName(others).groupBy("token").agg(F.max("_total").alias("_total")), "token", "_id"), "tokens")
    whole = tokens.agg(F.coalesce(F.sum(F.col("_total").cast("double")), F.lit(1.0))).first()[0]
    share = F.ceil(F.col("_total") * float(blocks) / F.lit(float(whole))).cast("int")
    return tokens.withColumn("_spread", F.least(F.greatest(F.coalesce(share, F.lit(1)), F.lit(1)), F.lit(blocks)))


def _labels(kept: DataFrame, blocks: int) -> list[int]:
    """Names of the blocks, such that the buckets of :func:`hand_over_by` have equally many."""
    spark = kept.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tried = spark.range(16 * blocks + 64).select(F.col("id").cast("int").alias("i"))
    seen: dict[int, int] = {}
    ranked = []
    for i, bucket in tried.select("i", F.pmod(F.hash("i"), F.lit(buckets))).collect():  # bounded by the number of blocks
        ranked.append((seen.setdefault(bucket, 0), i))
        seen[bucket] += 1
    return [i for _, i in sorted(ranked)[:blocks]]


# Functions of the workers hold what they use, so that workers need not have this package.
def _pack() -> Callable[[pa.Table], pa.Table]:
    def narrow(values: np.ndarray) -> bytes:
        """Four bytes a value where they are enough."""
        return values.astype("<u4" if not len(values) or values.max() < 1 << 32 else "<i8").tobytes()

    def pack(table: pa.Table) -> pa.Table:
        of = {name: table[name].to_numpy() for name in table.column_names}
        placed = np.lexsort((of["before"], of["context"]))
        of = {name: values[placed] for name, values in of.items()}
        contexts, first, sizes = np.unique(of["context"], return_index=True, return_counts=True)
        packed = {"contexts": contexts, "totals": of["total"][first], "sizes": sizes, **{name: of[name] for name in ("token", "before", "n")}}
        if "low" in of:
            packed |= {"low": of["low"], "by_token": np.lexsort((of["token"], of["context"]))}
        counts = {"block": pa.array([of["block"][0]], pa.int32()), "size": pa.array([len(placed)], pa.int64()), "heads": pa.array([len(contexts)], pa.int64())}
        return pa.table(counts | {name: pa.array([narrow(values)], pa.binary()) for name, values in packed.items()})

    return pack


class Blocks:
    """Candidate sets in blocks, with the tokens' numbers. ``low``: each candidate's weight once its token has been said."""

    def __init__(self, kept: DataFrame, low: Column | None = None, size: int = BLOCK):
        kept = hand_over(kept, "candidates")
        buckets = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.repeated = low is not None
        self.blocks = buckets * max(1, -(-kept.count() // (size * buckets)))
        self.labels = _labels(kept, self.blocks)
        self.tokens = hand_over(numbered(kept, self.blocks), "numbers")
        self.vocabulary = self.tokens.count()
        spread = self.tokens.filter("_spread > 1").select("_id", "_spread").collect()  # fewer than there are blocks
        self.wide = sorted((r["_id"], r["_spread"]) for r in spread)
        names = [F.col("before"), F.col("n")] + ([low.alias("low")] if self.repeated else [])
        rows = kept.select("prev", "next", *names)
        columns = ["before", "n"] + ["low"] * self.repeated
        token = self.looked_up(rows, "next").select("prev", F.col("_id").alias("token"), *columns)
        whole = self.looked_up(token, "prev", context=True).select(
            F.col("_id").alias("context"), F.col("_total").alias("total"), "token", *columns, F.explode(F.sequence(F.lit(0), F.col("_spread") - 1)).alias("_copy")
        )
        dealt = whole.select(self.block(F.col("context"), F.col("_copy")).alias("block"), "context", "total", "token", *columns)
        parts = _BYTES + (_PENALTY_BYTES if self.repeated else ())
        schema = "block int, size long, heads long, " + ", ".join(f"{name} binary" for name in parts)
        self.table = hand_over_by(dealt.groupBy("block").applyInArrow(_pack(), schema), "blocks", "block")

    def looked_up(self, rows: DataFrame, name: str, how: str = "inner", context: bool = False) -> DataFrame:
        """``rows`` with the entry of the token in the column ``name``."""
        table = self.tokens.filter("_total is not null") if context else self.tokens
        return with_entries(rows, table.withColumnRenamed("token", name), [name], F.coalesce("_total", F.lit(0)), how)

    def number_of(self, token: str) -> int:
        row = self.tokens.filter(F.col("token") == F.lit(token)).select("_id").first()
        return NONE if row is None else row["_id"]

    def block(self, number: Column, copy: Column) -> Column:
        """Where a context's candidates lie, or one of its copies of them."""
        return F.get(F.lit(self.labels), ((number + copy) % self.blocks).cast("int"))

    def step(self, rows: DataFrame, end: int, name: str) -> DataFrame:
        """One token further. ``rows`` have the number ``_row``, the ``_context`` a prompt stands at, its ``_block``, the draw
        ``_u`` and, where said tokens lose weight, those of the prompt, ``_seen``, and of the steps before, ``_said_...``, and how
        often each counts, ``_times``. The drawn token's number goes to ``name``, and the prompt to that context; a finished
        prompt stands at none."""
        rows = rows.withColumn(name, F.lit(NONE).cast("long"))
        made = rows.drop("_u")
        said = [c for c in made.columns if c.startswith("_said_") and c != name] if self.repeated else []
        walk = _walk(self.labels, self.wide, self.vocabulary, end, name, said, self.repeated, made.columns)
        return rows.groupBy("_block").cogroup(self.table.groupBy("block")).applyInArrow(walk, made.schema)


def _walk(
    labels: list[int], wide: list[tuple[int, int]], vocabulary: int, end: int, name: str, said: list[str], repeated: bool, columns: list[str]
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = np.array(labels, "int32")
    wide_ids, wide_spread = (np.array([w[k] for w in wide], "int64") for k in (0, 1))

    def wide_values(data: pa.Buffer, n: int) -> np.ndarray:
        return np.frombuffer(data, "<u4" if data.size == 4 * n else "<i8").astype("int64", copy=False)

    def followed(rows: pa.Table, block: pa.Table) -> np.ndarray:
        """The number of the token drawn for each prompt."""
        out = np.full(rows.num_rows, NONE, "int64")
        if not block.num_rows:
            return out
        size, heads = block["size"][0].as_py(), block["heads"][0].as_py()

        def part(column: str, n: int = size) -> np.ndarray:
            return wide_values(block[column][0].as_buffer(), n)

        contexts, totals, sizes = (part(c, heads) for c in ("contexts", "totals", "sizes"))
        here = rows["_context"].to_numpy()
        place = np.minimum(np.searchsorted(contexts, here), heads - 1)
        live = np.flatnonzero(contexts[place] == here)
        if not len(live):
            return out
        place = place[live]
        token, before, n = (part(c) for c in ("token", "before", "n"))
        # all contexts of the block on one line
        base = np.cumsum(totals) - totals
        owner = np.repeat(np.arange(heads), sizes)
        start = base[owner] + before
        u, total = rows["_u"].to_numpy()[live], totals[place]

        def draw(total: np.ndarray) -> np.ndarray:
            return np.minimum(np.floor(u * total).astype("int64"), total - 1)

        at = corrected(rows, block, live, place, owner, token, before, n, part, draw, total) if repeated else draw(total)
        spot = base[place] + at
        found = np.searchsorted(start, spot, "right") - 1
        hit = (found >= 0) & (spot < start[found] + n[found]) & (owner[found] == place)
        out[live[hit]] = token[found[hit]]
        return out

    def corrected(rows, block, live, place, owner, token, before, n, part, draw, total) -> np.ndarray:
        """A place among the unchanged weights, drawn from the penalised ones: what the penalty takes from a prompt's own
        tokens is taken from the total, and a place below that is moved past what was taken from candidates before it."""
        order, low = part("by_token"), part("low")
        pairs = owner[order] * vocabulary + token[order]
        own = rows["_seen"].combine_chunks() if isinstance(rows["_seen"], pa.ChunkedArray) else rows["_seen"]
        lengths = np.diff(own.offsets.to_numpy())
        spot = np.full(rows.num_rows, NONE, "int64")
        spot[live] = np.arange(len(live))
        row = np.repeat(spot, lengths)
        values = own.flatten().to_numpy(zero_copy_only=False)
        row, values = row[row >= 0], values[row >= 0]
        for c in said:
            later = rows[c].to_numpy()[live]
            row, values = np.concatenate([row, np.flatnonzero(later >= 0)]), np.concatenate([values, later[later >= 0]])
        wanted = place[row] * vocabulary + values
        at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
        same = pairs[at] == wanted
        # a token may be in ``_seen`` and said again; hits come by prompt, then in order of the candidates
        hits = np.unique(row[same] * len(pairs) + order[at[same]])
        row, entry = hits // len(pairs), hits % len(pairs)
        times = rows["_times"].to_numpy()[live][row]
        row, entry, times = row[times > 0], entry[times > 0], times[times > 0]
        less = times * (n[entry] - low[entry])
        counts = np.bincount(row, minlength=len(live))
        first = np.cumsum(counts) - counts
        through = np.concatenate([[0], np.cumsum(less)])
        ahead = through[:-1] - through[first[row]]
        drawn = draw(total - (through[first + counts] - through[first]))
        begins = before[entry] - ahead
        passed = np.bincount(row[begins <= drawn[row]], minlength=len(live))
        moved = drawn.copy()
        some = np.flatnonzero(passed)
        last = first[some] + passed[some] - 1
        inside = drawn[some] < begins[last] + low[entry[last]]
        moved[some] = np.where(inside, before[entry[last]], drawn[some] + ahead[last] + less[last])
        return moved

    def walk(rows: pa.Table, block: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(columns)
        drawn = followed(rows, block)
        drawn[drawn == end] = NONE
        number = rows["_row"].to_numpy()
        spread = np.ones(len(drawn), "int64")
        if len(wide_ids):
            k = np.minimum(np.searchsorted(wide_ids, drawn), len(wide_ids) - 1)
            spread[wide_ids[k] == drawn] = wide_spread[k][wide_ids[k] == drawn]
        # finished prompts are spread by their own number
        target = np.where(drawn >= 0, drawn + number % spread, number)
        new = {name: pa.array(drawn), "_context": pa.array(drawn), "_block": pa.array(names[target % len(names)])}
        return pa.table({c: new.get(c, rows[c]) for c in columns})

    return walk
