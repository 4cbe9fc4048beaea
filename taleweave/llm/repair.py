"""Conversation structure repair by weighted CYK interval parsing.

A conversation is repaired when the initials of its roles read ``(s?(ua)+)?``. Rows are kept (cost 0), given the role user
or assistant (2) or deleted (3), and empty user or assistant rows are inserted anywhere (2). Blank rows and rows whose
role and text were seen earlier must be deleted; a truncated row that stays adds 1. The cheapest repair is found, among
equally cheap ones that with the least audit, the initials of its edits in order.

The grammar is in Chomsky normal form. Its nonterminals are the factors of the language by their first and last role
(``UA``: begins with a user's turn, ends with an assistant's), ``S`` for a system row alone and ``E`` for nothing left.
A cell holds the least (cost, audit) of each nonterminal over a span of rows. Cells are closed under insertion at either
end and combined bottom-up by span length over all splits, in blocks of ``BLOCK`` spans; the cells of blocks are the
terminals of the next level, so a conversation of any length is parsed in time linear in its rows. This is exact:
every factor has a nonterminal, and of two repairs of the same rows with equal cost neither audit begins the other.

Rows are sorted by range over conversation and turn, so a long conversation is spread over tasks; each task turns what it
has of a conversation into one cell, and a conversation has at most one cell for each task. Only roles, turns and digests
of texts are sorted. The texts move once, to be written out or hashed in order; a SHA-256 can only be made in order, so
this step streams a conversation through one task without holding it.

A null role or text is one space. Rows are in order of their turn, null turns first, then of role and of the text's md5.
An empty role has no initial and can't be kept. Rows without a conversation id make one conversation. Repeated rows are
duplicates of the first. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from taleweave.session import hand_over

#: Costs of the edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Spans that are combined at a time.
BLOCK = 16

NONTERMINALS = ["E", "S", "UU", "UA", "AU", "AA", "SU", "SA"]
E, S, UU, UA, AU, AA, SU, SA = range(8)
#: Nonterminals of a whole repaired conversation.
START = (E, UA, SA)

#: Least (cost, audit) of each nonterminal over a span, None where it has none.
Cell = tuple[tuple[int, str] | None, ...]


def _rules() -> list[tuple[int, int, int]]:
    """(whole, left, right): two factors may stand side by side if a user's and an assistant's turn meet, or s and u."""
    out = [(x, E, x) for x in range(8)] + [(x, x, E) for x in range(1, 8)]
    for left in range(1, 8):
        for right in (UU, UA, AU, AA):
            a, b = NONTERMINALS[left], NONTERMINALS[right]
            if a[-1] + b[0] in ("SU", "UA", "AU"):
                out.append((NONTERMINALS.index(a[0] + b[-1]), left, right))
    return out


RULES = _rules()
_INSERTED: Cell = (None, None, (INSERT, "I"), None, None, (INSERT, "I"), None, None)


def _combine(best: list[tuple[int, str] | None], left: Cell, right: Cell) -> bool:
    """Lower the entries of ``best`` by the rules over two spans side by side; whether any was."""
    lowered = False
    for x, b, c in RULES:
        l, r = left[b], right[c]  # noqa: E741
        if l is None or r is None:
            continue
        cost, old = l[0] + r[0], best[x]
        if old is None or cost < old[0] or (cost == old[0] and l[1] + r[1] < old[1]):
            best[x] = (cost, l[1] + r[1])
            lowered = True
    return lowered


def close(cell: Cell) -> Cell:
    """With rows inserted before and after, as long as that lowers an entry."""
    best = list(cell)
    while True:
        before = tuple(best)
        lowered = _combine(best, before, _INSERTED)
        if not (_combine(best, _INSERTED, before) or lowered):
            return tuple(best)


def parse(cells: list[Cell]) -> Cell:
    """The cell of all spans together: every span of two, then of three, ..., over all its splits."""
    n = len(cells)
    spans = {(i, i + 1): close(c) for i, c in enumerate(cells)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            best: list[tuple[int, str] | None] = [None] * 8
            for k in range(i + 1, i + length):
                _combine(best, spans[i, k], spans[k, i + length])
            spans[i, i + length] = close(tuple(best))
    return spans[0, n]


def parse_long(cells: list[Cell]) -> Cell:
    """``parse`` in blocks, whose cells are parsed in turn."""
    while len(cells) > BLOCK:
        cells = [parse(cells[i : i + BLOCK]) for i in range(0, len(cells), BLOCK)]
    return parse(cells) if cells else close(((0, ""),) + (None,) * 7)


#: Kinds of initials: none of the three, system, user, assistant. A row's code is 0 if it must be deleted, else
#: 1 + 2 * kind + truncated.
KINDS = " sua"


def terminal(code: int) -> Cell:
    """The cell of one row."""
    cell: list[tuple[int, str] | None] = [None] * 8
    cell[E] = (DELETE, "D")
    if code:
        kind, cut = divmod(code - 1, 2)
        cell[UU] = cell[AA] = (REROLE + cut * TRUNCATED, "R")
        if kind:
            cell[(S, UU, AA)[kind - 1]] = (cut * TRUNCATED, "K")
    return tuple(cell)


_TERMINALS = [terminal(c) for c in range(9)]


@lru_cache(1 << 15)
def _parse_codes(codes: tuple[int, ...]) -> Cell:
    """Short runs of codes recur in many conversations."""
    return parse([_TERMINALS[c] for c in codes])


class _Run:
    """What a task has of one conversation: rows come in order, whole blocks are parsed at once."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.codes: list[int] = []
        self.levels: list[list[Cell]] = []
        self.first = self.last = None
        self.illegal = 0

    def add(self, code: int, kind: int, copies: int) -> None:
        """A row and its further copies, which must be deleted."""
        if self.first is None:
            self.first = kind
        elif (self.last, kind) not in _LEGAL:
            self.illegal += 1
        self.illegal += copies - 1
        self.last = kind
        self._add(code)
        if copies <= BLOCK:
            for _ in range(copies - 1):
                self._add(0)
        else:
            self._flush()
            self._push(0, ((DELETE * (copies - 1), "D" * (copies - 1)),) + (None,) * 7)

    def _add(self, code: int) -> None:
        self.codes.append(code)
        if len(self.codes) == BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.codes:
            self._push(0, _parse_codes(tuple(self.codes)))
            self.codes = []

    def _push(self, level: int, cell: Cell) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(cell)
        if len(self.levels[level]) == BLOCK:
            whole = parse(self.levels[level])
            self.levels[level] = []
            self._push(level + 1, whole)

    def row(self, part: int) -> tuple:
        self._flush()
        cell = parse_long([c for level in reversed(self.levels) for c in level])
        costs = [c[0] if c else None for c in cell]
        return self.conv_id, part, self.first, self.last, self.illegal, costs, [c[1] if c else None for c in cell]


#: Kinds that may follow each other: su, ua, au.
_LEGAL = {(1, 2), (2, 3), (3, 2)}
_OUT = 4096


def _id_field(rows: DataFrame) -> StructField:
    return StructField("conv_id", rows.schema["conv_id"].dataType)


def _cells_schema(rows: DataFrame) -> StructType:
    ints = [StructField(n, IntegerType()) for n in ("part", "first", "last")]
    cell = [StructField("costs", ArrayType(LongType())), StructField("audits", ArrayType(StringType()))]
    return StructType([_id_field(rows), *ints, StructField("illegal", LongType()), *cell])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _parse_rows(id_type: pa.DataType):
    schema = pa.schema(
        [
            ("conv_id", id_type),
            *[(n, pa.int32()) for n in ("part", "first", "last")],
            ("illegal", pa.int64()),
            ("costs", pa.list_(pa.int64())),
            ("audits", pa.list_(pa.string())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now: _Run | None = None
        out: list[tuple] = []
        for batch in batches:
            for conv_id, code, kind, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.append(now.row(part))
                    now = _Run(conv_id)
                now.add(code, kind, copies)
            if len(out) >= _OUT:
                yield _batch(out, schema)
                out = []
        if now is not None:
            out.append(now.row(part))
        yield _batch(out, schema)

    return run


_PLAN = StructType(
    [StructField("illegal", LongType()), StructField("cost", LongType()), StructField("audit", StringType())]
)


@F.arrow_udf(_PLAN)
def _whole(cells: pa.Array) -> pa.Array:
    """Cells of a conversation's tasks, in order, to its cheapest repair."""
    out = []
    for parts in cells.to_pylist():
        illegal = sum(p["illegal"] for p in parts)
        illegal += sum((p["last"], q["first"]) not in _LEGAL for p, q in zip(parts, parts[1:], strict=False))
        cells_ = [tuple((c, a) if c is not None else None for c, a in zip(p["costs"], p["audits"], strict=True)) for p in parts]
        cell = parse_long(cells_) if len(cells_) > 1 else cells_[0]
        cost, audit = min(cell[x] for x in START if cell[x] is not None)
        out.append({"illegal": illegal, "cost": cost, "audit": audit})
    return pa.array(out, pa.struct([("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))


#: Order of a conversation's rows; ``turn`` has nulls first.
ORDER = ["turn", "role", "digest"]


def _rows(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    space = F.lit(" ")
    text = F.coalesce(F.col("text"), space)
    return rows.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), space).alias("role"),
        F.md5(text.cast("binary")).alias("digest"),
        text.alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
    )


def _narrow(rows: DataFrame) -> DataFrame:
    """Different rows without their texts: whether they are blank, their number of copies, whether one is the first."""
    ends = F.regexp_extract(F.col("text"), r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    first = F.substring("role", 1, 1)
    kind = F.when(first == "", 0).otherwise(F.greatest(F.position(first, F.lit(KINDS)) - 1, F.lit(0)))
    # the same role and text have the same flags, so that copies meet as one row
    keyed = rows.select(
        "conv_id", *ORDER, kind.cast("int").alias("kind"), (ends == "").alias("blank"), (~ends.rlike("[.!?]")).alias("cut"), "copies"
    )
    keyed = keyed.groupBy("conv_id", *ORDER, "kind", "blank", "cut").agg(F.sum("copies").alias("copies"))
    keyed = hand_over(keyed, "turns")
    since = F.min(F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn")))["turn"]
    again = keyed.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
    again = again.agg(since.alias("since"), F.count("*").alias("n")).filter("n > 1")
    again = hand_over(again, "seen-again")  # its size decides how it is joined; a frequent text's rows can be split
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    marked = keyed.join(again, same, "left")
    first = F.col("n").isNull() | F.col("turn").eqNullSafe(F.col("since"))
    return marked.select("conv_id", *ORDER, "kind", "blank", "cut", "copies", first.alias("first"))


def plans(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """Each conversation's conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit.

    ``copies`` says how often a row stands; the rows of conversations are conv_id, turn, role and text.
    """
    narrow = _narrow(_rows(rows, copies))
    turn = F.col("turn").cast("decimal(20,0)")
    gaps = F.max(turn) - F.min(turn) + 1 - F.count_distinct("turn")
    gaps = F.when(gaps <= 2**63 - 1, gaps).when(gaps.isNotNull(), F.lit(2**63 - 1))
    later = F.col("copies") - F.col("first").cast("long")
    stats = narrow.groupBy("conv_id").agg(
        F.coalesce(gaps.cast("long"), F.lit(0).cast("long")).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(later)).alias("duplicate"),
        F.sum((F.col("first") & ~F.col("blank") & F.col("cut")).cast("long")).alias("truncated"),
    )
    stays = F.col("first") & ~F.col("blank")
    code = F.when(stays, 1 + 2 * F.col("kind") + F.col("cut").cast("int")).otherwise(0)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = narrow.select("conv_id", *ORDER, code.alias("code"), "kind", "copies")
    dealt = dealt.repartitionByRange(tasks, "conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    id_type = _arrow_type(rows)
    cells = dealt.select("conv_id", "code", "kind", "copies").mapInArrow(_parse_rows(id_type), _cells_schema(rows))
    parts = F.sort_array(F.collect_list(F.struct("part", "first", "last", "illegal", "costs", "audits")))
    found = cells.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", _whole("parts").alias("plan"))
    found = found.select(F.col("conv_id").alias("c"), "plan.*")
    joined = stats.join(found, F.col("conv_id").eqNullSafe(F.col("c")))
    return joined.drop("c")


def _arrow_type(rows: DataFrame) -> pa.DataType:
    return to_arrow_type(rows.schema["conv_id"].dataType)


def _streamed(rows: DataFrame, found: DataFrame, copies: Column | None) -> DataFrame:
    """Each conversation's audit, then its rows in order, one conversation after the other within a task."""
    texts = _rows(rows, copies).select("conv_id", F.lit(1).alias("kind"), *ORDER, "text", "copies")
    heads = found.select("conv_id", F.col("audit").alias("text"), F.lit(0).alias("kind"))
    both = texts.unionByName(heads, allowMissingColumns=True)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    return dealt.select("conv_id", "kind", "role", "text", "copies")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, position, edit, role, text) of every row of the repaired conversations; position None begins one."""
    audit, at, rest, place, system = "", 0, 0, 0, 0

    def turn() -> str:
        return ("user", "assistant")[(place - system) % 2]

    for batch in batches:
        for conv_id, kind, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                audit, at, place = text, 0, 0
                rest = len(audit.rstrip("I"))  # from here on rows are only inserted
                system = (len(audit) - audit.count("D")) % 2
                yield conv_id, None, None, None, None
                continue
            for _ in range(copies):
                while audit[at] == "I":
                    yield conv_id, place, "I", turn(), ""
                    at, place = at + 1, place + 1
                edit = audit[at]
                at += 1
                if edit != "D":
                    yield conv_id, place, edit, role if edit == "K" else turn(), text
                    place += 1
            while rest <= at < len(audit):
                yield conv_id, place, "I", turn(), ""
                at, place = at + 1, place + 1


def repaired(rows: DataFrame, found: DataFrame | None = None, copies: Column | None = None) -> DataFrame:
    """The rows of the repaired conversations: conv_id, position, edit (K, R or I), role and text."""
    found = hand_over(plans(rows, copies), "plans") if found is None else found
    schema = pa.schema(
        [("conv_id", _arrow_type(rows)), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in _edited(batches):
            if row[1] is None:
                continue
            out.append(row)
            size += len(row[4])
            if len(out) >= _OUT or size > 1 << 22:
                yield _batch(out, schema)
                out, size = [], 0
        yield _batch(out, schema)

    text = [StructField(n, StringType()) for n in ("edit", "role", "text")]
    return _streamed(rows, found, copies).mapInArrow(run, StructType([_id_field(rows), StructField("position", LongType()), *text]))


def repaired_hashes(rows: DataFrame, found: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id and the SHA-256 of each repaired conversation's ``role:text`` lines, joined by line breaks."""
    schema = pa.schema([("conv_id", _arrow_type(rows)), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, now = [], None, None
        for conv_id, position, _, role, text in _edited(batches):
            if position is None:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                if len(out) >= _OUT:
                    yield _batch(out, schema)
                    out = []
                now, digest = conv_id, hashlib.sha256()
            else:
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
        if digest is not None:
            out.append((now, digest.hexdigest()))
        yield _batch(out, schema)

    return _streamed(rows, found, copies).mapInArrow(run, StructType([_id_field(rows), StructField("sha256", StringType())]))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes
    the marks ``.!?`` from it, 3 repeats it (``copies`` is 2), 4 makes it a user's. Nulls are one space."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    rows = rows.select("conv_id", "turn", "role", "text", (F.crc32(name.cast("binary")) % 20).alias("fault"))
    text, fault = F.coalesce(F.col("text"), space), F.col("fault")
    return rows.filter(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), space)).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def repair_report(rows: DataFrame) -> DataFrame:
    """Every conversation of ``rows`` after ``damaged``, with what was wrong, the cheapest repair and its hash."""
    broken = damaged(rows)
    copies = F.col("copies")
    found = hand_over(plans(broken, copies), "plans")
    hashes = repaired_hashes(broken, found, copies).withColumnRenamed("conv_id", "h")
    named = found.withColumnRenamed("conv_id", "c")
    all_ids = rows.select("conv_id").distinct()
    out = all_ids.join(named, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    out = out.join(hashes, F.col("conv_id").eqNullSafe(F.col("h")), "left")
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"),
    )
