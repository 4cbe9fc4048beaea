"""Subword pieces: merges learned from the corpus's word counts, and longest-match pieces of words.

A word is a row of symbols, its characters at first; all but the first carry the mark ``##``. In a round every pair of
neighbouring symbols that is the most frequent one of both its symbols becomes one symbol, so the most frequent pair of
all is always among them and no symbol is in two pairs. Rounds end when enough merges are learned. Learning reads
different words only; after a round the pair counts are brought up to date from the words that changed.

Words are cut into the longest pieces from left to right. Single characters are always pieces, so no word is unknown and
joining the pieces gives the word back. The pieces make one regular expression, a trie whose branches end in the shorter
pieces, so cutting stays a column expression.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from taleweave.functions.arrays import bind
from taleweave.session import hand_over

# Fixed value: what a piece begins with that does not begin its word.
MARK = "##"
MERGES = 200
#: Stands for the begin of a word while it is cut.
_BEGIN = "\x01"


def word_counts(df: DataFrame, words: str) -> DataFrame:
    """(word, n) of an array column of words, which the outer form keeps the optimizer from making twice."""
    rows = df.select(F.posexplode_outer(words).alias("pos", "word")).filter("pos is not null")
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _pairs(words: DataFrame, sign: int = 1) -> DataFrame:
    """(left, right, n) over all neighbouring symbols."""
    symbols = F.split(F.trim("symbols"), " ")
    both = F.arrays_zip(F.slice(symbols, 1, F.size(symbols) - 1).alias("left"), F.slice(symbols, 2, F.size(symbols)).alias("right"))
    pairs = words.filter(F.instr(F.trim("symbols"), " ") > 0).select((F.col("n") * sign).alias("n"), F.inline(both))
    return pairs.groupBy("left", "right").agg(F.sum("n").alias("n"))


def _best(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs that are the most frequent ones of both their symbols, at most ``most`` of them, best first."""
    order = F.struct((-F.col("n")).alias("minus"), "left", "right")
    sides = pairs.select(F.explode(F.array_distinct(F.array("left", "right"))).alias("symbol"), order.alias("o"))
    tops = sides.groupBy("symbol").agg(F.min("o").alias("o"))
    # a pair is chosen when it is the best of as many symbols as it has
    chosen = tops.groupBy("o.left", "o.right", (-F.col("o.minus")).alias("n")).agg(F.count(F.lit(1)).alias("k"))
    whole = F.when(F.col("left") == F.col("right"), 1).otherwise(2)
    return chosen.filter(F.col("k") == whole).orderBy(F.desc("n"), "left", "right").limit(most).select("left", "right", "n")


def _quoted(symbol: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in symbol)


def _merged(symbols: Column, pairs: list[tuple[str, str]]) -> Column:
    """All pairs joined, each from left to right."""
    found = "|".join(f"({_quoted(left)}) {MARK}({_quoted(right.removeprefix(MARK))})" for left, right in pairs)
    groups = "".join(f"${k + 1}" for k in range(2 * len(pairs)))
    return F.regexp_replace(symbols, f" (?:{found})(?= )", f" {groups}")


def learn_merges(counts: DataFrame, merges: int = MERGES) -> DataFrame:
    """(rank, round, left, right, piece, n) of the merges learned from ``counts`` (word, n); n is the pair's count.

    The driver holds the merges only.
    """
    spark = counts.sparkSession
    marked = F.regexp_replace(F.col("word"), r"(?s)(.)", f" {MARK}$1")
    symbols = F.concat(F.lit(" "), F.substring(marked, 2 + len(MARK), 1 << 30), F.lit(" "))
    words = hand_over(counts.filter("word <> '' and word not like '% %'").select(symbols.alias("symbols"), "n"), "words")
    pairs = hand_over(_pairs(words), "symbol-pairs")
    found: list[tuple[int, int, str, str, str, int]] = []
    turn = 0
    while len(found) < merges:
        best = [(r["left"], r["right"], r["n"]) for r in _best(pairs, merges - len(found)).collect()]
        if not best:
            break
        for left, right, n in best:
            found.append((len(found), turn, left, right, left + right.removeprefix(MARK), n))
        joined = _merged(F.col("symbols"), [b[:2] for b in best])
        following = hand_over(words.withColumn("before", F.col("symbols")).withColumn("symbols", joined), "words")
        changed = following.filter("symbols <> before")
        gone = _pairs(changed.select(F.col("before").alias("symbols"), "n"), -1)
        added = _pairs(changed.select("symbols", "n"))
        pairs = pairs.unionByName(gone).unionByName(added).groupBy("left", "right").agg(F.sum("n").alias("n"))
        pairs = hand_over(pairs.filter("n > 0"), "symbol-pairs")
        words = following.select("symbols", "n")
        turn += 1
    schema = "rank int, round int, left string, right string, piece string, n long"
    return spark.createDataFrame(found, schema)


def piece_pattern(pieces: Iterable[str]) -> str:
    """A regular expression of the longest piece at a place; ``pieces`` are as learned, the word begins with ``_BEGIN``."""
    trie: dict = {}
    for piece in pieces:
        node = trie
        for c in piece.removeprefix(MARK) if piece.startswith(MARK) and piece != MARK else _BEGIN + piece:
            node = node.setdefault(c, {})
        node[""] = {}

    def branches(node: dict) -> str:
        kinds = [_quoted(c) + rest(below) for c, below in sorted(node.items()) if c]
        return kinds[0] if len(kinds) == 1 else f"(?:{'|'.join(kinds)})"

    def rest(node: dict) -> str:
        if not any(node):
            return ""
        return f"(?:{branches(node)})?" if "" in node else branches(node)

    one = f"{_quoted(_BEGIN)}?(?s:.)"
    return f"{branches(trie)}|{one}" if trie else one


def to_pieces(words: Column, pieces: Iterable[str]) -> Column:
    """The pieces of all words of an array, in order; those that go on a word carry the mark.

    All words are cut in one run: each begins with a sign that pieces have at their begin only.
    """
    pattern = F.lit(piece_pattern(pieces))

    def cut(said: Column) -> Column:
        found = F.regexp_extract_all(said, pattern, F.lit(0))
        return F.transform(
            found, lambda p: F.when(p.startswith(_BEGIN), F.substring(p, 2, 1 << 30)).otherwise(F.concat(F.lit(MARK), p))
        )

    def together(said: Column) -> Column:
        # a piece with the sign inside could reach over the begin of the next word
        one_by_one = F.flatten(F.transform(said, lambda w: cut(F.concat(F.lit(_BEGIN), w))))
        apart = F.exists(said, lambda w: w.isNull() | w.contains(_BEGIN))
        return F.when(apart, one_by_one).otherwise(cut(F.array_join(F.transform(said, lambda w: F.concat(F.lit(_BEGIN), w)), "")))

    return bind(F.filter(words, lambda w: w != ""), together)


def joined_words(pieces: Column) -> Column:
    """Words put together from their pieces."""
    spaced = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith(MARK), F.substring(p, 3, 1 << 30)).otherwise(F.concat(F.lit(_BEGIN), p))), "")
    return F.filter(F.split(spaced, _BEGIN), lambda w: w != "")
