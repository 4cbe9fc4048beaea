"""Phonetic similarity of the tokens of one text.

The matrix of a text is an expression over its own token array: nothing is exploded, joined or shuffled, and memory
per row is bounded by the padded length squared. Tokens of equal codes have equal rows and columns, so a matrix can also be
had as its different rows, ``cells``, with the row of each token, ``slots``, and each row's number of tokens, ``often``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from taleweave.functions.arrays import bind, total
from taleweave.functions.phonetic import phonetic_codes
from taleweave.functions.text import join_text, word_tokens

# Begin and end marker, and the tokens whose distance is always 0.
BEGIN, END = "[CLS]", "[SEP]"
SPECIALS = ["[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]", ""]


def marked_tokens(tokens: Column, length: int | None = 128) -> Column:
    """begin + tokens without '#' at the ends + end, cut to ``length`` (None: whole) and not yet padded."""
    said = tokens if length is None else F.slice(tokens, 1, length)
    bare = F.transform(said, lambda t: F.regexp_replace(t, "^#+|#+$", ""))
    whole = F.concat(F.array(F.lit(BEGIN)), bare, F.array(F.lit(END)))
    return whole if length is None else F.slice(whole, 1, length)


def is_special(token: Column, specials: Sequence[str] = SPECIALS) -> Column:
    return token.isin(*specials)


def codes(tokens: Column, algorithm: str = "META", specials: Sequence[str] = SPECIALS) -> Column:
    """Phonetic code of each token, null for special ones. A word that recurs in the text is coded once."""

    def look_up(said: Column, words: Column, coded: Column) -> Column:
        return F.transform(said, lambda t: F.get(coded, (F.array_position(words, t) - 1).cast("int")))

    return bind(
        tokens,
        lambda said: bind(
            F.array_distinct(said),
            lambda words: bind(
                phonetic_codes(F.transform(words, lambda t: F.when(~is_special(t, specials), t)), algorithm),
                lambda coded: look_up(said, words, coded),
            ),
        ),
    )


def _distances(words: Column) -> Column:
    """Edit distances between all of ``words``; each two are compared once."""

    def both(later: Column) -> Column:
        def cell(i: Column, j: Column) -> Column:
            return F.get(F.get(later, F.least(i, j)), F.abs(i - j) - 1)

        return F.transform(later, lambda row, i: F.concat(F.transform(F.slice(words, 1, i), lambda _, j: cell(i, j)), F.array(F.lit(0)), row))

    return bind(
        F.transform(words, lambda a, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda b: F.levenshtein(a, b))), both
    )


def _by_codes(code_array: Column, length: int, cells: Callable[[Column, Column], Column]) -> Column:
    """Square matrix of ``length`` by its different rows and columns: struct of ``cells``, ``slots`` and ``often``.

    The matrix has cells[slots[i]][slots[j]] at (i, j); ``often`` is how many slots each of the different rows has. ``cells``
    turns (different distances, often) into the cells. Special and padded slots share one row and column, the last, which is
    there only if there is such a slot.
    """

    def place(words: Column, slots: Column) -> Column:
        zero = F.array(F.lit(0))
        blank = F.array(F.array_repeat(F.lit(0), F.size(words) + 1))
        near = bind(
            _distances(words),
            lambda m: F.when(F.array_contains(slots, F.size(words)), F.concat(F.transform(m, lambda r: F.concat(r, zero)), blank)).otherwise(m),
        )

        def parts(m: Column) -> Column:
            often = F.transform(m, lambda _, i: F.size(slots) - F.size(F.array_remove(slots, i)))
            return bind(often, lambda k: F.struct(cells(m, k).alias("cells"), slots.alias("slots"), k.alias("often")))

        return bind(near, parts)

    def with_slots(c: Column, words: Column) -> Column:
        special = F.size(words)
        found = F.transform(
            c, lambda x: F.coalesce((F.array_position(words, x) - 1).cast("int"), special)
        )
        slots = F.concat(found, F.array_repeat(special, F.lit(length) - F.size(c)))
        return bind(slots, lambda s: F.when(s.isNotNull(), place(words, s)))

    return bind(
        code_array, lambda c: bind(F.array_compact(F.array_distinct(c)), lambda words: with_slots(c, words))
    )


def whole_row(row: Column, matrix: Column) -> Column:
    """A row of the square from one of the different rows."""
    return F.transform(matrix["slots"], lambda j: F.get(row, j))


def square(matrix: Column) -> Column:
    """The matrix cell by cell. Rows of equal codes are one shared array."""
    return bind(
        matrix,
        lambda m: bind(
            F.transform(m["cells"], lambda row: whole_row(row, m)),
            lambda wide: F.transform(m["slots"], lambda i: F.get(wide, i)),
        ),
    )


def weighted_sum(values: Column, often: Column) -> Column:
    """Sum of values that each occur ``often`` times."""
    return F.aggregate(F.zip_with(values, often, lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)


def distance_matrix(code_array: Column, length: int, whole: bool = True) -> Column:
    """Square matrix of edit distances, 0 where a token is special or padding; not ``whole``: by its different rows."""
    parts = _by_codes(code_array, length, lambda near, often: near)
    return square(parts) if whole else parts


def similarity_matrix(code_array: Column, length: int, whole: bool = True) -> Column:
    """The distances inverted and put through one softmax, as :func:`inverted` and :func:`matrix_softmax` do.

    largest - d + 1 less its own maximum is smallest - d, and the smallest distance is that of a special token, 0, or
    else of a token with itself, 0. So each cell is exp(-d) over the sum of all cells, which the distinct codes and
    their frequencies give without visiting every cell.
    """

    def normalised(near: Column, often: Column) -> Column:
        weights = F.transform(near, lambda row: F.transform(row, lambda d: F.exp(-d.cast("double"))))
        return bind(weights, lambda e: bind(often.cast("array<double>"), lambda k: _shares(e, k)))

    parts = _by_codes(code_array, length, normalised)
    return square(parts) if whole else parts


def _shares(e: Column, often: Column | None) -> Column:
    """Cells over the sum of all cells of the square, whose rows and columns occur ``often`` times (None: once)."""

    add = total if often is None else lambda values: weighted_sum(values, often)
    return bind(add(F.transform(e, add)), lambda s: F.transform(e, lambda r: F.transform(r, lambda x: x / s)))


def inverted(matrix: Column) -> Column:
    """largest - value + 1, so that the nearest pair has the highest score; also on the cells of different rows."""
    return bind(
        matrix,
        lambda m: bind(
            F.array_max(F.transform(m, lambda r: F.array_max(r))),
            lambda top: F.transform(m, lambda r: F.transform(r, lambda d: top - d + 1)),
        ),
    )


def matrix_softmax(matrix: Column, often: Column | None = None) -> Column:
    """Softmax over all cells of the matrix together; of different rows with the numbers they occur ``often``."""

    def scaled(m: Column) -> Column:
        return bind(
            F.array_max(F.transform(m, lambda r: F.array_max(r))),
            lambda top: F.transform(m, lambda r: F.transform(r, lambda s: F.exp((s - top).cast("double")))),
        )

    if often is None:
        return bind(matrix, lambda m: bind(scaled(m), lambda e: _shares(e, None)))
    return bind(matrix, lambda m: bind(often.cast("array<double>"), lambda k: bind(scaled(m), lambda e: _shares(e, k))))


def pair_similarity(
    df: DataFrame,
    text_a: str,
    text_b: str | None = None,
    length: int = 128,
    algorithm: str = "META",
    name: str = "similarity",
    whole: bool = True,
) -> DataFrame:
    """Add the similarity matrix of a text, or of two texts joined by a space, as a feature column."""
    text = F.col(text_a) if text_b is None else join_text(F.col(text_a), F.col(text_b))
    tokens = marked_tokens(word_tokens(text), length)
    return df.withColumn(name, similarity_matrix(codes(tokens, algorithm), length, whole))


def attended(own: Column, other: Column) -> Column:
    """What the words of the first text attend to in the second one: ``own`` of :func:`attended_both`."""
    return attended_both(own, other)["own"]


def attended_both(own: Column, other: Column) -> Column:
    """Means over the words of each text of the other text's values, weighted by similarity: struct of ``own``, what the words
    of the first text attend to, and ``other``; null where one has no words.

    Both are arrays of different codes with the number ``n`` of their words and the sum ``v`` of the words' values. A word
    attends to another one with weight exp(-distance of their codes), as in the similarity matrix, so each code of one
    text meets each of the other's once, however many words share it and for both directions.
    """

    def numbers(side: Column, name: str) -> Column:
        return F.transform(side, lambda x: x[name].cast("double"))

    def weighted(weights: Column, values: Column) -> Column:
        return F.aggregate(F.zip_with(weights, values, lambda w, v: w * v), F.lit(0.0), lambda a, x: a + x)

    def mean(near: Column, side: Column, sizes: Column, sums: Column) -> Column:
        def taken(n: Column, v: Column) -> Column:
            return F.zip_with(near, side, lambda row, x: x["n"] * weighted(row, v) / weighted(row, n))

        words = F.aggregate(side, F.lit(0).cast("long"), lambda s, x: s + x["n"])
        each = bind(sizes, lambda n: bind(sums, lambda v: taken(n, v)))
        return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / words

    def both(near: Column) -> Column:
        turned = F.transform(other, lambda _, j: F.transform(near, lambda row: F.get(row, j)))
        return F.struct(
            mean(near, own, numbers(other, "n"), numbers(other, "v")).alias("own"),
            mean(turned, other, numbers(own, "n"), numbers(own, "v")).alias("other"),
        )

    near = F.transform(own, lambda x: F.transform(other, lambda y: F.exp(-F.levenshtein(x["code"], y["code"]).cast("double"))))
    return F.when((F.size(own) > 0) & (F.size(other) > 0), bind(near, both))


def matrix_rows(df: DataFrame, key: str, matrix: str, of: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Long form of a matrix column: (key, i, row).

    With ``of`` the matrix is given by its different rows, and ``row`` is what ``of`` makes of (different row, matrix), once
    for each of them. The outer form keeps the optimizer from computing the matrix once more for a "not empty" filter.
    """
    rows = F.col(matrix)
    if of is not None:
        rows = bind(
            rows,
            lambda m: bind(
                F.transform(m["cells"], lambda r: of(r, m)),
                lambda made: F.transform(m["slots"], lambda i: F.get(made, i)),
            ),
        )
    return df.select(key, F.posexplode_outer(rows).alias("i", "row"))
