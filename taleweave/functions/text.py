"""Text and token-array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The characters Python's str.split() treats as white space.
# The class is spelled out because Java and RE2 do not agree on \s beyond ASCII.
UNICODE_SPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
ASCII_SPACE = "[ \\t\\n\\r]"

# A sentence ends at one of these marks followed by white space.
SENTENCE_END = "[.!?][ \\t\\n\\r\\f]+"

# Tokens are runs of letters and digits, or single other visible characters.
WORD_OR_MARK = r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r\f]"

# Accented Latin letters and their base letters, pairwise.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"
# Letters whose plain spelling has two letters.
DIGRAPHS = {"ß": "ss", "œ": "oe", "æ": "ae"}


def join_text(*parts: Column) -> Column:
    """Parts joined by one space; null if any part is null (as a string join over a missing part fails)."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.lit(" "))
        pieces.append(part)
    return F.concat(*pieces)


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, ASCII_SPACE + "+", " "))


def whitespace_tokens(text: Column) -> Column:
    """Tokens between runs of blanks, tabs and newlines; an empty text has none."""
    return F.array_remove(F.split(single_spaced(text), " ", -1), "")


def word_tokens(text: Column, lower: bool = False) -> Column:
    """Words and single punctuation marks."""
    source = F.lower(text) if lower else text
    return F.regexp_extract_all(source, F.lit(WORD_OR_MARK), F.lit(0))


def words_by_single_space(text: Column) -> Column:
    """Word count where every single space separates, so double spaces give empty words."""
    return F.size(F.split(text, " ", -1))


def words_by_any_space(text: Column) -> Column:
    """Word count where runs of (Unicode) white space separate."""
    return F.size(F.filter(F.split(text, UNICODE_SPACE + "+", -1), lambda t: t != ""))


def sentences(text: Column) -> Column:
    """Non-blank sentences in order."""
    return F.filter(F.split(text, SENTENCE_END, -1), lambda p: p.rlike("[^ \\t\\n\\r\\f]"))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, "[\\r\\n]+", " ")


def fold_accents(text: Column) -> Column:
    """Lower case with Latin accents removed."""
    folded = F.translate(F.lower(text), ACCENTED, UNACCENTED)
    for letter, spelled in DIGRAPHS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(spelled))
    return folded


def truncate(tokens: Column, max_length: int, model_limit: int | None = None) -> Column:
    limit = max_length if model_limit is None else min(max_length, model_limit)
    return F.slice(tokens, 1, limit)


def pad(tokens: Column, length: int | Column, filler: Column) -> Column:
    """Append ``filler`` up to ``length``; longer arrays stay as they are."""
    target = F.lit(length) if isinstance(length, int) else length
    missing = F.greatest(target - F.size(tokens), F.lit(0)).cast("int")
    return F.concat(tokens, F.array_repeat(filler, missing))


def attention_mask(n_tokens: Column, length: int | Column) -> Column:
    """1 for each real token, 0 for each padded slot."""
    target = F.lit(length) if isinstance(length, int) else length
    real = F.least(n_tokens, target).cast("int")
    return F.concat(
        F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), (target - real).cast("int"))
    )


def position_ids(mask: Column) -> Column:
    """Running count of unmasked slots minus one; masked slots get 1.

    The count before a slot is looked up among the unmasked places, so no array is copied step by step.
    """
    places = F.filter(F.transform(mask, lambda m, i: F.when(m != 0, i)), lambda i: i.isNotNull())
    numbered = F.map_from_entries(F.transform(places, lambda i, n: F.struct(i, n)))
    return F.transform(mask, lambda m, i: F.when(m == 0, F.lit(1)).otherwise(F.element_at(numbered, i)))


def padded_position_ids(n_tokens: Column, length: int | Column) -> Column:
    """``position_ids`` where padding follows the tokens, from their number alone and in linear time."""
    target = F.lit(length) if isinstance(length, int) else length
    real = F.least(n_tokens, target).cast("int")
    places = F.when(real > 0, F.sequence(F.lit(0), real - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(places, F.array_repeat(F.lit(1), (target - real).cast("int")))


def last_token_value(values: Column, ids: Column, pad_id: Column) -> Column:
    """The value at (number of real tokens - 1); no real token means the last slot."""
    n = F.size(F.filter(ids, lambda x: x != pad_id))
    return F.when(n > 0, F.get(values, n - 1)).otherwise(F.element_at(values, -1))


def next_pairs(tokens: Column) -> Column:
    """(token, following token) structs of one sequence."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.arrays_zip(
        F.slice(tokens, F.lit(1), n).alias("prev"), F.slice(tokens, F.lit(2), n).alias("next")
    )


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams as space-joined strings (tokens themselves hold no space)."""
    count = F.size(tokens) - F.lit(n - 1)
    starts = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def wrap_special(
    tokens: Column, begin: str = "[CLS]", end: str = "[SEP]", length: int = 128
) -> Column:
    """begin + tokens without leading/trailing '#' + end, cut and filled with '' to ``length``."""
    bare = F.transform(tokens, lambda t: F.regexp_replace(t, "^#+|#+$", ""))
    cut = F.slice(F.concat(F.array(F.lit(begin)), bare, F.array(F.lit(end))), 1, length)
    return pad(cut, length, F.lit(""))


def stop_truncate(text: Column, marker: str, compat: bool = True) -> Column:
    """Text before the first marker.

    Without a marker ``compat`` keeps the habit of slicing at position -1, which drops the last character;
    otherwise the text stays whole.
    """
    at = F.locate(marker, text)
    missing = F.substr(text, F.lit(1), F.greatest(F.length(text) - 1, F.lit(0))) if compat else text
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(missing)


def names_where(flags: Column, names: Sequence[str]) -> Column:
    """Names whose 0/1 flag is set, in order."""
    literal = F.array(*[F.lit(n) for n in names])
    return F.filter(literal, lambda n, i: F.get(flags, i) == 1)


def list_literal(names: Column) -> Column:
    """Names rendered the way a Python list of strings prints."""
    return F.when(F.size(names) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))
    )
