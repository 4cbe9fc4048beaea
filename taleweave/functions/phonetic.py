"""Phonetic codes as column expressions.

All three codes are chains of built-in string functions, so whole corpora are coded inside the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from taleweave.functions.arrays import bind
from taleweave.functions.text import fold_accents

# Refined Soundex digit of each letter (H and W have none).
REFINED_LETTERS = "AEIOUYBPFVCKSGJQXZDTLMNR"
REFINED_DIGITS = "000000112233344555667889"

# The Metaphone rewriting rules in the order they apply, as (pattern, replacement).
METAPHONE_RULES = (
    (r"[^a-z]", r""),
    (r"([bcdfhjklmnpqrstvwxyz])\1+", r"$1"),
    (r"^ae", r"E"),
    (r"^[gkp]n", r"N"),
    (r"^wr", r"R"),
    (r"^x", r"S"),
    (r"^wh", r"W"),
    (r"mb$", r"M"),
    (r"(?!^)sch", r"SK"),
    (r"th", r"0"),
    (r"t?ch|sh", r"X"),
    (r"c(?=ia)", r"X"),
    (r"[st](?=i[ao])", r"X"),
    (r"s?c(?=[iey])", r"S"),
    (r"ck|q", r"K"),
    (r"dg(?=[iey])", r"J"),
    (r"d", r"T"),
    (r"g(?=h[^aeiou])", r""),
    (r"gn(ed)?", r"N"),
    (r"([^g]|^)g(?=[iey])", r"$1J"),
    (r"g+", r"K"),
    (r"ph", r"F"),
    (r"([aeiou])h(?=\b|[^aeiou])", r"$1"),
    (r"[wy](?![aeiou])", r""),
    (r"z", r"S"),
    (r"v", r"F"),
    (r"(?!^)[aeiou]+", r""),
)


def letters_only(word: Column) -> Column:
    return F.regexp_replace(fold_accents(word), "[^a-z]", "")


def soundex(word: Column) -> Column:
    """Four-character Soundex; a word without letters has the empty code."""
    return F.soundex(letters_only(word))


def refined_soundex(word: Column) -> Column:
    """First letter, then one digit per sounding letter with repeats collapsed."""
    letters = F.upper(letters_only(word))
    digits = F.translate(F.regexp_replace(letters, "[HW]", ""), REFINED_LETTERS, REFINED_DIGITS)
    return F.concat(F.substring(letters, 1, 1), F.regexp_replace(digits, r"(.)\1+", "$1"))


def metaphone(word: Column) -> Column:
    return _rewritten(word, METAPHONE_RULES)


def _rewritten(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    code = fold_accents(text)
    for pattern, replacement in rules:
        if pattern.isalpha():
            code = F.replace(code, F.lit(pattern), F.lit(replacement))
        else:
            code = F.regexp_replace(code, pattern, replacement)
    return F.upper(code)


def metaphones(words: Column) -> Column:
    """Metaphone code of each word of an array, null for null.

    The rules run once over all words, one a line: begin and end of a line are those of a word, and no rule takes a line
    end for a letter.
    """
    rules = [(p if p.isalpha() else "(?md)" + p.replace("[^", r"[^\n"), r) for p, r in METAPHONE_RULES]
    lines = F.array_join(F.transform(words, lambda w: F.translate(w, "\n", " ")), "\n", "")
    coded = F.split(_rewritten(lines, rules), "\n", -1)
    return bind(coded, lambda c: F.transform(words, lambda w, i: F.when(w.isNotNull(), F.get(c, i))))


# Short algorithm names.
ALGORITHMS = {"S": soundex, "RS": refined_soundex, "META": metaphone}


def phonetic_code(word: Column, algorithm: str = "META") -> Column:
    return ALGORITHMS[algorithm](word)


def phonetic_codes(words: Column, algorithm: str = "META") -> Column:
    """Code of each word of an array."""
    return metaphones(words) if algorithm == "META" else F.transform(words, lambda w: phonetic_code(w, algorithm))


def phonetic_distance(a: Column, b: Column, algorithm: str = "META") -> Column:
    """Edit distance between the codes of two words."""
    return F.levenshtein(phonetic_code(a, algorithm), phonetic_code(b, algorithm))
