"""Suffix stemming of English words by ordered rules, as column expressions.

The rules and conditions are those of the published suffix-stripping algorithm of 1980. They are stated over the form of
the stem: a run of vowels followed by a run of consonants counts one.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from taleweave.functions.arrays import bind

# Vowels and consonants; y is a vowel after a consonant.
_V = "[aeiouy]"
_CS, _VS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: A stem that counts one or more, exactly one, two or more; one with a vowel; one that ends consonant-vowel-consonant.
POSITIVE = f"^(?:{_CS})?{_VS}{_CS}"
ONE = f"^(?:{_CS})?{_VS}{_CS}(?:{_VS})?$"
MANY = f"^(?:{_CS})?{_VS}{_CS}{_VS}{_CS}"
VOWEL = f"^(?:{_CS})?{_V}"
SHORT = f"^{_CS}{_V}[^aeiouwxy]$"
DOUBLE = "(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

# Suffixes and what takes their place, of the steps that ask for a stem that counts one or more.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
# Suffixes that go where the stem counts two or more; "ion" only after s or t.
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)


def _without(word: Column, suffix: str) -> Column:
    return F.left(word, F.length(word) - len(suffix))


def _first(word: Column, rules: list[tuple[str, Column]]) -> Column:
    """The result of the first rule whose suffix the word has; the word itself without one."""
    out = F.when(F.lit(False), word)
    for suffix, result in rules:
        out = out.when(word.endswith(suffix), result)
    return out.otherwise(word)


def _plural(w: Column) -> Column:
    return _first(w, [("sses", _without(w, "es")), ("ies", _without(w, "es")), ("ss", w), ("s", _without(w, "s"))])


def _tidied(w: Column) -> Column:
    """What follows the removal of ed and ing."""
    return (
        F.when(w.endswith("at") | w.endswith("bl") | w.endswith("iz"), F.concat(w, F.lit("e")))
        .when(w.rlike(DOUBLE), _without(w, "x"))
        .when(w.rlike(ONE) & w.rlike(SHORT), F.concat(w, F.lit("e")))
        .otherwise(w)
    )


def _past(w: Column) -> Column:
    def cut(suffix: str) -> Column:
        return bind(_without(w, suffix), lambda s: F.when(s.rlike(VOWEL), _tidied(s)).otherwise(w))

    agreed = F.when(_without(w, "eed").rlike(POSITIVE), _without(w, "d")).otherwise(w)
    return _first(w, [("eed", agreed), ("ed", cut("ed")), ("ing", cut("ing"))])


def _last_y(w: Column) -> Column:
    return _first(w, [("y", F.when(_without(w, "y").rlike(VOWEL), F.concat(_without(w, "y"), F.lit("i"))).otherwise(w))])


def _replaced(w: Column, table: tuple[tuple[str, str], ...]) -> Column:
    # the longest suffix decides
    rules = sorted(table, key=lambda r: -len(r[0]))
    return _first(w, [(s, F.when(_without(w, s).rlike(POSITIVE), F.concat(_without(w, s), F.lit(r))).otherwise(w)) for s, r in rules])


def _removed(w: Column) -> Column:
    def gone(suffix: str) -> Column:
        fits = _without(w, suffix).rlike(MANY)
        if suffix == "ion":
            fits = fits & _without(w, suffix).rlike("[st]$")
        return F.when(fits, _without(w, suffix)).otherwise(w)

    return _first(w, [(s, gone(s)) for s in sorted(STEP_4, key=lambda s: -len(s))])


def _last_e(w: Column) -> Column:
    s = _without(w, "e")
    fits = s.rlike(MANY) | (s.rlike(ONE) & ~s.rlike(SHORT))
    return _first(w, [("e", F.when(fits, s).otherwise(w))])


def _last_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & _without(w, "l").rlike(MANY), _without(w, "l")).otherwise(w)


def stem(word: Column) -> Column:
    """Stem of a lower-case word; words of one or two letters stay as they are."""
    steps = [_plural, _past, _last_y, lambda w: _replaced(w, STEP_2), lambda w: _replaced(w, STEP_3), _removed, _last_e, _last_l]
    out = word
    for step in steps:
        out = bind(out, step)
    return F.when(F.length(word) > 2, out).otherwise(word)
