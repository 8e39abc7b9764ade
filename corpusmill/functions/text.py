"""Column functions over text: tokens, n-grams, white space, self-containment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of questions that lean on a text the reader does not see.
NOT_SELF_CONTAINED = [
    r'\b(documentation|paper|article|research|study|passage|text|excerpt)\b\s*"[^"]+"',
    r'\b(discussed in|addressed in|described in|mentioned in|according to|based on|stated in|of the)\b\s*"[^"]+"',
    r"\b(the\s+)?(above|given|provided|following)\s+(documentation|passage|text|excerpt|context)\b",
    r"\baccording\s+to\s+(the\s+)?(documentation|paper|article|passage|text)\b",
    r"^based\s+on\s+(the\s+)?(given\s+|provided\s+|above\s+)?(text|passage|information|content|material|excerpt|context|document)",
]


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, also where ``f`` uses it in a lambda or several times."""
    return F.element_at(F.transform(F.array(value), f), 1)


def stripped(text: Column) -> Column:
    """Text without Unicode white space at its ends; null stays null."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_tokens(text: Column) -> Column:
    """Lower-case tokens between Unicode white space; a null text gives null, an empty one no tokens."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, the terms of the text index."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ngrams(tokens: Column, n: int | Column) -> Column:
    """Distinct n-grams of a token array, joined by blanks; with fewer than ``n`` tokens none."""
    n = F.lit(n) if isinstance(n, int) else n

    def grams(t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " ")))

    return bound(tokens, grams)


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats, as sets; 0 when both are empty."""

    def ratio(x: Column, y: Column) -> Column:
        return bound(F.size(F.array_intersect(x, y)), lambda c: F.when(F.size(x) + F.size(y) == 0, F.lit(0.0)).otherwise(c / (F.size(x) + F.size(y) - c)))

    return bound(a, lambda x: bound(b, lambda y: ratio(x, y)))


def jaccard_ngram(a: Column, b: Column, n: int | Column = 3) -> Column:
    """Jaccard similarity of word n-grams; of single words when either side is shorter than ``n``.

    A null side counts as empty, and an empty side gives 0.
    """
    none = F.array().cast("array<string>")
    return bound(F.coalesce(split_tokens(a), none), lambda x: bound(F.coalesce(split_tokens(b), none), lambda y: token_jaccard(x, y, n)))


def token_jaccard(x: Column, y: Column, n: int | Column) -> Column:
    """:func:`jaccard_ngram` of token arrays."""
    m = F.lit(n) if isinstance(n, int) else n
    return (
        F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0))
        .when((F.size(x) < m) | (F.size(y) < m), set_jaccard(F.array_distinct(x), F.array_distinct(y)))
        .otherwise(set_jaccard(ngrams(x, m), ngrams(y, m)))
    )


def self_contained(text: Column) -> Column:
    """True when none of the patterns matches, ignoring case; a null text gives null."""
    found = F.lit(False)
    for p in NOT_SELF_CONTAINED:
        found = found | text.rlike("(?iU)" + p)
    return ~found


def file_extension(path: Column) -> Column:
    """Lower-case suffix of a path with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
