"""Column functions over answers, options and generated JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import stripped

LABELS = ("A", "B", "C", "D")
_BRACE = re.compile("[{}]")


def parse_answer(response: Column, keys: tuple[str, ...] = LABELS) -> Column:
    """The option letter a response names, by priority of five forms, or ``INVALID``.

    The forms: after "answer is" or "answer:"; a letter followed by a mark and white space; at the start;
    at the end; anywhere.  A null response gives ``INVALID``.
    """
    k = "|".join(sorted(keys))
    t = stripped(response)
    # The forms of an answer, by priority.
    forms = [rf"(?:the\s+)?answer\s*(?:is|:)\s*({k})\b", rf"\b({k})\s*[).:]\s", rf"^({k})\b", rf"\b({k})$", rf"\b({k})\b"]
    found = [F.nullif(F.regexp_extract(t, "(?iU)" + f, 1), F.lit("")) for f in forms]
    return F.coalesce(*[F.upper(x) for x in found], F.lit("INVALID"))


def valid_options(options: Column, answer: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """True when the options have exactly the labels and the answer is one of them; nulls give False."""
    keys = F.array_sort(F.map_keys(options)) == F.array(*[F.lit(x) for x in labels])
    return F.coalesce(keys & answer.isin(*labels), F.lit(False))


def shuffled_options(key: Column, options: Column, answer: Column, labels: tuple[str, ...] = LABELS, seed: str = "42") -> tuple[Column, Column]:
    """Options in an order fixed by a hash of seed, key and label, and the answer's new label.

    The answer is followed by its text; of equal texts the last place wins.
    """
    texts = F.transform(
        F.array_sort(F.transform(F.array(*[F.lit(x) for x in labels]), lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(seed), key, x)).alias("h"), F.element_at(options, x).alias("t")))),
        lambda s: s["t"],
    )
    wanted = F.element_at(options, answer)
    place = F.size(texts) - F.array_position(F.reverse(texts), wanted).cast("int") + 1
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), texts), F.element_at(F.array(*[F.lit(x) for x in labels]), place)


def without_fence(text: Column) -> Column:
    """Text without an opening fence line and, as last line, a closing fence."""
    t = stripped(text)
    return stripped(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"\n?```$", ""))


def repaired_json(text: Column) -> Column:
    """JSON text without commas in front of closing braces and brackets."""
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def _first_object(text: str | None) -> str | None:
    if text is None or (a := text.find("{")) < 0:
        return None
    depth = 0
    for m in _BRACE.finditer(text, a):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return text[a : m.end()]
    return None


@F.pandas_udf(StringType())
def first_object(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first balanced ``{...}`` of a text, or null; braces in strings count, as documented."""
    for s in parts:
        yield s.map(_first_object)


def parsed_object(text: Column, schema: str) -> Column:
    """An object read from generated text: fence removed, repaired, else the first balanced object; null if neither parses."""
    plain = repaired_json(without_fence(text))
    whole = F.when(F.try_parse_json(plain).isNotNull() & plain.startswith("{"), F.from_json(plain, schema))
    part = repaired_json(first_object(without_fence(text)))
    return F.coalesce(whole, F.when(F.try_parse_json(part).isNotNull(), F.from_json(part, schema)))
