"""Texts cut off before their end, found with corpus statistics in pure SQL.

Every line of every text is turned into tokens (words, numbers as ``0``, single punctuation
marks) and the kind of its line (prose, list, table row, label line, notice, reference,
heading).  Word trigrams and their shapes (any word becomes ``w``) are counted over all
positions *inside* the texts and at the texts' ends.  The final trigram of each text is
joined with these counts; a text is cut when its final trigram is common inside texts but
almost never ends one.  The share of ends is smoothed towards the share of the trigram's
shape, so rare trigrams fall back to their shape.

Two endings need no statistics because they never occur inside a text: an ellipsis,
replacement character or opening bracket that a limit left behind, and an unclosed code block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import BROADCAST_BYTES, written

#: A final trigram is "almost never terminal" when its smoothed share of ends is below so many times
#: that of any position, which is one over the mean number of tokens of a text.
MAX_LIFT = 4
#: Occurrences with which the share of a trigram's shape counts against its own.
SHAPE_WEIGHT = 200
#: Occurrences inside texts from which a trigram is reported as frequent.
FREQUENT = 5

# What a field or transfer limit leaves at the end of a text.
LEFT_BEHIND = (
    r"(\\.\\.\\.+|[…\\uFFFD\\[]|\\[ ?(…|\\.\\.\\.|cut|more|truncated)\\]?"
    r"|&#?[a-z0-9]?[a-z0-9]?[a-z0-9]?[a-z0-9]?[a-z0-9]?|</?[a-z0-9]*|\\\\u[0-9a-f]?[0-9a-f]?[0-9a-f]?)$"
)
# White space and invisible characters at the end of a text.
BLANK_END = (
    r" \t\n\r\f\u000B\u0085             "
    r"​‌‍‎‏    ⁠　﻿­"
)

# The last element of a text: what follows its last code block, or the block itself.
_BODY = r"""
WITH body AS (
  SELECT {id} AS id, rtrim('{blank}', {text}) AS b FROM {{docs}}
)"""

_LINES = r""", line AS (
  SELECT i = size(ls) - 1 AS last, l
  FROM body
  LATERAL VIEW explode(array(filter(transform(
    split(regexp_replace(lower(CASE WHEN contains(b, '```') THEN regexp_replace(b, '(?s)```.*?(```|$)', '\n⟦\n') ELSE b END),
                         '[0-9]+([.,][0-9]+)*', '0'), '[\r\n]+'), x -> ltrim(x)), x -> x <> ''))) AS ls
  LATERAL VIEW posexplode(ls) AS i, l
  WHERE b <> ''
)"""

_LAST = r""", line AS (
  SELECT id, left_behind, open_block, tail, true AS last,
         CASE WHEN e = '' THEN '⟦' ELSE ltrim(regexp_replace(lower(substring_index(replace(e, '\r', '\n'), '\n', -1)), '[0-9]+([.,][0-9]+)*', '0')) END AS l
  FROM (
    SELECT id, right(b, 16) RLIKE '{left}' AS left_behind,
           ((length(b) - length(replace(b, '```', ''))) / 3) % 2 = 1 AS open_block,
           xxhash64(translate(b, ' \t\r\n', '')) AS tail,
           CASE WHEN contains(b, '```') THEN substring_index(b, '```', -1) ELSE b END AS e
    FROM body WHERE b <> ''
  )
)"""

_TOKENS = r""", tokens AS (
  SELECT line.*, w, kind
  FROM line
  LATERAL VIEW explode(array(regexp_extract_all(l, '[\\pL\\pM_]+|\\S', 0))) AS w
  LATERAL VIEW explode(array(
    CASE WHEN l RLIKE '^[-*+] ' THEN 'l' WHEN startswith(l, '|') THEN 't' WHEN startswith(l, '#') THEN 'h'
         WHEN startswith(l, '©') THEN 'c' WHEN startswith(l, '[') THEN 'r'
         WHEN l RLIKE '^[\\pL]+:' THEN 'k' ELSE 'p' END)) AS kind
)"""


def _shape(word: str) -> str:
    """The shape of a token; null stays null."""
    return f"CASE WHEN {word} IS NULL THEN NULL WHEN {word} = '0' THEN '0' WHEN length({word}) > 1 OR lower({word}) <> upper({word}) THEN 'w' ELSE {word} END"


# The hashes of the trigram that ends with the token ``x`` after ``v`` and ``u``, and of its shape.
_KEYS = f"xxhash64(kind, u, v, x) AS g, xxhash64(kind, {_shape('u')}, {_shape('v')}, {_shape('x')}) AS s"

_SQL_END = _BODY + _LAST + _TOKENS + f"""
SELECT id, tail, left_behind, open_block, CASE WHEN x IS NOT NULL THEN g END AS g, CASE WHEN x IS NOT NULL THEN s END AS s
FROM (SELECT id, tail, left_behind, open_block, x, {_KEYS}
      FROM (SELECT *, get(w, size(w) - 3) AS u, get(w, size(w) - 2) AS v, get(w, size(w) - 1) AS x FROM tokens))
"""

_INNER = f""", inner_keys AS (
  SELECT {_KEYS}
  FROM (SELECT kind, get(w, i - 2) AS u, get(w, i - 1) AS v, x FROM tokens LATERAL VIEW posexplode(w) AS i, x WHERE NOT (last AND i = size(w) - 1))
)"""

# Only trigrams that end some text are looked up, all others are counted by their shape alone, of which there are few.
_SQL_INSIDE = _BODY + _LINES + _TOKENS + _INNER + """
SELECT e.g AS g, i.s AS s, count(*) AS n FROM inner_keys i LEFT JOIN {{wanted}} e ON i.g = e.g GROUP BY e.g, i.s
"""

# The same where the endings are too many to be broadcast: trigrams are counted by each task before they are shuffled.
_SQL_INSIDE_MANY = _BODY + _LINES + _TOKENS + _INNER + """
SELECT e.g AS g, i.s AS s, sum(n) AS n
FROM (SELECT g, s, count(*) AS n FROM inner_keys GROUP BY g, s) i LEFT JOIN {{wanted}} e ON i.g = e.g GROUP BY e.g, i.s
"""


def _filled(sql: str) -> str:
    return sql.format(id="id", text="text", blank=BLANK_END, left=LEFT_BEHIND)


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, cut, by, inside, ends, end_share`` for every text that shows anything.

    ``inside`` and ``ends`` are how often the text's final trigram occurs inside texts and at
    the end of other texts; ``end_share`` is the smoothed share of ends.  ``by`` is what a cut text was judged
    by: what was ``left`` behind, an open ``block``, its final ``trigram`` (common inside texts, where even
    the trigram's own share is below the threshold), or the trigram's ``shape`` (too rare for a share of its own).

    Defined results: null, empty and blank texts have no row; repeated rows and copies get a
    row each, and texts that differ in white space alone count as one text's end; ties cannot arise; extra columns are ignored, whatever their names.
    The whole text is read, however long.
    """
    spark = docs.sparkSession
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    ends = written(spark.sql(_filled(_SQL_END), docs=d), "ends")
    wanted = ends.filter("NOT left_behind AND NOT open_block").select("g").distinct()
    n = wanted.count()
    few = n * 64 <= BROADCAST_BYTES
    inside = written(spark.sql(_filled(_SQL_INSIDE if few else _SQL_INSIDE_MANY), docs=d, wanted=F.broadcast(wanted) if few else wanted), "inside")
    return spark.sql(
        f"""
WITH end_g AS (
  SELECT g, any_value(s) AS s, count(DISTINCT tail) AS ends FROM {{ends}} WHERE NOT left_behind AND NOT open_block GROUP BY g
), in_g AS (SELECT g, sum(n) AS n FROM {{inside}} WHERE g IS NOT NULL GROUP BY g),
shape_end AS (SELECT s, sum(ends) AS ends FROM end_g GROUP BY s),
shape_in AS (SELECT s, sum(n) AS n FROM {{inside}} GROUP BY s),
shape AS (
  SELECT e.s, e.ends / (e.ends + coalesce(i.n, 0)) AS share FROM shape_end e LEFT JOIN shape_in i ON e.s = i.s
), base AS (
  SELECT sum(e) / sum(n) AS share
  FROM (SELECT sum(ends) AS e, sum(ends) AS n FROM shape_end UNION ALL SELECT 0 AS e, sum(n) AS n FROM shape_in)
), judged AS (
  SELECT e.g, coalesce(i.n, 0) AS inside, e.ends,
         coalesce(try_divide(e.ends - 1, e.ends - 1 + coalesce(i.n, 0)), 0) AS own_share,
         (e.ends - 1 + {SHAPE_WEIGHT} * p.share) / (e.ends - 1 + coalesce(i.n, 0) + {SHAPE_WEIGHT}) AS end_share
  FROM end_g e JOIN shape p ON e.s = p.s LEFT JOIN in_g i ON e.g = i.g
)
SELECT t.id AS `{id_col}`,
       t.left_behind OR t.open_block OR coalesce(j.end_share < {MAX_LIFT} * base.share, false) AS cut,
       CASE WHEN t.left_behind THEN 'left' WHEN t.open_block THEN 'block' WHEN j.end_share < {MAX_LIFT} * base.share
            THEN CASE WHEN j.inside >= {FREQUENT} AND j.own_share < {MAX_LIFT} * base.share THEN 'trigram' ELSE 'shape' END END AS by,
       j.inside, j.ends, j.end_share
FROM {{ends}} t CROSS JOIN base LEFT JOIN judged j ON t.g = j.g AND NOT t.left_behind AND NOT t.open_block
""",
        ends=ends,
        inside=inside,
    )


def cut_rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``source, texts, cut_texts, cut_rate``: how often each source cuts its texts off.

    Defined results: rows of a null source form one group of source null; null, empty and blank
    texts are not counted; a source without texts has no row; an id that occurs in several rows
    counts once per row.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[source_col].alias("source"))
    keyed = rows.withColumn("id", F.struct("source", "id"))
    return (
        cut_texts(keyed, "id", "text")
        .groupBy(F.col("id.source").alias("source"))
        .agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut_texts"))
        .withColumn("cut_rate", F.round(F.col("cut_texts") / F.col("texts"), 6))
    )
