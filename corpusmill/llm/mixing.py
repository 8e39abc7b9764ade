"""Mixing sources to target shares with capped water-filling."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.runtime import maybe_broadcast, ship_package, written

#: Share of a target by which the planned size may fall short through rounding alone.
TOLERANCE = 1e-9
# Fixed value: the published splitting pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(name: str):
    """The tokenizer of a shipped rank file, loaded once per Python worker."""
    import tiktoken

    path = SparkFiles.get(name)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def shipped(spark: SparkSession, tokenizer: str) -> str:
    """Give every worker the rank file at ``tokenizer`` (a path the driver can read), once; its name there."""
    name = os.path.basename(tokenizer)
    sc = spark.sparkContext
    sent = getattr(sc, "_corpusmill_tokenizers", {})
    if sent.get(name) != tokenizer:
        sc.addFile(tokenizer)
        sc._corpusmill_tokenizers = {**sent, name: tokenizer}
    return name


def with_tokens(df: DataFrame, tokenizer: str, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """Replace ``text_col`` by its size in tokens, ``out``; a null text has none.

    ``tokenizer`` is the rank file of a byte-level BPE vocabulary with the splitting pattern ``PATTERN``.
    """
    ship_package(df.sparkSession)
    rank_file = shipped(df.sparkSession, tokenizer)
    names = [c for c in df.columns if c != text_col]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file)
        for b in batches:
            sizes = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(sizes, pa.int64())], [*names, out])

    return df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`")).mapInArrow(count, (fields + ", " if fields else "") + f"`{out}` long")


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The passes over each target source by capped water-filling.

    ``sizes`` has ``source, docs, size`` for every source, null included; ``targets`` has
    ``source, target_share, max_repeat``.  The mix shall be as large as all documents.  A source
    gives ``min(max_repeat * size, level * target_share)``; the level is the one at which the mix
    is full: sources at their cap are clamped, and what they lack is spread over the others
    in proportion to their shares until nothing exceeds a cap.

    One row per target source: ``source, target_share, max_repeat, docs, size, total, short``
    (the water level leaves less than the target share of the total to it), ``planned`` (size in the mix) and
    ``repeats`` (passes, with a fraction).  Where the shares sum to 1, the level is at least the total, so a
    source is short exactly when its cap lies below its target; with shares of a smaller sum likewise.
    Defined results: targets with a null source, or a null or negative share or cap, count as share 0
    or cap 0; a repeated target keeps the largest share; sources without documents have size 0.
    """
    spark = targets.sparkSession
    # one row a source: written once, used several times in the plan
    sizes = written(sizes, "sizes")
    return spark.sql(
        """
WITH t AS (
  SELECT source, max(greatest(coalesce(target_share, 0), 0)) AS target_share, max(greatest(coalesce(max_repeat, 0), 0)) AS max_repeat
  FROM {targets} WHERE source IS NOT NULL GROUP BY source
), s AS (SELECT source, sum(docs) AS docs, sum(size) AS size FROM {sizes} GROUP BY source),
total AS (SELECT coalesce(sum(size), 0) AS total FROM s),
j AS (
  SELECT t.source, t.target_share, t.max_repeat, coalesce(s.docs, 0) AS docs, coalesce(s.size, 0) AS size, total.total,
         CAST(t.max_repeat * coalesce(s.size, 0) AS DOUBLE) AS reach,
         CASE WHEN t.target_share > 0 THEN CAST(t.max_repeat * coalesce(s.size, 0) AS DOUBLE) ELSE 0D END AS cap
  FROM t LEFT JOIN s ON t.source = s.source CROSS JOIN total
), r AS (
  SELECT *, CASE WHEN target_share > 0 THEN cap / target_share END AS full_at,
         sum(cap) OVER w AS cap_before, sum(target_share) OVER () - sum(target_share) OVER w AS share_after
  FROM j WINDOW w AS (ORDER BY CASE WHEN target_share > 0 THEN cap / target_share ELSE 0 END, source ROWS UNBOUNDED PRECEDING)
), level AS (
  -- the level with the first so many sources clamped; the true one is the largest that clamps no source beyond its cap
  SELECT max(CASE WHEN share_before > 1e-12 THEN (total - cap_prior) / share_before END) AS level
  FROM (SELECT *, cap_before - cap AS cap_prior, share_after + target_share AS share_before FROM r WHERE target_share > 0)
  WHERE (total - cap_prior) / nullif(share_before, 0) <= full_at
)
SELECT source, target_share, max_repeat, docs, size, total,
       planned < target_share * total * (1 - {tolerance}) AS short, planned,
       CASE WHEN size = 0 THEN 0D ELSE planned / size END AS repeats
FROM (
  SELECT r.*, CASE WHEN r.target_share = 0 THEN 0D ELSE least(r.cap, coalesce(level.level * r.target_share, r.cap)) END AS planned
  FROM r CROSS JOIN level
)
""",
        sizes=sizes,
        targets=targets,
        tolerance=TOLERANCE,
    )


def sizes_by_source(docs: DataFrame, tokenizer: str, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source, docs, size`` in tokens; a hot source is pre-aggregated by each task."""
    slim = docs.select(docs[source_col].alias("source"), docs[text_col].alias("text"))
    return with_tokens(slim, tokenizer).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("size"))


def mixed(docs: DataFrame, passes: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 13) -> DataFrame:
    """The mix: ``docs`` with ``copy_no``, each record as often as its source's passes say.

    Whole passes take every record; the fraction of a pass takes the records whose seeded
    hash lies below it, so the choice is the same on every run and in every partitioning.
    """
    p = passes.filter("repeats > 0").select(F.col("source").alias(source_col), F.floor("repeats").cast("int").alias("_whole"), (F.col("repeats") % 1).alias("_part"))
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(2**40)) / F.lit(float(2**40))
    times = F.col("_whole") + (u < F.col("_part")).cast("int")
    # one row a target source
    out = docs.join(maybe_broadcast(p, p.count(), 64), source_col).withColumn("_times", times).filter("_times > 0")
    return out.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_whole", "_part", "_times")


def report(docs: DataFrame, targets: DataFrame, tokenizer: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Target and actual shares of each source in the sampled mix, with its passes.  Texts are tokenised once."""
    slim = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), docs[text_col].alias("text"))
    tokens = written(with_tokens(slim, tokenizer), "tokens")
    sizes = tokens.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("size"))
    passes = written(plan(sizes, targets), "passes")
    got = mixed(tokens, passes, "id", "source").groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("tokens").alias("mixed_size"))
    out = written(passes.join(got, "source", "left").na.fill(0, ["records", "mixed_size"]), "mix")
    # one row per target source; the window runs over the report, not over the records
    whole = out.select(F.sum("mixed_size").alias("mix_total"))
    return out.crossJoin(whole).select(
        "source", "target_share", "max_repeat", "docs", "size", "short", F.round("repeats", 6).alias("repeats"), "records", "mixed_size",
        F.round(F.col("mixed_size") / F.greatest("mix_total", F.lit(1)), 6).alias("actual_share"),
    )
