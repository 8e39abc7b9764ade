"""Queries of the training-data operators, one or more per problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.runtime import table, written

from . import clusters, cutoff, leak, mixing, neardup, neighbours, pairs


#: Rank file of a public byte-level BPE vocabulary, where ``spark.corpusmill.tokenizer`` names no other.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _tokenizer(spark: SparkSession) -> str:
    return spark.conf.get("spark.corpusmill.tokenizer", TOKENIZER)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with their cluster, named by its smallest id."""
    return clusters.named(clusters.clusters(table(spark, sf_dir, "index_row", wide=True))).select("id", "group_id")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical chunks of each cluster."""
    return clusters.described(clusters.clusters(table(spark, sf_dir, "index_row", wide=True)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective answers with their defect."""
    return pairs.defects(table(spark, sf_dir, "question_result", wide=True), table(spark, sf_dir, "mcq_question"))


def p2_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each defect occurs."""
    return p2_found(spark, sf_dir).groupBy("defect").agg(F.count(F.lit(1)).alias("answers"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of cosine at least 0.9, one among the ten most similar of the other."""
    return neighbours.close_pairs(table(spark, sf_dir, "index_row", wide=True))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar chunks of every chunk whose number is divisible by 50, among all chunks."""
    asked = "CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 50 = 0"
    near = neighbours.nearest(table(spark, sf_dir, "index_row", wide=True), queries=asked)
    return near.select("id", "other", F.round("cos", 5).alias("cos"), "rank")


def p4_varied_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A varied subset of one chunk in 400."""
    return clusters.varied(table(spark, sf_dir, "index_row", wide=True), share=1 / 400)


def p4_varied_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A varied exam of 50 questions, by the vectors of their chunks, with the outdated label kept for comparison."""
    vectors = table(spark, sf_dir, "index_row", wide=True).select(F.col("id").alias("source_chunk_id"), "vector").dropDuplicates(["source_chunk_id"])
    q = table(spark, sf_dir, "mcq_question").filter(F.col("question").isNotNull() & F.col("source_chunk_id").isNotNull())
    q = q.select("id", "source_chunk_id", "cluster_id").groupBy("id").agg(F.min(F.struct("source_chunk_id", "cluster_id")).alias("q"))
    q = q.select("id", "q.source_chunk_id", "q.cluster_id")
    chosen = clusters.varied(q.join(vectors, "source_chunk_id"), 50)
    # at most 50 rows
    return q.join(F.broadcast(chosen), "id").select("id", "source_chunk_id", "cluster_id", "group_no", "group_size")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of questions whose bags of words have similarity at least 0.75."""
    return neardup.pairs(table(spark, sf_dir, "mcq_question"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, group and number of links of every question."""
    return neardup.groups(table(spark, sf_dir, "mcq_question"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the held-out items they contain."""
    return leak.leaks(table(spark, sf_dir, "documents", wide=True), table(spark, sf_dir, "heldout_item")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each leaked item occurs in, and its best alignment."""
    found = leak.leaks(table(spark, sf_dir, "documents", wide=True), table(spark, sf_dir, "heldout_item"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("share").alias("best_share"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of source_target that cannot reach their target."""
    sizes = mixing.sizes_by_source(table(spark, sf_dir, "documents", wide=True), _tokenizer(spark))
    return mixing.plan(sizes, table(spark, sf_dir, "source_target")).filter("short").select("source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share, passes and records of each source in the mix."""
    return mixing.report(table(spark, sf_dir, "documents", wide=True), table(spark, sf_dir, "source_target"), _tokenizer(spark))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    docs = table(spark, sf_dir, "documents", wide=True)
    passes = written(mixing.plan(mixing.sizes_by_source(docs, _tokenizer(spark)), table(spark, sf_dir, "source_target")), "passes")
    return mixing.mixed(docs.select("doc_id", "source"), passes)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut off."""
    cut = cutoff.cut_texts(table(spark, sf_dir, "documents", wide=True))
    return cut.filter("cut").select("doc_id").distinct()


def p8_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts its texts off."""
    docs = table(spark, sf_dir, "documents", wide=True)
    return cutoff.cut_rates(docs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p2_found": p2_found,
    "p2_defects": p2_defects,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p4_varied_chunks": p4_varied_chunks,
    "p4_varied_questions": p4_varied_questions,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_mix": p7_mix,
    "p8_found": p8_found,
    "p8_source_rates": p8_source_rates,
}
