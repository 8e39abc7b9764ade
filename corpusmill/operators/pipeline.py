"""The composed paths: retrieve for all questions at once, and evaluate an exam over what was retrieved."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from corpusmill.functions import answers
from corpusmill.operators import retrieval, scoring
from corpusmill.operators.index import Index
from corpusmill.providers import Embedder, Generator, HashEmbedder
from corpusmill.runtime import written

log = logging.getLogger(__name__)

#: Hits fetched for each one that a reranker keeps.
OVER_FETCH = 3
# Index types, and what stands for the response of a question that failed.
INDEX_TYPES = ("vector_only", "hybrid_bm25_vector", "graph", "hybrid_graph_vector")
ERROR_RESPONSE = "QUESTION_EVALUATION_ERROR"


@dataclass(frozen=True)
class Settings:
    """What a trial may change without rebuilding its index."""

    index_type: str = "vector_only"
    top_k: int = 5
    reranker: str = "none"
    reranker_top_n: int = 5
    query_expansion: str = "none"


def checked_vectors(rows: DataFrame, vec_col: str = "vector") -> DataFrame:
    """``rows`` with the vector as ``array<double>``; a column that is not a flat list of numbers is an error."""
    kind = rows.schema[vec_col].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, NumericType):
        raise ValueError(f"{vec_col} must be a one-dimensional list of numbers, not {kind.simpleString()}")
    return rows.withColumn(vec_col, F.col(vec_col).cast("array<double>"))


def search(index: Index, queries: DataFrame, k: int, index_type: str = "vector_only", embedder: Embedder | None = None) -> DataFrame:
    """``qid, id, score, rank``: the hits of the queries ``qid, text`` by the way of the index type.

    Vectors alone rank by distance, smaller is better; the fused ways rank by reciprocal ranks, larger is better.
    No graph store exists, so graph searches find nothing and log it; an unknown type is searched by vectors, and logged.
    Every text is searched once, by the smallest of its queries; all of its queries get the hits.
    """
    asked = written(queries.filter("text IS NOT NULL").withColumn("first", F.min("qid").over(Window.partitionBy("text"))), "asked")
    queries = asked.filter("qid = first").select("qid", "text").distinct()

    def to_all(hits: DataFrame) -> DataFrame:
        return hits.withColumnRenamed("qid", "first").join(asked.select("qid", "first").distinct(), "first").select("qid", "id", "score", "rank")

    def by_vector(n: int) -> DataFrame:
        q = checked_vectors((embedder or HashEmbedder()).embed(queries, "qid", "text"))
        return index.search_vectors(q.withColumnRenamed("id", "qid"), n)

    def by_graph() -> DataFrame:
        log.warning("no graph store: graph search finds nothing")
        return retrieval.graph_search(index.chunks, queries, "chunk_id", "qid")

    def hybrid() -> DataFrame:
        return retrieval.rrf(index.search_text(queries, k, "qid"), by_vector(k)).filter(F.col("rank") <= k)

    if index_type == "hybrid_bm25_vector":
        return to_all(hybrid())
    if index_type == "graph":
        return by_graph()
    if index_type == "hybrid_graph_vector":
        return to_all(retrieval.rrf(hybrid(), by_graph()).filter(F.col("rank") <= k))
    if index_type != "vector_only":
        log.warning("unknown index type %r: searched by vectors", index_type)
    return to_all(by_vector(k))


def retrieve(index: Index, questions: DataFrame, settings: Settings = Settings(), embedder: Embedder | None = None, id_col: str = "id", text_col: str = "question", generated: str | None = None) -> DataFrame:
    """``qid, rank, id, text, score``: what every question retrieves, in one lineage.

    Each question and its variants are searched for ``top_k`` hits, or three times as many with a reranker; hits are
    joined in order of variant and rank, each id once; a reranker orders them by the original question and keeps
    ``reranker_top_n``, else the first ``top_k`` are kept.

    Defined results: questions with null id or text retrieve nothing; of several rows of an id the smallest text is
    asked; ties are ordered as the search and fusion order them; extra columns are ignored.
    """
    s = settings
    q = questions.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    q = q.groupBy(F.col(id_col).alias("qid")).agg(F.min(F.struct(F.col(text_col).alias("text"), *([F.col(generated).alias("more")] if generated else []))).alias("q")).select("qid", "q.*")
    variants = retrieval.expanded(q, s.query_expansion, "qid", "text", "more" if generated else None)
    kind = q.schema["qid"].dataType.simpleString()
    if s.query_expansion == "none":
        hits = search(index, variants.select("qid", "text"), _fetched(s), s.index_type, embedder).withColumn("variant", F.lit(0))
    else:
        keyed = variants.select(F.concat_ws("\x1f", F.col("qid").cast("string"), F.col("variant").cast("string")).alias("qid"), "text")
        found = search(index, keyed, _fetched(s), s.index_type, embedder)
        hits = found.select(F.substring_index("qid", "\x1f", 1).cast(kind).alias("qid"), F.substring_index("qid", "\x1f", -1).cast("int").alias("variant"), "id", "score", "rank")
    once = retrieval.deduplicated(hits)
    texts = index.chunks.select(F.col("chunk_id").alias("id"), "text")
    if s.reranker != "none":
        order = retrieval.reranked(once, q, index.chunks, s.reranker_top_n, "qid", "chunk_id", "text")
        once = order.select("qid", "id", F.col("rank").alias("place")).join(once.drop("rank"), ["qid", "id"]).withColumnRenamed("place", "rank")
    else:
        once = once.filter(F.col("rank") <= s.top_k)
    return once.join(texts, "id").select("qid", "rank", "id", "text", retrieval.normalised_hit(F.col("score"), F.lit(None)).alias("score"))


def _fetched(s: Settings) -> int:
    return s.top_k if s.reranker == "none" else OVER_FETCH * s.top_k


def evaluate(exam: DataFrame, retrieved: DataFrame, generator: Generator, failed: Column | None = None) -> DataFrame:
    """``question_id, correct, selected_answer, correct_answer, retrieved_context, generated_response`` for every question of an exam.

    ``exam`` has ``id, question, options, correct_answer``, ``retrieved`` what :func:`retrieve` gives.  The generator is asked
    with the question's context and options; its response is parsed.  A question whose generation raised or gave null, or for which ``failed``
    holds, has an empty context, the answer ``INVALID`` and the error marker as response, so every question has a row.

    Defined results: a question without hits has an empty context; rows with a null id are left out; of several rows of an
    id the smallest question and its options count; extra columns are ignored.
    """
    entries = F.array_sort(F.map_entries("options"))
    one = exam.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("question", entries.alias("e"), "correct_answer")).alias("x"))
    one = one.select("id", "x.question", F.map_from_entries("x.e").alias("options"), "x.correct_answer")
    rows = one.join(scoring.context_of(retrieved).withColumnRenamed("qid", "id"), "id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    rows = rows.withColumn("prompt", scoring.answer_prompt(F.col("question"), F.col("options"), F.col("context")))
    said = generator.generate(rows)
    bad = F.col("response").isNull() | (F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False))
    said = said.withColumn("_bad", bad)
    response = F.when(F.col("_bad"), F.lit(ERROR_RESPONSE)).otherwise(F.col("response"))
    chosen = F.when(F.col("_bad"), F.lit("INVALID")).otherwise(answers.parse_answer(F.col("response")))
    return said.select(
        F.col("id").alias("question_id"), F.coalesce(chosen == F.col("correct_answer"), F.lit(False)).alias("correct"), chosen.alias("selected_answer"), "correct_answer",
        F.when(F.col("_bad"), F.lit("")).otherwise(F.col("context")).alias("retrieved_context"), response.alias("generated_response"),
    )


def failure_text(results: DataFrame, exam: DataFrame, n: int = 15) -> DataFrame:
    """``text``: a numbered block for each of the first ``n`` wrong answers in order of question, in one row; empty when all are right.

    At most ``n`` rows are gathered.
    """
    wrong = scoring.failed(results.withColumn("_all", F.lit(0)), "_all", "question_id", n)
    q = exam.select(F.col("id").alias("question_id"), "question").dropDuplicates(["question_id"])
    block = F.concat(
        F.col("nth").cast("string"), F.lit(". Question: "), F.coalesce("question", F.lit("")), F.lit("\n   Selected: "), F.coalesce("selected_answer", F.lit("")), F.lit(", correct: "), F.coalesce("correct_answer", F.lit("")),
        F.lit("\n   Context: "), F.substring(F.coalesce("retrieved_context", F.lit("")), 1, 500), F.lit("\n   Response: "), F.substring(F.coalesce("generated_response", F.lit("")), 1, 300),
    )
    lines = wrong.join(q, "question_id", "left").select("nth", block.alias("b"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "b"))), lambda x: x["b"]), "\n\n").alias("text"))


def in_exam_order(exam: DataFrame, by: str = "id") -> DataFrame:
    """The exam with its place ``pos`` from 0. One window over an exam, which has tens of questions."""
    return exam.withColumn("pos", F.row_number().over(Window.partitionBy().orderBy(by)) - 1)
