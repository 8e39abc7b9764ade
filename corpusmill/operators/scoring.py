"""Scoring answers and reading the trial history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.answers import LABELS

# Fields compared between two configurations, as paths into the ``config`` struct.
DIFF_FIELDS = [
    "structural.chunk_size", "structural.chunk_overlap", "structural.chunking_strategy", "structural.embedding_model", "structural.index_type",
    "runtime.top_k", "runtime.hybrid_alpha", "runtime.reranker", "runtime.query_expansion", "runtime.llm_model", "runtime.temperature",
]


def delivered_once(results: DataFrame) -> DataFrame:
    """One row per ``result_id``: of repeated deliveries the last loaded."""
    rest = [c for c in results.columns if c != "result_id"]
    return results.groupBy("result_id").agg(F.max(F.struct("loaded_at", *[c for c in rest if c != "loaded_at"])).alias("x")).select("result_id", *[F.col(f"x.{c}").alias(c) for c in rest])


def exam_score(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``n_correct, n_total, score``; a null ``correct`` counts as wrong, no answers give a score of 0."""
    right = F.count_if(F.coalesce("correct", F.lit(False)))
    total = F.count(F.lit(1))
    score = F.when(total == 0, F.lit(0.0)).otherwise(F.round(right / total, 6))
    return (results.groupBy(*by) if by else results.groupBy()).agg(right.alias("n_correct"), total.alias("n_total"), score.alias("score"))


def failed(results: DataFrame, by: str, order: str, n: int = 15) -> DataFrame:
    """The first ``n`` wrong answers of each group, with their place ``nth``."""
    w = Window.partitionBy(by).orderBy(order)
    return results.filter(~F.coalesce("correct", F.lit(False))).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def best_trial(trials: DataFrame, order: str = "trial_number") -> DataFrame:
    """The trial with the highest score, the first of equal ones; no row when every score is null."""
    return trials.filter("score IS NOT NULL").orderBy(F.col("score").desc(), order).limit(1)


def running_best(trials: DataFrame, order: str = "trial_number") -> DataFrame:
    """Adds ``best_so_far`` and ``improved`` (a strictly higher score). One window over the history, one row a trial."""
    w = Window.partitionBy().orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy().orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("score").over(before)
    return trials.withColumn("best_so_far", F.max("score").over(w)).withColumn("improved", F.coalesce((F.col("score") > best) | (best.isNull() & F.col("score").isNotNull()), F.lit(False)))


def last_n(trials: DataFrame, n: int = 10, order: str = "trial_number") -> DataFrame:
    """The last ``n`` trials."""
    return trials.orderBy(F.col(order).desc()).limit(n)


def fixed_decimals(x: Column, digits: int) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def summary_line() -> Column:
    """One line about a trial; a null score reads ``nan``."""
    # The wording of the line.
    s, r = "config.structural.", "config.runtime."
    return F.concat(
        F.lit("Trial "), F.col("trial_number").cast("string"), F.lit(": score="), F.coalesce(fixed_decimals(F.col("score"), 3), F.lit("nan")),
        F.lit(" | chunk="), F.col(s + "chunk_size").cast("string"), F.lit(", embed="), F.col(s + "embedding_model"), F.lit(", index="), F.col(s + "index_type"),
        F.lit(", top_k="), F.col(r + "top_k").cast("string"), F.lit(", reranker="), F.col(r + "reranker"), F.lit(", llm="), F.col(r + "llm_model"),
    )


def config_changes(trials: DataFrame, order: str = "trial_number") -> DataFrame:
    """``trial_number, field, old, new``: fields that differ from the trial before. One window over the history."""
    prior = Window.partitionBy().orderBy(order)
    rows = trials.select(order, F.col("config").alias("new_config"), F.lag("config").over(prior).alias("old_config")).filter("old_config IS NOT NULL")
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col("old_config." + f).cast("string").alias("old"), F.col("new_config." + f).cast("string").alias("new")) for f in DIFF_FIELDS])
    return rows.select(order, F.explode(entries).alias("e")).select(order, "e.field", "e.old", "e.new").filter("NOT old <=> new")


def joined_context(hits: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``qid, context``: the hits' texts in order of rank, joined by line breaks."""
    rows = hits.select("qid", "rank", "id").join(docs.select(F.col(doc_id).alias("id"), F.col(text_col).alias("t")), "id")
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "\n").alias("context"))


def context_of(retrieved: DataFrame) -> DataFrame:
    """``qid, context``: the texts of ``qid, rank, text`` in order of rank, joined by line breaks."""
    lists = retrieved.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    return lists.select("qid", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("context"))


def rendered_options(options: Column) -> Column:
    """``K) text`` lines in order of the labels; null without options."""
    return F.array_join(F.transform(F.filter(F.array(*[F.lit(x) for x in LABELS]), lambda k: F.map_contains_key(options, k)), lambda k: F.concat(k, F.lit(") "), F.coalesce(F.element_at(options, k), F.lit("")))), "\n")


def answer_prompt(question: Column, options: Column, context: Column) -> Column:
    """The text a generator is asked with; a missing context is empty."""
    return F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question, F.lit("\n\nOptions:\n"), F.coalesce(rendered_options(options), F.lit("")), F.lit("\n\nAnswer with the letter of one option."))


def response_matrix(results: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """``trial, question_id, correct`` (0 or 1), dense: an unanswered question counts 0; of repeated answers the last counts.

    With ``questions(question_id)`` restricted to an exam.  The distinct trials, few by nature, are one
    row that is spread over the questions; fewer than two trials give no matrix.
    """
    rows = results.filter("question_id IS NOT NULL")
    if questions is not None:
        rows = rows.join(questions.select("question_id").distinct(), "question_id", "left_semi")
    cells = rows.groupBy(F.col("trial_number").alias("trial"), "question_id").agg(F.max(F.struct("result_id", F.coalesce("correct", F.lit(False)).cast("int").alias("c"))).alias("x"))
    cells = cells.select("trial", "question_id", F.col("x.c").alias("correct"))
    trials = results.agg(F.sort_array(F.collect_set("trial_number")).alias("trials")).filter(F.size("trials") >= 2)
    grid = rows.select("question_id").distinct().crossJoin(F.broadcast(trials)).select("question_id", F.explode("trials").alias("trial"))
    return grid.join(cells, ["trial", "question_id"], "left").select("trial", "question_id", F.coalesce("correct", F.lit(0)).alias("correct"))
