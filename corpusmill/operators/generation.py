"""Exam generation: questions from chunks by a generator, parsed, checked and taken until every stratum is filled."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import answers
from corpusmill.functions.text import self_contained
from corpusmill.operators import exam
from corpusmill.providers import Embedder, Generator, HashEmbedder
from corpusmill.runtime import written

MCQ = "question string, options map<string,string>, correct_answer string, reasoning string"
#: Attempts at a question, and candidates generated for each slot in the first round of a cluster.
ATTEMPTS, AHEAD = 3, 2
#: Cosine above which a later question repeats an earlier one.
SAME_QUESTION = 0.90


def question_prompt(text: Column, domain: Column | None = None) -> Column:
    """What a model is asked for a question about a text: the form of the answer, the domain where one is known, and the text."""
    about = F.coalesce(domain, F.lit("the subject of the text")) if domain is not None else F.lit("the subject of the text")
    return F.concat(
        F.lit('Write one multiple-choice question about '), about, F.lit(' that can be answered without seeing the text.\nReply with a JSON object with the fields "question", "options" (the texts of A, B, C and D), '
                                                                      '"correct_answer" (one of the letters) and "reasoning".\n\nText:\n'), F.coalesce(text, F.lit("")))


class QuestionGenerator(Protocol):
    """Adds ``generated``, the text of a question about ``text``, to rows ``id, text, ...``; null where none could be made."""

    def generate(self, rows: DataFrame, attempt: int) -> DataFrame: ...


class ModelQuestions:
    """Asks a text model, an answer generator of prompts, for the question; a failed call leaves a null and so another attempt."""

    def __init__(self, generator: Generator, domain: str | None = None) -> None:
        self.generator, self.domain = generator, domain

    def generate(self, rows: DataFrame, attempt: int) -> DataFrame:
        asked = rows.withColumn("prompt", question_prompt(F.col("text"), F.lit(self.domain))).withColumn("options", F.lit(None).cast("map<string,string>")).withColumn("context", F.col("text"))
        return self.generator.generate(asked).withColumnRenamed("response", "generated")


class ClozeGenerator:
    """The offline generator: asks which words follow the first six of a chunk; the distractors continue other chunks.

    ``pool`` has ``text``; a chunk's distractors are the continuations of the next three chunks by a hash of the text within
    one of ``parts`` parts of the pool, so no window holds the whole pool.  Chunks of fewer than twelve words give no question.
    """

    def __init__(self, pool: DataFrame, parts: int = 64) -> None:
        words = F.filter(F.split("text", r"(?U)\s+"), lambda t: t != "")
        rows = pool.select("text").filter("text IS NOT NULL").distinct().withColumn("w", words).filter(F.size("w") >= 12)
        rows = rows.select("text", F.array_join(F.slice("w", 1, 6), " ").alias("start"), F.array_join(F.slice("w", 7, 6), " ").alias("rest"), F.md5("text").alias("h"))
        w = Window.partitionBy(F.pmod(F.xxhash64("h"), F.lit(parts))).orderBy("h")
        first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        wrapped = [F.coalesce(F.lead("rest", i).over(w), F.nth_value("rest", i).over(first)) for i in (1, 2, 3)]
        self.made = rows.select("text", "start", "rest", *[x.alias(f"d{i}") for i, x in enumerate(wrapped, 1)])

    def generate(self, rows: DataFrame, attempt: int) -> DataFrame:
        # the n-th attempt puts the answer in another place
        order = [["rest", "d1", "d2", "d3"][(i + attempt) % 4] for i in range(4)]
        options = F.create_map(*[x for k, c in zip(answers.LABELS, order) for x in (F.lit(k), F.col(c))])
        right = F.lit(answers.LABELS[order.index("rest")])
        question = F.concat(F.lit("Which words continue '"), F.col("start"), F.lit("'?"))
        text = F.to_json(F.struct(question.alias("question"), options.alias("options"), right.alias("correct_answer")))
        done = self.made.filter("d1 IS NOT NULL AND d2 IS NOT NULL AND d3 IS NOT NULL").select("text", text.alias("generated"))
        return rows.join(done, "text", "left")


def parsed_question(generated: Column) -> Column:
    """Struct ``question, options, correct_answer`` of generated text, null unless it holds a question with exactly the four options and an answer among them."""
    o = answers.parsed_object(generated, MCQ)
    ok = o["question"].isNotNull() & answers.valid_options(o["options"], o["correct_answer"])
    return F.when(ok, F.struct(o["question"].alias("question"), o["options"].alias("options"), o["correct_answer"].alias("correct_answer")))


def questions_of(candidates: DataFrame, generator: QuestionGenerator, attempts: int = ATTEMPTS, seed: str = "42") -> DataFrame:
    """Candidates ``id, text, ...`` with ``question, options, correct_answer, good``: one question a chunk.

    An attempt that cannot be parsed, or leans on a text the reader does not see, is followed by another, up to ``attempts``;
    the first that passes has its options shuffled and its distractors judged (``good``), whatever the outcome.
    Chunks without a passing attempt have no row.  What was generated is written, so no model is asked twice.
    """
    left, done = candidates, None
    names = candidates.columns
    for attempt in range(attempts):
        made = written(generator.generate(left, attempt).select(*names, "generated"), "generated").withColumn("q", parsed_question(F.col("generated")))
        ok = F.coalesce(F.col("q").isNotNull() & self_contained(F.col("q.question")), F.lit(False))
        passed = made.filter(ok).select(*names, "q")
        done = passed if done is None else done.unionByName(passed)
        left = made.filter(~ok).select(*names)
        if attempt + 1 < attempts and left.isEmpty():
            break
    mapped, answer = answers.shuffled_options(F.col("id").cast("string"), F.col("q.options"), F.col("q.correct_answer"), seed=seed)
    rows = done.select(*names, F.col("q.question").alias("question"), mapped.alias("options"), answer.alias("correct_answer"))
    return exam.option_quality(rows, chunk="text").drop("too_close_to_text", "too_alike")


def generate_exam(chunks: DataFrame, exam_size: int, generator: QuestionGenerator, n_clusters: int | None = None, embedder: Embedder | None = None, labels: DataFrame | None = None, seed: int = 42, restarts: int = 10) -> DataFrame:
    """``id, question, options, correct_answer, source_chunk_id, cluster_id`` of an exam over ``chunks(id, text, vector)``.

    Chunks are clustered (or come with ``labels(id, label)``), slots allocated by the root of the cluster sizes, the chunks
    of each cluster taken in hash order until its slots hold accepted questions or it is exhausted: rounds of candidates, twice as
    many as the open slots and doubling, so few are generated in vain.  Later questions of cosine above 0.90 to a kept one are dropped.

    Defined results: chunks with null id, text or vector are not asked about; repeated rows count once; the id of a question is a
    hash of its chunk and text; an empty table gives no rows; extra columns are ignored.
    """
    base = chunks.filter("id IS NOT NULL AND text IS NOT NULL" + ("" if labels is not None else " AND vector IS NOT NULL"))
    pool = written(base.groupBy("id").agg(F.min("text").alias("text"), *([] if labels is not None else [F.first("vector").alias("vector")])), "pool")
    n = pool.count()
    if labels is None:
        k = exam.n_clusters(n, exam_size, n_clusters)
        labels = written(exam.kmeans_labels(pool, min(k, max(n, 1)), restarts, seed), "labels") if n else pool.select("id", F.lit(0).alias("label"))
    else:
        k = (labels.agg(F.max("label")).first()[0] or 0) + 1
    slots = written(exam.allocate(exam.cluster_sizes(labels, k), exam_size), "slots")
    # the exam's slots, one row a cluster
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("cluster_id").cast("string"), F.col("id").cast("string")))
    turn = F.row_number().over(Window.partitionBy("cluster_id").orderBy(key, "id"))
    rows = pool.select("id", "text").join(labels.select("id", F.col("label").alias("cluster_id")), "id").withColumn("turn", turn)
    rows = written(rows.join(slots.filter("slots > 0").select(F.col("cluster_id").cast(labels.schema["label"].dataType).alias("cluster_id"), "slots"), "cluster_id"), "turns")
    taken, low, high = None, 0, AHEAD
    while True:
        # turns of clusters that still have open slots, in proportion to them
        now = rows.filter((F.col("turn") > low * F.col("slots")) & (F.col("turn") <= high * F.col("slots")))
        if taken is not None:
            full = taken.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
            now = now.join(full, "cluster_id", "left").filter(F.coalesce("n", F.lit(0)) < F.col("slots")).drop("n")
        now = written(now, "round")
        if now.isEmpty():
            break
        got = written(questions_of(now, generator, seed=str(seed)).filter("good"), "questions")
        taken = got if taken is None else taken.unionByName(got)
        low, high = high, 2 * high
    if taken is None:
        taken = questions_of(rows.limit(0), generator)
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy("turn"))
    taken = taken.withColumn("nth", nth).filter(F.col("nth") <= F.col("slots"))
    out = taken.select(
        F.md5(F.concat_ws("|", F.col("id").cast("string"), "question")).alias("id"), "question", "options", "correct_answer", F.col("id").alias("source_chunk_id"), F.col("cluster_id").cast("int").alias("cluster_id"), "turn",
    )
    return without_repeats(written(out, "exam"), embedder).drop("turn")


def without_repeats(questions: DataFrame, embedder: Embedder | None = None, order: tuple[str, ...] = ("cluster_id", "turn", "id"), threshold: float = SAME_QUESTION) -> DataFrame:
    """The questions ``id, question, ...`` whose text has cosine of at most ``threshold`` to every earlier kept one.

    One window over an exam, which has tens of questions; questions whose text has no vector are kept.
    """
    numbered = written(questions.withColumn("pos", F.row_number().over(Window.partitionBy().orderBy(*order)).cast("long")), "ordered")
    vectors = (embedder or HashEmbedder()).embed(numbered, "pos", "question").withColumnRenamed("id", "pos").withColumn("grp", F.lit(0))
    edges = exam.close_edges(vectors, threshold, "grp")
    kept = exam.greedy_kept(numbered.select("pos", F.lit(0).alias("grp")), edges, "grp")
    return numbered.join(kept.select("pos"), "pos", "left_semi").drop("pos")
