"""Queries over answers and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import answers
from corpusmill.operators import scoring, space
from corpusmill.plans.catalog import query
from corpusmill.plans.corpus import STRIP
from corpusmill.providers import overlap_answer
from corpusmill.runtime import table

# each answer as delivered last; trials without repeated rows
ONCE = """once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC NULLS LAST, trial_number DESC, question_id DESC NULLS LAST) AS n FROM question_result) WHERE n = 1)"""
TRIALS = "trials AS (SELECT DISTINCT trial_number, config, score, trial_ts FROM trial_record)"


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["result_id", "loaded_at", "trial_number", "question_id", "correct", "selected_answer", "correct_answer", "generated_response"]
    return scoring.delivered_once(table(spark, sf_dir, "question_result").select(*cols))


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "trial_record").select("trial_number", "config", "score", "trial_ts").distinct()


_K = r"(^|[^\p{L}\p{N}_])"
_E = r"($|[^\p{L}\p{N}_])"


@query(rf"""
WITH r AS (SELECT DISTINCT generated_response, {STRIP.format("generated_response")} AS t FROM question_result)
SELECT md5(coalesce(generated_response, '')) AS response, upper(coalesce(
  nullif(regexp_extract(t, 'answer\s*(?:is|:)\s*(A|B|C|D){_E}', 1, 'i'), ''),
  nullif(regexp_extract(t, '{_K}(A|B|C|D)\s*[).:]\s', 2, 'i'), ''),
  nullif(regexp_extract(t, '^(A|B|C|D){_E}', 1, 'i'), ''),
  nullif(regexp_extract(t, '{_K}(A|B|C|D)$', 2, 'i'), ''),
  nullif(regexp_extract(t, '{_K}(A|B|C|D){_E}', 2, 'i'), ''), 'INVALID')) AS answer
FROM r WHERE generated_response IS NOT NULL
""")
def parse_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letter each different response names."""
    rows = table(spark, sf_dir, "question_result").select("generated_response").distinct().filter("generated_response IS NOT NULL")
    return rows.select(F.md5("generated_response").alias("response"), answers.parse_answer(F.col("generated_response")).alias("answer"))


@query(f"WITH {ONCE} SELECT trial_number, count_if(coalesce(correct, false))::BIGINT AS n_correct, count(*)::BIGINT AS n_total, round(count_if(coalesce(correct, false)) / count(*), 6) AS score FROM once GROUP BY trial_number")
def exam_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right answers, answers and score of each trial."""
    return scoring.exam_score(_once(spark, sf_dir), ["trial_number"])


@query(f"""
WITH {ONCE}, f AS (SELECT *, row_number() OVER (PARTITION BY trial_number ORDER BY result_id) AS nth FROM once WHERE NOT coalesce(correct, false))
SELECT trial_number, result_id, nth::INT AS nth, selected_answer, correct_answer FROM f WHERE nth <= 15
""")
def failed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 wrong answers of each trial."""
    return scoring.failed(_once(spark, sf_dir), "trial_number", "result_id").select("trial_number", "result_id", "nth", "selected_answer", "correct_answer")


@query(f"WITH {TRIALS} SELECT trial_number, score FROM trials WHERE score IS NOT NULL ORDER BY score DESC, trial_number LIMIT 1")
def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best trial."""
    return scoring.best_trial(_trials(spark, sf_dir)).select("trial_number", "score")


@query(f"""
WITH {TRIALS}, b AS (SELECT trial_number, score, max(score) OVER (ORDER BY trial_number ROWS UNBOUNDED PRECEDING) AS best_so_far,
  max(score) OVER (ORDER BY trial_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM trials)
SELECT trial_number, best_so_far, coalesce(score > before OR (before IS NULL AND score IS NOT NULL), false) AS improved FROM b
""")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score so far at every trial, and whether the trial improved it."""
    return scoring.running_best(_trials(spark, sf_dir)).select("trial_number", "best_so_far", "improved")


@query(f"""
WITH {TRIALS}
SELECT trial_number, 'Trial ' || trial_number || ': score=' || coalesce(format('{{:.3f}}', score), 'nan') || ' | chunk=' || config.structural.chunk_size || ', embed=' || config.structural.embedding_model
  || ', index=' || config.structural.index_type || ', top_k=' || config.runtime.top_k || ', reranker=' || config.runtime.reranker || ', llm=' || config.runtime.llm_model AS line
FROM trials ORDER BY trial_number DESC LIMIT 10
""")
def last_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line about each of the last ten trials."""
    return scoring.last_n(_trials(spark, sf_dir)).select("trial_number", scoring.summary_line().alias("line"))


_FIELDS = " UNION ALL ".join(f"SELECT trial_number, '{f}' AS field, o.{f}::VARCHAR AS old, c.{f}::VARCHAR AS new FROM p" for f in scoring.DIFF_FIELDS)


@query(f"WITH {TRIALS}, p AS (SELECT * FROM (SELECT trial_number, config AS c, lag(config) OVER (ORDER BY trial_number) AS o FROM trials) WHERE o IS NOT NULL) SELECT * FROM ({_FIELDS}) WHERE old IS DISTINCT FROM new")
def config_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration fields that changed from trial to trial."""
    return scoring.config_changes(_trials(spark, sf_dir))


@query(f"""
WITH {ONCE}, c AS (SELECT trial_number AS trial, question_id, arg_max(coalesce(correct, false)::INT, result_id) AS correct FROM once WHERE question_id IS NOT NULL GROUP BY ALL)
SELECT t.trial, q.question_id, coalesce(c.correct, 0)::INT AS correct FROM (SELECT DISTINCT trial_number AS trial FROM once WHERE trial_number IS NOT NULL) t CROSS JOIN (SELECT DISTINCT question_id FROM once WHERE question_id IS NOT NULL) q
LEFT JOIN c ON c.trial = t.trial AND c.question_id = q.question_id
""")
def response_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense matrix of trials and questions."""
    return scoring.response_matrix(_once(spark, sf_dir))


@query(f"""
WITH {ONCE}, e AS (SELECT DISTINCT id FROM mcq_question WHERE question IS NOT NULL),
r AS (SELECT * FROM once WHERE question_id IN (SELECT id FROM e)),
c AS (SELECT trial_number AS trial, question_id, arg_max(coalesce(correct, false)::INT, result_id) AS correct FROM r GROUP BY ALL)
SELECT t.trial, q.question_id, coalesce(c.correct, 0)::INT AS correct FROM (SELECT DISTINCT trial_number AS trial FROM once) t CROSS JOIN (SELECT DISTINCT question_id FROM r) q LEFT JOIN c ON c.trial = t.trial AND c.question_id = q.question_id
""")
def response_matrix_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense matrix restricted to the questions of the pool."""
    exam = table(spark, sf_dir, "mcq_question").filter("question IS NOT NULL").select(F.col("id").alias("question_id"))
    return scoring.response_matrix(_once(spark, sf_dir), exam)


@query("""
WITH m AS (SELECT DISTINCT id, question, options FROM mcq_question WHERE question IS NOT NULL AND options IS NOT NULL)
SELECT id, md5('Context:' || chr(10) || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Options:' || chr(10) ||
  array_to_string(list_transform(list_filter(['A', 'B', 'C', 'D'], lambda k: list_contains(map_keys(options), k)), lambda k: k || ') ' || coalesce(map_extract(options, k)[1], '')), chr(10))
  || chr(10) || chr(10) || 'Answer with the letter of one option.') AS digest FROM m
""")
def answer_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the prompt of every question, without context."""
    q = table(spark, sf_dir, "mcq_question").filter("question IS NOT NULL AND options IS NOT NULL")
    return q.select("id", F.md5(scoring.answer_prompt(F.col("question"), F.col("options"), F.lit(None).cast("string"))).alias("digest")).distinct()


@query(rf"""
WITH c AS (SELECT chunk_id, min(text) AS text FROM chunk GROUP BY chunk_id),
m AS (SELECT DISTINCT id, options, correct_answer, text FROM mcq_question JOIN c ON chunk_id = source_chunk_id WHERE options IS NOT NULL),
k AS (SELECT id, correct_answer, k, len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')), list_distinct(regexp_extract_all(lower(coalesce(map_extract(options, k)[1], '')), '[\p{{L}}\p{{N}}]+')))) AS s
  FROM (SELECT *, unnest(['A', 'B', 'C', 'D']) AS k FROM m)),
b AS (SELECT id, correct_answer, k, row_number() OVER (PARTITION BY id, correct_answer ORDER BY s DESC, k) AS n FROM k)
SELECT DISTINCT id, 'The answer is ' || k AS response, k = correct_answer AS correct FROM b WHERE n = 1
""")
def evaluate_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline generator's answer to every question with its own chunk as context, parsed and scored."""
    chunk = table(spark, sf_dir, "chunk").groupBy("chunk_id").agg(F.min("text").alias("text"))
    q = table(spark, sf_dir, "mcq_question").filter("options IS NOT NULL")
    rows = q.join(chunk, F.col("source_chunk_id") == F.col("chunk_id"))
    rows = rows.select("id", overlap_answer(F.col("options"), F.col("text")).alias("response"), "correct_answer")
    return rows.select("id", "response", (answers.parse_answer(F.col("response")) == F.col("correct_answer")).alias("correct")).distinct()


_SPACE = space.Space(
    {"structural.parser": ["pymupdf4llm", "docling"], "structural.chunking_strategy": ["recursive"], "structural.index_type": ["vector_only", "hybrid_bm25_vector"],
     "runtime.reranker": ["none"], "runtime.query_expansion": ["none", "hyde"], "structural.embedding_model": ["local/enc-mini", "local/enc-base"], "runtime.llm_model": ["local/gen-3b", "local/gen-7b"]},
    {"structural.chunk_size": space.Span(256, 1024), "structural.chunk_overlap": space.Span(0, 128), "runtime.top_k": space.Span(3, 10),
     "runtime.hybrid_alpha": space.Span(0, 0.5), "runtime.reranker_top_n": space.Span(3, 10), "runtime.temperature": space.Span(0, 0.5)},
)
_CHECKS = sorted([(k, f"config.{k} IN ({', '.join(repr(x) for x in v)})") for k, v in _SPACE.choices.items()] + [(k, f"config.{k} BETWEEN {s.low} AND {s.high}") for k, s in _SPACE.spans.items()])


@query(f"WITH {TRIALS} SELECT trial_number, array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{k}' END" for k, c in _CHECKS) + "], lambda x: x IS NOT NULL), ',') AS violations FROM trials")
def validate_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each trial's configuration lies outside a search space."""
    return space.violations(_trials(spark, sf_dir), _SPACE).select("trial_number", F.array_join("violations", ",").alias("violations"))


@query(f"""
WITH {TRIALS}
SELECT substr(sha256('{{"chunk_overlap": ' || s.chunk_overlap || ', "chunk_size": ' || s.chunk_size || ', "chunking_strategy": "' || s.chunking_strategy || '", "embedding_model": "' || s.embedding_model
  || '", "index_type": "' || s.index_type || '", "parser": "' || s.parser || '"}}'), 1, 12) AS fingerprint, count(*)::BIGINT AS trials, min(trial_number)::INT AS first_trial
FROM (SELECT trial_number, config.structural AS s FROM trials) GROUP BY 1
""")
def structural_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials that can share an index, by fingerprint."""
    rows = _trials(spark, sf_dir).select("trial_number", space.fingerprint(F.col("config.structural")).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("trials"), F.min("trial_number").alias("first_trial"))
