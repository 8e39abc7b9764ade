"""Queries over the composed paths: retrieval by index type, evaluation, exam generation and refinement, stores and sources."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import answers
from corpusmill.functions.text import self_contained
from corpusmill.functions.vectors import hash_embed, hash_embed_rows
from corpusmill.operators import chunking, exam, generation, items, loop, pipeline, retrieval
from corpusmill.operators import index as store
from corpusmill.plans.catalog import query
from corpusmill.plans.corpus import STRIP, TERMS
from corpusmill.plans.scores import TRIALS, _trials
from corpusmill.plans.searches import _BM25, _embed_sql
from corpusmill.providers import HashEmbedder, OverlapGenerator
from corpusmill.runtime import shared_dir, table, written
from corpusmill.sources import corpus as src
from corpusmill.sources import history

# ---- retrieval of every question of the pool over the chunks

_CHUNKS = "ch AS (SELECT chunk_id, min(text) AS text FROM chunk WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id)"
_ASKED = "asked AS (SELECT id AS qid, min(question) AS question, min(CASE WHEN n = 1 THEN more END) AS more FROM (SELECT id, question, map_extract(options, correct_answer)[1] AS more, row_number() OVER (PARTITION BY id ORDER BY question, more NULLS FIRST) AS n FROM mcq_question WHERE id IS NOT NULL AND question IS NOT NULL) GROUP BY id)"


def _index(spark: SparkSession, sf_dir: str) -> store.Index:
    rows = table(spark, sf_dir, "chunk").filter("chunk_id IS NOT NULL AND text IS NOT NULL").groupBy("chunk_id").agg(F.min("text").alias("text"))
    chunks = written(rows.withColumn("doc_id", F.lit(None).cast("long")).withColumn("pos", F.lit(0)), "chunks")
    terms, stats = retrieval.postings(chunks, "chunk_id", "text")
    return store.Index(chunks, written(hash_embed_rows(chunks, "chunk_id", "text"), "vectors"), terms, stats)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "mcq_question")
    return q.withColumn("more", F.try_element_at("options", "correct_answer"))


def _text_hits(queries: str, k: int, name: str = "bm") -> str:
    body = _BM25.replace("@Q@", queries).replace("doc_id AS id", "chunk_id AS id").replace("FROM documents", "FROM ch")
    return body


_VEC = f"""{_embed_sql("dv", "chunk_id", "text", "ch")}, {_embed_sql("qv", "qid", "qtext", "q")},
vs AS (SELECT qv.id AS qid, dv.id AS id, round(list_distance(qv.v, dv.v), 6) AS score FROM qv CROSS JOIN dv),
vk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM vs)"""
_PLAIN = "q AS (SELECT qid, question AS qtext FROM asked)"


def _fused(k: int) -> str:
    return f"""l AS (SELECT qid, id, 0 AS list, rank FROM bm WHERE rank <= {k} UNION ALL SELECT qid, id, 1, rank FROM vk WHERE rank <= {k}),
f AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS first FROM l GROUP BY qid, id),
hy AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS rank FROM f) WHERE rank <= {k})"""


_HYBRID = f"WITH {_CHUNKS}, {_ASKED}, {_text_hits(_PLAIN, 5)}, {_VEC}, {_fused(5)}"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("qid").alias("question_id"), F.col("rank").cast("int").alias("rank"), "id", F.md5("text").alias("digest"), F.round("score", 6).alias("score"))


@query(f"WITH {_CHUNKS}, {_ASKED}, {_PLAIN}, {_VEC} SELECT qid AS question_id, rank::INT AS rank, id, md5(text) AS digest, round(score, 6) AS score FROM vk JOIN ch ON chunk_id = id WHERE rank <= 5")
def retrieve_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest chunks of every question, by vectors."""
    return _shown(pipeline.retrieve(_index(spark, sf_dir), _questions(spark, sf_dir), pipeline.Settings("vector_only")))


@query(f"{_HYBRID} SELECT qid AS question_id, rank::INT AS rank, id, md5(text) AS digest, round(score, 6) AS score FROM hy JOIN ch ON chunk_id = id")
def retrieve_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best chunks of every question, text and vector rankings fused."""
    return _shown(pipeline.retrieve(_index(spark, sf_dir), _questions(spark, sf_dir), pipeline.Settings("hybrid_bm25_vector")))


@query("SELECT id AS question_id, 0::INT AS rank, id, '' AS digest, 0::DOUBLE AS score FROM mcq_question WHERE false")
def retrieve_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval from the absent graph store."""
    return _shown(pipeline.retrieve(_index(spark, sf_dir), _questions(spark, sf_dir), pipeline.Settings("graph")))


@query(f"""{_HYBRID},
g AS (SELECT qid, id, round(1.0 / (60 + rank), 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(1.0 / (60 + rank), 9) DESC, rank) AS rank FROM hy)
SELECT qid AS question_id, rank::INT AS rank, id, md5(text) AS digest, round(score, 6) AS score FROM g JOIN ch ON chunk_id = id""")
def retrieve_hybrid_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused ranking, fused again with that of the absent graph store."""
    return _shown(pipeline.retrieve(_index(spark, sf_dir), _questions(spark, sf_dir), pipeline.Settings("hybrid_graph_vector")))


@query(f"""
WITH {_CHUNKS}, {_ASKED}, {_text_hits("q AS (SELECT qid || '#0' AS qid, question AS qtext FROM asked UNION ALL SELECT qid || '#1', more FROM asked)", 15)}, {_VEC}, {_fused(15)},
v AS (SELECT substr(qid, 1, length(qid) - 2) AS qid, right(qid, 1)::INT AS variant, id, rank, score FROM hy),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY variant, rank) AS n FROM v) WHERE n = 1),
p AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY variant, rank) AS prior FROM o),
t AS (SELECT p.*, ch.text, list_distinct({TERMS.format("question")}) AS a, list_distinct({TERMS.format("ch.text")}) AS b FROM p JOIN asked USING (qid) JOIN ch ON chunk_id = id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) DESC, prior) AS rank FROM t)
SELECT qid AS question_id, rank::INT AS rank, id, md5(text) AS digest, round(score, 6) AS score FROM r WHERE rank <= 3
""")
def retrieve_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and their right options as generated passages, fifteen hits each, joined, reranked and cut to three."""
    s = pipeline.Settings("hybrid_bm25_vector", 5, "overlap", 3, "hyde")
    return _shown(pipeline.retrieve(_index(spark, sf_dir), _questions(spark, sf_dir), s, generated="more"))


# ---- evaluation over what was retrieved

_EXAM = "e AS (SELECT * FROM (SELECT id, question, options, correct_answer, row_number() OVER (PARTITION BY id ORDER BY question NULLS FIRST, options::VARCHAR NULLS FIRST, correct_answer) AS n FROM mcq_question WHERE id IS NOT NULL) WHERE n = 1)"


@query(rf"""
{_HYBRID}, {_EXAM},
cx AS (SELECT qid, string_agg(text, chr(10) ORDER BY rank) AS context FROM hy JOIN ch ON chunk_id = hy.id GROUP BY qid),
k AS (SELECT id, k, len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(context, '')), '[\p{{L}}\p{{N}}]+')), list_distinct(regexp_extract_all(lower(coalesce(map_extract(options, k)[1], '')), '[\p{{L}}\p{{N}}]+')))) AS s
  FROM (SELECT *, unnest(['A', 'B', 'C', 'D']) AS k FROM e LEFT JOIN cx ON cx.qid = e.id WHERE options IS NOT NULL)),
b AS (SELECT id, k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, k) AS n FROM k) WHERE n = 1)
SELECT e.id AS question_id, coalesce(b.k, 'INVALID') AS selected_answer, coalesce(b.k = e.correct_answer, false) AS correct, coalesce('The answer is ' || b.k, 'QUESTION_EVALUATION_ERROR') AS generated_response,
  md5(CASE WHEN b.k IS NULL THEN '' ELSE coalesce(context, '') END) AS context
FROM e LEFT JOIN b ON b.id = e.id LEFT JOIN cx ON cx.qid = e.id
""")
def evaluate_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline generator's answers to all questions over their five retrieved chunks; questions without options are error rows."""
    q = _questions(spark, sf_dir)
    hits = pipeline.retrieve(_index(spark, sf_dir), q, pipeline.Settings("hybrid_bm25_vector"))
    rows = pipeline.evaluate(q, hits, OverlapGenerator())
    return rows.select("question_id", "selected_answer", "correct", "generated_response", F.md5("retrieved_context").alias("context"))


@query("""
WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC NULLS LAST, trial_number DESC, question_id DESC NULLS LAST) AS n FROM question_result) WHERE n = 1 AND trial_number = (SELECT min(trial_number) FROM question_result)),
q AS (SELECT id, min(question) AS question FROM mcq_question GROUP BY id),
w AS (SELECT *, row_number() OVER (ORDER BY question_id, result_id) AS nth FROM o WHERE NOT coalesce(correct, false) AND question_id IS NOT NULL)
SELECT nth::INT AS nth, md5(nth || '. Question: ' || coalesce(q.question, '') || chr(10) || '   Selected: ' || coalesce(selected_answer, '') || ', correct: ' || coalesce(correct_answer, '') || chr(10)
  || '   Context: ' || left(coalesce(retrieved_context, ''), 500) || chr(10) || '   Response: ' || left(coalesce(generated_response, ''), 300)) AS digest
FROM w LEFT JOIN q ON q.id = question_id WHERE nth <= 15
""")
def failure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks about the first fifteen wrong answers of the first trial, as a proposer reads them."""
    from corpusmill.operators.scoring import delivered_once

    cols = ["result_id", "loaded_at", "trial_number", "question_id", "correct", "selected_answer", "correct_answer", "retrieved_context", "generated_response"]
    once = delivered_once(table(spark, sf_dir, "question_result").select(*cols))
    first = once.agg(F.min("trial_number")).first()[0]
    rows = once.filter((F.col("trial_number") == first) & F.col("question_id").isNotNull()).withColumn("question_id", F.struct("question_id", "result_id"))
    pool = table(spark, sf_dir, "mcq_question").groupBy("id").agg(F.min("question").alias("question"))
    keys = rows.select(F.col("question_id").alias("id"), F.col("question_id.question_id").alias("qid")).distinct()
    asked = keys.join(pool.withColumnRenamed("id", "qid"), "qid", "left").select("id", "question")
    text = pipeline.failure_text(rows, asked)
    blocks = text.select(F.posexplode(F.split("text", r"\n\n(?=[0-9]+\. Question: )")).alias("i", "block"))
    return blocks.filter("block <> ''").select((F.col("i") + 1).alias("nth"), F.md5("block").alias("digest"))


# ---- generated questions

_JSON = """to_json({'question': question, 'options': options, 'correct_answer': correct_answer})"""


@query("""
WITH m AS (SELECT DISTINCT id, question, options, correct_answer FROM mcq_question WHERE id IS NOT NULL)
SELECT id, CASE WHEN ok THEN md5(question || '|' || array_to_string([coalesce(map_extract(options, k)[1], '') FOR k IN ['A', 'B', 'C', 'D']], '|') || '|' || correct_answer) END AS digest
FROM (SELECT *, question IS NOT NULL AND coalesce(list_sort(map_keys(options)) = ['A', 'B', 'C', 'D'] AND correct_answer IN ('A', 'B', 'C', 'D'), false) AS ok FROM m)
""")
def parse_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool's questions written as fenced, prefaced and comma-broken JSON and parsed back into valid questions."""
    q = table(spark, sf_dir, "mcq_question", wide=True).filter("id IS NOT NULL").select("id", "question", "options", "correct_answer")
    text = F.to_json(F.struct("question", "options", "correct_answer"), {"ignoreNullFields": "false"})
    broken = F.regexp_replace(text, r"\}$", ", }")
    kind = F.pmod(F.xxhash64("id"), F.lit(3))
    made = F.when(kind == 0, F.concat(F.lit("```json\n"), broken, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Here is the question: "), text, F.lit(" I hope it helps."))).otherwise(text)
    rows = q.select("id", made.alias("generated")).select("id", generation.parsed_question(F.col("generated")).alias("q"))
    listed = F.array_join(F.transform(F.array(*[F.lit(k) for k in answers.LABELS]), lambda k: F.coalesce(F.element_at("q.options", k), F.lit(""))), "|")
    return rows.select("id", F.when(F.col("q").isNotNull(), F.md5(F.concat_ws("|", "q.question", listed, "q.correct_answer"))).alias("digest")).distinct()


_W = r"list_filter(string_split_regex(text, '[\s\p{Z}\x{0085}\x0b]+'), lambda t: t <> '')"


@query(f"""
WITH {_CHUNKS}, w AS (SELECT DISTINCT text, {_W} AS w FROM ch),
m AS (SELECT text, array_to_string(w[1:6], ' ') AS start FROM w WHERE len(w) >= 12)
SELECT chunk_id AS id, md5('Which words continue ''' || start || '''?') AS digest FROM m JOIN ch USING (text)
""")
def mcq_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about every chunk of at least twelve words by the offline generator: attempts, parsing, checks and shuffle run on all."""
    chunks = _index(spark, sf_dir).chunks.select(F.col("chunk_id").alias("id"), "text")
    made = generation.questions_of(chunks, generation.ClozeGenerator(chunks, 16))
    return made.filter(self_contained(F.col("question")) & (F.size("options") == 4)).select("id", F.md5("question").alias("digest"))


@query()
def generate_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exam of fifty questions over the chunks: clustered vectors, allocated slots, accepted questions, repeats dropped."""
    chunks = _index(spark, sf_dir).chunks.select(F.col("chunk_id").alias("id"), "text")
    rows = chunks.join(hash_embed(chunks, "id", "text"), "id")
    return generation.generate_exam(rows, 50, generation.ClozeGenerator(chunks)).select("id", "question", "correct_answer", "source_chunk_id", "cluster_id")


@query("""
WITH p AS (SELECT id, min(source_chunk_id) AS source_chunk_id, min(discrimination) AS a FROM mcq_question WHERE id IS NOT NULL AND discrimination IS NOT NULL GROUP BY id),
r AS (SELECT *, row_number() OVER (ORDER BY a, id) AS r, count(*) OVER () AS n FROM p),
kept AS (SELECT * FROM r WHERE r > greatest(1, floor(n * 0.1::DOUBLE)) OR n <= 1),
gone AS (SELECT * FROM r WHERE NOT (r > greatest(1, floor(n * 0.1::DOUBLE)) OR n <= 1)),
c AS (SELECT chunk_id AS id, min(doc_id % 20)::INT AS cluster_id FROM chunk GROUP BY chunk_id),
culled AS (SELECT DISTINCT cluster_id FROM gone JOIN c ON c.id = gone.source_chunk_id),
fresh AS (SELECT c.id, row_number() OVER (ORDER BY CASE WHEN c.cluster_id IN (SELECT cluster_id FROM culled) THEN 0 ELSE 1 END, md5('42|' || c.id), c.id) AS n FROM c
  WHERE c.id NOT IN (SELECT source_chunk_id FROM kept WHERE source_chunk_id IS NOT NULL))
SELECT id, source_chunk_id FROM kept UNION ALL SELECT 'new_' || id, id FROM fresh WHERE n <= (SELECT count(*) FROM gone)
""")
def refine_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool as one exam without its tenth of least discriminating questions, which unused chunks replace, those of their clusters first."""
    pool = table(spark, sf_dir, "mcq_question").filter("id IS NOT NULL AND discrimination IS NOT NULL").groupBy("id").agg(F.min("source_chunk_id").alias("source_chunk_id"), F.min("discrimination").alias("a"))
    pool = written(pool, "pool")
    chunks = table(spark, sf_dir, "chunk").groupBy(F.col("chunk_id").alias("id")).agg(F.min((F.col("doc_id") % 20).cast("int")).alias("cluster_id"))
    gone = written(items.culled(pool, "a", "id"), "gone")
    kept = pool.join(gone.select("id"), "id", "left_anti")
    clusters = gone.select("source_chunk_id").join(chunks, F.col("source_chunk_id") == chunks["id"]).select("cluster_id")
    fresh = exam.replacements(chunks, clusters, kept, gone.count()).select(F.concat(F.lit("new_"), F.col("id")).alias("id"), F.col("id").alias("source_chunk_id"))
    parameters = pool.select(F.col("id").alias("question_id"), "a", F.lit(0.5).alias("b"), F.lit(0.25).alias("g"))
    return items.refined(pool.drop("a"), parameters, fresh).select("id", "source_chunk_id")


# ---- stores and sources

_FOLDS = r"""p AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10) || chr(10)), lambda x: x <> ''), lambda x: [x]) AS p FROM documents WHERE text IS NOT NULL AND """ + STRIP.format("text") + r""" <> ''),
fold AS (SELECT doc_id, list_reduce(p, lambda acc, x: CASE WHEN length(acc[-1]) + 2 + length(x[1]) > 1024 THEN list_concat(acc, x) ELSE list_concat(acc[1:-2], [acc[-1] || chr(10) || chr(10) || x[1]]) END) AS c FROM p WHERE len(p) > 0),
ck AS (SELECT doc_id, """ + STRIP.format("t") + r""" AS text, i FROM (SELECT doc_id, unnest(c) AS t, generate_subscripts(c, 1) AS i FROM fold))"""


@query(f"""
WITH {_FOLDS}, kept AS (SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id, i) - 1) AS n FROM ck WHERE text <> '')
SELECT 'chunk_' || n AS chunk_id, doc_id, md5(text) AS digest, (SELECT count(*) FROM kept)::BIGINT AS n_chunks, true AS reused FROM kept
""")
def index_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents built, registered under its fingerprint, found again and loaded: its chunks, its count and that it was not built twice."""
    docs = table(spark, sf_dir, "documents", wide=True).select("doc_id", "text")
    registry = store.Registry(spark, f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}")
    config = {"chunking_strategy": "fixed", "chunk_size": 1024, "chunk_overlap": 0}
    built = []

    def make() -> store.Index:
        built.append(1)
        return store.build(docs, "fixed", 1024, 0)

    registry.get_or_build("demo", make, config)
    index = registry.get_or_build("demo", make, config)
    n = store.metadata(spark, registry.path("demo"))["n_chunks"]
    reused = len(built) == 1 and registry.manifest("demo")["config"] == config
    return index.chunks.select("chunk_id", "doc_id", F.md5("text").alias("digest"), F.lit(n).alias("n_chunks"), F.lit(reused).alias("reused"))


@query(f"WITH {TRIALS} SELECT DISTINCT trial_number, score, config.runtime.top_k AS top_k, config.structural.index_type AS index_type FROM trials WHERE trial_number IS NOT NULL AND config IS NOT NULL")
def history_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trials appended to a history of JSON lines that also holds blank and malformed ones, and read back."""
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    history.append(_trials(spark, sf_dir).select("trial_number", "config", "score", F.col("trial_ts").alias("timestamp")), path)
    spark.createDataFrame([("",), ("{broken",), ('{"score": 0.5}',)], "value string").write.mode("append").text(path)
    return history.read(spark, path).select("trial_number", "score", "config.runtime.top_k", "config.structural.index_type").distinct()


@query(f"SELECT item_id::VARCHAR AS name, md5({STRIP.format('text')}) AS digest FROM heldout_item WHERE text IS NOT NULL AND {STRIP.format('text')} <> ''")
def corpus_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every held-out item written as a file of a folder, with hidden, side and unreadable files, and read back as a corpus."""
    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "heldout_item").filter("text IS NOT NULL").select(F.col("item_id").cast("string").alias("name"), "text")
    _write_files(spark, rows, path)
    docs = src.documents(src.read_corpus(spark, path))
    return docs.select(F.regexp_extract("path", r"([^/]+)\.(?:md|txt)$", 1).alias("name"), F.md5("text").alias("digest"))


def _write_files(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """One file a row through the file system of ``path``; the test items are a fixed table of a few hundred rows."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    extra = [(".hidden.md", "hidden"), ("metadata.json", "{}"), ("scan.bin", "unsupported")]
    for name, text in [(f"{r['name']}.{'md' if len(r['text']) % 2 else 'txt'}", r["text"]) for r in rows.toLocalIterator()] + extra:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
        out.write(bytearray(text.encode("utf-8")))
        out.close()


@query(f"""
WITH {TRIALS}, b AS (SELECT * FROM trials WHERE score IS NOT NULL ORDER BY score DESC, trial_number LIMIT 1)
SELECT config.structural.chunk_size AS chunk_size, config.structural.embedding_model AS embedding_model, config.runtime.top_k AS top_k, config.runtime.llm_model AS llm_model FROM b
""")
def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best trial's configuration saved as YAML and read back from a fenced reply."""
    import tempfile

    from corpusmill.operators.scoring import best_trial

    row = best_trial(_trials(spark, sf_dir)).first()
    kinds = "chunk_size int, embedding_model string, top_k int, llm_model string"
    if row is None:
        return spark.createDataFrame([], kinds)
    config = json.loads(json.dumps(row["config"].asDict(recursive=True)))
    with tempfile.TemporaryDirectory() as folder:  # a file of one trial on the driver
        loop.save_best({"trial": loop.Trial(**config)}, Path(folder) / "best.yaml")
        text = (Path(folder) / "best.yaml").read_text(encoding="utf-8")
    t = loop.read_trial(f"The best one:\n```yaml\n{text}```\n")
    return spark.createDataFrame([(t.structural["chunk_size"], t.structural["embedding_model"], t.runtime["top_k"], t.runtime["llm_model"])], kinds)
