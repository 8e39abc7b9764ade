"""Queries over the exam pool: strata, allocation, sampling, quality, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import answers
from corpusmill.functions.vectors import cosine, hash_embed
from corpusmill.operators import exam
from corpusmill.plans.catalog import query
from corpusmill.plans.searches import _TOK, _embed_sql
from corpusmill.runtime import table, written

# the pool without repeated rows; clusters by label
_POOL = """pool AS (SELECT id, min(question) AS question, min(cluster_id) AS cluster_id FROM mcq_question WHERE id IS NOT NULL GROUP BY id)"""
_SIZES = """kmax AS (SELECT max(cluster_id) AS k FROM pool),
sizes AS (SELECT c::INT AS cluster_id, count(pool.id) AS size FROM (SELECT unnest(generate_series(0, (SELECT k FROM kmax))) AS c) LEFT JOIN pool ON pool.cluster_id = c GROUP BY c)"""
_ALLOC = """quota AS (SELECT *, CASE WHEN (SELECT sum(sqrt(size)) FROM sizes) = 0 THEN 0 ELSE 50 * sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes) END AS q FROM sizes),
base AS (SELECT *, least(floor(q), size)::BIGINT AS base, round(q - floor(q), 9) AS rest FROM quota),
turn AS (SELECT *, base < size AS room, 50 - (SELECT sum(base) FROM base) AS missing, row_number() OVER (PARTITION BY base < size ORDER BY rest DESC, cluster_id) AS t FROM base),
alloc AS (SELECT cluster_id, size, base + CASE WHEN room AND t <= missing THEN 1 ELSE 0 END AS slots FROM turn)"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "mcq_question", wide=True).filter("id IS NOT NULL")
    return q.groupBy("id").agg(F.min("question").alias("question"), F.min("cluster_id").alias("cluster_id"))


def _sizes(pool: DataFrame) -> DataFrame:
    most = pool.agg(F.max("cluster_id")).first()[0]
    return exam.cluster_sizes(pool, (most if most is not None else -1) + 1, "cluster_id")


@query(f"WITH {_POOL} SELECT greatest(1, least(floor(sqrt(count(*)))::BIGINT, 50))::BIGINT AS clusters FROM pool")
def resolve_n_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many clusters an exam of 50 from the pool has."""
    return _pool(spark, sf_dir).agg(exam.n_clusters_column(F.count(F.lit(1)), 50).cast("bigint").alias("clusters"))


@query(f"WITH {_POOL}, {_SIZES} SELECT cluster_id, size::BIGINT AS size FROM sizes")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of each cluster label, 0 for unused labels."""
    return _sizes(_pool(spark, sf_dir))


@query(f"WITH {_POOL}, {_SIZES}, {_ALLOC} SELECT cluster_id, size::BIGINT AS size, slots::BIGINT AS slots FROM alloc")
def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of an exam of 50 by cluster."""
    return exam.allocate(_sizes(_pool(spark, sf_dir)), 50)


@query(f"""
WITH {_POOL}, {_SIZES}, {_ALLOC},
r AS (SELECT id, pool.cluster_id, slots, row_number() OVER (PARTITION BY pool.cluster_id ORDER BY md5('42|' || pool.cluster_id || '|' || id), id) AS turn FROM pool JOIN alloc USING (cluster_id) WHERE slots > 0)
SELECT id, cluster_id, turn::INT AS turn FROM r WHERE turn <= slots
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exam: in each cluster the allocated number of questions in hash order."""
    pool = _pool(spark, sf_dir)
    return exam.stratified(pool, exam.allocate(_sizes(pool), 50)).select("id", "cluster_id", "turn")


@query(f"""
WITH {_POOL}, {_SIZES}, {_ALLOC},
c AS (SELECT id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY md5('42|' || cluster_id || '|' || id), id) AS turn, question IS NOT NULL AND lower(question) LIKE '%e%' AND length(question) % 3 > 0 AS ok FROM pool WHERE cluster_id IS NOT NULL),
r AS (SELECT c.*, slots, row_number() OVER (PARTITION BY c.cluster_id ORDER BY turn) AS n FROM c JOIN alloc USING (cluster_id) WHERE ok)
SELECT id, cluster_id, turn::INT AS turn FROM r WHERE n <= slots
""")
def take_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each cluster walked in order until its slots are filled with accepted ones."""
    pool = _pool(spark, sf_dir).filter("cluster_id IS NOT NULL")
    key = F.md5(F.concat_ws("|", F.lit("42"), F.col("cluster_id").cast("string"), "id"))
    rows = pool.withColumn("turn", F.row_number().over(Window.partitionBy("cluster_id").orderBy(key, "id")))
    rows = rows.withColumn("ok", F.col("question").isNotNull() & F.lower("question").contains("e") & (F.length("question") % 3 > 0))
    return exam.accepted(rows, exam.allocate(_sizes(pool), 50)).select("id", "cluster_id", "turn")


@query()
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster labels of all vectors, the best of ten restarts."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return exam.kmeans_labels(rows, 10)


@query("""
WITH g AS (SELECT label, list([{'id': vec_id, 'v': embedding::DOUBLE[]}] ORDER BY vec_id) AS l FROM embeddings GROUP BY label),
k AS (SELECT label, unnest(list_reduce(l, lambda acc, x: CASE WHEN list_bool_or(list_transform(acc, lambda a: round(list_cosine_similarity(a.v, x[1].v), 9) > 0.3)) THEN acc ELSE list_concat(acc, x) END)) AS e FROM g)
SELECT label, e.id AS pos FROM k
""")
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each label kept by a greedy walk in order of id that drops those of cosine above 0.3 to a kept one."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    return exam.greedy_kept(rows, exam.close_edges(rows, 0.3, "label"), "label").withColumnRenamed("grp", "label")


@query(f"""
WITH {_POOL}, asked AS (SELECT id, cluster_id, question FROM pool WHERE question IS NOT NULL AND cluster_id IS NOT NULL),
{_embed_sql("ev", "id", "question", "asked")},
g AS (SELECT cluster_id, list([{{'id': asked.id, 'v': ev.v}}] ORDER BY asked.id) AS l FROM asked JOIN ev ON ev.id = asked.id GROUP BY cluster_id),
k AS (SELECT cluster_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN list_bool_or(list_transform(acc, lambda a: round(list_cosine_similarity(a.v, x[1].v), 9) > 0.9)) THEN acc ELSE list_concat(acc, x) END)) AS e FROM g)
SELECT cluster_id, e.id AS id FROM k
""")
def question_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of each cluster label kept by a greedy walk in order of id that drops those of cosine above 0.9 to a kept one."""
    pool = _pool(spark, sf_dir).filter("question IS NOT NULL AND cluster_id IS NOT NULL")
    numbered = written(pool.withColumn("pos", F.row_number().over(Window.partitionBy("cluster_id").orderBy("id")).cast("long")), "numbered")
    vectors = hash_embed(numbered, "id", "question").join(numbered.select("id", "cluster_id", "pos"), "id")
    kept = exam.greedy_kept(vectors, exam.close_edges(vectors, 0.9, "cluster_id"), "cluster_id")
    return kept.withColumnRenamed("grp", "cluster_id").join(numbered.select("cluster_id", "pos", "id"), ["cluster_id", "pos"]).select("cluster_id", "id")


_QUALITY_VECTORS = f"""c AS (SELECT chunk_id, min(text) AS chunk FROM chunk GROUP BY chunk_id),
m AS (SELECT * FROM (SELECT id, options, correct_answer, source_chunk_id, row_number() OVER (PARTITION BY id ORDER BY options::VARCHAR, correct_answer, source_chunk_id) AS n FROM mcq_question WHERE id IS NOT NULL AND options IS NOT NULL) WHERE n = 1),
r AS (SELECT id, correct_answer, options, chunk FROM m JOIN c ON chunk_id = source_chunk_id WHERE list_contains(map_keys(options), correct_answer)),
t AS (SELECT id || '|' || k AS key, map_extract(options, k)[1] AS txt FROM (SELECT *, unnest(map_keys(options)) AS k FROM r) UNION ALL SELECT id || '|chunk', chunk FROM r),
{_embed_sql("ev", "key", "txt", "t")},
x AS (SELECT r.id, cv.v AS c, rv.v AS r, wv.v AS w FROM (SELECT *, unnest(map_keys(options)) AS k FROM r) r LEFT JOIN ev cv ON cv.id = r.id || '|chunk' LEFT JOIN ev rv ON rv.id = r.id || '|' || correct_answer LEFT JOIN ev wv ON wv.id = r.id || '|' || k WHERE k <> correct_answer)
SELECT id, bool_or(coalesce(round(list_cosine_similarity(c, r), 6), 0) + 0.05 < coalesce(round(list_cosine_similarity(c, w), 6), 0)) AS too_close_to_text, bool_or(coalesce(round(list_cosine_similarity(r, w), 6), 0) >= 0.85) AS too_alike FROM x GROUP BY id"""


def _jac(a: str, b: str) -> str:
    """DuckDB n-gram Jaccard of the token lists a and b with n grams."""
    g = "list_distinct(list_transform(generate_series(1, greatest(len({0}) - n + 1, 1)), lambda i: array_to_string({0}[i:i + n - 1], ' ')))"
    x = f"CASE WHEN len({a}) < n OR len({b}) < n THEN list_distinct({a}) ELSE {g.format(a)} END"
    y = f"CASE WHEN len({a}) < n OR len({b}) < n THEN list_distinct({b}) ELSE {g.format(b)} END"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END"


@query(f"""
WITH c AS (SELECT chunk_id, min(text) AS chunk FROM chunk GROUP BY chunk_id),
m AS (SELECT DISTINCT id, options, correct_answer, chunk FROM mcq_question LEFT JOIN c ON chunk_id = source_chunk_id),
t AS (SELECT id, correct_answer, {_TOK.format("chunk")} AS ct, options, map_keys(options) AS ks,
  greatest(1, floor(list_sum(list_transform(map_values(options), lambda v: len({_TOK.format("v")}))) / len(map_values(options))))::INT AS n
  FROM m WHERE options IS NOT NULL AND chunk IS NOT NULL AND map_extract(options, correct_answer)[1] IS NOT NULL),
d AS (SELECT id, n, ct, {_TOK.format("map_extract(options, correct_answer)[1]")} AS r, {_TOK.format("map_extract(options, k)[1]")} AS w
  FROM (SELECT *, unnest(ks) AS k FROM t) WHERE k <> correct_answer),
s AS (SELECT id, bool_or({_jac("ct", "r")} + 0.05 < {_jac("ct", "w")}) AS close, bool_or({_jac("r", "w")} >= 0.70) AS alike FROM d GROUP BY id)
SELECT id, s.close AS too_close_to_text, s.alike AS too_alike, coalesce(NOT s.close AND NOT s.alike, false) AS good FROM m LEFT JOIN s USING (id)
""")
def discriminator_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the distractors of each question are neither closer to the text than the answer nor like it."""
    chunk = table(spark, sf_dir, "chunk").groupBy("chunk_id").agg(F.min("text").alias("chunk"))
    q = table(spark, sf_dir, "mcq_question", wide=True).withColumn("options", F.col("options").cast("map<string,string>"))
    keyed = q.select("id", F.array_sort(F.map_entries("options")).alias("e"), "correct_answer", "source_chunk_id").distinct()
    rows = keyed.join(chunk, F.col("source_chunk_id") == F.col("chunk_id"), "left").withColumn("options", F.map_from_entries("e"))
    return exam.option_quality(rows).select("id", "too_close_to_text", "too_alike", "good").distinct()


@query(f"WITH {_QUALITY_VECTORS}")
def discriminator_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine half of the distractors' quality, with hashed embeddings of chunk and options."""
    chunk = table(spark, sf_dir, "chunk").groupBy("chunk_id").agg(F.min("text").alias("chunk"))
    q = table(spark, sf_dir, "mcq_question", wide=True).filter("id IS NOT NULL AND options IS NOT NULL")
    q = q.groupBy("id").agg(F.min(F.struct(F.array_sort(F.map_entries("options")).alias("e"), "correct_answer", "source_chunk_id")).alias("x")).select("id", "x.*")
    rows = written(q.join(chunk, F.col("source_chunk_id") == F.col("chunk_id")).select("id", "correct_answer", "chunk", F.map_from_entries("e").alias("options")), "quality")
    texts = rows.select("id", F.explode(F.map_concat("options", F.create_map(F.lit("chunk"), F.col("chunk")))).alias("k", "t")).select(F.concat_ws("|", "id", "k").alias("key"), "id", "k", "t")
    made = hash_embed(texts, "key", "t").withColumnRenamed("id", "key").join(texts.select("key", "id", "k"), "key")
    vecs = made.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "vector"))).alias("v"))
    zero = F.array_repeat(F.lit(0.0), 64)
    full = rows.join(vecs, "id").withColumn("chunk_vec", F.coalesce(F.try_element_at("v", F.lit("chunk")), zero))
    full = full.withColumn("option_vecs", F.map_from_entries(F.transform(F.map_keys("options"), lambda k: F.struct(k.alias("k"), F.coalesce(F.try_element_at("v", k), zero).alias("v")))))
    rv = F.element_at("option_vecs", F.col("correct_answer"))
    wrong = F.filter(F.map_keys("options"), lambda k: k != F.col("correct_answer"))
    judged = full.filter(F.map_contains_key("options", F.col("correct_answer"))).select("id", F.explode(wrong).alias("k"), "chunk_vec", rv.alias("rv"), F.col("option_vecs").alias("o"))
    w = F.element_at("o", F.col("k"))
    close = F.round(cosine(F.col("chunk_vec"), F.col("rv")), 6) + exam.EXTRA_COSINE < F.round(cosine(F.col("chunk_vec"), w), 6)
    alike = F.round(cosine(F.col("rv"), w), 6) >= exam.INTRA_COSINE
    return judged.groupBy("id").agg(F.bool_or(close).alias("too_close_to_text"), F.bool_or(alike).alias("too_alike"))


@query("""
SELECT DISTINCT id, coalesce(list_sort(map_keys(options)) = ['A', 'B', 'C', 'D'] AND correct_answer IN ('A', 'B', 'C', 'D'), false) AS ok FROM mcq_question
""")
def valid_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with exactly the four options and an answer among them."""
    q = table(spark, sf_dir, "mcq_question", wide=True)
    return q.select("id", answers.valid_options(F.col("options"), F.col("correct_answer")).alias("ok")).distinct()


@query("""
WITH m AS (SELECT DISTINCT id, options, correct_answer FROM mcq_question WHERE len(map_keys(options)) = 4),
o AS (SELECT id, map_extract(options, correct_answer)[1] AS wanted, l, map_extract(options, l)[1] AS t, row_number() OVER (PARTITION BY id ORDER BY md5('42|' || id || '|' || l)) AS place
  FROM (SELECT *, unnest(['A', 'B', 'C', 'D']) AS l FROM m))
SELECT id, string_agg(coalesce(t, ''), '|' ORDER BY place) AS shuffled, substr('ABCD', max(CASE WHEN t = wanted THEN place END)::INT, 1) AS answer FROM o GROUP BY id
""")
def shuffle_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options in hash order with the answer's new label."""
    q = table(spark, sf_dir, "mcq_question", wide=True).filter(F.size("options") == 4)
    mapped, answer = answers.shuffled_options(F.col("id"), F.col("options"), F.col("correct_answer"))
    joined = F.array_join(F.transform(F.map_values(mapped), lambda x: F.coalesce(x, F.lit(""))), "|")
    return q.select("id", joined.alias("shuffled"), answer.alias("answer")).distinct()


@query("""
WITH c AS (SELECT chunk_id AS id, min(doc_id % 20)::INT AS cluster_id FROM chunk GROUP BY chunk_id),
used AS (SELECT DISTINCT source_chunk_id AS id FROM mcq_question WHERE source_chunk_id IS NOT NULL AND NOT coalesce(discrimination < 0.3, false)),
culled AS (SELECT DISTINCT c.cluster_id FROM mcq_question m JOIN c ON c.id = m.source_chunk_id WHERE m.discrimination < 0.3)
SELECT id, cluster_id, priority FROM (
  SELECT c.id, c.cluster_id, CASE WHEN c.cluster_id IN (SELECT cluster_id FROM culled) THEN 0 ELSE 1 END AS priority FROM c WHERE c.id NOT IN (SELECT id FROM used))
ORDER BY priority, md5('42|' || id), id LIMIT 50
""")
def replacement_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 unused chunks that replace weak questions, chunks of their clusters first."""
    chunks = table(spark, sf_dir, "chunk").groupBy(F.col("chunk_id").alias("id")).agg(F.min((F.col("doc_id") % 20).cast("int")).alias("cluster_id"))
    q = table(spark, sf_dir, "mcq_question", wide=True)
    is_weak = F.coalesce(F.col("discrimination") < 0.3, F.lit(False))
    culled = q.filter(is_weak).select("source_chunk_id").join(chunks, F.col("source_chunk_id") == chunks["id"]).select("cluster_id")
    return exam.replacements(chunks, culled, q.filter(~is_weak), 50)
