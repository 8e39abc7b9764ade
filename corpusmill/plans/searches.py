"""Queries over queries: text and vector retrieval, fusion, expansion, reranking, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import jaccard_ngram
from corpusmill.functions.vectors import cosine, hash_embed
from corpusmill.operators import retrieval as r
from corpusmill.operators import scoring
from corpusmill.plans.catalog import query
from corpusmill.plans.corpus import STRIP, TERMS
from corpusmill.runtime import table

# BM25 of every held-out item over all documents
_BM25 = f"""
w AS (SELECT doc_id AS id, {TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT id, w, len(w) AS dl FROM w WHERE len(w) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
@Q@,
qt AS (SELECT DISTINCT qid, unnest({TERMS.format("qtext")}) AS term FROM q WHERE qtext IS NOT NULL),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT qid, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM qt JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY qid, tf.id),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
"""


def _bm25(queries: str) -> str:
    return _BM25.replace("@Q@", queries)


_ITEMS = "q AS (SELECT item_id AS qid, text AS qtext FROM heldout_item)"


def _docs_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents", wide=True).select("doc_id", "text"), table(spark, sf_dir, "heldout_item").select("item_id", "text")


@query(f"WITH {_bm25(_ITEMS)} SELECT qid AS item_id, id AS doc_id, rank::INT AS rank, score FROM bm WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for every held-out item."""
    docs, items = _docs_items(spark, sf_dir)
    return r.bm25(docs, items, 5).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "rank", "score")


@query("""
WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, vec_id AS id, round(list_distance(v, embedding::DOUBLE[]), 6) AS score FROM q CROSS JOIN embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s)
SELECT qid, id, rank::INT AS rank, score FROM k WHERE rank <= 5
""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every query vector, the query itself included, among all vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.filter("id % 50 = 0").withColumnRenamed("id", "qid")
    return r.vector_search(v, q, 5).select("qid", "id", "rank", "score")


def _embed_sql(name: str, id_expr: str, text_expr: str, source: str) -> str:
    return f"""
{name}_n AS (SELECT id, (('0x' || substr(md5(term), 1, 8))::UBIGINT % 64)::INT AS bucket, count(*) AS n
  FROM (SELECT {id_expr} AS id, unnest({TERMS.format(text_expr)}) AS term FROM {source} WHERE {text_expr} IS NOT NULL) GROUP BY ALL),
{name} AS (SELECT id, list_transform(generate_series(0, 63), lambda b: coalesce(map_extract(m, b::INT)[1], 0) / sqrt(sq)) AS v
  FROM (SELECT id, map_from_entries(list((bucket, n::DOUBLE))) AS m, sum(n * n)::DOUBLE AS sq FROM {name}_n GROUP BY id))"""


@query(f"""
WITH {_bm25(_ITEMS)}, {_embed_sql("dv", "doc_id", "text", "documents")}, {_embed_sql("qv", "item_id", "text", "heldout_item")},
vs AS (SELECT qv.id AS qid, dv.id AS id, round(list_inner_product(qv.v, dv.v) / (sqrt(list_inner_product(qv.v, qv.v)) * sqrt(list_inner_product(dv.v, dv.v))), 6) AS score FROM qv CROSS JOIN dv),
vk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vs),
l AS (SELECT qid, id, 0 AS list, rank FROM bm WHERE rank <= 10 UNION ALL SELECT qid, id, 1, rank FROM vk WHERE rank <= 10),
f AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 9) AS score, min((list * 1000 + rank)) AS first FROM l GROUP BY qid, id),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS rank FROM f)
SELECT qid AS item_id, id AS doc_id, rank::INT AS rank, round(score, 6) AS score FROM k WHERE rank <= 5
""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and vector rankings of the items over the documents, fused by reciprocal ranks."""
    docs, items = _docs_items(spark, sf_dir)
    by_vector = r.vector_search(hash_embed(docs, "doc_id", "text"), hash_embed(items, "item_id", "text").withColumnRenamed("id", "qid"), 10, "cosine")
    fused = r.rrf(r.bm25(docs, items, 10), by_vector).filter("rank <= 5")
    return fused.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query("""
WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
a AS (SELECT qid, vec_id AS id, row_number() OVER (PARTITION BY qid ORDER BY round(list_distance(v, embedding::DOUBLE[]), 6), vec_id) AS rank FROM q CROSS JOIN embeddings),
b AS (SELECT qid, vec_id AS id, row_number() OVER (PARTITION BY qid ORDER BY round(list_distance(v[1:16], embedding[1:16]::DOUBLE[]), 6), vec_id) AS rank FROM q CROSS JOIN embeddings),
l AS (SELECT qid, id, 0 AS list, rank FROM a WHERE rank <= 10 UNION ALL SELECT qid, id, 1, rank FROM b WHERE rank <= 10),
f AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS first FROM l GROUP BY qid, id)
SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, first))::INT AS rank, round(score, 6) AS score FROM f
""")
def rrf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vector rankings, over all and over 16 dimensions, fused by reciprocal ranks."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    short = v.select("id", F.slice("vector", 1, 16).alias("vector"))
    a = r.vector_search(v, v.filter("id % 50 = 0").withColumnRenamed("id", "qid"), 10)
    b = r.vector_search(short, short.filter("id % 50 = 0").withColumnRenamed("id", "qid"), 10)
    return r.rrf(a, b).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(rf"""
WITH g AS (SELECT item_id, text, list_slice(list_filter(list_transform(string_split(coalesce(replace(text, '. ', chr(10)), ''), chr(10)), lambda x: {STRIP.format("x")}), lambda x: x <> ''), 1, 3) AS more FROM heldout_item)
SELECT item_id, 0 AS variant, text FROM g UNION ALL SELECT item_id, i::INT AS variant, more[i] AS text FROM (SELECT item_id, more, unnest(generate_series(1, len(more))) AS i FROM g)
""")
def expand_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items with up to three generated variants, here their sentences."""
    items = table(spark, sf_dir, "heldout_item").withColumn("lines", F.replace(F.col("text"), F.lit(". "), F.lit("\n")))
    return r.expanded(items, "multi_query", generated="lines").withColumnRenamed("qid", "item_id")


_VARIANTS = """q AS (SELECT item_id * 2 AS qid, text AS qtext FROM heldout_item UNION ALL
  SELECT item_id * 2 + 1, substr(text, 1, (length(text) // 2)::INT) FROM heldout_item)"""


@query(f"""
WITH {_bm25(_VARIANTS)},
h AS (SELECT qid // 2 AS item_id, qid % 2 AS variant, id, rank, score FROM bm WHERE rank <= 5),
f AS (SELECT *, row_number() OVER (PARTITION BY item_id, id ORDER BY variant, rank) AS n FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY variant, rank) AS place FROM f WHERE n = 1)
SELECT item_id, id AS doc_id, place::INT AS rank, score FROM k WHERE place <= 8
""")
def retrieve_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of two variants of each item, in order, each document once."""
    docs, items = _docs_items(spark, sf_dir)
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    q = r.expanded(items.withColumn("half", half), "hyde", generated="half").select((F.col("qid") * 2 + F.col("variant")).alias("qv"), "text")
    hits = r.bm25(docs, q, 5, query_id="qv")
    hits = hits.select(F.floor(F.col("qid") / 2).alias("qid"), (F.col("qid") % 2).alias("variant"), "id", "rank", "score")
    return r.deduplicated(hits).filter("rank <= 8").select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "rank", "score")


@query(f"""
WITH {_bm25(_ITEMS)},
h AS (SELECT bm.qid, bm.id, bm.rank AS prior, list_distinct({TERMS.format("q.qtext")}) AS a, list_distinct(d.w) AS b FROM bm JOIN q USING (qid) JOIN d ON d.id = bm.id WHERE bm.rank <= 15),
rs AS (SELECT qid, id, prior, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS score FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, prior) AS rank FROM rs)
SELECT qid AS item_id, id AS doc_id, rank::INT AS rank, score FROM k WHERE rank <= 3
""")
def rerank_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three times five hits per item, reranked and cut to three."""
    docs, items = _docs_items(spark, sf_dir)
    return r.reranked(r.bm25(docs, items, 15), items, docs, 3).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "rank", "score")


@query("SELECT item_id, item_id AS doc_id, 0::INT AS rank, 0::DOUBLE AS score FROM heldout_item WHERE false")
def graph_search_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in an absent graph store."""
    docs, items = _docs_items(spark, sf_dir)
    return r.graph_search(docs, items).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "rank", "score")


@query("""
WITH q AS (SELECT vec_id AS a, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0)
SELECT a, vec_id AS b, round(list_cosine_similarity(v, embedding::DOUBLE[]), 5) AS cos FROM q JOIN embeddings ON vec_id <> a AND list_cosine_similarity(v, embedding::DOUBLE[]) > 0.3
""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of cosine above 0.3 to a query vector, as a broadcast of the small query set."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("v"))
    from corpusmill.runtime import maybe_broadcast

    q = maybe_broadcast(q, q.count(), 400)
    c = cosine(F.col("v"), F.col("embedding"))
    return q.join(v, (F.col("vec_id") != F.col("a")) & (c > 0.3)).select("a", F.col("vec_id").alias("b"), F.round(c, 5).alias("cos"))


_GRAMS = "list_distinct(list_transform(generate_series(1, len({0}) - 2), lambda i: array_to_string({0}[i:i+2], ' ')))"
_TOK = r"list_filter(string_split_regex(lower({}), '[\s\p{{Z}}\x{{0085}}\x0b]+'), lambda t: t <> '')"


@query(f"""
WITH p AS (SELECT DISTINCT m.id, {_TOK.format("m.question")} AS a, {_TOK.format("c.text")} AS b
  FROM mcq_question m JOIN (SELECT chunk_id, min(text) AS text FROM chunk GROUP BY chunk_id) c ON c.chunk_id = m.source_chunk_id WHERE m.question IS NOT NULL AND c.text IS NOT NULL),
g AS (SELECT id, a, b, CASE WHEN len(a) < 3 OR len(b) < 3 THEN list_distinct(a) ELSE {_GRAMS.format("a")} END AS x,
  CASE WHEN len(a) < 3 OR len(b) < 3 THEN list_distinct(b) ELSE {_GRAMS.format("b")} END AS y FROM p)
SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS jaccard FROM g
""")
def jaccard_question_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram similarity of each question and its chunk."""
    chunk = table(spark, sf_dir, "chunk").groupBy("chunk_id").agg(F.min("text").alias("text"))
    q = table(spark, sf_dir, "mcq_question", wide=True).filter("question IS NOT NULL")
    pairs = q.join(chunk, q["source_chunk_id"] == chunk["chunk_id"]).filter("text IS NOT NULL").select("id", "question", "text").distinct()
    return pairs.select("id", F.round(jaccard_ngram(F.col("question"), F.col("text"), 3), 6).alias("jaccard"))


@query(f"""
WITH {_bm25(_ITEMS)}
SELECT qid AS item_id, md5(string_agg(t.text, chr(10) ORDER BY rank)) AS digest FROM bm JOIN documents t ON t.doc_id = bm.id WHERE rank <= 3 GROUP BY qid
""")
def context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the texts of each item's three best documents, joined in order."""
    docs, items = _docs_items(spark, sf_dir)
    rows = scoring.joined_context(r.bm25(docs, items, 3), docs)
    return rows.select(F.col("qid").alias("item_id"), F.md5("context").alias("digest"))
