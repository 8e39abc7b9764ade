"""Queries over documents: scans, chunks, parsers, JSON, self-containment, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import answers, text
from corpusmill.functions.vectors import hash_counts
from corpusmill.operators import chunking
from corpusmill.plans.catalog import query
from corpusmill.runtime import table
from corpusmill.sources import corpus as src
from corpusmill.sources import parsers

# DuckDB forms of Unicode white space trimming and of terms
STRIP = r"regexp_replace(regexp_replace({}, '^[\s\p{{Z}}\x{{0085}}\x0b]+', ''), '[\s\p{{Z}}\x{{0085}}\x0b]+$', '')"
TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_FILES = ["a/one.pdf", "a/two.PDF", "b/three.docx", "b/notes.md", "b/data.json", "c/page.html", "c/scan.tiff", "c/sheet.ods", "d/readme.txt", "d/noext"]
_FILES_SQL = ", ".join(f"('{f}')" for f in _FILES)


@query(f"""
SELECT source, lang, count(*)::BIGINT AS docs, sum(length(t))::BIGINT AS chars
FROM (SELECT source, lang, {STRIP.format("text")} AS t FROM documents WHERE text IS NOT NULL) WHERE t <> '' GROUP BY source, lang
""")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with visible text, by source and language."""
    docs = table(spark, sf_dir, "documents", wide=True).select("source", "lang", text.stripped(F.col("text")).alias("t")).filter("t <> ''")
    return docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("t")).alias("chars"))


@query(f"""
SELECT DISTINCT lower(regexp_extract(f, '(\\.[^./]+)$', 1)) AS extension FROM (VALUES {_FILES_SQL}) t(f)
WHERE lower(regexp_extract(f, '(\\.[^./]+)$', 1)) NOT IN ('', '.md', '.txt', '.json')
""")
def corpus_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions of a listing that need a parser."""
    return src.extensions(spark.createDataFrame([(f,) for f in _FILES], "path string"))


@query(f"""
WITH e AS (SELECT DISTINCT lower(regexp_extract(f, '(\\.[^./]+)$', 1)) AS e FROM (VALUES {_FILES_SQL}) t(f)),
can AS (SELECT unnest(['pymupdf4llm', 'docling']) AS parser, unnest([{src.PARSER_EXTENSIONS["pymupdf4llm"] and list(src.PARSER_EXTENSIONS["pymupdf4llm"])}, {list(src.PARSER_EXTENSIONS["docling"])}]) AS reads)
SELECT parser, coalesce(string_agg(e, ',' ORDER BY e) FILTER (WHERE e NOT IN ('', '.md', '.txt', '.json') AND NOT list_contains(reads, e)), '') AS missing FROM can CROSS JOIN e GROUP BY parser
""")
def parser_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions of the listing that each parser cannot read."""
    return src.unsupported(spark.createDataFrame([(f,) for f in _FILES], "path string"), ["pymupdf4llm", "docling"])


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive chunks of all documents."""
    return chunking.chunk_documents(table(spark, sf_dir, "documents", wide=True))


@query("""
WITH p AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10) || chr(10)), lambda x: x <> ''), lambda x: [x]) AS p FROM documents WHERE text IS NOT NULL AND """ + STRIP.format("text") + """ <> ''),
f AS (SELECT doc_id, list_reduce(p, lambda acc, x: CASE WHEN length(acc[-1]) + 2 + length(x[1]) > 1024 THEN list_concat(acc, x) ELSE list_concat(acc[1:-2], [acc[-1] || chr(10) || chr(10) || x[1]]) END) AS c FROM p WHERE len(p) > 0),
c AS (SELECT doc_id, """ + STRIP.format("t") + """ AS text, i FROM (SELECT doc_id, unnest(c) AS t, generate_subscripts(c, 1) AS i FROM f))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, md5(text) AS digest FROM c WHERE text <> ''
""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks at blank lines."""
    rows = chunking.chunk_documents(table(spark, sf_dir, "documents", wide=True), "fixed", 1024, 0)
    return rows.select("doc_id", "pos", F.md5("text").alias("digest"))


@query()
def chunk_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exam's chunks with their ids over all documents."""
    return chunking.chunk_ids(chunking.chunk_documents(table(spark, sf_dir, "documents", wide=True), keep_blank=True), "exam_chunk")


@query(f"""
WITH t AS (SELECT doc_id, {STRIP.format("text")} AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, t, unnest(generate_series(0, greatest(ceil((length(t) - 64) / 448.0), 1)::BIGINT - 1))::INT AS pos FROM t WHERE t <> '')
SELECT 'chunk_' || (row_number() OVER (ORDER BY doc_id, pos) - 1)::VARCHAR AS chunk_id, doc_id, pos, md5(substr(t, pos * 448 + 1, 512)) AS digest FROM w
""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows of all documents, numbered without a single-task window."""
    rows = chunking.chunk_ids(chunking.fixed_windows(table(spark, sf_dir, "documents", wide=True), 512, 64))
    return rows.select("chunk_id", "doc_id", "pos", F.md5("text").alias("digest"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({TERMS.format("text")}) AS term FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::UBIGINT % 64)::INT AS bucket, count(*)::BIGINT AS n FROM w GROUP BY ALL
""")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed term counts of all documents, the entries of their embeddings."""
    return hash_counts(table(spark, sf_dir, "documents", wide=True), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query("SELECT DISTINCT id, NOT (" + " OR ".join(f"regexp_matches(question, '{p}', 'i')" for p in text.NOT_SELF_CONTAINED) + ") AS ok FROM mcq_question")
def self_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that do not lean on a text the reader cannot see."""
    return table(spark, sf_dir, "mcq_question", wide=True).select("id", text.self_contained(F.col("question")).alias("ok")).distinct()


@query("""
SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events
""")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties read back from fenced, commented and comma-broken JSON."""
    p = F.col("props")
    broken = F.regexp_replace(p, r"\}$", ", }")
    made = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), broken, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), broken, F.lit(" Done."))).otherwise(p)
    rows = table(spark, sf_dir, "events").select("event_id", answers.parsed_object(made, "k bigint").alias("o"))
    return rows.select("event_id", "o.k")


@query(r"""
WITH l AS (SELECT doc_id, unnest(list_concat(['# ' || coalesce(title, '')], string_split(regexp_replace(coalesce(text, ''), '[<&]', ' ', 'g'), chr(10)))) AS l, unnest(generate_series(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
c AS (SELECT doc_id, i, trim(regexp_replace(l, '[\s\p{Z}\x{0085}\x0b\x1c-\x1f]+', ' ', 'g'), ' ') AS l FROM l)
SELECT doc_id, md5(string_agg(l, chr(10) ORDER BY i)) AS digest FROM c WHERE l <> '' GROUP BY doc_id
""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts wrapped as pages and read back by the HTML parser."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def read(s):
        return s.map(parsers.html_text)

    page = F.concat(F.lit("<html><body><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"), F.regexp_replace(F.coalesce("text", F.lit("")), "[<&]", " "), F.lit("</p></body></html>"))
    return table(spark, sf_dir, "documents", wide=True).select("doc_id", F.md5(read(page)).alias("digest"))
