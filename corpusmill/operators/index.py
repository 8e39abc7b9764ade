"""Indices as Parquet tables: build, save, load, and reuse by fingerprint."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import chunking, retrieval
from corpusmill.providers import Embedder, HashEmbedder

PARTS = ("chunks", "vectors", "postings", "stats")


@dataclass(frozen=True)
class Index:
    """The tables of an index."""

    chunks: DataFrame
    vectors: DataFrame
    postings: DataFrame
    stats: DataFrame

    def search_text(self, queries: DataFrame, k: int, query_id: str = "item_id", text_col: str = "text") -> DataFrame:
        """BM25 of many queries at once: the chunks are streamed."""
        return retrieval.bm25(self.chunks, queries, k, "chunk_id", query_id, text_col)

    def look_up_text(self, queries: DataFrame, k: int, query_id: str = "item_id", text_col: str = "text") -> DataFrame:
        """BM25 of few queries: only the postings of their terms are read."""
        return retrieval.bm25(self.chunks, queries, k, "chunk_id", query_id, text_col, (self.postings, self.stats))

    def search_vectors(self, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        return retrieval.vector_search(self.vectors, queries, k, metric)

    def save(self, path: str, index_type: str = "vector_only") -> None:
        """Replace the index at ``path``, its type and number of chunks beside its tables."""
        for name in PARTS:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.chunks.sparkSession
        about = spark.read.parquet(f"{path}/chunks").agg(F.lit(index_type).alias("index_type"), F.count(F.lit(1)).alias("n_chunks"))
        about.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> Index:
    """Read an index; a missing folder is an error, a missing table too."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in PARTS])


def metadata(spark: SparkSession, path: str) -> dict:
    """Type and number of chunks of a saved index."""
    return spark.read.schema("index_type string, n_chunks long").json(f"{path}/metadata").first().asDict()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def build(docs: DataFrame, strategy: str = "recursive", size: int = 512, overlap: int = 64, embedder: Embedder | None = None) -> Index:
    """Chunk, number, embed and index documents; no chunk at all is an error."""
    chunks = chunking.chunk_ids(chunking.chunk_documents(docs, strategy, size, overlap))
    if chunks.isEmpty():
        raise ValueError("the documents give no chunk")
    terms, stats = retrieval.postings(chunks, "chunk_id", "text")
    return Index(chunks, (embedder or HashEmbedder()).embed(chunks, "chunk_id", "text"), terms, stats)


class Registry:
    """Indices by fingerprint below one folder of any file system Spark can write."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def has(self, key: str) -> bool:
        """Whether a finished index of that fingerprint is there."""
        return exists(self.spark, self.path(key) + "/manifest") and exists(self.spark, self.path(key) + "/chunks")

    def get(self, key: str) -> Index:
        if not self.has(key):
            raise KeyError(key)
        return load(self.spark, self.path(key))

    def register(self, key: str, index: Index, config: dict) -> None:
        """Write the index, then its manifest, so that a half-written index is never found."""
        index.save(self.path(key))
        line = json.dumps({"config": config, "created_at": datetime.now(UTC).isoformat()}, sort_keys=True)
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(self.path(key) + "/manifest")

    def manifest(self, key: str) -> dict:
        return json.loads(self.spark.read.text(self.path(key) + "/manifest").first()[0])

    def get_or_build(self, key: str, make, config: dict) -> Index:
        """Load the index of a fingerprint or build and register it."""
        if not self.has(key):
            self.register(key, make(), config)
        return self.get(key)


def with_ids(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the text and document of their chunk."""
    return found.join(chunks.select(F.col("chunk_id").alias("id"), "doc_id", "text"), "id")
