"""Vector expressions and the deterministic hashing embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import word_tokens

DIM = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when either is all zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def bucket(term: Column, dim: int = DIM) -> Column:
    """Bucket of a term: the first eight hex digits of its MD5, modulo ``dim``."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def hash_counts(df: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> DataFrame:
    """``id, bucket, n``: term counts by bucket of each text; texts without terms have no row."""
    words = df.select(F.col(id_col).alias("id"), F.explode(word_tokens(F.col(text_col))).alias("term"))
    return words.groupBy("id", bucket(F.col("term"), dim).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> DataFrame:
    """``id, vector``: unit-length bag of hashed terms; texts without terms have no row."""
    rows = hash_counts(df, id_col, text_col, dim).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    places = F.array(*[F.lit(i) for i in range(dim)])
    return rows.select("id", F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.sqrt("sq")).alias("vector"))


def hash_embed_rows(df: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> DataFrame:
    """:func:`hash_embed` of rows whose ids are unique: each is embedded where it is, without a shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, place = re.compile(r"[^\W_]+"), {}
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                b = whole.slice(a, 2048)
                n = np.zeros((b.num_rows, dim))
                for i, t in enumerate(b.column(1).to_pylist()):
                    at = []
                    for w in term.findall(t or ""):
                        if (p := place.get(w)) is None:
                            if len(place) >= 1 << 18:  # memory of a worker stays bounded
                                place.clear()
                            p = place[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim
                        at.append(p)
                    if at:
                        n[i] = np.bincount(at, minlength=dim)
                some = np.flatnonzero(n.any(axis=1))
                v = n[some] / np.sqrt((n[some] * n[some]).sum(axis=1, keepdims=True))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), flat], ["id", "vector"])

    return df.select(F.col(id_col), F.lower(F.col(text_col))).mapInArrow(embed, f"id {kind}, vector array<double>")
