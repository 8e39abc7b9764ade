"""Models behind small interfaces, with deterministic offline implementations."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.answers import LABELS
from corpusmill.functions.text import bound, word_tokens
from corpusmill.functions.vectors import DIM, hash_embed
from corpusmill.runtime import ship_package


#: Models of this Python worker by the name of their provider; made once a worker, not once a task.
_MODELS: dict[str, object] = {}


def worker_model(key: str, factory):
    """The model of a provider in this Python worker, made on first use."""
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


class Embedder(Protocol):
    """Embeds the texts of a DataFrame."""

    def embed(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame: ...


class HashEmbedder:
    """Bags of hashed terms at unit length, all as expressions."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim

    def embed(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``id, vector``."""
        return hash_embed(rows, id_col, text_col, self.dim)


class ModelEmbedder:
    """Wraps a factory of a batch encoder; each Python worker makes the encoder of a ``name`` once."""

    def __init__(self, factory, dim: int, name: str | None = None) -> None:
        self.factory, self.dim = factory, dim
        self.name = name or f"{factory.__module__}.{factory.__qualname__}"

    def embed(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``id, vector``; null texts have a null vector."""
        ship_package(rows.sparkSession)
        factory, name = self.factory, self.name

        @F.pandas_udf("array<float>")
        def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = worker_model(name, factory)
            for s in parts:
                some = [t for t in s if t is not None and t == t]
                made = iter(np.asarray(model(some), dtype=np.float32)) if some else iter(())
                out = pd.Series([next(made) if t is not None and t == t else None for t in s], dtype=object)
                yield out

        return rows.select(F.col(id_col).alias("id"), encode.asNondeterministic()(F.col(text_col)).alias("vector"))


def overlap_answer(options: Column, context: Column) -> Column:
    """The offline generator: names the option that shares most words with the context, the first of equal ones."""
    def named(words: Column) -> Column:
        scored = F.transform(
            F.array(*[F.lit(x) for x in LABELS]),
            lambda k: F.struct((-F.size(F.array_intersect(words, F.coalesce(word_tokens(F.try_element_at(options, k)), F.array().cast("array<string>"))))).alias("s"), k.alias("k")),
        )
        return F.array_min(scored)["k"]

    return F.concat(F.lit("The answer is "), bound(F.array_distinct(word_tokens(F.coalesce(context, F.lit("")))), named))


class Generator(Protocol):
    """Adds a ``response`` to rows with ``prompt``, ``options`` and ``context``; null where none could be made."""

    def generate(self, rows: DataFrame) -> DataFrame: ...


class OverlapGenerator:
    """The offline generator of answers, all as expressions; rows without options have no response."""

    def generate(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("response", F.when(F.col("options").isNotNull(), overlap_answer(F.col("options"), F.col("context"))))


class ModelGenerator:
    """Wraps a factory of a function from a prompt to a response; a prompt for which it raises has a null response and the error's text in ``error``."""

    def __init__(self, factory, name: str | None = None) -> None:
        self.factory, self.name = factory, name or f"{factory.__module__}.{factory.__qualname__}"

    def generate(self, rows: DataFrame) -> DataFrame:
        ship_package(rows.sparkSession)
        factory, name = self.factory, self.name

        @F.pandas_udf("response string, error string")
        def ask(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = worker_model(name, factory)
            for s in parts:
                out = []
                for p in s:
                    try:
                        out.append((None if p is None else model(p), None))
                    except Exception as e:  # one question must not fail the job
                        out.append((None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=["response", "error"], dtype=object)

        return rows.withColumn("_said", ask.asNondeterministic()(F.col("prompt"))).withColumn("response", F.col("_said.response")).withColumn("error", F.col("_said.error")).drop("_said")
