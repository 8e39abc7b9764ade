"""The trial history as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = (
    "struct<structural:struct<parser:string,chunking_strategy:string,chunk_size:int,chunk_overlap:int,embedding_model:string,index_type:string>,"
    "runtime:struct<top_k:int,hybrid_alpha:double,reranker:string,reranker_top_n:int,query_expansion:string,llm_model:string,temperature:double>>"
)
RESULT = "struct<question_id:string,correct:boolean,selected_answer:string,correct_answer:string,retrieved_context:string,generated_response:string>"
SCHEMA = f"trial_number int, config {CONFIG}, score double, error_trace string, question_results array<{RESULT}>, timestamp timestamp, reasoning string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Trials of a history; blank lines are ignored and malformed lines, or those without number or config, skipped."""
    rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rows.filter("trial_number IS NOT NULL AND config IS NOT NULL")


def read_with_errors(spark: SparkSession, path: str) -> DataFrame:
    """All lines, with ``_corrupt_record`` for those that cannot be read, to count them."""
    return spark.read.schema(SCHEMA + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def append(trials: DataFrame, path: str) -> None:
    """Append trials to a history."""
    trials.write.mode("append").json(path)


def as_line(trials: DataFrame) -> DataFrame:
    """``line``: each trial as one JSON text, null fields left out."""
    return trials.select(F.to_json(F.struct(*trials.columns)).alias("line"))


def flat_results(trials: DataFrame) -> DataFrame:
    """``trial_number`` and the fields of each of its question results."""
    return trials.select("trial_number", F.explode("question_results").alias("r")).select("trial_number", "r.*")
