"""The search over trial configurations: evaluate, record, refine and propose, with an offline proposer."""

from __future__ import annotations

import json
import logging
import random
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import pipeline, scoring
from corpusmill.operators.index import Index, Registry, build
from corpusmill.operators.space import Space, fingerprint, violations
from corpusmill.providers import Embedder, Generator, OverlapGenerator
from corpusmill.sources import history

log = logging.getLogger(__name__)
#: Calls of a proposer before the last configuration is kept.
PROPOSALS = 5


@dataclass(frozen=True)
class Trial:
    """A configuration as two flat dictionaries, of what needs an index of its own and of what does not."""

    structural: dict = field(default_factory=dict)
    runtime: dict = field(default_factory=dict)

    def settings(self) -> pipeline.Settings:
        r = self.runtime
        return pipeline.Settings(self.structural["index_type"], r["top_k"], r["reranker"], r["reranker_top_n"], r["query_expansion"])

    def row(self, spark: SparkSession, number: int = 0) -> DataFrame:
        """``trial_number, config`` of one row in the history's schema."""
        line = json.dumps({"trial_number": number, "config": asdict(self)})
        return spark.createDataFrame([(line,)], "value string").select(F.from_json("value", history.SCHEMA).alias("t")).select("t.trial_number", "t.config")

    def key(self, spark: SparkSession) -> str:
        return self.row(spark).select(fingerprint(F.col("config.structural"))).first()[0]

    def outside(self, spark: SparkSession, space: Space) -> list[str]:
        """The paths at which the trial lies outside the space."""
        return violations(self.row(spark), space).first()["violations"]


def yaml_block(text: str) -> str:
    """The YAML of a reply: of the first block fenced as such, else of the first bare fence; without a fence an error."""
    for pattern in (r"```ya?ml[^\n]*\n(.*?)```", r"```[^\n]*\n(.*?)```"):
        if m := re.search(pattern, text, re.DOTALL | re.IGNORECASE):
            return m[1].strip()
    raise ValueError("the reply holds no fenced block")


def read_trial(text: str) -> Trial:
    """The trial in the YAML of a reply."""
    import yaml

    data = yaml.safe_load(yaml_block(text))
    if not isinstance(data, dict) or not isinstance(data.get("structural"), dict) or not isinstance(data.get("runtime"), dict):
        raise ValueError("the reply needs the sections structural and runtime")
    return Trial(data["structural"], data["runtime"])


class Proposer(Protocol):
    """Gives the next trial from the last one, a text about its failures and lines about the trials so far."""

    def propose(self, last: Trial | None, failures: str, lines: list[str], problems: list[str]) -> Trial: ...


class TweakProposer:
    """The offline proposer: the first trial has the first choices and the middle of every span, later ones tweak the numbers of the last at random."""

    def __init__(self, space: Space, seed: int = 42) -> None:
        self.space, self.random = space, random.Random(seed)

    def propose(self, last: Trial | None, failures: str, lines: list[str], problems: list[str]) -> Trial:
        if last is None:
            config = {"structural": {}, "runtime": {}}
            for path, values in self.space.choices.items():
                part, name = path.split(".")
                config[part][name] = values[0]
            for path, s in self.space.spans.items():
                part, name = path.split(".")
                middle = (s.low + s.high) / 2
                config[part][name] = middle if name in ("hybrid_alpha", "temperature") else int(middle)
            return Trial(**config)
        runtime = dict(last.runtime)
        for name in ("top_k", "temperature", "hybrid_alpha"):
            if s := self.space.spans.get(f"runtime.{name}"):
                runtime[name] = self.random.randint(int(s.low), int(s.high)) if name == "top_k" else round(self.random.uniform(s.low, s.high), 3)
        return replace(last, runtime=runtime)


class ReplyProposer:
    """Asks ``reply``, a function from a prompt to a text, and reads the trial from the YAML of its answer."""

    def __init__(self, reply: Callable[[str], str], space: Space) -> None:
        self.reply, self.space = reply, space

    def propose(self, last: Trial | None, failures: str, lines: list[str], problems: list[str]) -> Trial:
        parts = [("Space", self.space.as_json()), ("Trials", "\n".join(lines)), ("Last", json.dumps(asdict(last)) if last else ""), ("Failures", failures), ("Problems of your last reply", "\n".join(problems))]
        return read_trial(self.reply("\n\n".join(f"{a}:\n{b}" for a, b in parts if b) + "\n\nReply with the next trial as fenced YAML."))


def next_trial(spark: SparkSession, proposer: Proposer, space: Space, last: Trial | None, failures: str = "", lines: list[str] | None = None, calls: int = PROPOSALS) -> Trial:
    """The proposer's first valid trial; its errors are told to it; after ``calls`` the last trial again, or an error when there is none."""
    problems: list[str] = []
    for _ in range(calls):
        try:
            trial = proposer.propose(last, failures, lines or [], problems)
            if not (problems := [f"outside the space: {p}" for p in trial.outside(spark, space)]):
                return trial
        except Exception as e:  # a proposer is free text in the end
            problems = [f"{type(e).__name__}: {e}"]
        log.warning("proposal refused: %s", problems)
    if last is None:
        raise RuntimeError(f"no valid proposal: {problems}")
    return last


def run_trial(docs: DataFrame, exam: DataFrame, trial: Trial, registry: Registry | None = None, generator: Generator | None = None, embedder: Embedder | None = None) -> DataFrame:
    """The results of an exam with one trial's index and settings; the index is loaded when its fingerprint is registered."""
    s = trial.structural
    make = lambda: build(docs, s["chunking_strategy"], s["chunk_size"], s["chunk_overlap"], embedder)
    index: Index = registry.get_or_build(trial.key(docs.sparkSession), make, asdict(trial)) if registry else make()
    expansion = {"generated": "hint"} if trial.runtime["query_expansion"] != "none" else {}
    asked = exam.withColumn("hint", F.coalesce(F.array_join(F.array_sort(F.map_values("options")), "\n"), F.lit(""))) if expansion else exam
    return pipeline.evaluate(exam, pipeline.retrieve(index, asked, trial.settings(), embedder, **expansion), generator or OverlapGenerator())


def optimize(docs: DataFrame, exam: DataFrame, space: Space, folder: str, trials: int, proposer: Proposer | None = None, generator: Generator | None = None, embedder: Embedder | None = None) -> dict:
    """Runs ``trials`` trials, appends each to the history below ``folder``, and returns the best as ``number, score, trial``.

    An index that cannot be built ends its trial without a score and the proposer goes on; the history has one file a trial.
    """
    spark = docs.sparkSession
    proposer, registry, path = proposer or TweakProposer(space), Registry(spark, f"{folder}/indices"), f"{folder}/history"
    last, failures, lines, best = None, "", [], None
    for number in range(1, trials + 1):
        last = next_trial(spark, proposer, space, last, failures, lines)
        trace, score, results = "", None, None
        try:
            results = run_trial(docs, exam, last, registry, generator, embedder).persist()
            score = scoring.exam_score(results).first()["score"]
            failures = pipeline.failure_text(results, exam).first()["text"]
        except Exception as e:
            trace = failures = f"{type(e).__name__}: {e}"
            log.warning("trial %d failed: %s", number, trace)
        row = last.row(spark, number).withColumn("score", F.lit(score).cast("double")).withColumn("error_trace", F.lit(trace)).withColumn("timestamp", F.lit(datetime.now(UTC).isoformat()).cast("timestamp"))
        if results is not None and score is not None:
            # an exam has tens of questions
            row = row.crossJoin(results.agg(F.collect_list(F.struct(*results.columns)).alias("question_results")))
        history.append(row, path)
        lines.append(row.select(scoring.summary_line()).first()[0])
        if score is not None and (best is None or score > best["score"]):
            best = {"number": number, "score": score, "trial": last}
        if results is not None:
            results.unpersist()
    return best or {}


def save_best(best: dict, path: str | Path) -> None:
    """The best trial as YAML; nothing without one."""
    import yaml

    if best:
        Path(path).write_text(yaml.safe_dump(asdict(best["trial"]), sort_keys=True), encoding="utf-8")


def save_exam(exam: DataFrame, path: str | Path) -> None:
    """An exam, tens of questions, as one JSON array, replacing the file."""
    rows = [json.loads(r[0]) for r in exam.orderBy("id").select(F.to_json(F.struct(*exam.columns))).collect()]
    Path(path).write_text(json.dumps(rows, indent=2, ensure_ascii=False), encoding="utf-8")


def save_result(results: DataFrame, path: str | Path) -> None:
    """The result of an exam as one JSON object with its score and the answers of its questions, tens of them."""
    s = scoring.exam_score(results).first()
    rows = [json.loads(r[0]) for r in results.orderBy("question_id").select(F.to_json(F.struct(*results.columns))).collect()]
    Path(path).write_text(json.dumps({"score": s["score"], "n_correct": s["n_correct"], "n_total": s["n_total"], "question_results": rows}, indent=2, ensure_ascii=False), encoding="utf-8")


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The answers of a saved exam result."""
    rows = spark.read.schema(f"score double, question_results array<{history.RESULT}>").option("multiLine", True).json(path)
    return rows.select(F.explode("question_results").alias("r")).select("r.*")
