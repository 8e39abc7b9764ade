"""Search spaces and trial configurations: validation over all trials at once, and fingerprints."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Span:
    """An inclusive numeric range."""

    low: float
    high: float

    def __post_init__(self) -> None:
        if self.high < self.low:
            raise ValueError("the upper end lies below the lower end")

    def contains(self, value: Column) -> Column:
        return value.between(self.low, self.high)


@dataclass(frozen=True)
class Space:
    """What trials may propose: categorical choices and numeric spans by config path."""

    choices: dict[str, list[str]] = field(default_factory=dict)
    spans: dict[str, Span] = field(default_factory=dict)

    @staticmethod
    def load(path: str | Path) -> Space:
        """Read a space from YAML with the sections ``choices`` and ``spans``."""
        import yaml

        p = Path(path)
        if not p.is_file():
            raise FileNotFoundError(p)
        data = yaml.safe_load(p.read_text(encoding="utf-8"))
        if not data:
            raise ValueError(f"{p} is empty")
        unknown = sorted(set(data) - {"choices", "spans"}) if isinstance(data, dict) else ["a mapping is needed"]
        if unknown:
            raise ValueError(f"{p}: {unknown}")
        return Space({k: list(v) for k, v in data.get("choices", {}).items()}, {k: Span(*map(float, v)) for k, v in data.get("spans", {}).items()})


    def as_json(self) -> str:
        """The space as indented JSON, as a proposer is told of it."""
        import json

        return json.dumps({"choices": self.choices, "spans": {k: [s.low, s.high] for k, s in self.spans.items()}}, indent=2)


def violations(trials: DataFrame, space: Space, config: str = "config") -> DataFrame:
    """Adds ``violations``: the config paths of each trial outside the space, in order of name; empty means valid.

    A null value is a violation.
    """
    checks = [(k, F.col(f"{config}.{k}").isin(*v)) for k, v in space.choices.items()] + [(k, s.contains(F.col(f"{config}.{k}"))) for k, s in space.spans.items()]
    named = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in sorted(checks, key=lambda x: x[0])]
    return trials.withColumn("violations", F.filter(F.array(*named), lambda x: x.isNotNull()))


def fingerprint(structural: Column, graph: Column | None = None) -> Column:
    """First twelve hex digits of the SHA-256 of the structural fields as JSON with sorted keys.

    ``graph``, a struct of ``graph_backend`` and ``entity_types``, adds both, the types in sorted order; where it is null the
    fingerprint is that without it.  Settings that do not change the index, such as a depth of traversal, are not part of it.
    """
    def text(name: str) -> Column:
        return F.concat(F.lit(f'"{name}": "'), F.coalesce(structural.getField(name), F.lit("")), F.lit('"'))

    def number(name: str) -> Column:
        return F.concat(F.lit(f'"{name}": '), F.coalesce(structural.getField(name).cast("string"), F.lit("null")))

    first = [number("chunk_overlap"), number("chunk_size"), text("chunking_strategy"), text("embedding_model")]
    last = [text("index_type"), text("parser")]
    body = F.concat_ws(", ", *first, *last)
    if graph is not None:
        kinds = F.array_join(F.transform(F.array_sort(F.coalesce(graph["entity_types"], F.array().cast("array<string>"))), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
        more = [F.concat(F.lit('"entity_types": ['), kinds, F.lit("]")), F.concat(F.lit('"graph_backend": "'), F.coalesce(graph["graph_backend"], F.lit("")), F.lit('"'))]
        body = F.when(graph.isNull(), body).otherwise(F.concat_ws(", ", *first, *more, *last))
    return F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 12)
