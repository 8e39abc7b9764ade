"""Fitting item parameters and choosing the questions to replace."""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import irt
from corpusmill.runtime import ship_package, written

log = logging.getLogger(__name__)

# Bounds of ability, discrimination, difficulty and guessing, and the start.
BOUNDS = {"theta": (-3.0, 3.0), "a": (0.1, 1.5), "b": (0.01, 1.0), "g": (0.2, 0.4)}
START = {"theta": 0.0, "a": 1.0, "b": 0.01, "g": 0.25}


@dataclass(frozen=True)
class Fit:
    """Abilities and item parameters of a response matrix."""

    abilities: np.ndarray
    discriminations: np.ndarray
    difficulties: np.ndarray
    guessings: np.ndarray
    converged: bool
    loss: float


def _cells(matrix: np.ndarray, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the cells of a matrix that count."""
    x = np.asarray(matrix, dtype=float)
    if x.ndim != 2:
        raise ValueError("a matrix is needed")
    i, j = np.nonzero(np.ones_like(x, bool) if seen is None else np.asarray(seen, bool))
    return i, j, x[i, j]


def loss_and_gradient(p: np.ndarray, n: int, m: int, i: np.ndarray, j: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log likelihood of the cells (row, column, value) of ``n`` rows and ``m`` columns, and its gradient."""
    theta, a, b, g = p[:n][i], p[n : n + m][j], p[n + m : n + 2 * m][j], p[n + 2 * m :][j]
    s = 1 / (1 + np.exp(-a * (theta - b)))
    q = np.clip(g + (1 - g) * s, irt.EPS, 1 - irt.EPS)
    loss = -float((x * np.log(q) + (1 - x) * np.log(1 - q)).sum())
    dq = (q - x) / (q * (1 - q))
    dz = dq * (1 - g) * s * (1 - s)
    return loss, np.concatenate([np.bincount(i, dz * a, n), np.bincount(j, dz * (theta - b), m), np.bincount(j, -dz * a, m), np.bincount(j, dq * (1 - s), m)])


def fit(matrix: np.ndarray, seen: np.ndarray | None = None, most: int = 1000, tolerance: float = 1e-8) -> Fit:
    """Bounded maximum likelihood of a matrix; unseen cells do not count."""
    n, m = np.asarray(matrix).shape
    return fit_cells(n, m, *_cells(matrix, seen), most, tolerance)


def fit_cells(n: int, m: int, i: np.ndarray, j: np.ndarray, x: np.ndarray, most: int = 1000, tolerance: float = 1e-8) -> Fit:
    """Bounded maximum likelihood of cells by projected gradient steps with a spectral step length and backtracking."""
    if n < 2 or m < 1:
        raise ValueError("at least two systems and one item are needed")
    sizes = {"theta": n, "a": m, "b": m, "g": m}
    low, high, p = (np.concatenate([np.full(sizes[k], v) for k, v in z]) for z in ([(k, b[0]) for k, b in BOUNDS.items()], [(k, b[1]) for k, b in BOUNDS.items()], list(START.items())))
    p = np.clip(p, low, high)
    loss, grad = loss_and_gradient(p, n, m, i, j, x)
    step, recent, converged = 1.0 / max(1.0, float(np.abs(grad).max())), [loss], False
    for _ in range(most):
        d = np.clip(p - step * grad, low, high) - p
        slope = float(grad @ d)
        if np.abs(d).max() < 1e-10:
            converged = True
            break
        t = 1.0
        while True:
            new = p + t * d
            new_loss, new_grad = loss_and_gradient(new, n, m, i, j, x)
            if new_loss <= max(recent) + 1e-4 * t * slope or t < 1e-12:
                break
            t /= 2
        s, y = new - p, new_grad - grad
        sy = float(s @ y)
        step = float(np.clip(s @ s / sy, 1e-6, 1e3)) if sy > 1e-16 else 1.0
        done = abs(loss - new_loss) <= tolerance * max(1.0, abs(loss), abs(new_loss))
        p, grad, loss = new, new_grad, new_loss
        recent = [*recent[-4:], loss]
        if done:
            converged = True
            break
    return Fit(p[:n], p[n : n + m], p[n + m : n + 2 * m], p[n + 2 * m :], converged, loss)


#: Answers of an exam that one task fits together (24 bytes each); larger exams are fitted by alternating updates.
TASK_CELLS = 5_000_000


def fit_exams(cells: DataFrame, exam_col: str = "exam", task_cells: int = TASK_CELLS, rounds: int = 30) -> tuple[DataFrame, DataFrame]:
    """``abilities(exam, trial, theta)`` and ``items(exam, question_id, a, b, g)`` for every exam of at least two trials.

    ``cells`` is the matrix in long form; cells that are absent do not count (give the dense response matrix to count
    unanswered questions as wrong).  Exams of up to ``task_cells`` answers are fitted jointly, one a task; of larger ones
    the abilities and the items are fitted in turn, each trial and each question by itself, until no round betters
    the likelihood by a millionth or ``rounds`` have run.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        i, trials = pd.factorize(pdf["trial"], sort=True)
        j, questions = pd.factorize(pdf["question_id"], sort=True)
        exam = pdf[exam_col].iloc[0]
        n, m = len(trials), len(questions)
        f = fit_cells(n, m, i, j, pdf["correct"].to_numpy(dtype=float))
        return pd.DataFrame({
            exam_col: [exam] * (n + m),
            "trial": [*trials.tolist(), *[None] * m],
            "question_id": [*[None] * n, *questions.tolist()],
            "theta": [*f.abilities, *[None] * m],
            "a": [*[None] * n, *f.discriminations],
            "b": [*[None] * n, *f.difficulties],
            "g": [*[None] * n, *f.guessings],
        })

    ship_package(cells.sparkSession)
    kind = {c: cells.schema[c].dataType.simpleString() for c in (exam_col, "trial", "question_id")}
    cells = written(cells.select(exam_col, "trial", "question_id", F.col("correct").cast("double").alias("correct")), "cells")
    size = written(cells.groupBy(exam_col).agg(F.countDistinct("trial").alias("_n"), F.count(F.lit(1)).alias("_cells")).filter("_n >= 2"), "exams")
    usual, large = size.filter(F.col("_cells") <= task_cells).select(exam_col), size.filter(F.col("_cells") > task_cells).select(exam_col)
    both = cells.join(usual, exam_col, "left_semi").groupBy(exam_col).applyInPandas(one, f"{exam_col} {kind[exam_col]}, trial {kind['trial']}, question_id {kind['question_id']}, theta double, a double, b double, g double")
    both = written(both, "fits")
    abilities, items = both.filter("question_id IS NULL").select(exam_col, "trial", "theta"), both.filter("question_id IS NOT NULL").select(exam_col, "question_id", "a", "b", "g")
    if not large.isEmpty():
        more = _alternating(cells.join(large, exam_col, "left_semi"), exam_col, rounds)
        abilities, items = abilities.unionByName(more[0]), items.unionByName(more[1])
    return abilities, items


def _bounded(value, names: tuple[str, ...]):
    """Minimum within bounds of a function of a point giving loss and gradient, by projected gradient steps."""
    low, high = (np.array([BOUNDS[k][z] for k in names]) for z in (0, 1))

    def solve(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, low, high)
        loss, grad = value(p)
        step = 1.0 / max(1.0, float(np.abs(grad).max()))
        for _ in range(60):
            d = np.clip(p - step * grad, low, high) - p
            if np.abs(d).max() < 1e-7:
                break
            new_loss, new_grad = value(p + d)
            if new_loss > loss + 1e-4 * float(grad @ d):
                step /= 2
                continue
            s, y = d, new_grad - grad
            p, loss, grad = p + d, new_loss, new_grad
            step = float(np.clip(s @ s / max(float(s @ y), 1e-12), 1e-6, 1e3))
        return p

    return solve


def _alternating(cells: DataFrame, exam_col: str, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The fit of large exams: every trial's ability given the items, then every item given the abilities, in turn.

    A trial or an item is one group; its answers are summed up by the parameters of the other side rounded to
    three digits, so the group of a task stays small however many answers there are.
    """
    kind = {c: cells.schema[c].dataType.simpleString() for c in (exam_col, "trial", "question_id")}
    items = cells.select(exam_col, "question_id").distinct().select("*", *[F.lit(START[k]).alias(k) for k in ("a", "b", "g")])
    abilities = None
    before = None

    def ability(t):
        import pyarrow as pa

        a, b, g, right, all_ = (t.column(c).to_numpy() for c in ("a", "b", "g", "right", "all"))

        def value(p: np.ndarray) -> tuple[float, np.ndarray]:
            s = 1 / (1 + np.exp(-a * (p[0] - b)))
            q = np.clip(g + (1 - g) * s, irt.EPS, 1 - irt.EPS)
            return -float((right * np.log(q) + (all_ - right) * np.log(1 - q)).sum()), np.array([((all_ * q - right) / (q * (1 - q)) * (1 - g) * s * (1 - s) * a).sum()])

        p = _bounded(value, ("theta",))(np.zeros(1))
        return pa.table({"e": t.column("e").slice(0, 1), "trial": t.column("trial").slice(0, 1), "theta": p})

    def item(t):
        import pyarrow as pa

        theta, right, all_ = (t.column(c).to_numpy() for c in ("theta", "right", "all"))

        def value(p: np.ndarray) -> tuple[float, np.ndarray]:
            a, b, g = p
            s = 1 / (1 + np.exp(-a * (theta - b)))
            q = np.clip(g + (1 - g) * s, irt.EPS, 1 - irt.EPS)
            dq = (all_ * q - right) / (q * (1 - q))
            dz = dq * (1 - g) * s * (1 - s)
            return -float((right * np.log(q) + (all_ - right) * np.log(1 - q)).sum()), np.array([(dz * (theta - b)).sum(), (-dz * a).sum(), (dq * (1 - s)).sum()])

        p = _bounded(value, ("a", "b", "g"))(np.array([START[k] for k in ("a", "b", "g")]))
        return pa.table({"e": t.column("e").slice(0, 1), "question_id": t.column("question_id").slice(0, 1), "a": p[:1], "b": p[1:2], "g": p[2:]})

    e = cells.withColumnRenamed(exam_col, "e")
    sums = [F.sum("correct").alias("right"), F.count(F.lit(1)).cast("double").alias("all")]
    for _ in range(rounds):
        known = items.withColumnRenamed(exam_col, "e").select("e", "question_id", *[F.round(k, 3).alias(k) for k in ("a", "b", "g")])
        side = e.join(known, ["e", "question_id"]).groupBy("e", "trial", "a", "b", "g").agg(*sums)
        abilities = written(side.groupBy("e", "trial").applyInArrow(ability, f"e {kind[exam_col]}, trial {kind['trial']}, theta double"), "abilities")
        side = e.join(abilities.withColumn("theta", F.round("theta", 3)), ["e", "trial"]).groupBy("e", "question_id", "theta").agg(*sums)
        items = written(side.groupBy("e", "question_id").applyInArrow(item, f"e {kind[exam_col]}, question_id {kind['question_id']}, a double, b double, g double"), "items").withColumnRenamed("e", exam_col)
        p = irt.icc(F.col("theta"), F.col("a"), F.col("b"), F.col("g"))
        now = e.join(abilities, ["e", "trial"]).join(items.withColumnRenamed(exam_col, "e"), ["e", "question_id"]).agg(F.sum(irt.log_loss(F.col("correct"), p))).first()[0]
        if before is not None and before - now <= 1e-6 * abs(before):
            break
        before = now
    return abilities.withColumnRenamed("e", exam_col), items


def total_loss(cells: DataFrame, abilities: DataFrame, items: DataFrame) -> DataFrame:
    """``nll``: negative log likelihood of the matrix, summed in parallel."""
    p = irt.icc(F.col("theta"), F.col("a"), F.col("b"), F.col("g"))
    return cells.join(abilities, "trial").join(items, "question_id").agg(F.sum(irt.log_loss(F.col("correct"), p)).alias("nll"))


def information_curve(items: DataFrame, thetas: list[float]) -> DataFrame:
    """``theta, information``: mean information of the items at each ability of a short grid."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thetas]))
    rows = items.select(grid.alias("theta"), "a", "b", "g")
    return rows.groupBy("theta").agg(F.avg(irt.information(F.col("theta"), F.col("a"), F.col("b"), F.col("g"))).alias("information"))


def weak(items: DataFrame, threshold: float = 0.3, a: str = "a") -> DataFrame:
    """Items that discriminate less than the threshold."""
    return items.filter(F.col(a) < threshold)


def with_cull_rank(items: DataFrame, by: str | None = None, a: str = "a", key: str = "question_id", ratio: float = 0.1) -> DataFrame:
    """Adds ``culled``: whether an item is among the ``max(1, int(n * ratio))`` least discriminating of its exam, ties by id."""
    group: list[Column] = [F.col(by)] if by else []
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(a, key))
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return items.withColumn("culled", rank <= F.greatest(F.lit(1), F.floor(n * F.lit(ratio))))


def culled(items: DataFrame, a: str = "a", key: str = "question_id", ratio: float = 0.1) -> DataFrame:
    """The ``max(1, int(n * ratio))`` least discriminating items of one exam, ties by id; none of an empty exam. No window over the exam."""
    n = items.count()
    return items.orderBy(a, key).limit(max(1, int(n * ratio)) if n else 0)


def refined(questions: DataFrame, items: DataFrame, replacement: DataFrame | None = None, ratio: float = 0.1) -> DataFrame:
    """The exam with fitted parameters, without its culled questions and with their replacements appended.

    A single question stays as it is; fewer replacements than culled questions are logged.
    """
    fitted = questions.drop("discrimination", "difficulty", "guessing").join(
        items.select(F.col("question_id").alias("id"), F.col("a").alias("discrimination"), F.col("b").alias("difficulty"), F.col("g").alias("guessing")), "id"
    )
    n = fitted.count()
    if n <= 1:
        return fitted
    gone = max(1, int(n * ratio))
    kept = fitted.join(culled(fitted, "discrimination", "id", ratio).select("id"), "id", "left_anti")
    if replacement is None:
        return kept
    if replacement.count() < gone:
        log.warning("fewer replacements than the %d culled questions", gone)
    return kept.unionByName(replacement, allowMissingColumns=True)
