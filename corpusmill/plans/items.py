"""Queries over item response models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import irt
from corpusmill.operators import items as op
from corpusmill.plans.catalog import query
from corpusmill.plans.scores import ONCE, _once
from corpusmill.runtime import table

_ITEMS = """items AS (SELECT id AS question_id, min(discrimination) AS a, min(difficulty) AS b, min(guessing) AS g FROM mcq_question
  WHERE discrimination IS NOT NULL AND difficulty IS NOT NULL AND guessing IS NOT NULL GROUP BY id)"""
_P = "least(greatest(g + (1 - g) / (1 + exp(-a * (theta - b))), 1e-10), 1 - 1e-10)"
_GRID = [-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0]
_THETA = ", ".join(f"({t})" for t in _GRID)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "mcq_question").filter("discrimination IS NOT NULL AND difficulty IS NOT NULL AND guessing IS NOT NULL")
    return q.groupBy(F.col("id").alias("question_id")).agg(F.min("discrimination").alias("a"), F.min("difficulty").alias("b"), F.min("guessing").alias("g"))


@query(f"WITH {_ITEMS} SELECT question_id, theta::DOUBLE AS theta, round({_P}, 6) AS p, round(a * a * (({_P} - g) ** 2 / (1 - g) ** 2) * ((1 - {_P}) / {_P}), 6) AS information FROM items CROSS JOIN (VALUES {_THETA}) t(theta)")
def irt_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of a right answer and information of every item over a grid of abilities."""
    rows = _items(spark, sf_dir).select("*", F.explode(F.array(*[F.lit(t) for t in _GRID])).alias("theta"))
    args = [F.col(c) for c in ("theta", "a", "b", "g")]
    return rows.select("question_id", "theta", F.round(irt.icc(*args), 6).alias("p"), F.round(irt.information(*args), 6).alias("information"))


@query(f"WITH {_ITEMS} SELECT theta::DOUBLE AS theta, round(avg(a * a * (({_P} - g) ** 2 / (1 - g) ** 2) * ((1 - {_P}) / {_P})), 6) AS information FROM items CROSS JOIN (VALUES {_THETA}) t(theta) GROUP BY theta")
def irt_agg_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean information of the items over a grid of abilities."""
    return op.information_curve(_items(spark, sf_dir), _GRID).select("theta", F.round("information", 6).alias("information"))


@query(f"""
WITH {ONCE}, {_ITEMS}, th AS (SELECT trial_number AS trial, round(4.0 * count_if(coalesce(correct, false)) / count(*) - 2, 6) AS theta FROM once GROUP BY trial_number),
c AS (SELECT trial_number AS trial, question_id, arg_max(coalesce(correct, false)::INT, result_id) AS correct FROM once GROUP BY ALL)
SELECT round(sum(-(correct * ln({_P}) + (1 - correct) * ln(1 - {_P}))), 3) AS nll FROM c JOIN th USING (trial) JOIN items USING (question_id)
""")
def irt_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative log likelihood of the observed answers with the pool's item parameters and abilities read off the scores."""
    once = _once(spark, sf_dir)
    theta = once.groupBy(F.col("trial_number").alias("trial")).agg(F.round(4.0 * F.count_if(F.coalesce("correct", F.lit(False))) / F.count(F.lit(1)) - 2, 6).alias("theta"))
    cells = once.groupBy(F.col("trial_number").alias("trial"), "question_id").agg(F.max_by(F.coalesce("correct", F.lit(False)).cast("int"), "result_id").alias("correct"))
    return op.total_loss(cells, theta, _items(spark, sf_dir)).select(F.round("nll", 3).alias("nll"))


@query()
def irt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item parameters fitted to the observed cells, the pool's questions of each cluster label as an exam."""
    once = _once(spark, sf_dir)
    q = table(spark, sf_dir, "mcq_question").filter("cluster_id IS NOT NULL").groupBy(F.col("id").alias("question_id")).agg(F.min("cluster_id").alias("exam"))
    cells = once.groupBy(F.col("trial_number").alias("trial"), "question_id").agg(F.max_by(F.coalesce("correct", F.lit(False)).cast("int"), "result_id").alias("correct"))
    return op.fit_exams(cells.join(q, "question_id"))[1].select("exam", "question_id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round("g", 4).alias("g"))


@query(f"WITH {_ITEMS} SELECT question_id, a FROM items WHERE a < 0.5")
def weak_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that discriminate less than 0.5."""
    return op.weak(_items(spark, sf_dir), 0.5).select("question_id", "a")


_EXAM = "e AS (SELECT items.*, exam FROM items JOIN (SELECT id, min(cluster_id) AS exam FROM mcq_question WHERE cluster_id IS NOT NULL GROUP BY id) x ON x.id = items.question_id)"


@query(f"""
WITH {_ITEMS}, {_EXAM}, r AS (SELECT *, row_number() OVER (PARTITION BY exam ORDER BY a, question_id) AS r, count(*) OVER (PARTITION BY exam) AS n FROM e)
SELECT question_id, exam, r <= greatest(1, floor(n * 0.1::DOUBLE)) AS culled FROM r
""")
def cull_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth of each exam that discriminates least, and the rest."""
    q = table(spark, sf_dir, "mcq_question").filter("cluster_id IS NOT NULL").groupBy(F.col("id").alias("question_id")).agg(F.min("cluster_id").alias("exam"))
    return op.with_cull_rank(_items(spark, sf_dir).join(q, "question_id"), "exam").select("question_id", "exam", "culled")


@query(f"""
WITH {ONCE}, {_ITEMS}, th AS (SELECT trial_number, round(4.0 * count_if(coalesce(correct, false)) / count(*) - 2, 6) AS theta FROM once GROUP BY trial_number)
SELECT count(*)::BIGINT AS items, count_if(a < 0.3)::BIGINT AS weak, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, (SELECT count(DISTINCT trial_number) FROM th)::BIGINT AS trials,
  (SELECT min(theta) FROM th) AS least_ability, (SELECT max(theta) FROM th) AS most_ability FROM items
""")
def irt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and means of the pool's item parameters, and the range of abilities read off the scores."""
    theta = _once(spark, sf_dir).groupBy("trial_number").agg(F.round(4.0 * F.count_if(F.coalesce("correct", F.lit(False))) / F.count(F.lit(1)) - 2, 6).alias("theta"))
    trials = theta.agg(F.countDistinct("trial_number").alias("trials"), F.min("theta").alias("least_ability"), F.max("theta").alias("most_ability"))
    rows = _items(spark, sf_dir).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("a") < 0.3).alias("weak"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"))
    return rows.crossJoin(F.broadcast(trials))  # one row each
