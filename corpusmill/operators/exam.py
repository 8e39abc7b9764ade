"""Stratified exams: cluster counts, slot allocation, sampling, option quality and greedy de-duplication."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import bound, split_tokens, token_jaccard
from corpusmill.functions.vectors import cosine
from corpusmill.runtime import ship_package, written

# Margins and limits of distractor quality.
EXTRA_JACCARD, EXTRA_COSINE, INTRA_JACCARD, INTRA_COSINE = 0.05, 0.05, 0.70, 0.85

#: Rounds of the greedy walk after which what is left of a group is walked in one task, if it has at most so many edges.
WALK_AFTER, WALK_EDGES = 8, 1_000_000


def n_clusters(n_chunks: int, exam_size: int, explicit: int | None = None) -> int:
    """The explicit number, else the root of the number of chunks, between 1 and the exam size."""
    return explicit if explicit is not None else max(1, min(int(n_chunks**0.5), exam_size))


def n_clusters_column(n_chunks: Column, exam_size: int) -> Column:
    """Column form of :func:`n_clusters` without an explicit number."""
    return F.greatest(F.lit(1), F.least(F.floor(F.sqrt(n_chunks)).cast("long"), F.lit(exam_size)))


def kmeans_labels(rows: DataFrame, k: int, restarts: int = 10, seed: int = 42, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """``id, label``: k-means labels of the restart with the least cost. Rows with a null vector have none."""
    data = rows.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("features")).persist()
    best = None
    try:
        for r in range(restarts):
            model = KMeans(k=k, seed=seed + r, maxIter=30).fit(data)
            cost = model.summary.trainingCost
            if best is None or cost < best[0]:
                best = (cost, model)
        return best[1].transform(data).select("id", F.col("prediction").alias("label"))
    finally:
        data.unpersist()


def cluster_sizes(labels: DataFrame, k: int, label_col: str = "label") -> DataFrame:
    """``cluster_id, size`` for every cluster number below ``k``, 0 where a cluster is empty; null and other labels are left out."""
    counts = labels.groupBy(F.col(label_col).cast("int").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"))
    return labels.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id")).join(counts, "cluster_id", "left").na.fill(0, ["size"])


def allocate(sizes: DataFrame, n: int) -> DataFrame:
    """``cluster_id, size, slots``: ``n`` slots in proportion to the root of the sizes, largest remainders first.

    Slots never exceed a cluster's size; a single pass over the remainders fills what capping left, so fewer
    than ``n`` slots can result.  Ties go to the smaller cluster id.  The window runs over one row a cluster.
    """
    w = F.sqrt(F.col("size").cast("double"))
    total = Window.partitionBy()
    q = sizes.select("cluster_id", "size", F.when(F.sum(w).over(total) == 0, F.lit(0.0)).otherwise(n * w / F.sum(w).over(total)).alias("quota"))
    q = q.withColumn("base", F.least(F.floor("quota"), F.col("size"))).withColumn("rest", F.round(F.col("quota") - F.floor("quota"), 9))
    q = q.withColumn("missing", F.when(F.sum("quota").over(total) == 0, F.lit(0)).otherwise(n - F.sum("base").over(total))).withColumn("room", F.col("base") < F.col("size"))
    turn = F.row_number().over(Window.partitionBy("room").orderBy(F.col("rest").desc(), "cluster_id"))
    extra = (F.col("room") & (turn <= F.col("missing"))).cast("long")
    return q.withColumn("extra", extra).select("cluster_id", "size", (F.col("base") + F.col("extra")).cast("long").alias("slots"))


def stratified(rows: DataFrame, slots: DataFrame, id_col: str = "id", cluster_col: str = "cluster_id", seed: int = 42) -> DataFrame:
    """The rows taken for the exam with their ``turn``: in each cluster the first ``slots`` in an order fixed by a seeded hash."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(cluster_col).cast("string"), F.col(id_col).cast("string")))
    w = Window.partitionBy(cluster_col).orderBy(key, id_col)
    taken = slots.filter("slots > 0").select(F.col("cluster_id").alias(cluster_col), "slots")
    return rows.join(taken, cluster_col).withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= F.col("slots")).drop("slots")


def accepted(candidates: DataFrame, slots: DataFrame, ok_col: str = "ok", cluster_col: str = "cluster_id") -> DataFrame:
    """Walks each cluster's candidates in order of ``turn`` and keeps the first ``slots`` accepted ones."""
    w = Window.partitionBy(cluster_col).orderBy("turn")
    taken = slots.select(F.col("cluster_id").alias(cluster_col), "slots")
    return candidates.filter(F.col(ok_col)).join(taken, cluster_col).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= F.col("slots")).drop("_n", "slots")


def close_edges(rows: DataFrame, threshold: float, group_col: str, pos_col: str = "pos", vec_col: str = "vector", block: int = 2048) -> DataFrame:
    """``grp, a, b``: pairs of positions a < b of one group whose cosine exceeds ``threshold``.

    Each group is compared in blocks, a block pair per task, so a large group is spread over many tasks.
    """
    ship_package(rows.sparkSession)
    base = rows.filter(F.col(vec_col).isNotNull()).select(F.col(group_col).alias("grp"), F.col(pos_col).cast("long").alias("pos"), F.col(vec_col).cast("array<double>").alias("v"))
    counts = base.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    spread = base.join(counts, "grp").withColumn("mine", F.pmod(F.xxhash64("pos"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("grp", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "mine", "pos", "v")

    def compare(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
        pos, mine = t.column("pos").to_numpy(), t.column("mine").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        r, c = np.nonzero(np.round(x[left] @ x[right].T, 9) > threshold)
        a, b = pos[left[r]], pos[right[c]]
        keep = a < b if i == j else a != b
        a, b = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
        return pa.table({"grp": pa.array([t.column("grp")[0].as_py()] * len(a), t.schema.field("grp").type), "a": a, "b": b})

    return spread.groupBy("grp", "i", "j").applyInArrow(compare, f"grp {rows.schema[group_col].dataType.simpleString()}, a long, b long")


def greedy_kept(rows: DataFrame, edges: DataFrame, group_col: str, pos_col: str = "pos") -> DataFrame:
    """``grp, pos``: the rows a walk in order of position keeps, when a kept row drops its later neighbours.

    Rounds decide, in parallel, every row whose earlier neighbours are all decided: it is dropped if one of them is kept.
    They go on until no row is undecided; each decides at least the first undecided row of a group.  After
    ``WALK_AFTER`` rounds, as long chains need, a group with at most ``WALK_EDGES`` undecided edges is walked in one task.
    """
    state = written(rows.select(F.col(group_col).alias("grp"), F.col(pos_col).cast("long").alias("pos"), F.lit(None).cast("boolean").alias("kept")).distinct(), "greedy")
    edges = written(edges, "edges")

    def walk(t: pa.Table) -> pa.Table:
        t = t.sort_by([("b", "ascending"), ("a", "ascending")])
        kept: dict[int, bool] = {}
        for a, b, a_kept in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), t.column("a_kept").to_pylist()):
            if a is not None:
                hit = a_kept if a_kept is not None else kept[a]
                kept[b] = kept.get(b, True) and not hit
            else:
                kept.setdefault(b, True)
        return pa.table({"grp": pa.array([t.column("grp")[0].as_py()] * len(kept), t.schema.field("grp").type), "pos": pa.array(list(kept), pa.int64()), "walked": pa.array(list(kept.values()), pa.bool_())})

    for turn in itertools.count(1):
        earlier = edges.join(state.select("grp", F.col("pos").alias("a"), "kept"), ["grp", "a"]).groupBy("grp", F.col("b").alias("pos")).agg(
            F.coalesce(F.bool_or("kept"), F.lit(False)).alias("hit"), F.count_if(F.col("kept").isNull()).alias("open")
        )
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("hit", F.lit(False)), F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        state = written(state.join(earlier, ["grp", "pos"], "left").select("grp", "pos", now.alias("kept")), "greedy")
        if state.filter("kept IS NULL").isEmpty():
            return state.filter("kept").select("grp", "pos")
        if turn >= WALK_AFTER:
            undecided = state.filter("kept IS NULL").select("grp", F.col("pos").alias("b"))
            sides = edges.join(state.filter("kept IS NULL OR kept").select("grp", F.col("pos").alias("a"), F.col("kept").alias("a_kept")), ["grp", "a"])
            into = written(undecided.join(sides, ["grp", "b"], "left"), "undecided")
            few = into.groupBy("grp").count().filter(F.col("count") <= WALK_EDGES).select("grp")
            walked = into.join(few, "grp", "left_semi").groupBy("grp").applyInArrow(walk, f"grp {state.schema['grp'].dataType.simpleString()}, pos long, walked boolean")
            state = written(state.join(walked, ["grp", "pos"], "left").select("grp", "pos", F.coalesce("kept", "walked").alias("kept")), "greedy")
            if state.filter("kept IS NULL").isEmpty():
                return state.filter("kept").select("grp", "pos")


def option_quality(rows: DataFrame, chunk: str = "chunk", options: str = "options", answer: str = "correct_answer", embeddings: bool = False) -> DataFrame:
    """Adds ``too_close_to_text``, ``too_alike`` and ``good`` for each question.

    The n-gram length is the mean number of tokens of the options, at least 1.  A distractor is too close to the
    text when it beats the right option's similarity to the chunk by the margin, and too alike when its similarity
    to the right option reaches the limit.  With ``embeddings`` the columns ``chunk_vec`` and ``option_vecs``
    (a map like the options) are compared by cosine as well.  Questions without options or chunk are not good.
    """
    o = F.col(options)
    labels = F.map_keys(o)
    right = F.element_at(o, F.col(answer))
    mean = F.aggregate(F.map_values(o), F.lit(0), lambda s, t: s + F.size(split_tokens(t))) / F.size(o)
    n = F.greatest(F.lit(1), F.floor(mean).cast("int"))
    others = F.filter(labels, lambda x: x != F.col(answer))
    c, r = split_tokens(F.col(chunk)), split_tokens(right)
    wrong = F.transform(others, lambda x: split_tokens(F.element_at(o, x)))

    def judged(size: Column) -> Column:
        """Per distractor: closer to the chunk than the answer, and like the answer."""
        return bound(c, lambda ct: bound(r, lambda rt: bound(token_jaccard(ct, rt, size), lambda base: F.transform(
            wrong, lambda w: F.struct((base + EXTRA_JACCARD < token_jaccard(ct, w, size)).alias("close"), (token_jaccard(rt, w, size) >= INTRA_JACCARD).alias("alike"))))))

    rows = rows.withColumn("_judged", F.explode(F.array(bound(n, judged))))  # the generator keeps it from being evaluated per use
    text, alike = F.exists("_judged", lambda j: j["close"]), F.exists("_judged", lambda j: j["alike"])
    if embeddings:
        v, cv = F.col("option_vecs"), F.col("chunk_vec")
        rv = F.element_at(v, F.col(answer))
        text = text | F.exists(others, lambda x: cosine(cv, rv) + EXTRA_COSINE < cosine(cv, F.element_at(v, x)))
        alike = alike | F.exists(others, lambda x: cosine(rv, F.element_at(v, x)) >= INTRA_COSINE)
    known = o.isNotNull() & F.col(chunk).isNotNull() & right.isNotNull()
    return (
        rows.withColumn("too_close_to_text", F.when(known, text)).withColumn("too_alike", F.when(known, alike))
        .withColumn("good", F.coalesce(~F.col("too_close_to_text") & ~F.col("too_alike"), F.lit(False))).drop("_judged")
    )


def replacements(chunks: DataFrame, culled: DataFrame, surviving: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` chunks that replace culled questions: unused by survivors, culled clusters first, then by a seeded hash.

    ``chunks(id, cluster_id)``, ``culled(cluster_id)``, ``surviving(source_chunk_id)``.
    """
    free = chunks.join(surviving.select(F.col("source_chunk_id").alias("id")).filter("id IS NOT NULL"), "id", "left_anti")
    first = culled.select("cluster_id").distinct().withColumn("_first", F.lit(True))
    ranked = free.join(first, "cluster_id", "left").withColumn("priority", F.when(F.col("_first"), 0).otherwise(1))
    return ranked.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), "id"))).orderBy("priority", "h", "id").limit(n).select("id", "cluster_id", "priority")
