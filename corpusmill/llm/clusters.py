"""Similarity clusters and varied subsets from cluster-feature trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.runtime import ship_package, written

from . import cftree
from .vectors import DIM, as_list, usable

#: Least cosine of a member with the mean direction of its cluster.
MEMBER_COS = 0.55
#: A member's cosine with every other cluster's mean direction stays below this.
OTHER_COS = 0.5
#: Fewest members.
LEAST = 5
#: Ward increase up to which a leaf entry absorbs a vector, and up to which leaves agglomerate.
LEAF_INCREASE = 0.7
CUT_INCREASE = 0.9
#: Mean directions at least this close belong to one cluster.
SAME_COS = 0.5
#: Least average pairwise cosine of a cluster; chance groups of few vectors stay below.
PAIR_COS = 0.36
#: Fewest vectors of a part of a cluster, as a region may hold it.
SEED = 3
#: A round that places less than this share of its rows is followed by a search of the rows near its finds only, at least this close.
FRUITFUL = 0.01
NEAR_COS = 0.4
#: Leaf entries of a tree for each group cut from it, and the Ward increase up to which vectors count as equal.
LEAVES_A_GROUP = 8
LEAST_INCREASE = 1e-9


def _united(n: np.ndarray, ls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups whose mean directions are so close that no member could keep below ``OTHER_COS`` are parts of one cluster."""
    c, alive = cftree.directions(ls), np.ones(len(n), bool)
    top, near = np.full(len(n), -2.0), np.zeros(len(n), int)

    def scan(rows: np.ndarray) -> None:
        for at in np.array_split(rows, len(rows) // 256 + 1):
            g = c[at] @ c.T
            g[:, ~alive] = -2
            g[np.arange(len(at)), at] = -2
            top[at], near[at] = g.max(axis=1, initial=-2), g.argmax(axis=1) if len(at) else 0

    scan(np.arange(len(n)))
    while len(n) and top.max() >= SAME_COS:
        a = int(top.argmax())
        a, b = sorted((a, int(near[a])))
        n[a] += n[b]
        ls[a] += ls[b]
        c[a], alive[b], top[b] = cftree.directions(ls[a : a + 1])[0], False, -2
        scan(np.flatnonzero(alive & ((near == a) | (near == b) | (np.arange(len(n)) == a))))
        g = c @ c[a]
        nearer = alive & (g > top)
        nearer[a] = False
        top[nearer], near[nearer] = g[nearer], a
    return n[alive], ls[alive]


def _pair_cos(n: np.ndarray, ls: np.ndarray) -> np.ndarray:
    """Average pairwise cosine of groups."""
    return ((ls * ls).sum(axis=1) - n) / np.maximum(n * (n - 1), 1)


def _refined(units: DataFrame, centres: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean directions after two passes over the rows, of what remains a cluster; those of what is large enough but too loose, as a mixture is."""
    loose = []
    for _ in range(2):
        n, ls = _united(*cftree.sums(units, centres, MEMBER_COS, dim))
        close = _pair_cos(n, ls) >= PAIR_COS
        loose.append(cftree.directions(ls[(n >= LEAST) & ~close]))
        centres = cftree.directions(ls[(n >= LEAST) & close])
    return centres, np.concatenate(loose)


def _seeds(n: np.ndarray, ls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ward groups of leaves that can be parts of a cluster."""
    label, _ = cftree.ward(n, ls, height=CUT_INCREASE)
    n, ls = cftree.merged(n, ls, label)
    keep = (n >= LEAST) | (n >= SEED) & (_pair_cos(n, ls) >= PAIR_COS)
    return n[keep], ls[keep]


def _seeds_by_region(rest: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds among the rows, divided into regions until no tree is condensed."""
    n, ls, t = cftree.summary(rest, LEAF_INCREASE, dim=dim)
    if t <= LEAF_INCREASE:
        return _seeds(n, ls)

    def seeds(t: pa.Table) -> pa.Table:
        n, ls = _seeds(t.column("n").to_numpy(), cftree.matrix(t.column("ls"), dim))
        return pa.table({"n": pa.array(n), "ls": as_list(ls, pa.float64())})

    rows = written(cftree.routed(rest.withColumn("r", F.lit(0).cast("long")), {0: cftree.marked(n, ls, cftree.PARTS, cftree.MAX_LEAVES)}, dim), "regions")
    found = []
    for _ in range(14):  # region numbers fill a long after that
        leaves = written(cftree.trees(rows, LEAF_INCREASE, dim=dim), "leaves")
        over = written(leaves.groupBy("r").agg(F.max("t").alias("t")).filter(F.col("t") > LEAF_INCREASE).select("r", F.lit(cftree.PARTS).alias("parts")), "parts")
        found.append(leaves.join(F.broadcast(over), "r", "left_anti").groupBy("r").applyInArrow(seeds, "n double, ls array<double>").toArrow())
        if over.isEmpty():
            all_found = pa.concat_tables(found)
            return all_found.column("n").to_numpy().copy(), cftree.matrix(all_found.column("ls"), dim).copy()
        rows = written(cftree.divided(rows, leaves, over, dim), "regions")
    raise RuntimeError("a region could not be divided")


def clusters(df: DataFrame, id_col: str = "id", vec_col: str = "vector", dim: int = DIM) -> DataFrame:
    """``id, c, cos``: the cluster number and centre cosine of every id that belongs to a cluster.

    Cluster-feature trees summarise each partition, the summaries are tree-reduced, rows whose tree
    had to be condensed are divided into regions until no tree is, as it could mix clusters, the leaves
    agglomerated by Ward linkage, means recomputed over all rows, and every row assigned.  Rows that fit no cluster
    are searched again until a round finds nothing: all of them while rounds place many, then those near what the last
    round found or rejected as a mixture, as only there can a find have hidden another.  Otherwise every round
    over many single vectors would find a few chance groups more, and the rounds would grow with the rows.

    Defined results: unusable vectors, null ids and vectors that fit no cluster have no row;
    repeated rows give one; equal vectors fall into the same cluster; an empty table gives no
    rows; extra columns are ignored.
    """
    ship_package(df.sparkSession)
    units = written(usable(df, id_col, vec_col, dim), "units")
    centres, rest, left, rounds = np.zeros((0, dim)), units, units.count(), 0
    while left >= LEAST:
        new, loose = _refined(rest, cftree.directions(_united(*_seeds_by_region(rest, dim))[1]), dim)
        if not len(new):
            break
        centres, rounds, before = np.concatenate([centres, new]), rounds + 1, left
        rest = written(cftree.apart(rest, new, loose, MEMBER_COS, NEAR_COS, dim), "rest")
        left = rest.count()
        if left == before:
            break
        if before - left < FRUITFUL * before:
            rest = rest.filter("near")
            left = rest.count()
        rest = rest.select("id", "u")
    if rounds > 1:
        centres, _ = _refined(units, centres, dim)
    found = cftree.nearest(units, centres, MEMBER_COS, dim).filter(F.col("other") < OTHER_COS).select("id", "c", "cos")
    return written(found, "members")


def named(members: DataFrame) -> DataFrame:
    """``id, group_id, cos``: clusters named by their smallest id."""
    names = members.groupBy("c").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)
    # one row per cluster
    return members.join(F.broadcast(names), "c").select("id", "group_id", "cos")


def described(members: DataFrame, typical: int = 3) -> DataFrame:
    """``group_id, size, typical``: each cluster's size and most typical members, nearest to the centre first (ties by id)."""
    m = named(members)
    order = Window.partitionBy("group_id").orderBy(F.col("cos").desc(), "id")
    top = m.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= typical)
    lists = top.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]), ",").alias("typical"))
    return m.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).join(lists, "group_id")


def _by_region(units: DataFrame, k: int, dim: int, max_leaves: int) -> DataFrame:
    """``id, c, cos``: the Ward group among ``k`` of every row, with a tree for each region.

    Regions are nodes of the Ward hierarchy.  All are cut at one height, which leaves ``k`` groups in total, so a
    region gets as many as its variety asks for.  Regions whose trees were condensed above that height are divided
    and summarised again, then condensed ones with fewer than ``LEAVES_A_GROUP`` leaves for each of their groups.
    Rows are assigned to groups of their own region.
    """
    room = max(max_leaves // LEAVES_A_GROUP, 2)
    rows = units.withColumn("r", F.lit(0).cast("long"))
    n, ls, t = cftree.summary(units, LEAST_INCREASE, max_leaves, dim)
    if t > LEAST_INCREASE:
        rows = written(cftree.routed(rows, {0: cftree.marked(n, ls, cftree.PARTS, max_leaves)}, dim), "regions")

    def heights(t: pa.Table) -> pa.Table:
        h = [m[0] for m in cftree.linkage(t.column("n").to_numpy(), cftree.matrix(t.column("ls"), dim).copy())]
        return pa.table({"r": pa.array(np.full(len(h), t.column("r")[0].as_py())), "i": pa.array(np.arange(len(h))), "h": pa.array(h, pa.float64())})

    def summed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        leaves = written(cftree.trees(rows, LEAST_INCREASE, max_leaves, dim), "leaves")
        return leaves, written(leaves.groupBy("r").applyInArrow(heights, "r long, i long, h double"), "merges")

    (leaves, merges), before = summed(rows), 0
    while True:
        regions = leaves.groupBy("r").agg(F.max("t").alias("t"))
        count = regions.count()
        split = merges.orderBy(F.col("h").desc(), "r", "i").limit(max(k - count, 0)).groupBy("r").agg(F.count(F.lit(1)).alias("groups"), F.min("h").alias("h"))
        quota = written(regions.join(split, "r", "left").select("r", "t", (F.coalesce("groups", F.lit(0)) + 1).alias("groups"), "h"), "quota")
        total, height = quota.agg(F.sum("groups"), F.min("h")).first()
        condensed = quota.filter(F.col("t") > LEAST_INCREASE)
        # with fewer groups than wanted every condensed tree hides some
        over = condensed.filter(F.col("t") >= (height if total == k else 0.0)) if count < k else condensed.limit(0)
        if over.isEmpty():
            over = condensed.filter(F.col("groups") > room)
        parts = over.select("r", F.greatest(F.lit(2), F.least(F.lit(cftree.PARTS), F.ceil(2 * F.col("groups") / room))).cast("int").alias("parts"))
        if parts.isEmpty():
            break
        if count <= before:
            raise RuntimeError("a region could not be divided")
        parts, before = written(parts, "parts"), count
        moved = written(cftree.divided(rows, leaves, parts, dim), "regions")
        # only what was divided is summarised again
        rows, leaves, merges = (a.join(F.broadcast(parts), "r", "left_anti").unionByName(b) for a, b in zip((rows, leaves, merges), (moved, *summed(moved))))

    def cut(t: pa.Table) -> pa.Table:
        n, ls = t.column("n").to_numpy(), cftree.matrix(t.column("ls"), dim)
        label, _ = cftree.ward(n, ls, groups=t.column("groups")[0].as_py())
        _, ls = cftree.merged(n, ls, label)
        c = t.column("first")[0].as_py() + np.arange(len(ls))
        return pa.table({"r": pa.array(np.full(len(ls), t.column("r")[0].as_py())), "c": pa.array(c), "ls": as_list(ls, pa.float64())})

    # the window runs over one row a region
    first = quota.select("r", "groups", (F.sum("groups").over(Window.orderBy("r")) - F.col("groups")).alias("first"))
    centres = leaves.join(first, "r").groupBy("r").applyInArrow(cut, "r long, c long, ls array<double>")
    return cftree.nearest_of_region(rows, centres, dim).select("id", F.col("c").cast("int").alias("c"), "cos")


def varied(df: DataFrame, k: int | None = None, share: float | None = None, id_col: str = "id", vec_col: str = "vector", dim: int = DIM, max_leaves: int = cftree.MAX_LEAVES) -> DataFrame:
    """``id, group_no, group_size, cos``: at most ``k`` records, the nearest to the centre of each of ``k`` Ward groups.

    The size is given as ``k`` or as a ``share`` of the usable vectors.
    Large groups of similar records get one record each like any other group, so they are not
    over-represented.

    Defined results: unusable vectors and null ids cannot be chosen; with fewer different
    vectors than ``k`` there are fewer records; equal distances go to the smallest id;
    repeated rows count once; an empty table gives no rows; ``k`` must be at least 1.  A subset
    too large for the leaves of one tree is chosen by region, see :func:`_by_region`.
    """
    if (k is None) == (share is None):
        raise ValueError("give either k or share")
    ship_package(df.sparkSession)
    units = written(usable(df, id_col, vec_col, dim), "units")
    if k is None:
        k = max(1, round(share * units.count()))
    if k < 1:
        raise ValueError(f"the size must be at least 1, not {k}")
    if k > max_leaves // LEAVES_A_GROUP:
        near = _by_region(units, k, dim, max_leaves)
    else:
        n, ls, _ = cftree.summary(units, LEAST_INCREASE, max_leaves, dim)
        label, _ = cftree.ward(n, ls, groups=k)
        _, ls = cftree.merged(n, ls, label)
        near = cftree.nearest(units, cftree.directions(ls), -1.5, dim)
    return near.groupBy("c").agg(
        F.min(F.struct(-F.col("cos"), F.col("id"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    ).select(F.col("best.id").alias("id"), F.col("c").alias("group_no"), "group_size", F.round(-F.col("best.col1"), 6).alias("cos"))
