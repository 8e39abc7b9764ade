"""Cluster-feature trees over unit vectors: mergeable summaries, Ward agglomeration, assignment.

Each partition condenses its vectors into leaf entries (count, linear sum); the inner levels
of the tree are replaced by one matrix product against all leaf entries, whose number is
bounded.  An entry absorbs a vector when the Ward increase stays under the tree's threshold;
when a tree outgrows ``max_leaves`` the threshold rises and the leaves are condensed.  Summaries
of partitions merge in rounds of eight, counted from the number of partitions, until one is left, so
no task and not the driver ever holds more than ``8 * max_leaves`` entries, however large the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import BROADCAST_BYTES

from .vectors import DIM, as_list

#: Leaf entries a tree may hold.
MAX_LEAVES = 1024
FAN_IN = 8
#: Parts into which a region is divided at most, and rows of a region that one task reads.
PARTS = 16
TASK_ROWS = 50_000


class Leaves:
    """Leaf entries of a cluster-feature tree over unit vectors."""

    def __init__(self, threshold: float, max_leaves: int = MAX_LEAVES, dim: int = DIM) -> None:
        self.threshold, self.max_leaves = threshold, max_leaves
        self.n = np.zeros(0)
        self.ls = np.zeros((0, dim))

    def _increase(self, n: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest leaf of each entry by Ward increase, and that increase."""
        own = self.ls / self.n[:, None]
        d = (c * c).sum(1)[:, None] - 2 * c @ own.T + (own * own).sum(1)[None, :]
        w = d * (n[:, None] * self.n[None, :] / (n[:, None] + self.n[None, :]))
        best = w.argmin(axis=1)
        return best, w[np.arange(len(c)), best]

    def add(self, n: np.ndarray, ls: np.ndarray, step: int = 2048) -> None:
        """Insert entries (single vectors have n = 1)."""
        for a in range(0, len(n), step):
            self._add(n[a : a + step], ls[a : a + step])
            while len(self.n) > self.max_leaves:
                self._condense()

    def _add(self, n: np.ndarray, ls: np.ndarray) -> None:
        rest = np.arange(len(n))
        while len(rest):
            if len(self.n):
                best, up = self._increase(n[rest], ls[rest] / n[rest, None])
                near = up <= self.threshold
                np.add.at(self.ls, best[near], ls[rest[near]])
                np.add.at(self.n, best[near], n[rest[near]])
                rest = rest[~near]
            if not len(rest):
                break
            # new leaves: those of the remaining entries that no earlier remaining one would absorb
            head = rest[:64]
            c = ls[head] / n[head, None]
            d = ((c[:, None, :] - c[None, :, :]) ** 2).sum(-1) * (n[head][:, None] * n[head][None, :] / (n[head][:, None] + n[head][None, :]))
            new: list[int] = []
            for i in range(len(head)):
                if not new or d[i, new].min() > self.threshold:
                    new.append(i)
            self.n = np.concatenate([self.n, n[head[new]]])
            self.ls = np.concatenate([self.ls, ls[head[new]]])
            keep = np.ones(len(rest), bool)
            keep[new] = False
            rest = rest[keep]

    def _condense(self) -> None:
        label, height = ward(self.n, self.ls, groups=self.max_leaves // 2)
        self.threshold = max(self.threshold * 1.05, float(height))
        self.n, self.ls = merged(self.n, self.ls, label)


def merged(n: np.ndarray, ls: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries summed by label."""
    k = int(label.max()) + 1 if len(label) else 0
    out_n, out_ls = np.zeros(k), np.zeros((k, ls.shape[1]))
    np.add.at(out_n, label, n)
    np.add.at(out_ls, label, ls)
    return out_n, out_ls


def linkage(n: np.ndarray, ls: np.ndarray) -> list[tuple[float, int, int]]:
    """All merges (height, entry, entry) of the Ward agglomeration of entries, by nearest-neighbour chains."""
    m = len(n)
    size = n.astype(float).copy()
    mean = ls / n[:, None]
    sq = (mean * mean).sum(1)
    alive = np.ones(m, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    start = 0
    while len(merges) < m - 1:
        if not chain:
            while not alive[start]:
                start += 1
            chain = [start]
        a = chain[-1]
        d = (sq + sq[a] - 2 * mean @ mean[a]) * (size * size[a] / (size + size[a]))
        d[~alive] = np.inf
        d[a] = np.inf
        b = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[b] + 1e-12:
            b = chain[-2]
            chain = chain[:-2]
            merges.append((max(float(d[b]), 0.0), a, b))
            total = size[a] + size[b]
            mean[b] = (mean[a] * size[a] + mean[b] * size[b]) / total
            sq[b] = mean[b] @ mean[b]
            size[b] = total
            alive[a] = False
        else:
            chain.append(b)
    return merges


def ward(n: np.ndarray, ls: np.ndarray, groups: int | None = None, height: float | None = None) -> tuple[np.ndarray, float]:
    """Ward agglomeration of entries, cut at ``groups`` groups or at ``height``.

    Returns the label of each entry and the height of the last merge kept.
    """
    m = len(n)
    if m == 0:
        return np.zeros(0, int), 0.0
    merges = linkage(n, ls)
    order = sorted(range(len(merges)), key=lambda i: merges[i][0])
    keep = order[: max(m - groups, 0)] if groups is not None else [i for i in order if merges[i][0] <= (height or 0.0)]
    root = np.arange(m)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    for i in keep:
        _, a, b = merges[i]
        root[find(a)] = find(b)
    _, label = np.unique([find(i) for i in range(m)], return_inverse=True)
    return label, max((merges[i][0] for i in keep), default=0.0)


def _entries(leaves: Leaves, key: int) -> pd.DataFrame:
    return pd.DataFrame({"part": key, "n": leaves.n, "ls": list(leaves.ls), "t": leaves.threshold})


def summary(units: DataFrame, threshold: float, max_leaves: int = MAX_LEAVES, dim: int = DIM) -> tuple[np.ndarray, np.ndarray, float]:
    """Leaf entries (counts, sums) of one cluster-feature tree over the column ``u`` of all rows, and its threshold.

    A threshold above the given one tells that the tree was condensed.
    """
    schema = "part long, n double, ls array<double>, t double"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Leaves(threshold, max_leaves, dim)
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            tree.add(np.ones(len(x)), x)
        if len(tree.n):
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(tree.n), part)), pa.array(tree.n), as_list(tree.ls, pa.float64()), pa.array(np.full(len(tree.n), tree.threshold))],
                ["part", "n", "ls", "t"],
            )

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Leaves(float(pdf["t"].max()), max_leaves, dim)
        # heaviest first, ties by value: the result does not depend on arrival order
        ls = np.array(pdf["ls"].tolist(), dtype=np.float64).reshape(-1, dim)
        order = np.lexsort((ls[:, 1], ls[:, 0], -pdf["n"].to_numpy()))
        tree.add(pdf["n"].to_numpy(dtype=np.float64)[order], ls[order])
        return _entries(tree, int(key[0]))

    width = units.rdd.getNumPartitions()  # at most one summary a partition
    parts = units.select("u").mapInArrow(build, schema)
    while True:
        width = -(-width // FAN_IN)
        parts = parts.withColumn("part", F.col("part") % width).groupBy("part").applyInPandas(join, schema)
        if width <= 1:
            break
    rows = parts.select("n", "ls", "t").toPandas()
    return rows["n"].to_numpy(dtype=np.float64), np.array(rows["ls"].tolist(), dtype=np.float64).reshape(-1, dim), float(rows["t"].max()) if len(rows) else threshold


def two_nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre by cosine of each row, that cosine and the second-best, in blocks of bounded size."""
    best, top, other = np.zeros(len(x), np.int32), np.full(len(x), -2.0), np.full(len(x), -2.0)
    step = max(1, 8_000_000 // max(len(c), 1))
    for a in range(0, len(x) if len(c) else 0, step):
        s = x[a : a + step] @ c.T
        at = np.arange(len(s))
        b = s.argmax(axis=1)
        best[a : a + step], top[a : a + step] = b, s[at, b]
        s[at, b] = -2
        other[a : a + step] = s.max(axis=1)
    return best, top, other


def nearest(units: DataFrame, centres: np.ndarray, lower: float, dim: int = DIM) -> DataFrame:
    """``id, c, cos, other``: nearest centre by cosine of each row, if at least ``lower``, and the second-best cosine.

    ``centres`` are unit rows, one a cluster or group.
    """
    ship = units.sparkSession.sparkContext.broadcast(centres.astype(np.float32))
    kind = units.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = ship.value
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            best, top, other = two_nearest(x, c)
            keep = pa.array(np.flatnonzero(top >= lower))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(keep), pa.array(best).take(keep), pa.array(top).take(keep), pa.array(other).take(keep)],
                ["id", "c", "cos", "other"],
            )

    return units.select("id", "u").mapInArrow(assign, f"id {kind}, c int, cos double, other double")


def apart(units: DataFrame, centres: np.ndarray, loose: np.ndarray, lower: float, close: float, dim: int = DIM) -> DataFrame:
    """``id, u, near``: the rows below ``lower`` of every centre; near are those of ``close`` to a centre or ``lower`` to a loose one."""
    ship = units.sparkSession.sparkContext.broadcast((centres.astype(np.float32), loose.astype(np.float32)))
    kind = units.schema["id"].dataType.simpleString()

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, others = ship.value
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            _, top, _ = two_nearest(x, c)
            keep = np.flatnonzero(top < lower)
            near = (top[keep] >= close) | (two_nearest(x[keep], others)[1] >= lower)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array(near)], ["id", "u", "near"])

    return units.select("id", "u").mapInArrow(far, f"id {kind}, u array<float>, near boolean")


def sums(units: DataFrame, centres: np.ndarray, lower: float, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the rows within ``lower`` of their nearest centre, by centre.

    Each partition sums the rows of each centre it holds first; the partitions' sums are added by Spark's own
    aggregation, in parts, so no task holds the rows of all partitions, and one row a centre reaches the driver.
    """
    ship = units.sparkSession.sparkContext.broadcast(centres.astype(np.float32))
    names = [f"x{i}" for i in range(dim)]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = ship.value
        n, ls = np.zeros(len(c)), np.zeros((len(c), dim))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if len(x) and len(c):
                best, top, _ = two_nearest(x, c)
                ok = top >= lower
                np.add.at(n, best[ok], 1)
                np.add.at(ls, best[ok], x[ok].astype(np.float64))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), *[pa.array(ls[some, i]) for i in range(dim)]], ["c", "n", *names])

    local_sums = units.select("u").mapInArrow(local, "c long, n double, " + ", ".join(f"{x} double" for x in names))
    rows = local_sums.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("n", *names)]).toArrow()
    n, ls = np.zeros(len(centres)), np.zeros((len(centres), dim))
    at = rows.column("c").to_numpy()
    n[at] = rows.column("n").to_numpy()
    for i, x in enumerate(names):
        ls[at, i] = rows.column(x).to_numpy()
    return n, ls


def directions(ls: np.ndarray) -> np.ndarray:
    """Rows at unit length."""
    return ls / np.maximum(np.sqrt((ls * ls).sum(axis=1, keepdims=True)), 1e-300)


def _salted(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``rows`` with a part ``s`` of their region ``r`` of about ``TASK_ROWS`` rows; the number of parts of each region; the largest."""
    parts = rows.groupBy("r").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("long").alias("parts"))
    most = parts.agg(F.max("parts")).first()[0] or 1
    return rows.join(parts, "r").withColumn("s", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts"), parts, most


def trees(rows: DataFrame, threshold: float, max_leaves: int = MAX_LEAVES, dim: int = DIM) -> DataFrame:
    """``r, s, n, ls, t``: the leaf entries of one tree for each region ``r`` of the rows ``id, u, r``, and its threshold."""
    schema = "r long, s long, n double, ls array<double>, t double"

    def table(r: int, s: int, tree: Leaves) -> pa.Table:
        m = len(tree.n)
        return pa.table({"r": pa.array(np.full(m, r)), "s": pa.array(np.full(m, s)), "n": pa.array(tree.n), "ls": as_list(tree.ls, pa.float64()), "t": pa.array(np.full(m, tree.threshold))})

    def build(key: tuple, t: pa.Table) -> pa.Table:
        tree = Leaves(threshold, max_leaves, dim)
        x = matrix(t.sort_by("id").column("u"), dim).astype(np.float64)
        tree.add(np.ones(len(x)), x)
        return table(key[0].as_py(), key[1].as_py(), tree)

    def join(key: tuple, t: pa.Table) -> pa.Table:
        n, ls, up = t.column("n").to_numpy(), matrix(t.column("ls"), dim), t.column("t").to_numpy()
        order = np.lexsort((ls[:, 1], ls[:, 0], -n))
        tree = Leaves(float(up.max()), max_leaves, dim)
        tree.add(n[order], ls[order])
        return table(key[0].as_py(), key[1].as_py(), tree)

    salted, _, width = _salted(rows)
    parts = salted.groupBy("r", "s").applyInArrow(build, schema)
    while width > 1:
        width = -(-width // FAN_IN)
        parts = parts.withColumn("s", F.col("s") % width).groupBy("r", "s").applyInArrow(join, schema)
    return parts


def matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as a matrix."""
    return col.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest_of_region(rows: DataFrame, centres: DataFrame, dim: int = DIM) -> DataFrame:
    """``id, u, r, c, cos``: the nearest of the centres ``r, c, ls`` of the row's own region, and its cosine."""
    salted, parts, _ = _salted(rows)
    spread = centres.join(parts, "r").withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("r", "s", "c", "ls")

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("c")
        u = left.column("u").combine_chunks()
        x, c = matrix(left.column("u"), dim), directions(matrix(right.column("ls"), dim)).astype(np.float32)
        at, top = np.zeros(len(x), int), np.zeros(len(x))
        for a in range(0, len(x), 4096):
            g = x[a : a + 4096] @ c.T
            at[a : a + 4096] = g.argmax(axis=1)
            top[a : a + 4096] = g.max(axis=1)
        return pa.table({"id": left.column("id"), "u": u, "r": left.column("r"), "c": right.column("c").to_numpy()[at], "cos": top})

    kind = rows.schema["id"].dataType.simpleString()
    return salted.select("id", "u", "r", "s").groupBy("r", "s").cogroup(spread.groupBy("r", "s")).applyInArrow(assign, f"id {kind}, u array<float>, r long, c long, cos double")


def marked(n: np.ndarray, ls: np.ndarray, parts: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` directions of entries, and the one of ``parts`` Ward groups each is in."""
    if len(n) > most:
        n, ls = merged(n, ls, ward(n, ls, groups=most)[0])
    return directions(ls).astype(np.float32), ward(n, ls, groups=parts)[0]


def routed(rows: DataFrame, marks: dict[int, tuple[np.ndarray, np.ndarray]], dim: int = DIM) -> DataFrame:
    """``id, u, r``: the rows of the regions of ``marks``, divided by the group of the nearest direction."""
    ship = rows.sparkSession.sparkContext.broadcast(marks)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, r = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), b.column(2).to_numpy()
            to = np.zeros(len(r), np.int64)
            for k in np.unique(r):
                c, label = ship.value[int(k)]
                at = np.flatnonzero(r == k)
                to[at] = k * PARTS + 1 + label[(x[at] @ c.T).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to)], ["id", "u", "r"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "u", "r").mapInArrow(route, f"id {kind}, u array<float>, r long")


def divided(rows: DataFrame, leaves: DataFrame, parts: DataFrame, dim: int = DIM) -> DataFrame:
    """``id, u, r``: the rows of the regions of ``parts`` (``r, parts``), divided by Ward linkage of their leaves.

    The directions that are broadcast stay under ``BROADCAST_BYTES``: more regions have fewer each.
    """
    most = max(2 * PARTS, BROADCAST_BYTES // (4 * dim * max(parts.count(), 1)))

    def mark(t: pa.Table) -> pa.Table:
        c, label = marked(t.column("n").to_numpy(), matrix(t.column("ls"), dim), t.column("parts")[0].as_py(), most)
        return pa.table({"r": pa.array(np.full(len(c), t.column("r")[0].as_py())), "c": as_list(c), "label": pa.array(label.astype(np.int64))})

    found = leaves.join(parts, "r").groupBy("r").applyInArrow(mark, "r long, c array<float>, label long").toArrow()
    at, c, label = found.column("r").to_numpy(), matrix(found.column("c"), dim), found.column("label").to_numpy()
    return routed(rows.join(F.broadcast(parts), "r", "left_semi"), {int(k): (c[at == k], label[at == k]) for k in np.unique(at)}, dim)
