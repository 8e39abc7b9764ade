"""Nearest neighbours of all vectors with learned partitions.

A bounded sample gives a neighbour graph, which is split into balanced parts with few cut
edges; a small network learns to predict, from a vector, the parts its neighbours lie in.
Parts that still hold many rows are partitioned again, each by a graph and a network of its
own, fitted in a task on a bounded sample of the part.  Every vector is indexed in its most
probable part and searched in as many of its most probable parts as cover ``COVER`` of the
probability; the candidates are ranked by their exact cosine.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.runtime import maybe_broadcast, ship_package, written

from .vectors import DIM, as_list, usable

#: Rows the graph and the classifier are fitted on, at most (about).
SAMPLE = 8192
#: Neighbours in the sample's graph.
GRAPH_K = 10
#: Indexed rows a part should hold, and the most parts of one network (32 sampled rows each).
PART_ROWS = 2048
MAX_PARTS = SAMPLE // 32
#: Parts of more than this many times ``PART_ROWS`` rows are partitioned again.
SPLIT_OVER = 2
#: Networks of parts that are broadcast at once (about 165 kB each); more take further passes.
NETWORKS = 256
#: Probability that the searched parts of a query cover, on each level, and the fewest parts searched.
COVER = 0.97
LEAST_PROBES = 2
#: Rows of one side that a task compares at once; larger parts are split into blocks.
BLOCK = 16384


def graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """Row numbers of the ``k`` nearest other rows of each row."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def partition(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Balanced parts (a power of two) of the neighbour graph by recursive bisection.

    Each bisection starts from the median along the main direction of its rows; then rows
    move, in rounds, to the side where more of their neighbours are, keeping both sides equal.
    """
    part = np.zeros(len(x), np.int64)
    count = 1
    while count < parts:
        for g in range(count):
            rows = np.flatnonzero(part == g)
            if len(rows) < 2:
                continue
            y = x[rows] - x[rows].mean(axis=0)
            v = y[np.argmax((y * y).sum(axis=1))].astype(np.float64)
            for _ in range(12):
                v = y.T @ (y @ v)
                v /= max(np.linalg.norm(v), 1e-30)
            along = y @ v
            at = np.full(len(x), -1)
            at[rows] = np.arange(len(rows))
            nb = at[near[rows]]
            inside = nb >= 0
            back = [nb[inside], np.repeat(np.arange(len(rows)), near.shape[1])[inside.ravel()]]
            half = len(rows) // 2
            side = np.zeros(len(rows))
            side[np.argsort(along, kind="stable")[half:]] = 1
            for _ in range(rounds):
                s = 2 * side - 1
                pull = np.where(inside, s[nb], 0).sum(axis=1)
                np.add.at(pull, back[0], s[back[1]])
                order = np.lexsort((along, pull + s))
                new = np.zeros(len(rows))
                new[order[half:]] = 1
                if (new == side).all():
                    break
                side = new
            part[rows[side == 1]] = g + count
        count *= 2
    return part


class Router:
    """A two-layer network from a vector to the probabilities of the parts."""

    def __init__(self, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray) -> None:
        self.w1, self.b1, self.w2, self.b2 = w1, b1, w2, b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        return z / z.sum(axis=1, keepdims=True)


def fitted(x: np.ndarray, part: np.ndarray, near: np.ndarray, parts: int, hidden: int = 128, epochs: int = 24, seed: int = 7) -> Router:
    """The router, trained on the parts of each sampled row and of its neighbours (Adam, cross entropy)."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = [
        rng.normal(0, (2 / d) ** 0.5, (d, hidden)).astype(np.float32), np.zeros(hidden, np.float32),
        rng.normal(0, (2 / hidden) ** 0.5, (hidden, parts)).astype(np.float32), np.zeros(parts, np.float32),
    ]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    aim = np.zeros((len(x), parts), np.float32)
    np.add.at(aim, (np.arange(len(x)), part), 2.0)
    for j in range(near.shape[1]):
        np.add.at(aim, (np.arange(len(x)), part[near[:, j]]), 1.0)
    aim /= aim.sum(axis=1, keepdims=True)
    size, step = 256, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = 0.004 * (1 - epoch / epochs) + 0.0002
        for a in range(0, len(x), size):
            rows = order[a : a + size]
            xb = x[rows]
            h = np.maximum(xb @ p[0] + p[1], 0)
            q = Router(*p).probabilities(xb)
            dz = (q - aim[rows]) / len(rows)
            dh = (dz @ p[2].T) * (h > 0)
            grads = [xb.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def _trained(x: np.ndarray, n: int, part_rows: int, most: int) -> tuple[Router, int]:
    """The router of ``n`` rows of which ``x`` is a sample, and its number of parts."""
    dim = x.shape[1]
    parts = 1
    while parts * part_rows < n and parts < most and parts * 32 <= len(x):
        parts *= 2
    if parts == 1:
        return Router(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32)), 1
    near = graph(x)
    return fitted(x, partition(x, near, parts), near, parts), parts


def _model(units: DataFrame, n: int, dim: int, part_rows: int, sample: int) -> Router:
    share = int(2**30 * min(1.0, sample / max(n, 1)))
    rows = units.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(2**30)) < share).orderBy("id").select("u").toPandas()
    return _trained(np.array(rows["u"].tolist(), dtype=np.float32).reshape(-1, dim), n, part_rows, sample // 32)[0]


class Probes:
    """The parts a batch of rows is indexed and searched in: rows, parts, probabilities, and whether it is the row's own part."""

    def __init__(self, row: np.ndarray, part: np.ndarray, p: np.ndarray, own: np.ndarray) -> None:
        self.row, self.part, self.p, self.own = row, part, p, own

    @staticmethod
    def first(net: Router, x: np.ndarray, asks: np.ndarray) -> Probes:
        """The probes of the first level: for rows that ask the parts that cover ``COVER``, for all the most probable one."""
        p = net.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_p = np.take_along_axis(p, order, 1)
        probe = (np.cumsum(sorted_p, axis=1) - sorted_p < COVER) | (np.arange(p.shape[1]) < LEAST_PROBES)[None, :]
        probe[~asks, 1:] = False
        row, place = np.nonzero(probe)
        return Probes(row, order[row, place].astype(np.int64), sorted_p[row, place], place == 0)

    def divided(self, nets: dict[int, Router], x: np.ndarray, asks: np.ndarray, level: int) -> Probes:
        """The probes after the parts of ``nets`` are partitioned again; a row's probes cover ``COVER`` of those it has."""
        row, part, p, own = [], [], [], []
        split = np.isin(self.part, list(nets))
        for g in np.unique(self.part[split]):
            at = np.flatnonzero(self.part == g)
            q = nets[int(g)].probabilities(x[self.row[at]])
            best = q.argmax(axis=1)
            # what is less than a thousandth of a row's probability is never needed for its cover
            r, c = np.nonzero((q * self.p[at][:, None] > 1e-3) | (np.arange(q.shape[1])[None, :] == best[:, None]))
            row.append(self.row[at[r]]), part.append(self.part[at[r]] + (c + 1) * MAX_PARTS**level * 2)
            p.append(q[r, c] * self.p[at[r]]), own.append(self.own[at[r]] & (c == best[r]))
        row, part, p, own = (np.concatenate([getattr(self, k)[~split], *v]) for k, v in (("row", row), ("part", part), ("p", p), ("own", own)))
        order = np.lexsort((part, -p, row))
        row, part, p, own = row[order], part[order], p[order], own[order]
        first = np.searchsorted(row, row, side="left")
        total = np.bincount(row, p, minlength=len(x))[row] if len(row) else p
        before = np.concatenate([[0.0], np.cumsum(p)])[:-1]
        before = before - before[first] if len(row) else before
        keep = own | (asks[row] & ((before < COVER * total) | (np.arange(len(row)) - first < LEAST_PROBES)))
        return Probes(row[keep], part[keep], p[keep], own[keep])


def _probe(nets: list, x: np.ndarray, asks: np.ndarray) -> Probes:
    found = Probes.first(nets[0], x, asks)
    for level, more in enumerate(nets[1:], 1):
        found = found.divided(more, x, asks, level)
    return found


def _levels(units: DataFrame, wanted: DataFrame, n: int, dim: int, part_rows: int, sample: int) -> tuple[list, dict[int, tuple[int, int]]]:
    """The networks, one of the first level and dictionaries by part of the further ones, and the rows of each part, indexed and asking.

    Each further level multiplies the parts by up to ``MAX_PARTS``; two hold 134 million vectors in parts near
    ``PART_ROWS``.  A level of more than ``NETWORKS`` networks is not built: its parts stay and are compared in blocks.
    """
    nets: list = [_model(units, n, dim, part_rows, sample)]
    spark = units.sparkSession
    while True:
        ship = spark.sparkContext.broadcast(nets)
        sizes = {r["part"]: (r["n"], r["m"]) for r in _sizes(wanted, ship, dim)}
        large = {p: own for p, (own, _) in sizes.items() if own > SPLIT_OVER * part_rows}
        if not large or len(large) > NETWORKS:
            return nets, sizes

        def sampled(batches: Iterator[pa.RecordBatch], ship=ship, large=large) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                found = _probe(ship.value, x, np.zeros(len(x), bool))
                size = np.array([large.get(int(g), 0) for g in found.part], np.float64)
                dice = b.column(0).to_numpy()[found.row] < np.minimum(sample / np.maximum(size, 1), 1) * 2**30
                at = np.flatnonzero((size > 0) & dice)
                yield pa.RecordBatch.from_arrays([pa.array(found.part[at]), b.column(0).take(pa.array(found.row[at])), as_list(x[found.row[at]])], ["part", "dice", "u"])

        sized = large

        def fit(t: pa.Table) -> pa.Table:
            g = t.column("part")[0].as_py()
            x = t.column("u").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = x[np.lexsort((x[:, 1], x[:, 0], t.column("dice").to_numpy()))]
            net, parts = _trained(x, sized[g], part_rows, sample // 32)
            return pa.table({"part": [g] if parts > 1 else [], "net": pa.array([pickle.dumps(net)] if parts > 1 else [], pa.binary())}, schema=pa.schema([("part", pa.int64()), ("net", pa.binary())]))

        dice = F.pmod(F.xxhash64("id", F.lit(11 + len(nets))), F.lit(2**30)).alias("dice")
        # at most NETWORKS groups of about SAMPLE rows each, and as many networks
        made = units.select(dice, "u").mapInArrow(sampled, "part long, dice long, u array<float>").groupBy("part").applyInArrow(fit, "part long, net binary").toArrow()
        more = {g: pickle.loads(blob) for g, blob in zip(made.column("part").to_pylist(), made.column("net").to_pylist())}
        if not more:
            return nets, sizes
        nets = [*nets, more]


def nearest(
    df: DataFrame, k: int = 10, least_cos: float | None = None, queries: str | None = None,
    id_col: str = "id", vec_col: str = "vector", dim: int = DIM, part_rows: int = PART_ROWS, sample: int = SAMPLE,
) -> DataFrame:
    """``id, other, cos, rank``: the ``k`` most similar other ids of every id (or of those for which the SQL condition ``queries`` on ``id`` holds).

    With ``least_cos`` only neighbours of at least that cosine are returned; they are still
    among the ``k`` most similar.  ``sample`` bounds the rows a network is fitted on, at most
    ``SAMPLE``; every row is indexed.

    Defined results: unusable vectors and null ids are neither searched nor found; repeated rows
    count once; equal cosines are ranked by id; of a vector shared by more than k + 1 ids, the
    first k + 1 ids stand for the group in searches, and every further member has the first k as
    its neighbours, which is what exact search with these ties gives; a table with a single usable id gives no rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    units = written(usable(df, id_col, vec_col, dim), "units")
    n = units.count()
    kind = units.schema["id"].dataType.simpleString()

    big = units.select(F.xxhash64("u").alias("h")).groupBy("h").count().filter(F.col("count") > k + 1).select("h")
    rest = None
    if not big.isEmpty():
        ranked = Window.partitionBy("h", "u").orderBy("id")
        hashed = units.withColumn("h", F.xxhash64("u"))
        first = written(hashed.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= k + 1), "first")
        stand = first.join(big, "h", "left_semi").filter(F.col("r") <= k).select("h", "u", F.col("id").alias("other"), F.col("r").alias("rank"))
        more = hashed.join(big, "h", "left_semi").join(first.select("id"), "id", "left_anti")
        # k rows a group; the members are on the other side of an equi-join, split by AQE when a group is hot
        rest = more.join(stand, ["h", "u"]).select("id", "other", F.lit(1.0).alias("cos"), "rank")
        units = first.select("id", "u")
        if queries:
            rest = rest.filter(queries)

    wanted = units.withColumn("q", F.expr(queries).cast("boolean") if queries else F.lit(True))
    nets, sizes = _levels(units, wanted, n, dim, part_rows, sample)
    ship = spark.sparkContext.broadcast(nets)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if not len(x):
                continue
            found = _probe(ship.value, x, b.column(2).to_numpy(zero_copy_only=False).astype(bool))
            at = pa.array(found.row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.part), pa.array(found.own), b.column(2).take(at), b.column(0).take(at), as_list(x[found.row])],
                ["part", "own", "q", "id", "u"],
            )

    routed = wanted.select("id", "u", "q").mapInArrow(route, f"part long, own boolean, q boolean, id {kind}, u array<float>")
    # hot parts are compared in blocks, index blocks by query blocks
    grid = [(p, -(-a // BLOCK), -(-b // (4 * BLOCK))) for p, (a, b) in sizes.items() if a > BLOCK or b > 4 * BLOCK]
    if grid:
        blocks = maybe_broadcast(spark.createDataFrame(grid, "part long, ib int, qb int"), len(grid), 24)
        routed = routed.join(blocks, "part", "left").na.fill(1, ["ib", "qb"])
        my_i = F.pmod(F.xxhash64("id"), F.col("ib"))
        my_q = F.pmod(F.xxhash64("id", F.lit(5)), F.col("qb"))
        as_index = routed.filter("own").withColumn("q", F.lit(False)).withColumn("bi", my_i).withColumn("bq", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
        as_query = routed.filter("q").withColumn("own", F.lit(False)).withColumn("bq", my_q).withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("ib") - 1)))
        cols = ["part", F.col("bi").cast("int").alias("bi"), F.col("bq").cast("int").alias("bq"), "own", "q", "id", "u"]
        routed = as_index.select(*cols).unionByName(as_query.select(*cols))
    else:
        routed = routed.select("part", F.lit(0).alias("bi"), F.lit(0).alias("bq"), "own", "q", "id", "u")

    def search(t: pa.Table) -> pa.Table:
        own = t.column("own").to_numpy(zero_copy_only=False).astype(bool)
        ask = t.column("q").to_numpy(zero_copy_only=False).astype(bool)
        x = t.column("u").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        ids = t.column("id").combine_chunks()
        names = np.array(ids.to_pylist(), dtype=object)
        order = np.argsort(names, kind="stable")  # index rows by id, so that ties keep the smaller one
        i_rows, q_rows = order[own[order]], np.flatnonzero(ask)
        y, i_names = x[i_rows], names[i_rows]
        out_q, out_i, out_c = [], [], []
        for a in range(0, len(q_rows) if len(i_rows) else 0, 1024):
            rows = q_rows[a : a + 1024]
            s = x[rows] @ y.T
            me = np.minimum(np.searchsorted(i_names, names[rows]), len(i_rows) - 1)
            self_ = i_names[me] == names[rows]
            s[np.flatnonzero(self_), me[self_]] = -2
            if least_cos is not None:
                r, c = np.nonzero(s >= least_cos - 1e-4)
            elif s.shape[1] > k:
                edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                r, c = np.nonzero(s >= np.maximum(edge, -1.5)[:, None])
            else:
                r, c = np.nonzero(s > -1.5)
            cos = (x[rows[r]].astype(np.float64) * y[c].astype(np.float64)).sum(axis=1)
            if least_cos is not None:
                ok = cos >= least_cos
                r, c, cos = r[ok], c[ok], cos[ok]
            by = np.lexsort((c, -cos, r))
            r, c, cos = r[by], c[by], cos[by]
            first = np.searchsorted(r, r, side="left")
            ok = np.arange(len(r)) - first < k
            out_q.append(rows[r[ok]]), out_i.append(i_rows[c[ok]]), out_c.append(cos[ok])
        cat = lambda z, kind: np.concatenate(z) if z else np.zeros(0, kind)
        return pa.table({"id": ids.take(pa.array(cat(out_q, np.int64))), "other": ids.take(pa.array(cat(out_i, np.int64))), "cos": pa.array(cat(out_c, np.float64))})

    found = routed.groupBy("part", "bi", "bq").applyInArrow(search, f"id {kind}, other {kind}, cos double")
    best = Window.partitionBy("id").orderBy(F.col("cos").desc(), "other")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    if rest is not None:
        if least_cos is not None and least_cos > 1:
            rest = rest.limit(0)
        ranked = ranked.unionByName(rest.select("id", "other", "cos", "rank"))
    return ranked


def _sizes(wanted: DataFrame, ship: object, dim: int) -> list:
    """Indexed and asking rows of each part; at most as many rows as parts and tasks, summed again by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        asking: Counter = Counter()
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if not len(x):
                continue
            asks = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            found = _probe(ship.value, x, asks)
            for into, rows in ((total, found.own), (asking, asks[found.row])):
                part, n = np.unique(found.part[rows], return_counts=True)
                into.update(dict(zip(part.tolist(), n.tolist())))
        keys = list(total | asking)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total[k] for k in keys], pa.int64()), pa.array([asking[k] for k in keys], pa.int64())], ["part", "n", "m"])

    return wanted.select("u", "q").mapInArrow(count, "part long, n long, m long").groupBy("part").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect()


def close_pairs(df: DataFrame, least_cos: float = 0.9, k: int = 10, id_col: str = "id", vec_col: str = "vector", dim: int = DIM) -> DataFrame:
    """``id_a, id_b``: pairs of at least ``least_cos`` of which one is among the ``k`` most similar of the other, ``id_a < id_b``.

    Defined results: as for :func:`nearest`; each pair once.
    """
    near = nearest(df, k, least_cos, None, id_col, vec_col, dim)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
