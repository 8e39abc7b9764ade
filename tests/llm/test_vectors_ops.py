"""Clusters, varied subsets and neighbours against brute force."""

import numpy as np
import pytest

from corpusmill.llm import cftree, clusters, neighbours
from corpusmill.llm.vectors import usable

SCHEMA = "id string, vector array<float>, u string, c int, other string"


def rows(x, prefix="v"):
    return [(f"{prefix}{i:05d}", [float(z) for z in v], "clash", i, "x") for i, v in enumerate(x)]


def made(seed=1, sizes=(60, 30, 12, 7), noise=15, dim=64):
    rng = np.random.default_rng(seed)
    out, label = [], []
    for k, n in enumerate(sizes):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        x = centre + rng.normal(size=(n, dim)) * 0.9 / np.sqrt(dim)
        out.append(x)
        label += [k] * n
    out.append(rng.normal(size=(noise, dim)))
    label += [-1] * noise
    return np.concatenate(out) * rng.uniform(0.5, 3, (sum(sizes) + noise, 1)), np.array(label)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_usable_rows(spark):
    x, _ = made(sizes=(4,), noise=0)
    good = rows(x)
    nan = [float("nan")] + [1.0] * 63
    bad = [("n", None, "", 1, ""), (None, [1.0] * 64, "", 1, ""), ("s", [1.0] * 3, "", 1, ""), ("e", [], "", 1, ""), ("z", [0.0] * 64, "", 1, ""), ("nan", nan, "", 1, ""), ("null", [None] + [1.0] * 63, "", 1, ""), ("inf", [float("inf")] * 64, "", 1, "")]
    out = usable(frame(spark, good + good[:2] + bad)).collect()
    assert sorted(r["id"] for r in out) == [g[0] for g in good]
    assert all(abs(np.linalg.norm(r["u"]) - 1) < 1e-6 for r in out)
    assert usable(frame(spark, [])).count() == 0
    two = [("a", [2.0] + [0.0] * 63, "", 1, ""), ("a", [0.0, 3.0] + [0.0] * 62, "", 1, "")]
    assert usable(frame(spark, two)).first()["u"][:2] == [0.0, 1.0]


def test_ward_matches_plain_agglomeration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(25, 3))
    n = rng.integers(1, 5, 25).astype(float)
    label, _ = cftree.ward(n, x * n[:, None], groups=6)
    groups = [[i] for i in range(25)]
    while len(groups) > 6:
        best = None
        for i in range(len(groups)):
            for j in range(i):
                a, b = n[groups[i]].sum(), n[groups[j]].sum()
                ca, cb = (x[g] * n[g][:, None] for g in (groups[i], groups[j]))
                d = a * b / (a + b) * ((ca.sum(0) / a - cb.sum(0) / b) ** 2).sum()
                if best is None or d < best[0]:
                    best = (d, i, j)
        _, i, j = best
        groups[j] += groups.pop(i)
    assert {frozenset(np.flatnonzero(label == k)) for k in set(label)} == {frozenset(g) for g in groups}
    assert len(cftree.ward(np.zeros(0), np.zeros((0, 3)), groups=1)[0]) == 0


def test_leaves_stay_bounded():
    rng = np.random.default_rng(3)
    tree = cftree.Leaves(1e-9, 64, 8)
    x = rng.normal(size=(2000, 8))
    tree.add(np.ones(2000), x, 100)
    assert len(tree.n) <= 64 and tree.n.sum() == 2000
    assert np.allclose(tree.ls.sum(0), x.sum(0))


def test_clusters_found(spark):
    x, label = made()
    data = rows(x)
    df = frame(spark, data + data[:20]).repartition(5)
    got = {r["id"]: r["group_id"] for r in clusters.named(clusters.clusters(df)).collect()}
    want = {}
    for k in range(4):
        ids = [data[i][0] for i in np.flatnonzero(label == k)]
        want |= {i: min(ids) for i in ids}
    assert got == want
    d = {r["group_id"]: r for r in clusters.described(clusters.clusters(df)).collect()}
    assert sorted(r["size"] for r in d.values()) == [7, 12, 30, 60]
    assert all(len(r["typical"].split(",")) == 3 for r in d.values())


def test_more_clusters_than_leaves(spark):
    rng = np.random.default_rng(3)
    bits = (np.arange(64)[:, None] >> np.arange(6)) & 1
    forms = []
    while len(forms) < 18:  # signs of quadratic forms that differ everywhere: cosines of at most 0.25
        q = np.triu(rng.integers(0, 2, (6, 6)), 1)
        signs = 1 - 2 * (((bits @ q) * bits).sum(1) % 2)
        if all(np.abs((signs * f) @ (1 - 2 * ((bits @ bits.T) % 2))).max() <= 16 for f in forms):
            forms.append(signs)
    centre = np.concatenate([f * (1 - 2 * ((bits @ bits.T) % 2)) for f in forms])[:1100] / 8
    label = np.repeat(np.arange(1100), 6)
    data = rows(centre[label] + rng.normal(size=(6600, 64)) * 0.05 / 8)
    got = {r["id"]: r["group_id"] for r in clusters.named(clusters.clusters(frame(spark, data).repartition(4))).collect()}
    assert got == {d[0]: data[6 * k][0] for d, k in zip(data, label)}


def test_clusters_of_nothing(spark):
    assert clusters.named(clusters.clusters(frame(spark, []))).count() == 0
    x, _ = made(sizes=(), noise=12)
    assert clusters.named(clusters.clusters(frame(spark, rows(x)))).count() == 0


def test_varied_subset_covers_small_groups(spark):
    x, label = made(sizes=(200, 10, 8), noise=0)
    df = frame(spark, rows(x)).repartition(4)
    got = clusters.varied(df, 3).collect()
    assert {label[int(r["id"][1:])] for r in got} == {0, 1, 2}
    assert sorted(r["group_size"] for r in got) == [8, 10, 200]
    assert len(clusters.varied(df, share=0.05).collect()) == 11
    same = frame(spark, [(f"i{k}", [1.0] * 64, "", 0, "") for k in range(30)])
    one = clusters.varied(same, 5).collect()
    assert len(one) == 1 and one[0]["id"] == "i0"
    assert clusters.varied(frame(spark, []), 5).count() == 0
    with pytest.raises(ValueError):
        clusters.varied(df, 0)
    with pytest.raises(ValueError):
        clusters.varied(df)


def test_varied_subset_larger_than_a_tree(spark):
    sizes = tuple(3 + 40 * (k % 10 == 0) for k in range(100))
    x, label = made(seed=6, sizes=sizes, noise=0)
    centre = np.stack([x[label == k].mean(0) for k in range(100)])
    x = centre[label] + 0.05 * x
    got = clusters.varied(frame(spark, rows(x)).repartition(4), 100, max_leaves=64).collect()
    assert {label[int(r["id"][1:])] for r in got} == set(range(100)) and len(got) == 100
    assert sorted(r["group_size"] for r in got) == sorted(sizes)
    assert len({r["group_no"] for r in got}) == 100
    few = [(f"i{k}", [1.0] * (k % 40 + 1) + [0.0] * (63 - k % 40), "", 0, "") for k in range(200)]
    assert len(clusters.varied(frame(spark, few), 100, max_leaves=64).collect()) == 40


def brute(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[ids[i]] = [(ids[j], s[i, j]) for j in order]
    return out


def test_neighbours_match_brute_force(spark):
    x, _ = made(seed=5, sizes=(50, 20), noise=30)
    data = rows(x)
    got = neighbours.nearest(frame(spark, data + data[:9]), 4).collect()
    want = brute(x, [d[0] for d in data], 4)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["id"], []).append((r["other"], round(r["cos"], 4)))
    assert {k: [j for j, _ in v] for k, v in by.items()} == {k: [j for j, _ in v] for k, v in want.items()}


def test_recall_with_learned_partitions(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 200)
    x, _ = made(seed=8, sizes=(900, 500, 300, 200), noise=100)
    data = rows(x)
    got = neighbours.nearest(frame(spark, data), 10, queries="CAST(substr(id, 2) AS INT) % 50 = 0").collect()
    want = brute(x, [d[0] for d in data], 10)
    asked = {d[0] for d in data if int(d[0][1:]) % 50 == 0}
    assert {r["id"] for r in got} == asked
    hits = sum(r["other"] in {j for j, _ in want[r["id"]]} for r in got)
    assert hits / (10 * len(asked)) >= 0.9


def test_large_parts_are_partitioned_again(spark, monkeypatch):
    seen = []
    sizes = neighbours._sizes
    monkeypatch.setattr(neighbours, "_sizes", lambda *a: seen.append(sizes(*a)) or seen[-1])
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 64))[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 64)) * 0.4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>")
    got = neighbours.nearest(df, 10, queries="id % 50 = 0", part_rows=64, sample=512).select("id", "other").toPandas()
    assert len(seen) >= 2 and max(r["n"] for r in seen[-1]) < max(r["n"] for r in seen[0]) and len(seen[-1]) > 16
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for i, g in got.groupby("id"):
        s = u @ u[i]
        s[i] = -2
        hit += len(set(np.argsort(-s)[:10]) & set(g["other"]))
    assert hit / (10 * 120) >= 0.9


def test_hot_parts_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    x, _ = made(seed=2, sizes=(70,), noise=10)
    data = rows(x)
    got = {(r["id"], r["other"]) for r in neighbours.nearest(frame(spark, data), 3).collect()}
    assert got == {(i, j) for i, v in brute(x, [d[0] for d in data], 3).items() for j, _ in v}


def test_groups_of_copies(spark):
    rng = np.random.default_rng(4)
    v = [float(z) for z in rng.normal(size=64)]
    data = [(f"c{i:03d}", v, "", 0, "") for i in range(40)] + rows(rng.normal(size=(5, 64)))
    pairs = {(r["id_a"], r["id_b"]) for r in neighbours.close_pairs(frame(spark, data), 0.9, 3).collect()}
    ids = [f"c{i:03d}" for i in range(40)]
    want = {tuple(sorted((i, j))) for i in ids for j in [z for z in ids if z != i][:3]}
    assert pairs == want


def test_neighbours_of_few(spark):
    assert neighbours.close_pairs(frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, rows(np.eye(64)[:1]))).count() == 0


@pytest.mark.parametrize("k", [50, 300, 800])
def test_many_clusters(spark, k):
    rng = np.random.default_rng(k)
    centres: list[np.ndarray] = []
    while len(centres) < k:  # sparse sign vectors of pairwise cosine at most 0.25
        v = np.zeros(64)
        v[rng.permutation(64)[:8]] = rng.choice([-1, 1], 8) / 8**0.5
        if not centres or (np.array(centres) @ v).max() < 0.3:
            centres.append(v)
    label = np.repeat(np.arange(k), rng.integers(5, 25, k))
    label = label[rng.permutation(len(label))]
    x = np.array(centres)[label] + rng.normal(size=(len(label), 64)) * 0.08
    got = clusters.named(clusters.clusters(spark.createDataFrame(rows(x), SCHEMA).repartition(6))).collect()
    first = {c: f"v{int(np.flatnonzero(label == c)[0]):05d}" for c in range(k)}
    found = {(r["id"], r["group_id"]) for r in got}
    assert sum((f"v{i:05d}", first[c]) in found for i, c in enumerate(label)) >= 0.95 * len(label)


def test_rounds_do_not_grow_with_single_vectors(spark, tmp_path, monkeypatch):
    """Among many single vectors every search finds a few chance groups; only what lies near them is searched again."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    x, label = made(seed=5, sizes=(60,) * 10 + (12,) * 10, noise=20_000)
    ids = [f"v{i:05d}" for i in range(len(x))]
    pq.write_table(pa.table({"id": ids, "vector": pa.array(list(x.astype(np.float32)))}), str(tmp_path / "x.parquet"))
    searched, search = [], clusters._seeds_by_region
    monkeypatch.setattr(clusters, "_seeds_by_region", lambda rest, dim: searched.append(rest.count()) or search(rest, dim))
    got = {r["id"]: r["group_id"] for r in clusters.named(clusters.clusters(spark.read.parquet(str(tmp_path / "x.parquet")))).collect()}
    assert sum(searched) < 3 * len(x)
    first = {k: ids[int(np.flatnonzero(label == k)[0])] for k in range(20)}
    assert sum(got.get(ids[i]) == first[k] for i, k in enumerate(label) if k >= 0) >= 0.9 * (label >= 0).sum()
