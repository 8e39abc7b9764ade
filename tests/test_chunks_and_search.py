"""Chunking and retrieval: invariants and brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import chunking, index, retrieval


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n.", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_recursive_chunks(t, size, overlap):
    chunks = chunking.split_recursive(t, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    squeeze = lambda x: "".join(x.split())
    assert set(squeeze(t)) == set(squeeze("".join(chunks)))
    if overlap == 0:
        assert squeeze("".join(chunks)) == squeeze(t)


def test_recursive_overlap_and_order():
    t = " ".join(f"word{i}" for i in range(200))
    chunks = chunking.split_recursive(t, 80, 20)
    assert all(len(c) <= 80 for c in chunks) and chunks[0].startswith("word0") and chunks[-1].endswith("word199")
    assert any(chunks[i].split()[-1] in chunks[i + 1].split() for i in range(len(chunks) - 1))
    assert len(chunking.split_recursive(t, 40, 0)) > len(chunking.split_recursive(t, 160, 0))


def test_fixed_keeps_long_pieces_whole():
    t = "x" * 300 + "\n\n" + "short" + "\n\n" + "tiny"
    assert chunking.split_fixed(t, 50, 0) == ["x" * 300, "short\n\ntiny"]


def test_chunk_documents(spark):
    docs = spark.createDataFrame([(2, "b " * 400), (1, "one"), (3, None), (4, "  "), (5, ""), (1, "one")], "doc_id bigint, text string").withColumn("pos", F.lit("clash"))
    out = chunking.chunk_documents(docs, size=100, overlap=10)
    assert {r["doc_id"] for r in out.collect()} == {1, 2}
    assert out.filter("doc_id = 1").count() == 2
    ids = chunking.chunk_ids(out.distinct()).orderBy(F.substring("chunk_id", 7, 9).cast("int")).collect()
    assert [r["chunk_id"] for r in ids] == [f"chunk_{i}" for i in range(len(ids))]
    assert [(r["doc_id"], r["pos"]) for r in ids] == sorted((r["doc_id"], r["pos"]) for r in ids)
    empty = docs.limit(0)
    assert chunking.chunk_documents(empty).count() == 0 and chunking.chunk_ids(chunking.chunk_documents(empty)).count() == 0
    with pytest.raises(ValueError, match="supported"):
        chunking.chunk_documents(docs, "semantic")
    with pytest.raises(ValueError):
        chunking.chunk_documents(docs, size=10, overlap=10)


def test_bm25_against_plain_python(spark):
    rng = random.Random(1)
    vocab = ["ant", "bee", "cat", "dog", "elk", "fox", "gnu"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12)))) for i in range(40)] + [(90, None), (91, "")]
    items = [(i, " ".join(rng.sample(vocab, 3))) for i in range(6)] + [(50, None), (51, "")]
    got = {}
    for r in retrieval.bm25(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), 5).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"]))
    bags = {i: Counter(t.split()) for i, t in docs if t}
    n, avg = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    assert set(got) == {i for i, t in items if t}
    for q, t in items:
        if not t:
            continue
        score = {}
        for i, b in bags.items():
            s = 0.0
            for w in set(t.split()):
                df = sum(w in x for x in bags.values())
                if b[w]:
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / avg))
            if s:
                score[i] = round(s, 6)
        want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [(i, pytest.approx(s, abs=2e-6)) for i, s in want] == [(i, s) for _, i, s in sorted(got[q])]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vector_search(spark, metric, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 600)
    rng = np.random.default_rng(42)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    v = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)] + [(100, None), (101, [1.0])], "id bigint, vector array<double>")
    q = v.filter("id % 3 = 0 AND id < 60").withColumnRenamed("id", "qid")
    got = {}
    for r in retrieval.vector_search(v, q, 4, metric).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    for i in range(0, 60, 3):
        d = np.round(np.linalg.norm(x - x[i], axis=1), 6) if metric == "l2" else -np.round(x @ x[i] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i])), 6)
        want = sorted(range(60), key=lambda j: (d[j], j))[:4]
        assert [j for _, j in sorted(got[i])] == want
    assert retrieval.vector_search(v, q.limit(0), 4, metric).count() == 0
    assert retrieval.vector_search(v.limit(0), q, 4, metric).count() == 0


def test_best_keeps_ties_and_drops_the_surpassed():
    import pyarrow as pa

    best = retrieval.Best(2, 2)
    ids = pa.array(list("abcdef"))
    best.add(np.array([0, 0, 1]), np.array([1.0, 2.0, np.nan]), ids, np.array([0, 1, 2]))
    best.add(np.array([0, 0, 0, 1]), np.array([2.0, 3.0, 0.5, 1.0]), ids, np.array([3, 4, 5, 0]))
    got = [r for b in best.found(pa.array(["x", "y"])) for r in b.to_pylist()]
    assert sorted((r["qid"], r["id"], r["score"]) for r in got) == [("x", "b", 2.0), ("x", "d", 2.0), ("x", "e", 3.0), ("y", "a", 1.0)]


def test_common_and_rare_terms_of_large_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    weight = 1 / np.arange(1, 301)
    text = lambda n: " ".join(rng.choice(words, n, p=weight / weight.sum()))
    docs = spark.createDataFrame([(i, text(20)) for i in range(1500)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, text(8)) for i in range(30)], "item_id bigint, text string")
    index = retrieval.postings(docs)
    rows = lambda x: sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in x.collect())
    assert rows(retrieval.bm25(docs, items, 5)) == rows(retrieval.bm25(docs, items, 5, index=index))


def hits(spark, rows):
    return spark.createDataFrame(rows, "qid int, id string, rank int, score double, variant int")


def test_rrf(spark):
    a = hits(spark, [(1, "a", 1, 0.0, 0), (1, "b", 2, 0.0, 0), (1, None, 3, 0.0, 0)])
    b = hits(spark, [(1, "b", 1, 0.0, 0), (1, "c", 2, 0.0, 0), (2, "z", 1, 0.0, 0)])
    out = {(r["qid"], r["rank"]): r["id"] for r in retrieval.rrf(a, b).collect()}
    assert out == {(1, 1): "b", (1, 2): "a", (1, 3): "c", (2, 1): "z"}


def test_deduplicated_and_reranked(spark):
    h = hits(spark, [(1, "a", 1, 1.0, 1), (1, "b", 2, 1.0, 0), (1, "a", 1, 2.0, 0), (1, "c", 1, 1.0, 2)])
    assert [(r["id"], r["rank"]) for r in retrieval.deduplicated(h).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    docs = spark.createDataFrame([("a", "red fox"), ("b", "green tree"), ("c", "red tree fox"), ("d", None)], "doc_id string, text string")
    items = spark.createDataFrame([(1, "red fox tree")], "item_id int, text string")
    out = retrieval.reranked(hits(spark, [(1, "a", 1, 0.0, 0), (1, "b", 2, 0.0, 0), (1, "c", 3, 0.0, 0)]), items, docs, 2).orderBy("rank").collect()
    assert [r["id"] for r in out] == ["c", "a"]


def test_expansion(spark):
    q = spark.createDataFrame([(1, "q", "x\n \n y \nz\nw"), (2, "p", None)], "item_id int, text string, gen string")
    out = retrieval.expanded(q, "multi_query", generated="gen").orderBy("qid", "variant").collect()
    assert [(r["qid"], r["variant"], r["text"]) for r in out] == [(1, 0, "q"), (1, 1, "x"), (1, 2, "y"), (1, 3, "z"), (2, 0, "p")]
    assert retrieval.expanded(q, "none").count() == 2 and retrieval.expanded(q, "hyde", generated="gen").count() == 4
    with pytest.raises(ValueError):
        retrieval.expanded(q, "hyde")
    with pytest.raises(ValueError):
        retrieval.expanded(q, "other", generated="gen")


def test_weighted_fusion_and_graph(spark):
    a = hits(spark, [(1, "a", 1, 10.0, 0), (1, "b", 2, 0.0, 0)])
    b = hits(spark, [(1, "b", 1, 1.0, 0), (1, "c", 2, 0.5, 0)])
    out = [r["id"] for r in retrieval.weighted_fusion(a, b, 0.7).orderBy("rank").collect()]
    assert out[0] == "b"
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert retrieval.graph_search(docs, spark.createDataFrame([], "item_id bigint, text string")).columns == ["qid", "id", "score", "rank"]


def test_index_round_trip_and_registry(spark, tmp_path):
    docs = spark.createDataFrame([(1, "solar panels turn light into power\n\nthey need sun"), (2, "bread needs flour and water"), (3, None)], "doc_id bigint, text string")
    made = []
    reg = index.Registry(spark, str(tmp_path / "indices"))
    assert not reg.has("k1")
    with pytest.raises(KeyError):
        reg.get("k1")
    build = lambda: made.append(1) or index.build(docs, size=40, overlap=5)
    one = reg.get_or_build("k1", build, {"chunk_size": 40})
    two = reg.get_or_build("k1", build, {"chunk_size": 40})
    assert made == [1] and reg.manifest("k1")["config"] == {"chunk_size": 40}
    q = spark.createDataFrame([(7, "solar power")], "item_id int, text string")
    top = index.with_ids(two.search_text(q, 1), two.chunks).first()
    assert top["doc_id"] == 1 and one.chunks.count() == two.chunks.count()
    from corpusmill.providers import HashEmbedder, ModelEmbedder

    near = two.search_vectors(HashEmbedder().embed(q, "item_id", "text").withColumnRenamed("id", "qid"), 1, "cosine").first()
    assert near["id"] == top["id"]
    with pytest.raises(ValueError):
        index.build(docs.limit(0))
    enc = ModelEmbedder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2).embed(docs, "doc_id", "text").collect()
    assert {r["id"]: r["vector"] for r in enc}[2] == [27.0, 1.0] and {r["id"]: r["vector"] for r in enc}[3] is None


def test_vectors_with_no_number_hide_nothing(spark):
    rows = [(i, [float(i), 1.0]) for i in range(8)] + [(90, [float("nan"), 1.0]), (91, None), (92, [1.0])]
    index = spark.createDataFrame(rows, "id bigint, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([("q", [2.2, 1.0]), ("bad", [float("nan"), 0.0]), ("none", None)], "qid string, vector array<double>")
    got = retrieval.vector_search(index, asked, 3).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == "q"] == [2, 3, 1] and {r["qid"] for r in got} == {"q"}


def test_running_best_loses_nothing():
    import numpy as np

    rng = np.random.default_rng(3)
    s = np.round(rng.normal(size=(7, 300)), 1)
    best, kept = retrieval.Best(7, 4), []
    for a in range(0, 300, 50):
        i, j = best.keep(0, s[:, a : a + 50].copy())
        kept += list(zip(i.tolist(), (a + j).tolist()))
    for q in range(7):
        edge = np.sort(s[q])[-4]
        assert {j for i, j in kept if i == q} >= set(np.flatnonzero(s[q] >= edge).tolist()) and sum(i == q for i, _ in kept) < 150
