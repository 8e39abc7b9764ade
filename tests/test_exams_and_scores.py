"""Exams, scores, item models, spaces, corpus, history and streams."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import irt
from corpusmill.operators import exam, items, scoring, space
from corpusmill.sources import corpus, history
from corpusmill.streaming import results as stream


def plain_allocation(sizes, n):
    w = [math.sqrt(s) for s in sizes]
    if not sum(w):
        return [0] * len(sizes)
    quota = [n * x / sum(w) for x in w]
    base = [min(math.floor(q), s) for q, s in zip(quota, sizes)]
    missing = n - sum(base)
    for i in sorted(range(len(sizes)), key=lambda i: (-round(quota[i] - math.floor(quota[i]), 9), i)):
        if missing > 0 and base[i] < sizes[i]:
            base[i] += 1
            missing -= 1
    return base


@pytest.mark.parametrize("sizes,n", [([100, 50, 30, 20], 50), ([100] * 4, 20), ([400, 25, 25, 25], 40), ([200], 30), ([3, 100, 100], 50), ([0, 0, 0], 10), ([5, 5, 5], 100), ([10, 1, 50, 2, 100], 30), ([1, 1, 100], 50)])
def test_allocation(spark, sizes, n):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "cluster_id int, size long")
    got = [r["slots"] for r in exam.allocate(df, n).orderBy("cluster_id").collect()]
    assert got == plain_allocation(sizes, n) and all(0 <= g <= s for g, s in zip(got, sizes)) and sum(got) <= n


def test_cluster_numbers_and_sizes(spark):
    assert [exam.n_clusters(*a) for a in [(0, 50), (1, 50), (99, 50), (10000, 50)]] == [1, 1, 9, 50] and exam.n_clusters(5, 5, 7) == 7
    df = spark.createDataFrame([(0,), (0,), (2,), (None,), (-1,), (9,)], "label int")
    assert [(r["cluster_id"], r["size"]) for r in exam.cluster_sizes(df, 4).orderBy("cluster_id").collect()] == [(0, 2), (1, 0), (2, 1), (3, 0)]


def test_sampling_and_acceptance(spark):
    rows = spark.createDataFrame([(f"i{k}", k % 3, k) for k in range(30)] + [("none", None, 1)], "id string, cluster_id int, slots int")
    slots = spark.createDataFrame([(0, 3), (1, 0), (2, 20)], "cluster_id int, slots long")
    got = exam.stratified(rows.drop("slots"), slots).collect()
    assert sorted(r["cluster_id"] for r in got) == [0] * 3 + [2] * 10
    assert {tuple(r) for r in got} == {tuple(r) for r in exam.stratified(rows.drop("slots").repartition(7), slots).collect()}
    cand = spark.createDataFrame([(0, t, t % 2 == 0) for t in range(10)], "cluster_id int, turn int, ok boolean")
    assert [r["turn"] for r in exam.accepted(cand, slots).orderBy("turn").collect()] == [0, 2, 4]


def test_kmeans_separates(spark):
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(size=(20, 2)) * 0.1 + c for c in ((0, 0), (10, 0), (0, 10))])
    df = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)] + [(99, None)], "id int, vector array<double>")
    got = {r["id"]: r["label"] for r in exam.kmeans_labels(df, 3, 2).collect()}
    assert 99 not in got and all(len({got[i] for i in range(a, a + 20)}) == 1 for a in (0, 20, 40)) and len(set(got.values())) == 3


def test_registered_kmeans_has_all_restarts(spark, monkeypatch, tmp_path):
    from corpusmill.plans.catalog import QUERIES

    starts, plain = [], exam.KMeans
    monkeypatch.setattr(exam, "KMeans", lambda **kw: starts.append(kw["seed"]) or plain(**kw))
    rng = np.random.default_rng(2)
    rows = [(i, [float(z) for z in v]) for i, v in enumerate(rng.normal(size=(40, 4)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["kmeans_assign"](spark, str(tmp_path)).count() == 40
    assert len(set(starts)) == 10


def test_greedy_walk(spark):
    rng = np.random.default_rng(1)
    data = []
    for g in ("a", "b"):
        x = rng.normal(size=(60, 3))
        data += [(g, i, [float(z) for z in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(data + [("a", 500, None)], "g string, pos int, vector array<double>")
    edges = exam.close_edges(df, 0.6, "g", block=16)
    got = {(r["grp"], r["pos"]) for r in exam.greedy_kept(df.filter("vector IS NOT NULL"), edges, "g").collect()}
    for g in ("a", "b"):
        v = [np.array(r[2]) / np.linalg.norm(r[2]) for r in data if r[0] == g]
        kept = []
        for i in range(60):
            if all(v[i] @ v[k] <= 0.6 for k in kept):
                kept.append(i)
        assert {p for q, p in got if q == g} == set(kept)
    none = df.limit(0)
    assert exam.greedy_kept(none, exam.close_edges(none, 0.6, "g"), "g").count() == 0


def test_greedy_walk_of_long_chains(spark, monkeypatch):
    rows = spark.createDataFrame([(g, i) for g in ("a", "b") for i in range(1000)] + [("c", 1)], "g string, pos long")
    edges = spark.createDataFrame([(g, i, i + 1) for g in ("a", "b") for i in range(999)], "grp string, a long, b long")
    got = {tuple(r) for r in exam.greedy_kept(rows, edges, "g").collect()}
    assert got == {(g, i) for g in ("a", "b") for i in range(0, 1000, 2)} | {("c", 1)}
    short = edges.filter("a < 14")
    monkeypatch.setattr(exam, "WALK_EDGES", 3)
    got = {tuple(r) for r in exam.greedy_kept(rows.filter("pos < 15"), short, "g").collect()}
    assert got == {(g, i) for g in ("a", "b") for i in range(0, 15, 2)} | {("c", 1)}


def test_option_quality(spark):
    chunk = "the cache keeps recent pages in memory for the reader"
    good = {"A": "recent pages in memory", "B": "stars and moons", "C": "bread with flour", "D": "winter sports in snow"}
    alike = {**good, "B": "recent pages in memory"}
    near = {"A": "something else entirely different", "B": "cache keeps recent pages", "C": "bread with some flour", "D": "winter sports in snow"}
    rows = [("good", chunk, good, "A"), ("alike", chunk, alike, "A"), ("near", chunk, near, "A"), ("nochunk", None, good, "A"), ("noopt", chunk, None, "A"), ("noans", chunk, good, None)]
    got = {r["id"]: (r["too_close_to_text"], r["too_alike"], r["good"]) for r in exam.option_quality(spark.createDataFrame(rows, "id string, chunk string, options map<string,string>, correct_answer string")).collect()}
    assert got == {"good": (False, False, True), "alike": (False, True, False), "near": (True, False, False), "nochunk": (None, None, False), "noopt": (None, None, False), "noans": (None, None, False)}


def test_replacements(spark):
    chunks = spark.createDataFrame([(f"c{i}", i % 3) for i in range(12)], "id string, cluster_id int")
    culled = spark.createDataFrame([(1,), (1,)], "cluster_id int")
    left = spark.createDataFrame([("c1",), ("c0",), (None,)], "source_chunk_id string")
    got = exam.replacements(chunks, culled, left, 5).collect()
    assert len(got) == 5 and {"c0", "c1"}.isdisjoint(r["id"] for r in got)
    assert {r["id"] for r in got if r["priority"] == 0} == {"c4", "c7", "c10"}


T = dt.datetime(2025, 5, 1)


def answers(spark, rows):
    return spark.createDataFrame(rows, "result_id bigint, trial_number int, question_id string, correct boolean, loaded_at timestamp")


def test_scores(spark):
    df = answers(spark, [(1, 0, "q", True, T), (1, 0, "q", False, T + dt.timedelta(1)), (2, 0, "r", None, T), (3, 0, "s", True, T), (4, 1, "q", True, T)])
    once = scoring.delivered_once(df)
    assert {r["trial_number"]: (r["n_correct"], r["n_total"], r["score"]) for r in scoring.exam_score(once, ["trial_number"]).collect()} == {0: (1, 3, 0.333333), 1: (1, 1, 1.0)}
    assert scoring.exam_score(once.limit(0)).first()["score"] == 0.0
    assert [(r["result_id"], r["nth"]) for r in scoring.failed(once, "trial_number", "result_id", 1).collect()] == [(1, 1)]
    grid = {(r["trial"], r["question_id"]): r["correct"] for r in scoring.response_matrix(once).collect()}
    assert grid == {(0, "q"): 0, (0, "r"): 0, (0, "s"): 1, (1, "q"): 1, (1, "r"): 0, (1, "s"): 0}
    only = spark.createDataFrame([("q",), ("zz",)], "question_id string")
    assert scoring.response_matrix(once, only).count() == 2
    assert scoring.response_matrix(once.filter("trial_number = 0")).count() == 0


def trial(n, score, size=512, temperature=0.0):
    return (n, ({"parser": "docling", "chunking_strategy": "recursive", "chunk_size": size, "chunk_overlap": 64, "embedding_model": "m", "index_type": "vector_only"},
                {"top_k": 5, "hybrid_alpha": 0.5, "reranker": "none", "reranker_top_n": 5, "query_expansion": "none", "llm_model": "l", "temperature": temperature}), score)


def trials(spark, rows):
    return spark.createDataFrame(rows, f"trial_number int, config {history.CONFIG}, score double")


def test_history_reads(spark):
    df = trials(spark, [trial(0, 0.5), trial(1, None), trial(2, 0.7, 256), trial(3, 0.7), trial(4, 0.6, 256, 0.3)])
    assert scoring.best_trial(df).first()["trial_number"] == 2
    assert [(r["best_so_far"], r["improved"]) for r in scoring.running_best(df).orderBy("trial_number").collect()] == [(0.5, True), (0.5, False), (0.7, True), (0.7, False), (0.7, False)]
    assert [r["trial_number"] for r in scoring.last_n(df, 2).collect()] == [4, 3]
    lines = [r[0] for r in df.orderBy("trial_number").select(scoring.summary_line()).collect()]
    assert lines[0] == "Trial 0: score=0.500 | chunk=512, embed=m, index=vector_only, top_k=5, reranker=none, llm=l" and "score=nan" in lines[1]
    assert {(r["trial_number"], r["field"], r["old"], r["new"]) for r in scoring.config_changes(df).collect() if r["trial_number"] == 4} == {(4, "structural.chunk_size", "512", "256"), (4, "runtime.temperature", "0.0", "0.3")}
    assert scoring.best_trial(df.limit(0)).count() == 0 and scoring.running_best(df.limit(0)).count() == 0


def test_space(spark, tmp_path):
    import hashlib

    (tmp_path / "s.yaml").write_text("choices: {structural.parser: [docling], runtime.reranker: [none]}\nspans: {structural.chunk_size: [256, 512], runtime.temperature: [0, 0.2]}\n")
    s = space.Space.load(tmp_path / "s.yaml")
    out = space.violations(trials(spark, [trial(0, 0.1), trial(1, 0.1, 513, 0.3), trial(2, 0.1, 512, None)]), s).orderBy("trial_number").collect()
    assert [r["violations"] for r in out] == [[], ["runtime.temperature", "structural.chunk_size"], ["runtime.temperature"]]
    (tmp_path / "e.yaml").write_text("")
    with pytest.raises(ValueError):
        space.Space.load(tmp_path / "e.yaml")
    with pytest.raises(FileNotFoundError):
        space.Space.load(tmp_path / "none.yaml")
    with pytest.raises(ValueError):
        space.Span(2, 1)
    got = trials(spark, [trial(0, 0.1)]).select(space.fingerprint(F.col("config.structural"))).first()[0]
    data = trial(0, 0.1)[1][0]
    assert got == hashlib.sha256(json.dumps(data, sort_keys=True).encode()).hexdigest()[:12]


def test_context_and_prompt(spark):
    h = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "zz")], "qid int, rank int, id string")
    d = spark.createDataFrame([("a", "first"), ("b", "second")], "doc_id string, text string")
    assert [(r["qid"], r["context"]) for r in scoring.joined_context(h, d).collect()] == [(1, "first\nsecond")]
    row = spark.createDataFrame([("why?", {"B": "two", "A": "one"})], "q string, o map<string,string>").select(scoring.answer_prompt(F.col("q"), F.col("o"), F.lit(None).cast("string"))).first()[0]
    assert "A) one\nB) two" in row and row.startswith("Context:\n\n\nQuestion: why?")


def simulated(n=10, m=40, seed=123):
    rng = np.random.default_rng(seed)
    theta, a, b = rng.normal(size=n), rng.uniform(0.5, 1.5, m), rng.uniform(0.01, 1, m)
    p = 0.25 + 0.75 / (1 + np.exp(-a * (theta[:, None] - b)))
    return theta, (rng.random((n, m)) < p).astype(int)


def test_fit():
    theta, x = simulated(30, 60)
    f = items.fit(x)
    start = items.loss_and_gradient(np.concatenate([np.zeros(30), np.ones(60), np.full(60, 0.01), np.full(60, 0.25)]), *x.shape, *items._cells(x, None))[0]
    assert f.loss < start and (np.abs(f.abilities) <= 3).all()
    for v, k in ((f.discriminations, "a"), (f.difficulties, "b"), (f.guessings, "g")):
        assert (v >= items.BOUNDS[k][0] - 1e-12).all() and (v <= items.BOUNDS[k][1] + 1e-12).all()
    assert np.corrcoef(np.argsort(np.argsort(theta)), np.argsort(np.argsort(f.abilities)))[0, 1] > 0.5
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.normal(size=4), rng.uniform(0.5, 1.4, 5), rng.uniform(0.1, 0.9, 5), rng.uniform(0.21, 0.39, 5)])
    y, seen = rng.integers(0, 2, (4, 5)).astype(float), rng.integers(0, 2, (4, 5)).astype(float)
    _, g = items.loss_and_gradient(p, *y.shape, *items._cells(y, seen))
    for i in range(len(p)):
        e = np.zeros_like(p)
        e[i] = 1e-6
        assert g[i] == pytest.approx((items.loss_and_gradient(p + e, *y.shape, *items._cells(y, seen))[0] - items.loss_and_gradient(p - e, *y.shape, *items._cells(y, seen))[0]) / 2e-6, abs=1e-5)
    with pytest.raises(ValueError):
        items.fit(np.zeros((1, 3)))


def test_item_columns(spark):
    rows = spark.createDataFrame([(t / 10, 1.2, 0.8, 0.25) for t in range(-30, 31)], "theta double, a double, b double, g double")
    c = [F.col(x) for x in ("theta", "a", "b", "g")]
    out = rows.select("theta", irt.icc(*c).alias("p"), irt.information(*c).alias("i")).orderBy("theta").collect()
    assert all(x["p"] < y["p"] for x, y in zip(out, out[1:])) and out[0]["p"] > 0.25
    assert abs(max(out, key=lambda r: r["i"])["theta"] - 0.8) < 0.6
    far = spark.createDataFrame([(500.0, 1.5, 0.0, 0.0), (-500.0, 1.5, 0.0, 0.0)], "theta double, a double, b double, g double").select(irt.icc(*c)).collect()
    assert far[0][0] == 1 - 1e-10 and far[1][0] == 1e-10


def test_cull_refine_and_exam_fits(spark):
    df = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate([0.2, 0.6, 0.9, 1.2, 0.4])], "question_id string, a double")
    assert {r["question_id"] for r in items.with_cull_rank(df, ratio=0.4).filter("culled").collect()} == {"q0", "q4"}
    assert {r["question_id"] for r in items.with_cull_rank(df, ratio=0.01).filter("culled").collect()} == {"q0"}
    assert {r["question_id"] for r in items.weak(df, 0.5).collect()} == {"q0", "q4"} and items.with_cull_rank(df.limit(0)).count() == 0
    q = spark.createDataFrame([(f"q{i}", "t", 1.0, 0.0, 0.25) for i in range(5)], "id string, question string, discrimination double, difficulty double, guessing double")
    par = spark.createDataFrame([(f"q{i}", v, 0.5, 0.3) for i, v in enumerate([0.2, 0.6, 0.9, 1.2, 0.4])], "question_id string, a double, b double, g double")
    new = spark.createDataFrame([("n1", "t")], "id string, question string")
    assert {r["id"] for r in items.refined(q, par, new, 0.2).collect()} == {"q1", "q2", "q3", "q4", "n1"}
    assert items.refined(q.limit(1), par).count() == 1
    _, x = simulated(6, 8)
    cells = spark.createDataFrame([(e, t, f"i{j}", int(x[t, j])) for e in (1, 2) for t in range(6) for j in range(8)] + [(3, 0, "z", 1)], "exam int, trial int, question_id string, correct int")
    who, what = items.fit_exams(cells)
    assert who.count() == 12 and what.count() == 16
    nll = items.total_loss(cells.filter("exam = 1").drop("exam"), who.filter("exam = 1").drop("exam"), what.filter("exam = 1").drop("exam")).first()["nll"]
    assert nll == pytest.approx(items.fit(x[:, np.argsort([f"i{j}" for j in range(8)])]).loss, rel=1e-6)
    assert items.information_curve(what, [0.0, 1.0]).count() == 2
    who2, what2 = items.fit_exams(cells, task_cells=10)
    alternating = items.total_loss(cells.filter("exam = 1").drop("exam"), who2.filter("exam = 1").drop("exam"), what2.filter("exam = 1").drop("exam")).first()["nll"]
    assert what2.count() == what.count() and alternating <= nll * 1.05


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in {"a.md": "# One \n", "b.txt": " \n", "metadata.json": "{}", ".hidden.txt": "no", "sub/c.html": "<h2>Head</h2><p>Some <b>bold</b> text</p><script>x</script><ul><li>item</ul>", "sub/d.ods": "zz", "e.txt": "café"}.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"] and r["error"].split(":")[0]) for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("# One", None), "c.html": ("## Head\nSome bold text\n- item", None), "d.ods": (None, "unsupported"), "e.txt": ("café", None), "bad.txt": (None, "UnicodeDecodeError")}
    assert corpus.parsers.html_text(None) is None and corpus.parsers.html_text("") == ""
    with pytest.raises(ValueError, match="available"):
        corpus.parser("other")
    paths = spark.createDataFrame([("x/a.PDF",), ("b.ods",), ("c.md",), ("d",)], "path string")
    assert {r["extension"] for r in corpus.extensions(paths).collect()} == {".pdf", ".ods"}
    assert {r["parser"]: r["missing"] for r in corpus.unsupported(paths, ["docling", "html"]).collect()} == {"docling": ".ods", "html": ".ods,.pdf"}
    with pytest.raises(ValueError):
        corpus.unsupported(paths, ["nope"])


def test_history_files(spark, tmp_path):
    full = trials(spark, [trial(0, 0.5), trial(1, None)])
    path = str(tmp_path / "h")
    history.append(full, path)
    history.append(full.filter("trial_number = 0"), path)
    (tmp_path / "h" / "extra.json").write_text('\n{"trial_number": "x"\n{"score": 1.0}\n')
    got = history.read(spark, path)
    assert sorted(r["trial_number"] for r in got.collect()) == [0, 0, 1]
    assert history.read_with_errors(spark, path).cache().filter("_corrupt_record IS NOT NULL").count() == 1
    assert json.loads(history.as_line(full).first()["line"])["config"]["structural"]["chunk_size"] == 512


def test_streamed_answers(spark, tmp_path):
    schema = "result_id bigint, trial_number int, correct boolean, recorded_at timestamp, loaded_at timestamp"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 0, True, T, T), (1, 0, True, T, T + dt.timedelta(1)), (2, 0, None, T, T)], schema).coalesce(1).write.parquet(src)
    q = stream.once(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    assert sorted(r["result_id"] for r in spark.read.parquet(out).collect()) == [1, 2]
    q = stream.windowed_scores(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("scores").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["n_correct"], r["n_total"]) for r in spark.table("scores").collect()] == [(2, 3)]


def test_registered_queries():
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 45
