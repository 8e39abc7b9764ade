"""Composed retrieval, evaluation, exam generation, stores and the trial loop."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import generation, items, loop, pipeline, retrieval
from corpusmill.operators import index as store
from corpusmill.operators.space import Space, Span, fingerprint
from corpusmill.providers import HashEmbedder, ModelEmbedder, ModelGenerator, OverlapGenerator
from corpusmill.sources import corpus, history

TEXTS = ["solar panels turn light into power on every roof", "database indexes speed up reads of large tables", "sourdough bread needs flour water salt and time", "wetlands filter water and shelter many birds"]


@pytest.fixture
def index(spark):
    chunks = spark.createDataFrame([(f"c{i}", i, 0, t) for i, t in enumerate(TEXTS)] + [("c9", 9, 0, "")], "chunk_id string, doc_id bigint, pos int, text string")
    return store.Index(chunks, HashEmbedder().embed(chunks, "chunk_id", "text"), *retrieval.postings(chunks, "chunk_id", "text"))


@pytest.fixture
def asked(spark):
    rows = [("q1", "how do solar panels give power", "light", 1), ("q2", "sourdough bread needs flour and salt", None, 2), ("q3", None, "x", 3), (None, "wetlands", "x", 4), ("q1", "how do solar panels give power", "light", 1)]
    return spark.createDataFrame(rows, "id string, question string, more string, rank int")


@pytest.mark.parametrize("kind", ["vector_only", "hybrid_bm25_vector", "hybrid_graph_vector", "no such type"])
def test_retrieve_by_index_type(index, asked, kind):
    got = pipeline.retrieve(index, asked, pipeline.Settings(kind, 2)).collect()
    by = {}
    for r in got:
        by.setdefault(r["qid"], []).append((r["rank"], r["id"], r["text"]))
    assert {k: sorted(v)[0][1] for k, v in by.items()} == {"q1": "c0", "q2": "c2"}
    assert all([x[0] for x in sorted(v)] == [1, 2] for v in by.values()) and sorted(by["q1"])[0][2] == TEXTS[0]


def test_retrieve_expands_over_fetches_and_reranks(index, asked, monkeypatch):
    seen = []
    whole = pipeline.search
    monkeypatch.setattr(pipeline, "search", lambda i, q, k, *a: seen.append((k, q.count())) or whole(i, q, k, *a))
    s = pipeline.Settings("hybrid_bm25_vector", 1, "overlap", 2, "hyde")
    got = pipeline.retrieve(index, asked, s, generated="more").filter("qid = 'q1'").orderBy("rank").collect()
    assert seen == [(3, 4)] and [r["rank"] for r in got] == [1, 2] and got[0]["id"] == "c0"
    none = pipeline.retrieve(index, asked, pipeline.Settings("graph", 2))
    assert none.count() == 0 and none.columns == ["qid", "rank", "id", "text", "score"]
    assert pipeline.retrieve(index, asked.limit(0), s, generated="more").count() == 0


def test_equal_texts_are_searched_once(spark, index, monkeypatch):
    seen, bm25 = [], retrieval.bm25
    monkeypatch.setattr(retrieval, "bm25", lambda docs, queries, *a: seen.append(queries.count()) or bm25(docs, queries, *a))
    asked = spark.createDataFrame([(f"q{i}", TEXTS[i % 2]) for i in range(8)], "id string, question string")
    by = {}
    for r in pipeline.retrieve(index, asked, pipeline.Settings("hybrid_graph_vector", 2)).collect():
        by.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"]))
    assert seen == [2] and sorted(by) == [f"q{i}" for i in range(8)]
    assert all(sorted(by[f"q{i}"]) == sorted(by[f"q{i % 2}"]) and min(by[f"q{i}"])[1] == f"c{i % 2}" for i in range(8))


def test_rows_embedded_in_place_equal_the_expressions(spark):
    from corpusmill.functions.vectors import hash_embed, hash_embed_rows

    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "Ärger über_die ²3 x-Y", "", None, "- _"])], "id bigint, text string")
    assert sorted(map(tuple, hash_embed_rows(docs, "id", "text").collect())) == sorted(map(tuple, hash_embed(docs, "id", "text").collect()))
    assert "Exchange" not in hash_embed_rows(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_checked(spark):
    with pytest.raises(ValueError):
        pipeline.checked_vectors(spark.createDataFrame([("a", [[1.0]])], "id string, vector array<array<double>>"))
    assert pipeline.checked_vectors(spark.createDataFrame([("a", [1])], "id string, vector array<int>")).schema["vector"].dataType.simpleString() == "array<double>"


def test_look_up_and_stream_agree(index, asked):
    q = asked.filter("question IS NOT NULL AND id IS NOT NULL").select("id", F.col("question").alias("text")).distinct()
    rows = lambda x: sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in x.collect())
    assert rows(index.search_text(q, 3, "id")) == rows(index.look_up_text(q, 3, "id")) != []


OPTIONS = {"A": "light and power", "B": "flour", "C": "birds", "D": "tables"}


def test_evaluate_gives_every_question_a_row(spark, index):
    def model():  # within the test, so that it is shipped by value
        def answer(prompt):
            if "sourdough" in prompt:
                raise RuntimeError("no answer")
            return "Answer: A"

        return answer

    exam = spark.createDataFrame([("q1", "how do solar panels give power", OPTIONS, "A"), ("q2", "what does sourdough bread need", OPTIONS, "B"), ("q3", "nothing", None, "A"), ("q4", None, OPTIONS, None)], "id string, question string, options map<string,string>, correct_answer string")
    hits = pipeline.retrieve(index, exam, pipeline.Settings(top_k=1))
    got = {r["question_id"]: r for r in pipeline.evaluate(exam, hits, OverlapGenerator()).collect()}
    assert got["q1"]["correct"] and got["q1"]["retrieved_context"] == TEXTS[0] and set(got) == {"q1", "q2", "q3", "q4"}
    assert (got["q3"]["selected_answer"], got["q3"]["generated_response"], got["q3"]["retrieved_context"], got["q3"]["correct"]) == ("INVALID", pipeline.ERROR_RESPONSE, "", False)
    got = {r["question_id"]: r for r in pipeline.evaluate(exam, hits, ModelGenerator(model)).collect()}
    assert got["q1"]["selected_answer"] == "A" and got["q2"]["selected_answer"] == "INVALID" and got["q2"]["generated_response"] == pipeline.ERROR_RESPONSE
    text = pipeline.failure_text(pipeline.evaluate(exam, hits, ModelGenerator(model)), exam).first()["text"]
    assert text.startswith("1. Question: what does sourdough") and "\n\n2. Question: \n" in text
    assert pipeline.evaluate(exam.limit(0), hits, OverlapGenerator()).count() == 0


def test_models_are_made_once_a_worker(spark):
    def make():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, "x" * i if i else None) for i in range(6)], "id int, t string").repartition(3)
    got = {r["id"]: r["vector"] for r in ModelEmbedder(make, 2).embed(rows, "id", "t").collect()}
    assert got[3] == [3.0, 1.0] and got[0] is None


class Stubborn:
    """Gives text that cannot be used at the first attempt, for one chunk never."""

    def generate(self, rows, attempt):
        good = F.to_json(F.struct(F.concat(F.lit("What is "), "id", F.lit("?")).alias("question"), F.create_map(*[F.lit(x) for k in "ABCD" for x in (k, f"{k} is an answer of its own kind {k}")]).alias("options"), F.lit("B").alias("correct_answer")))
        leaning = F.regexp_replace(good, "What is", "According to the text, what is")
        bad = F.lit("no question") if attempt == 0 else leaning if attempt == 1 else good
        return rows.withColumn("generated", F.when(F.col("id") == "never", F.lit(None).cast("string")).otherwise(bad))


def test_questions_are_retried(spark):
    rows = spark.createDataFrame([("one", "text"), ("never", "text")], "id string, text string")
    got = generation.questions_of(rows, Stubborn()).collect()
    assert [r["id"] for r in got] == ["one"] and got[0]["question"] == "What is one?" and got[0]["options"][got[0]["correct_answer"]].startswith("B")
    assert generation.questions_of(rows, Stubborn(), attempts=2).count() == 0


def test_parsed_questions(spark):
    good = json.dumps({"question": "Q?", "options": {k: k for k in "ABCD"}, "correct_answer": "C", "reasoning": "r"})
    rows = [(good, True), (f"```json\n{good[:-1]}, }}\n```", True), (f"Here: {good} done", True), ("nothing", False), (good.replace('"D"', '"E"', 1), False), (good.replace('"C", "reas', '"Z", "reas'), False), (None, False), ("", False)]
    got = spark.createDataFrame(rows, "t string, ok boolean").select("ok", generation.parsed_question(F.col("t")).isNotNull().alias("q")).collect()
    assert all(r["ok"] == r["q"] for r in got)


def test_generated_exam(spark):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(f"c{i}", " ".join(rng.choice(words) for _ in range(20)), i % 3) for i in range(60)] + [("short", "two words", 0), (None, "x", 0), ("c0", None, 1)]
    chunks = spark.createDataFrame(rows, "id string, text string, label int")
    labels = chunks.filter("id IS NOT NULL AND text IS NOT NULL").select("id", "label")
    pool = chunks.filter("id IS NOT NULL")
    got = generation.generate_exam(pool, 9, generation.ClozeGenerator(pool, 4), labels=labels).collect()
    assert len(got) == 9 and {sum(r["cluster_id"] == k for r in got) for k in range(3)} == {3} and len({r["id"] for r in got}) == 9
    assert all(sorted(r["options"]) == list("ABCD") and r["source_chunk_id"] for r in got)
    text = {r[0]: r[1] for r in rows if r[1]}
    assert all(r["options"][r["correct_answer"]] in text[r["source_chunk_id"]] for r in got)
    vectors = HashEmbedder().embed(pool, "id", "text")
    again = generation.generate_exam(pool.join(vectors, "id"), 6, generation.ClozeGenerator(pool, 4), restarts=1)
    assert 1 <= again.count() <= 6
    assert generation.generate_exam(pool.limit(0), 9, generation.ClozeGenerator(pool.limit(0)), labels=labels.limit(0)).count() == 0


def test_repeated_questions_are_dropped(spark):
    rows = [("a", "what is the size of the red lamp", 0, 1), ("b", "what is the size of the red lamp", 0, 2), ("c", "who built the bridge", 1, 1), ("d", None, 1, 2)]
    q = spark.createDataFrame(rows, "id string, question string, cluster_id int, turn int")
    assert {r["id"] for r in generation.without_repeats(q).collect()} == {"a", "c", "d"}


def test_culled_and_refined(spark, caplog):
    q = spark.createDataFrame([(f"q{i}", "t", i) for i in range(10)], "id string, question string, source_chunk_id int")
    p = spark.createDataFrame([(f"q{i}", 0.5 if i < 3 else 1.0, 0.5, 0.25) for i in range(10)], "question_id string, a double, b double, g double")
    assert {r["question_id"] for r in items.culled(p, ratio=0.25).collect()} == {"q0", "q1"} and items.culled(p.limit(0)).count() == 0
    short = spark.createDataFrame([("n1", "new", 77)], "id string, question string, source_chunk_id int")
    assert {r["id"] for r in items.refined(q, p, short, 0.25).collect()} == {"q2", *(f"q{i}" for i in range(3, 10)), "n1"}
    assert "fewer replacements" in caplog.text


SPACE = Space(
    {"structural.parser": ["html"], "structural.chunking_strategy": ["recursive"], "structural.embedding_model": ["hash"], "structural.index_type": ["hybrid_bm25_vector"], "runtime.reranker": ["none"], "runtime.query_expansion": ["none"], "runtime.llm_model": ["overlap"]},
    {"structural.chunk_size": Span(64, 128), "structural.chunk_overlap": Span(8, 16), "runtime.top_k": Span(1, 3), "runtime.hybrid_alpha": Span(0, 1), "runtime.temperature": Span(0, 1), "runtime.reranker_top_n": Span(1, 3)},
)


def test_replies_are_read_and_refused(spark):
    assert loop.yaml_block("a\n```yaml\nx: 1\n```\n```\ny\n```") == "x: 1" and loop.yaml_block("```\nz: 2\n```") == "z: 2"
    with pytest.raises(ValueError):
        loop.yaml_block("x: 1")
    first = loop.TweakProposer(SPACE).propose(None, "", [], [])
    assert first.outside(spark, SPACE) == []
    import yaml

    good = "Fine:\n```yml\n" + yaml.safe_dump({"structural": first.structural, "runtime": {**first.runtime, "top_k": 3}}) + "```"
    wrong = good.replace("top_k: 3", "top_k: 30")
    prompts, replies = [], iter(["no fence", wrong, good])
    got = loop.next_trial(spark, loop.ReplyProposer(lambda p: prompts.append(p) or next(replies), SPACE), SPACE, None)
    assert got.runtime["top_k"] == 3 and "no fenced block" in prompts[1] and "runtime.top_k" in prompts[2]
    silent = loop.ReplyProposer(lambda p: "", SPACE)
    assert loop.next_trial(spark, silent, SPACE, got) == got
    with pytest.raises(RuntimeError):
        loop.next_trial(spark, silent, SPACE, None, calls=2)


def test_optimize_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, (t + ". ") * 3) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    exam = spark.createDataFrame([("q1", "how do solar panels give power", OPTIONS, "A"), ("q2", "what does sourdough bread need", OPTIONS, "B")], "id string, question string, options map<string,string>, correct_answer string")
    best = loop.optimize(docs, exam, SPACE, str(tmp_path), 2)
    past = history.read(spark, str(tmp_path / "history"))
    assert best["score"] >= 0.5 and best["number"] == 1 and past.count() == 2 and history.flat_results(past).count() == 4
    assert len(list((tmp_path / "indices").iterdir())) == 1  # the second trial found the first one's index
    loop.save_best(best, tmp_path / "best.yaml")
    assert loop.read_trial("```yaml\n" + (tmp_path / "best.yaml").read_text() + "```") == best["trial"]
    loop.save_best({}, tmp_path / "none.yaml")
    assert not (tmp_path / "none.yaml").exists()
    loop.save_exam(exam, tmp_path / "exam.json")
    assert [x["id"] for x in json.loads((tmp_path / "exam.json").read_text())] == ["q1", "q2"]
    results = loop.run_trial(docs, exam, best["trial"])
    loop.save_result(results, tmp_path / "result.json")
    assert loop.read_result(spark, str(tmp_path / "result.json")).count() == 2
    broken = loop.Trial({**best["trial"].structural, "chunking_strategy": "semantic"}, best["trial"].runtime)
    with pytest.raises(ValueError):
        loop.run_trial(docs, exam, broken)


def test_index_store(spark, tmp_path, index):
    index.save(str(tmp_path / "i"), "hybrid_bm25_vector")
    assert store.metadata(spark, str(tmp_path / "i")) == {"index_type": "hybrid_bm25_vector", "n_chunks": 5}
    assert store.load(spark, str(tmp_path / "i")).chunks.count() == 5
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"))


def test_empty_corpus(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    with pytest.raises(ValueError):
        corpus.documents(corpus.read_corpus(spark, str(tmp_path)))


def test_fingerprint_with_graph(spark):
    kind = "struct<parser:string,chunking_strategy:string,chunk_size:int,chunk_overlap:int,embedding_model:string,index_type:string>"
    rows = [(("p", "r", 1, 0, "e", "graph"), ("networkx", ["b", "a"])), (("p", "r", 1, 0, "e", "graph"), ("networkx", ["a", "b"])), (("p", "r", 1, 0, "e", "graph"), None)]
    df = spark.createDataFrame(rows, f"s {kind}, g struct<graph_backend:string,entity_types:array<string>>")
    a, b, c = [r[0] for r in df.select(fingerprint(F.col("s"), F.col("g"))).collect()]
    assert a == b != c and c == df.select(fingerprint(F.col("s"))).first()[0]


def test_questions_of_a_model(spark):
    def model():
        def reply(prompt):
            text = prompt.rsplit("Text:", 1)[1].strip()
            if text == "broken":
                raise RuntimeError("no reply")
            return json.dumps({"question": f"What about {text}?", "options": {k: f"{k} {text} of a kind" for k in "ABCD"}, "correct_answer": "D", "reasoning": "r"})

        return reply

    rows = spark.createDataFrame([("one", "lamps"), ("two", "broken")], "id string, text string")
    got = generation.questions_of(rows, generation.ModelQuestions(ModelGenerator(model))).collect()
    assert [(r["id"], r["question"]) for r in got] == [("one", "What about lamps?")]


def _zip(**files):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_parsers(spark, tmp_path):
    import zlib

    from corpusmill.sources import parsers

    w = 'xmlns:w="w"'
    docx = _zip(word__document_xml=f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>A </w:t></w:r><w:r><w:t>line.</w:t></w:r></w:p></w:body></w:document>')
    assert parsers.docx_text(docx) == "# Title\n\nA line."
    pptx = _zip(ppt__slides__slide2_xml='<s xmlns:a="a"><a:p><a:t>two</a:t></a:p></s>', ppt__slides__slide1_xml='<s xmlns:a="a"><a:p><a:t>one</a:t></a:p></s>')
    assert parsers.pptx_text(pptx) == "one\n\ntwo"
    xlsx = _zip(xl__sharedStrings_xml="<sst><si><t>name</t></si></sst>", xl__worksheets__sheet1_xml='<ws><row><c t="s"><v>0</v></c><c><v>7</v></c></row><row><c t="inlineStr"><is><t>x</t></is></c></row></ws>')
    assert parsers.xlsx_text(xlsx) == "| name | 7 |\n| --- | --- |\n| x |  |"
    assert parsers.csv_text(b"a,b\n1,2\n") == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    page = zlib.compress(rb"BT /F1 12 Tf 72 700 Td (One sentence \(here\).) Tj T* <4142> Tj ET")
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Length 1 >>\nstream\n" + page + b"\nendstream\nendobj\n"
    assert parsers.pdf_text(pdf) == "One sentence (here).\nAB"
    (tmp_path / "a.pdf").write_bytes(pdf)
    (tmp_path / "b.docx").write_bytes(docx)
    (tmp_path / "c.png").write_bytes(b"x")
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / ".e.md").write_bytes(b"hidden")
    (tmp_path / "g.md").write_bytes(b"broken \xff ")
    (tmp_path / "f.json").write_text("{}")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in corpus.read_corpus(spark, str(tmp_path), "docling").collect()}
    assert got["a.pdf"][0].startswith("One sentence") and got["b.docx"][0].startswith("# Title") and got["c.png"][1] and got["d.docx"][1] and got["f.json"][1] == "unsupported" and got["g.md"][1] and ".e.md" not in got
    loose = {r["path"].rsplit("/", 1)[1]: r["text"] for r in corpus.read_corpus(spark, str(tmp_path), "pymupdf4llm", lenient=True).collect()}
    assert loose["g.md"] == "broken \ufffd " and ".e.md" not in loose and "f.json" not in loose and loose["a.pdf"].startswith("One")
