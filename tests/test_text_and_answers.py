"""Text functions, answers and JSON against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import answers, text


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def jaccard(a, b, n):
    x, y = a.lower().split(), b.lower().split()
    if not x or not y:
        return 0.0
    g = (lambda t: set(t)) if min(len(x), len(y)) < n else (lambda t: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)})
    return len(g(x) & g(y)) / len(g(x) | g(y))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_jaccard_ngram(spark, n):
    rng = random.Random(n)
    made = lambda: " ".join(rng.choice(["a", "b", "C", "d e", " "]) for _ in range(rng.randint(0, 9)))
    data = [(i, made(), made()) for i in range(120)]
    out = spark.createDataFrame(data, "i int, a string, b string").select("i", text.jaccard_ngram(F.col("a"), F.col("b"), n))
    for i, got in rows_of(out):
        assert got == pytest.approx(jaccard(data[i][1], data[i][2], n))
    assert rows_of(spark.createDataFrame([(None, "x")], "a string, b string").select(text.jaccard_ngram(F.col("a"), F.col("b"))))[0][0] == 0.0


def test_stripped_and_tokens(spark):
    data = ["  a b ", "\tx\n", "", " ", None, "word " * 30000]
    out = rows_of(spark.createDataFrame([(x,) for x in data], "t string").select(text.stripped(F.col("t")), text.split_tokens(F.col("t"))))
    for x, (s, t) in zip(data, out):
        assert s == (x.strip() if x is not None else None)
        assert t == (x.lower().split() if x is not None else None)


def test_self_contained(spark):
    bad = ["What does the above passage say?", 'As described in "Notes", why?', "Based on the given text, which is it?", "According to the paper, what holds?", 'Which article "X" is it?']
    good = ["What is a cache?", "Which text editor loads the passage of time?", ""]
    out = rows_of(spark.createDataFrame([(x,) for x in bad + good + [None]], "t string").select(text.self_contained(F.col("t"))))
    assert [x[0] for x in out] == [False] * 5 + [True] * 3 + [None]


@pytest.mark.parametrize(
    ("response", "want"),
    [("B", "B"), ("b", "B"), ("The answer is C", "C"), ("answer: d", "D"), ("A) because", "A"), ("I think B. It is", "B"), ("so it is D", "D"), ("  c  ", "C"),
     ("no idea", "INVALID"), ("", "INVALID"), ("Maybe this choice: D", "D"), ("ABCD", "INVALID"), ("The answer is B, not A", "B")],
)
def test_parse_answer(spark, response, want):
    assert rows_of(spark.createDataFrame([(response,)], "t string").select(answers.parse_answer(F.col("t"))))[0][0] == want


def test_parse_answer_keys_and_null(spark):
    df = spark.createDataFrame([("The answer is D",), (None,)], "t string")
    assert [r[0] for r in rows_of(df.select(answers.parse_answer(F.col("t"), ("A", "B", "C"))))] == ["INVALID", "INVALID"]


def test_json_of_generated_text(spark):
    data = ['{"a": 1, "b": "x"}', '```json\n{"a": 1, "b": "x",}\n```', 'Sure: {"a": 1, "b": "x"} done {"a": 2}', "{broken", "", None, "[1]", '{"a": 1, "b": "x"']
    out = rows_of(spark.createDataFrame([(x,) for x in data], "t string").select(answers.parsed_object(F.col("t"), "a int, b string").alias("o")).select("o.a", "o.b"))
    assert out == [(1, "x")] * 3 + [(None, None)] * 5


def test_options(spark):
    good, three = {k: k.lower() for k in "ABCD"}, {k: "x" for k in "ABC"}
    df = spark.createDataFrame([("q", good, "A"), ("q", three, "A"), ("q", good, "E"), ("q", None, "A"), ("q", good, None)], "id string, o map<string,string>, a string")
    assert [r[0] for r in rows_of(df.select(answers.valid_options(F.col("o"), F.col("a"))))] == [True, False, False, False, False]


def test_shuffle_keeps_the_answer_and_spreads_it(spark):
    data = [(f"q{i}", {"A": "w", "B": "x", "C": "y", "D": "z"}, "B") for i in range(400)]
    df = spark.createDataFrame(data, "id string, o map<string,string>, a string")
    o, a = answers.shuffled_options(F.col("id"), F.col("o"), F.col("a"))
    out = rows_of(df.select(o, a))
    assert all(sorted(m.values()) == ["w", "x", "y", "z"] and m[k] == "x" for m, k in out)
    assert all(sum(k == x for _, k in out) > 50 for x in "ABCD")
    twin = spark.createDataFrame([("q", {"A": "s", "B": "s", "C": "t", "D": "u"}, "A")], "id string, o map<string,string>, a string")
    m, k = rows_of(twin.select(o, a))[0]
    assert k == max(x for x in m if m[x] == "s")


def test_hash_embedding(spark):
    import hashlib

    from corpusmill.functions.vectors import cosine, hash_embed

    docs = spark.createDataFrame([(1, "Red red fox"), (2, None), (3, ""), (4, "!?")], "doc_id bigint, text string")
    out = hash_embed(docs, "doc_id", "text").collect()
    assert [r["id"] for r in out] == [1]
    want = [0.0] * 64
    for w in ("red", "red", "fox"):
        want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
    n = sum(x * x for x in want) ** 0.5
    assert out[0]["vector"] == pytest.approx([x / n for x in want])
    two = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in two.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
