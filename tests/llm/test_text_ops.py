"""Cut texts, leaks, mixes, near-duplicates and broken pairs."""

import random

import pytest

from corpusmill.llm import cutoff, leak, mixing, neardup, pairs
from corpusmill.llm.queries import TOKENIZER

WORDS = "river table lamp stone quiet green window morning paper engine silver market garden winter letter music bridge forest button candle".split()


def sentence(rng, n=8):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def text(rng, k=6):
    return " ".join(sentence(rng) for _ in range(k))


# ---- cut texts


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    return [(i, text(rng), f"s{i % 3}", 7) for i in range(n)]


def test_cut_texts(spark):
    rows = corpus()
    whole = dict((r[0], r[1]) for r in rows)
    cut = {1000: whole[0][:-12], 1001: whole[1] + "..", 1002: whole[2][:-5] + "…", 1003: whole[3] + "\n```python\nx = 1", 1004: whole[4][:-1] + " �", 1005: whole[5] + " <b", 1006: whole[6] + "\nriver table &am"}
    fine = {1100: whole[7] + "\n```\nx = 1\n```", 1101: whole[8] + "  \n​", 1102: whole[0]}
    blank = [(2000, None, "s0", 1), (2001, "", "s0", 1), (2002, " \n ", None, 1)]
    extra = [(i, t, None, 1) for i, t in {**cut, **fine}.items()]
    df = spark.createDataFrame(rows + extra + blank + extra[:1], "doc_id bigint, text string, source string, tail int")
    got = cutoff.cut_texts(df).collect()
    found = {r["doc_id"] for r in got if r["cut"]}
    assert found == set(cut)
    assert {2000, 2001, 2002}.isdisjoint(r["doc_id"] for r in got)
    assert sum(r["doc_id"] == 1000 for r in got) == 2
    rates = {r["source"]: (r["texts"], r["cut_texts"]) for r in cutoff.cut_rates(df).collect()}
    assert rates[None] == (len(extra) + 1, len(cut) + 1) and rates["s0"] == (134, 0)


def test_cut_texts_of_nothing_and_long(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert cutoff.cut_texts(df).count() == 0 and cutoff.cut_rates(df).count() == 0
    rng = random.Random(1)
    long = spark.createDataFrame(corpus() + [(9999, text(rng, 20000) + " River table", "s0", 1)], "doc_id bigint, text string, source string, w int")
    assert {r["doc_id"] for r in cutoff.cut_texts(long).filter("cut").collect()} == {9999}


# ---- leaks


def test_leaks_of_short_items(spark):
    rng = random.Random(9)
    noise = [f"n{i}" for i in range(400)]
    filler = lambda n: " ".join(rng.choice(noise) for _ in range(n))
    three, five, twelve, fifty = "quick brown fox", "one two three four five", " ".join(f"t{i}" for i in range(12)), " ".join(f"f{i}" for i in range(50))
    edited = " ".join("x" if i % 6 == 5 else f"f{i}" for i in range(6, 35))
    items = [(1, three), (2, five), (3, twelve), (4, fifty), (5, None), (6, "")]
    docs = [(1, filler(30) + " Quick, brown FOX " + filler(9)), (2, filler(8) + " " + five), (3, filler(30) + " t4 t5 t6 t7 t8 " + filler(30)), (4, filler(20) + " " + edited + " " + filler(20)),
            (5, filler(40) + " quick brown"), (6, filler(20) + " one two three four"), (7, filler(9) + " t4 t5 t6 t7 " + filler(9)), (8, None)]
    got = leak.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_leaks(spark):
    rng = random.Random(3)
    vocab = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi") for b in ("ro", "ta", "si", "ne", "du") for c in ("x", "n", "l", "m", "p", "k")]
    item = lambda: " ".join(rng.choice(vocab) for _ in range(50))
    items = [(i, item(), "z") for i in range(20)]
    body = lambda: " ".join(rng.choice(vocab) for _ in range(120))
    w = items[0][1].split()
    part = w[10:34]
    edited = part[:9] + ["other"] + part[10:15] + part[16:]
    docs = [
        (1, body() + " " + items[0][1].upper().replace(" ", ",\n ") + " " + body()),
        (2, body() + " " + " ".join(edited) + " " + body()),
        (3, body() + " " + " ".join(w[:12]) + " " + body()),
        (4, body() + " " + "​".join(items[1][1].replace(" ", " ")) + " " + body()),
        (5, None), (6, ""), (7, " ".join(body() for _ in range(300)) + " " + items[2][1]), (8, items[3][1] + " " + body() + " " + items[3][1]),
        (9, items[4][1][:100] + "\n" + items[4][1][100:]),
    ]
    d = spark.createDataFrame(docs + docs[:1], "doc_id bigint, text string").withColumn("item_id", __import__("pyspark").sql.functions.lit(5))
    t = spark.createDataFrame(items + items[:2] + [(90, None, ""), (91, "", ""), (92, "two words", "")], "item_id bigint, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["share"] for r in leak.leaks(d, t).collect()}
    assert set(got) == {(1, 0), (2, 0), (4, 1), (7, 2), (8, 3), (9, 4)}
    assert got[(1, 0)] == 1.0 and leak.leaks(d, t).count() == 6
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert leak.leaks(empty, t).count() == 0
    assert leak.leaks(d, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_items_leaked_everywhere_and_slices(spark, monkeypatch):
    rng = random.Random(4)
    it = [(i, " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(30))) for i in range(3)]
    docs = [(k, text(rng) + " " + it[0][1]) for k in range(200)]
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(it, "item_id bigint, text string")
    monkeypatch.setattr(leak, "SLICE_WORDS", 40)
    assert {(r["doc_id"], r["item_id"]) for r in leak.leaks(d, t).collect()} == {(k, 0) for k in range(200)}


def test_alignment_matches_plain_smith_waterman():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.integers(10, 14, (6, 9)).astype(np.uint64), rng.integers(10, 14, (6, 15)).astype(np.uint64)
    for r in range(6):
        h = np.zeros((10, 16), int)
        for i in range(9):
            for j in range(15):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[r, i] == b[r, j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert leak.align(a[r : r + 1], b[r : r + 1])[0] == h.max()


# ---- mixes


def water_fill(size, target, cap, total):
    take, free = {s: 0.0 for s in target}, {s for s in target if target[s] > 0}
    rest = total
    while free:
        w = sum(target[s] for s in free)
        over = {s for s in free if rest * target[s] / w > cap[s] * size.get(s, 0) + 1e-9}
        if not over:
            for s in free:
                take[s] = rest * target[s] / w
            break
        for s in over:
            take[s] = float(cap[s] * size.get(s, 0))
            rest -= take[s]
        free -= over
    return take


@pytest.mark.parametrize("seed", range(6))
def test_water_filling(spark, seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(7)]
    size = {s: rng.randint(0, 500) for s in names[:6]}
    w = [rng.random() if rng.random() > 0.2 else 0.0 for _ in names]
    target = {s: x / (sum(w) or 1) for s, x in zip(names, w)}
    cap = {s: rng.randint(1, 3) for s in names}
    sizes = spark.createDataFrame([(s, 1, n) for s, n in size.items()] + [(None, 1, 100), ("else", 1, 50)], "source string, docs long, size long")
    targets = spark.createDataFrame([(s, target[s], cap[s]) for s in names] + [(None, 0.5, 1)], "source string, target_share double, max_repeat int")
    total = sum(size.values()) + 150
    want = water_fill(size, target, cap, total)
    for r in mixing.plan(sizes, targets).collect():
        assert r["planned"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert r["short"] == (cap[r["source"]] * size.get(r["source"], 0) < target[r["source"]] * total)


def test_mix_repeats_whole_and_in_part(spark):
    docs = spark.createDataFrame([(i, "word " * 10, "a" if i < 100 else "b", 3) for i in range(1000)] + [(5000, None, "b", 1), (5001, "x", None, 1)], "doc_id bigint, text string, source string, size int")
    targets = spark.createDataFrame([("a", 0.25, 4), ("b", 0.75, 2), ("gone", 0.0, 1)], "source string, target_share double, max_repeat int")
    rep = {r["source"]: r for r in mixing.report(docs, targets, TOKENIZER).collect()}
    assert rep["a"]["actual_share"] == pytest.approx(0.25, abs=0.02) and rep["gone"]["records"] == 0
    passes = mixing.plan(mixing.sizes_by_source(docs, TOKENIZER), targets)
    one, two = ({(r["doc_id"], r["copy_no"], r["source"]) for r in mixing.mixed(docs.select("doc_id", "source"), passes).collect()} for _ in range(2))
    assert max(n for _, n, s in one if s == "a") <= 4
    assert one == two and len(one) > 1000
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.report(none, targets, TOKENIZER).count() == 3
    assert mixing.report(docs, spark.createDataFrame([], "source string, target_share double, max_repeat int"), TOKENIZER).count() == 0


# ---- near-duplicates


def bag(q, o):
    import re
    from collections import Counter

    return Counter(re.findall(r"\w+", " ".join([q, *(v for v in (o or {}).values() if v)]).lower()))


def sim(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_near_duplicates(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(40):
        base = [rng.choice(vocab) for _ in range(30)]
        for v in range(3):
            words = base[:]
            for _ in range(v * 2):
                words[rng.randrange(30)] = rng.choice(vocab)
            if v == 2:
                words = words[15:] + words[:15]
            rows.append((f"q{g:02d}{v}", " ".join(words[:20]).upper() + "?", {"A": " ".join(words[20:]), "B": None}))
    rows += [("n1", None, {"A": "x"}), (None, "some text", None), ("e1", "", None), ("e2", "?!", {}), ("long", "word " * 50000, None)]
    rows += [("copy1", rows[0][1], rows[0][2]), ("copy2", rows[0][1].lower(), rows[0][2])]
    df = spark.createDataFrame(rows + rows[:4], "id string, question string, options map<string,string>").withColumn("rep", __import__("pyspark").sql.functions.lit(1))
    want = set()
    kept = [(i, bag(q, o)) for i, q, o in rows if i and q is not None]
    for x in range(len(kept)):
        for y in range(x):
            a, b = kept[x], kept[y]
            if sim(a[1], b[1]) >= 0.75 or a[1] == b[1]:
                want.add(tuple(sorted((a[0], b[0]))))
    got = {(r["id_a"], r["id_b"]) for r in neardup.pairs(df).collect()}
    assert got == want
    g = {r["id"]: (r["class_id"], r["group_id"], r["links"]) for r in neardup.groups(df).collect()}
    assert g["q000"][0] == g["copy1"][0] == "copy1" and g["e1"][:2] == g["e2"][:2] == ("e1", "e1") and g["long"] == ("long", "long", 0)
    for a, b in want:
        assert g[a][1] == g[b][1]


def test_hot_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = [f"w{i}" for i in range(60)]
    rows = [(f"h{k:03d}", " ".join(base + [f"own{k}"]), None) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, question string, options map<string,string>")
    assert neardup.pairs(df).count() == 40 * 39 // 2


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id string, question string, options map<string,string>")
    assert neardup.pairs(df).count() == 0 and neardup.groups(df).count() == 0


# ---- broken pairs

Q = "Which of the changes to the index keeps the recall of the reader above the limit when the cache is rebuilt?"
O = {"A": "the cache is read before the index", "B": "only a small table of 40 rows", "C": "the reader is moved to the limit", "D": "an index without any cache"}
CASES = [
    ("empty", None), ("empty", " \n"), ("empty", "```\n```"), ("empty", "<answer></answer>"), ("empty", '{"answer": ""}'), ("empty", "N/A"), ("empty", "..."), ("empty", "QUESTION_EVALUATION_ERROR"),
    ("refusal", "I'm sorry, but I cannot answer this question."), ("refusal", "Leider gilt: ich kann diese Frage nicht beantworten."), ("refusal", "Prefiero no dar una respuesta."),
    ("copy", Q), ("copy", "> " + Q.upper()), ("copy", Q + "\nA) " + O["A"] + "\nB) " + O["B"] + "\nC) " + O["C"] + "\nD) " + O["D"]),
    ("truncated", "Option A holds. The cache is read before the ind"), ("truncated", "The answer is ("), ("truncated", "The answer is"), ("truncated", '{"answer": "B", "reason": "The cache'), ("truncated", "The answer is: **"),
    ("other_language", "Die Antwort ist B, weil der Cache vor dem Index gelesen wird."), ("other_language", "Je prends D. La lecture est faite avant la fin de chaque liste."),
    (None, "B"), (None, "b"), (None, "**C**"), (None, '{"answer": "A"}'), (None, "D) an index without any cache"), (None, "The cache is rebuilt before the index is read."), (None, Q + " The correct choice is A."),
    (None, "I was unable to rule out more than two, yet C is right."), (None, "I would go with A"), (None, "Which of the changes keeps the recall? Option B fits best."),
]


def results(spark, rows):
    return spark.createDataFrame(rows, "result_id bigint, question_id string, generated_response string, loaded_at timestamp, qid string")


def test_defects(spark):
    import datetime as dt

    day = dt.datetime(2025, 1, 1)
    rows = [(i, "q", r, day, "clash") for i, (_, r) in enumerate(CASES)]
    filler = [(1000 + i, "q", t, day, "") for i, t in enumerate(["The answer is A.", "It must be B.", "I would go with C", "Option D fits best.", "The cache is read."] * 60)]
    twice = [(5000, "q", "The answer is", day, ""), (5000, "q", "The answer is B.", day + dt.timedelta(1), ""), (None, "q", "", day, "")]
    gone = [(6000, "missing", "Die Antwort ist B, weil der Cache vor dem Index gelesen wird.", day, ""), (6001, None, "The answer is B.", day, ""), (6002, "q", "The cache is read before the index. " * 3000 + "The ind", day, "")]
    questions = spark.createDataFrame([("q", Q, O, "x"), ("q", Q, O, "x"), ("n", None, None, "x"), (None, "y", None, "x")], "id string, question string, options map<string,string>, result string")
    got = {r["result_id"]: r["defect"] for r in pairs.defects(results(spark, rows + filler + twice + gone + rows[:5]), questions).collect()}
    want = {i: d for i, (d, _) in enumerate(CASES) if d} | {6000: "other_language", 6002: "truncated"}
    assert got == want


def test_defects_of_nothing_and_hot_question(spark, monkeypatch):
    import datetime as dt

    questions = spark.createDataFrame([("q", Q, None)], "id string, question string, options map<string,string>")
    assert pairs.defects(results(spark, []), questions).count() == 0
    left = spark.createDataFrame([(i, "q" if i % 3 else "r") for i in range(30000)], "result bigint, k string")
    right = spark.createDataFrame([("q", 1)], "k string, v int")
    out = pairs.salted_join(left, right, "k")
    assert out.count() == 30000 and out.filter("v = 1").count() == 20000
    one = results(spark, [(1, "q", "A", dt.datetime(2025, 1, 1), "")])
    assert pairs.defects(one, spark.createDataFrame([], "id string, question string, options map<string,string>")).count() == 0


def test_refusals_and_languages_beyond_the_phrases():
    options = ["red lamp", "blue stone"]
    for t in (
        "I am afraid I am not in a position to pick one of these.", "There is no basis on which I could single out a choice.", "We won't commit to any of the four.",
        "Ich sehe mich außerstande, hier eine Auswahl zu treffen.", "Mir ist es nicht gegeben, das zu entscheiden.", "Je suis incapable de trancher entre ces propositions.",
        "Il m'est impossible de désigner la bonne proposition.", "No soy capaz de decidir entre las opciones.", "Me es imposible elegir una de ellas.",
    ):
        assert pairs.declines(t, options), t
    for t in ("The valve cannot open before the pump has stopped.", "I cannot say more than that the red lamp is on.", "B) blue stone", "Das Ventil öffnet nicht vor dem Start der Pumpe.", "El motor no arranca sin la llave.", "La pompe ne démarre pas sans clé."):
        assert not pairs.declines(t, options), t
    assert pairs.language("Il motore non parte perché la pompa è sempre ferma quando il serbatoio viene svuotato.") == "it"
    assert pairs.language("De pomp wordt niet gestart omdat het reservoir met het ventiel is verbonden.") == "nl"
    assert pairs.language("泵在启动之前必须检查阀门。") == "han" and pairs.language("Насос не запускается до открытия клапана.") == "cyrillic"
    assert pairs.language("The pump is started before the valve opens.") == "en" and pairs.language("Die Pumpe ist nicht mit dem Ventil verbunden.") == "de"
    assert pairs.defect("Il motore non parte perché la pompa è sempre ferma quando il serbatoio viene svuotato.", "When is the pump started?", [("A", "x"), ("B", "y")], {"": 0.0}) == "other_language"


def test_copies_keep_the_labels_of_options():
    question = "Which lamp in the long hall of the old station burns until the morning comes?"
    labelled = [("A", "the zinc lamp beside the gate"), ("B", "the amber lamp above the stairs"), ("C", "the blue lamp"), ("D", "the lamp")]
    assert pairs.is_copy(question + " " + " ".join(f"{k}) {o}" for k, o in labelled) + ". So.", question, labelled)
