"""Broken prompt and response pairs.

Each response is judged against its question.  Copies are found by compressing the response with
the prompt as a zstandard dictionary (nothing new is left) and the question with the response
as dictionary (most of it is there); refusals and languages by dictionaries; cut responses by a
model of terminal contexts, which counts over all responses how often the shapes of three tokens end
one.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import ship_package, written

DEFECTS = ("empty", "copy", "refusal", "truncated", "other_language")
#: A final context is not terminal when its share of ends is below so many times that of any position
#: (one over the mean number of tokens of a response); prior weight of an unseen context.
MAX_LIFT, PRIOR = 0.5, 20
#: Bytes of a response that its prompt does not explain, as a share of its length, and at least.
NEW_SHARE, NEW_LEAST = 0.2, 24
#: Share of the question's own compressed size that is left once the response is known.
LEFT_SHARE = 0.5
#: A question asked in more than this share of the answers is joined in SALTS parts.
HOT_SHARE, SALTS = 0.01, 16

# Frequent function words by language.
STOP = {
    "en": "the of and is a an to in with if which each was its on before after when not for by while but their that this it be or as are were than from within every between only without under until because unless",
    "de": "der die das und ist ein eine einen von mit im in wenn nicht den dem für auf des zu sobald während jede jeden jedes weil falls nachdem bis obwohl solange zwischen ich es aber als auch bei nach vor hinter trotz unter neben dank aus wird sich nur da dass",
    "fr": "le la les de des du et est une un dans que qui pour avec sur quand si pas chaque lorsque après plus entre alors tant dès là où à côté je ce mais se au aux sans sous avant derrière pendant puisque elle il son sa ses cette trouve parce",
    "es": "el la los las de del y es una un en que con por para cuando si no cada pues entre donde más porque hay aunque mientras ya lo se junto a frente como pero es sin sobre antes tras bajo durante siempre apenas desde hasta su al este esta ni",
}
# Function words of languages questions are not asked in.
STOP_OTHER = {
    "it": "il gli della dello delle degli nella nello nelle che è sono una uno perché quando non più con questo questa viene sempre dopo prima anche dal dalla alla allo ogni tra oppure senza quindi essere",
    "pt": "o os as não uma um em que é são com para quando mais do da dos das pelo pela se depois antes cada também porque isso este esta foi ser está entre sem até seu sua",
    "nl": "het een van niet dat is met voor wanneer op zijn wordt ook maar naar omdat deze dit bij tot door elke tussen zonder dan nog wel heeft worden uit over",
    "sv": "och att det är som på inte för med av ett när varje efter innan eftersom denna detta mellan utan också från till hos blir har skall eller",
    "pl": "nie jest się że na w z do oraz gdy każdy przed po ponieważ ten ta to między bez także od przez jak tylko są być lub przy",
    "da": "og at det er som på ikke for med af et når hver efter før fordi denne dette mellem uden også fra til bliver har skal eller kun",
    "tr": "ve bir bu için ile olarak değil daha gibi kadar sonra önce çünkü her olan ancak veya ise ne var yok",
    "cs": "a že se na je v z do nebo když každý před po protože tento tato mezi bez také od pro jako pouze jsou být při",
    "fi": "ja on ei että se joka kun myös ovat mutta tai sekä kuin ennen jälkeen koska ilman jokainen vain niin tämä",
}
# Phrases with which a response declines to answer.
REFUSALS = [
    "cannot answer", "can't answer", "can not answer", "unable to answer", "not able to answer", "not able to pick", "unable to pick", "cannot pick", "can't pick",
    "must decline", "have to decline", "i decline", "won't be able to help", "will not be able to help", "cannot help with", "can't help with", "unable to help",
    "not enough information", "insufficient information", "impossible to say", "impossible to tell", "impossible to choose", "none of this lets me", "does not let me decide",
    "doesn't let me decide", "don't feel comfortable", "do not feel comfortable", "not comfortable selecting", "cannot choose", "can't choose", "unable to choose", "cannot decide",
    "can't decide", "unable to decide", "unable to determine", "cannot determine", "can't determine", "cannot select", "prefer not to answer", "rather not answer", "will not answer", "won't answer",
    "kann diese frage nicht beantworten", "kann die frage nicht beantworten", "keine antwort geben", "reicht nicht für eine wahl", "nicht beantworten", "keine auswahl treffen",
    "nicht entscheiden", "nicht möglich zu sagen", "unmöglich zu sagen", "nicht genug information", "nicht genügend information", "dabei nicht helfen", "möchte nicht antworten",
    "ne peux pas répondre", "ne pas donner de réponse", "ne permet pas de choisir", "ne peux pas choisir", "impossible de répondre", "impossible de dire", "impossible de choisir", "refuse de répondre",
    "pas assez d'informations", "ne peux pas aider", "ne permet pas de répondre", "ne pas répondre",
    "no puedo responder", "no dar una respuesta", "no puedo elegir", "no permite elegir", "no basta para elegir", "imposible decir", "imposible responder", "imposible elegir", "no hay suficiente información",
    "no puedo ayudar", "no puedo contestar", "no puedo decidir", "no alcanza para elegir", "prefiero no responder",
]
# What stands for a missing answer, and the evaluator's error marker.
PLACEHOLDERS = {"null", "none", "nan", "n/a", "na", "nil", "undefined", "todo", "tbd", "answer", "your answer", "your answer here", "placeholder", "no answer", "empty", "unknown", "question_evaluation_error", "lorem ipsum", "x", "xxx", "tba", "response", "insert answer here", "answer here"}

# A speaker or an impersonal form, an inability or unwillingness, and an act of choosing; one of each, in this order and close together, declines.
DECLINES = [
    r"\b(?:i|we|i'm|we're|i'll|i'd|me|us|this assistant|the model|it(?:'s| is| isn't| is not| would be)?|there(?:'s| is))\b",
    r"\b(?:can ?not|can't|couldn't|could not|unable|not able|incapable|won't|will not|decline|declining|refuse|refusing|must not|mustn't|impossible|not possible|isn't possible|no way|no basis|not in a position|not going to|do not wish|don't wish|don't want|rather not|prefer not|not willing|unwilling|hesitant|not qualified|nothing)\b",
    r"\b(?:answer|choose|choosing|pick|picking|decide|deciding|select|selecting|determine|tell|say|respond|settle|commit|judge|help|favou?r|single out|identify|recommend|conclude)\b",
    r"\b(?:ich|wir|mir|uns|es|man)\b",
    r"\b(?:nicht|kein|keine|keinen|unmöglich|außerstande|weigere|lehne|verzichte|ungern)\b",
    r"\b(?:antworten|beantworten|antwort|entscheiden|entscheidung|wählen|auswählen|auswahl|festlegen|sagen|bestimmen|helfen|beurteilen)\b",
    r"\b(?:je|nous|il|me|moi)\b",
    r"\b(?:ne|n'|pas|impossible|refuse|refusons|incapable|décline|aucune)\b",
    r"\b(?:répondre|choisir|réponse|trancher|décider|dire|déterminer|sélectionner|aider|désigner)\b",
    r"\b(?:yo|me|nos|no|es)\b",
    r"\b(?:puedo|podemos|imposible|posible|capaz|rehúso|declino|niego|prefiero no|quiero|voy a)\b",
    r"\b(?:responder|contestar|elegir|escoger|decidir|decir|determinar|seleccionar|ayudar|respuesta|decantarme)\b",
]

_COUNT = Counter(w for words in STOP.values() for w in set(words.split()))
# words that several of the languages share say nothing
_STOP = {lang: frozenset(w for w in words.split() if _COUNT[w] == 1) for lang, words in STOP.items()}
_OTHER_COUNT = Counter(w for words in STOP_OTHER.values() for w in set(words.split()))
_STOP_OTHER = {lang: frozenset(w for w in words.split() if w not in _COUNT) for lang, words in STOP_OTHER.items()}
# gaps of up to six words within a sentence
_DECLINE = [re.compile(rf"{a}[^.!?\n]{{0,40}}?{b}(?:\W+\w+){{0,6}}?\W+{c}") for a, b, c in zip(DECLINES[::3], DECLINES[1::3], DECLINES[2::3])]
# Blocks of letters of other scripts than Latin.
_SCRIPTS = {
    "greek": r"[\u0370-\u03ff]", "cyrillic": r"[\u0400-\u052f]", "hebrew": r"[\u0590-\u05ff]", "arabic": r"[\u0600-\u06ff]", "indic": r"[\u0900-\u0dff]", "thai": r"[\u0e00-\u0e7f]",
    "kana": r"[\u3040-\u30ff]", "han": r"[\u3400-\u9fff]", "hangul": r"[\uac00-\ud7af]",
}
_FOREIGN = {k: re.compile(v) for k, v in _SCRIPTS.items()}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*|\S")
_TAGS = re.compile(r"<[^<>]*>|```\w*|&\w+;")
_TAIL = re.compile(r"(?:^|[\s(\[{\"'*:=>«“„])\(?([A-D])\)?[\s)\]}\"'*.!`»”<]*(?:</\w+>)?$")
_HEAD = re.compile(r"^[\s(\[*\"'>`]*(?:(?:Option|I pick|I choose|Answer|Antwort|Réponse|Respuesta)\W+)?([A-D])(?:[)\].:,*\"'`]|\s+(?:holds|is|fits|weil|because)\b|$)", re.IGNORECASE)
_MID = re.compile(r"\b(?:Option|Opción)\s+[A-D]\b(?!\))|\b[A-D]\s+(?:is|it is|fits|follows|holds)\b")
_LETTER = re.compile(r"\b[A-Da-d]\b")
_SEEN = "w0X.,;:!?)(\"'`*}{<>-"


def shape(token: str) -> str:
    """Class of a token: word ``w``, number ``0``, single capital answer letter ``X``, mark, or ``o``."""
    if len(token) == 1 and token in "ABCD":
        return "X"
    c = token[0]
    if c.isalpha():
        return "w"
    if c.isdigit():
        return "0"
    return c if c in _SEEN else ")" if c in "]»”’" else "o"


def contexts(text: str) -> list[str]:
    """Shape trigrams at every token, padded in front."""
    s = "^^" + "".join(shape(t) for t in _TOKEN.findall(text))
    return [s[i : i + 3] for i in range(len(s) - 2)]


def language(text: str) -> str | None:
    """Language by function words: at least two of them, and clearly more than of any other.

    A text mostly of letters of another script than Latin has that script as its language; further languages
    need three words that none of the four main ones has, and clearly more than these have.
    """
    low = _LETTER.sub(" ", text).lower()
    words = _WORD.findall(low)
    letters = sum(map(len, words))
    if letters and not low.isascii():
        script, n = max(((k, len(p.findall(low))) for k, p in _FOREIGN.items()), key=lambda x: x[1])
        if 2 * n > letters:
            return "ja" if script in ("kana", "han") and _FOREIGN["kana"].search(low) else script
    found = {lang: sum(w in stop for w in words) for lang, stop in _STOP.items()}
    (first, n), (_, m) = sorted(found.items(), key=lambda x: -x[1])[:2]
    other, k = max(((lang, sum(w in stop for w in words)) for lang, stop in _STOP_OTHER.items()), key=lambda x: x[1])
    if k >= 3 and k >= 1.5 * n:
        return other
    return first if n >= 2 and n >= 1.5 * m else None


def declines(text: str, options: list[str]) -> bool:
    """It says that no choice is made, by a phrase of the dictionary or a speaker's inability to choose, and neither gives a letter nor quotes an option."""
    low = text.lower().replace("\u2019", "'")
    if answers(text):
        return False
    if any(p in low for p in REFUSALS):
        return True
    return not any(len(o) > 5 and o.lower() in low for o in options) and any(p.search(low) for p in _DECLINE)


def is_empty(text: str | None) -> bool:
    """Nothing visible, punctuation, empty markup, a placeholder or the error marker."""
    if text is None:
        return True
    t = text.strip()
    if t[:1] in "{[":
        try:
            value = json.loads(t)
        except ValueError:
            value = t
        if isinstance(value, dict):
            kept = [v for k, v in value.items() if str(k).lower() in ("answer", "choice", "option", "response")] or list(value.values())
            value = " ".join("" if v is None else str(v) for v in kept)
        elif isinstance(value, list):
            value = " ".join("" if v is None else str(v) for v in value)
        t = str(value)
    t = _TAGS.sub(" ", t)
    bare = " ".join(re.sub(r"[\W_]+", " ", t).split()).lower()
    return not bare or " ".join(t.split()).strip(" \"'`*()[]{}<>.-:").lower() in PLACEHOLDERS or bare in PLACEHOLDERS


def answers(text: str) -> bool:
    """A letter is given as the answer, in front or at the end."""
    return bool(_TAIL.search(text) or _HEAD.match(text) or _MID.search(text))


def _plain(text: str) -> bytes:
    return " ".join(re.sub(r"[>*#`\"“”«»_]+", " ", text).lower().split()).encode()


_plain_cctx = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, write_dict_id=False)


def explained(data: bytes, by: bytes) -> int:
    """Compressed size of ``data`` with ``by`` as dictionary."""
    if len(by) < 8:
        return len(_plain_cctx.compress(data))
    d = zstandard.ZstdCompressionDict(by, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(data))


def is_copy(text: str, question: str | None, options: list[tuple[str, str]]) -> bool:
    """The response repeats (most of) the question, perhaps with options, and adds no answer."""
    if not question or answers(text):
        return False
    r, q = _plain(text), _plain(question)
    if len(r) < 0.45 * len(q) or len(q) < 16:
        return False
    prompt = b" ".join([q, *(_plain(f"{k}) {o}") for k, o in options)])
    if explained(r, prompt) > max(NEW_LEAST, NEW_SHARE * len(r)):
        return False
    return explained(q, r) <= max(NEW_LEAST, LEFT_SHARE * len(_plain_cctx.compress(q)))


def is_cut(text: str, options: list[str], share: dict[str, float]) -> bool:
    """It stops inside a word, sentence or structure."""
    t = text.strip()
    m = re.match(r"^[\s(*]*[A-D][).:]\s+(.*)$", t, re.DOTALL)
    body = (m[1] if m else t).strip()
    if body.rstrip(".") in options:
        return False
    if t[:1] == "{":
        try:
            json.loads(t)
            return False
        except ValueError:
            return not t.endswith("}")
    if t.count("```") % 2 or re.search(r"(\.\.\.|…|�)$", t) or t.count("**") % 2:
        return True
    if re.search(r"[(\[{,;:–—]$", t):
        return True
    if m and not options and not re.search(r"[.!?]\s", body) and len(body.split()) <= 24 and not re.search(r"[,;:(-]$", body):
        return False  # a quoted option whose text is not known
    if _TAIL.search(t) or re.fullmatch(r"\W*[A-Da-d]\W*", t):
        return False
    return share.get(contexts(t)[-1] if t else "", 0.0) < MAX_LIFT * share.get("", 0.0)


def prose(text: str, options: list[str]) -> str:
    """The response without a quoted option and its letter."""
    m = re.match(r"^[\s(*]*[A-D][).:]\s+(.*)$", text.strip(), re.DOTALL)
    body = (m[1] if m else text).strip()
    return "" if body.rstrip(".") in options else body


def defect(text: str | None, question: str | None, labelled: list[tuple[str, str]], share: dict[str, float]) -> str | None:
    """The defect of a response to a question with ``labelled`` options, or None."""
    options = [o for _, o in labelled]
    if is_empty(text):
        return "empty"
    if is_copy(text, question, labelled):
        return "copy"
    if declines(text, options):
        return "refusal"
    if is_cut(text, options, share):
        return "truncated"
    own = language(prose(text, options))
    asked = language(question) if question else "en"
    if own and asked and own != asked:
        return "other_language"
    return None


def end_shares(responses: DataFrame) -> dict[str, float]:
    """Smoothed share of ends of every shape trigram, counted over all responses, and under "" that of any position.

    Trigrams of at most 21 shapes: what reaches the driver is bounded by their number.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, ends = Counter(), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c = contexts(t.strip())
                if c:
                    ends[c[-1]] += 1
                    inside.update(c[:-1])
        keys = list(inside.keys() | ends.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([ends[k] for k in keys], pa.int64())], ["c", "i", "e"])

    rows = responses.filter("r IS NOT NULL").select("r").mapInArrow(count, "c string, i long, e long").groupBy("c").agg(F.sum("i").alias("i"), F.sum("e").alias("e")).collect()
    ends, total = sum(x["e"] for x in rows), sum(x["e"] + x["i"] for x in rows)
    return {x["c"]: x["e"] / (x["e"] + x["i"] + PRIOR) for x in rows} | {"": ends / max(total, 1)}


def salted_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key`` of a unique right side; keys that hold many left rows are split into parts.

    At most 1 / HOT_SHARE keys can be hot, so their list is bounded.
    """
    total = left.count()
    hot = [r[key] for r in left.groupBy(key).count().filter((F.col("count") > max(HOT_SHARE * total, 10_000)) & F.col(key).isNotNull()).collect()]
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.col(key).isin(hot)
    parts = F.when(is_hot, F.lit(SALTS)).otherwise(F.lit(1))
    a = left.withColumn("_salt", F.pmod(F.xxhash64("result"), parts).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return a.join(b, [key, "_salt"], "left").drop("_salt")


def defects(results: DataFrame, questions: DataFrame) -> DataFrame:
    """``result_id, defect``: every defective answer once.

    Defined results: an answer delivered several times counts as delivered last (ties: the largest
    content); null result ids are left out; an answer whose question is not in the pool, or is null
    there, counts as asked in English; null options are no options; of a question id with several
    questions the smallest holds; responses are read whole; extra columns are ignored.
    """
    spark = results.sparkSession
    ship_package(spark)
    last = F.max(F.struct("loaded_at", F.col("question_id").alias("qid"), F.col("generated_response").alias("r"))).alias("x")
    one = results.filter("result_id IS NOT NULL").groupBy("result_id").agg(last).select(F.col("result_id").alias("result"), "x.qid", "x.r")
    one = written(one, "answers")
    # options in order of their labels, each behind its label
    texts = F.array_sort(F.transform(F.filter(F.map_entries("options"), lambda e: e["value"].isNotNull()), lambda e: F.concat_ws("\t", e["key"], e["value"])))
    asked = questions.filter("id IS NOT NULL AND question IS NOT NULL").groupBy(F.col("id").alias("qid")).agg(F.min(F.struct("question", texts.alias("options"))).alias("q"))
    ship = spark.sparkContext.broadcast(end_shares(one.select("r")))
    joined = salted_join(one, asked.select("qid", "q.question", "q.options"), "qid").select("result", "r", "question", "options")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = ship.value
        for b in batches:
            found = [
                defect(r, q, [(k, x) for k, x in (y.split("\t", 1) for y in o) if x] if o else [], share)
                for r, q, o in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())
            ]
            keep = np.flatnonzero([f is not None for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array([found[i] for i in keep], pa.string())], ["result_id", "defect"])

    return joined.mapInArrow(judge, f"result_id {results.schema['result_id'].dataType.simpleString()}, defect string")
