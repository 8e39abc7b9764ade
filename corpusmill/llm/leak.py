"""Held-out items inside corpus documents: rare n-gram seeds, then Smith-Waterman alignment.

The five-word n-grams of the items are the seeds.  A first pass over the documents counts in
how many documents each seed occurs; seeds in few documents are rare.  A second pass looks up
each document's n-grams in the seeds, takes the (document, item) pairs with enough seeds near one
diagonal as candidates and aligns the item's words with that stretch of the document.  Items of fewer words than a seed are looked up whole, each by the hash of all its words.
Both passes stream the documents; the only shuffle is the seed count.  Items are taken in
slices of bounded size, so what is broadcast is bounded however many items there are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import ship_package

from .neardup import mix, word_hashes

#: Words of a seed.
GRAM = 5
#: A seed is rare when it occurs in at most this share of the documents (or in RARE_LEAST documents).
RARE_SHARE, RARE_LEAST = 0.004, 20
#: Seeds near one diagonal that make a candidate: rare ones, or any (for items that leaked into many documents).
#: Two fifths of an item of up to ``SHORT`` words may hold a single seed when a word is changed: there one seed is enough.
RARE_SEEDS, ANY_SEEDS, SHORT = 2, 3, 25
#: Words by which the diagonals of one stretch may differ.
DRIFT = 12
#: Least alignment score as a share of the item's words (match 1, changed, missing or added word -1).
LEAST_SCORE = 0.33
#: Words of items in one broadcast slice (16 MB of seeds at most).
SLICE_WORDS = 500_000
#: Cells of one alignment batch.
CELLS = 4_000_000

_WORD = re.compile(r"[^\W_]+")
# Invisible characters, dropped before words are read.
_INVISIBLE = dict.fromkeys([0x00AD, 0x034F, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0xFE0F, 0xFEFF])
_known: dict[str, int] = {}


def _words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    return _WORD.findall(text.lower())


def _codes(words: list[str]) -> np.ndarray:
    """Word hashes, remembered by the worker."""
    if len(_known) > 2_000_000:
        _known.clear()
    new = [w for w in set(words) if w not in _known]
    if new:
        _known.update(zip(new, word_hashes(new).tolist()))
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def _grams(codes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the n-gram that starts at each word (the last ones run over the end)."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    return mix(h)


class Seeds:
    """The seeds of a slice of items: sorted hashes with item and position, and a bit table in front."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.ids, self.codes, h, own, pos = [], [], [], [], []
        self.whole: dict[int, dict[int, list[int]]] = {}
        for i, text in items:
            c = _codes(_words(text))
            if not len(c):
                continue
            g = _grams(c)
            if len(c) < GRAM:
                self.whole.setdefault(len(c), {}).setdefault(int(_grams(c, len(c))[0]), []).append(len(self.ids))
            h.append(g)
            own.append(np.full(len(g), len(self.ids)))
            pos.append(np.arange(len(g)))
            self.ids.append(i)
            self.codes.append(c)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        hashes, own, pos = cat(h, np.uint64), cat(own, np.int64), cat(pos, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hash, self.own, self.pos = hashes[order], own[order], pos[order]
        self.unique, self.first = np.unique(self.hash, return_index=True)
        self.last = np.append(self.first[1:], len(self.hash))
        self.rare = np.ones(len(self.unique), bool)
        self.size = np.array([len(c) for c in self.codes], np.int64)
        # every word of every item, one number a word and item
        with np.errstate(over="ignore"):
            self.words = np.unique(cat([c * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i) for i, c in enumerate(self.codes)], np.uint64))
        self.short = self.size <= SHORT
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[(self.unique & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the n-grams that are seeds, and the seeds' numbers."""
        if not len(self.unique):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[(grams & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.unique, grams[at]), len(self.unique) - 1)
        ok = self.unique[k] == grams[at]
        return at[ok], k[ok]


def _concatenated(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of a batch and the first word of each text."""
    words: list[str] = []
    start = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        words += _words(t)
        start[i + 1] = len(words)
    return _codes(words), start


def _hits(texts: list[str | None], seeds: Seeds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes, start = _concatenated(texts)
    at, k = seeds.find(_grams(codes))
    doc = np.searchsorted(start, at, side="right") - 1
    inside = at + GRAM <= start[doc + 1]
    return codes, start, at[inside], k[inside], doc[inside]


def align(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smith-Waterman scores of many pairs of padded word rows at once (match 1, otherwise -1).

    ``a`` (n x items' words) and ``b`` (n x stretch) are padded with different codes.
    """
    n, w = b.shape
    h = np.zeros((n, w + 1), np.int32)
    best = np.zeros(n, np.int32)
    ramp = np.arange(w + 1, dtype=np.int32)
    for i in range(a.shape[1]):
        s = np.where(b == a[:, i : i + 1], 1, -1).astype(np.int32)
        t = np.maximum(h - 1, 0)
        t[:, 1:] = np.maximum(t[:, 1:], h[:, :-1] + s)
        h = np.maximum.accumulate(t + ramp, axis=1) - ramp
        best = np.maximum(best, h.max(axis=1))
    return best


def _candidates(seeds: Seeds, at: np.ndarray, k: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, diagonal) of the stretches with enough seeds."""
    many = seeds.last[k] - seeds.first[k]
    row = np.repeat(np.arange(len(k)), many)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    entry = seeds.first[k][row] + offset
    item, d = seeds.own[entry], doc[row]
    diag = at[row] - start[d] - seeds.pos[entry]
    rare = seeds.rare[k][row]
    order = np.lexsort((diag, item, d))
    d, item, diag, rare = d[order], item[order], diag[order], rare[order]
    if not len(d):
        return d, item, diag
    # seeds on diagonals from each seed's own up to DRIFT further, counted within its document and item
    base = (d * (len(seeds.ids) + 1) + item) * (1 << 33) + (diag + (1 << 31))
    end = np.searchsorted(base, base + DRIFT, side="right")
    total = end - np.arange(len(base))
    sums = np.concatenate([[0], np.cumsum(rare)])
    rares = sums[end] - sums[:-1]
    ok = (rares >= RARE_SEEDS) | (total >= ANY_SEEDS) | seeds.short[item]
    # the best stretch of each document and item, and further ones that lie apart from it
    key = np.flatnonzero(ok)
    key = key[np.lexsort((key, -(total[key] + rares[key]), item[key], d[key]))]
    chosen: list[int] = []
    for i in key:
        if chosen and d[chosen[-1]] == d[i] and item[chosen[-1]] == item[i]:
            j = len(chosen) - 1
            apart = True
            while j >= 0 and d[chosen[j]] == d[i] and item[chosen[j]] == item[i]:
                if abs(diag[chosen[j]] - diag[i]) <= 2 * DRIFT:
                    apart = False
                    break
                j -= 1
            if not apart:
                continue
        chosen.append(int(i))
    c = np.array(chosen, np.int64)
    return d[c], item[c], diag[c]


def _whole(seeds: Seeds, codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, item) of the short items that occur whole."""
    d, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size, known in seeds.whole.items():
        grams = _grams(codes, size)
        at = np.flatnonzero(np.isin(grams, np.array(list(known), np.uint64)))
        doc = np.searchsorted(start, at, side="right") - 1
        inside = at + size <= start[doc + 1]
        for g, k in zip(grams[at[inside]].tolist(), doc[inside].tolist()):
            d.append(np.full(len(known[g]), k)), item.append(np.array(known[g]))
    both = np.unique(np.stack([np.concatenate(d), np.concatenate(item)]), axis=1)
    return both[0], both[1]


def _possible(seeds: Seeds, codes: np.ndarray, start: np.ndarray, d: np.ndarray, item: np.ndarray, diag: np.ndarray) -> np.ndarray:
    """Whether the stretch of each candidate has so many words of the item that the alignment can reach ``LEAST_SCORE``.

    No score exceeds the number of the stretch's words that occur in the item, so nothing is lost.
    """
    size = seeds.size[item]
    lo = np.maximum(diag - DRIFT, 0) + start[d]
    hi = np.maximum(np.minimum(diag + size + 2 * DRIFT + start[d], start[d + 1]), lo)
    n = hi - lo
    row = np.repeat(np.arange(len(d)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
    with np.errstate(over="ignore"):
        known = np.isin(codes[at] * np.uint64(0x9E3779B97F4A7C15) + item[row].astype(np.uint64), seeds.words)
    return np.bincount(row, known, minlength=len(d)) >= LEAST_SCORE * size


def _scores(seeds: Seeds, codes: np.ndarray, start: np.ndarray, d: np.ndarray, item: np.ndarray, diag: np.ndarray) -> np.ndarray:
    sizes = np.array([len(seeds.codes[i]) for i in item], np.int64)
    out = np.zeros(len(d), np.int64)
    order = np.argsort(sizes, kind="stable")
    a = 0
    while a < len(order):
        z = a
        while z < len(order) and (z - a + 1) * sizes[order[z]] * (sizes[order[z]] + 4 * DRIFT) <= CELLS:
            z += 1
        z = max(z, a + 1)
        rows = order[a:z]
        longest = int(sizes[rows].max())
        width = longest + 4 * DRIFT
        x = np.full((len(rows), longest), 1, np.uint64)
        y = np.full((len(rows), width), 2, np.uint64)
        for r, i in enumerate(rows):
            c = seeds.codes[item[i]]
            x[r, : len(c)] = c
            lo = max(int(diag[i]) - DRIFT, 0) + start[d[i]]
            hi = min(int(diag[i]) + len(c) + 2 * DRIFT + start[d[i]], start[d[i] + 1])
            if hi > lo:
                y[r, : hi - lo] = codes[lo:hi]
        out[rows] = align(x, y)
        a = z
    return out


def _slices(items: list[tuple[int, str | None]]) -> list[list[tuple[int, str | None]]]:
    out: list[list] = [[]]
    held = 0
    for i, t in items:
        size = len(_words(t))
        if out[-1] and held + size > SLICE_WORDS:
            out.append([])
            held = 0
        out[-1].append((i, t))
        held += size
    return out


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, score, share``: documents that contain a passage of an item, with the best alignment.

    ``share`` is the score over the item's number of words.  Letter case, punctuation, white space
    and invisible characters do not count.

    Defined results: null and blank texts match nothing; a stretch of fewer than five words counts only when
    it is a whole item (two fifths of an item of up to ten words are fewer than a seed); a null id
    is kept as an id of its own; repeated rows give one row; of several stretches in one document the
    best score counts; whole texts are read, however long; extra columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind, ikind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text")).filter(F.col("text").isNotNull())
    test = items.select(items[item_col].alias("item"), items[item_text].alias("text")).filter(F.col("text").isNotNull()).distinct().orderBy("item", "text")
    out = None
    for part in _slices([(r["item"], r["text"]) for r in test.toLocalIterator()]):
        seeds = Seeds(part)
        found = _leaks_of(spark, slim, seeds, kind, ikind)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("doc", "item").agg(F.max("score").alias("score"), F.max("share").alias("share"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "score", F.round("share", 4).alias("share"))


def _leaks_of(spark, slim: DataFrame, seeds: Seeds, kind: str, ikind: str) -> DataFrame:
    ship = spark.sparkContext.broadcast(seeds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = ship.value
        n, rows = np.zeros(len(s.unique), np.int64), 0
        for b in batches:
            rows += b.num_rows
            if len(s.unique):
                _, _, _, k, doc = _hits(b.column(0).to_pylist(), s)
                np.add.at(n, np.unique(doc * len(s.unique) + k) % len(s.unique), 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[some], rows))], ["seed", "n"])

    counted = slim.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toPandas()  # at most one row a seed
    total = int(counted.loc[counted["seed"] == -1, "n"].sum())
    often = counted[(counted["n"] > max(RARE_LEAST, RARE_SHARE * total)) & (counted["seed"] >= 0)]
    seeds.rare[often["seed"].to_numpy(dtype=np.int64)] = False
    ship2 = spark.sparkContext.broadcast(seeds)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = ship2.value
        sizes = s.size
        names = pa.array(s.ids)
        for b in batches:
            if not len(s.ids):
                continue
            codes, start, at, k, doc = _hits(b.column(1).to_pylist(), s)
            d, item, diag = _candidates(s, at, k, doc, start)
            may = _possible(s, codes, start, d, item, diag)
            d, item, diag = d[may], item[may], diag[may]
            score = _scores(s, codes, start, d, item, diag)
            dw, iw = _whole(s, codes, start)
            d, item, score = np.concatenate([d, dw]), np.concatenate([item, iw]), np.concatenate([score, sizes[iw]])
            if not len(d):
                continue
            share = score / sizes[item]
            ok = np.flatnonzero(share >= LEAST_SCORE)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(d[ok])), names.take(pa.array(item[ok])), pa.array(score[ok]), pa.array(share[ok])], ["doc", "item", "score", "share"]
            )

    return slim.mapInArrow(look, f"doc {kind}, item {ikind}, score long, share double")
