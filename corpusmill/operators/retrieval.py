"""Batch retrieval: text index, vector search, fusion, expansion, de-duplication and reranking of all queries at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import set_jaccard, stripped, word_tokens
from corpusmill.runtime import BROADCAST_BYTES, maybe_broadcast, ship_package, written

K1, B = 1.2, 0.75
RRF_K = 60
#: Bytes of query vectors that a slice broadcasts.
QUERY_BYTES = BROADCAST_BYTES
#: Queries that are scored at once against a block of texts.
QUERY_BLOCK = 512
#: Texts of a block that hold a term, from which on it takes part in the matrix product.
COMMON = 48
#: Rows a task keeps before it drops those that others have surpassed.
HELD = 1 << 20
#: Runs of letters and digits, the terms of the text index.
TERM = re.compile(r"[^\W_]+")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``postings(term, id, tf, dl)`` and one row of ``n, avgdl``; texts without terms are not indexed."""
    words = docs.select(F.col(id_col).alias("id"), word_tokens(F.col(text_col)).alias("w")).filter(F.size("w") > 0).withColumn("dl", F.size("w"))
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    terms = words.select("id", "dl", F.explode("w").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return terms, stats


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``qid, term``: the distinct terms of each query."""
    return queries.select(F.col(id_col).alias("qid"), F.explode(F.array_distinct(word_tokens(F.col(text_col)))).alias("term"))


def top_ranked(scored: DataFrame, k: int, by: list[Column], key: str = "qid") -> DataFrame:
    """The first ``k`` rows of each query with their ``rank``; the limit runs before the shuffle."""
    w = Window.partitionBy(key).orderBy(*by)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Best:
    """The ``k`` best scores of each query that a task has seen, larger is better, and the rows that reach them; ties are kept."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.top = k, np.full((queries, k), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size, self.limit = 0, HELD

    def least(self, first: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score each row of ``s``, whose first query is ``first``, must reach, and the ``k``-th best of those rows of ``s`` that have seen fewer than ``k``."""
        low = self.top[first : first + len(s)].min(axis=1)
        new = np.flatnonzero(low == -np.inf)
        own = np.full(len(s), -np.inf)
        if len(new) and s.shape[1] >= self.k:
            some = s[new]
            some[np.isnan(some)] = -np.inf
            own[new] = np.partition(some, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
        return low, own

    def add(self, q: np.ndarray, score: np.ndarray, ids: pa.Array, at: np.ndarray) -> None:
        """Take in scores of queries ``q`` and rows ``at`` of ``ids``; scores that are no number are never kept."""
        good = (score >= self.top[q].min(axis=1)) & (score > -np.inf)
        q, score, at = q[good], score[good], at[good]
        if not len(q):
            return
        order = np.lexsort((-score, q))
        q, score, at = q[order], score[order], at[order]
        rows, line = np.unique(q, return_inverse=True)
        place = np.arange(len(q)) - np.searchsorted(q, q)
        first = place < self.k
        new = np.full((len(rows), self.k), -np.inf)
        new[line[first], place[first]] = score[first]
        self.top[rows] = np.partition(np.concatenate([self.top[rows], new], axis=1), self.k, axis=1)[:, self.k :]
        keep = score >= self.top[q].min(axis=1)
        self.held.append((q[keep], score[keep], ids.take(pa.array(at[keep]))))
        self.size += int(keep.sum())
        if self.size > self.limit:
            self._drop()

    def _drop(self) -> None:
        q, score = (np.concatenate([x[i] for x in self.held]) for i in (0, 1))
        keep = np.flatnonzero(score >= self.top[q].min(axis=1))
        self.held = [(q[keep], score[keep], pa.concat_arrays([x[2] for x in self.held]).take(pa.array(keep)))]
        self.size = len(keep)
        self.limit = max(HELD, 2 * self.size)

    def found(self, names: pa.Array, sign: int = 1) -> Iterator[pa.RecordBatch]:
        """``qid, id, score`` of all that was kept."""
        if self.held:
            self._drop()
            q, score, ids = self.held[0]
            for a in range(0, len(q), 65536):
                z = slice(a, a + 65536)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q[z])), ids.slice(a, 65536), pa.array(sign * score[z])], ["qid", "id", "score"])


def _impacts(tf: np.ndarray, dl: np.ndarray, idf: np.ndarray, avgdl: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", query_id: str = "item_id", text_col: str = "text", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``qid, id, score, rank``: the ``k`` best documents of each query by BM25.

    Scores are rounded to six digits and ties broken by id; null texts and texts without terms neither search nor are
    found.  Without an ``index`` the documents are streamed twice: once for the frequencies of the queries' terms and
    the mean length, once to score every document against all queries as a product of two matrices, each task
    keeping the best ``k`` of each query, so only those are shuffled.  The queries are taken in slices of bounded size.
    """
    if index is not None:
        return _bm25_of_index(*index, queries, k, query_id, text_col)
    spark = docs.sparkSession
    ship_package(spark)
    slim = docs.select(F.col(doc_id).alias("id"), F.lower(F.col(text_col)).alias("t")).filter("t IS NOT NULL AND id IS NOT NULL")
    q = query_terms(queries.filter(F.col(query_id).isNotNull()), query_id, text_col).groupBy("qid").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    q = written(q, "queries")
    size = q.agg(F.sum(F.size("terms")), F.count(F.lit(1))).first()
    slices = max(1, -(-(size[0] or 0) * 60 // QUERY_BYTES))
    kind, qkind = docs.schema[doc_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    found = None
    for i in range(slices):
        rows = q.filter(F.pmod(F.xxhash64("qid"), F.lit(slices)) == i).orderBy("qid").toArrow() if slices > 1 else q.orderBy("qid").toArrow()
        one = slim.mapInArrow(_bm25_scorer(slim, rows, k), f"qid {qkind}, id {kind}, score double")
        found = one if found is None else found.unionByName(one)
    return top_ranked(found, k, [F.col("score").desc(), F.col("id")])


def _bm25_scorer(docs: DataFrame, queries: pa.Table, k: int):
    """The function that scores Arrow batches ``id, t`` against a slice of queries ``qid, terms``."""
    lists = queries.column("terms").to_pylist()
    number = {t: i for i, t in enumerate(dict.fromkeys(t for x in lists for t in x))}
    # the terms of all queries, one after the other, and where each query starts
    wants = np.fromiter((number[t] for x in lists for t in x), np.int32), np.cumsum([0] + [len(x) for x in lists])
    sc = docs.sparkSession.sparkContext
    terms = sc.broadcast(number)

    def counted(texts: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and frequency of the queries' terms in texts, and the texts' lengths in terms."""
        dl, row, col = np.zeros(len(texts)), [], []
        for i, t in enumerate(texts):
            words = TERM.findall(t)
            dl[i] = len(words)
            hits = [known[w] for w in words if w in known]
            row.append(np.full(len(hits), i)), col.append(np.array(hits, np.int64))
        cell, tf = np.unique(np.concatenate([*row, np.zeros(0, int)]) * max(len(known), 1) + np.concatenate([*col, np.zeros(0, np.int64)]), return_counts=True)
        return cell // max(len(known), 1), cell % max(len(known), 1), tf, dl

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, n, total = terms.value, np.zeros(len(terms.value), np.int64), 0, 0
        for b in batches:
            _, col, _, dl = counted(b.column(1).to_pylist(), known)
            np.add.at(df, col, 1)
            n, total = n + int((dl > 0).sum()), total + int(dl.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n, total]))], ["term", "n"])

    # at most one row a term of the slice
    sums = docs.mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df, at, n = np.zeros(len(number)), sums.column("term").to_numpy(), sums.column("n").to_numpy()
    df[at[at >= 0]] = n[at >= 0]
    docs_n, total = (int(n[at == c].sum()) for c in (-1, -2))
    idf, avgdl = np.log(1 + (docs_n - df + 0.5) / (df + 0.5)), total / max(docs_n, 1)
    ship = sc.broadcast((wants, idf, avgdl, queries.column("qid").combine_chunks()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (term, start), idf, avgdl, names = ship.value
        known = terms.value
        best = Best(len(names), k)
        for whole in batches:
            for a in range(0, whole.num_rows if len(names) else 0, 1024):
                b = whole.slice(a, 1024)
                row, col, tf, dl = counted(b.column(1).to_pylist(), known)
                # only the terms of these texts take part: common ones by a product of matrices, the texts of others one by one
                used, col = np.unique(col, return_inverse=True)
                place = np.full(len(idf), -1)
                place[used] = np.arange(len(used))
                parts = np.zeros((len(used) + 1, b.num_rows))
                parts[col, row] = _impacts(tf, dl[row], idf[used[col]], avgdl)
                held = np.bincount(col, minlength=len(used))
                common = np.flatnonzero(held >= COMMON)
                column = np.full(len(used), -1)
                column[common] = np.arange(len(common))
                dense = parts[common].astype(np.float32)
                by = np.argsort(col, kind="stable")
                where, begin = row[by], np.cumsum(held) - held
                for q in range(0, len(names), QUERY_BLOCK):
                    bounds = start[q : q + QUERY_BLOCK + 1]
                    at = place[term[bounds[0] : bounds[-1]]]
                    mine = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[at >= 0]
                    at = at[at >= 0]
                    many = column[at] >= 0
                    asks = np.zeros((len(bounds) - 1, len(common)), np.float32)
                    asks[mine[many], column[at[many]]] = 1
                    s = asks @ dense
                    few = at[~many]
                    n = held[few]
                    post = np.repeat(begin[few] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    np.add.at(s.reshape(-1), np.repeat(mine[~many] * b.num_rows, n) + where[post], parts[np.repeat(few, n), where[post]].astype(np.float32))
                    # single precision only tells which scores need not be computed
                    low, own = best.least(q, s)
                    low = np.maximum(low, own)
                    i, j = np.divmod(np.flatnonzero(s >= np.maximum(low - 1e-4 - 1e-5 * np.abs(low), 4e-7).astype(np.float32)[:, None]), b.num_rows)
                    if not len(i):
                        continue
                    first, n = np.searchsorted(mine, i), np.bincount(mine, minlength=len(bounds) - 1)[i]
                    exact = np.zeros(len(i))
                    for c in range(0, len(i), 65536):
                        z = slice(c, c + 65536)
                        head = np.cumsum(n[z]) - n[z]
                        cell = np.repeat(first[z] - head, n[z]) + np.arange(n[z].sum())
                        exact[z] = np.add.reduceat(parts[at[cell], np.repeat(j[z], n[z])], head)
                    exact = np.round(exact, 6)
                    exact[exact <= 0] = -np.inf
                    best.add(q + i, exact, b.column(0), j)
        yield from best.found(names)

    return score


def _bm25_of_index(terms: DataFrame, stats: DataFrame, queries: DataFrame, k: int, query_id: str, text_col: str) -> DataFrame:
    """BM25 over postings: only those of terms that some query holds are joined."""
    q = written(query_terms(queries, query_id, text_col), "terms")
    wanted = q.select("term").distinct()
    hit = written(terms.join(maybe_broadcast(wanted, wanted.count(), 40), "term", "left_semi"), "postings")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    impact = hit.join(df, "term").crossJoin(F.broadcast(stats)).select("term", "id", part.alias("part"))  # stats is one row
    rows = q.count()
    if rows * 60 <= BROADCAST_BYTES:
        # each document's postings meet the queries in one task: scores need no further shuffle
        pairs = impact.repartition("id").join(F.broadcast(q), "term")
    else:
        pairs = impact.join(q, "term")
    scored = pairs.groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_ranked(scored, k, [F.col("score").desc(), F.col("id")])


def vector_search(index: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id", query_id: str = "qid", vec_col: str = "vector", digits: int = 6) -> DataFrame:
    """``qid, id, score, rank``: exact nearest rows of every query vector, by distance (``l2``) or similarity (``cosine``).

    The query set is taken in slices whose size is bounded; each slice is compared with every index row in NumPy
    blocks of bounded size, each task keeping its own best ``k``.  Scores are rounded and ties broken by id.  Rows whose
    vector is null or of another length than the queries' are not found.
    """
    spark = index.sparkSession
    ship_package(spark)
    q = queries.select(F.col(query_id).alias("qid"), F.col(vec_col).alias("v")).filter("v IS NOT NULL")
    stat = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    n, d = stat["n"], stat["d"] or 1
    slices = max(1, -(-n * d * 8 // QUERY_BYTES))
    kind, qkind = index.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    rows = index.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter(F.size("v") == d)
    found = None
    for s in range(slices):
        part = q.filter((F.size("v") == d) & (F.pmod(F.xxhash64("qid"), F.lit(slices)) == s)).toPandas()
        if part.empty and s:
            continue
        ship = spark.sparkContext.broadcast((part["qid"].tolist(), np.array(part["v"].tolist(), dtype=np.float64).reshape(-1, d)))

        def search(batches: Iterator[pa.RecordBatch], ship=ship) -> Iterator[pa.RecordBatch]:
            names, y = ship.value
            best, cosine = Best(len(names), k), metric == "cosine"
            norm = np.sqrt((y * y).sum(1))
            for b in batches:
                if not b.num_rows or not names:
                    continue
                x = pa.compute.cast(b.column(1).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
                for a in range(0, len(x), 1024):
                    z = x[a : a + 1024]
                    size = np.sqrt((z * z).sum(1))
                    # g grows with the score; in single precision, where that can hold it, g only tells which scores need not be computed
                    kind = np.float32 if max(norm.max(), size.max()) < 1e15 else np.float64
                    right = (z / np.maximum(size, 1e-300)[:, None] if cosine else np.column_stack([z, size * size])).astype(kind)
                    for q0 in range(0, len(y), QUERY_BLOCK):
                        v, r = y[q0 : q0 + QUERY_BLOCK], norm[q0 : q0 + QUERY_BLOCK]
                        left = v / np.maximum(r, 1e-300)[:, None] if cosine else np.column_stack([v, np.full(len(v), -0.5)])
                        g = left.astype(kind) @ right.T
                        low, own = best.least(q0, g)
                        slack = np.full(len(v), 1e-5) if cosine else 1e-5 * (r * r + np.nanmax(size, initial=0.0) ** 2)
                        seen = low - 2 * 10.0**-digits if cosine else (r * r - (2 * 10.0**-digits - low) ** 2) / 2
                        i, j = np.divmod(np.flatnonzero(g >= (np.where(low > -np.inf, seen, own) - 2 * slack).astype(kind)[:, None]), len(z))
                        for c in range(0, len(i), 65536):
                            at, to = i[c : c + 65536], j[c : c + 65536]
                            if cosine:
                                s = (v[at] * z[to]).sum(1) / np.maximum(r[at] * size[to], 1e-300)
                            else:
                                s = -np.sqrt(((v[at] - z[to]) ** 2).sum(1))
                            best.add(q0 + at, np.round(s, digits), b.column(0), a + to)
            yield from best.found(pa.array(names, q_type), 1 if metric == "cosine" else -1)

        from pyspark.sql.pandas.types import to_arrow_type

        q_type = to_arrow_type(queries.schema[query_id].dataType)
        one = rows.mapInArrow(search, f"qid {qkind}, id {kind}, score double")
        found = one if found is None else found.unionByName(one)
    by = F.col("score").desc() if metric == "cosine" else F.col("score").asc()
    return top_ranked(found, k, [by, F.col("id")])


def rrf(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """``qid, id, score, rank``: reciprocal-rank fusion of ranked lists; ties keep the order of first appearance."""
    rows = None
    for i, x in enumerate(lists):
        one = x.select("qid", "id", F.lit(i).alias("list"), F.col("rank"))
        rows = one if rows is None else rows.unionByName(one)
    fused = rows.filter("id IS NOT NULL").groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "first.list", "first.rank")
    return fused.withColumn("rank", F.row_number().over(w)).select("qid", "id", "score", "rank")


def deduplicated(hits: DataFrame) -> DataFrame:
    """``qid, id, score, rank``: of several query variants' hits the first of each id, in order of variant and rank."""
    w = Window.partitionBy("qid", "id").orderBy("variant", "rank")
    first = hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    order = Window.partitionBy("qid").orderBy("variant", "rank")
    return first.withColumn("rank", F.row_number().over(order)).select("qid", "id", "score", "rank")


def expanded(queries: DataFrame, mode: str, id_col: str = "item_id", text_col: str = "text", generated: str | None = None, lines: int = 3) -> DataFrame:
    """``qid, variant, text``: the queries with their variants.

    ``none`` keeps the query, ``hyde`` adds the generated passage, ``multi_query`` the first three non-blank lines of it.
    """
    q, t = F.col(id_col).alias("qid"), F.col(text_col)
    if mode == "none":
        return queries.select(q, F.lit(0).alias("variant"), t.alias("text"))
    if generated is None:
        raise ValueError(f"mode {mode!r} needs the column of generated text")
    if mode == "hyde":
        return queries.select(q, F.posexplode(F.array(t, F.col(generated))).alias("variant", "text"))
    if mode == "multi_query":
        more = F.slice(F.filter(F.transform(F.split(F.coalesce(F.col(generated), F.lit("")), "\n"), stripped), lambda x: x != ""), 1, lines)
        return queries.select(q, F.posexplode(F.concat(F.array(t), more)).alias("variant", "text"))
    raise ValueError(f"unknown expansion {mode!r}; supported: none, hyde, multi_query")


def reranked(hits: DataFrame, queries: DataFrame, docs: DataFrame, top_n: int, query_id: str = "item_id", doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``qid, id, score, rank``: hits ordered by the offline reranker (token-set Jaccard), ties by prior rank, cut to ``top_n``."""
    q = queries.select(F.col(query_id).alias("qid"), F.array_distinct(word_tokens(F.col(text_col))).alias("a"))
    d = docs.select(F.col(doc_id).alias("id"), F.array_distinct(word_tokens(F.col(text_col))).alias("b"))
    scored = hits.select("qid", "id", F.col("rank").alias("prior")).join(q, "qid").join(d, "id")
    scored = scored.withColumn("score", F.round(set_jaccard(F.col("a"), F.col("b")), 6)).drop("a", "b")
    return top_ranked(scored, top_n, [F.col("score").desc(), F.col("prior")]).select("qid", "id", "score", "rank")


def weighted_fusion(text_hits: DataFrame, vector_hits: DataFrame, alpha: float) -> DataFrame:
    """``qid, id, score, rank``: min-max scaled scores mixed by ``alpha`` (the vectors' weight). An extension, off by default."""
    w = Window.partitionBy("qid")

    def scaled(x: DataFrame, name: str) -> DataFrame:
        low, high = F.min("score").over(w), F.max("score").over(w)
        return x.select("qid", "id", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)).alias(name))

    both = scaled(text_hits, "t").join(scaled(vector_hits, "v"), ["qid", "id"], "full")
    score = F.round(alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("t", F.lit(0.0)), 6)
    ranked = both.select("qid", "id", score.alias("score"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")))


def graph_search(index: DataFrame, queries: DataFrame, id_col: str = "doc_id", query_id: str = "item_id") -> DataFrame:
    """No graph store exists: an empty result of the usual columns."""
    spark = index.sparkSession
    kind, qkind = index.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    return spark.createDataFrame([], f"qid {qkind}, id {kind}, score double, rank int")


def normalised_hit(row_score: Column, distance: Column) -> Column:
    """One score of a hit: its score, else its distance, else 0."""
    return F.coalesce(row_score.cast("double"), distance.cast("double"), F.lit(0.0))
