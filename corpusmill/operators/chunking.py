"""Splitting texts into chunks: recursive, fixed separator, fixed windows, and global ordinals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import stripped
from corpusmill.runtime import default_parallelism, maybe_broadcast, ship_package, written

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, sep: str) -> list[str]:
    """Pieces that each start with the separator in front of them."""
    if sep == "":
        return list(text)
    out, at = [], 0
    while (nxt := text.find(sep, at + (1 if out or at else 0))) > 0 and nxt != at:
        out.append(text[at:nxt])
        at = nxt
    out.append(text[at:])
    return [p for p in out if p]


def _windows(pieces: list[str], size: int, overlap: int, glue: str) -> list[str]:
    """Greedy runs of pieces up to ``size`` characters; each run begins with up to ``overlap`` characters of the last."""
    out: list[str] = []
    first, length = 0, 0
    for i, p in enumerate(pieces):
        extra = len(glue) if i > first else 0
        if i > first and length + extra + len(p) > size:
            out.append(glue.join(pieces[first:i]))
            while first < i and (length > overlap or length + len(glue) + len(p) > size):
                length -= len(pieces[first]) + (len(glue) if first + 1 < i else 0)
                first += 1
            extra = len(glue) if i > first else 0
        length = (length if i > first else 0) + extra + len(p)
    if first < len(pieces):
        out.append(glue.join(pieces[first:]))
    return out


def split_recursive(text: str, size: int = 512, overlap: int = 64, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that occurs; longer pieces are split by finer ones."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    out: list[str] = []
    run: list[str] = []
    for p in _pieces(text, sep):
        if len(p) <= size or not finer:
            run.append(p)
            continue
        out += _windows(run, size, overlap, "")
        run = []
        out += split_recursive(p, size, overlap, finer)
    out += _windows(run, size, overlap, "")
    return [c for c in (x.strip() for x in out) if c]


def split_fixed(text: str, size: int = 512, overlap: int = 64, separator: str = "\n\n") -> list[str]:
    """Runs of separator-free pieces; a piece longer than ``size`` stays whole."""
    pieces = [p for p in text.split(separator) if p] if separator else list(text)
    return [c for c in (x.strip() for x in _windows(pieces, size, overlap, separator)) if c]


STRATEGIES: dict[str, Callable[..., list[str]]] = {"recursive": split_recursive, "fixed": split_fixed}


def chunk_documents(docs: DataFrame, strategy: str = "recursive", size: int = 512, overlap: int = 64, id_col: str = "doc_id", text_col: str = "text", keep_blank: bool = False) -> DataFrame:
    """``doc_id, pos, text``: the chunks of every document in order.

    Blank documents are skipped and chunks stripped and dropped when empty, unless ``keep_blank`` (the exam's
    splitting, which takes the splitter's output as it is).  Null texts have no chunks.  Documents of the
    same id keep their own positions.  Unknown strategies raise before any job runs.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {strategy!r}; supported: {sorted(STRATEGIES)}")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    split = STRATEGIES[strategy]
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pos, out = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t is None or not (keep_blank or t.strip()):
                    continue
                for j, c in enumerate(split(t, size, overlap)):
                    row.append(i), pos.append(j), out.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(pos, pa.int32()), pa.array(out, pa.string())], [id_col, "pos", "text"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, pos int, text string")


def fixed_windows(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pos, text``: windows of ``size`` characters every ``size - overlap``, all as expressions."""
    step = size - overlap
    t = stripped(F.col(text_col))
    rows = docs.select(F.col(id_col), t.alias("_t")).filter("_t <> ''")
    count = F.greatest(F.ceil((F.length("_t") - overlap) / F.lit(step)), F.lit(1)).cast("int")
    rows = rows.select(id_col, "_t", F.explode(F.sequence(F.lit(0), count - 1)).alias("pos"))
    return rows.select(id_col, "pos", F.substring("_t", F.col("pos") * step + 1, F.lit(size)).alias("text"))


def with_ordinal(df: DataFrame, order: list[str | Column], out: str = "ordinal") -> DataFrame:
    """Number all rows from 0 in the given order without a single-task window.

    Rows are range-partitioned and written in order; the partitions' counts, one row each, give the offsets.
    """
    n = default_parallelism(df.sparkSession)
    spread = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    spread = written(spread, "ordered")
    # one row a partition; the window runs over them
    counts = written(spread.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n")), "counts")
    start = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    numbered = spread.withColumn("_part", F.shiftright("_at", 33)).join(maybe_broadcast(start, n, 16), "_part")
    return numbered.withColumn(out, F.col("_start") + F.col("_at").bitwiseAND(2**33 - 1)).drop("_at", "_part", "_start")


def chunk_ids(chunks: DataFrame, prefix: str = "chunk", order: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """Add ``chunk_id``: the prefix and the chunk's number over all documents."""
    return with_ordinal(chunks, [F.col(c) for c in order]).withColumn("chunk_id", F.concat(F.lit(prefix + "_"), F.col("ordinal").cast("string"))).drop("ordinal")
