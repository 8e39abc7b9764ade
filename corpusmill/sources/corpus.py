"""Corpus folders: discovery, parsing by provider, parser and extension checks."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import file_extension, stripped
from corpusmill.runtime import ship_package
from corpusmill.sources import parsers

log = logging.getLogger(__name__)

TEXT_EXTENSIONS = (".md", ".txt")
# Extensions each parser reads.
PARSER_EXTENSIONS = {
    "pymupdf4llm": (".pdf",),
    "docling": (".pdf", ".docx", ".xlsx", ".pptx", ".html", ".xhtml", ".csv", ".adoc", ".asciidoc", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp"),
    "html": (".html", ".xhtml"),
}


PARSERS: dict[str, Callable[[bytes, str], str | None]] = {
    "html": lambda content, ext: parsers.html_text(content),
    "pymupdf4llm": lambda content, ext: parsers.pdf_text(content),
    "docling": parsers.office_text,
}


def parser(name: str) -> Callable[[bytes, str], str | None]:
    """A registered parser; others are an error that names those there are."""
    if name not in PARSERS:
        raise ValueError(f"unknown parser {name!r}; available: {sorted(PARSERS)}")
    return PARSERS[name]


def read_corpus(spark: SparkSession, path: str, parser_name: str = "html", lenient: bool = False) -> DataFrame:
    """``doc_id, path, text, error``: the files below ``path`` in order of path.

    Hidden files and ``metadata.json`` are left out; Markdown and text files are read as UTF-8, files the parser
    handles are parsed, others have the error ``unsupported``; a file that fails to parse keeps its row with the error, and
    blank texts are left out.  Spark never lists names that start with a dot or an underscore. With ``lenient`` all JSON
    files are left out, broken UTF-8 is replaced, and texts are kept as they are, blank ones too.  ``doc_id`` is a hash of the path, so it does not depend on the listing.  A missing path is
    an error; see :func:`documents` for one that must hold texts.
    """
    parse, reads = parser(parser_name), PARSER_EXTENSIONS[parser_name]
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.filter(~F.lower(name).endswith(".json") if lenient else ~name.startswith(".") & (name != "metadata.json")).select("path", "content", file_extension(F.col("path")).alias("ext"))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts, errors = [], []
            for content, ext in zip(pdf["content"], pdf["ext"]):
                text = error = None
                try:
                    if ext in TEXT_EXTENSIONS:
                        text = bytes(content).decode("utf-8", "replace" if lenient else "strict")
                    elif ext in reads:
                        text = parse(bytes(content), ext)
                    else:
                        error = "unsupported"
                except Exception as e:  # a broken file must not fail the job
                    error = f"{type(e).__name__}: {e}"
                texts.append(text), errors.append(error)
            yield pd.DataFrame({"path": pdf["path"], "text": texts, "error": errors})

    rows = files.mapInPandas(read, "path string, text string, error string")
    if not lenient:
        rows = rows.withColumn("text", stripped(F.col("text"))).filter("error IS NOT NULL OR text <> ''")
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "text", "error")


def documents(corpus: DataFrame) -> DataFrame:
    """``doc_id, path, text``: the texts of a corpus; a corpus without any is an error, files that failed are logged and skipped."""
    counts = corpus.agg(F.count("text").alias("texts"), F.count("error").alias("failed")).first()
    if counts["failed"]:
        log.warning("%d files were skipped", counts["failed"])
    if not counts["texts"]:
        raise ValueError("the corpus holds no text")
    return corpus.filter("error IS NULL").select("doc_id", "path", "text")


def extensions(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``extension``: distinct suffixes of the files that need a parser."""
    ext = file_extension(F.col(path_col))
    return paths.select(ext.alias("extension")).filter((F.col("extension") != "") & ~F.col("extension").isin(*TEXT_EXTENSIONS, ".json")).distinct()


def unsupported(paths: DataFrame, parsers: list[str], path_col: str = "path") -> DataFrame:
    """``parser, missing``: per parser the sorted, comma-joined extensions it cannot read; unknown parsers are an error."""
    for p in parsers:
        if p not in PARSER_EXTENSIONS:
            raise ValueError(f"unknown parser {p!r}; available: {sorted(PARSER_EXTENSIONS)}")
    can = paths.sparkSession.createDataFrame([(p, e) for p in parsers for e in PARSER_EXTENSIONS[p]], "parser string, extension string")
    names = paths.sparkSession.createDataFrame([(p,) for p in parsers], "parser string")
    missing = extensions(paths, path_col).select(F.explode(F.array(*[F.lit(p) for p in parsers])).alias("parser"), "extension").join(can, ["parser", "extension"], "left_anti")
    lists = missing.groupBy("parser").agg(F.array_join(F.sort_array(F.collect_set("extension")), ",").alias("missing"))
    return names.join(lists, "parser", "left").na.fill("", ["missing"])
