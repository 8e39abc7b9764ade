"""Command line: run and explain queries, look into a search space, run one trial or a search over trials."""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusmill")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    for name, text in (("run", "run a query and show its rows"), ("explain", "show the plan of a query")):
        c = sub.add_parser(name, help=text)
        c.add_argument("query")
        c.add_argument("tables", help="folder with the Parquet tables")
        c.add_argument("--rows", type=int, default=20)
    c = sub.add_parser("info", help="show a search space")
    c.add_argument("space", help="YAML file with choices and spans")
    for name, text in (("trial", "run one trial"), ("optimize", "search over trials")):
        c = sub.add_parser(name, help=text)
        c.add_argument("space", help="YAML file with choices and spans")
        c.add_argument("corpus", help="folder of documents")
        c.add_argument("output", help="folder for indices, history, exam and results")
        c.add_argument("--exam-size", type=int, default=10)
        if name == "optimize":
            c.add_argument("--trials", type=int, default=10)
    a = p.parse_args(argv)
    return {"list": _list, "run": _query, "explain": _query, "info": _info, "trial": _search, "optimize": _search}[a.command](a, p)


def _list(a: argparse.Namespace, p: argparse.ArgumentParser) -> int:
    from corpusmill.plans.catalog import QUERIES

    print("\n".join(QUERIES))
    return 0


def _query(a: argparse.Namespace, p: argparse.ArgumentParser) -> int:
    from corpusmill.plans.catalog import QUERIES

    if a.query not in QUERIES:
        p.error(f"unknown query {a.query!r}")
    from corpusmill.runtime import local_session

    df = QUERIES[a.query](local_session(), a.tables)
    df.explain("formatted") if a.command == "explain" else df.show(a.rows, truncate=False)
    return 0


def _info(a: argparse.Namespace, p: argparse.ArgumentParser) -> int:
    from corpusmill.operators.space import Space

    print(Space.load(a.space).as_json())
    return 0


def _search(a: argparse.Namespace, p: argparse.ArgumentParser) -> int:
    from pathlib import Path

    from corpusmill.operators import generation, loop
    from corpusmill.operators.chunking import chunk_documents, chunk_ids
    from corpusmill.operators.space import Space
    from corpusmill.providers import HashEmbedder
    from corpusmill.runtime import local_session, written
    from corpusmill.sources.corpus import documents, read_corpus

    space, out = Space.load(a.space), Path(a.output)
    out.mkdir(parents=True, exist_ok=True)
    spark = local_session()
    docs = written(documents(read_corpus(spark, a.corpus)), "documents")
    chunks = written(chunk_ids(chunk_documents(docs, keep_blank=True), "exam_chunk"), "chunks").withColumnRenamed("chunk_id", "id").select("id", "text")
    vectors = HashEmbedder().embed(chunks, "id", "text")
    exam = written(generation.generate_exam(chunks.join(vectors, "id"), a.exam_size, generation.ClozeGenerator(chunks)), "exam")
    loop.save_exam(exam, out / "exam.json")
    if a.command == "trial":
        results = written(loop.run_trial(docs, exam, loop.next_trial(spark, loop.TweakProposer(space), space, None)), "results")
        loop.save_result(results, out / "result.json")
        print(json.dumps({k: v for k, v in json.loads((out / "result.json").read_text(encoding="utf-8")).items() if k != "question_results"}))
        return 0
    best = loop.optimize(docs, exam, space, str(out.resolve()), a.trials)
    loop.save_best(best, out / "best_config.yaml")
    print(json.dumps({"best_trial": best.get("number"), "score": best.get("score")}))
    return 0
