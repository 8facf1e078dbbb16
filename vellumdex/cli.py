"""Command line: `python -m vellumdex.cli build FILE FOLDER [-p 1..10]`, `python -m vellumdex.cli query FOLDER [--corpus [FILE]]`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from vellumdex.operators.index import SearchIndex, summary
from vellumdex.operators.search import rendered, search
from vellumdex.operators.snippets import region_snippets
from vellumdex.sources.corpus import read_trec


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellumdex")
    commands = p.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build", help="index a tagged text file")
    b.add_argument("file")
    b.add_argument("folder")
    b.add_argument("-p", type=int, choices=range(1, 11), default=10, metavar="1..10", help="tenths of the file to read")
    q = commands.add_parser("query", help="answer queries, one a line, until an empty line")
    q.add_argument("folder")
    q.add_argument("--corpus", nargs="?", const="", metavar="FILE", help="show snippets from the tagged text file; name it if it has moved since the build")
    q.add_argument("--limit", type=int, default=10)
    q.add_argument("--mode", type=int, choices=(0, 1), default=0, help="0: all words, 1: any word")
    return p


def main(arguments: list[str] | None = None, lines=sys.stdin, out=print) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("vellumdex").getOrCreate()
    if a.command == "build":
        row = summary(SearchIndex.build(read_trec(spark, a.file, a.p), a.folder)).first()
        out(f"{row['n_docs']} documents, {row['n_terms']} terms")
        return
    index = SearchIndex.load(spark, a.folder)
    for line in lines:
        if not line.strip():
            return
        results = search(index, line, a.mode, a.limit)
        shown = {} if a.corpus is None else {r["doc_id"]: r["snippet"] for r in region_snippets(index, results, line, file=a.corpus or None).collect()}
        out(f"Showing Top {a.limit}")
        rows = results.select("rank", "doc_id", rendered(results).alias("text")).orderBy("rank").collect()
        if not rows:
            out("No result found.")
        for r in rows:
            out(r["text"] + (f"\n<Snippet>\n{shown.get(r['doc_id']) or ''}\n</Snippet>" if a.corpus is not None else ""))


if __name__ == "__main__":
    main()
