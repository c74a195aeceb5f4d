"""Command line: build, promote, search, status, doctor, and stand-alone filters."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkfathom.engine import Engine
from sparkfathom.functions import chunking
from sparkfathom.operators import embedding
from sparkfathom.sources import config as configuration
from sparkfathom.sources import files, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkfathom")
    p.add_argument("--root", default="sparkfathom-warehouse", help="folder of the index")
    p.add_argument("--config", help="a TOML file")
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="bring an index in line with a directory")
    build.add_argument("directory")
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("-k", "--top-k", type=int)
    search.add_argument("-c", "--collection", action="append")
    for name in ("promote", "remove"):
        sub.add_parser(name).add_argument("collection")
    build.add_argument("-c", "--collection", required=True)
    sub.choices["promote"].add_argument("--force", action="store_true")
    for name in ("status", "doctor", "collections", "config"):
        sub.add_parser(name)
    sub.add_parser("extract").add_argument("path")
    sub.add_parser("chunk").add_argument("path")
    sub.add_parser("embed").add_argument("path")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    """The rows that a command prints."""
    settings = configuration.load(args.config)
    engine = Engine(spark, args.root, settings)
    rows = lambda df: [json.loads(x) for x in sinks.json_lines(df)]
    if args.command == "build":
        return [engine.build(args.collection, args.directory)]
    if args.command == "search":
        return rows(engine.search(args.query, args.top_k, args.collection).orderBy("rank"))
    if args.command == "promote":
        return [vars(engine.promote(args.collection, args.force))]
    if args.command == "remove":
        return [{"removed": engine.remove(args.collection)}]
    if args.command == "status":
        return engine.status()
    if args.command == "doctor":
        return engine.check()
    if args.command == "collections":
        return rows(engine.collections().orderBy("collection"))
    if args.command == "config":
        return [{"chunk": vars(settings.chunk), "search": vars(settings.search), "index": vars(settings.index), "n_ctx": settings.n_ctx}]
    if args.command == "extract":
        return rows(engine.registry.extract(files.scan(spark, args.path, engine.registry.suffixes())).select("path", "text", "error"))
    if args.command == "chunk":
        texts = files.read_text(spark, args.path)
        refused = texts.select("path", chunking.run_error(F.col("text")).alias("error")).where("error is not null").first()
        if refused:
            raise ValueError(f"{refused.path}: {refused.error}")
        return rows(chunking.chunk_words(texts, ["path"], "text", settings.chunk.size, settings.chunk.overlap).drop("path", "n_tokens"))
    return rows(embedding.embed(files.read_chunks_jsonl(spark, args.path), engine.provider).drop("error"))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sparkfathom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        for row in run(spark, args):
            print(json.dumps(row, ensure_ascii=False, default=str))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
