"""Command line: ingest, index, health, query, chat."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import answer as A
from corpusloom.operators import index as I
from corpusloom.operators import retrieve as R
from corpusloom.operators import state
from corpusloom.operators.chunk import ChunkConfig
from corpusloom.operators.normalize import NormalizationConfig
from corpusloom.plans.index import COLLECTION, IndexConfig, ask, build_index
from corpusloom.plans.ingest import IngestConfig, ingest
from corpusloom.sources import clients

SWITCHES = ("page_numbers", "headers_footers", "boilerplate", "whitespace", "special_chars", "bullets", "zero_width", "code_blocks")
FIELD = {"page_numbers": "remove_page_numbers", "headers_footers": "remove_headers_footers", "boilerplate": "remove_boilerplate", "whitespace": "normalize_whitespace", "special_chars": "normalize_special_chars", "bullets": "normalize_bullets", "zero_width": "remove_zero_width", "code_blocks": "preserve_code_blocks"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("ingest")
    p.add_argument("input_root")
    p.add_argument("output_root")
    p.add_argument("--chunk-size", type=int, default=400)
    p.add_argument("--overlap", type=float, default=0.15)
    p.add_argument("--preset", choices=["default", "minimal", "aggressive", "none"], default="default")
    p.add_argument("--config")
    p.add_argument("--cleanup-orphans", action="store_true")
    p.add_argument("--fail-fast", action="store_true")
    p.add_argument("--retry-failed", action="store_true")
    for name in SWITCHES:
        p.add_argument("--no-" + name.replace("_", "-"), action="store_true", dest="no_" + name)
    p = commands.add_parser("index")
    p.add_argument("chunks_root")
    p.add_argument("index_root")
    p.add_argument("--collection", default=COLLECTION)
    p.add_argument("--doc-id", action="append", dest="docs")
    p.add_argument("--purge", action="store_true")
    p.add_argument("--verify", type=int, nargs="?", const=100)
    p = commands.add_parser("health")
    p.add_argument("index_root")
    p.add_argument("--collection")
    for name in ("query", "chat"):
        p = commands.add_parser(name)
        p.add_argument("index_root")
        p.add_argument("question", nargs="?" if name == "chat" else None)
        p.add_argument("--collection", default=COLLECTION)
        p.add_argument("-k", type=int, default=3 if name == "query" else 5)
    commands.choices["query"].add_argument("--pretty", action="store_true")
    commands.choices["query"].add_argument("--max-chars", type=int, default=240)
    chat = commands.choices["chat"]
    chat.add_argument("--provider")
    chat.add_argument("--max-tokens", type=int)
    chat.add_argument("--temperature", type=float)
    chat.add_argument("--json", action="store_true")
    chat.add_argument("--show-sources", action="store_true")
    return top


def normalization(args) -> NormalizationConfig | None:
    config = NormalizationConfig.from_yaml(args.config) if args.config else NormalizationConfig.preset(args.preset)
    if config is None:
        return None
    return replace(config, **{FIELD[s]: False for s in SWITCHES if getattr(args, "no_" + s)})


def questions(spark: SparkSession, text: str):
    return spark.createDataFrame([(1, text)], "query_id int, question string")


def main(argv: list | None = None, spark: SparkSession | None = None, read=input) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    if args.command == "ingest":
        report = ingest(spark, IngestConfig(args.input_root, args.output_root, ChunkConfig(args.chunk_size, args.overlap), normalization(args), args.cleanup_orphans, args.fail_fast, args.retry_failed))
        print(json.dumps(report))
        return 1 if report["failed"] else 0
    if args.command == "index":
        print(json.dumps(build_index(spark, IndexConfig(args.chunks_root, args.index_root, args.collection, args.docs, args.purge))))
        if args.verify:
            print(I.verify(state.Store(spark, args.index_root).read(args.collection), args.verify).toJSON().first())
        return 0
    store = state.Store(spark, args.index_root)
    if args.command == "health":
        found = I.health(store, args.collection)
        print(found.message)
        return 0 if found.healthy else 1
    if not store.exists(args.collection):
        print(f"no collection {args.collection} in {args.index_root}", file=sys.stderr)
        return 1
    if args.command == "query":
        hits, _ = ask(spark, args.index_root, questions(spark, args.question), max(1, args.k), args.collection)
        meta = {c: F.col(c) for c in hits.columns}
        if args.pretty:
            shown = hits.select("rank", R.hit_json(F.col("rank"), F.col("id"), F.col("distance"), F.struct(*(c for c in hits.columns if c not in ("text", "rank", "distance"))), F.col("text")).alias("line"))
        else:
            shown = hits.select("rank", R.hit_text(F.col("rank"), F.col("text"), {**meta, "chunk_id": F.col("id")}, F.col("distance"), args.max_chars).alias("line"))
        lines = [r.line for r in shown.orderBy("rank").collect()]
        print("\n".join(lines) if lines else "No results found.")
        return 0
    client = clients.create(args.provider)
    while True:
        question = args.question or read("> ").strip()
        if not question or question.lower() in ("quit", "exit", "q"):
            return 0
        try:
            hits, prompts = ask(spark, args.index_root, questions(spark, question), args.k, args.collection)
            row = prompts.first()
            said = client.generate(question, row.system_prompt, args.max_tokens or 1000, 0.7 if args.temperature is None else args.temperature) if row.n_chunks else A.NO_CONTEXT
        except clients.ClientError as error:
            print(f"[error] {error}", file=sys.stderr)
            return 1
        if args.json:
            parts = [json.loads(r.s) for r in hits.orderBy("rank").select(R.sources_json(F.col("text"), F.struct("id", "doc_id", "page", "section"), F.col("distance")).alias("s")).collect()]
            print(json.dumps({"question": question, "answer": said, "sources": parts}, ensure_ascii=False, indent=2))
        else:
            print(said)
            if args.show_sources:
                for r in hits.orderBy("rank").select(R.source_line(F.col("rank"), F.col("text"), F.col("relative_path"), F.col("page"), F.col("distance")).alias("s")).collect():
                    print(r.s)
        if args.question:
            return 0


if __name__ == "__main__":
    sys.exit(main())
