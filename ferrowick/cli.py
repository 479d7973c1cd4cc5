"""Commands: build and search indexes, write runs, evaluate them, measure latency, make prompts. ``python -m ferrowick <command> --help``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrowick.functions.codec import CODECS
from ferrowick.functions.text import checked_int, prompt
from ferrowick.operators import evaluate as ev
from ferrowick.operators import index as ix
from ferrowick.operators import latency
from ferrowick.operators.search import MOST, SearchOptions, query_slice, search_batch
from ferrowick.sources import files, sinks
from ferrowick.streaming import serve


def _between(least: int, most: int) -> Callable[[str], int]:
    def parse(text: str) -> int:
        try:
            return checked_int(text, "the value", least, most)
        except ValueError as e:
            raise argparse.ArgumentTypeError(str(e)) from None

    return parse


def _positive(most: int = MOST) -> Callable[[str], int]:
    return _between(1, most)


def _index(spark: SparkSession, args: argparse.Namespace) -> ix.Index:
    docs = files.read_collection(spark, args.collection).select("doc_id", "text") if getattr(args, "collection", None) else None
    return ix.Index.load(spark, args.index, docs)


def build(spark: SparkSession, args: argparse.Namespace) -> Iterable[str]:
    docs = files.read_collection(spark, args.collection).select("doc_id", "text")
    ix.build_index(docs).save(args.index, args.buckets, args.codec, args.per_block)
    if args.stats_json:
        saved = ix.Index.load(spark, args.index)
        yield sinks.write_stats(ix.saved_stats(saved, args.spill_threshold), args.stats_json)
    yield f"index written to {args.index}"


def search(spark: SparkSession, args: argparse.Namespace) -> Iterable[str]:
    index = _index(spark, args)
    if args.server:
        return serve.handle(index, sys.stdin, args.top_k)
    lines = [json.dumps({"q": args.query, "k": args.top_k, "mode": serve.MODES[int(args.conjunctive)]})] if args.query is not None else None
    return serve.interactive(index, sys.stdin, args.top_k) if lines is None else serve.handle(index, lines)


def run(spark: SparkSession, args: argparse.Namespace) -> Iterable[str]:
    queries = files.read_queries(spark, args.queries)
    if queries.isEmpty():
        raise ValueError("no queries")
    sinks.write_run(search_batch(_index(spark, args), queries.select("qid", "query"), SearchOptions(args.top_k)), args.out, args.tag)
    yield f"run written to {args.out}"


def evaluate(spark: SparkSession, args: argparse.Namespace) -> Iterable[str]:
    missing = [p for p in (args.qrels, args.run) if "://" not in p and not os.path.exists(p)]
    if missing:  # a set of queries without judgements or run is passed over
        return [f"skipped: {', '.join(missing)} missing"]
    run = files.read_ranked_run(spark, args.run).join(files.read_run(spark, args.run), ["qid", "doc_id"])
    metrics = ev.evaluate(files.read_qrels(spark, args.qrels), run, tuple(args.metrics))
    return [sinks.write_metrics(metrics, args.out, qrels=args.qrels, run=args.run)]


def bench(spark: SparkSession, args: argparse.Namespace) -> Iterable[str]:
    queries = query_slice(files.read_queries(spark, args.queries, strict=False), "line_no", args.offset, args.limit).select("qid", "query")
    index = _index(spark, args)
    timing = latency.measure(index, queries, SearchOptions(args.top_k), chunk=args.throughput_chunk, repeat=args.repeat)
    found = latency.summary(index, timing, threads=spark.sparkContext.defaultParallelism, chunk=args.throughput_chunk, mode=args.mode)
    if args.csv:
        sinks.write_latency(found, args.csv)
    r = found.first()
    yield f"threads={r.threads} qps={r.qps:.1f} p50_us={r.p50_us:.0f} p95_us={r.p95_us:.0f} p99_us={r.p99_us:.0f}"


def rag(spark: SparkSession, args: argparse.Namespace) -> Iterable[str]:
    """The prompt for a question, and of the backend ``mock`` an answer that cites the first passage. Other backends need a network and aren't offered."""
    with serve.Retriever(_index(spark, args), args.top_k) as retriever:
        found = retriever.search(args.q)
    kinds = "question string, passages array<struct<rank int, doc_id long, score double, passage string>>"
    rows: DataFrame = spark.createDataFrame([(args.q, [(r["rank"], r["doc_id"], r["score"], r["passage"]) for r in found])], kinds)
    yield rows.select(prompt(F.col("question"), F.col("passages"), args.max_passage_chars)).first()[0]
    yield f"[{found[0]['doc_id']}] answers this best." if found else "I do not have enough information."


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ferrowick", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, f: Callable, *, index: bool = True, collection: bool | None = None, k: int | None = None) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.set_defaults(run_=f)
        if index:
            c.add_argument("--index", required=True, help="folder of a saved index")
        if collection is not None:
            c.add_argument("--collection", required=collection, help="TSV file or folder")
        if k is not None:
            c.add_argument("--top-k", type=_positive(), default=k)
        return c

    c = command("build", build, collection=True)
    c.add_argument("--codec", choices=CODECS, default="varbyte")
    c.add_argument("--buckets", type=_positive(), default=64)
    c.add_argument("--per-block", type=_positive(), default=ix.POSTINGS_PER_BLOCK)
    c.add_argument("--stats-json")
    c.add_argument("--spill-threshold", type=_positive(2**62), default=5_000_000)
    c = command("search", search, collection=False, k=10)
    c.add_argument("--query", help="one query; without it lines are read")
    c.add_argument("--conjunctive", action="store_true")
    c.add_argument("--server", action="store_true", help="JSON requests and responses, a line each")
    c = command("run", run, k=1000)
    c.add_argument("--queries", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--tag", default="ferrowick")
    c = command("evaluate", evaluate, index=False)
    c.add_argument("--qrels", required=True)
    c.add_argument("--run", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--metrics", nargs="+", default=list(ev.DEFAULT))
    c = command("bench", bench, k=10)
    c.add_argument("--queries", required=True)
    c.add_argument("--offset", type=_between(0, 2**31 - 1), default=0)
    c.add_argument("--limit", type=_between(0, 2**31 - 1), default=0)
    c.add_argument("--repeat", type=_positive(), default=1)
    c.add_argument("--throughput-chunk", type=_between(0, MOST), default=0)
    c.add_argument("--mode", choices=("latency", "throughput"), default="latency")
    c.add_argument("--csv")
    c = command("rag", rag, collection=True, k=5)
    c.add_argument("--q", required=True)
    c.add_argument("--backend", choices=("mock",), default="mock")
    c.add_argument("--max-passage-chars", type=_positive(), default=512)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 2 where what a command needs is missing or wrong."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("ferrowick").getOrCreate()
    try:
        for line in args.run_(spark, args):
            print(line, flush=True)
    except ValueError as e:
        print(f"ferrowick: {e}", file=sys.stderr)
        return 2
    return 0
