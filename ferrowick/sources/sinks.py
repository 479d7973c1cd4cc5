"""Sinks: run files, JSON lines, metrics, CSV and small reports."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrowick.functions.text import human_bytes


def run_lines(results: DataFrame, tag: str = "ferrowick") -> DataFrame:
    """(qid, rank, value): lines of six fields, scores with six decimals."""
    fields = (F.col("qid").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", "score"), F.lit(tag))
    return results.select("qid", "rank", F.concat_ws(" ", *fields).alias("value"))


def write_run(results: DataFrame, path: str, tag: str = "ferrowick") -> None:
    """A folder of text files; each query's lines are together, in the order of the ranks."""
    lines = run_lines(results, tag)
    lines.repartition("qid").sortWithinPartitions("qid", "rank").select("value").write.mode("overwrite").text(path)


def responses(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, response): one JSON object a query, {"q", "results": [{rank, doc_id, score, passage}]}; a query without results has none in it."""
    item = F.struct("rank", "doc_id", "score", "passage")
    lists = results.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("results"))
    empty = F.from_json(F.lit("[]"), lists.schema["results"].dataType)
    return queries.join(lists, "qid", "left").select("qid", F.to_json(F.struct(F.col("query").alias("q"), F.coalesce("results", empty).alias("results"))).alias("response"))


def write_metrics(metrics: DataFrame, path: str, **about: str) -> str:
    """One row as JSON, also to a local file."""
    text = json.dumps({**about, "metrics": metrics.first().asDict()}, indent=2)
    with open(path, "w") as f:
        f.write(text)
    return text


def write_stats(stats: DataFrame, path: str) -> str:
    text = json.dumps(stats.first().asDict())
    with open(path, "w") as f:
        f.write(text)
    return text


def write_latency(rows: DataFrame, path: str) -> None:
    """threads, mode, qps, p50_us, p95_us, p99_us, throughput_chunk with a header."""
    rows.select("threads", "mode", "qps", "p50_us", "p95_us", "p99_us", "throughput_chunk").coalesce(1).write.mode("overwrite").csv(path, header=True)  # a row for each number of threads


def _human(spark: SparkSession, values: Mapping[str, int]) -> dict[str, str]:
    table = spark.createDataFrame(list(values.items()), "name string, n long")
    return {r.name: r.size for r in table.select("name", human_bytes(F.col("n")).alias("size")).collect()}  # a row for each artefact


def size_report(spark: SparkSession, collection: int, parts: Mapping[str, int]) -> str:
    """A Markdown table of the artefacts' sizes, their sum and its share of the collection."""
    total = sum(parts.values())
    named = _human(spark, {"collection": collection, **parts, "**Total index**": total})
    lines = ["# Index Size", "", "| Artifact | Size |", "| - | - |", *[f"| {name} | {named[name]} |" for name in ("collection", *parts, "**Total index**")]]
    return "\n".join([*lines, *(["", f"The index is {total / collection:.3f}x of the collection."] if collection > 0 else [])]) + "\n"


def compression_report(spark: SparkSession, stores: Mapping[str, Mapping[str, int]]) -> str:
    """A Markdown table by codec, from {codec: {part: bytes}} with raw32 among the codecs; the posting store is index and blocks."""
    store = {c: p.get("index", 0) + p.get("blocks", 0) for c, p in stores.items()}
    raw = store.get("raw32", 0)
    lines = ["# Compression", "", "| Codec | Index | Blocks | Posting store | Ratio |", "| - | - | - | - | - |"]
    for c, p in stores.items():
        h = _human(spark, {"i": p.get("index", 0), "b": p.get("blocks", 0), "s": store[c]})
        lines.append(f"| {c} | {h['i']} | {h['b']} | {h['s']} | {store[c] / raw if raw else 0:.3f}x |")
    return "\n".join([*lines, *[f"\n{c} saves {(1 - s / raw) * 100:.1f}%." for c, s in store.items() if raw and s < raw]]) + "\n"


def rss_report(baseline: int, experiment: int) -> dict[str, object]:
    """Two peaks of memory and the reduction in percent."""
    return {"baseline_bytes": baseline, "experiment_bytes": experiment, "reduction_percent": (baseline - experiment) / baseline * 100 if baseline else 0.0}
