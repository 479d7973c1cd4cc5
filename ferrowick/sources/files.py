"""Text sources: collections, queries, judgements, runs, request lines, bench results, logs, file sizes.

Lines end with LF alone. A line's number and place in its file come from the splits' own sums, so a collection of any
size is numbered without passing through one task."""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrowick.functions.text import text_after_tab


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line_pos, line): every line of the file or folder, numbered from 0, with its first byte's offset over all files in the order of their names."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"))
    raw = raw.withColumn("bytes", (F.octet_length("value") + 1).cast("long"))
    # a row for each split
    splits = raw.groupBy("file", "split").agg(F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("size"))
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "split", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("no"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("pos"))
    own = Window.partitionBy("file", "split").orderBy("i")
    within = raw.select("*", (F.row_number().over(own) - 1).alias("n"), F.coalesce(F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    return within.join(bases, ["file", "split"]).select((F.col("no") + F.col("n")).alias("line_no"), (F.col("pos") + F.col("at")).alias("line_pos"), F.col("value").alias("line"))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_pos, text) of a TSV collection: the id is the line's number, whatever its first field; blank lines count."""
    return read_lines(spark, path).select(F.col("line_no").alias("doc_id"), "line_pos", text_after_tab(F.col("line")).alias("text"))


def read_queries(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """(line_no, qid, query). Lines without TAB are skipped, or with ``strict=False`` are queries of the line's number."""
    lines = read_lines(spark, path).withColumn("tab", F.instr("line", "\t"))
    if strict:
        lines = lines.where("tab > 0")
    qid = F.when(F.col("tab") > 0, F.substring_index("line", "\t", 1)).otherwise(F.col("line_no").cast("string"))
    return lines.select("line_no", qid.alias("qid"), text_after_tab(F.col("line")).alias("query"))


def _fields(spark: SparkSession, path: str, n: int) -> DataFrame:
    lines = read_lines(spark, path).select("line_no", F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+").alias("f"))
    return lines.where(F.size("f") == n)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel) of lines of four fields; of a repeated pair the last line counts."""
    return _fields(spark, path, 4).groupBy(F.col("f")[0].alias("qid"), F.col("f")[2].alias("doc_id")).agg(F.max_by(F.col("f")[3].cast("int"), "line_no").alias("rel"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, score) of lines of six fields; of a repeated pair the last line counts."""
    return _fields(spark, path, 6).groupBy(F.col("f")[0].alias("qid"), F.col("f")[2].alias("doc_id")).agg(F.max_by(F.col("f")[4].cast("double"), "line_no").alias("score"))


def read_ranked_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rank): places from 1 in the order of the rank written, then of the document's name."""
    lines = _fields(spark, path, 6).select(F.col("f")[0].alias("qid"), F.col("f")[2].alias("doc_id"), F.col("f")[3].cast("int").alias("written"))
    return lines.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy("written", "doc_id")).alias("rank"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term, term_id, df, start_position, bytes_size) of a lexicon as text: lines of these five fields between blanks; other lines are skipped."""
    f = F.col("f")
    return _fields(spark, path, 5).select(f[0].alias("term"), *[f[i].cast("long").alias(name) for i, name in enumerate(("term_id", "df", "start_position", "bytes_size"), 1)])


def read_latency(spark: SparkSession, folder: str) -> DataFrame:
    """(source, threads, qps, p50_us, p95_us, p99_us) of latency_t*.csv; files named latency_t<number>.csv are preferred if there are any."""
    paths = sorted(glob.glob(os.path.join(folder, "latency_t*.csv")))
    paths = [p for p in paths if re.fullmatch(r"latency_t\d+\.csv", os.path.basename(p))] or paths
    names = ("qps", "p50_us", "p95_us", "p99_us")
    if not paths:
        return spark.createDataFrame([], "source string, threads int, " + ", ".join(f"{n} double" for n in names))
    table = spark.read.csv(paths, header=True, enforceSchema=False)
    return table.select(F.col("_metadata.file_name").alias("source"), F.col("threads").cast("int"), *[F.col(n).cast("double") for n in names]).orderBy("threads")


def max_rss_bytes(text: str) -> int:
    """The number before the first mention of the maximum resident set size, else ValueError."""
    for line in text.splitlines():
        first = line.split()[:1]
        if "maximum resident set size" in line.lower() and first and first[0].isdigit():
            return int(first[0])
    raise ValueError("no maximum resident set size")


def size_of(path: str) -> int:
    """Bytes of a file, or of all files in a folder; 0 if missing."""
    if os.path.isfile(path):
        return os.path.getsize(path)
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)
