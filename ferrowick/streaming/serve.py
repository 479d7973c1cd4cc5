"""Request lines: {"q", "k", "mode"} in, one JSON response a line out, in order; errors are responses too."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ferrowick.functions.text import checked_int
from ferrowick.operators.index import Index
from ferrowick.operators.search import MOST, SearchOptions, search_batch

MODES = ("disjunctive", "conjunctive")


def parse(line: str, default_k: int = 10) -> tuple[str, int, str]:
    """(query, k, mode) of a request, else ValueError."""
    request = json.loads(line)
    if not isinstance(request, dict) or not isinstance(request.get("q", ""), str):
        raise ValueError("a request is an object with a text q")
    k = request.get("k", default_k)
    if not isinstance(k, int) or isinstance(k, bool):
        raise ValueError("k must be a whole number")
    checked_int(k, "k", 1, MOST)
    mode = request.get("mode", "disjunctive")
    if mode not in MODES:
        raise ValueError("mode must be disjunctive or conjunctive")
    return request.get("q", ""), k, mode


def _failed(e: Exception) -> str:
    return json.dumps({"error": f"server: {e}"})


def _found(index: Index, asked: list[tuple[str, str, int]], mode: str) -> dict[str, list[dict]]:
    """Results of requests (number, query, k) of one mode, in one search; k is at most MOST for each."""
    queries = index.postings.sparkSession.createDataFrame([x[:2] for x in asked], "qid string, query string")
    most = {qid: k for qid, _, k in asked}
    found: dict[str, list[dict]] = {qid: [] for qid in most}
    results = search_batch(index, queries, SearchOptions(max(most.values()), mode == "conjunctive", index.docs is not None))
    for r in results.orderBy("qid", "rank").toLocalIterator():
        if r["rank"] <= most[r.qid]:
            found[r.qid].append({"rank": r["rank"], "doc_id": r.doc_id, "score": r.score, "passage": r.passage})
    return found


def handle(index: Index, lines: Iterable[str], default_k: int = 10) -> Iterator[str]:
    """The response to each line that isn't blank, as soon as the line is read: a client may wait for it before its next line."""
    for line in lines:
        if not line.strip("\n"):
            continue
        try:
            q, k, mode = parse(line, default_k)
        except ValueError as e:
            yield _failed(e)
            continue
        yield json.dumps({"q": q, "results": _found(index, [("0", q, k)], mode)["0"]}, ensure_ascii=False)


def handle_together(index: Index, lines: Iterable[str], default_k: int = 10) -> list[str]:
    """The responses to lines that are all at hand, in their order: queries of one mode and k are one search."""
    answers: list[str | None] = []
    asked: dict[tuple[str, int], list[tuple[str, str, int]]] = {}
    for line in lines:
        if not line.strip("\n"):
            continue
        try:
            q, k, mode = parse(line, default_k)
            asked.setdefault((mode, k), []).append((str(len(answers)), q, k))
            answers.append(None)
        except ValueError as e:
            answers.append(_failed(e))
    for (mode, _), wanted in asked.items():
        found = _found(index, wanted, mode)
        for qid, q, _ in wanted:
            answers[int(qid)] = json.dumps({"q": q, "results": found[qid]}, ensure_ascii=False)
    return [a for a in answers if a is not None]


class Retriever:
    """Searches of an index by request lines, one at a time, as a client of the loop would."""

    def __init__(self, index: Index, default_k: int = 10) -> None:
        self.index, self.default_k, self._open = index, default_k, True

    def search(self, query: str, k: int | None = None, mode: str = MODES[0]) -> list[dict]:
        """The results; RuntimeError if the request is refused or the retriever is closed."""
        if not self._open:
            raise RuntimeError("the retriever is closed")
        reply = json.loads(next(handle(self.index, [json.dumps({"q": query, "k": self.default_k if k is None else k, "mode": mode})])))
        if "error" in reply:
            raise RuntimeError(reply["error"])
        return reply["results"]

    def close(self) -> None:
        self._open = False

    def __enter__(self) -> Retriever:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def interactive(index: Index, lines: Iterable[str], top_k: int = 10) -> Iterator[str]:
    """Answers as text, one query a line, until ``q`` or ``quit``."""
    for line in lines:
        query = line.rstrip("\n")
        if query in ("q", "quit"):
            return
        if not query:
            continue
        response = json.loads(next(handle(index, [json.dumps({"q": query, "k": top_k})])))
        if not response["results"]:
            yield "  (no results)"
        for r in response["results"]:
            cut = r["passage"].encode()[:120].decode("utf-8", "ignore")
            yield f"  {r['rank']}. score={r['score']:g} doc_id={r['doc_id']}" + (f"  | {cut}" if cut else "")


def serve_stream(spark: SparkSession, requests: str, responses: str, checkpoint: str, index: Index, default_k: int = 10) -> StreamingQuery:
    """Request files that arrive in a folder are answered batch by batch with (q, results) JSON files; invalid requests with errors.

    Every batch is one search of its valid queries against the static index."""
    schema = "q string, k int, mode string, _corrupt_record string"

    def answer(batch: DataFrame, number: int) -> None:
        rows = batch.where("value <> ''").select(F.monotonically_increasing_id().cast("string").alias("qid"), "value", F.from_json("value", schema).alias("r")).persist()
        k, mode = F.coalesce("r.k", F.lit(default_k)), F.coalesce("r.mode", F.lit(MODES[0]))
        good = rows.select("qid", F.coalesce("r.q", F.lit("")).alias("query"), k.alias("k"), mode.alias("mode"), (F.col("r").isNotNull() & F.col("r._corrupt_record").isNull() & k.between(1, MOST) & mode.isin(*MODES)).alias("valid"))
        parts = []
        for m in MODES:
            queries = good.where(F.col("valid") & (F.col("mode") == m))
            most = queries.agg(F.max("k")).first()[0]
            if most:
                found = search_batch(index, queries.select("qid", "query"), SearchOptions(most, m == "conjunctive", index.docs is not None))
                lists = queries.select("qid", "query", "k").join(found, "qid", "left").where("rank is null or rank <= k").groupBy("qid", "query").agg(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "doc_id", "score", "passage")))).alias("results"))
                parts.append(lists.select(F.to_json(F.struct(F.col("query").alias("q"), "results")).alias("value")))
        parts.append(good.where(~F.col("valid")).select(F.to_json(F.struct(F.lit("server: invalid request").alias("error"))).alias("value")))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        out.write.mode("overwrite").text(f"{responses}/batch={number}")  # a batch that is tried again replaces its own answers
        rows.unpersist()

    return spark.readStream.option("lineSep", "\n").text(requests).writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
