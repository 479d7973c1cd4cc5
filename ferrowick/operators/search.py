"""Ranked retrieval: batches of queries against an index.

The terms of a batch are looked up first: only their postings are read, by the buckets and row groups that they lie in. Those
postings are brought together by document, once, however many queries want them; each task then scores every query
of the batch over its own documents, a chunk of them at a time, and gives no more than the k best of each. So what is shuffled are postings of the batch's
terms and k rows a query and task, never a row for each query, token and document.

A batch reaches the tasks by broadcast, at most ``BATCH_TOKENS`` tokens of it at a time: more queries take more passes.

Partial scores are added in the order of the query's tokens. Ranks follow the score rounded to nine digits, then
doc_id: engines differ in the last bits of a logarithm, and equal scores should tie everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrowick.functions.bm25 import K1, B
from ferrowick.functions.text import passage, query_tokens
from ferrowick.operators.index import Index, build_index
from ferrowick.operators.lineage import cut_lineage
from ferrowick.operators.runs import parts as partitions

MOST = 100_000
BATCH_TOKENS = 200_000
#: Results up to which their documents are looked up by a broadcast of the ids.
FEW_RESULTS = 1_000_000
#: Postings that a task scores at a time, and results that it holds.
CHUNK_POSTINGS, HELD_RESULTS = 1 << 18, 4_000_000
#: Scores that round to nine digits alike differ by less.
_CLOSE = 2e-9


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = 10
    conjunctive: bool = False
    fill_passage: bool = False


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, pos, term) of (qid, query), stop words dropped, repeated tokens kept."""
    return queries.select("qid", F.posexplode(query_tokens(F.col("query")))).select("qid", "pos", F.col("col").alias("term"))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best and of those whose scores are close to theirs."""
    found = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - _CLOSE)
    if len(found) > k:  # of equal scores the k least ids suffice
        found = found[np.lexsort((ids[found], -scores[found]))]
        first = np.append(True, np.diff(scores[found]) != 0)
        run = np.arange(len(found)) - np.maximum.accumulate(np.where(first, np.arange(len(found)), 0))
        found = found[run < k]
    return found


@dataclass
class Batch:
    """Queries as codes of terms in the order of their tokens, for a broadcast; of tokens that the index knows."""

    qids: pa.Array
    queries: list[np.ndarray]
    terms: pa.Array
    idf: np.ndarray
    avgdl: float

    def score(self, table: pa.Table, k: int | None, conjunctive: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, doc_ids, scores) over postings (term, doc_id, dl, tf), all of these documents' for the batch's terms: the best of each query, with a few more where scores are close; all without k."""
        ids, at = np.unique(table["doc_id"].to_numpy(), return_inverse=True)
        code = pc.index_in(table["term"].combine_chunks(), self.terms).to_numpy()
        dl, tf = table["dl"].to_numpy(), table["tf"].to_numpy()
        part = self.idf[code] * (tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * dl / self.avgdl)))
        order = np.argsort(code, kind="stable")
        at, part = at[order], part[order]
        cut = np.searchsorted(code[order], np.arange(len(self.idf) + 1))
        for q, codes in enumerate(self.queries):
            total, matched = np.zeros(len(ids)), np.zeros(len(ids), np.int32)
            for c in codes.tolist():
                own = slice(cut[c], cut[c + 1])
                np.add.at(total, at[own], part[own])
                np.add.at(matched, at[own], 1)
            found = np.flatnonzero(matched == len(codes) if conjunctive else matched)
            if k is not None and len(found) > k:
                found = found[_best(ids[found], total[found], k)]
            if len(found):
                yield q, ids[found], total[found]


def _batches(index: Index, terms: DataFrame) -> Iterator[tuple[list[str], Broadcast]]:
    """The terms wanted and the batch, for blocks of the queries (qid, pos, term)."""
    spark, avgdl = terms.sparkSession, index.avg_doc_length()
    first = terms.limit(BATCH_TOKENS + 1).toArrow()
    blocks = 1 if first.num_rows <= BATCH_TOKENS else -(-terms.count() // BATCH_TOKENS)
    for block in range(blocks):
        tokens = first if blocks == 1 else terms.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).toArrow()  # about BATCH_TOKENS rows
        tokens = tokens.sort_by([("qid", "ascending"), ("pos", "ascending")])
        known = index.weights(pc.unique(tokens["term"]).to_pylist())
        names = pa.array(list(known), pa.string())
        code = pc.index_in(tokens["term"].combine_chunks(), names)
        tokens = tokens.append_column("code", code).filter(pc.is_valid(code))
        if not tokens.num_rows:
            continue
        qid = tokens["qid"].combine_chunks()
        runs = pc.dictionary_encode(qid)
        runs = runs.combine_chunks() if isinstance(runs, pa.ChunkedArray) else runs
        starts = np.flatnonzero(np.append(True, np.diff(runs.indices.to_numpy()) != 0))
        codes = np.split(tokens["code"].to_numpy(), starts[1:])
        batch = Batch(qid.take(pa.array(starts)), codes, names, np.array(list(known.values())), avgdl)
        yield list(known), spark.sparkContext.broadcast(batch)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Postings in the order of doc_id, CHUNK_POSTINGS at a time, twice that at most, or as many as one document has: a document's are together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        for at in range(0, b.num_rows, CHUNK_POSTINGS):
            part = b.slice(at, CHUNK_POSTINGS)
            ids = part["doc_id"].to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(ids, ids[-1]))  # the last document may go on
            if held and n + cut > CHUNK_POSTINGS and held[-1]["doc_id"][-1].as_py() != ids[0]:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            if n + cut >= CHUNK_POSTINGS and cut:
                yield pa.Table.from_batches([*held, part.slice(0, cut)])
                held, n, part = [], 0, part.slice(cut)
            held.append(part)
            n += part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def best_of(batch: Batch, tables: Iterator[pa.Table], k: int | None, conjunctive: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Batch.score of tables of different documents; with k the best of all of them together, unless that is more than HELD_RESULTS."""
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held = 0
    for table in tables:
        for q, ids, scores in batch.score(table, k, conjunctive):
            if k is None:
                yield q, ids, scores
                continue
            if q in best:
                held -= len(best[q][0])
                ids, scores = np.append(best[q][0], ids), np.append(best[q][1], scores)
                if len(ids) > k:
                    kept = _best(ids, scores, k)
                    ids, scores = ids[kept], scores[kept]
            best[q] = ids, scores
            held += len(ids)
        if held > HELD_RESULTS:
            yield from ((q, *found) for q, found in best.items())
            best, held = {}, 0
    yield from ((q, *found) for q, found in best.items())


def scored(index: Index, terms: DataFrame, *, k: int | None = None, conjunctive: bool = False) -> DataFrame:
    """(qid, doc_id, score) for query tokens (qid, pos, term): any token matches, or with ``conjunctive`` every one that the lexicon knows. With k no more than the k best of a task's documents, and those close to them."""
    kind = terms.schema["qid"].dataType.simpleString()
    schema = f"qid {kind}, doc_id long, score double"
    names = ["qid", "doc_id", "score"]
    parts = []
    for wanted, shared in _batches(index, terms):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for q, ids, scores in best_of(shared.value, _documents(batches), k, conjunctive):
                yield pa.RecordBatch.from_arrays([shared.value.qids.take(pa.array(np.full(len(ids), q))), pa.array(ids), pa.array(scores)], names)

        own = index.postings_of(wanted).select("term", "doc_id", "dl", "tf")
        parts.append(own.repartition(4 * partitions(own), "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, schema))
    return reduce(DataFrame.union, parts) if parts else terms.sparkSession.createDataFrame([], schema)


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank) of the k best of each query; none for k under 1."""
    if k < 1:
        rows = rows.limit(0)
    best = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(k, 0))


def with_passages(results: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Results with the beginning of their text, empty if the document is missing. After the top k; unless the results are very many only their documents' texts are moved."""
    results = cut_lineage(results)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if results.count() <= FEW_RESULTS:
        texts = texts.join(F.broadcast(results.select("doc_id").distinct()), "doc_id", "left_semi")  # counted
    return results.join(texts.select("doc_id", passage(F.col("text")).alias("passage")), "doc_id", "left").withColumn("passage", F.coalesce("passage", F.lit("")))


def search_batch(index: Index, queries: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(qid, doc_id, score, rank, passage) of all queries."""
    k = max(options.top_k, 0)
    found = top_k(scored(index, query_terms(queries), k=k, conjunctive=options.conjunctive) if k else queries.sparkSession.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, doc_id long, score double"), k)
    if options.fill_passage and index.docs is not None:
        found = with_passages(found, index.docs)
    else:
        found = found.withColumn("passage", F.lit(""))
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank", "passage")


def index_for(docs: DataFrame, queries: DataFrame) -> Index:
    """An index of docs for these queries only: the texts are read once, and only postings of the queries' terms are kept."""
    return build_index(docs, query_terms(queries))


def search_documents(docs: DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """search_batch without an index at hand: only the queries' terms are counted, in one pass over the documents."""
    return search_batch(index_for(docs, queries), queries, options)


def search(index: Index, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    spark: SparkSession = index.postings.sparkSession
    return search_batch(index, spark.createDataFrame([("0", query)], "qid string, query string"), options).drop("qid")


def candidates(index: Index, queries: DataFrame, *, conjunctive: bool = False) -> DataFrame:
    """(qid, doc_id) that match, unranked: the union of the terms' postings or their intersection."""
    return scored(index, query_terms(queries), conjunctive=conjunctive).select("qid", "doc_id")


def with_judgements(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """The queries that have judgements."""
    return queries.join(qrels.select("qid").distinct(), "qid", "left_semi")


def query_slice(queries: DataFrame, order_col: str, offset: int = 0, limit: int = 0) -> DataFrame:
    """A slice of a query list; limit 0 is all. An empty slice is an error."""
    part = queries.orderBy(order_col).offset(max(offset, 0))
    part = part.limit(limit) if limit > 0 else part
    if part.isEmpty():
        raise ValueError("the slice holds no queries")
    return part
