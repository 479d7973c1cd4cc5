"""The inverted index as DataFrames: postings, lexicon, document information, blocks, and what they would weigh encoded."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ferrowick.functions import bm25, codec
from ferrowick.operators import runs as ru
from ferrowick.operators.lineage import delete, exists, written
from ferrowick.operators.ranges import running, running_before

POSTINGS_PER_BLOCK = 128
#: Terms of a batch up to which they are compared as a list within the scan, and up to which they are broadcast.
FEW_TERMS, MOST_TERMS = 1_000, 1_000_000
BLOCK_RECORD_BYTES = 20
#: Files of each bucket's part of a lexicon.
LEXICON_PARTS = 4
#: A posting that is summed takes more memory than its share of the text.
MERGED_PER_PART = 4


def doc_info(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dl): tokens with repeated ones and stop words."""
    return ru.lengths(docs, id_col, text_col)


def corpus_stats(info: DataFrame) -> DataFrame:
    """One row (n, total_dl, avgdl); avgdl is 0 without documents."""
    return info.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_dl"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def postings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, dl, tf)."""
    return ru.counted(docs, id_col, text_col)


def posting_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, first, ids, dls, tfs): postings by term and chunk of documents, a row for each instead of one for each posting."""
    return ru.posting_runs(docs, id_col, text_col)


def packed_postings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> ru.Packed:
    """posting_runs packed by the partition that a term belongs to: what posting_deltas, posting_lists and blocks take without a sort by term."""
    return ru.packed_runs(docs, id_col, text_col)


def merge_postings(parts: DataFrame) -> DataFrame:
    """Postings of several builds: frequencies of the same term and document are added."""
    # brought together by document, in partitions in proportion to the table: what a task sums up doesn't grow with it
    together = parts.repartition(MERGED_PER_PART * ru.parts(parts), "doc_id")
    return together.groupBy("term", "doc_id", "dl").agg(F.sum("tf").cast("int").alias("tf"))


def posting_lists(rows: DataFrame | ru.Packed, per_block: int = POSTINGS_PER_BLOCK) -> DataFrame:
    """(term, block, n, postings) of postings or their runs: arrays in the order of doc_id, of ``per_block`` postings at most, so that no term's list has to fit in a row."""
    if per_block <= 0:
        raise ValueError("per_block must be above 0")
    return ru.packed_lists(rows, per_block) if isinstance(rows, ru.Packed) else ru.lists_of(ru.as_runs(rows), per_block)


def posting_deltas(rows: DataFrame | ru.Packed) -> DataFrame:
    """(term, doc_id, tf, pos, delta) of postings or their runs: distance to the term's document before, the first one absolute; it goes on across blocks."""
    return ru.packed_deltas(rows) if isinstance(rows, ru.Packed) else ru.deltas_of(ru.as_runs(rows))


def undelta(rows: DataFrame) -> DataFrame:
    """(term, doc_id, tf, pos) from (term, pos, delta, tf); an error for ids that don't rise and sums beyond 2**63 - 1."""
    together = rows.select("term", F.col("tf").cast("int").alias("tf"), F.col("pos").cast("int").alias("pos"), F.col("delta").cast("long").alias("delta"))
    return ru.undeltas_of(together.repartition(ru.parts(rows), "term").sortWithinPartitions("term", "pos"))


def delta_roundtrip(packed: ru.Packed) -> DataFrame:
    """undelta of posting_deltas, summed up in the task that makes the distances: there a term's are in order already."""
    return ru.packed_roundtrip(packed)


def check_blocks(block_rows: DataFrame) -> DataFrame:
    """The same rows; an error at the first block without postings or with a size under 1."""
    bad = F.coalesce((F.col("n_postings") < 1) | (F.col("doc_id_size") < 1) | (F.col("freq_size") < 1), F.lit(True))
    return block_rows.where(F.when(bad, F.raise_error(F.concat(F.lit("corrupt block of "), F.coalesce("term", F.lit("?")))).cast("boolean")).otherwise(True))


def first_at_least(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(term, target, doc_id, tf): each term's first posting from the target on, null if there is none; targets: (term, target)."""
    found = targets.join(rows, "term", "left").where((F.col("doc_id") >= F.col("target"))).groupBy("term", "target").agg(F.min("doc_id").alias("doc_id"), F.min_by("tf", "doc_id").alias("tf"))
    return targets.join(found, ["term", "target"], "left").select("term", "target", "doc_id", "tf")


def first_in_all(rows: DataFrame, targets: Sequence[int]) -> DataFrame:
    """first_at_least of the same targets in all terms: postings are counted once and aggregated where they are, and joined with nothing."""
    wanted = {f"at_{i}_": target for i, target in enumerate(sorted(set(targets)))}
    if not wanted:
        return rows.limit(0).select("term", F.lit(0).cast("long").alias("target"), "doc_id", "tf")
    reached = {name: F.when(F.col("doc_id") >= target, F.col("doc_id")) for name, target in wanted.items()}
    found = rows.groupBy("term").agg(*[f.alias(name + part) for name, c in reached.items() for part, f in (("doc_id", F.min(c)), ("tf", F.min_by("tf", c)))])
    return found.select("term", F.inline(F.array(*[F.struct(F.lit(target).cast("long").alias("target"), F.col(f"{name}doc_id").alias("doc_id"), F.col(f"{name}tf").alias("tf")) for name, target in wanted.items()])))


def seek(lists: DataFrame, targets: DataFrame) -> DataFrame:
    """first_at_least over posting_lists: of each term only the block is opened whose last document is the first not before the target."""
    last = F.element_at("postings", -1)["doc_id"]
    open_ = lists.select("term", "block", last.alias("last")).join(targets, "term").where("last >= target").groupBy("term", "target").agg(F.min("block").alias("block"))
    hit = F.filter("postings", lambda p: p["doc_id"] >= F.col("target"))[0]
    found = lists.join(open_, ["term", "block"]).select("term", "target", hit.alias("p")).select("term", "target", "p.doc_id", "p.tf")
    return targets.join(found, ["term", "target"], "left").select("term", "target", "doc_id", "tf")


def seek_in_all(packed: ru.Packed, targets: Sequence[int], per_block: int = POSTINGS_PER_BLOCK) -> DataFrame:
    """seek of the same targets in the posting lists of all terms, in the tasks that make them: lists and targets are neither kept nor joined."""
    if per_block <= 0:
        raise ValueError("per_block must be above 0")
    return ru.packed_seek(packed, targets, per_block)


def blocks(rows: DataFrame | ru.Packed, codec_name: str = "varbyte", per_block: int = POSTINGS_PER_BLOCK) -> DataFrame:
    """(term, block, last_doc_id, n_postings, doc_id_size, freq_size) of postings or their runs: ``per_block`` postings of a term at a time and their encoded sizes."""
    if per_block <= 0:
        raise ValueError("per_block must be above 0")
    if isinstance(rows, ru.Packed):
        return ru.packed_blocks(rows, codec.checked_codec(codec_name), per_block)
    return ru.blocks_of_runs(ru.as_runs(rows), (codec.checked_codec(codec_name),), per_block)


def block_offsets(block_rows: DataFrame) -> DataFrame:
    """blocks with start_offset: the bytes of all blocks before, in the order of term and block."""
    return running_before(block_rows.withColumn("bytes_", F.col("doc_id_size") + F.col("freq_size")), "bytes_", ["term", "block"], "start_offset").drop("bytes_")


def lexicon(block_rows: DataFrame) -> DataFrame:
    """(term, term_id, df, start_position, bytes_size), numbered in the order of the terms' bytes."""
    if {"start_offset", "term_id"} <= set(block_rows.columns):  # blocks that have been numbered and placed
        of_term = block_rows.groupBy("term").agg(F.min("term_id").cast("long").alias("term_id"), F.sum("n_postings").alias("df"), F.min("start_offset").alias("start_position"), F.sum(F.col("doc_id_size") + F.col("freq_size")).alias("bytes_size"))
        return of_term.select("term", "term_id", "df", "start_position", "bytes_size")
    terms = block_rows.groupBy("term").agg(F.sum("n_postings").alias("df"), F.sum(F.col("doc_id_size") + F.col("freq_size")).alias("bytes_size"))
    placed = running(terms, ["term"], sums={"start_position": F.col("bytes_size"), "term_id": F.lit(1)})
    return placed.select("term", F.col("term_id").cast("long"), "df", "start_position", "bytes_size")


def line_positions(docs: DataFrame, *, id_col: str = "doc_id", line: Column | None = None) -> DataFrame:
    """(doc_id, line_pos): where each line would begin in a file of ``line`` (by default doc_id, TAB, text in one line), a line end after each."""
    line = F.concat(F.col(id_col).cast("string"), F.lit("\t"), F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\n"), F.lit(" "))) if line is None else line
    sizes = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(line) + 1).cast("long").alias("bytes_"))
    return running_before(sizes, "bytes_", ["doc_id"], "line_pos").select("doc_id", "line_pos")


def sizes(block_rows: DataFrame) -> DataFrame:
    """One row: index_bytes, blocks_bytes, posting_store_bytes, n_blocks, n_postings, n_terms."""
    return block_rows.agg(
        F.coalesce(F.sum(F.col("doc_id_size") + F.col("freq_size")), F.lit(0)).cast("long").alias("index_bytes"),
        (F.count(F.lit(1)) * BLOCK_RECORD_BYTES).alias("blocks_bytes"),
        F.coalesce(F.sum(F.col("doc_id_size") + F.col("freq_size") + BLOCK_RECORD_BYTES), F.lit(0)).cast("long").alias("posting_store_bytes"),
        F.count(F.lit(1)).alias("n_blocks"),
        F.coalesce(F.sum("n_postings"), F.lit(0)).cast("long").alias("n_postings"),
        F.count_if(F.col("block") == 0).alias("n_terms"),
    )


def spill_of_documents(per_doc: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, n, segment) of a build that writes a run after the document at which the count reaches ``threshold``; per_doc: (doc_id, n).

    The cut depends on all documents before, so one task folds the pairs in their order; the memory that it takes is a batch's."""
    if threshold <= 0:
        raise ValueError("threshold must be above 0")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, total = 0, 0
        for b in batches:
            out = []
            for n in b.column(1).to_pylist():
                out.append(segment)
                total += n
                if total >= threshold:
                    segment, total = segment + 1, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], ["doc_id", "n", "segment"])

    pairs = per_doc.select(F.col("doc_id").cast("long"), F.col("n").cast("long"))
    return pairs.repartition(1).sortWithinPartitions("doc_id").mapInArrow(fold, "doc_id long, n long, segment int")


def spill_segments(per_doc: DataFrame, threshold: int) -> DataFrame:
    """(segment, first_doc, last_doc, n_postings) of the runs that hold postings."""
    runs = spill_of_documents(per_doc, threshold).groupBy("segment").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum("n").alias("n_postings"))
    return runs.where("n_postings > 0")


def term_weights(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) of postings or their runs; stats: one row."""
    df = F.sum(F.size("ids")) if "ids" in rows.columns else F.count(F.lit(1))
    return rows.groupBy("term").agg(df.alias("df")).crossJoin(stats.select("n")).select("term", "df", bm25.idf(F.col("n"), F.col("df")).alias("idf"))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


PARTS = ("postings", "lexicon", "blocks", "docinfo", "stats")
#: 2: postings in blocks, a row for each; document information with the number of postings.
FORMAT = 2
_KEPT = ("term", "block", "last_doc_id", "n_postings", "doc_id_size", "freq_size")


@dataclass
class Index:
    """What a search needs. Held as plans until ``save`` writes them; ``load`` reads them back."""

    postings: DataFrame
    lexicon: DataFrame
    stats: DataFrame
    docs: DataFrame | None = None
    #: Of a saved index: how many buckets its terms are in, and its further tables.
    buckets: int = 0
    blocks: DataFrame | None = None
    docinfo: DataFrame | None = None
    #: The postings by term and chunk of documents, if they come of texts.
    runs: DataFrame | None = None
    #: The same packed for a number of buckets, with what is known of the documents.
    pack: Callable[[int], ru.Packed] | None = None
    #: Of a saved index: its blocks with their postings (bucket, term, before, ids, dls, tfs).
    lists: DataFrame | None = None

    def save(self, path: str, buckets: int = 64, codec_name: str = "varbyte", per_block: int = POSTINGS_PER_BLOCK) -> None:
        """Write the postings with their blocks and byte offsets, the lexicon with term ids and positions, document information and statistics.

        Terms lie in buckets, a folder each, and within them in files sorted by term and document, so that a query's terms choose
        folders and row groups. A term of any length is cut into ranges. The description is written last; what a failure leaves is removed."""
        spark = self.postings.sparkSession
        try:
            if self.pack is not None:  # the texts are tokenised once
                packed = self.pack(buckets)
                packed = ru.Packed(written(packed.rows), packed.n)
                info = ru.info_of(packed)
            else:
                packed = ru.packed_rows(self.postings, buckets)
                info = self.docinfo if self.docinfo is not None else doc_info(self.docs) if self.docs is not None else self.postings.select("doc_id", "dl").distinct()
            info.write.mode("overwrite").parquet(f"{path}/docinfo")
            # counted from what is written, not from the texts again
            (self.stats if self.docinfo is None and self.docs is None else corpus_stats(spark.read.parquet(f"{path}/docinfo"))).write.mode("overwrite").parquet(f"{path}/stats")
            laid = ru.packed_blocks(packed, codec.checked_codec(codec_name), per_block, buckets).sortWithinPartitions("bucket", "term", "block")
            laid.write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(f"{path}/postings")
            block_rows = spark.read.schema(laid.schema).parquet(f"{path}/postings").select(*_KEPT)
            # a term's first block is numbered by the terms before
            placed = running(block_rows, ["term", "block"], sums={"start_offset": F.col("doc_id_size") + F.col("freq_size"), "term_id": (F.col("block") == 0).cast("int")})
            placed.write.mode("overwrite").parquet(f"{path}/blocks")
            terms = lexicon(spark.read.parquet(f"{path}/blocks")).crossJoin(F.broadcast(spark.read.parquet(f"{path}/stats").select("n")))  # one row
            terms = terms.withColumn("idf", bm25.idf(F.col("n"), F.col("df"))).drop("n").withColumn("bucket", _bucket(F.col("term"), buckets))
            terms.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(LEXICON_PARTS))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lexicon")
            about = {"format": FORMAT, "buckets": buckets, "codec": codec_name, "per_block": per_block}
            spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        except Exception:
            delete(spark, path)
            raise

    @classmethod
    def load(cls, spark: SparkSession, path: str, docs: DataFrame | None = None) -> Index:
        """A saved index; ValueError if it is incomplete or of another format."""
        missing = [p for p in (*PARTS, "about") if not exists(spark, f"{path}/{p}/_SUCCESS")]
        if missing:
            raise ValueError(f"no whole index at {path}: {', '.join(missing)} missing")
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        if about.get("format") != FORMAT:
            raise ValueError(f"format {about.get('format')} of {path} isn't {FORMAT}")
        parts = {p: spark.read.parquet(f"{path}/{p}") for p in PARTS}
        lists = parts["postings"]
        return cls(ru.flattened(lists), parts["lexicon"], parts["stats"], docs, about["buckets"], check_blocks(parts["blocks"].select(*_KEPT, "start_offset")), parts["docinfo"], lists=lists)

    def _of(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        """The rows of these terms, at most a batch's; of a saved index only their buckets are listed and read."""
        if self.buckets:
            rows = rows.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})))
        if len(terms) <= FEW_TERMS:
            return rows.where(F.col("term").isin(terms))
        names = rows.sparkSession.createDataFrame(pa.table({"term": pa.array(terms, pa.string())}))
        return rows.join(F.broadcast(names), "term", "left_semi")

    def postings_of(self, terms: list[str]) -> DataFrame:
        return self._of(self.postings, terms) if self.lists is None else ru.flattened(self._of(self.lists, terms))

    def weights(self, terms: list[str]) -> dict[str, float]:
        """The idf of those of the terms that the index has."""
        return {r.term: r.idf for r in self._of(self.lexicon, terms).select("term", "idf").orderBy("term").collect()} if terms else {}

    @cached_property
    def _stats(self) -> Row:
        return self.stats.first()

    def total_docs(self) -> int:
        return self._stats["n"]

    def avg_doc_length(self) -> float:
        return self._stats["avgdl"]


def build_index(docs: DataFrame, terms: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index of docs; with ``terms`` of these terms only, for a batch of queries that is known: then the texts are tokenised once, now."""
    if terms is not None:
        return _index_of(docs, terms, id_col, text_col)
    rows = postings(docs, id_col=id_col, text_col=text_col)
    info = doc_info(docs, id_col=id_col, text_col=text_col)
    stats = corpus_stats(info)
    runs = posting_runs(docs, id_col=id_col, text_col=text_col)
    return Index(rows, term_weights(runs, stats), stats, docs, docinfo=info, runs=runs, pack=lambda buckets: ru.packed_runs(docs, id_col, text_col, buckets=buckets, with_dl=True, with_info=True))


def _index_of(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> Index:
    # each document has a row without term beside its tokens', so that lengths and postings come of one pass
    names = terms.select("term").distinct()
    if names.count() <= MOST_TERMS:  # counted
        shared = docs.sparkSession.sparkContext.broadcast(names.toArrow()["term"].combine_chunks())
        rows = ru.counted(docs, id_col, text_col, lambda: shared.value, with_lengths=True)
    else:
        rows = ru.counted(docs, id_col, text_col, with_lengths=True).join(names.withColumn("known_", F.lit(True)), "term", "left").where("term is null or known_").drop("known_")
    rows = written(rows)
    n = F.coalesce(F.sum("tf"), F.lit(0))
    stats = rows.where("term is null").agg(n.alias("n"), F.coalesce(F.sum(F.col("tf") * F.col("dl").cast("long")), F.lit(0)).alias("total_dl")).select("n", "total_dl", F.when(F.col("n") > 0, F.col("total_dl") / F.col("n")).otherwise(0.0).alias("avgdl"))
    kept = rows.where("term is not null")
    return Index(kept, term_weights(kept, stats), stats, docs)


def build_stats(docs: DataFrame, codec_name: str = "varbyte") -> DataFrame:
    """One row: docs_processed, total_postings, final_terms, final_index_bytes."""
    found = sizes(blocks(packed_postings(docs), codec_name))
    return docs.agg(F.count(F.lit(1)).alias("docs_processed")).crossJoin(found.select(F.col("n_postings").alias("total_postings"), F.col("n_terms").alias("final_terms"), F.col("index_bytes").alias("final_index_bytes")))


def saved_stats(index: Index, spill_threshold: int) -> DataFrame:
    """build_stats of a saved index, and what a build that spills at ``spill_threshold`` postings would hold at most: spill_count, peak_partial_postings, peak_unique_terms."""
    found = sizes(index.blocks).select(F.col("n_postings").alias("total_postings"), F.col("n_terms").alias("final_terms"), F.col("index_bytes").alias("final_index_bytes"))
    if index.lists is not None and "n_terms" in index.docinfo.columns:
        per_doc = index.docinfo.groupBy("doc_id").agg(F.sum("n_terms").alias("n")).where("n > 0")
        lists = index.lists
    else:
        per_doc = index.postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        lists = index.lists if index.lists is not None else ru.packed_blocks(ru.packed_rows(index.postings), "varbyte", POSTINGS_PER_BLOCK, 1)
    segments = written(spill_of_documents(per_doc, spill_threshold)).groupBy("segment").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("n").alias("n")).toArrow()  # a row for each spill
    counts = index.postings.sparkSession.createDataFrame([(segments.num_rows, max(segments["n"].to_pylist(), default=0))], "spill_count long, peak_partial_postings long")
    terms = ru.terms_of_ranges(lists, segments.sort_by("segment")["last"].fill_null(ru.NO_ID).to_numpy())
    peak = terms.agg(F.coalesce(F.max("n"), F.lit(0)).alias("peak_unique_terms"))
    return index.docinfo.agg(F.count(F.lit(1)).alias("docs_processed")).crossJoin(found).crossJoin(counts).crossJoin(peak)


def invalid_postings(rows: DataFrame) -> DataFrame:
    """Postings that break the index: null or negative parts, frequencies under 1, a document twice in a term."""
    again = F.count(F.lit(1)).over(Window.partitionBy("term", "doc_id")) > 1
    return rows.withColumn("again_", again).where("again_ or term is null or doc_id is null or doc_id < 0 or tf is null or tf < 1").drop("again_")
