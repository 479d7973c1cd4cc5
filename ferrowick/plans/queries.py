"""Registered queries over the driver's tables, and the SQL that gives the same rows.

The collection is ``documents``; the queries are all tokens, without stop words, of each ``benchmark`` text; the
judgements are the documents that hold that text. The queries named after a source or sink write a file from the tables to the
shared folder and read it back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrowick.functions import bm25, codec
from ferrowick.functions.text import INSTRUCTIONS, STOP_WORDS, human_bytes, prompt, query_tokens, tokenize
from ferrowick.operators import evaluate as ev
from ferrowick.operators import index as ix
from ferrowick.operators import runs as ru
from ferrowick.operators import search as se
from ferrowick.operators.lineage import cut_lineage, shared_folder
from ferrowick.sources import files, sinks

QUERIES = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(query_tokens(F.col("text")), " ").alias("query"))


def literal_queries(spark: SparkSession, *queries: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(queries)), "qid long, query string")


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, doc_id, rel): documents that hold a benchmark text. Found by the tokens two to six of the text, which any text that holds it has too, then compared whole. The few texts of under seven tokens have no such key and are compared with every document."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("item"))
    counted = items.select("*", F.size(tokenize(F.col("item"))).alias("n"))
    slices = lambda df: (df.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for n in [max(1, -(-df.count() // FEW_ITEMS))] for i in range(n))  # noqa: E731 FEW_ITEMS at a time
    long = [ru.holders(documents(spark, sf_dir), part.select("qid", "item")) for part in slices(counted.where("n >= 7"))]
    short = [documents(spark, sf_dir).join(F.broadcast(part), F.contains("text", "item")).select("qid", "doc_id") for part in slices(counted.where("n < 7"))]
    return reduce(DataFrame.union, [*long, *short]).select("qid", "doc_id", F.lit(1).alias("rel")).distinct()


#: Items that are broadcast together.
FEW_ITEMS = 500_000
_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
_TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda x: lower(x))"
_QUERY_TOKENS = f"list_filter({_TOKENS}, lambda t: t NOT IN ({_STOP}))"
_BENCH = f"q AS (SELECT item_id AS qid, array_to_string({_QUERY_TOKENS.format('text')}, ' ') AS query FROM benchmark)"
_POST = f"""tok AS (SELECT doc_id, text, {_TOKENS.format('text')} AS tokens FROM documents),
info AS (SELECT doc_id, len(tokens)::INT AS dl FROM tok),
post AS (SELECT term, doc_id, count(*)::INT AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY ALL),
st AS (SELECT count(*) AS n, sum(dl)::BIGINT AS total_dl, coalesce(avg(dl), 0) AS avgdl FROM info),
lex AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
_IDF = "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE)"
_NORM = "tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
_PLACED = """placed AS (SELECT term, doc_id, tf, row_number() OVER w AS pos, doc_id - coalesce(lag(doc_id) OVER w, 0) AS delta FROM post WINDOW w AS (PARTITION BY term ORDER BY doc_id))"""


def _vb(v: str) -> str:
    return f"(1 + ({v} >= 128)::INT + ({v} >= 16384)::INT + ({v} >= 2097152)::INT + ({v} >= 268435456)::INT)"


_BLOCKS = f"""blk AS (SELECT term, ((pos - 1) // 128)::INT AS block, max(doc_id) AS last_doc_id, count(*) AS n_postings, sum({_vb('delta')})::BIGINT AS doc_id_size, sum({_vb('tf')})::BIGINT AS freq_size
 FROM placed GROUP BY ALL)"""


def _hits(q: str, having: str = "") -> str:
    return f"""{q}, {_POST},
qt AS (SELECT qid, t.pos, t.term FROM (SELECT qid, unnest(list_transform(range(1, len(ts) + 1), lambda i: {{'pos': i, 'term': ts[i]}})) AS t FROM (SELECT qid, {_QUERY_TOKENS.format('query')} AS ts FROM q))),
known AS (SELECT qt.*, df, count(*) OVER (PARTITION BY qid) AS wanted FROM qt JOIN lex USING (term)),
scored AS (SELECT qid, p.doc_id, sum({_IDF} * ({_NORM}) ORDER BY pos) AS score, count(*) AS matched, any_value(wanted) AS wanted
 FROM known JOIN post p USING (term) JOIN info USING (doc_id), st GROUP BY qid, p.doc_id {having}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)"""


_ALL = "HAVING count(*) = any_value(wanted)"
_RESULT = "SELECT qid, doc_id, round(score, 6) AS score, rank::INT AS rank, '' AS passage FROM ranked WHERE rank <= {0}"


def _literal(*queries: str) -> str:
    return "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in enumerate(queries)) + ") AS v(qid, query))"


# Index

@registered(f"WITH {_POST} SELECT doc_id, tokens FROM tok")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tokenize(F.col("text")).alias("tokens"))


@registered(f"SELECT page_id, {_TOKENS.format('html')} AS tokens FROM pages")
def html_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tokenize(F.col("html")).alias("tokens"))


@registered(f"SELECT conv_id, turn, {_QUERY_TOKENS.format('text')} AS tokens FROM conversations")
def conversation_query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", query_tokens(F.col("text")).alias("tokens"))


@registered(f"WITH {_POST} SELECT doc_id, dl FROM info")
def doc_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.doc_info(documents(spark, sf_dir))


@registered(f"WITH {_POST} SELECT n, total_dl, round(avgdl, 9) AS avgdl FROM st")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.corpus_stats(ix.doc_info(documents(spark, sf_dir))).withColumn("avgdl", F.round("avgdl", 9))


@registered(f"WITH {_POST} SELECT term, doc_id, dl, tf FROM post JOIN info USING (doc_id)")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings(documents(spark, sf_dir))


@registered(f"WITH {_POST} SELECT term, doc_id, dl, tf FROM post JOIN info USING (doc_id)")
def merged_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three builds over parts of the collection, merged."""
    docs = documents(spark, sf_dir)
    parts = [ix.postings(docs.where(F.pmod("doc_id", F.lit(3)) == i)) for i in range(3)]
    return ix.merge_postings(parts[0].union(parts[1]).union(parts[2]))


@registered(f"WITH {_POST}, {_PLACED} SELECT term, ((pos - 1) // 128)::INT AS block, count(*) AS n, list(doc_id ORDER BY doc_id) AS doc_ids, list(tf ORDER BY doc_id) AS tfs FROM placed GROUP BY ALL")
def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.posting_lists(ix.packed_postings(documents(spark, sf_dir))).select("term", "block", "n", F.col("postings.doc_id").alias("doc_ids"), F.col("postings.tf").alias("tfs"))


@registered(f"WITH {_POST} SELECT term, df FROM lex")
def lexicon_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings(documents(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@registered(f"WITH {_POST}, {_PLACED} SELECT term, doc_id, tf, pos::INT AS pos, delta FROM placed")
def posting_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.posting_deltas(ix.packed_postings(documents(spark, sf_dir)))


@registered(f"WITH {_POST}, {_PLACED} SELECT term, doc_id, tf, pos::INT AS pos FROM placed")
def delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.delta_roundtrip(ix.packed_postings(documents(spark, sf_dir)))


@registered(f"WITH {_POST}, {_PLACED}, {_BLOCKS} SELECT * FROM blk")
def block_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.blocks(ix.packed_postings(documents(spark, sf_dir)))


@registered(f"WITH {_POST}, {_PLACED}, {_BLOCKS} SELECT *, coalesce(sum(doc_id_size + freq_size) OVER (ORDER BY term, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM blk")
def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.block_offsets(ix.blocks(ix.packed_postings(documents(spark, sf_dir))))


@registered(
    f"""WITH {_POST}, {_PLACED}, {_BLOCKS}, t AS (SELECT term, sum(n_postings)::BIGINT AS df, sum(doc_id_size + freq_size)::BIGINT AS bytes_size FROM blk GROUP BY term)
SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, coalesce(sum(bytes_size) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_position, bytes_size FROM t"""
)
def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.lexicon(ix.blocks(ix.packed_postings(documents(spark, sf_dir))))


_SIZES = f"WITH {_POST}, {_PLACED}, {_BLOCKS}, s AS (SELECT sum(doc_id_size + freq_size)::BIGINT AS index_bytes, (count(*) * 20)::BIGINT AS blocks_bytes, count(*) AS n_blocks, sum(n_postings)::BIGINT AS n_postings, count(*) FILTER (block = 0) AS n_terms FROM blk)"


@registered(
    f"""{_SIZES}, r AS (SELECT 'varbyte' AS codec, index_bytes, * EXCLUDE (index_bytes) FROM s UNION ALL SELECT 'raw32', 8 * n_postings, * EXCLUDE (index_bytes) FROM s)
SELECT codec, index_bytes, blocks_bytes, index_bytes + blocks_bytes AS posting_store_bytes, n_blocks, n_postings, n_terms FROM r"""
)
def codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ix.packed_postings(documents(spark, sf_dir))
    both = [ix.sizes(ix.blocks(runs, c)).select(F.lit(c).alias("codec"), "*") for c in codec.CODECS]
    return both[0].union(both[1])


@registered(f"{_SIZES} SELECT round((index_bytes + blocks_bytes) / (8 * n_postings + blocks_bytes), 6) AS ratio, format('{{:.2f}} MB', index_bytes / 1048576) AS index_size FROM s WHERE index_bytes BETWEEN 1048576 AND 1073741823 UNION ALL SELECT round((index_bytes + blocks_bytes) / (8 * n_postings + blocks_bytes), 6), format('{{:.2f}} KB', index_bytes / 1024) FROM s WHERE index_bytes < 1048576")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ix.sizes(ix.blocks(ix.packed_postings(documents(spark, sf_dir))))
    return s.select(F.round(F.col("posting_store_bytes") / (8 * F.col("n_postings") + F.col("blocks_bytes")), 6).alias("ratio"), human_bytes(F.col("index_bytes")).alias("index_size"))


@registered("SELECT doc_id, coalesce(sum(strlen(doc_id::VARCHAR || chr(9) || text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_pos FROM documents")
def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.line_positions(documents(spark, sf_dir))


@registered(f"{_SIZES} SELECT (SELECT count(*) FROM documents) AS docs_processed, n_postings AS total_postings, n_terms AS final_terms, index_bytes AS final_index_bytes FROM s")
def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.build_stats(documents(spark, sf_dir))


_WALK = f"""WITH RECURSIVE {_POST}, per AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, len(list_distinct(tokens))::BIGINT AS n FROM tok),
walk AS (SELECT i, doc_id, 0 AS segment, n AS total FROM per WHERE i = 1
 UNION ALL SELECT p.i, p.doc_id, CASE WHEN w.total >= 50000 THEN w.segment + 1 ELSE w.segment END, CASE WHEN w.total >= 50000 THEN p.n ELSE w.total + p.n END FROM walk w JOIN per p ON p.i = w.i + 1)"""


@registered(f"{_WALK} SELECT segment, min(doc_id) AS first_doc, max(doc_id) AS last_doc, max(total)::BIGINT AS n_postings FROM walk GROUP BY segment")
def spill_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc = documents(spark, sf_dir).select("doc_id", F.size(F.array_distinct(tokenize(F.col("text")))).cast("long").alias("n"))
    return ix.spill_segments(per_doc, 50_000)


@registered(
    f"""WITH {_POST}, broken AS (SELECT term, CASE WHEN doc_id % 11 = 0 THEN -doc_id ELSE doc_id END AS doc_id, dl, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE tf END AS tf FROM post JOIN info USING (doc_id)
 UNION ALL SELECT term, doc_id, dl, tf FROM post JOIN info USING (doc_id) WHERE doc_id % 5 = 0),
seen AS (SELECT *, count(*) OVER (PARTITION BY term, doc_id) AS n FROM broken)
SELECT doc_id, count(*) AS n_invalid FROM seen WHERE n > 1 OR doc_id < 0 OR tf < 1 GROUP BY doc_id"""
)
def index_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with negative ids, frequencies of 0 and documents twice in a term put among them, found by document."""
    rows = ix.postings(documents(spark, sf_dir))
    broken = rows.select("term", F.when(F.col("doc_id") % 11 == 0, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), "dl", F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("tf")).alias("tf"))
    return ix.invalid_postings(broken.unionByName(rows.where("doc_id % 5 = 0"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_invalid"))


_TARGETS = (0, 3, 100, 250, 10**9)
_SEEK = f"""WITH {_POST}, t AS (SELECT DISTINCT term, unnest({list(_TARGETS)})::BIGINT AS target FROM post),
f AS (SELECT t.term, t.target, min(doc_id) AS doc_id FROM t JOIN post ON post.term = t.term AND doc_id >= target GROUP BY ALL)
SELECT t.term, t.target, coalesce(f.doc_id, -1) AS doc_id, coalesce(post.tf, -1)::INT AS tf FROM t LEFT JOIN f USING (term, target) LEFT JOIN post ON post.term = f.term AND post.doc_id = f.doc_id"""


def _sought(found: DataFrame) -> DataFrame:
    return found.select("term", "target", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("tf", F.lit(-1)).alias("tf"))


@registered(_SEEK)
def first_posting_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sought(ix.first_in_all(ix.postings(documents(spark, sf_dir)), _TARGETS))


@registered(_SEEK)
def posting_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_posting_from by the blocks of posting lists."""
    return _sought(ix.seek_in_all(ix.packed_postings(documents(spark, sf_dir)), _TARGETS))


@registered(f"WITH {_POST}, {_PLACED} SELECT term, pos::INT AS pos, {_vb('delta')}::INT AS delta_bytes, {_vb('tf')}::INT AS tf_bytes, delta AS decoded FROM placed")
def varbyte_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ix.posting_deltas(ix.packed_postings(documents(spark, sf_dir)))
    return rows.select("term", "pos", codec.varbyte_length(F.col("delta")).alias("delta_bytes"), F.octet_length(codec.encode(F.col("tf"))).alias("tf_bytes"), codec.decode(codec.encode(F.col("delta"))).alias("decoded"))


@registered(f"WITH {_POST}, {_PLACED} SELECT term, pos::INT AS pos, delta AS decoded FROM placed")
def raw32_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ix.posting_deltas(ix.packed_postings(documents(spark, sf_dir)))
    return rows.select("term", "pos", codec.decode(codec.encode(F.col("delta"), "raw32"), "raw32").alias("decoded"))


# Ranking

@registered(f"WITH {_POST} SELECT term, df, round({_IDF}, 9) AS idf FROM lex, st")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.build_index(documents(spark, sf_dir)).lexicon.select("term", "df", F.round("idf", 9).alias("idf"))


@registered(f"WITH {_POST} SELECT term, doc_id, round({_IDF} * ({_NORM}), 6) AS score FROM post JOIN info USING (doc_id) JOIN lex USING (term), st")
def bm25_term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ix.build_index(documents(spark, sf_dir))
    df = F.sum(F.size("ids")).over(Window.partitionBy("term"))
    runs = index.runs.repartition(ru.parts(index.runs), "term").withColumn("df", df).crossJoin(F.broadcast(index.stats))  # one row
    return ru.term_scores(runs.withColumn("idf", bm25.idf(F.col("n"), F.col("df")))).withColumn("score", F.round("score", 6))


def _search(k: int = 10, conjunctive: bool = False, passages: bool = False, *literal: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        queries = literal_queries(spark, *literal) if literal else benchmark_queries(spark, sf_dir)
        return se.search_documents(documents(spark, sf_dir), queries, se.SearchOptions(k, conjunctive, passages))

    return run


def _named(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


_LITERALS = {
    "search_duplicate_terms": (False, ("and and with there there", "tion tion", "la la le")),
    "search_oov_conjunctive": (True, ("tion zzzzqqq", "zzzzqqq", "ther zzzzqqq tion")),
    "search_stopwords_only": (False, ("the of", "and to a")),
}
_named("search_disjunctive_top10", _search(), f"WITH {_hits(_BENCH)} {_RESULT.format(10)}")
_named("search_top1000", _search(1000), f"WITH {_hits(_BENCH)} {_RESULT.format(1000)}")
_named("search_conjunctive_top10", _search(10, True), f"WITH {_hits(_BENCH, _ALL)} {_RESULT.format(10)}")
_named("search_nothing_wanted", _search(0), f"WITH {_hits(_BENCH)} {_RESULT.format(0)}")
for _name, (_mode, _texts) in _LITERALS.items():
    _named(_name, _search(10, _mode, False, *_texts), f"WITH {_hits(_literal(*_texts), _ALL if _mode else '')} {_RESULT.format(10)}")


# 512 bytes, back to where a character begins
_PASSAGE = "coalesce((SELECT max(substring(text, 1, k)) FROM range(1, 513) t(k) WHERE strlen(substring(text, 1, k)) <= 512), '')"


@registered(f"WITH {_hits(_BENCH)} SELECT qid, doc_id, round(score, 6) AS score, rank::INT AS rank, {_PASSAGE} AS passage FROM ranked JOIN documents USING (doc_id) WHERE rank <= 10")
def search_with_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(10, False, True)(spark, sf_dir)


@registered(f"WITH {_hits(_BENCH)} SELECT qid, doc_id FROM scored")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = benchmark_queries(spark, sf_dir)
    return se.candidates(se.index_for(documents(spark, sf_dir), queries), queries)


@registered(f"WITH {_hits(_BENCH, _ALL)} SELECT qid, doc_id FROM scored")
def candidate_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = benchmark_queries(spark, sf_dir)
    return se.candidates(se.index_for(documents(spark, sf_dir), queries), queries, conjunctive=True)


# Runs, responses, evaluation

_QRELS = "qrels AS (SELECT item_id AS qid, doc_id, 1 AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@registered(f"WITH {_QRELS} SELECT * FROM qrels")
def derived_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgements(spark, sf_dir)


@registered(f"WITH {_BENCH}, {_QRELS} SELECT * FROM q WHERE qid IN (SELECT qid FROM qrels)")
def query_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.with_judgements(benchmark_queries(spark, sf_dir), judgements(spark, sf_dir))


@registered(f"WITH {_BENCH} SELECT * FROM q WHERE qid >= 5 AND qid < 15")
def query_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.query_slice(benchmark_queries(spark, sf_dir), "qid", 5, 10)


@registered(f"WITH {_hits(_BENCH)} SELECT qid, rank::INT AS rank, qid || ' Q0 ' || doc_id || ' ' || rank || ' ' || printf('%.6f', round(score, 6)) || ' ferrowick' AS value FROM ranked WHERE rank <= 1000")
def run_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.run_lines(_search(1000)(spark, sf_dir))


@registered(
    f"""WITH {_hits(_BENCH)}, top AS (SELECT qid, to_json(list({{'rank': rank::INT, 'doc_id': doc_id, 'score': round(score, 6), 'passage': {_PASSAGE}}} ORDER BY rank)) AS results FROM ranked JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY qid)
SELECT qid, '{{"q":' || to_json(query)::VARCHAR || ',"results":' || coalesce(results::VARCHAR, '[]') || '}}' AS response FROM q LEFT JOIN top USING (qid)"""
)
def json_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = benchmark_queries(spark, sf_dir)
    return sinks.responses(queries, se.search_documents(documents(spark, sf_dir), queries, se.SearchOptions(10, False, True)))


_PROMPT = " ".join(INSTRUCTIONS).replace("'", "''")


@registered(
    f"""WITH {_hits(_BENCH)}, p AS (SELECT qid, rank, doc_id, {_PASSAGE} AS passage FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5)
SELECT qid, '{_PROMPT}' || chr(10) || chr(10) || 'Passages:' || chr(10) || string_agg('[' || doc_id || '] ' || trim(replace(passage, chr(10), ' ')), chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(query) || chr(10) || 'Answer:' AS prompt
FROM p JOIN q USING (qid) GROUP BY qid"""
)
def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _search(5, False, True)(spark, sf_dir).groupBy("qid").agg(F.collect_list(F.struct("rank", "doc_id", "score", "passage")).alias("passages"))
    return benchmark_queries(spark, sf_dir).join(found, "qid").select("qid", prompt(F.col("query"), F.col("passages")).alias("prompt"))


_JUDGED = f"""WITH {_hits(_BENCH)}, {_QRELS}, run AS (SELECT qid, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 1000),
placed AS (SELECT r.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id::VARCHAR DESC) AS place FROM run r WHERE qid IN (SELECT qid FROM qrels)),
hit AS (SELECT p.qid, place, row_number() OVER (PARTITION BY p.qid ORDER BY place) AS before FROM placed p JOIN qrels USING (qid, doc_id)),
rel AS (SELECT qid, relevant, list_sum(list_transform(range(1, least(10, relevant) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM (SELECT qid, count(*) AS relevant FROM qrels GROUP BY qid)),
sums AS (SELECT qid, sum(1 / log2(place + 1)) FILTER (place <= 10) AS dcg, count(*) AS recalled, sum(before / place) AS precision, min(place) AS first FROM hit GROUP BY qid),
per AS (SELECT qid, round(coalesce(dcg / ideal, 0), 9) AS ndcg_cut_10, round(coalesce(recalled / relevant, 0), 9) AS recall_1000, round(coalesce(precision / relevant, 0), 9) AS map, round(coalesce(1 / first, 0), 9) AS recip_rank
 FROM (SELECT DISTINCT qid FROM placed) JOIN rel USING (qid) LEFT JOIN sums USING (qid))"""


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(1000)(spark, sf_dir)


@registered(f"{_JUDGED} SELECT * FROM per")
def metrics_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = ev.per_query(cut_lineage(judgements(spark, sf_dir)), _run(spark, sf_dir))
    return per.select("qid", *[F.round(c, 9).alias(c) for c in per.columns[1:]])


_MRR = "(SELECT avg(coalesce(rr, 0)) FROM (SELECT qid, (SELECT 1 / min(rank) FROM run r JOIN qrels x USING (qid, doc_id) WHERE r.qid = g.qid AND rank <= 10) AS rr FROM (SELECT DISTINCT qid FROM qrels) g))"


@registered(f"{_JUDGED} SELECT round({_MRR}, 9) AS mrr_cut_10")
def mrr_cut_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.mrr_cut(cut_lineage(judgements(spark, sf_dir)), _run(spark, sf_dir)).select(F.round("mrr_cut_10", 9).alias("mrr_cut_10"))


@registered(f"{_JUDGED} SELECT round(avg(ndcg_cut_10), 6) AS ndcg_cut_10, round(avg(recall_1000), 6) AS recall_1000, round(avg(map), 6) AS map, round(avg(recip_rank), 6) AS recip_rank, round({_MRR}, 6) AS mrr_cut_10, count(*) AS num_queries FROM per")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ev.evaluate(cut_lineage(judgements(spark, sf_dir)), cut_lineage(_run(spark, sf_dir)))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns[:-1]], "num_queries")


@registered("WITH s AS (SELECT n_chars::DOUBLE AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT p::DOUBLE AS p, v AS value FROM s, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) t(p) WHERE i = least(floor(p * n), n - 1)")
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.percentiles(table(spark, sf_dir, "documents").select(F.col("n_chars").cast("double").alias("v")), "v")


# A saved index, sources and sinks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _saved(spark: SparkSession, sf_dir: str) -> ix.Index:
    docs, path = documents(spark, sf_dir), _folder(spark, "index")
    ix.build_index(docs).save(path)
    return ix.Index.load(spark, path, docs)


@registered(f"WITH {_hits(_BENCH)} {_RESULT.format(10)}")
def saved_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_disjunctive_top10 against an index that was written and read."""
    return se.search_batch(_saved(spark, sf_dir), benchmark_queries(spark, sf_dir))


@registered(
    f"""{_WALK}, {_PLACED}, {_BLOCKS}, held AS (SELECT segment, max(total)::BIGINT AS n FROM walk GROUP BY segment), terms AS (SELECT segment, count(DISTINCT term) AS n FROM walk JOIN post USING (doc_id) GROUP BY segment)
SELECT (SELECT count(*) FROM documents) AS docs_processed, sum(n_postings)::BIGINT AS total_postings, count(*) FILTER (block = 0) AS final_terms, sum(doc_id_size + freq_size)::BIGINT AS final_index_bytes,
 (SELECT count(*) FROM held) AS spill_count, (SELECT max(n) FROM held) AS peak_partial_postings, (SELECT max(n) FROM terms) AS peak_unique_terms FROM blk"""
)
def saved_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.saved_stats(_saved(spark, sf_dir), 50_000)


@registered(
    f"""WITH {_POST}, {_PLACED}, {_BLOCKS}, t AS (SELECT term, sum(n_postings)::BIGINT AS df, sum(doc_id_size + freq_size)::BIGINT AS bytes_size FROM blk GROUP BY term)
SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, coalesce(sum(bytes_size) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_position, bytes_size, round({_IDF}, 9) AS idf FROM t, st"""
)
def saved_index_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir).lexicon.select("term", "term_id", "df", "start_position", "bytes_size", F.round("idf", 9).alias("idf"))


_LINE = "doc_id::VARCHAR || chr(9) || replace(text, chr(10), ' ')"


@registered(f"SELECT row_number() OVER w - 1 AS doc_id, coalesce(sum(strlen({_LINE}) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_pos, replace(text, chr(10), ' ') AS text FROM documents WINDOW w AS (ORDER BY doc_id)")
def collection_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "collection")
    documents(spark, sf_dir).orderBy("doc_id").select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.replace("text", F.lit("\n"), F.lit(" ")))).write.text(path)
    return files.read_collection(spark, path)


def _query_file(spark: SparkSession, sf_dir: str) -> str:
    """A line without TAB for every third item."""
    path, text = _folder(spark, "queries"), F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    items = table(spark, sf_dir, "benchmark").orderBy("item_id")
    items.select(F.when(F.col("item_id") % 3 == 0, text).otherwise(F.concat(F.lit("q"), F.col("item_id").cast("string"), F.lit("\t"), text))).write.text(path)
    return path


_QUERY_LINES = "SELECT row_number() OVER (ORDER BY item_id) - 1 AS line_no, item_id % 3 = 0 AS bare, 'q' || item_id AS qid, replace(replace(text, chr(10), ' '), chr(9), ' ') AS query FROM benchmark"


@registered(f"SELECT line_no, qid, query FROM ({_QUERY_LINES}) WHERE NOT bare")
def query_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_queries(spark, _query_file(spark, sf_dir))


@registered(f"SELECT line_no, CASE WHEN bare THEN line_no::VARCHAR ELSE qid END AS qid, query FROM ({_QUERY_LINES})")
def query_source_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_queries(spark, _query_file(spark, sf_dir), strict=False)


@registered(f"WITH {_QRELS} SELECT 'q' || qid AS qid, 'd' || doc_id AS doc_id, (doc_id % 3)::INT AS rel FROM qrels")
def qrels_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements written with a line of another length after each, read back."""
    path = _folder(spark, "qrels")
    line = F.concat_ws(" ", F.concat(F.lit("q"), "qid"), F.lit("0"), F.concat(F.lit("d"), "doc_id"), (F.col("doc_id") % 3).cast("string"))
    judgements(spark, sf_dir).select(F.concat(line, F.lit("\nskipped "), line)).write.text(path)
    return files.read_qrels(spark, path)


def _run_file(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark, "run")
    sinks.write_run(_search(100)(spark, sf_dir), path)
    return path


@registered(f"WITH {_hits(_BENCH)} SELECT qid::VARCHAR AS qid, doc_id::VARCHAR AS doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 100")
def run_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_run(spark, _run_file(spark, sf_dir))


@registered(f"WITH {_hits(_BENCH)} SELECT qid::VARCHAR AS qid, doc_id::VARCHAR AS doc_id, rank::INT AS rank FROM ranked WHERE rank <= 100")
def ranked_run_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_ranked_run(spark, _run_file(spark, sf_dir))


@registered("SELECT r_regionkey::INT + 1 AS threads, 'latency' AS mode, r_regionkey * 1.5::DOUBLE AS qps, 1.0::DOUBLE AS p50_us, 2.0::DOUBLE AS p95_us, 3.0::DOUBLE AS p99_us, 0::INT AS throughput_chunk FROM region")
def latency_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each number of threads, as CSV with a header, read back."""
    rows, path = table(spark, sf_dir, "region"), _folder(spark, "latency")
    sinks.write_latency(rows.select((F.col("r_regionkey").cast("int") + 1).alias("threads"), F.lit("latency").alias("mode"), (F.col("r_regionkey") * F.lit(1.5)).alias("qps"), F.lit(1.0).alias("p50_us"), F.lit(2.0).alias("p95_us"), F.lit(3.0).alias("p99_us"), F.lit(0).alias("throughput_chunk")), path)
    kinds = "threads int, mode string, qps double, p50_us double, p95_us double, p99_us double, throughput_chunk int"
    return spark.read.csv(path, header=True, schema=kinds)
