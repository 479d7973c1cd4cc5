"""Operator 2: line dedup.

Lines are normalised (trimmed, runs of blanks as one, lower case), hashed to 96 bits, and the
distinct documents of each hash counted. A line found in more than ``max_docs`` documents is dropped
wherever it occurs; with ``keep_first`` (the default) the document of the lowest id that holds it keeps it, so that
the text of a document copied a thousand times survives once. The rest is put together again in its order.

The exploded lines are hashed once and written; their (hash, id) pairs are counted, with partial aggregation
before a hot line's shuffle, and the lines that are frequent come back to their rows by hash. A row's lost positions are
gathered, its text joined once to them, and the stretches between them are put together.

Defined results: lines blank after normalisation are never counted or dropped; a null text stays null, an
empty one empty; a text of any length or number of lines is handled in time proportional to it; a line in exactly ``max_docs`` documents stays; rows with a null id are neither counted nor changed; rows that repeat an id are one
document; an empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrowick.llm._session import written

MAX_DOCS = 20


def _evened(text: Column) -> Column:
    """Lower case, runs of blanks as one; done for a whole text at once, since it leaves line ends alone."""
    return F.lower(F.regexp_replace(text, r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " "))


def normalised(line: Column) -> Column:
    return F.trim(_evened(line))


def _lost(base: DataFrame, max_docs: int, keep_first: bool) -> DataFrame:
    """(fw_id, fw_hash, lost): the positions, from 0, of the lines that each text loses, rising, from (fw_id, fw_hash, fw_text)."""
    each = base.where("fw_id is not null and fw_text is not null").select("fw_id", "fw_hash", F.posexplode(F.split(_evened(F.col("fw_text")), "\n")).alias("pos", "line")).select("fw_id", "fw_hash", "pos", F.trim("line").alias("line")).where("line <> ''")
    # two independent hashes of a line
    lines = written(each.select("fw_id", "fw_hash", "pos", F.xxhash64("line").alias("a"), F.hash("line").alias("b")))
    frequent = lines.groupBy("a", "b").agg(F.count_distinct("fw_id").alias("n"), F.min("fw_id").alias("first")).where(F.col("n") > max_docs)
    found = lines.join(frequent.select("a", "b", "first"), ["a", "b"])
    if keep_first:
        found = found.where(F.col("fw_id") != F.col("first"))
    return found.groupBy("fw_id", "fw_hash").agg(F.array_sort(F.collect_set("pos")).alias("lost"))


def _between(lines: Column, lost: Column) -> Column:
    """The lines but those at ``lost``, by slices between the positions: each line is copied once, however many go."""

    def pieces(x: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(x["lost"], lambda p: p + 1))
        ends = F.concat(x["lost"], F.array(F.size(x["lines"])))
        return F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("z")), lambda s: F.slice(x["lines"], s["a"] + 1, s["z"] - s["a"])))

    # the one struct holds the split text, which would otherwise be split again for each piece
    return F.transform(F.array(F.struct(lines.alias("lines"), lost.alias("lost"))), pieces)[0]


def _cut(docs: DataFrame, id_col: str, text_col: str, max_docs: int, keep_first: bool) -> DataFrame:
    """docs packed as fw_row, beside fw_id, fw_text and kept: the lines left, null where nothing is lost."""
    rows = docs.select(F.col(id_col).alias("fw_id"), F.col(text_col).alias("fw_text"), F.xxhash64(F.col(text_col)).alias("fw_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("fw_row"))
    # rows of one id are told apart by their text's hash
    joined = rows.join(_lost(rows.select("fw_id", "fw_hash", "fw_text"), max_docs, keep_first), ["fw_id", "fw_hash"], "left")
    return joined.withColumn("kept", F.when(F.col("lost").isNotNull(), _between(F.split("fw_text", "\n"), F.col("lost")))).drop("lost", "fw_hash")


def _text() -> Column:
    return F.when(F.col("kept").isNull(), F.col("fw_text")).otherwise(F.array_join("kept", "\n"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, keep_first: bool = True) -> DataFrame:
    """(id, text, n_lines, n_dropped) of every row."""
    n = F.size(F.split("fw_text", "\n"))
    return _cut(docs.select(id_col, text_col), id_col, text_col, max_docs, keep_first).select(
        F.col("fw_id").alias(id_col),
        _text().alias(text_col),
        F.when(F.col("fw_text").isNull(), 0).otherwise(n).cast("int").alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(n - F.size("kept")).cast("int").alias("n_dropped"),
    )


def with_lines_dropped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, keep_first: bool = True) -> DataFrame:
    """docs with the same columns, their texts without the lines dropped; a document whose every line with text is dropped goes."""
    cut = _cut(docs, id_col, text_col, max_docs, keep_first)
    gone = F.col("kept").isNotNull() & ~F.exists("kept", lambda x: normalised(x) != "")
    return cut.where(~gone).select(*[_text().alias(c) if c == text_col else F.col(f"fw_row.`{c}`").alias(c) for c in docs.columns])


#: DuckDB's form of dedup_lines over the table documents.
ORACLE_SQL = f"""
WITH rows AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, p, lines[p] AS line, lower(regexp_replace(regexp_replace(lines[p], '[ \t\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g')) AS norm
         FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p FROM rows)),
freq AS (SELECT norm, min(doc_id) AS first FROM each WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text, count(*) AS n
         FROM each LEFT JOIN freq USING (norm) WHERE first IS NULL OR first = doc_id GROUP BY doc_id)
SELECT doc_id, coalesce(k.text, '') AS text, len(lines)::INT AS n_lines, (len(lines) - coalesce(k.n, 0))::INT AS n_dropped
FROM rows r LEFT JOIN kept k USING (doc_id)
"""
