"""Operator 7: substring dedup by compressed FM-indexes.

A passage of ``MIN_WORDS`` or more words (runs of bytes that aren't white space) that another document holds word for word
is reported. Comparing all documents with all shards would cost their product, so shards are chosen by content:

1. Winnowing: of every ``MIN_WORDS`` words in a row, the run of ``ANCHOR`` words of the least hash is an anchor. Two
   documents that share MIN_WORDS words share an anchor within them. A first pass over the texts aggregates the anchors' hashes to
   those of two or more documents and marks them in a Bloom filter of a fixed size (``FILTER_BITS``), which is broadcast; a
   second pass lets only anchors in it out, so hardly a row of an unshared anchor is shuffled.
2. Each anchor stands for its window: all runs of MIN_WORDS words that contain it. A window found whole in several documents
   is repeated as it stands. The other windows of an anchor are gathered in the anchor's shard, a repeated window once.
   Both are told by aggregation before and after the shuffle, so no anchor's rows pass through one task.
3. Each shard's windows form an FM-index: the Burrows-Wheeler transform of their words in a wavelet matrix of
   packed bits with rank counts, beside the LCP array in bytes. Its windows are streamed against it, all in lockstep:
   backward search, going to the parent interval where no other document follows, gives matching statistics, the longest
   match with another document at every word. Matches of MIN_WORDS words or more are intervals.
4. An anchor with more than ``MAX_CLASSES`` different windows (a phrase common to very many documents) would not fit a
   shard. There all runs of MIN_WORDS words round the anchor are counted by hash instead: exact too, and without a bound.

A document's intervals are united. Both ways together cover every match; nothing is capped.

Defined results: a text of any length is searched whole; of two intervals that touch or overlap one is made; null, empty and shorter texts repeat nothing; a passage repeated within one document only isn't reported;
rows with a null id are left out; rows that repeat an id are one document, each with its own intervals; an empty table gives an empty
result. Offsets are bytes of the UTF-8 text, from 0, the end exclusive; words are compared by 64-bit hashes. Further
columns are ignored: the result has the id, ``start`` and ``end``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrowick.llm import _text as tx
from ferrowick.llm._session import written

MIN_WORDS, ANCHOR = 50, 32
MAX_CLASSES, SHARD_WORDS = 1_000, 400_000
#: Bits of the filter of shared anchors, 16 MB whatever the corpus; two of each anchor are set.
FILTER_BITS = 1 << 27


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    of = tx.code_hashes(hashes)
    at = np.arange(len(hashes) - n + 1)
    return of(at, at + n)


def anchors(words: np.ndarray, rows: np.ndarray, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> np.ndarray:
    """Where the anchors begin, from words' hashes and the texts that they belong to: one at least in each run of min_words words of a text."""
    h = runs(words, anchor)
    width = min_words - anchor + 1
    if len(h) < width:
        return np.zeros(0, np.int64)
    least, reach = h, 1
    while reach < width:  # least[i]: of h[i : i + reach]
        step = min(reach, width - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    of_one = rows[min_words - 1 :] == rows[: len(least)]
    lowest = np.zeros(len(h), bool)
    for i in range(width):  # in a window beginning at p, p + i holds the least value
        lowest[i : i + len(least)] |= of_one & (h[i : i + len(least)] == least)
    return np.flatnonzero(lowest)


def _anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, id): each anchor's hash, once for a text."""
    for b in batches:
        for first, _, data, offsets in tx.chunks(b.column(2)):
            starts, ends, rows = tx.words(data, offsets)
            word = tx.window_hashes(data)(starts, ends)
            at = anchors(word, rows)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(tx.code_hashes(word)(at, at + ANCHOR).view(np.int64)), b.column(0).take(pa.array(rows[at] + first))], ["anchor", "id"])


def _places(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(FILTER_BITS - 1)
    return (anchor & mask).astype(np.int64), ((anchor >> np.uint64(32)) & mask).astype(np.int64)


def _anchored(shared: Broadcast):
    """(anchor, whole, id, tag, start, end, n): each anchor's hash, if the filter has it, its window's hash, and where the window lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for first, end, data, offsets in tx.chunks(b.column(2)):
                starts, ends, rows = tx.words(data, offsets)
                word = tx.window_hashes(data)(starts, ends)
                at = anchors(word, rows)
                if not len(at):
                    continue
                of = tx.code_hashes(word)
                anchor = of(at, at + ANCHOR)
                one, two = _places(anchor)
                known = ((bits[one >> 3] >> (one & 7)) & (bits[two >> 3] >> (two & 7)) & 1).astype(bool)
                at, anchor = at[known], anchor[known]
                bounds = np.searchsorted(rows, np.arange(end - first + 1))
                row = rows[at]
                a, z = np.maximum(at + ANCHOR - MIN_WORDS, bounds[row]), np.minimum(at + MIN_WORDS, bounds[row + 1])
                origin, pick = offsets[row], pa.array(row + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(of(a, z).view(np.int64)), b.column(0).take(pick), b.column(1).take(pick), pa.array((starts[a] - origin).astype(np.int32)), pa.array((ends[z - 1] - origin).astype(np.int32)), pa.array((z - a).astype(np.int32))],
                    ["anchor", "whole", "id", "tag", "start", "end", "n"],
                )

    return run


def _filter_of(shared: DataFrame) -> np.ndarray:
    """The bits of these anchors; they are set by aggregation, and at most FILTER_BITS of them reach the driver."""
    mask = F.lit(FILTER_BITS - 1)
    place = F.explode(F.array(F.col("anchor").bitwiseAND(mask), F.shiftrightunsigned("anchor", 32).bitwiseAND(mask)))
    parts = shared.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for part, bits in parts.collect():  # 4 KB each
        out[part * 4096 : part * 4096 + 4096] = np.frombuffer(bits, np.uint8)
    return out


class WaveletMatrix:
    """Ranks of symbols in a sequence, from one packed bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.depth = max(1, int(size - 1).bit_length())
        self.n, self.words, self.counts, self.zeros = len(symbols), [], [], []
        for level in range(self.depth):
            bit = (symbols >> (self.depth - 1 - level)) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.frombuffer(np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8)).tobytes(), np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def places(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbols before ``at`` lead on the last level; less that of 0 it is the symbol's rank."""
        for level in range(self.depth):
            at = self._step(level, ((symbols >> (self.depth - 1 - level)) & 1).astype(bool), at)
        return at

    def _step(self, level: int, one: np.ndarray, x: np.ndarray) -> np.ndarray:
        r = self._ones(level, x)
        return np.where(one, self.zeros[level] + r, x - r)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP) by prefix doubling; lcp[r] is of ranks r - 1 and r."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    levels, reach = [rank], 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] + 1 if reach < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(tx.first_of_runs(key[order])) - 1
        rank, reach = new, reach * 2
        if rank[order[-1]] == n - 1:
            break
        levels.append(rank)
    lcp = np.zeros(n, np.int32)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        both = np.flatnonzero((a < n) & (b < n))
        same = both[levels[k][a[both]] == levels[k][b[both]]]
        # ranks of a level compare 2**k symbols
        lcp[1 + same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, lcp


class FMIndex:
    """Windows of words, each of a document or of many (-1). Symbol 0 ends a window."""

    def __init__(self, windows: list[np.ndarray], documents: np.ndarray) -> None:
        sizes = np.array([len(w) + 1 for w in windows], np.int64)
        words = np.concatenate([np.append(w, np.uint64(0)) for w in windows]) if len(windows) else np.zeros(0, np.uint64)
        ends = np.cumsum(sizes) - 1
        inside = np.ones(len(words), bool)
        inside[ends] = False
        self.alphabet = np.unique(words[inside])
        text = np.zeros(len(words), np.int64)
        text[inside] = np.searchsorted(self.alphabet, words[inside]) + 1
        self.texts, self.begin = text, ends - sizes + 1
        distinct_ends = text + len(ends)
        distinct_ends[ends] = np.arange(len(ends))
        order, lcp = suffix_array(distinct_ends)
        self.lcp = lcp.astype(np.min_scalar_type(int(lcp.max(initial=0))))  # no match is longer than a window
        self.bwt = WaveletMatrix(text[order - 1], len(self.alphabet) + 1)
        counts = np.bincount(text, minlength=len(self.alphabet) + 1)
        # a symbol's first rank, less its first place on the wavelet matrix's last level
        self.shift = np.cumsum(counts) - counts - self.bwt.places(np.arange(len(counts)), np.zeros(len(counts), np.int64))
        doc = np.repeat(documents, sizes)[order]
        n = len(doc)
        # other[r]: the least end e so that ranks r .. e - 1 hold two documents
        change = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, n + 1)
        self.other = change[np.searchsorted(change, np.arange(n), "right")] + 1
        self.other = np.where(doc == -1, np.arange(n) + 1, self.other)
        table = [self.lcp]
        while 2 << (len(table) - 1) <= n:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][: len(table[-1]) - half], table[-1][half:]))
        self.table, self.n = table, n

    def _parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least wider interval, and its depth."""
        right = np.where(hi < self.n, self.lcp[np.minimum(hi, self.n - 1)], 0)
        depth = np.maximum(self.lcp[lo], right).astype(np.int64)
        lo, hi = lo.copy(), hi.copy()
        for k in range(len(self.table) - 1, -1, -1):
            step = 1 << k
            # lcp[lo - step + 1 .. lo] >= depth: the interval reaches further left
            can = np.flatnonzero(lo - step + 1 >= 1)
            can = can[self.table[k][lo[can] - step + 1] >= depth[can]]
            lo[can] -= step
            can = np.flatnonzero(hi + step <= self.n)
            can = can[self.table[k][hi[can]] >= depth[can]]
            hi[can] += step
        return lo, hi, depth

    def matching_statistics(self, which: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For every word of the windows named, end to end: the longest match from there on with another document."""
        offset = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        at = sizes - 1  # the word to be prepended next
        lo, hi, depth = np.zeros(len(which), np.int64), np.full(len(which), self.n), np.zeros(len(which), np.int64)
        live = np.flatnonzero(at >= 0)
        while len(live):
            symbol = self.texts[self.begin[which[live]] + at[live]]
            a, z = (self.shift[symbol] + self.bwt.places(symbol, x[live]) for x in (lo, hi))
            good = (z > a) & (self.other[np.minimum(a, self.n - 1)] <= z)
            yes, no = live[good], live[~good]
            lo[yes], hi[yes] = a[good], z[good]
            depth[yes] += 1
            out[offset[yes] + at[yes]] = depth[yes]
            at[yes] -= 1
            root = no[depth[no] == 0]
            at[root] -= 1
            up = no[depth[no] > 0]
            if len(up):
                lo[up], hi[up], depth[up] = self._parent(lo[up], hi[up])
                top = up[depth[up] == 0]
                lo[top], hi[top] = 0, self.n
            live = live[at[live] >= 0]
        return out


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted intervals with those that overlap made one."""
    if not len(starts):
        return starts, ends
    high = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] >= high[:-1])
    at = np.flatnonzero(new)
    return starts[at], high[np.append(at[1:] - 1, len(starts) - 1)]


def _shard(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Intervals of a shard's windows, each window being compared with those of the same shard."""
    data, offsets = tx.as_bytes(pa.concat_arrays(t["text"].chunks))
    starts, ends, rows = tx.words(data, offsets)
    word = tx.window_hashes(data)(starts, ends)
    cut = np.searchsorted(rows, np.arange(len(t) + 1))
    many = t["many"].to_numpy()
    _, document = np.unique(t["doc"].to_numpy(), return_inverse=True)
    index = FMIndex([word[a:z] for a, z in zip(cut, cut[1:], strict=False)], np.where(many, -1, document))
    which = np.flatnonzero(~many)
    sizes = np.diff(cut)[which]
    found = index.matching_statistics(which, sizes)
    origin = t["start"].to_numpy()
    out = []
    for q, size, off in zip(which.tolist(), sizes.tolist(), (np.cumsum(sizes) - sizes).tolist(), strict=True):
        ms = found[off : off + size]
        at = np.flatnonzero(ms >= MIN_WORDS)
        a, z = united(at, at + ms[at])
        out += [(q, s, e) for s, e in zip(a.tolist(), z.tolist(), strict=True)]
    q, a, z = (np.array([o[i] for o in out], np.int64) for i in range(3))
    base = origin[q] - offsets[q] if len(q) else np.zeros(0, np.int64)
    return pa.table([t["id"].take(pa.array(q)), t["tag"].take(pa.array(q)), pa.array((starts[cut[q] + a] + base).astype(np.int32)), pa.array((ends[cut[q] + z - 1] + base).astype(np.int32))], ["id", "tag", "start", "end"])


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, id, tag, start, end, many): every run of MIN_WORDS words of these windows, by hash."""
    for b in batches:
        data, offsets = tx.as_bytes(b.column(4))
        starts, ends, rows = tx.words(data, offsets)
        word = tx.window_hashes(data)(starts, ends)
        h = runs(word, MIN_WORDS)
        at = np.flatnonzero(rows[MIN_WORDS - 1 :] == rows[: len(h)]) if len(h) else np.zeros(0, np.int64)
        row = rows[at]
        base = b.column(2).to_numpy()[row] - offsets[row]
        many = b.column(3).to_numpy(zero_copy_only=False)[row]
        yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array((starts[at] + base).astype(np.int32)), pa.array((ends[at + MIN_WORDS - 1] + base).astype(np.int32)), pa.array(many)], ["run", "id", "tag", "start", "end", "many"])


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_classes: int = MAX_CLASSES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, start, end) of every maximal run of words covered by passages that other documents hold too."""
    kind = docs.schema[id_col].dataType.simpleString()
    # the tag tells rows of one id apart
    own = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.hash(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))
    kinds = f"anchor long, whole long, id {kind}, tag int, start int, end int, n int"
    ids = own.mapInArrow(_anchors_of, f"anchor long, id {kind}").groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(ids.where("lo <> hi").select("anchor")))  # FILTER_BITS
    rows = written(own.mapInArrow(_anchored(bits), kinds).withColumn("pick", F.xxhash64("id", "tag", "start")))
    classes = rows.groupBy("anchor", "whole").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("pick").alias("least"))
    # what the filter lets through by chance ends here
    held = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes"), F.min("lo").alias("all_lo"), F.max("hi").alias("all_hi")).where("all_lo <> all_hi").select("anchor", "classes")
    classes = classes.join(held, "anchor").select("anchor", "whole", (F.col("lo") != F.col("hi")).alias("many"), "least", "classes")
    # a window in many documents stands for itself once, the rest for their documents
    found = rows.join(classes, ["anchor", "whole"]).withColumn("first", F.col("pick") == F.col("least"))
    found = written(found.select("anchor", "id", "tag", "start", "end", "n", "many", "first", "classes"))
    whole = found.where(F.col("many") & (F.col("n") >= MIN_WORDS)).select("id", "tag", "start", "end")
    asked = found.where((F.col("classes") > 1) & (~F.col("many") | F.col("first")))
    shards = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // shard_words))
    wanted = asked.groupBy("id", "tag").agg(F.collect_set(F.struct("anchor", "start", "end", "many", "classes")).alias("windows"))
    cut = own.join(wanted, ["id", "tag"]).select("id", "tag", F.encode("text", "UTF-8").alias("bytes"), F.explode("windows").alias("w"))
    # windows begin and end at the bounds of words, so the bytes cut out are whole characters
    windows = written(cut.select("id", "tag", "w.anchor", "w.start", "w.many", "w.classes", F.decode(F.expr("substring(bytes, w.start + 1, w.end - w.start)"), "UTF-8").alias("text")))
    usual = windows.where(F.col("classes") <= max_classes).select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "id", "tag", F.xxhash64("id").alias("doc"), "start", "many", "text")
    by_index = usual.groupBy("shard").applyInArrow(_shard, f"id {kind}, tag int, start int, end int")
    each = windows.where(F.col("classes") > max_classes).select("id", "tag", "start", "many", "text").mapInArrow(_crowded, f"run long, id {kind}, tag int, start int, end int, many boolean")
    common = each.groupBy("run").agg((F.max("many") | (F.min("id") != F.max("id"))).alias("repeated")).where("repeated").select("run")
    by_count = each.join(common, "run").where(~F.col("many")).select("id", "tag", "start", "end")
    spans = whole.union(by_index).union(by_count).distinct()
    each_text = Window.partitionBy("id", "tag").orderBy("start", "end")
    apart = spans.withColumn("high", F.max("end").over(each_text.rowsBetween(Window.unboundedPreceding, -1))).withColumn("island", F.sum(F.when(F.col("start") <= F.col("high"), 0).otherwise(1)).over(each_text))
    return apart.groupBy("id", "tag", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(F.col("id").alias(id_col), "start", "end")


_BLANKS = r" \t\n\r\x0B\x0C"
#: DuckDB's form of repeated_passages over the table documents, by all runs of MIN_WORDS words.
ORACLE_SQL = f"""
WITH pieces AS (SELECT doc_id, regexp_extract_all(text, '[{_BLANKS}]*[^{_BLANKS}]+') AS ps FROM documents),
each AS (SELECT doc_id, p, ps[p] AS piece, regexp_replace(ps[p], '^[{_BLANKS}]+', '') AS word FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS p FROM pieces)),
placed AS (SELECT doc_id, p, word, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY p) AS e FROM each),
runs AS (SELECT doc_id, e - strlen(word) AS a, lead(e, {MIN_WORDS - 1}) OVER w AS z,
  md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)) AS run FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
held AS (SELECT doc_id, a, z FROM runs WHERE z IS NOT NULL AND run IN (SELECT run FROM runs WHERE z IS NOT NULL GROUP BY run HAVING count(DISTINCT doc_id) > 1)),
cut AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM held),
isle AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS i FROM cut)
SELECT doc_id, min(a)::INT AS start, max(z)::INT AS "end" FROM isle GROUP BY doc_id, i
"""
