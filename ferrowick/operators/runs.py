"""Tokens, counts and posting lists over Arrow batches, in numpy: what a document's text gives is counted where the text is.

The texts are brought together by document, not their postings: a document's counts are then whole in one task, without an
aggregation that would hold a partition's postings. A task takes ``CHUNK_BYTES`` of text at a time, so its memory is that of a chunk,
whatever the number of partitions. A run is what a chunk holds of one term: a row for its whole stretch of documents."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrowick.functions.bm25 import K1, B

CHUNK_BYTES = 8 << 20
#: Postings that leave a task at a time.
CHUNK_POSTINGS = 1 << 18
#: Bytes, by the optimizer's estimate, for each of the partitions that texts and runs are brought to.
PART_BYTES = 4 << 20
#: The optimizer takes a table of which it knows nothing, such as rows of the driver's Python, to be of 2**63 bytes.
UNKNOWN_BYTES = 1 << 55
#: Stands for no id: ids are sorted with it first.
NO_ID = -(2**63)

_LOW = np.zeros(256, np.uint8)
_LOW[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
_LOW[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)


def parts(df: DataFrame) -> int:
    """Partitions for df, in proportion to its size, which a session's number of shuffle partitions isn't; that number for tables of unknown size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > UNKNOWN_BYTES:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(df.sparkSession.sparkContext.defaultParallelism, size // PART_BYTES), 10_000)


def tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of the texts, one after another, and how many each text has: functions.text.tokenize in numpy."""
    if not len(text):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    text = (text.fill_null("") if text.null_count else text).cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    low = _LOW[data]
    inside = low != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # a token ends with its text
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(low))]
    begins[edges], ends[edges - 1] = inside[edges], inside[edges - 1]
    starts = np.flatnonzero(begins)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(ends) + 1 - starts, out=at[1:])
    kind = pa.StringArray if at[-1] < 2**31 else pa.LargeStringArray
    found = kind.from_buffers(len(starts), pa.py_buffer(at.astype(np.int32) if kind is pa.StringArray else at), pa.py_buffer(low[inside]))
    return found, np.diff(np.searchsorted(starts, offsets))


def _sizes(text: pa.Array) -> np.ndarray:
    return pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of batches in the order of the id, ``CHUNK_BYTES`` of text at a time and what their last id has beyond."""
    held: list[pa.RecordBatch] = []
    size, last = 0, NO_ID

    def whole() -> tuple[pa.Array, pa.Array]:
        return tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))

    for b in batches:
        upto, named = np.cumsum(_sizes(b.column(1))), b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        at = 0
        while at < b.num_rows:
            before = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + CHUNK_BYTES, "right")))
            if held and size + upto[end - 1] - before > CHUNK_BYTES:
                if last != named[at]:
                    yield whole()
                    held, size = [], 0
                else:  # no more than what this id still has
                    end = at + int(np.searchsorted(named[at:end], last, "right"))
            held.append(b.slice(at, end - at))
            size += upto[end - 1] - before
            at, last = end, named[end - 1]
    if held:
        yield whole()


class Counts:
    """A chunk's frequencies. ids, dl and times: of each different (id, length), how many rows have it; terms, in the order of their ``place`` if one is given, and for each posting its code, owner and tf."""

    def __init__(self, ids: pa.Array, text: pa.Array, by_term: bool, place: Callable[[pa.Array], np.ndarray] | None = None) -> None:
        found, dl = tokens(text)
        named = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        owner, first, self.times = np.arange(len(dl)), np.arange(len(dl)), np.ones(len(dl), np.int32)
        if (named[1:] == named[:-1]).any():
            rank = np.cumsum(np.append(False, named[1:] != named[:-1]))
            _, first, owner, times = np.unique(rank * (dl.max() + 1) + dl, return_index=True, return_inverse=True, return_counts=True)
            self.times = times.astype(np.int32)
        self.named, self.dl = named[first], dl[first].astype(np.int32)
        coded = found.dictionary_encode()
        self.terms, code, own = coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64), np.repeat(owner, dl)
        if place is not None:
            self.part = place(self.terms)
            sorted_ = np.argsort(self.part, kind="stable")
            self.part = self.part[sorted_]
            rank = np.empty(len(sorted_), np.int64)
            rank[sorted_] = np.arange(len(sorted_))
            self.terms, code = self.terms.take(pa.array(sorted_)), rank[code]
        n = len(first) if by_term else len(self.terms)
        key = code * n + own if by_term else own * n + code
        key.sort()
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.tf = np.diff(np.append(at, len(key))).astype(np.int32)
        a, b = np.divmod(key[at], max(n, 1))
        self.code, self.owner = (a, b) if by_term else (b, a)


def ids_of(named: np.ndarray) -> pa.Array:
    return pa.array(named, mask=named == NO_ID)


def _cut(b: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, most):
        yield b.slice(at, most)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with at most CHUNK_BYTES of text together, one row at least."""
    for b in batches:
        upto, at = np.cumsum(_sizes(b.column(1))), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK_BYTES, "right")))
            yield b.slice(at, end - at)
            at = end


class Passages:
    """Items of KEY + 2 tokens or more, found in texts by their tokens from the second on, which any text that holds an item has, then compared whole."""

    KEY = 5

    def __init__(self, items: pa.Table) -> None:
        self.qids, self.items = items["qid"].combine_chunks(), items["item"].to_pylist()
        found, n = tokens(items["item"].combine_chunks())
        first = np.cumsum(n) - n + 1
        own = (first[:, None] + np.arange(self.KEY)).ravel()
        key = found.take(pa.array(own))
        self.known = pc.unique(key)
        hashed = self._hash(pc.index_in(key, self.known).to_numpy().astype(np.int64), np.arange(0, len(own), self.KEY))
        self.order = np.argsort(hashed, kind="stable")
        self.hashed = hashed[self.order]

    def _hash(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for i in range(self.KEY):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[at + i].astype(np.uint64) + np.uint64(1)
        return h

    def held(self, text: pa.Array) -> Iterator[tuple[int, int]]:
        """(row, item) of each item that a text holds."""
        found, dl = tokens(text)
        n = len(found) - self.KEY + 1
        if n < 1 or not len(self.items):
            return
        code = pc.index_in(found, self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        known, row = code >= 0, np.repeat(np.arange(len(dl)), dl)
        at = np.flatnonzero(np.logical_and.reduce([known[i : i + n] for i in range(self.KEY)]) & (row[:n] == row[self.KEY - 1 :]))
        h = self._hash(code, at)
        a, z = np.searchsorted(self.hashed, h, "left"), np.searchsorted(self.hashed, h, "right")
        hit = np.flatnonzero(z > a)
        for r, f, e in sorted(set(zip(row[at[hit]].tolist(), a[hit].tolist(), z[hit].tolist(), strict=True))):
            whole = text[r].as_py()
            yield from ((r, i) for i in self.order[f:e].tolist() if self.items[i] in whole)


def holders(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, doc_id): which documents (doc_id, text) hold which items (qid, item) of seven tokens or more; the items fit a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(items.toArrow())
    kind = items.schema["qid"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(shared.value)
        for part in _text_slices(batches):
            if hits := list(passages.held(part.column(1))):
                rows, found = (pa.array(x, pa.int64()) for x in zip(*hits, strict=True))
                yield pa.RecordBatch.from_arrays([passages.qids.take(found), part.column(0).take(rows)], ["qid", "doc_id"])

    return _texts(docs, "doc_id", "text").mapInArrow(find, f"qid {kind}, doc_id long")


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, dl), where the texts are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens(part.column(1))[1].astype(np.int32))], ["doc_id", "dl"])

    return _texts(docs, id_col, text_col).mapInArrow(count, "doc_id long, dl int")


def counted(docs: DataFrame, id_col: str, text_col: str, wanted: Callable[[], pa.Array | None] = lambda: None, with_lengths: bool = False) -> DataFrame:
    """(term, doc_id, dl, tf), of the ``wanted`` terms or of all; ``with_lengths`` also a row without term for each document, whose tf is how often it is there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = wanted()
        for ids, text in chunks(batches):
            c = Counts(ids, text, by_term=False)
            code, owner, tf = c.code, c.owner, c.tf
            if names is not None:
                keep = pc.is_in(c.terms, names).to_numpy(zero_copy_only=False)[code]
                code, owner, tf = code[keep], owner[keep], tf[keep]
            for at in range(0, len(code), CHUNK_POSTINGS):
                part = slice(at, at + CHUNK_POSTINGS)
                yield pa.RecordBatch.from_arrays([c.terms.take(pa.array(code[part])), ids_of(c.named[owner[part]]), pa.array(c.dl[owner[part]]), pa.array(tf[part])], ["term", "doc_id", "dl", "tf"])
            if with_lengths:
                yield from _cut(pa.RecordBatch.from_arrays([pa.nulls(len(c.dl), pa.string()), ids_of(c.named), pa.array(c.dl), pa.array(c.times)], ["term", "doc_id", "dl", "tf"]), CHUNK_POSTINGS)

    texts = _texts(docs, id_col, text_col)
    return texts.repartition(parts(docs), "doc_id").sortWithinPartitions("doc_id").mapInArrow(count, "term string, doc_id long, dl int, tf int")


RUNS = "term string, first long, ids array<long>, dls array<int>, tfs array<int>"


def posting_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, first, ids, dls, tfs): the postings of one chunk of documents and one term, in the order of the ids. No two chunks share an id, and their ids don't overlap."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, text in chunks(batches):
            c = Counts(ids, text, by_term=True)
            at = np.searchsorted(c.code, np.arange(len(c.terms) + 1)).astype(np.int32)
            own = pa.array(c.named[c.owner])
            lists = [pa.ListArray.from_arrays(pa.array(at), values) for values in (own, pa.array(c.dl[c.owner]), pa.array(c.tf))]
            yield from _cut(pa.RecordBatch.from_arrays([c.terms, own.take(pa.array(at[:-1])), *lists], ["term", "first", "ids", "dls", "tfs"]), 1 << 14)

    texts = _texts(docs, id_col, text_col)
    return texts.repartitionByRange(parts(docs), "doc_id").sortWithinPartitions("doc_id").mapInArrow(count, RUNS)


def as_runs(rows: DataFrame) -> DataFrame:
    """Postings (term, doc_id, tf), each as a run; runs as they are."""
    if "ids" in rows.columns:
        return rows
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))
    return rows.select("term", own.alias("first"), F.array(own).alias("ids"), F.array(F.col("tf").cast("int")).alias("tfs"))


def _flat(column: pa.Array) -> pa.Array:
    return column.flatten()


def flattened(runs: DataFrame, *also: str) -> DataFrame:
    """(term, the columns ``also``, doc_id, dl, tf) of runs, in their order."""
    fields = {f.name: f.dataType.simpleString() for f in runs.schema}
    names = ["term", *also]

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            row = _rows(part)
            yield pa.RecordBatch.from_arrays([*[part[n].take(row) for n in names], ids_of(_flat(part["ids"]).to_numpy()), _flat(part["dls"]), _flat(part["tfs"])], [*names, "doc_id", "dl", "tf"])

    return runs.select(*names, "ids", "dls", "tfs").mapInArrow(flat, ", ".join([*[f"{n} {fields[n]}" for n in names], "doc_id long, dl int, tf int"]))


def term_scores(runs: DataFrame) -> DataFrame:
    """(term, doc_id, score) of runs with the columns idf and avgdl."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            row = _rows(part)
            idf, avgdl = (part[n].take(row).to_numpy(zero_copy_only=False) for n in ("idf", "avgdl"))
            tf, dl = (_flat(part[n]).to_numpy() for n in ("tfs", "dls"))
            # the order of bm25.term_score, to the last bit
            norm = tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * dl / avgdl))
            yield pa.RecordBatch.from_arrays([part["term"].take(row), ids_of(_flat(part["ids"]).to_numpy()), pa.array(idf * norm)], ["term", "doc_id", "score"])

    return runs.select("term", "ids", "dls", "tfs", "idf", "avgdl").mapInArrow(score, "term string, doc_id long, score double")


def _rows(b: pa.RecordBatch) -> pa.Array:
    """The row of each posting."""
    return pa.array(np.repeat(np.arange(b.num_rows), pc.list_value_length(b["ids"]).to_numpy()))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (part for b in batches for part in _run_slices(b))


def _run_slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of at most CHUNK_POSTINGS postings together, one row at least."""
    upto, at = np.cumsum(pc.list_value_length(b["ids"]).to_numpy()), 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK_POSTINGS, "right")))
        yield b.slice(at, end - at)
        at = end


class Placed:
    """Postings of whole blocks in the order of term and id: terms (names of the groups), group of each posting, named, tf, pos from 0 and delta; of packed runs also dl and the id before."""

    def __init__(self, terms: pa.Array, group: np.ndarray, named: np.ndarray, tf: np.ndarray, pos: np.ndarray, delta: np.ndarray, dl: np.ndarray | None = None, before: np.ndarray | None = None) -> None:
        self.terms, self.group, self.named, self.tf, self.pos, self.delta, self.dl, self.before = terms, group, named, tf, pos, delta, dl, before


def _walk(batches: Iterator[pa.RecordBatch], per_block: int) -> Iterator[Placed]:
    """Runs in the order of term and first id, as postings with their places. What the last block lacks is awaited: a block is never divided."""
    name, base, last = None, 0, 0  # of the term that goes on: how many postings went before the tail held, and their last id
    tail = (np.zeros(0, np.int64), np.zeros(0, np.int32))
    started = False
    for part in _slices(batches):
        lens = pc.list_value_length(part["ids"]).to_numpy()
        coded = pc.run_end_encode(part["term"])
        terms, ends = coded.values, np.asarray(coded.run_ends)
        group = np.repeat(np.repeat(np.arange(len(terms)), np.diff(np.append(0, ends))), lens)
        named, tf = _flat(part["ids"]).to_numpy(), _flat(part["tfs"]).to_numpy(zero_copy_only=False)
        if started:
            if terms[0].as_py() == name:
                group = np.append(np.zeros(len(tail[0]), np.int64), group)
            else:
                terms = pa.concat_arrays([pa.array([name], pa.string()), terms])
                group = np.append(np.zeros(len(tail[0]), np.int64), group + 1)
            named, tf = np.append(tail[0], named), np.append(tail[1], tf)
        started = True
        out, base, last, cut = _placed(terms, group, named, tf, base, last, per_block)
        name, tail = terms[-1].as_py(), (named[cut:], tf[cut:])
        if cut:
            yield out
    if len(tail[0]):
        yield _placed(pa.array([name], pa.string()), np.zeros(len(tail[0]), np.int64), *tail, base, last, 1)[0]


def _placed(terms: pa.Array, group: np.ndarray, named: np.ndarray, tf: np.ndarray, base: int, last: int, per_block: int) -> tuple[Placed, int, int, int]:
    """What is whole; base and last for the rest, and where it begins."""
    first = np.searchsorted(group, np.arange(len(terms)))
    pos = np.arange(len(group)) - first[group]
    pos[group == 0] += base
    before = np.append(last if group[0] == 0 else 0, named[:-1])
    opens = first[first < len(group)]
    before[opens[opens > 0]] = 0
    before[before == NO_ID] = 0
    delta = np.where(named == NO_ID, NO_ID, named - before)
    own = first[-1]  # of the last term
    n = len(group) - own
    went = base if len(terms) == 1 else 0
    done = (went + n) // per_block * per_block - went if n else 0
    cut = own + max(done, 0)
    if cut > own:
        went, last = went + cut - own, int(named[cut - 1])
    elif len(terms) > 1:
        last = 0
    last = 0 if last == NO_ID else last
    part = slice(0, cut)
    return Placed(terms, group[part], named[part], tf[part], pos[part], delta[part]), went, last, cut


def _together(runs: DataFrame) -> DataFrame:
    """Runs by term: a term's are in one task, which walks through them; that it holds no more than a chunk is why a stop word needs no further division."""
    return runs.select("term", "first", "ids", "tfs").repartition(parts(runs), "term").sortWithinPartitions("term", "first")


def deltas_of(runs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, pos, delta), pos from 1."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _walk(batches, 1):
            yield pa.RecordBatch.from_arrays([p.terms.take(pa.array(p.group)), ids_of(p.named), pa.array(p.tf), pa.array((p.pos + 1).astype(np.int32)), ids_of(p.delta)], ["term", "doc_id", "tf", "pos", "delta"])

    return _together(runs).mapInArrow(walk, "term string, doc_id long, tf int, pos int, delta long")


def _block_starts(p: Placed, per_block: int) -> np.ndarray:
    return np.flatnonzero(np.append(True, p.group[1:] != p.group[:-1]) | (p.pos % per_block == 0))


def lists_of(runs: DataFrame, per_block: int) -> DataFrame:
    """(term, block, n, postings)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _walk(batches, per_block):
            at = _block_starts(p, per_block)
            ends = np.append(at, len(p.group)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([ids_of(p.named), pa.array(p.tf)], ["doc_id", "tf"])
            yield from _cut(pa.RecordBatch.from_arrays([p.terms.take(pa.array(p.group[at])), pa.array((p.pos[at] // per_block).astype(np.int32)), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pairs)], ["term", "block", "n", "postings"]), 1 << 14)

    return _together(runs).mapInArrow(walk, "term string, block int, n long, postings array<struct<doc_id: long, tf: int>>")


def _encoded(v: np.ndarray, codec_name: str) -> np.ndarray:
    if codec_name != "varbyte":
        return np.full(len(v), 4, np.int64)
    return 1 + sum((v >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))


def blocks_of_runs(runs: DataFrame, codec_names: tuple[str, ...], per_block: int) -> DataFrame:
    """(term, block, last_doc_id, n_postings), and for each codec (doc_id_size, freq_size), with the codec's name after from the second one on."""
    names = ["term", "block", "last_doc_id", "n_postings", *[f"{n}{f'_{c}' if i else ''}" for i, c in enumerate(codec_names) for n in ("doc_id_size", "freq_size")]]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _walk(batches, per_block):
            at = _block_starts(p, per_block)
            ends = np.append(at[1:], len(p.group))
            sizes = [np.add.reduceat(_encoded(v, c), at) for c in codec_names for v in (p.delta, p.tf)]
            yield from _cut(pa.RecordBatch.from_arrays([p.terms.take(pa.array(p.group[at])), pa.array((p.pos[at] // per_block).astype(np.int32)), ids_of(p.named[ends - 1]), pa.array(ends - at), *map(pa.array, sizes)], names), 1 << 16)

    return _together(runs).mapInArrow(walk, ", ".join(f"{n} {'string' if n == 'term' else 'int' if n == 'block' else 'long'}" for n in names))


# Runs packed by the partition that their terms belong to: a row for each chunk of documents and partition, so that rows don't
# grow with the vocabulary, and what is shuffled is neither sorted by term nor turned from arrays into rows and back.

PACKED = "part int, first long, data binary, info binary"


@dataclass
class Packed:
    """Packed runs (part, first, data, info) and the number of their partitions."""

    rows: DataFrame
    n: int


def packed_parts(n: int, buckets: int = 1) -> int:
    """Partitions of packed runs for a wish of n: with more than the buckets a number for each bucket alike."""
    return -(-n // buckets) * buckets if n >= buckets else n


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> 1), _CRC >> 1)
#: Bytes of a term up to which its checksum is taken together with others', a byte of all at a time.
_SHORT = 32


def _crc32(terms: pa.Array) -> np.ndarray:
    """zlib.crc32 of each term."""
    sizes, chars = _chars(terms)
    starts, crc = np.cumsum(sizes, dtype=np.int64) - sizes, np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-sizes, kind="stable")
    upto = np.searchsorted(-sizes[order], -np.arange(_SHORT), "left")  # how many have a byte at this place
    for i, n in enumerate(upto.tolist()):
        some = order[:n]
        crc[some] = _CRC[(crc[some] ^ chars[starts[some] + i]) & 0xFF] ^ (crc[some] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in order[: np.searchsorted(-sizes[order], -_SHORT, "left")].tolist():
        crc[i] = zlib.crc32(chars[starts[i] : starts[i] + sizes[i]])
    return crc.astype(np.int64)


def bucket_and_part(terms: pa.Array, n: int, buckets: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of each term its bucket and its partition of ``packed_parts(n, buckets)``; none holds parts of two buckets if there are as many."""
    crc = _crc32(terms)
    own = crc % buckets
    if n < buckets:
        return own, own * n // buckets
    each = -(-n // buckets)
    return own, own * each + crc // buckets % each


def _chars(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each term, and all of them."""
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1]
    return np.diff(offsets), np.frombuffer(terms.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


#: Of terms: bytes of each, all bytes, postings of each; and ids, dls (or none) and tfs of the postings.
Piece = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]


def _packed(sizes: np.ndarray, chars: np.ndarray, lens: np.ndarray, named: np.ndarray, dl: np.ndarray | None, tf: np.ndarray) -> bytes:
    some = [named, lens.astype(np.int32), sizes.astype(np.int32), *([] if dl is None else [dl]), tf, chars]
    return b"".join([np.array([len(lens), len(named), dl is not None], np.int64).tobytes(), *[x.tobytes() for x in some]])


def _unpacked(data: pa.Buffer) -> Piece:
    n_terms, n, with_dl = np.frombuffer(data, np.int64, 3).tolist()
    at = 24

    def take(kind: type, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    named, lens, sizes = take(np.int64, n), take(np.int32, n_terms), take(np.int32, n_terms)
    dl, tf = take(np.int32, n) if with_dl else None, take(np.int32, n)
    return sizes, take(np.uint8, len(data) - at), lens, named, dl, tf


def packed_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = 1, with_dl: bool = False, with_info: bool = False) -> Packed:
    """(part, first, data, info): posting_runs packed, a row for each chunk of documents and partition of terms; ``with_info`` also a row of
    partition -1 for each chunk, of which ``info_of`` reads what is known of the documents."""
    n = parts(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, text in chunks(batches):
            c = Counts(ids, text, by_term=True, place=lambda terms: bucket_and_part(terms, n, buckets)[1])
            info = b"".join(x.tobytes() for x in (np.array([len(c.dl)], np.int64), c.named, c.dl, c.times, np.bincount(c.owner, minlength=len(c.dl)).astype(np.int32))) if with_info else None
            yield from _cut(_pieces_of(c.terms, c.code, c.named[c.owner], c.dl[c.owner] if with_dl else None, c.tf, c.part, info), 256)

    texts = _texts(docs, id_col, text_col)
    return Packed(texts.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(count, PACKED), packed_parts(n, buckets))


def _pieces_of(terms: pa.Array, code: np.ndarray, named: np.ndarray, dl: np.ndarray | None, tf: np.ndarray, part: np.ndarray, info: bytes | None) -> pa.RecordBatch:
    """Rows of packed runs: postings by term and within it by id, terms by their partition."""
    at, (sizes, chars) = np.searchsorted(code, np.arange(len(terms) + 1)), _chars(terms)
    lens, byte = np.diff(at), np.append(0, np.cumsum(sizes))
    cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
    out = [_packed(sizes[a:z], chars[byte[a] : byte[z]], lens[a:z], named[at[a] : at[z]], None if dl is None else dl[at[a] : at[z]], tf[at[a] : at[z]]) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    numbers, also = part[cut[:-1]], [None] * len(out)
    if info is not None:
        numbers, out, also = np.append(numbers, -1), [*out, None], [*also, info]
    first = np.full(len(out), named.min() if len(named) else NO_ID, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), pa.array(first), pa.array(out, pa.binary()), pa.array(also, pa.binary())], ["part", "first", "data", "info"])


def packed_rows(rows: DataFrame, buckets: int = 1) -> Packed:
    """Packed runs of postings (term, doc_id, dl, tf), CHUNK_POSTINGS at a time and what the last document has beyond."""
    n = parts(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            coded = table["term"].combine_chunks().dictionary_encode()
            terms = coded.dictionary.cast(pa.string())
            part = bucket_and_part(terms, n, buckets)[1]
            order = np.argsort(part, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            code = rank[coded.indices.to_numpy()]
            by_term = np.argsort(code, kind="stable")
            named, dl, tf = (table[c].to_numpy()[by_term] for c in ("doc_id", "dl", "tf"))
            return _pieces_of(terms.take(pa.array(order)), code[by_term], named, dl, tf, part[order], None)

        for b in batches:
            for at in range(0, b.num_rows, CHUNK_POSTINGS):
                part = b.slice(at, CHUNK_POSTINGS)
                if sum(x.num_rows for x in held) >= CHUNK_POSTINGS:
                    new = int(np.searchsorted(part["doc_id"].to_numpy(), held[-1]["doc_id"][-1].as_py(), "right"))
                    held.append(part.slice(0, new))
                    if new < part.num_rows:
                        yield from _cut(whole(), 256)
                        held = [part.slice(new)]
                else:
                    held.append(part)
        if held:
            yield from _cut(whole(), 256)

    own = rows.select("term", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("doc_id"), F.coalesce(F.col("dl").cast("int"), F.lit(0)).alias("dl"), F.col("tf").cast("int").alias("tf"))
    return Packed(own.where("term is not null").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(pack, PACKED), packed_parts(n, buckets))


def info_of(packed: Packed) -> DataFrame:
    """(doc_id, dl, n_terms) of packed runs with information: a row for each document, repeated ones too; n_terms is its postings, at the first row of several alike, 0 at the others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for value in b.column(0):
                data = value.as_buffer()
                n = int(np.frombuffer(data, np.int64, 1)[0])
                named, (dl, times, terms) = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int32, 3 * n, 8 + 8 * n).reshape(3, n)
                row = np.repeat(np.arange(n), times)
                first = np.append(True, row[1:] != row[:-1])[: len(row)]
                yield from _cut(pa.RecordBatch.from_arrays([ids_of(named[row]), pa.array(dl[row]), pa.array(np.where(first, terms[row], 0).astype(np.int32))], ["doc_id", "dl", "n_terms"]), CHUNK_POSTINGS)

    return packed.rows.where("part = -1").select("info").mapInArrow(read, "doc_id long, dl int, n_terms int")


def _by_part(packed: Packed) -> DataFrame:
    """Packed runs in their partitions, in the order of the documents."""
    return packed.rows.where("part >= 0").select("part", "first", "data").repartitionById(packed.n, "part").sortWithinPartitions("first").select("data")


def _merged(pieces: list[Piece]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """The different terms; group, id, dl and tf of all postings, by term and within it in the order of the pieces."""
    sizes, chars, lens, named, dl, tf = (None if x[0] is None else np.concatenate(x) for x in zip(*pieces, strict=True))
    at = np.append(0, np.cumsum(sizes, dtype=np.int64))
    small = at[-1] < 2**31
    names = (pa.StringArray if small else pa.LargeStringArray).from_buffers(len(sizes), pa.py_buffer(at.astype(np.int32) if small else at), pa.py_buffer(chars))
    coded = names.dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    own = lens[order].astype(np.int64)
    starts = np.cumsum(lens, dtype=np.int64) - lens
    take = np.repeat(starts[order] - (np.cumsum(own) - own), own) + np.arange(len(named))
    return coded.dictionary.cast(pa.string()), np.repeat(code[order].astype(np.int64), own), named[take], None if dl is None else dl[take], tf[take]


class State:
    """Numbers held for each term of a task, whatever batches it comes in."""

    def __init__(self, n: int) -> None:
        self.known = pa.array([], pa.string())
        self.held = np.zeros((n, 1024), np.int64)

    def codes(self, terms: pa.Array) -> np.ndarray:
        """Of different terms."""
        at, n = pc.index_in(terms, self.known), len(self.known)
        out = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if at.null_count:
            new = out < 0
            out[new] = n + np.arange(at.null_count)
            self.known = pa.concat_arrays([self.known, terms.filter(pa.array(new))])
        if len(self.known) > self.held.shape[1]:
            self.held = np.concatenate([self.held, np.zeros((len(self.held), 2 * len(self.known) - self.held.shape[1]), np.int64)], axis=1)
        return out


def _walk_packed(batches: Iterator[pa.RecordBatch], per_block: int = 0) -> Iterator[tuple[Placed, bool]]:
    """Packed runs in the order of the documents as postings with their places, about CHUNK_POSTINGS at a time, and whether they are the last.

    A term comes again with later documents: its count and last id are kept. With ``per_block`` a block is never divided: what a term has after its last whole
    block, and that block, are held, and merged with what comes once that is as much; so a task holds up to its vocabulary's open blocks."""
    state = State(2)

    def place(pieces: list[Piece], last: bool) -> tuple[Placed, list[Piece]]:
        terms, group, named, dl, tf = _merged(pieces)
        code = state.codes(terms)
        base, ends = state.held
        first = np.searchsorted(group, np.arange(len(terms) + 1))
        n = np.diff(first)
        done = n if last or not per_block else (n - 1) // per_block * per_block
        within = np.arange(len(group)) - first[group]
        before = np.append(0, named[:-1])
        before[first[:-1]] = ends[code]
        delta = np.where(named == NO_ID, NO_ID, named - np.where(before == NO_ID, 0, before))
        pos = within + base[code][group]
        some = done > 0
        base[code] += done
        ends[code[some]] = named[(first[:-1] + done - 1)[some]]
        if done is n:
            return Placed(terms, group, named, tf, pos, delta, dl, before), []
        emit = within < done[group]
        rest = (*_chars(terms), n - done, named[~emit], None if dl is None else dl[~emit], tf[~emit])
        return Placed(terms, group[emit], named[emit], tf[emit], pos[emit], delta[emit], None if dl is None else dl[emit], before[emit]), [rest]

    held: list[Piece] = []
    new: list[Piece] = []
    n_held = n_new = 0
    for b in batches:
        for value in b.column(0):
            new.append(_unpacked(value.as_buffer()))
            n_new += len(new[-1][3])
            if n_new >= max(CHUNK_POSTINGS, n_held):
                out, held = place([*held, *new], False)
                n_held, n_new, new = sum(len(x[3]) for x in held), 0, []
                if len(out.group):
                    yield out, False
    if held or new:
        yield place([*held, *new], True)[0], True


def _delta_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p, _ in _walk_packed(batches):
        yield pa.RecordBatch.from_arrays([p.terms.take(pa.array(p.group)), ids_of(p.named), pa.array(p.tf), pa.array((p.pos + 1).astype(np.int32)), ids_of(p.delta)], ["term", "doc_id", "tf", "pos", "delta"])


def _undelta_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, doc_id, tf, pos) of (term, tf, pos, delta): a term's rows are in the order of pos, in one batch or several; an error for ids that don't rise or exceed 2**63 - 1."""
    state = State(1)
    for b in batches:
        if not b.num_rows:
            continue
        coded = pc.run_end_encode(b["term"])
        code, ends = state.codes(coded.values), np.asarray(coded.run_ends, np.int64)
        first = np.append(0, ends[:-1])
        pos, delta = b["pos"].to_numpy(zero_copy_only=False), b["delta"]
        fine = delta.is_valid().to_numpy(zero_copy_only=False)
        delta = delta.fill_null(0).to_numpy()
        if not (fine & ((delta > 0) | ((pos == 1) & (delta == 0)))).all():
            raise ValueError("document ids don't rise")
        total = np.cumsum(delta)  # modulo 2**64, as the differences are
        lens = ends - first
        # runs of one term follow another only between batches
        ids = total + np.repeat(state.held[0][code] - (total[first] - delta[first]), lens)
        if (ids < 0).any():
            raise ValueError("a document id is too large")
        state.held[0][code] = ids[ends - 1]
        yield pa.RecordBatch.from_arrays([b["term"], pa.array(ids), b["tf"], b["pos"]], ["term", "doc_id", "tf", "pos"])


def undeltas_of(rows: DataFrame) -> DataFrame:
    """(term, doc_id, tf, pos) of (term, tf, pos, delta), a term's in one partition and in the order of pos."""
    return rows.select("term", "tf", "pos", "delta").mapInArrow(_undelta_batches, "term string, doc_id long, tf int, pos int")


def packed_deltas(packed: Packed) -> DataFrame:
    """deltas_of packed runs."""
    return _by_part(packed).mapInArrow(_delta_batches, "term string, doc_id long, tf int, pos int, delta long")


def packed_roundtrip(packed: Packed) -> DataFrame:
    """(term, doc_id, tf, pos): distances of packed runs, summed up again where they are made; the sum is given nothing of the ids."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _undelta_batches(b.select(["term", "tf", "pos", "delta"]) for b in _delta_batches(batches))

    return _by_part(packed).mapInArrow(both, "term string, doc_id long, tf int, pos int")


def packed_lists(packed: Packed, per_block: int) -> DataFrame:
    """lists_of packed runs."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, _ in _walk_packed(batches, per_block):
            at = _block_starts(p, per_block)
            ends = np.append(at, len(p.group)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([ids_of(p.named), pa.array(p.tf)], ["doc_id", "tf"])
            yield from _cut(pa.RecordBatch.from_arrays([p.terms.take(pa.array(p.group[at])), pa.array((p.pos[at] // per_block).astype(np.int32)), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pairs)], ["term", "block", "n", "postings"]), 1 << 14)

    return _by_part(packed).mapInArrow(walk, "term string, block int, n long, postings array<struct<doc_id: long, tf: int>>")


def _first_from(named: np.ndarray, low: np.ndarray, high: np.ndarray, target: int) -> np.ndarray:
    """Of each stretch from low to high, whose last id is not before the target, the place of its first id from the target on; all are halved at a time."""
    while (low < high).any():
        middle = (low + high) // 2
        before = named[middle] < target
        low, high = np.where(before, middle + 1, low), np.where(before, high, middle)
    return low


def _seek_batches(batches: Iterator[pa.RecordBatch], targets: Sequence[int], per_block: int) -> Iterator[pa.RecordBatch]:
    for p, last in _walk_packed(batches, per_block):
        at = _block_starts(p, per_block)
        ends = np.append(at[1:], len(p.group)) - 1
        for target in targets:
            from_ = max(target, NO_ID + 1)  # a posting without id is at no target
            opened = np.flatnonzero((p.named[ends] >= from_) & ((p.pos[at] == 0) | (p.before[at] < from_)))
            hit = _first_from(p.named, at[opened], ends[opened], from_)
            found = [(p.group[hit], pa.array(p.named[hit]), pa.array(p.tf[hit]))]
            if last:  # each term's last block was held until now, so no term is missing here
                over = ends[(p.named[ends] < from_) & np.append(p.group[1:] != p.group[:-1], True)[ends]]
                found.append((p.group[over], pa.nulls(len(over), pa.int64()), pa.nulls(len(over), pa.int32())))
            for group, ids, tf in found:
                yield from _cut(pa.RecordBatch.from_arrays([p.terms.take(pa.array(group)), pa.array(np.full(len(group), target, np.int64)), ids, tf], ["term", "target", "doc_id", "tf"]), 1 << 16)


def packed_seek(packed: Packed, targets: Sequence[int], per_block: int) -> DataFrame:
    """(term, target, doc_id, tf): of each term and target the first posting from the target on, null if there is none, sought in the task that makes the blocks.

    A term's block is opened for a target only if it ends at or after it and the block before doesn't; the lists themselves go nowhere."""
    wanted = sorted(set(targets))
    return _by_part(packed).mapInArrow(lambda batches: _seek_batches(batches, wanted, per_block), "term string, target long, doc_id long, tf int")


BLOCKS = "term string, block int, last_doc_id long, n_postings long, doc_id_size long, freq_size long"


def packed_blocks(packed: Packed, codec_name: str, per_block: int, buckets: int = 0) -> DataFrame:
    """blocks_of_runs of packed runs; with ``buckets`` also the term's bucket, the last id of its block before (0 without one) and the block's ids, dls and tfs."""
    names = [c.split()[0] for c in BLOCKS.split(", ")] + (["bucket", "before", "ids", "dls", "tfs"] if buckets else [])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, _ in _walk_packed(batches, per_block):
            at = _block_starts(p, per_block)
            ends = np.append(at[1:], len(p.group))
            sizes = [np.add.reduceat(_encoded(v, codec_name), at) for v in (p.delta, p.tf)]
            columns = [p.terms.take(pa.array(p.group[at])), pa.array((p.pos[at] // per_block).astype(np.int32)), ids_of(p.named[ends - 1]), pa.array(ends - at), *map(pa.array, sizes)]
            if buckets:
                offsets = pa.array(np.append(at, len(p.group)).astype(np.int32))
                own = bucket_and_part(p.terms, buckets, buckets)[0].astype(np.int32)
                columns += [pa.array(own[p.group[at]]), pa.array(p.before[at]), *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (p.named, p.dl, p.tf)]]
            yield from _cut(pa.RecordBatch.from_arrays(columns, names), 1 << 14)

    return _by_part(packed).mapInArrow(walk, BLOCKS + (", bucket int, before long, ids array<long>, dls array<int>, tfs array<int>" if buckets else ""))


def terms_of_ranges(lists: DataFrame, lasts: np.ndarray) -> DataFrame:
    """(range, n): how many terms have postings in each range of documents, of blocks (block, before, ids); lasts: the last id of each range, rising.

    A term is counted in a range at its first posting there, which the id before tells: nothing of it is moved."""
    shared = lists.sparkSession.sparkContext.broadcast(lasts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) + 1, np.int64)
        for b in batches:
            for part in _slices(iter([b])):
                # null ids come first, in the first range; a first block has no id before
                lens = pc.list_value_length(part["ids"]).to_numpy()
                own = np.searchsorted(shared.value, _flat(part["ids"]).to_numpy())
                before = np.append(-1, own[:-1])
                starts = np.cumsum(lens) - lens
                before[starts] = np.where(part["block"].to_numpy() == 0, -1, np.searchsorted(shared.value, part["before"].to_numpy()))
                total += np.bincount(own[own != before], minlength=len(total))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["range", "n"])

    found = lists.select("block", "before", "ids").mapInArrow(count, "range int, n long")
    return found.groupBy("range").agg(F.sum("n").alias("n"))
