"""Operator 6: MinHash near-dedup.

One-permutation hashing: every shingle of ``WORDS`` words is hashed once; the hash names one of ``BINS`` bins, which keeps
its least value. Empty bins are filled by optimal densification: each draws bins from its own sequence
of universal hashes, the same for all documents, until it meets a filled one. Documents with equal
signatures are one node. Nodes are bucketed by bands of the signature; each bucket gives the edges of a star, from
its least id to the others, so a bucket of m gives m - 1 pairs. An edge stands if enough bins agree; the
groups are the connected components, found by passing least labels with pointer jumping. Buckets whose members, the
hub aside, are then of several components are settled: each member in turn is the hub of those of other components, until any two
members of a bucket are of one component or compared. So the groups are those of all pairs that share a bucket.

Defined results: null, empty and blank texts have no shingles and are never duplicates; a text shorter
than a shingle is one shingle; rows with a null id are in no group; rows that repeat an id are one document if their
signatures are equal, else each is grouped by its own text; an empty table gives an empty result. Of a group the lowest id is the
keeper; of its rows the stage keeps one. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrowick.llm import _text as tx
from ferrowick.llm._session import cut_lineage

BINS, WORDS = 128, 3
#: Bins in a band, and bands: pairs of similarity 0.45 share a bucket in 98 % of cases.
ROWS, BANDS = 3, 42
THRESHOLD = 0.5
#: Members of a bucket that one task holds on either side; larger buckets are settled block against block.
BLOCK = 2048
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _donors() -> np.ndarray:
    """For each bin the bins that it draws, in turn; every bin is among them."""
    rng = np.random.default_rng(7)
    draws = rng.integers(0, BINS, (BINS, 4 * BINS))
    return np.concatenate([draws, np.tile(np.arange(BINS), (BINS, 1))], 1)


_DONORS = _donors()


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit hashes of all runs of n words; a shorter text is one shingle."""
    starts, ends, rows = tx.words(data, offsets, _WORD)
    if not len(starts):
        return rows, np.zeros(0, np.uint64)
    word = tx.window_hashes(data, lower=True)(starts, ends)
    h = word.copy()
    of_row = np.searchsorted(rows, np.arange(len(offsets)))  # first word of each row
    left = of_row[rows + 1] - np.arange(len(rows))  # words from here to the row's end
    for i in range(1, n):
        reach = np.flatnonzero(left > i)
        h[reach] = tx.mix(h[reach] * np.uint64(0x9E3779B97F4A7C15) + word[reach + i])
    whole = (left >= n) | (np.arange(len(rows)) == of_row[rows])
    return rows[whole], tx.mix(h[whole])


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An array of uint32, rows by bins, and which rows have shingles."""
    out, some = np.zeros((len(texts), BINS), np.uint32), np.zeros(len(texts), bool)
    bits = np.uint64(BINS.bit_length() - 1)
    for first, end, data, offsets in tx.chunks(texts):
        rows, h = shingles(data, offsets)
        if not len(rows):
            continue
        for lo in range(0, end - first, 4096):  # row, bin and value share 64 bits: 12, 7 and 32
            pick = slice(*np.searchsorted(rows, [lo, lo + 4096]))
            if pick.start == pick.stop:
                continue
            keys = np.sort(((rows[pick] - lo).astype(np.uint64) << (np.uint64(32) + bits)) | (h[pick] >> (np.uint64(32) - bits)))
            keys = keys[tx.first_of_runs(keys >> np.uint64(32))]
            own = (keys >> (np.uint64(32) + bits)).astype(np.int64)
            n = min(end - first - lo, 4096)
            sig, full = np.zeros((n, BINS), np.uint32), np.zeros((n, BINS), bool)
            at = ((keys >> np.uint64(32)) & np.uint64(BINS - 1)).astype(np.int64)
            sig[own, at], full[own, at] = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), True
            has = full.any(1)
            r, b = np.nonzero(~full & has[:, None])
            for turn in range(_DONORS.shape[1]):
                if not len(r):
                    break
                donor = _DONORS[b, turn]
                good = full[r, donor]
                sig[r[good], b[good]] = sig[r[good], donor[good]]
                r, b = r[~good], b[~good]
            out[first + lo : first + lo + n], some[first + lo : first + lo + n] = sig, has
    return out, some


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig, some = signatures(b.column(1))
        pick = np.flatnonzero(some)
        packed = pa.Array.from_buffers(pa.binary(BINS * 4), len(pick), [None, pa.py_buffer(np.ascontiguousarray(sig[pick]))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pick)), b.column(2).take(pa.array(pick)), packed], ["id", "text_hash", "sig"])


def _agree(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, BINS) for i in (2, 3))
            keep = (one == two).sum(1) >= threshold * BINS
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep))

    return run


def joined(sig: np.ndarray, component: np.ndarray, side: np.ndarray, cut: float) -> tuple[list[int], list[int]]:
    """Pairs of rows that agree in cut bins and join components. All pairs of rows that stay in different ones have been compared; with two sides, those across."""
    component, across = component.copy(), len(np.unique(side)) > 1
    one, two = [], []
    for i in range(len(sig)):
        rest = np.flatnonzero(component[i + 1 :] != component[i]) + i + 1
        if across:
            rest = rest[side[rest] != side[i]]
        hits = rest[(sig[rest] == sig[i]).sum(1) >= cut]
        if len(hits):
            met, first = np.unique(component[hits], return_index=True)
            one += [i] * len(met)
            two += hits[first].tolist()
            component[np.isin(component, met)] = component[i]
    return one, two


def _settle(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, low, high, side, component, label, sig), those of a cell (bucket, low, high) in a row."""
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            ends = _ends(held)
            yield from _edges(held, ends[:-1], threshold)
            held = held.slice(ends[-2] if len(ends) > 1 else 0)  # the last cell may go on
        if held is not None:
            yield from _edges(held, _ends(held), threshold)

    return run


def _ends(table: pa.Table) -> list[int]:
    cell = np.stack([table.column(i).to_numpy() for i in range(3)])
    return [*(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1).tolist(), *([table.num_rows] if table.num_rows else [])]


def _edges(table: pa.Table, ends: list[int], threshold: float) -> Iterator[pa.RecordBatch]:
    for start, end in zip([0, *ends], ends):
        part = table.slice(start, end - start).combine_chunks()
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, BINS)
        one, two = joined(sig, part.column("component").to_numpy(), part.column("side").to_numpy(), threshold * BINS)
        if one:
            label = part.column("label").combine_chunks()
            label = label.chunk(0) if isinstance(label, pa.ChunkedArray) else label
            yield pa.RecordBatch.from_arrays([label.take(pa.array(one)), label.take(pa.array(two))], ["u", "v"])


def settled(spokes: DataFrame, labels: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v): labels of components that members of one bucket join, from the buckets' members (bucket, node), their (node, label) and (node, sig)."""
    members = spokes.join(labels, "node").select("bucket", "node", "label")
    mixed = members.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most")
    cells = members.join(mixed.select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks")), "bucket").withColumn("side", F.pmod(F.xxhash64("node"), "blocks"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.join(nodes.select("node", "sig"), "node").select("bucket", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", F.xxhash64("label").alias("component"), "label", "sig")
    kind = labels.schema["label"].dataType.simpleString()
    return cells.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(_settle(threshold), f"u {kind}, v {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id of each vertex's connected component, from (u, v). Each round passes labels along the edges, then follows the label's own label."""
    both = cut_lineage(edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v").distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")))
    while True:
        heard = both.join(labels, F.col("v") == F.col("id")).groupBy("u").agg(F.min("label").alias("heard"))
        passed = labels.join(heard, F.col("id") == F.col("u")).select("id", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        up = labels.select(F.col("id").alias("on"), F.col("label").alias("further"))
        new = cut_lineage(passed.join(up, F.col("label") == F.col("on")).select("id", "was", F.least("label", "further").alias("label")))
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def _text_hash(text_col: str):
    return F.xxhash64(F.col(text_col))


def grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, text_hash, node, keeper) of every row that has shingles; node and keeper are (id, a), the least id of a signature and the signature's hash."""
    kind = docs.schema[id_col].dataType.simpleString()
    signed = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col, _text_hash(text_col).alias("text_hash")).mapInArrow(_sign, f"id {kind}, text_hash long, sig binary")
    signed = cut_lineage(signed.select("id", "text_hash", "sig", F.xxhash64("sig").alias("a"), F.hash("sig").alias("b")))
    # aggregated before the shuffle, so that a text copied any number of times is one row a task
    nodes = signed.groupBy("a", "b").agg(F.min("id").alias("id"), F.min("sig").alias("sig"))
    nodes = cut_lineage(nodes.select("a", "b", F.struct("id", "a").alias("node"), "sig"))
    kind = nodes.schema["node"].dataType.simpleString()
    width = 4 * ROWS
    bands = nodes.select("node", F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(BANDS)])).alias("bucket"))
    hubs = bands.groupBy("bucket").agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spokes = cut_lineage(bands.join(hubs, "bucket").where("node <> u").select("bucket", "u", "node"))
    edges = spokes.select("u", F.col("node").alias("v")).distinct()
    sig = lambda name: nodes.select(F.col("node").alias(name), F.col("sig").alias(f"sig_{name}"))
    judged = edges.join(sig("u"), "u").join(sig("v"), "v").select("u", "v", "sig_u", "sig_v").mapInArrow(_agree(threshold), f"u {kind}, v {kind}")
    labels = cut_lineage(nodes.select("a", "b", "node").join(components(judged).withColumnRenamed("id", "node"), "node", "left").select("a", "b", "node", F.coalesce("label", "node").alias("label")))
    further = components(settled(spokes.select("bucket", "node"), labels.select("node", "label"), nodes, threshold)).toDF("label", "further")
    labels = labels.join(further, "label", "left").select("a", "b", "node", F.coalesce("further", "label").alias("keeper"))
    return signed.select("id", "text_hash", "a", "b").join(labels, ["a", "b"]).select("id", "text_hash", "node", "keeper")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, keeper_id) of every document that duplicates another and isn't its group's keeper."""
    found = grouped(docs, id_col, text_col, threshold).where("id <> keeper.id")
    return found.select(F.col("id").alias(id_col), F.col("keeper.id").alias("keeper_id")).distinct()


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group; rows are told apart by id and text."""
    key = ["fw_id", "fw_text_hash"]
    found = cut_lineage(grouped(docs, id_col, text_col, threshold).groupBy("id", "text_hash").agg(F.first("node").alias("node"), F.first("keeper").alias("keeper"), F.count(F.lit(1)).alias("n")))
    kept = found.where("node = keeper and id = keeper.id").groupBy("keeper").agg(F.min("text_hash").alias("text_hash"))
    kept = kept.select(F.col("keeper.id").alias("id"), "text_hash")
    gone = found.select("id", "text_hash").join(kept, ["id", "text_hash"], "left_anti").toDF(*key)
    # packed, so that no further column can bear a name used here
    keyed = docs.select(F.col(id_col).alias(key[0]), _text_hash(text_col).alias(key[1]), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("fw_row"))
    left = keyed.join(gone, key, "left_anti")
    twice = cut_lineage(found.where("n > 1").join(kept, ["id", "text_hash"], "left_semi").select("id", "text_hash").toDF(*key))
    if not twice.isEmpty():
        left = left.join(twice, key, "left_anti").unionByName(left.join(twice, key, "left_semi").dropDuplicates(key))
    return left.select(*[F.col(f"fw_row.`{c}`").alias(c) for c in docs.columns])
