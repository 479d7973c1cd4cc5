"""Operator 9: URL filters by a cascade of Bloom filters.

A URL's key is its host in lower case and its path. The corpus's complete key universe is known, so membership can be
made exact: level 0 encodes the listed keys, level 1 the keys of the universe that level 0 accepts
falsely, level 2 the listed keys that level 1 accepts, and so on until a level accepts nothing falsely. A key's first
level that rejects it tells the answer by its parity. The pages are then filtered without a join.

The universe's distinct keys are shuffled once, as 128-bit hashes, and fall into shards of about
``shard_keys`` keys, each with its own cascade (about 2 to 20 bits a listed key). Filters of up to ``max_broadcast``
bytes together are broadcast; larger ones are sent with the pages' hashes to the shards' tasks, each of which
holds one shard's cascade at a time.

Defined results: a null URL, or one without a host, has a null key and isn't listed; null listed keys are ignored;
listed keys that no page has change nothing; pages with equal URLs are each reported; empty tables
give an empty result, an empty list lists nothing. Further columns are ignored: the result has the id, ``key`` and ``listed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrowick.llm import _text as tx
from ferrowick.llm._session import cut_lineage

SHARD_KEYS, MAX_BROADCAST = 1_000_000, 64 << 20
_HOST, _PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"

Level = tuple[int, int, np.ndarray]  # bits, hashes, bytes
Cascade = list[Level]


def url_key(url: Column) -> Column:
    """Host in lower case and path without slashes at its end; null without a host."""
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(host != "", F.concat(host, F.regexp_replace(F.regexp_extract(url, _PATH, 1), "/+$", "")))


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    salt = np.uint64(0xA0761D6478BD642F * (level + 1) & (1 << 64) - 1)
    a, b = tx.mix(h1 ^ salt), tx.mix(h2 + salt) | np.uint64(1)
    for i in range(hashes):
        yield ((a + np.uint64(i) * b) >> np.uint64(1)) % np.uint64(bits)


def _level(h1: np.ndarray, h2: np.ndarray, level: int, rate: float) -> Level:
    hashes = max(1, round(-np.log2(rate)))
    bits = max(64, int(np.ceil(len(h1) * -np.log(rate) / np.log(2) ** 2)))
    data = np.zeros(-(-bits // 8), np.uint8)
    for at in _positions(h1, h2, level, bits, hashes):
        np.bitwise_or.at(data, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return bits, hashes, data


def _accepts(one: Level, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    bits, hashes, data = one
    found = np.ones(len(h1), bool)
    for at in _positions(h1, h2, level, bits, hashes):
        found &= (data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def build(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> Cascade:
    """The cascade of one shard's keys; empty if none is listed."""
    out: Cascade = []
    inside, outside = (h1[listed], h2[listed]), (h1[~listed], h2[~listed])
    rate = min(0.5, max(len(inside[0]) * 0.5**0.5 / max(len(outside[0]), 1), 1e-6))
    while len(inside[0]):
        if len(out) == 200:
            raise ValueError("two keys have the same hashes")
        out.append(_level(*inside, len(out), rate))
        false = _accepts(out[-1], *outside, len(out) - 1)
        inside, outside, rate = (outside[0][false], outside[1][false]), inside, 0.5
    return out


def contains(cascade: Cascade, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys are listed; exact for keys of the universe."""
    answer = np.full(len(h1), len(cascade) % 2 == 1)
    open_ = np.arange(len(h1))
    for i, one in enumerate(cascade):
        passed = _accepts(one, h1[open_], h2[open_], i)
        answer[open_[~passed]] = i % 2 == 1
        open_ = open_[passed]
    return answer


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")


def build_cascades(universe: DataFrame, listed: DataFrame, *, key_col: str = "key", shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(shard, level, bits, hashes, data) and the number of shards, from tables of keys; the listed ones may lie outside the universe."""
    part = lambda df, flag: df.where(F.col(key_col).isNotNull()).select(*_hashes(F.col(key_col)), F.lit(flag).alias("listed"))
    keys = cut_lineage(part(universe, False).union(part(listed, True)).groupBy("h1", "h2").agg(F.max("listed").alias("listed")))
    shards = max(1, -(-keys.count() // shard_keys))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        h1, h2 = (t[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        levels = build(h1, h2, t["listed"].to_numpy())
        return pa.table(
            [pa.array([key[0].as_py()] * len(levels), pa.int32()), pa.array(range(len(levels)), pa.int32()), pa.array([x[0] for x in levels], pa.int64()), pa.array([x[1] for x in levels], pa.int32()), pa.array([x[2].tobytes() for x in levels], pa.binary())],
            ["shard", "level", "bits", "hashes", "data"],
        )

    return cut_lineage(keys.groupBy(F.pmod("h2", F.lit(shards)).cast("int").alias("shard")).applyInArrow(run, "shard int, level int, bits long, hashes int, data binary")), shards


def mark_listed(pages: DataFrame, cascades: DataFrame, shards: int, *, id_col: str = "page_id", url_col: str = "url", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(id, key, listed) of every row."""
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, key string, listed boolean"
    own = pages.select(F.col(id_col).alias("id"), url_key(F.col(url_col)).alias("key"))
    rows = own.select("id", "key", *_hashes(F.col("key")))
    total = cascades.agg(F.sum(F.length("data"))).first()[0] or 0

    def answer(cascade_of: dict[int, Cascade], b: pa.RecordBatch) -> pa.RecordBatch:
        h1, h2 = (b.column(i).to_numpy().view(np.uint64) for i in (2, 3))
        shard = np.mod(h2.view(np.int64), shards)
        listed = np.zeros(len(h1), bool)
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            listed[at] = contains(cascade_of.get(s, []), h1[at], h2[at])
        listed &= b.column(1).is_valid().to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(listed)], [id_col, "key", "listed"])

    if total <= max_broadcast:
        found: dict[int, Cascade] = {}
        for r in cascades.orderBy("shard", "level").collect():  # at most max_broadcast bytes
            found.setdefault(r.shard, []).append((r.bits, r.hashes, np.frombuffer(r.data, np.uint8)))
        shared = pages.sparkSession.sparkContext.broadcast(found)
        return rows.mapInArrow(lambda batches: (answer(shared.value, b) for b in batches), schema)

    nothing = {"level": "int", "bits": "long", "hashes": "int", "data": "binary"}
    queries = rows.select("*", F.coalesce(F.pmod("h2", F.lit(shards)), F.lit(0)).cast("int").alias("shard"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    filters = cascades.select(F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "shard", *nothing)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: dict[int, Cascade] = {}
        for b in batches:
            levels = b.filter(b.column(5).is_valid())
            for r in levels.to_pylist():
                if r["shard"] not in current:  # keep the shards of this batch only
                    current = {s: c for s, c in current.items() if s >= b.column(4)[0].as_py()}
                current.setdefault(r["shard"], []).append((r["bits"], r["hashes"], np.frombuffer(r["data"], np.uint8)))
            yield answer(current, b.filter(b.column(5).is_null()))

    return queries.union(filters).repartition(shards, "shard").sortWithinPartitions("shard", F.col("level").asc_nulls_last()).mapInArrow(stream, schema)


def tracked_keys(pages: DataFrame, *, url_col: str = "url") -> DataFrame:
    """The list of the registered query: keys that some page's URL reaches with a tracking parameter."""
    return pages.where(F.col(url_col).contains("utm_source=")).select(url_key(F.col(url_col)).alias("key"))


def filter_urls(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", key_col: str = "key", shard_keys: int = SHARD_KEYS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(id, key, listed) of every page, with the pages' own keys as the universe."""
    cascades, shards = build_cascades(pages.select(url_key(F.col(url_col)).alias("key")), listed.select(F.col(key_col).alias("key")), shard_keys=shard_keys)
    return mark_listed(pages, cascades, shards, id_col=id_col, url_col=url_col, max_broadcast=max_broadcast)


_SQL_KEY = f"nullif(lower(regexp_extract(url, '{_HOST}', 1)), '') || regexp_replace(regexp_extract(url, '{_PATH}', 1), '/+$', '')"
ORACLE_SQL = f"""
WITH keyed AS (SELECT page_id, url, {_SQL_KEY} AS key FROM pages)
SELECT page_id, key, coalesce(key IN (SELECT key FROM keyed WHERE contains(url, 'utm_source=') AND key IS NOT NULL), false) AS listed FROM keyed
"""
