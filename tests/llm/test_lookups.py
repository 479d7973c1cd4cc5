"""BPE, URL filters and vector search against brute force and exact round trips."""

import base64
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrowick.llm import bpe, url_filter, vector_search
from tests.llm.common import docs, rows, sentence

# Byte-level BPE

TEXTS = [
    "Hello world, it's 2024!", "  two  blanks \n\n\t tabs\t", "don't can't we'll they've I'm he'd she's you're 'tis 'S 'LL", "çela été là-bas… naïve", "日本語テキスト と 한국어 and 😀👩‍👩‍👧", " nbsp em", "a" * 5000,
    "12345 ½ ² ٣٤", "<|endoftext|> <unk> ▁ ▁▁x", "\x00\x01\x7f", "x\r\ny\rz", "'", "''s", "' s", "trailing   ", "\n", " ", "é́̂", "_under_score__", "ſ ſs 'ſ", "İı", "�﻿",
]


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks())


def test_ids_are_those_of_another_implementation(codec, reference_encoding):
    rng = random.Random(11)
    odd = "abzAZ019 '\n\t .,!éßñ日😀sтm½_-"
    texts = TEXTS + ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [sentence(rng, 200) for _ in range(20)]
    for part in (texts, *[[t] for t in texts[:60]]):
        ids, offsets = codec.encode(part)
        for t, a, z in zip(part, offsets, offsets[1:], strict=False):
            assert ids[a:z].tolist() == reference_encoding.encode_ordinary(t), repr(t)
        assert codec.decode(ids, offsets) == part


def test_bpe_table_comes_back(spark):
    table = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, ""), (None, "null id"), (None, None), (102, "long text " * 60_000), (103, "again"), (103, "again")]
    coded = bpe.encode(docs(spark, table, extra=True), decode_too=True)
    assert coded.columns == ["doc_id", "token_ids", "n_tokens", "decoded"]
    assert rows(coded, "doc_id", "decoded") == sorted(table, key=repr)
    assert rows(bpe.decode(coded)) == sorted(table, key=repr)
    by_id = {r.doc_id: r for r in coded.collect()}
    assert by_id[100].token_ids is None and by_id[100].n_tokens is None and by_id[101].token_ids == [] and by_id[101].n_tokens == 0
    assert rows(bpe.encode(docs(spark, []))) == []


def test_another_vocabulary_and_ids_out_of_it(spark, codec):
    path = os.path.join(os.path.dirname(bpe.VOCABULARY), "byte_bpe_multi_50k.tiktoken")
    table = [(1, "Ein schöner Tag"), (2, "日本語")]
    assert rows(bpe.decode(bpe.encode(docs(spark, table), vocabulary=path), vocabulary=path)) == sorted(table)
    with pytest.raises(ValueError):
        codec.decode(np.array([10**6]), np.array([0, 1]))
    assert codec.decode(np.array([codec.encode(["é"])[0][0], bpe.read_ranks().index(b"\xff")]), np.array([0, 1, 2]))[1] == "�"


def test_a_table_of_pre_tokens_that_is_emptied_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 10)
    small, whole = bpe.Codec(bpe.read_ranks()), bpe.Codec(bpe.read_ranks())
    rng = random.Random(12)
    for _ in range(5):
        texts = [sentence(rng, 30) for _ in range(5)]
        assert small.encode(texts)[0].tolist() == whole.encode(texts)[0].tolist()


# URL filters


def pages(spark, urls, extra=False):
    if extra:
        return spark.createDataFrame([(i, u, "h", 1, "k", 2, 3) for i, u in urls], "page_id long, url string, html string, id long, key string, shard int, h1 long")
    return spark.createDataFrame(urls, "page_id long, url string")


def key_by_hand(url):
    import re

    m = url and re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*([^?#]*)", url)
    return m[1].lower() + m[2].rstrip("/") if m else None


URLS = [(i, f"http{'s' * (i % 2)}://{'WWW.' * (i % 3 == 0)}Site{i % 40}.org:80/p{i % 7}/{'?a=1#top' * (i % 2)}") for i in range(900)] + [
    (1000, None), (1001, ""), (1002, "no scheme"), (1003, "http:///path"), (1004, "ftp://u:p@Host.net"), (1005, "ftp://Host.net/"), (None, "http://site1.org/p1"), (1006, "http://h.org/" + "x" * 90_000), (1007, "http://site2.org/p2"), (1007, "http://site2.org/p2"),
]


@pytest.mark.parametrize("more", [{}, {"shard_keys": 40}, {"shard_keys": 40, "max_broadcast": 0}, {"max_broadcast": 0}])
def test_urls_are_marked_exactly(spark, more):
    rng = random.Random(13)
    keys = sorted({k for _, u in URLS if (k := key_by_hand(u))})
    listed = set(rng.sample(keys, 60)) | {"host.net"}
    table = spark.createDataFrame([(k,) for k in listed] + [(None,), ("elsewhere.org/x",), ("host.net",)], "key string")
    out = url_filter.filter_urls(pages(spark, URLS, extra=True), table, **more)
    assert rows(out) == sorted(((i, key_by_hand(u), key_by_hand(u) in listed) for i, u in URLS), key=repr)


def test_urls_with_nothing_everything_and_no_pages(spark):
    some = pages(spark, URLS)
    none = spark.createDataFrame([], "key string")
    assert {r.listed for r in url_filter.filter_urls(some, none).collect()} == {False}
    everything = some.select(url_filter.url_key(some.url).alias("key"))
    assert all(r.listed == (r.key is not None) for r in url_filter.filter_urls(some, everything).collect())
    assert rows(url_filter.filter_urls(pages(spark, []), none)) == []


def test_a_cascade_is_exact_and_small():
    rng = np.random.default_rng(14)
    h1, h2 = rng.integers(0, 1 << 63, (2, 200_000), dtype=np.uint64)
    listed = rng.random(200_000) < 0.02
    cascade = url_filter.build(h1, h2, listed)
    assert (url_filter.contains(cascade, h1, h2) == listed).all() and len(cascade) > 2
    assert sum(len(x[2]) for x in cascade) * 8 < 14 * listed.sum()


# Vector search


def nearest_by_hand(table, k, every=1):
    clean = {}
    for i, v in table:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            clean[i] = min(clean.get(i, v), v)
    lengths = [len(v) for v in clean.values()]
    d = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if lengths else 0
    clean = {i: np.array(v) for i, v in clean.items() if len(v) == d}
    out = []
    for i, v in clean.items():
        if i % every:
            continue
        order = sorted((((v - w) ** 2).sum(), j) for j, w in clean.items() if j != i)[:k]
        out += [(i, n + 1, j, round(float(np.sqrt(d2)), 6)) for n, (d2, j) in enumerate(order)]
    return sorted(out, key=repr)


def vectors(spark, table):
    return spark.createDataFrame([(i, v, 7, 1.5, "s") for i, v in table], "vec_id long, embedding array<double>, id long, d2 double, shard string")


@pytest.mark.parametrize("shard_rows", [1000, 60, 7])
def test_nearest_is_all_pairs(spark, shard_rows):
    rng = np.random.default_rng(15)
    centres = rng.normal(0, 5, (5, 6))
    table = [(i, [float(x) for x in np.round(centres[i % 5] + rng.normal(size=6), 1)]) for i in range(300)]
    table += [(400 + i, table[i][1]) for i in range(20)] + [(500 + i, [0.0] * 6) for i in range(30)]  # ties
    table += [(600, None), (601, []), (602, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (603, [float("nan")] * 6), (604, [float("inf")] + [0.0] * 5), (605, [1.0, 2.0]), (None, [0.0] * 6), (1, [99.0] * 6), (3, table[3][1])]
    assert rows(vector_search.nearest(vectors(spark, table), 5, shard_rows=shard_rows)) == nearest_by_hand(table, 5)
    if shard_rows == 60:
        some = vectors(spark, table).withColumn("embedding", F.col("embedding").cast("array<float>"))
        table = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in table]
        assert rows(vector_search.nearest(some, 5, queries=some.vec_id % 20 == 0, shard_rows=shard_rows)) == nearest_by_hand(table, 5, 20)


def test_nearest_of_a_vector_repeated_very_often(spark):
    table = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 0.0, 1.0]) for i in range(12_000)]
    some = vectors(spark, table)
    found = defaultdict(list)
    for r in vector_search.nearest(some, 4, queries=some.vec_id % 20 == 0, shard_rows=500).orderBy("rank").collect():
        found[r.vec_id].append((r.neighbor_id, r.distance))
    assert sorted(found) == list(range(0, 12_000, 20))
    repeated = [i for i in range(12_000) if i % 3]
    assert all(found[i] == [(j, 0.0) for j in [j for j in repeated[:5] if j != i][:4]] for i in found if i % 3)
    assert found[6000] == [(5997, 3.0), (6003, 3.0), (5994, 6.0), (6006, 6.0)]


def test_nearest_of_few_and_none(spark):
    table = [(1, [0.0]), (2, [3.0]), (3, [1.0])]
    assert rows(vector_search.nearest(vectors(spark, table), 10)) == nearest_by_hand(table, 10)
    assert rows(vector_search.nearest(vectors(spark, table[:1]), 10)) == []
    assert rows(vector_search.nearest(vectors(spark, []), 10)) == [] and rows(vector_search.nearest(vectors(spark, table), 0)) == []


def test_boxes_are_tight_and_hold_each_vector_once():
    rng = np.random.default_rng(16)
    x = rng.normal(size=(1000, 4))
    turned = x @ vector_search._axes(x)
    assert np.allclose(np.linalg.norm(turned[:50, None] - turned[None], axis=2), np.linalg.norm(x[:50, None] - x[None], axis=2))
    tree = vector_search.KDTree(x, turned, np.arange(1000), np.arange(1001), leaf=10)
    leaves = [s for s, kids in zip(tree.span, tree.kids, strict=True) if kids is None]
    assert sorted(leaves)[0][0] == 0 and sum(b - a for a, b in leaves) == 1000 and max(b - a for a, b in leaves) <= 10
    back = {tuple(v): w for v, w in zip(x.tolist(), turned, strict=True)}
    for (a, b), low, high in zip(tree.span, tree.low, tree.high, strict=True):
        own = np.array([back[tuple(v)] for v in tree.x[a:b].tolist()])
        assert (own.min(0) == low).all() and (own.max(0) == high).all()
