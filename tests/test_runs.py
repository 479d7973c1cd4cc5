"""Counting where the text is, runs of postings, and scores in chunks: what they hold is bounded, whatever the table's size."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrowick.functions import codec
from ferrowick.operators import index as ix
from ferrowick.operators import runs as ru
from ferrowick.operators import search as se


def table(n=60, seed=3):
    """A stop word in all texts, ids that repeat with equal and other texts, no text, no id."""
    rng = random.Random(seed)
    rows = [(rng.randrange(3 * n), " ".join(rng.choice(["The", "the,", "Kelvin \u212a", "É", "x1", "Oak-elm", "ſ"]) for _ in range(rng.randint(0, 9))) + "|the") for _ in range(n)]
    return [*rows, rows[0], (rows[1][0], "the other"), (5, None), (7, ""), (-4, "the negative")]


def words(text):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text or "")]


def by_hand(rows):
    out = {}
    for i, t in rows:
        for w in words(t):
            key = w, i, len(words(t))
            out[key] = out.get(key, 0) + 1
    return out


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(table(), "doc_id long, text string").repartition(5)


def test_tokens_end_with_their_text():
    found, dl = ru.tokens(pa.array(["skipped", "ab", "cd", None, "", "É1é", "\u212ak", "a b "])[1:])
    assert found.to_pylist() == ["ab", "cd", "1", "k", "a", "b"] and dl.tolist() == [1, 1, 0, 0, 1, 1, 2]
    assert ru.tokens(pa.array([], pa.string()))[1].tolist() == [] and ru.tokens(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0]


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_chunks_are_small_and_never_divide_an_id(size, monkeypatch):
    monkeypatch.setattr(ru, "CHUNK_BYTES", size)
    rows = sorted((i, t) for i, t in table() if t is not None)
    batches = [pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows[at : at + 7]]) for at in range(0, len(rows), 7)]
    out = [list(zip(i.to_pylist(), t.to_pylist(), strict=True)) for i, t in ru.chunks(iter(batches))]
    assert [r for c in out for r in c] == rows
    assert len({i for c in out for i in {i for i, _ in c}}) == sum(len({i for i, _ in c}) for c in out)
    assert all(sum(len(t.encode()) for i, t in c if i != c[-1][0]) <= size for c in out)


def test_postings_take_no_aggregation(spark, docs):
    rows = ix.postings(docs)
    assert "Aggregate" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r.term, r.doc_id, r.dl): r.tf for r in rows.collect()} == by_hand(table())


def test_partitions_grow_with_the_table_and_not_with_the_session(spark, docs, monkeypatch, tmp_path):
    assert ru.parts(docs) == 4  # nothing is known of it
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(ru, "PART_BYTES", 1000)
    n = ru.parts(docs)
    assert 20 > n > 4 == int(spark.conf.get("spark.sql.shuffle.partitions"))
    third = [ix.postings(docs.where(F.pmod("doc_id", F.lit(3)) == i)) for i in range(3)]
    merged = ix.merge_postings(third[0].union(third[1]).union(third[2]))
    assert merged.rdd.getNumPartitions() >= n
    assert {(r.term, r.doc_id, r.dl): r.tf for r in merged.collect()} == by_hand(table())


@pytest.mark.parametrize("per_block", [1, 3, 128])
@pytest.mark.parametrize(("size", "most"), [(1, 1), (60, 4), (1 << 20, 1 << 18)])
def test_walks_over_runs_by_hand(per_block, size, most, monkeypatch):
    """Terms that go on over chunks and batches, blocks that a batch's end would divide."""
    monkeypatch.setattr(ru, "CHUNK_POSTINGS", most)
    rng = random.Random(size)
    want = {w: sorted(rng.sample(range(1, 400), n)) for w, n in (("a", 50), ("b", 1), ("c", 128), ("d", 3), ("e", 129))}
    pieces = []
    for w, ids in want.items():
        while ids:
            n = rng.randint(1, min(len(ids), size))
            pieces.append({"term": w, "ids": ids[:n], "tfs": [i % 5 + 1 for i in ids[:n]]})
            ids = ids[n:]
    kinds = pa.schema([("term", pa.string()), ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32()))])
    batches = [pa.RecordBatch.from_pylist(pieces[at : at + 5], kinds) for at in range(0, len(pieces), 5)]
    found, blocks = [], set()
    for p in ru._walk(iter(batches), per_block):
        assert len(p.group) <= size + most + per_block
        found += zip(p.terms.take(pa.array(p.group)).to_pylist(), p.named.tolist(), p.tf.tolist(), p.pos.tolist(), p.delta.tolist(), strict=True)
        own = {(p.terms[p.group[i]].as_py(), p.pos[i] // per_block) for i in range(len(p.group))}
        assert not own & blocks
        blocks |= own
    assert found == [(w, i, i % 5 + 1, k, i - (ids[k - 1] if k else 0)) for w, ids in want.items() for k, i in enumerate(ids)]


def test_runs_and_rows_give_the_same(spark, docs):
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    once = once.persist()
    rows, runs = ix.postings(once), ix.posting_runs(once)
    for f in (ix.posting_deltas, ix.posting_lists, ix.blocks, lambda r: ix.posting_lists(r, 2), lambda r: ix.blocks(r, "raw32", 3)):
        assert sorted(map(repr, f(rows).collect())) == sorted(map(repr, f(runs).collect()))
    assert sorted(map(tuple, ru.flattened(runs).select("term", "doc_id", "dl", "tf").collect())) == sorted(map(tuple, rows.collect()))


def test_a_task_scores_a_chunk_of_documents_at_a_time(monkeypatch):
    rng = random.Random(8)
    rows = [{"term": w, "doc_id": d, "dl": 9, "tf": rng.randint(1, 3)} for d in range(200) for w in rng.sample("abcdef", 3)]
    kinds = pa.schema([("term", pa.string()), ("doc_id", pa.int64()), ("dl", pa.int32()), ("tf", pa.int32())])
    batches = [pa.RecordBatch.from_pylist(rows[at : at + 50], kinds) for at in range(0, len(rows), 50)]
    batch = se.Batch(pa.array([0, 1]), [np.array([0, 1]), np.array([2, 2, 5])], pa.array(list("abcdef")), np.array([1.0, 2.0, 1.5, 1.2, 1.1, 3.0]), 9.0)

    def top(found, k):
        out = {0: [], 1: []}
        for q, ids, scores in found:
            out[q] += zip((-scores).round(9).tolist(), ids.tolist(), strict=True)
        return {q: sorted(x)[:k] for q, x in out.items()}

    for conjunctive in (False, True):
        whole = top(batch.score(pa.Table.from_batches(batches), None, conjunctive), 10**6)
        for size, held in ((7, 10**6), (1, 3), (1 << 18, 10**6)):
            monkeypatch.setattr(se, "CHUNK_POSTINGS", size)
            monkeypatch.setattr(se, "HELD_RESULTS", held)
            tables = list(se._documents(iter(batches)))
            assert max(t.num_rows for t in tables) <= 2 * size + 3 and sum(t.num_rows for t in tables) == len(rows)
            assert top(se.best_of(batch, iter(tables), None, conjunctive), 10**6) == whole
            best = list(se.best_of(batch, iter(tables), 5, conjunctive))
            assert top(best, 5) == {q: x[:5] for q, x in whole.items()}
            if held > 3:
                assert sum(len(ids) for _, ids, _ in best) < 60


@pytest.mark.parametrize("name", codec.CODECS)
def test_codecs_are_compiled_expressions(spark, name):
    values = [0, 1, 127, 128, 129, 16383, 16384, 2097151, 2097152, 268435455, 268435456, 2**32 - 1]
    out = spark.createDataFrame([(v,) for v in values], "v long").select("v", codec.encode(F.col("v"), name).alias("e")).select("v", "e", codec.decode(F.col("e"), name).alias("d"))
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        want = r.v.to_bytes(4, "little") if name == "raw32" else bytes([*((r.v >> 7 * i) & 127 | 128 for i in range((max(r.v.bit_length(), 1) - 1) // 7)), r.v >> (max(r.v.bit_length(), 1) - 1) // 7 * 7])
        assert (bytes(r.e), r.d) == (want, r.v)


def test_texts_that_hold_an_item():
    items = ["Alpha beta gamma delta epsilon zeta eta", "alpha beta gamma delta epsilon zeta etas", "one two three four five six seven eight", "beta gamma delta epsilon zeta eta one"]
    found = ru.Passages(pa.table({"qid": list("abcd"), "item": items}))
    texts = [None, "xAlpha beta gamma delta epsilon zeta etas", "beta gamma delta epsilon", "zeta eta", "one two three four five six seven eight; Alpha beta gamma delta epsilon zeta eta one", "", "beta, gamma delta epsilon zeta eta one"]
    assert sorted(found.held(pa.array(texts))) == sorted((r, i) for r, t in enumerate(texts) for i, x in enumerate(items) if t and x in t)
    assert list(ru.Passages(pa.table({"qid": pa.array([], pa.int64()), "item": pa.array([], pa.string())})).held(pa.array(texts))) == []


def test_judgements_take_no_row_for_each_token(spark):
    from ferrowick.plans import queries as plans

    plan = plans.judgements(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


@pytest.mark.parametrize(("size", "most"), [(1, 1), (60, 7), (1 << 20, 1 << 18)])
def test_packed_runs_give_the_same_as_rows(spark, docs, size, most, monkeypatch):
    """Terms that come again with later chunks, blocks that a chunk's end would divide, a document without id."""
    monkeypatch.setattr(ru, "CHUNK_BYTES", size)
    monkeypatch.setattr(ru, "CHUNK_POSTINGS", most)
    once = docs.dropDuplicates(["doc_id"]).persist()
    rows, packed = ix.postings(once), ix.packed_postings(once)
    for f in (ix.posting_deltas, ix.posting_lists, ix.blocks, lambda r: ix.posting_lists(r, 2), lambda r: ix.blocks(r, "raw32", 3)):
        assert sorted(map(repr, f(rows).collect())) == sorted(map(repr, f(packed).collect()))
    positive = ix.packed_postings(once.where("doc_id > 0"))
    want = rows.where("doc_id > 0").select("term", "doc_id", "tf").collect()
    found = ix.delta_roundtrip(positive).collect()
    assert sorted((r.term, r.doc_id, r.tf) for r in found) == sorted(map(tuple, want))
    assert sorted(map(tuple, ix.undelta(ix.posting_deltas(positive)).collect())) == sorted(map(tuple, found))


@pytest.mark.parametrize("per_block", [1, 3, 128])
@pytest.mark.parametrize(("size", "most"), [(1, 1), (60, 7), (1 << 20, 1 << 18)])
def test_targets_are_sought_where_the_lists_are_made(spark, docs, per_block, size, most, monkeypatch):
    """Each target once for each term, whatever chunks its list comes in: before, between, at and after its ids, negative ones and none."""
    monkeypatch.setattr(ru, "CHUNK_BYTES", size)
    monkeypatch.setattr(ru, "CHUNK_POSTINGS", most)
    rng = random.Random(per_block)
    rows = [(i, t) for i, t in {**dict(table(90)), -7: "only negative", 333: "only late once"}.items()] + [(None, "nothing the")]
    some = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    targets = (10**9, 0, -(2**63), 2**63 - 1, -7, -6, 333, 334, *rng.sample(range(-3, 300), 12), 0)
    want = {}
    for w in {w for _, t in rows for w in words(t)}:
        held = sorted((i, words(t).count(w)) for i, t in rows if i is not None and w in words(t))
        want |= {(w, x): next((h for h in held if h[0] >= x), (None, None)) for x in targets}
    packed = ix.packed_postings(some)
    pieces = packed.rows.where("part >= 0").orderBy("part", "first").toArrow()
    found = [ix.seek_in_all(packed, targets, per_block).toArrow().to_pylist(), []]
    for part in range(packed.n):  # in this process too, where the sizes set above hold
        own = pieces.filter(pa.compute.equal(pieces["part"], part)).select(["data"]).to_batches(max_chunksize=2)
        found[1] += [r for b in ru._seek_batches(iter(own), sorted(set(targets)), per_block) for r in b.to_pylist()]
    if size == 60:  # lists that were made before, with a table of targets
        asked = spark.createDataFrame(sorted(want), "term string, target long")
        found.append(ix.seek(ix.posting_lists(packed, per_block), asked).toArrow().to_pylist())
        found.append(ix.first_in_all(ix.postings(some), targets).toArrow().to_pylist())
        assert ix.first_in_all(ix.postings(some), ()).count() == ix.seek_in_all(packed, ()).count() == 0
    for out in found:
        assert len(out) == len(want) and {(r["term"], r["target"]): (r["doc_id"], r["tf"]) for r in out} == want
    with pytest.raises(ValueError):
        ix.seek_in_all(packed, targets, 0)


def test_seeking_keeps_and_joins_no_lists(spark):
    """Texts are read once, moved once and moved once more as packed runs; nothing is written for a second reading."""
    from ferrowick.plans import queries as plans

    plan = plans.QUERIES["posting_seek"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Existing" not in plan and plan.count("FileScan") == 1
    assert plan.count("Exchange") <= 2
    plan = plans.QUERIES["first_posting_from"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1 and "SortAggregate" not in plan


def test_registered_lists_are_not_sorted_by_term(spark):
    """What moves is a row for each chunk and partition; a round trip moves nothing between its ways."""
    from ferrowick.plans import queries as plans

    for name in ("posting_deltas", "delta_roundtrip", "posting_lists", "block_info", "varbyte_roundtrip"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Sort [term" not in plan and "Window" not in plan and "hashpartitioning(term" not in plan, name
        assert plan.count("Exchange") - plan.count("ReusedExchange") <= 2, name


def test_packed_parts_hold_one_bucket_each():
    terms = pa.array(["skipped", *[f"t{i}" for i in range(2000)], "", "x" * 31, "y" * 32, "z" * 33])[1:]
    assert ru._crc32(terms).tolist() == [zlib.crc32(t.encode()) for t in terms.to_pylist()]
    for n, buckets in ((1, 1), (7, 1), (5, 64), (64, 64), (130, 64)):
        own, part = ru.bucket_and_part(terms, n, buckets)
        assert part.max() < ru.packed_parts(n, buckets) and set(own.tolist()) <= set(range(buckets))
        if n >= buckets:
            assert len(set(zip(own.tolist(), part.tolist(), strict=True))) == len(set(part.tolist()))


def test_a_saved_index_of_awkward_rows(spark, docs, tmp_path, monkeypatch):
    """Texts are tokenised once, postings lie in blocks, and a spill's terms are counted without moving postings."""
    rows = table()
    want = by_hand(rows)
    monkeypatch.setattr(ru, "lengths", lambda *a: 1 / 0)
    built = ix.Index(ix.postings(docs), None, None, docs, pack=lambda buckets: ru.packed_runs(docs, buckets=buckets, with_dl=True, with_info=True))
    for n, index in enumerate((built, ix.Index(ix.postings(docs).persist(), None, ix.corpus_stats(ix.postings(docs).select("dl"))))):
        path = f"{tmp_path}/{n}"
        index.save(path, 3, per_block=2)
        again = ix.Index.load(spark, path)
        assert {(r.term, r.doc_id, r.dl): r.tf for r in again.postings.collect()} == want
        assert {(r.term, r.doc_id, r.dl) for r in again.postings_of(["the", "x1"]).collect()} == {k for k in want if k[0] in ("the", "x1")}
        blocks = again.blocks.orderBy("term", "block").collect()
        assert [b.start_offset for b in blocks] == [sum(x.doc_id_size + x.freq_size for x in blocks[:i]) for i in range(len(blocks))]
        terms = sorted({k[0] for k in want})
        assert [(r.term, r.term_id, r.df) for r in again.lexicon.orderBy("term").collect()] == [(t, i, sum(k[0] == t for k in want)) for i, t in enumerate(terms)]
        per = {}
        for t, i, _ in want:
            per.setdefault(i, []).append(t)
        segments, total = [[]], 0
        for i in sorted(per):
            if total >= 20:
                segments, total = [*segments, []], 0
            segments[-1] += per[i]
            total += len(per[i])
        stats = ix.saved_stats(again, 20)
        assert "hashpartitioning(term" not in stats._jdf.queryExecution().executedPlan().toString()
        found = stats.first()
        assert (found.spill_count, found.peak_partial_postings, found.peak_unique_terms) == (len(segments), max(map(len, segments)), max(len(set(s)) for s in segments))
    assert sorted((r.doc_id, r.dl) for r in ix.Index.load(spark, f"{tmp_path}/0").docinfo.collect()) == sorted((i, len(words(t))) for i, t in rows)
