"""The pipeline against each stage by hand, and the registered queries."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from ferrowick.llm import _text as tx
from ferrowick.llm import bpe, decontaminate, near_dedup, toxicity
from tests.llm.common import docs, rows, sentence
from tests.llm.test_text_filters import least_distance, lines_by_hand, shingle_set


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, and the documents' rows."""
    rng = random.Random(20)
    items = [(k, sentence(rng, 12)) for k in range(5)]
    common = [sentence(rng, 7) for _ in range(2)]
    table, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        lines = [sentence(rng, 15) for _ in range(4)]
        if bad:
            lines[1] += " blorgish"
        if i % 3 == 1:
            lines.insert(2, common[i % 2])
        table.append((i, "\n".join(lines)))
        labels.append((i, 1, int(bad)))
    for i in range(300, 330):  # copies, near copies
        words = table[i - 299][1].split(" ")
        for _ in range(i % 3):
            words[rng.randrange(len(words))] = "changed"
        table.append((i, " ".join(words)))
    for i in range(400, 412):
        table.append((i, sentence(rng, 30) + "\n" + items[i % 5][1].upper() + "x" * (i % 3) + "\n" + sentence(rng, 20)))
    table += [(500, None), (501, ""), (None, sentence(rng, 25)), (502, "only this"), (503, table[5][1]), (503, table[5][1])]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs(spark, table).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, table, items


def flagged_by_hand(model, text):
    """The sum of the weights of a text's distinct features, word by word."""
    found = set()
    for word in tx.as_bytes(pa.array([text or ""]))[0].tobytes().translate(bytes(b if toxicity._WORD[b] else 32 for b in range(256))).split():
        data = np.frombuffer(word, np.uint8)
        for n in (None, *(n for n in toxicity.PREFIXES if n <= len(word))):
            h = int(tx.window_hashes(data, lower=True)(np.array([0]), np.array([n or len(word)]))[0])
            found.add((h ^ (0 if n is None else 0x9E3779B97F4A7C15 * n & (1 << 64) - 1)) >> (64 - toxicity.BITS))
    total = model.bias + sum(float(model.weights[f]) for f in found)
    return 1 / (1 + np.exp(-np.clip(total, -60, 60))) >= model.threshold


def kept_by_hand(table):
    """The documents left when all pairs of similar ones are joined into groups."""
    ids = sorted({i for i, t in table if i is not None and t and shingle_set(t)})
    text = {i: t for i, t in table}
    group = {i: i for i in ids}
    sets = {i: shingle_set(text[i]) for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= near_dedup.THRESHOLD * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return [(i, t) for i, t in table if i not in group or root(i) == i]


def test_pipeline_is_its_stages_by_hand(spark, corpus):
    import tiktoken

    folder, table, items = corpus
    model = toxicity.fit_toxicity(docs(spark, table), spark.read.parquet(f"{folder}/labels.parquet"))
    left = [(i, t) for i, t in table if not flagged_by_hand(model, t)]
    assert 190 < len(left) < 260
    lined = [(i, t) for i, t, _, dropped in lines_by_hand(left, 20) if not (dropped and not t.strip())]
    unique = kept_by_hand(lined)
    assert len(unique) < len(lined) - 20
    budget = lambda t: int(decontaminate.RATE * len(decontaminate.normalised(t)))
    clean = [(i, t) for i, t in unique if not any(t and least_distance(decontaminate.normalised(x), decontaminate.normalised(t)) <= budget(x) for _, x in items)]
    assert len(clean) < len(unique) - 8
    ranks = {t: r for r, t in enumerate(bpe.read_ranks())}
    coding = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = [(i, None if t is None else tuple(coding.encode_ordinary(t)), None if t is None else len(coding.encode_ordinary(t)), t) for i, t in clean]
    assert rows(corpus_pipeline.run(spark, folder), "doc_id", "token_ids", "n_tokens", "decoded") == sorted(expected, key=repr)


def test_stages_keep_the_columns_but_the_last(spark, corpus):
    folder = corpus[0]
    before = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert (stage(spark, before, folder).columns == before.columns) == (k < 4)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "byte-level BPE"]


def edited(rng, text, n):
    """text with n edits: characters replaced, left out or put in."""
    for _ in range(n):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["#", "", "#" + text[at]]) + text[at + 1 :]
    return text


def test_decontamination_query_is_all_pairs(spark, corpus, tmp_path):
    """All distances, within an item's budget and beyond it; the edit distance itself is held against the matrix elsewhere."""
    rng, folder, (given, table, items) = random.Random(22), str(tmp_path), corpus
    table = table + [(600 + 20 * k + n, f"{sentence(rng, 20)}\n{edited(rng, item, n)} {sentence(rng, 20)}") for k, item in items for n in range(12)]
    docs(spark, table).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{given}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    n, expected = decontaminate.normalised, []
    for i, text in table:
        for k, item in items:
            d = decontaminate.myers(n(item), n(text)) if text and text.strip() else len(item)
            if d <= int(decontaminate.RATE * len(n(item))):
                expected.append((i, k, d))
    assert len({d for *_, d in expected}) > 1
    assert len({(i, k) for i, k, _ in expected if i is not None and i >= 600}) < 12 * len(items)  # some are beyond it
    assert rows(__spark_entry__.queries()["op3_decontamination"](spark, folder), "doc_id", "item_id", "distance") == sorted(expected, key=repr)


def test_stages_with_very_long_texts_and_clashing_columns(spark, corpus, tmp_path):
    """Nulls in every column, a text of a megabyte and more, copies of it, columns of the operators' own names."""
    rng = random.Random(21)
    long = "\n".join(sentence(rng, 40) for _ in range(4_000))
    table = [(1, long), (2, long + " end"), (2, long), (3, None), (None, None), (None, ""), (4, corpus[2][0][1]), (5, "x" * 1_500_000), (6, "\n" * 100_000), (7, "one line"), (7, "one line")]
    folder = str(tmp_path)
    wide = docs(spark, table, extra=True).withColumns({"kept": F.lit(None).cast("string"), "near_dedup_text_hash": F.lit("n"), "keeper": F.lit(1), "fw_hash": F.lit(2), "held": F.lit(True), "text_hash": F.lit(3)})
    wide.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    before = spark.read.parquet(f"{folder}/documents.parquet")
    left = {"toxicity": table, "line dedup": table, "near dedup": [r for k, r in enumerate(table) if k not in (1, 2, 9)], "decontamination": [r for r in table if r[0] != 4]}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, before, folder)
        assert out.columns == before.columns
        assert sorted((r.doc_id, len(r.text or "")) for r in out.where("doc_id is not null").collect()) == sorted((i, len(t or "")) for i, t in left[name] if i is not None), name
        assert {(r.keeper, r.fw_hash, r.text_hash, r.score) for r in out.collect()} == {(1, 2, 3, 0.5)}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {i for i in found if i is not None} == {1, 3, 5, 6, 7} and found[1].decoded == long and found[5].decoded == "x" * 1_500_000


def test_pipeline_of_no_documents(spark, corpus, tmp_path):
    folder = str(tmp_path)
    docs(spark, []).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert rows(corpus_pipeline.run(spark, folder)) == []


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 11)])
def test_every_operator_has_its_query(name):
    assert len([q for q in __spark_entry__.queries() if q.startswith(name)]) == 1


def test_queries_are_the_operators_over_whole_tables(spark):
    """On the driver's smallest tables: queries without SQL against brute force."""
    folder = "/root/testdata/sf0.001"
    queries = __spark_entry__.queries()
    table = spark.read.parquet(f"{folder}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in table.collect()]
    assert rows(queries["op8_bpe"](spark, folder), "doc_id", "decoded") == sorted(texts, key=repr)
    found = {(r.doc_id, r.item_id) for r in queries["op3_decontamination"](spark, folder).collect() if r.distance == 0}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    n = decontaminate.normalised
    assert found == {(i, k) for i, t in texts for k, x in items if n(x) in n(t)}
    kept = {i for i, _ in kept_by_hand(texts)}
    assert rows(queries["op6_near_dedup"](spark, folder), "doc_id") == sorted(((i,) for i, _ in texts if i not in kept), key=repr)
    truth = {r.doc_id: r.lang for r in table.collect()}
    assert np.mean([truth[r.doc_id] == r.language for r in queries["op10_language"](spark, folder).collect()]) > 0.97
    assert queries["op1_quality"](spark, folder).count() == queries["op5_toxicity"](spark, folder).count() == len(texts)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op4_top_k", "op7_substring_dedup", "op9_url_filter"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    import duckdb

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    expected = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    found = __spark_entry__.queries()[name](spark, folder)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, expected.fetchall()))
