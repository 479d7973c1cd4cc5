import pytest
from pyspark.sql import functions as F

from ferrowick.functions import bm25, codec
from ferrowick.functions import text as tx


def one(spark, column, *values, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_tokens(spark):
    cases = {
        "Hello WORLD": ["hello", "world"],
        "BM25 retrieval": ["bm25", "retrieval"],
        "hello, world! it's me.": ["hello", "world", "it", "s", "me"],
        "<p>foo &amp; bar</p>": ["p", "foo", "amp", "bar", "p"],
        "café latte": ["caf", "latte"],
        "": [],
        " \t\n": [],
        "K9 İx": ["9", "x"],
        None: [],
    }
    assert one(spark, tx.tokenize(F.col("v")), *cases) == list(cases.values())


def test_query_tokens_drop_stop_words_and_keep_repeats(spark):
    assert len(tx.STOP_WORDS) == 40
    assert one(spark, tx.query_tokens(F.col("v")), "What is the Foo foo", "the of") == [["foo", "foo"], []]


def test_text_after_tab(spark):
    assert one(spark, tx.text_after_tab(F.col("v")), "1\ta b\tc", "no tab", "\t", "") == ["a b\tc", "no tab", "", ""]


def test_passages_are_cut_at_bytes_but_not_within_characters(spark):
    texts = ["x" * 600, "short", "é" * 300, "x" + "é" * 300, "日" * 200, "x" * 511 + "😀", "x" * 509 + "😀", "x" * 508 + "😀", ""]
    assert one(spark, tx.passage(F.col("v")), *texts) == [t.encode()[:512].decode("utf-8", "ignore") for t in texts]
    assert [bytes(b) for b in one(spark, tx.passage_bytes(F.col("v")), *texts)] == [t.encode()[:512] for t in texts]
    assert one(spark, tx.snippet(F.col("v")), "é" * 100) == ["é" * 60]


def test_prompt(spark):
    assert one(spark, tx.prompt_snippet(F.col("v"), 5), " \n ab\ncd \n", "abcdef", "abcde", None) == ["ab cd", "abcd…", "abcde", ""]
    row = spark.sql("select 'what is bm25' q, array(named_struct('rank', 2, 'doc_id', 3L, 'passage', 'two'), named_struct('rank', 1, 'doc_id', 2L, 'passage', 'bm25\\nis')) p")
    text = row.select(tx.prompt(F.col("q"), F.col("p"))).first()[0]
    assert "Cite each factual statement" in text and text.endswith("Passages:\n[2] bm25 is\n[3] two\n\nQuestion: what is bm25\nAnswer:")


def test_human_bytes(spark):
    assert one(spark, tx.human_bytes(F.col("v")), 0, 1023, 1024, 1536, 5 << 20, 3 << 30, schema="v long") == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "5.00 MB", "3.00 GB"]


def test_checked_int():
    assert tx.checked_int("10", "k", 1, 100) == 10
    for bad in ("x", "1.5", "0", "101", ""):
        with pytest.raises(ValueError):
            tx.checked_int(bad, "k", 1, 100)


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_bm25_values(spark):
    n = lambda x: F.lit(x)
    r = values(
        spark, score=bm25.term_score(n(10), n(2), n(3), n(5), n(10.0)), all_hold=bm25.idf(n(100), n(100)), many=bm25.idf(n(10000), n(9000)), rare=bm25.idf(n(10**6), n(1)), common=bm25.idf(n(10**6), n(10**5)),
        none=bm25.tf_norm(n(0), n(100), n(50.0)), full=bm25.tf_norm(n(10000), n(50), n(50.0)), flat_a=bm25.tf_norm(n(3), n(10), n(50.0), b=0.0), flat_b=bm25.tf_norm(n(3), n(1000), n(50.0), b=0.0), short=bm25.tf_norm(n(3), n(10), n(50.0), b=1.0), long=bm25.tf_norm(n(3), n(1000), n(50.0), b=1.0),
    )
    assert abs(r.score - 2.607623) < 1e-6 and r.all_hold > 0 and r.many > 0 and r.rare > r.common
    assert r.none == 0 and abs(r.full - 2.2) < 1e-2 and abs(r.flat_a - r.flat_b) < 1e-12 and r.short > r.long


LENGTHS = {0: 1, 1: 1, 127: 1, 128: 2, 255: 2, 16383: 2, 16384: 3, 2097151: 3, 2097152: 4, 268435455: 4, 268435456: 5, 4294967295: 5}


def test_codecs(spark):
    frame = spark.createDataFrame([(v,) for v in LENGTHS], "v long")
    v = F.col("v")
    for r in frame.select("v", codec.varbyte_length(v).alias("n"), codec.encode(v).alias("b"), codec.decode(codec.encode(v)).alias("d"), codec.encode(v, "raw32").alias("raw"), codec.decode(codec.encode(v, "raw32"), "raw32").alias("rd"), codec.encoded_length(v, "raw32").alias("four")).collect():
        assert r.n == LENGTHS[r.v] == len(r.b) and r.d == r.v == r.rd and bytes(r.raw) == r.v.to_bytes(4, "little") and r.four == 4
    assert bytes(values(spark, b=codec.encode(F.lit(128))).b) == b"\x80\x01" and bytes(values(spark, b=codec.encode(F.lit(0))).b) == b"\x00"


@pytest.mark.parametrize("data", ["X'80'", "X'0101'", "X''", "X'808080808001'"])
def test_cut_or_overlong_numbers_are_errors(spark, data):
    with pytest.raises(Exception, match="VarByte"):
        spark.range(1).select(codec.decode(F.expr(data))).collect()


def test_unknown_codec():
    with pytest.raises(ValueError):
        codec.checked_codec("zip")
