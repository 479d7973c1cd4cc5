import json

import pytest

from ferrowick.functions.text import tokenize
from ferrowick.operators import search as se
from ferrowick.operators.index import build_index
from ferrowick.sources import files, sinks
from ferrowick.streaming import serve
from tests.test_retrieval import DEMO, TINY, collection


def written(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_collection(spark, tmp_path):
    path = written(tmp_path / "c.tsv", "0\tfoo bar\n\n2\tbar\rbaz\r\nno tab here\n4\tcafé a\tb\n")
    out = files.read_collection(spark, path)
    assert [(r.doc_id, r.line_pos) for r in out.orderBy("doc_id").collect()] == list(enumerate([0, 10, 11, 22, 34]))
    assert [r[0] for r in out.orderBy("doc_id").select(tokenize(out.text)).collect()] == [["foo", "bar"], [], ["bar", "baz"], ["no", "tab", "here"], ["caf", "a", "b"]]


def test_lines_of_many_splits_and_files(spark, tmp_path):
    lines = [f"{i}\t" + "é" * (i % 50) for i in range(3000)]
    for part in range(3):
        written(tmp_path / f"p{part}.tsv", "".join(x + "\n" for x in lines[part * 1000 : part * 1000 + 1000]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        out = [(r.line_no, r.line_pos, r.line) for r in files.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    at, expected = 0, []
    for i, x in enumerate(lines):
        expected.append((i, at, x))
        at += len(x.encode()) + 1
    assert out == expected


def test_queries_judgements_and_runs(spark, tmp_path):
    q = written(tmp_path / "q.tsv", "1\tfoo bar\nno tab\n2\tx\ty\n")
    assert [(r.qid, r.query) for r in files.read_queries(spark, q).orderBy("line_no").collect()] == [("1", "foo bar"), ("2", "x\ty")]
    assert [r.query for r in files.read_queries(spark, q, strict=False).orderBy("line_no").collect()] == ["foo bar", "no tab", "x\ty"]
    j = written(tmp_path / "j.txt", "q1 0 d1 1\nbad line\n  q1\t0  d2 0 \nq1 0 d1 2\nq2 0 d1 1 extra\n")
    assert sorted(tuple(r) for r in files.read_qrels(spark, j).collect()) == [("q1", "d1", 2), ("q1", "d2", 0)]
    r = written(tmp_path / "r.txt", "q1 Q0 d2 2 1.5 t\nq1 Q0 d1 1 2.5 t\nq1 Q0 d0 2 0.5 t\nshort line\n")
    assert sorted(tuple(x) for x in files.read_run(spark, r).collect()) == [("q1", "d0", 0.5), ("q1", "d1", 2.5), ("q1", "d2", 1.5)]
    assert sorted(tuple(x) for x in files.read_ranked_run(spark, r).collect()) == [("q1", "d0", 2), ("q1", "d1", 1), ("q1", "d2", 3)]


def test_a_run_written_is_read(spark, tmp_path):
    results = spark.createDataFrame([("q", 5, 1.23456789, 1), ("q", 3, 1.0, 2)], "qid string, doc_id long, score double, rank int")
    assert [r.value for r in sinks.run_lines(results, "T").orderBy("rank").collect()] == ["q Q0 5 1 1.234568 T", "q Q0 3 2 1.000000 T"]
    sinks.write_run(results, str(tmp_path / "run"))
    assert sorted(tuple(r) for r in files.read_run(spark, str(tmp_path / "run")).collect()) == [("q", "3", 1.0), ("q", "5", 1.234568)]


def test_latency_logs_and_sizes(spark, tmp_path):
    head = "threads,mode,qps,p50_us,p95_us,p99_us,throughput_chunk\n"
    written(tmp_path / "latency_t8.csv", head + "8,latency,2.5,1,2,3,0\n")
    written(tmp_path / "latency_t1.csv", "threads,qps,p50_us,p95_us,p99_us\n1,1.5,4,5,6\n")
    written(tmp_path / "latency_tx.csv", head + "9,latency,2.5,1,2,3,0\n")
    one = files.read_latency(spark, str(tmp_path / "none"))
    assert one.count() == 0
    (tmp_path / "latency_t1.csv").unlink()
    assert [tuple(r) for r in files.read_latency(spark, str(tmp_path)).collect()] == [("latency_t8.csv", 8, 2.5, 1.0, 2.0, 3.0)]
    assert files.max_rss_bytes("x\n  987654321  maximum resident set size\n") == 987654321
    with pytest.raises(ValueError):
        files.max_rss_bytes("nothing")
    assert files.size_of(written(tmp_path / "f", "12345")) == 5 and files.size_of(str(tmp_path / "missing")) == 0
    assert sinks.rss_report(200, 150)["reduction_percent"] == 25.0 and sinks.rss_report(0, 1)["reduction_percent"] == 0.0


def test_reports(spark, tmp_path):
    text = sinks.size_report(spark, 2048, {"index": 512, "lexicon": 512})
    assert "| **Total index** | 1.00 KB |" in text and "0.500x" in text
    text = sinks.compression_report(spark, {"raw32": {"index": 90, "blocks": 10}, "varbyte": {"index": 15, "blocks": 10}})
    assert "| varbyte | 15 B | 10 B | 25 B | 0.250x |" in text and "varbyte saves 75.0%" in text
    metrics = spark.createDataFrame([(0.5, 3)], "map double, num_queries long")
    assert json.loads(sinks.write_metrics(metrics, str(tmp_path / "m.json"), run="r")) == {"run": "r", "metrics": {"map": 0.5, "num_queries": 3}} == json.loads((tmp_path / "m.json").read_text())
    sinks.write_stats(metrics, str(tmp_path / "s.json"))
    rows = spark.createDataFrame([(1, "latency", 2.0, 1.0, 2.0, 3.0, 0)], "threads int, mode string, qps double, p50_us double, p95_us double, p99_us double, throughput_chunk int")
    sinks.write_latency(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == rows.columns


def test_responses(spark):
    queries = spark.createDataFrame([("a", "oak"), ("b", "zzz")], "qid string, query string")
    out = se.search_batch(build_index(collection(spark, TINY)), queries, se.SearchOptions(2, fill_passage=True))
    got = {r.qid: json.loads(r.response) for r in sinks.responses(queries, out).collect()}
    assert got["b"] == {"q": "zzz", "results": []}
    assert [(r["rank"], r["doc_id"], r["passage"]) for r in got["a"]["results"]] == [(1, 1, "oak oak"), (2, 4, "oak elm")]


REQUESTS = ['{"q": "bm25 ranking", "k": 3}', "", "not json", '{"q": "inverted index"}', '{"q": "search", "k": 0}', '{"q": "x", "mode": "odd"}', '{"q": "search engine", "mode": "conjunctive"}', '{"q": "xyzzy"}', "[1]", '{"k": "3"}', "{}"]


def test_request_lines(spark):
    index = build_index(collection(spark, DEMO))
    out = [json.loads(x) for x in serve.handle(index, REQUESTS)]
    assert [[r["doc_id"] for r in x["results"]] if "results" in x else "error" for x in out] == [[2], "error", [3], "error", "error", [5], [], "error", "error", []]
    assert serve.handle_together(index, REQUESTS) == list(serve.handle(index, REQUESTS))
    assert out[0]["q"] == "bm25 ranking" and out[0]["results"][0]["passage"] == DEMO[2][1] and out[1]["error"].startswith("server: ")
    assert list(serve.interactive(index, ["bm25\n", "\n", "zzz\n", "q\n", "search\n"]))[1] == "  (no results)"


def test_each_line_is_answered_before_the_next_is_read(spark):
    read = []

    def lines():
        for line in ('{"q": "ranking"}', "oops", '{"q": "model"}'):
            read.append(line)
            yield line

    replies = serve.handle(build_index(collection(spark, DEMO)), lines())
    assert read == [] and json.loads(next(replies))["results"][0]["doc_id"] == 2 and len(read) == 1
    assert "error" in json.loads(next(replies)) and len(read) == 2
    with serve.Retriever(build_index(collection(spark, DEMO))) as retriever:
        assert [r["doc_id"] for r in retriever.search("parallel", 3)] == [4]
        with pytest.raises(RuntimeError, match="k"):
            retriever.search("parallel", 0)
    with pytest.raises(RuntimeError, match="closed"):
        retriever.search("parallel")


def test_commands(spark, tmp_path, capsys, monkeypatch):
    import io

    from ferrowick import cli

    collection_path, index = written(tmp_path / "c.tsv", "".join(f"{i}\t{t}\n" for i, t in DEMO)), str(tmp_path / "index")

    def call(*args):
        code = cli.main([str(a) for a in args], spark)
        return code, capsys.readouterr().out

    code, out = call("build", "--index", index, "--collection", collection_path, "--buckets", 4, "--stats-json", tmp_path / "stats.json", "--spill-threshold", 10)
    stats = json.loads((tmp_path / "stats.json").read_text())
    assert code == 0 and stats["docs_processed"] == 6 and stats["spill_count"] >= 3 and json.loads(out.splitlines()[0]) == stats
    code, out = call("search", "--index", index, "--collection", collection_path, "--query", "parallel cores", "--conjunctive", "--top-k", 2)
    assert code == 0 and json.loads(out)["results"][0]["doc_id"] == 4
    monkeypatch.setattr("sys.stdin", io.StringIO('{"q": "ranking", "k": 1}\nno\n'))
    code, out = call("search", "--index", index, "--server")
    assert code == 0 and [list(json.loads(x)) for x in out.splitlines()] == [["q", "results"], ["error"]]
    queries = written(tmp_path / "q.tsv", "a\tranking\nno tab\nb\tinverted index\n")
    assert call("run", "--index", index, "--queries", queries, "--out", tmp_path / "run")[0] == 0
    qrels = written(tmp_path / "qrels", "a 0 2 1\nb 0 3 1\nc 0 1 1\n")
    code, out = call("evaluate", "--qrels", qrels, "--run", tmp_path / "run", "--out", tmp_path / "m.json")
    assert code == 0 and json.loads(out)["metrics"]["num_queries"] == 2 and abs(json.loads(out)["metrics"]["mrr_cut_10"] - 2 / 3) < 1e-9
    assert "skipped" in call("evaluate", "--qrels", tmp_path / "missing", "--run", tmp_path / "run", "--out", tmp_path / "m.json")[1]
    code, out = call("bench", "--index", index, "--queries", queries, "--csv", tmp_path / "csv")
    assert code == 0 and "qps=" in out and call("bench", "--index", index, "--queries", queries, "--offset", 9)[0] == 2
    code, out = call("rag", "--index", index, "--collection", collection_path, "--q", "which index lists words")
    assert code == 0 and "Question: which index lists words" in out and "[3]" in out.splitlines()[-1]
    assert call("search", "--index", tmp_path / "nowhere", "--query", "x")[0] == 2
    with pytest.raises(SystemExit):
        cli.main(["search", "--index", index, "--top-k", "0"], spark)


def test_request_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    written(tmp_path / "in" / "a.jsonl", "\n".join(REQUESTS[:6]) + "\n")
    index = build_index(collection(spark, DEMO))
    for name in ("b", None):
        q = serve.serve_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), index)
        q.awaitTermination()
        if name:
            written(tmp_path / "in" / "b.jsonl", REQUESTS[6] + "\n")
    out = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(r["results"][0]["doc_id"] for r in out if r.get("results")) == [2, 3, 5]
    assert sum("error" in r for r in out) == 3
