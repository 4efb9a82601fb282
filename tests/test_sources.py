from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lexmill.plans import shared
from lexmill.sources import readers, writers
from lexmill.streaming import ingest


def test_topics(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1\tfirst query\twith tab\n\n2\tsecond\n")
    (tmp_path / "t.jsonl").write_text('{"id": "a", "title": "x"}\n{"qid": "b", "query": "y"}\n')
    assert sorted(map(tuple, readers.read_topics(spark, str(tmp_path / "t.tsv")).collect())) == [("1", "first query\twith tab"), ("2", "second")]
    assert sorted(map(tuple, readers.read_topics(spark, str(tmp_path / "t.jsonl")).collect())) == [("a", "x"), ("b", "y")]


def test_qrels_and_runs(spark, tmp_path):
    (tmp_path / "q.txt").write_text("q1 0 d1 1\nq1 d2 2\nbad line\nq1 0 d1 3\nq1 0 d3 x\na b c d e\n")
    got = {(r["qid"], r["doc_id"]): r["rel"] for r in readers.read_qrels(spark, str(tmp_path / "q.txt")).collect()}
    assert got == {("q1", "d1"): 3, ("q1", "d2"): 2}
    df = spark.createDataFrame([("q", "d1", 0, 2.5), ("q", None, 1, 2.0), ("q", "d3", 2, 1.0)], "qid string, doc_id string, rank0 int, score double")
    writers.write_run(df, str(tmp_path / "run"), "mine")
    lines = [line for f in sorted((tmp_path / "run").glob("part*")) for line in f.read_text().splitlines()]
    assert lines == ["q Q0 d1 1 2.500000 mine", "q Q0 d3 3 1.000000 mine"]
    back = {(r["doc_id"], r["rank"], r["score"], r["run"]) for r in readers.read_run(spark, str(tmp_path / "run")).collect()}
    assert back == {("d1", 1, 2.5, "mine"), ("d3", 3, 1.0, "mine")}
    assert writers.run_lines(df, "x", None).first()["line"] == "q Q0 d1 1 1000.000000 x"


def test_expansions(spark, tmp_path):
    rows = [
        {"qid": "n", "KEY_ENTITIES": {"a": ["x", "y"], "b": {"lexical": ["z"], "conceptual": []}}, "ASSOCIATED_TERMS": ["t"], "VERBS": ["v"]},
        {"qid": "f", "core": ["c"], "expansion": ["e"]},
        {"qid": "p", "KEY: one": ["k"], "SUP: two": ["s"], "AUX: three": ["u"]},
        {"qid": "b", "raw": "broken"},
    ]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    want = {("n", "key", "a", "x"), ("n", "key", "a", "y"), ("n", "key", "b", "z"), ("n", "assoc", "", "t"), ("n", "verb", "", "v"), ("f", "key", "", "c"), ("f", "assoc", "", "e"), ("p", "key", "one", "k"), ("p", "assoc", "two", "s"), ("p", "assoc", "three", "u")}
    assert set(map(tuple, readers.read_expansions(spark, str(tmp_path / "e.jsonl")).collect())) == want
    (tmp_path / "e.json").write_text(json.dumps({r.pop("qid"): r for r in rows}))
    assert set(map(tuple, readers.read_expansions(spark, str(tmp_path / "e.json")).collect())) == want


def test_found_and_lookup(spark, tmp_path):
    (tmp_path / "q7.jsonl").write_text('{"doc_id": "d", "segment": "s", "text": "t", "relevance": 2}\n{"docid": "e", "text": " "}\n')
    assert [tuple(r) for r in readers.read_found(spark, str(tmp_path / "*.jsonl")).collect()] == [("q7", "d", "s", 2)]
    with gzip.open(tmp_path / "part_03.jsonl.gz", "wt") as f:
        f.write('{"docid": "a_b_c_d_03_1", "segment": "here"}\n{"docid": "a_b_c_d_03_2", "segment": "other"}\n')
    out = readers.lookup_ids(spark, str(tmp_path), ["a_b_c_d_03_1", "a_b_c_d_99_1", "odd"])
    assert [tuple(r) for r in out.collect()] == [("a_b_c_d_03_1", "here")]


def test_batches_orders_and_limits(spark):
    files = spark.createDataFrame([("s", f"f{i}") for i in range(5)] + [("t", "g")], "subset string, path string")
    got = {(r["batch"], r["path"]) for r in readers.file_batches(files, "subset", "path", 2).collect()}
    assert ("batch_0002_s", "f4") in got and ("batch_0000_t", "g") in got
    order = readers.strided_order(spark.createDataFrame([(i,) for i in range(7)], "b int"), "b", 3).orderBy("position")
    assert [r["b"] for r in order.collect()] == [0, 3, 6, 1, 4, 2, 5]
    df = spark.createDataFrame([(i, 10) for i in range(6)], "i int, n int")
    assert [r["i"] for r in readers.take_until(df, ["i"], "n", 25).orderBy("i").collect()] == [0, 1, 2]
    assert readers.in_all_folders(spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], "d string, n string"), "d", "n", 2).first()[0] == "x"


def test_enrich_pending_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", "own"), ("b", None), ("c", None)], "doc_id string, text string")
    texts = spark.createDataFrame([("a", "new"), ("b", "new")], "doc_id string, text string")
    assert dict(map(tuple, writers.enrich(rows, texts).collect())) == {"a": "own", "b": "new", "c": None}
    assert dict(map(tuple, writers.enrich(rows, texts, replace=True).collect())) == {"a": "new", "b": "new", "c": None}
    assert [r["doc_id"] for r in writers.pending(rows, texts, ["doc_id"]).collect()] == ["c"]
    writers.write_table(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    writers.append_done(texts, str(tmp_path / "done"))
    writers.append_done(texts, str(tmp_path / "done"))
    assert spark.read.json(str(tmp_path / "done")).count() == 4
    coded = spark.createDataFrame([(i, list(range(i % 4))) for i in range(40)], "doc_id long, ids array<int>").repartition(2)
    path = f"file://{tmp_path}/shards"
    made = writers.write_token_shards(coded, path, tokens_per_shard=20).collect()
    assert sum(r["sentences"] for r in made) == 40 and sum(r["tokens"] for r in made) == 60 and len(made) > 2
    assert sorted(tuple(r["tokens"]) for r in readers.shard_sentences(spark, path, per_task=3).collect()) == sorted(tuple(range(i % 4)) for i in range(40) if i % 4)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "shards").iterdir()}
    assert sorted(map(tuple, writers.write_token_shards(coded, path, tokens_per_shard=20).collect())) == sorted(map(tuple, made))
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "shards").iterdir()} == before  # a shard that is there stays


def test_stream_counts_new_files_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"text": "a b a"}\n{"text": " "}\n{"text": null}\n')
    run = lambda: {r["tok"]: r["tf"] for r in ingest.streamed_vocabulary(spark, str(src), "text string", str(tmp_path / "out"), str(tmp_path / "ck"), "json").collect()}
    assert run() == {"a": 2, "b": 1}
    assert run() == {"a": 2, "b": 1}
    (src / "b.json").write_text('{"text": "B c"}\n')
    assert run() == {"a": 2, "b": 2, "c": 1}


def test_stream_prepares_and_writes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"text": "One <b>is</b>. Two"}\n')
    rows = ingest.prepared(ingest.corpus_stream(spark, str(src), "text string"), "sentences")
    ingest.run_to_end(rows, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [r["item"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["One is .", "Two"]
    with pytest.raises(ValueError, match="mode"):
        ingest.prepared(rows, "odd")


def test_shared_tables(spark):
    df = shared.cut(spark.range(10).withColumn("x", F.lit("a")))
    assert df.count() == 10 and df.columns == ["id", "x"]
    assert shared.sized_broadcast(df, 10)[1] and not shared.sized_broadcast(df, 9)[1]
    assert spark.range(1).withColumn("a.b`c", F.lit(1)).select(shared.col("a.b`c")).first()[0] == 1


def test_tables_of_a_scratch_are_removed(spark):
    kept = shared.cut(spark.range(3))
    with shared.scratch():
        inner = shared.cut(spark.range(5))
        path = inner.inputFiles()[0]
        assert inner.count() == 5 and shared.still_there(spark, path)
    assert not shared.still_there(spark, path) and kept.count() == 3


def test_written_index(spark, tmp_path):
    from lexmill.operators import cnf, index

    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (4, "")], "doc_id long, text string")
    words = index.doc_words(docs)
    at = index.build_index(docs, f"file://{tmp_path}/ix", 4)
    hits = cnf.phrase_hits(None, spark.createDataFrame([("b c",)], "phrase string"), at)
    assert [(r["doc_id"], r["pos"]) for r in hits.collect()] == [(2, 0)]
    assert {r["tok"]: (r["tf"], r["df"]) for r in at.words.collect()} == {"a": (1, 1), "b": (3, 2), "c": (1, 1)}
    assert {r["doc_id"]: r["dl"] for r in at.docs.collect()} == {1: 3, 2: 2, 3: 0, 4: 0}
    alts = cnf.alternatives(spark, {"q": [[["b", "c"]], [["b"], ["zz"]]]})
    assert cnf.matches(None, alts, at=at).collect() == cnf.matches(words, alts).collect()
    plan = index.postings_of(at, spark.createDataFrame([("b",)], "tok string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(tok,b)" in plan
    assert cnf.set_matches(index.build_index(docs.limit(0), f"file://{tmp_path}/none", 4), cnf.word_sets(spark.createDataFrame([("q", ["a"])], "q string, ws array<string>"), "q", "ws")).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        applicationId, master = "other", "spark://host:7077"

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda name, default=None: default)})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Session())
    big = shared.cut(spark.range(3).withColumn("x", F.lit("a")))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 10)
    assert not shared.sized_broadcast(big)[1]


def test_arrays_and_shards(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "s0_ids.npy", np.array([5, 6, 7, 8], np.uint16))
    np.save(tmp_path / "s0_offsets.npy", np.array([0, 3, 3, 4]))
    (tmp_path / "odd.npy").write_bytes(b"not an array")
    arrays = readers.read_arrays(spark, str(tmp_path))
    assert {r["filename"]: r["n"] for r in arrays.collect()} == {"s0_ids.npy": 4, "s0_offsets.npy": 4}
    got = sorted((r["shard"], r["sentence"], r["tokens"]) for r in readers.shard_sentences(spark, str(tmp_path)).collect())
    assert got == [("s0", 0, [5, 6, 7]), ("s0", 2, [8])]


def test_unigrams_and_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5, 0.5), (2, "b", 1, 0.1)], "token_id long, token string, count long, probability double")
    df.write.parquet(str(tmp_path / "u.parquet"))
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "u.csv"))
    for name in ("u.parquet", "u.csv"):
        assert [r["token"] for r in readers.unigrams_of(readers.read_unigrams(spark, str(tmp_path / name)), ["a", "b", "z"]).collect()] == ["b", "a"]
    for run in ("r1", "r2"):
        df.select("token").coalesce(1).write.parquet(str(tmp_path / "runs" / run))
    assert {(r["run"], r["n"]) for r in readers.read_results(spark, str(tmp_path / "runs")).groupBy("run").agg(F.count("*").alias("n")).collect()} == {("r1", 2), ("r2", 2)}


def test_settings(tmp_path):
    from lexmill.plans.settings import Settings

    (tmp_path / "c.yml").write_text("# comment\nbudget: 5_000  # less\nrun_name: 'mine'\ncutoffs: [5, 10]\nqrels:\nodd: 1\n")
    s = Settings.load(str(tmp_path / "c.yml"))
    assert (s.budget, s.run_name, s.cutoffs, s.qrels, s.key_standalone) == (5000, "mine", (5, 10), None, 1500)
    s.save(str(tmp_path / "c.json"))
    assert Settings.load(str(tmp_path / "c.json")) == s
    with pytest.raises(ValueError, match="odd"):
        Settings.load(str(tmp_path / "c.yml"), strict=True)
