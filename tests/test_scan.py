from __future__ import annotations

import math
import random
from itertools import product
from types import SimpleNamespace

import pyarrow as pa
import pytest

from lexmill import queries as core
from lexmill.operators import build, rank, scan
from lexmill.plans import registry, shared
from tests.compare import DATA

SMALL = DATA / "sf0.001"

SETS = {"a": ["a"], "ab": ["a", "b"], "abc": ["a", "b", "c"], "abcd": ["a", "b", "c", "d"], "bcdef": list("bcdef"), "zz": ["a", "zz"]}


def _span(d, ws):
    places = [[k for k, w in enumerate(d) if w == x] for x in ws]
    return (min((max(p) - min(p) for p in product(*places)), default=0), min(map(len, places))) if all(places) else None


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    docs = {i: [rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(0, 25))] for i in range(1200)}
    lists = scan.word_lists(spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()] + [(5000, None), (None, "a b")], "doc_id long, text string"))
    sets = spark.createDataFrame(list(SETS.items()), "query_id string, ws array<string>")
    words = scan.frequencies(lists, spark.createDataFrame([(w,) for w in [*"abcdef", "zz"]], "tok string"))
    want = {(q, i): s for q, ws in SETS.items() for i, d in docs.items() if (s := _span(d, ws))}
    return lists, sets, words, want


@pytest.mark.parametrize("held", [400_000, 2])
def test_sets_met_in_one_pass_against_loops(corpus, held):
    lists, sets, words, want = corpus
    assert {(r["query_id"], r["doc_id"]): (r["span"], r["n_occ"]) for r in scan.matches(lists, sets, words, held).collect()} == want


def test_counts_of_one_pass_against_loops(corpus):
    lists, sets, words, want = corpus
    got = {(r["query_id"], r["at"]): (r["n_docs"], r["n_occ"]) for r in scan.counts(lists, sets, words, [0, 3, None], 3).collect()}
    expected = {}
    for k, most in enumerate((0, 3, 10**9)):
        for (q, _), (span, n) in want.items():
            if span <= most:
                d, o = expected.get((q, k), (0, 0))
                expected[q, k] = (d + 1, o + n)
    assert got == expected


def test_rows_of_one_document_are_read_together(spark):
    lists = scan.word_lists(spark.createDataFrame([(1, "a x"), (1, "y y b"), (2, "a b")], "doc_id long, text string"))
    sets = spark.createDataFrame([("ab", ["a", "b"])], "query_id string, ws array<string>")
    words = spark.createDataFrame([("a", 2), ("b", 2)], "tok string, tf long")
    assert {tuple(r) for r in scan.matches(lists, sets, words).collect()} == {("ab", 1, 2, 1), ("ab", 2, 1, 1)}


def test_best_of_one_pass_against_loops(spark, monkeypatch):
    rng = random.Random(4)
    docs = {i: [rng.choice("a b c d e f all".split()) for _ in range(rng.randrange(0, 9))] + ["all"] for i in range(300)}
    asked = {(q, w) for q in range(7) for w in rng.sample(["a", "b", "c", "all", "zz"], 2)} | {(9, "all")}
    lists = scan.word_lists(spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()], "doc_id long, text string").repartition(3))
    df = spark.createDataFrame([(f"q{q}", w) for q, w in asked], "query_id string, tok string")
    got = {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in rank.ranked(scan.sparse_top(lists, df, 300, 5, held=4), ["query_id"], 5).collect()}
    n = {w: sum(w in d for d in docs.values()) for w in "abc"} | {"all": 300}
    want = {}
    for q in {q for q, _ in asked}:
        ws = [w for x, w in asked if x == q and w != "zz"]
        scored = [(round(sum((1 + math.log(d.count(w))) * math.log(300 / n[w]) for w in ws if w in d), 9), i) for i, d in docs.items() if any(w in d for w in ws)]
        want |= {(f"q{q}", i): round(s, 6) for s, i in sorted(scored, reverse=True)[:5]}
    assert got == want
    monkeypatch.setattr(scan, "BEST_HELD", 40)  # in this process, so that candidates are cut down again and again
    sent = SimpleNamespace(value=(df.toArrow(), pa.table({"tok": list(n), "df": list(n.values())})))
    found = [r for b in scan._sparse_batches(sent, 300, 5)(iter(lists.toArrow().to_batches())) for r in b.to_pylist()]
    assert {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in found} == want


#: Queries that evaluate the sets of all topics; none of them may write the index, or what the sets find, to disk.
LEAN = ["cnf_counts", "peeked_pieces", "static_queries", "cnf_matches", "early_stop", "static_anchor_pairs", "triple_counts", "combination_queries", "sparse_topk"]


@pytest.mark.skipif(not SMALL.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", LEAN)
def test_no_positions_or_matches_are_written(spark, monkeypatch, name):
    labels, fresh = [], shared.fresh_path
    monkeypatch.setattr(shared, "fresh_path", lambda s, label: labels.append(label) or fresh(s, label))
    monkeypatch.setattr(registry, "_INDEXES", {})
    core.queries()[name](spark, str(SMALL)).collect()
    assert labels and not {"index", "index-words", "set-documents", "topic-matches"} & set(labels)


WORDED = [("q", "key", "heat pump", "heat  pump"), ("q", "key", "heat pump", "Pump of the heat"), ("q", "key", "grid", "the grid"), ("q", "key", "grid", ""), ("q", "assoc", "", "absent pump"), ("q", "assoc", "", "heat"), ("r", "assoc", None, "pump HEAT"), ("r", "verb", "v", None)]


def test_keywords_are_worded_once_and_dropped_by_absent_words(spark):
    given = build.keywords_with_aspects(spark.createDataFrame(WORDED, "qid string, role string, aspect string, keyword string").where("role <> 'verb'"))
    worded = shared.cut(build.keyword_words(given))
    asked = shared.cut(build.asked_words(worded))
    assert {r["tok"] for r in asked.collect()} == {"heat", "pump", "grid", "absent"}
    words = shared.cut(spark.createDataFrame([("heat",), ("pump",), ("grid",)], "tok string"))
    got = {(r["qid"], r["role"], r["aspect_ix"], r["keyword"], r["piece"], tuple(r["ws"])) for r in build.word_pieces(worded, asked, words).collect()}
    both = "heat pump", ("heat", "pump")
    assert got == {("q", "key", 1, "heat pump", *both), ("q", "key", 1, "Pump of the heat", *both), ("q", "key", 0, "grid", "grid", ("grid",)), ("q", "assoc", None, "heat", "heat", ("heat",)), ("r", "assoc", None, "pump HEAT", *both)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not SMALL.exists(), reason="the test tables are not here")
def test_expansions_are_read_and_exchanged_once(spark):
    given = build.keywords_with_aspects(registry.topic_keywords(spark, str(SMALL)).where("role <> 'verb'"))
    assert _plan(given).count("FileScan") == 1 and _plan(given).count("Exchange hashpartitioning") == 1


def test_words_are_counted_before_they_meet_many_asked_ones(spark, monkeypatch):
    lists = scan.word_lists(spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string"))
    asked = shared.cut(spark.createDataFrame([("a",), ("b",), ("zz",)], "tok string"))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = scan.frequencies(lists, asked)
        assert {tuple(r) for r in found.collect()} == {("a", 2), ("b", 2)}
        plan = _plan(scan.frequencies(lists, asked))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    assert plan.index("Join") < plan.index("partial_count")  # the count is below the join
