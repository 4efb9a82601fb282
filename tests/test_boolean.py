from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import build, cnf, index, resolve, select


def best_span(positions: list[list[int]]) -> int | None:
    """The smallest distance of one position of each list, by trying all."""
    if not all(positions):
        return None
    return min(max(c) - min(c) for c in itertools.product(*positions)) if len(positions) > 1 else 0


def starts(words: list[str], phrase: list[str]) -> list[int]:
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a"), (103, "a b a b a b c"), (104, "C B A")]
    return docs, index.doc_words(spark.createDataFrame(docs, "doc_id long, text string")).cache()


QUERIES = {
    "one": [[["a"]]],
    "phrase": [[["a", "b"]]],
    "and": [[["a"]], [["b"]]],
    "or": [[["a", "b"], ["g"]], [["c"], ["d", "e"]]],
    "three": [[["a"]], [["b", "c"], ["f"]], [["g"]]],
    "same": [[["a"]], [["a"]]],
    "none": [[["zz"]], [["a"]]],
}


def test_matches_against_all_combinations(spark, corpus):
    docs, words = corpus
    alts = cnf.alternatives(spark, QUERIES)
    got = {(r["query_id"], r["doc_id"]): (r["span"], r["n_occ"]) for r in cnf.matches(words, alts).collect()}
    want = {}
    for name, query in QUERIES.items():
        for doc, t in docs:
            ws = (t or "").lower().split()
            pos = [sorted({p for alt in clause for p in starts(ws, alt)}) for clause in query]
            if (s := best_span(pos)) is not None:
                want[name, doc] = (s, min(map(len, pos)))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    single = {k for k in want if all(len({len(a) for a in c}) == 1 for c in QUERIES[k[0]])}
    assert {k: got[k] for k in single} == {k: want[k] for k in single}


def test_counts_fall_with_the_bound_and_name_empty_queries(spark, corpus):
    _, words = corpus
    alts = cnf.alternatives(spark, QUERIES)
    n = {(r["query_id"], r["within"]): r["n_docs"] for r in cnf.counts(cnf.matches(words, alts), alts, [0, 2, 5, 50]).collect()}
    assert n["none", 50] == 0
    for q in QUERIES:
        assert n[q, 0] <= n[q, 2] <= n[q, 5] <= n[q, 50] <= min(n["one", 50] if ["a"] in c else 10**9 for c in QUERIES[q])


def test_canonical():
    assert cnf.canonical([[["b"], ["a"]], [["c"]]]) == cnf.canonical([[["c"]], [["a"], ["b"], ["a"]]])


def test_pairs_are_counted_like_queries_of_their_own(spark, corpus):
    _, words = corpus
    pieces = {"p": [[["a"]], [["b"]]], "q": [[["c"]]], "r": [[["d"]], [["e"]]]}
    hits = cnf.clause_hits(words, cnf.alternatives(spark, pieces))
    groups = spark.createDataFrame([("p+q", "p", "q"), ("p+r", "p", "r"), ("q+r", "q", "r")], "query_id string, a string, b string")
    got = {(r["query_id"], r["doc_id"]): r["span"] for r in cnf.spans(cnf.combined_hits(hits, groups, ["a", "b"]), 4).collect()}
    whole = {"p+q": pieces["p"] + pieces["q"], "p+r": pieces["p"] + pieces["r"], "q+r": pieces["q"] + pieces["r"]}
    want = {(r["query_id"], r["doc_id"]): r["span"] for r in cnf.matches(words, cnf.alternatives(spark, whole)).collect()}
    assert got == want


def test_fold_and_stop(spark):
    rows = [("a", n, c) for n, c in zip("wxyvu", (30, 50, 40, 15, 10))]
    df = spark.createDataFrame(rows, "q string, n string, c long")
    assert {r["n"] for r in select.fold_budget(df, "q", ["c", "n"], "n", "c", 100).collect()} == {"u", "v", "w", "y"}
    assert {r["n"] for r in select.fold_budget(df, "q", ["n"], "n", "c", 60, stop=True).collect()} == {"u", "v", "w"}
    assert {r["n"] for r in select.early_stop(df, "q", ["n"], "c", 55).collect()} == {"u", "v", "w"}
    assert select.fold_budget(df.limit(0), "q", ["n"], "n", "c", 60).count() == 0


def choose(pieces, pairs, budget, key_most, assoc_most, most_assoc=50_000):
    """The four phases of the selection for one topic, as a loop."""
    grabbed = [p for p in pieces if 0 < p[3] <= (key_most if p[1] == "key" else assoc_most)]
    rest = [p for p in pieces if p not in grabbed and p[3] > 0]
    out = {p[0]: 1 for p in grabbed}
    total = sum(p[3] for p in grabbed)
    by = {p[0]: p for p in rest}
    first = min((p[2] for p in rest if p[1] == "key"), default=None)
    combos = []
    for a, b, n in pairs:
        if a in by and b in by and 0 < n <= key_most:
            if by[b][1] == "key" or (by[a][2] == first and by[b][3] <= most_assoc):
                combos.append((f"{a} + {b}", by[b][1] == "key", n))
    if sum(n for *_, n in combos) <= budget - total:
        out |= {name: 2 for name, *_ in combos}
        total += sum(n for *_, n in combos)
    else:
        cheap = [c for c in combos if not c[1] and c[2] <= assoc_most / 2]
        out |= {c[0]: 3 for c in cheap}
        total += sum(c[2] for c in cheap)
        for c in sorted((c for c in combos if c not in cheap), key=lambda c: (not c[1], c[2], c[0])):
            if total + c[2] <= budget:
                out[c[0]] = 3
                total += c[2]
    for p in sorted(rest, key=lambda p: (p[3], p[0])):
        if total + p[3] <= budget:
            out[p[0]] = 4
            total += p[3]
    return out


def test_peek_and_grab_against_a_loop(spark):
    rng = random.Random(5)
    all_pieces, all_pairs, want = [], [], {}
    for t in range(25):
        q = f"q{t}"
        ps = [(f"k{i}", "key", i % 3, rng.randrange(0, 400)) for i in range(7)] + [(f"s{i}", "assoc", None, rng.randrange(0, 300)) for i in range(5)]
        prs = [(a[0], b[0], rng.randrange(0, 160)) for a in ps for b in ps if a[1] == "key" and ((b[1] == "key" and a[2] < b[2]) or b[1] == "assoc")]
        budget = rng.choice([0, 200, 800, 3000, 10**6])
        want |= {(q, budget, n): ph for n, ph in choose(ps, prs, budget, 120, 60).items()}
        all_pieces += [(q, budget, *p) for p in ps]
        role = {p[0]: p[1] for p in ps}
        all_pairs += [(q, f"{a} + {b}", "key-key" if role[b] == "key" else "key-assoc", a, b, n) for a, b, n in prs]
    pieces = spark.createDataFrame(all_pieces, "qid string, budget long, piece string, role string, aspect_ix int, n_docs long")
    pairs = spark.createDataFrame(all_pairs, "qid string, query_id string, kind string, a string, b string, n_docs long")
    got = {}
    for b in {x[1] for x in all_pieces}:
        peeked = select.grabbed_alone(pieces.where(F.col("budget") == b).drop("budget"), 120, 60)
        mine = select.combos_of_rest(peeked, pairs.join(peeked.select("qid").distinct(), "qid", "left_semi"), 120)
        got |= {(r["qid"], b, r["query_id"]): r["phase"] for r in select.peek_and_grab(peeked, mine, b, 60).collect()}
    assert got == want


def test_pieces_need_all_words(spark, corpus):
    _, words = corpus
    kw = spark.createDataFrame([("q", "key", "a b", "a b"), ("q", "key", "a b", "zz a"), ("q", "assoc", "", "bb")], "qid string, role string, aspect string, keyword string")
    none, _ = build.pieces(build.keywords_with_aspects(kw), index.term_frequencies_only(words), F.lower("w"))
    assert none.count() == 0  # one-letter words have no content
    long = spark.createDataFrame([(1, "heat pump on"), (2, "Heat only")], "doc_id long, text string")
    kw = spark.createDataFrame([("q", "key", "heat", "heat pump"), ("q", "key", "heat", "heat zz")], "qid string, role string, aspect string, keyword string")
    kept, alts = build.pieces(build.keywords_with_aspects(kw), index.term_frequencies_only(index.doc_words(long)), F.lower("w"))
    assert {r["keyword"] for r in kept.collect()} == {"heat pump", "heat"}
    assert alts.count() == 3


def test_clusters(spark):
    names = ["civilized", "civilization", "civil", "community", "communities", "cat"]
    df = spark.createDataFrame([("q", i, t, 1.0 - i / 10) for i, t in enumerate(names)], "qid string, ord int, token string, score double")
    got: dict[int, set] = {}
    for r in build.cluster_tokens(df).collect():
        got.setdefault(r["cluster"], set()).add(r["token"])
    assert sorted(map(sorted, got.values())) == [["cat"], ["civil", "civilization", "civilized"], ["communities", "community"]]


def test_units_are_not_joined_later(spark):
    df = spark.createDataFrame([("q", 0, 1, 2), ("q", 1, 3, 4), ("q", 2, 2, 3)], "qid string, ord int, a long, b long")
    got: dict[int, set] = {}
    for r in build.link_units(df).collect():
        got.setdefault(r["unit"], set()).add(r["cluster"])
    assert list(map(sorted, (got[0], got[1]))) == [[1, 2, 3], [3, 4]]


def test_adaptive(spark):
    anchors = spark.createDataFrame([("q", 1, 1.0, 5), ("q", 2, 2.0, 500), ("q", 3, 3.0, 600)], "qid string, cluster long, score double, n_docs long")
    info = spark.createDataFrame([("q", 9, 0.5)], "qid string, cluster long, score double")
    links = spark.createDataFrame([("q", 0, 2, 3)], "qid string, ord int, a long, b long")
    counts = spark.createDataFrame([("q", 2, 3, 300), ("q", 1, 2, 4), ("q", 2, 9, 50), ("q", 3, 9, 60), ("q", 1, 3, 3)], "qid string, a long, b long, n_docs long")
    kinds = {(r["a"], r["b"]): r["kind"] for r in build.adaptive_queries(anchors, counts, links, info, 100, 200).collect()}
    assert kinds == {(1, None): "direct", (2, 9): "informative", (3, 9): "informative", (1, 2): "cross", (1, 3): "cross"}
    kinds = {(r["a"], r["b"]): r["kind"] for r in build.adaptive_queries(anchors, counts, links, info, 100, 300).collect()}
    assert kinds == {(1, None): "direct", (2, 3): "linked", (1, 2): "cross", (1, 3): "cross"}


def test_extensions_and_pointers(spark):
    words = index.doc_words(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"))
    hits = cnf.phrase_hits(words, spark.createDataFrame([("c",)], "phrase string")).withColumnRenamed("phrase", "query_id")
    r = index.extensions(hits, words, 3).first()
    assert (r["ext"], r["truncated"]) == (["c", "d", "<pad>"], True)
    offsets = spark.createDataFrame([(10, "x"), (20, "y"), (3_000_000, "z")], "off long, d string")
    ptrs = spark.createDataFrame([(5,), (10,), (19,), (20,), (2_999_999,), (9_000_000,)], "p long")
    got = {r["p"]: r["d"] for r in index.containing_document(ptrs, "p", offsets, "off", "d").collect()}
    assert got == {5: "x", 10: "x", 19: "x", 20: "y", 2_999_999: "y", 9_000_000: "z"}


def test_codes_come_back(spark):
    docs = index.doc_words(spark.createDataFrame([(1, "b a b"), (2, "a c")], "doc_id long, text string"))
    ids = index.with_token_ids(index.vocabulary(docs))
    assert {r["tok"]: r["tok_id"] for r in ids.collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r["doc_id"]: r["text"] for r in index.decode(index.encode(docs, ids), ids).collect()} == {1: "b a b", 2: "a c"}


def test_merging(spark):
    df = spark.createDataFrame([(1, "q1", "d", "t1", False), (2, "q2", "d", "t2", None), (3, "q3", "e", "t", True)], "seq int, query string, doc_id string, text string, blocked boolean")
    assert [tuple(r) for r in resolve.merged_answers(df).collect()] == [("d", "t1", ["q1", "q2"])]
    df = spark.createDataFrame([("d", 2, "later", [3]), ("d", 1, "first", [1, 3])], "doc_id string, n int, text string, qs array<int>")
    assert [tuple(r) for r in resolve.once(df, ["doc_id"], "n", "qs").select("doc_id", "text", "qs").collect()] == [("d", "first", [1, 3])]


def test_word_sets_against_loops(spark, tmp_path):
    """Sets of one to five words, in short texts and in one where the places can't be tried in a row."""
    from itertools import product

    rng = random.Random(12)
    docs = {i: [rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(0, 25))] for i in range(40)}
    docs[99] = ["a", "x", "b"] * 300 + ["c"]
    at = index.build_index(spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()], "doc_id long, text string"), f"file://{tmp_path}/ix", 4)
    sets = {"a": ["a"], "ab": ["a", "b"], "abc": ["a", "b", "c"], "abcd": ["a", "b", "c", "d"], "bcdef": list("bcdef"), "zz": ["a", "zz"]}
    got = {(r["query_id"], r["doc_id"]): (r["span"], r["n_occ"]) for r in cnf.set_matches(at, cnf.word_sets(spark.createDataFrame(list(sets.items()), "q string, ws array<string>"), "q", "ws")).collect()}
    want = {}
    for q, ws in sets.items():
        for i, d in docs.items():
            places = [[k for k, w in enumerate(d) if w == x] for x in ws]
            if all(places):
                span = min((max(p) - min(p) for p in product(*places)), default=0) if i != 99 else {"a": 0, "ab": 1, "abc": 3}[q]
                want[q, i] = (span, min(map(len, places)))
    assert got == want


def test_budget_of_a_stream(spark):
    rng = random.Random(5)
    rows = [(f"q{rng.randrange(6)}", f"n{i:04}", rng.choice([None, 0, 1, 5, 20, 80])) for i in range(400)]
    df = spark.createDataFrame(rows, "q string, n string, c long").withColumn("__count", F.lit("clash"))
    for stop, most in ((False, None), (True, None), (False, 7)):
        want = set()
        for q in {r[0] for r in rows}:
            used, over, k = 0, False, 0
            for c, n in sorted((c, n) for x, n, c in rows if x == q and c is not None):
                fits = used + c <= 100 and not (stop and over) and (most is None or k < most)
                over = over or not fits
                if fits:
                    used, k = used + c, k + 1
                    want.add(n)
        assert {r["n"] for r in select.fold_budget(df.drop("__count"), "q", ["c"], "n", "c", 100, stop, most).collect()} == want
