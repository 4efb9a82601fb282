from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import analyze, evaluate, index, lm, rank, resolve


def okapi(pool, query, k1=1.5, b=0.75, eps=0.25):
    n, avg = len(pool), sum(map(len, pool.values())) / len(pool)
    df: dict[str, int] = {}
    for ws in pool.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: eps * mean if v < 0 else v for w, v in idf.items()}
    return {d: sum(idf.get(q, 0) * ws.count(q) * (k1 + 1) / (ws.count(q) + k1 * (1 - b + b * len(ws) / avg)) for q in query) for d, ws in pool.items()}


def test_bm25_against_the_formula(spark):
    rng = random.Random(2)
    docs = {i: [rng.choice("a b c d e f".split()) for _ in range(rng.randrange(0, 12))] for i in range(30)}
    pools = {"q1": list(range(20)), "q2": list(range(10, 30))}
    queries = {"q1": ["a", "b", "b", "zz"], "q2": ["c"]}
    words = spark.createDataFrame([(i, w) for i, w in docs.items()], "doc_id long, ws array<string>")
    pooled = spark.createDataFrame([(q, d) for q, ds in pools.items() for d in ds], "qid string, doc_id long")
    asked = spark.createDataFrame([(q, w, ws.count(w)) for q, ws in queries.items() for w in set(ws)], "qid string, tok string, qtf long")
    got = {(r["qid"], r["doc_id"]): r["score"] for r in rank.bm25(pooled, words, asked).collect()}
    want = {(q, d): s for q, ds in pools.items() for d, s in okapi({d: docs[d] for d in ds}, queries[q]).items()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("part", [1000, 3])
def test_bm25_by_the_index_against_the_formula(spark, tmp_path, part):
    """Also where a pool is dealt out over several tasks."""
    rng = random.Random(3)
    docs = {i: [rng.choice("a b c d e f".split()) for _ in range(rng.randrange(0, 12))] for i in range(30)}
    pools = {"q1": list(range(20)), "q2": list(range(10, 30))}
    queries = {"q1": ["a", "b", "b", "zz"], "q2": ["c"]}
    at = index.build_index(spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()], "doc_id long, text string"), f"file://{tmp_path}/ix", 3)
    pooled = spark.createDataFrame([(q, d) for q, ds in pools.items() for d in ds], "qid string, doc_id long")
    asked = spark.createDataFrame([(q, x, w, ws.count(w)) for q, ws in queries.items() for w in set(ws) for x in "xy"], "qid string, s string, tok string, qtf long")
    size = pooled.groupBy("qid").agg(F.count("*").alias("n"))
    means = {r["qid"]: r["mean"] for r in rank.pool_idf_means(at, pooled, size, part).collect()}
    for q, ds in pools.items():
        df = [sum(w in docs[d] for d in ds) for w in "abcdef"]
        assert means[q] == pytest.approx(sum(math.log(len(ds) - f + 0.5) - math.log(f + 0.5) for f in df) / 6)
    want = {(q, d): v for q, ds in pools.items() for d, v in okapi({d: docs[d] for d in ds}, queries[q]).items()}
    got = {(r["qid"], r["doc_id"], r["s"]): r["score"] for r in rank.bm25_at(at, pooled, asked, ("s",), ("x", "y")).collect()}
    assert got == pytest.approx({(*k, x): v for k, v in want.items() for x in "xy"})


@pytest.mark.parametrize("block", [100, 3])
def test_dense_top_against_all_pairs(spark, block):
    rng = random.Random(6)
    vec = lambda: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]
    items = [(i, vec()) for i in range(60)] + [(100, None), (101, [0.0] * 4), (102, [1.0]), (103, [1.0, None, 0.0, 0.0])]
    asked = [(i, vec()) for i in range(7)] + [(8, [0.0] * 4), (9, None)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    sound = lambda rows: [(i, v) for i, v in rows if v and len(v) == 4 and None not in v and any(v)]
    want = {q: [i for _, i in sorted(((round(cos(v, x), 9), i) for i, x in sound(items)), reverse=True)[:5]] for q, v in sound(asked)}
    q, x = (spark.createDataFrame(rows, f"{n} long, embedding array<double>") for n, rows in (("query_id", asked), ("vec_id", items)))
    got: dict = {}
    for r in sorted(rank.dense_top(q, x.repartition(3), 5, block=block).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((round(r["score"], 6), r["vec_id"]))
    assert {k: [round(cos(dict(asked)[k], dict(items)[i]), 6) for _, i in v] for k, v in got.items()} == {k: [round(cos(dict(asked)[k], dict(items)[i]), 6) for i in v] for k, v in want.items()}


def test_keyword_occurrences_against_count(spark):
    docs = [(1, "Aaaa aa heat HEAT pump"), (2, None), (3, ""), (4, "heat pumpheat pump"), (5, "ab" * 3000)]
    words = ["aa", "heat pump", "heat", "p", "ab", "zz", ""]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for held in (100, 2):
        got = {(r["doc_id"], r["keyword"]): r["n"] for r in rank.keyword_occurrences(df, spark.createDataFrame([(w,) for w in words], "keyword string"), held).collect()}
        assert got == {(i, w): t.lower().count(w) for i, t in docs if t for w in words if w and w in t.lower()}
    none = spark.createDataFrame([], "keyword string")
    assert rank.keyword_occurrences(df, none).count() == 0


def judged(rels, order):
    """recall@3, p@3, ndcg@3, mrr and map of a ranked list."""
    good = {d for d, r in rels.items() if r and r > 0}
    gain = lambda d: max(rels.get(d) or 0, 0)
    dcg = sum(gain(d) / math.log2(i + 1) for i, d in enumerate(order[:3], 1))
    ideal = sum(g / math.log2(i + 1) for i, g in enumerate(sorted(map(gain, rels), reverse=True)[:3], 1))
    hits = [i for i, d in enumerate(order, 1) if d in good]
    ap = sum((k / i) for k, i in enumerate(hits, 1)) / len(good) if good else 0
    found = sum(d in good for d in order[:3])
    return (found / len(good) if good else 0, found / 3, dcg / ideal if ideal else 0, 1 / hits[0] if hits else 0, ap)


def test_metrics_by_hand(spark):
    rels = {"q": {"a": 2, "b": 0, "c": 1, "d": 1, "x": -1}, "none": {"a": 0}}
    run = {"q": [("x", 9.0), ("a", 5.0), ("b", 5.0), ("c", 1.0), ("e", 0.5)], "none": [("a", 1.0)], "unjudged": [("a", 1.0)]}
    runs = spark.createDataFrame([(q, d, s) for q, ds in run.items() for d, s in ds] + [("q", "a", 0.1), ("q", "n", None)], "qid string, doc_id string, score double")
    qrels = spark.createDataFrame([(q, d, r) for q, ds in rels.items() for d, r in ds.items()], "qid string, doc_id string, rel int")
    out = {r["qid"]: r for r in evaluate.metrics(evaluate.positions_in_run(runs, ["qid"]), qrels, (3,)).collect()}
    assert set(out) == {"q", "none"}
    order = ["x", "b", "a", "c", "e"]  # ties by document, descending
    r = out["q"]
    assert (r["recall_3"], r["p_3"], r["ndcg_3"], r["mrr"], r["map"]) == pytest.approx(judged(rels["q"], order))
    assert out["none"]["recall_3"] == out["none"]["map"] == 0
    alt = {r["qid"]: r["precision"] for r in evaluate.precision_of_returned(evaluate.positions_in_run(runs, ["qid"]), qrels, 10).collect()}
    assert alt["q"] == pytest.approx(2 / 5)


def test_summary_and_head_to_head(spark):
    rows = [(f"q{i:02}", "a", i / 20, 0.5) for i in range(20)] + [(f"q{i:02}", "b", 0.5, 0.5) for i in range(20)]
    df = spark.createDataFrame(rows, "qid string, mode string, recall double, precision double")
    out = {r["mode"]: r for r in evaluate.recall_summary(df, ["mode"]).collect()}
    assert out["a"]["cvar"] == pytest.approx((0 + 1 / 20) / 2)
    h = evaluate.head_to_head(df, "mode", "recall").first()
    assert (h["wins"], h["losses"], h["ties"]) == (9, 10, 1)


def test_aspects(spark):
    texts = spark.createDataFrame([("q", 1, "Heat pump, heat pump and grid", 5), ("q", 2, "", 5), ("q", 3, None, 5), ("q", 4, "none of them", None), ("q", 5, "nothing", 3)], "qid string, doc_id long, text string, least long")
    kw = spark.createDataFrame([("q", "key", "heat", "heat pump"), ("q", "key", "grid", "Grid"), ("q", "key", "more", "grid"), ("q", "key", "heat", "pump"), ("q", "assoc", "", "pump"), ("q", "verb", "v", "AND")], "qid string, role string, aspect string, keyword string")
    got = {r["doc_id"]: r["score"] for r in rank.scored_by_aspects(texts.select("qid", "doc_id", "least"), kw, texts.select("doc_id", "text")).collect()}
    assert got == pytest.approx({1: 90 + (1 + math.log(2)) + 1 + 0.5 * (1 + math.log(2)) + 0.3 + 1 / math.log(7), 2: 0.0, 3: 0.0, 4: 0.0, 5: 1 / math.log(5)})


def greedy(sets, cost=None):
    covered, out, sets = set(), [], dict(sets)
    while sets:
        q = max(sorted(sets), key=lambda q: len(sets[q] - covered) / (max(1, cost[q]) if cost else 1))
        new = sets.pop(q) - covered
        if not new:
            break
        covered |= new
        out.append((q, len(new)))
    return out


def test_covers_against_a_loop(spark):
    rng = random.Random(4)
    rows, want, by_cost = [], {}, {}
    for t in range(8):
        sets = {i: {rng.randrange(30) for _ in range(rng.randrange(1, 10))} for i in range(12)}
        cost = {i: rng.choice([0, 1, 5, 40]) for i in sets}
        want[f"q{t}"], by_cost[f"q{t}"] = greedy(sets), greedy(sets, cost)
        rows += [(f"q{t}", i, d, cost[i]) for i, ds in sets.items() for d in ds]
    df = spark.createDataFrame([*rows, rows[0]], "qid string, query_ix long, doc_id long, engine long")
    for flag, expected in ((False, want), (True, by_cost)):
        got: dict = {}
        for r in sorted(analyze.greedy_cover(df, flag).collect(), key=lambda r: (r["qid"], r["step"])):
            got.setdefault(r["qid"], []).append((r["query_ix"], r["new_docs"]))
        assert got == expected


def test_cost_at_recall(spark):
    curve = spark.createDataFrame([("q", 1, 1, 4, 4, 10), ("q", 2, 2, 4, 8, 50)], "qid string, step int, query_ix long, new_docs long, covered long, engine_total long")
    out = {r["target"]: r["engine_total"] for r in analyze.cost_at_recall(curve, spark.createDataFrame([("q", 10)], "qid string, n_docs long"), (0.4, 0.8, 0.95)).collect()}
    assert out == {0.4: 10, 0.8: 50, 0.95: 50}


def test_crude_scores(spark):
    words = spark.createDataFrame([(1, ["b", "x", "a"]), (2, ["c"])], "doc_id long, ws array<string>")
    terms = spark.createDataFrame([("q", "a b"), ("q", "c"), ("q", "zz")], "qid string, term string")
    pooled = spark.createDataFrame([("q", 1), ("q", 2), ("q", 3)], "qid string, doc_id long")
    weights = spark.createDataFrame([("q", "a b", 10, 5.0), ("q", "c", None, 0.25)], "qid string, term string, n_docs long, sparse double")
    got = {r["doc_id"]: r["score"] for r in resolve.crude_scores(pooled, resolve.term_hits(words, terms), weights).collect()}
    assert got == pytest.approx({1: 1 / math.log(12), 2: 0.25, 3: 0.0})


def test_next_words(spark):
    docs = index.doc_words(spark.createDataFrame([(1, "a b a c"), (2, "a b"), (3, None), (4, "c a b d")], "doc_id long, text string"))
    bi = lm.next_words(docs)
    got = {(r["tok"], r["nxt"]): (r["n"], r["p"]) for r in bi.collect()}
    assert got["a", "b"] == (3, 0.75) and got["c", "a"] == (1, 1.0)
    total: dict = {}
    for (t, _), (_, p) in got.items():
        total[t] = total.get(t, 0) + p
    assert list(total.values()) == pytest.approx([1.0] * len(total))
    prompts = spark.createDataFrame([("zz a b",), ("d",), ("c a b",)], "prompt string")
    back = {(r["prompt"], r["used"], r["nxt"]): r["p"] for r in lm.backed_off(docs, prompts).collect()}
    assert back == {("zz a b", 2, "a"): 0.5, ("zz a b", 2, "d"): 0.5, ("c a b", 3, "d"): 1.0}


def beam(bi, start, width, steps, size, depth):
    seqs = [((start,), 0.0)]
    for level in range(1, depth + 1):
        grown = []
        for s, lp in seqs:
            for nxt, p in sorted(bi.get(s[-1], {}).items(), key=lambda x: (-x[1], x[0]))[:width]:
                grown.append(((*s, nxt), lp + math.log(p)))
        seqs = grown
        if level % steps == 0 or level == depth:
            seqs = sorted(seqs, key=lambda x: (-x[1], " ".join(x[0])))[:size]
    return seqs


def test_beam_against_a_loop(spark):
    rng = random.Random(9)
    docs = index.doc_words(spark.createDataFrame([(i, " ".join(rng.choice("abcdefg") for _ in range(30))) for i in range(20)], "doc_id long, text string"))
    bi = lm.next_words(docs)
    table: dict = {}
    for r in bi.collect():
        table.setdefault(r["tok"], {})[r["nxt"]] = r["p"]
    got, made = lm.beam_search(spark, bi, ["a"], 3, 2, 4, 3)
    want = beam(table, "a", 3, 2, 4, 3)
    assert sorted((" ".join(r["ids"]), round(r["logprob"], 9)) for r in got.collect()) == sorted((" ".join(s), round(lp, 9)) for s, lp in want)
    assert made == 3 + 9 + 12
    tree = lm.expansion_tree(bi, "a", 2, 2).collect()
    assert len(tree) == 1 + 2 + 4
    leaf = {r["text"] for r in lm.leaves(lm.expansion_tree(bi, "a", 2, 2)).collect()}
    assert len(leaf) == 4 and all(t.startswith("a ") for t in leaf)


def test_cross_distance(spark):
    hits = spark.createDataFrame([("p", 1, 0), ("p", 1, 20), ("r", 1, 7), ("r", 1, 18), ("s", 1, 19)], "query_id string, doc_id long, pos int")
    pieces = spark.createDataFrame([("q", "p", "key", "A"), ("q", "r", "key", "B"), ("q", "s", "key", "C")], "qid string, piece string, role string, aspect string")
    got = {(r["a"], r["b"]): r["distance"] for r in analyze.cross_distance(hits, pieces).collect()}
    assert got == {("A", "B"): 2, ("A", "C"): 1, ("B", "C"): 1}


def test_vectors(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "query_id string, embedding array<double>")
    v = spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"]) for r in rank.dense_top(q, v, 2).where("query_id = 'q'").orderBy("rank").collect()]
    assert got == [("q", 2), ("q", 1)]
    enc = rank.encoded(spark.createDataFrame([(1, "a b"), (2, None)], "i int, t string"), "t", rank.hashed_encoder).select("i", F.size("embedding").alias("n")).collect()
    assert {r["n"] for r in enc} == {64}
    s = rank.pair_scored(spark.createDataFrame([("a b", "b c"), ("", None)], "q string, t string"), "q", "t", rank.overlap_scorer).collect()
    assert sorted(r["score"] for r in s) == [0.0, 0.5]


def test_numbers_over_partitions(spark):
    from lexmill.plans import ordered

    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(6)
    got = {r["i"]: r["n"] for r in ordered.numbered(df, [F.desc("i")], "n").collect()}
    assert got == {i: 2999 - i for i in range(3000)}
    want, seen = {}, {}
    for k, i, _ in sorted(rows):
        seen[k] = want[i] = seen.get(k, 0) + 1
    assert {r["i"]: r["n"] for r in ordered.numbered_within(df, ["k"], ["i"], "n").collect()} == want
    total, sums = 0, {}
    for _, i, v in sorted(rows, key=lambda r: r[1]):
        sums[i], total = total, total + v
    assert {r["i"]: r["s"] for r in ordered.running_total(df, ["i"], "v", "s").collect()} == sums
    assert ordered.numbered_within(df.limit(0), ["k"], ["i"], "n").count() == 0


def test_tightest_queries_against_all_combinations(spark):
    """Each document's combinations, their spans and counts, and the candidates of covers, against loops over all texts."""
    from itertools import combinations, product

    from lexmill.operators import build, cnf

    rng = random.Random(5)
    words = {"q1": {"x": ["xa", "xb"], "y": ["ya yb", "xa"], "z": ["za"]}, "q2": {"x": ["xa", "xb"], "y": ["yb"]}}
    assoc = {"q1": ["s", "t u"], "q2": ["s"]}
    filler = ["o", "p", "r"]
    pool = ["xa", "xb", "ya", "yb", "za", "s", "t", "u", "x", "y", "z", *filler * 5]
    texts = [[rng.choice(pool) for _ in range(rng.randint(1, 25))] for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, ws array<string>")
    rows = [(q, "key", a, k, i) for q in words for i, a in enumerate(words[q]) for k in [a, *words[q][a]]] + [(q, "assoc", "", k, None) for q in assoc for k in assoc[q]]
    pieces = spark.createDataFrame([(q, f"{q}: {k}", r, a, ix, k) for q, r, a, k, ix in rows], "qid string, piece string, role string, aspect string, aspect_ix int, keyword string")
    alts = cnf.alternatives(spark, {f"{q}: {k}": [[[w]] for w in k.split()] for q, _, _, k, _ in rows})
    hits = cnf.clause_hits(docs, alts)
    t = analyze.keyword_table(cnf.spans(hits, 2), pieces).distinct()
    tight = analyze.tightest_combinations(t).cache()
    queries = analyze.cover_queries(pieces, tight).cache()
    spans = cnf.group_spans(hits, queries.select("qid", "query_id", "members")).cache()

    def span(members, ws):
        clauses = [w for m in members for w in m.split(": ")[1].split()]
        at = [[i for i, x in enumerate(ws) if x == w] for w in clauses]
        return min((max(c) - min(c) for c in product(*at)), default=None)

    def named(members):
        return " + ".join(sorted(set(members)))

    want, want_spans = set(), {}
    for q in words:
        for d, ws in enumerate(texts):
            has = {a: sorted({f"{q}: {k}" for k in [a, *words[q][a]] if set(k.split()) <= set(ws)}) for a in words[q]}
            ways = [v for v in has.values() if v]
            more = [f"{q}: {k}" for k in assoc[q] if set(k.split()) <= set(ws)]
            for c in product(*ways, *([more] if more else [])) if ways else ():
                want.add((q, d, named(c), len(c)))
    assert {tuple(r) for r in tight.select("qid", "doc_id", "query_id", "score").collect()} == want

    made = {(r.qid, r.query_id): (r.members, r.type) for r in queries.collect()}
    cands = set()
    for q in words:
        every = {a: [f"{q}: {k}" for k in [a, *words[q][a]]] for a in words[q]}
        keys, more = [k for v in every.values() for k in v], [f"{q}: {k}" for k in assoc[q]]
        cands |= {(q, named(m)) for m in [[k] for k in keys + more] + [[k, m] for k in keys for m in more] + [[f"{q}: {a}" for a in words[q]]]}
        cands |= {(q, named([x, y])) for a, b in combinations(every, 2) for x in every[a] for y in every[b]}
    assert set(made) == cands | {(q, n) for q, _, n, _ in want}
    assert {k for k, (_, type_) in made.items() if type_ != "tightest"} == cands
    for (q, n), (members, _) in made.items():
        for d, ws in enumerate(texts):
            if (s := span(members, ws)) is not None:
                want_spans[q, n, d] = s
    assert {(r.qid, r.query_id, r.doc_id): r.span for r in spans.collect()} == want_spans

    counted = {(r.qid, r.query_id): (r.docs, r.engine) for r in analyze.tightest_counts(tight, spans, 5).collect()}
    near = {(q, n): sum(1 for (q2, n2, _), s in want_spans.items() if (q2, n2) == (q, n) and s <= 5) for q, n in made}
    assert counted == {(q, n): (sum(1 for x in want if (x[0], x[2]) == (q, n)), near[q, n]) for q, n in {(x[0], x[2]) for x in want}}
    relevant = t.where("role = 'key'").groupBy("qid", "doc_id").agg(F.count_distinct("aspect").alias("a")).where("a >= 2").select("qid", "doc_id").cache()
    covering = analyze.cover_candidates(queries, spans, tight, relevant, 5).join(queries, ["qid", "query_ix"])
    good = {tuple(r) for r in relevant.collect()}
    assert {(r.qid, r.query_id, r.doc_id, r.engine) for r in covering.collect()} == {(q, n, d, near[q, n]) for q, n, d in {k for k, s in want_spans.items() if s <= 5 and k[:2] in cands} | {(q, n, d) for q, d, n, _ in want} if (q, d) in good}


def test_word_vectors_are_whole_and_tell_contexts_apart(spark):
    """200 dimensions for every frequent word; words of one context are nearer than words of two."""
    from lexmill.operators import vectors

    rng = random.Random(9)
    groups = [[f"{g}{i}" for i in range(6)] for g in "ab"]
    docs = spark.createDataFrame([([rng.choice(groups[i % 2]) for _ in range(30)] + ["rare"] * (i == 0),) for i in range(400)], "ws array<string>")
    v = {r["word"]: r["vector"] for r in vectors.vectors_of(vectors.word_vectors(docs)).collect()}
    assert set(v) == {w for g in groups for w in g} and {len(x) for x in v.values()} == {200}

    def cos(a, b):
        return sum(x * y for x, y in zip(v[a], v[b])) / math.sqrt(sum(x * x for x in v[a]) * sum(y * y for y in v[b]))

    assert min(cos("a0", w) for w in groups[0][1:]) > max(cos("a0", w) for w in groups[1])


def test_word2vec_has_each_word_with_its_vector(spark):
    from tests.compare import DATA

    if not (DATA / "sf0.001").exists():
        pytest.skip("the test tables are not here")
    from lexmill import queries as core

    got = core.queries()["word2vec"](spark, str(DATA / "sf0.001"))
    assert got.columns == ["word", "vector"] and got.where(F.size("vector") == 200).count() == got.count() > 0


def test_next_word_change_writes_no_bigrams_and_counts_only_its_words(spark, monkeypatch, tmp_path):
    """The rows are those over all bigrams, which aren't written, and the filter on the word is below the first exchange."""
    from lexmill.operators import lm
    from lexmill.plans import analysis_queries, shared

    rng = random.Random(3)
    texts = [" ".join(rng.choice("the heat meter pump price a b".split()) for _ in range(20)) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    v = spark.createDataFrame([(w, [rng.random() for _ in range(4)]) for w in "the heat meter pump price a".split()], "tok string, embedding array<double>")
    monkeypatch.setattr(analysis_queries, "_word_vectors", lambda spark, d: v)
    labels, fresh = [], shared.fresh_path
    monkeypatch.setattr(shared, "fresh_path", lambda s, label: labels.append(label) or fresh(s, label))
    df = analysis_queries.next_word_change(spark, str(tmp_path))
    assert "bigrams" not in labels
    got = {r["nxt"]: (r["p"], round(r["change"], 9)) for r in df.collect()}
    want = lm.next_word_change(lm.next_words(analysis_queries._docs(spark, str(tmp_path))).cache(), "the heat", v, "meter", 10)
    assert got == {r["nxt"]: (r["p"], round(r["change"], 9)) for r in want.collect()} and set(got) == set("the heat meter pump price a".split())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lowest = plan[: plan.index("Generate")].rsplit("Aggregate [", 1)[1]
    assert "= heat)" in lowest
