"""Queries of coverage analysis, the language model, vectors and the streamed vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import numbers
from lexmill.operators import analyze, cnf, evaluate, lm, vectors
from lexmill.plans.boolean_queries import _PAIRS, _SP, _docs, _piece_hits, _piece_spans
from lexmill.plans.ranking_queries import _OUTCOME, _RUNS, _rounded, stage_runs
from lexmill.plans.registry import SQL_PIECES, SQL_WORDS, index_for, lower_pieces, query, sql_sets, table
from lexmill.plans.shared import cut, fresh_path
from lexmill.streaming.ingest import streamed_vocabulary

_TABLE = f"""{_SP}, kt AS (SELECT DISTINCT k.qid, s.doc_id, k.role, k.aspect, k.piece, span FROM sp s JOIN (SELECT DISTINCT qid, role, aspect, piece FROM pc) k USING (piece)),
    dq AS (SELECT DISTINCT k.qid, d.doc_id FROM documents d CROSS JOIN (SELECT DISTINCT qid FROM pc) k),
    cv AS (SELECT dq.qid, dq.doc_id, count(DISTINCT CASE WHEN role = 'key' THEN aspect END) n_aspects, count(DISTINCT CASE WHEN role = 'key' THEN piece END) n_keys, count(DISTINCT CASE WHEN role = 'assoc' THEN piece END) n_assoc FROM dq LEFT JOIN kt USING (qid, doc_id) GROUP BY ALL)"""


def _table(spark, d):
    p, _, m, docs = _piece_spans(spark, d)
    return cut(analyze.keyword_table(m, p).distinct(), "keyword-table"), p, m, docs


def _covered(spark, d):
    """What is matched of each topic, its pieces, and how many documents there are for it."""
    t, p, _, docs = _table(spark, d)
    return analyze.coverage(t), p, p.select("qid").distinct().withColumn("all", F.lit(docs.count()))


@query(f"WITH {SQL_WORDS}, {SQL_PIECES}, {_TABLE} SELECT qid, n_aspects, count(*) docs, round(count(*) / sum(count(*)) OVER (PARTITION BY qid)::DOUBLE, 9) share FROM cv GROUP BY qid, n_aspects")
def coverage_hist(spark, d):
    covered, _, totals = _covered(spark, d)
    return analyze.coverage_histogram(covered, totals).withColumn("share", F.round("share", 9))


@query(f"WITH {SQL_WORDS}, {SQL_PIECES}, {_TABLE} SELECT qid, role, aspect, piece, count(DISTINCT doc_id) docs FROM kt GROUP BY ALL")
def keyword_coverage(spark, d):
    return analyze.group_coverage(_table(spark, d)[0], ["role", "aspect", "piece"])


@query(f"WITH {SQL_WORDS}, {SQL_PIECES}, {_TABLE}, a AS (SELECT DISTINCT qid, doc_id, aspect FROM kt WHERE role = 'key') SELECT x.qid, x.aspect a, y.aspect b, count(*) docs FROM a x JOIN a y ON x.qid = y.qid AND x.doc_id = y.doc_id AND x.aspect < y.aspect GROUP BY ALL")
def aspect_pairs(spark, d):
    return analyze.aspect_pairs(_table(spark, d)[0])


@query(f"WITH {SQL_WORDS}, {SQL_PIECES}, p AS (SELECT DISTINCT qid, aspect, piece FROM pc WHERE role = 'key'), h AS (SELECT DISTINCT p.qid, doc_id, aspect, pos FROM p JOIN ph USING (piece)) SELECT x.qid, x.doc_id, x.aspect a, y.aspect b, min(abs(x.pos - y.pos)) distance FROM h x JOIN h y ON x.qid = y.qid AND x.doc_id = y.doc_id AND x.aspect < y.aspect GROUP BY ALL")
def cross_distance(spark, d):
    p, _, hits, _ = _piece_hits(spark, d)
    return analyze.cross_distance(hits, p)


@query(f"""WITH {SQL_WORDS}, {SQL_PIECES}, {_TABLE}, na AS (SELECT qid, count(DISTINCT aspect) t FROM pc WHERE role = 'key' GROUP BY qid),
    f AS (SELECT cv.*, n_keys > 0 k, n_assoc > 0 a, n_aspects >= 2 p, n_aspects = t AND t >= 2 e FROM cv JOIN na USING (qid)),
    l AS (SELECT qid, unnest(['standalone_key', 'standalone_assoc', 'any_standalone', 'pairwise_key', 'all_aspects_key', 'key_plus_assoc', 'pairwise_key_plus_assoc', 'all_aspects_plus_assoc']) strategy, unnest([k, a, k OR a, p, e, k AND a, p AND a, e AND a]) hit FROM f)
    SELECT qid, strategy, count(*) FILTER (hit) docs, round(count(*) FILTER (hit) / count(*)::DOUBLE, 9) share FROM l GROUP BY ALL""")
def strategy_coverage(spark, d):
    return analyze.strategy_coverage(*_covered(spark, d)).withColumn("share", F.round("share", 9))


@query(f"""WITH {SQL_WORDS}, {SQL_PIECES}, k AS (SELECT DISTINCT qid, piece, aspect_ix FROM pc WHERE role = 'key'), a AS (SELECT qid, count(DISTINCT piece) n FROM pc WHERE role = 'assoc' GROUP BY qid),
    c AS (SELECT q.qid, n, (SELECT count(*) FROM k WHERE k.qid = q.qid) o, (SELECT count(*) FROM k x JOIN k y ON x.qid = y.qid AND x.aspect_ix < y.aspect_ix WHERE x.qid = q.qid) p,
        (SELECT count(*) FROM k x JOIN k y ON x.qid = y.qid AND x.aspect_ix < y.aspect_ix JOIN k z ON z.qid = y.qid AND y.aspect_ix < z.aspect_ix WHERE x.qid = q.qid) t, (SELECT product(s) FROM (SELECT count(*) s FROM k WHERE k.qid = q.qid GROUP BY aspect_ix))::BIGINT w FROM a q)
    SELECT qid, o standalone_key, n standalone_assoc, p pairwise_key, t triple_key, w all_aspects_key, o * n key_plus_assoc, p * n pairwise_key_plus_assoc, w * n all_aspects_plus_assoc FROM c""")
def strategy_query_counts(spark, d):
    p, _ = lower_pieces(spark, index_for(spark, d))
    return analyze.strategy_query_counts(p)


@query(f"WITH {SQL_WORDS}, {SQL_PIECES}, {_TABLE}, n AS (SELECT qid, doc_id, role, aspect, count(DISTINCT piece) c FROM kt GROUP BY ALL), k AS (SELECT qid, doc_id, count(*) a, product(c) ways FROM n WHERE role = 'key' GROUP BY ALL), s AS (SELECT qid, doc_id, sum(c) c FROM n WHERE role = 'assoc' GROUP BY ALL) SELECT qid, doc_id, a + CASE WHEN coalesce(c, 0) > 0 THEN 1 ELSE 0 END score, CAST(ways * greatest(1, coalesce(c, 0)) AS BIGINT) combinations FROM k LEFT JOIN s USING (qid, doc_id)")
def maximal_combos(spark, d):
    return analyze.maximal_combinations(_table(spark, d)[0])


@query(f"WITH {SQL_WORDS}, {SQL_PIECES}, {_TABLE}, na AS (SELECT qid, count(DISTINCT aspect) t FROM pc WHERE role = 'key' GROUP BY qid) SELECT qid, count(*) docs, count(*) FILTER (n_keys > 0) any_key, count(*) FILTER (n_assoc > 0) any_assoc, count(*) FILTER (n_keys > 0 OR n_assoc > 0) any_term, count(*) FILTER (n_keys > 0 AND n_assoc > 0) key_and_assoc, count(*) FILTER (n_aspects = t) all_keys, count(*) FILTER (n_keys = 0 AND n_assoc = 0) zero, round(100.0 * count(*) FILTER (n_keys > 0 OR n_assoc > 0) / count(*)::DOUBLE, 6) pct_any, round(100.0 * count(*) FILTER (n_aspects = t) / count(*)::DOUBLE, 6) pct_all_keys FROM cv JOIN na USING (qid) GROUP BY qid")
def keyword_effect(spark, d):
    return _rounded(analyze.keyword_effect(*_covered(spark, d)))


@query(f"WITH {SQL_WORDS}, {SQL_PIECES}, {_PAIRS}, q AS (SELECT query_id, span, quantile_cont(span, [0.5, 0.75, 0.9, 0.95]) OVER (PARTITION BY query_id) q FROM ps) SELECT query_id, count(*) n, min(span)::BIGINT least, trunc(any_value(q)[1])::BIGINT median, trunc(any_value(q)[2])::BIGINT p75, trunc(any_value(q)[3])::BIGINT p90, trunc(any_value(q)[4])::BIGINT p95, max(span)::BIGINT most FROM q GROUP BY query_id")
def span_stats(spark, d):
    return analyze.span_statistics(_pair_spans(spark, d), ["query_id"])


def _pair_spans(spark, d):
    p, _, hits, _ = _piece_hits(spark, d)
    pairs = cnf.pairs_of(p.select("qid", "piece", "role", "aspect_ix").distinct())
    return cut(cnf.spans(cnf.combined_hits(hits, pairs.select("query_id", "a", "b"), ["a", "b"]), 4), "pair-spans")


_BOUNDS = (5, 10, 25, 50, 100, 200, 500)
_CURVE = f"c AS (SELECT query_id, b bound, count(*) FILTER (span <= b) docs, count(*) n FROM ps, (SELECT unnest({list(_BOUNDS)}) b) GROUP BY ALL)"


@query(f"WITH {SQL_WORDS}, {SQL_PIECES}, {_PAIRS}, {_CURVE} SELECT query_id, bound, docs, round(docs / n::DOUBLE, 9) share FROM c")
def prox_curve(spark, d):
    return analyze.proximity_curve(_pair_spans(spark, d), _BOUNDS, ["query_id"]).withColumn("share", F.round("share", 9))


@query(f"WITH {SQL_WORDS}, {SQL_PIECES}, {_PAIRS}, {_CURVE} SELECT query_id, min(bound) bound FROM c WHERE docs / n::DOUBLE >= 0.9 GROUP BY query_id")
def advised_bound(spark, d):
    return analyze.advised_bound(analyze.proximity_curve(_pair_spans(spark, d), _BOUNDS, ["query_id"]), ["query_id"], 0.9)


@query(f"""WITH {SQL_WORDS}, {SQL_PIECES}, {_PAIRS}, g AS (SELECT doc_id FROM documents WHERE source IN ('webcrawl', 'newswire')), b AS (SELECT unnest([50, 100, 200]) bound),
    e AS (SELECT query_id, bound, count(*) FILTER (span <= bound) engine, count(*) FILTER (span <= bound AND g.doc_id IS NOT NULL) covered FROM ps LEFT JOIN g USING (doc_id), b GROUP BY ALL)
    SELECT query_id, bound, covered, engine, round(CASE WHEN engine > 0 THEN covered / engine::DOUBLE END, 9) AS precision FROM e""")
def candidate_outcomes(spark, d):
    all_ = _pair_spans(spark, d)
    good = table(spark, d, "documents").where(F.col("source").isin("webcrawl", "newswire")).select("doc_id")
    return analyze.candidate_outcomes(all_.join(good, "doc_id", "left_semi"), all_, (50, 100, 200)).withColumn("precision", F.round("precision", 9))


def _tightest(spark, d):
    """The matches of the pieces, their hits, and the tightest queries of each document."""
    p, alts, hits, docs = _piece_hits(spark, d)
    m = cnf.spans(hits, cnf.most_clauses(alts))
    t = cut(analyze.keyword_table(m, p).distinct(), "keyword-table")
    return t, p, hits, docs, cut(analyze.tightest_combinations(t), "tightest")


def _own_spans(hits, tight):
    return cut(cnf.group_spans(hits, tight.select("qid", "query_id", "members").distinct()), "tightest-spans")


_TIGHT = f"""{_SP}, tk AS (SELECT DISTINCT k.qid, s.doc_id, k.role, k.aspect_ix, k.piece FROM sp s JOIN (SELECT DISTINCT qid, role, aspect_ix, piece FROM pc) k USING (piece)), d0 AS (SELECT DISTINCT qid, doc_id FROM tk WHERE role = 'key'),
    cm AS (SELECT DISTINCT d0.qid, d0.doc_id, list_sort(list_distinct(list_filter([a.piece, b.piece, c.piece, s.piece], lambda x: x IS NOT NULL))) m, (a.piece IS NOT NULL)::BIGINT + (b.piece IS NOT NULL)::BIGINT + (c.piece IS NOT NULL)::BIGINT + (s.piece IS NOT NULL)::BIGINT score
        FROM d0 LEFT JOIN tk a ON a.qid = d0.qid AND a.doc_id = d0.doc_id AND a.aspect_ix = 0 LEFT JOIN tk b ON b.qid = d0.qid AND b.doc_id = d0.doc_id AND b.aspect_ix = 1 LEFT JOIN tk c ON c.qid = d0.qid AND c.doc_id = d0.doc_id AND c.aspect_ix = 2 LEFT JOIN tk s ON s.qid = d0.qid AND s.doc_id = d0.doc_id AND s.role = 'assoc'),
    tq AS (SELECT qid, doc_id, list_aggregate(m, 'string_agg', ' + ') query_id, m, score FROM cm), tm AS (SELECT qid, query_id, unnest(m) piece FROM (SELECT DISTINCT qid, query_id, m FROM tq)),
    tw AS (SELECT qid, query_id, list_aggregate(list_sort(list(DISTINCT word)), 'string_agg', ' ') sk FROM tm JOIN pw USING (piece) GROUP BY ALL), pdt AS MATERIALIZED (SELECT DISTINCT tok, doc_id FROM tok),
    tws AS (SELECT sk, len(l) n, unnest(l) word, generate_subscripts(l, 1) - 1 clause FROM (SELECT DISTINCT sk, string_split(sk, ' ') l FROM tw)), {sql_sets("tws", "sk", "tx")}"""


@query(f"WITH {SQL_WORDS}, {SQL_PIECES}, {_TIGHT} SELECT tq.qid, tq.doc_id, tq.query_id, tq.score, tx.span::BIGINT span FROM tq JOIN tw ON tw.qid = tq.qid AND tw.query_id = tq.query_id JOIN tx ON tx.sk = tw.sk AND tx.doc_id = tq.doc_id")
def tightest_queries(spark, d):
    """Each document's queries of one keyword for each aspect it has and one associated term, with their spans there."""
    _, _, hits, _, tight = _tightest(spark, d)
    return tight.join(_own_spans(hits, tight), ["qid", "query_id", "doc_id"]).select("qid", "doc_id", "query_id", "score", "span")


@query(f"WITH {SQL_WORDS}, {SQL_PIECES}, {_TIGHT}, td AS (SELECT qid, query_id, count(DISTINCT doc_id) docs FROM tq GROUP BY ALL), te AS (SELECT sk, count(*) FILTER (span <= 50) engine FROM tx GROUP BY sk) SELECT td.qid, td.query_id, docs, coalesce(engine, 0) engine, round(CASE WHEN engine > 0 THEN docs / engine::DOUBLE ELSE 0 END, 9) AS precision FROM td JOIN tw USING (qid, query_id) LEFT JOIN te USING (sk)")
def tightest_counts(spark, d):
    _, _, hits, _, tight = _tightest(spark, d)
    return analyze.tightest_counts(tight, _own_spans(hits, tight), 50).withColumn("precision", F.round("precision", 9))


@query(f"WITH {SQL_WORDS}, {SQL_PIECES}, {_TABLE} SELECT qid, doc_id FROM cv WHERE n_aspects <= 1 AND n_assoc = 0 AND n_keys > 0")
def single_term_docs(spark, d):
    return analyze.single_term_documents(_covered(spark, d)[0])


def _cover_spans(spark, d):
    """All candidates and tightest queries, and where each of them matches."""
    t, p, hits, _, tight = _tightest(spark, d)
    queries = cut(analyze.cover_queries(p, tight), "cover-queries")
    return t, tight, queries, cut(cnf.group_spans(hits, queries.select("qid", "query_id", "members")), "cover-spans")


_QUERIES = f"""{_TIGHT}, k1 AS (SELECT DISTINCT qid, piece, role, aspect_ix FROM pc), nm AS (SELECT qid, list_sort(list(DISTINCT piece)) m FROM pc WHERE role = 'key' AND lower(keyword) = lower(aspect) GROUP BY qid HAVING count(DISTINCT aspect) >= 2),
    cq0 AS (SELECT a.qid, list_sort(list_distinct([a.piece, b.piece])) m, CASE WHEN b.role = 'key' THEN 1 ELSE 3 END ty FROM k1 a JOIN k1 b ON a.qid = b.qid AND a.role = 'key' AND ((b.role = 'key' AND a.aspect_ix < b.aspect_ix) OR b.role = 'assoc')
        UNION ALL SELECT qid, m, 2 FROM nm UNION ALL SELECT qid, [piece], CASE WHEN role = 'key' THEN 4 ELSE 5 END FROM k1 UNION ALL SELECT DISTINCT qid, m, 6 FROM tq),
    cq AS (SELECT qid, list_aggregate(m, 'string_agg', ' + ') query_id, m, min(ty) ty FROM cq0 GROUP BY qid, m), cqi AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ty, query_id) - 1 query_ix, ['pairwise', 'all_aspects', 'aspect_assoc', 'standalone_key', 'standalone_assoc', 'tightest'][ty] AS type FROM cq),
    cw3 AS (SELECT qid, query_id, list_aggregate(list_sort(list(DISTINCT word)), 'string_agg', ' ') sk FROM (SELECT qid, query_id, unnest(m) piece FROM cq) JOIN pw USING (piece) GROUP BY ALL),
    cws AS (SELECT sk, len(l) n, unnest(l) word, generate_subscripts(l, 1) - 1 clause FROM (SELECT DISTINCT sk, string_split(sk, ' ') l FROM cw3)), {sql_sets("cws", "sk", "cx")}, cs AS (SELECT cw3.qid, cw3.query_id, doc_id, span FROM cw3 JOIN cx USING (sk))"""


@query(f"""WITH {SQL_WORDS}, {SQL_PIECES}, {_QUERIES}, g AS (SELECT doc_id FROM documents WHERE source IN ('webcrawl', 'newswire')), b AS (SELECT unnest([50, 100, 200]) bound),
    o AS (SELECT cs.qid, cs.query_id, bound, count(*) FILTER (span <= bound) engine, count(*) FILTER (span <= bound AND g.doc_id IS NOT NULL) covered FROM cs LEFT JOIN g USING (doc_id), b GROUP BY ALL)
    SELECT cqi.qid, cqi.query_id, cqi.type, b.bound, coalesce(covered, 0) covered, coalesce(engine, 0) engine, round(CASE WHEN engine > 0 THEN covered / engine::DOUBLE END, 9) AS precision FROM cqi CROSS JOIN b LEFT JOIN o ON o.qid = cqi.qid AND o.query_id = cqi.query_id AND o.bound = b.bound""")
def cover_outcomes(spark, d):
    """What :func:`candidate_outcomes` has for pairs, for all kinds of candidates and the tightest queries."""
    _, _, queries, spans = _cover_spans(spark, d)
    good = table(spark, d, "documents").where(F.col("source").isin("webcrawl", "newswire")).select("doc_id")
    one = spans.select(F.struct("qid", "query_id").alias("query_id"), "doc_id", "span")
    out = analyze.candidate_outcomes(one.join(good, "doc_id", "left_semi"), one, (50, 100, 200)).select("query_id.*", "bound", "covered", "engine", F.round("precision", 9).alias("precision"))
    bounds = queries.select("qid", "query_id", "type", F.explode(F.array(*[F.lit(b) for b in (50, 100, 200)])).alias("bound"))
    return bounds.join(out, ["qid", "query_id", "bound"], "left").na.fill(0, ["covered", "engine"])


def _covering(spark, d, within):
    """What candidates and tightest queries cover of the documents with two aspects of a topic, with each query's count within the bound."""
    t, tight, queries, spans = _cover_spans(spark, d)
    relevant = t.where("role = 'key'").groupBy("qid", "doc_id").agg(F.count_distinct("aspect").alias("a")).where("a >= 2").select("qid", "doc_id")
    return cut(analyze.cover_candidates(queries, spans, tight, relevant, within), "covering"), relevant, queries


def _greedy(within: int, by_cost: bool) -> str:
    """``st(qid, step, query_ix, new_docs, covered, engine_total)``: the greedy choice, a step a recursion."""
    worth = "new / greatest(1, engine)::DOUBLE" if by_cost else "new"
    return f"""{_QUERIES}, rl AS (SELECT qid, doc_id FROM tk WHERE role = 'key' GROUP BY ALL HAVING count(DISTINCT aspect_ix) >= 2), en AS (SELECT qid, query_id, count(*) engine FROM cs WHERE span <= {within} GROUP BY ALL),
    co AS (SELECT cs.qid, cs.query_id, doc_id FROM cs JOIN cqi USING (qid, query_id) WHERE ty < 6 AND span <= {within} UNION SELECT qid, query_id, doc_id FROM tq),
    cd AS MATERIALIZED (SELECT co.qid, query_ix, list(DISTINCT doc_id) docs, coalesce(any_value(engine), 0) engine FROM co JOIN rl USING (qid, doc_id) JOIN cqi USING (qid, query_id) LEFT JOIN en USING (qid, query_id) GROUP BY co.qid, query_ix),
    st AS (SELECT DISTINCT qid, 0 step, NULL::BIGINT query_ix, 0::BIGINT new_docs, []::BIGINT[] cov, []::BIGINT[] used, 0::BIGINT engine_total FROM cd
        UNION ALL SELECT qid, step + 1, query_ix, new, list_distinct(list_concat(cov, docs)), list_append(used, query_ix), engine_total + engine FROM (
            SELECT st.qid, step, cov, used, engine_total, c.query_ix, c.docs, c.engine, len(list_filter(c.docs, lambda x: NOT list_contains(cov, x))) new, row_number() OVER (PARTITION BY st.qid ORDER BY {worth} DESC, c.query_ix) r FROM st JOIN cd c ON c.qid = st.qid AND NOT list_contains(st.used, c.query_ix)) WHERE r = 1 AND new > 0)"""


_STEPS = "SELECT qid, step, query_ix, new_docs, len(cov) covered, engine_total FROM st WHERE step > 0"


@query(f"WITH RECURSIVE {SQL_WORDS}, {SQL_PIECES}, {_greedy(50, False)} {_STEPS}")
def greedy_cover(spark, d):
    return analyze.greedy_cover(_covering(spark, d, 50)[0])


@query(f"WITH RECURSIVE {SQL_WORDS}, {SQL_PIECES}, {_greedy(100, True)} {_STEPS}")
def cover_curve(spark, d):
    return analyze.greedy_cover(_covering(spark, d, 100)[0], by_cost=True)


@query(f"""WITH RECURSIVE {SQL_WORDS}, {SQL_PIECES}, {_greedy(100, True)}, t AS (SELECT unnest([0.5, 0.8, 0.95])::DOUBLE target), n AS (SELECT qid, count(*) n FROM rl GROUP BY qid)
    SELECT qid, target, coalesce(min(engine_total) FILTER (len(cov) / n::DOUBLE >= target), max(engine_total)) engine_total FROM st JOIN n USING (qid), t WHERE step > 0 GROUP BY ALL""")
def engine_at_recall(spark, d):
    covering, relevant, _ = _covering(spark, d, 100)
    return analyze.cost_at_recall(cut(analyze.greedy_cover(covering, by_cost=True), "curve"), relevant.groupBy("qid").agg(F.count("*").alias("n_docs")))


@query(f"""WITH RECURSIVE {SQL_WORDS}, {SQL_PIECES}, {_greedy(100, True)}, o AS (SELECT qid, query_ix, new_docs, engine_total - lag(engine_total, 1, 0) OVER (PARTITION BY qid ORDER BY step) engine FROM st WHERE step > 0)
    SELECT type, count(*) steps, sum(new_docs)::BIGINT new_docs, sum(engine)::BIGINT engine FROM o JOIN cqi USING (qid, query_ix) GROUP BY type""")
def cover_by_type(spark, d):
    covering, _, queries = _covering(spark, d, 100)
    curve = cut(analyze.greedy_cover(covering, by_cost=True), "curve")
    return analyze.step_types(curve, queries.select("qid", "query_ix", "type"))


@query(f"WITH {_RUNS}, p AS (SELECT stage, qid, k::DOUBLE x, sum(hit) OVER (PARTITION BY stage, qid ORDER BY k)::DOUBLE y FROM h), g AS (SELECT unnest([1, 5, 10, 20, 50])::DOUBLE gx), m AS (SELECT stage, qid, max(x) mx FROM p GROUP BY ALL), v AS (SELECT m.stage, m.qid, gx, (SELECT max(y) FROM p WHERE p.stage = m.stage AND p.qid = m.qid AND p.x <= least(gx, mx)) y FROM m, g) SELECT stage, gx, round(avg(y), 6) mean, round(quantile_cont(y, 0.25), 6) q25, round(quantile_cont(y, 0.75), 6) q75 FROM v GROUP BY ALL")
def interp_bands(spark, d):
    from pyspark.sql import Window

    runs, qrels = stage_runs(spark, d)
    hit = runs.join(qrels.where("rel > 0").select("qid", "doc_id", F.lit(1).alias("hit")), ["qid", "doc_id"], "left")
    so_far = F.sum(F.coalesce("hit", F.lit(0))).over(Window.partitionBy("stage", "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    curves = hit.select(F.struct("stage", "qid").alias("c"), F.col("rank").alias("x"), so_far.alias("y"))
    grid = spark.createDataFrame([(float(g),) for g in (1, 5, 10, 20, 50)], "gx double")
    at = numbers.on_grid(curves, "c", "x", "y", grid, "gx")
    return _rounded(at.groupBy("c.stage", "gx").agg(F.avg("y").alias("mean"), F.percentile("y", 0.25).alias("q25"), F.percentile("y", 0.75).alias("q75")))


@query("WITH x AS (SELECT ln(n_chars) / ln(10) v FROM documents WHERE n_chars > 0), g AS (SELECT unnest(generate_series(0, 50)) / 10.0 gx) SELECT gx::DOUBLE AS gx, round(avg(exp(-0.5 * ((gx - v) / 0.2) * ((gx - v) / 0.2)) / (0.2 * 2.5066282746310002)), 6) density FROM x, g GROUP BY ALL")
def length_density(spark, d):
    v = table(spark, d, "documents").where("n_chars > 0").select((F.log("n_chars") / F.log(F.lit(10.0))).alias("v"))
    grid = spark.range(0, 51).select((F.col("id") / 10.0).alias("gx"))
    return _rounded(numbers.density(v, "v", grid, "gx", 0.2))


@query(f"{_OUTCOME}, z AS (SELECT stage, list_sort(list(recall)) r FROM o GROUP BY stage) SELECT stage, round(r[least(len(r), floor(len(r) * 0.5)::INT + 1)], 6) p50, round(r[least(len(r), floor(len(r) * 0.9)::INT + 1)], 6) p90 FROM z")
def index_percentiles(spark, d):
    runs, qrels = stage_runs(spark, d)
    o = evaluate.retrieval_outcome(runs, qrels, ["stage"])
    return _rounded(analyze.index_percentiles(o, "stage", "recall", (50, 90)))


_BI = "bg AS (SELECT a.tok, b.tok nxt, count(*) n FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY ALL), bp AS (SELECT tok, nxt, n, n / sum(n) OVER (PARTITION BY tok)::DOUBLE p FROM bg)"


def _bigrams(spark, d):
    return cut(lm.next_words(_docs(spark, d)), "bigrams")


@query(f"WITH {SQL_WORDS}, {_BI} SELECT tok, nxt, n, round(p, 9) p FROM bp")
def ntd_bigram(spark, d):
    return lm.next_words(_docs(spark, d)).withColumn("p", F.round("p", 9))


PROMPTS = ["price of heat pump", "zz unknown heat", "the", "zz yy", "less than blood pressure once"]


@query(f"""WITH {SQL_WORDS}, pr AS (SELECT prompt, string_split(prompt, ' ') ws FROM (VALUES {', '.join(f"('{p}')" for p in PROMPTS)}) v(prompt)), en AS (SELECT prompt, unnest(generate_series(1, least(5, len(ws)))) used, ws FROM pr), e2 AS (SELECT prompt, used, ws[len(ws) - used + 1:] x FROM en),
    ex AS (SELECT prompt, used, unnest(x) word, generate_subscripts(x, 1) - 1 off FROM e2), hi AS (SELECT prompt, used, doc_id, pos - off pos FROM ex JOIN tok ON tok.tok = word GROUP BY prompt, used, doc_id, pos - off HAVING count(*) = used),
    nx AS (SELECT prompt, used, t.tok nxt, count(*) n FROM hi JOIN tok t ON t.doc_id = hi.doc_id AND t.pos = hi.pos + used GROUP BY ALL), mx AS (SELECT prompt, max(used) used FROM nx GROUP BY prompt)
    SELECT prompt, used, nxt, n, round(n / sum(n) OVER (PARTITION BY prompt)::DOUBLE, 9) p FROM nx JOIN mx USING (prompt, used)""")
def ntd_backoff(spark, d):
    prompts = spark.createDataFrame([(p,) for p in PROMPTS], "prompt string")
    return lm.backed_off(_docs(spark, d), prompts).withColumn("p", F.round("p", 9))


_TOP3 = "t3 AS (SELECT tok, nxt, p FROM bp QUALIFY row_number() OVER (PARTITION BY tok ORDER BY p DESC, nxt) <= 3)"


@query(f"WITH {SQL_WORDS}, {_BI}, {_TOP3}, l1 AS (SELECT 'heat ' || nxt path, nxt AS last, p FROM t3 WHERE tok = 'heat'), l2 AS (SELECT path || ' ' || nxt path, nxt AS last, l1.p * t3.p p FROM l1 JOIN t3 ON t3.tok = l1.last) SELECT 0 depth, 'heat' path, 1.0::DOUBLE p UNION ALL SELECT 1, path, round(p, 9) FROM l1 UNION ALL SELECT 2, path, round(p, 9) FROM l2")
def tree_depth2(spark, d):
    return lm.expansion_tree(_bigrams(spark, d), "heat", 2, 3).select("depth", F.array_join("path", " ").alias("path"), F.round("p", 9).alias("p"))


@query(f"WITH {SQL_WORDS}, {_BI}, {_TOP3}, l1 AS (SELECT 'heat' par, 'heat ' || nxt path, nxt AS last FROM t3 WHERE tok = 'heat'), l2 AS (SELECT path par, path || ' ' || nxt path, nxt AS last FROM l1 JOIN t3 ON t3.tok = l1.last), al AS (SELECT NULL par, 'heat' path UNION ALL SELECT par, path FROM l1 UNION ALL SELECT par, path FROM l2) SELECT a.path AS text, (SELECT string_agg(split_part(b.path, ' ', -1), ', ' ORDER BY split_part(b.path, ' ', -1)) FROM al b WHERE b.par = a.path) children FROM al a")
def tree_children(spark, d):
    t = cut(lm.expansion_tree(_bigrams(spark, d), "heat", 2, 3), "tree")
    return lm.with_children(t).select("text", "children")


@query(f"""WITH {SQL_WORDS}, {_BI}, {_TOP3}, l1 AS (SELECT 'heat ' || nxt s, nxt AS last, ln(p) lp FROM t3 WHERE tok = 'heat'), l2 AS (SELECT s || ' ' || nxt s, nxt AS last, lp + ln(p) lp FROM l1 JOIN t3 ON t3.tok = l1.last),
    k2 AS (SELECT * FROM l2 ORDER BY lp DESC, s LIMIT 4), l3 AS (SELECT s || ' ' || nxt s, lp + ln(p) lp FROM k2 JOIN t3 ON t3.tok = k2.last) SELECT s ids, round(lp, 6) logprob FROM l3 ORDER BY lp DESC, s LIMIT 4""")
def beam_d3(spark, d):
    seqs, _ = lm.beam_search(spark, _bigrams(spark, d), ["heat"], 3, 2, 4, 3)
    return seqs.select(F.array_join("ids", " ").alias("ids"), F.round("logprob", 6).alias("logprob"))


def _word_vectors(spark, d):
    """``tok, embedding`` of every word that occurs often enough to be trained."""
    return vectors.vectors_of(vectors.word_vectors(_docs(spark, d))).select(F.col("word").alias("tok"), F.col("vector").alias("embedding"))


@query()
def tree_cosine(spark, d):
    """Cosines of the nodes of a tree with a target word, their changes from the parents, and the nodes to the best leaves."""
    v = cut(_word_vectors(spark, d), "word-vectors")
    t = cut(lm.expansion_tree(_bigrams(spark, d), "heat", 3, 3), "tree")
    goal = v.where("tok = 'pump'").select(F.col("embedding").alias("target"))
    nodes = t.join(v, t["last"] == v["tok"], "left").select("path", "depth", "parent", "embedding").crossJoin(F.broadcast(goal))
    change = cut(lm.similarity_change(nodes), "change")
    best = lm.top_leaf_paths(change.join(t.select("path", "parent"), "path").select("path", "parent", "cos"), 5)
    return change.join(best.select("path").distinct().withColumn("on_best", F.lit(True)), "path", "left").select(F.array_join("path", " ").alias("path"), "depth", "cos", "delta", F.coalesce("on_best", F.lit(False)).alias("on_best"))


@query()
def cosine_by_depth(spark, d):
    return lm.similarity_by_depth(tree_cosine(spark, d))


@query()
def next_word_change(spark, d):
    bigrams = lm.next_words(_docs(spark, d))  # not written, so that only those of the prompt's last word are exchanged
    return lm.next_word_change(bigrams, "the heat", cut(_word_vectors(spark, d), "word-vectors"), "meter", 10)


@query()
def kmeans_clusters(spark, d):
    return vectors.clusters(table(spark, d, "embeddings"), "embedding", 10).groupBy("cluster", "label").agg(F.count("*").alias("n"))


@query()
def pca_projection(spark, d):
    return vectors.projection(table(spark, d, "embeddings"), "embedding").select("vec_id", F.round(F.col("xy")[0], 6).alias("x"), F.round(F.col("xy")[1], 6).alias("y"))


@query()
def word2vec(spark, d):
    return vectors.vectors_of(vectors.word_vectors(_docs(spark, d)))


@query(f"WITH {SQL_WORDS} SELECT tok, count(*) tf FROM tok WHERE doc_id IN (SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> '') GROUP BY tok")
def stream_vocab(spark, d):
    out = fresh_path(spark, "stream")
    schema = "doc_id long, text string"
    return streamed_vocabulary(spark, f"{d}/documents.parquet*", schema, f"{out}/counts", f"{out}/checkpoint")


@query(f"WITH {_RUNS}, t AS (SELECT doc_id, min(coalesce(segment, body)) text FROM passages GROUP BY doc_id), g AS (SELECT qid, doc_id, 'found' kind FROM ql WHERE rel > 0), kw0 AS (SELECT DISTINCT qid, trim(k, ' ') k FROM (SELECT qid, unnest(associated_terms) k FROM api_expansions) WHERE trim(k, ' ') <> '' AND qid IS NOT NULL), kf AS (SELECT qid, k keyword FROM kw0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY k) <= 30) SELECT kf.qid, keyword, kind, count(*) FILTER (contains(lower(text), lower(keyword))) docs FROM g JOIN t USING (doc_id) JOIN kf USING (qid) GROUP BY ALL")
def keyword_presence(spark, d):
    good = stage_runs(spark, d)[1].where("rel > 0").select("qid", "doc_id", F.lit("found").alias("kind"))
    texts = table(spark, d, "passages").groupBy("doc_id").agg(F.min(F.coalesce("segment", "body")).alias("text"))
    kw = table(spark, d, "api_expansions").where("qid IS NOT NULL").select("qid", F.explode("associated_terms").alias("k")).select("qid", F.trim("k").alias("keyword")).where("keyword <> ''").distinct()
    return analyze.keyword_presence(good.join(texts, "doc_id"), kw, 30)
