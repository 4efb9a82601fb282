"""Queries of the index, of Boolean evaluation, query building and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions.text import SPACE, STOPWORDS, content_words, words
from lexmill.operators import build, cnf, index, select
from lexmill.plans.ordered import running_total
from lexmill.plans.registry import SQL_PIECES, SQL_WORDS, index_for, lower_pieces, query, sql_spans, stop_list, table, values
from lexmill.plans.shared import cut

#: Phrases that are looked up, as a setting.
PHRASES = ["heat pump", "power grid", "the", "of the", "zz none such", "blood pressure and", "in"]
#: Thresholds of the selection, scaled to a small corpus by share of its documents, as settings.
KEY_SHARE, ASSOC_SHARE, BUDGET_SHARE = 0.08, 0.04, 0.25


def _docs(spark, d):
    return index.doc_words(table(spark, d, "documents"))


_PHRASE_HITS = f"""ps AS (SELECT phrase, string_split(phrase, ' ') ws FROM {values([(p,) for p in PHRASES])} v(phrase)),
    pt AS (SELECT phrase, len(ws) n, unnest(ws) word, generate_subscripts(ws, 1) - 1 off FROM ps),
    hit AS (SELECT phrase, doc_id, pos - off pos FROM pt JOIN tok ON tok.tok = word GROUP BY phrase, doc_id, pos - off, n HAVING count(*) = n)"""


def _phrases(spark):
    return spark.createDataFrame([(p,) for p in PHRASES], "phrase string")


@query(f"WITH {SQL_WORDS}, {_PHRASE_HITS} SELECT phrase, count(hit.doc_id) n_occ, count(DISTINCT hit.doc_id) n_docs FROM ps LEFT JOIN hit USING (phrase) GROUP BY phrase")
def phrase_counts(spark, d):
    hits = cnf.phrase_hits(None, _phrases(spark), index_for(spark, d))
    per = hits.groupBy("phrase", "doc_id").agg(F.count("*").alias("c")).groupBy("phrase").agg(F.sum("c").alias("n_occ"), F.count("*").alias("n_docs"))
    return _phrases(spark).join(per, "phrase", "left").na.fill(0)


@query(f"WITH {SQL_WORDS}, {_PHRASE_HITS} SELECT phrase, doc_id, pos FROM hit")
def phrase_find(spark, d):
    return cnf.phrase_hits(None, _phrases(spark), index_for(spark, d)).select("phrase", "doc_id", "pos")


@query(f"WITH {SQL_WORDS}, {_PHRASE_HITS} SELECT DISTINCT phrase, doc_id FROM hit")
def phrase_docs(spark, d):
    return cnf.phrase_hits(None, _phrases(spark), index_for(spark, d)).select("phrase", "doc_id").distinct()


_SP = sql_spans("ph", "piece", 4)


def _piece_hits(spark, d):
    at = index_for(spark, d)
    p, alts = lower_pieces(spark, at)
    return p, alts, cut(cnf.clause_hits(None, alts, at), "hits"), at.docs


def _piece_spans(spark, d):
    p, alts, hits, docs = _piece_hits(spark, d)
    return p, alts, cut(cnf.spans(hits, cnf.most_clauses(alts)), "matches"), docs


_OR = [("any energy", 0, "heat pump"), ("any energy", 0, "wind turbine"), ("any energy", 0, "coal mine"), ("energy and health", 0, "heat pump"), ("energy and health", 0, "power grid"), ("energy and health", 1, "fever"), ("energy and health", 1, "vaccine"), ("three", 0, "the"), ("three", 1, "near"), ("three", 1, "around"), ("three", 2, "since"), ("three", 2, "until")]
_OR_N = {q: max(c for x, c, _ in _OR if x == q) + 1 for q, _, _ in _OR}


@query(f"""WITH {SQL_WORDS}, a AS (SELECT * FROM {values([(q, c, p, _OR_N[q]) for q, c, p in _OR])} v(query_id, clause, phrase, n)),
    pt AS (SELECT query_id, clause, phrase, n, len(string_split(phrase, ' ')) size, unnest(string_split(phrase, ' ')) word, generate_subscripts(string_split(phrase, ' '), 1) - 1 off FROM a),
    h AS (SELECT DISTINCT query_id, n, clause, doc_id, pos FROM (SELECT query_id, n, clause, phrase, doc_id, pos - off pos FROM pt JOIN tok ON tok.tok = word GROUP BY query_id, n, clause, phrase, doc_id, pos - off, size HAVING count(*) = size)),
    {sql_spans("h", "query_id", 3)} SELECT query_id, doc_id, span, n_occ FROM sp""")
def cnf_alternatives(spark, d):
    q = {name: [[p.split(" ") for x, k, p in _OR if x == name and k == c] for c in range(n)] for name, n in _OR_N.items()}
    return cnf.matches(None, cnf.alternatives(spark, q), at=index_for(spark, d))


_PAIRS = """pr AS (
        SELECT a.qid, a.piece || ' + ' || b.piece query_id, a.piece a, b.piece b, CASE WHEN b.role = 'key' THEN 'key-key' ELSE 'key-assoc' END kind, a.n na, a.n + b.n n
        FROM (SELECT DISTINCT qid, piece, role, aspect_ix, n FROM pc) a JOIN (SELECT DISTINCT qid, piece, role, aspect_ix, n FROM pc) b USING (qid)
        WHERE a.role = 'key' AND ((b.role = 'key' AND a.aspect_ix < b.aspect_ix) OR b.role = 'assoc')),
    prh AS (
        SELECT query_id, pr.n, ph.clause, doc_id, pos FROM pr JOIN ph ON ph.piece = pr.a
        UNION ALL SELECT query_id, pr.n, ph.clause + na, doc_id, pos FROM pr JOIN ph ON ph.piece = pr.b),
    prd AS (SELECT query_id, n, doc_id FROM prh GROUP BY ALL HAVING count(DISTINCT clause) = n),
    prk AS (SELECT prh.* FROM prh JOIN prd USING (query_id, n, doc_id)), """ + sql_spans("prk", "query_id", 4, "ps")


def _pair_counts(p, hits, within=100):
    pairs = cnf.pairs_of(p.select("qid", "piece", "role", "aspect_ix").distinct())
    met = cnf.spans(cnf.combined_hits(hits, pairs.select("query_id", "a", "b"), ["a", "b"]), 4)
    n = met.where(F.col("span") <= within).groupBy("query_id").agg(F.count("*").alias("n_docs"))
    return pairs.join(n, "query_id", "left").na.fill(0, ["n_docs"])


_LIMITS = f"lim AS (SELECT count(*) * {KEY_SHARE} key_most, count(*) * {ASSOC_SHARE} assoc_most, CAST(count(*) * {BUDGET_SHARE} AS BIGINT) budget FROM documents)"
_PEEK = f"""{_SP}, {_LIMITS}, pk AS (SELECT DISTINCT p.qid, p.piece, p.role, p.aspect_ix, coalesce(c.n_docs, 0) n_docs FROM pc p LEFT JOIN (SELECT piece, count(*) n_docs FROM sp WHERE span <= 10 GROUP BY piece) c USING (piece)),
    pg AS (SELECT pk.*, n_docs > 0 AND n_docs <= CASE WHEN role = 'key' THEN key_most ELSE assoc_most END grabbed FROM pk, lim)"""


def _peeked(spark, d, evaluated=None):
    p, alts, m, docs = evaluated or _piece_spans(spark, d)
    n = table(spark, d, "documents").count()
    counts = cnf.counts(m, alts, [10]).select(F.col("query_id").alias("piece"), "n_docs")
    all_ = p.select("qid", "piece", "role", "aspect_ix").distinct().join(counts, "piece")
    return select.grabbed_alone(all_, n * KEY_SHARE, n * ASSOC_SHARE), n


def selected(spark, d):
    pieces_, alts, hits, docs = _piece_hits(spark, d)
    p, n = _peeked(spark, d, (pieces_, alts, cnf.spans(hits, cnf.most_clauses(alts)), docs))
    p = cut(p, "peeked")
    pairs = cut(_pair_counts(pieces_, hits), "pairs")
    return p, pairs


_FOLD = [("a", "w", 30), ("a", "x", 50), ("a", "y", 40), ("a", "v", 15), ("a", "u", 10), ("b", "z", 120), ("b", "t", 90), ("b", "s", 20)]


@query(f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n, name) i FROM {values(_FOLD)} v(qid, name, n)),
    f AS (SELECT qid, 0::BIGINT i, 0::BIGINT used, NULL::VARCHAR name FROM (SELECT DISTINCT qid FROM c)
        UNION ALL SELECT f.qid, c.i, CASE WHEN used + n <= 100 THEN used + n ELSE used END, CASE WHEN used + n <= 100 THEN c.name END FROM f JOIN c ON c.qid = f.qid AND c.i = f.i + 1)
    SELECT c.qid, c.name, c.n FROM f JOIN c ON c.qid = f.qid AND c.i = f.i WHERE f.name IS NOT NULL""")
def budget_fold(spark, d):
    return select.fold_budget(spark.createDataFrame(_FOLD, "qid string, name string, n long"), "qid", ["n", "name"], "name", "n", 100)


@query(f"WITH {SQL_WORDS}, {_PHRASE_HITS}, e AS (SELECT phrase, list_concat(ws[pos + 1:pos + 4], list_resize([]::VARCHAR[], greatest(0, 4 - len(ws[pos + 1:pos + 4])), '<pad>')) x, len(ws) < pos + 4 cutoff FROM hit JOIN w USING (doc_id)) SELECT phrase query_id, list_aggregate(x, 'string_agg', ' ') ext, cutoff truncated, count(*) n FROM e GROUP BY ALL")
def extensions_padded(spark, d):
    docs = _docs(spark, d)
    hits = cnf.phrase_hits(None, _phrases(spark), index_for(spark, d)).withColumnRenamed("phrase", "query_id")
    return index.extensions(hits, docs, 4).groupBy("query_id", F.array_join("ext", " ").alias("ext"), "truncated").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_WORDS}, {_PHRASE_HITS}, e AS (SELECT phrase, list_aggregate(ws[1:5], 'string_agg', ' ') ext FROM hit JOIN w USING (doc_id)), c AS (SELECT phrase query_id, ext, count(*) n FROM e GROUP BY ALL) SELECT query_id, ext, n FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, ext) <= 10")
def ext_top(spark, d):
    docs = _docs(spark, d)
    hits = cnf.phrase_hits(None, _phrases(spark), index_for(spark, d)).withColumnRenamed("phrase", "query_id")
    exts = index.extensions(hits, docs, 5, from_start=True).withColumn("ext", F.filter("ext", lambda t: t != "<pad>"))
    return index.extension_counts(exts, 10).select("query_id", F.array_join("ext", " ").alias("ext"), "n")


@query("WITH o AS (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT off FROM documents WHERE n_chars > 0), p AS (SELECT event_id, event_id * 97 ptr FROM events) SELECT ptr, coalesce(o.doc_id, (SELECT min(doc_id) FROM o)) doc_id FROM p ASOF LEFT JOIN o ON p.ptr >= o.off")
def ptr_to_doc(spark, d):
    o = running_total(table(spark, d, "documents").where("n_chars > 0").select("doc_id", "n_chars"), ["doc_id"], "n_chars", "off")
    p = table(spark, d, "events").select((F.col("event_id") * 97).alias("ptr"))
    return index.containing_document(p, "ptr", o, "off", "doc_id")


@query(rf"""WITH {SQL_WORDS}, v AS (SELECT tok, count(*) / (SELECT count(*) FROM tok)::DOUBLE p FROM tok GROUP BY tok), t AS (SELECT qid, min(text) t FROM topics WHERE qid IS NOT NULL AND text IS NOT NULL GROUP BY qid),
    e AS (SELECT qid, unnest(list_filter(string_split_regex(lower(t), '{SPACE}'), lambda x: x <> '')) tok FROM t) SELECT t.qid, round(coalesce(sum(ln(p)), 0), 6) log_p FROM t LEFT JOIN (SELECT qid, p FROM e JOIN v USING (tok)) USING (qid) GROUP BY t.qid""")
def span_probability(spark, d):
    """The topics' texts as spans, by the probabilities of their words in the documents."""
    t = table(spark, d, "topics").where("qid IS NOT NULL AND text IS NOT NULL").groupBy("qid").agg(F.min("text").alias("text")).select("qid", words(F.col("text")).alias("x"))
    return index.word_probability(t, "qid", "x", index.vocabulary(_docs(spark, d))).select("qid", F.round(F.log("p"), 6).alias("log_p"))


@query(f"""WITH {SQL_WORDS}, v AS (SELECT tok, row_number() OVER (ORDER BY count(*) DESC, tok) - 1 tok_id FROM tok GROUP BY tok)
    SELECT doc_id, list_aggregate(list(tok_id ORDER BY pos), 'string_agg', ' ') ids FROM tok JOIN v USING (tok) GROUP BY doc_id""")
def encoded_documents(spark, d):
    docs = _docs(spark, d)
    coded = index.encode(docs, cut(index.with_token_ids(index.vocabulary(docs)), "ids"))
    return coded.select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


#: Terms of several words and stopwords, as settings of the validation.
TERMS = ["heat pump", "price of the heat pump", "insulation near battery storage", "the of", "zz none", "coal mine and wind turbine", "Blood Pressure", "fever", "power zz grid"]


def _forms() -> list[tuple]:
    """What each term asks for, in lower case: itself, its runs between stopwords, its content words; for the SQL alone."""
    rows = []
    for t in TERMS:
        ws, runs = t.lower().split(), [[]]
        for w in ws:
            runs = [*runs, []] if w in STOPWORDS else [*runs[:-1], [*runs[-1], w]]
        runs = [" ".join(r) for r in runs if r]
        single = [w for w in ws if w not in STOPWORDS and len(w) > 1]
        rows += [(t, k, c, p, len(ps)) for k, ps in ((1, [t.lower()]), (2, runs), (3, single)) for c, p in enumerate(ps)]
    return rows


@query(f"""WITH {SQL_WORDS}, fm AS (SELECT * FROM {values(_forms())} v(term, level, clause, phrase, n)), vp AS (SELECT *, level || '/' || term query_id, string_split(phrase, ' ') l FROM fm),
    vw AS (SELECT query_id, n, clause, phrase, len(l) size, unnest(l) word, generate_subscripts(l, 1) - 1 off FROM vp),
    vh AS (SELECT DISTINCT query_id, n, clause, doc_id, pos FROM (SELECT query_id, n, clause, phrase, doc_id, pos - off pos FROM vw JOIN tok ON tok.tok = word GROUP BY query_id, n, clause, phrase, doc_id, pos - off, size HAVING count(*) = size)),
    {sql_spans("vh", "query_id", 5, "vs")}, vn AS (SELECT query_id, count(*) n_docs FROM vs WHERE span <= 100 GROUP BY query_id),
    sh AS (SELECT term, level, query_id, max(len(l)) longest FROM vp GROUP BY ALL), me AS (SELECT * FROM sh JOIN vn USING (query_id) WHERE n_docs > 0 AND (level = 1 OR n_docs <= 1000) QUALIFY row_number() OVER (PARTITION BY term ORDER BY level) = 1)
    SELECT term, level, n_docs AS count, CASE level WHEN 1 THEN n_docs <= 1000 WHEN 2 THEN longest > 1 ELSE false END standalone FROM me""")
def validated_terms(spark, d):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    forms = cut(build.cascade_forms(terms).select("term", "level", "query_id", "clause", F.lower("phrase").alias("phrase"), "n_clauses").distinct(), "cascade")
    m = cnf.matches(None, forms.select("query_id", "clause", "phrase", "n_clauses"), within=100, at=index_for(spark, d))
    n = m.groupBy("query_id").agg(F.count("*").alias("n_docs"))
    return build.validated(forms, n, 1000)


@query(f"""WITH {SQL_WORDS}, t AS (SELECT term, list_filter(string_split(term, ' '), lambda x: length(x) > 1 AND NOT list_contains({stop_list()}, x)) ws FROM {values([(t.lower(),) for t in TERMS])} v(term)),
    e AS (SELECT term, len(ws) n, unnest(ws) word, generate_subscripts(ws, 1) - 1 clause FROM t), c AS (SELECT term, n, word, clause, coalesce((SELECT count(*) FROM tok WHERE tok = word), 0) tf FROM e),
    eh AS (SELECT term, n, clause, doc_id, pos FROM e JOIN tok ON tok.tok = word), {sql_spans("eh", "term", 6, "es")}, m AS (SELECT term, count(*) docs FROM es WHERE span <= 5 GROUP BY term)
    SELECT t.term, len(ws) n_words, CAST(CASE WHEN bool_or(tf = 0) THEN 0 WHEN len(ws) <= 1 THEN coalesce(sum(tf), 0) ELSE coalesce(any_value(docs), 0) END AS BIGINT) AS count, arg_min(word, clause) FILTER (tf = 0) invalid_word FROM t LEFT JOIN c USING (term) LEFT JOIN m USING (term) GROUP BY t.term, ws""")
def peeked_terms(spark, d):
    terms = spark.createDataFrame([(t.lower(),) for t in TERMS], "term string")
    at = index_for(spark, d)
    sets = cnf.word_sets(terms.select("term", content_words(F.col("term")).alias("ws")).where("size(ws) > 0"), "term", "ws")
    return build.peeked_terms(terms, at.words.select("tok", "tf"), cnf.set_matches(at, sets).where("span <= 5"))


def _clusters(spark, d):
    """Pieces as clusters with counts and scores, for the builders."""
    p, pairs = selected(spark, d)
    at = F.dense_rank().over(Window.partitionBy("qid").orderBy("piece"))
    c = cut(p.select("qid", "piece", "role", "n_docs", at.cast("long").alias("cluster"), F.round(1 / F.log(F.col("n_docs") + 2.0), 6).alias("score")), "clusters")
    name = c.select("qid", "piece", "cluster")
    pc = pairs.join(name.toDF("qid", "a", "ca"), ["qid", "a"]).join(name.toDF("qid", "b", "cb"), ["qid", "b"])
    pc = pc.select("qid", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "n_docs")
    return c, cut(pc, "pair-counts")


_CLUSTERS = """cl AS (SELECT qid, piece, role, n_docs, dense_rank() OVER (PARTITION BY qid ORDER BY piece) cluster, round(1 / ln(n_docs + 2.0), 6) score FROM pk),
    pcn AS (SELECT pr.qid, a, b, count(*) FILTER (span <= 100) n_docs FROM pr LEFT JOIN ps USING (query_id) GROUP BY ALL),
    pcc AS (SELECT pcn.qid, least(x.cluster, y.cluster) a, greatest(x.cluster, y.cluster) b, pcn.n_docs FROM pcn JOIN cl x ON x.qid = pcn.qid AND x.piece = pcn.a JOIN cl y ON y.qid = pcn.qid AND y.piece = pcn.b)"""


_LINKS = [("q1", 0, 1, 2), ("q1", 1, 2, 3), ("q1", 2, 5, 6), ("q1", 3, 6, 1), ("q2", 0, 1, 3)]


@query(f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ord) i FROM {values(_LINKS)} v(qid, ord, a, b)),
    f AS (SELECT DISTINCT qid, 0::BIGINT i, []::BIGINT[][] us FROM l
        UNION ALL SELECT f.qid, l.i, CASE WHEN len(list_filter(us, lambda u: list_contains(u, a) OR list_contains(u, b))) = 0 THEN list_append(us, list_distinct([a::BIGINT, b::BIGINT]))
            ELSE list_transform(us, lambda u, k: CASE WHEN k = list_position(list_transform(us, lambda x: list_contains(x, a) OR list_contains(x, b)), true) THEN list_concat(u, list_filter(list_distinct([a::BIGINT, b::BIGINT]), lambda x: NOT list_contains(u, x))) ELSE u END) END FROM f JOIN l ON l.qid = f.qid AND l.i = f.i + 1),
    z AS (SELECT qid, us FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY i DESC) = 1), e AS (SELECT qid, unnest(us) u, generate_subscripts(us, 1) - 1 unit FROM z) SELECT qid, unit::INT unit, unnest(u) AS cluster FROM e""")
def linked_units(spark, d):
    return build.link_units(spark.createDataFrame(_LINKS, "qid string, ord int, a long, b long"))


@query(f"""WITH {SQL_WORDS}, {SQL_PIECES}, {_PAIRS}, {_PEEK}, {_CLUSTERS}, mx AS (SELECT CAST(floor(count(*) * 0.03) AS BIGINT) one, CAST(floor(count(*) * 0.06) AS BIGINT) two FROM documents),
    p AS (SELECT * FROM pcc WHERE n_docs > 0), bw AS (SELECT qid, a, b, n_docs FROM p UNION ALL SELECT qid, b, a, n_docs FROM p),
    l0 AS (SELECT * FROM {values(_LINKS)} v(qid, ord, a, b)), lk AS (SELECT qid, ord, a, b FROM l0 UNION ALL SELECT qid, ord, b, a FROM l0),
    an AS (SELECT * FROM cl WHERE role = 'key'), inf AS (SELECT * FROM cl WHERE role = 'assoc'), wide AS (SELECT an.* FROM an, mx WHERE n_docs > one),
    fst AS (SELECT w.qid, w.cluster a, lk.b, bw.n_docs, w.score + coalesce(y.score, 0) score FROM wide w JOIN lk ON lk.qid = w.qid AND lk.a = w.cluster JOIN bw ON bw.qid = w.qid AND bw.a = w.cluster AND bw.b = lk.b LEFT JOIN cl y ON y.qid = w.qid AND y.cluster = lk.b, mx WHERE bw.n_docs <= two QUALIFY row_number() OVER (PARTITION BY w.qid, w.cluster ORDER BY ord, lk.b) = 1),
    al AS (SELECT qid, cluster a, NULL::BIGINT b, 'direct' kind, n_docs, score, 0 r FROM an, mx WHERE n_docs > 0 AND n_docs <= one
        UNION ALL SELECT qid, a, b, 'linked', n_docs, score, 1 FROM fst
        UNION ALL SELECT w.qid, w.cluster, i.cluster, 'informative', bw.n_docs, w.score * i.score, 2 FROM wide w JOIN inf i ON i.qid = w.qid AND i.cluster <> w.cluster JOIN bw ON bw.qid = w.qid AND bw.a = w.cluster AND bw.b = i.cluster WHERE NOT EXISTS (SELECT 1 FROM fst WHERE fst.qid = w.qid AND fst.a = w.cluster)
        UNION ALL SELECT x.qid, x.cluster, y.cluster, 'cross', p.n_docs, x.score * y.score, 3 FROM an x JOIN an y ON x.qid = y.qid AND x.cluster < y.cluster JOIN p ON p.qid = x.qid AND p.a = x.cluster AND p.b = y.cluster WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.qid = x.qid AND lk.a = x.cluster AND lk.b = y.cluster))
    SELECT qid, coalesce(least(a, b), a) a, CASE WHEN b IS NOT NULL THEN greatest(a, b) END b, kind, n_docs, round(score, 9) score FROM al QUALIFY row_number() OVER (PARTITION BY qid, coalesce(least(a, b), a), greatest(a, b) ORDER BY r, score DESC) = 1""")
def adaptive_queries(spark, d):
    c, pc = _clusters(spark, d)
    links = spark.createDataFrame(_LINKS, "qid string, ord int, a long, b long")
    n = table(spark, d, "documents").count()
    out = build.adaptive_queries(c.where("role = 'key'"), pc, links, c.where("role = 'assoc'").select("qid", "cluster", "score"), int(n * 0.03), int(n * 0.06))
    return out.withColumn("score", F.round("score", 9))


_CEILING = f"""WITH {SQL_WORDS}, {SQL_PIECES}, {_SP}, dp AS (SELECT piece, doc_id FROM sp), k AS (SELECT DISTINCT qid, piece, role, aspect_ix, aspect, keyword FROM pc),
    m AS (SELECT qid, 'keys_only' AS mode, doc_id FROM k JOIN dp USING (piece) WHERE role = 'key' AND lower(keyword) = lower(aspect)
        UNION SELECT qid, 'keys_expanded', doc_id FROM k JOIN dp USING (piece) WHERE role = 'key' UNION SELECT qid, 'full', doc_id FROM k JOIN dp USING (piece)
        UNION SELECT a.qid, '2way_and', x.doc_id FROM k a JOIN k b ON a.qid = b.qid AND a.role = 'key' AND b.role = 'key' AND a.aspect_ix < b.aspect_ix JOIN dp x ON x.piece = a.piece JOIN dp y ON y.piece = b.piece AND y.doc_id = x.doc_id
        UNION SELECT a.qid, '3way_and', x.doc_id FROM k a JOIN k b ON a.qid = b.qid AND a.role = 'key' AND b.role = 'key' AND a.aspect_ix < b.aspect_ix JOIN k c ON c.qid = b.qid AND c.role = 'key' AND b.aspect_ix < c.aspect_ix JOIN dp x ON x.piece = a.piece JOIN dp y ON y.piece = b.piece AND y.doc_id = x.doc_id JOIN dp z ON z.piece = c.piece AND z.doc_id = x.doc_id)"""


@query(f"{_CEILING} SELECT qid, mode, count(*) n_retrieved FROM m GROUP BY ALL")
def ceiling_modes(spark, d):
    return ceiling_pools(spark, d).groupBy("qid", "mode").agg(F.count("*").alias("n_retrieved"))


def ceiling_pools(spark, d):
    """``qid, mode, doc_id``: what each ablation retrieves."""
    p, _, m, _ = _piece_spans(spark, d)
    q = build.ceiling_queries(p)
    each = q.select("qid", "mode", "query_id", F.size("members").alias("n"), F.explode("members").alias("piece"))
    met = each.join(m.select(F.col("query_id").alias("piece"), "doc_id"), "piece").groupBy("qid", "mode", "query_id", "doc_id", "n").agg(F.count("*").alias("c")).where("c = n")
    return met.select("qid", "mode", "doc_id").distinct()
