"""Queries of text functions, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import nested, text
from lexmill.operators import build, index
from lexmill.plans.registry import SQL_WORDS, query, stop_list, table, values
from lexmill.sources import readers, writers


@query(f"WITH {SQL_WORDS} SELECT count(DISTINCT doc_id) docs, count(*) tokens FROM tok")
def tok_count(spark, d):
    w = index.doc_words(table(spark, d, "documents"))
    return w.agg(F.count_if(F.size("ws") > 0).alias("docs"), F.sum(F.size("ws")).alias("tokens"))


@query(f"WITH {SQL_WORDS} SELECT tok, count(*) tf, count(DISTINCT doc_id) df, round(count(*) / (SELECT count(*) FROM tok)::DOUBLE, 12) p FROM tok GROUP BY tok")
def vocab_tup(spark, d):
    return index.vocabulary(index.doc_words(table(spark, d, "documents"))).withColumn("p", F.round("p", 12))


@query(f"WITH {SQL_WORDS} SELECT row_number() OVER (ORDER BY count(*) DESC, tok) place, tok, count(*) tf FROM tok GROUP BY tok ORDER BY place LIMIT 100")
def zipf_topk(spark, d):
    top = index.term_frequencies_only(index.doc_words(table(spark, d, "documents"))).orderBy(F.desc("tf"), "tok").limit(100)
    return readers.first_per_group(top.withColumn("one", F.lit(1)), ["one"], [F.desc("tf"), "tok"], 100).selectExpr("row_number() OVER (ORDER BY tf DESC, tok) place", "tok", "tf")


_SENT = rf"""flat AS (SELECT doc_id, lang, trim(regexp_replace(coalesce(text, ''), '{text.SPACE}', ' ', 'g'), ' ') t FROM documents),
    parts AS (SELECT doc_id, lang, list_filter(string_split(regexp_replace(t, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') s FROM flat),
    sent AS (SELECT doc_id, lang, generate_subscripts(s, 1) - 1 n, unnest(s) sentence FROM parts)"""


@query(f"WITH {_SENT} SELECT doc_id, n, sentence FROM sent")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("n", "sentence"))


@query(rf"WITH {_SENT} SELECT lang, count(*) sentences, round(avg(len(string_split(sentence, ' '))), 6) mean_words, max(length(sentence)) longest FROM sent GROUP BY lang")
def sentence_len_stats(spark, d):
    s = table(spark, d, "documents").select("lang", F.explode(text.sentences(F.col("text"))).alias("s"))
    return s.groupBy("lang").agg(F.count("*").alias("sentences"), F.round(F.avg(F.size(F.split("s", " "))), 6).alias("mean_words"), F.max(F.length("s")).alias("longest"))


@query("""WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) t FROM documents), f AS (SELECT trim(regexp_replace(t, '""" + text.SPACE + """', ' ', 'g'), ' ') t FROM l), s AS (SELECT unnest(list_filter(string_split(regexp_replace(t, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> '')) s FROM f) SELECT count(*) sentences, sum(length(s))::BIGINT chars FROM s""")
def line_sentences(spark, d):
    s = table(spark, d, "documents").select(F.explode(text.line_sentences(F.col("text"))).alias("s"))
    return s.agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("chars"))


def _sql_clean(x: str) -> str:
    for entity, plain in text.ENTITIES:
        x = f"replace({x}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({x}, '(?i)</?({text.TAGS})[^>]*>', ' ', 'g')"


@query(f"SELECT DISTINCT doc_id, {_sql_clean('coalesce(segment, body)')} cleaned FROM passages WHERE coalesce(segment, body) IS NOT NULL")
def html_clean(spark, d):
    p = table(spark, d, "passages").select("doc_id", F.coalesce("segment", "body").alias("t")).where("t IS NOT NULL")
    return p.select("doc_id", text.clean_html(F.col("t")).alias("cleaned")).distinct()


@query(rf"WITH t AS (SELECT unnest(regexp_extract_all({_sql_clean('lower(segment)')}, '[\p{{L}}]+')) tok FROM passages) SELECT tok, count(*) n FROM t WHERE length(tok) BETWEEN 2 AND 15 GROUP BY tok")
def simple_preproc(spark, d):
    return table(spark, d, "passages").select(F.explode(text.simple_tokens(F.col("segment"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


@query("""WITH j AS (SELECT doc_id, CASE WHEN json_valid(metadata) THEN coalesce(json_extract_string(metadata, '$.metadata.docid'), json_extract_string(metadata, '$.docid')) END docid FROM passages)
    SELECT DISTINCT doc_id, docid FROM j""")
def metadata_docid(spark, d):
    p = table(spark, d, "passages")
    sound = F.try_parse_json("metadata").isNotNull()
    return p.select("doc_id", F.when(sound, nested.first_path(F.col("metadata"), "$.metadata.docid", "$.docid")).alias("docid")).distinct()


@query("SELECT event_type, json_extract_string(props, '$.' || k) v, count(*) n FROM events, (VALUES ('page'), ('k'), ('ref'), ('device')) t(k) WHERE json_extract_string(props, '$.' || k) IS NOT NULL GROUP BY ALL")
def event_props(spark, d):
    e = table(spark, d, "events")
    each = e.select("event_type", F.explode(F.array(*[F.get_json_object("props", f"$.{k}") for k in ("page", "k", "ref", "device")])).alias("v"))
    return each.where("v IS NOT NULL").groupBy("event_type", "v").agg(F.count("*").alias("n"))


_FIELD = "CASE WHEN trim(coalesce(segment, '')) <> '' THEN 'segment' WHEN trim(coalesce(body, '')) <> '' THEN 'body' ELSE 'none' END"


@query(f"SELECT {_FIELD} field, count(DISTINCT doc_id) docs FROM passages GROUP BY ALL")
def text_fallback(spark, d):
    return table(spark, d, "passages").select("doc_id", F.expr(_FIELD).alias("field")).groupBy("field").agg(F.count_distinct("doc_id").alias("docs"))


@query(r"""WITH rw AS (SELECT unnest(list_filter(string_split_regex(text, '""" + text.SPACE + r"""'), lambda x: x <> '')) w FROM topics),
    v AS (SELECT DISTINCT w, unnest([w, lower(w), upper(w[1]) || lower(w[2:])]) tok FROM rw),
    dt AS (SELECT unnest(list_filter(string_split_regex(coalesce(text, ''), '""" + text.SPACE + r"""'), lambda x: x <> '')) tok FROM documents), f AS (SELECT tok, count(*) tf FROM dt GROUP BY tok)
    SELECT w word, tok, tf FROM v JOIN f USING (tok)""")
def case_variants(spark, d):
    words = table(spark, d, "topics").select(F.explode(text.raw_words(F.col("text"))).alias("word")).distinct()
    forms = words.select("word", F.explode(text.case_variants(F.col("word"))).alias("tok"))
    raw = index.doc_words(table(spark, d, "documents"), tokenize=text.raw_words)
    return forms.join(index.term_frequencies_only(raw), "tok").select("word", "tok", "tf")


@query(r"SELECT DISTINCT qid, unnest([text, lower(text), list_aggregate(list_transform(regexp_extract_all(lower(text), '\p{L}+|[^\p{L}]+'), lambda x: upper(x[1]) || x[2:]), 'string_agg', ''), upper(text[1]) || lower(text[2:])]) variant FROM topics WHERE text IS NOT NULL")
def phrase_variants(spark, d):
    t = table(spark, d, "topics").where("text IS NOT NULL")
    return t.select("qid", F.explode(text.phrase_variants(F.col("text"))).alias("variant")).distinct()


_RAW = f"list_filter(string_split_regex(coalesce(text, ''), '{text.SPACE}'), lambda x: x <> '')"


@query(f"SELECT DISTINCT qid, list_aggregate(list_filter({_RAW}, lambda x: length(x) > 1 AND NOT list_contains({stop_list()}, lower(x))), 'string_agg', ' ') content FROM topics WHERE text IS NOT NULL")
def content_words(spark, d):
    t = table(spark, d, "topics").where("text IS NOT NULL")
    words = text.content_words(F.col("text"))
    return t.select("qid", F.when(F.size(words) > 0, F.array_join(words, " ")).alias("content")).distinct()


@query(f"""WITH w AS (SELECT DISTINCT qid, text, {_RAW} ws FROM topics WHERE text IS NOT NULL),
    e AS (SELECT qid, text, unnest(ws) w, generate_subscripts(ws, 1) i FROM w), m AS (SELECT *, list_contains({stop_list()}, lower(w)) stop FROM e),
    g AS (SELECT qid, text, w, i, i - row_number() OVER (PARTITION BY qid, text ORDER BY i) run FROM m WHERE NOT stop),
    c AS (SELECT qid, text, run, min(i) i, string_agg(w, ' ' ORDER BY i) chunk FROM g GROUP BY ALL)
    SELECT qid, row_number() OVER (PARTITION BY qid, text ORDER BY i) - 1 n, chunk FROM c""")
def stopword_chunks(spark, d):
    t = table(spark, d, "topics").where("text IS NOT NULL").select("qid", "text").distinct()
    return t.select("qid", F.posexplode(text.stopword_chunks(F.col("text"))).alias("n", "chunk"))


@query(f"""WITH {SQL_WORDS}, g AS (
        SELECT a.tok || ' ' || b.tok ngram FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
        UNION ALL SELECT a.tok || ' ' || b.tok || ' ' || c.tok FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2)
    SELECT ngram, count(*) n FROM g GROUP BY ngram""")
def ngrams_2_3(spark, d):
    w = index.doc_words(table(spark, d, "documents"))
    return w.select(F.explode(nested.ngrams(F.col("ws"), 2, 3)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


_PIECES = ["▁he ▁walk ed ▁home", "▁a ▁b c\n ▁d", "▁one", "x ▁y", "▁long er ▁word s ▁here"]


@query("""WITH p AS (SELECT s, string_split(s, ' ') t FROM """ + values([(s,) for s in _PIECES]) + """ v(s)),
    i AS (SELECT s, t, unnest(generate_series(1, len(t))) i FROM p), r AS (SELECT s, t, i, unnest([1, 2, 3]) n FROM i)
    SELECT s, list_aggregate(t[i:i + n - 1], 'string_agg', ' ') span FROM r
    WHERE i + n - 1 <= len(t) AND starts_with(t[i], '▁') AND (i + n > len(t) OR starts_with(t[i + n], '▁')) AND NOT contains(coalesce(list_aggregate(t[i:i + n - 2], 'string_agg', ' '), ''), chr(10))""")
def word_spans(spark, d):
    p = spark.createDataFrame([(s,) for s in _PIECES], "s string")
    return p.select("s", F.explode(nested.whole_word_spans(F.split("s", " "), 1, 3)).alias("x")).select("s", F.array_join("x", " ").alias("span"))


_ANSWERS = ['{"a": [1, 2}', 'text {"a": } more', '```json\n{"a": [1, 2,],}\n```', 'Here you are: {"a": "b"} .', "no object", '{"x": {"y": 1,\n}}', None]


@query("""WITH a AS (SELECT * FROM """ + values([(i, s) for i, s in enumerate(_ANSWERS)]) + r""" v(i, s)),
    b AS (SELECT i, regexp_extract(regexp_replace(s, '```(json)?', '', 'g'), '(?s)(\{.*\})', 1) j FROM a)
    SELECT i, CASE WHEN j <> '' AND json_valid(regexp_replace(j, ',\s*([}\]])', '\1', 'g')) THEN regexp_replace(j, ',\s*([}\]])', '\1', 'g') END json FROM b""")
def json_repair(spark, d):
    return spark.createDataFrame(list(enumerate(_ANSWERS)), "i int, s string").select("i", nested.repaired_json(F.col("s")).alias("json"))


_FLAT = """x AS (SELECT DISTINCT expansion_id, qid, key_entities, associated_terms, verbs FROM api_expansions),
    flat AS (
        SELECT expansion_id, 'key' role, e.key aspect, unnest(e.value) keyword FROM (SELECT expansion_id, unnest(map_entries(key_entities)) e FROM x)
        UNION ALL SELECT expansion_id, 'assoc', '', unnest(associated_terms) FROM x
        UNION ALL SELECT expansion_id, 'verb', e.key, unnest(e.value) FROM (SELECT expansion_id, unnest(map_entries(verbs)) e FROM x))"""


def _expansions(spark, d):
    return readers.first_per_group(table(spark, d, "api_expansions"), ["expansion_id"], ["created"], 1)


@query(f"WITH {_FLAT} SELECT expansion_id, role, aspect, keyword FROM flat")
def expansions_flat(spark, d):
    return _expansions(spark, d).select("expansion_id", F.explode(nested.expansion_terms(F.col("key_entities"), F.col("associated_terms"), F.col("verbs"))).alias("k")).select("expansion_id", "k.*")


@query("""WITH x AS (SELECT DISTINCT expansion_id, key_entities, associated_terms FROM api_expansions),
    n AS (SELECT expansion_id, list_transform(map_values(key_entities), lambda v: coalesce(len(v), 0)) ks, coalesce(len(associated_terms), 0) a FROM x)
    SELECT expansion_id, coalesce(len(list_filter(ks, lambda k: k < 3)) = 0, true) AND coalesce(list_sum(ks), 0) + a >= 10 valid FROM n""")
def expansion_valid(spark, d):
    return _expansions(spark, d).select("expansion_id", nested.is_valid_expansion(F.col("key_entities"), F.col("associated_terms")).alias("valid"))


@query(f"""WITH {_FLAT}, q AS (SELECT DISTINCT expansion_id, qid FROM api_expansions), k AS (SELECT qid, keyword, expansion_id * 1000 + row_number() OVER (PARTITION BY expansion_id ORDER BY role, aspect, keyword) ord FROM flat JOIN q USING (expansion_id)),
    t AS (SELECT qid, trim(keyword) keyword, ord FROM k WHERE length(trim(keyword)) >= 3), f AS (SELECT qid, arg_min(keyword, ord) keyword, min(ord) ord FROM t GROUP BY qid, lower(keyword))
    SELECT qid, keyword, ord, row_number() OVER (PARTITION BY qid ORDER BY length(keyword) DESC, ord) place FROM f""")
def tidy_keywords(spark, d):
    from pyspark.sql import Window

    x = _expansions(spark, d)
    flat = x.select("expansion_id", "qid", F.explode(nested.expansion_terms(F.col("key_entities"), F.col("associated_terms"), F.col("verbs"))).alias("k"))
    at = F.row_number().over(Window.partitionBy("expansion_id").orderBy("k.role", "k.aspect", "k.keyword"))
    return build.tidy_keywords(flat.select("qid", F.col("k.keyword").alias("keyword"), (F.col("expansion_id") * 1000 + at).alias("ord")))


@query("SELECT qid, doc_id, arg_max(rel, line_no) rel FROM qrels WHERE rel IS NOT NULL AND qid IS NOT NULL AND doc_id IS NOT NULL GROUP BY qid, doc_id")
def qrels_last(spark, d):
    q = table(spark, d, "qrels").where("rel IS NOT NULL AND qid IS NOT NULL AND doc_id IS NOT NULL")
    lines = q.select(F.concat_ws(" ", "qid", F.lit("0"), "doc_id", "rel").alias("value"), "line_no")
    return readers.judgments(lines)


_BEST = """e AS (SELECT qid, unnest(crossencoder_ranked) x FROM rerank_results WHERE qid IS NOT NULL),
    b AS (SELECT qid, x.doc_id doc_id, max(x.score) score FROM e WHERE x.score IS NOT NULL AND NOT isnan(x.score) AND x.doc_id <> '' GROUP BY ALL),
    r AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) rank FROM b)"""


def cross_run(spark, d):
    from lexmill.operators import evaluate

    e = table(spark, d, "rerank_results").where("qid IS NOT NULL").select("qid", F.explode("crossencoder_ranked").alias("x")).select("qid", "x.doc_id", "x.score").where("doc_id <> ''")
    return evaluate.positions_in_run(e, ["qid"])


@query(f"WITH {_BEST} SELECT qid, rank, printf('%s Q0 %s %d %.6f %s', qid, doc_id, rank, score, 'cross') line FROM r")
def run_lines(spark, d):
    return writers.run_lines(cross_run(spark, d).withColumn("rank0", F.col("rank") - 1), "cross")


@query("""WITH f AS (SELECT DISTINCT site, doc_id FROM passages), n AS (SELECT *, (row_number() OVER (PARTITION BY site ORDER BY doc_id) - 1) // 50 b FROM f)
    SELECT 'batch_' || lpad(b::VARCHAR, 4, '0') || '_' || site batch, site subset, doc_id path FROM n WHERE site IS NOT NULL""")
def file_batches(spark, d):
    f = table(spark, d, "passages").where("site IS NOT NULL").select("site", "doc_id").distinct()
    return readers.file_batches(f, "site", "doc_id", 50)


@query("WITH b AS (SELECT DISTINCT site FROM passages WHERE site IS NOT NULL), n AS (SELECT site, row_number() OVER (ORDER BY site) - 1 i FROM b) SELECT site, row_number() OVER (ORDER BY i % 7, i) position FROM n")
def strided_batches(spark, d):
    return readers.strided_order(table(spark, d, "passages").where("site IS NOT NULL").select("site").distinct(), "site", 7)


@query("WITH s AS (SELECT lang, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM documents) SELECT lang, doc_id FROM s WHERE before < 20000")
def take_until(spark, d):
    return readers.take_until(table(spark, d, "documents"), ["doc_id"], "n_chars", 20000, ["lang"]).select("lang", "doc_id")


@query("SELECT qid FROM documents WHERE source IN ('webcrawl', 'forum', 'newswire') AND qid IS NOT NULL GROUP BY qid HAVING count(DISTINCT source) = 3")
def in_all_sources(spark, d):
    f = table(spark, d, "documents").where(F.col("source").isin("webcrawl", "forum", "newswire") & F.col("qid").isNotNull())
    return readers.in_all_folders(f, "source", "qid", 3)


@query("SELECT DISTINCT doc_id, CASE WHEN nullif(trim(coalesce(title, '')), '') IS NULL THEN coalesce(segment, '') WHEN segment IS NULL THEN trim(title) ELSE trim(title) || '. ' || segment END AS text FROM passages")
def beir_corpus(spark, d):
    return readers.beir_corpus(table(spark, d, "passages").select(F.col("doc_id").alias("_id"), "title", F.col("segment").alias("text"))).distinct()


@query("SELECT DISTINCT qid, text FROM topics WHERE qid IN (SELECT qid FROM qrels)")
def judged_topics(spark, d):
    return readers.beir_topics(table(spark, d, "topics").select("qid", "text").distinct(), table(spark, d, "qrels"))


@query("SELECT lang, count(*) n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 9) share FROM documents GROUP BY lang")
def lang_shares(spark, d):
    from lexmill.operators import analyze

    return analyze.value_shares(table(spark, d, "documents"), "lang").withColumn("share", F.round("share", 9))


@query("""WITH p AS (SELECT doc_id, min(segment) AS text FROM passages GROUP BY doc_id), q AS (SELECT qid, doc_id, arg_max(rel, line_no) rel FROM qrels WHERE rel IS NOT NULL GROUP BY ALL)
    SELECT qid, doc_id, rel, text FROM q LEFT JOIN p USING (doc_id)""")
def enriched_qrels(spark, d):
    q = qrels_last(spark, d)
    return writers.enrich(q, table(spark, d, "passages").select("doc_id", F.col("segment").alias("text")))


_WORDPIECES = [("a", 0, "vi", 0.5), ("a", 1, "##car", 0.9), ("a", 2, "##ious", 0.1), ("a", 3, "trauma", 0.7), ("b", 0, "run", 0.2), ("b", 1, "##ning", 0.3), ("b", 2, "running", 0.8), ("b", 3, "##s", 0.1)]


@query("WITH p AS (SELECT * FROM " + values(_WORDPIECES) + """ t(qid, pos, piece, score)), n AS (SELECT *, sum(CASE WHEN starts_with(piece, '##') THEN 0 ELSE 1 END) OVER (PARTITION BY qid ORDER BY pos) w FROM p),
    g AS (SELECT qid, w, string_agg(replace(piece, '##', ''), '' ORDER BY pos) word, max(score) score FROM n GROUP BY ALL) SELECT qid, word, max(score)::DOUBLE score FROM g GROUP BY ALL""")
def wordpiece_glue(spark, d):
    p = spark.createDataFrame(_WORDPIECES, "qid string, pos int, piece string, score double")
    return text.glue_wordpieces(p, "word", ["qid"], "pos", "piece", "score")


@query("""WITH t AS (SELECT DISTINCT qid, lower(w) w FROM (SELECT qid, unnest(string_split(trim(v), ' ')) w FROM (SELECT qid, unnest(associated_terms) v FROM api_expansions)) WHERE w <> '' AND qid IS NOT NULL),
    s AS (SELECT qid, w, w[:unnest(generate_series(5, length(w)))] stem FROM t WHERE length(w) >= 5) SELECT qid, stem, count(*) n FROM s GROUP BY ALL HAVING count(*) >= 2""")
def stem_candidates(spark, d):
    return build.stem_candidates(_expansion_words(spark, d))


def _expansion_words(spark, d):
    x = table(spark, d, "api_expansions").where("qid IS NOT NULL").select("qid", F.explode("associated_terms").alias("v"))
    w = x.select("qid", F.explode(F.split(F.trim("v"), " ")).alias("token")).where("token <> ''")
    return w.groupBy("qid", "token").agg(F.count("*").cast("double").alias("score"))


@query()
def token_clusters(spark, d):
    from pyspark.sql import Window

    w = _expansion_words(spark, d)
    w = w.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "token")))
    return build.cluster_tokens(w)
