"""The queries of this subpackage over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from unicodedata import lookup, normalize

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm import frequency, lookalikes, mixing, neardup, packing, pairs, splitting, tokens, topn
from lexmill.plans.shared import cut


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark, d):
    return topn.top_documents(_t(spark, d, "rerank_results"), 10)


def _terms(spark, d):
    return frequency.passage_and_expansion_terms(_t(spark, d, "passages"), _t(spark, d, "api_expansions"))


def p2_found(spark, d):
    return _terms(spark, d).where("mark IS NOT NULL").select("field_name", "term", "mark")


def p2_terms(spark, d):
    return _terms(spark, d).select("field_name", "term", "occurrences", "records", F.coalesce("mark", F.lit("-")).alias("mark"))


def p2_spilled(spark, d):
    """The same terms where a task may hold 256 KB of counts only, so that it spills and splits by hash bits."""
    t = frequency.passage_and_expansion_terms(_t(spark, d, "passages"), _t(spark, d, "api_expansions"), held_bytes=256_000)
    return t.select("field_name", "term", "occurrences", "records", F.coalesce("mark", F.lit("-")).alias("mark"))


def p2_spilled(spark, d):
    """The same terms where a task may hold 256 KB of counts only, so that it spills and splits by hash bits."""
    t = frequency.passage_and_expansion_terms(_t(spark, d, "passages"), _t(spark, d, "api_expansions"), held_bytes=256_000)
    return t.select("field_name", "term", "occurrences", "records", F.coalesce("mark", F.lit("-")).alias("mark"))


def p3_found(spark, d):
    return pairs.pair_defects(_t(spark, d, "api_expansions")).where("defect IS NOT NULL")


def _pieces(spark, d):
    return splitting.split_passages(_t(spark, d, "passages"), _t(spark, d, "split_limits"))


def p4_found(spark, d):
    return _pieces(spark, d).where("piece_no = 1 AND n_pieces > 1").select("doc_id", "field_name").distinct()


def p4_pieces(spark, d):
    return _pieces(spark, d)


def p4_rejoined(spark, d):
    """What the pieces' own parts join to, and whether all pieces keep to the limit and overlap as given."""
    limits = _t(spark, d, "split_limits").select("field_name", "max_chars", F.col("overlap_chars").alias("asked"))
    p = _pieces(spark, d).join(F.broadcast(limits), "field_name")  # a row a field
    # an id with different texts has several cuts; a cut is known by its number of pieces and where it ends
    ends = F.max("end_char").over(Window.partitionBy("doc_id", "field_name", "n_pieces"))
    own = F.struct("piece_no", F.expr("substring(piece, overlap_chars + 1)").alias("own"))
    sound = (F.length("piece") <= F.col("max_chars")) & (F.col("overlap_chars") == F.least("asked", "start_char"))
    per = p.withColumn("ends", ends).groupBy("doc_id", "field_name", "n_pieces", "ends").agg(F.array_sort(F.collect_list(own)).alias("l"), F.min(sound).alias("sound"))
    return per.select("doc_id", "field_name", F.md5(F.array_join(F.transform("l", lambda x: x["own"]), "")).alias("digest"), "sound")


def p5_found(spark, d):
    return neardup.similar_pairs(_t(spark, d, "passages"), "doc_id", "segment", n=3, least=0.6, min_words=20)


def p5_groups(spark, d):
    return neardup.similar_groups(_t(spark, d, "passages"), "doc_id", "segment", n=3, least=0.6, min_words=20)


def _sized(spark, d):
    return cut(tokens.token_counts(_t(spark, d, "documents"), keep=("doc_id", "source")), "tokens")


def _packed(spark, d):
    return packing.pack_documents(_sized(spark, d), packing.capacity_of(_t(spark, d, "pack_limits")))


def p6_found(spark, d):
    return _packed(spark, d).where("piece_no = 1 AND n_pieces > 1").select("doc_id")


def p6_containers(spark, d):
    return _packed(spark, d)


def p6_fill(spark, d):
    """Every document once and whole, no container above its capacity, and at least 95 % of the containers' room used."""
    capacity = packing.capacity_of(_t(spark, d, "pack_limits"))
    p = cut(packing.pack_documents(_sized(spark, d), capacity), "packed")
    docs = p.groupBy("doc_id").agg(F.count("*").alias("c"), F.max("n_pieces").alias("n")).agg(F.count("*").alias("documents"), F.min(F.col("c") == F.col("n")).alias("whole"))
    load = p.groupBy("container").agg(F.sum("n_tokens").alias("load")).agg((F.max("load") <= capacity).alias("within_capacity"), (F.sum("load") >= 0.95 * capacity * F.count("*")).alias("filled"))
    return docs.crossJoin(load)  # one row each


def p7_found(spark, d):
    return mixing.mix_plan(_sized(spark, d), _t(spark, d, "mix_targets")).where("short").select("mix_id", "source")


def p7_shares(spark, d):
    return mixing.mix(_sized(spark, d), _t(spark, d, "mix_targets"))[1]


def p7_within(spark, d):
    """Of each mix's sources: no document drawn too often, and the target met up to a fiftieth wherever no source is short."""
    report = mixing.mix(_sized(spark, d), _t(spark, d, "mix_targets"))[1]
    near = F.abs(F.col("reached_share") - F.col("target_share")) <= 0.02
    met = F.when(F.max(F.col("short").cast("int")).over(Window.partitionBy("mix_id")) == 1, True).otherwise(near)
    return report.select("mix_id", "source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), met.alias("met"))


def p7_drawn(spark, d):
    return mixing.mix(_sized(spark, d), _t(spark, d, "mix_targets"))[0]


def p8_found(spark, d):
    return lookalikes.look_alike_pairs(_t(spark, d, "documents"))


def p8_groups(spark, d):
    return lookalikes.look_alike_groups(_t(spark, d, "documents"))


def p8_forms(spark, d):
    return lookalikes.consistent_texts(_t(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (p1_found, p2_found, p2_terms, p2_spilled, p3_found, p4_found, p4_pieces, p4_rejoined, p5_found, p5_groups, p6_found, p6_containers, p6_fill, p7_found, p7_shares, p7_within, p7_drawn, p8_found, p8_groups, p8_forms)
    return {f.__name__: f for f in names}


_TERMS = r"""
    WITH seg AS (SELECT doc_id, lower(any_value(segment)) txt FROM passages WHERE segment IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
    lst AS (SELECT expansion_id, any_value(associated_terms) vals FROM api_expansions WHERE associated_terms IS NOT NULL AND expansion_id IS NOT NULL GROUP BY expansion_id),
    occ AS (
        SELECT 'segment' field_name, CAST(doc_id AS VARCHAR) rec, unnest(regexp_extract_all(txt, '[\p{L}\p{N}]+')) term FROM seg
        UNION ALL SELECT 'associated_terms', CAST(expansion_id AS VARCHAR), trim(regexp_replace(lower(v), '[ \t\r\n\x{A0}]+', ' ', 'g')) FROM (SELECT expansion_id, unnest(vals) v FROM lst)),
    cnt AS (SELECT field_name, term, count(*) occurrences, count(DISTINCT rec) records FROM occ WHERE term IS NOT NULL AND term <> '' GROUP BY ALL),
    n AS (SELECT 'segment' field_name, (SELECT count(*) FROM seg) total, 20 pct UNION ALL SELECT 'associated_terms', (SELECT count(*) FROM lst), 1),
    marked AS (SELECT field_name, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records * 100 > pct * total THEN 'common' END mark FROM cnt JOIN n USING (field_name))
"""

_SIMILAR = r"""
    WITH one AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(segment), '[\p{L}\p{N}]+') w FROM passages WHERE segment IS NOT NULL AND doc_id IS NOT NULL),
    sh AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) i FROM one WHERE len(w) >= 20)),
    size AS (SELECT doc_id, count(*) n FROM sh GROUP BY doc_id),
    df AS (SELECT s, count(*) f FROM sh GROUP BY s),
    ranked AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) k FROM sh JOIN df USING (s) JOIN size USING (doc_id)),
    prefix AS (SELECT doc_id, s FROM ranked WHERE k <= n - ceil(0.6 * n) + 1),
    cand AS (SELECT DISTINCT a.doc_id a, b.doc_id b FROM prefix a JOIN prefix b USING (s) WHERE a.doc_id < b.doc_id),
    inter AS (SELECT a, b, count(*) i FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.s = x.s GROUP BY a, b)
    SELECT a doc_id_a, b doc_id_b FROM inter JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE i >= 0.6 * (p.n + q.n - i)
"""


# Look-alike letters of these documents by the ends of their Unicode names, for the SQL alone.
_NAMED = {
    "CYRILLIC SMALL LETTER ": {"A": "a", "ES": "c", "KOMI DE": "d", "IE": "e", "SHHA": "h", "BYELORUSSIAN-UKRAINIAN I": "i", "JE": "j", "PALOCHKA": "l", "O": "o", "ER": "p", "QA": "q", "DZE": "s", "WE": "w", "HA": "x", "U": "y", "IZHITSA": "v", "STRAIGHT U": "y"},
    "CYRILLIC CAPITAL LETTER ": {"A": "A", "VE": "B", "ES": "C", "IE": "E", "EN": "H", "BYELORUSSIAN-UKRAINIAN I": "I", "JE": "J", "KA": "K", "EM": "M", "O": "O", "ER": "P", "QA": "Q", "DZE": "S", "TE": "T", "WE": "W", "HA": "X", "U": "Y", "STRAIGHT U": "Y", "IZHITSA": "V", "KOMI SJE": "G"},
    "GREEK SMALL LETTER ": {"ALPHA": "a", "NU": "v", "OMICRON": "o", "RHO": "p", "IOTA": "i"},
    "GREEK CAPITAL LETTER ": {"ALPHA": "A", "BETA": "B", "EPSILON": "E", "ZETA": "Z", "ETA": "H", "IOTA": "I", "KAPPA": "K", "MU": "M", "NU": "N", "OMICRON": "O", "RHO": "P", "TAU": "T", "UPSILON": "Y", "CHI": "X"},
    "ARMENIAN SMALL LETTER ": {"OH": "o", "VO": "n", "SEH": "u", "HO": "h", "CO": "g", "ZA": "q"},
    "LATIN SMALL LETTER ": {"SCRIPT G": "g", "ALPHA": "a", "DOTLESS I": "i"},
}


def _looks() -> str:
    """Skeletons in SQL, for the characters of these documents: composed instead of decomposed, letters by their names."""
    wide, spaces = range(0xFF01, 0xFF5F), "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
    letters = {lookup(script + name): plain for script, names in _NAMED.items() for name, plain in names.items()}
    strange = "".join(letters) + "".join(map(chr, wide)) + spaces
    plain = "".join(letters.values()) + "".join(chr(c - 0xFEE0) for c in wide) + " " * len(spaces)
    latin = str.maketrans(strange, plain)
    for c in range(0x370, 0x530):  # look-alike letters stored together with their accents
        made = normalize("NFC", normalize("NFD", chr(c)).translate(latin))
        if len(made) == 1 and made != normalize("NFC", chr(c)) and chr(c) not in strange:
            strange, plain = strange + chr(c), plain + made
    unseen = r"[\x{AD}\x{34F}\x{61C}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202C}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    return f"nfc_normalize(translate(regexp_replace(text, '{unseen}', '', 'g'), {quote(strange)}, {quote(plain)}))"


def oracle_sql() -> dict[str, str]:
    return {
        "p8_found": f"""
            WITH t AS (SELECT doc_id, text, {_looks()} look FROM documents WHERE text IS NOT NULL)
            SELECT DISTINCT least(a.doc_id, b.doc_id) doc_id_a, greatest(a.doc_id, b.doc_id) doc_id_b FROM t a JOIN t b ON a.look = b.look AND a.doc_id <> b.doc_id WHERE a.text <> b.text AND regexp_matches(a.look, '[^\\s]')""",
        "p8_groups": f"""
            WITH t AS (SELECT doc_id, text, {_looks()} look FROM documents WHERE text IS NOT NULL), g AS (SELECT look, min(doc_id) group_id, count(DISTINCT text) n_forms FROM t WHERE regexp_matches(look, '[^\\s]') GROUP BY look)
            SELECT DISTINCT doc_id, group_id, n_forms FROM t JOIN g USING (look)""",
        "p8_forms": f"SELECT doc_id, {_looks()} AS text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)",
        "p1_found": """
            WITH e AS (
                SELECT qid, 'biencoder_ranked' stage, unnest(biencoder_ranked) x FROM rerank_results
                UNION ALL SELECT qid, 'crossencoder_ranked', unnest(crossencoder_ranked) FROM rerank_results),
            best AS (SELECT qid, stage, x.doc_id doc_id, max(x.score) score FROM e WHERE qid IS NOT NULL AND x.score IS NOT NULL AND NOT isnan(x.score) AND x.doc_id <> '' GROUP BY ALL)
            SELECT qid, stage, CAST(row_number() OVER (PARTITION BY qid, stage ORDER BY score DESC, doc_id DESC) AS INT) rank_no, doc_id FROM best
            QUALIFY rank_no <= 10""",
        "p2_found": f"{_TERMS} SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
        "p2_terms": f"{_TERMS} SELECT field_name, term, occurrences, records, coalesce(mark, '-') mark FROM marked",
        "p4_found": r"""
            WITH f AS (
                SELECT doc_id, 'segment' field_name, trim(segment, E' \t\r\n') t FROM passages
                UNION ALL SELECT doc_id, 'body', trim(body, E' \t\r\n') FROM passages)
            SELECT DISTINCT doc_id, field_name FROM f JOIN split_limits USING (field_name) WHERE length(t) > max_chars""",
        "p5_found": _SIMILAR,
        "p2_spilled": f"{_TERMS} SELECT field_name, term, occurrences, records, coalesce(mark, '-') mark FROM marked",
        "p4_rejoined": r"""
            WITH f AS (
                SELECT doc_id, 'segment' field_name, trim(segment, E' \t\r\n') t FROM passages
                UNION ALL SELECT doc_id, 'body', trim(body, E' \t\r\n') FROM passages)
            SELECT DISTINCT doc_id, field_name, md5(t) digest, true AS sound FROM f JOIN split_limits USING (field_name) WHERE length(t) > max_chars""",
        "p6_fill": "SELECT count(DISTINCT doc_id) documents, true AS whole, true AS within_capacity, true AS filled FROM documents",
        "p7_within": "SELECT DISTINCT mix_id, source, true AS within_repeats, true AS met FROM mix_targets WHERE mix_id IS NOT NULL AND source IS NOT NULL",
    }
