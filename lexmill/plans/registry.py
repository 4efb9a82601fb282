"""Registration of queries with their SQL, and what several of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import SPACE, STOPWORDS

REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name; ``sql`` gives the same rows."""

    def wrap(f: Callable) -> Callable:
        REGISTERED[f.__name__] = (f, sql)
        return f

    return wrap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Words of each document and their positions, in SQL.
SQL_WORDS = rf"""w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{SPACE}'), lambda x: x <> '') ws FROM documents),
    tok AS (SELECT doc_id, unnest(ws) tok, generate_subscripts(ws, 1) - 1 pos FROM w)"""

#: Two topics' keywords, as a setting of the Boolean queries.
KEYWORDS = [
    ("q1", "key", "heat pump", "heat pump"),
    ("q1", "key", "heat pump", "coal mine"),
    ("q1", "key", "power grid", "Power grid"),
    ("q1", "key", "power grid", "electricity meter"),
    ("q1", "key", "power grid", "wind turbine"),
    ("q1", "key", "fuel price", "fuel price"),
    ("q1", "assoc", "", "battery storage"),
    ("q1", "assoc", "", "insulation"),
    ("q1", "assoc", "", "zzabsent word"),
    ("q1", "verb", "verbs", "repair"),
    ("q2", "key", "blood pressure", "the blood pressure"),
    ("q2", "key", "blood pressure", "fever"),
    ("q2", "key", "physical therapy", "physical therapy"),
    ("q2", "key", "sleep quality", "sleep quality"),
    ("q2", "assoc", "", "vaccine"),
    ("q2", "assoc", "", "nutrition"),
    ("q2", "assoc", "", "of the"),
    ("q2", "verb", "verbs", "protect"),
]


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KEYWORDS, "qid string, role string, aspect string, keyword string")


def values(rows: list[tuple]) -> str:
    """Rows as SQL values."""
    def lit(x) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def stop_list() -> str:
    return "[" + ", ".join(f"'{s}'" for s in STOPWORDS) + "]"


#: The pieces of those keywords over the lower-cased index, in SQL: ``pc(qid, role, aspect, aspect_ix, keyword, piece, n)`` and their words ``pw(piece, n, clause, word)``.
SQL_PIECES = rf"""kw AS (SELECT * FROM {values(KEYWORDS)} t(qid, role, aspect, keyword)),
    named AS (SELECT qid, role, aspect, keyword FROM kw UNION SELECT qid, role, aspect, aspect FROM kw WHERE role = 'key'),
    ixd AS (SELECT *, CASE WHEN role = 'key' THEN dense_rank() OVER (PARTITION BY qid, role ORDER BY aspect) - 1 END aspect_ix FROM named WHERE role <> 'verb'),
    cw AS (SELECT *, string_split(keyword, ' ') rw, list_filter(string_split(keyword, ' '), lambda x: length(x) > 1 AND NOT list_contains({stop_list()}, lower(x))) ws FROM ixd),
    ok AS (SELECT qid, role, aspect, aspect_ix, keyword, qid || ': ' || keyword piece, ws, len(ws) n FROM cw WHERE len(ws) > 0 AND NOT (len(rw) > 1 AND len(ws) <= 1)),
    pw0 AS (SELECT DISTINCT piece, n, lower(unnest(ws)) word, generate_subscripts(ws, 1) - 1 clause FROM ok),
    alive AS (SELECT piece FROM pw0 LEFT JOIN (SELECT DISTINCT tok FROM tok) v ON v.tok = pw0.word GROUP BY piece HAVING bool_and(v.tok IS NOT NULL)),
    pc AS (SELECT qid, role, aspect, aspect_ix, keyword, piece, n FROM ok JOIN alive USING (piece)),
    pw AS (SELECT piece, n, clause, word FROM pw0 JOIN alive USING (piece)),
    ph AS (SELECT piece, n, clause, doc_id, pos FROM pw JOIN tok ON tok.tok = pw.word)"""


def sql_spans(source: str, key: str, clauses: int, name: str = "sp") -> str:
    """``name(key, doc_id, span, n_occ)`` from hits ``source(key, n, clause, doc_id, pos)``."""
    last = ", ".join(f"max(CASE WHEN clause = {i} THEN pos END) OVER win l{i}" for i in range(clauses))
    there = " AND ".join(f"(n <= {i} OR l{i} IS NOT NULL)" for i in range(clauses))
    return f"""{name}_ev AS (SELECT {key}, n, doc_id, clause, pos, {last} FROM {source} WINDOW win AS (PARTITION BY {key}, doc_id ORDER BY pos, clause ROWS UNBOUNDED PRECEDING)),
    {name}_n AS (SELECT {key}, doc_id, min(c) n_occ FROM (SELECT {key}, doc_id, clause, count(*) c FROM {source} GROUP BY ALL) GROUP BY ALL),
    {name} AS (SELECT {key}, doc_id, min(CASE WHEN n = 1 THEN 0 WHEN {there} THEN pos - least({', '.join(f'l{i}' for i in range(clauses))}) END) span, any_value(n_occ) n_occ FROM {name}_ev JOIN {name}_n USING ({key}, doc_id) GROUP BY {key}, doc_id HAVING span IS NOT NULL)"""


def lower_pieces(spark: SparkSession, at) -> tuple[DataFrame, DataFrame]:
    """The pieces of :data:`KEYWORDS` over a lower-cased index, and their alternatives."""
    from lexmill.operators import build
    from lexmill.plans.shared import cut, if_small

    given = cut(build.keywords_with_aspects(keywords(spark).where("role <> 'verb'")), "keywords")
    asked = given.select(F.explode(F.split(F.lower("keyword"), " ")).alias("tok")).distinct()
    known = cut(at.words.select("tok").join(if_small(asked), "tok", "left_semi"), "known-words")
    p, alts = build.pieces(given, known, F.lower("w"))
    return cut(p, "pieces"), cut(alts, "alts")


#: Words of a piece at most, as a bound of the SQL's windows only.
_SQL_CLAUSES = 10

#: The keywords of all topics (``kw``): those of the last expansion of each; the SQL of their pieces is as that of :data:`KEYWORDS`, but a piece is
#: its sorted different words, so that it is the same for all topics that ask for it; ``pt(qid, piece, role, aspect_ix, n)`` has each once a topic.
SQL_TOPIC_KEYWORDS = rf"""ex AS (SELECT qid, key_entities, associated_terms, verbs FROM (SELECT DISTINCT expansion_id, qid, created, key_entities, associated_terms, verbs FROM api_expansions WHERE qid IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY created DESC, expansion_id DESC) = 1),
    ek AS (SELECT qid, e.key aspect, e.value l FROM (SELECT qid, unnest(map_entries(key_entities)) e FROM ex)), ev AS (SELECT qid, e.key aspect, e.value l FROM (SELECT qid, unnest(map_entries(verbs)) e FROM ex)),
    k0 AS (SELECT qid, 'key' AS role, aspect, unnest(l) keyword FROM ek UNION ALL SELECT qid, 'assoc', '', unnest(associated_terms) FROM ex UNION ALL SELECT qid, 'verb', aspect, unnest(l) FROM ev),
    kw AS (SELECT DISTINCT qid, role, aspect, trim(regexp_replace(keyword, '{SPACE}', ' ', 'g'), ' ') keyword FROM k0 WHERE trim(regexp_replace(keyword, '{SPACE}', ' ', 'g'), ' ') <> '')"""
SQL_TOPIC_PIECES = rf"""{SQL_TOPIC_KEYWORDS},
    named AS (SELECT qid, role, aspect, keyword FROM kw WHERE role <> 'verb' UNION SELECT qid, 'key', aspect, trim(regexp_replace(aspect, '{SPACE}', ' ', 'g'), ' ') FROM kw WHERE role = 'key'),
    ixd AS (SELECT *, CASE WHEN role = 'key' THEN dense_rank() OVER (PARTITION BY qid, role ORDER BY aspect) - 1 END aspect_ix FROM named WHERE keyword <> ''),
    cw AS (SELECT *, string_split(keyword, ' ') rw, list_filter(string_split(keyword, ' '), lambda x: length(x) > 1 AND NOT list_contains({stop_list()}, lower(x))) ws FROM ixd),
    ok AS (SELECT *, list_sort(list_distinct(list_transform(ws, lambda x: lower(x)))) lw FROM cw WHERE len(ws) > 0 AND NOT (len(rw) > 1 AND len(ws) <= 1)),
    okp AS (SELECT qid, role, aspect, aspect_ix, keyword, lw, list_aggregate(lw, 'string_agg', ' ') piece, len(lw) n FROM ok),
    pw0 AS (SELECT DISTINCT piece, n, unnest(lw) word, generate_subscripts(lw, 1) - 1 clause FROM okp),
    pdt AS MATERIALIZED (SELECT DISTINCT tok, doc_id FROM tok), alive AS (SELECT piece FROM pw0 LEFT JOIN (SELECT DISTINCT tok FROM pdt) v ON v.tok = pw0.word GROUP BY piece HAVING bool_and(v.tok IS NOT NULL)),
    pc AS (SELECT qid, role, aspect, aspect_ix, keyword, piece, n FROM okp JOIN alive USING (piece)), pw AS (SELECT piece, n, clause, word FROM pw0 JOIN alive USING (piece)),
    pt AS (SELECT qid, piece, CASE WHEN bool_or(role = 'key') THEN 'key' ELSE 'assoc' END AS role, min(aspect_ix) aspect_ix, any_value(n) n FROM pc GROUP BY qid, piece)"""


def sql_sets(sets: str, key: str, name: str) -> str:
    """``name(key, doc_id, span, n_occ)`` of queries ``sets(key, n, clause, word)`` for all words of a set."""
    return f"""{name}_d AS (SELECT {key}, n, doc_id FROM {sets} JOIN pdt ON pdt.tok = word GROUP BY {key}, n, doc_id HAVING count(*) = n),
    {name}_h AS (SELECT d.{key}, d.n, s.clause, d.doc_id, tok.pos FROM {name}_d d JOIN {sets} s ON s.{key} = d.{key} JOIN tok ON tok.tok = s.word AND tok.doc_id = d.doc_id),
    {sql_spans(f"{name}_h", key, _SQL_CLAUSES, name)}"""


def topic_keywords(spark: SparkSession, d: str) -> DataFrame:
    """``qid, role, aspect, keyword`` of the last expansion of each topic, blanks tidied, each once; roles key, assoc, verb."""
    from lexmill.functions.nested import expansion_terms
    from lexmill.sources.readers import first_per_group

    last = first_per_group(table(spark, d, "api_expansions").where("qid IS NOT NULL"), ["qid"], [F.col("created").desc_nulls_last(), F.col("expansion_id").desc_nulls_last()], 1)
    each = last.select("qid", F.explode(expansion_terms(F.col("key_entities"), F.col("associated_terms"), F.col("verbs"))).alias("k"))
    return each.select("qid", "k.role", "k.aspect", F.trim(F.regexp_replace("k.keyword", SPACE, " ")).alias("keyword")).where("keyword <> ''").distinct()


_INDEXES: dict[tuple[str, str], object] = {}


def index_for(spark: SparkSession, d: str):
    """The written index of ``documents``; written once for each session and folder, as all Boolean and ranking queries read it."""
    from lexmill.operators import index
    from lexmill.plans.shared import fresh_path, still_there

    key = (spark.sparkContext.applicationId, d)
    path = _INDEXES.get(key)
    if path is None or not still_there(spark, path):
        path = fresh_path(spark, "index")
        index.build_index(table(spark, d, "documents"), path)
        _INDEXES[key] = path
    return index.read_index(spark, path)
