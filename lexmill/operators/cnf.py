"""Boolean queries: a query is an AND of clauses, a clause an OR of phrases, within a bound of proximity.

All queries of a job are evaluated together. Their different phrases are looked up once in one pass over the
documents; clauses are then put together from phrases, and queries from clauses.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators.index import Index, positions, positions_of, postings_of
from lexmill.plans.shared import cut, if_small, sized_broadcast

#: A query's clauses, each a list of phrases, each a list of words.
Cnf = Sequence[Sequence[Sequence[str]]]
ALTS = "query_id string, clause int, phrase string, n_clauses int"


def alternatives(spark: SparkSession, queries: Mapping[str, Cnf]) -> DataFrame:
    """``query_id, clause, phrase, n_clauses``: a row for each alternative of each clause; phrases are joined by blanks."""
    rows = [(q, k, " ".join(p), len(cnf)) for q, cnf in queries.items() for k, clause in enumerate(cnf) for p in clause]
    return spark.createDataFrame(rows, ALTS).distinct()


def canonical(cnf: Cnf) -> tuple:
    """A key that is equal for queries that differ only in the order of clauses and alternatives."""
    return tuple(sorted({tuple(sorted({tuple(p) for p in clause})) for clause in cnf}))


def phrase_hits(documents: DataFrame | None, phrases: DataFrame, at: Index | None = None) -> DataFrame:
    """``phrase, doc_id, pos, length`` of every occurrence of every phrase; ``phrases`` has a column ``phrase``.

    A document's words meet the phrases' words by a join; a phrase begins where all its words meet at one start. The
    words of a document stay together up to that count, so they are added up before any exchange.
    """
    wanted = _phrase_words(phrases)
    there = positions(documents) if at is None else positions_of(at, wanted)
    return _starts(there.join(if_small(wanted), "tok"))


def _phrase_words(phrases: DataFrame) -> DataFrame:
    each = phrases.select("phrase").distinct().where("phrase <> ''").select("phrase", F.split("phrase", " ").alias("w"))
    return each.select("phrase", F.size("w").alias("length"), F.posexplode("w").alias("off", "tok"))


def _starts(met: DataFrame) -> DataFrame:
    starts = met.groupBy("phrase", "doc_id", (F.col("pos") - F.col("off")).alias("pos"), "length").agg(F.count("*").alias("c"))
    return starts.where("c = length").select("phrase", "doc_id", "pos", "length")


def clause_hits(documents: DataFrame | None, alts: DataFrame, at: Index | None = None) -> DataFrame:
    """``query_id, n_clauses, clause, doc_id, pos, length``: the hits of each clause.

    With ``at``, a written index, the documents themselves are not read, and of the index only the words that are asked for.
    """
    few, small = sized_broadcast(alts)
    wanted = _phrase_words(alts)  # no more phrases than alternatives
    there = positions(documents) if at is None else positions_of(at, wanted)
    hits = _starts(there.join(F.broadcast(wanted) if small else wanted, "tok"))
    return hits.join(few, "phrase").select("query_id", "n_clauses", "clause", "doc_id", "pos", "length").distinct()


def spans(hits: DataFrame, most_clauses: int, ends: bool = False, whole: bool = False) -> DataFrame:
    """``query_id, doc_id, span, n_occ`` of the documents in which every clause of a query has a hit.

    ``span`` is the smallest distance of the first and the last start of one hit for each clause (with ``ends``, from
    the first start to the last end); 0 for a single clause. ``n_occ`` are the hits of the rarest clause.

    Going through a document's hits in order, the last hit of each clause so far makes the smallest span that ends
    at the current hit: one running window instead of a loop with two pointers. ``whole`` says that ``hits`` has only documents
    with a hit of every clause.
    """
    of = Window.partitionBy("query_id", "doc_id")
    seen = hits if whole else hits.withColumn("there", F.size(F.collect_set("clause").over(of))).where("there = n_clauses")
    running = of.orderBy("pos", "clause", "length").rowsBetween(Window.unboundedPreceding, 0)
    last = seen
    for i in range(most_clauses):
        mine = F.when(F.col("clause") == i, F.struct("pos", (F.col("pos") + F.col("length") - 1).alias("end")))
        last = last.withColumn(f"l{i}", F.last(mine, ignorenulls=True).over(running))
    none = F.struct("pos", (F.col("pos") + F.col("length") - 1).alias("end"))
    all_there, starts, stops = F.lit(True), [], []
    for i in range(most_clauses):
        used = F.col("n_clauses") > i
        all_there = all_there & (~used | F.col(f"l{i}").isNotNull())
        starts.append(F.when(used, F.col(f"l{i}")["pos"]).otherwise(none["pos"]))
        stops.append(F.when(used, F.col(f"l{i}")["end"]).otherwise(none["end"]))
    low = F.least(*starts) if most_clauses > 1 else starts[0]
    high = (F.greatest(*stops) if most_clauses > 1 else stops[0]) if ends else F.col("pos")
    span = F.when(F.col("n_clauses") == 1, F.lit(0)).otherwise(F.when(all_there, high - low))
    per = last.withColumn("span", span).groupBy("query_id", "doc_id", "clause").agg(F.min("span").alias("span"), F.count("*").alias("n"))
    return per.groupBy("query_id", "doc_id").agg(F.min("span").cast("long").alias("span"), F.min("n").alias("n_occ"))


def most_clauses(alts: DataFrame) -> int:
    return alts.agg(F.max("n_clauses")).first()[0] or 1


def matches(documents: DataFrame | None, alts: DataFrame, within: int | None = None, at: Index | None = None) -> DataFrame:
    """``query_id, doc_id, span, n_occ`` of each query's documents, with a span of at most ``within`` words if given."""
    found = spans(clause_hits(documents, alts, at), most_clauses(alts))
    return found if within is None else found.where(F.col("span") <= within)


def word_sets(named: DataFrame, name: str, words: str) -> DataFrame:
    """``query_id, n_clauses, clause, tok``: queries that ask for all words of an array, each word a clause."""
    return named.select(F.col(name).alias("query_id"), F.size(words).alias("n_clauses"), F.posexplode(words).alias("clause", "tok")).distinct()


def set_documents(at: Index, sets: DataFrame) -> DataFrame:
    """``query_id, n_clauses, doc_id, at`` of the documents that hold all words of a query; ``at`` has ``clause, ps`` of each word.

    The documents of a query's rarest word are looked up first; only for those the other words are asked, so that a common
    word beside a rare one costs no more than the rare one has documents. A word that is asked by many queries is looked up once.
    """
    known = cut(sets.join(at.words.select("tok", "df"), "tok", "left"), "set-words")
    w = Window.partitionBy("query_id")
    ordered = known.withColumn("dead", F.max(F.col("df").isNull()).over(w)).where("NOT dead").withColumn("r", F.row_number().over(w.orderBy("df", "clause"))).drop("dead", "df")
    ordered = cut(ordered, "set-order")
    held = postings_of(at, ordered)
    first, rest = ordered.where("r = 1").drop("r"), ordered.where("r > 1").drop("r")
    found = held.join(if_small(first), "tok").select("query_id", "n_clauses", "doc_id", F.struct("clause", "ps").alias("x"))
    more = found.where("n_clauses > 1").select("query_id", "doc_id").join(if_small(rest), "query_id").join(held, ["tok", "doc_id"]).select("query_id", "n_clauses", "doc_id", F.struct("clause", "ps").alias("x"))
    several = found.where("n_clauses > 1").unionByName(more).groupBy("query_id", "n_clauses", "doc_id").agg(F.collect_list("x").alias("at")).where(F.size("at") == F.col("n_clauses"))
    return found.where("n_clauses = 1").select("query_id", "n_clauses", "doc_id", F.array("x").alias("at")).unionByName(several)


def set_matches(at: Index, sets: DataFrame) -> DataFrame:
    """``query_id, doc_id, span, n_occ`` as :func:`matches`, for queries that are sets of words (:func:`word_sets`)."""
    found = cut(set_documents(at, sets), "set-documents")
    fewest = F.array_min(F.transform("at", lambda x: F.size(x["ps"]))).cast("long")
    ways = F.aggregate("at", F.lit(1).cast("long"), lambda a, x: F.least(a * F.size(x["ps"]), F.lit(_WAYS + 1).cast("long")))
    marked = found.withColumn("few", (F.col("n_clauses") <= len(_SPANS)) & (ways <= _WAYS))
    # where the words' places can be put together in a few ways, all are tried in the row; else they go through the running window
    span = F.lit(0)
    for n, of in _SPANS.items():
        span = F.when(F.col("n_clauses") == n, of(lambda i: F.col("at")[i]["ps"])).otherwise(span)
    tried = marked.where("few").select("query_id", "doc_id", span.cast("long").alias("span"), fewest.alias("n_occ"))
    many = marked.where("NOT few")
    hits = many.select("query_id", "n_clauses", "doc_id", F.explode("at").alias("x")).select("query_id", "n_clauses", "x.clause", "doc_id", F.explode("x.ps").alias("pos")).withColumn("length", F.lit(1))
    most = many.agg(F.max("n_clauses")).first()[0] or 1
    return tried.unionByName(spans(hits, most, whole=True))


#: Ways to choose a place for each word up to which all are tried.
_WAYS = 600
#: The smallest distance of the first and the last place, by number of words; ``of(i)`` are the places of word ``i``.
_SPANS = {
    1: lambda of: F.lit(0),
    2: lambda of: F.array_min(F.flatten(F.transform(of(0), lambda x: F.transform(of(1), lambda y: F.abs(x - y))))),
    3: lambda of: F.array_min(F.flatten(F.transform(of(0), lambda x: F.flatten(F.transform(of(1), lambda y: F.transform(of(2), lambda z: F.greatest(x, y, z) - F.least(x, y, z))))))),
}


def counts(matched: DataFrame, alts: DataFrame, bounds: Sequence[int]) -> DataFrame:
    """``query_id, within, n_docs, n_occ`` for each query and bound; 0 where nothing matches."""
    asked = alts.select("query_id").distinct().select("query_id", F.explode(F.array(*[F.lit(b) for b in bounds])).alias("within"))
    hit = F.col("span") <= F.col("within")
    return asked.join(matched, "query_id", "left").groupBy("query_id", "within").agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("n_docs"), F.coalesce(F.sum(F.when(hit, F.col("n_occ"))), F.lit(0)).alias("n_occ"))


def combined_hits(hits: DataFrame, groups: DataFrame, members: Sequence[str]) -> DataFrame:
    """Hits of queries made of pieces: ``groups`` has ``query_id`` and the piece columns ``members``.

    Pieces are matched to documents once; only documents that have all pieces of a group go on to its span. That
    takes the place of one count for each pair or triple. Clauses of later pieces are numbered after those before.
    """
    per = hits.groupBy("query_id", "doc_id", "n_clauses").agg(F.count_distinct("clause").alias("c")).where("c = n_clauses").select(F.col("query_id").alias("piece"), "doc_id", "n_clauses")
    asked = if_small(groups)
    first, rest = members[0], members[1:]
    both = per.select(F.col("piece").alias(first), "doc_id", F.col("n_clauses").alias(f"n_{first}")).join(asked, first)
    for m in rest:
        both = both.join(per.select(F.col("piece").alias(m), "doc_id", F.col("n_clauses").alias(f"n_{m}")), [m, "doc_id"])
    total = sum((F.col(f"n_{m}") for m in rest), F.col(f"n_{first}"))
    parts, before = [], F.lit(0)
    for m in members:
        parts.append(F.struct(F.col(m).alias("piece"), before.alias("before")))
        before = before + F.col(f"n_{m}")
    each = both.select(F.col("query_id").alias("g"), "doc_id", total.alias("n"), F.explode(F.array(*parts)).alias("m"))
    each = each.select("g", "doc_id", "n", F.col("m.piece").alias("query_id"), F.col("m.before").alias("before"))
    return each.join(hits, ["query_id", "doc_id"]).select(F.col("g").alias("query_id"), F.col("n").alias("n_clauses"), (F.col("clause") + F.col("before")).alias("clause"), "doc_id", "pos", "length")


def group_spans(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """``qid, query_id, doc_id, span`` of queries made of any number of pieces; ``groups`` has ``qid, query_id, members``.

    Documents that hold the same pieces of a topic answer the same queries, so queries meet sets of pieces, each set once,
    and only then documents. ``query_id`` is that of one topic.
    """
    per = hits.groupBy("query_id", "doc_id", "n_clauses").agg(F.count_distinct("clause").alias("c")).where("c = n_clauses").select(F.col("query_id").alias("piece"), "doc_id", "n_clauses")
    sizes = per.select("piece", "n_clauses").distinct()
    each = groups.select("qid", "query_id", F.explode("members").alias("piece"))
    of = Window.partitionBy("qid", "query_id")
    n, before = F.sum("n_clauses").over(of), F.sum("n_clauses").over(of.orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_clauses")
    parts = cut(each.join(sizes, "piece").select("qid", "query_id", "piece", n.cast("int").alias("n"), before.cast("int").alias("before")), "parts")
    held = cut(per.join(if_small(each.select("qid", "piece").distinct()), "piece").groupBy("qid", "doc_id").agg(F.sort_array(F.collect_set("piece")).alias("held")), "held")
    sets = held.select("qid", "held").distinct().select("qid", "held", F.explode("held").alias("first"))
    met = sets.join(groups.select("qid", "query_id", "members", F.col("members")[0].alias("first")), ["qid", "first"]).where(F.size(F.array_except("members", "held")) == 0)
    found = held.join(if_small(cut(met.select("qid", "held", "query_id"), "met")), ["qid", "held"]).select("qid", "query_id", "doc_id")
    at = found.join(if_small(parts), ["qid", "query_id"]).join(hits.select(F.col("query_id").alias("piece"), "doc_id", "clause", "pos", "length"), ["piece", "doc_id"])
    made = at.select(F.struct("qid", "query_id").alias("query_id"), F.col("n").alias("n_clauses"), (F.col("clause") + F.col("before")).alias("clause"), "doc_id", "pos", "length")
    most = parts.agg(F.max("n")).first()[0] or 1
    return spans(made, most).select("query_id.qid", "query_id.query_id", "doc_id", "span")


def pairs_of(pieces: DataFrame) -> DataFrame:
    """``query_id, a, b``: pieces of different aspects of a topic, and key pieces with associated ones.

    ``pieces`` has ``qid, piece, role, aspect_ix``. The join is on the topic; pairs are formed once.
    """
    a = pieces.select("qid", F.col("piece").alias("a"), F.col("role").alias("ra"), F.col("aspect_ix").alias("ia"))
    b = pieces.select("qid", F.col("piece").alias("b"), F.col("role").alias("rb"), F.col("aspect_ix").alias("ib"))
    kk = (F.col("ra") == "key") & (F.col("rb") == "key") & (F.col("ia") < F.col("ib"))
    ka = (F.col("ra") == "key") & (F.col("rb") == "assoc")
    return a.join(b, "qid").where(kk | ka).select("qid", F.concat_ws(" + ", "a", "b").alias("query_id"), "a", "b", F.when(kk, "key-key").otherwise("key-assoc").alias("kind"))
