"""Building queries from keywords, clusters and links.

Where a builder's next query depends on a count, all counts it could ask for are made beforehand, together; the
decision is then a join.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import SPACE, STOPWORDS, case_variants, content_words, is_usable_keyword, phrase_variants, prefix_stems, raw_words, stopword_chunks
from lexmill.plans.shared import cut, if_small, sized_broadcast


def keywords_with_aspects(keywords: DataFrame) -> DataFrame:
    """``qid, role, aspect, aspect_ix, keyword``: the given ones and each key aspect's own name, each once, blanks trimmed.

    ``aspect_ix`` counts the key aspects of a topic by name; for others it is null.
    """
    tidy = keywords.select("qid", "role", F.coalesce("aspect", F.lit("")).alias("aspect"), F.trim(F.regexp_replace("keyword", SPACE, " ")).alias("keyword"))
    own = F.when(F.col("role") == "key", F.trim(F.regexp_replace("aspect", SPACE, " ")))
    # in one pass, so that keywords are made once and stay where their topic is
    all_ = tidy.select("qid", "role", "aspect", F.explode(F.array("keyword", own)).alias("keyword")).where("keyword <> ''").distinct()
    key = F.when(F.col("role") == "key", F.dense_rank().over(Window.partitionBy("qid", "role").orderBy("aspect")) - 1)
    return all_.select("qid", "role", "aspect", key.alias("aspect_ix"), "keyword")


def pieces(keywords: DataFrame, vocab: DataFrame, variants: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``pieces(qid, piece, role, aspect, aspect_ix, keyword, n_words)`` and ``alts(query_id, clause, phrase, n_clauses)``.

    Each content word of a keyword makes a clause of its case variants that occur; a word none of whose variants does
    drops the whole piece, and so does a keyword of several words of which one or none has content. ``vocab`` has
    ``tok``; over a lower-cased index ``variants`` (a column of the word ``w``) may be just the lower-cased word.
    """
    asked = keywords.where(is_usable_keyword(F.col("keyword"))).withColumn("piece", F.concat_ws(": ", "qid", "keyword"))
    each = asked.select("qid", "piece", "role", "aspect", "aspect_ix", "keyword", content_words(F.col("keyword")).alias("ws"))
    words = each.select("piece", F.size("ws").alias("n_words"), F.posexplode("ws").alias("clause", "w")).distinct()
    forms = words.select("piece", "n_words", "clause", F.explode(case_variants(F.col("w")) if variants is None else F.array(variants)).alias("tok"))
    found = forms.join(vocab.select("tok"), "tok", "left_semi")
    whole = found.groupBy("piece", "n_words").agg(F.count_distinct("clause").alias("c")).where("c = n_words").select("piece", "n_words")
    kept = each.select("qid", "piece", "role", "aspect", "aspect_ix", "keyword").join(whole, "piece")
    alts = found.join(whole.select("piece"), "piece", "left_semi").select(F.col("piece").alias("query_id"), "clause", F.col("tok").alias("phrase"), F.col("n_words").cast("int").alias("n_clauses")).distinct()
    return kept, alts


def _lower_words() -> Column:
    return F.array_sort(F.array_distinct(F.transform(content_words(F.col("keyword")), lambda w: F.lower(w))))


def keyword_words(keywords: DataFrame) -> DataFrame:
    """``qid, role, aspect, aspect_ix, keyword, piece, ws``: keywords as sets of their content words over a lower-cased index.

    ``piece`` is the sorted different words, joined, the same for all topics and keywords that ask for them; ``ws`` the array of
    them. Dropped are keywords of several words of which one or none has content.
    """
    asked = keywords.where(is_usable_keyword(F.col("keyword")))
    return asked.select("qid", "role", "aspect", "aspect_ix", "keyword", _lower_words().alias("ws")).withColumn("piece", F.array_join("ws", " "))


def asked_words(worded: DataFrame) -> DataFrame:
    """``tok``: the words of all pieces of :func:`keyword_words`, each once."""
    return worded.select(F.explode("ws").alias("tok")).distinct()


def word_pieces(worded: DataFrame, asked: DataFrame, words: DataFrame) -> DataFrame:
    """The rows of :func:`keyword_words` whose words all occur.

    ``asked`` has ``tok`` of all their words, ``words`` of those that occur (both written tables). The pieces that are dropped are the
    fewer ones, so that the others aren't exchanged where these can be broadcast.
    """
    absent = cut(asked.join(if_small(words.select("tok")), "tok", "left_anti"), "absent-words")
    dead = worded.select("piece", F.explode("ws").alias("tok")).join(if_small(absent), "tok", "left_semi").select("piece").distinct()
    dead, small = sized_broadcast(cut(dead, "absent-pieces"))
    whole = worded.join(dead, "piece", "left_anti")
    return whole if small else cut(whole, "pieces")


def peeked_terms(terms: DataFrame, vocab: DataFrame, matched: DataFrame) -> DataFrame:
    """``term, n_words, count, invalid_word``: every term, valid or not.

    A single word counts all occurrences of its case variants, several words the documents in ``matched``
    (``query_id`` = term). ``invalid_word`` is the first word that doesn't occur.
    """
    each = terms.select("term", content_words(F.col("term")).alias("ws")).select("term", F.size("ws").alias("n_words"), F.posexplode_outer("ws").alias("at", "w"))
    forms = each.select("term", "n_words", "at", "w", F.explode_outer(case_variants(F.col("w"))).alias("tok")).join(vocab.select("tok", "tf"), "tok", "left")
    per = forms.groupBy("term", "n_words", "at", "w").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tf"))
    out = per.groupBy("term", "n_words").agg(F.sum("tf").alias("tf"), F.min_by(F.when(F.col("tf") == 0, F.col("w")), F.when(F.col("tf") == 0, F.col("at"))).alias("invalid_word"))
    docs = matched.groupBy(F.col("query_id").alias("term")).agg(F.count("*").alias("docs"))
    count = F.when(F.col("invalid_word").isNotNull(), 0).when(F.col("n_words") <= 1, F.col("tf")).otherwise(F.coalesce("docs", F.lit(0)))
    return out.join(docs, "term", "left").select("term", "n_words", count.cast("long").alias("count"), "invalid_word")


def tidy_keywords(keywords: DataFrame, key: str = "qid", term: str = "keyword", order: str = "ord", least: int = 3) -> DataFrame:
    """Trimmed, of at least ``least`` characters, the first of those that differ only in case; ``place`` from the longest, else as given."""
    rows = keywords.withColumn(term, F.trim(term)).where(F.length(term) >= least)
    first = rows.groupBy(key, F.lower(term).alias("__l")).agg(F.min_by(term, order).alias(term), F.min(order).alias(order))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.length(term)), order))).select(key, term, order, "place")


def cascade_forms(terms: DataFrame) -> DataFrame:
    """``term, level, query_id, clause, phrase, n_clauses``: what has to be counted to validate each term.

    Level 1 asks for the phrase in its variants, level 2 for its runs between stopwords together, level 3 for its
    content words together.
    """
    stop = F.array(*[F.lit(s) for s in STOPWORDS])
    one = terms.select("term", F.lit(1).alias("level"), F.array(phrase_variants(F.col("term"))).alias("clauses"))
    chunks = F.transform(stopword_chunks(F.col("term")), lambda c: F.array(c))
    two = terms.select("term", F.lit(2).alias("level"), chunks.alias("clauses"))
    single = F.transform(F.filter(raw_words(F.col("term")), lambda w: ~F.array_contains(stop, F.lower(w)) & (F.length(w) > 1)), lambda w: F.array(w))
    three = terms.select("term", F.lit(3).alias("level"), single.alias("clauses"))
    all_ = one.unionByName(two).unionByName(three).where(F.size("clauses") > 0)
    each = all_.select("term", "level", F.size("clauses").alias("n_clauses"), F.posexplode("clauses").alias("clause", "alts"))
    return each.select("term", "level", F.concat_ws("/", F.col("level").cast("string"), "term").alias("query_id"), "clause", F.explode("alts").alias("phrase"), "n_clauses")


def validated(forms: DataFrame, n_docs: DataFrame, most_standalone: int, most: int | None = None) -> DataFrame:
    """``term, level, count, standalone``: each term at its first level with documents, the rarest first by ``place``.

    ``n_docs`` has ``query_id, n_docs``. The phrase itself stands alone up to ``most_standalone``; together runs must be
    within it, and stand alone only if one of them has several words; single words never do. Terms above ``most`` are
    left out.
    """
    shapes = forms.groupBy("term", "level", "query_id").agg(F.max(F.size(F.split("phrase", " "))).alias("longest"))
    met = shapes.join(n_docs, "query_id").where("n_docs > 0").where((F.col("level") == 1) | (F.col("n_docs") <= most_standalone))
    best = met.groupBy("term").agg(F.min_by(F.struct("level", "n_docs", "longest"), "level").alias("b"))
    alone = F.when(F.col("b.level") == 1, F.col("b.n_docs") <= most_standalone).when(F.col("b.level") == 2, F.col("b.longest") > 1).otherwise(F.lit(False))
    out = best.select("term", F.col("b.level").alias("level"), F.col("b.n_docs").alias("count"), alone.alias("standalone"))
    return out if most is None else out.where(F.col("count") <= most)


def stem_candidates(tokens: DataFrame, least: int = 5, key: str = "qid", token: str = "token") -> DataFrame:
    """``qid, stem, n`` of the beginnings that at least two different tokens of a topic share."""
    each = tokens.select(key, F.lower(F.ltrim(F.col(token), F.lit("#"))).alias("w")).distinct()
    return each.select(key, F.explode(prefix_stems(F.col("w"), least)).alias("stem")).groupBy(key, "stem").agg(F.count("*").alias("n")).where("n >= 2")


def cluster_tokens(tokens: DataFrame, least: int = 5) -> DataFrame:
    """``qid, cluster, stem, token, score, max_score``: tokens that share a beginning, and single ones.

    ``tokens`` has ``qid, ord, token, score``. Stems are tried from the one with most tokens, then the longest, then
    the first to occur, and take the tokens not yet taken if these are two or more. Clusters are numbered from the
    highest score. A stem's tokens depend on all before it, so a topic's tokens, a query's expansion, meet in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").drop_duplicates("token")
        qid = pdf["qid"].iloc[0]
        score = dict(zip(pdf["token"], pdf["score"]))
        stems: dict[str, list[str]] = {}
        for t in score:
            w = t.lstrip("#").lower()
            for n in range(least, len(w) + 1):
                stems.setdefault(w[:n], []).append(t)
        order = {s: i for i, s in enumerate(stems)}
        free, made = dict.fromkeys(score), []
        for s in sorted((s for s, ts in stems.items() if len(ts) > 1), key=lambda s: (-len(stems[s]), -len(s), order[s])):
            ts = [t for t in stems[s] if t in free]
            if len(ts) > 1:
                made.append((s, ts))
                for t in ts:
                    del free[t]
        made += [(t.lstrip("#").lower(), [t]) for t in free]
        made.sort(key=lambda c: -max(score[t] for t in c[1]))
        rows = [(qid, i, s, t, score[t], max(score[x] for x in ts)) for i, (s, ts) in enumerate(made) for t in ts]
        return pd.DataFrame(rows, columns=["qid", "cluster", "stem", "token", "score", "max_score"])

    return tokens.select("qid", "ord", "token", F.col("score").cast("double").alias("score")).groupBy("qid").applyInPandas(run, "qid string, cluster int, stem string, token string, score double, max_score double")


def cluster_clauses(clustered: DataFrame) -> DataFrame:
    """``qid, cluster, stem, clause, max_score``: a cluster's tokens as alternatives, the highest score first."""
    return clustered.groupBy("qid", "cluster", "stem").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "token"))), lambda x: F.ltrim(x["token"], F.lit("#"))).alias("clause"), F.max("score").alias("max_score"))


def link_units(links: DataFrame) -> DataFrame:
    """``qid, unit, cluster``: clusters joined by links.

    ``links`` has ``qid, ord, a, b``. A link joins the first unit that already has one of its ends; units are not joined
    with each other later, so the order of links matters, and a topic's links meet in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        qid, units = pdf["qid"].iloc[0], []
        for a, b in pdf.sort_values("ord")[["a", "b"]].itertuples(index=False):
            home = next((u for u in units if a in u or b in u), None)
            if home is None:
                units.append(home := [])
            home += [x for x in (a, b) if x not in home]
        return pd.DataFrame([(qid, i, c) for i, u in enumerate(units) for c in u], columns=["qid", "unit", "cluster"])

    return links.groupBy("qid").applyInPandas(run, "qid string, unit int, cluster long")


def static_queries(units: DataFrame, mode: str, most: int | None = None, anchor_splade: float = 0.0, anchor_tup: float = 1.0) -> DataFrame:
    """``qid, query_id, units, score``: queries of one unit or of pairs of units, the best first.

    ``units`` has ``qid, unit, score, max_splade, min_tup``. An anchor has a high weight and a low probability.
    ``anchor`` asks for each anchor alone, ``anchor_plus_common`` for an anchor with any other unit, ``all_pairs`` for all
    pairs. The score of a pair is the product of its units'.
    """
    marked = units.withColumn("anchor", (F.col("max_splade") >= anchor_splade) & (F.col("min_tup") <= anchor_tup))
    if mode == "anchor":
        out = marked.where("anchor").select("qid", F.array("unit").alias("units"), "score")
    else:
        a, b = (marked.select("qid", F.col("unit").alias(x), F.col("score").alias(f"s{x}"), F.col("anchor").alias(f"k{x}")) for x in "ab")
        met = a.join(b, "qid").where("a < b")
        if mode == "anchor_plus_common":
            met = met.where("ka OR kb")
        elif mode != "all_pairs":
            raise ValueError("mode is anchor, anchor_plus_common or all_pairs")
        out = met.select("qid", F.array("a", "b").alias("units"), (F.col("sa") * F.col("sb")).alias("score"))
    out = out.withColumn("query_id", F.concat_ws("+", F.transform("units", lambda u: u.cast("string"))))
    at = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "query_id"))
    out = out.withColumn("place", at)
    return out if most is None else out.where(F.col("place") <= most)


def adaptive_queries(anchors: DataFrame, pair_counts: DataFrame, links: DataFrame, informative: DataFrame, direct_most: int = 10_000, pair_most: int = 20_000) -> DataFrame:
    """``qid, a, b, kind, n_docs, score`` of the queries that each anchor comes to.

    ``anchors`` and ``informative`` have ``qid, cluster, score`` (anchors also ``n_docs``), ``links`` ``qid, ord, a, b``,
    ``pair_counts`` ``qid, a, b, n_docs`` for a < b. An anchor of at most ``direct_most`` documents is asked alone; else with
    the first linked partner that leaves at most ``pair_most``; else with each informative cluster. Then pairs of
    anchors not yet asked together follow. Single and linked queries have the score or its sum, others the product.
    """
    pc = pair_counts.where("n_docs > 0")
    both_ways = pc.select("qid", "a", "b", "n_docs").unionByName(pc.select("qid", F.col("b").alias("a"), F.col("a").alias("b"), "n_docs"))
    lk = links.select("qid", "ord", "a", "b").unionByName(links.select("qid", "ord", F.col("b").alias("a"), F.col("a").alias("b")))
    direct = anchors.where((F.col("n_docs") > 0) & (F.col("n_docs") <= direct_most))
    wide = anchors.where(F.col("n_docs") > direct_most).select("qid", F.col("cluster").alias("a"), F.col("score").alias("sa"))
    scores = anchors.select("qid", "cluster", "score").unionByName(informative.select("qid", "cluster", "score")).groupBy("qid", "cluster").agg(F.max("score").alias("sb"))
    sb = scores.withColumnRenamed("cluster", "b")
    partner = wide.join(lk, ["qid", "a"]).join(both_ways, ["qid", "a", "b"]).where(F.col("n_docs") <= pair_most)
    first = partner.withColumn("__r", F.row_number().over(Window.partitionBy("qid", "a").orderBy("ord", "b"))).where("__r = 1").join(sb, ["qid", "b"], "left")
    alone = wide.join(first.select("qid", "a"), ["qid", "a"], "left_anti")
    each = alone.join(informative.select("qid", F.col("cluster").alias("b"), F.col("score").alias("sb")), "qid").where("a <> b").join(both_ways, ["qid", "a", "b"])
    x = anchors.select("qid", F.col("cluster").alias("a"), F.col("score").alias("sa"))
    y = anchors.select("qid", F.col("cluster").alias("b"), F.col("score").alias("sb"))
    cross = x.join(y, "qid").where("a < b").join(pc, ["qid", "a", "b"]).join(lk.select("qid", "a", "b").distinct(), ["qid", "a", "b"], "left_anti")
    shaped = [
        direct.select("qid", F.col("cluster").alias("a"), F.lit(None).cast("long").alias("b"), F.lit("direct").alias("kind"), "n_docs", "score"),
        first.select("qid", "a", "b", F.lit("linked").alias("kind"), "n_docs", (F.col("sa") + F.coalesce("sb", F.lit(0.0))).alias("score")),
        each.select("qid", "a", "b", F.lit("informative").alias("kind"), "n_docs", (F.col("sa") * F.col("sb")).alias("score")),
        cross.select("qid", "a", "b", F.lit("cross").alias("kind"), "n_docs", (F.col("sa") * F.col("sb")).alias("score")),
    ]
    out = shaped[0]
    for s in shaped[1:]:
        out = out.unionByName(s)
    # the same query under two kinds counts once, under the first
    rank = F.when(F.col("kind") == "direct", 0).when(F.col("kind") == "linked", 1).when(F.col("kind") == "informative", 2).otherwise(3)
    canon = out.withColumn("lo", F.coalesce(F.least("a", "b"), F.col("a"))).withColumn("hi", F.greatest("a", "b"))
    w = Window.partitionBy("qid", "lo", "hi").orderBy(rank, F.desc("score"))
    return canon.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("qid", F.col("lo").alias("a"), F.when(F.col("b").isNotNull(), F.col("hi")).alias("b"), "kind", "n_docs", "score")


def keyword_adaptive_queries(terms: DataFrame, term_docs: DataFrame, most_key: int, most_assoc: int, most: int | None = None) -> DataFrame:
    """``qid, query_id, level, n_docs, score, place``: terms few enough alone, the others together with any key term, and facets together.

    ``terms`` has ``qid, piece, role, facet, n_docs``, ``term_docs`` ``piece, doc_id``. Level 1: a term of at most ``most_key`` documents
    (``most_assoc`` for associated ones); its score is what is left to that bound. Level 2: a wider term AND the OR of all key terms, if at
    most ``most_key`` documents remain, for a score of ``most_key``. Level 3: the OR of a key facet's terms of at most ``most_key`` documents AND that of
    another one, for twice ``most_key``, or AND that of the associated terms, if at most ``most_key`` remain, for ``most_key``. The best first, at
    most ``most``.
    """
    bound = F.when(F.col("role") == "key", most_key).otherwise(most_assoc)
    held = terms.join(term_docs, "piece")
    keys = held.where("role = 'key'").select("qid", "doc_id").distinct()
    wide = held.where(F.col("n_docs") > bound).join(keys, ["qid", "doc_id"], "left_semi").groupBy("qid", "piece").agg(F.count("*").alias("n_docs"))
    facets = held.where(F.col("n_docs") <= most_key).select("qid", "role", "facet", "doc_id").distinct()
    one, two = (facets.select("qid", "doc_id", F.col("facet").alias(f"f{x}"), F.col("role").alias(f"r{x}")) for x in "ab")
    met = one.where("ra = 'key'").join(two, ["qid", "doc_id"]).where("rb = 'assoc' OR fa < fb").groupBy("qid", "fa", "fb", "rb").agg(F.count("*").alias("n_docs"))
    return keyword_adaptive_levels(terms, wide, met, most_key, most_assoc, most)


def keyword_adaptive_levels(terms: DataFrame, wide: DataFrame, met: DataFrame, most_key: int, most_assoc: int, most: int | None = None) -> DataFrame:
    """:func:`keyword_adaptive_queries` from counts: ``wide`` has ``qid, piece, n_docs`` of wider terms with any key term, ``met`` ``qid, fa, fb, rb, n_docs`` of two facets."""
    bound = F.when(F.col("role") == "key", most_key).otherwise(most_assoc)
    alone = terms.where((F.col("n_docs") > 0) & (F.col("n_docs") <= bound)).select("qid", F.col("piece").alias("query_id"), F.lit(1).alias("level"), "n_docs", (bound - F.col("n_docs")).cast("long").alias("score"))
    wide = wide.where(F.col("n_docs") <= most_key)
    second = wide.select("qid", F.concat("piece", F.lit(" AND keys")).alias("query_id"), F.lit(2).alias("level"), "n_docs", F.lit(most_key).cast("long").alias("score"))
    met = met.where((F.col("rb") == "key") | (F.col("n_docs") <= most_key))
    third = met.select("qid", F.concat("fa", F.lit(" x "), "fb").alias("query_id"), F.lit(3).alias("level"), "n_docs", F.when(F.col("rb") == "key", 2 * most_key).otherwise(most_key).cast("long").alias("score"))
    out = alone.unionByName(second).unionByName(third)
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "query_id")))
    return out if most is None else out.where(F.col("place") <= most)


def ceiling_queries(pieces_: DataFrame, modes: Sequence[str] = ("keys_only", "keys_expanded", "full", "2way_and", "3way_and")) -> DataFrame:
    """``mode, query_id, members``: the queries of each ablation, as sets of pieces, without counts.

    ``keys_only`` takes the aspects' names, ``keys_expanded`` all key pieces, ``full`` associated ones too; the others
    combine key pieces of two or three different aspects.
    """
    key = pieces_.where("role = 'key'")
    single = lambda df, mode: df.select("qid", F.lit(mode).alias("mode"), F.array("piece").alias("members")).distinct()
    p = [key.select("qid", F.col("piece").alias(x), F.col("aspect_ix").alias(f"i{x}")) for x in "abc"]
    two = p[0].join(p[1], "qid").where("ia < ib")
    three = two.join(p[2], "qid").where("ib < ic")
    made = {
        "keys_only": lambda: single(key.where(F.lower("keyword") == F.lower("aspect")), "keys_only"),
        "keys_expanded": lambda: single(key, "keys_expanded"),
        "full": lambda: single(pieces_, "full"),
        "2way_and": lambda: two.select("qid", F.lit("2way_and").alias("mode"), F.array("a", "b").alias("members")).distinct(),
        "3way_and": lambda: three.select("qid", F.lit("3way_and").alias("mode"), F.array("a", "b", "c").alias("members")).distinct(),
    }
    out = None
    for m in modes:
        out = made[m]() if out is None else out.unionByName(made[m]())
    return out.withColumn("query_id", F.array_join("members", " + "))
