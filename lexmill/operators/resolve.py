"""From hits to documents: pools, provenance and a first score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.numbers import term_weight
from lexmill.plans.shared import if_small


def pool(matched: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, doc_id, from_queries``: each topic's different documents, with the sorted numbers of the queries that found them.

    ``queries`` has ``qid, query_id, query_ix``.
    """
    return matched.select("query_id", "doc_id").join(queries, "query_id").groupBy("qid", "doc_id").agg(F.sort_array(F.collect_set("query_ix")).alias("from_queries"))


def resolved(pooled: DataFrame, docs: DataFrame, most_words: int | None = None) -> DataFrame:
    """The pool with each document's text; with ``most_words`` its words are cut to so many, as for display."""
    joined = pooled.join(docs, "doc_id")
    return joined if most_words is None else joined.withColumn("tokens", F.slice("ws", 1, most_words))


def term_hits(documents: DataFrame, phrases: DataFrame) -> DataFrame:
    """``qid, doc_id, term``: the terms all of whose words a document holds, in whatever order.

    ``phrases`` has ``qid, term``. Only the words of terms are looked up, and counted before they are exchanged.
    """
    each = phrases.select("term").distinct().select("term", F.array_distinct(F.split("term", " ")).alias("w")).select("term", F.size("w").alias("n"), F.explode("w").alias("tok"))
    seen = documents.select("doc_id", F.explode(F.array_distinct("ws")).alias("tok")).join(if_small(each), "tok")
    full = seen.groupBy("term", "doc_id").agg(F.count("*").alias("c"), F.first("n").alias("n")).where("c = n")
    return full.select("term", "doc_id").join(phrases, "term").select("qid", "doc_id", "term")


def crude_scores(pooled: DataFrame, hits: DataFrame, weights: DataFrame, n: int | None = None) -> DataFrame:
    """``qid, doc_id, score``: the sum of the weights of a document's terms, 0 for none; the ``n`` best of each topic if given.

    ``weights`` has ``qid, term, n_docs`` for keywords and may have ``sparse`` for terms that are only weighted; a
    keyword's weight falls with its count and wins over a sparse one.
    """
    w = F.when(F.col("n_docs").isNotNull(), term_weight(F.col("n_docs"))).otherwise(F.coalesce("sparse", F.lit(0.0)) if "sparse" in weights.columns else F.lit(0.0))
    scored = hits.join(weights.withColumn("w", w), ["qid", "term"]).groupBy("qid", "doc_id").agg(F.sum("w").alias("score"))
    all_ = pooled.join(scored, ["qid", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if n is None:
        return all_
    return all_.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("doc_id")))).where(F.col("rank") <= n)


def merged_answers(answers: DataFrame) -> DataFrame:
    """``doc_id, text, queries``: documents of several answers, blocked ones dropped, the first seen kept, with all queries that gave them.

    ``answers`` has ``seq, query, doc_id, text, blocked``.
    """
    open_ = answers.where(~F.coalesce("blocked", F.lit(False)))
    return open_.groupBy("doc_id").agg(F.min_by("text", "seq").alias("text"), F.transform(F.array_sort(F.collect_set(F.struct("seq", "query"))), lambda x: x["query"]).alias("queries"))


def once(docs: DataFrame, keys: list[str], order: str, merge: str | None = None) -> DataFrame:
    """The first row of each document; with ``merge`` the union of that array over its rows."""
    rest = [c for c in docs.columns if c not in keys and c != merge]
    aggs = [F.min_by(F.struct(*rest), order).alias("__f")] + ([F.array_sort(F.array_distinct(F.flatten(F.collect_list(merge)))).alias(merge)] if merge else [])
    out = docs.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[F.col(f"__f.`{c}`").alias(c) for c in rest], *([merge] if merge else []))
