"""Choosing queries under a budget of documents.

A budget with skips is sequential: each candidate is taken if it still fits. A topic's candidates stream by in their order with one
running total; they are counts and names, never documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_budget(df: DataFrame, key: str, order: Sequence[str], name: str, count: str, budget: Column | int, stop: bool = False, most: int | None = None) -> DataFrame:
    """The rows kept of each ``key``: in order, a row is taken if its ``count`` still fits ``budget``, else skipped.

    With ``stop`` the first row that doesn't fit ends the list; at most ``most`` rows are taken if given. ``budget`` may be a column that
    is constant within a key. Rows with a null count are skipped. ``name`` orders rows that are equal in ``order``. Rows of a key
    stream by in order, and only the running total is held.
    """
    columns = df.columns
    rows = df.where(F.col(count).isNotNull()).withColumn("__budget", (budget if isinstance(budget, Column) else F.lit(budget)).cast("long")).withColumn("__count", F.col(count).cast("long"))
    sorted_ = rows.repartition(key).sortWithinPartitions(key, *order, name)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, n, over, first = None, 0, 0, False, True
        for b in batches:
            flags = []
            for k, c, room in zip(b[key].to_pylist(), b["__count"].to_pylist(), b["__budget"].to_pylist()):
                if first or k != now:
                    now, used, n, over, first = k, 0, 0, False, False
                fits = room is not None and used + c <= room and not (stop and over) and (most is None or n < most)
                over = over or not fits
                used, n = (used + c, n + 1) if fits else (used, n)
                flags.append(fits)
            yield b.filter(pa.array(flags, pa.bool_())).select(columns)

    return sorted_.mapInArrow(keep, df.schema)


def early_stop(df: DataFrame, key: str, order: Sequence[str], count: str, enough: int) -> DataFrame:
    """Queries in order until their counts add up to ``enough``; the one that reaches it is still run."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(count).over(w), F.lit(0))).where(F.col("before") < enough)


def grabbed_alone(counts: DataFrame, key_most: int = 1500, assoc_most: int = 750) -> DataFrame:
    """Phase 1: pieces few enough to be taken alone, by ``role``; the count must be above 0."""
    most = F.when(F.col("role") == "key", key_most).otherwise(assoc_most)
    return counts.withColumn("grabbed", (F.col("n_docs") > 0) & (F.col("n_docs") <= most))


def combos_of_rest(peeked: DataFrame, pair_counts: DataFrame, key_most: int = 1500, most_assoc: int = 50_000) -> DataFrame:
    """Phase 2: the pairs among pieces that weren't taken alone, with a count from 1 to ``key_most``.

    Pairs of keys of different aspects all count; of key and associated pieces, only those with the topic's first
    remaining aspect, and only if the associated piece itself has at most ``most_assoc`` documents.
    """
    rest = peeked.where(~F.col("grabbed") & (F.col("n_docs") > 0))
    first = rest.where("role = 'key'").groupBy("qid").agg(F.min("aspect_ix").alias("first_ix"))
    a = rest.where("role = 'key'").select("qid", F.col("piece").alias("a"), F.col("aspect_ix").alias("ia"), F.col("n_docs").alias("ca"))
    b = rest.select("qid", F.col("piece").alias("b"), F.col("role").alias("rb"), F.col("n_docs").alias("cb"))
    cheap = pair_counts.where((F.col("n_docs") > 0) & (F.col("n_docs") <= key_most))
    met = cheap.join(a, ["qid", "a"]).join(b, ["qid", "b"]).join(first, "qid")
    return met.where((F.col("kind") == "key-key") | ((F.col("ia") == F.col("first_ix")) & (F.col("cb") <= most_assoc))).select("qid", "query_id", "kind", "a", "b", "n_docs")


def peek_and_grab(peeked: DataFrame, combos: DataFrame, budget: int = 20_000, assoc_most: int = 750) -> DataFrame:
    """``qid, query_id, phase, n_docs``: the queries a topic runs, in four phases.

    ``peeked`` (:func:`grabbed_alone`) has ``qid, piece, role, aspect_ix, n_docs, grabbed``; ``combos``
    (:func:`combos_of_rest`) the pairs. Phase 1 takes the grabbed pieces. Where the pairs fit into what is left of the
    budget, all are taken; else key-associated pairs of at most half of ``assoc_most`` are, and then the rest while it
    fits, key-key pairs first, each kind from the cheapest. Phase 4 fills what is left with the cheapest remaining
    pieces that fit.
    """
    alone = peeked.where("grabbed").select("qid", F.col("piece").alias("query_id"), F.lit(1).alias("phase"), "n_docs")
    spent = peeked.groupBy("qid").agg(F.coalesce(F.sum(F.when(F.col("grabbed"), F.col("n_docs"))), F.lit(0)).alias("spent"))
    wanted = combos.withColumn("always", (F.col("kind") == "key-assoc") & (F.col("n_docs") <= assoc_most / 2))
    total = Window.partitionBy("qid")
    wanted = wanted.join(spent, "qid").withColumn("all", F.sum("n_docs").over(total)).withColumn("cheap", F.coalesce(F.sum(F.when(F.col("always"), F.col("n_docs"))).over(total), F.lit(0))).withColumn("left", F.lit(budget) - F.col("spent"))
    fitting = wanted.where(F.col("all") <= F.col("left"))
    over = wanted.where(F.col("all") > F.col("left"))
    chosen = over.where(~F.col("always")).withColumn("kind_ix", F.when(F.col("kind") == "key-key", 0).otherwise(1))
    folded = fold_budget(chosen, "qid", ["kind_ix", "n_docs", "query_id"], "query_id", "n_docs", F.col("left") - F.col("cheap"))
    third = fitting.select("qid", "query_id", F.lit(2).alias("phase"), "n_docs").unionByName(over.where("always").select("qid", "query_id", F.lit(3).alias("phase"), "n_docs")).unionByName(folded.select("qid", "query_id", F.lit(3).alias("phase"), "n_docs"))
    so_far = alone.unionByName(third)
    used = so_far.groupBy("qid").agg(F.sum("n_docs").alias("used"))
    rest = peeked.where(~F.col("grabbed") & (F.col("n_docs") > 0)).join(used, "qid", "left").withColumn("left", F.lit(budget) - F.coalesce("used", F.lit(0)))
    filled = fold_budget(rest, "qid", ["n_docs", "piece"], "piece", "n_docs", F.col("left"))
    return so_far.unionByName(filled.select("qid", F.col("piece").alias("query_id"), F.lit(4).alias("phase"), "n_docs"))


def combination_candidates(peeked: DataFrame, pieces: DataFrame) -> DataFrame:
    """``qid, step, o1, s1, o2, s2, members``: the combinations of the earlier scheme, in the order ``step, o1, s1, o2, s2`` in which they are tried.

    Only pieces that weren't taken alone and occur are combined. An aspect's name is the piece of its own name, else its cheapest. Steps:
    1 all aspects' names, if three or more; 2 two names; 3 an expansion, the cheapest first, and another aspect's name; 4 an associated piece and a
    name; 5 an expansion and an associated piece. ``pieces`` has ``qid, piece, role, aspect_ix, aspect, keyword``.
    """
    rest = peeked.where("NOT grabbed AND n_docs > 0").select("qid", "piece", "role", "aspect_ix", "n_docs")
    own = pieces.where("role = 'key'").groupBy("qid", "piece", "aspect_ix").agg(F.max(F.lower("keyword") == F.lower("aspect")).alias("own"))
    key = rest.where("role = 'key'").join(own, ["qid", "piece", "aspect_ix"])
    w = Window.partitionBy("qid", "aspect_ix").orderBy(F.desc("own"), "n_docs", "piece")
    key = key.withColumn("__r", F.row_number().over(w))
    name = key.where("__r = 1").select("qid", F.col("aspect_ix").alias("ix"), F.col("piece").alias("name"))
    other = key.where("__r > 1").select("qid", "piece", "aspect_ix", "n_docs")
    assoc = rest.where("role = 'assoc'").select("qid", F.col("piece").alias("assoc"), F.col("n_docs").alias("an"))
    no, none = F.lit(0).cast("long"), F.lit("")

    def made(df: DataFrame, step: int, members: Column, o1=no, s1=none, o2=no, s2=none) -> DataFrame:
        return df.select("qid", F.lit(step).alias("step"), o1.cast("long").alias("o1"), s1.alias("s1"), o2.cast("long").alias("o2"), s2.alias("s2"), members.alias("members"))

    two = name.join(name.toDF("qid", "ix2", "name2"), "qid").where("ix < ix2")
    x, n, a, c = F.col("piece"), F.col("name"), F.col("assoc"), F.col("n_docs")
    parts = [
        made(name.groupBy("qid").agg(F.collect_list("name").alias("m")).where("size(m) >= 3"), 1, F.col("m")),
        made(two, 2, F.array("name", "name2"), F.col("ix"), none, F.col("ix2")),
        made(other.join(name, "qid").where("ix <> aspect_ix"), 3, F.array(x, n), c, x, F.col("ix")),
        made(assoc.join(name, "qid"), 4, F.array(n, a), F.col("an"), a, F.col("ix")),
        made(other.join(assoc, "qid"), 5, F.array(x, a), c, x, F.col("an"), a),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def combination_queries(candidates: DataFrame, peeked: DataFrame, budget: int, most_queries: int = 200) -> DataFrame:
    """The earlier scheme: candidates ``qid, query_id, n_docs`` and their order, while they fit what the pieces taken alone have left of the budget.

    Equal queries count once, at their first place; those without documents are passed over; a topic has at most ``most_queries``, which is a
    setting of the scheme.
    """
    order = ["step", "o1", "s1", "o2", "s2"]
    first = Window.partitionBy("qid", "query_id").orderBy(*order)
    once = candidates.where("n_docs > 0").withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    spent = peeked.groupBy("qid").agg(F.coalesce(F.sum(F.when(F.col("grabbed"), F.col("n_docs"))), F.lit(0)).alias("spent"))
    known = once.join(spent, "qid", "left").withColumn("left", F.lit(budget) - F.coalesce("spent", F.lit(0)))
    return fold_budget(known, "qid", order, "query_id", "n_docs", F.col("left"), most=most_queries)
