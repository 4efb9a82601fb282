"""Problem 1: the N best items of every group.

Method: per-group score histograms give a safe lower threshold that leaves at least N different items; rows below
it are dropped before anything is shuffled by group; the survivors are ranked exactly with the tie key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.plans.shared import BROADCAST_ROWS, col, cut, sized_broadcast

#: Where the thresholds of all groups are too many to broadcast, groups with fewer rows than this for each place are ranked without one:
#: that saves a shuffle of all rows to meet the thresholds, and ranking keeps n rows of a group in each task anyway.
HEAVY_FACTOR = 20
#: Salts a threshold is repeated over where the thresholds are too many to broadcast.
SALTS = 16


def score_bucket(score: Column, steps: int = 32) -> Column:
    """A bucket number that never falls as ``score`` rises: ``steps`` buckets for each doubling, on both sides of 0.

    It needs no range of the scores, so it can be computed before any of them has been seen.
    """
    size = F.floor((F.log2(F.least(F.abs(score), F.lit(1e308))) + 1076) * steps)
    return F.when(score == 0, F.lit(0)).otherwise(F.signum(score).cast("long") * size).cast("long")


def top_n_per_group(df: DataFrame, group_cols: Sequence[str], item_col: str, score_col: str, n: int = 10, steps: int = 32, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The ``n`` best distinct items of each group: group columns, ``item_col``, ``score_col``, ``rank_no`` from 1.

    An item counts once, with its highest score. Order: score descending, then item descending (strings in byte
    order). Rows with a null group column, a null or empty item, or a null or NaN score don't count; infinite
    scores do. Other columns of ``df`` are ignored, whatever their names. An empty input gives an empty result;
    a group with fewer than ``n`` items gives all of them.

    The histogram holds, for each group, at most ``4 n`` hash slots of items with the slot's best bucket: it stays
    that small however many rows a group has, and n filled slots at or above a bucket prove n different items there.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    g = [f"g{i}" for i in range(len(group_cols))]
    score = col(score_col).cast("double")
    rows = df.select(*[col(c).alias(a) for c, a in zip(group_cols, g)], col(item_col).alias("item"), score.alias("score"))
    rows = rows.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("item").isNotNull() & (F.col("item").cast("string") != ""))
    for a in g:
        rows = rows.where(F.col(a).isNotNull())
    rows = rows.withColumn("bucket", score_bucket(F.col("score"), steps)).withColumn("slot", F.pmod(F.xxhash64("item"), F.lit(4 * n)).cast("int"))

    tops = rows.groupBy(*g, "slot").agg(F.max("bucket").alias("bucket"), F.count("*").alias("c"))
    hist = tops.groupBy(*g, "bucket").agg(F.count("*").alias("slots"), F.sum("c").alias("c"))
    falling = Window.partitionBy(*g).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*g)
    hist = hist.withColumn("have", F.sum("slots").over(falling)).withColumn("rows", F.sum("c").over(whole))
    floors = cut(hist.where(F.col("have") >= n).groupBy(*g).agg(F.max("bucket").alias("floor"), F.max("rows").alias("rows")), "topn-floors")
    floors, small = sized_broadcast(floors, broadcast_rows)
    if not small:
        floors, small = sized_broadcast(cut(floors.where(F.col("rows") >= HEAVY_FACTOR * n), "topn-heavy"), broadcast_rows)
    floors = floors.drop("rows")

    if small:
        kept = rows.join(F.broadcast(floors), g, "left")
    else:  # salted, as one group may hold much of all rows
        floors = floors.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        kept = rows.withColumn("salt", F.pmod("slot", F.lit(SALTS))).join(floors, [*g, "salt"], "left")
    kept = kept.where(F.col("floor").isNull() | (F.col("bucket") >= F.col("floor")))

    best = kept.groupBy(*g, "item").agg(F.max("score").alias("score"))
    # Spark keeps n rows of a group in each task before it shuffles by group (WindowGroupLimit)
    ranked = best.withColumn("rank_no", F.row_number().over(Window.partitionBy(*g).orderBy(F.desc("score"), F.desc("item")))).where(F.col("rank_no") <= n)
    return ranked.select(*[F.col(a).alias(c) for c, a in zip(group_cols, g)], F.col("item").alias(item_col), F.col("score").alias(score_col), "rank_no")


def stage_entries(results: DataFrame, stages: Sequence[str] = ("biencoder_ranked", "crossencoder_ranked")) -> DataFrame:
    """One row ``qid, stage, doc_id, score`` for each entry of the ranking arrays; null arrays and null entries give none."""

    def labelled(stage: str) -> Column:
        return F.transform(F.coalesce(col(stage), F.array().cast("array<struct<doc_id:string,score:double>>")), lambda x: F.struct(F.lit(stage).alias("stage"), x["doc_id"].alias("doc_id"), x["score"].alias("score")))

    each = results.where(F.col("qid").isNotNull()).select("qid", F.explode(F.concat(*[labelled(s) for s in stages])).alias("e"))
    return each.select("qid", "e.stage", "e.doc_id", "e.score")


def top_documents(results: DataFrame, n: int = 10) -> DataFrame:
    """``qid, stage, rank_no, doc_id``: the first ``n`` documents of each topic and stage."""
    top = top_n_per_group(stage_entries(results), ["qid", "stage"], "doc_id", "score", n)
    return top.select("qid", "stage", "rank_no", "doc_id")
