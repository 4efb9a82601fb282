"""Evaluation of runs against judgments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.plans.ordered import numbered_within


def positions_in_run(run: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rank`` from 1 by score, then document, both descending; a document counts once, with its highest score.

    A topic's run may be longer than one task should hold: ranks are numbered over range partitions.
    """
    best = run.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy(*keys, "doc_id").agg(F.max("score").alias("score"))
    return numbered_within(best, keys, [F.desc("score"), F.desc("doc_id")], "rank")


def ranked_by_file(run: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``rank`` from 1 by the place in a run's file, whatever the scores."""
    return numbered_within(run, keys, [order], "rank")


def metrics(ranked: DataFrame, qrels: DataFrame, cutoffs: Sequence[int] = (10, 100), run_keys: Sequence[str] = (), binary: bool = False) -> DataFrame:
    """A row for each run and topic that has both results and judgments.

    ``ranked`` has ``run_keys, qid, doc_id, rank``; ``qrels`` ``qid, doc_id, rel``, one row a pair. Columns:
    ``n_rel, n_ret, found_k, recall_k, p_k, ndcg_k`` for each cutoff, ``mrr, map``. A document is relevant above
    grade 0. Precision divides by k, recall and average precision by all relevant documents, and the ideal gain is
    that of all judgments; the gain is the grade, or 1 if ``binary``. Topics without relevant documents have 0.

    The judgments' ideal ranking is cut to the largest cutoff in each task, and only relevant results are numbered for
    the average precision, so no topic has to fit into one task.
    """
    keys = [*run_keys, "qid"]
    gain = F.when(F.col("rel") > 0, F.lit(1.0) if binary else F.col("rel").cast("double")).otherwise(F.lit(0.0))
    judged = qrels.where(F.col("rel").isNotNull()).withColumn("gain", gain)
    ideal = judged.withColumn("__r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("gain"), "doc_id"))).where(F.col("__r") <= max(cutoffs))
    discount = lambda r: 1.0 / F.log2(F.col(r) + 1.0)
    wanted = judged.groupBy("qid").agg(F.count_if(F.col("gain") > 0).alias("n_rel"))
    best = ideal.groupBy("qid").agg(*[F.coalesce(F.sum(F.when(F.col("__r") <= k, F.col("gain") * discount("__r"))), F.lit(0.0)).alias(f"ideal_{k}") for k in cutoffs]).join(wanted, "qid")
    hit = ranked.join(judged.select("qid", "doc_id", "gain"), ["qid", "doc_id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0))).withColumn("hit", (F.col("gain") > 0).cast("int"))
    found = numbered_within(hit.where("hit = 1").select(*keys, "rank"), keys, ["rank"], "hit_no")
    average = found.groupBy(*keys).agg(F.sum(F.col("hit_no") / F.col("rank")).alias("sum_prec"))
    parts = [F.count("*").alias("n_ret"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")]
    for k in cutoffs:
        parts += [F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("hit"))), F.lit(0)).alias(f"found_{k}"), F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("gain") * discount("rank"))), F.lit(0.0)).alias(f"dcg_{k}")]
    met = hit.groupBy(*keys).agg(*parts).join(average, keys, "left").na.fill(0.0, ["sum_prec"]).join(best, "qid")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = [*keys, "n_rel", "n_ret"]
    for k in cutoffs:
        out += [f"found_{k}", ratio(f"found_{k}", "n_rel").alias(f"recall_{k}"), (F.col(f"found_{k}") / k).alias(f"p_{k}"), ratio(f"dcg_{k}", f"ideal_{k}").alias(f"ndcg_{k}")]
    return met.select(*out, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), ratio("sum_prec", "n_rel").alias("map"))


def precision_of_returned(ranked: DataFrame, qrels: DataFrame, k: int, run_keys: Sequence[str] = ()) -> DataFrame:
    """The other precision: found among the first k, divided by k or by the results there are, whichever is less."""
    keys = [*run_keys, "qid"]
    good = qrels.where("rel > 0").select("qid", "doc_id", F.lit(1).alias("hit"))
    met = ranked.where(F.col("rank") <= k).join(good, ["qid", "doc_id"], "left").groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    return met.select(*keys, "found", (F.col("found") / F.least(F.lit(k), F.col("n"))).alias("precision"))


def macro(per_topic: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means over topics, and their number."""
    return per_topic.groupBy(*keys).agg(F.count("*").alias("topics"), *[F.avg(v).alias(v) for v in values])


def recall_summary(per_topic: DataFrame, keys: Sequence[str], recall: str = "recall", precision: str = "precision", tail: float = 0.1) -> DataFrame:
    """Mean, sample deviation and median of recall, its mean over the worst ``tail`` of topics (one at least), mean precision."""
    w = Window.partitionBy(*keys)
    low = F.row_number().over(w.orderBy(recall, "qid"))
    worst = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * tail))
    marked = per_topic.withColumn("__low", low <= worst)
    return marked.groupBy(*keys).agg(F.avg(recall).alias("mean_recall"), F.coalesce(F.stddev_samp(recall), F.lit(0.0)).alias("std_recall"), F.median(recall).alias("median_recall"), F.avg(F.when(F.col("__low"), F.col(recall))).alias("cvar"), F.avg(precision).alias("mean_precision"))


def retrieval_outcome(pooled: DataFrame, qrels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, qid, n_relevant, n_retrieved, n_found, recall, precision`` of pools; topics with nothing retrieved have 0."""
    good = qrels.where("rel > 0").select("qid", "doc_id")
    wanted = good.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    got = pooled.select(*keys, "qid", "doc_id").distinct().join(good.withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left").groupBy(*keys, "qid").agg(F.count("*").alias("n_retrieved"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"))
    return got.join(wanted, "qid").select(*keys, "qid", "n_relevant", "n_retrieved", "n_found", (F.col("n_found") / F.col("n_relevant")).alias("recall"), (F.col("n_found") / F.col("n_retrieved")).alias("precision"))


def head_to_head(per_topic: DataFrame, mode: str, value: str) -> DataFrame:
    """``mode_a, mode_b, wins, losses, ties, avg_diff`` of each pair of modes over their common topics."""
    a = per_topic.select("qid", F.col(mode).alias("mode_a"), F.col(value).alias("va"))
    b = per_topic.select("qid", F.col(mode).alias("mode_b"), F.col(value).alias("vb"))
    return a.join(b, "qid").where("mode_a < mode_b").groupBy("mode_a", "mode_b").agg(F.count_if(F.col("va") > F.col("vb")).alias("wins"), F.count_if(F.col("va") < F.col("vb")).alias("losses"), F.count_if(F.col("va") == F.col("vb")).alias("ties"), F.avg(F.col("va") - F.col("vb")).alias("avg_diff"))


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def share_of_pool(stages: DataFrame, pool_stage: str = "pool") -> DataFrame:
    """``qid, stage, found, share``: what each stage keeps of what the pool found."""
    base = stages.where(F.col("stage") == pool_stage).select("qid", F.col("found").alias("pool_found"))
    return stages.join(base, "qid", "left").select("qid", "stage", "found", F.when(F.col("pool_found") > 0, F.col("found") / F.col("pool_found")).alias("share"))


def grade_histogram(pooled: DataFrame, qrels: DataFrame) -> DataFrame:
    """``grade, found, n``: judged pairs by grade, found in the pool or not."""
    marked = qrels.where("rel IS NOT NULL").join(pooled.select("qid", "doc_id").distinct().withColumn("found", F.lit(True)), ["qid", "doc_id"], "left")
    return marked.groupBy(F.col("rel").alias("grade"), F.coalesce("found", F.lit(False)).alias("found")).agg(F.count("*").alias("n"))
