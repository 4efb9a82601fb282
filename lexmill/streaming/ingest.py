"""A corpus folder read as a stream of files: cleaned, split, tokenised, and written or counted batch by batch.

Each micro-batch takes a bounded number of files, finished files are remembered in the checkpoint, and a stream that
is started again goes on with the files that are new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import clean_html, sentences, simple_tokens, words


def corpus_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int = 16, text: str = "text") -> DataFrame:
    """The rows of a folder's files with non-empty texts, as a stream."""
    rows = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.where(F.trim(F.coalesce(text, F.lit(""))) != "")


def prepared(rows: DataFrame, mode: str = "raw", text: str = "text") -> DataFrame:
    """The rows with ``item``: the cleaned text (``raw``), its sentences (``sentences``), words (``words``) or simple tokens (``preproc``)."""
    made: dict[str, Callable] = {"raw": clean_html, "sentences": lambda c: F.explode(sentences(clean_html(c))), "words": lambda c: words(clean_html(c)), "preproc": simple_tokens}
    if mode not in made:
        raise ValueError(f"mode is one of {', '.join(made)}")
    return rows.withColumn("item", made[mode](F.col(text)))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """Appends what there is by now to ``path`` and ends."""
    q = stream.writeStream.format(fmt).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q


def each_batch(stream: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls ``do`` with each micro-batch and its number. A batch may come again after a failure, under the same number."""
    q = stream.writeStream.foreachBatch(do).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def limited(batch: DataFrame, n: int, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first ``n`` rows of a batch, or of each key in it: the reader's own limit of sentences."""
    w = Window.partitionBy(*keys).orderBy(order)
    return batch.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def streamed_vocabulary(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, fmt: str = "parquet", files_per_batch: int = 4) -> DataFrame:
    """``tok, tf`` over all files so far: each batch writes its partial counts under its own number, and reading adds them up.

    A batch that comes again overwrites its own folder, so every file counts once.
    """
    rows = corpus_stream(spark, path, schema, fmt, files_per_batch)

    def add(batch: DataFrame, number: int) -> None:
        batch.select(F.explode(words(F.col("text"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("tf")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    each_batch(rows, add, checkpoint)
    return spark.read.parquet(out).groupBy("tok").agg(F.sum("tf").alias("tf"))
