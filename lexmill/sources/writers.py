"""Writers: run files, tables of metrics, document lists, token shards and resumable caches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_lines(ranked: DataFrame, run_name: str, score: str | None = "score") -> DataFrame:
    """``qid, rank, line`` in the six columns of a run file, from ``qid, doc_id, rank0`` and a score.

    ``rank0`` counts from 0; rows without a document are left out, but their rank is used up. Without a score column
    the score is 1000 less ``rank0``.
    """
    value = F.col(score).cast("double") if score else (F.lit(1000.0) - F.col("rank0"))
    line = F.format_string("%s Q0 %s %d %.6f %s", F.col("qid"), F.col("doc_id"), (F.col("rank0") + 1).cast("int"), value, F.lit(run_name))
    return ranked.where(F.col("doc_id").isNotNull()).select("qid", (F.col("rank0") + 1).cast("int").alias("rank"), line.alias("line"))


def write_run(ranked: DataFrame, path: str, run_name: str, score: str | None = "score") -> None:
    lines = run_lines(ranked, run_name, score)
    lines.repartitionByRange("qid", "rank").sortWithinPartitions("qid", "rank").select("line").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with a header, JSON lines, or Parquet."""
    w = df.write.mode("overwrite")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def found_lists(pool: DataFrame, relevant: DataFrame, texts: DataFrame, chars: int = 2000, per_qid: int | None = None) -> DataFrame:
    """``qid, doc_id, kind, relevance, text``: documents found, missed and irrelevant, with their texts cut to ``chars``.

    ``chars`` and ``per_qid`` (irrelevant documents listed for a topic) are limits of the report.
    """
    good = relevant.where("rel > 0")
    found = pool.join(good, ["qid", "doc_id"]).withColumn("kind", F.lit("found"))
    missed = good.join(pool, ["qid", "doc_id"], "left_anti").withColumn("kind", F.lit("missed"))
    rest = pool.join(good, ["qid", "doc_id"], "left_anti").withColumn("rel", F.lit(0)).withColumn("kind", F.lit("irrelevant"))
    if per_qid is not None:
        rest = rest.withColumn("__n", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id"))).where(F.col("__n") <= per_qid)
    parts = [p.select("qid", "doc_id", "kind", F.col("rel").alias("relevance")) for p in (found, missed, rest)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.join(texts.select("doc_id", F.left("text", F.lit(chars)).alias("text")), "doc_id", "left").select("qid", "doc_id", "kind", "relevance", "text")


def enrich(rows: DataFrame, texts: DataFrame, key: str = "doc_id", field: str = "text", replace: bool = False) -> DataFrame:
    """Adds ``field`` of ``texts`` by ``key``: an existing value stays, unless ``replace``."""
    given = texts.groupBy(key).agg(F.min(field).alias("__new"))
    joined = rows.join(given, key, "left")
    old = F.col(field) if field in rows.columns else F.lit(None).cast("string")
    value = F.coalesce("__new", old) if replace else F.coalesce(old, F.col("__new"))
    return joined.withColumn(field, value).drop("__new")


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is wanted and not yet done, for appending to a resumable cache."""
    return wanted.join(done.select(*keys), [*keys], "left_anti")


def append_done(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def write_token_shards(coded: DataFrame, path: str, ids: str = "ids", tokens_per_shard: int = 1 << 27, kind: str = "uint16") -> DataFrame:
    """``shard, sentences, tokens`` of the shards written: ``_ids.npy``, ``_offsets.npy`` and ``_meta.json`` for each, of about ``tokens_per_shard`` tokens.

    ``coded`` has an array of token ids a row, a sentence. Each task writes the shards of its own rows, one after the other; one whose meta
    file is there is not written again, so that a job that is repeated goes on where it stopped. Ids that ``kind`` can't hold raise.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import json

        import numpy as np
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
        store.create_dir(root, recursive=True)
        pid, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def save(name: str, content: bytes) -> None:
            with store.open_output_stream(name) as out:
                out.write(content)

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            name, number = f"shard_{pid:05}_{number:05}", number + 1
            offsets = np.cumsum([0, *(len(x) for x in held)]).astype("int64")
            if store.get_file_info(f"{root}/{name}_meta.json").type == fs.FileType.NotFound:
                flat = np.concatenate(held)
                if len(flat) and (flat.min() < 0 or flat.max() > np.iinfo(kind).max):
                    raise ValueError(f"token ids don't fit into {kind}")
                for end, values in (("ids", flat.astype(kind)), ("offsets", offsets)):
                    buffer = io.BytesIO()
                    np.save(buffer, values)
                    save(f"{root}/{name}_{end}.npy", buffer.getvalue())
                save(f"{root}/{name}_meta.json", json.dumps({"sentences": len(held), "tokens": int(offsets[-1]), "dtype": kind}).encode())
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())], names=["shard", "sentences", "tokens"])
            held, size = [], 0
            return row

        for b in batches:
            for x in b[ids].to_pylist():
                held.append(np.array(x or [], dtype="int64"))
                size += len(held[-1])
                if size >= tokens_per_shard:
                    yield flush()
        if held:
            yield flush()

    return coded.select(ids).mapInArrow(write, "shard string, sentences bigint, tokens bigint")
