"""Readers: topics, judgments, runs, expansions, corpora and token shards as DataFrames.

All take paths that Spark reads (files, folders, globs; gzip and zstd by their endings).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import qid_of_path
from lexmill.plans.ordered import numbered, numbered_within, running_total
from lexmill.plans.shared import col

#: The typed schema of a raw corpus row.
CORPUS_SCHEMA = "text string, added string, created string, attributes string, doc string, id string, metadata string, source string, version string, url string, warcinfo string, length long, tokens long, score double, lang struct<en: double>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, line_no``: the lines of text files, with a value that rises from line to line of a file.

    It is made of the place of the file's part and the line's place within it, so that no file has to be in one task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"))
    return lines.select("value", "file", F.struct("file", "part", "at").alias("line_no"))


def columns_of(line: Column) -> Column:
    return F.filter(F.split(line, "\\s+"), lambda x: x != "")


def latest_by(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """For each key the row that comes last; the order column is dropped."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    picked = df.groupBy(*keys).agg(*[F.max_by(F.struct(*rest), order).alias("__r")])
    return picked.select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest])


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """``qid, text`` from JSON lines (id or qid; title, text or query) where a line begins with a brace, else from tab-separated lines."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = F.from_json("value", "id string, qid string, title string, text string, query string")
    both = lines.select(F.startswith(F.ltrim("value"), F.lit("{")).alias("is_json"), fields.alias("j"), F.split("value", "\t", 2).alias("t"))
    qid = F.when(F.col("is_json"), F.coalesce("j.id", "j.qid")).otherwise(F.trim(F.col("t")[0]))
    text = F.when(F.col("is_json"), F.coalesce("j.title", "j.text", "j.query")).otherwise(F.trim(F.get("t", 1)))
    return both.select(qid.alias("qid"), text.alias("text")).where("qid IS NOT NULL AND text IS NOT NULL")


def judgments(lines: DataFrame, value: str = "value", order: str = "line_no") -> DataFrame:
    """``qid, doc_id, rel`` from lines of 3 or 4 columns; lines of other widths are dropped, of repeated pairs the last line counts."""
    parts = lines.select(columns_of(col(value)).alias("c"), col(order).alias("__o"))
    wide = parts.where(F.size("c").isin(3, 4))
    rows = wide.select(F.col("c")[0].alias("qid"), F.element_at("c", -2).alias("doc_id"), F.element_at("c", -1).try_cast("int").alias("rel"), "__o").where("rel IS NOT NULL")
    return latest_by(rows, ["qid", "doc_id"], "__o")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return judgments(numbered_lines(spark, path))


def run_entries(lines: DataFrame, value: str = "value", order: str = "line_no") -> DataFrame:
    """``qid, doc_id, rank, score, run`` from lines of at least 5 columns; of repeated pairs the last line counts."""
    parts = lines.select(columns_of(col(value)).alias("c"), col(order).alias("__o")).where(F.size("c") >= 5)
    rows = parts.select(F.col("c")[0].alias("qid"), F.col("c")[2].alias("doc_id"), F.col("c")[3].try_cast("int").alias("rank"), F.col("c")[4].try_cast("double").alias("score"), F.get("c", 5).alias("run"), "__o")
    return latest_by(rows, ["qid", "doc_id"], "__o")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return run_entries(numbered_lines(spark, path))


def read_expansions(spark: SparkSession, path: str) -> DataFrame:
    """``qid, role, aspect, keyword`` from JSON lines with a ``qid``, or from one JSON object by qid.

    Understands nested aspects (lists, or lists by facet), flat ``core`` and ``expansion`` lists, and keys with a
    ``KEY:``, ``SUP:``, ``CORE:`` or ``AUX:`` prefix. Rows of which nothing can be read give no keyword.
    """
    lines = spark.read.text(path, wholetext=not path.endswith((".jsonl", ".jsonl.gz", ".jsonl.zst")))
    top = lines.select(F.from_json("value", "map<string,string>").alias("m"))
    by_line = top.where(F.map_contains_key("m", F.lit("qid"))).select(F.col("m")["qid"].alias("qid"), F.col("m").alias("body"))
    by_key = top.where(~F.map_contains_key("m", F.lit("qid"))).select(F.explode("m").alias("qid", "v")).select("qid", F.from_json("v", "map<string,string>").alias("body"))
    entries = by_line.unionByName(by_key).select("qid", F.explode("body").alias("name", "v")).where("name <> 'qid'")
    upper = F.upper("name")
    role = (
        F.when(upper.isin("ASSOCIATED_TERMS", "ASSOCIATED", "EXPANSION") | upper.rlike("^(SUP|AUX):"), "assoc")
        .when(upper == "VERBS", "verb")
        .when(upper.isin("KEY_ENTITIES", "CORE") | upper.rlike("^(KEY|CORE):"), "key")
    )
    listed = lambda v: F.from_json(v, "array<string>")
    known = entries.withColumn("role", role).where("role IS NOT NULL")
    aspect = F.when(F.col("name").rlike("^[A-Za-z]+: *"), F.regexp_replace("name", "^[A-Za-z]+: *", "")).otherwise(F.lit(""))
    flat = known.where(F.startswith("v", F.lit("["))).select("qid", "role", aspect.alias("aspect"), F.explode(listed("v")).alias("keyword"))
    # each aspect's value is read by its own shape
    nested = known.where(F.startswith("v", F.lit("{"))).select("qid", "role", F.explode(F.from_json("v", "map<string,string>")).alias("aspect", "w"))
    lists = F.when(F.startswith("w", F.lit("{")), F.flatten(F.filter(F.map_values(F.from_json("w", "map<string,array<string>>")), lambda x: x.isNotNull()))).otherwise(listed("w"))
    nested = nested.select("qid", "role", "aspect", F.explode(lists).alias("keyword"))
    return flat.unionByName(nested).where("keyword IS NOT NULL")


def read_found(spark: SparkSession, path: str, qid_pattern: str | None = None) -> DataFrame:
    """``qid, doc_id, text, relevance`` of found or missed documents, one JSON a line; the qid is the file's name. Blank texts are left out."""
    rows = spark.read.schema("doc_id string, docid string, text string, segment string, body string, relevance int").json(path)
    name = F.input_file_name() if qid_pattern is None else F.regexp_extract(F.input_file_name(), qid_pattern, 1)
    text = F.coalesce("segment", "body", "text")
    qid = qid_of_path(name) if qid_pattern is None else name
    return rows.select(qid.alias("qid"), F.coalesce("docid", "doc_id").alias("doc_id"), text.alias("text"), "relevance").where(F.trim("text") != "")


def read_jsonl(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def lookup_ids(spark: SparkSession, root: str, ids: Iterable[str], pattern: str = "{root}/part_{number}.jsonl.gz", number: int = 4, schema: str = "docid string, segment string") -> DataFrame:
    """The rows of the given ids, read only from the files whose number is the id's field ``number``; missing files are tolerated."""
    ids = sorted(set(ids))
    files = sorted({pattern.format(root=root, number=i.split("_")[number]) for i in ids if i.count("_") >= number})
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = [f for f in files if (p := path(f)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)]
    wanted = spark.createDataFrame([(i,) for i in ids], "docid string")
    rows = spark.read.schema(schema).json(there) if there else spark.createDataFrame([], schema)
    return rows.join(wanted, "docid", "left_semi")


def file_batches(files: DataFrame, subset: str, path: str, per_batch: int) -> DataFrame:
    """``batch, subset, path``: the files of each subset in batches of at most ``per_batch``, named ``batch_0000_subset``.

    Files are numbered over range partitions, so that no subset has to fit into one task.
    """
    number = numbered_within(files.select(col(subset).alias("subset"), col(path).alias("path")), ["subset"], ["path"], "__n")
    name = F.concat(F.lit("batch_"), F.lpad(F.floor((F.col("__n") - 1) / per_batch).cast("string"), 4, "0"), F.lit("_"), "subset")
    return number.select(name.alias("batch"), "subset", "path")


def strided_order(batches: DataFrame, order: str, offset: int) -> DataFrame:
    """``position`` for each batch: first every ``offset``-th, then those after them, and so on; every batch once."""
    at = numbered(batches, [order], "__no")
    return numbered(at.withColumn("__rest", F.col("__no") % offset), ["__rest", "__no"], "__p").withColumn("position", F.col("__p") + 1).drop("__no", "__rest", "__p")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def take_until(df: DataFrame, order: Sequence[Column | str], size: str, enough: float, keys: Sequence[str] = ()) -> DataFrame:
    """Rows in order while the total before them is below ``enough``: the row that reaches it is still taken.

    Without ``keys`` the total runs over range partitions.
    """
    if not keys:
        return running_total(df, order, size, "__before").where(F.col("__before") < enough).drop("__before")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("__before") < enough).drop("__before")


def in_all_folders(files: DataFrame, folder: str, name: str, folders: int) -> DataFrame:
    """Names that every one of the ``folders`` folders has."""
    return files.groupBy(name).agg(F.count_distinct(folder).alias("__n")).where(F.col("__n") == folders).select(name)


def beir_corpus(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``title. text`` from ``_id, title, text``."""
    title = F.nullif(F.trim(F.coalesce("title", F.lit(""))), F.lit(""))
    return rows.select(F.col("_id").alias("doc_id"), F.concat_ws(". ", title, "text").alias("text"))


def beir_topics(topics: DataFrame, qrels: DataFrame) -> DataFrame:
    """Topics that have judgments, by qid."""
    return topics.join(qrels.select("qid"), "qid", "left_semi").orderBy("qid")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``filename, size, n, values`` of a folder's ``.npy`` files of whole numbers; files that aren't arrays are left out.

    An array is one value of a row, so it must be smaller than 2 GB; shards of any size are read by :func:`shard_sentences`.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "length", "content")

    def parse(batches):
        import io

        import numpy as np
        import pandas as pd

        for b in batches:
            rows = []
            for p, length, content in zip(b["path"], b["length"], b["content"]):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False).astype("int64").reshape(-1)
                except (ValueError, EOFError):
                    continue
                rows.append((p.rsplit("/", 1)[-1], length, len(a), a))
            yield pd.DataFrame(rows, columns=["filename", "size", "n", "values"])

    return files.mapInPandas(parse, "filename string, size long, n long, values array<long>")


def _open(path: str):
    """A file of any file system that pyarrow knows, for random access."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return store.open_input_file(at)


def _header(f) -> tuple[object, int, int]:
    """Type, length and beginning of the values of a ``.npy`` file of one dimension."""
    from numpy.lib import format as npy

    version = npy.read_magic(f)
    shape, _, kind = npy.read_array_header_1_0(f) if version == (1, 0) else npy.read_array_header_2_0(f)
    return kind, int(shape[0]) if shape else 0, f.tell()


def _values(f, head: tuple, first: int, n: int):
    import numpy as np

    kind, _, begin = head
    f.seek(begin + first * kind.itemsize)
    return np.frombuffer(f.read(n * kind.itemsize), kind)


def shard_sentences(spark: SparkSession, path: str, ids: str = "_ids.npy", offsets: str = "_offsets.npy", per_task: int = 50_000) -> DataFrame:
    """``shard, sentence, tokens`` from pairs of id and offset arrays of any size; empty sentences, as at joints of batches, are left out.

    A task reads the byte ranges of ``per_task`` sentences, so that no file is read as a whole. The driver reads the headers.
    """
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = store.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*{offsets}"))
    parts = []
    for status in there:
        name = status.getPath().toString()
        with _open(name) as f:
            n = _header(f)[1] - 1
        parts += [(name[: -len(offsets)], first, min(per_task, n - first)) for first in range(0, max(n, 0), per_task)]
    schema = "shard string, sentence bigint, tokens array<bigint>"
    if not parts:
        return spark.createDataFrame([], schema)
    ranges = spark.createDataFrame(parts, "stem string, first bigint, n bigint").repartition(len(parts), "stem", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stem, first, n in zip(*(c.to_pylist() for c in b.columns)):
                with _open(stem + offsets) as f, _open(stem + ids) as g:
                    at = _values(f, _header(f), first, n + 1).astype("int64")
                    words_ = _values(g, _header(g), int(at[0]), int(at[-1] - at[0])).astype("int64")
                full = at[1:] > at[:-1]
                lists = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(words_))
                number = pa.array(range(first, first + n), pa.int64())
                keep = pa.array(full)
                yield pa.RecordBatch.from_arrays([pa.array([stem.rsplit("/", 1)[-1]] * int(full.sum()), pa.string()), number.filter(keep), lists.filter(keep)], names=["shard", "sentence", "tokens"])

    return ranges.mapInArrow(read, schema)


def read_unigrams(spark: SparkSession, path: str) -> DataFrame:
    """``token_id, token, count, probability`` from Parquet, or from CSV with a header."""
    schema = "token_id long, token string, count long, probability double"
    rows = spark.read.schema(schema).option("header", True).csv(path) if path.rstrip("/").endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    return rows.select("token_id", "token", "count", "probability")


def unigrams_of(unigrams: DataFrame, tokens: Iterable[str]) -> DataFrame:
    """The rows of the given tokens, the rarest first."""
    return unigrams.where(F.col("token").isin(*tokens)).orderBy("probability", "token")


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """Saved runs below ``root``, one Parquet folder each, with the folder's name as ``run``; whatever else lies there is passed over."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    return rows.withColumn("run", F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1))
