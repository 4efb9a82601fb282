"""The index: documents as word arrays, positions, vocabulary, extensions.

There is no suffix array. A position table is a projection of the word arrays; a written index has the positions of each word in
each document, by buckets of words, so that a query reads the buckets of its own words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import numbers
from lexmill.functions.text import words
from lexmill.plans.ordered import numbered, placed
from lexmill.plans.shared import col, cut, if_small


def doc_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenize=words) -> DataFrame:
    """``doc_id, ws``: the words of each document; null texts have none."""
    return docs.select(col(doc_id).alias("doc_id"), tokenize(col(text)).alias("ws"))


def positions(documents: DataFrame) -> DataFrame:
    """``doc_id, pos, tok`` with 0-based positions, from :func:`doc_words`.

    The outer form, as before the inner one Spark puts a filter on the array's size that makes all arrays twice.
    """
    return documents.select("doc_id", F.posexplode_outer("ws").alias("pos", "tok")).where("pos IS NOT NULL")


def all_words(documents: DataFrame) -> DataFrame:
    """``doc_id, tok`` without positions."""
    return documents.select("doc_id", F.explode_outer("ws").alias("tok")).where("tok IS NOT NULL")


@dataclass(frozen=True)
class Index:
    """A written index: ``postings`` (``bucket, tok, doc_id, ps`` with sorted positions), ``docs`` (``doc_id, dl, hs``) and ``words`` (``tok, tf, df``).

    ``dl`` is a document's number of words and ``hs`` the hashes of its different ones. A folder of the postings holds the words of
    one hash bucket, so that a query reads only the folders of its own words.
    """

    postings: DataFrame
    docs: DataFrame
    words: DataFrame
    buckets: int


def _bucket(tok: Column, buckets: int) -> Column:
    return F.pmod(F.hash(tok), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, path: str, buckets: int = 16, splits: int = 4, **columns) -> Index:
    """Writes the index of ``docs`` below ``path``, in one pass over their texts; positions of a word are grouped before they are exchanged.

    A bucket lies in ``splits`` files by the hash of the document, so that the commonest word isn't written by one task.
    """
    documents = doc_words(docs, **columns)
    tokens = cut(documents, "index-words")  # read twice
    tokens.select("doc_id", F.size("ws").alias("dl"), F.transform(F.array_distinct("ws"), lambda w: F.xxhash64(w)).alias("hs")).write.parquet(f"{path}/docs")
    per = positions(tokens).groupBy("tok", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("ps")).withColumn("bucket", _bucket(F.col("tok"), buckets))
    per = per.repartition("bucket", F.pmod(F.hash("doc_id"), F.lit(splits))).sortWithinPartitions("bucket", "tok", "doc_id")
    per.write.partitionBy("bucket").parquet(f"{path}/postings")
    _postings(docs.sparkSession, path, tokens.schema["doc_id"].dataType.simpleString()).groupBy("tok").agg(F.sum(F.size("ps")).alias("tf"), F.count("*").alias("df")).write.parquet(f"{path}/words")
    return read_index(docs.sparkSession, path, buckets)


def _postings(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"tok string, doc_id {kind}, ps array<int>, bucket int").parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str, buckets: int = 16) -> Index:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    kind = spark.read.parquet(f"{path}/docs").schema["doc_id"].dataType.simpleString()
    return Index(_postings(spark, path, kind), read("docs", f"doc_id {kind}, dl int, hs array<bigint>"), read("words", "tok string, tf bigint, df bigint"), buckets)


def postings_of(at: Index, asked: DataFrame, few: int = 1_000) -> DataFrame:
    """``tok, doc_id, ps`` for the words in ``asked`` (a column ``tok``).

    Up to ``few`` words are named in the filter with their buckets, so that only those folders are read; more are joined.
    """
    words_ = asked.select("tok").distinct()
    named = [r["tok"] for r in words_.limit(few + 1).collect()]
    if len(named) <= few:
        spark = asked.sparkSession
        of = spark.createDataFrame([(w,) for w in named], "tok string").select(_bucket(F.col("tok"), at.buckets).alias("b")).distinct() if named else None
        folders = [r["b"] for r in of.collect()] if of is not None else []
        return at.postings.where(F.col("bucket").isin(folders) & F.col("tok").isin(named)).select("tok", "doc_id", "ps")
    return at.postings.join(if_small(words_), "tok", "left_semi").select("tok", "doc_id", "ps")


def positions_of(at: Index, asked: DataFrame) -> DataFrame:
    """``doc_id, pos, tok`` of the words in ``asked``, as :func:`positions` has them of all."""
    return postings_of(at, asked).select("doc_id", F.explode("ps").alias("pos"), "tok")


def vocabulary(documents: DataFrame) -> DataFrame:
    """``tok, tf, df, p``: occurrences, documents, and the share of all occurrences.

    Occurrences and first occurrences are counted together by word, so that one exchange of partial counts is needed.
    """
    first = F.array_distinct("ws")
    each = documents.select(F.explode_outer(F.concat(F.transform("ws", lambda w: F.struct(w.alias("tok"), F.lit(0).alias("one"))), F.transform(first, lambda w: F.struct(w.alias("tok"), F.lit(1).alias("one"))))).alias("x")).where("x IS NOT NULL")
    counts = each.select("x.tok", "x.one").groupBy("tok").agg(F.count_if(F.col("one") == 0).alias("tf"), F.sum("one").alias("df"))
    total = documents.agg(F.sum(F.size("ws")).alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("tok", "tf", "df", (F.col("tf") / F.col("total")).alias("p"))


def term_frequencies_only(documents: DataFrame) -> DataFrame:
    """``tok, tf`` where documents don't matter: partial counts per task, one exchange."""
    return all_words(documents).groupBy("tok").agg(F.count("*").alias("tf"))


def frequencies_of(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """``tok, tf`` of the words in ``asked`` (a column ``tok``) that occur: the vocabulary without counting it all."""
    met = all_words(documents).select("tok").join(if_small(asked.select("tok").distinct()), "tok", "left_semi")
    return met.groupBy("tok").agg(F.count("*").alias("tf"))


def below_probability(vocab: DataFrame, spans: DataFrame, span_words: str, most: float) -> DataFrame:
    """Spans whose first word is rarer than ``most``, by the probabilities of ``vocab``; unknown words have probability 0."""
    first = spans.withColumn("tok", F.element_at(col(span_words), 1))
    return first.join(vocab.select("tok", "p"), "tok", "left").where(F.coalesce("p", F.lit(0.0)) <= most).drop("tok")


def word_probability(spans: DataFrame, key: str, span_words: str, vocab: DataFrame) -> DataFrame:
    """``key, p``: the product of the probabilities of a span's words; words outside the vocabulary are passed over, an empty span has 1."""
    each = spans.select(col(key).alias(key), F.posexplode_outer(col(span_words)).alias("at", "tok"))
    known = each.join(vocab.select("tok", "p"), "tok", "left")
    listed = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("ps"))
    return listed.select(key, numbers.product(F.filter(F.transform("ps", lambda x: x["p"]), lambda p: p.isNotNull())).alias("p"))


def with_token_ids(vocab: DataFrame) -> DataFrame:
    """The vocabulary with ``tok_id`` 0, 1, … from the most frequent word, ties by the word."""
    return numbered(vocab, [F.desc("tf"), "tok"], "tok_id")


def encode(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, ids``: word ids in order of position; unknown words are -1.

    A document's different words, not all its words, meet the vocabulary, and come back as one map.
    """
    each = documents.select("doc_id", F.explode(F.array_distinct("ws")).alias("tok")).join(ids.select("tok", "tok_id"), "tok")
    known = each.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("tok", "tok_id"))).alias("m"))
    met = documents.where(F.size("ws") > 0).join(known, "doc_id", "left")
    return met.select("doc_id", F.transform("ws", lambda w: F.coalesce(F.col("m")[w], F.lit(-1).cast("long"))).alias("ids"))


def decode(coded: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text``: the words of ids, joined by blanks; unknown ids are passed over."""
    at = coded.select("doc_id", F.posexplode("ids").alias("pos", "tok_id")).join(ids.select("tok", "tok_id"), "tok_id")
    grouped = at.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("l"))
    return grouped.select("doc_id", F.array_join(F.transform("l", lambda x: x["tok"]), " ").alias("text"))


def right_extension(ws: Column, pos: Column, length: int, pad: str = "<pad>") -> Column:
    """The ``length`` words from ``pos`` on, clamped at the document's end and padded."""
    taken = F.slice(ws, pos + 1, length)
    return F.concat(taken, F.array_repeat(F.lit(pad), F.lit(length) - F.size(taken)))


def extensions(hits: DataFrame, documents: DataFrame, length: int, from_start: bool = False, pad: str = "<pad>") -> DataFrame:
    """``query_id, doc_id, pos, ext, truncated`` for each hit; from the document's start instead if ``from_start``."""
    met = hits.join(documents, "doc_id")
    pos = F.lit(0) if from_start else F.col("pos")
    return met.select("query_id", "doc_id", "pos", right_extension(F.col("ws"), pos, length, pad).alias("ext"), (F.size("ws") < pos + length).alias("truncated"))


def extension_counts(exts: DataFrame, k: int | None = None) -> DataFrame:
    """``query_id, ext, n``: how often each extension occurs, the ``k`` most frequent of each query if given."""
    counted = exts.groupBy("query_id", "ext").agg(F.count("*").alias("n"))
    if k is None:
        return counted
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), F.array_join("ext", " ")))
    return counted.withColumn("__r", at).where(F.col("__r") <= k).drop("__r")


def passage_counts(exts: DataFrame, pad: str = "<pad>") -> DataFrame:
    """``query_id, passage, n``: the different extensions as text without padding, blank ones dropped, with their numbers."""
    text = F.trim(F.array_join(F.filter("ext", lambda t: t != pad), " "))
    return exts.select("query_id", text.alias("passage")).where("passage <> ''").groupBy("query_id", "passage").agg(F.count("*").alias("n"))


def containing_document(pointers: DataFrame, pointer: str, offsets: DataFrame, offset: str, doc_id: str) -> DataFrame:
    """Each pointer with the document of the greatest offset not above it; pointers before all offsets go to the first.

    Offsets and pointers are sorted together over range partitions. A pointer looks back within its partition, and those before its
    first offset take the last document of the partitions before, of which there is one row a partition.
    """
    kind = offsets.schema[doc_id].dataType
    o = offsets.select(col(offset).cast("long").alias("at"), F.lit(0).alias("asked"), col(doc_id).alias("d"))
    p = pointers.select(col(pointer).cast("long").alias("at"), F.lit(1).alias("asked"), F.lit(None).cast(kind).alias("d"))
    sorted_ = placed(o.unionByName(p), ["at", "asked"])
    back = Window.partitionBy("__pid").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    near = sorted_.withColumn("found", F.last("d", ignorenulls=True).over(back)).where("asked = 1")
    last = sorted_.groupBy("__pid").agg(F.max_by("d", F.when(F.col("asked") == 0, F.col("__at"))).alias("last"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    carried = F.broadcast(last.select("__pid", F.last("last", ignorenulls=True).over(before).alias("carry")))
    head = F.broadcast(o.agg(F.min_by("d", "at").alias("head")))  # one row
    return near.join(carried, "__pid").crossJoin(head).select(F.col("at").alias(pointer), F.coalesce("found", "carry", "head").alias(doc_id))
