"""Problem 2: how often every term occurs and in how many records.

Method: recursive radix spilling. Each task first adds up its own records with DuckDB, so that a term found
everywhere leaves a task as one row; the partial counts are shuffled by their hash; each receiving task adds them
up in DuckDB, and where it gets more bytes than it may hold, it spills them by the next hash bits into files and
does the parts one after the other, splitting a part that is still too large by the bits after those. DuckDB itself
may go out of core into the scratch folder that Spark gives the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.plans.shared import col, cut, fresh_path

#: RE2 and Java spelling of a word: a maximal run of letters and digits.
WORD = r"[\p{L}\p{N}]+"
#: Bytes of partial counts that one task holds at once, and hash bits of one split.
HELD_BYTES, FAN_OUT_BITS = 64_000_000, 4
#: Bytes of texts that DuckDB counts at once.
PORTION = 16_000_000
_NO_WORD = re.compile(r"[\W_]")

_PARTIAL = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64()), ("h", pa.int64())])
_TOTAL = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def text_records(df: DataFrame, id_col: str, text_col: str, field_name: str) -> DataFrame:
    """Records of a text field: one row for each id with a non-null text (rows delivered twice count once)."""
    one = df.select(col(id_col).alias("id"), F.lower(col(text_col)).alias("txt")).where(F.col("txt").isNotNull() & F.col("id").isNotNull()).dropDuplicates(["id"])
    return one.select(F.lit(field_name).alias("field_name"), "txt", F.lit(None).cast("array<string>").alias("vals"))


def tidy_value(value: Column) -> Column:
    """Lower-cased, each run of blank, tab, CR, LF and no-break space made one blank, end blanks removed."""
    return F.trim(F.regexp_replace(F.lower(value), "[ \\t\\r\\n\\u00a0]+", " "))


def value_records(df: DataFrame, id_col: str, values_col: str, field_name: str) -> DataFrame:
    """Records of a list field: one row for each id with a non-null list; null and empty values are dropped."""
    one = df.select(col(id_col).alias("id"), col(values_col).alias("vals")).where(F.col("vals").isNotNull() & F.col("id").isNotNull()).dropDuplicates(["id"])
    vals = F.filter(F.transform("vals", tidy_value), lambda x: x.isNotNull() & (x != ""))
    return one.select(F.lit(field_name).alias("field_name"), F.lit(None).cast("string").alias("txt"), vals.alias("vals"))


def _connect():
    """A connection of one task; what it can't hold goes to Spark's own scratch folder of the task."""
    import os
    import uuid

    import duckdb

    scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": f"{scratch}/duckdb-{uuid.uuid4().hex}" if scratch else ""})
    con.execute("SET preserve_insertion_order = false")
    return con


def _add_up(con, parts: list[pa.Table]) -> pa.Table:
    counted = pa.concat_tables(parts)  # noqa: F841 - DuckDB finds it by name
    return con.sql("SELECT field_name, term, CAST(sum(occurrences) AS BIGINT) occurrences, CAST(sum(records) AS BIGINT) records, any_value(h) h FROM counted GROUP BY field_name, term").to_arrow_table().cast(_PARTIAL)


def _portions(t: pa.Table) -> Iterator[pa.Table]:
    """``t`` in portions of at most :data:`PORTION` bytes, with a column ``rid`` that numbers the records.

    A single text beyond that becomes several rows of one record, cut where no word is.
    """
    if t.nbytes <= PORTION:
        yield t.append_column("rid", pa.array(range(t.num_rows), pa.int64()))
    elif t.num_rows > 1:
        half = t.num_rows // 2
        yield from _portions(t.slice(0, half).combine_chunks())
        yield from _portions(t.slice(half).combine_chunks())
    else:
        text, parts = t["txt"][0].as_py(), []
        while text:
            gap = _NO_WORD.search(text, PORTION // 4)
            end = gap.end() if gap else len(text)
            parts.append(text[:end])
            text = text[end:]
        n = max(1, len(parts))
        first = t["vals"].to_pylist()
        yield pa.table({"field_name": t["field_name"].to_pylist() * n, "txt": pa.array(parts or [None], pa.string()), "vals": pa.array(first + [None] * (n - 1), t.schema.field("vals").type), "rid": pa.array([0] * n, pa.int64())})


def _count_batches(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    con, parts, size = _connect(), [], 0
    count = f"""
        WITH r AS (SELECT field_name, rid, CASE WHEN vals IS NULL THEN regexp_extract_all(txt, '{WORD}') ELSE vals END words FROM t),
        w AS (SELECT field_name, rid, unnest(words) term FROM r),
        per AS (SELECT field_name, rid, term, count(*) tf FROM w GROUP BY ALL)
        SELECT field_name, term, CAST(sum(tf) AS BIGINT) occurrences, count(*) records, CAST(hash(term) >> 1 AS BIGINT) h FROM per GROUP BY field_name, term
        UNION ALL SELECT field_name, NULL, 0, count(DISTINCT rid), 0 FROM r GROUP BY field_name"""
    for batch in batches:
        for t in _portions(pa.Table.from_batches([batch])) if batch.num_rows else ():  # noqa: B007 - DuckDB finds t by name
            parts.append(con.sql(count).to_arrow_table().cast(_PARTIAL))
            size += parts[-1].nbytes
            if size > held:
                parts = [_add_up(con, parts)]
                if parts[0].nbytes > held // 2:  # not worth holding on to
                    yield from parts[0].to_batches(50_000)
                    parts = []
                size = sum(p.nbytes for p in parts)
    if parts:
        yield from _add_up(con, parts).to_batches(50_000)


def _radix_add_up(batches: Iterator[pa.RecordBatch], scratch: str, held: int, shift: int = 0) -> Iterator[pa.RecordBatch]:
    """Adds up partial counts, spilling by the hash bits above ``shift`` where they have more than ``held`` bytes."""
    import uuid

    import pyarrow.compute as pc
    import pyarrow.feather as feather
    from pyarrow import fs

    con, parts, size = _connect(), [], 0
    files, spilled, store, place = {}, set(), None, ""

    def spill() -> None:
        nonlocal store, place
        if store is None:
            store, root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", scratch))
            place = f"{root}/{uuid.uuid4().hex}"
            store.create_dir(place, recursive=True)
        held_now = _add_up(con, parts)
        digit = pc.bit_wise_and(pc.shift_right(held_now["h"], shift), (1 << FAN_OUT_BITS) - 1)
        for d in range(1 << FAN_OUT_BITS):
            part = held_now.filter(pc.equal(digit, d))
            if part.num_rows:
                files[d] = files.get(d, 0) + 1
                with store.open_output_stream(f"{place}/{d}-{files[d]}") as out:
                    feather.write_feather(part, out, compression="lz4")
                spilled.add(d)

    for batch in batches:
        if batch.num_rows:
            parts.append(pa.Table.from_batches([batch]).cast(_PARTIAL))
            size += parts[-1].nbytes
            if size > held:
                merged = _add_up(con, parts)
                parts, size = [merged], merged.nbytes
                # a single term can't be split further, whatever its length
                if size > held // 2 and shift < 40 and merged.num_rows > 1:
                    spill()
                    parts, size = [], 0
    if not spilled:
        if parts:
            yield from _add_up(con, parts).select(_TOTAL.names).to_batches(50_000)
        return
    if parts:
        spill()
        parts = []
    try:
        for d in sorted(spilled):

            def read(d: int = d) -> Iterator[pa.RecordBatch]:
                for k in range(1, files[d] + 1):
                    with store.open_input_file(f"{place}/{d}-{k}") as src:
                        yield from feather.read_table(src).to_batches(50_000)

            yield from _radix_add_up(read(), scratch, held, shift + FAN_OUT_BITS)
    finally:
        store.delete_dir(place)


def term_counts(records: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``field_name, term, occurrences, records`` of each term, and for each field a row with a null term and its number of records.

    ``records`` as from :func:`text_records` and :func:`value_records`, or a union of such. Empty fields and empty
    tables give no terms. Words are those of :data:`WORD` in the lower-cased whole text.
    """
    scratch = fresh_path(records.sparkSession, "radix")
    partial = records.select("field_name", "txt", "vals").mapInArrow(lambda it: _count_batches(it, held_bytes), "field_name string, term string, occurrences long, records long, h long")
    # the upper hash bits choose the task, the lower ones are left for splitting within it
    shuffled = partial.repartition(F.shiftright("h", 40))
    return shuffled.mapInArrow(lambda it: _radix_add_up(it, scratch, held_bytes), "field_name string, term string, occurrences long, records long")


def term_frequencies(records: DataFrame, common_percent: Mapping[str, float], rare_records: int = 2, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``field_name, term, occurrences, records, mark`` of every term of every field.

    ``mark`` is ``rare`` if at most ``rare_records`` records hold the term, else ``common`` if more than
    ``common_percent[field]`` per cent of the field's records do, else null.
    """
    counted = cut(term_counts(records, held_bytes), "terms")
    total = {r["field_name"]: r["records"] for r in counted.where(F.col("term").isNull()).groupBy("field_name").agg(F.sum("records").alias("records")).collect()}  # a row a field
    mark = F.when(F.col("records") <= rare_records, F.lit("rare"))
    for field, percent in common_percent.items():
        mark = mark.when((F.col("field_name") == field) & (F.col("records") * 100 > F.lit(float(percent)) * total.get(field, 0)), F.lit("common"))
    return counted.where(F.col("term").isNotNull()).withColumn("mark", mark)


#: Fixed shares of the problem: above them a term is common, in per cent of the field's records.
COMMON_PERCENT = {"segment": 20.0, "associated_terms": 1.0}


def passage_and_expansion_terms(passages: DataFrame, expansions: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The terms of ``passages.segment`` and ``api_expansions.associated_terms`` with their counts and marks."""
    records = text_records(passages, "doc_id", "segment", "segment").unionByName(value_records(expansions, "expansion_id", "associated_terms", "associated_terms"))
    return term_frequencies(records, COMMON_PERCENT, held_bytes=held_bytes)
