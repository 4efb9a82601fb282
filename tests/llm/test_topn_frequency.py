from __future__ import annotations

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.llm import frequency, topn


def best(rows, n):
    by = {}
    for g, i, s in rows:
        if g is not None and i and s is not None and not math.isnan(s):
            by.setdefault(g, {})[i] = max(s, by.get(g, {}).get(i, -math.inf))
    out = {}
    for g, items in by.items():
        for k, (i, s) in enumerate(sorted(items.items(), key=lambda x: (x[1], x[0].encode()), reverse=True)[:n], 1):
            out[g, k] = (i, s)
    return out


@pytest.mark.parametrize(("n", "broadcast_rows"), [(1, 1000), (10, 1000), (10, 0)])
def test_top_n_against_sorting(spark, n, broadcast_rows):
    rng = random.Random(n)
    values = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1e-300, 1e300]
    rows = [(f"g{rng.randrange(8)}" if rng.random() < 0.5 else "hot", f"d{rng.randrange(900)}", rng.choice(values) if rng.random() < 0.1 else round(rng.uniform(-3, 3), 2)) for _ in range(6000)]
    rows += [("tied", f"t{i}", 0.5) for i in range(700)] + [(None, "d", 1.0), ("g0", None, 9.0), ("g0", "", 9.0), ("few", "é", 1.0), ("few", "z", 1.0)]
    rows += rows[:200]
    df = spark.createDataFrame(rows, "g string, i string, s double").withColumn("bucket", F.lit("x")).withColumn("rank_no", F.lit(7)).repartition(5)
    got = {(r["g"], r["rank_no"]): (r["i"], r["s"]) for r in topn.top_n_per_group(df, ["g"], "i", "s", n, broadcast_rows=broadcast_rows).collect()}
    assert got == best(rows, n)


def test_threshold_drops_rows_of_large_groups(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("i"), (F.col("id") / 20_000).alias("s"))
    top = topn.top_n_per_group(df, ["g"], "i", "s", 10)
    assert [r["i"] for r in top.orderBy("rank_no").collect()] == [str(i) for i in range(19_999, 19_989, -1)]


def test_buckets_rise_with_scores(spark):
    values = sorted([-1e308, -3.0, -1.0, -1e-310, 0.0, 5e-324, 1e-9, 0.1, 0.100001, 1.0, 2.0, 1e308, float("inf"), -float("inf")])
    df = spark.createDataFrame([(v,) for v in values], "s double")
    b = [r[0] for r in df.orderBy("s").select(topn.score_bucket(F.col("s"))).collect()]
    assert b == sorted(b) and len(set(b)) > 8


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "qid string, biencoder_ranked array<struct<doc_id:string,score:double>>, crossencoder_ranked array<struct<doc_id:string,score:double>>")
    assert topn.top_documents(df).count() == 0
    rows = [("q", None, [("d", 1.0), None]), ("q", [], None), (None, [("d", 1.0)], None)]
    assert [tuple(r) for r in topn.top_documents(spark.createDataFrame(rows, df.schema)).collect()] == [("q", "crossencoder_ranked", 1, "d")]
    with pytest.raises(ValueError, match="at least 1"):
        topn.top_n_per_group(df, ["qid"], "qid", "qid", 0)


TEXTS = ["The cat, the CAT and 3 dogs.", "", None, "  ", "a-b_c d", "été ÉTÉ ete", "word " * 3000, "x1 ²3 ½ ☃ Ωmega"]


@pytest.mark.parametrize("held", [10**6, 8])
def test_words_against_counter(spark, held):
    rng = random.Random(1)
    docs = [(f"d{i}", t) for i, t in enumerate(TEXTS)] + [(f"r{i}", " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(20))) for i in range(60)]
    df = spark.createDataFrame([*docs, docs[0], docs[9], (None, "lost words")], "doc_id string, segment string").withColumn("txt", F.lit("other")).repartition(3)
    out = frequency.term_frequencies(frequency.text_records(df, "doc_id", "segment", "segment"), {"segment": 20.0}, held_bytes=held).collect()
    tf, rec = collections.Counter(), collections.Counter()
    for _, t in docs:
        ws = re.findall(r"[^\W_]+", (t or "").lower())
        tf.update(ws)
        rec.update(set(ws))
    n = sum(t is not None for _, t in docs)
    assert {r["term"]: (r["occurrences"], r["records"]) for r in out} == {w: (tf[w], rec[w]) for w in tf}
    assert {r["term"]: r["mark"] for r in out} == {w: "rare" if rec[w] <= 2 else "common" if rec[w] * 5 > n else None for w in tf}


def test_values(spark):
    rows = [(1, ["Heat  Pump", "heat pump ", None, "", " \t"]), (1, ["Heat  Pump", "heat pump ", None, "", " \t"]), (2, None), (3, []), (4, ["HEAT\r\npump"]), (None, ["zz"])]
    out = frequency.term_frequencies(frequency.value_records(spark.createDataFrame(rows, "i long, v array<string>"), "i", "v", "f"), {"f": 1.0}).collect()
    assert [tuple(r) for r in out] == [("f", "heat pump", 3, 2, "rare")]


def test_portions_keep_records(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(frequency, "PORTION", 400)
    texts = ["short one", "a bb ccc " * 200, None, "x" * 3000, "", "one more"]
    t = pa.table({"field_name": ["f"] * 6, "txt": pa.array(texts, pa.string()), "vals": pa.array([None] * 6, pa.list_(pa.string()))})
    out = pa.Table.from_batches(list(frequency._count_batches(iter(t.to_batches()), 10**6))).to_pylist()
    got = {r["term"]: (r["occurrences"], r["records"]) for r in out}
    assert got == {None: (0, 6), "short": (1, 1), "one": (2, 2), "a": (200, 1), "bb": (200, 1), "ccc": (200, 1), "x" * 3000: (1, 1), "more": (1, 1)}


def test_terms_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id string, segment string")
    assert frequency.term_frequencies(frequency.text_records(df, "doc_id", "segment", "segment"), {"segment": 20.0}).count() == 0


def test_spilled_parts_add_up(tmp_path):
    import pyarrow as pa

    rng = random.Random(2)
    rows = [("f", f"t{rng.randrange(500)}", 1, 1) for _ in range(20_000)]
    batches = [pa.RecordBatch.from_pylist([{"field_name": f, "term": t, "occurrences": o, "records": r, "h": hash(t) & (2**62 - 1)} for f, t, o, r in rows[i : i + 1000]], frequency._PARTIAL) for i in range(0, len(rows), 1000)]
    out = pa.Table.from_batches(list(frequency._radix_add_up(iter(batches), str(tmp_path), 100))).to_pylist()
    assert {r["term"]: r["occurrences"] for r in out} == dict(collections.Counter(t for _, t, _, _ in rows))
    assert len(out) == len({r["term"] for r in out})
    assert not list(tmp_path.iterdir())
