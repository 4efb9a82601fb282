from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lexmill.functions import nested, numbers, text


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) and (not v or isinstance(v[0], str)) else 'array<double>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(col.alias("r")).first()["r"]


@pytest.mark.parametrize(("given", "made"), [("  The Cat\tsat on ", ["the", "cat", "sat", "on"]), ("", []), (None, [])])
def test_words(spark, given, made):
    assert one(spark, text.words(F.col("t")), t=given) == made == (given or "").lower().split()


@pytest.mark.parametrize("w", ["iPhone", "USA", "the", "éclair", "x"])
def test_case_variants(spark, w):
    assert one(spark, text.case_variants(F.col("t")), t=w) == list(dict.fromkeys([w, w.lower(), w[:1].upper() + w[1:].lower()]))


@pytest.mark.parametrize("p", ["it's a dog's life", "3d printers", "CO2 levels", "o'neil", "heat pump"])
def test_titled_is_pythons(spark, p):
    assert one(spark, text.titled(F.col("t")), t=p) == p.title()


def test_content_words_and_chunks(spark):
    assert one(spark, text.content_words(F.col("t")), t="the role of a heat pump") == ["role", "heat", "pump"]
    assert one(spark, text.stopword_chunks(F.col("t")), t="price of the heat pump in winter") == ["price", "heat pump", "winter"]
    assert one(spark, text.is_usable_keyword(F.col("t")), t="of the pump") is False
    assert one(spark, text.is_usable_keyword(F.col("t")), t="pump") is True
    assert one(spark, text.is_usable_keyword(F.col("t")), t="of the") is False


def test_sentences(spark):
    assert one(spark, text.sentences(F.col("t")), t="One is here.  Two is\nhere! 3 is? no. end") == ["One is here.", "Two is here!", "3 is? no. end"]
    assert one(spark, text.line_sentences(F.col("t")), t="One. Two\nthree. Four") == ["One.", "Two", "three.", "Four"]


def test_clean_html(spark):
    assert one(spark, text.clean_html(F.col("t")), t="a&lt;br&gt;b<DIV class='x'>c</div> d &amp;amp; <pre>e</pre><u>f</u>") == "a b c  d &amp;  e <u>f</u>"


def test_all_entities(spark):
    assert one(spark, text.clean_html(F.col("t"), all_entities=True), t="caf&eacute; &#x41; &lt;p&gt;x") == "café A  x"


def test_stems_and_occurrences(spark):
    assert one(spark, text.prefix_stems(F.col("t"), 5), t="civilian") == ["civil", "civili", "civilia", "civilian"]
    assert one(spark, text.prefix_stems(F.col("t"), 5), t="civi") == []
    assert one(spark, text.occurrences(F.col("t"), F.col("k")), t="aAaa b", k="aa") == 2
    assert one(spark, text.occurrences(F.col("t"), F.col("k")), t="a", k="") == 0
    assert one(spark, text.holds(F.col("t"), F.col("k")), t="Heat Pump", k="heat p") is True


def test_step_class_and_describe(spark):
    assert [one(spark, text.step_class(F.col("t")), t=t) for t in ("a", "a AND b", "a AND b AND c")] == ["standalone", "2way_and", "3way_and"]
    df = spark.createDataFrame([([["a", "b"], ["c", "d", "e", "f"]],)], "c array<array<string>>")
    assert df.select(text.describe(F.col("c"))).first()[0] == "(a OR b) AND (c OR d OR e +1)"
    assert one(spark, text.qid_of_path(F.col("t")), t="file:/x/y/q12.jsonl.gz") == "q12"


def test_glue(spark):
    rows = [("a", 0, "vi", 0.5), ("a", 1, "##car", 0.9), ("a", 2, "##ious", 0.1), ("a", 3, "trauma", 0.7)]
    out = text.glue_wordpieces(spark.createDataFrame(rows, "q string, pos int, piece string, s double"), "word", ["q"], "pos", "piece", "s")
    assert {(r["word"], r["s"]) for r in out.collect()} == {("vicarious", 0.9), ("trauma", 0.7)}


def test_numbers(spark):
    assert one(spark, numbers.product(F.col("a")), a=[0.5, 0.5]) == 0.25
    assert one(spark, numbers.combined_score(F.col("s"), F.col("p")), s=2.0, p=0.0) == pytest.approx(2 * math.log(1e15))
    assert one(spark, numbers.dampened_tf(F.col("c")), c=5) == pytest.approx(1 + math.log(5))
    assert one(spark, numbers.dampened_tf(F.col("c")), c=0) == 1.0
    assert one(spark, numbers.specificity(F.col("c")), c=999_999) == 0.0
    assert one(spark, numbers.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) is None
    assert one(spark, numbers.cosine(F.col("a"), F.col("b")), a=[1.0, 1.0], b=[1.0, 0.0]) == pytest.approx(2**-0.5)
    assert one(spark, numbers.index_percentile(F.col("a"), 50), a=[4.0, 1.0, 3.0, 2.0]) == 3.0


def test_on_grid(spark):
    curves = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 5.0), ("b", 5.0, 1.0)], "k string, x double, y double")
    grid = spark.createDataFrame([(-1.0,), (4.0,), (10.0,), (20.0,)], "g double")
    got = {(r["k"], r["g"]): r["y"] for r in numbers.on_grid(curves, "k", "x", "y", grid, "g").collect()}
    assert got == {("a", -1.0): 0.0, ("a", 4.0): 2.0, ("a", 10.0): 5.0, ("a", 20.0): 5.0, **{("b", g): 1.0 for g in (-1.0, 4.0, 10.0, 20.0)}}


def test_sublists(spark):
    assert one(spark, nested.starts_of(F.col("t"), F.col("p")), t=["a", "b", "a", "b", "a"], p=["a", "b", "a"]) == [0, 2]
    assert one(spark, nested.starts_of(F.col("t"), F.col("p")), t=["a"], p=["a", "b"]) == []
    assert one(spark, nested.starts_of(F.col("t"), F.col("p")), t=["a"], p=[]) == []
    assert one(spark, nested.is_sublist(F.col("p"), F.col("t")), t=["a", "b"], p=["a", "b"]) is False
    assert one(spark, nested.ngrams(F.col("t"), 2, 3), t=["a", "b", "c"]) == ["a b", "b c", "a b c"]
    assert one(spark, nested.ngrams(F.col("t"), 2, 3), t=["a"]) == []
    assert one(spark, nested.holds_all(F.col("t"), F.col("p")), t=["a", "b"], p=["b", "a"]) is True


def test_expansions(spark):
    df = spark.createDataFrame([({"x": ["a", "b", "c"], "y": None}, ["d"], None)], "k map<string,array<string>>, a array<string>, v map<string,array<string>>")
    got = df.select(F.explode(nested.expansion_terms(F.col("k"), F.col("a"), F.col("v"))).alias("e")).select("e.*").collect()
    assert [tuple(r) for r in got] == [("key", "x", "a"), ("key", "x", "b"), ("key", "x", "c"), ("assoc", "", "d")]
    assert df.select(nested.is_valid_expansion(F.col("k"), F.col("a"))).first()[0] is False
