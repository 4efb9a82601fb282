from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.llm import lookalikes, mixing, tokens

TARGETS = "mix_id int, source string, target_share double, max_repeats int"


def test_water_fill():
    assert mixing.water_fill([0.5, 0.5], [100, 100], 100) == [50, 50]
    assert mixing.water_fill([0.5, 0.3, 0.2], [20, 100, 100], 100) == pytest.approx([20, 48, 32])
    assert mixing.water_fill([0.5, 0.5], [10, 20], 100) == [10, 20]
    assert mixing.water_fill([0.0, 1.0, 0.5], [10, 0, 20], 30) == [0, 0, 20]
    assert mixing.water_fill([], [], 5) == []
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 7)
        t, c = [rng.random() for _ in range(n)], [rng.choice([0, rng.random() * 50]) for _ in range(n)]
        got = mixing.water_fill(t, c, 60)
        assert sum(got) == pytest.approx(min(60, sum(c))) and all(g <= x + 1e-9 for g, x in zip(got, c))
        free = [g / x for g, x, cap in zip(got, t, c) if g < cap - 1e-9]
        assert not free or max(free) == pytest.approx(min(free))
        assert all(g / x <= min(free) + 1e-9 for g, x, cap in zip(got, t, c) if cap and free and g >= cap - 1e-9)


def test_mix_reaches_what_it_planned(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["web"] * 6 + ["book", "code", None, "rest"]), rng.choice([None, 0, 5, 50, 500])) for i in range(6000)]
    sized = spark.createDataFrame([*docs, (None, "web", 10**9)], "doc_id long, source string, n_tokens long").withColumn("copies", F.lit(9)).withColumn("h", F.lit(1))
    targets = spark.createDataFrame([(1, "web", 0.2, 1), (1, "book", 0.5, 2), (1, "code", 0.3, 5), (2, "book", 0.9, 1), (2, "absent", 0.1, 3), (3, "web", 1.0, 3), (None, "web", 1.0, 1)], TARGETS)
    drawn, report = mixing.mix(sized, targets)
    size = {i: n or 0 for i, _, n in docs}
    by: dict = {}
    for r in drawn.collect():
        by.setdefault((r["mix_id"], r["source"]), []).append(r)
    total = sum(size.values())
    for r in report.collect():
        mine = by.get((r["mix_id"], r["source"]), [])
        own = sum(size[i] for i, s, _ in docs if s == r["source"])
        assert r["total_tokens"] == total and r["source_tokens"] == own
        assert r["short"] == (r["max_repeats"] * own < r["target_share"] * total)
        assert r["drawn_tokens"] == sum(size[x["doc_id"]] * x["copies"] for x in mine)
        assert abs(r["drawn_tokens"] - r["planned_tokens"]) < 500
        assert all(1 <= x["copies"] <= r["max_repeats"] for x in mine) and len({x["doc_id"] for x in mine}) == len(mine)
    again, _ = mixing.mix(sized.repartition(7), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))
    other, _ = mixing.mix(sized, targets, seed=18)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, drawn.collect()))


def test_mix_of_nothing(spark):
    sized = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([(1, "web", 1.0, 2)], TARGETS)
    drawn, report = mixing.mix(sized, targets)
    assert drawn.count() == 0
    r = report.first()
    assert (r["source_tokens"], r["drawn_tokens"], r["reached_share"], r["short"]) == (0, 0, None, False)
    assert mixing.mix(sized, targets.limit(0))[1].count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "naïve Привет 👍"), (5, "x" * 100_000)], "doc_id long, text string").withColumn("n_tokens", F.lit(-1))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 3 and got[5] > 1000
    enc = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    text = "Any text, même ça: 12 345 <|endoftext|>\n\n  ok"
    assert enc.decode(enc.encode_ordinary(text)) == text


TABLE = lookalikes.prototypes()
SAME = [("ｗｉｄｅ　１２", "wide 12"), ("café", "café"), ("a​b­c﻿", "abc"), ("a b c", "a b c"), ("Русо", "Pyco"), ("ΑΒΕ ο", "ABE o"), ("Ångström K", "Ångström K"), ("ё", "ё"), ("ɡо", "go"), ("ﾊﾞ", "バ"), ("x︎͏y", "xy"), ("Ꭺꓮ", "AA"), ("ⲟᴏ", "oo"), ("Ⅿıx", "Mix"), ("а\u200dб", "aб"), ("l\u2066o\u200eg\u2069", "log"), ("ө", "ө"), ("é\u00ad", "е\u0301")]
DIFFERENT = [("A", "a"), ("cafe", "café"), ("a-b", "a–b"), ("'a'", "’a’"), ("x²", "x2"), ("l0", "lO"), ("a b", "a  b"), ("1", "l"), ("I", "l"), ("a\nb", "a b"), ("ﬁ", "f i"), ("m²", "m2"), ("٣\u0600", "٣"), ("\u0600٣", "٣"), ("می\u200cخواهم", "میخواهم"), ("क्\u200dष", "क्ष"), ("З", "3"), ("б", "6"), ("к", "k"), ("a\u202ebc", "abc"), ("👨\u200d👩", "👨👩"), ("❤\ufe0f", "❤"), ("\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", "\U0001f3f4\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f"), ("葛\U000e0100", "葛")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_equal_to_the_eye(a, b):
    assert lookalikes.skeleton(a, TABLE) == lookalikes.skeleton(b, TABLE)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_visibly_different(a, b):
    assert lookalikes.skeleton(a, TABLE) != lookalikes.skeleton(b, TABLE)


def test_a_skeleton_is_its_own():
    rng = random.Random(5)
    for _ in range(500):
        s = lookalikes.skeleton("".join(chr(rng.choice([rng.randrange(32, 0x600), rng.randrange(0x1E00, 0x3100), rng.randrange(0xFF00, 0xFFEF)])) for _ in range(12)), TABLE)
        assert lookalikes.skeleton(s, TABLE) == s == unicodedata.normalize("NFD", s)


def test_pairs_and_groups_against_all_pairs(spark):
    rng = random.Random(7)
    base = ["a cat", "the mоon", "x", "Übung", "one two", "long " * 20_000]
    swap = str.maketrans({"a": "а", "o": "ο", " ": " ", "e": "е"})
    docs = []
    for i in range(120):
        t = rng.choice(base)
        docs.append((i, rng.choice([t, t.translate(swap), unicodedata.normalize("NFD", t), t + "​", t.upper()])))
    docs += [(500, None), (501, ""), (502, " "), (503, " ​"), (504, "  ")]
    df = spark.createDataFrame([*docs, docs[0], docs[1], (None, "x")], "doc_id long, text string").withColumn("look", F.lit(1)).withColumn("blank", F.lit("x"))
    looks = {i: lookalikes.skeleton(t, TABLE) for i, t in docs if t is not None}
    text = dict(docs)
    solid = [i for i, s in looks.items() if s.strip()]
    want = {(a, b) for a in solid for b in solid if a < b and looks[a] == looks[b] and text[a] != text[b]}
    got = [(r["doc_id_a"], r["doc_id_b"]) for r in lookalikes.look_alike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r["doc_id"]: (r["group_id"], r["n_forms"]) for r in lookalikes.look_alike_groups(df).collect()}
    assert groups == {i: (min(j for j in solid if looks[j] == looks[i]), len({text[j] for j in solid if looks[j] == looks[i]})) for i in solid}
    assert lookalikes.look_alike_pairs(df.limit(0)).count() == 0


def test_consistent_texts_of_all_documents(spark):
    """Every document has one text, blank ones too; equal looks give equal texts, and again the same."""
    rows = [(1, "café price"), (2, "café price"), (3, "сafé ｐrice​"), (4, "cafe price"), (5, " ​"), (6, ""), (7, None), (1, "café price")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lookalikes.consistent_texts(df)
    out = {r["doc_id"]: r["text"] for r in got.collect()}
    assert got.count() == 6
    assert out == {1: "café price", 2: "café price", 3: "café price", 4: "cafe price", 5: " ", 6: ""}
    assert {r["doc_id"]: r["text"] for r in lookalikes.consistent_texts(got).collect()} == out
