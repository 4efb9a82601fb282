from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexmill.llm import pairs, splitting

SCHEMA = "expansion_id long, text string, key_entities map<string,array<string>>, associated_terms array<string>, verbs map<string,array<string>>"
V = {"v": ["do"]}


def runs(prompt, words):
    """The longest run ending at each word that the prompt holds, by trying all."""
    joined = [tuple(prompt[i:j]) for i in range(len(prompt)) for j in range(i + 1, len(prompt) + 1)]
    return [max([n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in joined], default=0) for i in range(len(words))]


def test_suffix_automaton_against_all_substrings():
    rng = random.Random(4)
    for _ in range(200):
        prompt = [rng.choice("abc") for _ in range(rng.randrange(0, 9))]
        words = [rng.choice("abcd") for _ in range(rng.randrange(0, 9))]
        sam = pairs.SuffixAutomaton(prompt)
        longest = runs(prompt, words)
        assert list(sam.longest_matches(words)) == longest
        assert sam.covered(words) == len({k for i, n in enumerate(longest) for k in range(i + 1 - n, i + 1)})


@pytest.mark.parametrize(("term", "open_"), [("a (b)", False), ("a (b", True), ('say "x"', False), ('say "x', True), ("«a", True), ("a)", False), ("", False)])
def test_delimiters(term, open_):
    assert pairs.unclosed(term) is open_


@pytest.mark.parametrize(("term", "short"), [("coal mine...", True), ("mot vide et les", True), ("coal mine etc.", False), ("coal mine no. 4", False), ("soil,", True), ("and", False), ("harvest (policy)", False), ("orchard such as", True)])
def test_endings(term, short):
    assert pairs.stops_short(term) is short


def found(spark, rows, **kw):
    good = [(1000 + i, f"why did {t} change near the {u} after 1990", {t: [t, f"cost of {t}", f"{u} policy"], u: [u, f"quality of {u}", f"{t} survey"]}, [f"history of {t}", f"supply of {u}", t, u, "insulation of irrigation", "irrigation"], V) for i in range(40) for t, u in [("heat pump", "power grid"), ("coal mine", "insulation")]]
    good += [(2000 + i, f"pourquoi la {t} change le {u} depuis 1990", {t: [t, f"coût pour {t}", f"{u} politique"], u: [u, f"qualité pour {u}"]}, [f"histoire pour {t}", f"pénurie pour {u}", t, u], V) for i in range(40) for t, u in [("sécheresse", "verger"), ("récolte", "bétail")]]
    df = spark.createDataFrame([*rows, *good], SCHEMA).withColumn("defect", F.lit("clash")).withColumn("lang", F.lit("xx"))
    out = {r["expansion_id"]: r["defect"] for r in pairs.pair_defects(df, **kw).collect()}
    return {k: v for k, v in out.items() if k < 1000}, {v for k, v in out.items() if k >= 1000}


def test_each_defect(spark):
    fr = {"sécheresse": ["sécheresse", "coût pour verger", "récolte"], "verger": ["verger politique", "qualité pour bétail"]}
    rows = [
        (1, "heat pump cost", None, None, None),
        (2, "heat pump cost", {"": [" ", "n/a"], "x": None}, ["...", None, " "], None),
        (3, "heat pump cost", {"message": ["I'm sorry, but I can't help with that request."]}, [], None),
        (4, "heat pump cost", None, ["Je suis désolé", "je ne peux pas répondre à cette demande."], None),
        (5, "how to say sorry in a letter", {"apology": ["I'm sorry card", "letter of regret", "cannot attend"]}, ["sorry note", "unable to come"], V),
        (6, "best heat pump cost in Oslo", {"heat": ["Heat Pump", "heat pump cost"]}, ["in Oslo", "best heat pump cost in Oslo?"], {}),
        (7, "what is the heat pump cost", {"heat pump": ["heat pump", "cost of heat pump"]}, ["supply of irrig"], None),
        (8, "what is the heat pump cost", {"heat pump": ["heat pump", "cost of heat pump (especially"]}, None, None),
        (9, "what is the heat pump cost", {"heat pump": ["heat pump", "coal mine etc."]}, ["power grid", "insulation"], None),
        (10, "what is the cost of the heat pump", fr, ["histoire pour sécheresse", "pénurie pour verger"], V),
        (11, "what is the cost of the heat pump", {"heat pump": ["cost of heat pump", "heat pump survey"]}, ["histoire pour sécheresse", "pénurie pour verger", "récolte", "bétail"], V),
        (12, "what is the cost of the heat pump", {"heat pump": ["cost of heat pump", "heat pump survey"]}, ["power grid", "récolte", "coal mine"], V),
        (13, None, {"heat pump": ["cost of heat pump"]}, ["power grid"], None),
        (14, "", {"heat pump": ["cost of heat pump"]}, ["power grid " * 5000], V),
        (15, "heat pump cost", {"x": ["heat pump survey", "I cannot provide keyword expansions for this query."]}, ["power grid", "coal mine", "insulation"], V),
        (16, "what is the heat pump cost", {"heat pump": ["heat pump", "cost of power grid"], "power grid": ["insulation survey"]}, None, None),
        (17, "what is the heat pump cost", {"heat pump": ["heat pump", "cost of heat pump", "power grid"], "power grid": ["power grid", "insulation Zumrab"]}, None, V),
        (18, "what is the heat pump cost", {"heat pump": ["тепловой насос", "цена насоса"]}, ["сеть", "power grid"], V),
        (19, "what is the heat pump cost", {"heat pump": ["heat pump", "cost of heat pump", "насос"]}, ["power grid", "coal mine"], V),
    ]
    got, others = found(spark, [*rows, rows[0], (None, "a", None, None, None)])
    assert got == {1: "empty", 2: "empty", 3: "refusal", 4: "refusal", 5: None, 6: "copied", 7: "truncated", 8: "truncated", 9: None, 10: "other_language", 11: "other_language", 12: None, 13: None, 14: None, 15: None, 16: None, 17: None, 18: "other_language", 19: None}
    assert others == {None}


REFUSALS = [
    ["I'm sorry", "but I cannot", "as an assistant", "help with that"],
    ["We are not able to give such a list."],
    ["Unfortunately this is not something that can be listed."],
    ["Ich kann Ihnen hierzu leider keine Auskunft geben."],
    ["Tyvärr kan jag inte hjälpa till med det här."],
    ["Jag får inte svara på den frågan."],
    ["Mi dispiace, non posso rispondere a questa domanda."],
    ["Infelizmente", "não consigo responder a isso."],
    ["Helaas kan ik deze vraag niet beantwoorden."],
    ["Przykro mi, ale nie mogę odpowiedzieć."],
    ["К сожалению, я не могу помочь с этим запросом."],
    ["很抱歉，我无法提供这些词语。"],
    ["申し訳ありませんが、その質問にはお答えできません。"],
    ["Üzgünüm, bu konuda yardımcı olamam."],
    ["Saya tidak dapat membantu permintaan ini."],
    ["Sajnálom, de ebben nem tudok segíteni."],
    ["Is oth liom nach féidir liom freagra a thabhairt."],  # a language without marks: a whole sentence in the place of terms
]
NO_REFUSALS = [
    ["sorry note", "cannot attend", "unable to come", "I'm sorry card"],
    ["I'm sorry", "my apologies", "regret letter"],
    ["how to say no", "refusing an offer politely", "declining an invitation"],
    ["heat pump not working", "pump will not start in winter", "cannot turn off the heat pump"],
    ["Nichts ist unmöglich", "Wärmepumpe ohne Strom"],
]


def test_refusals_are_known_by_their_marks():
    marks = pairs.Marks()
    for said in REFUSALS[:-1]:
        assert pairs.is_refusal(said, marks), said
    for said in NO_REFUSALS:
        assert not pairs.is_refusal(said, marks), said
    own = ["warum kann ich nicht schlafen"]
    assert not pairs.is_refusal(own, marks, frozenset(own))


def test_adversarial_pairs(spark):
    sound = {"heat pump": ["cost of heat pump", "heat pump survey"], "power grid": ["power grid", "insulation"]}
    rows = [(i, "what is the heat pump cost", {"x": said}, None, None) for i, said in enumerate(REFUSALS)]
    want = dict.fromkeys(range(len(REFUSALS)), "refusal")
    more = [
        ("heat pump cost in oslo", {"x": ["cost heat pump", "oslo cost"]}, ["pump oslo"], "copied"),  # in another order
        ("best heat pump cost in oslo", {"x": ["heat pump cost", "best heat pump"]}, ["in oslo", "heat pump", "cost", "price"], "copied"),  # but for one word in eleven
        ("heat pump cost", {"x": ["heat pump price", "heat pump survey"]}, None, None),  # two thirds
        ("what is the heat pump cost", {"a": ["cost of heat pump", "insulation"], "b": ["power grid"]}, None, None),  # a sound short list
        ("what is the heat pump cost", sound, ["heat pump price (especially"], "truncated"),
        ("what is the heat pump cost", sound, ["insulation survey", "supply of irrig"], "truncated"),
        ("what is the heat pump cost", {**sound, "z": ["supply of irrig"]}, ["insulation survey", "power grid policy"], None),  # odd, but not the end
        ("warum kann ich nicht schlafen", {"x": ["warum kann ich nicht schlafen"]}, None, "copied"),
        ("what is the heat pump cost", {"x": ["costo della pompa di calore", "prezzo per la rete", "storia della pompa"]}, ["qualità della rete", "mancanza di energia nel paese"], "other_language"),  # no prompt is in this language
        ("cycling races of the world", {"x": ["Tour de France", "Vuelta a España", "Giro d'Italia"]}, ["stage race", "power grid"], None),
    ]
    for k, (prompt, e, a, defect) in enumerate(more, 100):
        # what follows the answer in other fields makes no difference
        rows += [(k, prompt, e, a, None), (k + 100, prompt, e, a, V)]
        want[k] = want[k + 100] = defect
    got, others = found(spark, rows)
    assert got == want
    assert others == {None}


def test_no_pairs(spark):
    assert pairs.pair_defects(spark.createDataFrame([], SCHEMA)).count() == 0


def check_pieces(text, size, overlap):
    cuts = splitting.split_text(text, size, overlap)
    assert "".join(text[a:b] for _, a, b in cuts) == text
    assert all(b - o <= size and b > a for o, a, b in cuts) or not text
    assert [a - o for o, a, _ in cuts][1:] == [min(overlap, a) for _, a, _ in cuts][1:]
    return [text[a:b] for _, a, b in cuts]


def test_splits_keep_everything():
    rng = random.Random(6)
    for _ in range(150):
        text = "".join(rng.choice(["a", "bc", " ", ". ", "\n", "\n\n", ", ", "é", "é", "👍", "👨‍👩"]) for _ in range(rng.randrange(0, 400)))
        size = rng.randrange(5, 60)
        check_pieces(text, size, rng.randrange(0, size))


def test_cuts_at_the_strongest_boundary():
    text = "word " * 10 + "end.\n\n" + "next " * 10
    assert check_pieces(text, 70, 0)[0].endswith("end.\n\n")
    assert check_pieces("x" * 100, 40, 10) == ["x" * 25] * 4
    assert check_pieces("Fits.", 10, 3) == ["Fits."]
    with pytest.raises(ValueError, match="overlap"):
        splitting.split_text("abc", 2, 2)


def test_a_character_is_not_cut():
    parts = check_pieces("é" * 20, 11, 0)
    assert not any(p.startswith("́") for p in parts)


def test_pieces_of_a_table(spark):
    rows = [("a", "x" * 30, None), ("a", "x" * 30, None), ("b", " \n" + "y" * 10 + "\t ", "z " * 300_000), ("c", None, ""), (None, "w" * 11, "w")]
    df = spark.createDataFrame(rows, "doc_id string, segment string, body string").withColumn("piece", F.lit(1)).withColumn("text", F.lit("clash"))
    limits = spark.createDataFrame([("segment", 10, 2), ("body", 1000, None), ("other", 5, 1), (None, 1, 0)], "field_name string, max_chars int, overlap_chars int")
    out = splitting.split_passages(df, limits).collect()
    assert {(r["doc_id"], r["field_name"]) for r in out} == {("a", "segment"), ("b", "body"), (None, "segment")}
    assert "".join(r["piece"][r["overlap_chars"] :] for r in sorted((r for r in out if r["doc_id"] == "b"), key=lambda r: r["piece_no"])) == ("z " * 300_000).strip()
    assert sum(r["doc_id"] == "a" for r in out) == len(splitting.split_text("x" * 30, 10, 2))
    assert splitting.split_passages(df.limit(0), limits).count() == 0
    assert splitting.split_oversized(df, "doc_id", ["segment"], {}).count() == 0


def test_a_boundary_far_from_the_midpoint_is_taken():
    """A run of 700 characters amid words: only a run that fits no piece is cut within."""
    text = "word " * 60 + "x" * 700 + " word" * 60
    cuts = splitting.cut_points(text, 1000)
    assert cuts and all(text[c - 1] == " " for c in cuts)
    run = text.index("x")
    inside = [c for c in splitting.cut_points(text, 500) if run < c < run + 700]
    assert inside == [run + 350]
    assert all(text[c - 1] == " " for c in splitting.cut_points(text, 500) if c not in inside)


@pytest.mark.parametrize(
    ("said", "refused"),
    [
        (["I'm sorry", "but I cannot", "as an assistant", "help with that"], True),
        (["Leider", "kann ich nicht", "als Assistent", "dabei helfen"], True),
        (["I'm sorry", "but I can't help with that", "as an assistant", "at this time", "please ask something else"], True),
        (["申し訳ありませんが、そのご質問にはお答えできません"], True),
        (["Jag är ledsen", "men jag kan inte hjälpa till med det"], True),
        (["I'm sorry card", "letter of regret", "cannot attend", "sorry note", "unable to come"], False),
        (["I'm sorry", "I am sorry", "apology", "forgiveness"], False),
        (["Unfortunately", "I cannot", "as an assistant", "help with that"], True),
        (["I can't sleep", "I can't breathe", "I won't eat", "I cannot walk"], False),
        (["heat pump", "I cannot provide keyword expansions for this query.", "power grid", "coal mine", "insulation"], False),
    ],
)
def test_a_refusal_in_pieces(said, refused):
    read = pairs.read_pair("heat pump cost", {"x": said}, None, pairs.Marks(), 0.9, 3, 0.25)
    assert (read[0] == "refusal") is refused
