"""Problem 8: texts that look the same but are stored differently.

Method: confusables skeleton. A text is decomposed, every character is replaced by its prototype from a look-alike
table, and the result is decomposed again; texts with equal skeletons look the same. Width, composition, invisible
characters, kinds of space and the script of a look-alike letter vanish; letter case, accents, kinds of dash and quote,
super- and subscripts, digits and the number of spaces stay.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.shared import col, cut, if_small

# Letters of other scripts and the Latin letters that they look like, in the same order, after the single-letter pairs
# of the public confusables data for security mechanisms (UTS 39) that common fonts draw alike.
LOOK_ALIKES = {
    "Cyrillic": ("асԁеһіјӏорԛѕԝхуѵүАВСЕԌНІЈКМОРԚЅТԜХУҮӀѴ", "acdehijlopqswxyvyABCEGHIJKMOPQSTWXYYIV"),
    "Greek": ("ανορϲϳιΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϜϺ", "avopcjiABEZHIKMNOPTYXCJFM"),
    "Armenian": ("օոսհցզյՕՏՍ", "onuhgqjOSU"),
    "Coptic": ("ⲟⲣⲥⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲌ", "opcBHIKMNOPCTYXZ"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃᎥ", "ABCDEGHJKLMPRSTVWZi"),
    "Lisu": ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    "Deseret and Osage": ("𐐄𐐬𐓂𐓪", "OoOo"),
    "Latin": ("ɡɑɩıȷᴄᴏꜱᴠᴡᴢⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "gaiijcosvwzIVXLCDMivxlcdm"),
}

# Format characters that are seen: signs over or around numbers, marks of abbreviation, annotations, overrides of the
# direction, joints of hieroglyphs.
SEEN = (*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x202D, 0x202E, *range(0xFFF9, 0xFFFC), 0x110BD, 0x110CD, *range(0x13430, 0x13440))
# Characters without a width that are not of the category of formats: joiners, fillers and variation selectors.
UNSEEN = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))

_PICTURE = "\u2190-\u2bff\u3030\u303d\u3297\u3299\U0001f000-\U0001faff"
#: Where such characters change what is seen: joiners within scripts whose letters join, selectors of a letter's or a picture's form,
#: joined pictures, the letters of a flag.
_CHANGES = re.compile(
    "(?<=[\u0600-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u17ff\u1800-\u18af])[\u200c\u200d]+"
    "|(?<=[\u1820-\u18aa])[\u180b-\u180f]"
    "|(?<=[\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])[\ufe00-\ufe02\U000e0100-\U000e01ef]"
    f"|(?<=[0-9#*])\ufe0f(?=\u20e3)|(?<=[{_PICTURE}])[\ufe0e\ufe0f]?\u200d(?=[{_PICTURE}])|(?<=[{_PICTURE}])[\ufe0e\ufe0f]"
    "|(?<=\U0001f3f4)[\U000e0020-\U000e007e]+\U000e007f"
)
_MAY_CHANGE = re.compile("[\u180b-\u180f\u200c\u200d\ufe00-\ufe0f\U000e0020-\U000e01ef]")


def prototypes() -> dict[int, str]:
    """What each character is replaced by: a look-alike letter, its own narrow form, a plain space, or nothing."""
    table: dict[int, str] = {}
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        kind, form = unicodedata.category(ch), unicodedata.decomposition(ch)
        if kind == "Zs":
            table[code] = " "
        elif kind == "Cf" and code not in SEEN:
            table[code] = ""
        elif form.startswith(("<wide>", "<narrow>")):
            table[code] = "".join(chr(int(x, 16)) for x in form.split()[1:])
    table.update(dict.fromkeys(UNSEEN, ""))
    for strange, plain in LOOK_ALIKES.values():
        table.update(zip(map(ord, strange), plain, strict=True))
    return table


def skeleton(text: str, table: dict[int, str]) -> str:
    """The text decomposed, replaced by prototypes, decomposed again; characters without a width stay where they change what is seen."""
    if text.isascii():  # has no decomposition, and its characters are their own prototypes
        return text
    text = unicodedata.normalize("NFD", text)
    if _MAY_CHANGE.search(text) is None:
        made = text.translate(table)
    else:
        parts, at = [], 0
        for m in _CHANGES.finditer(text):
            parts += [text[at : m.start()].translate(table), m.group()]
            at = m.end()
        made = "".join(parts) + text[at:].translate(table)
    return unicodedata.normalize("NFD", made)


def with_skeleton(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, skeleton, text_key, blank`` of each row with a non-null text; ``text_key`` is equal for equal texts only."""
    rows = df.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        table = prototypes()
        for b in batches:
            made = [skeleton(t, table) for t in b["text"]]
            # surrogates can't come from Spark's strings, so each text has bytes
            yield pd.DataFrame({"doc_id": b["doc_id"], "skeleton": made, "text_key": [xxhash.xxh3_128_digest(t.encode()) for t in b["text"]], "blank": [not s.strip() for s in made]})

    return rows.mapInPandas(each, f"doc_id {kind}, skeleton string, text_key binary, blank boolean")


def consistent_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``: the composed skeleton of each document's text, blank ones included; a row delivered twice is one.

    Texts that look the same come out the same, and the result of a result is itself.
    """
    rows = df.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).distinct()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = prototypes()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [unicodedata.normalize("NFC", skeleton(t, table)) for t in b["text"]]})

    return rows.mapInPandas(each, rows.schema)


def look_alike_forms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, look, text_key``: documents with equal ``look`` have texts equal to the eye. Blank texts are left out."""
    made = with_skeleton(df, id_col, text_col).where("NOT blank")
    return cut(made.select("doc_id", F.unhex(F.md5("skeleton")).alias("look"), "text_key").distinct(), "looks")


def look_alike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs ``doc_id_a < doc_id_b`` whose non-blank texts look the same but differ in code points.

    Forms, that is different texts of one look, are paired first and their documents then put in; exact copies
    make no pair with each other. So no step makes more rows than the result has.
    """
    looks = look_alike_forms(df, id_col, text_col)
    forms = looks.groupBy("look", "text_key").agg(F.count("*").alias("c"))
    mixed = forms.groupBy("look").agg(F.count("*").alias("forms")).where("forms > 1").select("look")
    among = cut(looks.join(if_small(cut(mixed, "looks-several")), "look"), "looks-mixed")
    f = among.select("look", "text_key").distinct()
    pairs = f.select("look", F.col("text_key").alias("k_a")).join(f.select("look", F.col("text_key").alias("k_b")), "look").where("k_a < k_b").select("k_a", "k_b")
    one, two = (among.select(F.col("text_key").alias(f"k_{x}"), F.col("doc_id").alias(f"d_{x}")) for x in "ab")
    both = pairs.join(one, "k_a").join(two, "k_b").where("d_a <> d_b")
    return both.select(F.least("d_a", "d_b").alias("doc_id_a"), F.greatest("d_a", "d_b").alias("doc_id_b")).distinct()


def look_alike_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, group_id, n_forms``: the smallest id with the same look, and the number of different texts of that look."""
    looks = look_alike_forms(df, id_col, text_col)
    per = looks.groupBy("look", "text_key").agg(F.min("doc_id").alias("d")).groupBy("look").agg(F.min("d").alias("group_id"), F.count("*").alias("n_forms"))
    return looks.join(per, "look").select("doc_id", "group_id", "n_forms").distinct()
