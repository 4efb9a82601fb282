"""Text functions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words that carry no content in keywords.
STOPWORDS = (
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will would could "
    "should may might can shall it its this that these those what which who whom how when where why not no nor if then than so up out "
    "about into through during before after above below between under again further once here there all each every both few more most "
    "other some such only own same too very just also"
).split()

#: White space of any script, spelt so that Java and RE2 read it alike.
SPACE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+"

# Tags that are dropped from a text, by the beginning of their names, and the five basic entities.
TAGS = "br|div|p|b|i|span|a"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def words(text: Column) -> Column:
    """Lower-cased words between white space; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda x: x != "")


def raw_words(text: Column) -> Column:
    """Words between white space as they are written."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def case_variants(word: Column) -> Column:
    """The word as it is, in lower case and capitalised, each once."""
    return F.array_distinct(F.array(word, F.lower(word), capitalised(word)))


def titled(phrase: Column) -> Column:
    """Each run of letters begins with a capital and goes on in lower case, as after an apostrophe or a digit too."""
    marked = F.regexp_replace(F.lower(phrase), "(^|[^\\p{L}])(\\p{L})", "$1\u0001$2")
    parts = F.split(marked, "\u0001")
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, 100000), capitalised_head), ""))


def capitalised_head(part: Column) -> Column:
    return F.concat(F.upper(F.substring(part, 1, 1)), F.substr(part, F.lit(2)))


def phrase_variants(phrase: Column) -> Column:
    """As it is, in lower case, in title case and capitalised, each once."""
    return F.array_distinct(F.array(phrase, F.lower(phrase), titled(phrase), capitalised(phrase)))


def content_words(phrase: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Words that are longer than one character and no stopwords, as they are written."""
    return F.filter(raw_words(phrase), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(list(stopwords)))


def is_usable_keyword(phrase: Column) -> Column:
    """Whether a keyword keeps content: not if several words come down to at most one."""
    n = F.size(content_words(phrase))
    return (n > 0) & ~((F.size(raw_words(phrase)) > 1) & (n <= 1))


def stopword_chunks(phrase: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """The longest runs of words between stopwords, in order, as strings."""
    stop = F.array(*[F.lit(s) for s in stopwords])
    marked = F.transform(raw_words(phrase), lambda w: F.when(F.array_contains(stop, F.lower(w)), F.lit("\u0001")).otherwise(w))
    runs = F.split(F.array_join(marked, " "), "\u0001")
    return F.filter(F.transform(runs, lambda r: F.trim(r)), lambda r: r != "")


def sentences(text: Column) -> Column:
    """White space made single blanks, then cut between a full stop, exclamation or question mark and a capital or digit."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.filter(F.split(F.regexp_replace(flat, "([.!?])\\s+([A-Z0-9])", "$1\u0001$2"), "\u0001"), lambda s: s != "")


def line_sentences(text: Column) -> Column:
    """Lines first, then sentences within each line."""
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), sentences))


def unescape(text: Column) -> Column:
    """The five basic entities; the ampersand last, so that nothing is unescaped twice."""
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def unescape_all(text: Column) -> Column:
    """All named and numeric entities, by Python's table; in Arrow batches, and only worth it where others than the five occur."""
    import html

    @F.pandas_udf("string")
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)

    return each(text)


def clean_html(text: Column, all_entities: bool = False) -> Column:
    """Entities first, so that escaped tags go too; then tags whose names begin with one of :data:`TAGS` become a blank."""
    plain = unescape_all(text) if all_entities else unescape(text)
    return F.regexp_replace(plain, f"(?i)</?({TAGS})[^>]*>", " ")


def simple_tokens(text: Column, least: int = 2, most: int = 15) -> Column:
    """Lower-cased, cleaned of tags, then runs of letters of ``least`` to ``most`` characters."""
    found = F.regexp_extract_all(clean_html(F.lower(F.coalesce(text, F.lit("")))), F.lit("[\\p{L}]+"), 0)
    return F.filter(found, lambda w: F.length(w).between(least, most))


def strip_hash(token: Column) -> Column:
    return F.ltrim(token, F.lit("#"))


def prefix_stems(word: Column, least: int = 5) -> Column:
    """All beginnings of at least ``least`` characters, the whole word too; none for shorter words."""
    return F.when(F.length(word) >= least, F.transform(F.sequence(F.lit(least), F.greatest(F.lit(least), F.length(word))), lambda i: F.left(word, i))).otherwise(F.array().cast("array<string>"))


def holds(text: Column, keyword: Column) -> Column:
    """Case-insensitive containment; an empty keyword is in no text."""
    return F.coalesce(F.contains(F.lower(text), F.lower(keyword)) & (keyword != ""), F.lit(False))


def occurrences(text: Column, keyword: Column) -> Column:
    """Non-overlapping occurrences, case-insensitive."""
    t, k = F.lower(F.coalesce(text, F.lit(""))), F.lower(keyword)
    return F.when(F.length(k) > 0, ((F.length(t) - F.length(F.replace(t, k, F.lit("")))) / F.length(k)).cast("long")).otherwise(F.lit(0).cast("long"))


def step_class(query: Column) -> Column:
    """``standalone``, ``2way_and`` or ``3way_and`` (three and more) by the parts joined with AND."""
    n = F.size(F.split(query, " AND "))
    return F.when(n == 1, "standalone").when(n == 2, "2way_and").otherwise("3way_and")


def describe(clauses: Column, shown: int = 3) -> Column:
    """``(a OR b) AND (c)`` of an array of arrays of alternatives; beyond ``shown`` alternatives their number."""

    def one(c: Column) -> Column:
        joined = F.array_join(F.slice(c, 1, shown), " OR ")
        return F.concat(F.lit("("), joined, F.when(F.size(c) > shown, F.concat(F.lit(" +"), (F.size(c) - shown).cast("string"))).otherwise(F.lit("")), F.lit(")"))

    return F.array_join(F.transform(clauses, one), " AND ")


def qid_of_path(path: Column) -> Column:
    """The file's name without folders and without its endings."""
    return F.regexp_extract(path, "([^/]+?)(\\.[A-Za-z0-9.]+)?$", 1)


def glue_wordpieces(pieces: DataFrame, text_col: str, keys: Sequence[str], pos: str, piece: str, score: str) -> DataFrame:
    """``keys, word, score``: pieces that begin with ``##`` are glued to the one before; a word has its pieces' highest score.

    Words that come out several times count once, with the highest score.
    """
    order = Window.partitionBy(*keys).orderBy(pos)
    numbered = pieces.withColumn("__w", F.sum(F.when(F.col(piece).startswith("##"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    glued = numbered.groupBy(*keys, "__w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, piece))), lambda x: strip_hash(x[piece])), "").alias(text_col), F.max(score).alias(score))
    return glued.groupBy(*keys, text_col).agg(F.max(score).alias(score))
