"""Arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lists an aspect of an expansion may be split into.
FACETS = ("lexical", "conceptual", "referential")


def starts_of(tokens: Column, pattern: Column) -> Column:
    """0-based positions at which ``pattern`` begins in ``tokens``; none for an empty pattern."""
    n, size = F.size(tokens), F.size(pattern)
    places = F.when((size > 0) & (n >= size), F.sequence(F.lit(0), F.greatest(F.lit(0), n - size))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.slice(tokens, i + 1, F.greatest(size, F.lit(1))) == pattern)


def is_sublist(pattern: Column, tokens: Column) -> Column:
    """Whether ``pattern`` is a contiguous part of ``tokens`` and not all of it."""
    return (F.size(pattern) < F.size(tokens)) & (F.size(starts_of(tokens, pattern)) > 0)


def holds_all(tokens: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, tokens)) == 0


def ngrams(tokens: Column, least: int, most: int) -> Column:
    """All runs of ``least`` to ``most`` tokens, joined by blanks."""
    size = F.size(tokens)

    def of(n: int) -> Column:
        places = F.when(size >= n, F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.flatten(F.array(*[of(n) for n in range(least, most + 1)]))


def whole_word_spans(pieces: Column, least: int, most: int, mark: str = "▁") -> Column:
    """Runs of subword pieces that begin a word, end before the next one begins, and hold no line break before the last piece."""
    size = F.size(pieces)

    def of(n: int) -> Column:
        places = F.when(size >= n, F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1))).otherwise(F.array().cast("array<int>"))
        whole = lambda i: F.startswith(F.element_at(pieces, i), F.lit(mark)) & ((i + n > size) | F.coalesce(F.startswith(F.get(pieces, i + n - 1), F.lit(mark)), F.lit(True)))
        unbroken = lambda i: (F.lit(True) if n == 1 else ~F.exists(F.slice(pieces, i, n - 1), lambda t: F.contains(t, F.lit("\n"))))
        return F.transform(F.filter(places, lambda i: whole(i) & unbroken(i)), lambda i: F.slice(pieces, i, n))

    return F.flatten(F.array(*[of(n) for n in range(least, most + 1)]))


def repaired_json(answer: Column) -> Column:
    """A model's answer as a JSON text: without fences, without what comes before the first brace, without trailing commas; null if that isn't JSON."""
    bare = F.regexp_extract(F.regexp_replace(answer, "```(json)?", ""), "(?s)(\\{.*\\})", 1)
    tidy = F.regexp_replace(bare, ",\\s*([}\\]])", "$1")
    return F.when(F.try_parse_json(tidy).isNotNull(), tidy)


def first_path(json: Column, *paths: str) -> Column:
    """The first of several JSON paths that has a value; broken JSON has none."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def expansion_terms(entities: Column, associated: Column, verbs: Column) -> Column:
    """``role, aspect, keyword`` of all keywords of an expansion: of its aspects, its associated terms and its verbs."""

    def of_map(m: Column, role: str) -> Column:
        m = F.coalesce(m, F.create_map().cast("map<string,array<string>>"))
        return F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<string>")), lambda k: F.struct(F.lit(role).alias("role"), e["key"].alias("aspect"), k.alias("keyword")))))

    listed = F.transform(F.coalesce(associated, F.array().cast("array<string>")), lambda k: F.struct(F.lit("assoc").alias("role"), F.lit("").alias("aspect"), k.alias("keyword")))
    return F.concat(of_map(entities, "key"), listed, of_map(verbs, "verb"))


def is_valid_expansion(entities: Column, associated: Column, per_group: int = 3, overall: int = 10) -> Column:
    """Whether every aspect has ``per_group`` keywords, and all together with the associated terms ``overall``."""
    lists = F.map_values(F.coalesce(entities, F.create_map().cast("map<string,array<string>>")))
    counts = F.transform(lists, lambda v: F.size(F.coalesce(v, F.array().cast("array<string>"))))
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x) + F.size(F.coalesce(associated, F.array().cast("array<string>")))
    return F.forall(counts, lambda n: n >= per_group) & (total >= overall)
