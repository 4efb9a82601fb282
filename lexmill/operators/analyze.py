"""Analysis of which queries cover which documents."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.cnf import pairs_of
from lexmill.plans.ordered import numbered_within
from lexmill.plans.shared import cut, if_small


def keyword_table(matched: DataFrame, pieces: DataFrame) -> DataFrame:
    """``qid, doc_id, role, aspect, piece, span`` of the pieces that match each document."""
    return matched.select(F.col("query_id").alias("piece"), "doc_id", "span").join(pieces.select("qid", "piece", "role", "aspect"), "piece").select("qid", "doc_id", "role", "aspect", "piece", "span")


def coverage(table: DataFrame) -> DataFrame:
    """``qid, doc_id, n_aspects, n_keys, n_assoc`` of each document with a match for a topic; all others have 0."""
    return table.groupBy("qid", "doc_id").agg(F.count_distinct(F.when(F.col("role") == "key", F.col("aspect"))).alias("n_aspects"), F.count_distinct(F.when(F.col("role") == "key", F.col("piece"))).alias("n_keys"), F.count_distinct(F.when(F.col("role") == "assoc", F.col("piece"))).alias("n_assoc"))


def coverage_histogram(covered: DataFrame, totals: DataFrame) -> DataFrame:
    """``qid, n_aspects, docs, share`` by number of matched aspects; ``totals`` has ``qid, all``, the documents looked at for each topic.

    Documents without any match are those that are left of all, so that none has to be written out for each topic.
    """
    counted = covered.groupBy("qid", "n_aspects").agg(F.count("*").alias("docs"))
    met = counted.groupBy("qid").agg(F.sum("docs").alias("met"))
    none = totals.join(met, "qid", "left").select("qid", F.lit(0).cast("long").alias("n_aspects"), (F.col("all") - F.coalesce("met", F.lit(0))).alias("docs"))
    all_ = counted.unionByName(none).groupBy("qid", "n_aspects").agg(F.sum("docs").alias("docs")).where("docs > 0")
    return all_.join(totals, "qid").select("qid", "n_aspects", "docs", (F.col("docs") / F.col("all")).alias("share"))


def group_coverage(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Documents that each aspect, keyword or the like covers."""
    return table.groupBy("qid", *by).agg(F.count_distinct("doc_id").alias("docs"))


def aspect_pairs(table: DataFrame) -> DataFrame:
    """``qid, a, b, docs``: documents in which two aspects both match. A document's aspects are joined, not its hits."""
    per = table.where("role = 'key'").select("qid", "doc_id", "aspect").distinct()
    return per.select("qid", "doc_id", F.col("aspect").alias("a")).join(per.select("qid", "doc_id", F.col("aspect").alias("b")), ["qid", "doc_id"]).where("a < b").groupBy("qid", "a", "b").agg(F.count("*").alias("docs"))


def cross_distance(hits: DataFrame, pieces: DataFrame) -> DataFrame:
    """``qid, doc_id, a, b, distance``: the smallest distance of a hit of one aspect and a hit of another.

    Each hit looks to the hit before it of every other aspect; only neighbours can be nearest, so no two hits are paired.
    """
    at = hits.join(pieces.where("role = 'key'").select(F.col("piece").alias("query_id"), "qid", "aspect"), "query_id").select("qid", "doc_id", "aspect", "pos").distinct()
    w = Window.partitionBy("qid", "doc_id").orderBy("pos", "aspect").rowsBetween(Window.unboundedPreceding, -1)
    # the last hit of each aspect so far, as a map that grows with the aspects of a topic only
    last = at.withColumn("before", F.collect_set("aspect").over(w))
    each = last.select("qid", "doc_id", "aspect", "pos", F.explode("before").alias("other")).where("other <> aspect")
    prior = at.select("qid", "doc_id", F.col("aspect").alias("other"), F.col("pos").alias("at"), F.lit(0).alias("asked"), F.lit(None).cast("string").alias("aspect"))
    asked = each.select("qid", "doc_id", "other", F.col("pos").alias("at"), F.lit(1).alias("asked"), "aspect")
    order = Window.partitionBy("qid", "doc_id", "other").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    near = prior.unionByName(asked).withColumn("p", F.last(F.when(F.col("asked") == 0, F.col("at")), ignorenulls=True).over(order)).where("asked = 1")
    return near.groupBy("qid", "doc_id", F.least("aspect", "other").alias("a"), F.greatest("aspect", "other").alias("b")).agg(F.min(F.col("at") - F.col("p")).alias("distance"))


def strategy_coverage(covered: DataFrame, pieces: DataFrame, totals: DataFrame) -> DataFrame:
    """``qid, strategy, docs, share``: documents that each kind of query would find, of all that ``totals`` (``qid, all``) has.

    ``all_aspects`` needs a topic of two aspects and more, and all of them matched.
    """
    aspects = pieces.where("role = 'key'").groupBy("qid").agg(F.count_distinct("aspect").alias("of"))
    k, key, assoc = F.col("n_aspects"), F.col("n_keys") > 0, F.col("n_assoc") > 0
    every = (k == F.col("of")) & (F.col("of") >= 2)
    rules = {
        "standalone_key": key,
        "standalone_assoc": assoc,
        "any_standalone": key | assoc,
        "pairwise_key": k >= 2,
        "all_aspects_key": every,
        "key_plus_assoc": key & assoc,
        "pairwise_key_plus_assoc": (k >= 2) & assoc,
        "all_aspects_plus_assoc": every & assoc,
    }
    known = covered.join(if_small(aspects), "qid", "left").withColumn("of", F.coalesce("of", F.lit(0)))
    counted = totals.join(known.groupBy("qid").agg(*[F.count_if(c).alias(s) for s, c in rules.items()]), "qid", "left").na.fill(0)
    long = counted.unpivot(["qid", "all"], list(rules), "strategy", "docs")
    return long.select("qid", "strategy", "docs", (F.col("docs") / F.col("all")).alias("share"))


def strategy_query_counts(pieces: DataFrame) -> DataFrame:
    """A row a topic: how many queries each strategy would fire, from the sizes of the aspects alone.

    Pairs and triples of different aspects follow from the sums of the sizes' powers; all aspects from their product.
    """
    sizes = pieces.where("role = 'key'").groupBy("qid", "aspect").agg(F.count_distinct("piece").alias("s"))
    p = sizes.groupBy("qid").agg(*[F.sum(F.pow("s", F.lit(i))).cast("long").alias(f"p{i}") for i in (1, 2, 3)], F.product("s").cast("long").alias("ways"), F.count("*").alias("aspects"))
    assoc = pieces.where("role = 'assoc'").groupBy("qid").agg(F.count_distinct("piece").alias("standalone_assoc"))
    both = p.join(assoc, "qid", "full").na.fill(0)
    p1, p2, p3, a = (F.col(c) for c in ("p1", "p2", "p3", "standalone_assoc"))
    pairs, triples = ((p1 * p1 - p2) / 2).cast("long"), ((p1 * p1 * p1 - 3 * p1 * p2 + 2 * p3) / 6).cast("long")
    every = F.when(F.col("aspects") >= 2, F.col("ways")).otherwise(p1)
    named = {"standalone_key": p1, "standalone_assoc": a, "pairwise_key": pairs, "triple_key": triples, "all_aspects_key": every, "key_plus_assoc": p1 * a, "pairwise_key_plus_assoc": pairs * a, "all_aspects_plus_assoc": every * a}
    return both.select("qid", *[c.alias(n) for n, c in named.items()])


def maximal_combinations(table: DataFrame) -> DataFrame:
    """``qid, doc_id, score, combinations``: the most a query of one keyword an aspect and one associated term can match, and how many such queries there are.

    The number is the product of the matches of each aspect, times those of the associated terms if there are any; none has
    to be written out. Documents with associated matches only have none.
    """
    per = table.groupBy("qid", "doc_id", "role", "aspect").agg(F.count_distinct("piece").alias("n"))
    keys = per.where("role = 'key'").groupBy("qid", "doc_id").agg(F.count("*").alias("aspects"), F.product("n").cast("long").alias("ways"))
    assoc = per.where("role = 'assoc'").groupBy("qid", "doc_id").agg(F.sum("n").alias("assoc"))
    both = keys.join(assoc, ["qid", "doc_id"], "left").withColumn("assoc", F.coalesce("assoc", F.lit(0)))
    return both.select("qid", "doc_id", (F.col("aspects") + (F.col("assoc") > 0).cast("long")).alias("score"), (F.col("ways") * F.greatest(F.lit(1), F.col("assoc"))).alias("combinations"))


def _named(members: Column) -> list[Column]:
    """``members, query_id`` of a set of pieces, the same in whatever order they come."""
    one = F.array_sort(F.array_distinct(members))
    return [one.alias("members"), F.array_join(one, " + ").alias("query_id")]


def tightest_combinations(table: DataFrame) -> DataFrame:
    """``qid, doc_id, query_id, members, score`` of the queries that :func:`maximal_combinations` counts.

    Documents with the same matches have the same queries, so these are made once for each different set of matches. A
    row grows by one aspect after the other, and the product is never held in one row.
    """
    per = table.groupBy("qid", "doc_id", "role", "aspect").agg(F.array_sort(F.collect_set("piece")).alias("p"))
    keys = per.where("role = 'key'").groupBy("qid", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("aspect", "p"))), lambda x: x["p"]).alias("ways"))
    assoc = table.where("role = 'assoc'").groupBy("qid", "doc_id").agg(F.array_sort(F.collect_set("piece")).alias("a"))
    ways = F.when(F.col("a").isNotNull(), F.concat("ways", F.array("a"))).otherwise(F.col("ways"))
    matched = cut(keys.join(assoc, ["qid", "doc_id"], "left").select("qid", "doc_id", ways.alias("ways")), "ways")
    made = matched.select("qid", "ways").distinct().withColumn("m", F.array().cast("array<string>"))
    for i in range(matched.agg(F.max(F.size("ways"))).first()[0] or 0):
        made = made.select("qid", "ways", "m", F.explode_outer(F.get("ways", F.lit(i))).alias("x")).select("qid", "ways", F.when(F.col("x").isNull(), F.col("m")).otherwise(F.concat("m", F.array("x"))).alias("m"))
    queries = cut(made.select("qid", "ways", *_named(F.col("m")), F.size("ways").cast("long").alias("score")).distinct(), "combinations")
    return matched.join(if_small(queries), ["qid", "ways"]).select("qid", "doc_id", "query_id", "members", "score")


def candidate_queries(pieces: DataFrame) -> DataFrame:
    """``qid, query_id, members, type``: pairs of key pieces of different aspects, the names of all aspects, key pieces with associated ones, and pieces alone."""
    p = pieces.select("qid", "piece", "role", "aspect_ix").distinct()
    pairs = pairs_of(p).select("qid", F.array("a", "b").alias("m"), F.when(F.col("kind") == "key-key", "pairwise").otherwise("aspect_assoc").alias("type"))
    names = pieces.where("role = 'key' AND lower(keyword) = lower(aspect)").groupBy("qid").agg(F.collect_set("piece").alias("m"), F.count_distinct("aspect").alias("n")).where("n >= 2").select("qid", "m", F.lit("all_aspects").alias("type"))
    alone = p.select("qid", F.array("piece").alias("m"), F.concat(F.lit("standalone_"), "role").alias("type"))
    return _first_type(pairs.unionByName(names).unionByName(alone).select("qid", *_named(F.col("m")), "type"))


#: The order in which candidates are tried; ties of a cover go to the first.
TYPES = ("pairwise", "all_aspects", "aspect_assoc", "standalone_key", "standalone_assoc", "tightest")


def _first_type(queries: DataFrame) -> DataFrame:
    """Each query once, under the first of its types."""
    at = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    return queries.groupBy("qid", "query_id", "members").agg(F.min_by("type", at).alias("type"))


def cover_queries(pieces: DataFrame, tightest: DataFrame) -> DataFrame:
    """``qid, query_ix, query_id, members, type`` of all candidates and the tightest queries; ``query_ix`` in the order of types."""
    more = tightest.select("qid", "query_id", "members", F.lit("tightest").alias("type")).distinct()
    all_ = _first_type(candidate_queries(pieces).unionByName(more))
    at = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    return all_.withColumn("query_ix", F.row_number().over(Window.partitionBy("qid").orderBy(at, "query_id")).cast("long") - 1)


def cover_candidates(queries: DataFrame, spans: DataFrame, tightest: DataFrame, relevant: DataFrame, within: int) -> DataFrame:
    """``qid, query_ix, doc_id, engine``: which relevant documents each query covers, and its count over all documents within the bound.

    A candidate covers what it finds within the bound; a tightest query also the documents that it was made for, however
    far apart its pieces are there, so that its count may be 0.
    """
    near = spans.where(F.col("span") <= within)
    engine = near.groupBy("qid", "query_id").agg(F.count("*").alias("engine"))
    asked = queries.where("type <> 'tightest'").select("qid", "query_id")
    covers = near.join(asked, ["qid", "query_id"], "left_semi").select("qid", "query_id", "doc_id").unionByName(tightest.select("qid", "query_id", "doc_id")).distinct()
    known = queries.select("qid", "query_id", "query_ix").join(engine, ["qid", "query_id"], "left").na.fill(0, ["engine"])
    return covers.join(relevant, ["qid", "doc_id"], "left_semi").join(if_small(known), ["qid", "query_id"]).select("qid", "query_ix", "doc_id", "engine")


def tightest_counts(tightest: DataFrame, spans: DataFrame, within: int) -> DataFrame:
    """``qid, query_id, docs, engine, precision``: the documents each tightest query was made for, and its count within the bound."""
    docs = tightest.groupBy("qid", "query_id").agg(F.count_distinct("doc_id").alias("docs"))
    engine = spans.where(F.col("span") <= within).groupBy("qid", "query_id").agg(F.count("*").alias("engine"))
    return docs.join(engine, ["qid", "query_id"], "left").na.fill(0, ["engine"]).withColumn("precision", F.when(F.col("engine") > 0, F.col("docs") / F.col("engine")).otherwise(0.0))


def single_term_documents(covered: DataFrame) -> DataFrame:
    """``qid, doc_id`` of the matched documents that no query of two pieces of a topic reaches: one aspect at most, and nothing associated.

    Documents without any match aren't listed; they are all that :func:`coverage` doesn't have.
    """
    return covered.where("n_aspects <= 1 AND n_assoc = 0").select("qid", "doc_id")


def keyword_effect(covered: DataFrame, pieces: DataFrame, totals: DataFrame) -> DataFrame:
    """``qid, docs, any_key, any_assoc, any_term, key_and_assoc, all_keys, zero`` and the shares of all documents, in per cent, of those with any term and with every aspect."""
    aspects = pieces.where("role = 'key'").groupBy("qid").agg(F.count_distinct("aspect").alias("of"))
    n, a, every = F.col("n_keys") > 0, F.col("n_assoc") > 0, (F.col("n_aspects") == F.col("of")) & (F.col("of") > 0)
    met = covered.join(if_small(aspects), "qid", "left").groupBy("qid").agg(F.count_if(n).alias("any_key"), F.count_if(a).alias("any_assoc"), F.count_if(n | a).alias("any_term"), F.count_if(n & a).alias("key_and_assoc"), F.count_if(F.coalesce(every, F.lit(False))).alias("all_keys"))
    out = totals.join(met, "qid", "left").na.fill(0).withColumnRenamed("all", "docs").withColumn("zero", F.col("docs") - F.col("any_term"))
    return out.withColumn("pct_any", 100.0 * F.col("any_term") / F.col("docs")).withColumn("pct_all_keys", 100.0 * F.col("all_keys") / F.col("docs"))


def _cover(pdf: pd.DataFrame, by_cost: bool) -> list[tuple]:
    """Greedy cover of one topic: ``step, query_ix, new, covered, cost``."""
    docs = {q: set(g) for q, g in pdf.groupby("query_ix")["doc_id"]}
    cost = {q: (0 if pd.isna(c) else int(c)) for q, c in pdf.groupby("query_ix")["engine"].first().items()}
    covered: set = set()
    steps, spent = [], 0
    while docs:
        left = {q: len(d - covered) for q, d in docs.items()}
        best = max(sorted(left), key=lambda q: left[q] / (max(1, cost[q]) if by_cost else 1))
        if not left[best]:
            break
        covered |= docs.pop(best)
        spent += cost[best]
        steps.append((len(steps) + 1, best, left[best], len(covered), spent))
    return steps


def greedy_cover(covering: DataFrame, by_cost: bool = False) -> DataFrame:
    """``qid, step, query_ix, new_docs, covered, engine_total``: queries in the order in which they cover most documents yet uncovered.

    ``covering`` has ``qid, query_ix, doc_id, engine``. With ``by_cost``, new documents are divided by the query's count
    (at least 1 for the choice; the count itself is added up). Ties go to the lowest ``query_ix``. The choice of a step
    depends on all before it, so a topic's relevant documents and queries come together in one task; they are bounded
    by its judgments.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        qid = pdf["qid"].iloc[0]
        return pd.DataFrame([(qid, *s) for s in _cover(pdf, by_cost)], columns=["qid", "step", "query_ix", "new_docs", "covered", "engine_total"])

    return covering.select("qid", "query_ix", "doc_id", "engine").dropDuplicates(["qid", "query_ix", "doc_id"]).groupBy("qid").applyInPandas(run, "qid string, step int, query_ix long, new_docs long, covered long, engine_total long")


def cost_at_recall(curve: DataFrame, relevant: DataFrame, targets: Sequence[float] = (0.5, 0.8, 0.95)) -> DataFrame:
    """``qid, target, engine_total``: what it costs to reach each recall; where it isn't reached, the cost of the whole curve.

    ``relevant`` has ``qid, n_docs``.
    """
    at = curve.join(relevant, "qid").withColumn("recall", F.col("covered") / F.col("n_docs")).withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    return at.groupBy("qid", "target").agg(F.coalesce(F.min(F.when(F.col("recall") >= F.col("target"), F.col("engine_total"))), F.max("engine_total")).alias("engine_total"))


def span_statistics(spans: DataFrame, keys: Sequence[str], value: str = "span") -> DataFrame:
    """Smallest, median, 75th, 90th, 95th percentile (interpolated, cut to whole numbers) and largest."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.5, 0.75, 0.9, 0.95)]))
    out = spans.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("least"), q.alias("q"), F.max(value).alias("most"), F.count("*").alias("n"))
    return out.select(*keys, "n", F.col("least").cast("long").alias("least"), *[F.col("q")[i].cast("long").alias(n) for i, n in enumerate(("median", "p75", "p90", "p95"))], F.col("most").cast("long").alias("most"))


def index_percentiles(df: DataFrame, key: str, value: str, percents: Sequence[int]) -> DataFrame:
    """``key, p50, …``: the value at ``n * percent / 100`` of a group's sorted values, without interpolation; numbered over range partitions."""
    at = numbered_within(df.where(F.col(value).isNotNull()).select(key, value), [key], [value], "__place")
    n = at.groupBy(key).agg(F.max("__place").alias("__n"))
    place = lambda p: F.least(F.col("__n"), F.floor(F.col("__n") * p / 100) + 1)
    return at.join(n, key).groupBy(key).agg(*[F.max(F.when(F.col("__place") == place(p), F.col(value))).alias(f"p{p}") for p in percents])


def proximity_curve(spans: DataFrame, bounds: Sequence[int], keys: Sequence[str], value: str = "span") -> DataFrame:
    """``keys, bound, docs, share``: matches that each bound keeps."""
    counted = spans.groupBy(*keys).agg(F.count("*").alias("all"), *[F.count_if(F.col(value) <= b).alias(str(b)) for b in bounds])
    long = counted.unpivot([*keys, "all"], [str(b) for b in bounds], "bound", "docs")
    return long.select(*keys, F.col("bound").cast("int").alias("bound"), "docs", (F.col("docs") / F.col("all")).alias("share"))


def advised_bound(curve: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """The first bound that keeps at least ``share``."""
    return curve.where(F.col("share") >= share).groupBy(*keys).agg(F.min("bound").alias("bound"))


def candidate_outcomes(covering: DataFrame, engine: DataFrame, bounds: Sequence[int]) -> DataFrame:
    """``query_id, bound, covered, engine, precision`` of candidate queries at each bound, in one pass.

    ``covering`` has ``query_id, doc_id, span`` over relevant documents, ``engine`` the same over all.
    """
    def at(df: DataFrame, name: str) -> DataFrame:
        wide = df.groupBy("query_id").agg(*[F.count_if(F.col("span") <= b).alias(str(b)) for b in bounds])
        return wide.unpivot(["query_id"], [str(b) for b in bounds], "bound", name).withColumn("bound", F.col("bound").cast("int"))

    both = at(engine, "engine").join(at(covering, "covered"), ["query_id", "bound"], "left").na.fill(0, ["covered"])
    return both.select("query_id", "bound", "covered", "engine", F.when(F.col("engine") > 0, F.col("covered") / F.col("engine")).alias("precision"))


def step_types(curve: DataFrame, queries: DataFrame) -> DataFrame:
    """``type, steps, new_docs, engine`` of a cover curve by the kind of query of each step; ``queries`` has ``qid, query_ix, type``."""
    w = Window.partitionBy("qid").orderBy("step")
    one = curve.withColumn("engine", F.col("engine_total") - F.coalesce(F.lag("engine_total").over(w), F.lit(0)))
    return one.join(queries, ["qid", "query_ix"]).groupBy("type").agg(F.count("*").alias("steps"), F.sum("new_docs").alias("new_docs"), F.sum("engine").alias("engine"))


def value_shares(df: DataFrame, value: str) -> DataFrame:
    """``value, n, share``, nulls included; counted first, then divided by the total of one row."""
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(df.agg(F.count("*").alias("all")))).select(value, "n", (F.col("n") / F.col("all")).alias("share"))


def keyword_presence(texts: DataFrame, keywords: DataFrame, first: int = 30) -> DataFrame:
    """``qid, keyword, kind, docs``: in how many found and missed documents each of a topic's first keywords is."""
    from lexmill.functions.text import holds

    few = keywords.withColumn("__n", F.row_number().over(Window.partitionBy("qid").orderBy("keyword"))).where(F.col("__n") <= first).select("qid", "keyword")
    return texts.join(few, "qid").groupBy("qid", "keyword", "kind").agg(F.count_if(holds(F.col("text"), F.col("keyword"))).alias("docs"))
