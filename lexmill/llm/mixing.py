"""Problem 7: sources mixed to target weights.

Method: capped water-filling. A source gets its target share of the total size, but no more than its own size times
its cap; what a clamped source can't give is redistributed over the others in proportion to their targets, until
nothing is clamped any more. The number of repetitions that follows is drawn in whole rounds of all documents, and
a fraction of a round by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.plans.shared import col, cut

#: Hash cells into which a source's documents fall for the fractional round.
CELLS = 4096
#: Amounts that differ by less than this share are equal: shares of a mix add up to 1 only up to rounding.
EQUAL = 1e-9


def water_fill(targets: Sequence[float], caps: Sequence[float], total: float) -> list[float]:
    """Amounts that add up to ``total``, or to all caps where those are less: proportional to ``targets`` below the caps."""
    given = [0.0] * len(targets)
    open_ = [i for i in range(len(targets)) if targets[i] > 0 and caps[i] > 0]
    rest = float(total)
    while open_ and rest > 1e-9:
        weight = sum(targets[i] for i in open_)
        clamped = [i for i in open_ if rest * targets[i] / weight >= caps[i]]
        if not clamped:
            for i in open_:
                given[i] = rest * targets[i] / weight
            break
        for i in clamped:
            given[i] = float(caps[i])
        rest -= sum(given[i] for i in clamped)
        open_ = [i for i in open_ if i not in clamped]
    return given


def mix_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_id, source, target_share, max_repeats, source_tokens, total_tokens, short, planned_tokens, rounds, fraction``.

    A row for each row of ``targets``. The size of a mix is that of all documents together (those of sources that no
    mix names, or of none, included). ``short`` says that the filling gives a source less than its target share, even though
    it repeats it fully. Planned on the driver from one number for each named source: ``targets`` is a table of settings.
    """
    spark = sized.sparkSession
    named = targets.where("mix_id IS NOT NULL AND source IS NOT NULL").groupBy("mix_id", "source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    named = named.collect()
    per = sized.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = {r["source"]: r["n"] for r in per.where(F.col("source").isin({r["source"] for r in named})).collect()}
    rows = []
    mixes: dict[int, list] = {}
    for r in named:
        mixes.setdefault(r["mix_id"], []).append(r)
    for mix, parts in sorted(mixes.items()):
        parts.sort(key=lambda r: r["source"])
        own = [size.get(r["source"], 0) for r in parts]
        caps = [r["max_repeats"] * n for r, n in zip(parts, own)]
        given = water_fill([r["target_share"] for r in parts], caps, total)
        for r, n, cap, g in zip(parts, own, caps, given):
            epochs = min(g / n, r["max_repeats"]) if n else 0.0
            whole = int(epochs + 1e-9)
            rows.append((mix, r["source"], r["target_share"], r["max_repeats"], n, total, g < r["target_share"] * total * (1 - EQUAL), g, whole, max(0.0, epochs - whole)))
    return spark.createDataFrame(rows, "mix_id int, source string, target_share double, max_repeats int, source_tokens long, total_tokens long, short boolean, planned_tokens double, rounds int, fraction double")


def draw(sized: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """``mix_id, source, doc_id, n_tokens, copies`` of every document drawn at least once.

    Documents fall into :data:`CELLS` cells of their source by a seeded hash; for the fractional round the cells are
    taken in order while their size fits, and in the cell that doesn't the documents in the order of their hash. So
    the drawn size misses the planned one by less than a document, and only one cell of a source is ever sorted.
    """
    docs = sized.where("source IS NOT NULL").select("doc_id", "source", "n_tokens", F.xxhash64(F.lit(seed), "doc_id").alias("h")).withColumn("cell", F.pmod("h", F.lit(CELLS)).cast("int"))
    wanted = F.broadcast(plan.select("mix_id", "source", "rounds", (F.col("fraction") * F.col("source_tokens")).alias("part")))  # a row a setting
    cells = docs.groupBy("source", "cell").agg(F.sum("n_tokens").alias("c"))
    running = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("upto", F.sum("c").over(running))
    edge = cells.join(wanted, "source").where("upto > part AND upto - c <= part").groupBy("mix_id", "source").agg(F.min("cell").alias("edge"), F.min(F.col("upto") - F.col("c")).alias("before"))
    edge = F.broadcast(cut(edge, "mix-edges"))  # a row a setting at most
    drawn = docs.join(wanted, "source").join(edge, ["mix_id", "source"], "left")
    inside = drawn.where("cell = edge")
    order = Window.partitionBy("mix_id", "source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("more", (F.col("before") + F.sum("n_tokens").over(order) <= F.col("part")).cast("int"))
    others = drawn.where("edge IS NULL OR cell <> edge").withColumn("more", F.when(F.col("part") <= 0, 0).when(F.col("edge").isNull() | (F.col("cell") < F.col("edge")), 1).otherwise(0))
    both = others.unionByName(inside)
    return both.select("mix_id", "source", "doc_id", "n_tokens", (F.col("rounds") + F.col("more")).alias("copies")).where("copies > 0")


def mix(sized: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The documents drawn (:func:`draw`) and, for each mix and source, the plan with ``drawn_tokens`` and ``reached_share``.

    ``sized`` has ``doc_id, source, n_tokens``, one row a document; null sizes count as 0, null ids are left out.
    ``reached_share`` is the share of what was really drawn for the mix, null for a mix with nothing drawn.
    """
    sized = sized.where(F.col("doc_id").isNotNull()).select("doc_id", "source", F.coalesce(col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
    plan = mix_plan(sized, targets)
    drawn = draw(sized, plan, seed)
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("documents"))
    report = plan.join(got, ["mix_id", "source"], "left").na.fill(0, ["drawn_tokens", "most_copies", "documents"])
    whole = F.sum("drawn_tokens").over(Window.partitionBy("mix_id"))
    return drawn, report.withColumn("reached_share", F.when(whole > 0, F.col("drawn_tokens") / whole))
