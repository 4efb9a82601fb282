"""Problem 6: items of varying length put into containers of fixed capacity.

Method: bulk-synchronous best-fit. In each round the items still without a place and the gaps of the open containers
are sorted together by size over range partitions. A sweep through each partition, from small to large, holds the
items it passed and lets each gap take the largest of them that fits, again and again while one fits. Items left over
in a partition are then matched with gaps left over in later ones, by rank: the driver only sees the two numbers of
each partition. The gaps are updated, and the next round begins; a round that places nothing opens new containers.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.shared import col, cut

_STATE = "kind string, item string, size long, container long, pid int, rank long"
#: Rows of a sweep's partition that are aimed at: there are as many partitions as that takes.
SWEEP_ROWS = 40_000


def _bundle(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Joins the tiny items of a partition, as they come, into bundles of at most ``most``."""
    name, room = None, 0
    for b in batches:
        names = []
        for item, size in zip(b["item"], b["size"]):
            if name is None or size > room:
                name, room = item, most
            room -= size
            names.append(name)
        b["bundle"] = names
        yield b[["item", "size", "bundle"]]


def sweep(sizes: list[tuple[int, str]], gaps: list[tuple[int, int]]) -> tuple[list[tuple[str, int, int]], list[tuple[int, str]], list[tuple[int, int]]]:
    """Best fit from small to large: placements ``(item, size, container)``, items left, gaps left ``(room, container)``.

    ``sizes`` and ``gaps`` are sorted rising; a gap takes the largest item that fits, then the largest that fits the
    rest, and so on.
    """
    placed, pending, left, k = [], [], [], 0
    for room, container in gaps:
        while k < len(sizes) and sizes[k][0] <= room:
            pending.append(sizes[k])
            k += 1
        while pending:
            at = bisect_right(pending, room, key=lambda x: x[0])
            if not at:
                break
            size, item = pending.pop(at - 1)
            placed.append((item, size, container))
            room -= size
        insort(left, (room, container))
    return placed, pending + sizes[k:], left


def _sweep_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    sizes, gaps = [], []
    for b in batches:
        yield b[b["kind"] == "placed"]
        items, room = b[b["kind"] == "item"], b[b["kind"] == "gap"]
        sizes += zip(items["size"].tolist(), items["item"].tolist())
        gaps += zip(room["size"].tolist(), (int(c) for c in room["container"]))
    sizes.sort()
    gaps.sort()
    placed, items_left, gaps_left = sweep(sizes, gaps)
    rows = [("placed", i, s, c, pid, 0) for i, s, c in placed]
    # leftovers are ranked from the largest item and from the smallest gap; a gap that took something has less room than
    # its partition stands for and waits for the next round
    taken = {c for _, _, c in placed}
    rows += [("item", i, s, None, pid, k) for k, (s, i) in enumerate(reversed(items_left))]
    rows += [("used", None, r, c, pid, 0) for r, c in gaps_left if c in taken]
    rows += [("gap", None, r, c, pid, k) for k, (r, c) in enumerate(x for x in gaps_left if x[1] not in taken)]
    out = pd.DataFrame(rows, columns=["kind", "item", "size", "container", "pid", "rank"])
    out["container"] = out["container"].astype("Int64")
    yield out


def match_leftovers(left: list[tuple[int, int, int]]) -> dict[tuple[str, int], list[tuple[int, int, int]]]:
    """Matches leftover items of partitions with leftover gaps of later ones; ``left`` has ``(pid, items, gaps)``.

    For ``("item", pid)`` and ``("gap", pid)``: intervals ``(first rank, number, first match number)``.
    """
    stack: list[list[int]] = []
    out: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    number = 0
    for pid, items, gaps in sorted(left):
        used = 0
        while stack and used < gaps:
            p, first, n = stack[-1]
            take = min(n, gaps - used)
            out.setdefault(("item", p), []).append((first, take, number))
            out.setdefault(("gap", pid), []).append((used, take, number))
            number, used = number + take, used + take
            if take == n:
                stack.pop()
            else:
                stack[-1] = [p, first + take, n - take]
        if items:
            stack.append([pid, 0, items])
    return out


def pack(items: DataFrame, capacity: int, sweep_rows: int = SWEEP_ROWS, max_rounds: int = 400) -> DataFrame:
    """``item, size, container`` for each row ``item string, size long`` of ``items``, whose sizes are 0 to ``capacity``.

    ``item`` must be unique. Each container holds at most ``capacity``; an item is never split. An empty table gives
    an empty result.
    """
    spark = items.sparkSession
    items = items.select(F.col("item").cast("string").alias("item"), F.col("size").cast("long").alias("size"))
    tiny, most = capacity // 32, max(1, capacity // 16)
    small = items.where(F.col("size") < tiny).repartition("item").sortWithinPartitions("item")
    bundles = cut(small.mapInPandas(lambda it: _bundle(it, most), "item string, size long, bundle string"), "pack-bundles")
    units = items.where(F.col("size") >= tiny).select("item", "size").union(bundles.groupBy("bundle").agg(F.sum("size").alias("size")).select("bundle", "size"))
    state = units.select(F.lit("item").alias("kind"), "item", "size", F.lit(None).cast("long").alias("container"), F.lit(0).alias("pid"), F.lit(0).cast("long").alias("rank"))
    state = cut(state, "pack-items")
    n_items, total = state.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    opened, n_gaps, placed_tables, stuck = 0, 0, [], True
    for _ in range(max_rounds):
        if n_items == 0:
            break
        if stuck:
            more = max(1, -(-total // capacity))
            fresh = spark.range(opened, opened + more).select(F.lit("gap").alias("kind"), F.lit(None).cast("string").alias("item"), F.lit(capacity).cast("long").alias("size"), F.col("id").alias("container"), F.lit(0).alias("pid"), F.lit(0).cast("long").alias("rank"))
            state, opened, n_gaps = state.unionByName(fresh), opened + more, n_gaps + more
        parts = max(1, -(-(n_items + n_gaps) // sweep_rows))
        # at equal size items come before gaps, so that a gap meets an item that fills it exactly
        ordered = state.repartitionByRange(parts, F.col("size"), F.desc("kind"), F.xxhash64("item", "container")) if parts > 1 else state.coalesce(1)
        swept = cut(ordered.mapInPandas(_sweep_batches, _STATE), "pack-swept")
        seen = swept.groupBy("pid", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("size").alias("least")).collect()  # 4 rows a partition
        left = {}
        for r in seen:
            left.setdefault(r["pid"], {})[r["kind"]] = r["n"]
        placed_tables.append(swept.where("kind = 'placed'"))
        items_now = sum(r["n"] for r in seen if r["kind"] == "item")
        total = sum(r["size"] for r in seen if r["kind"] == "item")
        least = min((r["least"] for r in seen if r["kind"] == "item"), default=0)
        matches = match_leftovers([(p, v.get("item", 0), v.get("gap", 0)) for p, v in left.items()])
        gaps = swept.where(F.col("kind").isin("gap", "used") & (F.col("size") >= least)).withColumn("kind", F.lit("gap"))
        rest = swept.where("kind = 'item'")
        if matches:
            table = spark.createDataFrame([(k, p, first, n, number) for (k, p), v in matches.items() for first, n, number in v], "kind string, pid int, first long, n long, number long")
            hit = F.broadcast(table)  # at most two rows a partition
            both = swept.where("kind <> 'placed'").join(hit, ["kind", "pid"]).where("rank >= first AND rank < first + n").withColumn("m", F.col("number") + F.col("rank") - F.col("first"))
            i, g = both.where("kind = 'item'").select("m", "item", "size"), both.where("kind = 'gap'").select("m", "container", F.col("size").alias("room"))
            met = cut(i.join(g, "m").select("item", "size", "container", (F.col("room") - F.col("size")).alias("room")), "pack-met")
            placed_tables.append(met.select(F.lit("placed").alias("kind"), "item", "size", "container", F.lit(0).alias("pid"), F.lit(0).cast("long").alias("rank")))
            rest = rest.join(met.select("item"), "item", "left_anti").select(*swept.columns)
            gaps = gaps.join(met.select("container"), "container", "left_anti").select(*swept.columns)
            gaps = gaps.union(met.select(F.lit("gap"), F.lit(None).cast("string"), "room", "container", F.lit(0), F.lit(0).cast("long")))
            matched, met_size = met.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            items_now, total = items_now - matched, total - met_size
        stuck = items_now == n_items
        n_items, n_gaps = items_now, sum(r["n"] for r in seen if r["kind"] in ("gap", "used"))
        state = rest.union(gaps)
    else:
        raise RuntimeError(f"{n_items} items have no container after {max_rounds} rounds")
    if not placed_tables:
        return spark.createDataFrame([], "item string, size long, container long")
    placed = placed_tables[0]
    for t in placed_tables[1:]:
        placed = placed.unionByName(t)
    placed = placed.select("item", "size", "container")
    alone = placed.join(items.where(F.col("size") >= tiny).select("item"), "item", "left_semi")
    bundled = bundles.join(placed.select(F.col("item").alias("bundle"), "container"), "bundle").select("item", "size", "container")
    return alone.union(bundled)


def pack_documents(sized: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """``doc_id, piece_no, n_pieces, token_from, n_tokens, container`` of every row of ``sized``.

    A document larger than ``capacity``, and only such a one, is split: into pieces of ``capacity`` that fill a
    container each, and a rest that is packed like a document. Null sizes count as 0; rows with a null id are left
    out; an id given twice is packed once, with its largest size. Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    docs = sized.select(col(id_col).alias("doc_id"), F.greatest(F.coalesce(col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    docs = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("n").alias("n"))
    number = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(capacity))).cast("int")
    pieces = docs.withColumn("n_pieces", number).select("doc_id", "n", "n_pieces", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))).alias("piece_no"))
    begins = (F.col("piece_no") - 1).cast("long") * capacity
    pieces = pieces.select("doc_id", "piece_no", "n_pieces", begins.alias("token_from"), F.least(F.lit(capacity).cast("long"), F.col("n") - begins).alias("n_tokens"), F.concat_ws("/", F.col("doc_id").cast("string"), "piece_no").alias("item"))
    pieces = cut(pieces, "pack-pieces")
    full = pieces.where(F.col("n_tokens") == capacity)
    packed = pack(pieces.where(F.col("n_tokens") < capacity).select("item", F.col("n_tokens").alias("size")), capacity).select("item", "container")
    # a full piece is a container by itself; those numbers are negative, so that they can't meet the others
    own = full.select("item", (-1 - F.monotonically_increasing_id()).alias("container"))
    return pieces.join(packed.union(cut(own, "pack-full")), "item").select("doc_id", "piece_no", "n_pieces", "token_from", "n_tokens", "container")


def capacity_of(pack_limits: DataFrame, name: str = "default") -> int:
    row = pack_limits.where(F.col("pack_name") == name).select("capacity_tokens").first()
    if row is None:
        raise ValueError(f"no capacity is given for {name}")
    return row[0]
