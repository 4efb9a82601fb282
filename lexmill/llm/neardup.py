"""Problem 5: records that share most of their content.

Method: pigeonhole blocks. A record's fingerprint is a row of min-hash components of its word sequences; it is split
into blocks, records are joined on equal blocks, and a joined pair is verified by the Hamming distance of the two
fingerprints, that is the number of components in which they differ. With ``L`` blocks, fingerprints at a distance
below ``L`` share a block for certain; of pairs at the similarity threshold itself (where a block of r components is
equal with probability s^r) a share of 1 - (1 - s^r)^L is found. One bit of each of 56 components goes along with a
block, so that most chance meetings end where they happen. The survivors' similarity is then computed exactly.

Records with equal sequence sets form one class beforehand, so that copies cost one row each and no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.shared import col, cut, if_small

_WORDS = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Components of a block, and blocks: 1 - (1 - 0.6^4)^64 = 0.99986 of the pairs at similarity 0.6, 0.999997 at 0.65. Of
#: unrelated records, which share some turns of phrase, four components are some twenty times less often equal than three.
BLOCK_SIZE, BLOCKS = 4, 64
#: Components of which one bit each goes along with a block, for a first look at the distance where two blocks meet. A block's
#: key, its class and these bits share two numbers of 64 bits: what is shuffled most is as short as it can be.
SKETCH = 56


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads each input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str], known: dict[str, int]) -> list[int]:
    """64-bit hashes of words, remembered in ``known``."""
    import xxhash

    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            if len(known) > 500_000:  # memory stays bounded whatever the vocabulary
                known.clear()
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return out


def sequence_hashes(text: str, n: int, known: dict[str, int]) -> tuple[int, np.ndarray]:
    """Number of words, and the sorted distinct hashes of all sequences of ``n`` consecutive words."""
    words = _WORDS.findall(text.lower())
    if len(words) < n:
        return len(words), np.empty(0, np.uint64)
    h = np.array(word_hashes(words, known), dtype=np.uint64)
    acc = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        acc = _mix(acc * _MIX + h[k : len(h) - n + 1 + k])
    return len(words), np.unique(acc)


def _multipliers(m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, m, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, m, dtype=np.uint64)


def fingerprints(sets: list[np.ndarray], m: int, seed: int = 7) -> np.ndarray:
    """Row i holds 8 bits of each of the ``m`` min-hash components of set i."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    a, b = _multipliers(m, seed)
    out = np.empty((len(sets), m), np.uint8)
    for k in range(m):
        low = np.minimum.reduceat((flat * a[k] + b[k]) >> np.uint64(16), starts)
        out[:, k] = _mix(low).astype(np.uint8)
    return out


_PRINT = "doc_id string, h1 long, h2 long, fp binary"


def _print_batches(batches: Iterator[pd.DataFrame], n: int, min_words: int, m: int) -> Iterator[pd.DataFrame]:
    import xxhash

    known: dict[str, int] = {}
    for batch in batches:
        ids, sets = [], []
        for i, text in zip(batch["doc_id"], batch["text"]):
            words, s = sequence_hashes(text, n, known)
            if words >= min_words and len(s):
                ids.append(i)
                sets.append(s)
        if ids:
            fp = fingerprints(sets, m)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            both = np.frombuffer(b"".join(digest), dtype=">i8").astype("int64").reshape(-1, 2)
            yield pd.DataFrame({"doc_id": ids, "h1": both[:, 0], "h2": both[:, 1], "fp": [r.tobytes() for r in fp]})


def _block_batches(batches: Iterator[pa.RecordBatch], r: int, blocks: int, uid_bits: int) -> Iterator[pa.RecordBatch]:
    """Each block as two numbers: its key above the class's upper bits, and the class's lowest 8 bits above the sketch."""
    shift = np.uint64(uid_bits - 8)
    for batch in batches:
        if batch.num_rows:
            fp = np.frombuffer(b"".join(batch["fp"].to_pylist()), np.uint8).reshape(batch.num_rows, r * blocks).astype(np.uint64)
            keys = np.broadcast_to(np.arange(1, blocks + 1, dtype=np.uint64) * _MIX, (batch.num_rows, blocks))
            for k in range(r):
                keys = _mix(keys * _MIX + fp[:, k::r])
            uid = batch["uid"].to_numpy().astype(np.uint64)
            bits = ((fp[:, :SKETCH] & np.uint64(1)) << np.arange(min(SKETCH, r * blocks), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            high = (keys << shift) | (uid >> np.uint64(8))[:, None]
            low = np.repeat(((uid & np.uint64(255)) << np.uint64(56)) | bits, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(high.reshape(-1).view(np.int64)), pa.array(low.view(np.int64))], names=["high", "low"])


def _short_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints with 4 bits of each component, two to a byte: enough for the distance, and half as much to move."""
    for batch in batches:
        if batch.num_rows:
            low = np.frombuffer(b"".join(batch["fp"].to_pylist()), np.uint8).reshape(batch.num_rows, -1) & 15
            low = np.pad(low, ((0, 0), (0, low.shape[1] % 2)))
            yield pa.RecordBatch.from_arrays([batch["uid"], pa.array([x.tobytes() for x in (low[:, ::2] << 4) | low[:, 1::2]])], names=["uid", "fp"])


def _distance_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("fp_a", "fp_b"))
            differ = one ^ two
            near = (((differ & 15) > 0).sum(axis=1) + ((differ >> 4) > 0).sum(axis=1)) <= most
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(near)), batch["b"].filter(pa.array(near))], names=["a", "b"])


def _similar_batches(batches: Iterator[pd.DataFrame], n: int, least: float) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}
    for batch in batches:
        keep, sim = [], []
        cache: dict[int, np.ndarray] = {}
        for k, (a, b, ta, tb) in enumerate(zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"])):
            sa, sb = (cache[u] if u in cache else cache.setdefault(u, sequence_hashes(t, n, known)[1]) for u, t in ((a, ta), (b, tb)))
            both = len(np.intersect1d(sa, sb, assume_unique=True))
            s = both / (len(sa) + len(sb) - both)
            if s >= least:
                keep.append(k)
                sim.append(s)
        yield pd.DataFrame({"a": batch["a"].iloc[keep].to_numpy(), "b": batch["b"].iloc[keep].to_numpy(), "similarity": sim})


class _Classes:
    """The classes of equal sequence sets of a table's texts, and what it takes to compare them."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, n: int, least: float, min_words: int, r: int, blocks: int):
        self.n, self.least, self.r, self.blocks, self.m = n, least, r, blocks, r * blocks
        self.texts = df.select(col(id_col).cast("string").alias("doc_id"), col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        m = self.m
        self.printed = cut(self.texts.mapInPandas(lambda it: _print_batches(it, n, min_words, m), _PRINT), "neardup-prints")
        # the min of doc_id picks one text for each class; equal sets have equal fingerprints
        classes = self.printed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"))
        made = cut(classes.withColumn("id", F.monotonically_increasing_id()), "neardup-classes")
        # partition and place as a number of as few bits as there are classes
        part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
        most = made.agg(F.coalesce(F.max(part), F.lit(0)), F.coalesce(F.max(place), F.lit(0))).first()
        bits = most[1].bit_length()
        self.uid_bits = max(8, bits + most[0].bit_length())
        self.classes = made.withColumn("uid", F.shiftleft(part, bits).bitwiseOR(place)).drop("id")

    def members(self) -> DataFrame:
        return self.printed.select("doc_id", "h1", "h2").distinct().join(self.classes.select("h1", "h2", "uid"), ["h1", "h2"]).select("doc_id", "uid")

    def keyed(self) -> DataFrame:
        """``high, low``: the blocks of each class (:func:`_block_batches`)."""
        r, blocks, bits = self.r, self.blocks, self.uid_bits
        return self.classes.select("uid", "fp").mapInArrow(lambda it: _block_batches(it, r, blocks, bits), "high long, low long")

    def key(self, high: str):
        return F.shiftrightunsigned(F.col(high), self.uid_bits - 8)

    def uid(self, high: str, low: str):
        upper = F.col(high).bitwiseAND(F.lit((1 << (self.uid_bits - 8)) - 1))
        return F.shiftleft(upper, 8).bitwiseOR(F.shiftrightunsigned(F.col(low), 56))

    def alike(self, one: str, two: str):
        """A first look at the distance by the bits of the sketch.

        4.5 standard deviations above the bits that differ on average in a pair at the threshold: at 0.6 that is 24 of 56 bits, and
        by the binomial distribution 0.00003 of those pairs have more.
        """
        differ, bits = (1 - self.least) / 2, min(SKETCH, self.m)
        seen = F.lit((1 << SKETCH) - 1)
        return F.bit_count(F.col(one).bitwiseXOR(F.col(two)).bitwiseAND(seen)) <= int(bits * differ + 4.5 * (bits * differ * (1 - differ)) ** 0.5)

    def links(self, pairs: DataFrame) -> DataFrame:
        """``a, b, similarity`` of the pairs ``a, b`` that are at least as similar as asked: by the Hamming distance first, then exactly."""
        short = self.classes.select("uid", "fp").mapInArrow(_short_batches, "uid long, fp binary")
        prints_a, prints_b = (short.select(F.col("uid").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "ab")
        # 4.5 standard deviations below the components that a pair at the threshold shares on average, by chance or not
        equal = self.least + (1 - self.least) / 16
        shared = equal * self.m - 4.5 * (self.m * equal * (1 - equal)) ** 0.5
        most, n, least = int(self.m - max(shared, 1)), self.n, self.least
        near = cut(pairs.join(prints_a, "a").join(prints_b, "b").mapInArrow(lambda it: _distance_batches(it, most), "a long, b long"), "neardup-near")
        # texts are moved only for the classes that are in a surviving pair
        wanted = near.select(F.col("a").alias("uid")).union(near.select(F.col("b").alias("uid"))).distinct()
        reps = self.classes.join(wanted, "uid").select("uid", "rep", "h1", "h2")
        held = self.printed.select("doc_id", "h1", "h2").join(reps, ["h1", "h2"]).where("doc_id = rep")
        held = held.groupBy("doc_id", "uid").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"))
        kept = self.texts.join(held, "doc_id").mapInPandas(lambda it: _own_text_batches(it, n), "uid long, text string").dropDuplicates(["uid"])
        text_a, text_b = (kept.select(F.col("uid").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        return near.join(text_a, "a").join(text_b, "b").mapInPandas(lambda it: _similar_batches(it, n, least), "a long, b long, similarity double")

    def all_links(self) -> DataFrame:
        """The links between all classes that share a block: as many rows as there are such pairs."""
        keyed = self.keyed()
        met = keyed.toDF("high_a", "low_a").join(keyed.toDF("high_b", "low_b"), (self.key("high_a") == self.key("high_b")) & (self.uid("high_a", "low_a") < self.uid("high_b", "low_b")) & self.alike("low_a", "low_b"))
        return self.links(met.select(self.uid("high_a", "low_a").alias("a"), self.uid("high_b", "low_b").alias("b")).distinct())

    def connecting_links(self) -> DataFrame:
        """Links that connect the same classes as :meth:`all_links` does, but as few as classes where a block is shared by many variants of one text.

        In each block the classes are compared with one of them, chosen by a hash. Those that are similar to it are connected by that, and
        need no comparison with each other; each of the others is compared with all of its block.
        """
        keyed = self.keyed().select(self.key("high").alias("key"), self.uid("high", "low").alias("uid"), "low")
        chosen = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "uid").alias("h"), "uid", "low")).alias("p"), F.count("*").alias("c")).where("c > 1")
        star = cut(keyed.join(chosen.select("key", F.col("p.uid").alias("pivot"), F.col("p.low").alias("pivot_low"), "c"), "key").where("uid <> pivot"), "neardup-star")
        pair = [F.least("uid", "pivot").alias("a"), F.greatest("uid", "pivot").alias("b")]
        first = cut(self.links(star.where(self.alike("low", "pivot_low")).select(*pair).distinct()), "neardup-first")
        apart = star.where("c > 2").withColumns(dict(zip("ab", pair))).join(first.select("a", "b"), ["a", "b"], "left_anti").select("key", F.col("uid").alias("x"), F.col("low").alias("low_x"))
        met = apart.join(star.select("key", F.col("uid").alias("y"), F.col("low").alias("low_y")), "key").where("x <> y")
        rest = met.where(self.alike("low_x", "low_y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        return first.unionByName(self.links(rest.join(first.select("a", "b"), ["a", "b"], "left_anti")))


def similar_classes(df: DataFrame, id_col: str, text_col: str, n: int = 5, least: float = 0.8, min_words: int = 1, r: int = BLOCK_SIZE, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """``members(doc_id, uid)`` and ``links(a, b, similarity)`` between the classes ``uid`` of equal sequence sets, a < b.

    Similarity is the intersection over the union of all distinct sequences of ``n`` consecutive words of the
    lower-cased text; a link has at least ``least``. Texts that are null, have fewer than ``min_words`` words or no
    sequence belong to no class. An id with several texts is a member of several classes; a row delivered twice is
    one member. Other columns of ``df`` are ignored.
    """
    c = _Classes(df, id_col, text_col, n, least, min_words, r, blocks)
    return c.members(), c.all_links()


def _own_text_batches(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """Of the texts of an id, the one whose sequence set is the class's."""
    import xxhash

    known: dict[str, int] = {}
    for batch in batches:
        keep = []
        for k, (text, h1, h2) in enumerate(zip(batch["text"], batch["h1"], batch["h2"])):
            _, s = sequence_hashes(text, n, known)
            if len(s):
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=">i8")
                if d[0] == h1 and d[1] == h2:
                    keep.append(k)
        yield batch.iloc[keep][["uid", "text"]]


def similar_pairs(df: DataFrame, id_col: str, text_col: str, n: int = 5, least: float = 0.8, min_words: int = 1) -> DataFrame:
    """All pairs ``doc_id_a < doc_id_b`` at or above ``least``, copies included; as many rows as there are such pairs."""
    members, links = similar_classes(df, id_col, text_col, n, least, min_words)
    members = cut(members, "neardup-members")
    one, two = (members.select(F.col("doc_id").alias(f"doc_{x}"), F.col("uid").alias(x)) for x in "ab")
    across = links.select("a", "b").join(one, "a").join(two, "b").select("doc_a", "doc_b")
    many = members.groupBy("uid").agg(F.count("*").alias("c")).where("c > 1").select("uid")
    copies = members.join(many, "uid")
    within = copies.select(F.col("doc_id").alias("doc_a"), "uid").join(copies.select(F.col("doc_id").alias("doc_b"), "uid"), "uid").where("doc_a < doc_b").select("doc_a", "doc_b")
    both = across.union(within).where("doc_a <> doc_b")
    return both.select(F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b")).distinct()


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``uid, root``: the smallest uid that each uid of ``links(a, b)`` is connected with.

    In each round every root is hooked to the smallest root next to its tree, and all paths are halved, so that a
    chain takes rounds as the logarithm of its length. Each round is a written table.
    """
    edges = links.select("a", "b").where("a <> b")
    edges = cut(edges.union(edges.select(F.col("b"), F.col("a"))).distinct().toDF("u", "v"), "cc-edges")
    label = cut(edges.select("u", F.col("u").alias("root")).distinct(), "cc-label")
    for _ in range(max_rounds):
        beside = edges.join(label.toDF("v", "offer"), "v").groupBy("u").agg(F.min("offer").alias("offer"))
        met = label.join(beside, "u")
        hooks = met.groupBy("root").agg(F.min("offer").alias("top")).where("top < root")
        hooks = cut(hooks, "cc-hooks")
        if hooks.limit(1).count() == 0:
            return label.withColumnRenamed("u", "uid")
        for _ in range(2):  # where the root was hooked to one that was hooked itself
            further = hooks.toDF("top", "beyond")
            hooks = hooks.join(further, "top", "left").select("root", F.coalesce("beyond", "top").alias("top"))
        hooks = if_small(cut(hooks, "cc-hooks"))
        label = cut(label.join(hooks, "root", "left").select("u", F.coalesce("top", "root").alias("root")), "cc-label")
    raise RuntimeError("the components aren't complete")


def similar_groups(df: DataFrame, id_col: str, text_col: str, n: int = 5, least: float = 0.8, min_words: int = 1, r: int = BLOCK_SIZE, blocks: int = BLOCKS) -> DataFrame:
    """One row ``doc_id, class_id, group_id, copies, classes`` for each document with a class.

    ``class_id`` is shared by documents with equal sequence sets, ``group_id`` by those connected through links; ``copies`` are
    the members of the class and ``classes`` the classes of the group. Many variants of one text take rows as their number,
    not as its square: only links that connect are looked for.
    """
    c = _Classes(df, id_col, text_col, n, least, min_words, r, blocks)
    members = cut(c.members(), "neardup-members")
    roots = connected(cut(c.connecting_links(), "neardup-links"))
    per = members.groupBy("uid").agg(F.count("*").alias("copies")).join(roots, "uid", "left").select("uid", "copies", F.coalesce("root", "uid").alias("group_id"))
    per = cut(per, "neardup-per")
    sizes = per.groupBy("group_id").agg(F.count("*").alias("classes"))
    return members.join(per.join(sizes, "group_id"), "uid").select("doc_id", F.col("uid").alias("class_id"), "group_id", "copies", "classes")
