"""Best-fit-decreasing sharding of indivisible groups.

Groups (documents of equal text), largest first, enter the shard with the tightest remaining capacity that
takes them, found in a balanced search tree.  Either the capacity is fixed and the number of shards is what
comes out, or the number is fixed and the least tried capacity that needs no more shards is taken.

Sizes are put into classes: exact below 4096 bytes, beyond that rounded up to 12 significant bits, so there
are at most 4096 classes per doubling and the driver packs a histogram that doesn't grow with the corpus.
Groups of one class are interchangeable; one finds its shard by its rank in the class.

A group that is larger than a shard is cut into as few pieces as will fit (there are fewer such groups than
shards), and ``group_cut`` marks its rows; no other group is split.  A document larger than a fixed capacity
is an error.  Cases: a null text has no bytes and groups with the empty text; repeated
rows and null ids are rows like any other; bytes that are not UTF-8 count as they are; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenfold.llm import ranks
from wrenfold.llm.storage import stored

BITS = 12
ROW_BYTES = 8


class CapacityTree:
    """An AA tree (balanced) of (remaining capacity, shard)."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, level, left, right]

    @staticmethod
    def _fix(t: list) -> list:
        if t[2] and t[2][1] == t[1]:  # skew
            low = t[2]
            t[2], low[3] = low[3], t
            t = low
        if t[3] and t[3][3] and t[3][3][1] == t[1]:  # split
            high = t[3]
            t[3], high[2] = high[2], t
            high[1] += 1
            t = high
        return t

    def add(self, key: tuple[int, int]) -> None:
        def down(t: list | None) -> list:
            if t is None:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = down(t[side])
            return self._fix(t)

        self.root = down(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def level(t: list | None) -> int:
            return t[1] if t else 0

        def down(t: list | None, key: tuple[int, int]) -> list | None:
            if t is None:
                return None
            if key == t[0]:
                if not t[2] and not t[3]:
                    return None
                side, other = (3, 2) if t[3] else (2, 3)
                near = t[side]
                while near[other]:
                    near = near[other]
                t[0] = near[0]
                t[side] = down(t[side], near[0])
            else:
                side = 2 if key < t[0] else 3
                t[side] = down(t[side], key)
            least = min(level(t[2]), level(t[3])) + 1
            if least < t[1]:
                t[1] = least
                if t[3] and least < t[3][1]:
                    t[3][1] = least
            t = self._fix(t)
            if t[3]:
                t[3] = self._fix(t[3])
                if t[3][3]:
                    t[3][3] = self._fix(t[3][3])
            return self._fix(t)

        self.root = down(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least entry with at least ``size`` left."""
        t, best = self.root, None
        while t:
            if t[0] >= (size, -1):
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best


def best_fit_decreasing(histogram: dict[int, int], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (class, first rank, end rank, shard), or None if more than ``most`` shards are needed."""
    tree, runs, shards = CapacityTree(), [], 0
    for size in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[size]
        while rank < todo:
            found = tree.tightest(size)
            if found is None:
                if shards == most:
                    return None
                left, shard = capacity, shards
                shards += 1
            else:
                left, shard = found
                tree.remove(found)
            n = min(todo - rank, left // size)  # a shard that took one stays the tightest while it takes another
            runs.append((size, rank, rank + n, shard))
            rank += n
            if left - n * size:
                tree.add((left - n * size, shard))
    return runs


def plan_for(histogram: dict[int, int], shards: int, steps: int = 24) -> tuple[list[tuple[int, int, int, int]], int]:
    """The plan for at most so many shards, with slack over the even share doubled from 2**-16 of it until it fits."""
    total = sum(s * n for s, n in histogram.items())
    even = max(-(-total // shards), max(histogram, default=1))
    for k in range(steps + 1):
        capacity = even if k == 0 else even + max(1, even >> max(0, 17 - k)) if k <= 17 else even << (k - 17)
        runs = best_fit_decreasing(histogram, capacity, shards)
        if runs is not None:
            return runs, capacity
    raise ValueError("no capacity found")


def size_class(size):  # noqa: ANN001, ANN201
    """``size`` rounded up to 12 significant bits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - BITS)
    unit = F.pow(F.lit(2), shift).cast("long")
    return F.floor((size + unit - 1) / unit).cast("long") * unit


def shard_documents(docs: DataFrame, shards: int | None = 24, capacity: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_cut.  Give ``shards``, or a ``capacity`` in bytes to open as few shards of it as best fit needs."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("grp")), "shard-rows")
    total, count, largest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(1))).first()
    if capacity and largest > capacity:
        raise ValueError(f"a document of {largest} bytes is larger than a shard of {capacity}")
    room = capacity or max(-(-total // shards), largest)
    salts = ranks.salts_for(count)
    groups = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    groups = groups.withColumn("per", F.least("n", F.greatest(F.lit(1), F.floor(F.lit(room) / F.col("size")).cast("long"))))
    # a group larger than a shard goes as pieces of ``per`` documents; all others as one
    pieces = groups.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div per"))).alias("piece"), "n", "per", "size")
    pieces = pieces.withColumn("bytes", F.least("per", F.expr("n - piece * per")) * F.col("size")).withColumn("cls", F.least(size_class(F.col("bytes")), F.greatest("bytes", F.lit(room)))).select("grp", "piece", "cls")
    histogram = {r.cls: r.n for r in pieces.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 4096 rows per doubling of the largest size
    runs = best_fit_decreasing(histogram, capacity) if capacity else plan_for(histogram, shards)[0]
    plan = spark.createDataFrame(runs, "cls long, lo long, hi long, shard int").groupBy("cls").agg(F.collect_list(F.struct("lo", "hi", "shard")).alias("runs"))
    placed = ranks.ranked(pieces, "cls", ["grp", "piece"], salts, "rank").join(F.broadcast(plan), "cls")  # bounded as the histogram is
    placed = placed.select("grp", "piece", F.expr("filter(runs, r -> r.lo <= rank AND rank < r.hi)[0].shard").alias("shard"))
    split = groups.filter("per < n").select("grp", "per")  # fewer rows than shards
    inside = rows.join(F.broadcast(split), "grp")
    cut = ranks.ranked(inside, "grp", ["doc_id", "text_crc32"], salts, "nth").withColumn("piece", F.expr("nth div per")).select(*rows.columns, "piece", F.lit(True).alias("group_cut"))
    whole = rows.join(F.broadcast(split.select("grp")), "grp", "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("piece"), F.lit(False).alias("group_cut"))
    dealt = whole.unionByName(cut).join(placed, ["grp", "piece"]).drop("piece", "grp")
    out = ranks.ranked(dealt, "shard", ["doc_id", "text_crc32"], salts, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_cut")
