"""Best-fit-decreasing packing of documents into windows of a fixed number of tokens.

Overlong documents are first cut into full windows; what is left of each document, longest first, enters
the tightest open window that takes it, found in a segment tree indexed by remaining capacity.

Lengths are integers up to the window, so equal pieces are interchangeable: the driver packs the histogram
of lengths (at most ``capacity`` rows, whatever the corpus), placing runs of equal pieces into runs of equal
windows at once, which gives the same windows as placing them one by one.  The plan is a table of runs; a
piece finds its window by its rank among the pieces of its length.  Ranks come from counts per (length,
salt), so a length that a third of all documents share is spread over many tasks.

Cases: a null or empty text has only the closing id; repeated rows are packed each; null ids are packed as
any other; bytes that are not UTF-8 are tokenized as U+FFFD; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenfold.llm import ranks, textops
from wrenfold.llm.storage import stored

BLOCK = 1 << 20
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """A segment tree over remaining capacities 0..n: the smallest one of at least s that an open window has."""

    def __init__(self, n: int) -> None:
        self.leaves = 1 << max(0, n.bit_length())
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, present: bool) -> None:
        i = self.leaves + capacity
        self.any[i] = present
        while i > 1:
            i //= 2
            now = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def at_least(self, size: int) -> int | None:
        i = self.leaves + size
        if self.any[i]:
            return size
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


@dataclass(frozen=True)
class Run:
    """Pieces ``first .. first + count - 1`` of one length fill windows from ``window`` on, ``each`` to a window, from ``offset``."""

    length: int
    first: int
    count: int
    window: int
    each: int
    offset: int


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """The plan for so many pieces of each length, and the number of windows."""
    tree, runs, windows = CapacityTree(capacity), [], 0
    open_: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> ranges (first window, number)

    def put(left: int, first: int, number: int) -> None:
        if left and number:
            open_.setdefault(left, []).append((first, number))
            tree.set(left, True)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.at_least(length)
            if left is None:
                left, first = capacity, windows
                number = -(-todo // (capacity // length))
                windows += number
            else:
                first, number = open_[left].pop()
                if not open_[left]:
                    tree.set(left, False)
            each = left // length
            full = min(number, todo // each)
            if full:
                runs.append(Run(length, rank, full * each, first, each, capacity - left))
                put(left - each * length, first, full)
                rank, todo, first, number = rank + full * each, todo - full * each, first + full, number - full
            if todo and number:  # fewer than one window takes
                runs.append(Run(length, rank, todo, first, todo, capacity - left))
                put(left - todo * length, first, 1)
                rank, todo, first, number = rank + todo, 0, first + 1, number - 1
            put(left, first, number)
    return runs, windows


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document: full windows and what is left; ``keep_ids`` adds the ids as little-endian bytes."""
    schema = PIECE + (", ids binary" if keep_ids else "")

    def work(batches):  # noqa: ANN001, ANN202
        from wrenfold.llm.tokens import PieceEncoder

        encoder = PieceEncoder(tokenizer_path)
        for batch in batches:
            data, offsets = textops.buffers(textops.as_text(batch.column("text")))
            ids_ = batch.column("doc_id")
            for lo, hi in textops.blocks(offsets, BLOCK):
                block = data[offsets[lo] : offsets[hi]]
                chars = np.frombuffer(block.tobytes().decode().encode("utf-32-le"), np.uint32)
                ahead = np.zeros(len(block) + 1, np.int64)
                np.cumsum((block & 0xC0) != 0x80, out=ahead[1:])
                tokens, cuts = encoder.encode(chars, ahead[offsets[lo : hi + 1] - offsets[lo]])
                yield _pieces(ids_.slice(lo, hi - lo), tokens, cuts, end_id, capacity, keep_ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, schema)


def _pieces(doc_ids: pa.Array, tokens: np.ndarray, cuts: np.ndarray, end_id: int, capacity: int, keep_ids: bool) -> pa.RecordBatch:
    sizes = np.diff(cuts) + 1
    rows = np.repeat(np.arange(len(sizes)), -(-sizes // capacity))
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    start = nth * capacity
    length = np.minimum(sizes[rows] - start, capacity)
    whole = tokens.astype("<u4").tobytes()
    end = int(end_id).to_bytes(4, "little")
    parts = []
    for a, b, last in zip((cuts[:-1][rows] + start).tolist(), (cuts[:-1][rows] + start + length).tolist(), (start + length == sizes[rows]).tolist(), strict=True):
        parts.append(whole[4 * a : 4 * (b - 1)] + end if last else whole[4 * a : 4 * b])
    out = {"doc_id": doc_ids.take(pa.array(rows)), "start": start.astype(np.int64), "length": length.astype(np.int64), "ids_crc32": pa.array(map(zlib.crc32, parts), pa.int64()), "doc_tokens": sizes[rows].astype(np.int64)}
    if keep_ids:
        out["ids"] = pa.array(parts, pa.binary())
    return pa.RecordBatch.from_pydict(out)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, keep_ids: bool = False, rows_per_salt: int = 1 << 18) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    pieces = stored(tokenized(docs, tokenizer_path, end_id, capacity, keep_ids), "pieces")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.collect()}  # at most capacity rows
    runs, _ = best_fit_decreasing(histogram, capacity)
    plan = spark.createDataFrame(
        [(r.length, r.first, r.first + r.count, r.window, r.each, r.offset) for r in runs] or [],
        "length long, lo long, hi long, window long, each long, room long",
    )  # runs depend on lengths, not on documents
    ranked = ranks.ranked(pieces, "length", ["doc_id", "start", "ids_crc32"], ranks.salts_for(sum(histogram.values()), rows_per_salt), "rank")
    steps = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "window", "each", "room"))).alias("runs"))
    placed = ranked.join(F.broadcast(steps), "length")
    run = F.expr("filter(runs, r -> r.lo <= rank AND rank < r.hi)[0]")
    placed = placed.withColumn("run", run).drop("runs")
    at = F.col("rank") - F.col("run.lo")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", F.expr("run.window + (rank - run.lo) div run.each").alias("sequence_id"), (F.col("run.room") + (at % F.col("run.each")) * F.col("length")).alias("offset")]
    return placed.select(*cols, *(["ids"] if keep_ids else []))


RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
