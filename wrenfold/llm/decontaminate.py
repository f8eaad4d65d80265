"""Benchmark decontamination.

The hash set of all normalised benchmark n-grams is broadcast; the token windows of each document are
scanned against it, hits are verified word by word, and spans or documents are removed.

A word is a run of digits, a-z and bytes of non-ASCII characters after lower-casing A-Z.  A window is
``width`` consecutive words of an item; an item of fewer words, but not none, is one window.

The set lies in arrays: the windows' hashes in order, where their words begin and end in one byte buffer, and
their items; about ten bytes for each byte of the benchmark.  A benchmark of more than ``part_bytes`` of text is
dealt into parts of about that size; each part is broadcast by itself, its scan of the documents is written
as the hit words of each row, and the parts' hits are united by row.  So neither the driver nor a worker holds
more than one part, whatever the benchmark's size, and every hit is verified.  A single item isn't split.

Cases: null, empty or word-less texts have no words and are never contaminated; a word-less item has no
window; repeated item ids count once; items without an id count as one, which has no place in the digest; a
repeated or null doc_id is judged row by row; bytes that are not UTF-8 are parts of words (U+FFFD in a cut text); other columns, of whatever name, are ignored or carried; empty tables give no rows, or no hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenfold.llm import textops
from wrenfold.llm.storage import carried, free_name, stored

FIELDS = [
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
]
BLOCK = 2 << 20
#: Leading bits of the hashes by which most windows of documents are told apart from all of the set.
SEEN_BITS = 22


class Windows:
    """The windows of a benchmark: for each length the sorted hashes, where their words lie in ``data``, and their items."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int) -> None:
        self.names = sorted({i for i, _ in items}, key=lambda x: (x is not None, x))
        number = {n: k for k, n in enumerate(self.names)}
        texts = [textops.LOWER[np.frombuffer(t, np.uint8)].tobytes() for _, t in items]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        starts, ends, first = textops.find_words(self.data, offsets, textops.ALNUM_OR_HIGH)
        hashes = textops.word_hashes(self.data, starts, ends)
        count = np.diff(first)
        item = np.array([number[i] for i, _ in items], np.int32)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for n in sorted({*np.minimum(count, width).tolist()} - {0}):
            own = (count == n) if n < width else (count >= n)
            row = np.repeat(np.arange(len(items)), count)
            at = np.flatnonzero(textops.window_mask(first, n, len(starts)) & own[row[: max(0, len(starts) - n + 1)]])
            h = textops.window_hashes(hashes, n)[at]
            order = np.lexsort((item[row[at]], h))
            h, at = h[order], at[order]
            seen = np.zeros(1 << SEEN_BITS, bool)
            seen[(h >> np.uint64(64 - SEEN_BITS)).astype(np.int64)] = True
            self.by_length[n] = h, starts[at], ends[at + n - 1], item[row[at]], np.packbits(seen)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """For the lower-cased rows: the first word of each row, which words are hit, and the numbers of each row's items."""
        starts, ends, first = textops.find_words(data, offsets, textops.ALNUM_OR_HIGH)
        hashes = textops.word_hashes(data, starts, ends)
        hit = np.zeros(len(starts), bool)
        items: list[set[int]] = [set() for _ in range(len(offsets) - 1)]
        for n, (known, begin, end, item, seen) in self.by_length.items():
            windows = textops.window_hashes(hashes, n)
            if not len(windows):
                continue
            lead = (windows >> np.uint64(64 - SEEN_BITS)).astype(np.int64)
            may = np.flatnonzero((seen[lead >> 3] >> (7 - (lead & 7)).astype(np.uint8)) & 1 & textops.window_mask(first, n, len(starts)))
            lo, hi = np.searchsorted(known, windows[may]), np.searchsorted(known, windows[may], "right")
            may, lo, hi = may[hi > lo], lo[hi > lo], hi[hi > lo]
            rows = np.searchsorted(first, may, "right") - 1
            sure = []
            for i, row, a, b in zip(may.tolist(), rows.tolist(), lo.tolist(), hi.tolist(), strict=True):
                words = _words(data, starts[i : i + n], ends[i : i + n])
                same = self._same(words, begin[a:b], end[a:b])  # verified
                if same.any():
                    sure.append(i)
                    items[row].update(item[a:b][same].tolist())
            if sure:
                hit |= textops.cover(np.array(sorted(sure)), n, len(starts))
        return first, hit, items

    def _same(self, words: list[bytes], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the windows have these words; windows of equal bytes are compared once."""
        known: dict[bytes, bool] = {}
        out = np.zeros(len(begin), bool)
        for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            raw = self.data[a:b].tobytes()
            if raw not in known:
                known[raw] = split(raw) == words
            out[k] = known[raw]
        return out


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def split(text: bytes) -> list[bytes]:
    data = textops.LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = textops.find_words(data, np.array([0, len(data)]), textops.ALNUM_OR_HIGH)
    return _words(data, starts, ends)


def _digest(items: set[str | None]) -> str:
    return hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest()


def _masked(raw: bytes, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, part_bytes: int = 16 << 20, clean: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``clean="spans"`` adds ``clean_text``, the text without the hit spans (from a hit word's start to the
    end of the hit run); ``clean="documents"`` instead returns the rows of ``docs`` that aren't contaminated.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    if parts > 1:
        if clean == "documents":
            return carried(docs, lambda rows: _in_parts(rows, items, width, parts, clean))
        return _in_parts(docs, items, width, parts, clean)
    shared = _broadcast(items, width)

    def work(batches):  # noqa: ANN001, ANN202
        windows = shared.value
        for batch in batches:
            for part, first, hit, items in _scan(batch, windows):
                yield _judged(part, first, hit, [{windows.names[i] for i in x} for x in items], clean)

    if clean == "documents":
        return carried(docs, lambda rows: rows.mapInArrow(work, rows.schema))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, T.StructType(FIELDS + [T.StructField("clean_text", T.StringType())] * (clean == "spans")))


def _broadcast(items: DataFrame, width: int):  # noqa: ANN202
    """The windows of items of at most about ``part_bytes`` of text."""
    return items.sparkSession.sparkContext.broadcast(Windows([(r.item, r.text.encode()) for r in items.collect()], width))


def _scan(batch: pa.RecordBatch, windows: Windows):  # noqa: ANN202
    """Blocks of a batch: its rows, the first word of each, which words are hit, and each row's items."""
    data, offsets = textops.buffers(batch.column("text"))
    for lo, hi in textops.blocks(offsets, BLOCK):
        block = textops.LOWER[data[offsets[lo] : offsets[hi]]]
        yield batch.slice(lo, hi - lo), *windows.scan(block, offsets[lo : hi + 1] - offsets[lo])


def _judged(part: pa.RecordBatch, first: np.ndarray, hit: np.ndarray, items: list[set[str | None]], clean: str | None) -> pa.RecordBatch:
    n_words, n_hit = np.diff(first).astype(np.int64), textops.per_row(hit, first)
    bad = (n_hit > 0) & (20 * n_hit >= n_words)
    if clean == "documents":
        return part.filter(pa.array(~bad))
    out = {"doc_id": part.column("doc_id"), "n_words": n_words, "n_hit": n_hit, "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": pa.array(map(_digest, items), pa.string()), "contaminated": bad}
    if clean == "spans":
        out["clean_text"] = pa.array(_cleaned(part.column("text"), hit, first), pa.string())
    return pa.RecordBatch.from_pydict(out)


def _cleaned(texts: pa.Array, hit: np.ndarray, first: np.ndarray) -> list[str | None]:
    out, known = [], texts.is_valid().to_pylist()
    data, offsets = textops.buffers(texts)
    for i, there in enumerate(known):
        flags, raw = hit[first[i] : first[i + 1]], data[offsets[i] : offsets[i + 1]].tobytes()
        if not there or not flags.any():
            out.append(raw.decode("utf-8", "replace") if there else None)
            continue
        low = textops.LOWER[np.frombuffer(raw, np.uint8)]
        starts, ends, _ = textops.find_words(low, np.array([0, len(low)]), textops.ALNUM_OR_HIGH)
        edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
        out.append(_masked(raw, [(int(starts[a]), int(ends[b - 1])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]))
    return out


def _in_parts(docs: DataFrame, items: DataFrame, width: int, parts: int, clean: str | None) -> DataFrame:
    """The same for a benchmark of several parts, one scan for each."""
    row = free_name(docs, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-docs")
    items = stored(items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int")), "decontaminate-items")
    found = None
    for k in range(parts):
        shared = _broadcast(items.filter(F.col("part") == k).select("item", "text"), width)
        hits = stored(rows.select(row, "text").mapInArrow(_hits(shared, row), f"{row} long, begins array<long>, ends array<long>, names array<string>, unnamed boolean"), "decontaminate-hits")
        shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    union = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  at most one row for each part
    found = found.groupBy(row).agg(union("begins"), union("ends"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"), F.bool_or("unnamed").alias("unnamed"))
    if clean == "documents":
        inside = rows.select(F.col(row).alias("doc_id"), "text").join(found.withColumnRenamed(row, "doc_id"), "doc_id")
        bad = inside.mapInArrow(_united(None), T.StructType(FIELDS)).filter("contaminated").select(F.col("doc_id").alias(row))
        return rows.join(bad, row, "left_anti").drop(row)
    schema = T.StructType(FIELDS + [T.StructField("clean_text", T.StringType())] * (clean == "spans"))
    return rows.select(row, F.col("doc_id").cast("long").alias("doc_id"), "text").join(found, row, "left").mapInArrow(_united(clean), schema)


def _hits(shared, row: str):  # noqa: ANN001, ANN202
    """Rows with hits: the runs of hit words, counted from the row's first, and the items."""

    def work(batches):  # noqa: ANN001, ANN202
        windows = shared.value
        for batch in batches:
            for part, first, hit, items in _scan(batch, windows):
                out = []
                for k in np.flatnonzero(textops.per_row(hit, first)).tolist():
                    edge = np.diff(np.concatenate(([0], hit[first[k] : first[k + 1]].astype(np.int8), [0])))
                    who = {windows.names[i] for i in items[k]}
                    out.append((part.column(row)[k].as_py(), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), sorted(who - {None}), None in who))
                if out:
                    ids, begins, ends, names, unnamed = zip(*out, strict=True)
                    runs = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_pydict({row: pa.array(ids, pa.int64()), "begins": pa.array(begins, runs), "ends": pa.array(ends, runs), "names": pa.array(names, pa.list_(pa.string())), "unnamed": pa.array(unnamed)})

    return work


def _united(clean: str | None):  # noqa: ANN202
    def work(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            data, offsets = textops.buffers(batch.column("text"))
            first = textops.find_words(textops.LOWER[data], offsets, textops.ALNUM_OR_HIGH)[2]
            hit = np.zeros(int(first[-1]), bool)
            names, unnamed = batch.column("names").to_pylist(), batch.column("unnamed").to_pylist()
            for k, (begins, ends) in enumerate(zip(batch.column("begins").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
                for a, b in zip(begins or (), ends or (), strict=True):
                    hit[first[k] + a : first[k] + b] = True
            yield _judged(batch, first, hit, [{*(x or ()), *([None] if none else ())} for x, none in zip(names, unnamed, strict=True)], clean)

    return work
