"""Substring dedup over token windows.

Rabin-Karp hashes of every window of ``width`` words are counted across the corpus; each word under a
window whose sequence also starts earlier is removed, so repeated windows merge into maximal removal
intervals.  "Earlier" is a smaller ``doc_id``, or an earlier start in the same document.

Plan: distinct texts are dealt into shards by digest (one shuffle of the text, read by both passes); a shard
sends its distinct window hashes, each with the least id that has it there, through the key exchange and
learns which of them start earlier elsewhere.  Of equal texts the one of the least id is judged; the others
lose every word, if they have a window.  Volume: about ten bytes a distinct window and shard.  Windows compare
by 64-bit hashes of mixed word hashes: for n windows a false match has a chance of n / 2**64 per window.

Cases: a null or empty text has no words and hashes as the empty string; a text of fewer words than
``width`` has no window; null ids come first; rows that repeat an id (or have none) are documents of their own,
ordered by the digests of their texts, and one of several equal rows comes first; bytes that are not UTF-8 are parts of
words (U+FFFD where kept words are returned as text); extra columns are ignored; an
empty table gives an empty result; a very long text is worked in one piece, its memory about 60 bytes per word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenfold.llm import exchange, textops
from wrenfold.llm.ranks import spread_join
from wrenfold.llm.storage import stored, text_bytes

RESULT = T.StructType([
    T.StructField("grp", T.BinaryType()), T.StructField("copies", T.LongType()), T.StructField("least", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("kept_sha256", T.StringType()), T.StructField("n_intervals", T.LongType()), T.StructField("kept", T.StringType()),
])
#: The order of a row without an id.
BEFORE_ALL = -(1 << 63)


def _windows(table: pa.Table, width: int) -> tuple:
    data, offsets = textops.buffers(table["text"])
    starts, ends, first = textops.find_words(data, offsets, textops.NOT_SPACE)
    hashes = textops.window_hashes(textops.word_hashes(data, starts, ends), width)
    return data, offsets, starts, ends, first, hashes, textops.window_mask(first, width, len(starts))


def _in_order(table: pa.Table) -> pa.Table:
    """Distinct texts by the place of the first row of each: without an id, then by id, then by digest."""
    least = np.where(table["nulls"].to_numpy() > 0, BEFORE_ALL, table["least"].fill_null(BEFORE_ALL).to_numpy())
    return exchange.ordered(table.set_column(table.column_names.index("least"), "least", pa.array(least)), "least")


def kept_texts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each row, joined by one space: bytes and offsets."""
    which = np.flatnonzero(keep)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[which]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[which]] += 1
    edge[ends[which]] -= 1  # words never touch
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    gap = ends[which[:-1]][rows[:-1] == rows[1:]] if len(which) else which  # behind each kept word but a row's last there is a separator
    mask[gap] = True
    out = data.copy()
    out[gap] = 0x20
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return out[mask], sums[offsets]


def dedup_windows(docs: DataFrame, width: int = 20, shard_bytes: int = 4 << 20, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, n_intervals (maximal removed runs) and, ``with_text``, the kept words."""
    total = text_bytes(docs)
    shards = exchange.shards_for(total, shard_bytes)
    bits = exchange.bits_for(1.3 * total)  # a window in some six bytes
    texts = exchange.dealt(docs, shards)

    def firsts(table: pa.Table) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
        """What ``_windows`` gives, its windows in the order of their hashes, which of these is the first of its hash, and the hashes."""
        found = _windows(table, width)
        at = np.flatnonzero(found[-1])
        order = at[np.argsort(found[-2][at], kind="stable")]
        ranked = found[-2][order]
        return found, order, np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(at) else np.zeros(0, bool), ranked

    def send(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        found, order, lead, ranked = firsts(table)
        row = np.searchsorted(found[4], order[lead], "right") - 1
        return exchange.sent(table["shard"][0].as_py(), ranked[lead], table["least"].to_numpy()[row], bits)

    def remove(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT_EMPTY
        table = _in_order(table)
        (data, offsets, starts, ends, first, *_), order, lead, _ = firsts(table)
        again = ~lead
        again[lead] = exchange.received(answer).astype(bool)
        gone = textops.cover(np.sort(order[again]), width, len(starts))
        kept, cuts = kept_texts(data, offsets, starts, ends, first, ~gone)
        edge = gone & ~np.concatenate(([False], gone[:-1]))
        begins = first[:-1][np.diff(first) > 0]
        edge[begins] = gone[begins]
        raw = memoryview(kept)
        parts = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.table({
            "grp": table["grp"], "copies": table["copies"], "least": table["least"], "n_words": np.diff(first).astype(np.int64), "n_removed": textops.per_row(gone, first),
            "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()), "n_intervals": textops.per_row(edge, first),
            "kept": pa.array([bytes(p).decode("utf-8", "replace") for p in parts] if with_text else [None] * len(parts), pa.string()),
        })

    keys = texts.groupBy("shard").applyInArrow(send, exchange.SENT)
    answers = exchange.ask(keys, exchange.of_first(), bits, shards)
    judged = stored(texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(remove, RESULT), "windows")
    rows = docs.select(F.col("doc_id").cast("long"), exchange.digest().alias("grp")).groupBy("doc_id", "grp").agg(F.count(F.lit(1)).alias("same"))
    both = spread_join(rows, judged, ["grp"], "copies").withColumn("nth", F.explode(F.expr("sequence(1L, same)")))
    stays = ((F.col("nth") == 1) & (F.coalesce("doc_id", F.lit(BEFORE_ALL)) == F.col("least"))) | (F.col("n_words") < width)
    nothing = {"n_removed": F.col("n_words"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "n_intervals": F.lit(1).cast("long"), "kept": F.lit("" if with_text else None)}
    return both.select("doc_id", "n_words", *[F.when(stays, F.col(c)).otherwise(x).alias(c) for c, x in nothing.items() if c != "kept" or with_text])


RESULT_EMPTY = pa.table({f.name: pa.array([], pa.int64() if f.dataType == T.LongType() else pa.binary() if f.dataType == T.BinaryType() else pa.string()) for f in RESULT.fields})
