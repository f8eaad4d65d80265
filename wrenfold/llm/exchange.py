"""Shards of distinct texts, and a key exchange between them.

``dealt`` gives each distinct text to a shard by its digest, whatever its id, source or number of copies: a
shard holds about ``shard_bytes`` bytes of text (one text at least), and a text that a third of all rows share
is in it once.  The order of shards is the order of digests.

``ask`` tells every shard about its keys.  A shard sends its distinct 64-bit keys, sorted and delta-coded,
with a number each, to the owners of ranges of the key space; an owner merges the lists and answers each with
one byte per key.  At most ``1 << FAN_BITS`` ranges are told apart at a time.  With more ranges than that the
lists of neighbouring shards first meet at a carrier of a coarse range, which sends on each key once; so a
shard sends a bounded number of rows on each level, and rows grow as the input does.  A hot key costs its
owner one entry per shard, or per carrier.

Cases: a null text is the empty text; copies of a text are counted whatever their ids, and rows without an id by
themselves; a text of many MB is a shard of its own (a text isn't split); an empty table has no shards and no
questions; columns other than doc_id and text are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenfold.llm import textops

#: Bits of the key by which a shard or carrier deals its keys.
FAN_BITS = 10
#: Shards to a partition, beyond ``LONE`` of them: a shard is a task's unit of memory, not of scheduling.
SHARDS_A_PARTITION, LONE = 64, 4096
PART_BYTES = 12 << 20

TEXTS = "shard long, grp binary, text string, copies long, least long, nulls long"
SENT = "part int, shard long, keys binary, vals binary"
ANSWER = "shard long, part int, said binary"


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_planes(values: np.ndarray) -> bytes:
    """64-bit values as byte planes, compressed."""
    return squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()) if len(values) else b""


def unpack_planes(blob: bytes, kind: type = np.uint64) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(unsqueeze(blob), np.uint8).reshape(8, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as byte planes of their differences."""
    return pack_planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(blob), dtype=np.uint64)


# ---- texts


def digest(text: str = "text"):  # noqa: ANN201
    """SHA-256 of a text as 32 bytes; null as the empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def shards_for(total_bytes: int, shard_bytes: int) -> int:
    return max(1, -(-total_bytes // shard_bytes))


def dealt(docs: DataFrame, shards: int) -> DataFrame:
    """One row per distinct text: shard, grp (its digest), text, copies, least (the smallest id of its rows, null if none has one), nulls (rows without an id).

    Copies leave a task once; those of several tasks meet in the JVM, where sorting can spill.
    """

    def work(batches):  # noqa: ANN001, ANN202
        seen: dict[bytes, list] = {}  # copies, least, nulls of texts of this task
        for batch in batches:
            texts, ids = batch.column("text").fill_null(""), batch.column("doc_id").to_pylist()
            data, offsets = textops.buffers(texts)
            raw = memoryview(data)
            fresh, own = [], []
            for i, (a, b, n) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), ids, strict=True)):
                g = hashlib.sha256(raw[a:b]).digest()
                have = seen.get(g)
                if have is None:
                    seen[g] = [0, None, 0]
                    fresh.append(i)
                    own.append((g, n))
                    continue
                have[0] += 1
                if n is None:
                    have[2] += 1
                elif have[1] is None or n < have[1]:
                    have[1] = n
            for lo in range(0, len(fresh), 500):
                part = own[lo : lo + 500]
                yield _rows([g for g, _ in part], texts.take(pa.array(fresh[lo : lo + 500])), [(1, n, int(n is None)) for _, n in part])
        more = [(g, x) for g, x in seen.items() if x[0]]
        for lo in range(0, len(more), 10_000):
            part = more[lo : lo + 10_000]
            yield _rows([g for g, _ in part], pa.nulls(len(part), pa.string()), [x for _, x in part])

    def _rows(groups: list[bytes], texts: pa.Array, counts: list) -> pa.RecordBatch:
        copies, least, nulls = zip(*counts, strict=True)
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([int.from_bytes(g[:6], "big") * shards >> 48 for g in groups], pa.int64()), "grp": pa.array(groups, pa.binary()), "text": texts,
            "copies": pa.array(copies, pa.int64()), "least": pa.array(least, pa.int64()), "nulls": pa.array(nulls, pa.int64()),
        })

    partitions = shards if shards <= LONE else max(LONE, shards // SHARDS_A_PARTITION)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, TEXTS).repartition(partitions, "shard")
    return rows.groupBy("shard", "grp").agg(F.first("text", ignorenulls=True).alias("text"), F.sum("copies").alias("copies"), F.min("least").alias("least"), F.sum("nulls").alias("nulls"))


def ordered(table: pa.Table, *keys: str) -> pa.Table:
    """A group's rows in one order, whatever order they came in: by ``keys``, then by digest."""
    return table.sort_by([(k, "ascending") for k in (*keys, "grp")]) if table.num_rows > 1 else table


# ---- keys


def bits_for(key_bytes: float) -> int:
    """Bits so that an owner merges about ``PART_BYTES`` of keys."""
    return max(0, int(np.ceil(np.log2(max(1.0, key_bytes / PART_BYTES)))))


@dataclass(frozen=True)
class Merge:
    """Entries of several lists in key order (of one key, in list order)."""

    group: np.ndarray  # the number of each entry's key
    heads: np.ndarray  # where each key begins
    vals: np.ndarray


@dataclass(frozen=True)
class Question:
    """``combine``: numbers of one key become one; ``judge``: an owner's uint8 for each entry; ``pass_on``: a carrier's for each entry, from what its owner said of each key."""

    combine: Callable[[Merge], np.ndarray]
    judge: Callable[[Merge], np.ndarray]
    pass_on: Callable[[Merge, np.ndarray], np.ndarray]


def of_sum(f: Callable[[np.ndarray], np.ndarray]) -> Question:
    """Every holder of a key learns ``f`` of the sum of all its numbers."""
    total = lambda m: np.add.reduceat(m.vals, m.heads) if len(m.heads) else m.vals
    return Question(total, lambda m: f(total(m)).astype(np.uint8)[m.group], lambda m, said: said[m.group])


def _first_least(m: Merge) -> np.ndarray:
    out = np.zeros(len(m.vals), bool)
    if len(m.heads):
        at = np.flatnonzero(m.vals == np.minimum.reduceat(m.vals, m.heads)[m.group])
        g = m.group[at]
        out[at[np.concatenate(([True], g[1:] != g[:-1]))]] = True
    return out


def of_first() -> Question:
    """The holder of a key's least number (of several, the first in shard order) learns 0, all others 1."""
    least = lambda m: np.minimum.reduceat(m.vals, m.heads) if len(m.heads) else m.vals
    return Question(least, lambda m: (~_first_least(m)).astype(np.uint8), lambda m, said: np.where(_first_least(m), said[m.group], 1).astype(np.uint8))


def _cuts(keys: np.ndarray, done: int, bits: int) -> np.ndarray:
    """Where each of the 2**bits ranges begins in sorted keys that share their ``done`` leading bits."""
    if not bits or not len(keys):
        return np.concatenate(([0], np.full(1 << bits, len(keys))))
    high = int(keys[0]) >> (64 - done) << bits if done else 0
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) + np.uint64(high)) << np.uint64(64 - done - bits)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def sent(shard: int, keys: np.ndarray, vals: np.ndarray, bits: int, done: int = 0, fan: int = FAN_BITS) -> pa.Table:
    """The rows by which a shard (or carrier) sends its sorted distinct keys and their numbers: one for each range that it has keys of."""
    step = min(bits, fan)
    at = _cuts(keys, done, step)
    parts = np.flatnonzero(np.diff(at))
    vals = vals.astype(np.int64)
    return pa.table({
        "part": pa.array(parts, pa.int32()),
        "shard": pa.array(np.full(len(parts), shard), pa.int64()),
        "keys": pa.array([pack_sorted(keys[at[p] : at[p + 1]]) for p in parts], pa.binary()),
        "vals": pa.array([pack_planes(vals[at[p] : at[p + 1]]) for p in parts], pa.binary()),
    })


def received(answer: pa.Table) -> np.ndarray:
    """The answers of all owners, in the order of the keys as sent."""
    if not answer.num_rows:
        return np.zeros(0, np.uint8)
    rows = sorted(zip(answer["part"].to_pylist(), answer["said"].to_pylist(), strict=True))
    return np.concatenate([np.frombuffer(unsqueeze(v), np.uint8) for _, v in rows])


def _merged(table: pa.Table) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, Merge]:
    """(shard, part) and sizes of the lists, the distinct keys, and the merge (whose ``order`` is returned third)."""
    rows = sorted(zip(table["shard"].to_pylist(), table["part"].to_pylist(), table["keys"].to_pylist(), table["vals"].to_pylist(), strict=True), key=lambda r: r[:2])
    lists = [unpack_sorted(k) for _, _, k, _ in rows]
    keys = np.concatenate(lists)
    order = np.argsort(keys, kind="stable")  # merges the runs
    keys = keys[order]
    lead = np.concatenate(([True], keys[1:] != keys[:-1]))
    heads = np.flatnonzero(lead)
    vals = np.concatenate([unpack_planes(v, np.int64) for *_, v in rows])[order]
    return [(r[0], r[1], len(x)) for r, x in zip(rows, lists, strict=True)], keys[heads], order, Merge(np.cumsum(lead) - 1, heads, vals)


def _answers(lists: list, order: np.ndarray, said: np.ndarray) -> pa.Table:
    out = np.empty(len(order), np.uint8)
    out[order] = said
    cut = np.cumsum([0, *(n for *_, n in lists)])
    return pa.table({
        "shard": pa.array([s for s, *_ in lists], pa.int64()), "part": pa.array([p for _, p, _ in lists], pa.int32()),
        "said": pa.array([squeeze(out[a:b].tobytes()) for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
    })


def ask(lists: DataFrame, question: Question, bits: int, senders: int, done: int = 0, fan: int = FAN_BITS) -> DataFrame:
    """The answers to what ``sent`` gave: shard, part, said.  ``bits``: of all ranges; ``senders``: shards 0 .. senders - 1 sent."""
    if bits <= fan:

        def own(table: pa.Table) -> pa.Table:
            known, _, order, merge = _merged(table)
            return _answers(known, order, question.judge(merge))

        return lists.groupBy("range" if "range" in lists.columns else "part").applyInArrow(own, ANSWER)
    # shards of one block meet at a carrier for each coarse range
    block = 1 << fan
    blocks = -(-senders // block)
    coarse = F.col("range") if "range" in lists.columns else F.col("part").cast("long")
    lists = lists.withColumn("carrier", coarse * blocks + F.expr(f"shard % {senders} div {block}"))

    def send_on(table: pa.Table) -> pa.Table:
        _, keys, _, merge = _merged(table)
        return sent(table["carrier"][0].as_py(), keys, question.combine(merge), bits - fan, done + fan, fan)

    def hand_down(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ANSWER_EMPTY
        known, _, order, merge = _merged(table)
        return _answers(known, order, question.pass_on(merge, received(answer)))

    up = lists.groupBy("carrier").applyInArrow(send_on, SENT)
    # a range of the next level: the coarse range and the part in it; its carriers are one for each block
    up = up.withColumn("range", F.expr(f"shard div {blocks}") * (1 << min(bits - fan, fan)) + F.col("part"))
    said = ask(up, question, bits - fan, blocks, done + fan, fan)
    return lists.groupBy("carrier").cogroup(said.withColumnRenamed("shard", "carrier").groupBy("carrier")).applyInArrow(hand_down, ANSWER)


ANSWER_EMPTY = pa.table({"shard": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "said": pa.array([], pa.binary())})
