"""Gapless ranks and running totals within keys and joins on keys, without collecting a key in one task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenfold.llm.storage import free_name, stored


def salts_for(rows: int, rows_per_salt: int = 1 << 18) -> int:
    """A power of two, so that one key with all rows still leaves about ``rows_per_salt`` to a task."""
    return 1 << max(3, math.ceil(math.log2(max(1, rows / rows_per_salt))))


def ranked(df: DataFrame, key: str, order: list[str], salts: int, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... within each ``key``.  Rows are numbered within (key, salt) and moved by the counts of lower salts, which is one row per key and salt; ``order`` fixes the salt and the order inside it."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    nth = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1
    return salted.withColumn("_nth", nth).join(ahead, [key, "_salt"]).withColumn(name, (F.col("_nth") + F.col("_ahead")).cast("long")).drop("_nth", "_ahead", "_salt")


def spread_join(rows: DataFrame, side: DataFrame, key: list[str], size: str, how: str = "inner", least: int = 256, known: tuple[int, int] | None = None) -> DataFrame:
    """``rows`` joined with ``side``, which has one row per key and, as ``size``, how many ``rows`` have it.

    A key with more than 1/4096 of all rows (and more than ``least``) is dealt over so many salts that none has
    more; only these keys, fewer than 4096, are broadcast.  ``side`` is read three times, so it should be stored;
    without such keys a plain join gives the same rows, and ``side`` is read once if ``known`` says how many rows there are and how many the commonest key has.
    """
    total, top = known or side.agg(F.sum(size), F.max(size)).first()
    most = max(least, (total or 0) >> 12)
    if (top or 0) <= most:
        return rows.join(side, key, how)
    salts, salt = free_name(rows, "_salts"), free_name(rows, "_salt")
    hot = side.filter(F.col(size) > most).select(*key, F.expr(f"cast({size} div {most} + 1 AS int)").alias(salts))
    spread = rows.join(F.broadcast(hot), key, "left")
    nth = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if c not in key and kind in _PLAIN]) + F.spark_partition_id(), F.col(salts)).cast("int")
    spread = spread.withColumn(salt, F.when(F.col(salts).isNull(), 0).otherwise(nth)).drop(salts)
    copies = side.withColumn(salt, F.explode(F.when(F.col(size) > most, F.expr(f"sequence(0, cast({size} div {most} AS int))")).otherwise(F.array(F.lit(0)))))
    return spread.join(copies, [*key, salt], how).drop(salt)


_PLAIN = ("bigint", "int", "binary", "boolean", "tinyint", "smallint")


def running(df: DataFrame, key: str, order: list[str], sums: list[str]) -> DataFrame:
    """``df`` with each of ``sums`` (longs, not null, none negative) replaced by its running total within ``key`` (a long, not null) in ``order``.

    Rows are sorted by ranges of (key, order), so that a key of any size lies over several tasks; each task adds up its
    own stretch, and the few keys that go over a border, fewer than tasks, carry what came before.
    """
    columns = [key, *order]
    part = free_name(df, "_part")
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(part, F.spark_partition_id())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            done = {}
            for c in sums:
                total = np.cumsum(batch.column(c).to_numpy(zero_copy_only=False))
                before = np.concatenate(([0], total[starts[1:] - 1]))
                if keys[0] == last:
                    before[0] -= carry[c]
                done[c] = total - np.repeat(before, sizes)
                carry[c] = int(done[c][-1])
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([pa.array(done[c]) if c in done else batch.column(c) for c in batch.schema.names], batch.schema.names)

    local = stored(ranged.mapInArrow(work, ranged.schema), "running")
    ends = local.groupBy(key, part).agg(*[F.max(c).alias(c) for c in sums])
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, part, F.row_number().over(Window.partitionBy(key).orderBy(part)).alias("_nth"), *[F.sum(c).over(before).alias(f"_before_{c}") for c in sums])
    carried = carried.filter("_nth > 1").drop("_nth")  # fewer rows than tasks
    out = local.join(F.broadcast(carried), [key, part], "left")
    return out.select(*[(F.col(c) + F.coalesce(f"_before_{c}", F.lit(0))).alias(c) if c in sums else c for c in df.columns])
