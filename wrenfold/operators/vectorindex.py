"""An inverted-cell index of vectors: equality prefixes, pruned probes, searches of many vectors at once.

``CellIndex.build`` fits cell centres on a bounded sample (``sample`` rows, those with the least hash of their id),
puts every vector into the cell of its nearest centre and writes the vectors by (prefix columns, cell).  A probe reads
only the folders of its prefix and of the cells nearest to the asked vector; ``probes=None`` looks into all cells,
which is exact.  ``search`` asks for many vectors: blocks of queries meet blocks of rows of the same prefix and cell,
cells with many rows are dealt over salts, and each pair of blocks keeps its best k.

How many cells a probe looks into is a trade of recall for reads: ``probes_for`` says how many a recall needs, from a
bounded number of asked vectors, and ``recall`` measures a search against the exact way.

Cases: a vector that is null, of another width, without length, or with a null or non-finite component can't be
searched and is left out, as is one whose prefix has a null; an index of no vectors answers with no rows; equal
distances go to the lesser id; of repeated ids each row counts; a search leaves out the rows with the query's own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wrenfold.functions.rows import table
from wrenfold.operators.retrieval import DIM, shortlist
from wrenfold.registry import query
from wrenfold.sources.folders import work_folder

#: Rows that the centres are fitted on, at most; cells, at most; rows and queries of a block.
SAMPLE, MOST_CELLS, ROWS, ASKED = 16384, 4096, 2048, 512
#: Distances of rows to centres that a task holds at a time, and rows with a cell each that it sends on at a time.
NEAR, COPIES = 1 << 19, 8192
#: Blocks of a cell that meet the queries in one task.
BLOCKS_A_SALT = 64


def searchable(vector: str, width: int) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == width) & good & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors, a row each."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


class CellIndex:
    """``path`` holds (id, embedding) by (prefix, cell); ``centres`` are unit vectors."""

    def __init__(self, spark: SparkSession, path: str, prefix: list[str], centres: np.ndarray, schema: StructType) -> None:
        self.spark, self.path, self.prefix, self.centres, self.schema = spark, path, prefix, centres, schema
        self.width = centres.shape[1]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, prefix: list[str], cells: int | None = None, width: int = DIM, sample: int = SAMPLE, seed: int = 7) -> CellIndex:
        """``vectors``: (id, embedding, prefix columns).  Without ``cells`` there are as many as the square root of the rows, ``MOST_CELLS`` at most."""
        spark = vectors.sparkSession
        rows = vectors.select("id", "embedding", *prefix).filter(searchable("embedding", width)).dropna(subset=["id", *prefix])
        some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector("embedding").alias("features"))
        cells = cells or max(1, min(MOST_CELLS, int(rows.count() ** 0.5)))
        if some.isEmpty():
            centres = np.zeros((0, width))
        elif cells == 1:
            centres = np.ones((1, width))
        else:
            centres = np.array(KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(some).clusterCenters())
        index = cls(spark, path, prefix, centres, StructType())
        placed = index.cells_of(rows, 1).select("id", "embedding", *prefix, "cell")
        index.schema = placed.schema
        # a shuffle that brings a cell together; AQE cuts cells that are larger than the others
        placed.hint("rebalance", *prefix, "cell").write.partitionBy(*prefix, "cell").parquet(path)
        return index

    def cells_of(self, rows: DataFrame, probes: int | None) -> DataFrame:
        """``rows`` with each of their nearest ``probes`` cells (all without it) in a row: ``cell``, and ``nth`` from 1."""
        shared = self.spark.sparkContext.broadcast(self.centres)  # MOST_CELLS vectors at most
        width = self.width

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = max(1, NEAR // max(1, len(shared.value)))
                for at in range(0, batch.num_rows, size):
                    some = batch.slice(at, size)
                    near = _matrix(some.column("embedding"), width) @ shared.value.T
                    n = min(probes or near.shape[1], near.shape[1])
                    best = near.argmax(1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]
                    for lo in range(0, some.num_rows, max(1, COPIES // max(1, n))):
                        part = some.slice(lo, max(1, COPIES // max(1, n)))
                        again = part.take(pa.array(np.repeat(np.arange(part.num_rows), n)))
                        cell, nth = best[lo : lo + part.num_rows].astype(np.int32).ravel(), np.tile(np.arange(1, n + 1, dtype=np.int32), part.num_rows)
                        yield pa.RecordBatch.from_arrays([*again.columns, pa.array(cell), pa.array(nth)], [*again.schema.names, "cell", "nth"])

        return rows.mapInArrow(work, StructType.fromJson(rows.schema.jsonValue()).add("cell", "integer").add("nth", "integer"))

    def probes_for(self, goal: float, k: int, asked: int = 256, seed: int = 11) -> int:
        """The fewest cells to look into for a recall of ``goal`` at k, measured on ``asked`` indexed vectors: how near to each is the cell of each of its exact neighbours?"""
        some = self.rows().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(asked).drop("cell")
        exact = F.broadcast(self.search(some, k).select("query_id", "vec_id"))  # asked * k rows
        homes = self.rows().select("id", "cell").join(exact, F.col("id") == F.col("vec_id")).select("query_id", "cell")
        order = self.cells_of(some.select("id", "embedding"), None).select(F.col("id").alias("query_id"), "cell", "nth")
        counts = homes.join(order, ["query_id", "cell"]).groupBy("nth").agg(F.count(F.lit(1)).alias("n")).orderBy("nth").collect()  # a row per cell
        total, have = sum(r.n for r in counts), 0
        for r in counts:
            have += r.n
            if have >= goal * total:
                return r.nth
        return max(1, len(self.centres))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def probe(self, vector: list[float], k: int, probes: int | None = None, **equal: object) -> DataFrame:
        """(vec_id, d): the k nearest of one vector with the given prefix values, among its nearest ``probes`` cells, or among all."""
        rows = self.rows()
        for name in self.prefix:
            rows = rows.filter(F.col(name) == F.lit(equal[name]))
        if probes and len(self.centres):
            unit = np.array(vector, np.float64)
            rows = rows.filter(F.col("cell").isin(np.argsort(-(self.centres @ unit), kind="stable")[:probes].tolist()))
        target = self.spark.createDataFrame([(list(map(float, vector)),)], "embedding array<double>")
        return shortlist(rows.withColumnRenamed("id", "vec_id"), target, k).select("vec_id", "d")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, rank, vec_id, d): the k nearest rows of each of ``queries`` (id, embedding, prefix columns)."""
        asked = queries.select("id", "embedding", *self.prefix).filter(searchable("embedding", self.width)).dropna(subset=["id", *self.prefix])
        key = lambda df: df.withColumn("key", F.to_json(F.struct(*self.prefix, "cell")))
        right = key(self.rows()).select("key", "id", "embedding").mapInArrow(_blocks(ROWS), _BLOCK)
        salts = right.groupBy("key").agg(F.expr(f"cast(count(1) div {BLOCKS_A_SALT} + 1 AS int)").alias("salts"))
        left = key(self.cells_of(asked, probes)).select("key", "id", "embedding").sortWithinPartitions("key").mapInArrow(_blocks(ASKED), _BLOCK)
        left = left.join(salts, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").toDF("key", "q_ids", "q_rows", "salt")
        right = right.join(salts, "key").withColumn("salt", F.pmod(F.xxhash64("ids"), F.col("salts")).cast("int")).drop("salts")
        pairs = left.join(right, ["key", "salt"]).select("q_ids", "q_rows", "ids", "rows")
        found = pairs.mapInArrow(_best(k, self.width), "query_id long, vec_id long, d double")
        best = Window.partitionBy("query_id").orderBy("d", "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "d")


_BLOCK = "key string, ids binary, rows binary"


def _blocks(size: int):  # noqa: ANN202
    """Rows (key, id, embedding) as blocks of one key, the vectors of unit length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            known = batch.column("key").dictionary_encode()
            code = known.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)[order]
            rows = _matrix(batch.column("embedding"), len(batch.column("embedding")[0]))[order]
            edge = np.flatnonzero(np.diff(code[order], prepend=-1))
            out: list[tuple] = []
            for lo, hi in zip(edge, [*edge[1:], len(code)], strict=True):
                out += [(known.dictionary[int(code[order[lo]])].as_py(), ids[at : min(at + size, hi)].tobytes(), rows[at : min(at + size, hi)].tobytes()) for at in range(lo, hi, size)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.string(), pa.binary(), pa.binary()), strict=True)], ["key", "ids", "rows"])

    return work


def _best(k: int, width: int):  # noqa: ANN202
    """The best k of each pair of blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_rows, ids, rows in zip(*(batch.column(c) for c in ("q_ids", "q_rows", "ids", "rows")), strict=True):
                asked, of = np.frombuffer(q_ids.as_py(), np.int64), np.frombuffer(ids.as_py(), np.int64)
                far = np.round(1 - np.frombuffer(q_rows.as_py()).reshape(-1, width) @ np.frombuffer(rows.as_py()).reshape(-1, width).T, 6) + 0.0
                far[asked[:, None] == of] = np.inf
                if len(of) > k:  # all rows as near as the k-th, as ids decide among equals
                    last = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
                    q, r = np.nonzero((far <= last) & np.isfinite(far))
                else:
                    q, r = np.nonzero(np.isfinite(far))
                yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(of[r]), pa.array(far[q, r])], ["query_id", "vec_id", "d"])

    return work


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact neighbours that were found; a row at the same distance as an exact one counts as it."""
    last = exact.groupBy("query_id").agg(F.max("d").alias("last"), F.count(F.lit(1)).alias("n"))
    good = last.join(found, "query_id", "left").groupBy("query_id", "n").agg(F.count_if(F.col("d") <= F.col("last")).alias("hit"))
    return good.agg(F.round(F.sum(F.least("hit", "n")) / F.sum("n"), 6).alias("recall"), F.sum("n").alias("asked"))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors under the prefix that retrievals carry: general lessons and named ones."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("label") < 5, "general").otherwise("named").alias("kind"))


def _index(spark: SparkSession, sf_dir: str, cells: int | None = None) -> CellIndex:
    return CellIndex.build(_kinds(spark, sf_dir), work_folder(spark, "vector-index"), ["kind"], cells)


@query("v11_vector_index")
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest rows of the same kind for each vector whose id fifty divides, by the index, with the recall against the exact way."""
    index = _index(spark, sf_dir)
    asked = _kinds(spark, sf_dir).filter("id % 50 = 0")
    probes = index.probes_for(0.95, 20)
    found = index.search(asked, 20, probes).withColumns({"probes": F.lit(probes), "cells": F.lit(len(index.centres))})
    return found.crossJoin(F.broadcast(recall(found, index.search(asked, 20)).select("recall")))  # one row


_KIND = "CASE WHEN label < 5 THEN 'general' ELSE 'named' END"
_EXACT_D = "round(1 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))), 6)"


@query("v11_exact_search", f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, d FROM (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank
FROM (SELECT q.vec_id AS query_id, e.vec_id, {_EXACT_D} AS d FROM (SELECT *, {_KIND} AS kind FROM embeddings WHERE vec_id % 50 = 0) q JOIN (SELECT *, {_KIND} AS kind FROM embeddings) e ON q.kind = e.kind AND q.vec_id <> e.vec_id)) WHERE rank <= 20""")
def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through all cells of the index: exact."""
    return _index(spark, sf_dir).search(_kinds(spark, sf_dir).filter("id % 50 = 0"), 20)


@query("v11_prefixed_probe", f"SELECT e.vec_id, {_EXACT_D} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_KIND.replace('label', 'e.label')} = 'named' ORDER BY d, e.vec_id LIMIT 20")
def prefixed_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector against the named kind only: the other kind's folders are never opened."""
    vector = table(spark, sf_dir, "embeddings").filter("vec_id = 0").first().embedding
    return _index(spark, sf_dir).probe(vector, 20, kind="named")
