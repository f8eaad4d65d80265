"""K-means by kd-tree filtering, exact in integers.

Vectors become integers once and are laid into kd-trees where they are: each task makes trees of up to ``TREE_ROWS``
vectors of its own partition and writes them to the shared folder.  A node has its number of vectors, the sums of
their components and its bounding box.  A round goes down all trees with the centroids (k rows, bounded by a
parameter): a centroid that is farther than another one from every point of a box, strictly, is pruned; a node with
one centroid left is assigned whole, by its count and sums; the vectors of a leaf are resolved one by one.  Each task
sends k rows of sums, so a round shuffles k rows a task and the driver gets k.

Cases: a vector of another size, or with a null or non-finite component, is left out; a null ``vec_id`` is kept but
chosen as a start last; of start candidates with the same hash the lesser vector comes first; with fewer vectors than
centroids there are as many centroids as vectors, and with none no rows; an empty centroid stays where it is and has
no rows; equal vectors make a box without extent, and go whole or leaf by leaf; components beyond 2**16 in size count
as that much, so that every squared distance fits a long; an inertia that doesn't fit a long is null; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfold.llm.storage import spent, stored

TREE_ROWS, LEAF_ROWS = 4096, 24
SCALE, LIMIT = 1024, 1 << 26
TREE = "vec_id array<long>, points binary, spans binary, sums binary, low binary, high binary"


def quantised(vector: str, dims: int) -> Column:
    """floor(1024 * x) of each component, null where the vector isn't ``dims`` finite numbers."""
    good = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    return F.when(good, F.transform(vector, whole))


class Tree:
    """Vectors in the order of the leaves, and nodes from the root on: span of vectors, left child (the right one is next), sums, box."""

    def __init__(self, points: np.ndarray, spans: np.ndarray, sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.points, self.spans, self.sums, self.low, self.high = points, spans, sums, low, high

    @classmethod
    def grown(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of the rows of ``points``, and their order in it: halves by the widest side of the box."""
        order = np.arange(len(points))
        spans, sums, low, high = [[0, len(points), 0]], [], [], []
        at = 0
        while at < len(spans):
            lo, hi, _ = spans[at]
            own = points[order[lo:hi]]
            low.append(own.min(0))
            high.append(own.max(0))
            sums.append(own.sum(0, dtype=np.int64))
            wide = high[-1].astype(np.int64) - low[-1]
            side = int(wide.argmax())
            if hi - lo > LEAF_ROWS and wide[side] > 0:
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, side], mid)]
                spans[at][2] = len(spans)
                spans += [[lo, lo + mid, 0], [lo + mid, hi, 0]]
            at += 1
        return cls(points[order], np.array(spans, np.int32), np.array(sums), np.array(low, np.int32), np.array(high, np.int32)), order

    def buffers(self) -> list[bytes]:
        return [x.tobytes() for x in (self.points, self.spans, self.sums, self.low, self.high)]

    @classmethod
    def read(cls, dims: int, points: bytes, spans: bytes, sums: bytes, low: bytes, high: bytes) -> Tree:
        of = lambda raw, kind, width: np.frombuffer(raw, kind).reshape(-1, width)
        return cls(of(points, np.int32, dims), of(spans, np.int32, 3), of(sums, np.int64, dims), of(low, np.int32, dims), of(high, np.int32, dims))

    def filter(self, centres: np.ndarray) -> tuple[list[tuple[np.ndarray, int]], np.ndarray, np.ndarray]:
        """Nodes that go whole to one centroid, as (nodes, centroid), and the vectors left over with the centroids each may have.

        ``p -> |p - z|^2 - |p - y|^2`` is linear in p, so its least value over a box is at a corner: where that is
        positive, z is farther than y from all of the box.
        """
        k = len(centres)
        square = (centres * centres).sum(1)
        nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
        whole: list[tuple[np.ndarray, int]] = []
        rest, masks = [np.zeros(0, np.int64)], [np.zeros((0, k), bool)]
        while len(nodes):
            low, high = self.low[nodes].astype(np.int64), self.high[nodes].astype(np.int64)
            mid = low + high
            far = np.stack([((mid - 2 * c) ** 2).sum(1) for c in centres], 1)
            near = np.where(alive, far, np.iinfo(np.int64).max).argmin(1)
            for z in range(k):
                step = centres[z] - centres[near]
                least = square[z] - square[near] - 2 * np.where(step > 0, high * step, low * step).sum(1)
                alive[:, z] &= ~(least > 0)
            single = alive.sum(1) == 1
            owner = alive.argmax(1)
            whole += [(nodes[single & (owner == z)], z) for z in range(k)]
            nodes, alive = nodes[~single], alive[~single]
            child = self.spans[nodes, 2]
            leaf = child == 0
            for node, mask in zip(nodes[leaf], alive[leaf], strict=True):
                lo, hi, _ = self.spans[node]
                rest.append(np.arange(lo, hi))
                masks.append(np.broadcast_to(mask, (hi - lo, k)))
            nodes, alive = np.concatenate((child[~leaf], child[~leaf] + 1)).astype(np.int64), np.concatenate((alive[~leaf], alive[~leaf]))
        return whole, np.concatenate(rest), np.concatenate(masks)

    def resolved(self, rows: np.ndarray, masks: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of the centroids that each of the rows may have, the least number of equals, and its squared distance."""
        own = self.points[rows].astype(np.int64)
        far = np.stack([np.where(masks[:, z], ((own - c) ** 2).sum(1), np.iinfo(np.int64).max) for z, c in enumerate(centres)], 1)
        best = far.argmin(1)
        return best, far[np.arange(len(rows)), best]

    def totals(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many vectors each centroid has, and the sums of their components."""
        n, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        whole, rows, masks = self.filter(centres)
        for nodes, z in whole:
            n[z] += (self.spans[nodes, 1] - self.spans[nodes, 0]).sum()
            sums[z] += self.sums[nodes].sum(0)
        best, _ = self.resolved(rows, masks, centres)
        for z in range(len(centres)):
            mine = rows[best == z]
            n[z] += len(mine)
            sums[z] += self.points[mine].sum(0, dtype=np.int64)
        return n, sums

    def labels(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of each vector."""
        label, far = np.empty(len(self.points), np.int32), np.empty(len(self.points), np.int64)
        whole, rows, masks = self.filter(centres)
        for nodes, z in whole:
            for lo, hi, _ in self.spans[nodes]:
                label[lo:hi] = z
                far[lo:hi] = ((self.points[lo:hi].astype(np.int64) - centres[z]) ** 2).sum(1)
        label[rows], far[rows] = self.resolved(rows, masks, centres)
        return label, far


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.RecordBatch] = []

    def grown(rows: pa.Table) -> pa.RecordBatch:
        vectors = rows.column("v").combine_chunks()
        points = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(vectors), -1)
        tree, order = Tree.grown(points)
        ids = rows.column("vec_id").combine_chunks().take(pa.array(order))
        return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), *[pa.array([b], pa.binary()) for b in tree.buffers()]], ["vec_id", "points", "spans", "sums", "low", "high"])

    for batch in batches:
        while batch.num_rows:
            room = TREE_ROWS - sum(b.num_rows for b in waiting)
            waiting.append(batch.slice(0, room))
            batch = batch.slice(room)  # noqa: PLW2901
            if sum(b.num_rows for b in waiting) == TREE_ROWS:
                yield grown(pa.Table.from_batches(waiting))
                waiting = []
    if waiting:
        yield grown(pa.Table.from_batches(waiting))


def _forest(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array | None, Tree]]:
    for batch in batches:
        ids = batch.column("vec_id") if "vec_id" in batch.schema.names else None
        for k in range(batch.num_rows):
            yield None if ids is None else ids[k].values, Tree.read(dims, *(batch.column(c)[k].as_py() for c in ("points", "spans", "sums", "low", "high")))


def _round(trees: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    shared = trees.sparkSession.sparkContext.broadcast(centres)  # k vectors

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        n, sums = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64)
        for _, tree in _forest(batches, now.shape[1]):
            more, add = tree.totals(now)
            n, sums = n + more, sums + add
        yield pa.RecordBatch.from_arrays([pa.array(range(len(now)), pa.int32()), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = trees.drop("vec_id").mapInArrow(work, "cluster int, n long, sums array<long>")
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(centres.shape[1])]).collect()  # k rows
    out = centres.copy()
    for row in found:
        if row.n:
            out[row.cluster] = [row[f"s{i}"] // row.n for i in range(centres.shape[1])]
    return out


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> DataFrame:
    """A row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding", dims).alias("v")).filter("v IS NOT NULL")
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(start.asc_nulls_last(), "v").limit(k).collect()
    with spent(spark) as tables:
        trees = stored(rows.mapInArrow(_trees, TREE), "kd-trees")
        centres = np.array([r.v for r in first], np.int64).reshape(-1, dims)
        for _ in range(rounds if len(centres) else 0):
            centres = _round(trees, centres)
        shared = spark.sparkContext.broadcast(centres)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, tree in _forest(batches, dims):
                label, far = tree.labels(shared.value)
                yield pa.RecordBatch.from_arrays([ids, pa.array(label), pa.array(far)], ["vec_id", "cluster", "distance"])

        found = stored(trees.mapInArrow(work, "vec_id long, cluster int, distance long"), "kd-clusters")
        tables.pop()
    sums = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    fits = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    known = [(z, fits(d), fits(sum(sums.values())), digest(centres[z])) for z, d in sums.items()]
    return found.join(F.broadcast(spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Every round written out, all distances computed."""
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT n - 1 AS j, v AS c FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v) AS n FROM v) WHERE n <= {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, min(d * {k} + j) AS m FROM (SELECT r, j, CAST(list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS d FROM v, c{t}) GROUP BY r)")
        if t < rounds:
            parts.append(
                f"c{t + 1} AS MATERIALIZED (SELECT j, coalesce(any_value(n.c), any_value(o.c)) AS c FROM c{t} o LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM "
                f"(SELECT m % {k} AS j, i, sum(x) AS s, count(*) AS n FROM (SELECT m, unnest(v) AS x, unnest(range(1, 65)) AS i FROM v JOIN a{t} USING (r)) GROUP BY 1, 2) GROUP BY 1) n USING (j) GROUP BY j)"
            )
    parts.append(f"o AS (SELECT vec_id, m % {k} AS j, m // {k} AS d FROM v JOIN a{rounds} USING (r))")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(j AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM o JOIN c{rounds} USING (j)"""
