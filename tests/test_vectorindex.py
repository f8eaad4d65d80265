"""The vector index: recall, the exact way, pruned folders, odd vectors."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from wrenfold.operators.vectorindex import CellIndex, recall
from wrenfold.sources.folders import work_folder

SCHEMA = "id long, embedding array<float>, kind string, state int"


def brute(rows: list[tuple], asked: list[tuple], k: int) -> list[tuple]:
    unit = lambda v: np.array(v, np.float64) / np.linalg.norm(v)
    out = []
    for q, v, kind, state in asked:
        near = sorted((round(1 - float(unit(np.float32(v)) @ unit(np.float32(w))), 6), i) for i, w, *p in rows if p == [kind, state] and i != q)
        out += [(q, n + 1, i, pytest.approx(d, abs=2e-6)) for n, (d, i) in enumerate(near[:k])]
    return sorted(out, key=lambda r: r[:2])


@pytest.fixture(scope="module")
def rows():  # noqa: ANN201
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 64))
    return [(k, (middle[k % 12] + 0.35 * rng.normal(size=64)).astype(np.float32).tolist(), "ab"[k % 5 == 0], k % 2) for k in range(1500)]


@pytest.fixture(scope="module")
def index(spark, rows):  # noqa: ANN001, ANN201
    odd = [(9001, None, "a", 0), (9002, [1.0] * 63, "a", 0), (9003, [0.0] * 64, "a", 0), (9004, [float("nan")] * 64, "a", 0), (9005, [1.0] * 64, None, 0), (None, [1.0] * 64, "a", 0), (9006, [None, *[1.0] * 63], "a", 0)]
    return CellIndex.build(spark.createDataFrame([*rows, *odd], SCHEMA), work_folder(spark, "idx"), ["kind", "state"], 12)


def got(df) -> list[tuple]:  # noqa: ANN001
    return sorted(map(tuple, df.collect()))


def test_exact(spark, rows, index):  # noqa: ANN001, ANN201
    asked = rows[::50]
    assert got(index.search(spark.createDataFrame(asked, SCHEMA), 7)) == brute(rows, asked, 7)


def test_recall_and_probes(spark, rows, index):  # noqa: ANN001, ANN201
    asked = spark.createDataFrame(rows[::10], SCHEMA)
    probes = index.probes_for(0.95, 10, 64)
    assert 1 <= probes < len(index.centres)
    told = recall(index.search(asked, 10, probes), index.search(asked, 10)).first()
    assert told.recall >= 0.9
    assert recall(index.search(asked, 10), index.search(asked, 10)).first().recall == 1
    assert recall(index.search(asked, 10, 1), index.search(asked, 10)).first().recall <= told.recall


def test_probe_prunes(spark, rows, index):  # noqa: ANN001, ANN201
    """A probe's scan is of the prefix and its cells only; all cells give the exact answer."""
    q, v = rows[0][0], rows[0][1]
    exact = got(index.probe(v, 5, kind="a", state=0))
    want = [(i, d) for _, _, i, d in brute([r for r in rows if r[0] != q], [(q, v, "a", 0)], 5)]
    assert sorted(exact) == sorted(want)
    few = index.probe(v, 5, 2, kind="a", state=0)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    assert "kind" in plan.split("PartitionFilters")[1].split("]")[0]
    opened = index.rows().filter("kind = 'a' AND state = 0").filter(F.col("cell").isin(np.argsort(-(index.centres @ np.array(v)))[:2].tolist()))
    assert len(opened.inputFiles()) > len(few.inputFiles()) - 1
    assert opened.count() < index.rows().filter("kind = 'a' AND state = 0").count() < index.rows().count()


def test_hot_cell_and_ties(spark):  # noqa: ANN001, ANN201
    """One vector many times over: all in one cell, blocks over salts, equal distances by id."""
    import wrenfold.operators.vectorindex as v

    was = v.ROWS, v.BLOCKS_A_SALT
    v.ROWS, v.BLOCKS_A_SALT = 16, 2
    try:
        rows = [(k, [1.0, *[0.0] * 63] if k < 400 else [0.0] * (k % 63) + [1.0] + [0.0] * (63 - k % 63), "a", 0) for k in range(500)]
        index = CellIndex.build(spark.createDataFrame(rows, SCHEMA), work_folder(spark, "idx"), ["kind", "state"], 4)
        assert got(index.search(spark.createDataFrame(rows[::50], SCHEMA), 9)) == brute(rows, rows[::50], 9)
    finally:
        v.ROWS, v.BLOCKS_A_SALT = was


def test_empty(spark):  # noqa: ANN001, ANN201
    none = spark.createDataFrame([], SCHEMA)
    index = CellIndex.build(none, work_folder(spark, "idx"), ["kind", "state"])
    assert index.search(none, 3).count() == 0
    assert index.probe([1.0] * 64, 3, 2, kind="a", state=0).count() == 0
    assert index.search(spark.createDataFrame([(1, [1.0] * 64, "a", 0)], SCHEMA), 3).count() == 0


def test_cells_hold_few_distances():  # noqa: ANN201
    """What a task holds grows neither with its batch nor with the number of cells."""
    rng = np.random.default_rng(4)
    centres, vectors = rng.normal(size=(1000, 8)), rng.normal(size=(10000, 8))
    index = CellIndex(SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), "", [], centres, StructType())
    work = index.cells_of(SimpleNamespace(schema=StructType().add("id", "long").add("embedding", ArrayType(DoubleType())), mapInArrow=lambda f, _: f), 3)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10000)), pa.array(list(vectors))], ["id", "embedding"])
    tracemalloc.start()
    got = [(part.column("id").to_pylist(), part.column("cell").to_pylist(), part.column("nth").to_pylist()) for part in work(iter([batch.slice(0, 200)]))]
    tracemalloc.clear_traces()
    tracemalloc.reset_peak()
    assert sum(part.num_rows for part in work(iter([batch]))) == 30000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    unit = vectors[:200] / np.linalg.norm(vectors[:200], axis=1, keepdims=True)
    assert sum((c for _, c, _ in got), []) == np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :3].ravel().tolist()
    assert sum((n for *_, n in got), []) == [1, 2, 3] * 200
