"""Kd-tree filtering against plain k-means on Python integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from wrenfold.llm import kdclusters

SCHEMA = "vec_id long, embedding array<float>, cluster string, v string, distance string, `a.b` string"
LIMIT = 1 << 26


def brute(rows: list[tuple], k: int = 8, rounds: int = 10) -> list[tuple]:
    kept = []
    for i, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(max(-LIMIT, min(LIMIT, 1024 * float(np.float32(x))))) for x in e]))
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centres = [v for _, v in starts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), z) for z, c in enumerate(centres))
    for _ in range(rounds):
        mine: dict[int, list] = {}
        for _, v in kept:
            mine.setdefault(near(v)[1], []).append(v)
        for z, vs in mine.items():
            centres[z] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    total = {z: sum(d for _, d, y in out if y == z) for z in range(k)}
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((i, z, d, fits(total[z]), fits(sum(total.values())), hashlib.sha256(",".join(map(str, centres[z])).encode()).hexdigest()) for i, d, z in out), key=repr)


def got(spark, rows: list[tuple]) -> list[tuple]:  # noqa: ANN001
    return sorted(map(tuple, kdclusters.cluster(spark.createDataFrame([(*r, "q", "q", "q", "q") for r in rows], SCHEMA).repartition(3)).collect()), key=repr)


def vectors(n: int, spread: float, seed: int = 0) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, 64))
    return (middle[rng.integers(0, 5, n)] + spread * rng.normal(size=(n, 64))).astype(np.float32).tolist()


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_clusters(spark, spread):  # noqa: ANN001, ANN201
    rows = list(enumerate(vectors(300, spread)))
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):  # noqa: ANN001, ANN201
    some = vectors(40, 0.3, 1)
    rows = list(enumerate(some)) + [(k, some[0]) for k in range(100, 400)]  # a very common vector
    rows += [(7, some[7]), (7, some[8]), (None, some[3]), (500, None), (501, []), (502, some[0][:63]), (503, [*some[0][:63], None]), (504, [*some[0][:63], float("nan")]), (505, [*some[0][:63], float("-inf")]), (506, [1e30, *some[0][:63]]), (507, [-1e30, *some[0][:63]])]
    assert got(spark, rows) == brute(rows)


def test_ties_and_few(spark):  # noqa: ANN001, ANN201
    """Grid points at equal distances go to the lesser number; fewer vectors than centroids; none."""
    grid = [(k, [float(k % 3), float(k // 3 % 3), *[0.0] * 62]) for k in range(90)]
    assert got(spark, grid) == brute(grid)
    assert got(spark, grid[:3]) == brute(grid[:3])
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == []


def test_filtering_prunes():  # noqa: ANN201
    """Whole nodes are assigned where groups are apart, and every vector gets its nearest centroid in any case."""
    points = np.floor(1024 * np.array(vectors(4000, 0.01))).astype(np.int32)
    tree, order = kdclusters.Tree.grown(points)
    assert sorted(order.tolist()) == list(range(4000))
    centres = points[[int(np.flatnonzero((points == p).all(1))[0]) for p in points[:8]]].astype(np.int64)
    again = kdclusters.Tree.read(64, *tree.buffers())
    whole, rest, _ = again.filter(centres)
    assert sum(int((tree.spans[n, 1] - tree.spans[n, 0]).sum()) for n, _ in whole) + len(rest) == 4000
    assert len(rest) < 4000
    far = ((tree.points[:, None].astype(np.int64) - centres) ** 2).sum(2)
    label, distance = again.labels(centres)
    assert (label == far.argmin(1)).all()
    assert (distance == far.min(1)).all()
    n, sums = again.totals(centres)
    assert n.tolist() == np.bincount(label, minlength=8).tolist()
    assert (sums[3] == tree.points[label == 3].sum(0)).all()
