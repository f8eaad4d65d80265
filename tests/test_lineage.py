"""Walks over basis graphs and lines of ancestors against plain search."""

from __future__ import annotations

import random

import pytest

from tests.conftest import DATA
from wrenfold.operators import joins
from wrenfold.operators.joins import walk_basis, walk_up


def brute(claims: list, edges: list[tuple], hops: int) -> list[tuple]:
    out = {}
    best: dict[tuple, float] = {}
    for a, b, w in edges:
        if a is not None and b is not None and a != b:
            best[a, b] = max(best.get((a, b), 0), 1.0 if w is None else w)
    for c in {c for c in claims if c is not None}:
        front = {c: 1.0}
        for hop in range(1, hops + 1):
            step: dict = {}
            for at, weight in front.items():
                for (a, b), w in best.items():
                    if a == at:
                        step[b] = max(step.get(b, 0), weight * w)
            for b, w in step.items():
                if b != c:
                    was = out.get((c, b), (hop, 0))
                    out[c, b] = (was[0], max(was[1], w))
            front = step
    return sorted((c, b, hop, pytest.approx(w)) for (c, b), (hop, w) in out.items())


def got(spark, claims: list, edges: list[tuple], hops: int) -> list[tuple]:  # noqa: ANN001
    rows = walk_basis(spark.createDataFrame([(c,) for c in claims], "claim long"), spark.createDataFrame(edges, "claim long, basis long, weight double"), hops)
    assert rows.columns == ["claim", "basis", "hop", "weight"]
    return sorted(map(tuple, rows.collect()))


DIAMOND = [(1, 2, 0.9), (1, 3, 0.5), (2, 4, 0.1), (3, 4, 0.8), (4, 5, 1.0), (1, 5, 0.01)]
CYCLE = [(1, 2, 1.0), (2, 3, 0.5), (3, 1, 1.0), (3, 4, 0.25), (4, 4, 1.0)]


@pytest.mark.parametrize(("claims", "edges", "hops"), [
    ([1], DIAMOND, 8), ([1, 2, 1, None], CYCLE, 8), ([1], CYCLE, 2), ([9], CYCLE, 8), ([], DIAMOND, 3), ([1], [], 3),
    ([1, 3], [(1, 2, None), (1, 2, 0.2), (2, None, 1.0), (None, 3, 1.0), (2, 3, 0.0)], 5),
])
def test_graphs(spark, claims, edges, hops):  # noqa: ANN001, ANN201
    assert got(spark, claims, edges, hops) == brute(claims, edges, hops)


def test_random_graph(spark):  # noqa: ANN001, ANN201
    """A longer way may be the better one; ways are limited by hops."""
    rng = random.Random(8)
    edges = [(rng.randrange(30), rng.randrange(30), rng.choice([1.0, 0.9, 0.5, 0.1])) for _ in range(90)]
    for hops in (1, 3, 6):
        assert got(spark, list(range(0, 30, 3)), edges, hops) == brute(list(range(0, 30, 3)), edges, hops)


def test_rounds_write_each_pair_once(spark, monkeypatch):  # noqa: ANN001, ANN201
    """What a walk writes grows with its pairs, not with pairs times rounds; cycles end though only some rounds look back."""
    sizes, write = [], joins._written  # noqa: SLF001
    monkeypatch.setattr(joins, "_written", lambda spark, rows: (out := write(spark, rows), sizes.append(out.count()))[0])
    line = [(k, k + 1, 0.5) for k in range(12)]
    assert got(spark, list(range(13)), line, 6) == brute(list(range(13)), line, 6)
    assert sum(sizes) == len(line) + sum(12 - hop + 1 for hop in range(1, 7))
    sizes.clear()
    monkeypatch.setattr(joins, "LOOK_BACK", 3, raising=False)
    assert got(spark, [1, 2], CYCLE, 30) == brute([1, 2], CYCLE, 30)
    assert len(sizes) <= 8


LONG = [(k, k + 1, 1.0) for k in range(20)] + [(0, 20, 0.1), (20, 21, 0.5)]


@pytest.mark.parametrize(("claims", "edges"), [([0, 5], LONG), ([0, 20], [*LONG, (21, 3, 0.9), (12, 0, 0.9)]), ([1, 2, 3, None], CYCLE), ([1], DIAMOND), ([1], [])])
def test_walk_to_the_end(spark, claims, edges):  # noqa: ANN001, ANN201
    """Nothing is cut after any number of hops, also where a long way is better than a short one, and cycles end."""
    assert got(spark, claims, edges, None) == brute(claims, edges, 60)


def test_random_graph_to_the_end(spark, monkeypatch):  # noqa: ANN001, ANN201
    rng = random.Random(9)
    edges = [(rng.randrange(40), rng.randrange(40), rng.choice([1.0, 0.9, 0.5, 0.1, None])) for _ in range(70)]
    want = brute(list(range(0, 40, 3)), edges, 60)
    assert max(hop for _, _, hop, _ in want) > 8
    for rounds in (1, 3, 8):
        monkeypatch.setattr(joins, "LOOK_BACK", rounds)
        assert got(spark, list(range(0, 40, 3)), edges, None) == want


@pytest.mark.parametrize("weight", [1.5, -0.5, float("nan")])
def test_walk_to_the_end_needs_weights(spark, weight):  # noqa: ANN001, ANN201
    with pytest.raises(Exception, match="needs weights between 0 and 1"):
        got(spark, [1], [(1, 2, 0.5), (2, 1, weight)], None)


def test_whole_basis(spark):  # noqa: ANN001, ANN201
    """Each purchase of the table with all it rests on; eight hops leave some of it out."""
    found = {(r.claim, r.basis): (r.hop, r.weight) for r in joins.whole_basis(spark, DATA).collect()}
    near = {(r.claim, r.basis) for r in joins.basis_graph(spark, DATA).collect()}
    edges = [tuple(r) for r in joins._rests(spark, DATA).collect()]  # noqa: SLF001
    far = sorted({c for c, b in found.keys() - near})[:5]
    want = brute(far, edges, 40)
    assert far
    assert max(hop for _, _, hop, _ in want) > 8
    assert near < found.keys()
    assert sorted((c, b, *v) for (c, b), v in found.items() if c in far) == want


def test_lines(spark):  # noqa: ANN001, ANN201
    edges = [(k, k // 2) for k in range(2, 200)] + [(500, 600), (600, 500)]
    parent = dict(edges)
    want = []
    for k in parent:
        at, hop = parent[k], 1
        while at is not None and hop <= 8:
            want.append((k, at, hop))
            at, hop = parent.get(at), hop + 1
    assert sorted(map(tuple, walk_up(spark.createDataFrame(edges, "id long, parent long"), 8).collect())) == sorted(want)
