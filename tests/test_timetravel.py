"""Instants of all shapes, and the as-of join against a search of each row."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from wrenfold.operators import retrieval, timetravel

NOON = 1_705_320_000  # 2024-01-15 12:00:00


@pytest.mark.parametrize(("text", "want"), [
    ("2024-01-15", (1_705_276_800 * 10**9, 0)), ("2024-01-15 12:00:00", (NOON * 10**9, 0)), ("2024-01-15 12:00:00.25", (NOON * 10**9 + 250_000_000, 0)),
    (f"{NOON}000000000.0000000007", (NOON * 10**9, 7)), (f"{NOON}000000000", (NOON * 10**9, 0)), ("-30s", ((NOON - 30) * 10**9, 0)), ("-2m", ((NOON - 120) * 10**9, 0)), ("-1h", ((NOON - 3600) * 10**9, 0)),
    ("now()", None), ("2024-01-15' OR 1=1", None), ("2024-01-15\n", None), ("30s", None), ("-30d", None), ("", None), (None, None), ("9" * 19, None), ("2024-13-45", None),
])
def test_resolved(spark, text, want):  # noqa: ANN001, ANN201
    got = spark.createDataFrame([(text,)], "t string").select(timetravel.resolved(F.col("t"), "2024-01-15 12:00:00").alias("at")).first().at
    assert (got and tuple(got)) == want


def test_rows_as_of(spark):  # noqa: ANN001, ANN201
    """The four shapes name the same state; what is older than the floor raises, and the floor itself is served."""
    at = lambda d, h=0, m=0, s=0: datetime.datetime(2024, 1, d, h, m, s)
    rows = spark.createDataFrame([(1, "old", at(1), at(15, 11, 59, 30)), (1, "new", at(15, 11, 59, 30), None), (2, "gone", at(2), at(3))], "k int, v string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    state = lambda instant: sorted(r.v for r in retrieval.as_of_rows(rows, instant, now="2024-01-15 12:00:00").collect())
    for instant in ("2024-01-15 11:59:30", f"{NOON - 30}000000000.0000000003", f"{NOON - 30}000000999", "-30s", "9" * 19):
        assert state(instant) == ["new"], instant
    for instant in ("-31s", f"{NOON - 31}999999999.0000000001", "2024-01-15 11:59:29.999999", "2024-01-03"):
        assert state(instant) == ["old"], instant
    assert state("2024-01-02") == ["gone", "old"]
    assert state("2024-01-01") == ["old"]
    for late in ("2023-12-31", "2023-12-31 23:59:59.999999", "-9000h", "1600000000000000000.0000000001"):
        with pytest.raises(retrieval.HistoryExpired):
            retrieval.as_of_rows(rows, late, now="2024-01-15 12:00:00")
    for bad in ("now()", "2024-02-31", "-1d"):
        with pytest.raises(ValueError, match="not an instant"):
            retrieval.as_of_rows(rows, bad)


@pytest.mark.parametrize("width", [3, 50, 10**9])
def test_join(spark, width):  # noqa: ANN001, ANN201
    rng = random.Random(width)
    clock = lambda: (rng.randrange(100), rng.randrange(3))
    versions = [(rng.choice(["hot", "hot", "hot", "b", None]), clock(), n) for n in range(150)] + [("late", (99, 0), 500), ("b", None, 501)]
    asks = [(n, rng.choice(["hot", "hot", "b", "none", "late", None]), clock() if n % 9 else None) for n in range(200)]
    v = spark.createDataFrame(versions, "k string, since struct<wall: long, counter: long>, n int")
    a = spark.createDataFrame([(*x, "q") for x in asks], "id int, k string, at struct<wall: long, counter: long>, extra string")
    got = timetravel.as_of_join(a, v, ["k"], "at", "since", ["n"], ["n"], width)
    assert got.columns == ["id", "k", "at", "extra", "n"]
    want = []
    for i, k, at in asks:
        past = [(s, n) for kk, s, n in versions if kk == k and k is not None and at is not None and s is not None and s <= at]
        want.append((i, max(past)[1] if past else None))
    assert sorted((r.id, r.n) for r in got.collect()) == sorted(want)
    assert timetravel.as_of_join(a, v.limit(0), ["k"], "at", "since", ["n"], ["n"], width).filter("n IS NOT NULL").count() == 0
    assert timetravel.as_of_join(a.limit(0), v, ["k"], "at", "since", ["n"], ["n"], width).count() == 0
