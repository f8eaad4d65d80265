"""Leases and one-time codes as streams against a replay, over restarts."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from wrenfold.operators.workflow import BACKOFF_MINUTES
from wrenfold.sources.folders import work_folder
from wrenfold.streaming import stateful

ZERO = datetime.datetime(2024, 1, 1)
LEASE = "lead long, at timestamp, seq long, action string, agent string, token long"
CODE = "email long, at timestamp, seq long, action string, code long"


def at(minute: float) -> datetime.datetime:
    return ZERO + datetime.timedelta(minutes=minute)


def run(spark, parts: list[list[tuple]], schema: str, make) -> tuple[list, dict]:  # noqa: ANN001
    """Each part lands, the stream is started from its checkpoint, drained and ended."""
    path, out, state = (work_folder(spark, n) for n in ("in", "out", "state"))
    progress: dict = {}
    for part in parts:
        rows = spark.createDataFrame(part, schema)
        rows.coalesce(1).write.mode("append").parquet(path)
        progress = stateful.drained(make(stateful.arriving(spark, path, rows)), out, state, "append" if schema == CODE else "update")
    return spark.read.parquet(out).collect(), progress


def replay_leases(events: list[tuple], seconds: int) -> dict:
    now: dict = {}
    for lead, t, seq, action, agent, token in sorted(events, key=lambda e: (e[1], e[2])):
        s = now.setdefault(lead, {"state": "pending", "owner": None, "token": None, "until": None, "n": 0, "due": ZERO})
        holds = s["owner"] == agent and s["token"] == token and s["owner"] is not None
        free = {"owner": None, "token": None, "until": None}
        if action == "claim" and s["state"] == "pending" and s["due"] <= t and (s["owner"] is None or s["until"] < t):
            s |= {"owner": agent, "token": seq, "until": t + datetime.timedelta(seconds=seconds)}
        elif action == "renew" and holds:
            s["until"] = t + datetime.timedelta(seconds=seconds)
        elif action == "complete" and holds and s["until"] > t:
            s |= free | {"state": "done"}
        elif action == "fail" and holds and s["until"] > t:
            s |= free | {"n": s["n"] + 1}
            if s["n"] >= 5:
                s["state"] = "failed"
            else:
                s["due"] = t + datetime.timedelta(minutes=BACKOFF_MINUTES[s["n"] - 1])
    return now


def lease_events() -> list[tuple]:
    rng, rows, last = random.Random(6), [], {}
    for seq in range(1, 400):
        lead, action = rng.randrange(6), rng.choice(["claim", "claim", "renew", "fail", "fail", "complete"][: 6 if seq > 250 else 5])
        rows.append((lead, at(seq * 4), seq, action, rng.choice("ab"), last.get(lead, 0) if rng.random() < 0.9 else 1))
        if action == "claim":
            last[lead] = seq
    return rows


def test_leases_survive_restarts(spark):  # noqa: ANN001, ANN201
    rows = lease_events()
    want = replay_leases(rows, 1800)
    assert {s["state"] for s in want.values()} >= {"done"}
    got, _ = run(spark, [rows[:120], rows[120:121], rows[121:300], rows[300:]], LEASE, lambda s: stateful.lease_stream(s, "1 hour", 1800))
    answers = spark.createDataFrame(got, stateful.LEASE_OUT + ", batch int").drop("batch")
    micros = lambda t: None if t is None else (t - ZERO) // datetime.timedelta(microseconds=1) + 1_704_067_200_000_000
    table = {r.lead: r for r in stateful.lease_table(answers).collect()}
    assert table.keys() == want.keys()
    for lead, s in want.items():
        r = table[lead]
        assert (r.state, r.owner, r.token, r.lease_until, r.attempts, r.next_action_at) == (s["state"], s["owner"], s["token"], micros(s["until"]), s["n"], 0 if s["due"] == ZERO else micros(s["due"]))
    assert len([r for r in got if r.seq is not None]) == len(rows), "one answer per event, none twice"
    assert {"claimed", "refused", "renewed", "lease lost", "retry"} <= {r.outcome for r in got}


def test_stale_tokens_and_lapses(spark):  # noqa: ANN001, ANN201
    """After a lease is over another claim gets a new token; the first holder's is refused; a lease that nobody claims lapses once."""
    first = [(1, at(0), 1, "claim", "a", 0), (2, at(0), 2, "claim", "a", 0), (1, at(5), 3, "claim", "b", 0)]
    later = [(1, at(200), 4, "claim", "b", 0), (1, at(201), 5, "complete", "a", 1), (1, at(202), 6, "complete", "b", 1), (1, at(203), 7, "complete", "b", 4), (3, at(400), 8, "claim", "a", 0)]
    last = [(3, at(401), 9, "renew", "a", 8), (3, at(402), 10, "claim", "b", 0)]
    got, _ = run(spark, [first, later, last], LEASE, lambda s: stateful.lease_stream(s, "10 minutes", 600))
    by = {r.seq: r.outcome for r in got if r.seq is not None}
    assert by == {1: "claimed", 2: "claimed", 3: "refused", 4: "claimed", 5: "lease lost", 6: "lease lost", 7: "done", 8: "claimed", 9: "renewed", 10: "refused"}
    assert [r.lead for r in got if r.outcome == "lapsed"].count(2) == 1


def replay_codes(events: list[tuple], ttl: int, guesses: int, limit: int, bucket: int, buckets: int) -> dict:
    state: dict = {}
    out = {}
    for who, t, seq, action, code in sorted(events, key=lambda e: (e[1], e[2])):
        s = state.setdefault(who, {"code": None, "at": None, "bad": 0, "sent": []})
        second = (t - ZERO).total_seconds()
        if action == "request":
            if sum(x > second // bucket - buckets for x in s["sent"]) >= limit:
                out[seq] = "rate limited"
            else:
                s |= {"code": seq, "at": second, "bad": 0}
                s["sent"].append(second // bucket)
                out[seq] = "sent"
        elif s["code"] is None or second >= s["at"] + 2 * ttl:
            out[seq] = "no code"
        elif second > s["at"] + ttl:
            out[seq] = "expired"
        elif s["bad"] >= guesses:
            out[seq] = "exhausted"
        elif s["code"] == code:
            out[seq] = "accepted"
            s["code"] = None
        else:
            out[seq] = "wrong"
            s["bad"] += 1
    return out


def test_codes(spark):  # noqa: ANN001, ANN201
    rng, rows, last = random.Random(9), [], {}
    for seq in range(1, 500):
        who, action = rng.randrange(4), rng.choice(["request", "verify", "verify", "verify"])
        rows.append((who, at(seq * 1.5 + (300 if seq > 250 else 0)), seq, action, last.get(who, 0) if rng.random() < 0.3 else -1))
        if action == "request":
            last[who] = seq
    limits = {"ttl": 1200, "guesses": 3, "limit": 4, "bucket": 300, "buckets": 12}
    want = replay_codes(rows, **limits)
    assert set(want.values()) == {"sent", "rate limited", "no code", "expired", "exhausted", "accepted", "wrong"}
    got, _ = run(spark, [rows[:100], rows[100:260], rows[260:]], CODE, lambda s: stateful.code_stream(s, "30 minutes", **limits))
    assert {r.seq: r.outcome for r in got} == want
    assert len(got) == len(want)


def test_finished_codes_leave_no_state(spark):  # noqa: ANN001, ANN201
    """Ten thousand keys come and go; only those of the last hours are kept."""
    wave = lambda k: [(k * 2000 + i, at(k * 600), k * 2000 + i, "request", None) for i in range(2000)]
    _, progress = run(spark, [wave(k) for k in range(4)] + [[(99999, at(9000), 99999, "request", None)], [(99998, at(9001), 99998, "request", None)]], CODE, lambda s: stateful.code_stream(s, "1 minute", ttl=600, limit=5))
    assert progress["stateOperators"][0]["numRowsTotal"] < 100


def test_landed_in_order(spark):  # noqa: ANN001, ANN201
    rows = spark.range(1000).select(F.timestamp_seconds(1000 + F.col("id") * 7 % 1000).alias("at"), "id")
    path = stateful.landed(rows, "at", 4)
    assert spark.read.parquet(path).count() == 1000
    assert len(spark.read.parquet(path).inputFiles()) == 4


def test_landed_makes_its_rows_once(spark):  # noqa: ANN001, ANN201
    """However many files there are, the rows behind them are made for one write (and its sample), not once a file."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = spark.range(200).selectExpr("id AS seq", "timestamp_seconds(id) AS at").mapInPandas(count, "seq long, at timestamp")
    path = stateful.landed(rows, "at", most=20)
    assert made.value <= 400
    assert sorted(r.seq for r in spark.read.parquet(path).collect()) == list(range(200))
