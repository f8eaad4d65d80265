"""State over time: leases with fencing tokens, and one-time codes with a rolling limit, as stateful streams.

Both take events (key, at, seq, ...) and put the events of a key in the order of (at, seq) within a micro-batch; events
that come later than the watermark are dropped by it.  What they answer depends on event times only, never on when a
timer fired, so a stream gives what a replay of all events gives, also after a restart from its checkpoint.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wrenfold.functions.rows import table
from wrenfold.operators.workflow import BACKOFF_MINUTES, PARK_AFTER
from wrenfold.registry import query
from wrenfold.sources.folders import work_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which these processors need; memory holds none of it."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was) if was else spark.conf.unset(_PROVIDER)


def drained(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> dict:
    """All there is now, once: a micro-batch's rows go under its number, so a batch that is done again replaces itself.  What the last batch reported is returned."""

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with state_store(stream.sparkSession):
        running = stream.writeStream.outputMode(mode).foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return running.lastProgress or {}


def _ordered(rows: Iterator[pd.DataFrame]) -> list:
    """A key's events as tuples, what has no value last."""
    known = lambda v: (v is None or v != v, 0 if v is None or v != v else v)
    return sorted((e for pdf in rows for e in pdf.itertuples(index=False)), key=lambda e: (known(e.at), known(e.seq)))


def _micros(at: pd.Timestamp) -> int:
    return at.value // 1000


LEASE_OUT = "lead long, seq long, version long, outcome string, state string, owner string, token long, lease_until long, attempts int, next_action_at long"


class Leases(StatefulProcessor):
    """A lead's state: pending, done or failed; its holder, the token of the claim that holds it, and until when.

    ``claim`` takes a lead that is pending, due and free or over its lease, and its own ``seq`` becomes the token;
    ``renew`` needs holder and token, not a live lease; ``complete`` and ``fail`` need all three.  A refused event
    changes nothing.  Each event answers with a row; a lease that runs out answers with ``lapsed`` by a timer.
    """

    def __init__(self, seconds: int = 600) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lead = handle.getValueState("lead", "version long, state string, owner string, token long, lease_until long, attempts int, next_action_at long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        version, state, owner, token, until, attempts, due, timer = self.lead.get() or (0, "pending", None, None, None, 0, 0, None)
        out = []
        for e in _ordered(rows):
            at, version = _micros(e.at), version + 1
            mine = owner is not None and owner == e.agent and token == e.token
            live = mine and until > at
            if e.action == "claim":
                if state != "pending" or due > at or (owner is not None and until >= at):
                    outcome = "refused"
                else:
                    outcome, owner, token, until = "claimed", e.agent, int(e.seq), at + self.seconds * 1_000_000
            elif e.action == "renew":
                outcome, until = ("renewed", at + self.seconds * 1_000_000) if mine else ("lease lost", until)
            elif not live:
                outcome = "lease lost"
            elif e.action == "complete":
                outcome, state, owner, token, until = "done", "done", None, None, None
            else:
                attempts += 1
                owner = token = until = None
                if attempts >= PARK_AFTER:
                    outcome, state = "parked", "failed"
                else:
                    outcome, due = "retry", at + BACKOFF_MINUTES[min(attempts, len(BACKOFF_MINUTES)) - 1] * 60_000_000
            out.append((key[0], e.seq, version, outcome, state, owner, token, until, attempts, due))
        wanted = None if until is None else -(-until // 1000)
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.lead.update((version, state, owner, token, until, attempts, due, wanted))
        yield _frame(out, LEASE_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        version, state, owner, token, until, attempts, due, timer = self.lead.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.lead.update((version, state, owner, token, until, attempts, due, None))
        yield _frame([(key[0], None, version, "lapsed", state, owner, token, until, attempts, due)], LEASE_OUT)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)  # Arrow takes the kinds from the schema; a frame per key must be cheap


def lease_stream(events: DataFrame, late: str = "1 hour", seconds: int = 600) -> DataFrame:
    """Answers to a stream of (lead, at timestamp, seq, action, agent, token)."""
    return events.withWatermark("at", late).groupBy("lead").transformWithStateInPandas(Leases(seconds), LEASE_OUT, "Update", "EventTime")


def lease_table(answers: DataFrame) -> DataFrame:
    """The last state of each lead, from all its answers."""
    last = answers.groupBy("lead").agg(F.max_by(F.struct("state", "owner", "token", "lease_until", "attempts", "next_action_at"), "version").alias("x"))
    return last.select("lead", "x.*")


CODE_OUT = "email long, seq long, outcome string"


class Codes(StatefulProcessor):
    """A key's live code, its wrong guesses, and how many codes went out in each of the last ``buckets`` buckets of ``bucket`` seconds.

    ``request`` sends a new code in place of any other, unless the rolling limit is reached; ``verify`` takes a code
    once, before it is ``ttl`` seconds old, and after fewer than ``guesses`` wrong ones.  A code that ran out is
    known as expired for another ``ttl``; then, and once nothing counts towards the limit, the state is dropped.
    """

    def __init__(self, ttl: int = 600, guesses: int = 5, limit: int = 60, bucket: int = 60, buckets: int = 60) -> None:
        self.ttl, self.guesses, self.limit, self.bucket, self.buckets = ttl * 1_000_000, guesses, limit, bucket * 1_000_000, buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.challenge = handle.getValueState("challenge", "code long, issued long, guesses int, newest long, ring array<int>, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        code, issued, guesses, newest, ring, timer = self.challenge.get() or (None, None, 0, None, None, None)
        ring = list(ring or [0] * self.buckets)
        out = []
        for e in _ordered(rows):
            at = _micros(e.at)
            place = at // self.bucket
            if newest is not None:  # what fell out of the ring since
                for k in range(newest + 1, min(place, newest + self.buckets) + 1):
                    ring[k % self.buckets] = 0
            newest = place if newest is None else max(newest, place)
            if e.action == "request":
                if sum(ring) >= self.limit:
                    outcome = "rate limited"
                else:
                    ring[place % self.buckets] += 1
                    outcome, code, issued, guesses = "sent", int(e.seq), at, 0
            elif code is None or at >= issued + 2 * self.ttl:
                outcome = "no code"
            elif at > issued + self.ttl:
                outcome = "expired"
            elif guesses >= self.guesses:
                outcome = "exhausted"
            elif code != e.code:
                outcome, guesses = "wrong", guesses + 1
            else:
                outcome, code = "accepted", None
            out.append((key[0], e.seq, outcome))
        ends = [(newest + self.buckets) * self.bucket] if any(ring) else []
        ends += [issued + 2 * self.ttl] if code is not None else []
        if timer is not None:
            self.handle.deleteTimer(timer)
        if ends:
            timer = -(-max(ends) // 1000)
            self.handle.registerTimer(timer)
            self.challenge.update((code, issued, guesses, newest, ring, timer))
        else:
            self.challenge.clear()
        yield _frame(out, CODE_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.challenge.clear()
        yield _frame([], CODE_OUT)

    def close(self) -> None:
        pass


def code_stream(events: DataFrame, late: str = "1 hour", **limits: int) -> DataFrame:
    """Answers to a stream of (email, at timestamp, seq, action, code)."""
    return events.withWatermark("at", late).groupBy("email").transformWithStateInPandas(Codes(**limits), CODE_OUT, "Append", "EventTime")


def landed(rows: DataFrame, by: str, files: int = 3, most: int = 2_000_000) -> str:
    """``rows`` in a folder of at least so many files, none with many more than ``most`` rows, written one after the other in the order of ``by`` (a timestamp): a stream takes them in that order.

    They are made and stored in that order once, by all tasks; a file then reads its own stretch of them.
    """
    spark = rows.sparkSession
    path, stored = work_folder(spark, "landed"), work_folder(spark, "sorted")
    rows.repartitionByRange(by).sortWithinPartitions(by).write.parquet(stored)
    rows, at = spark.read.schema(rows.schema).parquet(stored), F.unix_micros(by)
    files = max(files, -(-rows.count() // most))
    found = rows.agg(F.percentile_approx(at, [k / files for k in range(1, files)])).first()[0] or []
    edge = lambda us: F.timestamp_micros(F.lit(us))  # noqa: E731  compared as stored, so other stretches are skipped
    for lo, hi in zip([None, *found], [*found, None], strict=True):
        part = rows if lo is None else rows.filter(F.col(by) > edge(lo))
        (part if hi is None else part.filter(F.col(by) <= edge(hi))).coalesce(1).write.mode("append").parquet(path)
    return path


def arriving(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


_LAST_CLAIM = "max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LEASE_EVENTS = f"""SELECT user_id AS lead, epoch_us(ts) AS t, event_id AS seq, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'renew' WHEN 'error' THEN 'fail' ELSE 'complete' END AS action, 'agent' || CAST(user_id % 2 AS VARCHAR) AS agent,
coalesce({_LAST_CLAIM}, 0) - CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS token, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"""


def lease_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what agents do to leads; each shows the token of the last claim it heard of, some a stale one."""
    e = table(spark, sf_dir, "events")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    heard = F.coalesce(F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(before), F.lit(0)) - F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    action = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "click", "renew").when(F.col("event_type") == "error", "fail").otherwise("complete")
    return e.select(F.col("user_id").alias("lead"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("agent"), (F.col("user_id") % 2).cast("string")).alias("agent"), heard.alias("token"))


#: A lease of the query below: two days, as an event of a user comes every few hours.
LEASE_SECONDS = 172_800


@query("q16_lease_stream", f"""WITH RECURSIVE e AS MATERIALIZED ({_LEASE_EVENTS}),
r AS (SELECT lead, CAST(0 AS BIGINT) AS n, 'pending' AS state, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS BIGINT) AS token, CAST(NULL AS BIGINT) AS until, 0 AS attempts, CAST(0 AS BIGINT) AS due FROM e GROUP BY lead UNION ALL
SELECT lead, n, CASE move WHEN 'done' THEN 'done' WHEN 'parked' THEN 'failed' ELSE state END, CASE WHEN move IN ('done', 'parked', 'retry') THEN NULL WHEN move = 'claimed' THEN agent ELSE owner END,
CASE WHEN move IN ('done', 'parked', 'retry') THEN NULL WHEN move = 'claimed' THEN seq ELSE token END, CASE WHEN move IN ('done', 'parked', 'retry') THEN NULL WHEN move IN ('claimed', 'renewed') THEN t + {LEASE_SECONDS}000000 ELSE until END,
CASE WHEN move IN ('parked', 'retry') THEN attempts + 1 ELSE attempts END, CASE WHEN move = 'retry' THEN t + ([1, 5, 30, 120, 720])[attempts + 1] * CAST(60000000 AS BIGINT) ELSE due END
FROM (SELECT r.lead, e.n, r.state, r.owner, r.token, r.until, r.attempts, r.due, e.agent, e.seq, e.t,
CASE WHEN action = 'claim' THEN CASE WHEN r.state <> 'pending' OR r.due > e.t OR (r.owner IS NOT NULL AND r.until >= e.t) THEN 'no' ELSE 'claimed' END WHEN r.owner IS NULL OR r.owner <> e.agent OR r.token <> e.token THEN 'no' WHEN action = 'renew' THEN 'renewed'
WHEN r.until <= e.t THEN 'no' WHEN action = 'complete' THEN 'done' WHEN r.attempts >= 4 THEN 'parked' ELSE 'retry' END AS move FROM r JOIN e ON e.lead = r.lead AND e.n = r.n + 1))
SELECT lead, state, owner, token, until AS lease_until, attempts, due AS next_action_at FROM (SELECT *, row_number() OVER (PARTITION BY lead ORDER BY n DESC) AS back FROM r) WHERE back = 1""")
def leases_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where all leads stand after their events went through the stream, in the order of time."""
    rows = lease_events(spark, sf_dir)
    path, out = landed(rows, "at"), work_folder(spark, "leases")
    drained(lease_stream(arriving(spark, path, rows), "40 days", LEASE_SECONDS), out, work_folder(spark, "leases-state"))
    return lease_table(spark.read.schema(LEASE_OUT).parquet(out))


_ASKED = "max(CASE WHEN event_type IN ('view', 'signup') THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
#: Codes of the query below live for two days, and three may go out within a day of 24 hours.
LIMITS = {"ttl": 172_800, "guesses": 2, "limit": 3, "bucket": 3600, "buckets": 24}


@query("d09_code_stream", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS email, epoch_us(ts) AS t, event_id AS seq, event_type IN ('view', 'signup') AS asks, coalesce({_ASKED}, 0) - CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS shown, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT email, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS code, CAST(NULL AS BIGINT) AS issued, 0 AS guesses, CAST([] AS BIGINT[]) AS sent, '' AS outcome FROM e GROUP BY email UNION ALL
SELECT email, n, seq, CASE outcome WHEN 'sent' THEN seq WHEN 'accepted' THEN NULL ELSE code END, CASE outcome WHEN 'sent' THEN t ELSE issued END, CASE outcome WHEN 'sent' THEN 0 WHEN 'wrong' THEN guesses + 1 ELSE guesses END,
CASE outcome WHEN 'sent' THEN list_append(recent, t // 3600000000) ELSE recent END, outcome FROM (SELECT *, CASE WHEN asks THEN CASE WHEN len(recent) >= 3 THEN 'rate limited' ELSE 'sent' END WHEN code IS NULL OR t >= issued + 345600000000 THEN 'no code'
WHEN t > issued + 172800000000 THEN 'expired' WHEN guesses >= 2 THEN 'exhausted' WHEN code <> shown THEN 'wrong' ELSE 'accepted' END AS outcome
FROM (SELECT r.email, e.n, e.seq, r.code, r.issued, r.guesses, e.t, e.asks, e.shown, list_filter(r.sent, lambda x: x > e.t // 3600000000 - 24) AS recent FROM r JOIN e ON e.email = r.email AND e.n = r.n + 1)))
SELECT email, seq, outcome FROM r WHERE n > 0""")
def codes_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request for a code, and each try of one, was answered."""
    e = table(spark, sf_dir, "events")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    asks = F.col("event_type").isin("view", "signup")
    shown = F.coalesce(F.max(F.when(asks, F.col("event_id"))).over(before), F.lit(0)) - F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    rows = e.select(F.col("user_id").alias("email"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.when(asks, "request").otherwise("verify").alias("action"), shown.alias("code"))
    path, out = landed(rows, "at"), work_folder(spark, "codes")
    drained(code_stream(arriving(spark, path, rows), "40 days", **LIMITS), out, work_folder(spark, "codes-state"), "append")
    return spark.read.schema(CODE_OUT).parquet(out).select("email", "seq", "outcome")
