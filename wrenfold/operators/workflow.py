"""Queues, outbox, conversations, budgets (Q), change events (E), and domain transforms (D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenfold.functions.rows import as_of, count_if, prop, table
from wrenfold.registry import query

# Minutes to wait after the first, second, ... failed attempt; parked after the last.
BACKOFF_MINUTES = (1, 5, 30, 120, 720)
PARK_AFTER = 5

_LEADS = """SELECT event_id AS id, ts AS next_action_at, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'done' END AS state, CASE WHEN user_id % 3 = 0 THEN 'worker' || CAST(user_id % 5 AS VARCHAR) END AS owner,
CASE WHEN user_id % 3 = 0 THEN md5(CAST(event_id AS VARCHAR)) END AS token, CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL 600 SECOND END AS lease_until, CAST(event_id % 7 AS INTEGER) AS attempts FROM events"""


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type").isin("view", "click"), "pending").when(F.col("event_type") == "error", "failed").otherwise("done")
    held = F.col("user_id") % 3 == 0
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("next_action_at"), state.alias("state"), F.when(held, F.concat(F.lit("worker"), (F.col("user_id") % 5).cast("string"))).alias("owner"),
        F.when(held, F.md5(F.col("event_id").cast("string"))).alias("token"), F.when(held, F.col("ts") + F.expr("INTERVAL 600 SECOND")).alias("lease_until"), (F.col("event_id") % 7).cast("int").alias("attempts"),
    )


def claimable(rows: DataFrame, now: Column, batch: int) -> DataFrame:
    """Due and pending leads that nobody holds, or whose lease ran out, oldest first."""
    free = F.col("owner").isNull() | (F.col("lease_until") < now)
    return rows.filter((F.col("state") == "pending") & (F.col("next_action_at") <= now) & free).orderBy("next_action_at", "id").limit(batch)


_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _now() -> Column:
    return F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")


@query("q01_claim_batch", f"SELECT id, 'agent-1' AS owner, md5('agent-1:' || CAST(id AS VARCHAR)) AS token FROM ({_LEADS}) WHERE state = 'pending' AND next_action_at <= {_NOW} AND (owner IS NULL OR lease_until < {_NOW}) ORDER BY next_action_at, id LIMIT 25")
def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claimable(leads(spark, sf_dir), _now(), 25).select("id", F.lit("agent-1").alias("owner"), F.md5(F.concat(F.lit("agent-1:"), F.col("id").cast("string"))).alias("token"))


@query("q02_fenced_finish", f"SELECT id, CASE WHEN owner IS NULL THEN 'not held' WHEN token <> CASE WHEN id % 4 = 0 THEN 'forged' ELSE token END THEN 'stale token' WHEN lease_until <= {_NOW} THEN 'lease over' ELSE 'finished' END AS outcome FROM ({_LEADS})")
def fenced_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("id") % 4 == 0, "forged").otherwise(F.col("token"))
    return leads(spark, sf_dir).select("id", finish(shown, _now()).alias("outcome"))


def finish(shown_token: Column, now: Column) -> Column:
    """Only the holder of an unexpired lease with its own token may finish."""
    return F.when(F.col("owner").isNull(), "not held").when(F.col("token") != shown_token, "stale token").when(F.col("lease_until") <= now, "lease over").otherwise("finished")


@query("q03_renew_release", f"SELECT id, CASE WHEN owner = 'worker1' THEN {_NOW} + INTERVAL 600 SECOND WHEN owner = 'worker2' THEN NULL ELSE lease_until END AS lease_until, CASE WHEN owner = 'worker2' THEN NULL ELSE owner END AS owner FROM ({_LEADS}) WHERE owner IS NOT NULL")
def renew_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    renewed, released = F.col("owner") == "worker1", F.col("owner") == "worker2"
    return leads(spark, sf_dir).filter("owner IS NOT NULL").select("id", F.when(renewed, _now() + F.expr("INTERVAL 600 SECOND")).when(~released, F.col("lease_until")).alias("lease_until"), F.when(~released, F.col("owner")).alias("owner"))


@query("q04_backoff", f"SELECT id, CASE WHEN attempts >= 5 THEN 'parked' ELSE 'pending' END AS state, CASE WHEN attempts < 5 THEN next_action_at + to_minutes(([1, 5, 30, 120, 720])[least(attempts, 4) + 1]) END AS retry_at FROM ({_LEADS}) WHERE state = 'failed'")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    wait = F.element_at(F.array(*map(F.lit, BACKOFF_MINUTES)), F.least("attempts", F.lit(len(BACKOFF_MINUTES) - 1)) + 1)
    parked = F.col("attempts") >= PARK_AFTER
    return leads(spark, sf_dir).filter("state = 'failed'").select("id", F.when(parked, "parked").otherwise("pending").alias("state"), F.when(~parked, F.col("next_action_at") + F.make_dt_interval(mins=wait)).alias("retry_at"))


@query("q05_follow_on", "SELECT min(event_id) AS parent_id, md5(event_type || ':' || CAST(user_id AS VARCHAR)) AS target_hash, 1 AS depth FROM events WHERE event_type = 'signup' GROUP BY event_type, user_id")
def follow_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.md5(F.concat_ws(":", "event_type", F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").filter("event_type = 'signup'").groupBy(target.alias("target_hash")).agg(F.min("event_id").alias("parent_id")).withColumn("depth", F.lit(1))


@query("q06_requeue", f"SELECT id, CASE WHEN state = 'failed' THEN 'pending' ELSE state END AS state, CASE WHEN state IN ('failed', 'pending') THEN {_NOW} ELSE next_action_at END AS next_action_at, CASE WHEN state = 'failed' THEN 0 ELSE attempts END AS attempts FROM ({_LEADS})")
def requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("state") == "failed"
    return leads(spark, sf_dir).select("id", F.when(failed, "pending").otherwise(F.col("state")).alias("state"), F.when(F.col("state").isin("failed", "pending"), _now()).otherwise(F.col("next_action_at")).alias("next_action_at"), F.when(failed, 0).otherwise(F.col("attempts")).alias("attempts"))


@query("q07_run_log", "SELECT event_id AS run_id, user_id % 5 AS agent, user_id AS lead, row_number() OVER w AS attempt, CASE WHEN event_type = 'error' THEN 'refused' ELSE 'done' END AS outcome, CAST(count(*) FILTER (WHERE event_type = 'error') OVER w AS BIGINT) AS refusals, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS DECIMAL(12,6)) * 0.000125 AS cost FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per attempt: its number, outcome, the refusals so far and its cost."""
    refused, w = F.col("event_type") == "error", Window.partitionBy("user_id").orderBy("ts", "event_id")
    sofar = count_if(refused).over(w.rowsBetween(Window.unboundedPreceding, 0))
    cost = prop().cast("decimal(12,6)") * F.lit("0.000125").cast("decimal(7,6)")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), (F.col("user_id") % 5).alias("agent"), F.col("user_id").alias("lead"), F.row_number().over(w).cast("long").alias("attempt"), F.when(refused, "refused").otherwise("done").alias("outcome"), sofar.alias("refusals"), cost.alias("cost"))


@query("q08_outbox_once", "SELECT message_id, min(event_id) AS first_attempt FROM (SELECT event_id, event_id // 4 AS message_id FROM events WHERE event_type NOT IN ('error', 'purchase')) WHERE message_id NOT IN (SELECT event_id // 4 FROM events WHERE event_type = 'purchase') GROUP BY 1")
def outbox_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to send: the first attempt of each, none that went already; a refusal is no attempt."""
    e = table(spark, sf_dir, "events")
    message = F.expr("event_id div 4").alias("message_id")
    due = e.filter("event_type NOT IN ('error', 'purchase')").groupBy(message).agg(F.min("event_id").alias("first_attempt"))
    return due.join(e.filter("event_type = 'purchase'").select(message), "message_id", "left_anti")


# Allowed moves of a conversation.
MOVES = (("system", "user"), ("user", "assistant"), ("assistant", "user"))


@query("q09_bad_transitions", "SELECT conv_id, turn, prev, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS NOT NULL AND (prev, role) NOT IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))")
def bad_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("prev"), "role")
    return rows.filter(F.col("prev").isNotNull() & ~F.concat_ws(">", "prev", "role").isin(*[">".join(m) for m in MOVES]))


@query("q10_idempotency_key", "SELECT conv_id, turn, sha256(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || text) AS key FROM conversations")
def idempotency_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "text"), 256).alias("key"))


@query("q11_attribution", """SELECT c.conv_id, c.turn, CASE WHEN c.conv_id % 10 = 0 THEN 'token' WHEN m.o_orderkey IS NOT NULL THEN 'message-id' WHEN s.c_custkey IS NOT NULL THEN 'sender' ELSE 'unmatched' END AS rung FROM conversations c
LEFT JOIN orders m ON m.o_orderkey = c.conv_id * 4 + c.turn AND m.o_orderstatus = 'F' LEFT JOIN customer s ON s.c_custkey = c.conv_id AND s.c_acctbal > 5000""")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("mid"))
    s = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("sid"))
    rows = table(spark, sf_dir, "conversations").join(m, F.col("mid") == F.col("conv_id") * 4 + F.col("turn"), "left").join(s, F.col("sid") == F.col("conv_id"), "left")
    return rows.select("conv_id", "turn", F.when(F.col("conv_id") % 10 == 0, "token").when(F.col("mid").isNotNull(), "message-id").when(F.col("sid").isNotNull(), "sender").otherwise("unmatched").alias("rung"))


@query("q12_spend_gate", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'unpriced' WHEN spent > least(2000, 500 + 100 * (user_id % 7)) THEN 'refused' ELSE 'allowed' END AS verdict FROM
(SELECT *, sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events)""")
def spend_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower of two ceilings, against the running sum; what has no price is refused."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "events").withColumn("spent", F.sum(F.col("value").cast("decimal(18,6)")).over(w))
    ceiling = F.least(F.lit(2000), 500 + 100 * (F.col("user_id") % 7))
    return rows.select("event_id", F.when(F.col("event_type") == "error", "unpriced").when(F.col("spent") > ceiling, "refused").otherwise("allowed").alias("verdict"))


@query("q13_autonomy", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'human' WHEN o_orderpriority LIKE '5%' THEN 'auto' WHEN o_totalprice <= 100000 THEN 'auto' ELSE 'human' END AS decision FROM orders")
def autonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(p.startswith("1"), "human").when(p.startswith("5") | (F.col("o_totalprice") <= 100000), "auto").otherwise("human").alias("decision"))


@query("q14_raise_proposal", "SELECT c_custkey, round(least(total, 1000000) - c_acctbal * 50, 2) AS raise FROM customer JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE least(total, 1000000) - c_acctbal * 50 >= 1000")
def raise_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    rows = table(spark, sf_dir, "customer").join(total, F.col("o_custkey") == F.col("c_custkey")).withColumn("r", F.least("total", F.lit(1000000.0)) - F.col("c_acctbal") * 50)
    return rows.filter("r >= 1000").select("c_custkey", F.round("r", 2).alias("raise"))


@query("q15_plan_allowance", "SELECT c_custkey, n, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS allowance, n >= CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS used_up FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-01' GROUP BY 1) ON o_custkey = c_custkey")
def plan_allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    n = table(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= at("1998-01-01")) & (F.col("o_orderdate") < at("1998-07-01"))).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    allowance = F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(3)
    return table(spark, sf_dir, "customer").join(n, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "n", allowance.alias("allowance"), (F.col("n") >= allowance).alias("used_up"))


CHANGE = "tenant_id BIGINT, state STRING"
TOPICS = ("lead", "thread", "outbox")


def raw_changes(events: DataFrame) -> DataFrame:
    """Webhook rows from the events table: (topic, after, updated)."""
    topic = F.when(F.col("event_type") == "view", "lead").when(F.col("event_type") == "click", "thread").when(F.col("event_type") == "purchase", "outbox").when(F.col("event_type") == "signup", "resolved").otherwise("mystery")
    after = F.when(F.col("event_id") % 11 != 0, F.to_json(F.struct(F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("tenant_id"), F.when(F.col("value") > 50, "terminal").otherwise("pending").alias("state"))))
    return events.select("event_id", topic.alias("topic"), after.alias("after"), F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(30,10)").alias("updated"))


def parsed_changes(raw: DataFrame) -> DataFrame:
    """Each row with a ``verdict``: event, none (heartbeat or delete), or why it goes to quarantine."""
    rows = raw.withColumn("a", F.from_json("after", CHANGE))
    verdict = F.when(F.col("topic") == "resolved", "none").when(~F.col("topic").isin(*TOPICS), "unknown topic").when(F.col("after").isNull(), "none").when(F.col("a.tenant_id").isNull(), "no tenant").otherwise("event")
    return rows.withColumn("verdict", verdict).withColumn("tenant_id", F.col("a.tenant_id")).withColumn("state", F.col("a.state")).drop("a")


def wakes(changes: DataFrame) -> DataFrame:
    """Which events wake whom: a terminal thread, a pending outbox row, any pending lead."""
    wake = F.when((F.col("topic") == "thread") & (F.col("state") == "terminal"), "learn").when((F.col("topic") == "outbox") & (F.col("state") == "pending"), "send").when((F.col("topic") == "lead") & (F.col("state") == "pending"), "work")
    return changes.filter("verdict = 'event'").withColumn("wake", wake).filter("wake IS NOT NULL")


_CH = """SELECT *, CASE WHEN topic = 'resolved' THEN 'none' WHEN topic = 'mystery' THEN 'unknown topic' WHEN event_id % 11 = 0 THEN 'none' WHEN event_id % 13 = 0 THEN 'no tenant' ELSE 'event' END AS verdict, CASE WHEN value > 50 THEN 'terminal' ELSE 'pending' END AS state
FROM (SELECT *, CASE event_type WHEN 'view' THEN 'lead' WHEN 'click' THEN 'thread' WHEN 'purchase' THEN 'outbox' WHEN 'signup' THEN 'resolved' ELSE 'mystery' END AS topic FROM events)"""
_WAKE = "CASE WHEN topic = 'thread' AND state = 'terminal' THEN 'learn' WHEN topic = 'outbox' AND state = 'pending' THEN 'send' WHEN topic = 'lead' AND state = 'pending' THEN 'work' END"


@query("e01_change_events", f"SELECT event_id, topic, verdict, CASE WHEN verdict = 'event' THEN user_id END AS tenant_id FROM ({_CH})")
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_changes(raw_changes(table(spark, sf_dir, "events"))).select("event_id", "topic", "verdict", F.when(F.col("verdict") == "event", F.col("tenant_id")).alias("tenant_id"))


@query("e02_wakes", f"SELECT event_id, user_id AS tenant_id, {_WAKE} AS wake FROM ({_CH}) WHERE verdict = 'event' AND {_WAKE} IS NOT NULL")
def wake_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wakes(parsed_changes(raw_changes(table(spark, sf_dir, "events")))).select("event_id", "tenant_id", "wake")


@query("e03_wake_latency", f"SELECT event_id, CAST(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) AS BIGINT) // 1000 AS latency_ms FROM ({_CH}) WHERE verdict = 'event'")
def wake_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed_changes(raw_changes(table(spark, sf_dir, "events"))).filter("verdict = 'event'")
    return rows.select("event_id", F.floor((F.unix_micros(as_of().cast("timestamp")) - F.col("updated").cast("long")) / 1000).alias("latency_ms"))


@query("e06_listen_tokens", "SELECT e.event_id, t.event_id AS token FROM events e JOIN (SELECT event_id, user_id, ts, ts + INTERVAL 5 DAY AS expires_at FROM events WHERE event_type = 'signup' AND event_id % 9 <> 0) t ON e.user_id = t.user_id AND e.ts >= t.ts AND e.ts < t.expires_at WHERE e.event_type = 'view'")
def listen_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views under a token that was valid then; revoked tokens (every ninth) resolve nothing."""
    e = table(spark, sf_dir, "events")
    t = e.filter("event_type = 'signup' AND event_id % 9 <> 0").select(F.col("event_id").alias("token"), "user_id", F.col("ts").alias("t0"), (F.col("ts") + F.expr("INTERVAL 5 DAY")).alias("t1"))
    days = F.explode(F.sequence(F.to_date("t0"), F.to_date("t1")))  # a token is laid out on the days that it is valid
    views = e.filter("event_type = 'view'").withColumn("day", F.to_date("ts"))
    return views.join(t.withColumn("day", days), ["user_id", "day"]).filter("ts >= t0 AND ts < t1").select("event_id", "token")


@query("d03_intake_fan_out", "SELECT c_custkey AS id, unnest(['party', 'role', 'usage', 'suggestion', 'lead']) AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def intake_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), "id", "left_anti")
    return new.select("id", F.explode(F.array(*map(F.lit, ("party", "role", "usage", "suggestion", "lead")))).alias("kind"))


@query("d04_audience_prose", """WITH last AS (SELECT user_id, max(CAST(ts AS DATE)) AS day FROM events GROUP BY 1), s AS (SELECT e.user_id, day, event_type, count(*) AS n FROM events e JOIN last l ON e.user_id = l.user_id AND CAST(e.ts AS DATE) = day GROUP BY 1, 2, 3)
SELECT user_id, 'On ' || CAST(day AS VARCHAR) || ': ' || string_agg(event_type || ' ' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, event_type) AS prose FROM s GROUP BY user_id, day""")
def audience_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    day = e.withColumn("last", F.max("day").over(Window.partitionBy("user_id"))).filter("day = last").groupBy("user_id", "day", "event_type").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type")))
    said = F.array_join(F.transform("p", lambda x: F.concat(x["event_type"], F.lit(" "), (-x["m"]).cast("string"))), ", ")
    return day.groupBy("user_id", "day").agg(parts.alias("p")).select("user_id", F.concat(F.lit("On "), F.col("day").cast("string"), F.lit(": "), said).alias("prose"))


@query("d05_best_overlap", """WITH a AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 86400 AS e FROM events WHERE event_type = 'view'), b AS (SELECT event_id AS bid, user_id, epoch_us(ts) // 1000000 AS bs, epoch_us(ts) // 1000000 + 43200 AS be FROM events WHERE event_type = 'click')
SELECT event_id, bid AS best, least(e, be) - greatest(s, bs) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY least(e, be) - greatest(s, bs) DESC, bs, bid) AS rn FROM a JOIN b USING (user_id) WHERE least(e, be) > greatest(s, bs)) WHERE rn = 1""")
def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))
    a = e.filter("event_type = 'view'").select("event_id", "user_id", "s", (F.col("s") + 86400).alias("e"))
    b = e.filter("event_type = 'click'").select(F.col("event_id").alias("bid"), "user_id", F.col("s").alias("bs"), (F.col("s") + 43200).alias("be"))
    return overlapping(a, b, 86400).groupBy("event_id").agg(F.max(F.struct("overlap", (-F.col("bs")).alias("k1"), (-F.col("bid")).alias("k2"))).alias("m")).select("event_id", (-F.col("m.k2")).alias("best"), F.col("m.overlap").alias("overlap"))


def overlapping(a: DataFrame, b: DataFrame, bucket: int) -> DataFrame:
    """Pairs of one user whose intervals overlap: each interval is laid into buckets, so a hot user's rows meet only those near in time; a pair counts in its first common bucket."""
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket)))
    x, y = a.withColumn("slot", spread("s", "e")), b.withColumn("slot", spread("bs", "be"))
    both = x.join(y, ["user_id", "slot"]).withColumn("overlap", F.least("e", "be") - F.greatest("s", "bs"))
    return both.filter((F.col("overlap") > 0) & (F.col("slot") == F.floor(F.greatest("s", "bs") / bucket)))


@query("d06_window_fallback", "SELECT c_custkey, coalesce(best, 'default') AS chosen, CAST(greatest(3, least(10, coalesce(n, 4))) AS BIGINT) AS loop_length FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS best, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def window_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("best"), F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "customer").join(w, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("best", F.lit("default")).alias("chosen"), F.greatest(F.lit(3), F.least(F.lit(10), F.coalesce("n", F.lit(4)))).cast("long").alias("loop_length"))


def overridden(shots: DataFrame, edits: DataFrame, least: float = 3.0, most: float = 10.0) -> DataFrame:
    """Planned shots (song, shot, framing, prompt, seconds) with a person's edits (song, shot, framing, prompt, seconds) by position.

    An edit that names another framing was made for another plan and is dropped, as one of a position that is gone; a
    blank prompt is none; lengths are clamped.  ``verbatim``: the prompt is what the person typed.
    """
    e = edits.select("song", "shot", F.col("framing").alias("_for"), F.nullif(F.trim("prompt"), F.lit("")).alias("_prompt"), F.when(F.col("seconds").isNotNull(), F.greatest(F.lit(least), F.least(F.lit(most), F.col("seconds")))).alias("_seconds"))
    both = shots.join(e, ["song", "shot"], "left").withColumn("_meant", F.coalesce(F.col("_for") == F.col("framing"), F.lit(True)))
    kept = lambda c: F.when(F.col("_meant"), F.col(c))
    return both.select("song", "shot", "framing", F.coalesce(kept("_prompt"), "prompt").alias("prompt"), F.coalesce(kept("_seconds"), "seconds").alias("seconds"), kept("_prompt").isNotNull().alias("verbatim"))


@query("d07_shot_plan", """WITH p AS (SELECT n_nationkey AS song, CAST(i AS INTEGER) AS shot, (['wide', 'close', 'detail'])[CAST((i + n_nationkey) % 3 + 1 AS INTEGER)] AS framing FROM nation, range(0, 6) r(i) WHERE i < least(6, n_regionkey + 2)),
e AS (SELECT s_nationkey AS song, CAST(s_suppkey % 7 AS INTEGER) AS shot, max(s_suppkey) AS k FROM supplier GROUP BY 1, 2), x AS (SELECT song, shot, CASE k % 3 WHEN 0 THEN 'wide' WHEN 1 THEN NULL ELSE 'close' END AS f, CASE WHEN k % 4 <> 0 THEN 'by hand ' || CAST(k AS VARCHAR) END AS prompt, CASE WHEN k % 5 <> 0 THEN greatest(3.0::DOUBLE, least(10.0, (k % 14)::DOUBLE)) END AS seconds FROM e)
SELECT p.song, p.shot, framing, coalesce(CASE WHEN coalesce(f = framing, TRUE) THEN x.prompt END, framing || ' shot of ' || CAST(p.song AS VARCHAR)) AS prompt, coalesce(CASE WHEN coalesce(f = framing, TRUE) THEN x.seconds END, 4.0) AS seconds, coalesce(f = framing, TRUE) AND x.prompt IS NOT NULL AS verbatim FROM p LEFT JOIN x ON p.song = x.song AND p.shot = x.shot""")
def shot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections times variants, round robin, capped; with edits by position."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("song"), F.explode(F.sequence(F.lit(0), F.least(F.lit(6), F.col("n_regionkey") + 2) - 1)).alias("shot"))
    framing = F.element_at(F.array(*map(F.lit, ("wide", "close", "detail"))), F.pmod(F.col("shot") + F.col("song"), F.lit(3)) + 1)
    plan = n.withColumn("framing", framing).select("song", "shot", "framing", F.concat("framing", F.lit(" shot of "), F.col("song").cast("string")).alias("prompt"), F.lit(4.0).alias("seconds"))
    last = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("song"), (F.col("s_suppkey") % 7).cast("int").alias("shot")).agg(F.max("s_suppkey").alias("k"))
    k = F.col("k")
    edits = last.select("song", "shot", F.when(k % 3 == 0, "wide").when(k % 3 == 2, "close").alias("framing"), F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit(" by hand "), k.cast("string"))).alias("prompt"), F.when(k % 5 != 0, (k % 14).cast("double")).alias("seconds"))
    return overridden(plan, edits)


@query("d09_one_time_codes", """WITH f AS (SELECT user_id, event_id, ts, first_value(ts) OVER w AS issued, row_number() OVER w AS nth, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN used > 0 THEN 'used' WHEN nth > 5 THEN 'too many' WHEN ts > issued + INTERVAL 10 DAY THEN 'expired' ELSE 'open' END AS state FROM f""")
def one_time_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    used = F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    state = F.when(used > 0, "used").when(F.row_number().over(w) > 5, "too many").when(F.col("ts") > F.first("ts").over(w) + F.expr("INTERVAL 10 DAY"), "expired").otherwise("open")
    return table(spark, sf_dir, "events").select("event_id", state.alias("state"))


@query("d10_asset_claim", "SELECT doc_id, CASE WHEN doc_id = first_id THEN 'stored' WHEN source = first_source THEN 'already there' ELSE 'conflict' END AS claim FROM (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, arg_min(source, doc_id) OVER (PARTITION BY sha256(text)) AS first_source FROM documents)")
def asset_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min(F.struct("doc_id", "source")).alias("f"))
    return d.join(first, "h").select("doc_id", F.when(F.col("doc_id") == F.col("f.doc_id"), "stored").when(F.col("source") == F.col("f.source"), "already there").otherwise("conflict").alias("claim"))


@query("d11_poll_order", "SELECT c_custkey, last_seen FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey * 37 % 1000 END AS last_seen FROM customer) ORDER BY last_seen NULLS FIRST, c_custkey LIMIT 100")
def poll_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") * 37 % 1000)
    return table(spark, sf_dir, "customer").select("c_custkey", seen.alias("last_seen")).orderBy(F.asc_nulls_first("last_seen"), "c_custkey").limit(100)


def polled(accounts: DataFrame, messages: DataFrame, batch: int = 50) -> DataFrame:
    """One poll of mailboxes: account, delivered (uids, oldest first), cursor, state.

    ``accounts``: account, cursor ("generation:uid"), generation (the server's now); ``messages``: account, uid.  Without a
    readable cursor, or where the server has renumbered, the position is set to the newest message and nothing is
    delivered; else up to ``batch`` messages above the cursor are, and it moves to the last of them.
    """
    known = F.split_part("cursor", F.lit(":"), F.lit(1))
    uid = F.coalesce(F.regexp_extract("cursor", "^[^:]*:([0-9]+)$", 1).try_cast("long"), F.lit(0))
    a = accounts.withColumn("_uid", uid).withColumn("_set", (F.coalesce("cursor", F.lit("")) == "") | (known != F.col("generation").cast("string")))
    inbox = messages.groupBy("account").agg(F.max("uid").alias("_newest"))
    nth = F.row_number().over(Window.partitionBy("account").orderBy("uid"))
    new = messages.join(a.filter(~F.col("_set")).select("account", "_uid"), "account").filter("uid > _uid").withColumn("_nth", nth).filter(F.col("_nth") <= batch)
    got = new.groupBy("account").agg(F.array_sort(F.collect_list("uid")).alias("delivered"))  # at most ``batch``
    both = a.join(inbox, "account", "left").join(got, "account", "left")
    at = F.when(F.col("_set"), F.coalesce("_newest", F.lit(0))).otherwise(F.coalesce(F.element_at("delivered", -1), F.col("_uid")))
    moved = F.col("_set") | F.col("delivered").isNotNull()
    return both.select(
        "account", F.coalesce("delivered", F.array().cast("array<bigint>")).alias("delivered"), F.when(moved, F.concat_ws(":", F.col("generation").cast("string"), at.cast("string"))).otherwise(F.col("cursor")).alias("cursor"),
        F.when(F.col("_set"), "position set").when(F.col("delivered").isNull(), "nothing new").otherwise("delivered").alias("state"),
    )


@query("d11_mail_cursor", """WITH a AS (SELECT c_custkey AS account, c_custkey % 3 AS generation, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN '9:10' WHEN 2 THEN CAST(c_custkey % 3 AS VARCHAR) || ':x' ELSE CAST(c_custkey % 3 AS VARCHAR) || ':' || CAST(c_custkey * 10 AS VARCHAR) END AS cursor FROM customer),
s AS (SELECT *, cursor = '' OR split_part(cursor, ':', 1) <> CAST(generation AS VARCHAR) AS reset, coalesce(TRY_CAST(split_part(cursor, ':', 2) AS BIGINT), 0) AS uid FROM a),
m AS (SELECT s.account, o_orderkey, row_number() OVER (PARTITION BY s.account ORDER BY o_orderkey) AS nth FROM s JOIN orders ON o_custkey = s.account AND NOT reset AND o_orderkey > uid), g AS (SELECT account, count(*) AS n, min(o_orderkey) AS first_uid, max(o_orderkey) AS last_uid FROM m WHERE nth <= 4 GROUP BY 1),
i AS (SELECT o_custkey AS account, max(o_orderkey) AS newest FROM orders GROUP BY 1)
SELECT s.account, coalesce(n, 0) AS n, first_uid, CASE WHEN reset THEN CAST(generation AS VARCHAR) || ':' || CAST(coalesce(newest, 0) AS VARCHAR) WHEN n IS NULL THEN cursor ELSE CAST(generation AS VARCHAR) || ':' || CAST(last_uid AS VARCHAR) END AS cursor, CASE WHEN reset THEN 'position set' WHEN n IS NULL THEN 'nothing new' ELSE 'delivered' END AS state
FROM s LEFT JOIN g ON s.account = g.account LEFT JOIN i ON s.account = i.account""")
def mail_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, g = F.col("c_custkey"), (F.col("c_custkey") % 3).cast("string")
    cursor = F.when(k % 6 == 0, "").when(k % 6 == 1, "9:10").when(k % 6 == 2, F.concat(g, F.lit(":x"))).otherwise(F.concat(g, F.lit(":"), (k * 10).cast("string")))
    accounts = table(spark, sf_dir, "customer").select(k.alias("account"), cursor.alias("cursor"), (k % 3).alias("generation"))
    got = polled(accounts, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("uid")), 4)
    return got.select("account", F.size("delivered").cast("long").alias("n"), F.try_element_at("delivered", F.lit(1)).alias("first_uid"), "cursor", "state")


@query("d12_mint_once", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN md5('new' || CAST(s_suppkey AS VARCHAR)) ELSE 'old' || CAST(s_suppkey AS VARCHAR) END AS token FROM supplier")
def mint_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    old = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("old"), k))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(F.nullif(old, F.lit("")), F.md5(F.concat(F.lit("new"), k))).alias("token"))


@query("d14_discovery_terms", "SELECT DISTINCT p_type AS term, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 48 ORDER BY term, l_suppkey LIMIT 40")
def discovery_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("term")), F.col("p_partkey") == F.col("l_partkey"))
    return rows.select("term", "l_suppkey").distinct().orderBy("term", "l_suppkey").limit(40)


@query("d16_provenance_write", "SELECT s_suppkey, dimension, CASE dimension WHEN 'measured' THEN 0.9::DOUBLE WHEN 'asserted' THEN 0.5 ELSE 0.3 END AS confidence FROM supplier, (VALUES ('measured'), ('asserted'), ('inferred')) v(dimension)")
def provenance_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.create_map(F.lit("measured"), F.lit(0.9), F.lit("asserted"), F.lit(0.5), F.lit("inferred"), F.lit(0.3))).alias("dimension", "confidence")
    return table(spark, sf_dir, "supplier").select("s_suppkey", kinds)


@query("d17_recomposition", "SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END) AS urgent, max(CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderstatus END) AS high FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def recomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    o = table(spark, sf_dir, "orders").join(c.filter("c_mktsegment = 'BUILDING'"), "o_custkey", "left_semi").join(c.filter("c_acctbal < 0"), "o_custkey", "left_anti")
    return o.groupBy("o_custkey").pivot("o_orderpriority", ["1-URGENT", "2-HIGH"]).agg(F.max("o_orderstatus")).toDF("o_custkey", "urgent", "high")


@query("d19_onboarding", "SELECT (SELECT count(*) FROM customer) > 0 AS has_account, (SELECT count(*) FROM orders WHERE o_orderstatus = 'X') > 0 AS has_thread, (SELECT arg_min(p_name, (p_retailprice, p_partkey)) FROM part WHERE p_size > 40) AS upsell")
def onboarding(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "customer").agg((F.count(F.lit(1)) > 0).alias("has_account"))
    two = table(spark, sf_dir, "orders").agg((count_if(F.col("o_orderstatus") == "X") > 0).alias("has_thread"))
    three = table(spark, sf_dir, "part").filter("p_size > 40").agg(F.min_by("p_name", F.struct("p_retailprice", "p_partkey")).alias("upsell"))
    return one.crossJoin(two).crossJoin(three)  # one row each


@query("d20_thread_progress", "SELECT conv_id, CASE arg_max(role, turn) WHEN 'assistant' THEN 100 WHEN 'user' THEN 50 ELSE 0 END AS progress FROM conversations GROUP BY 1")
def thread_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by("role", "turn")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.when(last == "assistant", 100).when(last == "user", 50).otherwise(0).alias("progress"))
