"""Many instants at once: literals of four shapes resolved to hybrid logical clocks, and an as-of join by windows.

An instant is (wall, counter): nanoseconds since 1970 and a logical counter, ordered by wall time, then counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenfold.functions.rows import AS_OF, table
from wrenfold.operators.retrieval import is_instant
from wrenfold.registry import query

DAY = 86_400 * 10**9


def nanos(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")) * 1000


def resolved(literal: Column, now: str = AS_OF) -> Column:
    """(wall, counter) of a date, a timestamp, a logical clock ``wall.counter`` or a time ago, from one ``now`` for all rows; null for anything else, and for walls beyond 64 bits."""
    part = lambda k: F.try_element_at(F.split(literal, r"\."), F.lit(k)).try_cast("long")
    clock = F.struct(part(1).alias("wall"), F.coalesce(part(2), F.lit(0)).alias("counter"))
    plain = lambda wall: F.struct(wall.alias("wall"), F.lit(0).cast("long").alias("counter"))
    unit = F.element_at(F.create_map(*[F.lit(x) for x in ("s", 1, "m", 60, "h", 3600)]), F.right(literal, F.lit(1)))
    ago = nanos(F.lit(now).cast("timestamp_ntz")) - F.regexp_extract(literal, r"\A-(\d+)", 1).try_cast("long") * unit * 10**9
    found = F.when(literal.startswith("-"), plain(ago)).when(literal.contains("-"), plain(nanos(literal.try_cast("timestamp_ntz")))).otherwise(clock)
    return F.when(is_instant(literal) & found["wall"].isNotNull(), found)


def as_of_join(asks: DataFrame, versions: DataFrame, keys: list[str], asked: str, since: str, payload: list[str], order: list[str], width: int = DAY) -> DataFrame:
    """Each of ``asks`` with the ``payload`` of the last version of its key that began at or before its own instant, nulls where there is none.

    ``asked`` and ``since`` are (wall, counter) structs; of versions that begin at once the last by ``order`` counts.
    Both sides lie in one order per key.  That order is cut into stretches of ``width`` nanoseconds: the last
    version of each stretch is carried into the later ones, a row per key and stretch, so a key with many rows is
    shared by tasks, and no pair of rows is formed.  An ask whose instant or key is null finds nothing.
    """
    columns = asks.columns
    held = versions.dropna(subset=[*keys, since]).select(*keys, F.col(since).alias("_at"), F.lit(0).alias("_side"), F.struct(*order).alias("_order"), F.struct(*payload).alias("_held"), F.lit(None).alias("_ask"))
    wanted = asks.select(*keys, F.col(asked).alias("_at"), F.lit(1).alias("_side"), F.lit(None).alias("_order"), F.lit(None).alias("_held"), F.struct(*columns).alias("_ask"))
    both = held.unionByName(wanted).withColumn("_stretch", F.expr(f"_at.wall div {width}"))
    last = both.groupBy(*keys, "_stretch").agg(F.max_by("_held", F.when(F.col("_side") == 0, F.struct("_at", "_order"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "_stretch", F.last("_last", ignorenulls=True).over(before).alias("_carried")).filter("_carried IS NOT NULL")
    inside = Window.partitionBy(*keys, "_stretch").orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_seen", F.last("_held", ignorenulls=True).over(inside)).filter("_side = 1").join(carried, [*keys, "_stretch"], "left")
    whole = F.when(F.col("_ask")[asked].isNotNull(), F.coalesce("_seen", "_carried"))
    return found.select("_ask", whole.alias("_whole")).select(*[F.col("_ask")[c].alias(c) for c in columns], *[F.col("_whole")[c].alias(c) for c in payload])


def _shown(now: str = AS_OF) -> Column:
    """The instant of an event in one of the four shapes."""
    at, k = F.col("ts"), F.col("event_id")
    clock = F.concat_ws(".", nanos(at).cast("string"), F.lpad((k % 1000).cast("string"), 10, "0"))
    ago = F.concat(F.lit("-"), F.floor((nanos(F.lit(now).cast("timestamp_ntz")) - nanos(at)) / 3_600_000_000_000).cast("string"), F.lit("h"))
    return F.element_at(F.array(F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"), clock, ago), (k % 4 + 1).cast("int"))


@query("t07_own_instants", f"""WITH v AS (SELECT user_id, ts, max(event_id) AS seen_id, arg_max(event_type, event_id) AS seen_type, arg_max(value, event_id) AS seen_value FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2),
a AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN date_trunc('day', ts) WHEN 3 THEN TIMESTAMP '{AS_OF}' - to_hours(CAST((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) // 3600000000 AS BIGINT)) ELSE ts END AS at FROM events WHERE event_type = 'purchase')
SELECT a.event_id, epoch_us(a.at) * 1000 AS wall, CAST(CASE WHEN a.event_id % 4 = 2 THEN a.event_id % 1000 ELSE 0 END AS BIGINT) AS counter, v.seen_id, v.seen_type, v.seen_value FROM a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.at >= v.ts""")
def own_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was the user's last other event, as of the instant that each purchase names in its own way?"""
    e = table(spark, sf_dir, "events")
    asks = e.filter("event_type = 'purchase'").select("event_id", "user_id", resolved(_shown()).alias("at"))
    plain = F.struct(nanos(F.col("ts")).alias("wall"), F.lit(0).cast("long").alias("counter"))
    versions = e.filter("event_type <> 'purchase'").select("user_id", plain.alias("since"), F.col("event_id").alias("seen_id"), F.col("event_type").alias("seen_type"), F.col("value").alias("seen_value"))
    found = as_of_join(asks, versions, ["user_id"], "at", "since", ["seen_id", "seen_type", "seen_value"], ["seen_id"])
    return found.select("event_id", "at.wall", "at.counter", "seen_id", "seen_type", "seen_value")


@query("t08_logical_clocks", """WITH v AS (SELECT user_id, event_id, value, epoch_us(date_trunc('day', ts)) * 1000::HUGEINT * 10000000000 + event_id AS clock FROM events)
SELECT a.event_id, v.event_id AS seen_id, v.value AS seen_value FROM v a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.clock - 1 >= v.clock""")
def logical_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with one wall time a day, told apart by their counters: each event asks for the state one tick before its own."""
    e = table(spark, sf_dir, "events").withColumn("wall", nanos(F.date_trunc("day", "ts")))
    clock = lambda counter: F.struct("wall", counter.alias("counter"))
    asks = e.select("event_id", "user_id", clock(F.col("event_id") - 1).alias("at"))
    versions = e.select("user_id", clock(F.col("event_id")).alias("since"), F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value"))
    return as_of_join(asks, versions, ["user_id"], "at", "since", ["seen_id", "seen_value"], ["seen_id"]).select("event_id", "seen_id", "seen_value")
