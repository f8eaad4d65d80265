"""Joins (J), set operations and recursion (U), write semantics (K)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenfold.functions.rows import count_if, newest, table
from wrenfold.registry import query
from wrenfold.sources.folders import work_folder


@query("j01_four_way_chain", """SELECT r_name, n_name, count(*) AS lines, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def four_way_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"))  # one row per order crosses the joins
    rows = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    named = F.broadcast(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")))  # 25 rows
    return rows.groupBy("c_nationkey").agg(F.sum("lines").alias("lines"), F.sum("qty").alias("qty")).join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "lines", "qty")


@query("j02_left_with_name", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def left_with_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("j03_preaggregated_sides", """WITH a AS (SELECT o_custkey, count(*) AS orders, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent FROM orders GROUP BY 1),
b AS (SELECT o_custkey, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines, CASE WHEN urgent = 1 THEN 'urgent' WHEN orders > 12 THEN 'busy' WHEN orders IS NULL THEN 'none' ELSE 'plain' END AS kind
FROM customer LEFT JOIN a ON c_custkey = a.o_custkey LEFT JOIN b ON c_custkey = b.o_custkey""")
def preaggregated_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side is one row per key before it is joined: no fan-out, one shuffle each."""
    o = table(spark, sf_dir, "orders")
    a = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("urgent"))
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    b = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("n").alias("lines"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(a, F.col("c_custkey") == a.o_custkey, "left").drop("o_custkey").join(b, F.col("c_custkey") == b.o_custkey, "left")
    kind = F.when(F.col("urgent") == 1, "urgent").when(F.col("orders") > 12, "busy").when(F.col("orders").isNull(), "none").otherwise("plain")
    return rows.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"), kind.alias("kind"))


@query("j04_lateral_newest_child", "SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true")
def lateral_newest_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("o"))  # partial aggregation, no sort
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o.o_orderkey", "o.o_totalprice")


@query("j05_semi_either", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)
OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '2-HIGH' AND o_orderstatus = 'P')""")
def semi_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    either = table(spark, sf_dir, "orders").filter("o_totalprice > 250000 OR (o_orderpriority = '2-HIGH' AND o_orderstatus = 'P')")  # one scan for both
    return table(spark, sf_dir, "customer").join(either, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j06_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j07_cross_registry", "SELECT n_name, k.kind FROM nation CROSS JOIN (VALUES ('radio'), ('podcast'), ('web')) k(kind)")
def cross_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(*map(F.lit, ("radio", "podcast", "web"))))  # a constant: no join
    return table(spark, sf_dir, "nation").select("n_name", kinds.alias("kind"))


@query("j09_polymorphic", """SELECT 'customer' AS subject_kind, c_custkey AS subject_id, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000
UNION ALL SELECT 'supplier', s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000""")
def polymorphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.lit("customer").alias("subject_kind"), F.col("c_custkey").alias("subject_id"), F.col("c_nationkey").alias("n_nationkey"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.lit("supplier").alias("subject_kind"), F.col("s_suppkey").alias("subject_id"), F.col("s_nationkey").alias("n_nationkey"))
    return c.union(s).join(F.broadcast(table(spark, sf_dir, "nation")), "n_nationkey").select("subject_kind", "subject_id", "n_name")


@query("j10_scalar_fan", """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS done_orders,
(SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS big_orders, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer""")
def scalar_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        count_if(F.col("o_orderstatus") == "O").alias("open_orders"), count_if(F.col("o_orderstatus") == "F").alias("done_orders"), count_if(F.col("o_totalprice") > 100000).alias("big_orders"), F.max("o_orderdate").alias("last_order"),
    )
    rows = table(spark, sf_dir, "customer").join(one, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("open_orders", "done_orders", "big_orders")], "last_order")


@query("j11_deterministic_pick", "SELECT n_name, (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) AS top_supplier FROM nation")
def deterministic_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max_by("s_name", F.struct(F.col("s_acctbal"), (-F.col("s_suppkey")).alias("k"))).alias("top_supplier"))
    return table(spark, sf_dir, "nation").join(best, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", "top_supplier")


@query("j12_catalogue_gaps", """SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines, coalesce(bool_or(l_returnflag = 'R'), FALSE) AS any_return, count(DISTINCT o_orderkey) = 0 AS no_orders, count(l_orderkey) = 0 AS no_lines
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def catalogue_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    c = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("n").alias("lines"), F.bool_or("r").alias("r"))
    rows = table(spark, sf_dir, "customer").join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("r", F.lit(False)).alias("any_return"))
    return rows.withColumn("no_orders", F.col("orders") == 0).withColumn("no_lines", F.col("lines") == 0)


@query("j13_nearest_mark", """WITH mark AS (SELECT user_id, ts AS m FROM events WHERE event_type = 'signup'), b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT event_id, m AS mark_ts FROM (SELECT event_id, m, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(m)), m) AS rn FROM b JOIN mark USING (user_id)) WHERE rn = 1""")
def nearest_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each boundary takes the closest mark of its user: the last at or before it and the first after it, by two windows over one ordering, so no pair of rows is formed."""
    e = table(spark, sf_dir, "events").filter("event_type IN ('signup', 'purchase')").select("user_id", "ts", "event_id", "event_type", F.when(F.col("event_type") == "signup", F.col("ts")).alias("m"))
    w = Window.partitionBy("user_id").orderBy("ts", F.col("m").isNull())
    before = F.last("m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    gap = lambda c: F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col(c).cast("timestamp")))
    rows = e.withColumn("p", before).withColumn("q", after).filter("event_type = 'purchase' AND coalesce(p, q) IS NOT NULL")
    return rows.select("event_id", F.when(F.col("q").isNull() | (gap("p") <= gap("q")), F.col("p")).otherwise(F.col("q")).alias("mark_ts"))


@query("u01_ancestors", """WITH RECURSIVE up(event_id, ancestor, hop) AS (SELECT event_id, event_id // 2, 1 FROM events WHERE event_id // 2 > 0
UNION ALL SELECT event_id, ancestor // 2, hop + 1 FROM up WHERE ancestor // 2 > 0 AND hop < 8) SELECT event_id, ancestor, CAST(hop AS INTEGER) AS hop FROM up""")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents of every event, at most eight hops."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr("event_id div 2").alias("parent")).filter("parent > 0")
    return walk_up(e, 8).select(F.col("id").alias("event_id"), "ancestor", "hop")


def walk_up(edges: DataFrame, hops: int) -> DataFrame:
    """(id, ancestor, hop) over edges (id, parent) with one parent at most: lists of ancestors double with each self join, so eight hops take three.  Lines that have ended meet on a hash of their own, not on one null key."""
    up = edges.select("id", F.array("parent").alias("line"))
    have = 1
    while have < hops:
        more = up.toDF("next", "more")
        top = F.try_element_at("line", F.lit(have))
        up = up.withColumns({"_open": top.isNotNull(), "_top": F.coalesce(top, F.xxhash64("id"))}).join(more, F.col("_open") & (F.col("_top") == F.col("next")), "left")
        up = up.select("id", F.concat("line", F.coalesce("more", F.array().cast("array<bigint>"))).alias("line"))
        have *= 2
    return up.select("id", F.posexplode(F.slice("line", 1, hops)).alias("hop", "ancestor")).select("id", "ancestor", (F.col("hop") + 1).alias("hop"))


@query("u02_one_hop_lineage", "SELECT event_id AS fact, event_id // 2 AS basis, 'up' AS direction FROM events WHERE event_id = 50 UNION ALL SELECT event_id, event_id // 2, 'down' FROM events WHERE event_id // 2 = 50")
def one_hop_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("fact"), F.expr("event_id div 2").alias("basis"))
    return e.filter("fact = 50 OR basis = 50").withColumn("direction", F.when(F.col("fact") == 50, "up").otherwise("down"))


@query("u03_heads", "WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id - 6 END AS supersedes_id FROM events WHERE event_type = 'view') SELECT event_id FROM r WHERE event_id NOT IN (SELECT supersedes_id FROM r WHERE supersedes_id IS NOT NULL)")
def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").filter("event_type = 'view'").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_id") - 6).alias("supersedes_id"))
    return supersession_heads(r, "event_id", "supersedes_id")


def supersession_heads(rows: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Rows that no row of the set supersedes; pointers out of the set are harmless."""
    return rows.join(rows.select(F.col(supersedes).alias(key)).filter(F.col(key).isNotNull()), key, "left_anti").select(key)


@query("u05_jaccard_positions", """WITH p AS (SELECT o_orderpriority AS name, list(DISTINCT CAST(round(o_totalprice / 1000) AS BIGINT)) AS s FROM orders GROUP BY 1)
SELECT a.name AS a, b.name AS b, round(CASE WHEN len(list_distinct(list_concat(a.s, b.s))) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END, 6) AS jaccard FROM p a JOIN p b ON a.name < b.name""")
def jaccard_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by shared positions: sizes and intersections are counted on (name, position), never as sets in a row."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.round(F.col("o_totalprice") / 1000).cast("long").alias("pos")).distinct()
    size = p.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    both = p.toDF("a", "pos").join(p.toDF("b", "pos"), "pos").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    pairs = size.toDF("a", "na").join(size.toDF("b", "nb"), F.col("a") < F.col("b")).join(both, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return pairs.select("a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("jaccard"))


@query("k01_insert_if_absent", "SELECT min(doc_id) AS doc_id, md5(text) AS content_hash FROM documents GROUP BY md5(text) HAVING md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    return absent(d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id")), d.filter("doc_id % 3 = 0"), ["content_hash"]).select("doc_id", "content_hash")


def absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't there yet."""
    return new.join(existing.select(*keys), keys, "left_anti")


_METRIC = "SELECT l_partkey % 50 AS recording, l_returnflag AS platform, date_trunc('month', l_shipdate) AS period, l_quantity AS quantity, l_orderkey, l_linenumber FROM lineitem"


@query("k02_upsert_last_wins", f"SELECT recording, platform, CAST(period AS DATE) AS period, quantity FROM (SELECT *, row_number() OVER (PARTITION BY recording, platform, period ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM ({_METRIC})) WHERE rn = 1")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("recording"), F.col("l_returnflag").alias("platform"), F.trunc("l_shipdate", "month").alias("period"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), F.col("l_quantity").alias("quantity"))  # one number, of at most seven lines an order: so the aggregate hashes and doesn't sort
    return rows.groupBy("recording", "platform", "period").agg(F.max_by("quantity", "at").alias("quantity"))


@query("k03_conditional_upsert", """WITH old AS (SELECT user_id AS k, max(event_type) AS state FROM events WHERE event_id < 5000 GROUP BY 1), new AS (SELECT user_id AS k, min(event_type) AS state FROM events WHERE event_id >= 5000 GROUP BY 1)
SELECT coalesce(old.k, new.k) AS k, CASE WHEN old.k IS NULL THEN new.state WHEN new.k IS NULL OR old.state = 'view' THEN old.state ELSE new.state END AS state FROM old FULL OUTER JOIN new ON old.k = new.k""")
def conditional_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, or update unless the row is in the protected state: one aggregation instead of a full outer join."""
    e = table(spark, sf_dir, "events")
    one = e.groupBy(F.col("user_id").alias("k")).agg(F.max(F.when(F.col("event_id") < 5000, F.col("event_type"))).alias("old"), F.min(F.when(F.col("event_id") >= 5000, F.col("event_type"))).alias("new"))
    return one.select("k", F.when(F.col("old").isNull(), F.col("new")).when(F.col("new").isNull() | (F.col("old") == "view"), F.col("old")).otherwise(F.col("new")).alias("state"))


@query("k04_full_upsert", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'auto' ELSE 'human' END AS mode FROM nation UNION ALL SELECT 100 + r_regionkey, 'auto' FROM region")
def full_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("human").alias("mode"), F.lit(0).alias("v"))
    new = old.filter("n_nationkey % 2 = 0").select("n_nationkey", F.lit("auto").alias("mode"), F.lit(1).alias("v"))
    added = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.lit("auto").alias("mode"), F.lit(1).alias("v"))
    return old.union(new).union(added).groupBy("n_nationkey").agg(F.max_by("mode", "v").alias("mode"))


@query("k05_queue_seeding", """SELECT c_custkey, kind FROM customer CROSS JOIN (VALUES ('enrich'), ('discover')) v(kind) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = CASE WHEN kind = 'enrich' THEN '1-URGENT' ELSE '5-LOW' END)""")
def queue_seeding(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit("enrich"), F.lit("discover"))).alias("kind"))
    have = table(spark, sf_dir, "orders").filter("o_orderpriority IN ('1-URGENT', '5-LOW')").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderpriority") == "1-URGENT", "enrich").otherwise("discover").alias("kind"))
    return absent(wanted, have, ["c_custkey", "kind"])


@query("k06_role_backfill", """SELECT c_custkey, 'buyer' AS role FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def role_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "P").alias("p"))
    return table(spark, sf_dir, "customer").join(per.filter("f AND NOT p"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", F.lit("buyer").alias("role"))


@query("k07_guarded_update", "SELECT event_id, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'done' ELSE event_type END AS state, event_type = 'click' AND user_id % 2 = 0 AS changed FROM events")
def guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = (F.col("event_type") == "click") & (F.col("user_id") % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", F.when(mine, "done").otherwise(F.col("event_type")).alias("state"), mine.alias("changed"))


@query("k08_cascade_orphans", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey <> 1)")
def cascade_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_suppkey") == 1).alias("gone"), F.bool_or(F.col("l_suppkey") != 1).alias("stays"))
    return table(spark, sf_dir, "part").join(refs.filter("gone AND NOT stays"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("k09_replace_chunks", "SELECT doc_id, CAST(i AS INTEGER) AS ordinal, substr(text, 1 + size * i, size) AS chunk FROM (SELECT doc_id, text, size, unnest(range(0, CAST(ceil(length(text) / CAST(size AS DOUBLE)) AS BIGINT))) AS i FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 1000 ELSE 500 END AS size FROM documents))")
def replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of a document that comes anew replace what it had."""
    d = table(spark, sf_dir, "documents")

    def cut(docs: DataFrame, size: int) -> DataFrame:
        rows = docs.filter(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / float(size)).cast("int") - 1)).alias("ordinal"))
        return rows.select("doc_id", "ordinal", F.expr(f"substring(text, 1 + {size} * ordinal, {size})").alias("chunk"))

    old, new = cut(d, 500), cut(d.filter("doc_id % 3 = 0"), 1000)
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


@query("k10_snapshot_append", """SELECT CAST(ts AS DATE) AS captured, 'total' AS dimension, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT CAST(ts AS DATE), event_type, count(*) FROM events GROUP BY 1, 2""")
def snapshot_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("captured"), F.col("event_type").alias("dimension")).agg(F.count(F.lit(1)).alias("n"))
    total = seg.groupBy("captured").agg(F.sum("n").alias("n")).select("captured", F.lit("total").alias("dimension"), "n")
    return total.union(seg)


@query("k11_report_lines", "SELECT n_name || ',' || CAST(count(c_custkey) AS VARCHAR) AS line FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "nation").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(F.concat_ws(",", "n_name", F.coalesce("n", F.lit(0)).cast("string")).alias("line"))


@query("d13_suggestion_accept", """SELECT o_orderkey, CASE WHEN rn = 1 THEN 'accepted' ELSE 'superseded' END AS state FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)""")
def suggestion_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.row_number().over(w) == 1, "accepted").otherwise("superseded").alias("state"))


@query("d15_enrich_or_create", """SELECT call AS call_sign, s_suppkey AS known_id, CASE WHEN s_suppkey IS NULL THEN 'create' ELSE 'enrich' END AS action FROM (SELECT DISTINCT 'Supplier#' || lpad(CAST(l_suppkey + l_linenumber % 2 * 1000 AS VARCHAR), 9, '0') AS call FROM lineitem) LEFT JOIN supplier ON s_name = call""")
def enrich_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.concat(F.lit("Supplier#"), F.lpad((F.col("l_suppkey") + F.col("l_linenumber") % 2 * 1000).cast("string"), 9, "0"))
    heard = table(spark, sf_dir, "lineitem").select(call.alias("call_sign")).distinct()
    known = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return heard.join(known, F.col("s_name") == F.col("call_sign"), "left").select("call_sign", F.col("s_suppkey").alias("known_id"), F.when(F.col("s_suppkey").isNull(), "create").otherwise("enrich").alias("action"))


@query("d01_country_ladder", """SELECT c_custkey, CASE WHEN c_acctbal > 8000 THEN 'US' ELSE p END AS country FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON o_custkey = c_custkey""")
def country_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = newest(table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", F.col("o_orderpriority").alias("p"))
    return table(spark, sf_dir, "customer").join(live, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.when(F.col("c_acctbal") > 8000, "US").otherwise(F.col("p")).alias("country"))


#: Rounds of a walk after which its pairs are held against all earlier ones.
LOOK_BACK = 8


def walk_basis(claims: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(claim, basis, hop, weight): all that ``claims`` (claim) rest on over edges (claim, basis, weight) of any shape, at most ``hops`` away or, without ``hops``, however far.

    ``hop`` is the shortest way and ``weight`` the best product of weights over any way of at most ``hops``.  A round
    follows the edges of the pairs of the round before and keeps the best way of each pair, so rows stay one per pair
    and round however many ways lead there; each pair is written once a round, and all rounds meet at the end.  Every
    ``LOOK_BACK`` rounds a pair that brings nothing better than an earlier round ends, so cycles end (weights lie
    between 0 and 1; a null one counts as 1).  A claim is no basis of itself; edges with a null end lead nowhere.
    Rounds are written to the shared folder.  A walk without ``hops`` goes on until a round that looks back finds
    nothing better; as no way gets better by passing a place twice, that is the whole result, and a weight that is not
    between 0 and 1, with which it might never end, is an error there.
    """
    spark = edges.sparkSession
    e = edges.dropna(subset=["claim", "basis"]).groupBy("claim", "basis").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight")).filter("claim <> basis")
    if hops is None:
        e = e.withColumn("weight", F.when(F.col("weight").between(0, 1), F.col("weight")).otherwise(F.raise_error(F.concat(F.lit("a walk to the end needs weights between 0 and 1, not "), F.col("weight").cast("string")))))
    e = _written(spark, e)
    onward = e.toDF("_at", "basis", "_more")
    front = _written(spark, claims.select("claim").dropna().distinct().join(e, "claim").select("claim", "basis", "weight"))
    found = front.withColumn("hop", F.lit(1))
    for hop in count(2) if hops is None else range(2, hops + 1):
        step = front.withColumnRenamed("basis", "_at").join(onward, "_at").select("claim", "basis", (F.col("weight") * F.col("_more")).alias("weight")).filter("claim <> basis")
        step = step.groupBy("claim", "basis").agg(F.max("weight").alias("weight"))
        if hop % LOOK_BACK == 0 and hop != hops:
            old = found.groupBy("claim", "basis").agg(F.max("weight").alias("_old"))
            step = step.join(old, ["claim", "basis"], "left").filter("_old IS NULL OR weight > _old").drop("_old")
        front = _written(spark, step)
        if front.isEmpty():
            break
        found = found.union(front.withColumn("hop", F.lit(hop)))
    return found.groupBy("claim", "basis").agg(F.min("hop").alias("hop"), F.max("weight").alias("weight"))


def _written(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = work_folder(spark, "walk")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: Events rest on two earlier ones, with weights; a few early ones also on a later one, which closes cycles.
_RESTS = """(SELECT event_id AS claim, event_id // 2 AS basis, 1 - (event_id % 9) / 10.0 AS weight FROM events WHERE event_id // 2 > 0 UNION ALL SELECT event_id, event_id // 3, 0.5 + (event_id % 5) / 10.0 FROM events WHERE event_id // 3 > 0
UNION ALL SELECT event_id, event_id * 6, 0.9 FROM events WHERE event_id BETWEEN 1 AND 9)"""


def _rests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf_dir, "events")
    halves = e.select(k.alias("claim"), F.expr("event_id div 2").alias("basis"), (1 - (k % 9) / F.lit(10.0)).alias("weight")).filter("basis > 0")
    thirds = e.select(k.alias("claim"), F.expr("event_id div 3").alias("basis"), (0.5 + (k % 5) / F.lit(10.0)).alias("weight")).filter("basis > 0")
    return halves.union(thirds).union(e.filter(k.between(1, 9)).select(k, k * 6, F.lit(0.9)))


def _graph_sql(claims: str, edges: str, hops: int) -> str:
    return f"""WITH RECURSIVE g AS (SELECT claim, basis, max(CAST(weight AS DOUBLE)) AS weight FROM {edges} GROUP BY 1, 2),
w(claim, basis, hop, weight) AS (SELECT claim, basis, 1, weight FROM g WHERE claim IN ({claims}) UNION SELECT w.claim, g.basis, w.hop + 1, w.weight * g.weight FROM w JOIN g ON g.claim = w.basis WHERE w.hop < {hops})
SELECT claim, basis, CAST(min(hop) AS INTEGER) AS hop, round(max(weight), 9) AS weight FROM w WHERE claim <> basis GROUP BY 1, 2"""


@query("p03_basis_graph", _graph_sql("SELECT event_id FROM events WHERE event_type = 'purchase'", _RESTS, 8))
def basis_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each purchase rests on at most eight hops away, over several bases an event, with cycles; ``whole_basis`` has the rest too."""
    return walk_basis(_purchases(spark, sf_dir), _rests(spark, sf_dir), 8).withColumn("weight", F.round("weight", 9))


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("claim"))


@query("p03_whole_basis", f"""WITH RECURSIVE g AS (SELECT claim, basis, max(CAST(weight AS DOUBLE)) AS weight FROM {_RESTS} WHERE claim <> basis GROUP BY 1, 2),
w(claim, basis, hop, weight) USING KEY (claim, basis) AS (SELECT claim, basis, 1, weight FROM g WHERE claim IN (SELECT event_id FROM events WHERE event_type = 'purchase')
UNION SELECT n.claim, n.basis, coalesce(o.hop, n.hop), n.weight FROM (SELECT w.claim, g.basis, min(w.hop) + 1 AS hop, max(w.weight * g.weight) AS weight FROM w JOIN g ON g.claim = w.basis WHERE w.claim <> g.basis GROUP BY 1, 2) n
LEFT JOIN recurring.w o ON o.claim = n.claim AND o.basis = n.basis WHERE o.weight IS NULL OR n.weight > o.weight)
SELECT claim, basis, CAST(hop AS INTEGER) AS hop, weight FROM w""")
def whole_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each purchase rests on, however far: the walk of ``basis_graph`` without its eight hops."""
    return walk_basis(_purchases(spark, sf_dir), _rests(spark, sf_dir))


@query("p03_dependents_graph", _graph_sql("SELECT event_id FROM events WHERE event_type = 'signup'", f"(SELECT basis AS claim, claim AS basis, weight FROM {_RESTS})", 3).replace("SELECT claim, basis, CAST", "SELECT claim AS fact, basis AS dependent, CAST"))
def dependents_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rests on each signup, three steps down: what a change of it would make stale."""
    facts = table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("claim"))
    down = _rests(spark, sf_dir).select(F.col("basis").alias("claim"), F.col("claim").alias("basis"), "weight")
    return walk_basis(facts, down, 3).select(F.col("claim").alias("fact"), F.col("basis").alias("dependent"), "hop", F.round("weight", 9).alias("weight"))
