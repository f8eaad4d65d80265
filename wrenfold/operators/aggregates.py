"""Aggregations (A) and windows (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenfold.functions.rows import as_of, count_if, exact_quantile, money, newest, prop, table
from wrenfold.registry import query






@query("a01_conditional_counts", "SELECT user_id % 10 AS bucket, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("bucket")).agg(count_if(F.col("event_type") == "view").alias("views"), count_if(F.col("event_type") == "error").alias("errors"))


@query("a02_grouped_totals", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS large, max(ts) AS last_ts, round(sum(CAST(value AS DECIMAL(18,6))), 4) AS total FROM events GROUP BY 1")
def grouped_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("value") > 50).alias("large"), F.max("ts").alias("last_ts"), F.round(F.sum(money(F.col("value"))), 4).alias("total"))


@query("a03_two_keys_by_count", "SELECT event_type, user_id % 7 AS day, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, 1, 2")
def two_keys_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 7).alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type", "day")


@query("a04_top_spread", "SELECT o_custkey, count(*) AS n, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25")
def top_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), (F.max("o_totalprice") - F.min("o_totalprice")).alias("spread")).orderBy(F.desc("n"), "o_custkey").limit(25)


@query("a05_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("a06_ordered_list", "SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("nations"))
    return table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "nations")


@query("a07_filtered_array", "SELECT o_custkey, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (WHERE o_orderstatus = 'P')), ','), '') AS partial_keys, max(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS BIGINT) END) AS top_done FROM orders GROUP BY 1")
def filtered_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(keys, lambda k: k.cast("string")), ",").alias("partial_keys"), F.max(F.when(F.col("o_orderstatus") == "F", F.rint("o_totalprice").cast("long"))).alias("top_done"))


@query("a08_marker_pivot", "SELECT user_id, max(CASE WHEN event_type = 'view' THEN value END) AS view, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM events GROUP BY 1")
def marker_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.max("value"))


@query("a09_two_key_rollup", """SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 UNION ALL SELECT n_name, NULL, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT NULL, NULL, count(*) FROM customer""")
def two_key_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("k"))
    named = leaf.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.rollup("n_name", "c_mktsegment").agg(F.sum("k").alias("n"))


@query("a10_daily_histogram", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY GROUP BY 1")
def daily_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("ts") > as_of() - F.expr("INTERVAL 14 DAY")).groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("a11_scalar_panel", "SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders WHERE o_totalprice < 0) AS negative, (SELECT count(*) FROM documents WHERE lang = 'xx') AS unknown_language, (SELECT max(l_shipdate) FROM lineitem) AS last_ship")
def scalar_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    parts = [t("customer").agg(F.count(F.lit(1)).alias("customers")), t("orders").filter("o_totalprice < 0").agg(F.count(F.lit(1)).alias("negative")), t("documents").filter("lang = 'xx'").agg(F.count(F.lit(1)).alias("unknown_language")), t("lineitem").agg(F.max("l_shipdate").alias("last_ship"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query("a12_rolling_spend", """SELECT c.user_id, coalesce(h.tokens, 0) AS tokens, coalesce(h.cost, 0) AS cost, coalesce(h.tokens, 0) > 100 AS over_cap FROM (SELECT DISTINCT user_id FROM events) c LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 DAY) AS tokens,
sum(CASE WHEN ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY THEN CAST(value AS DECIMAL(18,6)) ELSE 0 END) AS cost FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY GROUP BY 1) h ON c.user_id = h.user_id""")
def rolling_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour, day = F.col("ts") > as_of() - F.expr("INTERVAL 3 DAY"), F.col("ts") > as_of() - F.expr("INTERVAL 10 DAY")
    one = table(spark, sf_dir, "events").groupBy("user_id").agg(count_if(hour).alias("tokens"), F.sum(F.when(day, money(F.col("value"))).otherwise(F.lit(0).cast("decimal(18,6)"))).alias("cost"))
    return one.withColumn("over_cap", F.col("tokens") > 100)


@query("a13_statement_summary", """SELECT l_suppkey, count(*) AS line_count, count(*) FILTER (WHERE l_partkey % 11 = 0) AS no_code, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, sum(CAST(l_extendedprice AS DECIMAL(18,6))) AS amount, min(date_trunc('month', l_shipdate))::DATE AS first_period, max(date_trunc('month', l_shipdate))::DATE AS last_period,
CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) ELSE 'MIXED' END AS currency, count(DISTINCT l_returnflag) AS stores FROM lineitem GROUP BY 1""")
def statement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("line_count"), count_if(F.col("l_partkey") % 11 == 0).alias("no_code"), F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.sum(money(F.col("l_extendedprice"))).alias("amount"),
        F.min(F.trunc("l_shipdate", "month")).alias("first_period"), F.max(F.trunc("l_shipdate", "month")).alias("last_period"),
        F.when(F.min("l_linestatus") == F.max("l_linestatus"), F.min("l_linestatus")).otherwise("MIXED").alias("currency"), F.size(F.collect_set("l_returnflag")).cast("long").alias("stores"),
    )


@query("a14_audience_valuation", """WITH m AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) AS rn FROM orders)
SELECT n_name, sum(CAST(o_totalprice AS DECIMAL(18,6))) AS total, count(o_custkey) AS valued, count(*) FILTER (WHERE o_custkey IS NULL) AS unvalued FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN m ON m.o_custkey = c_custkey AND rn = 1 GROUP BY 1""")
def audience_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = newest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_totalprice")
    rows = table(spark, sf_dir, "customer").join(m, F.col("o_custkey") == F.col("c_custkey"), "left")
    per = rows.groupBy("c_nationkey").agg(F.sum(money(F.col("o_totalprice"))).alias("total"), F.count("o_custkey").alias("valued"), count_if(F.col("o_custkey").isNull()).alias("unvalued"))
    return per.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "total", "valued", "unvalued")


@query("a15_curator_rollup", """SELECT l_suppkey AS curator, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS matched, CAST(sum(l_linenumber) AS BIGINT) AS tracks, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1""")
def curator_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_suppkey").alias("curator")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda k: k.cast("string")), ",").alias("matched"), F.sum("l_linenumber").alias("tracks"), F.count(F.lit(1)).alias("n"))


@query("a16_quantile_scaling", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, round(least(1.0, l_extendedprice / p95), 6) AS level FROM lineitem JOIN q USING (l_returnflag)""")
def quantile_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return li.join(exact_quantile(li, "l_returnflag", "l_extendedprice", 0.95, "p95"), "l_returnflag").select("l_orderkey", "l_linenumber", F.round(F.least(F.lit(1.0), F.col("l_extendedprice") / F.col("p95")), 6).alias("level"))


@query("a17_mean_over_patches", """SELECT label, i AS position, round(avg(v), 6) AS mean FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY avg(v) DESC, i) <= 3""")
def mean_over_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.expr("cast(embedding as array<double>)")).alias("position", "v"))
    means = v.groupBy("label", F.col("position").cast("long").alias("position")).agg(F.avg("v").alias("m"))
    top = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("m"), "position"))
    return means.withColumn("rn", top).filter("rn <= 3").select("label", "position", F.round("m", 6).alias("mean"))


@query("a18_confusion", "SELECT count(*) FILTER (WHERE p AND toxic = 1) AS tp, count(*) FILTER (WHERE NOT p AND toxic = 1) AS fn, count(*) FILTER (WHERE p AND toxic = 0) AS fp, count(*) FILTER (WHERE NOT p AND toxic = 0) AS tn FROM (SELECT toxic, n_chars > 2000 AS p FROM labels JOIN documents USING (doc_id))")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).alias("p")), "doc_id")
    t, p = F.col("toxic") == 1, F.col("p")
    return rows.agg(count_if(p & t).alias("tp"), count_if(~p & t).alias("fn"), count_if(p & ~t).alias("fp"), count_if(~p & ~t).alias("tn"))


@query("a19_guarded_correlation", "SELECT l_suppkey, round(CASE WHEN count(*) < 3 OR stddev_pop(l_quantity) < 1e-12 OR stddev_pop(l_extendedprice) < 1e-12 THEN NULL ELSE corr(l_quantity, l_extendedprice) END, 6) AS r FROM lineitem GROUP BY 1")
def guarded_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = (F.count(F.lit(1)) < 3) | (F.stddev_pop("l_quantity") < 1e-12) | (F.stddev_pop("l_extendedprice") < 1e-12)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.when(~flat, F.corr("l_quantity", "l_extendedprice")), 6).alias("r"))


@query("w01_total_with_page", "SELECT c_custkey, c_name, count(*) OVER () AS total FROM customer WHERE c_acctbal > 0 ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def total_with_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total comes from one partial-aggregated row; a window over nothing would put all rows in one task."""
    rows = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    return rows.orderBy("c_name", "c_custkey").offset(40).limit(20).crossJoin(rows.agg(F.count(F.lit(1)).alias("total")))


@query("w02_newest_per_key", "SELECT DISTINCT ON (o_custkey, o_orderpriority) o_custkey, o_orderpriority, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderpriority, o_orderdate DESC, o_orderkey DESC")
def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("b")
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(best).select("o_custkey", "o_orderpriority", "b.o_orderkey", "b.o_orderstatus")


_TRUST = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"


@query("w03_trust_order", f"SELECT DISTINCT ON (o_custkey, o_orderpriority) o_custkey, o_orderpriority, o_orderkey FROM orders ORDER BY o_custkey, o_orderpriority, {_TRUST}, o_orderdate DESC, o_orderkey DESC")
def trust_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], [F.expr(_TRUST), F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("w04_latest_snapshot", "SELECT user_id, event_id, event_type FROM events e WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events x WHERE x.user_id = e.user_id)")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return e.withColumn("r", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("day")))).filter("r = 1").select("user_id", "event_id", "event_type")


@query("w06_rank_intensity", "SELECT p_partkey, CAST(1 + round_even(4.0 * (rn - 1) / (n - 1), 0) AS INTEGER) AS intensity FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE n > 1")
def rank_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(w.orderBy("p_retailprice", "p_partkey")).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.filter("n > 1").select("p_partkey", (1 + F.bround(4.0 * (F.col("rn") - 1) / (F.col("n") - 1))).cast("int").alias("intensity"))


@query("w07_zscore_argmax", """WITH s AS (SELECT avg(p_size) AS ms, stddev_samp(p_size) AS ss, avg(p_retailprice) AS mp, stddev_samp(p_retailprice) AS sp FROM part), z AS (SELECT p_partkey, (p_size - ms) / ss AS zs, (p_retailprice - mp) / sp AS zp FROM part, s)
SELECT p_partkey, round(zs, 6) AS z_size, round(zp, 6) AS z_price, CASE WHEN abs(zs) >= abs(zp) THEN 'size' ELSE 'price' END AS axis FROM z""")
def zscore_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    s = p.agg(F.avg("p_size").alias("ms"), F.stddev_samp("p_size").alias("ss"), F.avg("p_retailprice").alias("mp"), F.stddev_samp("p_retailprice").alias("sp"))
    z = p.crossJoin(F.broadcast(s)).select("p_partkey", ((F.col("p_size") - F.col("ms")) / F.col("ss")).alias("zs"), ((F.col("p_retailprice") - F.col("mp")) / F.col("sp")).alias("zp"))
    return z.select("p_partkey", F.round("zs", 6).alias("z_size"), F.round("zp", 6).alias("z_price"), F.when(F.abs("zs") >= F.abs("zp"), "size").otherwise("price").alias("axis"))


@query("w08_sessions", """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM s GROUP BY 1, 2""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    brk = F.when(before.isNull() | (F.col("ts") - before > F.expr("INTERVAL 12 HOUR")), 1).otherwise(0)
    rows = table(spark, sf_dir, "events").withColumn("brk", brk).withColumn("session", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@query("w09_longest_run", """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events),
c AS (SELECT user_id, event_type, island, count(*) AS n FROM r GROUP BY 1, 2, 3) SELECT user_id, event_type, max(n) AS longest FROM c GROUP BY 1, 2""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["ts", "event_id"]
    island = F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(*order))
    runs = table(spark, sf_dir, "events").select("user_id", "event_type", island.alias("island")).groupBy("user_id", "event_type", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("user_id", "event_type").agg(F.max("n").alias("longest"))


@query("w10_grid_durations", """WITH c AS (SELECT l_orderkey, l_linenumber, CAST(round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity ROWS UNBOUNDED PRECEDING) / 4) AS BIGINT) AS pos, l_partkey, l_suppkey, l_shipdate, l_quantity FROM lineitem)
SELECT l_orderkey, l_linenumber, pos - coalesce(lag(pos) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity), 0) AS duration FROM c""")
def grid_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    pos = F.round(F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)) / 4).cast("long")
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", pos)
    return rows.select("l_orderkey", "l_linenumber", (F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0))).alias("duration"))


@query("w11_local_maxima", """WITH d AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
m AS (SELECT user_id, median(abs(step)) AS md FROM d WHERE step IS NOT NULL GROUP BY 1) SELECT event_id, round(step, 6) AS step FROM d JOIN m USING (user_id) WHERE value > p AND value >= n AND abs(step) > 1.5 * md""")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.lag("value").over(w).alias("p"), F.lead("value").over(w).alias("n")).withColumn("step", F.col("value") - F.col("p"))
    rows = d.join(exact_quantile(d.withColumn("size", F.abs("step")), "user_id", "size", 0.5, "md"), "user_id")
    return rows.filter("value > p AND value >= n AND abs(step) > 1.5 * md").select("event_id", F.round("step", 6).alias("step"))


@query("d02_creator_profile", """SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS measured, round(avg(l_quantity), 6) AS mean_bpm, 'beat own median ' || CAST(count(*) FILTER (WHERE l_extendedprice > md) AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) AS claim
FROM (SELECT *, median(l_extendedprice) OVER (PARTITION BY l_suppkey) AS md FROM lineitem) GROUP BY 1""")
def creator_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice")
    rows = rows.join(exact_quantile(rows, "l_suppkey", "l_extendedprice", 0.5, "md"), "l_suppkey")
    won = count_if(F.col("l_extendedprice") > F.col("md"))
    return rows.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("measured"), F.round(F.avg("l_quantity"), 6).alias("mean_bpm"), F.concat(F.lit("beat own median "), won.cast("string"), F.lit(" of "), F.count(F.lit(1)).cast("string")).alias("claim"))


@query("d08_rate_limits", "SELECT user_id, count(*) AS recent, count(*) >= 5 AS limited FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 48 HOUR AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 0 GROUP BY 1")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").filter((F.col("ts") > as_of() - F.expr("INTERVAL 48 HOUR")) & (prop() >= 0)).groupBy("user_id").agg(F.count(F.lit(1)).alias("recent"))
    return n.withColumn("limited", F.col("recent") >= 5)
