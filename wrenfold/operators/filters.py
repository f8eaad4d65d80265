"""Projections, filters and predicates (F), scans (S) and limits (L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.functions.rows import as_of, prop, table
from wrenfold.registry import query


@query("s01_tenant_newest", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def tenant_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_custkey = 7")
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("s02_positional_feed", """
WITH line AS (SELECT CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE '|' END || concat_ws('|', CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE 'W' || CAST(s_suppkey AS VARCHAR) END, '88.' || CAST(s_suppkey % 10 AS VARCHAR) || ' MHz', 'FM', '200', 'ND', '-', '-', 'A', CASE WHEN s_nationkey % 3 = 0 THEN ' LIC' ELSE 'CP' END, 'NEW TOWN', CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'GA' END) || repeat('|', 7) || CAST(1000 + s_suppkey AS VARCHAR)
|| repeat('|', CASE WHEN s_suppkey % 11 = 0 THEN 3 ELSE 9 END) || CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE s_name || ' ' END || CASE WHEN s_suppkey % 2 = 0 THEN '|' ELSE '' END AS v FROM supplier),
f AS (SELECT list_transform(list_slice(string_split(v, '|'), 2, 99), lambda x: trim(x)) AS p FROM line WHERE v LIKE '|%')
SELECT p[1] AS call_sign, TRY_CAST(regexp_replace(p[2], '[^0-9.]', '', 'g') AS DOUBLE) AS frequency_mhz, 'New Town' AS city, CASE WHEN p[11] = '' THEN 'XX' ELSE p[11] END AS state, p[18] AS facility_id, p[27] AS licensee FROM f WHERE len(p) >= 27 AND p[9] = 'LIC' AND p[1] <> '' AND p[27] <> ''""")
def positional_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, empty = F.col("s_suppkey"), F.lit("")
    fields = [F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("W"), k.cast("string"))), F.concat(F.lit("88."), (k % 10).cast("string"), F.lit(" MHz")), *map(F.lit, ("FM", "200", "ND", "-", "-", "A"))]
    fields += [F.when(F.col("s_nationkey") % 3 == 0, " LIC").otherwise("CP"), F.lit("NEW TOWN"), F.when(k % 4 == 0, "").otherwise("GA"), *[empty] * 6, (1000 + k).cast("string")]
    owner = F.when(k % 7 == 0, " ").otherwise(F.concat(F.col("s_name"), F.lit(" ")))
    line = F.concat(F.when(k % 13 == 0, "").otherwise("|"), F.concat_ws("|", *fields), F.repeat(F.lit("|"), F.when(k % 11 == 0, 3).otherwise(9)), owner, F.when(k % 2 == 0, "|").otherwise(""))
    return licensed(table(spark, sf_dir, "supplier").select(line.alias("line")), "XX")


# The fields of the feed, counted from the first after the leading bar.
FEED = {"call_sign": 1, "frequency": 2, "status": 9, "city": 10, "state": 11, "facility_id": 18, "licensee": 27}


def licensed(lines: DataFrame, state: str, fields: int = 27) -> DataFrame:
    """Licensed stations of a feed of bar-delimited positions without header; other lines, short, unlicensed and nameless ones are skipped.  ``state`` stands for one that is left out."""
    p = lines.filter(F.col("line").startswith("|")).select(F.slice(F.transform(F.split("line", r"\|"), lambda x: F.trim(x)), 2, 1 << 20).alias("p")).filter(F.size("p") >= fields)
    at = lambda name: F.element_at("p", FEED[name])
    kept = p.filter((at("status") == "LIC") & (at("call_sign") != "") & (at("licensee") != ""))
    mhz = F.regexp_replace(at("frequency"), "[^0-9.]", "").try_cast("double")
    return kept.select(at("call_sign").alias("call_sign"), mhz.alias("frequency_mhz"), F.initcap(at("city")).alias("city"), F.coalesce(F.nullif(at("state"), F.lit("")), F.lit(state)).alias("state"), F.nullif(at("facility_id"), F.lit("")).alias("facility_id"), at("licensee").alias("licensee"))


@query("s06_id_blocks", """
SELECT CAST(b AS BIGINT) AS block_start, count(*) AS n, CAST(min(l_orderkey) AS BIGINT) AS first_key, CAST(max(l_orderkey) AS BIGINT) AS last_key
FROM range(0, (SELECT max(l_orderkey) + 1 FROM lineitem), 1000) r(b) JOIN lineitem ON l_orderkey >= b AND l_orderkey < b + 1000 GROUP BY b""")
def id_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = (F.floor(F.col("l_orderkey") / 1000) * 1000).cast("long")  # a block number, not a range join
    return table(spark, sf_dir, "lineitem").groupBy(block.alias("block_start")).agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))


@query("s07_alias_hops", """
WITH alias AS (SELECT doc_id AS src, doc_id - doc_id % 10 AS dst FROM documents WHERE doc_id % 10 BETWEEN 1 AND 3),
page AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 20 <> 10)
SELECT d.doc_id, coalesce(p0.doc_id, p1.doc_id, p2.doc_id) AS found_id, coalesce(p0.lang, p1.lang, p2.lang) AS lang
FROM documents d LEFT JOIN alias a1 ON d.doc_id = a1.src LEFT JOIN alias a2 ON a1.dst = a2.src
LEFT JOIN page p0 ON p0.doc_id = d.doc_id AND d.doc_id % 2 = 0 LEFT JOIN page p1 ON p1.doc_id = a1.dst LEFT JOIN page p2 ON p2.doc_id = a2.dst""")
def alias_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    alias = d.filter("doc_id % 10 BETWEEN 1 AND 3").select(F.col("doc_id").alias("src"), F.expr("doc_id - doc_id % 10").alias("dst"))
    page = d.filter("doc_id % 20 <> 10")
    hop = lambda k: alias.toDF(f"s{k}", f"d{k}")
    at = lambda k: page.toDF(f"p{k}", f"l{k}")
    rows = d.join(hop(1), F.col("doc_id") == F.col("s1"), "left").join(hop(2), F.col("d1") == F.col("s2"), "left")
    rows = rows.join(at(0), (F.col("p0") == F.col("doc_id")) & (F.col("doc_id") % 2 == 0), "left").join(at(1), F.col("p1") == F.col("d1"), "left").join(at(2), F.col("p2") == F.col("d2"), "left")
    return rows.select("doc_id", F.coalesce("p0", "p1", "p2").alias("found_id"), F.coalesce("l0", "l1", "l2").alias("lang"))


def landed_feed(spark: SparkSession, root: str, state: str, band: str) -> DataFrame:
    """The lines of one jurisdiction and band of a landing zone (``root/state=XX/band=YY/``); other folders aren't read."""
    rows = spark.read.schema("value string, state string, band string").text(root)
    return rows.filter((F.col("state") == state) & (F.col("band") == band)).select(F.col("value").alias("line"))


#: What a feed tells of itself stands in its first bytes; a feed of every episode ever isn't read to its end.
FEED_BYTES = 2_000_000


def feed_heads(files: DataFrame, cap: int = FEED_BYTES) -> DataFrame:
    """(url, title, owner_email, cut) from the first ``cap`` bytes of landed feeds (url, content)."""
    head = F.substring("content", 1, cap).cast("string")
    owner = F.regexp_extract(head, r"(?s)<itunes:owner>(.*?)</itunes:owner>", 1)
    found = lambda c, tag: F.trim(F.regexp_extract(c, rf"(?s)<{tag}>\s*([^<]*)", 1))
    return files.select("url", found(head, "title").alias("title"), found(owner, "itunes:email").alias("owner_email"), (F.octet_length("content") > cap).alias("cut"))


@query("s08_feed_heads", r"""WITH x AS (SELECT doc_id, '<rss><channel>' || chr(10) || '<title> Show ' || CAST(doc_id AS VARCHAR) || '</title><description>' || replace(text, '<', ' ') || '</description><itunes:owner><itunes:email>o' || CAST(doc_id AS VARCHAR) || '@x.example</itunes:email></itunes:owner></channel></rss>' AS xml FROM documents),
h AS (SELECT doc_id, strlen(xml) > 2000 AS cut, strpos(xml, '<itunes:owner>') AS at, strlen(xml[1:strpos(xml, '</itunes:owner>') - 1]) + 15 AS seen FROM x)
SELECT 'feed:' || CAST(doc_id AS VARCHAR) AS url, 'Show ' || CAST(doc_id AS VARCHAR) AS title, CASE WHEN seen <= 2000 THEN 'o' || CAST(doc_id AS VARCHAR) || '@x.example' ELSE '' END AS owner_email, cut FROM h""")
def feed_head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    xml = F.concat(F.lit("<rss><channel>\n<title> Show "), k, F.lit("</title><description>"), F.replace("text", F.lit("<"), F.lit(" ")), F.lit("</description><itunes:owner><itunes:email>o"), k, F.lit("@x.example</itunes:email></itunes:owner></channel></rss>"))
    return feed_heads(table(spark, sf_dir, "documents").select(F.concat(F.lit("feed:"), k).alias("url"), xml.cast("binary").alias("content")), 2000)


@query("s09_allowed_contact_pages", """
SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1) ORDER BY page_id) AS rn, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages)
WHERE rn <= 3 AND host IN (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) FROM pages WHERE page_id % 2 = 0)""")
def allowed_contact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    allowed = p.filter("page_id % 2 = 0").select("host").distinct()
    return first_of_host(p, 3).join(allowed, "host", "left_semi").select("page_id", "url")


def first_of_host(pages: DataFrame, most: int) -> DataFrame:
    from pyspark.sql import Window

    return pages.withColumn("rn", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).filter(F.col("rn") <= most)


@query("s18_breakdown_shares", "SELECT event_type AS dimension, user_id % 5 AS bucket, sum(value) / sum(sum(value)) OVER (PARTITION BY event_type) AS share FROM events GROUP BY event_type, user_id % 5")
def breakdown_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    sums = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("dimension"), (F.col("user_id") % 5).alias("bucket")).agg(F.sum("value").alias("v"))
    return sums.select("dimension", "bucket", (F.col("v") / F.sum("v").over(Window.partitionBy("dimension"))).alias("share"))


@query("s20_enabled_sources", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 3)")
def enabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    enabled = table(spark, sf_dir, "nation").filter("n_regionkey IN (1, 3)")
    return table(spark, sf_dir, "customer").join(F.broadcast(enabled), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")  # the 25 nations


def directory(customers: DataFrame, name: str | None = None, segment: str | None = None, searchable: bool | None = None) -> DataFrame:
    """Conjunctive filters, each only if given; ``searchable`` has three states."""
    if name:
        customers = customers.filter(F.col("c_name").ilike(f"%{name}%"))
    if segment:
        customers = customers.filter(F.col("c_mktsegment") == segment)
    if searchable is not None:
        customers = customers.filter((F.col("c_acctbal") > 0) == F.lit(searchable))
    return customers


@query("f01_dynamic_directory", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%customer%1%' AND c_mktsegment = 'BUILDING' AND (c_acctbal > 0) = TRUE")
def dynamic_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory(table(spark, sf_dir, "customer"), "customer%1", "BUILDING", True).select("c_custkey", "c_name", "c_mktsegment")


@query("f02_substring_two_columns", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%' OR p_type ILIKE '%RED%'")
def substring_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_name").ilike("%RED%") | F.col("p_type").ilike("%RED%")).select("p_partkey")


@query("f03_prefix_shard", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'b%' ORDER BY p_name, p_partkey LIMIT 50")
def prefix_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_name").startswith("b")).orderBy("p_name", "p_partkey").limit(50).select("p_partkey", "p_name")


@query("f04_membership", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 5, 9, 33)")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_custkey").isin(1, 5, 9, 33)).select("o_orderkey")


@query("f05_not_closed", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def not_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(~F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")


@query("f06_superseded_excluded", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id - 3 FROM events WHERE event_id % 4 = 0 AND event_id IS NOT NULL)")
def superseded_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    return e.join(e.filter("event_id % 4 = 0").select((F.col("event_id") - 3).alias("event_id")), "event_id", "left_anti")


@query("f07_rolling_window", "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def rolling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("ts") > as_of() - F.expr("INTERVAL 7 DAY")).select("event_id", "event_type")


@query("f08_month_to_date", "SELECT o_orderkey FROM orders WHERE o_orderdate >= date_trunc('month', TIMESTAMP '1998-05-17') AND o_orderdate <= TIMESTAMP '1998-05-17'")
def month_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("1998-05-17").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= F.date_trunc("month", at).cast("timestamp_ntz")) & (F.col("o_orderdate") <= at)).select("o_orderkey")


@query("f09_usable_routes", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND (o_orderstatus <> 'P' OR o_orderpriority = '1-URGENT')")
def usable_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.col("o_orderstatus").isin("O", "P")
    inferred, verified = F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "1-URGENT"
    return table(spark, sf_dir, "orders").filter(allowed & (~inferred | verified)).select("o_orderkey")


@query("f10_case_projection", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'no code' ELSE 'C' || CAST(o_orderkey AS VARCHAR) END AS code FROM orders")
def case_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("C"), F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(code == "", "no code").otherwise(code).alias("code"))


@query("f11_priority_class", "SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'gold' WHEN c_mktsegment = 'MACHINERY' THEN 'industry' WHEN c_acctbal < 0 THEN 'debt' ELSE 'other' END AS platform FROM customer")
def priority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("c_acctbal") > 9000, "gold").when(F.col("c_mktsegment") == "MACHINERY", "industry").when(F.col("c_acctbal") < 0, "debt").otherwise("other")
    return table(spark, sf_dir, "customer").select("c_custkey", first.alias("platform"))


@query("f12_region_map", "SELECT n_name, CASE WHEN n_regionkey IN (0, 4) THEN 'emea' WHEN n_regionkey = 1 THEN 'us' WHEN n_regionkey = 2 THEN 'apac' ELSE 'eu' END AS home FROM nation")
def region_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    homes = F.create_map(*[F.lit(x) for kv in {0: "emea", 4: "emea", 1: "us", 2: "apac"}.items() for x in kv])
    return table(spark, sf_dir, "nation").select("n_name", F.coalesce(F.element_at(homes, F.col("n_regionkey")), F.lit("eu")).alias("home"))


@query("f13_fallback_target", "SELECT s_suppkey, coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END, ''), 'supplier:' || CAST(s_suppkey AS VARCHAR)) AS target FROM supplier")
def fallback_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(F.nullif(given, F.lit("")), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string"))).alias("target"))


@query("f14_boolean_column", "SELECT vec_id, (CASE WHEN vec_id % 3 = 0 THEN NULL ELSE embedding END) IS NOT NULL AS searchable FROM embeddings")
def boolean_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, None).otherwise(F.col("embedding")).isNotNull().alias("searchable"))


@query("f15_liveness", """SELECT event_id FROM events WHERE event_type <> 'error' AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 0
AND (CASE WHEN event_id % 5 = 0 THEN NULL ELSE 100 + event_id % 500 END IS NULL OR CASE WHEN event_id % 5 = 0 THEN NULL ELSE 100 + event_id % 500 END BETWEEN 200 AND 399)""")
def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 5 != 0, 100 + F.col("event_id") % 500)
    return table(spark, sf_dir, "events").filter((F.col("event_type") != "error") & (prop() > 0) & (status.isNull() | status.between(200, 399))).select("event_id")


@query("f16_pitchable", "SELECT p_partkey FROM part WHERE (p_size BETWEEN 1 AND 20 AND p_type LIKE '%STEEL%') OR (p_size > 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13'))")
def pitchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.col("p_size").between(1, 20), F.col("p_size") > 20
    return table(spark, sf_dir, "part").filter((low & F.col("p_type").contains("STEEL")) | (high & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"))).select("p_partkey")


@query("l01_newest", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts")


@query("l02_boolean_first", "SELECT o_orderkey FROM orders ORDER BY (o_orderstatus = 'O') DESC, o_totalprice DESC, o_orderkey LIMIT 25")
def boolean_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy((F.col("o_orderstatus") == "O").desc(), F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey")


@query("l03_nulls_last", "SELECT c_custkey, last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY 1) ON c_custkey = o_custkey ORDER BY last_order DESC NULLS LAST, c_custkey LIMIT 40")
def nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").orderBy(F.desc_nulls_last("last_order"), "c_custkey").limit(40).select("c_custkey", "last_order")


@query("l04_tie_break", "SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name ORDER BY n DESC, c_name, c_custkey LIMIT 30")
def tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.orderBy(F.desc("n"), "c_name", "c_custkey").limit(30)


@query("l05_lexicographic", "SELECT p_partkey FROM part ORDER BY p_size DESC, p_retailprice ASC, p_partkey LIMIT 15")
def lexicographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy(F.desc("p_size"), "p_retailprice", "p_partkey").limit(15).select("p_partkey")
