"""Integrity rules (C) as queries that return the rows at fault: none is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.functions.rows import table
from wrenfold.registry import query


def duplicates(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys that more than one row has (a unique index, partial if ``where`` is given)."""
    rows = df.filter(where) if where is not None else df
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def violations(df: DataFrame, rule: str, holds: Column, key: str) -> DataFrame:
    """Rows that break a check; a check of unknown outcome holds, as in SQL."""
    return df.filter(~F.coalesce(holds, F.lit(True))).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("row_key"))


@query("c01_one_live_fact", "SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY 1, 2, 3 HAVING count(*) > 1")
def one_live_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority", "o_orderstatus"], F.col("o_totalprice") > 150000)


@query("c02_row_checks", """SELECT 'status' AS rule, CAST(o_orderkey AS VARCHAR) AS row_key FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'share', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.09)
UNION ALL SELECT 'alpha', CAST(n_nationkey AS VARCHAR) FROM nation WHERE NOT regexp_full_match(n_name, '[A-Z]{2,12}') UNION ALL SELECT 'reference', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    a = violations(t("orders"), "status", F.col("o_orderstatus").isin("O", "F"), "o_orderkey")
    b = violations(t("lineitem"), "share", F.col("l_discount").between(0, 0.09), "l_orderkey")
    c = violations(t("nation"), "alpha", F.col("n_name").rlike("^[A-Z]{2,12}$"), "n_nationkey")
    d = t("labels").join(t("documents").select("doc_id"), "doc_id", "left_anti").select(F.lit("reference").alias("rule"), F.col("doc_id").cast("string").alias("row_key"))
    return a.union(b).union(c).union(d)


@query("c07_one_open_thread", "SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'system' GROUP BY 1 HAVING count(*) > 1")
def one_open_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "conversations"), ["conv_id"], F.col("role") == "system")


# name -> (rule, table, what must hold in SQL, key): the surrogates stand for the relations named in the rule.
CHECKS = {
    "c03_embedding_has_model": ("embedding present => model present", "embeddings", "label IS NOT NULL OR vec_id < 0", "vec_id"),
    "c04_no_self_supersession": ("a row never supersedes itself", "events", "event_id <> event_id - event_id % 4", "event_id"),
    "c05_scope_shape": ("either scope is set as its kind asks", "orders", "(o_orderstatus = 'O' AND o_totalprice > 0) OR (o_orderstatus <> 'O' AND o_custkey IS NOT NULL)", "o_orderkey"),
    "c09_all_or_nothing": ("a decision has all three parts or none", "events", "(event_id % 10 < 9) = (value >= 0) AND (user_id > 0)", "event_id"),
    "c11_alias_target": ("an alias has a target, nothing else has", "documents", "(doc_id % 10 BETWEEN 1 AND 3) = (doc_id - doc_id % 10 <> doc_id AND doc_id % 10 < 4)", "doc_id"),
    "c12_direction": ("the time of a message fits its direction", "conversations", "role IN ('user', 'assistant') OR turn = 0", "conv_id"),
    "c13_stored_asset": ("stored <=> has bytes", "documents", "(n_chars > 0) = (length(text) > 0)", "doc_id"),
    "c14_share": ("a share is in [0, 1]", "lineitem", "l_discount BETWEEN 0 AND 0.05", "l_orderkey"),
    "c15_budget": ("allocated <= ceiling", "customer", "c_acctbal <= 9500", "c_custkey"),
    "c16_valence": ("quality and toxicity are 0 or 1", "labels", "quality IN (0, 1) AND toxic IN (0, 1)", "doc_id"),
    "c17_shape": ("a name has its shape", "part", "p_brand LIKE 'Brand#__'", "p_partkey"),
}


def _register(name: str, rule: str, source: str, holds: str, key: str) -> None:
    @query(name, f"SELECT '{rule}' AS rule, CAST({key} AS VARCHAR) AS row_key FROM {source} WHERE NOT ({holds})")
    def check(spark: SparkSession, sf_dir: str) -> DataFrame:
        return violations(table(spark, sf_dir, source), rule, F.expr(holds), key)


for _name, _check in CHECKS.items():
    _register(_name, *_check)

# name -> (table, key columns that are unique, partial condition).
UNIQUE = {
    "c06_lead_target": ("events", ["user_id", "event_type"], None),
    "c08_one_outbox_row": ("orders", ["o_orderkey"], None),
    "c10_one_metric": ("lineitem", ["l_partkey", "l_suppkey", "l_shipdate"], None),
    "c18_one_presence": ("pages", ["url"], "page_id > 0"),
}


def _register_unique(name: str, source: str, keys: list[str], where: str | None) -> None:
    cols = ", ".join(keys)

    @query(name, f"SELECT {cols}, count(*) AS n FROM {source} WHERE {where or 'TRUE'} GROUP BY {cols} HAVING count(*) > 1")
    def check(spark: SparkSession, sf_dir: str) -> DataFrame:
        return duplicates(table(spark, sf_dir, source), keys, F.expr(where) if where else None)


for _name, _unique in UNIQUE.items():
    _register_unique(_name, *_unique)
