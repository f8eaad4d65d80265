"""Writes with the semantics of the operators' DML: append, upsert by key, replace of partitions, once-only sends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenfold.functions.rows import table
from wrenfold.registry import query
from wrenfold.sources.folders import work_folder
from wrenfold.sources.manifest import commit_table, manifest, read_table


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The full next state: rows of ``new`` win, of several for a key the last by ``_order`` if there is such a column."""
    order = F.desc("_order") if "_order" in new.columns else F.lit(1)
    last = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_rn = 1").drop("_rn", "_order")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Only partitions that come anew are overwritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def report(df: DataFrame, path: str, kind: str = "csv") -> None:
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def upsert_table(path: str, new: DataFrame, keys: list[str], batch: str) -> int:
    """``new`` merged into a manifest table as one batch: done once, and refused if another writer was faster."""
    base = manifest(path)["version"]
    state = upsert(read_table(new.sparkSession, path), new, keys) if base else new
    return commit_table(state, path, batch, overwrite=True, base=base)


@query("k12_manifest_upsert", """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderdate >= TIMESTAMP '1996-07-01' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders""")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load, an upsert that changes some rows and adds others, and the same batch once more with other rows, which writes nothing; read back."""
    path = work_folder(spark, "orders-table")
    orders = table(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    later = orders.filter("o_orderdate >= TIMESTAMP_NTZ '1996-07-01 00:00:00'").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    commit_table(orders.filter("o_orderdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'").select(rows.columns), path, "load")
    upsert_table(path, later, ["o_orderkey"], "day-2")
    upsert_table(path, rows.withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"], "day-2")
    return read_table(spark, path)
