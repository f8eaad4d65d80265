"""The cost model (B): tiers, their measured drivers and what these cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.functions.rows import table
from wrenfold.registry import query

# Dollars per unit, and counts per edit.
TEXT_PER_MTOK, TEXT_BATCH_PER_MTOK, IMAGE_EACH = 0.02, 0.01, 0.00006
STILL_EACH, STILLS_AN_EDIT, CAST_AN_EDIT, EMBED_TOKENS = 0.04, 22, 2, 64
JUDGE_EACH = 2000 / 1e6 * 0.30 + 300 / 1e6 * 2.50
OPS_AN_ATTEMPT, OPS_AN_EDIT, FREE_UNITS = 5, 20, 50_000_000
_TIERS = """(SELECT c_mktsegment AS tier, count(DISTINCT c_custkey) AS clips, count(*) AS edits, sum(n)::DOUBLE / count(*) AS attempts FROM customer JOIN orders ON o_custkey = c_custkey JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1)"""


def edits_with_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, attempts): orders as edits, their lines as the attempts that they took."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("attempts"))


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drivers of each tier, as measured: customers of a segment, their edits, and attempts an edit."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(edits_with_attempts(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    mine = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("edits"), F.sum("attempts").alias("tries"))
    rows = table(spark, sf_dir, "customer").join(mine, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("tier"))
    return rows.agg(F.count(F.lit(1)).alias("clips"), F.sum("edits").alias("edits"), (F.sum("tries").cast("double") / F.sum("edits")).alias("attempts"))


def monthly(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("stills", F.col("edits") * STILLS_AN_EDIT).withColumn("tries", F.col("stills") * F.col("attempts"))
    rows = rows.withColumn("ops", F.col("tries") * OPS_AN_ATTEMPT + F.col("edits") * OPS_AN_EDIT)
    return rows.withColumn("generation", F.col("tries") * STILL_EACH).withColumn("judging", F.col("tries") * CAST_AN_EDIT * JUDGE_EACH).withColumn("embedding", F.col("tries") * (2 * EMBED_TOKENS / 1e6 * TEXT_PER_MTOK + IMAGE_EACH))


_M = f"SELECT tier, clips, edits, attempts, edits * {STILLS_AN_EDIT} AS stills, edits * {STILLS_AN_EDIT} * attempts AS tries FROM {_TIERS}"
_M2 = f"SELECT *, tries * {OPS_AN_ATTEMPT} + edits * {OPS_AN_EDIT} AS ops, tries * {STILL_EACH}::DOUBLE AS generation, tries * {CAST_AN_EDIT} * {JUDGE_EACH}::DOUBLE AS judging, tries * {2 * EMBED_TOKENS / 1e6 * TEXT_PER_MTOK + IMAGE_EACH!r}::DOUBLE AS embedding FROM ({_M})"


@query("b01_tier_month", f"SELECT tier, stills, round(tries, 6) AS tries, round(ops, 6) AS ops, round({FREE_UNITS} / ops, 2) AS break_even, round(generation, 6) AS generation, round(judging, 6) AS judging, round(embedding, 6) AS embedding FROM ({_M2})")
def tier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return monthly(tiers(spark, sf_dir)).select("tier", "stills", r("tries"), r("ops"), F.round(FREE_UNITS / F.col("ops"), 2).alias("break_even"), r("generation"), r("judging"), r("embedding"))


@query("b02_attempt_curve", f"SELECT n AS attempts, count(*) AS edits, round({STILLS_AN_EDIT} * n * ({STILL_EACH}::DOUBLE + {CAST_AN_EDIT} * {JUDGE_EACH}::DOUBLE), 6) AS cost FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def attempt_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edit costs by the attempts that it took, and how many took so many."""
    cost = STILLS_AN_EDIT * F.col("attempts") * (STILL_EACH + CAST_AN_EDIT * JUDGE_EACH)
    return edits_with_attempts(spark, sf_dir).groupBy("attempts").agg(F.count(F.lit(1)).alias("edits")).select("attempts", "edits", F.round(cost, 6).alias("cost"))


@query("b03_line_items", f"SELECT tier, item, round(amount, 6) AS amount FROM (SELECT tier, generation, judging, embedding FROM ({_M2})) UNPIVOT (amount FOR item IN (generation, judging, embedding))")
def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(tiers(spark, sf_dir)).unpivot("tier", ["generation", "judging", "embedding"], "item", "amount").withColumn("amount", F.round("amount", 6))
