"""Plans that are proved to read one tenant only, and broken ones that are refused."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import DATA
from wrenfold import registry
from wrenfold.functions.rows import table
from wrenfold.plans import guards
from wrenfold.plans.guards import Unscoped
from wrenfold.plans.scope import prove_plan

COLUMNS = {"orders": "o_custkey", "customer": "c_custkey", "events": "user_id"}


def plans(spark) -> dict:  # noqa: ANN001
    o, c, e, n = (table(spark, DATA, t) for t in ("orders", "customer", "events", "nation"))
    mine, own, link = F.col("o_custkey") == 7, F.col("c_custkey") == 7, F.col("o_custkey") == F.col("c_custkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return {
        "filter": (o.filter(mine), True),
        "filter under all": (o.filter(mine).orderBy("o_orderkey").limit(3).groupBy().count(), True),
        "renamed": (o.select(F.col("o_custkey").alias("t"), "o_orderkey").select(F.col("t").alias("u")).filter("u = 7"), True),
        "cast": (o.filter(F.col("o_custkey").cast("string") == "7"), True),
        "grouped by it": (o.groupBy("o_custkey").count().filter(mine), True),
        "window by it": (o.withColumn("rn", F.row_number().over(w)).filter(mine & (F.col("rn") == 1)), True),
        "join passes it on": (o.join(c, link).filter(own), True),
        "join of both": (o.filter(mine).join(c.filter(own), F.lit(True)), True),
        "left join": (c.filter(own).join(o, link, "left"), True),
        "semi join": (c.filter(own).join(o, link, "left_semi"), True),
        "shared table": (c.filter(own).join(n, F.col("c_nationkey") == F.col("n_nationkey")), True),
        "union": (o.select("o_custkey").union(c.select("c_custkey")).filter(mine), True),
        "batches below": (o.filter(mine).select("o_orderkey").mapInPandas(lambda it: it, "o_orderkey long"), True),
        "self join": (o.filter(mine).alias("a").join(o.filter(mine).alias("b"), "o_orderkey"), True),
        "no filter": (o, False),
        "another": (o.filter("o_custkey = 8"), False),
        "or": (o.filter("o_custkey = 7 OR o_orderkey = 1"), False),
        "not": (o.filter("NOT o_custkey = 7"), False),
        "other column": (o.filter("o_orderkey = 7"), False),
        "computed": (o.filter("coalesce(o_custkey, 7) = 7"), False),
        "overwritten": (o.withColumn("o_custkey", F.lit(7)).filter(mine), False),
        "limit before": (o.orderBy("o_orderkey").limit(3).filter(mine), False),
        "count before": (o.groupBy("o_orderstatus").agg(F.max("o_custkey").alias("o_custkey")).filter(mine), False),
        "window over all": (o.withColumn("rn", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderkey"))).filter(mine), False),
        "join without": (o.filter(mine).join(c, F.col("o_orderkey") == F.col("c_custkey")), False),
        "wrong side": (c.join(o.filter(mine), link & own, "left"), False),
        "outer both": (c.join(o, link & own & mine, "full"), False),
        "anti": (c.join(o.filter(mine), link, "left_anti"), False),
        "half a union": (o.filter(mine).select("o_custkey").union(c.select("c_custkey")), False),
        "union with another column": (o.select("o_custkey").union(c.select("c_nationkey")).filter(mine), False),
        "batches above": (o.mapInPandas(lambda it: it, o.schema).filter(mine), False),
        "unknown table": (table(spark, DATA, "part").filter("p_partkey = 7"), False),
        "no table": (spark.range(3), False),
    }


def test_plans(spark):  # noqa: ANN001, ANN201
    for name, (df, ok) in plans(spark).items():
        try:
            proved = prove_plan(df, 7, COLUMNS, {"nation"}) != []
        except Unscoped:
            proved = False
        assert proved == ok, name
    left = plans(spark)["shared table"][0]
    with pytest.raises(Unscoped, match="nation"):
        prove_plan(left, 7, COLUMNS)


def test_statements(spark):  # noqa: ANN001, ANN201
    for name in ("orders", "customer"):
        table(spark, DATA, name).createOrReplaceTempView(name)
    ok = "SELECT * FROM orders o WHERE o_custkey = 7 AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = 7 AND c.c_name <> o.o_orderstatus)"
    assert sorted(prove_plan(spark.sql(ok), 7, COLUMNS)) == ["customer", "orders"]
    for bad in (ok.replace("c.c_custkey = 7 AND ", ""), "SELECT * FROM orders WHERE o_custkey = 7 AND o_totalprice > (SELECT avg(c_acctbal) FROM customer)", "WITH x AS (SELECT * FROM orders) SELECT count(*) FROM x"):
        with pytest.raises(Unscoped):
            prove_plan(spark.sql(bad), 7, COLUMNS)


def test_the_librarys_tenant_queries(spark):  # noqa: ANN001, ANN201
    """Every query of the library that answers for one tenant is proved by its plan."""
    queries = registry.queries()
    assert prove_plan(queries["s01_tenant_newest"](spark, DATA), 7, COLUMNS) == ["orders"]
    for name in (q for q in queries if q.startswith("g03_")):
        assert set(prove_plan(queries[name](spark, DATA), 7, guards.TENANTS)) <= {"orders", "customer", "events"}, name
        with pytest.raises(Unscoped):
            prove_plan(queries[name](spark, DATA), 8, guards.TENANTS)
