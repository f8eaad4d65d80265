"""Connected components by alternating large-star and small-star steps.

Each step is a group-by and a join on nodes; tables between steps lie in the shared folder, and only a
count and a checksum reach the driver.

Cases: links to oneself and repeated or reversed links count once; a null end makes no link; no links, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenfold.llm.storage import spend_later, spent, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of the undirected links (two long columns): the least node of its component.  No links give no rows."""
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()  # drops null ends
    edges, state, path = _kept(edges)
    while state[0]:
        # large star: larger neighbours of a node point to the least one around it
        both = edges.union(edges.select("lo", "hi")).toDF("node", "near")
        least = both.groupBy("node").agg(F.min("near").alias("m")).withColumn("m", F.least("node", "m"))
        large = both.filter("near > node").join(least, "node").select(F.col("near").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        # small star: a node and its smaller neighbours point to the least of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").union(low).distinct()
        edges, now, path = _kept(small, path)
        if now == state:
            break
        state = now
    spend_later(path)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(edges.select("lo", "lo").distinct())


def _kept(edges: DataFrame, before: str | None = None) -> tuple[DataFrame, tuple, str]:
    """The edges as a table, their number and checksum, and its place; the table ``before`` it has been read and goes."""
    with spent(edges.sparkSession) as tables:
        edges = stored(edges, "components")
        path = tables.pop()
        if before:
            tables.append(before)
    return edges, tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()), path
