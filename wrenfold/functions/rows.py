"""Small building blocks that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The instant that rolling windows look back from; queries are deterministic, so never now().
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def through_python(rows: DataFrame, schema: str, work: Callable[..., Iterable[tuple]], most: int = 4096) -> DataFrame:
    """The rows that ``work`` gives for each row (its columns as arguments), taken one by one and sent on by ``most``: what a task holds beside its Arrow batch depends neither on the rows nor on what they grow to."""
    columns, fields = rows.columns, to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (out for batch in batches for k in range(batch.num_rows) for out in work(*(batch.column(c)[k].as_py() for c in columns)))
        while part := list(islice(found, most)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(zip(*part, strict=True), fields, strict=True)], fields.names)

    return rows.mapInArrow(run, schema)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def money(column: Column, scale: int = 6) -> Column:
    """A double as an exact amount."""
    return column.cast(f"decimal(18,{scale})")


def prop(column: str = "props") -> Column:
    """The one number that ``events.props`` carries."""
    return F.get_json_object(column, "$.k").cast("long")


def in_buckets(v: DataFrame, key: str, most: int) -> DataFrame:
    """Values (key, _v) with their number of a key (_n) and their bucket of equal width (_b): as many as the root of that number, ``most`` at most."""
    stats = v.groupBy(key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    k = F.least(F.lit(most), F.ceil(F.sqrt("_n"))).cast("int")
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(k - 1, F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * k))).otherwise(0)
    return v.join(stats, key).withColumn("_b", place)


def exact_quantile(df: DataFrame, key: str, value: str, q: float, name: str, buckets: int = 4096) -> DataFrame:
    """(key, name): the interpolated quantile of each key, without gathering a key's values in one task.

    Values are counted in equal-width buckets per key, as many as the square root of its values and ``buckets`` at
    most, so that counts are few beside the values; only the buckets that hold the wanted ranks are looked into, and
    there equal values are counted first.
    """
    v = df.select(key, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    placed = in_buckets(v, key, buckets)
    w = Window.partitionBy(key)
    counts = placed.groupBy(key, "_b", "_n").agg(F.count(F.lit(1)).alias("_c"))  # at most the root of its values per key, and ``buckets``
    counts = counts.withColumn("_before", F.sum("_c").over(w.orderBy("_b")) - F.col("_c")).withColumn("_r", F.lit(q) * (F.col("_n") - 1))
    wanted = counts.filter("_before <= ceil(_r) AND _before + _c > floor(_r)").select(key, "_b", "_before", "_r")
    near = placed.join(wanted, [key, "_b"]).groupBy(key, "_r", "_v").agg(F.min("_before").alias("_before"), F.count(F.lit(1)).alias("_c"))
    near = near.withColumn("_end", F.min("_before").over(w) + F.sum("_c").over(w.orderBy("_v")))
    at = lambda r: F.min(F.when(F.col("_end") > r, F.col("_v")))
    found = near.groupBy(key, "_r").agg(at(F.floor("_r")).alias("_a"), at(F.ceil("_r")).alias("_z"))
    # low * (1 - part) + high * part with its first product unrounded, as DuckDB has it: a threshold that a value just meets would else fall on its other side
    part, fused = F.col("_r") - F.floor("_r"), lambda x, y, z: F.reflect(F.lit("java.lang.Math"), F.lit("fma"), x, y, z).cast("double")
    return found.select(key, fused(F.col("_a"), 1 - part, F.col("_z") * part).alias(name))
