"""Tables between stages, in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; one is set only where none is and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="wrenfold-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def spent(spark: SparkSession) -> Iterator[list[str]]:
    """Tables stored inside are deleted at the end, but for those that the caller takes off the list: their readers have run by then."""
    mine: list[str] = []
    _open.append(mine)
    try:
        yield mine
    finally:
        _open.pop()
        discard(spark, mine)


def spend_later(path: str) -> None:
    """A table that is spent with all others of the innermost ``spent`` block, if there is one."""
    if _open:
        _open[-1].append(path)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """The UTF-8 bytes of all texts; it only sizes shards, never results."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def carried(docs: DataFrame, work: Callable[[DataFrame], DataFrame], own: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``work(docs)``, which returns the columns of ``docs``, with all columns but ``own`` under plain names of their place meanwhile: theirs may hold dots or any other signs."""
    names, taken = docs.columns, {}
    for name in own:  # as it is spelt, else in another case
        found = [k for k, c in enumerate(names) if c == name] or [k for k, c in enumerate(names) if c.lower() == name]
        taken |= {k: name for k in found[:1]}
    return work(docs.toDF(*[taken.get(k, f"carried_{k}") for k in range(len(names))])).toDF(*names)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores before it until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base
