"""Paged JSON as a Spark data source: one input partition per page, so pages are read in parallel and again if a task is lost.

    paged.register(spark)
    spark.read.format("paged_json").schema(...).option("template", "https://host/items?key={key}&offset={offset}&limit={limit}")
        .option("counts", "https://host/keys").option("key", "country").load().filter("country = 'NZ'")

``counts`` names a page that is asked for first: a list of {key, count}.  Pages are planned from what it says, so a key
that grows loses nothing to a fixed number of pages; a filter on the key column (= or IN) leaves only the pages of these keys to
be read.  Without ``counts``, ``total`` says how many items there are.  A template may also be a ``file:`` URL that
executors share (a landing zone).
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Iterable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from wrenfold.functions.rows import table
from wrenfold.registry import query
from wrenfold.sources.folders import work_folder
from wrenfold.sources.manifest import local


class Page(InputPartition):
    def __init__(self, key: str | None, offset: int) -> None:
        super().__init__((key, offset))


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> PageReader:  # noqa: ANN001
        return (KeyedPageReader if "key" in self.options else PageReader)(dict(self.options), [f.name for f in schema.fields])


def _json(url: str) -> list | dict:
    with urllib.request.urlopen(url, timeout=60) as page:  # noqa: S310
        return json.load(page)


class PageReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.options, self.names = options, names
        self.template, self.limit, self.key = options["template"], int(options.get("limit", 500)), options.get("key")
        self.wanted: set[str] | None = None

    def partitions(self) -> list[Page]:
        if "counts" not in self.options:
            return [Page(None, o) for o in range(0, int(self.options["total"]), self.limit)]
        counts = {str(c["key"]): int(c["count"]) for c in _json(self.options["counts"])}
        return [Page(k, o) for k, n in counts.items() if self.wanted is None or k in self.wanted for o in range(0, n, self.limit)]

    def read(self, partition: Page) -> Iterator[tuple]:
        key, offset = partition.value
        for item in _json(self.template.format(key=quote(key or ""), offset=offset, limit=self.limit)):
            yield (json.dumps(item),) if self.names == ["value"] else tuple(item.get(n) for n in self.names)


class KeyedPageReader(PageReader):
    """Takes filters, which Spark offers only if ``spark.sql.python.filterPushdown.enabled`` is set (``register`` does)."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Keys that a filter asks for; all filters are left to Spark, too."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.key,):
                asked = {str(v) for v in (f.value if isinstance(f, In) else [f.value])}
                self.wanted = asked if self.wanted is None else self.wanted & asked
            yield f


def register(spark: SparkSession) -> None:
    """The source, with filters that reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)


def land_pages(rows: DataFrame, key: str, order: str, path: str, limit: int) -> None:
    """``rows`` as a paged service would give them: ``<key>-<offset>.json`` of ``limit`` items, and ``counts.json``."""
    folder = local(path)
    os.makedirs(folder, exist_ok=True)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    pages = rows.withColumn("_nth", nth).groupBy(F.col(key).cast("string").alias("key"), F.expr(f"_nth div {limit} * {limit}").alias("offset"))
    pages = pages.agg(F.array_sort(F.collect_list(F.struct("_nth", F.to_json(F.struct(*rows.columns)).alias("json")))).alias("items"))  # at most ``limit`` items

    def work(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for k, offset, items in zip(pdf["key"], pdf["offset"], pdf["items"], strict=True):
                draft = os.path.join(folder, f".{os.urandom(8).hex()}")
                with open(draft, "w", encoding="utf-8") as out:
                    out.write("[" + ",".join(i["json"] for i in items) + "]")
                os.replace(draft, os.path.join(folder, f"{k}-{offset}.json"))
            yield pdf[["key"]].assign(n=pdf["items"].map(len))

    counts = pages.mapInPandas(work, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()  # a row per key, as the count page has
    with open(os.path.join(folder, "counts.json"), "w") as out:
        json.dump([{"key": r.key, "count": r.n} for r in sorted(counts)], out)


def read_pages(spark: SparkSession, path: str, schema: str, key: str, limit: int) -> DataFrame:
    register(spark)
    at = f"file://{local(path)}"
    return spark.read.format("paged_json").schema(schema).option("template", at + "/{key}-{offset}.json").option("counts", f"{at}/counts.json").option("key", key).option("limit", limit).load()


_STATIONS = "c_nationkey long, c_custkey long, c_name string, c_acctbal double"


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "pages")
    land_pages(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", "c_acctbal"), "c_nationkey", "c_custkey", path, 200)
    return read_pages(spark, path, _STATIONS, "c_nationkey", 200)


@query("s04_paged_all", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey, c_name, c_acctbal FROM customer")
def paged_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, landed as pages by nation and read back through the count page."""
    return _stations(spark, sf_dir)


@query("s04_paged_keys", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (3, 7) AND c_acctbal > 0")
def paged_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nations' customers: no page of another nation is asked for."""
    return _stations(spark, sf_dir).filter("c_nationkey IN (3, 7) AND c_acctbal > 0").select("c_custkey", "c_name")
