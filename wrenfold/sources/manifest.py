"""A table whose state is a manifest: writes by tasks count only when the driver has published them, once per batch.

    spark.dataSource.register(ManifestTable)
    df.write.format("manifest_table").mode("append").option("path", folder).option("batch", "2024-01-15").save()
    read_table(spark, folder)

Tasks write Parquet files under a folder of their write and report them; the driver's commit publishes the next
manifest (all files of the table, or only the new ones for an overwrite) under a name that can be taken only once.  A
failed write leaves the old manifest and takes its files away (what a killed task leaves goes with the next commit); a batch that is already in the table adds nothing; an
append that loses a race is built on the winner's manifest, an overwrite with ``base`` (the version it has read)
is refused.  The same sink takes streams: the batch is then the stream's name (``stream``) and the micro-batch.

The folder must be mounted alike on the driver and all executors (``file:`` or a plain path).
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """The table is no longer in the version that an overwrite was made from."""


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


def local(path: str) -> str:
    if path.startswith("file:"):
        path = path.removeprefix("file:")
        return "/" + path.lstrip("/")
    if "://" in path:
        raise ValueError(f"not a mounted folder: {path}")
    return path


def versions(path: str) -> list[int]:
    folder = os.path.join(local(path), "manifests")
    return sorted(int(n.removesuffix(".json")) for n in os.listdir(folder) if n.endswith(".json") and not n.startswith(".")) if os.path.isdir(folder) else []


def manifest(path: str, version: int | None = None) -> dict:
    """The manifest of a version, else of the newest; an empty one where nothing was published."""
    known = versions(path)
    if not known:
        return {"version": 0, "batch": None, "files": [], "rows": 0}
    with open(_place(path, version or known[-1])) as f:
        return json.load(f)


def _place(path: str, version: int) -> str:
    return os.path.join(local(path), "manifests", f"{version:08d}.json")


def _mark(path: str, batch: str) -> str:
    return os.path.join(local(path), "batches", quote(batch, safe=""))


def _touch(mark: str) -> None:
    os.makedirs(os.path.dirname(mark), exist_ok=True)
    with open(mark, "w"):
        pass


def has_batch(path: str, batch: str) -> bool:
    """Whether a batch was published.  Marks are set after publishing, so the newest manifests are looked at back to one whose mark is there; lost marks are set again."""
    if os.path.exists(_mark(path, batch)):
        return True
    for version in reversed(versions(path)):
        own = manifest(path, version)["batch"]
        if os.path.exists(_mark(path, own)):
            return False
        _touch(_mark(path, own))
        if own == batch:
            return True
    return False


def publish(path: str, batch: str, files: list[str], rows: int, schema: str, overwrite: bool, base: int | None) -> bool:
    """The next manifest; False where the batch is there already."""
    while True:
        if has_batch(path, batch):
            return False
        now = manifest(path)
        if overwrite and base is not None and now["version"] != base:
            raise Conflict(f"version {now['version']}, not {base}")
        after = {"version": now["version"] + 1, "batch": batch, "schema": json.loads(schema), "files": files if overwrite else now["files"] + files, "rows": rows if overwrite else now["rows"] + rows}
        place = _place(path, after["version"])
        os.makedirs(os.path.dirname(place), exist_ok=True)
        draft = os.path.join(os.path.dirname(place), f".{uuid.uuid4().hex}")
        with open(draft, "w") as f:
            json.dump(after, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, place)  # fails where another writer took this version
        except FileExistsError:
            continue
        finally:
            os.unlink(draft)
        _touch(_mark(path, batch))
        return True


def sweep(path: str) -> None:
    """What tasks left behind that were killed after their write was given up; each commit does this."""
    folder = os.path.join(local(path), "given-up")
    for write_id in os.listdir(folder) if os.path.isdir(folder) else ():
        shutil.rmtree(os.path.join(local(path), "data", write_id), ignore_errors=True)


class _Writer:
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.overwrite, self.schema = options["path"], overwrite, schema.json()
        self.write_id, self.base = uuid.uuid4().hex, int(options["base"]) if "base" in options else None

    def _folder(self) -> str:
        return os.path.join("data", self.write_id)

    def _ended(self) -> str:
        """The mark of a write that was given up: tasks that go on after it take their files away."""
        return os.path.join(local(self.path), "given-up", self.write_id)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        writer, rows = None, 0
        task = TaskContext.get()
        name = os.path.join(self._folder(), f"part-{task.partitionId():05d}-{task.taskAttemptId()}.parquet")
        place = os.path.join(local(self.path), name)
        try:
            for batch in iterator:
                if writer is None:
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    writer = pq.ParquetWriter(place, batch.schema, compression="zstd")
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
                if os.path.exists(self._ended()):
                    os.unlink(place)
        return Written(name if writer is not None else None, rows)

    def _commit(self, messages: list[Written | None], batch: str) -> None:
        told = [m for m in messages if m and m.file]
        try:
            done = publish(self.path, batch, [m.file for m in told], sum(m.rows for m in told), self.schema, self.overwrite, self.base)
        except Conflict:
            self._drop()
            raise
        if not done:
            self._drop()
            return
        sweep(self.path)
        kept = {os.path.basename(m.file) for m in told}
        folder = os.path.join(local(self.path), self._folder())
        for name in os.listdir(folder) if os.path.isdir(folder) else ():  # of attempts that were repeated
            if name not in kept:
                os.unlink(os.path.join(folder, name))

    def _drop(self) -> None:
        _touch(self._ended())
        shutil.rmtree(os.path.join(local(self.path), self._folder()), ignore_errors=True)


class BatchWriter(_Writer, DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        super().__init__(options, schema, overwrite)
        self.batch = options.get("batch", self.write_id)

    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        super().__init__(options, schema, overwrite)
        self.stream = options["stream"]

    def _folder(self) -> str:
        return os.path.join("data", f"{quote(self.stream, safe='')}-{self.write_id}")

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        told = [m for m in messages if m and m.file]
        if not publish(self.path, f"{self.stream}/{batchId}", [m.file for m in told], sum(m.rows for m in told), self.schema, False, None):
            self.abort(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        """Only this micro-batch's files: the folder is the whole run's."""
        for m in messages:
            if m and m.file and os.path.exists(os.path.join(local(self.path), m.file)):
                os.unlink(os.path.join(local(self.path), m.file))


class ManifestTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "manifest_table"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(dict(self.options), schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(dict(self.options), schema, overwrite)


def commit_table(df: DataFrame, path: str, batch: str | None = None, overwrite: bool = False, base: int | None = None) -> int:
    """``df`` written and published; the version that is now the newest."""
    df.sparkSession.dataSource.register(ManifestTable)
    writer = df.write.format("manifest_table").mode("overwrite" if overwrite else "append").option("path", path)
    for name, value in (("batch", batch), ("base", base)):
        writer = writer if value is None else writer.option(name, value)
    writer.save()
    return manifest(path)["version"]


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table of a version, by Spark's own Parquet reader: columns and filters reach the scan."""
    now = manifest(path, version)
    if "schema" not in now:
        raise ValueError(f"nothing was published in {path}")
    schema = StructType.fromJson(now["schema"])
    if not now["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[os.path.join(path, f) for f in now["files"]])
