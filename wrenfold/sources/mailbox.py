"""A mailbox as a stream: messages have numbers (uid, from 1) within an epoch, and the offset is (epoch, uid).

    spark.dataSource.register(Mailbox)
    spark.readStream.format("mailbox").option("path", landing_zone).load()

The landing zone is a mounted folder of JSON lines, ``<epoch>-<first uid>-<last uid>.jsonl``, a line a message
(uid, message_id, and other fields).  A poll plans one partition for each file with numbers above the position, so
polls read in parallel and a lost task reads its file again.  When the server numbers its messages anew, a new epoch
begins; the position in the old one means nothing then, and all messages of the new epoch come again: ``deliver`` tells
those that are delivered by their message ids.  ``start``: ``earliest``, or ``now``, which sets the position to the newest
message of the first poll and delivers none of those before.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from wrenfold.functions.rows import table
from wrenfold.registry import query
from wrenfold.sources.folders import work_folder
from wrenfold.sources.manifest import commit_table, local, manifest, read_table

_NAME = re.compile(r"(\d+)-(\d+)-(\d+)\.jsonl")


class Span(InputPartition):
    """The messages of a file with uids in (above, upto]."""

    def __init__(self, file: str, epoch: int, above: int, upto: int) -> None:
        super().__init__((file, epoch, above, upto))


def landed_files(path: str) -> list[tuple[int, int, int, str]]:
    """(epoch, first uid, last uid, name) of all files; others are not messages."""
    found = ((m, n) for n in os.listdir(local(path)) if (m := _NAME.fullmatch(n)))
    return sorted((int(m[1]), int(m[2]), int(m[3]), n) for m, n in found)


class MailboxReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.start = options["path"], options.get("start", "earliest")
        if self.start not in ("earliest", "now"):
            raise ValueError(f"start: {self.start!r}")

    def _newest(self) -> dict:
        files = landed_files(self.path)
        if not files:
            return {"epoch": 0, "uid": 0}
        epoch = files[-1][0]
        return {"epoch": epoch, "uid": max(last for e, _, last, _ in files if e == epoch)}

    def initialOffset(self) -> dict:  # noqa: N802
        return self._newest() if self.start == "now" else {"epoch": 0, "uid": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return self._newest()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        above = start["uid"] if start["epoch"] == end["epoch"] else 0
        return [Span(n, e, max(above, first - 1), min(last, end["uid"])) for e, first, last, n in landed_files(self.path) if e == end["epoch"] and last > above and first <= end["uid"]]

    def read(self, partition: Span) -> Iterator[tuple]:
        file, epoch, above, upto = partition.value
        with open(os.path.join(local(self.path), file), encoding="utf-8") as lines:
            for line in lines:
                message = json.loads(line)
                if above < message["uid"] <= upto:
                    yield epoch, message["uid"], message["message_id"], line.rstrip("\n")


class Mailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return "epoch long, uid long, message_id string, raw string"

    def streamReader(self, schema) -> MailboxReader:  # noqa: ANN001, N802
        return MailboxReader(dict(self.options))


def land(messages: DataFrame, path: str, epoch: int, files: int = 4) -> None:
    """``messages`` (uid, message_id, ...) as files of an epoch, each of a range of uids; a file appears whole or not at all."""
    folder = local(path)
    os.makedirs(folder, exist_ok=True)
    rows = messages.select("uid", F.to_json(F.struct(*messages.columns)).alias("line")).repartitionByRange(files, "uid").sortWithinPartitions("uid")

    def work(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        draft, first, last = os.path.join(folder, f".{os.urandom(8).hex()}"), None, None
        with open(draft, "w", encoding="utf-8") as out:
            for pdf in batches:
                for uid, line in zip(pdf["uid"], pdf["line"], strict=True):
                    first, last = uid if first is None else first, uid
                    out.write(line + "\n")
        if first is None:
            os.unlink(draft)
            return
        os.replace(draft, os.path.join(folder, f"{epoch}-{first}-{last}.jsonl"))
        yield pd.DataFrame({"first": [first]})

    rows.mapInPandas(work, "first long").write.format("noop").mode("overwrite").save()


def deliver(spark: SparkSession, path: str, table: str, checkpoint: str, stream: str, start: str = "earliest") -> None:
    """All there is now goes into a manifest table, each message id once, whatever was read again: a batch publishes only what the table hasn't got, and under its number."""
    spark.dataSource.register(Mailbox)

    def handle(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy("message_id").agg(F.min(F.struct("epoch", "uid", "raw")).alias("m")).select("message_id", "m.*")
        if manifest(table)["version"]:
            fresh = fresh.join(read_table(spark, table).select("message_id"), "message_id", "left_anti")
        commit_table(fresh, table, f"{stream}/{number}")

    source = spark.readStream.format("mailbox").option("path", path).option("start", start).load()
    source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query("d11_mailbox_stream", "SELECT CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS message_id, CASE WHEN turn < 2 THEN 1 ELSE 2 END AS epoch, CASE WHEN turn < 2 THEN conv_id * 1000 + turn + 1 ELSE conv_id * 1000 + turn + 8 END AS uid, text FROM conversations")
def mailbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as mail: a first poll, then the server numbers all messages anew and has more of them, and two more polls; each message once, with the number it was delivered under."""
    inbox, box, state = (work_folder(spark, n) for n in ("inbox", "delivered", "inbox-state"))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("uid"), F.concat_ws(".", "conv_id", "turn").alias("message_id"), "turn", "text")
    land(turns.filter("turn < 2"), inbox, 1)
    deliver(spark, inbox, box, state, "inbox")
    land(turns.withColumn("uid", F.col("uid") + 7), inbox, 2)
    for _ in range(2):
        deliver(spark, inbox, box, state, "inbox")
    return read_table(spark, box).select("message_id", F.col("epoch").cast("int").alias("epoch"), "uid", F.get_json_object("raw", "$.text").alias("text"))
