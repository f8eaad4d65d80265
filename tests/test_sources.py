"""The manifest table, the mailbox stream, paged reads, statement folders, broken mail and descriptors."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from tests.conftest import DATA
from wrenfold.sources import files, mailbox, manifest, paged
from wrenfold.sources.folders import work_folder
from wrenfold.sources.manifest import commit_table, read_table
from wrenfold.sources.sinks import upsert_table


def rows_of(df) -> list[tuple]:  # noqa: ANN001
    return sorted(map(tuple, df.collect()))


def parquet_files(path: str) -> set[str]:
    return {f for _, _, names in os.walk(manifest.local(path)) for f in names if f.endswith(".parquet")}


def test_commits(spark):  # noqa: ANN001, ANN201
    path = work_folder(spark, "t")
    one, two = spark.range(5).repartition(3), spark.range(5, 8)
    assert commit_table(one, path, "a") == 1
    assert commit_table(two, path, "b") == 2
    before = parquet_files(path)
    assert commit_table(spark.range(100), path, "a") == 2, "a batch that is there writes nothing"
    assert parquet_files(path) == before
    assert rows_of(read_table(spark, path)) == [(k,) for k in range(8)]
    assert rows_of(read_table(spark, path, 1)) == [(k,) for k in range(5)]
    assert commit_table(spark.range(2), path, overwrite=True, base=2) == 3
    assert rows_of(read_table(spark, path)) == [(0,), (1,)]
    with pytest.raises(PySparkException, match="Conflict|not 2"):
        commit_table(spark.range(3), path, overwrite=True, base=2)
    assert rows_of(read_table(spark, path)) == [(0,), (1,)]
    plan = read_table(spark, path).filter("id > 0")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,0)]" in plan


def test_failed_write_leaves_the_old_table(spark):  # noqa: ANN001, ANN201
    path = work_folder(spark, "t")
    commit_table(spark.range(4), path, "a")
    before = parquet_files(path)
    bad = spark.range(0, 40, 1, 4).withColumn("id", F.when(F.col("id") == 33, F.raise_error("broken").cast("long")).otherwise(F.col("id")))
    with pytest.raises(PySparkException):
        commit_table(bad, path, "b")
    assert manifest.versions(path) == [1]
    assert rows_of(read_table(spark, path)) == [(k,) for k in range(4)]
    time.sleep(2)  # tasks that were under way end
    assert commit_table(spark.range(4, 5).coalesce(1), path, "b") == 2, "the batch may come again after it failed"
    assert len(parquet_files(path) - before) == 1, "nothing of the failed write is left"
    assert rows_of(read_table(spark, path)) == [(k,) for k in range(5)]


def test_lost_marks_and_races(spark, monkeypatch):  # noqa: ANN001, ANN201
    """A crash between publishing and marking is mended; an append that loses a race is built on the winner."""
    path = work_folder(spark, "t")
    commit_table(spark.range(1), path, "a")
    os.unlink(manifest._mark(path, "a"))
    assert manifest.has_batch(path, "a")
    assert commit_table(spark.range(9), path, "a") == 1
    schema = json.dumps(manifest.manifest(path)["schema"])
    real, raced = manifest.manifest, []

    def stale(at, version=None):  # noqa: ANN001, ANN202
        now = real(at, version)
        if version is None and not raced:
            raced.append(True)
            assert manifest.publish(at, "other", ["x.parquet"], 1, schema, False, None)
        return now

    monkeypatch.setattr(manifest, "manifest", stale)
    assert manifest.publish(path, "mine", ["y.parquet"], 1, schema, False, None)
    monkeypatch.undo()
    assert manifest.versions(path) == [1, 2, 3]
    assert manifest.manifest(path)["files"][-2:] == ["x.parquet", "y.parquet"]


def test_upserts_and_empty(spark):  # noqa: ANN001, ANN201
    path = work_folder(spark, "t")
    df = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    upsert_table(path, df((1, "a"), (2, "b")), ["k"], "1")
    upsert_table(path, df((2, "c"), (3, "d")), ["k"], "2")
    upsert_table(path, df((2, "x")), ["k"], "2")
    assert rows_of(read_table(spark, path)) == [(1, "a"), (2, "c"), (3, "d")]
    commit_table(spark.createDataFrame([], "k int, v string"), path, "3", overwrite=True)
    assert read_table(spark, path).count() == 0
    with pytest.raises(ValueError, match="nothing was published"):
        read_table(spark, work_folder(spark, "none"))


def messages(spark, ids, shift=0):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(i + shift, f"m{i}", f"é text {i}") for i in ids], "uid long, message_id string, text string")


def test_mailbox(spark):  # noqa: ANN001, ANN201
    inbox, box, state = (work_folder(spark, n) for n in ("inbox", "box", "state"))
    poll = lambda: mailbox.deliver(spark, inbox, box, state, "s")
    ids = lambda: sorted((r.message_id, r.epoch) for r in read_table(spark, box).collect())
    mailbox.land(messages(spark, range(1, 30)), inbox, 1)
    poll()
    poll()
    assert ids() == sorted((f"m{i}", 1) for i in range(1, 30))
    mailbox.land(messages(spark, range(30, 40)), inbox, 1)
    poll()
    mailbox.land(messages(spark, range(20, 45), 100), inbox, 2)  # numbered anew
    poll()
    assert ids() == sorted([(f"m{i}", 1) for i in range(1, 40)] + [(f"m{i}", 2) for i in range(40, 45)])
    again = work_folder(spark, "state")  # a lost checkpoint reads the whole epoch again and delivers nothing twice
    mailbox.land(messages(spark, range(45, 47), 100), inbox, 2)
    mailbox.deliver(spark, inbox, box, again, "s2")
    assert [i for i, _ in ids()] == sorted(f"m{i}" for i in range(1, 47))


def test_mailbox_positions(spark):  # noqa: ANN001, ANN201
    inbox = work_folder(spark, "inbox")
    mailbox.land(messages(spark, range(1, 21)), inbox, 3, 4)
    reader = mailbox.MailboxReader({"path": inbox, "start": "now"})
    assert reader.initialOffset() == reader.latestOffset() == {"epoch": 3, "uid": 20}
    files_ = mailbox.landed_files(inbox)
    part = reader.partitions({"epoch": 3, "uid": files_[1][2]}, {"epoch": 3, "uid": 20})
    assert [p.value[0] for p in part] == [f[3] for f in files_[2:]]
    assert [uid for p in reader.partitions({"epoch": 3, "uid": 7}, {"epoch": 3, "uid": 12}) for _, uid, _, _ in reader.read(p)] == [8, 9, 10, 11, 12]
    assert len(reader.partitions({"epoch": 2, "uid": 99}, {"epoch": 3, "uid": 20})) == len(files_)
    with pytest.raises(ValueError, match="start"):
        mailbox.MailboxReader({"path": inbox, "start": "later"})


def test_pages(spark):  # noqa: ANN001, ANN201
    path = work_folder(spark, "pages")
    rows = spark.createDataFrame([(k, "abc"[k % 7 % 3], f"n{k}") for k in range(100)], "id long, key string, name string")
    paged.land_pages(rows, "key", "id", path, 8)
    got = paged.read_pages(spark, path, "id long, key string, name string", "key", 8)
    assert rows_of(got) == rows_of(rows)
    some = got.filter("key = 'b' AND id > 10")
    assert rows_of(some) == rows_of(rows.filter("key = 'b' AND id > 10"))
    used = lambda df: df.rdd.getNumPartitions()
    assert used(got.filter("key = 'b'")) < used(got)
    options = {"template": f"file://{path}/{{key}}-{{offset}}.json", "counts": f"file://{manifest.local(path)}/counts.json", "key": "key", "limit": "8"}
    pages = {}
    for name, pushed in (("all", []), ("one", [EqualTo(("key",), "b")]), ("two", [In(("key",), ("a", "c"))]), ("none", [EqualTo(("key",), "b"), In(("key",), ("a",))]), ("other", [EqualTo(("id",), 3)])):
        reader = paged.KeyedPageReader(options, ["id"])
        assert list(reader.pushFilters(pushed)) == pushed
        pages[name] = len(reader.partitions())
    assert pages["one"] + pages["two"] == pages["all"] == pages["other"]
    assert pages["none"] == 0


def test_statement_folder(spark, tmp_path):  # noqa: ANN001, ANN201
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8")
    put("m.tsv", "﻿Sale Month\tISRC\tCountry\tQuantity\tEarnings\r\n2024-02\tus-abc-0000001\tus\t1,000\t$3.50\r\n2024-02\tx\tus\t1\toops\r\n")
    put("d.csv", 'Revenue,"sale_date",ISRC,Streams,Territory\n"1,234.50",2024-03-05,"usabc0000002",7,gb\n2.00,never,usabc0000003,1,gb\n')
    put("semi.csv", "Sale Date;Isrc;Streams;Revenue\n2024-03-06;usabc0000004;3;4\n\n")
    put("other.csv", "a,b\n1,2\n3,4\n")
    put("both.csv", "sale month,sale date,isrc,quantity,streams,earnings,revenue\n1,2,3,4,5,6,7\n")
    good, bad = files.read_statements(spark, str(tmp_path))
    assert sorted((r.format, r.isrc, r.territory, str(r.period_start), str(r.period_end), r.quantity, str(r.earnings)) for r in good.collect()) == [
        ("daily", "USABC0000002", "GB", "2024-03-05", "2024-03-05", 7, "1234.500000"), ("daily", "USABC0000004", None, "2024-03-06", "2024-03-06", 3, "4.000000"), ("monthly", "USABC0000001", "US", "2024-02-01", "2024-02-29", 1000, "3.500000"),
    ]
    told = {(os.path.basename(r.file), r.reason) for r in bad.collect()}
    assert told == {("m.tsv", "unreadable amount"), ("d.csv", "unreadable period"), ("other.csv", "no format has these columns"), ("both.csv", "several formats have these columns: monthly, daily")}


def test_broken_mail(spark):  # noqa: ANN001, ANN201
    ok = b"From: a@x\r\nMessage-ID: <1>\r\nSubject: s\r\n\r\nhello"
    strange = b"From: a@x\r\nMessage-ID: <2>\r\nContent-Type: text/plain; charset=no-such\r\n\r\nhello"
    rows = spark.createDataFrame([(ok,), (strange,), (None,), (b"",), (b"\xff\xfe\x00garbage",)], "content binary")
    got = files.parse_mail(rows).collect()
    assert len(got) == 5
    by = {r.message_id: r for r in got if r.message_id}
    assert by["<1>"].body == "hello"
    assert by["<1>"].error is None
    assert by["<2>"].body is None
    assert "LookupError" in by["<2>"].error
    assert sum(r.error == "no message" for r in got) == 2


def test_descriptors():  # noqa: ANN201
    text = "# c\nid: 7\nmeta:\n  duration: 12\n  deep:\n    fps: '25.0'\nempty:\nquoted: \"a: b\"\n"
    assert files.flat_yaml(text) == {"id": "7", "meta.duration": "12", "meta.deep.fps": "25.0", "empty": "", "quoted": "a: b"}
    for bad in ("no key here", "a: [1]", "- x", "a: |\n  text", "   odd: 1", "a:b"):
        with pytest.raises(ValueError, match="no "):
            files.flat_yaml(bad)


def test_words_and_mail_leave_by_few(spark):  # noqa: ANN001, ANN201
    """Neither a batch's words nor its messages are gathered in pandas."""
    for made in (files.captions, files.mail):
        plan = made(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_statement_lines_stay_where_they_are(spark, tmp_path):  # noqa: ANN001, ANN201
    """However many lines a file has, they aren't brought to one task."""
    (tmp_path / "a.txt").write_text("Sale Month\tISRC\tQuantity\tEarnings\n2024-01\tusabc0000001\t1\t$2.00\n2024-02\tusabc0000002\t3\t\"4.00\"\n")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = files.read_statements(spark, str(tmp_path))[0]
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted((r.isrc, float(r.earnings)) for r in lines.collect()) == [("USABC0000001", 2.0), ("USABC0000002", 4.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
