"""Behaviour that tables of the driver don't show: guards, refusals, kernels, parsers, streams."""

from __future__ import annotations

import json
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import DATA
from wrenfold.functions import signal
from wrenfold.functions import text as X
from wrenfold.operators import retrieval
from wrenfold.operators.media import sequence_order
from wrenfold.plans import guards
from wrenfold.sources import files, sinks
from wrenfold.sources.paged import PagedJson
from wrenfold.streaming import changes


def one(spark, expr, value, kind="string"):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("($1,234.50)", "-1234.500000"), ("12", "12.000000"), ("n/a", None), ("", None)])
def test_amounts(spark, raw, want):  # noqa: ANN001, ANN201
    got = one(spark, X.parse_amount, raw)
    assert (None if got is None else str(got)) == want


def test_identifiers_and_contacts(spark):  # noqa: ANN001, ANN201
    assert one(spark, lambda c: X.canonical(c, X.ISRC), "us-abc-12-34567") == "USABC1234567"
    assert one(spark, lambda c: X.canonical(c, X.ISRC), None) == ""
    assert one(spark, X.canonical_gtin, "012345678905") == "00012345678905"
    assert one(spark, X.normalise_email, "mailto:Ab@X.Example.ORG?subject=hi") == "Ab@x.example.org"
    assert one(spark, X.normalise_email, "nobody") == ""
    assert one(spark, X.normalise_phone, "12 34") == ""


@pytest.mark.parametrize(("sql", "ok"), [
    ("SELECT * FROM a WHERE tenant_id = 1", True),
    ("SELECT * FROM a", False),
    ("SELECT * FROM a WHERE tenant_id = 1 OR x = 2", False),
    ("SELECT * FROM a JOIN b ON a.k = b.k WHERE a.tenant_id = 1", False),
    ("SELECT * FROM a JOIN b ON a.k = b.k AND a.tenant_id = b.tenant_id WHERE a.tenant_id = 1", True),
    ("SELECT * FROM a WHERE tenant_id = 1 AND k IN (SELECT k FROM b)", False),
    ("SELECT * FROM a WHERE tenant_id = 1 AND k IN (SELECT k FROM b WHERE b.tenant_id = 1)", True),
    ("SELECT * FROM (SELECT * FROM a) s WHERE s.tenant_id = 1", False),
    ("SELECT * FROM a WHERE tenant_id = 1 -- x", False),
    ("SELECT 1 FROM a WHERE tenant_id = 1 UNION SELECT 1 FROM b WHERE tenant_id = 1", False),
])
def test_scope_proof(spark, sql, ok):  # noqa: ANN001, ANN201
    if ok:
        assert guards.prove_scoped(spark, sql, tenant=1)
    else:
        with pytest.raises(guards.Unscoped):
            guards.prove_scoped(spark, sql, tenant=1)


@pytest.mark.parametrize("key", sorted(guards.QUESTIONS))
def test_every_question_is_scoped(spark, key):  # noqa: ANN001, ANN201
    """Each statement of the library that reads tenants' tables proves itself, and doesn't without any one of its conditions on the tenant."""
    sql = guards.QUESTIONS[key].sql
    assert set(guards.prove_scoped(spark, sql)) <= set(guards.tenant_views(spark, DATA))
    conditions = re.findall(r"\w+\.tenant_id = (?:\w+\.tenant_id|:tenant)", sql)
    assert conditions
    for c in conditions:
        with pytest.raises(guards.Unscoped):
            guards.prove_scoped(spark, sql.replace(c, "1 = 1", 1))
    with pytest.raises(guards.Unscoped):
        guards.prove_scoped(spark, sql.replace(":tenant", "8"), tenant=7)


def test_question_slots(spark):  # noqa: ANN001, ANN201
    with pytest.raises(ValueError, match="takes"):
        guards.ask(spark, DATA, "status_spread", tenant=7)
    with pytest.raises(ValueError, match="invalid literal"):
        guards.ask(spark, DATA, "status_spread", tenant=7, limit="5; DROP")
    assert guards.ask(spark, DATA, "parties_with_status", tenant=7, term="' OR 1=1", limit=5).count() == 0
    assert guards.nearest_question("how much work is pending") == "work_queue"
    assert guards.nearest_question("what kind of customers are there?") == "parties_by_segment"
    assert guards.nearest_question("xyzzy") is None


def test_history_expires(spark):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(1, None, None)], "id int, valid_from timestamp_ntz, valid_to timestamp_ntz")
    with pytest.raises(retrieval.HistoryExpired):
        retrieval.as_of_rows(rows, "2020-01-01 00:00:00")
    for bad in ("now()", "2024-01-01; DROP", "5m"):
        with pytest.raises(ValueError, match="instant"):
            retrieval.as_of_literal(bad)


def test_vector_width(spark):  # noqa: ANN001, ANN201
    with pytest.raises(PySparkException):
        retrieval.check_width(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).collect()


def test_statement_files(spark, tmp_path):  # noqa: ANN001, ANN201
    good = tmp_path / "s.tsv"
    good.write_text("Sale Month\tISRC\tCountry\tQuantity\tEarnings\n2024-02\tus-abc-0000001\tus\t1,000\t$3.50\n")
    r = files.read_statement(spark, str(good)).first()
    assert (r.isrc, r.territory, str(r.period_end), r.quantity, str(r.earnings)) == ("USABC0000001", "US", "2024-02-29", 1000, "3.500000")
    with pytest.raises(files.AmbiguousFormat):
        files.detect(["a", "b"])
    good.write_text("Sale Month\tISRC\tCountry\tQuantity\tEarnings\n2024-02\tx\tus\t1\toops\n")
    with pytest.raises(PySparkException):
        files.read_statement(spark, str(good)).collect()


def test_scout_quarantine(spark):  # noqa: ANN001, ANN201
    lines = [("@a|tiktok|s|5||g",), ("# c",), ("",), ("@b|x|s|many|1|g",), ("|x|s|1|1|g",)]
    good, bad = files.scout_lines(spark.createDataFrame(lines, "line string"))
    assert [(r.handle, r.view_count, r.creator_median_views) for r in good.collect()] == [("@a", 5, None)]
    assert sorted(r.reason for r in bad.collect()) == ["no handle", "views unreadable"]


def test_captions_roll():  # noqa: ANN201
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\na b\n\n00:00:02.000 --> 00:00:03.000\na b\nc\n"
    assert files.timed_words(vtt) == [(1.0, "a"), (1.0, "b"), (2.0, "c")]


def test_paged_source(spark, tmp_path):  # noqa: ANN001, ANN201
    for o in (0, 2, 4):
        (tmp_path / f"{o}.json").write_text(json.dumps([{"id": i, "name": f"n{i}"} for i in range(o, min(o + 2, 5))]))
    spark.dataSource.register(PagedJson)
    df = spark.read.format("paged_json").schema("id long, name string").option("template", f"file://{tmp_path}/{{offset}}.json").option("limit", "2").option("total", "5").load()
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]


def test_tempo_and_wav():  # noqa: ANN201
    x = signal.click_train(100, 12, 8000, 0.05, 4)
    y, rate = signal.decode_wav(signal.encode_wav(x, 8000))
    assert rate == 8000
    assert np.abs(x - y).max() < 1e-3
    heard = signal.tempo(y, rate)
    found, confidence = heard.bpm, heard.confidence
    assert abs(found - 100) < 1.5
    assert confidence > 2 * signal.tempo(np.random.default_rng(1).normal(0, 0.1, 96000).astype(np.float32), 8000).confidence
    assert signal.tempo(np.zeros(96000, np.float32), 8000) == signal.Tempo()


def test_segments_and_edges():  # noqa: ANN201
    assert signal.segment_types(np.array([[0.0], [0.1], [5.0], [5.1], [0.05]]), [(k, k + 1) for k in range(5)]) == [0, 0, 1, 1, 0]
    assert signal.merge_edges([5, 1, 2, 9, 8]) == [1, 5, 8]


def test_upsert(spark):  # noqa: ANN001, ANN201
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, _order int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_stream_sends_once(spark, tmp_path):  # noqa: ANN001, ANN201
    sent: list[int] = []
    handle = changes.once_only(str(tmp_path / "sent"), lambda df: sent.extend(r.event_id for r in df.select("event_id").collect()))
    changes.follow(changes.change_stream(spark, DATA), str(tmp_path / "c"), handle)
    assert len(sent) == len(set(sent)) > 0
    n = len(sent)
    batch = spark.createDataFrame([(sent[0], 1, "work"), (-5, 1, "work")], "event_id long, tenant_id long, wake string")
    handle(batch, 99)
    handle(batch, 99)  # the same batch again
    assert len(sent) == n + 1


def test_sequence_order_keeps_all_parts(spark):  # noqa: ANN001, ANN201
    parts = {r.p_partkey: r.p_brand for r in spark.read.parquet(f"{DATA}/part.parquet").collect()}
    got = sequence_order(spark, DATA).collect()
    assert sorted((r.p_partkey, r.p_brand) for r in got) == sorted(parts.items())
    assert len({(r.p_brand, r.edit, r.position) for r in got}) == len(got)
    assert max(r.position for r in got) < 24


def test_sequence_order_of_many_parts(spark, tmp_path):  # noqa: ANN001, ANN201
    spark.createDataFrame([("b", k, k * 7 % 50 + 1) for k in range(60)], "p_brand string, p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(((r.edit, r.position, r.p_partkey, r.cost) for r in sequence_order(spark, str(tmp_path)).collect()))
    want = []
    for edit in range(3):
        keys = np.arange(24 * edit, min(60, 24 * edit + 24))
        order, cost = signal.order_sequence(((keys * 7 % 50) // 10 + 1).astype(float), np.linspace(1, 5, len(keys)), 6000)
        want += [(edit, i, int(k), cost) for i, k in enumerate(keys[order])]
    assert got == want


def test_captions_time_whole_turns(spark, tmp_path):  # noqa: ANN001, ANN201
    turns = [(1, t, f"a{t} " + "long\n word " * 20) for t in (0, 1, 59, 60, 61, 3600, 400000)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.idx, r.start_s, r.word) for r in files.captions(spark, str(tmp_path)).collect())
    words = [(float(t), w) for _, t, text in turns for w in text.split()]
    assert got == [(i, t, w) for i, (t, w) in enumerate(words)]
