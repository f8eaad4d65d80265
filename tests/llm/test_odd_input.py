"""Bytes that are not UTF-8 in every operator, and columns of any name through every stage."""

from __future__ import annotations

import hashlib
import zlib

import pytest

import corpus_pipeline
from wrenfold.llm import decontaminate, licenses, ngramjoin, ogg, packing, sharding, suffixdedup, toxicity, windowdedup

BAD = b"some \xff\xfe words and \xc3 more of them, caf\xc3\xa9 " * 12
ROWS = [(1, BAD), (2, BAD + b"end"), (3, b"plain words only"), (4, b"\x80"), (5, None)]
PUBLIC = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def raw(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(ROWS, "doc_id long, b binary").selectExpr("doc_id", "cast(b AS string) AS text")


def by_id(df) -> dict:  # noqa: ANN001
    return {r.doc_id: r for r in df.collect()}


def test_bytes(spark, raw):  # noqa: ANN001, ANN201
    import public_tokenizers

    sizes = {i: len(b or b"") for i, b in ROWS}
    got = by_id(ogg.media_columns(raw))
    assert {i: r.n_bytes for i, r in got.items()} == sizes
    got = by_id(suffixdedup.dedup_substrings(raw))
    assert {i: r.n_bytes for i, r in got.items()} == sizes
    assert got[2].n_removed >= len(BAD) - 1
    assert got[3].kept_sha256 == hashlib.sha256(b"plain words only").hexdigest()
    got = by_id(sharding.shard_documents(raw, shards=2))
    assert {i: r.text_crc32 for i, r in got.items()} == {i: zlib.crc32(b or b"") for i, b in ROWS}
    assert {i: r.n_words for i, r in by_id(windowdedup.dedup_windows(raw, with_text=True)).items()} == {i: len((b or b"").split()) for i, b in ROWS}
    got = by_id(ngramjoin.near_duplicates(raw))
    assert got[2].component_id == 1
    got = by_id(packing.pack(raw, public_tokenizers.path(PUBLIC)))
    want = by_id(packing.pack(spark.createDataFrame([(i, b if b is None else b.decode("utf-8", "replace")) for i, b in ROWS], "doc_id long, text string"), public_tokenizers.path(PUBLIC)))
    assert {i: r.ids_crc32 for i, r in got.items()} == {i: r.ids_crc32 for i, r in want.items()}
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(1, 6)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.classify(raw, labels).collect())
    bench = spark.createDataFrame([(9, bytearray(BAD[:120]))], "item_id long, b binary").selectExpr("item_id", "cast(b AS string) AS text")
    for clean in (None, "spans"):
        got = by_id(decontaminate.decontaminate(raw, bench, clean=clean))
        assert got[3].n_hit == 0
        assert got.keys() == sizes.keys()
    assert licenses.recognise(raw).count() == len(ROWS)


NAMES = ["meta.url", "a`b", "x y", "grp.text", "TEXT2", "doc-id", "ключ", "carried_2", "text.", "_grp", "kept", "n.chars"]


def test_names_through_all_stages(spark, tmp_path):  # noqa: ANN001, ANN201
    long = " ".join(f"word{k}" for k in range(80))
    rows = [(1, long), (2, long), (3, None), (4, "x" * 500), (5, "y" + "x" * 500), (None, "")]
    schema = ", ".join(f"`{n.replace('`', '``')}` struct<`u.v`: string>" if k % 2 else f"`{n.replace('`', '``')}` string" for k, n in enumerate(NAMES))
    docs = spark.createDataFrame([(i, t, "en", "s", None, *[(f"{i}.{k}",) if k % 2 else f"{i}.{k}" for k in range(len(NAMES))]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + schema)
    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([(1, 0, 0)] if name == "labels" else [(1, "nothing of it here")], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.schema == docs.schema
        assert all(r[-1] == (f"{r[0]}.{len(NAMES) - 1}",) for r in got.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 5
