"""The pipeline, stage by stage, on the smallest tables."""

from __future__ import annotations

import zlib

import pytest

import __spark_entry__
import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_operators import brute_bytes, brute_contamination, brute_cut, brute_links
from wrenfold.llm import queries, toxicity
from wrenfold.llm.storage import stored


@pytest.fixture(scope="module")
def stages(spark):  # noqa: ANN001, ANN201
    docs = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], DATA), name))
    return docs


def pairs(df) -> list[tuple]:  # noqa: ANN001
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_order_and_columns(stages):  # noqa: ANN001, ANN201
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_toxic_go(spark, stages):  # noqa: ANN001, ANN201
    scores = toxicity.classify(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in scores.filter("predicted = 0").collect()}


def test_one_of_each_group(stages):  # noqa: ANN001, ANN201
    links = brute_links(pairs(stages[1]), 5, 80)
    assert sorted(i for i, _ in pairs(stages[2])) == sorted({c for _, _, c in links})


def test_near_copies_at_five_words(spark):  # noqa: ANN001, ANN201
    words = [f"w{k}" for k in range(300)]
    edit = lambda at, n: [f"x{k}" if k in at else w for k, w in enumerate(words[:n])]
    texts = [words[:186], edit({30, 75, 120, 165}, 186), [f"y{w}" for w in words[:100]], [f"y{w}" for w in words[:122]], [f"z{w}" for w in words[:50]], [f"z{w}" for w in words[:70]]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want = sorted({c for _, _, c in brute_links(rows, 5, 80)})
    assert want == [0, 2, 4, 5]
    assert len({c for _, _, c in brute_links(rows)}) == 6
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_repeats_go(stages):  # noqa: ANN001, ANN201
    assert sorted(pairs(stages[3]), key=repr) == brute_cut(pairs(stages[2]), 200)
    assert sum(r[2] for r in brute_bytes(pairs(stages[2]), 200)) > 0
    assert all(r.n_chars == len(r.text or "") for r in stages[3].collect())


def test_stages_on_odd_rows(spark, tmp_path):  # noqa: ANN001, ANN201
    """Nulls, empty and equal texts, repeated and missing ids, clashing names: each stage alone, and an empty table."""
    long = " ".join(f"word{k}" for k in range(80))
    rows = [(1, long), (1, long), (None, long), (None, None), (2, None), (3, ""), (3, " \n"), (4, "x" * 500), (5, "y" + "x" * 500), (6, "z " + long)]
    names = ["grp", "bin", "_grp", "kept", "label", "rid", "root", "y", "id", "t", "doc", "item", "length"]
    docs = spark.createDataFrame([(i, t, "en", "s", None, *["q"] * len(names)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        assert got.schema == docs.schema
        kept = [(r.doc_id, r.text) for r in got.collect()]
        if name == "ngram_jaccard_join":
            assert sorted(kept, key=repr) == sorted([(1, long), *rows[3:9]], key=repr)
        elif name == "suffix_array_dedup":
            assert sorted(kept, key=repr) == brute_cut(rows, 200)
        else:
            assert sorted(kept, key=repr) == sorted(rows, key=repr)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))
    assert packed.groupBy("doc_id").count().count() == len({i for i, _ in rows})
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_contaminated_go(spark, stages):  # noqa: ANN001, ANN201
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = [r[0] for r in brute_contamination(pairs(stages[3]), [(str(i), t) for i, t in items]) if not r[5]]
    assert sorted(i for i, _ in pairs(stages[4])) == sorted(want)


def test_all_packed(stages):  # noqa: ANN001, ANN201
    got = stages[5].collect()
    assert {r.doc_id for r in got} == {i for i, _ in pairs(stages[4])}
    assert max(r.offset + r.length for r in got) <= 2048


def test_registered():  # noqa: ANN201
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert zlib.crc32(b"0") % 5 in range(5)
