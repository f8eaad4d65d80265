"""Cross-parsing against a plain greedy parse, and held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from wrenfold.llm import crossparse
from wrenfold.llm.crossparse import BLOCK, Automaton, Languages


def greedy(text: bytes, known: bytes) -> int:
    n = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in known:
            end += 1
        at, n = max(end - 1, at + 1), n + 1
    return n


def languages(samples: dict[str, bytes]) -> Languages:
    made = {k: Automaton(v) for k, v in samples.items()}
    return Languages(list(samples), [len(v) for v in samples.values()], [a.states for a in made.values()], [a.edges for a in made.values()])


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh "])
def test_phrases(letters):  # noqa: ANN001, ANN201
    rng = random.Random(2)
    some = lambda n, of=letters: bytes(rng.choice(of) for _ in range(n))
    samples = {"x": some(300), "y": some(40) + b"\n" + some(200), "z": b"q"}
    own = languages(samples)
    rows = [some(n, letters + b"\xc3") for n in (0, 1, 2, 30, 500, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 7)] + [b"q" * 5, b"!!"]
    data = np.frombuffer(b"".join(rows), np.uint8)
    got = own.phrases(data, np.cumsum([0, *map(len, rows)]))
    for k, text in enumerate(samples.values()):
        assert got[k].tolist() == [sum(greedy(r[i : i + BLOCK], text) for i in range(0, len(r), BLOCK)) for r in rows]


def test_automaton():  # noqa: ANN201
    """Paths from the start are the substrings, no others."""
    text = b"abcbcabbca"
    steps: dict = {}
    for s, c, t in Automaton(text).edges.tolist():
        steps.setdefault(s, {})[c] = t
    found, front = {b""}, [(0, b"")]
    while front:
        s, w = front.pop()
        for c, t in steps.get(s, {}).items():
            found.add(w + bytes([c]))
            front.append((t, w + bytes([c])))
    assert found == {text[i:j] for i in range(len(text) + 1) for j in range(i, len(text) + 1)}


def test_plain():  # noqa: ANN201
    got = crossparse.plain(pa.array(["Ça--va, 12 ÖDE!", "", None, "  ", "éa"])).to_pylist()
    assert got[0] == " ça va öde "
    assert got[1] == "  "
    assert got[2] is None
    assert got[4] == " éa "


def test_predictions(spark):  # noqa: ANN001, ANN201
    """What is learnt, the choice and the score, from the rules."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    own = crossparse.learn(docs, 1 << 15)
    assert own.names == sorted({r.lang for r in docs.select("lang").distinct().collect()})
    assert all(n <= (1 << 15) // len(own.names) for n in own.sizes)
    got = {r.doc_id: r for r in crossparse.identify(docs, own).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    right = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert np.mean(right) > 0.97
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= got[r.doc_id].score <= 1
    samples = {"aa": b" the cat sat on the mat ", "bb": b" le chat est sur le tapis et dort "}
    two = languages(samples)
    for text in ("The cat!", "le tapis", "chat sat", "zzz"):
        words = crossparse.plain(pa.array([text])).to_pylist()[0].encode()
        cost = sorted((greedy(words, s) * math.log2(1 + len(s)), k) for k, s in samples.items())
        lang, score = two.predict(pa.array([text]))
        assert lang == [cost[0][1]]
        assert score[0] == pytest.approx(1 - cost[0][0] / cost[1][0])


def test_odd_rows(spark):  # noqa: ANN001, ANN201
    text = {"en": "the quick brown fox jumps over the lazy dog and runs away ", "ru": "съешь же ещё этих мягких французских булок да выпей чаю "}
    rows = [(k, text[x] * 3, x) for k in range(30) for x in text] + [(100, None, "en"), (101, "", "en"), (102, " 12 !?\n", "ru"), (None, text["ru"], "ru"), (103, "日本語", None), (104, text["en"] * 20000, None), (5, text["en"], None), (5, text["en"], None), (105, "123", "zz")]
    docs = spark.createDataFrame([(*r, "q", "q", "q") for r in rows], "doc_id long, text string, lang string, held_out string, score string, `key.x` string")
    got = crossparse.predict_languages(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert got.count() == len(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[k][0].lang_pred == "und" and by[k][0].score == 0 for k in (100, 101, 102, 105))
    assert by[None][0].lang_pred == "ru"
    assert by[None][0].held_out
    assert by[103][0].lang_pred in ("en", "ru")
    assert by[104][0].lang_pred == "en"
    assert len({r.score for r in by[5] if r.lang_pred == "en" and r.score == by[5][-1].score}) == 1
    assert {r.lang_pred for r in crossparse.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert crossparse.predict_languages(docs.limit(0)).count() == 0
    bad = spark.range(1).selectExpr("9L AS doc_id", "cast(concat(unhex('FF'), cast(' the lazy dog' AS binary)) AS string) AS text", "'en' AS lang")
    assert crossparse.predict_languages(docs.select(bad.columns).union(bad)).filter("doc_id = 9 AND lang_pred = 'en'").count() == 2
