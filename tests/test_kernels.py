"""Kernels and helpers against values worked out by hand."""

from __future__ import annotations

import itertools
import math
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from wrenfold.functions import rows, signal, webpage
from wrenfold.functions import text as T
from wrenfold.operators import contacts, extras, filters, retrieval, scalars
from tests.conftest import DATA
from wrenfold.functions.rows import exact_quantile, through_python
from wrenfold.operators.media import alignment, byte_frames, candidate_rules, comb_scores, local_pulse, matching_blocks, onset_envelope, probes, segment_types, short_spectra, tracks, wav_decode
from wrenfold.sources import files

RATE = 8000


@pytest.mark.parametrize("bpm", [75, 100, 128, 140, 150, 170])
def test_tempo_of_clicks(bpm):  # noqa: ANN001, ANN201
    """The faster reading of an octave, whatever the comb scores at half of it."""
    heard = signal.tempo(signal.click_train(bpm, 20, RATE, 0.05), RATE)
    assert min(abs(heard.bpm - bpm), abs(heard.bpm - 2 * bpm)) < 0.3
    assert heard.bpm > 74
    assert heard.confidence > 0.5


def test_tempo_rivals_and_silence():  # noqa: ANN201
    noise = signal.tempo(np.random.default_rng(3).normal(0, 0.1, 20 * RATE).astype(np.float32), RATE)
    assert noise.confidence < 0.3
    assert signal.tempo(signal.click_train(170, 20, RATE, 0.05), RATE).rivals == (85.0,)  # half of it scores as well
    assert signal.tempo(signal.click_train(100, 20, RATE, 0.05), RATE).rivals == ()
    assert signal.tempo(np.zeros(20 * RATE, np.float32), RATE) == signal.Tempo()
    assert signal.tempo(signal.click_train(100, 2.5, RATE), RATE) == signal.Tempo()  # fewer than eight beats


def test_fold():  # noqa: ANN201
    assert [signal.folded(x) for x in (35.0, 69.9, 70.0, 100.0, 179.9, 180.0, 361.0)] == [70.0, 139.8, 70.0, 100.0, 179.9, 90.0, 90.25]


def test_drop_plateau_riser():  # noqa: ANN201
    low = np.array([50.0] * 32 + [0.5] * 8 + [52.0] * 28 + [20.0] * 20) + np.tile([0.1, 0.0], 44)
    assert signal.find_drop(low) == (40, True)
    assert signal.find_drop(low, near=45) == (40, True)
    assert signal.plateau_beats(low, 40) == 28
    assert signal.riser_beats(low, 40) == 8
    steady = np.tile([5.0, 1.0, 1.0, 1.0], 20)
    assert not signal.find_drop(steady)[1]  # the loudest step is followed by what preceded it
    assert signal.find_drop(np.array([1.0])) == (0, False)
    assert signal.plateau_beats(low[:46], 40) == 4
    assert signal.riser_beats(low, 3) is None


def test_bar_phase():  # noqa: ANN201
    low = np.repeat([1.0, 30.0, 5.0, 40.0, 2.0, 35.0], 8)  # changes at multiples of eight
    assert signal.bar_phase(low, low, 17) == (1, 5 / 6)  # of six picks one is no change
    assert signal.bar_phase(low[:5], low[:5], 2) == (0, None)


def test_shots_and_windows():  # noqa: ANN201
    frames = np.full((40, 8, 16), 100, np.uint8)
    frames[20:] = 160  # one cut into frame 20
    frames[22:30:2] += 6
    curve = signal.motion_curve(frames)
    assert np.flatnonzero(curve > 50).tolist() == [19]
    assert signal.shot_bounds(curve) == [(0, 20), (20, 39)]
    start, length = signal.pick_window(frames, curve, 1.0, 0.5, 2.0)
    assert (start, length) == (12 / 8, 1.0)  # the cut itself still counts to the shot that it ends
    dark = np.zeros((40, 8, 16), np.uint8)
    assert signal.pick_window(dark, signal.motion_curve(dark), 1.0, 0.5, 2.0) == (0.0, 1.0)
    assert signal.crop_left(frames, 0, 2, 900, 1600) == 0  # already upright
    moving = np.full((16, 8, 16), 50, np.uint8)
    moving[::2, :, 12] = 250
    assert signal.crop_left(moving, 0, 2, 1600, 900) == min(1600 - 506, round(12 / 16 * 1600 - 253))
    f = signal.clip_features(frames, np.repeat(frames[..., None], 3, axis=-1), start, length, curve)
    assert f["warmth"] == 0.5
    assert f["saturation"] == 0.0
    assert f["intensity"] == round(0.45 * f["energy"] + 0.2 * f["contrast"] + 0.15 * f["detail"], 3)
    assert signal.poles({"luma": 0.1, "energy": 0.5, "warmth": 0.9, "detail": 0.61}) == {"light": "dark", "motion": "mid", "temp": "warm", "scale": "close"}


def test_overlays():  # noqa: ANN201
    rng = np.random.default_rng(0)
    scene = rng.integers(0, 255, (12, 72, 128)).astype(np.float64)
    assert signal.screen_overlay(scene)[0] == "clean"
    drawn = scene.copy()
    drawn[:, 50:66, 10:118] = 20.0
    drawn[:, 54:62, 14:114:8] = 250.0
    verdict, share, aligned = signal.screen_overlay(drawn)
    assert verdict == "overlay"
    assert share > signal.SHARE
    moon = scene.copy()
    y, x = np.mgrid[:72, :128]
    disc = np.clip(260 - 8 * np.hypot(y - 36, x - 64), 0, 250)
    inside = np.hypot(y - 36, x - 64) < 34
    moon[:, inside] = disc[inside]
    verdict, share, aligned = signal.screen_overlay(moon)
    assert share > signal.SHARE  # locked and edged, but round
    assert (verdict, aligned < signal.ON_AXIS) == ("clean", True)
    assert signal.screen_overlay(np.full((8, 20, 20), 90.0))[0] == "abstain"
    assert signal.screen_overlay(byte_frames(b""))[0] == "abstain"
    assert signal.screen_overlay(byte_frames(np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8).tobytes()))[0] == "clean"


def test_probe():  # noqa: ANN201
    wav = signal.encode_wav(np.zeros(4000, np.float32), 8000)
    assert signal.probe(wav) == {"container": "wav", "codec": "pcm", "channels": 1, "rate": 8000, "seconds": 0.5}
    assert signal.probe(wav[:30])["container"] == "wav"
    assert signal.probe(b"")["container"] is None
    assert signal.probe(b"\xff\xfb\x90\x00")["codec"] == "mp3"
    assert signal.probe(b"\0\0\0\x18ftypisom")["container"] == "mp4"


def test_anchors():  # noqa: ANN201
    page = """<A HREF='/a b'>One <i>two</i>\n three</A><a class="x>y" href=/c>c<a href="&#109;ailto:x@y.z">M&amp;D</a><!-- <a href="/no">n</a> --><script>'<a href="/no">'</script><a data-href="/no">none</a><a href="/open">left open"""
    assert webpage.Page(page).anchors == [("/a b", "One two three"), ("/c", "c"), ("mailto:x@y.z", "M&D"), ("", "none"), ("/open", "left open")]
    anchors = lambda t: [tuple(a) for a in webpage.Page(t).anchors]
    assert anchors("<a href='/q>z") == [("/q", "z")]
    assert anchors("<a href='/q>z</a>") == [("/q", "z")]
    assert anchors("a < b <a href=x>1 < 2</a>") == [("x", "1 < 2")]
    assert anchors("<!-- never closed <a href=x>y</a>") == anchors("<script> <a href=x>y</a>") == anchors(None) == []
    assert anchors("<style>a{}</STYLE ><a href=x>y</a><!DOCTYPE html><?php ?></>") == [("x", "y")]
    assert anchors("<a href=1 href=2 / title>t</a><abbr href=no>") == [("1", "t")]
    assert webpage.Page("<p><TextArea rows=2>").has_box
    assert not webpage.Page("<!-- <textarea> --><script><textarea></script></textarea>").has_box
    assert len(webpage.Page("<a href=x>" * 20000).anchors) == 20000


@pytest.mark.parametrize(("reference", "want"), [
    ("/a b?q=%20#f", "https://s.example/a%20b?q=%20"), ("b/../c/./d", "https://s.example/x/c/d"), ("../../../up", "https://s.example/up"), ("?n=1", "https://s.example/x/y?n=1"), ("//o.example/é", "https://o.example/%C3%A9"), ("HTTP://O.example", "http://O.example"),
    ("z/", "https://s.example/x/z/"), ("..", "https://s.example/"), (".", "https://s.example/x/"), ("a\nb", "https://s.example/x/ab"), ("tel:1", None), ("ftp://x/y", None), ("#top", None), ("", None), ("https:///p", None), ("javascript:alert(1)", None), ("mailto:a@b.c", None),
])
def test_references(reference, want):  # noqa: ANN001, ANN201
    found = webpage.link(reference, webpage.link("https://s.example/x/y"))
    assert (found and str(found)) == want


def test_sites():  # noqa: ANN201
    covers = lambda site, url: webpage.Site(site).covers(webpage.link(url))
    assert covers("https://www.wrek.example/", "https://music.wrek.example")
    assert covers("https://wrek.example/", "http://user@WREK.example:8080/x")
    assert not covers("https://wrek.example", "https://notwrek.example")
    assert not covers("https://music.wrek.example", "https://wrek.example")
    assert not covers("", "https://wrek.example")
    assert [webpage.tier_of(u, t) for u, t in (("https://x/Contact", ""), ("https://x/y", "Our team"), ("https://x/y", "news"), ("https://contact.example/y", ""))] == [0, 1, None, None]
    assert webpage.contact("mailto:A.b@X.EXAMPLE,c@d.example?subject=q") == ("email", "A.b@x.example")
    assert webpage.contact("mailto:nobody") is webpage.contact("tel:12-34") is webpage.contact("/x") is None
    assert webpage.Page("write to &#109;d@KEXP.example").shows("md@kexp.example")
    site = webpage.Site("https://s.example/")
    assert site.owns("https://s.example/", "email", "a@s.example")
    assert not site.owns("https://s.example/about", "email", "a@gmail.example")
    assert site.owns("https://s.example/staff", "phone", "5550100200")
    page = webpage.Page("<a href=/about>x</a><a href='/about#f'>y</a><a href=https://t.example/contact>z</a><a href=/>home</a><a href=/n>contact</a>")
    assert list(site.contact_links(page)) == [("https://s.example/about", 1, 0), ("https://s.example/n", 0, 4)]


def test_routes_that_no_page_has(spark):  # noqa: ANN001, ANN201
    pages = lambda x: spark.createDataFrame([("https://s.example/", k, f"https://s.example/{u}", h) for k, (u, h) in enumerate(x)], "site string, step int, url string, html string")
    got = contacts.routes(pages([("", "<a href='mailto:a@s.example'>x</a>"), ("contact", "<a href='mailto:A@s.example'>Boss</a><a href='tel:555 0100 200'>y</a><textarea>")]))
    assert sorted((r.channel, r.value, r.addressee) for r in got.collect()) == [("email", "a@s.example", "x"), ("form", "https://s.example/contact", ""), ("phone", "555 0100 200", "y")]
    with pytest.raises(Exception, match="isn't on"):
        contacts.routes(pages([("contact", "<a href='tel:555x0100x200'>y</a>")])).collect()
    assert contacts.routes(pages([("contact", None)])).count() == 0


def test_chunks(spark):  # noqa: ANN001, ANN201
    rows = {1: "aa\n\nbb\n \ncc", 2: "x" * 25, 3: "p" * 6 + "\n\n" + "q" * 6, 4: None, 5: " \n\n ", 6: "hello\n\n" + "y" * 12 + "\n\nend"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {}
    for r in retrieval.chunked(df, 10, 3).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {1: ["aa\n\nbb\n\ncc"[:6], "\n\nbb"[-3:] + "\n\ncc"] if len("aa\n\nbb") + 4 > 10 else ["aa\n\nbb\n\ncc"], 2: ["x" * 10, "x" * 10, "x" * 10, "x" * 4], 3: ["p" * 6, "ppp\n\n" + "q" * 6], 6: ["hello", "y" * 10, "y" * 5, "end"]}


def test_batches(spark):  # noqa: ANN001, ANN201
    sizes = spark.sparkContext.accumulator(0)

    def embed(texts: list[str]) -> list[list[float]]:
        assert len(texts) <= 16
        sizes.add(1)
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.range(40).select("id", F.repeat(F.lit("a"), F.col("id").cast("int")).alias("text")).coalesce(1)
    assert {r.id: r.embedding[0] for r in retrieval.embedded(df, embed, 2).collect()} == {k: float(k) for k in range(40)}
    assert sizes.value == 3
    with pytest.raises(Exception, match="vectors of 3"):
        retrieval.embedded(df, lambda t: [[0.0, 1.0]] * len(t), 3).collect()
    lines = spark.createDataFrame([('{"recordId": "rec1", "modelOutput": {"embedding": [1, 2]}}',), ('{"recordId": "rec0", "modelOutput": {"embedding": [3, 4]}}',), ("not json",)], "line string")
    whole = retrieval.batch_results(spark.range(2), lines, 2)
    assert {r.id: r.embedding for r in retrieval.all_or_nothing(whole).collect()} == {0: [3.0, 4.0], 1: [1.0, 2.0]}
    with pytest.raises(Exception, match="record 2: missing"):
        retrieval.all_or_nothing(retrieval.batch_results(spark.range(3), lines, 2)).collect()


def test_lines_of_words(spark):  # noqa: ANN001, ANN201
    """Against the three rules, word by word."""
    words = [("spacing", " ", 0, 0, None), ("word", "So", 0, 200, -0.1), ("spacing", " ", 200, 210, None), ("word", "it", 210, 300, -0.3), ("punct", ".", 300, 310, None), ("word", "goes", 320, 500, None), ("word", "on", 1300, 1400, 0.0)]
    words += [("word", "w" * 10, 1500 + 100 * k, 1550 + 100 * k, -0.2) for k in range(8)] + [("word", "end!", 2400, 2300, -1.0), ("word", "new", 2450, 2500, -0.5)]

    def brute() -> list[tuple]:
        out, line = [], None
        for kind, text, a, b, p in words:
            if kind != "word":
                if line:
                    line["text"] += text
                    line["closed"] |= re.search(scalars.CLOSERS, text.strip()) is not None
                continue
            if line and (line["closed"] or a - line["end"] > 700 or len(line["text"].strip()) + 1 + len(text) > 42):
                out.append(line)
                line = None
            if line is None:
                line = {"text": "", "start": a, "p": [], "closed": False}
            elif not line["text"].endswith(" "):
                line["text"] += " "
            line["text"] += text
            line["end"] = max(a, b)
            line["p"] += [] if p is None else [p]
            line["closed"] |= re.search(scalars.CLOSERS, text) is not None
        return [(x["text"].strip(), x["start"], x["end"], round(min(1.0, math.exp(sum(x["p"]) / len(x["p"]))), 9) if x["p"] else None) for x in [*out, line]]

    df = spark.createDataFrame([(1, words), (2, []), (3, None)], "id int, words array<struct<kind:string,text:string,start_ms:bigint,end_ms:bigint,logp:double>>")
    got = {r.id: r.lines for r in df.select("id", scalars.grouped_lines(F.col("words")).alias("lines")).collect()}
    assert [(x.text, x.start_ms, x.end_ms, None if x.confidence is None else round(x.confidence, 9)) for x in got[1]] == brute()
    assert len(got[1]) > 4
    assert got[2] == []
    assert got[3] is None


def test_line_scores(spark):  # noqa: ANN001, ANN201
    rows = [("Have you ever been so lost here", 0.0, 2.2, 0.6, 1.0), ("What if we never go back?", 0.0, 3.2, 2.0, 9.0), ("so", 0.0, 1.0, 0.0, 0.0), ("please subscribe to my channel now", 0.0, 2.0, 1.0, 1.0), ("one two", 0.0, 1.0, 1.0, 1.0), ("nothing special in this line", 0.0, 2.2, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "t string, s double, e double, b double, a double")
    got = [r[0] for r in df.select(scalars.line_score(*[F.col(c) for c in "tseba"])).collect()]
    want = [3.0 + 2.0 + 2.2 + 0.8 * 0.6, 2.2 + 2.0 + 2.2 * 1.6 + 0.8 - 0.9, None, None, None, 0.0]
    assert [None if x is None else round(x, 9) for x in got] == [None if x is None else round(x, 9) for x in want]


def test_slug_folds(spark):  # noqa: ANN001, ANN201
    import unicodedata

    names = ["Beyoncé", "Ærø & Straße", "Łódź", "ﬁn Ǆ ½ №", "日本", "ÅNGSTRÖM--x", "ếẩ"]
    want = [re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().lower()).strip("-") for n in names]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(names)), "k int, n string").orderBy("k").select(T.slugify(F.col("n"))).collect()]
    assert got[:3] + got[4:] == want[:3] + want[4:]


def test_windows_by_rule(spark):  # noqa: ANN001, ANN201
    """(start, end, plateau) at 120 BPM, bars of two seconds: the worked cases of the rules."""
    rows = [(1100, 9000, None), (900, 30000, None), (0, 30000, 3500), (0, 1900, None), (100, 4100, 2100)]
    df = spark.createDataFrame(rows, "s long, e long, p long").coalesce(1)
    a, b = T.suggested_window(F.col("s"), F.col("e"), F.lit(0), F.lit(2000.0), F.col("p"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [(2000, 8000), (0, 10000), (0, 4000), (None, None), (0, 4000)]


def test_candidate_rules_abstain(spark):  # noqa: ANN001, ANN201
    rows = [(4000, 8000, 500.0, 2000.0, 0, 4000, 8), (4030, 8030, 500.0, 2000.0, 0, None, None), (0, 5000, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "start long, end long, beat double, bar double, grid long, drop long, plateau int").coalesce(1)
    got = [(r.loop_ok, r.on_bar_line, r.whole_bars, r.in_plateau, r.balance) for r in candidate_rules(df).collect()]
    assert got == [(True, True, True, True, 4), (True, False, True, None, 1), (True, None, None, None, 1)]


def test_kinds_in_order(spark):  # noqa: ANN001, ANN201
    names = ["Calvary Chapel University", "Baptist College", "Regents of Radio Ministries", "Lutheran High School", "Bible Church", "Friends of Radio", "Acme", None]
    got = [r[0] for r in spark.createDataFrame(pd.DataFrame({"k": range(len(names)), "n": names}), "k long, n string").orderBy("k").select(scalars.licensee_kind(F.col("n"))).collect()]
    assert got == ["network", "college", "college", "school_k12", "religious", "community", "other", "other"]


def test_rolling_captions():  # noqa: ANN201
    vtt = """WEBVTT

00:00:01.000 --> 00:00:04.560 align:start position:0%
 
So, I<00:00:01.500><c> uh</c><00:00:02.000><c> see</c>

00:00:04.560 --> 00:00:04.570
So, I uh see
 

00:00:04.570 --> 00:00:07.190
So, I uh see
&gt;&gt; come<00:00:04.720><c> in</c><00:00:04.960><c> here</c>

00:09.000 --> 00:10.000
<b>plain</b> words
at last

00:10.000 --> 00:11.000
at last
once more
"""
    assert files.timed_words(vtt) == [
        (1.0, "So,"), (1.0, "I"), (1.5, "uh"), (2.0, "see"), (4.57, ">>"), (4.57, "come"), (4.72, "in"), (4.96, "here"), (9.0, "plain"), (9.0, "words"), (9.0, "at"), (9.0, "last"), (10.0, "once"), (10.0, "more"),
    ]


def test_spectral_kernels():  # noqa: ANN201
    t = np.arange(4 * RATE) / RATE
    low, high = np.sin(2 * np.pi * 200 * t).astype(np.float32), np.sin(2 * np.pi * 3000 * t).astype(np.float32)
    assert abs(signal.centroid(low, RATE) - 200) < 30
    assert abs(signal.centroid(high, RATE) - 3000) < 30
    assert signal.centroid(np.zeros(RATE, np.float32), RATE) == 0.0
    bars = signal.bar_features(0.5 * high, RATE, 120, 0.0)
    assert len(bars) == 2
    assert all(abs(b["rms_db"] - 20 * math.log10(0.5 / math.sqrt(2))) < 0.1 for b in bars)
    assert all(b["air"] + b["presence"] > 0.99 > 0.01 > b["low"] for b in bars)


def test_onsets_and_comb():  # noqa: ANN201
    x = signal.click_train(120, 10, RATE, 0.256)
    env = signal.onset_envelope(x)
    peaks = {round(k * 0.5 + 0.256, 1) for k in range(19)}
    top = np.argsort(env)[-15:] * signal.HOP / RATE
    assert all(min(abs(t + 0.128 - p) for p in peaks) < 0.13 for t in top)  # a frame of 0.128 s ends behind its click
    assert abs(env.mean()) < 1e-6
    grid = np.array([90.0, 100.0, 110.0, 120.0, 130.0])
    score, phase = signal.comb(env, RATE, grid)
    assert grid[score.argmax()] == 120.0
    assert min(abs((phase[3] + 0.128 - 0.256 + d) % 0.5) for d in (0.0, 0.064)) < 0.1
    assert (signal.onset_envelope(np.zeros(RATE, np.float32)) == 0).all()


def test_sequences_never_cost_more():  # noqa: ANN201
    levels, target = np.array([5.0, 1.0, 3.0, 3.0, 2.0, 4.0]), np.linspace(1, 5, 6)
    order, cost = signal.order_sequence(levels, target)
    assert sorted(order) == list(range(6))
    best = min((((levels[list(o)] - target) ** 2).sum() + 0.5 * (np.diff(levels[list(o)]) == 0).sum() for o in itertools.permutations(range(6))))
    assert abs(cost - best) < 1e-9


def test_settings_merge():  # noqa: ANN201
    base = {"a": {"x": 1, "y": [1, 2]}, "b": 2, "c": {"k": 1}}
    assert extras.merged_settings(base, {"a": {"y": [3], "z": 0}, "c": 5, "d": None}) == {"a": {"x": 1, "y": [3], "z": 0}, "b": 2, "c": 5, "d": None}
    assert base["a"]["y"] == [1, 2]


def test_alignment_blocks(spark, tmp_path):  # noqa: ANN001, ANN201
    rows = [(1, 0, "a b c d"), (1, 1, "x b c y d"), (1, 2, None), (2, 0, "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(tuple(r) for r in alignment(spark, str(tmp_path)).collect()) == [(1, 1, 1, 1, 2), (1, 1, 3, 4, 1)]


def test_profiles(spark):  # noqa: ANN001, ANN201
    rows = [(1, "KX", "KX plays jazz.  Every day! " + "y" * 500 + ". Ask KX?"), (2, "n", None), (3, "q", "One. Two.")]
    got = {r.k: r.profile for r in extras.composed(spark.createDataFrame(rows, "k int, name string, body string")).collect()}
    assert got == {1: "plays jazz. Every day! Ask ?", 2: None, 3: "One. Two."}


def test_hashed_embeddings_are_unit_vectors(spark, tmp_path):  # noqa: ANN001, ANN201
    spark.createDataFrame([(1, "one two three"), (2, "one two three"), (3, "Other words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: np.array(r.embedding) for r in retrieval.hashed_embeddings(spark, str(tmp_path)).collect()}
    assert (got[1] == got[2]).all()
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 and len(v) == 64 for v in got.values())
    assert not (got[1] == got[3]).all()


def test_landing_zone(spark, tmp_path):  # noqa: ANN001, ANN201
    for state, band, line in (("GA", "FM", "|W1"), ("GA", "AM", "|W2"), ("TX", "FM", "|K1")):
        folder = tmp_path / f"state={state}" / f"band={band}"
        folder.mkdir(parents=True)
        (folder / "feed.txt").write_text(f"{line}\nx|y")
    found = filters.landed_feed(spark, str(tmp_path), "GA", "FM")
    assert sorted(r.line for r in found.collect()) == ["x|y", "|W1"]
    assert len(found.inputFiles()) == 3
    assert "PartitionFilters: [isnotnull" in found._jdf.queryExecution().toString()


def test_feed_heads(spark):  # noqa: ANN001, ANN201
    xml = "<rss><title>\n Größe </title><itunes:owner>\n<itunes:name>n</itunes:name><itunes:email> a@b.example </itunes:email></itunes:owner>" + "ü" * 50
    rows = spark.createDataFrame([("a", bytearray(xml.encode())), ("b", bytearray()), ("c", None)], "url string, content binary")
    assert sorted(map(tuple, filters.feed_heads(rows, len(xml.encode()) - 1).collect()), key=repr) == [("a", "Größe", "a@b.example", True), ("b", "", "", False), ("c", None, None, None)]


def test_byte_frames():  # noqa: ANN201
    f = byte_frames(bytes(range(200)) * 5)
    assert f.shape == (6, 12, 16)
    assert f.ravel()[:1000].tobytes() == bytes(range(200)) * 5
    assert not f.ravel()[1000:].any()
    assert byte_frames(b"").shape == (3, 12, 16)


def test_clicks():  # noqa: ANN201
    x = signal.clicks(np.array([0, 5, 99]), np.array([1.0, 4.0, 2.0]), 1.0, 8000, 0.01)
    assert len(x) == 8000
    assert [round(float(x[k]), 3) for k in (0, 400, 7920)] == [0.225, 0.9, 0.45]
    assert not signal.clicks(np.array([]), np.array([]), 1.0, 8000, 0.01).any()
    wav, rate = signal.decode_wav(signal.encode_wav(x, 8000))
    assert np.abs(wav - x).max() < 1e-3


def test_short_spectra(spark):  # noqa: ANN001, ANN201
    """The sums are those of a windowed transform of each whole frame, over any partitions."""
    rng = np.random.default_rng(2)
    tracks = {1: rng.normal(size=100), 2: rng.normal(size=16), 3: rng.normal(size=15), 4: rng.normal(size=24)}
    rows = [(t, n, float(v), len(x)) for t, x in tracks.items() for n, v in enumerate(x)]
    got = {(r.track_id, r.frame, r.bin): r.mag for r in short_spectra(spark.createDataFrame(rows, "track_id long, n long, x double, total long").repartition(5)).collect()}
    want = {}
    for t, x in tracks.items():
        for k in range(max(0, (len(x) - 16) // 8 + 1)):
            for b, v in enumerate(np.abs(np.fft.rfft(x[8 * k : 8 * k + 16] * np.hanning(16)))):
                want[t, k, b] = float(v)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_matching_blocks():  # noqa: ANN201
    """Against the standard library's matcher."""
    from difflib import SequenceMatcher

    rng = np.random.default_rng(4)
    for letters, n in (("ab", 30), ("abcdefgh", 60), ("a", 9)):
        for _ in range(40):
            x, y = (list(rng.choice(list(letters), rng.integers(0, n))) for _ in range(2))
            want = [tuple(m) for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if m.size]
            assert matching_blocks(x, y) == want


def test_sound_stays_in_its_task(spark):  # noqa: ANN001, ANN201
    """Tracks go through Spark as cells, never as sound, and rows leave Python by few."""
    assert "binary" not in dict(tracks(spark, DATA).dtypes).values()
    for made in (onset_envelope, segment_types, local_pulse, probes):
        plan = made(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan
    rows = spark.createDataFrame([(9000, "a"), (0, None), (3, "b")], "n long, s string").coalesce(1)
    many = through_python(rows, "s string, k int, x double", lambda n, s: ((s, k, None if k else float("nan")) for k in range(n)), 1000)
    assert many.count() == 9003
    assert many.filter("x IS NULL").count() == 9003
    assert sorted(r.k for r in many.filter("s = 'b'").collect()) == [0, 1, 2]


def test_tracks_are_dealt_out(spark):  # noqa: ANN001, ANN201
    """Few bytes of cells don't bring all tracks to one task, where their sound would be made one after another."""
    made = through_python(tracks(spark, DATA), "task int", lambda *_: [(TaskContext.get().partitionId(),)])
    tasks = [r.task for r in made.collect()]
    assert len(tasks) == tracks(spark, DATA).count()
    assert len(set(tasks)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.fixture
def sound_held(spark, monkeypatch):  # noqa: ANN001, ANN201
    """Of a query of sound, for 15 and 150 tracks in one Arrow batch: the rows of its Python step and the most bytes that the step held at a time."""
    taken, frame = [], type(spark.range(0))
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(frame, name, lambda self, run, schema, *a, real=getattr(frame, name), **b: taken.append((self, run)) or real(self, run, schema, *a, **b))

    def of(made):  # noqa: ANN001, ANN202
        made(spark, DATA)
        ((cells, run),) = taken  # sound is made and used in one step
        assert "binary" not in dict(cells.dtypes).values()
        few, out = cells.limit(15).toArrow(), []
        for k in (1, 1, 10):  # the first warms up
            (batch,) = pa.concat_tables([few] * k).combine_chunks().to_batches()
            tracemalloc.start()
            rows = sum(b.num_rows for b in run(iter([batch])))
            out.append((rows, tracemalloc.get_traced_memory()[1]))
            tracemalloc.stop()
        return out[1:]

    return of


def test_comb_scores_hold_the_sound_of_one_track(sound_held):  # noqa: ANN001, ANN201
    (few, least), (many, most) = sound_held(comb_scores)
    assert (few, many) == (15 * 31, 150 * 31)
    assert most < least + 2_000_000  # the scores that leave together; the sound of 135 tracks is 26 MB


def test_decoding_holds_the_sound_of_one_track(sound_held):  # noqa: ANN001, ANN201
    (few, least), (many, most) = sound_held(wav_decode)
    assert (few, many) == (15, 150)
    assert most < least + 500_000  # a row a track


@pytest.fixture
def spectra(monkeypatch):  # noqa: ANN001, ANN201
    """The lengths of the sounds that spectrograms were made of."""
    made, real = [], signal.spectrogram
    monkeypatch.setattr(signal, "spectrogram", lambda x: made.append(len(x)) or real(x))
    return made


def test_one_spectrogram_a_bar(spectra):  # noqa: ANN001, ANN201
    """What it is used for thrice is made once, and is what each use alone gives."""
    x = signal.click_train(120, 10, RATE, 0.05)
    bars = signal.bar_features(x, RATE, 120, 0.05)
    assert spectra == [16000] * 4 == [16000] * len(bars)
    for b in bars:
        part = x[400 + b["idx"] * 16000 :][:16000]
        assert (b["centroid_hz"], b["onsets"]) == (signal.centroid(part, RATE), (signal.onset_envelope(part) > 1).sum())


def test_one_spectrogram_a_third(spectra):  # noqa: ANN001, ANN201
    x = np.concatenate([signal.click_train(bpm, 8, RATE, 0.05) for bpm in (100, 150)] + [np.zeros(8 * RATE, np.float32)])
    got = signal.local_pulse(x, RATE)
    assert spectra == [64000] * 3
    assert [bpm for bpm, _ in got] == [signal.tempo(part, RATE).bpm for part in np.array_split(x, 3)]
    assert got[2] == (0.0, 0.0)


def test_many_sequences_as_one_by_one():  # noqa: ANN201
    """Ordered at once, sequences get what each gets alone, to the last bit, in a fraction of the time."""

    def alone(levels, target):  # noqa: ANN001, ANN202
        cost = lambda o: float(((levels[o] - target) ** 2).sum() + 0.5 * (levels[o][1:] == levels[o][:-1]).sum())
        order = np.argsort(levels, kind="stable")
        now = cost(order)
        for i, j in np.random.default_rng(7).integers(0, len(levels), (6000, 2)):
            order[[i, j]] = order[[j, i]]
            new = cost(order)
            if new <= now:
                now = new
            else:
                order[[i, j]] = order[[j, i]]
        return order.tolist(), now

    for n in (1, 2, 9, 24):
        levels, target = np.random.default_rng(n).integers(1, 6, (4, n)).astype(float), np.linspace(1, 5, n)
        orders, costs = signal.order_sequences(levels, target)
        assert [(o.tolist(), c) for o, c in zip(orders, costs, strict=True)] == [alone(row, target) for row in levels]


def test_word_ends_are_ascii(spark):  # noqa: ANN001, ANN201
    """As in RE2, a letter outside of ASCII ends a word."""
    rows = [("doí quecoja óbodo las", 0.0, 2.2, 0.0, 0.0), ("tionièerle éonchier épatreon ouelle", 0.0, 2.2, 0.0, 0.0), ("nothing épatreons in this line", 0.0, 2.2, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "t string, s double, e double, b double, a double").coalesce(1)
    assert [r[0] for r in df.select(scalars.line_score(*[F.col(c) for c in "tseba"])).collect()] == [2.0, None, 0.0]


def test_quantiles_to_the_last_bit(spark):  # noqa: ANN001, ANN201
    import duckdb

    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k in range(60) for v in np.round(rng.random(5 + k) * 500, 2)]
    df, duck = spark.createDataFrame(rows, "k int, v double"), duckdb.connect()
    duck.execute("CREATE TABLE t (k INTEGER, v DOUBLE)")
    duck.executemany("INSERT INTO t VALUES (?, ?)", rows)
    for q in (0.5, 0.9, 0.95):
        got = {r.k: r.p for r in exact_quantile(df, "k", "v", q, "p").collect()}
        assert got == dict(duck.execute(f"SELECT k, quantile_cont(v, {q}) FROM t GROUP BY k").fetchall())


def test_beat_grids_are_shared_by_tracks_of_one_length():  # noqa: ANN201
    """A comb's scores and phases are those of each tempo alone, and its grids are made once for a length."""
    rng, grid = np.random.default_rng(5), np.array([0.5, 70.0, 70.25, 121.3, 179.75, 3000.0])
    for n in (1, 30, 186):
        for _ in range(3):
            env = rng.normal(size=n)
            score, phase = signal.comb(env, 8000, grid, 16)
            for i, step in enumerate(60.0 / grid * 8000 / signal.HOP):
                means = []
                for p in range(16):
                    at = np.rint((p / 16 + np.arange(int(n / step) + 2)) * step).astype(int)
                    means.append(env[at[at < n]].mean() if (at < n).any() else -np.inf)
                assert score[i] == pytest.approx(max(means)) and phase[i] == pytest.approx(int(np.argmax(means)) * step / 16 * signal.HOP / 8000)
    assert signal._grids.cache_info().hits >= 6  # noqa: SLF001


def test_quantile_counts_are_few(spark):  # noqa: ANN001, ANN201
    """A key's buckets are as many as the root of its values, so its counts are few beside them."""
    v = spark.range(40000).select((F.col("id") % 4).alias("k"), F.xxhash64("id").cast("double").alias("_v"))
    assert 4 * 90 <= rows.in_buckets(v, "k", 4096).select("k", "_b").distinct().count() <= 4 * 100
    assert rows.in_buckets(v, "k", 16).filter("_b < 0 OR _b > 15 OR _n <> 10000").isEmpty()
