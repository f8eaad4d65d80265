"""The training-data operators against brute force, and on nulls, empty and repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from wrenfold.llm import decontaminate, exchange, licenses, merkle, ngramjoin, ogg, packing, sharding, suffixarray, suffixdedup, textops, toxicity, windowdedup
from wrenfold.llm.components import components

WORD, ALNUM = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def corpus() -> list[tuple]:
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéö1") for _ in range(rng.randint(1, 8))) for _ in range(250)]
    base = [[rng.choice(words) for _ in range(rng.randint(40, 160))] for _ in range(5)]
    rows: list[tuple] = []
    for b in base:
        for k in range(12):
            w = list(b)
            for _ in range(k % 5):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w) + ("\n" if k % 2 else "")))
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "a b"), (504, "A  B"), (505, "x" * 3000), (506, "ab" * 300 + "é" * 250), (None, rows[0][1]), (None, "solo words"), (3, rows[3][1]), (507, rows[20][1]), (508, " ".join(base[1] + base[2]))]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):  # noqa: ANN001, ANN201
    """With columns whose names the operators use inside."""
    names = ["shard", "grp", "salt", "part", "copies", "_id", "_grp", "rank", "_row", "length", "held_out", "score", "bin", "payload", "kept", "gram", "rid", "root", "y", "id", "t", "least", "_copies", "_stays", "_salt", "stays", "n_words", "size"]
    return spark.createDataFrame([(*r, *["q"] * len(names)) for r in ROWS], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))


@pytest.fixture(scope="module")
def empty(docs):  # noqa: ANN001, ANN201
    return docs.limit(0)


def rows_of(df) -> list[tuple]:  # noqa: ANN001
    return sorted(map(tuple, df.collect()), key=repr)


def test_text_core():  # noqa: ANN201
    rng = np.random.default_rng(0)
    for w in (1, 2, 5, 13, 20):
        items = rng.integers(0, 4, 60).astype(np.uint64)
        h = textops.window_hashes(items, w)
        seen = collections.defaultdict(set)
        for i in range(60 - w + 1):
            seen[tuple(items[i : i + w].tolist())].add(int(h[i]))
        assert all(len(v) == 1 for v in seen.values())
        assert len({next(iter(v)) for v in seen.values()}) == len(seen)
    keys = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    assert (exchange.unpack_sorted(exchange.pack_sorted(keys)) == keys).all()


def test_structured_words_differ():  # noqa: ANN201
    """Words of the Thue-Morse sequence and of its complement collide under every polynomial modulo a power of two."""
    for doublings in (3, 8, 10, 12):
        one, two = b"a", b"b"
        for _ in range(doublings):
            one, two = one + two, two + one
        data = np.frombuffer(one + b" " + two + b" " + one, np.uint8)
        h = textops.word_hashes(data, *textops.find_words(data, np.array([0, len(data)]), textops.NOT_SPACE)[:2])
        assert h[0] == h[2] != h[1]
    rng = random.Random(5)
    words = [bytes(rng.randint(1, 255) for _ in range(rng.randint(1, 70))).replace(b" ", b"x") for _ in range(400)] + [b"a", b"a\0", b"a\0\0", b"aaaaaaaa", b"aaaaaaaa\0"]
    ends = np.cumsum([len(w) for w in words])
    h = textops.word_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends, 50)
    assert len({*h.tolist()}) == len({*words})


@pytest.mark.parametrize(("fan", "bits"), [(10, 0), (10, 6), (2, 2), (2, 6), (1, 5)])
def test_key_exchange(spark, fan, bits):  # noqa: ANN001, ANN201
    """Over any number of levels the answers are those of one table of all keys; rows sent are bounded by shards and levels."""
    rng = np.random.default_rng(bits)
    pool = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)
    keys = [np.unique(rng.choice(pool, 60)) for _ in range(23)]
    vals = [rng.integers(-5, 5, len(k)) for k in keys]
    import pandas as pd

    frames = pd.concat([exchange.sent(s, k, v, bits, fan=fan).to_pandas() for s, (k, v) in enumerate(zip(keys, vals, strict=True))])
    lists = spark.createDataFrame(frames, exchange.SENT)
    total, first = collections.Counter(), {}
    for s, (k, v) in enumerate(zip(keys, vals, strict=True)):
        for x, n in zip(k.tolist(), v.tolist(), strict=True):
            total[x] += n
            first[x] = min(first.get(x, (99, 99)), (n, s))
    for question, want in ((exchange.of_sum(lambda t: t % 7), lambda s, x, n: total[x] % 7), (exchange.of_first(), lambda s, x, n: int(first[x] != (n, s)))):
        got = exchange.ask(lists, question, bits, len(keys), fan=fan).toPandas()
        for s, (k, v) in enumerate(zip(keys, vals, strict=True)):
            said = exchange.received(exchange.pa.Table.from_pandas(got[got["shard"] == s]))
            assert said.tolist() == [want(s, x, n) for x, n in zip(k.tolist(), v.tolist(), strict=True)]


def test_hot_keys_are_spread(spark):  # noqa: ANN001, ANN201
    from pyspark.sql import functions as F

    from wrenfold.llm.ranks import spread_join

    rows = spark.range(3000).select("id", F.expr("IF(id % 3 = 0, 7, id)").alias("k"))
    side = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    for how in ("inner", "left"):
        got = spread_join(rows, side.filter("k % 2 = 1"), ["k"], "n", how, least=50).select("id", "k", "least")
        want = rows.join(side.filter("k % 2 = 1"), "k", how).select("id", "k", "least")
        assert rows_of(got) == rows_of(want)


def test_one_text_many_ids(spark):  # noqa: ANN001, ANN201
    """A third of all rows is one text, most without an id."""
    rows = [(None if k % 3 else k, "the same words " * 12) for k in range(600)] + [(1000 + k, f"word{k} " * 5) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(windowdedup.dedup_windows(docs, 20, 9000).drop("n_intervals")) == brute_windows(rows, 20)
    assert rows_of(suffixdedup.dedup_substrings(docs, 60, 9000, 3000)) == brute_bytes(rows, 60)
    assert rows_of(ngramjoin.near_duplicates(docs).filter("doc_id < 1000")) == sorted(((k, 3, 0) for k in range(0, 600, 3)), key=repr)
    assert ngramjoin.keep_one(docs).count() == 51


def brute_windows(rows, width):  # noqa: ANN001, ANN201
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            if x in seen:
                gone[k : k + width] = [True] * width
            seen.add(x)
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_bytes", [1500, 1 << 30])
def test_window_dedup(docs, empty, shard_bytes):  # noqa: ANN001, ANN201
    assert rows_of(windowdedup.dedup_windows(docs, 20, shard_bytes).drop("n_intervals")) == brute_windows(ROWS, 20)
    assert rows_of(windowdedup.dedup_windows(empty)) == []


def brute_bytes(rows, width):  # noqa: ANN001, ANN201
    count = collections.Counter(b[k : k + width] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - width + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard_bytes", "hot"), [(1500, 4096), (1 << 30, 4096), (1500, 2)])
def test_substring_dedup(docs, empty, monkeypatch, shard_bytes, hot):  # noqa: ANN001, ANN201
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    assert rows_of(suffixdedup.dedup_substrings(docs, 200, shard_bytes, 1500)) == brute_bytes(ROWS, 200)
    assert rows_of(suffixdedup.dedup_substrings(empty)) == []


def brute_cut(rows, width):  # noqa: ANN001, ANN201
    """What is left of each text; of a character that a cut splits nothing is."""
    count = collections.Counter(b[k : k + width] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - width + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        out.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore") if any(gone) else t))
    return sorted(out, key=repr)


def test_cut_documents(docs, empty):  # noqa: ANN001, ANN201
    out = suffixdedup.cut_documents(docs)
    assert out.columns == docs.columns
    assert rows_of(out.select("doc_id", "text")) == brute_cut(ROWS, 200)
    assert {tuple(r)[2:] for r in out.collect()} == {tuple(r)[2:] for r in docs.collect()}
    assert suffixdedup.cut_documents(empty).count() == 0


def test_suffix_array_and_merge():  # noqa: ANN201
    rng = random.Random(3)
    for _ in range(60):
        strs = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(2, 6))]
        text = np.frombuffer(b"".join(strs), np.uint8)
        left = np.concatenate([np.arange(len(s), 0, -1) for s in strs])
        base = np.cumsum([0, *map(len, strs)])
        sa, rank = suffixarray.suffix_array(text, left)
        want = sorted(range(len(text)), key=lambda i: ([b + 1 for b in text[i : i + left[i]].tolist()] + [0], np.searchsorted(base, i, "right")))
        assert sa.tolist() == want
        lcp = suffixarray.common_prefixes(text, left, sa, rank)
        for a, b in zip(want, want[1:], strict=False):
            x, y = bytes(text[a : a + left[a]]), bytes(text[b : b + left[b]])
            assert lcp[b] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        cut = base[len(strs) // 2]
        _, one = suffixarray.repeated_starts(text[:cut], left[:cut], 5)
        _, two = suffixarray.repeated_starts(text[cut:], left[cut:], 5)
        hits = suffixarray.across_shards(text, [one, two + cut], 5).tolist()
        of = lambda ix: {bytes(text[i : i + 5]) for i in ix}  # noqa: B023, E731
        assert of(hits) == of(one.tolist()) & of((two + cut).tolist())


def test_split_minimiser(monkeypatch):  # noqa: ANN001, ANN201
    """A minimiser with more bytes than a suffix array takes: shards and binary search give the same as one array."""
    monkeypatch.setattr(suffixarray, "MOST", 1200)
    rng = random.Random(1)
    parts = [("".join(rng.choice("ab") for _ in range(30)) + "k" * 32 + "".join(rng.choice("ab") for _ in range(10 + i % 3))).encode() * (1 + i % 2) for i in range(30)] * 2
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array(list(map(len, parts)))
    begins = np.cumsum(sizes) - sizes
    flags = np.zeros(len(data), bool)
    suffixdedup._across(data, begins, sizes, np.arange(len(parts)), flags, 40)
    count = collections.Counter(p[k : k + 40] for p in parts for k in range(len(p) - 39))
    assert flags.tolist() == [k + 40 <= len(p) and count[p[k : k + 40]] > 1 for p in parts for k in range(len(p))]


def brute_links(rows, width=4, percent=85):  # noqa: ANN001, ANN201
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(sets[k]), least.get(top(k))) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("shard_bytes", [1500, 1 << 30])
def test_ngram_join(docs, shard_bytes):  # noqa: ANN001, ANN201
    assert rows_of(ngramjoin.near_duplicates(docs, 4, 85, shard_bytes)) == brute_links(ROWS)
    assert rows_of(ngramjoin.near_duplicates(docs, shard_bytes=shard_bytes)) == brute_links(ROWS, 5, 80)


def test_hot_ngrams_and_many_copies(spark):  # noqa: ANN001, ANN201
    """A passage that many unlinked texts share, texts of little else, and one text with thousands of copies."""
    shared = "all of these words stand in every text of this kind and say nothing"
    rows = [(k, f"{shared} " + " ".join(f"own{k}x{j}" for j in range(40))) for k in range(300)]
    rows += [(1000 + k, f"{shared} a{k}") for k in range(40)]  # each links with most of the others
    copies = spark.range(5000).selectExpr("id + 10000 AS doc_id", "'one text that is here again and again and again for thousands of rows' AS text")
    got = {r.doc_id: r.component_id for r in ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").union(copies), 4, 85, 20_000).collect()}
    want = {i: c for i, _, c in brute_links(rows)}
    assert {i: c for i, c in got.items() if i < 10000} == want
    assert len({want[k] for k in range(300)}) == 300
    assert {c for i, c in got.items() if i >= 10000} == {10000}
    assert len(got) == len(rows) + 5000


def test_ngram_join_empty_and_keep_one(docs, empty):  # noqa: ANN001, ANN201
    assert rows_of(ngramjoin.near_duplicates(empty)) == []
    kept = ngramjoin.keep_one(docs)
    assert kept.columns == docs.columns
    links = brute_links(ROWS, 5, 80)
    assert kept.count() == sum(n == 0 for _, n, _ in links) + len({c for _, n, c in links if n and c is not None}) + sum(1 for i, n, c in links if n and c is None)


def test_components(spark):  # noqa: ANN001, ANN201
    pairs = [(1, 2), (2, 3), (9, 3), (20, 21), (21, 22), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20} | {k: 100 for k in range(100, 141)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_contamination(rows, items, width=13):  # noqa: ANN001, ANN201
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t or ""))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(None if i is None else str(i))
    out = []
    for i, t in rows:
        w = ALNUM.findall(low(t or ""))
        hit, who = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    who |= found
                    hit[k : k + n] = [True] * n
        out.append((i, len(w), sum(hit), len(who), hashlib.sha256(",".join(sorted(who - {None})).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=repr)


def test_windows_stay_small():  # noqa: ANN201
    """The set takes some ten bytes for each byte of the benchmark, however many items there are, and hits are verified."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    items = [(str(k), " ".join(rng.choice(words) for _ in range(200)).encode()) for k in range(300)] + [("many", items_text) for items_text in [b"one two three"] * 50]
    found = decontaminate.Windows(items, 13)
    arrays = [found.data, *[x for part in found.by_length.values() for x in part[:4]]]
    assert sum(a.nbytes for a in arrays) < 10 * sum(len(t) for _, t in items)
    text = b"x " + items[7][1] + b" y one, two three"
    first, hit, who = found.scan(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert (int(hit.sum()), {found.names[i] for i in who[0]}) == (203, {"7", "many"})
    for part in found.by_length.values():
        part[0][:] = part[0][0]  # all windows collide
    first, hit, who = found.scan(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert {found.names[i] for i in who[0]} <= {"7", "many"}


@pytest.mark.parametrize("part_bytes", [16 << 20, 100])
def test_decontamination(spark, docs, empty, part_bytes):  # noqa: ANN001, ANN201
    items = [("1", " ".join(ROWS[0][1].upper().split()[5:40])), ("10", "a, B"), ("2", None), ("2", "!!"), (None, ROWS[30][1]), ("null", ROWS[30][1]), (None, ROWS[31][1]), ("7", "nothing of the kind"), ("7", "nothing of the kind"), ("11", ROWS[0][1])]
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id string, text string, n string")
    run = lambda d, **k: decontaminate.decontaminate(d, bench, part_bytes=part_bytes, **k)
    want = brute_contamination(ROWS, items)
    assert rows_of(run(docs)) == want
    assert rows_of(run(empty)) == []
    assert run(docs, clean="documents").count() == sum(not r[5] for r in want)
    spans = {r.doc_id: r.clean_text for r in run(docs, clean="spans").collect()}
    assert spans[503] == ""
    assert spans[505] == "x" * 3000
    assert spans[500] is None
    assert rows_of(decontaminate.decontaminate(docs, bench.limit(0), part_bytes=part_bytes)) == brute_contamination(ROWS, [])


def test_sharding(docs, empty):  # noqa: ANN001, ANN201
    got = sharding.shard_documents(docs, shards=4).collect()
    assert len(got) == len(ROWS)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS)
    slots = collections.defaultdict(list)
    groups = collections.defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        groups[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    assert sharding.shard_documents(empty, shards=4).count() == 0
    assert not any(r.group_cut for r in got)
    fixed = sharding.shard_documents(docs, shards=None, capacity=6000).groupBy("shard").sum("size").collect()
    assert all(r[1] <= 6000 for r in fixed)
    with pytest.raises(ValueError, match="larger than a shard"):
        sharding.shard_documents(docs, shards=None, capacity=3007)
    assert max(r[1] for r in sharding.shard_documents(docs, shards=None, capacity=3008).groupBy("shard").sum("size").collect()) <= 3008


def test_sharding_splits_only_what_is_too_large(spark):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(i, "same text" * 5) for i in range(300)] + [(1000 + i, "y" * i) for i in range(60)], "doc_id long, text string")
    sizes = collections.Counter()
    for r in sharding.shard_documents(rows, shards=5).collect():
        sizes[r.shard] += r["size"]
        assert r.group_cut == (r.doc_id < 1000)
    assert max(sizes.values()) - min(sizes.values()) <= 120


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_plans(seed):  # noqa: ANN001, ANN201
    """Runs of equal items give what one-by-one best fit decreasing gives."""
    rng = random.Random(seed)
    sizes = [rng.randint(1, 60) for _ in range(400)]
    left: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [x for x in left if x >= s]
        if fits:
            left[left.index(min(fits))] -= s
        else:
            left.append(100 - s)
    histogram = dict(collections.Counter(sizes))
    runs, windows = packing.best_fit_decreasing(histogram, 100)
    assert windows == len(left)
    used = collections.defaultdict(list)
    for r in runs:
        for k in range(r.count):
            used[r.window + k // r.each].append((r.offset + k % r.each * r.length, r.length))
    assert sum(map(len, used.values())) == 400
    for spans in used.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 100
    assert sorted(100 - sum(n for _, n in s) for s in used.values()) == sorted(left)
    plan = sharding.best_fit_decreasing(histogram, 100)
    assert 1 + max(p[3] for p in plan) == len(left)


def test_packing(docs, empty):  # noqa: ANN001, ANN201
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    ids = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in ROWS]
    got = packing.pack(docs, path, capacity=128, keep_ids=True).collect()
    whole = collections.Counter()
    seqs = collections.defaultdict(list)
    by = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32
        assert len(r.ids) == 4 * r.length
        seqs[r.sequence_id].append((r.offset, r.length))
        by[(r.doc_id, r.doc_tokens)].append((r.start, r.ids))
    for s in seqs.values():
        at = 0
        for a, n in sorted(s):
            assert a == at
            at += n
        assert at <= 128
    for (i, n), parts in by.items():
        copies = sum(1 for j, x in ids if (j, len(x)) == (i, n))
        whole[i] += copies
        assert sum(len(p) for _, p in parts) == 4 * n * copies
        if copies == 1:
            at = 0
            for start, piece in sorted(parts):
                assert start == at
                at += len(piece) // 4
            assert b"".join(p for _, p in sorted(parts)) == next(np.array(x, "<u4").tobytes() for j, x in ids if (j, len(x)) == (i, n))
    assert sum(whole.values()) == len(ROWS)
    assert packing.pack(empty, path).count() == 0


def test_token_ids():  # noqa: ANN201
    import public_tokenizers

    from wrenfold.llm.tokens import PieceEncoder

    enc = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), slot_bits=6, pool=200)
    rng = random.Random(2)
    signs = ["'", "  ", "\n", "s", "re", "ll", "é", "1", "½", "!", " ", "中", "\t", "\x1c", "\x85", "😀", "''", "​", "́", "<|endoftext|>", "word", "　"]
    for _ in range(30):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(40)]
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ids, cuts = enc.encode(chars, np.cumsum([0, *map(len, texts)]))
        want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == want


def test_pieces_are_verified(monkeypatch):  # noqa: ANN001, ANN201
    """Pieces that collide under the hash still get their own ids; structured words do too."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from wrenfold.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    one, two = "a", "b"
    for _ in range(12):
        one, two = one + two, two + one
    texts = [one, two, f"{two} {one}", "some words and some other words", "wordswordswords wordswordsword"] * 3

    def check() -> None:
        enc = tokens.PieceEncoder(path, slot_bits=4)
        for _ in range(2):
            ids, cuts = enc.encode(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)]))
            assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]

    check()
    monkeypatch.setattr(tokens.textops, "block_hashes", lambda blocks, first, size: size.astype(np.uint64))
    check()


def test_added_tokens(spark):  # noqa: ANN001, ANN201
    import public_tokenizers
    from tokenizers import Tokenizer

    from wrenfold.llm.tokens import PieceEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), PieceEncoder(path)
    end, rng = "<|endoftext|>", random.Random(3)
    parts = [end, end, " ", "  ", "\n", "a", "'s", "'", "é", "<|endof", "text|>", "1", ""]
    batches = [["a <|endoftext|> b", "", end, end * 3, "x<|endof", "text|>y", f"it{end}'s"]]
    batches += [["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(30)] for _ in range(40)]
    for texts in batches:
        ids, cuts = enc.encode(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)]))
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    texts = batches[0]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, keep_ids=True).collect()}
    assert got == {k: [*tok.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    assert got[0] == [64, 220, 50256, 275, 1]


def demuxed(raw: bytes) -> dict[int, bytes]:
    """The payloads of each logical stream, page by page, with nothing checked; the header packet of a stream is left out."""
    packets: dict[int, list[bytes]] = collections.defaultdict(lambda: [b""])
    at = 0
    while at < len(raw):
        serial, n = int.from_bytes(raw[at + 14 : at + 18], "little"), raw[at + 26]
        lacing, at = raw[at + 27 : at + 27 + n], at + 27 + n
        for size in lacing:
            packets[serial][-1] += raw[at : at + size]
            at += size
            if size < 255:
                packets[serial].append(b"")
    return {s: b"".join(p[1:]) for s, p in packets.items()}


def test_ogg(spark, docs, empty):  # noqa: ANN001, ANN201
    def slow(data: bytes) -> int:
        c = 0
        for b in data:
            c ^= b << 24
            for _ in range(8):
                c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        return c

    assert all(ogg.checksum(x) == slow(x) for x in (b"", b"a", b"OggS" * 99))
    rng = np.random.default_rng(0)
    for n in (0, 1, 64, 4000, 65025, 255 * 255 * 2 + 9):
        text = rng.integers(0, 256, n, np.uint8).tobytes()
        media = ogg.write_samples(ogg.payload_of(text))
        back, streams = ogg.read_samples(media)
        assert back[:n] == text
        assert len(back) % 64 == 0 < len(back)
        assert streams[ogg.SAMPLES].ends[-1] == len(back)
        for at in (5, len(media) // 2, len(media) - 1):
            with pytest.raises(ogg.OggError):
                ogg.read(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
        with pytest.raises(ogg.OggError):
            ogg.read(media[:-3])
    big = bytes(255 * 300)
    s = ogg.read(b"".join(ogg.paged(7, [(b"h", 0), (big, 5), (b"", 6)])))[7]
    assert s.packets == [b"h", big, b""]
    rows = {r.doc_id: r for r in ogg.media_columns(docs, with_media=True).collect()}
    assert (rows[500].payload_bytes, rows[500].n_bytes, rows[500].media_sha256) == (64, 0, rows[501].media_sha256)
    assert rows[505].payload_sha256 == hashlib.sha256(b"x" * 3000 + bytes(8)).hexdigest()
    for i, t in ROWS:
        raw = (t or "").encode()
        payload = raw + bytes((-len(raw) % 64) or (0 if raw else 64))
        r = rows[i] if i is not None and [x for x, _ in ROWS].count(i) == 1 else None
        if r:
            media = bytes(r.media)
            assert demuxed(media)[ogg.SAMPLES] == payload
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
            told = dict(x.split("=") for x in r.feature.split(";"))
            assert int(told["samples"]) == len(payload)
            assert int(told["mean_milli"]) == sum(payload) * 1000 // len(payload)
    assert ogg.media_columns(empty).count() == 0
    files = spark.createDataFrame([("a", bytearray(rows[505].media)), ("b", bytearray(b"junk")), ("c", None), ("d", bytearray())], "path string, content binary")
    read = ogg.read_media(files).collect()
    assert [(r.path, r.error is None) for r in read if r.path != "a"] == [("b", False), ("c", False), ("d", False)]
    assert {r.serial for r in read if r.path == "a"} == {ogg.SAMPLES, ogg.MARKS}


def test_toxicity(spark, docs, empty):  # noqa: ANN001, ANN201
    rng = random.Random(0)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = [rng.choice(words) for _ in range(30)]
        if bad:
            w[7] = rng.choice(["horrid", "vilest"])
        if i % 3 == 0:
            w[9] = "muslims" if bad else rng.choice(["christians", "jews"])  # a spurious hint
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(d, lab).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    plain, fair = (toxicity.train(d, lab, counterfactual=c) for c in (0.0, 30.0))
    neutral, swapped = (textops.LOWER[np.frombuffer(t.encode(), np.uint8)] for t in ("all muslims welcome", "all jews welcome"))
    gap = lambda m: abs(float(m.score(neutral, np.array([0, len(neutral)]))[0] - m.score(swapped, np.array([0, len(swapped)]))[0]))
    assert gap(fair) < 0.3 * gap(plain)
    scores = {r.doc_id: r.score for r in toxicity.classify(docs, lab).collect()}
    assert 0 <= scores[500] == scores[501] <= 1
    assert toxicity.classify(empty, lab).count() == 0
    none = toxicity.classify(docs, lab.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.25, 0)}  # nothing was learnt, so nothing is toxic
    kept = toxicity.score_documents(docs, toxicity.train(d, lab), keep=True)
    assert kept.columns == docs.columns


def test_template_swaps(spark):  # noqa: ANN001, ANN201
    """Texts without any mention still have swaps, and the penalty keeps added mentions from moving scores."""
    from tests.conftest import DATA

    docs, lab = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    plain, fair = (toxicity.train(docs, lab, counterfactual=c) for c in (0.0, 1.0))
    assert fair.report["swaps"] > 50
    assert fair.report["mean_change"] < 0.1 * plain.report["mean_change"]
    assert fair.report["mean_rise"] < 0.1 * plain.report["mean_rise"]
    assert set(toxicity.IDENTITY.tolist()) <= set(fair.known.tolist())


def test_fit_reaches_the_least_loss():  # noqa: ANN201
    """Against plain gradient descent with numeric gradients of the loss as the docstring states it."""
    rng = np.random.default_rng(0)
    known = np.unique(np.concatenate((toxicity.IDENTITY[:6], rng.integers(0, 1 << 22, 4)))).astype(np.int32)
    k, n = len(known), 12
    x = rng.random((n, k)) < 0.4
    y = (rng.random(n) < 0.5).astype(float)
    adds = [[np.flatnonzero((rng.random(k) < 0.2) & ~x[i]).astype(np.int32) for i in range(n)] for _ in range(2)]
    swaps = {(known[:2].tobytes(), known[2:3].tobytes()): 3, (known[4:5].tobytes(), known[1:3].tobytes()): 1}

    def loss(w: np.ndarray) -> float:
        z = x @ w[:k] + w[k]
        move = np.array([[w[a].sum() for a in side] for side in adds])
        nll = lambda t: np.mean(np.logaddexp(0, t) - y * t)
        pairs = np.mean((move[0] - move[1]) ** 2) / 3 + np.mean(move[0] ** 2) / 3 + np.mean(move[1] ** 2) / 3
        mentions = (3 * (w[2] - w[:2].sum()) ** 2 + (w[1:3].sum() - w[4]) ** 2) / 4
        return (nll(z) + nll(z + move[0]) + nll(z + move[1])) / 3 + pairs + mentions + 1e-3 / n * (w[:k] ** 2 * x.sum(axis=0)).sum()

    w, step = np.zeros(k + 1), 1e-5
    for _ in range(6000):
        w -= 0.3 * np.array([(loss(w + step * e) - loss(w - step * e)) / (2 * step) for e in np.eye(k + 1)])
    m = toxicity.fit(known, y, [np.flatnonzero(r).astype(np.int32) for r in x], tuple(adds), swaps, steps=3000, rate=0.02)
    assert abs(loss(np.append(m.weights, m.bias)) - loss(w)) < 1e-4


def test_all_swaps_count():  # noqa: ANN201
    def swaps(text: bytes) -> collections.Counter:
        out: collections.Counter = collections.Counter()
        for sentence in re.split(rb"[.!?\n]", text):
            words = [(m.start(), m.end()) for m in re.finditer(rb"[0-9a-z\x80-\xff]+", sentence)]
            for a, b in words:
                for other in toxicity._OTHERS.get(sentence[a:b], ()):
                    x, y = toxicity._of(sentence), toxicity._of(sentence[:a] + other + sentence[b:])
                    out[np.setdiff1d(x, y).tobytes(), np.setdiff1d(y, x).tobytes()] += 1
        return out

    text = low("The old man and the young woman, Muslims or Jews. All MUSLIMS welcome! all muslims welcome? Muslimsmuslims.\nwhite, whitewash and the white; Frauen und Männer\nWomen women and men_and boys 1men").encode() * 3
    got = toxicity.counterfactuals(text)
    assert got == swaps(text)
    assert sum(got.values()) > 100
    late = toxicity.counterfactuals(b"black. " * 5 + b"deaf.")
    assert sum(late.values()) == 5 * 6 + 3


MIT = """The MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_licenses(spark, docs, empty):  # noqa: ANN001, ANN201
    rows = [(1, MIT), (2, "Prose.\nLicensed under CC BY-NC 4.0.\nMore"), (3, "x\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0."), (4, None), (5, "All rights reserved."), (6, "permission is hereby granted"), (None, "SPDX-License-Identifier: MIT")]
    got = {r.doc_id: r for r in licenses.recognise(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int")).collect()}
    assert (got[1].licences, got[1].left_over, got[1].identifiers) == ("MIT", "", "MITtitle,MITgrant,MITnotice")
    assert (got[2].licences, got[2].restricted) == ("CC-BY-NC-4.0", True)
    assert got[3].licences == "Apache-2.0,MIT"
    assert (got[4].n_sentences, got[4].licences, got[4].restricted) == (0, "", False)
    assert (got[5].licences, got[5].left_over) == ("", "Reserved")
    assert got[6].n_sentences == 0
    assert licenses.recognise(empty).count() == 0
    assert licenses.recognise(docs).count() == len(ROWS)


def test_licenses_in_padding_and_joined(spark):  # noqa: ANN001, ANN201
    gpl = """This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version %d of the License, or
    (at your option) any later version."""
    rows = [(1, "/" + "*" * 5000 + " MIT License " + "*" * 5000 + "/"), (2, " " * 9000 + "Licensed under CC BY-NC 4.0"), (3, gpl % 3), (4, gpl % 2), (5, gpl.replace(",", ";", 1) % 3)]
    got = {r.doc_id: (r.licences, r.left_over) for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(licenses.oracle_sql())
    at = [c[0] for c in found.description]
    assert {r[0]: (r[at.index("licences")], r[at.index("left_over")]) for r in found.fetchall()} == got
    assert got == {1: ("MIT", ""), 2: ("CC-BY-NC-4.0", ""), 3: ("GPL-3.0-or-later", ""), 4: ("GPL-2.0-or-later", ""), 5: ("GPL-3.0-or-later", "")}


def brute_audit(a, b):  # noqa: ANN001, ANN201
    """Faults of two lists of (page_id, url, html), with trees made by hand."""
    sha = lambda x: hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()

    def record(url, html) -> bytes:  # noqa: ANN001
        body = (html or "").encode()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {url or ''}\r\nWARC-Block-Digest: sha256:{sha(body)}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    count = [collections.Counter((i, sha(record(u, h)), len(record(u, h))) for i, u, h in side) for side in (a, b)]
    ranges = collections.defaultdict(list)
    for leaf in count[0] | count[1]:
        ranges[None if leaf[0] is None else leaf[0] // 256].append(leaf)
    files = collections.defaultdict(list)
    for r, found in ranges.items():
        name = "none" if r is None else str(r)
        for leaf in found:
            files[name if len(found) <= 256 else f"{name}.{int(leaf[1][:12], 16) % -(-len(found) // 256)}"].append(leaf)
    out = []
    for name, found in files.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        at, level, lost = 0, [], []
        for slot, leaf in enumerate(found):
            n = [c[leaf] for c in count]
            level.append((at, at + leaf[2] * n[0], *["-" if k == 0 else leaf[1] if k == 1 else f"{leaf[1]}*{k}" for k in n]))
            if n[0] != n[1]:
                lost.append((slot, at, leaf, n))
            at += leaf[2] * n[0]
        for _ in range(3):
            parts = [level[k : k + 16] for k in range(0, len(level), 16)]
            level = [(p[0][0], p[-1][1], *[sha(f"{p[0][0]}:{p[-1][1]}:" + "".join(x[j] for x in p)) for j in (2, 3)]) for p in parts]
        out += [(name, slot, lo, leaf, n, level[0][2], level[0][3]) for slot, lo, leaf, n in lost]
    by_id = collections.defaultdict(list)
    for row in out:
        by_id[row[3][0]].append(row)
    rows = []
    for i, found in by_id.items():
        gone, new = [r for r in found if r[4][0] > r[4][1]], [r for r in found if r[4][0] < r[4][1]]
        if i is not None and len(gone) == len(new) == 1 and gone[0][4][0] - gone[0][4][1] == new[0][4][1] - new[0][4][0]:
            name, slot, lo, leaf, n, x, y = gone[0]
            rows.append((name, slot, lo, leaf[2], i, "changed", n[0] - n[1], leaf[1], new[0][3][1], x, y))
            continue
        rows += [(name, slot, lo, leaf[2], i, "missing", n[0] - n[1], leaf[1], None, x, y) for name, slot, lo, leaf, n, x, y in gone]
        rows += [(name, slot, None, leaf[2], i, "extra", n[1] - n[0], None, leaf[1], x, y) for name, slot, lo, leaf, n, x, y in new]
    return sorted(rows, key=repr)


def test_warc_audit(spark):  # noqa: ANN001, ANN201
    rows = [(None, None, None), (None, "u", "x"), (1, "a", "b"), (1, "a", "b"), (1, "a", "c"), (2, None, "zé")] + [(5, "q", str(k)) for k in range(700)] + [(k, "r", "t" * k) for k in range(10, 600)] + [(-3, "n", "n")] + [(None, "v", str(k)) for k in range(300)]
    schema = "page_id long, url string, html string, slot string, file string, node string, a string"
    frame = lambda x: spark.createDataFrame([(*r, "s", "s", "s", "s") for r in x], schema)
    a = frame(rows)
    hurt = [(i, u, "HURT") if i == 300 or (i, h) == (5, "44") else (i, u, h) for i, u, h in rows if i not in (301, 302) and (i, h) != (None, "7")] + [(9999, "n", "n"), (1, "a", "b"), (5, "q", "new"), (None, "v", "8")]
    want = brute_audit(rows, hurt)
    assert {(r[4], r[5]) for r in want} == {(300, "changed"), (301, "missing"), (302, "missing"), (9999, "extra"), (1, "extra"), (5, "missing"), (5, "extra"), (None, "missing"), (None, "extra")}
    assert rows_of(merkle.audit(a, frame(hurt))) == want
    assert merkle.audit(a, a).count() == 0
    assert merkle.audit(a.limit(0), a.limit(0)).count() == 0
    assert merkle.audit(a.limit(0), a.limit(5)).count() == len({r for r in map(tuple, a.limit(5).collect())})
    pages = spark.createDataFrame([(k, f"u{k}", "h" * k) for k in range(1, 700)], "page_id long, url string, html string")
    own = [tuple(r) for r in pages.collect()]
    aged = merkle.aged_replica(pages)
    assert rows_of(merkle.audit(pages, aged)) == brute_audit(own, [(r.page_id, r.url, r.html) for r in aged.collect()])


def test_warc_files(spark):  # noqa: ANN001, ANN201
    rec = lambda k: b"WARC/1.1\r\nContent-Length: %d\r\nWARC-Target-URI: u%d\r\n\r\n%s\r\n\r\n" % (k, k, b"x" * k)
    whole = b"".join(map(rec, range(300)))
    list_ = list(merkle.read_warc(whole))
    assert [(r[2], r[3]) for r in list_] == [(f"u{k}", b"x" * k) for k in range(300)]
    with pytest.raises(ValueError, match="cut"):
        list(merkle.read_warc(whole[:-5]))
    frame = lambda x: spark.createDataFrame([(p, None if c is None else bytearray(c), "q") for p, c in x], "path string, content binary, length string")
    bad = [("cut", whole[:-5]), ("junk", b"junk"), ("none", None), ("empty", b""), ("size", b"WARC/1.0\r\nContent-Type: x\r\n\r\n"), ("number", b"WARC/1.0\r\nContent-Length: 1x\r\n\r\n")]
    got = collections.Counter((r.path, r.error is None) for r in merkle.warc_records(frame([("whole", whole), *bad])).collect())
    assert got == {("whole", True): 300, ("cut", True): 299, **{(p, False): 1 for p, _ in bad}}
    at = {k: r[0] for k, r in enumerate(list_)}
    hurt = whole[: at[40] + 60] + b"y" + whole[at[40] + 61 :]
    first, second = frame([("f", whole), ("g", whole), ("h", rec(3))]), frame([("f", hurt), ("g", whole[: at[290]]), ("h", rec(3)), ("i", rec(4))])
    faults = merkle.audit_warc(first, second).collect()
    assert sorted((r.file, r.offset, r.kind) for r in faults) == sorted([("f", at[40], "changed"), ("i", 0, "extra"), *[("g", at[k], "missing") for k in range(290, 300)]])
    assert all(r.expected_sha256 == hashlib.sha256(whole[at[40] : at[41]]).hexdigest() for r in faults if r.kind == "changed")
    assert merkle.audit_warc(first, first).count() == 0
