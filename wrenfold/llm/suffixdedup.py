"""Removal of repeated byte strings by suffix arrays.

Every byte under a ``width``-byte string that starts at another place too, in the same document or another,
is removed; all such strings are judged on the input.

1. Equal texts become one, with their number (texts of at least ``width`` bytes that occur twice go whole).
2. Texts lie in shards.  Each start of a ``width``-byte string is given the minimiser of that string: the
   least hash of its ``GRAM``-byte substrings.  Equal strings have equal minimisers, so a minimiser that has
   one place in the whole corpus rules out all starts under it.  Shards learn through the key exchange which
   of theirs are shared.  Nothing else is ruled out, and no start is sampled.
3. Stretches of text under shared minimisers go to bins by minimiser; one that a shard or bin holds more than
   twice is laid out twice.  A bin lays its stretches into shards of at most ``ARRAY`` bytes, builds the suffix
   array of each (Larsson-Sadakane refinement) and its common prefixes (Kasai), and merges the sorted strings of
   shards that split a minimiser by binary search: these alone say which strings repeat.  A minimiser with
   more than ``HOT`` places is first split by the hash of each string, so no bin gathers it.
4. The repeated starts return to the shards that hold them, which cut the texts.

The text is shuffled once; the three passes over it read the same exchange.  A shard's arrays take about 30
bytes for each byte of its text, so a single text of many MB needs as much; all else is bounded.

Cases: a null text is empty and nothing is removed; texts shorter than ``width`` keep all bytes; repeated
rows count as other places; null ids are carried along; bytes that are not UTF-8 count as they are; other columns, of whatever name, are ignored or carried; an empty table gives an
empty result.  Where a cut splits a character, ``kept`` as text drops its other bytes too.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenfold.llm import exchange, suffixarray, textops
from wrenfold.llm.ranks import spread_join
from wrenfold.llm.storage import carried, free_name, stored, text_bytes
from wrenfold.llm.textops import ranges as _gather

GRAM = 32
HOT = 4096
CHUNK = 1 << 18
#: Bytes of one suffix array.
ARRAY = 1 << 20
#: Bytes of text that are cut at a time.
BLOCK = 1 << 19
_U = np.uint64

PIECES = "bin int, shard long, payload binary"
MARKS = "shard long, payload binary"
CUTS = T.StructType([
    T.StructField("grp", T.BinaryType()), T.StructField("copies", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType()),
])


def minimisers(data: np.ndarray, fits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with one minimiser at one place: first start, end, the minimiser's hash (40 bits), its place.

    ``fits``: the starts whose string ends in their text; the others have none.  Among equal hashes the leftmost place counts, which
    depends on the string alone.
    """
    n, grams = len(data), width - GRAM + 1
    out: list[tuple[np.ndarray, ...]] = []
    low = _U((1 << 24) - 1)
    for base in range(0, n, CHUNK):
        stop = min(n, base + CHUNK + width - 1)
        m = stop - base - width + 1
        if m <= 0:
            break
        sums = np.empty(stop - base + 1, _U)
        sums[0] = 0
        np.cumsum(textops.BYTE_VALUES[data[base:stop]] * textops.powers(textops.BYTE_BASE, stop - base), out=sums[1:])
        g = (sums[GRAM:] - sums[:-GRAM]) * textops.powers(textops._INV_BYTE_BASE, stop - base)[: stop - base - GRAM + 1]
        key = (textops.mix(g) & ~low) | np.arange(len(g), dtype=_U)
        have = 1
        while have * 2 <= grams:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < grams:
            key = np.minimum(key[: len(key) - (grams - have)], key[grams - have :])
        ok = fits[base : base + m]
        change = np.ones(m, bool)
        change[1:] = (key[1:] != key[:-1]) | (ok[1:] != ok[:-1])
        at = np.flatnonzero(change)
        end = np.append(at[1:], m)
        keep = ok[at]
        at, end = at[keep], end[keep]
        out.append((at + base, end + base, key[at] >> _U(24), (key[at] & low).astype(np.int64) + base))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # a run may be in two parts at a chunk's end


def _fits(offsets: np.ndarray, width: int) -> np.ndarray:
    """Which positions begin a ``width``-byte string that ends in their text."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int32)
    np.add.at(edge, offsets[:-1], 1)
    np.add.at(edge, np.maximum(offsets[1:] - width + 1, offsets[:-1]), -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _key(fp: np.ndarray) -> np.ndarray:
    return textops.mix(fp + _U(1))


def _dump(**arrays: np.ndarray) -> bytes:
    return exchange.squeeze(b"".join(len(a.tobytes()).to_bytes(8, "little") + a.tobytes() for a in arrays.values()))


def _load(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw, at, out = exchange.unsqueeze(blob), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _stretch_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches, given by start, that may overlap."""
    out, lo = np.empty(len(starts), _U), 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(starts, base + CHUNK, "right")))
        s, n = starts[lo:hi] - base, sizes[lo:hi]
        part = data[base : base + int((s + n).max())]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(textops.BYTE_VALUES[part] * textops.powers(textops.BYTE_BASE, len(part)), out=sums[1:])
        out[lo:hi] = textops.mix((sums[s + n] - sums[s]) * textops.powers(textops._INV_BYTE_BASE, len(part) + 1)[s] + n.astype(_U))
        lo = hi
    return out


def _distinct(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches: which is the first of its equals, and for each the index of that first.  Hash groups are verified byte by byte."""
    h = _stretch_hashes(data, starts, sizes)
    order = np.argsort(h, kind="stable")
    lead = np.ones(len(h), bool)
    lead[1:] = h[order[1:]] != h[order[:-1]]
    first = np.empty(len(h), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))]
    other = np.flatnonzero(first != np.arange(len(h)))
    ends = np.cumsum(np.concatenate(([0], sizes[other])))
    for lo, hi in textops.blocks(ends, BLOCK):
        part = other[lo:hi]
        same_size = sizes[part] == sizes[first[part]]
        bad = part[~same_size]
        part = part[same_size]
        differ = data[_gather(starts[part], sizes[part])] != data[_gather(starts[first[part]], sizes[part])]
        bad = np.concatenate((bad, part[np.bincount(np.repeat(np.arange(len(part)), sizes[part]), differ, minlength=len(part)) > 0]))
        first[bad] = bad  # a collision: stands for itself
    return np.flatnonzero(first == np.arange(len(h))), first


def repeated_bytes(docs: DataFrame, width: int = 200, shard_bytes: int = 4 << 20, bin_bytes: int = 3 << 20, changed_text: bool = False) -> DataFrame:
    """One row per distinct text: grp (its digest), copies, n_bytes, n_removed, n_spans, kept_sha256; with ``changed_text`` only texts that lose bytes, and kept."""
    total = text_bytes(docs)
    shards = exchange.shards_for(total, shard_bytes)
    bits = exchange.bits_for(0.2 * total)  # a minimiser in some 80 bytes, as two 64-bit numbers
    bins = 1 << max(0, math.ceil(math.log2(max(1, total / bin_bytes))))

    def send(table: pa.Table) -> pa.Table:
        data, offsets = textops.buffers(exchange.ordered(table)["text"])
        _, _, fp, place = minimisers(data, _fits(offsets, width), width)
        order = np.lexsort((place, fp))
        fp, place = fp[order], place[order]
        once = np.ones(len(fp), bool)
        once[1:] = (fp[1:] != fp[:-1]) | (place[1:] != place[:-1])
        fp = fp[once]
        lead = np.ones(len(fp), bool)
        lead[1:] = fp[1:] != fp[:-1]
        count = np.diff(np.append(np.flatnonzero(lead), len(fp)))
        keys = _key(fp[lead])
        order = np.argsort(keys)
        return exchange.sent(table["shard"][0].as_py(), keys[order], count[order], bits)

    def shared(places: np.ndarray) -> np.ndarray:
        return (places > 1).astype(np.uint8) + (places > HOT)

    def stretches(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _none(PIECES)
        shard = table["shard"][0].as_py()
        data, offsets = textops.buffers(exchange.ordered(table)["text"])
        start, end, fp, _ = minimisers(data, _fits(offsets, width), width)
        # a stretch: adjoining runs with one hash
        join = np.zeros(len(fp), bool)
        join[1:] = (fp[1:] == fp[:-1]) & (start[1:] == end[:-1])
        heads = np.flatnonzero(~join)
        if not len(heads):
            return _none(PIECES)
        multi = np.diff(np.append(heads, len(fp))) > 1
        end = end[np.append(heads[1:], len(fp)) - 1]
        start, fp = start[heads], fp[heads]
        known = textops.sorted_unique(_key(fp))
        say = exchange.received(answer)[np.searchsorted(known, _key(fp))]
        keep = say > 0
        start, end, fp, hot, multi = start[keep], end[keep], fp[keep], say[keep] > 1, multi[keep]
        key = _key(fp)
        if hot.any():  # every string of its own, by its own hash
            alone = _gather(start[hot], end[hot] - start[hot])
            own = _stretch_hashes(data, alone, np.full(len(alone), width))
            start, end, key = np.concatenate((start[~hot], alone)), np.concatenate((end[~hot], alone + 1)), np.concatenate((key[~hot], textops.mix(own)))
            multi = np.concatenate((multi[~hot], np.zeros(len(alone), bool)))
            order = np.argsort(start, kind="stable")
            start, end, key, multi = start[order], end[order], key[order], multi[order]
        if not len(start):
            return _none(PIECES)
        where = (key >> _U(40)).astype(np.int64) % bins
        sizes = end - start + width - 1
        first_of, same = _distinct(data, start, sizes)
        text_of = np.searchsorted(offsets, start, "right") - 1
        rows = {"bin": [], "payload": []}
        order = np.lexsort((start, where))
        cut = np.append(np.flatnonzero(np.diff(where[order], prepend=-1)), len(order))
        local = np.full(len(start), -1)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            mine = order[a:b]
            distinct = mine[same[mine] == mine]
            local[distinct] = np.arange(len(distinct))
            rows["bin"].append(int(where[mine[0]]))
            rows["payload"].append(_dump(
                key=key[distinct], multi=multi[distinct].astype(np.uint8), size=sizes[distinct].astype(np.int32), data=data[_gather(start[distinct], sizes[distinct])], which=local[same[mine]].astype(np.int32),
                text=text_of[mine].astype(np.int32), at=(start[mine] - offsets[text_of[mine]]).astype(np.int64),
            ))
        return pa.table({"bin": pa.array(rows["bin"], pa.int32()), "shard": pa.array([shard] * len(rows["bin"]), pa.int64()), "payload": pa.array(rows["payload"], pa.binary())})

    def judge(table: pa.Table) -> pa.Table:
        parts = [(s, *_load(p, np.uint64, np.uint8, np.int32, np.uint8, np.int32, np.int32, np.int64)) for s, p in sorted(zip(table["shard"].to_pylist(), table["payload"].to_pylist(), strict=True))]
        key = np.concatenate([p[1] for p in parts])
        multi = np.concatenate([p[2] for p in parts]).astype(bool)
        sizes = np.concatenate([p[3] for p in parts]).astype(np.int64)
        data = np.concatenate([p[4] for p in parts])
        base = np.cumsum([0, *(len(p[1]) for p in parts)])
        which = np.concatenate([p[5] + b for p, b in zip(parts, base[:-1], strict=True)])
        begins = np.cumsum(sizes) - sizes
        distinct, same = _distinct(data, begins, sizes)
        uses = np.bincount(same[which], minlength=len(key))
        flags = np.zeros(len(data), bool)  # starts of strings that repeat
        _mark(data, begins, sizes, key, multi, np.concatenate((distinct, distinct[uses[distinct] > 1])), flags, width)
        return _returned(parts, same[which], begins, sizes, flags)

    def cut(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return CUTS_EMPTY
        table = exchange.ordered(table)
        data, offsets = textops.buffers(table["text"])
        copies = table["copies"].to_numpy()
        found = [np.concatenate(x) for x in zip(*(_load(p, np.int32, np.int64, np.int32) for p in marks["payload"].to_pylist()), strict=True)] or [np.zeros(0, np.int64)] * 3
        text, at, length = (x[np.argsort(found[0], kind="stable")].astype(np.int64) for x in found)
        whole = (copies > 1) & (np.diff(offsets) >= width)
        out = []
        for lo, hi in textops.blocks(offsets, BLOCK):
            base, own = offsets[lo], slice(*np.searchsorted(text, (lo, hi)))
            ends = offsets[lo : hi + 1] - base
            edge = np.zeros(int(ends[-1]) + 1, np.int32)
            begins = ends[text[own] - lo] + at[own]
            np.add.at(edge, np.concatenate((begins, ends[:-1][whole[lo:hi]])), 1)
            np.add.at(edge, np.concatenate((begins + length[own] + width - 1, ends[1:][whole[lo:hi]])), -1)
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
            out.append(_kept(table.slice(lo, hi - lo), data[base : offsets[hi]], ends, gone, changed_text))
        return pa.concat_tables(out)

    texts = exchange.dealt(docs, shards)
    answers = exchange.ask(texts.groupBy("shard").applyInArrow(send, exchange.SENT), exchange.of_sum(shared), bits, shards)
    pieces = texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(stretches, PIECES)
    marks = pieces.groupBy("bin").applyInArrow(judge, MARKS)
    out = texts.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(cut, CUTS)
    return out if changed_text else out.drop("kept")


def _kept(table: pa.Table, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, changed_text: bool) -> pa.Table:
    """What is left of a block of texts; with ``changed_text`` of those that lose bytes."""
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    full = offsets[:-1][np.diff(offsets) > 0]
    edge[full] = gone[full]
    removed, spans = textops.per_row(gone, offsets), textops.per_row(edge, offsets)
    rows = np.flatnonzero(removed > 0) if changed_text else np.arange(len(removed))
    kept = memoryview(data[~gone])
    ends = np.cumsum(np.concatenate(([0], np.diff(offsets) - removed)))
    parts = [kept[a:b] for a, b in zip(ends[rows].tolist(), ends[rows + 1].tolist(), strict=True)]
    return pa.table({
        "grp": table["grp"].take(pa.array(rows)), "copies": table["copies"].take(pa.array(rows)), "n_bytes": np.diff(offsets)[rows], "n_removed": removed[rows], "n_spans": spans[rows],
        "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()), "kept": pa.array([bytes(p).decode(errors="ignore") if changed_text else None for p in parts], pa.string()),
    })


def _mark(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, key: np.ndarray, multi: np.ndarray, laid: np.ndarray, flags: np.ndarray, width: int) -> None:
    """Set ``flags`` where a string starts that starts elsewhere too, in this or another stretch of its minimiser; ``laid``: the stretches, one that has equals twice."""
    order = laid[np.argsort(key[laid], kind="stable")]
    lone = np.ones(len(order), bool)
    lone[1:] &= key[order[1:]] != key[order[:-1]]
    lone[:-1] &= key[order[1:]] != key[order[:-1]]
    order = order[~lone | multi[order]]  # a stretch alone repeats itself only if it holds its minimiser at two places
    if not len(order):
        return
    heads = np.append(np.flatnonzero(np.diff(key[order].view(np.int64), prepend=key[order[0]].view(np.int64) ^ 1)), len(order))
    shard: list[np.ndarray] = []
    room = most = min(ARRAY, suffixarray.MOST)
    for a, b in zip(heads[:-1], heads[1:], strict=True):
        mine = order[a:b]
        need = int(sizes[mine].sum())
        if need > most:
            _across(data, begins, sizes, mine, flags, width)
            continue
        if need > room:
            _local(data, begins, sizes, np.concatenate(shard), flags, width)
            shard, room = [], most
        shard.append(mine)
        room -= need
    if shard:
        _local(data, begins, sizes, np.concatenate(shard), flags, width)


def _local(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, mine: np.ndarray, flags: np.ndarray, width: int) -> None:
    """One shard: flags its repeated starts."""
    at = _gather(begins[mine], sizes[mine])
    left = np.repeat(np.cumsum(sizes[mine]), sizes[mine]) - np.arange(len(at))
    again, _ = suffixarray.repeated_starts(data[at], left, width)
    flags[at[again]] = True


def _across(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, mine: np.ndarray, flags: np.ndarray, width: int) -> None:
    """One minimiser in several shards: each by itself, then strings of several shards by binary search."""
    most = min(ARRAY, suffixarray.MOST)
    step = most - width
    spans: list[tuple[int, int]] = []  # long stretches are cut with an overlap, so that each string is whole in one part
    for i in mine.tolist():
        n = int(sizes[i]) - width + 1
        spans += [(int(begins[i]) + lo, min(step, n - lo) + width - 1) for lo in range(0, n, step)]
    lists, equal, group, used = [], [], [], 0
    for span in [*spans, None]:
        if span is None or used + span[1] > most:
            s = np.array(group, np.int64)
            at = _gather(s[:, 0], s[:, 1])
            left = np.repeat(np.cumsum(s[:, 1]), s[:, 1]) - np.arange(len(at))
            again, heads = suffixarray.repeated_starts(data[at], left, width)
            flags[at[again]] = True
            lists.append(at[heads])
            equal.append((at, left))
            group, used = [], 0
        if span:
            group.append(span)
            used += span[1]
    hits = suffixarray.across_shards(data, lists, width)
    flags[hits] = True  # the others of a shard's equal strings are flagged already


def _returned(parts: list, stand: np.ndarray, begins: np.ndarray, sizes: np.ndarray, flags: np.ndarray) -> pa.Table:
    """The runs of repeated starts of every use of a stretch, by the shard it lies in."""
    edge = np.zeros(len(flags) + 1, np.int8)
    edge[:-1] += flags
    edge[1:] -= flags
    edge[begins] = flags[begins]  # runs end with their stretch
    closes = begins + sizes
    edge[closes[closes < len(flags)]] = flags[closes[closes < len(flags)]]
    run = np.flatnonzero(flags & (edge[:-1] == 1))
    owner = np.searchsorted(begins, run, "right") - 1
    nxt = np.searchsorted(run, begins), np.searchsorted(run, closes)
    stop = np.flatnonzero(flags & ~np.append(flags[1:], False) | flags & np.isin(np.arange(1, len(flags) + 1), begins, kind="sort")) + 1 if len(run) else run
    shards, payloads = [], []
    used = 0
    for s, _, _, _, _, w, text, at in parts:
        uses = stand[used : used + len(w)]
        used += len(w)
        n = nxt[1][uses] - nxt[0][uses]
        mine = _gather(nxt[0][uses], n)
        if len(mine):
            use = np.repeat(np.arange(len(w)), n)
            shards.append(s)
            payloads.append(_dump(text=text[use], at=at[use] + run[mine] - begins[owner[mine]], length=(stop[mine] - run[mine]).astype(np.int32)))
    return pa.table({"shard": pa.array(shards, pa.int64()), "payload": pa.array(payloads, pa.binary())})


def _none(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.table({n: pa.array([], kinds[k]) for n, k in (f.split() for f in schema.split(", "))})


CUTS_EMPTY = pa.table({"grp": pa.array([], pa.binary()), "copies": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string()), "kept": pa.array([], pa.string())})


def dedup_substrings(docs: DataFrame, width: int = 200, shard_bytes: int = 4 << 20, bin_bytes: int = 3 << 20) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    ids = docs.select(F.col("doc_id").cast("long"), exchange.digest().alias("grp"))
    return spread_join(ids, stored(repeated_bytes(docs, width, shard_bytes, bin_bytes), "cuts"), ["grp"], "copies").drop("grp", "copies")


def cut_documents(docs: DataFrame, width: int = 200) -> DataFrame:
    """``docs`` with what repeats cut out of ``text``; a text that loses nothing stays as it is."""
    return carried(docs, lambda rows: _cut(rows, width))


def _cut(docs: DataFrame, width: int) -> DataFrame:
    grp, kept, copies = (free_name(docs, c) for c in ("_grp", "_kept", "_copies"))
    cuts = stored(repeated_bytes(docs, width, changed_text=True).select(F.col("grp").alias(grp), F.col("kept").alias(kept), F.col("copies").alias(copies)), "cuts")
    return spread_join(docs.withColumn(grp, exchange.digest()), cuts, [grp], copies, "left").withColumn("text", F.coalesce(kept, "text")).select(docs.columns)
