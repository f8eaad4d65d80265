"""Suffix arrays over sets of byte strings, in numpy.

``suffix_array`` refines by prefix doubling with Larsson and Sadakane's groups: only suffixes whose group
still has company are sorted again.  A group, the rank of the suffix further on and the position are
packed into one 64-bit key, so a round is one sort.  ``common_prefixes`` gives the common prefix with the
predecessor by Kasai's observation (it falls by at most one from a position to the next): positions whose
preceding bytes differ are compared directly, all at once, and the rest follow from them.

A string ends before a sentinel of its own; sentinels sort below all bytes, in the order of the strings.
"""

from __future__ import annotations

import numpy as np

#: Positions and ranks take 21 bits each.
MOST = (1 << 21) - 2
_U = np.uint64
_LOW = _U((1 << 21) - 1)


def suffix_array(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and its inverse; ``left[i]``: bytes from i to the end of its string."""
    n = len(text)
    if n > MOST:
        raise ValueError(f"{n} bytes are more than {MOST}")
    key = np.zeros(n, _U)
    padded = np.concatenate((text, np.zeros(4, np.uint8))).astype(np.uint16)
    for j in range(4):
        key = (key << _U(9)) | np.where(left > j, padded[j : j + n] + 1, 0).astype(_U)
    key = np.sort((key << _U(21)) | np.arange(n, dtype=_U))
    sa = (key & _LOW).astype(np.int64)
    head = np.ones(n, bool)
    head[1:] = (key[1:] >> _U(21)) != (key[:-1] >> _U(21))
    where = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = where
    done, at = 4, np.arange(n)
    group = where
    while True:
        # groups with company in which some suffix goes on
        size = np.bincount(group, minlength=n) if len(group) else np.zeros(n, np.int64)
        longest = np.zeros(n, bool)
        longest[group[left[sa[at]] > done]] = True
        at = at[(size[group] > 1) & longest[group]]
        if not len(at):
            return sa, _inverse(sa)
        i = sa[at]
        more = left[i] > done
        ahead = np.zeros(len(i), np.int64)
        ahead[more] = rank[i[more] + done] + 1
        key = np.sort((rank[i].astype(_U) << _U(42)) | (ahead.astype(_U) << _U(21)) | i.astype(_U))
        i = (key & _LOW).astype(np.int64)
        sa[at] = i
        head = np.ones(len(i), bool)
        head[1:] = (key[1:] >> _U(21)) != (key[:-1] >> _U(21))
        group = np.maximum.accumulate(np.where(head, at, 0))
        rank[i] = group
        done *= 2


def _inverse(sa: np.ndarray) -> np.ndarray:
    rank = np.empty(len(sa), np.int64)
    rank[sa] = np.arange(len(sa))
    return rank


def common_prefixes(text: np.ndarray, left: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each position (in text order): the common prefix of its suffix and the one before it in the suffix array."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    first = np.ones(n, bool)
    first[1:] = left[1:] >= left[:-1]  # begins a string
    here = np.arange(n)
    p = before
    falls = (~first) & (p > 0)
    falls[falls] = ~first[p[falls]]
    falls[falls] = text[here[falls] - 1] == text[p[falls] - 1]
    # where the byte before differs: compare
    direct = np.flatnonzero(~falls & (p >= 0))
    found = np.zeros(n, np.int64)
    words = np.concatenate((text, np.zeros(16, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(words, (n + 8, 8), (1, 1))
    a, b, room, have = direct, p[direct], np.minimum(left[direct], left[p[direct]]), np.zeros(len(direct), np.int64)
    live = np.arange(len(direct))
    while len(live):
        x = np.ascontiguousarray(eight[a[live] + have[live]]).view(_U).ravel() ^ np.ascontiguousarray(eight[b[live] + have[live]]).view(_U).ravel()
        same = x == 0
        step = np.full(len(live), 8)
        odd = ~same
        if odd.any():
            low = x[odd] & (~x[odd] + _U(1))  # little-endian: the lowest set bit is in the first byte that differs
            step[odd] = np.log2(low.astype(np.float64)).astype(np.int64) >> 3
        have[live] = np.minimum(have[live] + step, room[live])
        live = live[same & (have[live] < room[live])]
    found[direct] = have
    since = np.maximum.accumulate(np.where(falls, 0, here))
    return np.maximum(found[since] - (here - since), 0)


def repeated_starts(text: np.ndarray, left: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which positions begin a ``width``-byte string that begins elsewhere too, and the sorted distinct such strings' positions (one of each)."""
    sa, rank = suffix_array(text, left)
    lcp = common_prefixes(text, left, sa, rank)[sa]
    again = np.zeros(len(sa) + 1, bool)
    again[:-1] = lcp >= width
    flag = np.zeros(len(sa), bool)
    flag[sa] = again[:-1] | again[1:]
    return flag, sa[(left[sa] >= width) & ~again[:-1]]


def _compare(text: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """-1, 0, 1 for the ``width`` bytes from each a against those from each b."""
    out = np.zeros(len(a), np.int8)
    live = np.arange(len(a))
    for at in range(0, width, 64):
        if not len(live):
            break
        n = min(64, width - at)
        span = np.arange(at, at + n)
        x, y = text[a[live][:, None] + span], text[b[live][:, None] + span]
        differ = x != y
        odd = differ.any(axis=1)
        col = differ.argmax(axis=1)
        rows = np.flatnonzero(odd)
        out[live[rows]] = np.where(x[rows, col[rows]] < y[rows, col[rows]], -1, 1)
        live = live[~odd]
    return out


def merge_sorted(text: np.ndarray, one: np.ndarray, two: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge two sorted lists of positions of distinct ``width``-byte strings by binary search: the union, and the members of each that the other has too."""
    if len(one) < len(two):
        union, b, a = merge_sorted(text, two, one, width)
        return union, a, b
    lo, hi = np.zeros(len(two), np.int64), np.full(len(two), len(one))
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) // 2
        less = _compare(text, one[mid], two[live], width) < 0
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
    inside = lo < len(one)
    equal = np.zeros(len(two), bool)
    equal[inside] = _compare(text, one[lo[inside]], two[inside], width) == 0
    return np.insert(one, lo[~equal], two[~equal]), one[lo[equal]], two[equal]


def across_shards(text: np.ndarray, lists: list[np.ndarray], width: int) -> np.ndarray:
    """Positions (of one per shard and string) whose string is in more than one of the sorted lists: lists merge in pairs, then pairs of pairs."""
    hits: list[np.ndarray] = []
    while len(lists) > 1:
        merged = []
        for k in range(0, len(lists) - 1, 2):
            union, a, b = merge_sorted(text, lists[k], lists[k + 1], width)
            hits += [a, b]
            merged.append(union)
        lists = merged + lists[len(lists) // 2 * 2 :]
    return np.concatenate(hits) if hits else np.zeros(0, np.int64)
