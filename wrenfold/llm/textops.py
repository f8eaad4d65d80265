"""Vectorised text primitives shared by the training-data operators.

Everything works on the raw UTF-8 buffer of an Arrow string column: one ``uint8`` array and the
offsets of its rows.  No Python object is made per word, byte or window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space that separates words: space and 0x09-0x0D.
WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])

_U64 = np.uint64
#: Odd multipliers of the polynomial (Rabin-Karp) hashes, modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_INV_BYTE_BASE = pow(BYTE_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads the entropy of the high bits over all 64."""
    h = h ^ (h >> _U64(30))
    h *= _U64(0xBF58476D1CE4E5B9)
    h ^= h >> _U64(27)
    h *= _U64(0x94D049BB133111EB)
    h ^= h >> _U64(31)
    return h


#: A pseudo-random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=_U64) * _U64(0xA0761D6478BD642F))

#: Byte tables: what belongs to a word, and ASCII lower case.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(WHITESPACE)] = False
ALNUM_OR_HIGH = np.zeros(256, bool)
ALNUM_OR_HIGH[0x30:0x3A] = ALNUM_OR_HIGH[0x61:0x7B] = ALNUM_OR_HIGH[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=_U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 row offsets of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def as_text(column: pa.Array) -> pa.Array:
    """A string column with UTF-8 only: what isn't is read as U+FFFD.  Parquet and casts can bring other bytes into a string."""
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([x if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()], pa.string())
    return column


def blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``table`` bytes inside each row, and for each row the index of its first word (n + 1 values)."""
    inside = table[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        at = offsets[:-1]
        before[at[at < len(data)]] = False
        at = offsets[1:]
        after[at[at > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of all stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _blocks(aligned: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, with zeros from ``ends`` on; ``aligned``: the bytes as 64-bit numbers, one more than they fill."""
    word, shift = at >> 3, ((at & 7) << 3).astype(_U64)
    found = aligned[word] >> shift
    found |= (aligned[word + 1] << _U64(1)) << (_U64(63) - shift)
    found &= _MASKS[np.minimum(ends - at, 8)]
    return found


def _aligned(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) >> 3) + 2, _U64)
    out.view(np.uint8)[: len(data)] = data
    return out


def _mixed(blocks: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """Each block mixed with its place in its word, twice: no structure of the bytes carries through a sum of these."""
    blocks = mix(blocks)
    blocks += (np.asarray(place).astype(_U64) + _U64(1)) * _U64(WORD_BASE)
    return mix(blocks)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    words, size = _aligned(data), ends - starts
    out = _mixed(_blocks(words, starts, ends), 0)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3  # blocks behind the first
        place = ranges(np.ones(len(long), np.int64), more)
        at = np.repeat(starts[long], more) + 8 * place
        out[long] += np.add.reduceat(_mixed(_blocks(words, at, np.repeat(ends[long], more)), place), np.cumsum(more) - more)
    out ^= size.astype(_U64) * _U64(BYTE_BASE)
    return mix(out)


def byte_blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as blocks of eight bytes, the last of each filled with zeros, and the n + 1 places of the words in them."""
    sizes = (ends - starts + 7) >> 3
    first = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(starts - 8 * first[:-1], sizes) + 8 * np.arange(first[-1])
    return _blocks(_aligned(data), at, np.repeat(ends, sizes)), first


def block_hashes(blocks: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What ``word_hashes`` gives, from ``byte_blocks`` and the words' sizes."""
    place = np.arange(len(blocks)) - np.repeat(first[:-1], np.diff(first))
    return mix(np.add.reduceat(_mixed(blocks, place), first[:-1]) ^ (size.astype(_U64) * _U64(BYTE_BASE)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each word (none is empty), worked in stretches of about ``limit`` bytes."""
    out = np.empty(len(starts), _U64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = _hashes(data[base : int(ends[hi - 1])], s, e)
        lo = hi
    return out


def window_hashes(items: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """Rabin-Karp hashes of every ``width`` consecutive items, by doubling: n - width + 1 values, rows not yet told apart."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, _U64)
    power, have = items, 1
    total, done = None, 0
    left = width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:  # the next ``have`` items of the window
                part = power[done : done + n]
                total = part.copy() if total is None else total * _U64(pow(base, have, 1 << 64)) + part
                done += have
            left >>= 1
            if left:
                power = power[:-have] * _U64(pow(base, have, 1 << 64)) + power[have:]
                have *= 2
    return mix(total)


def window_mask(first: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of the ``total - width + 1`` windows lie inside one row; ``first`` as find_words returns it."""
    n = max(0, total - width + 1)
    rows_end = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + width <= rows_end[:n]


def cover(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in an interval of ``width`` from one of the starts."""
    edge = np.bincount(starts, minlength=total + 1)[: total + 1] - np.bincount(np.minimum(starts + width, total), minlength=total + 1)[: total + 1]
    return np.cumsum(edge[:total]) > 0


def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of ``flags`` over each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def sorted_unique(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
