"""Token ids of whole texts, in numpy.

The split of a text into pieces (contractions, letters, numbers, other signs, white space) is computed
for all characters at once; each distinct piece is then encoded by the ``tokenizers`` library and its ids
are kept in a direct-mapped table of bounded size.  Pieces are found by 64-bit hashes and then compared byte by
byte.  Texts are first cut at the added tokens of the file, which have ids of their own.  The ids equal
``Tokenizer.encode(text, add_special_tokens=False)`` of a byte-level BPE without normaliser.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

from wrenfold.llm import textops

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: What may follow an apostrophe that begins a piece.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """The class of each code point: a letter (L*), a number (N*), white space, or other."""
    global _classes
    if _classes is None:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                kinds[c] = LETTER
            elif k == "N":
                kinds[c] = NUMBER
        kinds[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _classes = kinds
    return _classes


def piece_starts(chars: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where pieces begin; ``cuts``: the n + 1 offsets of the rows in ``chars``."""
    n = len(chars)
    kind = char_classes()[chars]
    row_start = np.zeros(n + 1, bool)
    row_start[cuts] = True
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin |= row_start[:n]
    space = kind == SPACE
    # the last sign of a white-space run goes apart if something follows in the row; a plain space joins what follows
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~row_start[1:n]
    begin |= last
    joins = last & (chars == 0x20)
    begin[1:] &= ~joins[:-1]
    # contractions: an apostrophe that begins a piece of its own class
    quote = np.flatnonzero((chars == 0x27) & begin)
    if len(quote):
        row_end = cuts[np.searchsorted(cuts, quote, "right")]
        padded = np.concatenate((chars, np.zeros(3, chars.dtype)))
        done = np.zeros(len(quote), bool)
        for tail in CONTRACTIONS:
            k = len(tail)
            match = ~done & (quote + k < row_end)
            for j, c in enumerate(tail):
                match &= padded[quote + 1 + j] == ord(c)
            at = quote[match]
            begin[at + 1] = False
            if k == 2:
                begin[at + 2] = False
            stop = at + k + 1
            begin[stop[stop < n]] = True
            done |= match
    return np.flatnonzero(begin)


def byte_signs() -> np.ndarray:
    """The printable character that a byte-level vocabulary writes for each byte: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = np.zeros(256, np.uint32)
    table[shown] = shown
    hidden = sorted(set(range(256)) - set(shown))
    table[hidden] = 0x100 + np.arange(len(hidden))
    return table


class PieceEncoder:
    """Ids of texts; at most ``pool`` cached ids, then the cache starts anew."""

    def __init__(self, path: str, slot_bits: int = 22, pool: int = 1 << 24) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("an added token that is not matched as it stands")
        self.added = {t.content: i for i, t in added.items()}
        self.added_at = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.model = self.tokenizer.model
        self.signs = byte_signs()
        self.mask = np.uint64((1 << slot_bits) - 1)
        self.pool_limit = pool
        self._reset(1 << slot_bits)

    def _reset(self, slots: int) -> None:
        self.keys = np.zeros(slots, np.uint64)
        self.at, self.size = np.zeros(slots, np.int32), np.zeros(slots, np.int32)  # ids in the pool
        self.own, self.length = np.zeros(slots, np.int32), np.zeros(slots, np.int32)  # blocks of the piece, and its bytes
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.blocks, self.blocks_used = np.zeros(1 << 16, np.uint64), 0

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece, by the tokenizer's own merges.  A piece is a whole word to the model, so splitting it again is left out."""
        text = self.signs[np.frombuffer(b"".join(pieces), np.uint8)].tobytes().decode("utf-32-le")
        out, at = [], 0
        tokenize = self.model.tokenize
        for p in pieces:
            out.append([t.id for t in tokenize(text[at : at + len(p)])])
            at += len(p)
        return out

    @staticmethod
    def _appended(pool: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
        """``pool`` with ``new`` from ``used`` on; it doubles until they fit."""
        while used + len(new) > len(pool):
            pool = np.concatenate((pool, np.zeros_like(pool)))
        pool[used : used + len(new)] = new
        return pool

    def encode(self, chars: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows and their n + 1 offsets; ``chars`` are code points."""
        cuts = np.asarray(cuts, np.int64)
        text = chars.tobytes().decode("utf-32-le")
        if self.added_at is None or not self.added_at.search(text):
            return self._encode_rows(chars, cuts)
        found = [m for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False) for m in self.added_at.finditer(text, a, b)]
        starts, ends = (np.array([m.span()[k] for m in found], np.int64) for k in (0, 1))
        own = np.array([self.added[m.group()] for m in found], np.uint32)
        inside = np.zeros(len(chars) + 1, np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        inside = np.cumsum(inside)[:-1]
        ahead = np.concatenate(([0], np.cumsum(inside == 0)))  # of what is left without them
        ids, at = self._encode_rows(chars[inside == 0], np.sort(ahead[np.concatenate((cuts, starts))]))
        edges = np.sort(np.concatenate((cuts, starts)))  # no added token is empty or crosses a cut: same order as ahead of it
        places = at[np.searchsorted(edges, starts, "right") - 1]
        return np.insert(ids, places, own), at[np.searchsorted(edges, cuts)] + np.searchsorted(starts, cuts)

    def _encode_rows(self, chars: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for rows without added tokens."""
        if not len(chars):
            return np.zeros(0, np.uint32), np.zeros(len(cuts), np.int64)
        if self.used > self.pool_limit:
            self._reset(len(self.keys))
        starts = piece_starts(chars, cuts)
        data = np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8)
        lead = starts if len(data) == len(chars) else np.flatnonzero((data & 0xC0) != 0x80)[starts]  # in bytes
        ends = np.append(lead[1:], len(data))
        length, (blocks, first) = ends - lead, textops.byte_blocks(data, lead, ends)
        count = np.diff(first)
        hashes = textops.block_hashes(blocks, first, length) | (np.uint64(1) << np.uint64(63))  # never 0, the empty slot
        slot = (hashes & self.mask).astype(np.int64)
        hit = np.flatnonzero((self.keys[slot] == hashes) & (self.length[slot] == length))
        hit = hit[_same(self.blocks, self.own[slot[hit]], blocks, first[hit], count[hit])]
        at, size = np.zeros(len(lead), np.int64), np.zeros(len(lead), np.int64)
        at[hit], size[hit] = self.at[slot[hit]], self.size[slot[hit]]
        todo = np.ones(len(lead), bool)
        todo[hit] = False
        todo, raw = np.flatnonzero(todo), data.tobytes()
        while len(todo):  # again only for pieces that share a hash with another of this call
            todo = todo[np.argsort(hashes[todo], kind="stable")]
            new = np.concatenate(([True], hashes[todo[1:]] != hashes[todo[:-1]]))
            heads, group = todo[new], np.cumsum(new) - 1
            found = self._encode([raw[a:b] for a, b in zip(lead[heads].tolist(), ends[heads].tolist(), strict=True)])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            places = self.used + np.cumsum(sizes) - sizes
            self.pool = self._appended(self.pool, self.used, np.fromiter((i for f in found for i in f), np.uint32, int(sizes.sum())))
            own = self.blocks_used + np.cumsum(count[heads]) - count[heads]
            self.blocks = self._appended(self.blocks, self.blocks_used, blocks[textops.ranges(first[heads], count[heads])])
            self.used, self.blocks_used = self.used + int(sizes.sum()), self.blocks_used + int(count[heads].sum())
            s = slot[heads]
            self.keys[s], self.at[s], self.size[s], self.own[s], self.length[s] = hashes[heads], places, sizes, own, length[heads]
            mine = length[todo] == length[heads][group]
            mine[mine] = _same(blocks, first[heads[group[mine]]], blocks, first[todo[mine]], count[todo[mine]])
            at[todo[mine]], size[todo[mine]] = places[group[mine]], sizes[group[mine]]
            todo = todo[~mine]
        total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        ids = self.pool[np.arange(total[-1]) + np.repeat(at - total[:-1], size)]
        return ids, total[np.searchsorted(starts, cuts)]


def _same(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether runs of ``count`` blocks (one at least) of x and y are equal."""
    if not len(count):
        return np.zeros(0, bool)
    same = x[x_at] == y[y_at]
    long = np.flatnonzero(same & (count > 1))
    if len(long):
        more = count[long] - 1
        differ = x[textops.ranges(x_at[long] + 1, more)] != y[textops.ranges(y_at[long] + 1, more)]
        same[long] = ~np.logical_or.reduceat(differ, np.cumsum(more) - more)
    return same
