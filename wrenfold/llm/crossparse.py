"""Language identification by cross-parsing.

A text is parsed against the labelled text of a language: each phrase is the longest stretch from where the last one
ended that occurs in it.  A suffix automaton of the labelled text finds these longest matches in one step a byte; the
language whose phrases cost least, ``phrases * log2(bytes of labelled text) / bytes of the text``, wins.

Texts are compared in lower case with one space for every run of other characters than letters and marks.  They are
parsed whole, in blocks of ``BLOCK`` bytes that each begin a phrase, so that numpy takes thousands of blocks a step.

The labelled text of a language is a bounded sample, a documented parameter (``sample``: bytes of all languages
together, the same for each): pieces of ``PIECE`` bytes of all labelled texts, those with the least hashes, equal
pieces once.  The automata are built by language in tasks; their edges, a small multiple of ``sample``, are broadcast.

Cases: ``und`` with score 0 where a text is null or has no letter, and for all texts where nothing is labelled; rows
without doc_id are not learnt from and count as held out; a lang without any letter in its labelled texts is not
learnt; ties go to the name that sorts first; letters that no sample has are phrases of their own; bytes that are not
UTF-8 are read as U+FFFD; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfold.llm import textops

BLOCK, PIECE, SLICE = 1024, 256, 1 << 21
#: What a run of characters that are no letters (or marks of letters) matches; and what tells that a text has a letter.
OTHER, LETTER = r"[^\p{L}\p{M}]+", r"\p{L}"


def plain(texts: pa.Array) -> pa.Array:
    """Lower case, one space for each run of other characters, one at either end."""
    words = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(textops.as_text(texts)), OTHER, " "), " ")
    return pc.binary_join_element_wise(" ", words, " ", "")


class Automaton:
    """The suffix automaton of a byte string: from state 0, every path spells one of its substrings."""

    def __init__(self, data: bytes) -> None:
        step: list[dict[int, int]] = [{}]
        link, size, last = [-1], [0], 0
        for c in data:
            new = len(step)
            step.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:  # the shorter strings of q end elsewhere, too, and get a state of their own
                    twin = len(step)
                    step.append(dict(step[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = twin
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
            last = new
        self.states = len(step)
        self.edges = np.array([(s, c, t) for s, out in enumerate(step) for c, t in out.items()], np.int32).reshape(-1, 3)


class Languages:
    """Automata by language, as one table of steps.  An entry is (place of the next state, phrases that end) for a state and a class of bytes."""

    def __init__(self, names: list[str], sizes: list[int], states: list[int], edges: list[np.ndarray]) -> None:
        self.names, self.sizes, self.states, self.edges = names, sizes, states, edges

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries (place << 2 | phrases), the places of the roots, and the class of each byte by language."""
        parts, roots, classes, at = [], [], [], 0
        for n, edges in zip(self.states, self.edges, strict=True):
            known = np.unique(edges[:, 1])
            of = np.zeros(256, np.int32)
            of[known] = np.arange(1, len(known) + 1)
            width = len(known) + 1
            first = edges[edges[:, 0] == 0]
            # without a step the phrase ends and the next one begins with this byte; a byte that no state knows is a phrase
            again = np.full(width, at << 2 | 2, np.int32)
            again[of[first[:, 1]]] = (at + first[:, 2] * width) << 2 | 1
            steps = np.tile(again, (n, 1))
            steps[0, 0] = at << 2 | 1
            steps[edges[:, 0], of[edges[:, 1]]] = (at + edges[:, 2] * width) << 2
            parts.append(steps.ravel())
            roots.append(at)
            classes.append(of)
            at += n * width
        return np.concatenate(parts), np.array(roots, np.int32), np.array(classes, np.int32)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many phrases each row has in each language: an array of languages by rows."""
        steps, roots, classes = self.table
        size = np.diff(offsets)
        blocks = -(-size // BLOCK)
        row = np.repeat(np.arange(len(size)), blocks)
        start = textops.ranges(np.zeros(len(size), np.int64), blocks) * BLOCK + offsets[:-1][row]
        length = np.minimum(start + BLOCK, offsets[1:][row]) - start
        order = np.argsort(-length, kind="stable")
        start, length, row = start[order], length[order], row[order]
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")  # blocks longer than t
        state = np.repeat(roots[:, None], len(start), 1)
        count = np.zeros(state.shape, np.int32)
        for t, m in enumerate(active.tolist()):
            entry = steps[state[:, :m] + classes[:, data[start[:m] + t]]]
            state[:, :m] = entry >> 2
            count[:, :m] += entry & 3
        count += state != roots[:, None]
        return np.stack([np.bincount(row, c, len(size)) for c in count]) if len(roots) else np.zeros((0, len(size)))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text, and how much less its phrases cost than those of the next best (0 to 1)."""
        words = plain(texts)
        sure = pc.fill_null(pc.match_substring_regex(words, LETTER), False).to_numpy(zero_copy_only=False) & bool(self.names)
        if not sure.any():
            return ["und"] * len(words), np.zeros(len(words))
        data, offsets = textops.buffers(words)
        cost = self.phrases(data, offsets) * np.log2(1 + np.array(self.sizes))[:, None]
        best = cost.argmin(0)
        two = np.sort(cost, 0)[:2]
        score = 1 - two[0] / np.maximum(two[1], 1e-9) if len(two) > 1 else np.ones(len(words))
        return [self.names[b] if s else "und" for b, s in zip(best.tolist(), sure.tolist(), strict=True)], np.where(sure, score, 0.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose language isn't learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, sample: int = 1 << 18) -> Languages:
    """The automata of all languages of labelled rows, of ``sample`` bytes of text in all."""
    rows = docs.filter(~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    bytes_of = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # a row per language
    each = max(PIECE, sample // max(1, len(bytes_of)))
    # twice as many pieces as needed, where pieces repeat; a share of all hashes
    below = {lang: min((2 * (each + PIECE) << 64) // max(1, n), (1 << 64) - 1) for lang, n in bytes_of.items()}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = textops.buffers(batch.column("text"))
            for lo, hi in textops.blocks(at, SLICE):
                langs = batch.column("lang").slice(lo, hi - lo).to_pylist()
                words = plain(batch.column("text").slice(lo, hi - lo))
                has = pc.match_substring_regex(words, LETTER).to_numpy(zero_copy_only=False)
                data, offsets = textops.buffers(words)
                n = np.where(has, -(-np.diff(offsets) // PIECE), 0)
                row = np.repeat(np.arange(len(n)), n)
                start = textops.ranges(np.zeros(len(n), np.int64), n) * PIECE + offsets[:-1][row]
                end = np.minimum(start + PIECE, offsets[1:][row])
                key = textops.word_hashes(data, start, end)
                kept = np.flatnonzero(key <= np.array([below[x] for x in langs], np.uint64)[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[r] for r in row[kept]], pa.string()), pa.array(key[kept].view(np.int64)), pa.array([data[start[k] : end[k]].tobytes() for k in kept], pa.binary())], ["lang", "key", "piece"]
                )

    def built(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("key").to_numpy().view(np.uint64), kind="stable")
        own = table.column("piece").to_pylist()
        text = b"\n".join(own[k] for k in order)[:each]  # a line break is in no text
        made = Automaton(text)
        return pa.table({"lang": table.column("lang")[:1], "size": [len(text)], "states": [made.states], "edges": pa.array([made.edges.tobytes()], pa.binary())})

    found = rows.mapInArrow(pieces, "lang string, key long, piece binary").groupBy("lang", "key").agg(F.min("piece").alias("piece"))
    found = sorted(found.groupBy("lang").applyInArrow(built, "lang string, size long, states long, edges binary").collect())  # at most 27 bytes of edges a byte of the sample
    return Languages([r.lang for r in found], [r.size for r in found], [r.states for r in found], [np.frombuffer(r.edges, np.int32).reshape(-1, 3) for r in found])


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row: one pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            _, at = textops.buffers(batch.column("text"))
            for lo, hi in textops.blocks(at, SLICE):
                part = batch.slice(lo, hi - lo)
                lang, score = own.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")


def predict_languages(docs: DataFrame, sample: int = 1 << 18) -> DataFrame:
    return identify(docs, learn(docs, sample))
