"""A counterfactual-regularised toxicity classifier.

Logistic regression on the presence of words and word beginnings (hashed).  Identity terms are swapped in
labelled sentences, and the loss penalises what that changes:

* each mention in a labelled sentence is swapped for the other terms of its kind (all mentions of all
  sentences; equal swaps count by their number);
* a template adds a neutral mention to each labelled text, once with either term of a pair (drawn by the text's
  hash); both copies are learnt from with the text's own label, and the change of the logit between them, and
  between each and the text without it, is penalised.  So the penalty acts on any corpus, and a term that no
  labelled text mentions can't raise a score either.

``Model.report`` says how many swaps there were and how far template mentions still move scores.

The model is fitted on at most ``sample`` labelled documents (those with the least hash of their id; of several
texts of an id the least); its features are all those whose presence tells at least ``least_gain`` about the label,
2**FEATURE_BITS at the very most.  Counts of features are made in Spark; the driver gets, for each sampled document,
the positions of its features among these: at most ``sample`` rows, however long the texts are.
Scoring runs over all documents, whole texts, in one pass.

Cases: null and empty texts get the score of a text without features; labels that are null are ignored and
of several labels of an id the largest counts; with one class only, the score is the smoothed share of toxic
rows, and with no labelled rows 0.25, so nothing is called toxic; repeated documents score alike; bytes that are not UTF-8 are parts of words; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfold.llm import textops
from wrenfold.llm.storage import carried, stored

FEATURE_BITS = 22
#: Bytes of a word's beginning that are a feature of their own.
PREFIXES = (4, 6)
BLOCK = 1 << 19

# Identity terms that may stand for each other, by kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer"), ("mujeres", "hombres"), ("femmes", "hommes"),
)
_OTHERS = {t.encode(): [o.encode() for o in kind if o != t] for kind in IDENTITY_TERMS for t in kind}
_MENTION = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(_OTHERS) + rb")(?![0-9a-z\x80-\xff])")
_STOP = re.compile(rb"[.\n!?]")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of lower-cased rows and the row of each; a feature of a row may come more than once."""
    starts, ends, first = textops.find_words(data, offsets, textops.ALNUM_OR_HIGH)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    shift = np.uint64(64 - FEATURE_BITS)
    out, rows = [(textops.word_hashes(data, starts, ends) >> shift).astype(np.int64)], [row]
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        packed = np.full(len(long), k, np.uint64)
        for j in range(k):
            packed = packed * np.uint64(257) + data[starts[long] + j]
        out.append((textops.mix(packed * np.uint64(textops.WORD_BASE)) >> shift).astype(np.int64))
        rows.append(row[long])
    return np.concatenate(out), np.concatenate(rows)


def _of(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return np.unique(features(data, np.array([0, len(data)]))[0].astype(np.int32)) if len(data) else np.zeros(0, np.int32)


_TERM_FEATURES = {t: _of(t) for t in _OTHERS}
#: Features of identity terms: always part of a model.
IDENTITY = np.unique(np.concatenate([*_TERM_FEATURES.values()]))
_PAIRS = [pair for kind in IDENTITY_TERMS for pair in combinations([t.encode() for t in kind], 2)]


def counterfactuals(text: bytes) -> Counter[tuple[bytes, bytes]]:
    """(features that a swap takes away, features that it adds), as int32 bytes, and their number, for all sentences of a lower-cased text that mention identity terms."""
    out: Counter[tuple[bytes, bytes]] = Counter()
    for sentence, copies in Counter(s for s in _STOP.split(text) if _MENTION.search(s)).items():
        data = np.frombuffer(sentence, np.uint8)
        has, count = np.unique(features(data, np.array([0, len(data)]))[0].astype(np.int32), return_counts=True)
        once = has[count == 1]
        for w, mentions in Counter(_MENTION.findall(sentence)).items():
            own = _TERM_FEATURES[w]
            for other in _OTHERS[w]:
                new = _TERM_FEATURES[other]
                gone = np.setdiff1d(np.intersect1d(own, once), new)
                out[gone.tobytes(), np.setdiff1d(new, has).tobytes()] += copies * mentions
    return out


def template(text: bytes, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features that a neutral mention of either term of the text's pair would add to it."""
    return tuple(np.setdiff1d(_TERM_FEATURES[t], present) for t in _PAIRS[zlib.crc32(text) % len(_PAIRS)])


SAMPLED = "y int, present array<int>, first array<int>, second array<int>, gone array<binary>, come array<binary>, times array<bigint>"


def _sampled(batches):  # noqa: ANN001, ANN202
    for batch in batches:
        data, offsets = textops.buffers(batch.column("text"))
        for y, lo, hi in zip(batch.column("y").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            raw = textops.LOWER[data[lo:hi]].tobytes()
            pairs, present = counterfactuals(raw), _of(raw)
            first, second = template(raw, present)
            ints, blobs = pa.list_(pa.int32()), pa.list_(pa.binary())
            yield pa.RecordBatch.from_pydict({
                "y": pa.array([y], pa.int32()), "present": pa.array([present], ints), "first": pa.array([first], ints), "second": pa.array([second], ints),
                "gone": pa.array([[a for a, _ in pairs]], blobs), "come": pa.array([[b for _, b in pairs]], blobs), "times": pa.array([[*pairs.values()]], pa.list_(pa.int64())),
            })


class Model:
    """Sorted feature numbers, their weights, and the bias."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.known, self.weights, self.bias = known, weights, bias
        self.slot = None
        self.report: dict[str, float] = {}

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of lower-cased rows."""
        if self.slot is None:
            self.slot = np.zeros(1 << FEATURE_BITS, np.int32)
            self.slot[self.known] = np.arange(1, len(self.known) + 1)
        f, row = features(data, offsets)
        at = self.slot[f]
        hit = np.flatnonzero(at)
        pairs = textops.sorted_unique((row[hit].astype(np.uint64) << np.uint64(32)) | at[hit].astype(np.uint64))
        n = len(offsets) - 1
        logit = self.bias + np.bincount((pairs >> np.uint64(32)).astype(np.int64), self.weights[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1], minlength=n)[:n]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _gain(a: Column, count: Column, toxic: int, total: int) -> Column:
    """The likelihood ratio statistic G of presence against label: ``a`` toxic documents of ``count`` have the feature."""
    cells = ((a, count, toxic), (count - a, count, total - toxic), (toxic - a, total - count, toxic), (total - toxic - count + a, total - count, total - toxic))
    return sum((F.when(seen > 0, 2 * seen * F.ln(seen * float(total) / (row * float(col)))).otherwise(0.0) for seen, row, col in cells), F.lit(0.0))


def _csr(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all lists and the list of each."""
    return np.concatenate([*lists, np.zeros(0, np.int32)]), np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(known: np.ndarray, y: np.ndarray, present: list[np.ndarray], pairs: tuple[list[np.ndarray], list[np.ndarray]], swaps: dict[tuple[bytes, bytes], int], counterfactual: float = 1.0, decay: float = 1e-3, steps: int = 150, rate: float = 0.1) -> Model:
    """Adam on the mean log loss of all texts and their template copies + ``counterfactual`` * (the mean squared change of logits under swaps of mentions + the same of template mentions) + ``decay`` / texts * the squared weights by number of texts.

    ``present`` and ``pairs`` (what either mention adds): positions in the sorted feature numbers ``known``; ``swaps``: feature numbers that go and come, and how often.
    """
    n, k = len(y), len(known)
    base = (y.sum() + 0.5) / (n + 2)
    (col, doc), (first, at1), (second, at2) = _csr(present), _csr(pairs[0]), _csr(pairs[1])
    added, adds = np.concatenate((first, second)), np.concatenate((at1, at2 + n))
    weight = np.array([*swaps.values()], np.float64) / max(1, sum(swaps.values()))
    gone, come = ([_positions(known, np.frombuffer(x, np.int32)) for x in side] for side in (zip(*swaps, strict=True) if swaps else ((), ())))
    (out, out_at), (in_, in_at) = _csr(gone), _csr(come)
    count = np.bincount(col, minlength=k)
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = np.log(base / (1 - base))
    both = np.concatenate((y, y))

    def forward() -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(doc, w[col], minlength=n) + w[k], np.bincount(adds, w[added], minlength=2 * n)

    for t in range(1, steps + 1):
        z, move = forward()
        e, e2 = (_sigmoid(z) - y) / (3 * n), (_sigmoid(np.concatenate((z, z)) + move) - both) / (3 * n)
        # what a mention moves, and what one instead of the other does
        apart = move[:n] - move[n:]
        pull = 2 * counterfactual / (3 * n) * (move + np.concatenate((apart, -apart)))
        grad = np.bincount(col, (e + e2[:n] + e2[n:])[doc], minlength=k) + np.bincount(added, (e2 + pull)[adds], minlength=k) + 2 * decay / n * w[:k] * count
        if swaps:
            change = np.bincount(in_at, w[in_], minlength=len(weight)) - np.bincount(out_at, w[out], minlength=len(weight))
            push = 2 * counterfactual * weight * change
            grad += np.bincount(in_, push[in_at], minlength=k) - np.bincount(out, push[out_at], minlength=k)
        grad = np.append(grad, e.sum() + e2.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = Model(known, w[:k], float(w[k]))
    z, move = forward()
    told = _sigmoid(np.concatenate((z, z)) + move)
    model.report = {"swaps": float(sum(swaps.values()) + n), "mention_swaps": float(sum(swaps.values())), "mean_change": float(np.abs(told[:n] - told[n:]).mean()), "mean_rise": float(np.abs(told - np.concatenate((_sigmoid(z),) * 2)).mean())}
    return model


def _positions(known: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Where those of ``features`` that are known stand."""
    at = np.minimum(np.searchsorted(known, features), len(known) - 1)
    return at[known[at] == features].astype(np.int32)


def held_out(doc_id="doc_id"):  # noqa: ANN001, ANN201
    """Rows whose labels aren't learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 8192, least_gain: float = 12.0, **options: float) -> Model:
    """A model of the features whose presence tells at least a likelihood ratio of ``least_gain`` about the label, and those of identity terms."""
    one = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("t")).filter("id IS NOT NULL AND t IS NOT NULL").filter(~held_out("id"))
    one = one.groupBy("id").agg(F.max("t").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(one), F.col("doc_id") == F.col("id"))  # at most ``sample`` rows are broadcast
    rows = stored(rows.groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text").mapInArrow(_sampled, SAMPLED), "labelled")
    total, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    base = (toxic + 0.5) / (total + 2)
    if toxic in (0, total):
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(base / (1 - base))))
    counts = rows.select("y", F.explode("present").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("a"))
    best = counts.select("f", _gain(F.col("a"), F.col("n"), toxic, total).alias("g")).filter(F.col("g") >= least_gain)
    known = np.union1d(np.array([r.f for r in best.collect()], np.int32), IDENTITY)

    def positions(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            own = {c: [_positions(known, np.array(x, np.int32)).tobytes() for x in batch.column(c).to_pylist()] for c in ("present", "first", "second")}
            yield pa.RecordBatch.from_pydict({"y": batch.column("y")} | {c: pa.array(x, pa.binary()) for c, x in own.items()})

    found = rows.select("y", "present", "first", "second").mapInArrow(positions, "y int, present binary, first binary, second binary").collect()
    swaps = rows.select(F.explode(F.arrays_zip("gone", "come", "times")).alias("s")).groupBy("s.gone", "s.come").agg(F.sum("s.times").alias("times")).collect()  # subsets of the features of two terms
    column = lambda c: [np.frombuffer(r[c], np.int32) for r in found]
    return fit(known, np.array([r.y for r in found], np.float64), column("present"), (column("first"), column("second")), {(bytes(r.gone), bytes(r.come)): r.times for r in swaps}, **options)


def score_documents(docs: DataFrame, model: Model, keep: bool = False, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted; or with ``keep`` the rows of ``docs`` that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((model.known, model.weights, model.bias))

    def work(batches):  # noqa: ANN001, ANN202
        own = Model(*shared.value)
        for batch in batches:
            data, offsets = textops.buffers(batch.column("text"))
            data = textops.LOWER[data]
            for lo, hi in textops.blocks(offsets, BLOCK):
                score = own.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                part = batch.slice(lo, hi - lo)
                if keep:
                    yield part.filter(pa.array(score < threshold))
                else:
                    yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": score, "predicted": pa.array((score >= threshold).astype(np.int32))})

    if keep:
        return carried(docs, lambda rows: rows.mapInArrow(work, rows.schema))
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = 8192) -> DataFrame:
    return score_documents(docs, train(docs, labels, sample))
