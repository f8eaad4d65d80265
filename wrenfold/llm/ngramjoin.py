"""Similarity join of documents by the Jaccard coefficient of their word n-grams.

A document's set: its distinct ``n``-word shingles after lower-casing A-Z (fewer words: the whole sequence
as one; none: empty, never linked).  Documents link when 100 * intersection >= ``percent`` * union.

1. Equal texts become one, with their number and least id.  Shards of texts send their distinct shingles, with
   numbers of texts, through the key exchange and get the frequency class of each.  A pair that links shares at
   least ``percent`` of either set, so a text with fewer shingles that others have is alone; it leaves here,
   with nothing but its size.
2. Equal sets become one representative.
3. The global n-gram order is (frequency class, hash), rarest first.  Linked sets share an n-gram of their
   prefixes in that order; only such pairs are candidates, and only if their sizes and the places of that
   n-gram in both leave room for a link (all before it is in one of the two only).
4. Vertical partitioning: the order is cut into fragments of even load; each set is cut into segments.  The
   overlap of a candidate pair is counted in each fragment by itself and summed per pair.
5. Candidates come in two passes.  First each member of a prefix group is compared with the group's pivot,
   one pair per member; the links give components.  Then pairs of a group that lie in different components
   and weren't compared yet follow.  What a component already joins isn't compared again, so a group of k
   copies costs about k pairs, and no link that would join two components is left out.

A key that many rows share (an n-gram, a pivot, a component, a text) is dealt over salts in every join.

Cases: null and empty texts have n_shingles 0 and stand alone; rows that repeat a document (or an id) are
documents of their own, linked by their texts; a null id never becomes a component's id unless no other is
there; bytes that are not UTF-8 are parts of words; other columns, of whatever name, are ignored or carried; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfold.llm import exchange, textops
from wrenfold.llm.components import components
from wrenfold.llm.ranks import spread_join
from wrenfold.llm.storage import carried, free_name, spent, stored, text_bytes

SETS = "tid long, grp binary, copies long, least long, n_shingles long, s1 long, s2 long, alone int, grams array<long>"
SET = ["n_shingles", "s1", "s2"]
_U = np.uint64


def shingle_sets(table: pa.Table, width: int, drop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: hash and row, by row and hash; and the hashes cut to the bits that the exchange compares."""
    data, offsets = textops.buffers(table["text"])
    data = textops.LOWER[data]
    starts, ends, first = textops.find_words(data, offsets, textops.NOT_SPACE)
    words = textops.word_hashes(data, starts, ends)
    hashes = textops.window_hashes(words, width)
    at = np.flatnonzero(textops.window_mask(first, width, len(words)))
    row = np.repeat(np.arange(table.num_rows), np.diff(first))
    few = np.flatnonzero((np.diff(first) < width) & (np.diff(first) > 0))
    short = np.array([_few(words[first[i] : first[i + 1]]) for i in few], _U)
    h, r = np.concatenate((hashes[at], short)), np.concatenate((row[at], few))
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[once], r[once]
    return h, r, (h >> _U(drop)) << _U(drop)


def _few(words: np.ndarray) -> int:
    out = len(words)
    for w in words.tolist():
        out = (out * textops.WORD_BASE + w) & ((1 << 64) - 1)
    return int(textops.mix(np.array([out ^ 0x5DEECE66D], _U))[0])


def frequency_class(texts: np.ndarray) -> np.ndarray:
    """0 for one text, else 1 + two steps per doubling (at most 127)."""
    return np.where(texts <= 1, 0, 1 + np.floor(2 * np.log2(np.maximum(texts, 1)))).astype(np.uint8)


def candidate_sets(docs: DataFrame, width: int, percent: int, shard_bytes: int) -> DataFrame:
    """A row for each distinct text; ``grams``, in the global order, only where a link with another text is possible."""
    total = text_bytes(docs)
    shards = exchange.shards_for(total, shard_bytes)
    bits = exchange.bits_for(1.3 * total)  # a shingle in some six bytes
    drop = max(0, 64 - (max(1, total).bit_length() + 13))  # of so few bits one in some thousand shingles seems shared by chance, which rules nothing out

    def send(table: pa.Table) -> pa.Table:
        _, _, key = shingle_sets(table, width, drop)
        key = np.sort(key)
        lead = np.ones(len(key), bool)
        lead[1:] = key[1:] != key[:-1]
        count = np.diff(np.append(np.flatnonzero(lead), len(key)))
        return exchange.sent(table["shard"][0].as_py(), key[lead], count, bits)

    def sets(table: pa.Table, answer: pa.Table) -> pa.Table:
        table = exchange.ordered(table)
        shard = table["shard"][0].as_py() if table.num_rows else 0
        h, r, key = shingle_sets(table, width, drop)
        order = np.argsort(key, kind="stable")
        lead = np.ones(len(key), bool)
        lead[1:] = key[order[1:]] != key[order[:-1]]
        kind = np.empty(len(key), np.uint8)
        kind[order] = exchange.received(answer)[np.cumsum(lead) - 1]
        n = np.bincount(r, minlength=table.num_rows)
        alone = np.bincount(r, kind == 0, minlength=table.num_rows).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(n)))
        with np.errstate(over="ignore"):
            s1, s2 = (np.add.reduceat(np.append(x, _U(0)), at[:-1]) if len(n) else x[:0] for x in (h, textops.mix(h ^ _U(0x9E3779B97F4A7C15))))
        may = (n > 0) & (100 * (n - alone) >= percent * n)
        keep = may[r] & (kind > 0)
        gram = (kind[keep].astype(np.int64) << 56) | (h[keep] >> _U(8)).astype(np.int64)
        order = np.lexsort((gram, r[keep]))
        sizes = np.where(may, n - alone, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(gram[order]), mask=pa.array(~may))
        return pa.table({
            "tid": pa.array((np.int64(shard) << 32) + np.arange(table.num_rows)), "grp": table["grp"], "copies": table["copies"], "least": table["least"], "n_shingles": n.astype(np.int64), "s1": s1.view(np.int64), "s2": s2.view(np.int64),
            "alone": pa.array(alone, pa.int32()), "grams": lists,
        })

    texts = exchange.dealt(docs, shards)
    answers = exchange.ask(texts.groupBy("shard").applyInArrow(send, exchange.SENT), exchange.of_sum(frequency_class), bits, shards)
    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(sets, SETS)


def _room(percent: int, n1: str, p1: str, n2: str, p2: str) -> Column:
    """Whether sets of n1 and n2 n-grams can link if the first that they share is at place p1 of the one and p2 of the other."""
    most = f"least({n1} - {p1}, {n2} - {p2})"
    return F.expr(f"100 * {most} >= {percent} * ({n1} + {n2} - {most})")


def overlaps(pairs: DataFrame, segments: DataFrame, fragments: int) -> DataFrame:
    """For pairs (a, b): the overlaps of their segments, counted by fragment and summed per pair."""
    partial = pairs.withColumn("fragment", F.explode(F.array(*map(F.lit, range(fragments)))))
    for one in ("a", "b"):
        uses = segments.join(pairs.groupBy(F.col(one).alias("rid")).agg(F.count(F.lit(1)).alias(f"n{one}")), "rid")
        side = uses.toDF(one, "fragment", f"g{one}", f"n{one}")
        partial = spread_join(partial, stored(side, "uses"), [one, "fragment"], f"n{one}").drop(f"n{one}")
    return partial.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("ga", "gb"))).alias("overlap"))


def jaccard_links(sets: DataFrame, percent: int, fragments: int = 8) -> DataFrame:
    """(rid, label) of the representatives that have a link; ``sets``: distinct sets with rid, n_shingles, alone and grams."""
    sets = sets.select("rid", F.col("n_shingles").alias("n"), F.col("alone").cast("long").alias("u"), "grams")
    grams = sets.select(F.explode("grams").alias("gram"))
    pivots = sorted({int(x) for x in grams.approxQuantile("gram", [i / fragments for i in range(1, fragments)], 0.01)})
    edges = [-(1 << 62), *pivots, 1 << 62]
    cuts = F.array(*[F.struct(F.lit(i).alias("fragment"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])
    segments = sets.select("rid", "grams", F.explode(cuts).alias("c")).select("rid", "c.fragment", F.expr("filter(grams, g -> g >= c.lo AND g < c.hi)").alias("grams")).filter("size(grams) > 0")
    segments = stored(segments, "segments")
    prefix = F.expr(f"n - ((n * {percent} + 99) div 100) + 1 - u").cast("int")
    heads = sets.select("rid", "n", "u", F.posexplode(F.slice("grams", F.lit(1), F.greatest(prefix, F.lit(0)))).alias("k", "gram")).select("rid", "n", (F.col("u") + F.col("k")).alias("at"), "gram")
    groups = heads.groupBy("gram").agg(F.min(F.struct("at", "rid", "n")).alias("p"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = spread_join(heads, stored(groups, "groups"), ["gram"], "size")
    heads = stored(met.select("gram", "rid", "n", "at", F.col("p.rid").alias("pr"), F.col("p.n").alias("pn"), F.col("p.at").alias("pat"), "size").filter("rid <> pr"), "heads")
    sizes = sets.select("rid", "n")

    def links(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, na, b, nb) that link."""
        both = pairs.join(overlaps(pairs.select("a", "b"), segments, len(edges) - 1), ["a", "b"])
        return both.filter(f"100 * overlap >= {percent} * (na + nb - overlap)").select("a", "b")

    def paired(left: str, right: str, n_left: str, n_right: str) -> list[Column]:
        swap = F.col(left) > F.col(right)
        return [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name) for x, y, name in ((left, right, "a"), (n_left, n_right, "na"), (right, left, "b"), (n_right, n_left, "nb"))]

    first = stored(heads.filter(_room(percent, "n", "at", "pn", "pat")).select(*paired("rid", "pr", "n", "pn")).distinct(), "pairs")
    found = stored(links(first), "links")
    labels = components(found)
    rest = heads.filter("size > 2").join(labels.toDF("rid", "label"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    mixed = rest.groupBy("gram").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count(F.lit(1)).alias("members")).filter("l1 <> l2").select("gram", "members")
    mixed = stored(mixed, "mixed")
    if mixed.isEmpty():  # no group is left in several components
        return labels
    rest = stored(spread_join(rest.select("gram", "rid", "n", "at", "label"), mixed, ["gram"], "members").withColumn("salts", F.expr("cast(members div 256 + 1 AS int)")).drop("members"), "rest")
    x = rest.withColumn("salt", F.expr("cast(pmod(xxhash64(rid), salts) AS int)")).drop("salts").toDF("gram", "a", "na", "ata", "la", "salt")
    y = rest.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts").toDF("gram", "b", "nb", "atb", "lb", "salt")
    meet = x.join(y, ["gram", "salt"]).filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _room(percent, "na", "ata", "nb", "atb"))
    second = stored(meet.select("a", "na", "b", "nb").distinct().join(first, ["a", "b"], "left_anti").select("a", "na", "b", "nb"), "pairs")
    if second.isEmpty():
        return labels
    more = stored(links(second), "links")
    return labels if more.isEmpty() else components(found.union(more))


def _texts(docs: DataFrame, width: int, percent: int, shard_bytes: int) -> DataFrame:
    """Each distinct text: grp, copies, least, n_shingles, component_id (the least id of its component), texts (distinct ones of the component) and first (whether the component's first row has this text)."""
    with spent(docs.sparkSession) as tables:  # all that is stored on the way goes, once the last table is written
        texts = _joined_texts(docs, width, percent, shard_bytes)
        tables.pop()
    return texts


def _joined_texts(docs: DataFrame, width: int, percent: int, shard_bytes: int) -> DataFrame:
    rows = stored(candidate_sets(docs, width, percent, shard_bytes), "sets")
    may = rows.filter(F.col("grams").isNotNull())
    order = F.struct(F.col("least").isNull().alias("none"), "least", "tid")
    classes = stored(may.groupBy(*SET).agg(F.min("tid").alias("rep"), F.min(order).alias("top"), F.count(F.lit(1)).alias("texts")), "classes")
    sets = may.join(classes.select(F.col("rep").alias("tid")), "tid", "left_semi").withColumnRenamed("tid", "rid")
    labels = jaccard_links(sets, percent)
    roots = stored(classes.join(labels.toDF("rep", "label"), "rep", "left").withColumn("root", F.coalesce("label", "rep")).drop("label", "rep"), "roots")
    whole = roots.groupBy("root").agg(F.count(F.lit(1)).alias("classes"), F.min("top").alias("first"), F.sum("texts").alias("all"))
    named = spread_join(roots.drop("top"), stored(whole, "roots"), ["root"], "classes").select(*SET, "texts", F.col("first.least").alias("component_id"), F.col("first.tid").alias("first"), "all")
    keep = ["grp", "copies", "least", "n_shingles"]
    member = spread_join(may.select("tid", "grp", "copies", "least", *SET), stored(named, "classes"), SET, "texts")
    member = member.select(*keep, "component_id", F.col("all").alias("texts"), (F.col("tid") == F.col("first")).alias("first"))
    single = rows.filter(F.col("grams").isNull()).select(*keep, F.col("least").alias("component_id"), F.lit(1).cast("long").alias("texts"), F.lit(True).alias("first"))
    return stored(member.unionByName(single), "texts")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, shard_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    texts = _texts(docs, width, percent, shard_bytes)
    ids = docs.select(F.col("doc_id").cast("long"), exchange.digest().alias("grp"))
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return spread_join(ids, texts.select("grp", "copies", "n_shingles", "component_id"), ["grp"], "copies").select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, shard_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with one document of each component: the one of least ``doc_id`` (of several rows with it, one); documents without words stay."""
    return carried(docs, lambda rows: _one_of_each(rows, width, percent, shard_bytes))


def _one_of_each(docs: DataFrame, width: int, percent: int, shard_bytes: int) -> DataFrame:
    texts = _texts(docs, width, percent, shard_bytes).filter("n_shingles > 0 AND (copies > 1 OR texts > 1)")
    grp, copies, stays, least = (free_name(docs, c) for c in ("_grp", "_copies", "_stays", "_least"))
    marks = texts.select(F.col("grp").alias(grp), F.col("copies").alias(copies), F.col("first").alias(stays), F.col("least").alias(least))
    seen = spread_join(docs.withColumn(grp, exchange.digest()), marks, [grp], copies, "left")
    once = seen.filter(F.col(stays) & F.col("doc_id").cast("long").eqNullSafe(F.col(least))).dropDuplicates([grp])
    return seen.filter(F.col(stays).isNull()).unionByName(once).select(docs.columns)
