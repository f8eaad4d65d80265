"""The trie of all conversation prefixes, by prefix-doubling naming.

A turn is known by the digest of its role and text.  Equal turns get one dense name; a block of 2**k turns gets its
name from those of its two halves, so after k join rounds every aligned block has one.  A prefix of d turns is the
chain of the blocks that the binary digits of d stand for: its name comes from that of d without its lowest digit
and that of the last block, in as many rounds as d has digits.  Prefixes of one length and name are one node.

A node is (depth, smallest member): at one depth no two nodes share a member.  The smallest member of a node stands
for it, and all nodes above are prefixes of that same conversation; so what a subtree sums is, for each node, the sum
over its members' own running totals, and no walk over depths is needed.

Cases: a row without conv_id belongs to no conversation and is left out; a null role or text is empty; turns of one
conversation with the same number come in the order of their digests (SHA-256 of the role's size, role and text);
repeated rows are turns of their own; a conversation with no turn left ends at the root; ``c - c % 5`` and ``%`` are
SQL's, towards zero; an empty table has no nodes; other columns are ignored; bytes that are not UTF-8 count as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wrenfold.llm.ranks import ranked, running, salts_for, spread_join
from wrenfold.llm.storage import spent, stored

#: Bits of an id that one piece of a node's list of ended conversations spans.
PIECE_BITS = 12


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, turn_key, n_bytes), a row per turn; texts go no further than their digests."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("turn_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("nth"))
    return running(rows, "conv_id", ["turn", "turn_key"], ["nth"]).select("conv_id", (F.col("nth") - 1).alias("pos"), "turn_key", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 1, turn_key, n_bytes) of all rebuilt conversations, and (conv_id, n) of all ids: the first h turns of conversation c - c % 5, then the own ones behind the first h."""
    h, base = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(9)), F.col("conv_id") - F.col("conv_id") % 5
    sizes = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"base": base, "h": h}), "trie-sizes")
    heads = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = stored(sizes.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).drop("n_base"), "trie-plan")
    own = spread_join(turns, plan, ["conv_id"], "n").filter("base = conv_id OR pos >= h")
    own = own.select("conv_id", F.when(F.col("base") == F.col("conv_id"), F.col("pos")).otherwise(F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_key", "n_bytes")
    first = turns.filter("conv_id % 5 = 0 AND pos < 8").withColumnRenamed("conv_id", "base")
    lent = plan.filter("base <> conv_id").select("conv_id", "base", "h").join(first, "base").filter("pos < h").select("conv_id", "pos", "turn_key", "n_bytes")
    return own.union(lent).withColumn("depth", F.col("pos") + 1).drop("pos"), plan.select("conv_id", "n")


def named(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` (stored) with the dense name, from 0, of their ``keys`` in place of these; keys that many rows share are salted."""
    seen = Observation()
    distinct = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).withColumn("_all", F.lit(0))
    distinct = stored(distinct.observe(seen, F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("_size"), F.lit(0)).alias("rows"), F.coalesce(F.max("_size"), F.lit(0)).alias("most")), "trie-keys")
    told = seen.get  # counted while the keys were written
    names = ranked(distinct, "_all", keys, salts_for(told["keys"]), name).drop("_all")
    return stored(spread_join(rows, names, keys, "_size", known=(told["rows"], told["most"])).drop(*keys, "_size"), "trie-named")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node) for every prefix of at least one turn; equal prefixes of one depth have one number.  ``rows``: (conv_id, depth, turn_key), stored."""
    blocks = named(rows.select("conv_id", (F.col("depth") - 1).alias("i"), "turn_key"), ["turn_key"], "name")
    # each block with an even number closes exactly one depth: the one whose lowest binary digit is the block's size
    closing = blocks.filter("i % 2 = 0").select("conv_id", (F.col("i") + 1).alias("depth"), F.col("i").alias("up"), "name")
    half = lambda k: F.max(F.when(F.col("i") % 2 == k, F.col("name")))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    for level in range(1, deepest.bit_length()):
        pairs = blocks.groupBy("conv_id", F.expr("i div 2").alias("j")).agg(half(0).alias("left"), half(1).alias("right")).filter("left IS NOT NULL AND right IS NOT NULL")
        blocks = named(stored(pairs.withColumnRenamed("j", "i"), "trie-pairs"), ["left", "right"], "name")
        size = F.lit(1 << level).cast("long")
        closing = closing.union(blocks.filter("i % 2 = 0").select("conv_id", ((F.col("i") + 1) * size).alias("depth"), (F.col("i") * size).alias("up"), "name"))
    closing = stored(closing.withColumn("digits", F.bit_count("depth")), "trie-closing")
    last = closing.filter("digits = 1").select("conv_id", "depth", F.col("name").alias("node"))
    found = last
    for digits in range(2, max(deepest.bit_count(), deepest.bit_length() - 1) + 1):
        above = last.select("conv_id", F.col("depth").alias("up"), F.col("node").alias("left"))
        pairs = closing.filter(F.col("digits") == digits).join(above, ["conv_id", "up"]).select("conv_id", "depth", F.col("depth").alias("of"), "left", F.col("name").alias("right"))
        last = named(stored(pairs, "trie-prefixes"), ["of", "left", "right"], "node").select("conv_id", "depth", "node")
        found = found.union(last)
    return found


def _hashed_lists(rows: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256): the digest of a node's ids, joined in order.  Ids are joined within ranges first; a node's pieces pass a task one by one."""
    pieces = rows.groupBy("depth", "node", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
                if (depth, node) == now:
                    digest.update(b",")
                else:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (depth, node), hashlib.sha256()
                digest.update(ids.encode())
            yield _ends(done)
        if now:
            yield _ends([(*now, digest.hexdigest())])

    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "piece").mapInArrow(work, "depth long, node long, ends_sha256 string")


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    depth, node, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(sha, pa.string())], ["depth", "node", "ends_sha256"])


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    zero, one, none = (F.lit(x).cast("long") for x in (0, 1, None))
    with spent(conversations.sparkSession) as tables:
        turns, ids = rebuilt(stored(turns_of(conversations), "trie-turns"))
        turns = stored(turns, "trie-rebuilt")
        found = prefixes(turns).union(ids.select("conv_id", zero, zero))
        # what is known of each (conversation, depth): its node, the bytes of its last turn, whether a turn follows
        parts = found.select("conv_id", "depth", "node", zero.alias("n_bytes"), zero.alias("inner"))
        parts = parts.union(turns.select("conv_id", "depth", none, "n_bytes", zero)).union(turns.select("conv_id", F.col("depth") - 1, none, zero, one))
        places = stored(parts.groupBy("conv_id", "depth").agg(*[F.max(c).alias(c) for c in ("node", "n_bytes", "inner")]), "trie-places")
        nodes = places.groupBy("depth", "node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("inner").alias("inner"))
        nodes = stored(nodes, "trie-nodes")
        # what each node adds is put to the conversation that stands for it, and counted for all shorter prefixes of that
        saves = nodes.select("conv_id", "depth", none.alias("node"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (1 - F.col("inner")).alias("leaves"), one.alias("stands"), zero.alias("child"))
        below = nodes.filter("depth > 0").select("conv_id", F.col("depth") - 1, none, zero, zero, zero, one)
        parts = places.select("conv_id", "depth", "node", zero.alias("saved"), zero.alias("leaves"), zero.alias("stands"), zero.alias("child")).union(saves).union(below)
        parts = parts.groupBy("conv_id", "depth").agg(*[F.max(c).alias(c) for c in ("node", "saved", "leaves", "stands", "child")])
        places_up = stored(running(parts.withColumn("_down", -F.col("depth")), "conv_id", ["_down"], ["saved", "leaves"]).drop("_down"), "trie-sums")
        sums = places_up.groupBy("depth", "node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        sums = stored(sums, "trie-node-sums")
        # the node above (d + 1, c) is that of the prefix of c with d turns
        child = places_up.filter("child = 1")
        same = child.filter("stands = 1").select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
        other = child.filter("stands = 0").select("depth", "node", F.col("conv_id").alias("of"))
        other = spread_join(other, sums.select("depth", "node", "n_children", F.col("conv_id").alias("parent_conv_id")), ["depth", "node"], "n_children")
        above = same.union(other.select(F.col("of").alias("conv_id"), F.col("depth") + 1, "parent_conv_id"))
        ends = _hashed_lists(places.filter("inner = 0").select("conv_id", "depth", "node"))
        out = sums.join(above, ["conv_id", "depth"], "left").join(ends, ["depth", "node"], "left")
        out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
        out = stored(out, "trie")
        tables.pop()
    return out


_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END), CAST(4294967295 AS BIGINT))"""


def oracle_sql() -> str:
    """The same nodes by whole paths: a path is the digests of its turns, one after the other."""
    return f"""
WITH raw AS (SELECT conv_id, turn, sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, octet_length(encode(coalesce(text, ''))) AS b FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM raw),
own AS (SELECT conv_id AS c, list(k ORDER BY pos) AS ks, list(b ORDER BY pos) AS bs FROM t GROUP BY 1),
plan AS (SELECT *, c - c % 5 AS base, {_CRC.format(x="c")} % 9 AS h FROM own),
re AS (SELECT p.c, CASE WHEN p.base = p.c THEN p.ks ELSE list_concat(coalesce(q.ks, [])[1:p.h], p.ks[p.h + 1:]) END AS ks,
              CASE WHEN p.base = p.c THEN p.bs ELSE list_concat(coalesce(q.bs, [])[1:p.h], p.bs[p.h + 1:]) END AS bs FROM plan p LEFT JOIN plan q ON q.c = p.base),
pre AS (SELECT c, d, array_to_string(ks[1:d], '') AS path, CASE WHEN d = 0 THEN 0 ELSE bs[d] END AS b, d = len(ks) AS ends FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM re)),
node AS (SELECT d, path, min(c) AS c, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS sha FROM pre GROUP BY 1, 2),
kids AS (SELECT u.d, u.path, count(v.d) AS n FROM node u LEFT JOIN node v ON v.d = u.d + 1 AND left(v.path, CAST(64 * u.d AS INT)) = u.path GROUP BY 1, 2),
sub AS (SELECT u.d, u.path, sum((v.n - 1) * v.b) AS saved, count(*) FILTER (k.n = 0) AS leaves
        FROM (SELECT c, d, path FROM pre) u JOIN node v ON v.c = u.c AND v.d >= u.d JOIN kids k ON k.d = v.d AND k.path = v.path GROUP BY 1, 2)
SELECT node.c AS conv_id, CAST(node.d AS BIGINT) AS depth, p.c AS parent_conv_id, node.n AS n_convs, kids.n AS n_children, sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, node.sha AS ends_sha256
FROM node JOIN kids USING (d, path) JOIN sub USING (d, path) LEFT JOIN node p ON p.d = node.d - 1 AND p.path = left(node.path, CAST(64 * (node.d - 1) AS INT))"""
