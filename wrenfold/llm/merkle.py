"""Merkle fixity audit of WARC replicas.

Records are hashed where they lie.  The distinct records of both replicas are the leaves of trees, one to a
file: slots in the order of their keys, with the range of offsets that they take in the first replica; each
leaf has the hash of either replica, or a hole.  A node covers ``FAN`` ordered ranges and hashes the range of
offsets and the hashes below it.  An audit compares the replicas' roots, then only the children of nodes that
differ, down to the records at fault: changed, missing or extra ones all change their root.

A page's file is its range of ``RECORDS_A_FILE`` ids; a range with more records than that (of one id, or none)
is dealt over volumes by the records' hashes, so no file grows with the table.  Copies of one record are one
leaf with two numbers.  All of a file's tree is built in the tasks that its leaves were sent to, once.

WARC files themselves (``warc_records``, ``audit_warc``) have their own paths and offsets in either replica.

Cases: a null url or html counts as empty; records without an id are in files named "none"; of an id with one
record in each replica a difference is a change, any other difference is missing or extra records; equal
records count by their number; an empty table has no files and no faults; extra columns are ignored; a file
that can't be read gives a row with ``error`` behind those of its records that can.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenfold.llm.ranks import spread_join
from wrenfold.llm.storage import stored

RECORDS_A_FILE = 256
FAN = 16
HOLE = "-"


def record_bytes(url: Column, html: Column) -> Column:
    """A WARC/1.1 response record as bytes."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def records(pages: DataFrame) -> DataFrame:
    """page_id, hash and length of each record."""
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), record_bytes(F.col("url"), F.col("html")).alias("raw"))
    return raw.select("page_id", F.sha2("raw", 256).alias("hash"), F.octet_length("raw").cast("long").alias("length"))


def _both(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct records of two replicas, with their number in the first (``a``) and the second (``b``)."""
    rows = first.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(second.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    return rows.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def leaves(first: DataFrame, second: DataFrame) -> DataFrame:
    """The leaves of two tables of pages: file, key (the order in it), page_id, hash, length, a, b."""
    found = _both(records(first), records(second), ["page_id", "hash", "length"]).withColumn("range", F.floor(F.col("page_id") / RECORDS_A_FILE).cast("long"))
    found = stored(found, "leaves")
    name = F.coalesce(F.col("range").cast("string"), F.lit("none"))
    full = found.groupBy("range").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > RECORDS_A_FILE)
    full = stored(full.select(F.coalesce("range", F.lit(_NO_RANGE)).alias("range"), "n"), "full-ranges")
    if not full.isEmpty():
        found = spread_join(found.withColumn("range", F.coalesce("range", F.lit(_NO_RANGE))), full, ["range"], "n", "left")
        volume = F.conv(F.substring("hash", 1, 12), 16, 10).cast("long") % F.ceil(F.col("n") / RECORDS_A_FILE)
        name = F.concat(F.when(F.col("range") == _NO_RANGE, "none").otherwise(F.col("range").cast("string")), F.coalesce(F.concat(F.lit("."), volume.cast("string")), F.lit("")))
    return found.select(name.alias("file"), F.struct("page_id", "hash").alias("key"), "page_id", "hash", "length", "a", "b")


_NO_RANGE = -(1 << 62)


def slots(found: DataFrame) -> DataFrame:
    """Leaves with slot, lo and hi (offsets in the first replica; an extra record takes no room) and the hashes ha and hb of either replica."""
    order = Window.partitionBy("file").orderBy("key")
    room = F.col("length") * F.col("a")
    lo = F.coalesce(F.sum(room).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("slot", (F.row_number().over(order) - 1).cast("long")).withColumn("lo", lo).withColumn("hi", lo + room).withColumns({f"h{x}": _of(x) for x in "ab"})


def _of(copies: str) -> Column:
    return F.when(F.col(copies) == 0, HOLE).when(F.col(copies) == 1, F.col("hash")).otherwise(F.concat_ws("*", "hash", F.col(copies).cast("string")))


def trees(placed: DataFrame, levels: int) -> DataFrame:
    """One row per file: its root with lo, hi, ha, hb and ``below``, its children, nested down to the slots."""
    rows = placed.withColumnRenamed("slot", "node").select("file", "node", "lo", "hi", "ha", "hb", "length", "page_id", "hash", "a", "b")
    for _ in range(levels):
        below = F.array_sort(F.collect_list(F.struct(*rows.columns[1:])))  # at most FAN of them
        rows = rows.groupBy("file", F.expr(f"node div {FAN}").alias("up")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), below.alias("below"))
        hashes = {f"h{x}": F.sha2(F.concat_ws(":", "lo", "hi", F.array_join(F.transform("below", lambda c: c[f"h{x}"]), "")), 256) for x in "ab"}  # noqa: B023
        rows = rows.withColumns(hashes).select("file", F.col("up").alias("node"), "lo", "hi", "ha", "hb", "below")
    return rows


def height(records_a_file: int) -> int:
    levels = 1
    while FAN**levels < records_a_file:
        levels += 1
    return levels


def faults(found: DataFrame, levels: int) -> DataFrame:
    """Leaves that differ: file, slot, lo, length, page_id, hash, a, b, root_expected, root_actual.  A file of more than FAN ** levels leaves has several roots."""
    at = trees(slots(found), levels).filter("ha <> hb").select("file", F.col("ha").alias("root_expected"), F.col("hb").alias("root_actual"), "below")
    for level in range(levels):  # only below nodes that differ
        at = at.select("file", "root_expected", "root_actual", F.explode(F.filter("below", lambda c: c["ha"] != c["hb"])).alias("c"))
        at = at.select("file", "root_expected", "root_actual", "c.*") if level == levels - 1 else at.select("file", "root_expected", "root_actual", "c.below")
    return at.select("file", F.col("node").alias("slot"), "lo", "length", "page_id", "hash", "a", "b", "root_expected", "root_actual")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per record at fault: file, slot, offset, length, page_id, kind (changed, missing, extra), copies, expected_sha256, actual_sha256, root_expected, root_actual; offsets are the first replica's."""
    found = stored(faults(leaves(first, second), height(4 * RECORDS_A_FILE)), "faults")
    lost, new = F.col("a") > F.col("b"), F.col("b") > F.col("a")
    times = F.abs(F.col("a") - F.col("b"))
    rows = found.withColumn("copies", times)
    # one record of an id lost and one new: the record has changed
    per = rows.filter("page_id IS NOT NULL").groupBy("page_id").agg(F.count(F.when(lost, 1)).alias("m"), F.count(F.when(new, 1)).alias("e"), F.min("copies").alias("c1"), F.max("copies").alias("c2"))
    pairs = per.filter("m = 1 AND e = 1 AND c1 = c2").select("page_id")
    changed = rows.join(pairs, "page_id", "left_semi").groupBy("page_id").agg(F.max(F.when(lost, F.struct("file", "slot", "lo", "length", "copies", "hash", "root_expected", "root_actual"))).alias("x"), F.max(F.when(new, F.col("hash"))).alias("actual"))
    changed = changed.select("x.file", "x.slot", F.col("x.lo").alias("offset"), "x.length", "page_id", F.lit("changed").alias("kind"), "x.copies", F.col("x.hash").alias("expected_sha256"), F.col("actual").alias("actual_sha256"), "x.root_expected", "x.root_actual")
    rest = rows.join(pairs, "page_id", "left_anti").select(
        "file", "slot", F.when(lost, F.col("lo")).alias("offset"), "length", "page_id", F.when(lost, "missing").otherwise("extra").alias("kind"), "copies",
        F.when(lost, F.col("hash")).alias("expected_sha256"), F.when(new, F.col("hash")).alias("actual_sha256"), "root_expected", "root_actual",
    )
    return changed.unionByName(rest)


def audit_warc(first: DataFrame, second: DataFrame) -> DataFrame:
    """The same for two sets of WARC files (path, content): file, offset, length, kind, expected_sha256, actual_sha256, root_expected, root_actual; a change keeps its offset."""
    keys = ["path", "offset", "length", "hash"]
    found = _both(*(warc_records(x).filter("error IS NULL").select("path", "offset", "length", F.col("sha256").alias("hash")) for x in (first, second)), keys)
    found = stored(found.select(F.col("path").alias("file"), F.struct("offset", "length", "hash").alias("key"), F.col("offset").alias("page_id"), "hash", "length", "a", "b"), "leaves")
    most = found.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    at = faults(found, height(most))
    side = lambda x, y: F.max(F.when(F.col(x) > F.col(y), F.struct("length", "hash")))
    both = at.groupBy("file", F.col("page_id").alias("offset"), "root_expected", "root_actual").agg(side("a", "b").alias("x"), side("b", "a").alias("y"))
    kind = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("changed")
    return both.select("file", "offset", F.coalesce("x.length", "y.length").alias("length"), kind.alias("kind"), F.col("x.hash").alias("expected_sha256"), F.col("y.hash").alias("actual_sha256"), "root_expected", "root_actual")


def _draw() -> Column:
    return F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), 16, 10).cast("long")


def aged_replica(pages: DataFrame) -> DataFrame:
    """A second copy with known damage, for drills: by MD5 of the id, one record in 61 has a changed byte, one in 97 is lost, and one in 89 is there once more under the negated id."""
    h = _draw()
    html = F.when((h % 61 == 0) & (F.length("html") > 0), F.concat(F.when(F.substring("html", 1, 1) == "#", "!").otherwise("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    kept = pages.filter(F.coalesce(h % 97 != 0, F.lit(True))).withColumn("html", html)
    more = pages.filter((h % 89 == 0) & (F.col("page_id") > 0)).withColumn("page_id", -F.col("page_id"))
    return kept.unionByName(more)


def read_warc(raw: bytes) -> Iterator[tuple[int, int, str, bytes]]:
    """(offset, length, target URI, block) of each record of an uncompressed WARC file; raises where it is no longer one."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        size = fields.get("content-length", "")
        if not size.isascii() or not size.isdigit():
            raise ValueError(f"record at byte {at} has no length")
        stop = end + 4 + int(size) + 4
        if stop > len(raw) or raw[stop - 4 : stop] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut")
        yield at, stop - at, fields.get("warc-target-uri", ""), raw[end + 4 : stop - 4]
        at = stop


def warc_records(files: DataFrame) -> DataFrame:
    """Records of WARC files given as (path, content): path, offset, length, sha256, url, html, error.  Where a file can't be read on, a row has ``error`` and the offset; a null or empty file has such a row too."""
    names = ("path", "offset", "length", "sha256", "url", "html", "error")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())

    def found(path: str | None, raw: bytes | None) -> Iterator[tuple]:
        stop = 0
        try:
            for at, size, url, block in read_warc(raw or b""):
                stop = at + size
                yield path, at, size, hashlib.sha256(raw[at:stop]).hexdigest(), url, block.decode("utf-8", "replace"), None
            if not raw:
                raise ValueError("no records")
        except ValueError as e:
            yield path, stop, None, None, None, None, str(e)

    def work(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                for row in found(path, raw):
                    rows.append(row)
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    return files.select("path", "content").mapInArrow(work, "path string, offset long, length long, sha256 string, url string, html string, error string")


def oracle_sql() -> str:
    """The audit of ``pages`` against ``aged_replica`` in DuckDB, for ids that each have one record: trees level by level, without descent."""
    record = lambda html: f"""'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'WARC-Block-Digest: sha256:' || sha256(coalesce({html}, '')) || e || 'Content-Type: text/html' || e || 'Content-Length: ' || CAST(strlen(coalesce({html}, '')) AS VARCHAR) || e || e || coalesce({html}, '') || e || e"""
    steps, levels = [], height(4 * RECORDS_A_FILE)
    for k in range(levels):
        steps.append(f""",
n{k + 1} AS (SELECT file, node // {FAN} AS node, min(lo) AS lo, max(hi) AS hi, string_agg(ha, '' ORDER BY node) AS ja, string_agg(hb, '' ORDER BY node) AS jb FROM t{k} GROUP BY 1, 2),
t{k + 1} AS (SELECT file, node, lo, hi, sha256(concat_ws(':', lo, hi, ja)) AS ha, sha256(concat_ws(':', lo, hi, jb)) AS hb FROM n{k + 1})""")
    return f"""
WITH p AS (SELECT *, chr(13) || chr(10) AS e, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM pages),
ra AS (SELECT page_id, {record("html")} AS raw FROM p),
aged AS (SELECT page_id, url, e, CASE WHEN h % 61 = 0 AND length(html) > 0 THEN CASE WHEN substr(html, 1, 1) = '#' THEN '!' ELSE '#' END || substr(html, 2) ELSE html END AS html FROM p WHERE h % 97 <> 0
         UNION ALL SELECT -page_id, url, e, html FROM p WHERE h % 89 = 0 AND page_id > 0),
rb AS (SELECT page_id, {record("html")} AS raw FROM aged),
uni AS (SELECT page_id, hash, length, sum(a) AS a, sum(b) AS b FROM (SELECT page_id, sha256(raw) AS hash, strlen(raw) AS length, 1 AS a, 0 AS b FROM ra UNION ALL SELECT page_id, sha256(raw), strlen(raw), 0, 1 FROM rb) GROUP BY 1, 2, 3),
rg AS (SELECT *, CAST(floor(page_id / {RECORDS_A_FILE}.0) AS BIGINT) AS r FROM uni),
full_ AS (SELECT r, count(*) AS n FROM rg GROUP BY 1 HAVING count(*) > {RECORDS_A_FILE}),
lv AS (SELECT rg.*, CAST(rg.r AS VARCHAR) || coalesce('.' || CAST(CAST('0x' || substr(hash, 1, 12) AS BIGINT) % CAST(ceil(n / {RECORDS_A_FILE}.0) AS BIGINT) AS VARCHAR), '') AS file FROM rg LEFT JOIN full_ ON rg.r = full_.r),
s AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page_id, hash) - 1 AS slot, coalesce(sum(length * a) OVER (PARTITION BY file ORDER BY page_id, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM lv),
t0 AS (SELECT file, slot AS node, CAST(lo AS BIGINT) AS lo, CAST(lo + length * a AS BIGINT) AS hi, CASE a WHEN 0 THEN '-' WHEN 1 THEN hash ELSE hash || '*' || CAST(a AS VARCHAR) END AS ha, CASE b WHEN 0 THEN '-' WHEN 1 THEN hash ELSE hash || '*' || CAST(b AS VARCHAR) END AS hb FROM s){"".join(steps)},
x AS (SELECT s.*, t.ha AS root_expected, t.hb AS root_actual FROM s JOIN t{levels} t ON t.file = s.file AND t.node = s.slot // {FAN**levels} WHERE a <> b),
k AS (SELECT *, count(*) FILTER (WHERE a > b) OVER (PARTITION BY page_id) AS m, count(*) FILTER (WHERE b > a) OVER (PARTITION BY page_id) AS e, first_value(hash) OVER (PARTITION BY page_id ORDER BY b DESC) AS other FROM x)
SELECT file, CAST(slot AS BIGINT) AS slot, CASE WHEN a > b THEN CAST(lo AS BIGINT) END AS "offset", CAST(length AS BIGINT) AS length, page_id, CASE WHEN m = 1 AND e = 1 THEN 'changed' WHEN a > b THEN 'missing' ELSE 'extra' END AS kind, CAST(abs(a - b) AS BIGINT) AS copies,
       CASE WHEN a > b THEN hash END AS expected_sha256, CASE WHEN m = 1 AND e = 1 THEN other WHEN b > a THEN hash END AS actual_sha256, root_expected, root_actual
FROM k WHERE NOT (m = 1 AND e = 1 AND b > a)"""
