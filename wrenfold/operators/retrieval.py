"""Vector retrieval (V), time travel (T) and provenance (P)."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenfold.functions.rows import AS_OF, count_if, newest, table
from wrenfold.operators.joins import walk_up
from wrenfold.registry import query

LESSON_WEIGHT, GEO_WEIGHT = 0.05, 0.08


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS double) * cast(y AS double)), cast(0 AS double), (s, v) -> s + v)"


def distances(vectors: DataFrame, target: DataFrame) -> DataFrame:
    """``vectors`` with their distance from the one row of ``target``."""
    one = target.select(F.col("embedding").alias("q"), F.expr(f"sqrt({dot('embedding', 'embedding')})").alias("_norm"))  # one row is broadcast, with its norm
    distance = F.expr(f"1 - {dot('embedding', 'q')} / (sqrt({dot('embedding', 'embedding')}) * _norm)")
    return vectors.crossJoin(F.broadcast(one)).withColumn("d", F.round(distance, 6)).drop("q", "_norm")


def shortlist(vectors: DataFrame, target: DataFrame, k: int, prefix: Column | None = None) -> DataFrame:
    """The k nearest under an equality prefix; the prefix reaches the scan, the order is a top-k without a full sort."""
    rows = vectors.filter(prefix) if prefix is not None else vectors
    return distances(rows, target).orderBy("d", "vec_id").limit(k)


_D = "round(1 - list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))), 6)".format(a="e.embedding", b="q.embedding")
_NEAR = f"SELECT e.vec_id, e.label, {_D} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e, e.filter("vec_id = 0")


@query("v01_filtered_cosine_topk", f"SELECT vec_id, d FROM ({_NEAR}) WHERE label = 3 ORDER BY d, vec_id LIMIT 20")
def filtered_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _near(spark, sf_dir)
    return shortlist(e, q, 20, F.col("label") == 3).select("vec_id", "d")


def lesson_shift(candidates: DataFrame, lessons: DataFrame) -> DataFrame:
    """``adjusted = max(0, d - sum(valence * confidence) * weight)``; ``lessons``: (id, valence, confidence)."""
    shift = lessons.groupBy("id").agg(F.sum(F.col("valence") * F.col("confidence")).alias("v"), F.count(F.lit(1)).alias("lessons"))
    rows = candidates.join(shift, candidates.vec_id == shift.id, "left").drop("id")
    return rows.withColumn("adjusted", F.round(F.greatest(F.lit(0.0), F.col("d") - F.coalesce("v", F.lit(0.0)) * LESSON_WEIGHT), 6)).withColumn("lessons", F.coalesce("lessons", F.lit(0))).drop("v")


def geo_shift(candidates: DataFrame, shares: DataFrame) -> DataFrame:
    """Less distance for countries with a share of the audience; no data moves nothing."""
    return candidates.join(F.broadcast(shares), "country", "left").withColumn("final", F.round(F.greatest(F.lit(0.0), F.col("adjusted") - F.coalesce("share", F.lit(0.0)) * GEO_WEIGHT), 6))  # at most one row per nation


_LESSONS = "SELECT doc_id AS id, 2.0 * quality - 1 AS valence, 0.5 + 0.5 * toxic AS confidence FROM labels"
_SHARES = "SELECT c_nationkey AS country, count(*) / sum(count(*)) OVER () AS share FROM customer WHERE c_nationkey < 10 GROUP BY 1"


def _lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (2.0 * F.col("quality") - 1).alias("valence"), (0.5 + 0.5 * F.col("toxic")).alias("confidence"))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").filter("c_nationkey < 10").groupBy(F.col("c_nationkey").alias("country")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("all"))).select("country", (F.col("n") / F.col("all")).alias("share"))


@query("v02_shortlist", f"""WITH c AS (SELECT vec_id, d, vec_id % 25 AS country FROM ({_NEAR}) WHERE vec_id <> 0 ORDER BY d, vec_id LIMIT 50), l AS (SELECT id, sum(valence * confidence) AS v, count(*) AS lessons FROM ({_LESSONS}) GROUP BY 1), s AS ({_SHARES}),
a AS (SELECT vec_id, country, d, coalesce(lessons, 0) AS lessons, round(greatest(0.0, d - coalesce(v, 0) * 0.05), 6) AS adjusted FROM c LEFT JOIN l ON id = vec_id),
f AS (SELECT a.*, round(greatest(0.0, adjusted - coalesce(share, 0) * 0.08), 6) AS final FROM a LEFT JOIN s USING (country)),
r AS (SELECT *, row_number() OVER (ORDER BY final, vec_id) AS rank FROM f ORDER BY final, vec_id LIMIT 20)
SELECT vec_id, d, adjusted, final, lessons, CAST(rank AS INTEGER) AS rank, (SELECT arg_max(s_name, (s_acctbal, -s_suppkey)) FROM supplier WHERE s_nationkey = country) AS contact FROM r""")
def shortlist_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty nearest, moved by lessons and by the audience's geography, cut to twenty, with one contact each."""
    e, q = _near(spark, sf_dir)
    found = shortlist(e.filter("vec_id <> 0"), q, 50).withColumn("country", (F.col("vec_id") % 25).cast("int"))
    moved = geo_shift(lesson_shift(found, _lessons(spark, sf_dir)), _shares(spark, sf_dir)).orderBy("final", "vec_id").limit(20)
    ranked = moved.withColumn("rank", F.row_number().over(Window.orderBy("final", "vec_id")))  # twenty rows
    contact = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("country")).agg(F.max_by("s_name", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("contact"))
    return ranked.join(contact, "country", "left").select("vec_id", "d", "adjusted", "final", "lessons", "rank", "contact")


@query("v03_rag_chunks", f"SELECT vec_id, d, lang, source, substr(text, 1, 80) AS title FROM (SELECT * FROM ({_NEAR}) ORDER BY d, vec_id LIMIT 8) JOIN documents ON doc_id = vec_id")
def rag_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _near(spark, sf_dir)
    top = shortlist(e, q, 8).select("vec_id", "d")
    return table(spark, sf_dir, "documents").join(F.broadcast(top), F.col("doc_id") == F.col("vec_id")).select("vec_id", "d", "lang", "source", F.substring("text", 1, 80).alias("title"))  # eight rows


@query("v04_lessons_for", f"""WITH general AS (SELECT vec_id, d FROM ({_NEAR}) WHERE label < 5 ORDER BY d, vec_id LIMIT 10), named AS (SELECT vec_id, d FROM ({_NEAR}) WHERE label >= 5 AND vec_id IN (11, 22, 33, 44)),
u AS (SELECT DISTINCT * FROM (SELECT * FROM general UNION ALL SELECT * FROM named)) SELECT vec_id, d FROM u WHERE vec_id NOT IN (SELECT vec_id - 11 FROM u WHERE vec_id % 2 = 0)""")
def lessons_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General lessons by similarity, named ones by id, then the heads of both."""
    e, q = _near(spark, sf_dir)
    both = shortlist(e, q, 10, F.col("label") < 5).select("vec_id", "d").unionByName(distances(e.filter("label >= 5 AND vec_id IN (11, 22, 33, 44)"), q).select("vec_id", "d")).distinct()
    gone = F.collect_set(F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") - 11)).over(Window.partitionBy(F.lit(0)))  # over ten rows and the named ones
    return both.withColumn("gone", gone).filter(~F.array_contains("gone", F.col("vec_id"))).drop("gone")


@query("v05_lesson_rerank", f"SELECT vec_id, d, coalesce(lessons, 0) AS lessons, round(greatest(0.0, d - coalesce(v, 0) * 0.05), 6) AS adjusted FROM ({_NEAR}) LEFT JOIN (SELECT id, sum(valence * confidence) AS v, count(*) AS lessons FROM ({_LESSONS}) GROUP BY 1) ON id = vec_id")
def lesson_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lesson_shift(distances(*_near(spark, sf_dir)), _lessons(spark, sf_dir)).select("vec_id", "d", "lessons", "adjusted")


@query("v06_geo_rerank", f"SELECT vec_id, round(greatest(0.0, d - coalesce(share, 0) * 0.08), 6) AS final FROM ({_NEAR}) LEFT JOIN ({_SHARES}) ON country = vec_id % 25")
def geo_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distances(*_near(spark, sf_dir)).withColumn("country", (F.col("vec_id") % 25).cast("int")).withColumn("adjusted", F.col("d"))
    return geo_shift(rows, _shares(spark, sf_dir)).select("vec_id", "final")


@query("v07_corpus_position", f"SELECT count(*) FILTER (WHERE d <= 0.9) AS as_close, count(*) AS indexed FROM ({_NEAR})")
def corpus_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(*_near(spark, sf_dir)).agg(count_if(F.col("d") <= 0.9).alias("as_close"), F.count(F.lit(1)).alias("indexed"))


@query("j08_single_row_theta", f"SELECT vec_id FROM ({_NEAR}) WHERE d < 0.8")
def single_row_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(*_near(spark, sf_dir)).filter("d < 0.8").select("vec_id")


@query("w05_rank_of_item", f"SELECT CAST(rn AS INTEGER) AS rank, d FROM (SELECT vec_id, d, row_number() OVER (ORDER BY d, vec_id) AS rn FROM (SELECT * FROM ({_NEAR}) ORDER BY d, vec_id LIMIT 50)) WHERE vec_id = (SELECT vec_id FROM ({_NEAR}) ORDER BY d, vec_id LIMIT 1 OFFSET 6)")
def rank_of_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _near(spark, sf_dir)
    top = shortlist(e, q, 50).withColumn("rank", F.row_number().over(Window.orderBy("d", "vec_id")))  # fifty rows
    return top.filter("rank = 7").select("rank", "d")


DIM = 64


def check_width(vectors: DataFrame, width: int = DIM) -> DataFrame:
    """Raises, when a row is read, on a vector of another width."""
    ok = F.assert_true(F.size("embedding") == width, F.concat(F.lit("vector width "), F.size("embedding").cast("string")))
    return vectors.filter(ok.isNull())


@query("v08_hashed_embeddings", f"""WITH w AS (SELECT doc_id, md5(w) AS h FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\pL\\pN]+')) AS w FROM documents) WHERE w <> ''),
v AS (SELECT doc_id, CAST('0x' || substr(h, 1, 7) AS BIGINT) % {DIM} AS k, sum(CASE WHEN CAST('0x' || substr(h, 8, 7) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM w GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM v GROUP BY 1),
c AS (SELECT doc_id, n, unnest(range(0, {DIM})) AS k FROM n) SELECT doc_id, list(CAST(coalesce(v, 0) / greatest(n, 1e-9) AS FLOAT) ORDER BY k) AS embedding FROM c LEFT JOIN v USING (doc_id, k) GROUP BY 1""")
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offline, deterministic embedder: words hashed to signed buckets, normalised; no model, no Python."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w")).filter("w <> ''")
    part = lambda at: F.conv(F.substring(F.md5("w"), at, 7), 16, 10).cast("long")
    h = d.groupBy("doc_id", (part(1) % DIM).alias("k")).agg(F.sum(F.when(part(8) % 2 == 0, 1).otherwise(-1)).alias("v"))
    norm = h.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"), F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))  # at most DIM entries
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(DIM - 1).cast("long")), lambda i: (F.coalesce(F.element_at("m", i), F.lit(0)) / F.greatest("n", F.lit(1e-9))).cast("float"))
    return norm.select("doc_id", cells.alias("embedding"))


@query("v09_chunks", """WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\\n', chr(10) || ' ' || chr(10), 'g'), '\\n\\s*\\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS ps FROM documents),
w(doc_id, ps, i, cur, outs) AS (SELECT doc_id, ps, 1, '', CAST([] AS VARCHAR[]) FROM p UNION ALL
SELECT doc_id, ps, i + 1, CASE WHEN length(ps[i]) > 1600 THEN '' WHEN cur <> '' AND length(cur) + length(ps[i]) + 2 > 1600 THEN right(cur, 200) || chr(10) || chr(10) || ps[i] WHEN cur <> '' THEN cur || chr(10) || chr(10) || ps[i] ELSE ps[i] END,
CASE WHEN length(ps[i]) > 1600 THEN list_concat(CASE WHEN cur <> '' THEN [cur] ELSE CAST([] AS VARCHAR[]) END, list_transform(range(0, length(ps[i]), 1400), lambda k: substr(ps[i], CAST(k + 1 AS BIGINT), 1600))) WHEN cur <> '' AND length(cur) + length(ps[i]) + 2 > 1600 THEN [cur] ELSE CAST([] AS VARCHAR[]) END FROM w WHERE i <= len(ps)),
c AS (SELECT doc_id, i, unnest(outs) AS chunk, generate_subscripts(outs, 1) AS k FROM w UNION ALL SELECT doc_id, i + 1, cur, 1 FROM w WHERE i > len(ps) AND cur <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS INTEGER) AS ordinal, md5(chunk) AS chunk_hash FROM c""")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents whose lines are paragraphs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n \n").alias("text"))
    return chunked(docs, 1600, 200).select("doc_id", "ordinal", F.md5("chunk").alias("chunk_hash"))


def chunked(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, ordinal, chunk): paragraphs packed up to ``size`` characters; a chunk begins with the last ``overlap`` characters of the one before.  Only a paragraph longer than ``size`` is cut, into overlapping windows, and stands by itself."""
    trimmed = F.transform(F.split("text", r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    paragraphs = F.filter(trimmed, lambda p: p != "")
    empty = F.array().cast("array<string>")
    open_ = lambda a: F.when(a["open"] == "", empty).otherwise(F.array(a["open"]))
    state = lambda done, current: F.struct(done.alias("done"), current.alias("open"))

    def step(a: Column, p: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(size - overlap)), lambda k: F.substring(p, k + 1, F.lit(size)))
        full = (a["open"] != "") & (F.length(a["open"]) + F.length(p) + 2 > size)
        tail = F.concat(F.substring(a["open"], -overlap, overlap), F.lit("\n\n"), p) if overlap else p
        return (
            F.when(F.length(p) > size, state(F.concat(a["done"], open_(a), windows), F.lit("")))
            .when(full, state(F.concat(a["done"], F.array(a["open"])), tail))
            .otherwise(state(a["done"], F.when(a["open"] == "", p).otherwise(F.concat(a["open"], F.lit("\n\n"), p))))
        )

    packed = F.aggregate(paragraphs, state(empty, F.lit("")), step, lambda a: F.concat(a["done"], open_(a)))
    return docs.select("doc_id", F.posexplode(packed).alias("ordinal", "chunk"))


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], width: int, size: int = 16) -> DataFrame:
    """(id, embedding) of (id, text) by a provider that takes ``size`` texts a call; another number of vectors, or another width, raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), size):
                part = pdf.iloc[lo : lo + size]
                found = embed(part["text"].tolist())
                if len(found) != len(part) or any(len(v) != width for v in found):
                    raise ValueError(f"not {len(part)} vectors of {width}")
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": found})

    return texts.select("id", "text").mapInPandas(run, "id long, embedding array<float>")


def batch_results(inputs: DataFrame, lines: DataFrame, width: int) -> DataFrame:
    """(id, embedding, problem): the lines of a batch job's output, in whatever order, by the record ids of ``inputs`` (id).

    ``problem`` is null, "missing", "failed", "width" or "twice"; ``all_or_nothing`` refuses a job with any.
    """
    shape = "recordId string, error string, modelOutput struct<embedding: array<float>>"
    read = lines.select(F.from_json("line", shape).alias("x")).select(F.regexp_extract("x.recordId", "^rec([0-9]+)$", 1).try_cast("long").alias("id"), "x.error", "x.modelOutput.embedding").filter("id IS NOT NULL")
    one = read.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("error").alias("error"), F.first("embedding", ignorenulls=True).alias("embedding"))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "twice").when(F.col("error").isNotNull() | F.col("embedding").isNull(), "failed").when(F.size("embedding") != width, "width")
    both = inputs.select("id").join(one, "id", "left").withColumn("problem", problem)
    return both.select("id", F.when(F.col("problem").isNull(), F.col("embedding")).alias("embedding"), "problem")


def all_or_nothing(results: DataFrame) -> DataFrame:
    """Raises, when a row with a problem is read."""
    told = F.concat(F.lit("record "), F.col("id").cast("string"), F.lit(": "), F.col("problem"))
    return results.filter(F.assert_true(F.col("problem").isNull(), told).isNull()).drop("problem")


@query("v08_batch_results", "SELECT vec_id AS id, CASE WHEN vec_id % 11 = 0 THEN 'missing' WHEN vec_id % 13 = 0 THEN 'twice' WHEN vec_id % 17 = 0 THEN 'failed' WHEN vec_id % 19 = 0 THEN 'width' END AS problem, CASE WHEN vec_id % 11 <> 0 AND vec_id % 13 <> 0 AND vec_id % 17 <> 0 AND vec_id % 19 <> 0 THEN round(CAST(embedding[2] AS DOUBLE), 4) END AS second FROM embeddings")
def batch_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch job's output with lost, doubled, failed and short records."""
    e, k = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    record = F.concat(F.lit("rec"), k.cast("string")).alias("recordId")
    vector = F.when(k % 19 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    line = F.when(k % 17 == 0, F.to_json(F.struct(record, F.lit("throttled").alias("error")))).otherwise(F.to_json(F.struct(record, F.struct(vector.alias("embedding")).alias("modelOutput"))))
    lines = e.filter(k % 11 != 0).select(F.explode(F.when(k % 13 == 0, F.array(line, line)).otherwise(F.array(line))).alias("line")).orderBy("line")
    return batch_results(e.select(k.alias("id")), lines, DIM).select("id", "problem", F.round(F.element_at("embedding", 2).cast("double"), 4).alias("second"))


@query("v10_backfill_selection", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND length(trim(text)) > 0")
def backfill_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.col("source").isin("src1", "src2") & (F.length(F.trim("text")) > 0)).select("doc_id")


RETENTION_FLOOR = "2024-01-01 00:00:00"
_ISO = re.compile(r"\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}(\.\d{1,6})?)?")
_HLC = re.compile(r"\d{1,19}(\.\d{1,10})?")
_AGO = re.compile(r"-\d{1,6}(s|m|h)")


class HistoryExpired(ValueError):
    """The instant is older than what is kept; current rows are never served in its stead."""


def is_instant(c: Column) -> Column:
    """Whether a text is an instant that ``as_of_literal`` takes."""
    shape = lambda p: c.rlike(rf"^(?:{p.pattern})\z")
    return shape(_ISO) | shape(_HLC) | shape(_AGO)


def expired(instant: Column, floor: str = RETENTION_FLOOR) -> Column:
    """Whether an instant is older than what is kept."""
    return instant < F.lit(floor).cast("timestamp_ntz")


def as_of_literal(text: str) -> str:
    """A validated instant: a timestamp, a hybrid logical clock, or a negative interval; anything else raises."""
    if not any(p.fullmatch(text) for p in (_ISO, _HLC, _AGO)):
        raise ValueError(f"not an instant: {text!r}")
    return text


def history(changes: DataFrame, keys: list[str], at: str, order: list[str]) -> DataFrame:
    """Versions with ``valid_from`` and ``valid_to``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return changes.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))


_SECONDS = {"s": 1, "m": 60, "h": 3600}


def wall_micros(instant: str, now: str = AS_OF) -> int:
    """Microseconds since 1970 of a validated instant: a date or timestamp, the wall time (nanoseconds) of a logical clock, or a time before ``now``."""
    since = lambda text: (datetime.datetime.fromisoformat(text) - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    text = as_of_literal(instant)
    if text.startswith("-"):
        return since(now) - int(text[1:-1]) * _SECONDS[text[-1]] * 1_000_000
    if _HLC.fullmatch(text):
        return int(text.split(".")[0]) // 1000
    try:
        return since(text)
    except ValueError:
        raise ValueError(f"not an instant: {instant!r}") from None


def as_of_rows(versions: DataFrame, instant: str, floor: str = RETENTION_FLOOR, now: str = AS_OF) -> DataFrame:
    """The versions valid at an instant of any shape.  Versions begin at whole microseconds with counter 0, so of a logical clock its wall time decides."""
    micros = wall_micros(instant, now)
    if micros < wall_micros(floor):
        raise HistoryExpired(instant)
    latest = (datetime.datetime.max - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    at = F.lit(str(datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=min(micros, latest)))).cast("timestamp_ntz")
    return versions.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


_ASOF = "SELECT user_id, event_id, event_type, value FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events) WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 12:00:00')"


def _state(spark: SparkSession, sf_dir: str, instant: str = "2024-01-15 12:00:00") -> DataFrame:
    return as_of_rows(history(table(spark, sf_dir, "events"), ["user_id"], "ts", ["ts", "event_id"]), instant)


@query("t01_as_of_state", _ASOF)
def as_of_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("user_id", "event_id", "event_type", "value")


@query("t02_pinned_instant", f"WITH s AS ({_ASOF}) SELECT TIMESTAMP '2024-01-15 12:00:00' AS instant, event_id, value FROM s ORDER BY value DESC, event_id LIMIT 10")
def pinned_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).orderBy(F.desc("value"), "event_id").limit(10).select(F.lit("2024-01-15 12:00:00").cast("timestamp_ntz").alias("instant"), "event_id", "value")


@query("t03_replay_ranking", f"""WITH n AS (SELECT vec_id, d, d + CASE WHEN vec_id % 3 = 0 THEN 0.02 ELSE 0 END AS rd FROM ({_NEAR}) WHERE label = 1),
r AS (SELECT vec_id, rd, row_number() OVER (ORDER BY rd, vec_id) AS recorded_rank FROM n QUALIFY recorded_rank <= 10), p AS (SELECT vec_id, d, row_number() OVER (ORDER BY d, vec_id) AS replayed_rank FROM n QUALIFY replayed_rank <= 10)
SELECT coalesce(r.vec_id, p.vec_id) AS vec_id, CAST(recorded_rank AS INTEGER) AS recorded_rank, CAST(replayed_rank AS INTEGER) AS replayed_rank, coalesce(recorded_rank = replayed_rank AND abs(d - rd) < 1e-6, FALSE) AS same FROM r FULL JOIN p ON r.vec_id = p.vec_id""")
def replay_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded ranking against one computed anew from the versions of that instant: same rank, and a distance within 1e-6.  The record here has every third distance off by 0.02."""
    e, q = _near(spark, sf_dir)
    order = Window.orderBy("d", "vec_id")  # over ten rows
    off = distances(e.filter("label = 1"), q).withColumn("d", F.col("d") + F.when(F.col("vec_id") % 3 == 0, 0.02).otherwise(0.0)).orderBy("d", "vec_id").limit(10)
    recorded = off.select("vec_id", F.row_number().over(order).alias("recorded_rank"), F.col("d").alias("recorded_d"))
    versions = e.withColumn("valid_from", F.lit("2024-01-02").cast("timestamp_ntz")).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    then = shortlist(as_of_rows(versions, "2024-01-15 12:00:00"), q, 10, F.col("label") == 1).select("vec_id", F.row_number().over(order).alias("replayed_rank"), "d")
    both = recorded.join(then, "vec_id", "full")
    return both.select("vec_id", "recorded_rank", "replayed_rank", F.coalesce((F.col("recorded_rank") == F.col("replayed_rank")) & (F.abs(F.col("d") - F.col("recorded_d")) < 1e-6), F.lit(False)).alias("same"))


@query("t04_replay_valuation", f"""WITH s AS ({_ASOF}), v AS (SELECT user_id % 50 AS recording, coalesce(sum(CAST(value AS DECIMAL(18,6))) FILTER (WHERE event_type <> 'error'), 0) AS total, count(*) FILTER (WHERE event_type = 'error') AS unvalued FROM s GROUP BY 1),
l AS (SELECT user_id % 50 AS recording, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND NOT (user_id % 7 = 0 AND ts > TIMESTAMP '2024-01-14 00:00:00') GROUP BY user_id),
r AS (SELECT recording, coalesce(sum(CAST(value AS DECIMAL(18,6))) FILTER (WHERE event_type <> 'error'), 0) AS total, count(*) FILTER (WHERE event_type = 'error') AS unvalued FROM l GROUP BY 1)
SELECT v.recording, CAST(v.total AS DECIMAL(28,6)) AS total, v.unvalued, coalesce(v.total = r.total AND v.unvalued = r.unvalued, FALSE) AS agrees FROM v LEFT JOIN r ON v.recording = r.recording""")
def replay_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valuations computed anew as of an instant against what was recorded; the record here missed the last day and a half of every seventh user."""
    exact = F.when(F.col("event_type") != "error", F.col("value").cast("decimal(18,6)"))
    value = lambda df: df.groupBy((F.col("user_id") % 50).alias("recording")).agg(F.coalesce(F.sum(exact), F.lit(0)).alias("total"), count_if(F.col("event_type") == "error").alias("unvalued"))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    seen = table(spark, sf_dir, "events").filter((F.col("ts") <= at("2024-01-15 12:00:00")) & ~((F.col("user_id") % 7 == 0) & (F.col("ts") > at("2024-01-14 00:00:00"))))
    recorded = value(seen.groupBy("user_id").agg(F.max_by(F.struct("value", "event_type"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")).toDF("recording", "t", "u")
    both = value(_state(spark, sf_dir)).join(recorded, "recording", "left")
    return both.select("recording", F.col("total").cast("decimal(28,6)").alias("total"), "unvalued", F.coalesce((F.col("total") == F.col("t")) & (F.col("unvalued") == F.col("u")), F.lit(False)).alias("agrees"))


@query("p01_supersede", """WITH c AS (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS prev FROM orders), k AS (SELECT * FROM c WHERE prev IS NULL OR prev <> o_orderstatus)
SELECT o_orderkey, o_orderstatus AS value_text, lag(o_orderkey) OVER w AS supersedes_id, lead(o_orderdate) OVER w AS superseded_at FROM k WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)""")
def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeat of the live value is no change; a new value supersedes it and points at it."""
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    kept = table(spark, sf_dir, "orders").withColumn("prev", F.lag("o_orderstatus").over(w)).filter("prev IS NULL OR prev <> o_orderstatus")
    return kept.select("o_orderkey", F.col("o_orderstatus").alias("value_text"), F.lag("o_orderkey").over(w).alias("supersedes_id"), F.lead("o_orderdate").over(w).alias("superseded_at"))


@query("p02_trusted_facts", "SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END) AS urgent, max(CASE WHEN o_orderpriority = '5-LOW' THEN o_orderstatus END) AS low FROM (SELECT DISTINCT ON (o_custkey, o_orderpriority) * FROM orders ORDER BY o_custkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey DESC) GROUP BY 1")
def trusted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = newest(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], [F.expr("CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"), F.desc("o_orderkey")])
    return best.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus"))).alias("urgent"), F.max(F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderstatus"))).alias("low"))


@query("p03_basis_walk", """WITH RECURSIVE up(event_id, ancestor, hop) AS (SELECT event_id, event_id // 2, 1 FROM events WHERE event_type = 'purchase' AND event_id // 2 > 0 UNION ALL SELECT event_id, ancestor // 2, hop + 1 FROM up WHERE ancestor // 2 > 0 AND hop < 8)
SELECT u.event_id, 'evidence' AS side, ancestor AS basis_id, CAST(hop AS INTEGER) AS hop, e.event_type AS basis_type FROM up u JOIN events e ON e.event_id = ancestor
UNION ALL SELECT c.event_id, 'dependent', d.event_id, 1, d.event_type FROM events c JOIN events d ON d.event_id // 2 = c.event_id WHERE c.event_type = 'purchase' AND c.event_id > 0""")
def basis_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each claim rests on, up to eight hops, and what rests on it."""
    e = table(spark, sf_dir, "events")
    edges = e.select(F.col("event_id").alias("id"), F.expr("event_id div 2").alias("parent")).filter("parent > 0")
    claims = e.filter("event_type = 'purchase'").select("event_id")
    kinds = e.select(F.col("event_id").alias("basis_id"), F.col("event_type").alias("basis_type"))
    up = claims.join(walk_up(edges, 8), F.col("event_id") == F.col("id")).select("event_id", F.lit("evidence").alias("side"), F.col("ancestor").alias("basis_id"), "hop")
    down = claims.join(edges, F.col("event_id") == F.col("parent")).select("event_id", F.lit("dependent").alias("side"), F.col("id").alias("basis_id"), F.lit(1).alias("hop"))
    return up.unionByName(down).join(kinds, "basis_id").select("event_id", "side", "basis_id", "hop", "basis_type")


@query("p04_ledger", "SELECT event_id, ts, event_type FROM events WHERE event_type IN ('signup', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 50")
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type IN ('signup', 'purchase')").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts", "event_type")


@query("p05_manual_demotes", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'asserted' WHEN o_orderstatus = 'F' THEN 'measured' ELSE 'inferred' END AS provenance FROM orders")
def manual_demotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    was = F.when(F.col("o_orderstatus") == "F", "measured").otherwise("inferred")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when((was == "measured") & (F.col("o_orderkey") % 4 == 0), "asserted").otherwise(was).alias("provenance"))
