"""Smaller transforms: profile composition, guarded instants, signatures, batched lookups, settings."""

from __future__ import annotations

import contextlib
import hashlib
import hmac
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.functions.rows import table
from wrenfold.operators import retrieval
from wrenfold.registry import query
from wrenfold.sources.folders import work_folder
from wrenfold.sources.manifest import local
from wrenfold.sources.paged import land_pages


def composed(rows: DataFrame, cap: int = 400) -> DataFrame:
    """``profile``: the sentences of ``body`` in order, without the party's own ``name``, up to ``cap`` characters and never part of a sentence."""
    bare = F.replace(F.col("body"), F.col("name"), F.lit(""))
    sentences = F.filter(F.transform(F.split(bare, r"(?<=[.!?])\s+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s).between(1, cap))
    grown = F.aggregate(sentences, F.lit(""), lambda acc, s: F.when(F.length(acc) + F.length(s) + F.when(acc == "", 0).otherwise(1) <= cap, F.when(acc == "", s).otherwise(F.concat(acc, F.lit(" "), s))).otherwise(acc))
    return rows.withColumn("profile", grown)


@query("x17_profile", r"""SELECT doc_id, list_reduce(list_prepend('', list_filter(list_transform(string_split(regexp_replace(replace(text, source, ''), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: length(s) BETWEEN 1 AND 400)),
lambda acc, s: CASE WHEN acc = '' THEN s WHEN length(acc) + length(s) + 1 <= 400 THEN acc || ' ' || s ELSE acc END) AS profile FROM documents""")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composed(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"), F.col("text").alias("body"))).select("doc_id", "profile")


@query("t05_history_expiry", "SELECT event_id, CASE WHEN ts - to_days(CAST(event_id % 40 AS INTEGER)) < TIMESTAMP '2024-01-01 00:00:00' THEN 'expired' ELSE 'served' END AS answer FROM events")
def history_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for states of the past: those older than what is kept are answered as expired, never by current rows (``as_of_rows`` raises)."""
    asked = F.col("ts") - F.expr("make_dt_interval(cast(event_id % 40 AS int))")
    return table(spark, sf_dir, "events").select("event_id", F.when(retrieval.expired(asked), "expired").otherwise("served").alias("answer"))


@query("t06_as_of_literals", r"""WITH l AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN CAST(epoch_us(ts) AS VARCHAR) || '.' || CAST(event_id AS VARCHAR) WHEN 3 THEN '-' || CAST(event_id AS VARCHAR) || 's' WHEN 4 THEN 'now()'
WHEN 5 THEN strftime(ts, '%Y-%m-%d') || chr(39) || ' OR 1=1' WHEN 6 THEN strftime(ts, '%Y-%m-%d') || chr(10) ELSE CAST(event_id AS VARCHAR) || 's' END AS literal FROM events)
SELECT event_id, regexp_full_match(literal, '\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}(\.\d{1,6})?)?') OR regexp_full_match(literal, '\d{1,19}(\.\d{1,10})?') OR regexp_full_match(literal, '-\d{1,6}(s|m|h)') AS valid FROM l""")
def as_of_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd")
    stamp = F.concat_ws(".", F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), k.cast("string"))
    shown = (day, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), stamp, F.concat(F.lit("-"), k.cast("string"), F.lit("s")), F.lit("now()"), F.concat(day, F.lit("' OR 1=1")), F.concat(day, F.lit("\n")), F.concat(k.cast("string"), F.lit("s")))
    literal = F.element_at(F.array(*shown), (k % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", retrieval.is_instant(literal).alias("valid"))


def signed(rows: DataFrame, secret: bytes, tolerance: int = 300) -> DataFrame:
    """``accepted`` for webhooks (body, at, now, signature): HMAC-SHA256 of ``at.body``, compared in constant time, and no older than the tolerance."""

    @F.pandas_udf("boolean")
    def check(body: pd.Series, at: pd.Series, now: pd.Series, signature: pd.Series) -> pd.Series:
        return pd.Series([abs(n - a) <= tolerance and hmac.compare_digest(hmac.new(secret, f"{a}.{b}".encode(), hashlib.sha256).hexdigest(), s or "") for b, a, n, s in zip(body, at, now, signature, strict=True)])

    return rows.withColumn("accepted", check("body", "at", "now", "signature"))


@query("d18_webhook_signature", "SELECT event_id, event_id % 3 <> 0 AND event_id % 400 <= 300 AS accepted FROM events")
def webhook_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(signature=[hmac.new(b"k" if i % 3 else b"forged", f"{a}.{b}".encode(), hashlib.sha256).hexdigest() for i, b, a in zip(pdf["event_id"], pdf["body"], pdf["at"], strict=True)])

    e = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("body"), F.lit(1_700_000_000).cast("long").alias("at"), (1_700_000_000 + F.col("event_id") % 400).alias("now"))
    return signed(e.mapInPandas(sign, "event_id long, body string, at long, now long, signature string"), b"k").select("event_id", "accepted")


def looked_up(keys: DataFrame, fetch: Callable[[list[str]], dict[str, str]], size: int = 50) -> DataFrame:
    """(key, value) by a service that takes ``size`` keys a call; keys it doesn't know have no value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), size):
                part = pdf["key"].iloc[lo : lo + size].tolist()
                found = fetch(part)
                yield pd.DataFrame({"key": part, "value": [found.get(k) for k in part]})

    return keys.select("key").mapInPandas(run, "key string, value string")


@query("s05_batched_lookup", "SELECT CAST(k AS VARCHAR) AS key, c_name AS value FROM (SELECT DISTINCT o_custkey * 2 AS k FROM orders) LEFT JOIN customer ON c_custkey = k")
def batched_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by key from landed pages of customers, a page for each hundred keys; some keys aren't known there."""
    path = work_folder(spark, "names")
    land_pages(table(spark, sf_dir, "customer").select(F.expr("c_custkey div 100").alias("block"), "c_custkey", "c_name"), "block", "c_custkey", path, 100)
    folder = local(path)

    def fetch(keys: list[str]) -> dict[str, str]:
        known: dict[str, str] = {}
        for block in {int(k) // 100 for k in keys}:
            with contextlib.suppress(FileNotFoundError), open(f"{folder}/{block}-0.json", encoding="utf-8") as page:
                known |= {str(item["c_custkey"]): item["c_name"] for item in json.load(page)}
        return known

    return looked_up(table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).cast("string").alias("key")).distinct(), fetch)


def merged_settings(base: dict, over: dict) -> dict:
    """Maps merge key by key; anything else, lists too, is replaced."""
    return {k: merged_settings(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in {**base, **over}}
