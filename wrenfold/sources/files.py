"""File-shaped sources: statements, pasted lists, mail, captions, descriptors. Bad rows go to quarantine with a reason; nothing is silently zero."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenfold.functions import text as X
from wrenfold.functions.rows import table, through_python
from wrenfold.registry import query
from wrenfold.sources.folders import work_folder

# Headers that tell a statement's format.
FORMATS = {"monthly": {"sale month", "isrc", "quantity", "earnings"}, "daily": {"sale date", "isrc", "streams", "revenue"}}


class AmbiguousFormat(ValueError):
    """A file's header fits no format, or several."""


def detect(header: list[str]) -> str:
    """The one format whose headers the file has."""
    have = {" ".join(h.lower().replace("_", " ").split()) for h in header}
    fits = [name for name, need in FORMATS.items() if need <= have]
    if len(fits) != 1:
        raise AmbiguousFormat(f"{fits or 'no format'} for {sorted(have)}")
    return fits[0]


def read_statement(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated statement with typed amounts; an unreadable amount raises when it is read."""
    head = spark.read.option("sep", "\t").option("header", True).csv(path)  # names only; types are never inferred
    detect(head.columns)
    return statement_lines(head.toDF(*[" ".join(c.lower().replace("_", " ").split()) for c in head.columns]))


def statement_lines(rows: DataFrame) -> DataFrame:
    amount = X.parse_amount(F.col("earnings"))
    checked = F.coalesce(amount, F.raise_error(F.concat(F.lit("unreadable amount: "), F.col("earnings"))).cast("decimal(18,6)"))
    month = F.try_to_timestamp("sale month", F.lit("yyyy-MM")).cast("date")
    return rows.select(X.canonical(F.col("isrc"), X.ISRC).alias("isrc"), X.territory(F.col("country")).alias("territory"), month.alias("period_start"), F.last_day(month).alias("period_end"), X.parse_count(F.col("quantity")).alias("quantity"), checked.alias("earnings"))


@query("s10_statement", """SELECT 'USABC' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS isrc, 'US' AS territory, CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start, last_day(l_shipdate) AS period_end, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice, 2) AS DECIMAL(18,6)) AS earnings FROM lineitem""")
def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("us-abc-"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")).alias("isrc"), F.lit(" us").alias("country"), F.date_format("l_shipdate", "yyyy-MM").alias("sale month"),
        F.format_number("l_quantity", 0).alias("quantity"), F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("earnings"),
    )
    return statement_lines(shown)


def _headers(names: Column) -> Column:
    return F.transform(names, lambda c: F.trim(F.regexp_replace(F.lower(F.translate(c, '_"', " ")), r"\s+", " ")))


def read_statements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, quarantine) of all statement files below ``path``, whatever their formats, in one scan of their text.

    A file's first line says its separator (tab, semicolon or comma, whichever cuts it most) and its format; lines have
    one schema: file, format, isrc, territory, period_start, period_end, quantity, earnings.  Files that fit no format, or
    several, go to quarantine whole (a row a file), single lines with an unreadable period or amount a row each: file, line, reason.
    """
    m = F.col("_metadata")
    text = spark.read.option("recursiveFileLookup", True).text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("nth"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"))
    first = text.filter("start = 0 AND trim(line) <> ''").groupBy("file").agg(F.min_by("line", "nth").alias("head"), F.min("nth").alias("head_nth"))  # a row per file
    cells = lambda c, by: F.split(c, by)
    by = F.element_at(F.array_sort(F.transform(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate("\t;,")]), lambda x: F.struct((-F.size(F.split("head", x["s"]))).alias("n"), x["k"].alias("k"), x["s"].alias("s")))), 1)["s"]
    first = first.withColumn("by", by).withColumn("names", _headers(cells(F.col("head"), F.col("by"))))
    fits = F.filter(F.array(*[F.when(F.size(F.array_except(F.array(*map(F.lit, sorted(need))), "names")) == 0, F.lit(name)) for name, need in FORMATS.items()]), lambda x: x.isNotNull())
    first = first.withColumn("fits", fits)
    lost = first.filter("size(fits) <> 1").select("file", F.col("head").alias("line"), F.when(F.size("fits") == 0, "no format has these columns").otherwise(F.concat(F.lit("several formats have these columns: "), F.array_join("fits", ", "))).alias("reason"))
    good = first.filter("size(fits) = 1").select("file", "head_nth", "by", "names", F.col("fits")[0].alias("format"))
    rows = text.filter("trim(line) <> ''").join(F.broadcast(good), "file").filter("nth <> head_nth")  # a row per file, all of which the driver lists to read them; lines stay where they are read
    # a separator inside quotes doesn't cut
    quoted = F.split("line", F.concat(F.col("by"), F.lit('(?=(?:[^"]*"[^"]*")*[^"]*$)')))
    parts = F.transform(F.when(F.contains("line", F.lit('"')), quoted).otherwise(F.split("line", F.col("by"))), lambda c: F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"')))
    rows = rows.withColumn("at", F.map_from_arrays("names", F.slice(F.concat(parts, F.array_repeat(F.lit(None).cast("string"), F.size("names"))), F.lit(1), F.size("names"))))
    of = lambda *names: F.coalesce(*[F.try_element_at("at", F.lit(n)) for n in names])
    month, day = F.try_to_timestamp(of("sale month"), F.lit("yyyy-MM")).cast("date"), F.try_to_timestamp(of("sale date"), F.lit("yyyy-MM-dd")).cast("date")
    monthly = F.col("format") == "monthly"
    read = rows.select(
        "file", "format", "line", X.canonical(of("isrc"), X.ISRC).alias("isrc"), X.territory(of("country", "territory")).alias("territory"), F.when(monthly, month).otherwise(day).alias("period_start"), F.when(monthly, F.last_day(month)).otherwise(day).alias("period_end"),
        X.parse_count(of("quantity", "streams")).alias("quantity"), X.parse_amount(of("earnings", "revenue")).alias("earnings"),
    )
    read = read.withColumn("reason", F.when(F.col("period_start").isNull(), "unreadable period").when(F.col("earnings").isNull(), "unreadable amount"))
    return read.filter("reason IS NULL").drop("line", "reason"), lost.unionByName(read.filter("reason IS NOT NULL").select("file", "line", "reason"))


def _mixed_statements(spark: SparkSession, sf_dir: str) -> str:
    """Lines as a folder of monthly files (tabs), daily files (commas, quoted), and files of no format and of both."""
    path, k = work_folder(spark, "statements"), F.col("l_linenumber")
    row = table(spark, sf_dir, "lineitem")
    isrc, money = F.concat(F.lit("us-abc-"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")).alias("ISRC"), F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))
    month, day, n = F.date_format("l_shipdate", "yyyy-MM"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.format_number("l_quantity", 0)
    broken = F.when(F.col("l_orderkey") % 97 == 0, "n/a").otherwise(money)
    row.filter(k <= 3).select(month.alias("Sale Month"), isrc, F.lit("us").alias("Country"), n.alias("Quantity"), broken.alias("Earnings")).write.option("sep", "\t").option("header", True).csv(f"{path}/monthly")
    row.filter(k.between(4, 5)).select(isrc, F.lit(" GB").alias("territory"), day.alias("sale_date"), n.alias("Streams"), money.alias("Revenue")).write.option("header", True).option("quoteAll", True).csv(f"{path}/daily")
    row.filter(k == 6).select(isrc, money.alias("net")).write.option("header", True).csv(f"{path}/other")
    row.filter(k == 7).select(isrc, month.alias("Sale Month"), day.alias("Sale Date"), n.alias("Quantity"), n.alias("Streams"), money.alias("Earnings"), money.alias("Revenue")).write.option("header", True).option("sep", ";").csv(f"{path}/both")
    return path


@query("s10_statement_folder", """SELECT CASE WHEN l_linenumber <= 3 THEN 'monthly' ELSE 'daily' END AS format, 'USABC' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS isrc, CASE WHEN l_linenumber <= 3 THEN 'US' ELSE 'GB' END AS territory, CAST(CASE WHEN l_linenumber <= 3 THEN date_trunc('month', l_shipdate) ELSE l_shipdate END AS DATE) AS period_start,
CAST(CASE WHEN l_linenumber <= 3 THEN last_day(l_shipdate) ELSE l_shipdate END AS DATE) AS period_end, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice, 2) AS DECIMAL(18,6)) AS earnings FROM lineitem WHERE l_linenumber <= 5 AND NOT (l_linenumber <= 3 AND l_orderkey % 97 = 0)""")
def statement_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readable lines of a folder of mixed formats."""
    return read_statements(spark, _mixed_statements(spark, sf_dir))[0].drop("file")


@query("s10_statement_quarantine", """SELECT 'unreadable amount' AS reason, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey % 97 = 0 HAVING count(*) > 0""")
def statement_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be read, line by line; whole files are listed once each and depend on how many there are."""
    return read_statements(spark, _mixed_statements(spark, sf_dir))[1].filter("reason LIKE 'unreadable%'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def scout_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) from ``handle|platform|sound|views|median|genre``; an empty count is unknown, not zero."""
    p = lines.filter((F.trim("line") != "") & ~F.trim("line").startswith("#")).withColumn("p", F.split("line", r"\|"))
    at = lambda i: F.trim(F.try_element_at("p", F.lit(i)))
    rows = p.select("line", at(1).alias("handle"), F.lower(at(2)).alias("platform"), at(3).alias("sound_ref"), F.nullif(at(4), F.lit("")).alias("v"), F.nullif(at(5), F.lit("")).alias("m"), F.nullif(at(6), F.lit("")).alias("asserted_genre"))
    rows = rows.withColumn("view_count", F.col("v").try_cast("long")).withColumn("creator_median_views", F.col("m").try_cast("long"))
    reason = F.when(F.coalesce("handle", F.lit("")) == "", "no handle").when(F.col("v").isNotNull() & F.col("view_count").isNull(), "views unreadable").when(F.col("m").isNotNull() & F.col("creator_median_views").isNull(), "median unreadable")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason IS NULL").drop("line", "v", "m", "reason"), rows.filter("reason IS NOT NULL").select("line", "reason")


@query("s11_scout_paste", """SELECT '@u' || CAST(user_id AS VARCHAR) AS handle, event_type AS platform, 's' || CAST(event_id AS VARCHAR) AS sound_ref, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS view_count, user_id AS creator_median_views, 'house' AS asserted_genre FROM events WHERE event_id % 7 <> 0 AND event_id % 10 <> 3""")
def scout_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    views = F.when(k % 5 == 0, "").when(k % 10 == 3, "lots").otherwise(k.cast("string"))
    line = F.concat_ws(" | ", F.concat(F.lit("@u"), F.col("user_id").cast("string")), F.upper("event_type"), F.concat(F.lit("s"), k.cast("string")), views, F.col("user_id").cast("string"), F.lit("house"))
    return scout_lines(table(spark, sf_dir, "events").select(F.when(k % 7 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("line")))[0]


@query("s12_mail", r"""SELECT '<' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) || '>' AS message_id, 'a@x.example' AS sender, 're' AS subject, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM conversations""")
def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the conversations, written as mail and read back."""
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("From: a@x.example\r\nMessage-ID: <"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit(">\r\nSubject: re\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"), F.coalesce("text", F.lit(""))).cast("binary").alias("content"))
    return parse_mail(c).drop("error")


def parse_mail(files: DataFrame) -> DataFrame:
    """message_id, sender, subject, body (text/plain preferred, else text of HTML) of RFC 822 files, and ``error``: why a message, or its body, can't be read."""
    return through_python(files.select("content"), "message_id string, sender string, subject string, body string, error string", lambda raw: [_message(raw)])


def _message(raw: bytes | None) -> tuple:
    from email import message_from_bytes, policy

    if raw is None or not bytes(raw).strip():
        return None, None, None, None, "no message"
    head: list[str | None] = [None, None, None]
    try:
        m = message_from_bytes(bytes(raw), policy=policy.default)
        for k, name in enumerate(("message-id", "from", "subject")):
            head[k] = None if m[name] is None else str(m[name])
        body = m.get_body(("plain", "html"))
        return *head, body.get_content().strip() if body else None, None
    except Exception as e:  # noqa: BLE001  whatever a broken message raises is its own row's error
        return *head, None, f"{type(e).__name__}: {e}".split("\n")[0]


@query("s13_documents_by_hash", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def documents_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def flat_yaml(text: str) -> dict[str, str]:
    """``key: value`` lines, nested by two spaces; nested keys are joined by dots, an empty value is an empty text.  Lists, anchors and texts over several lines are no part of these descriptors and raise."""
    out: dict[str, str] = {}
    path: list[str] = []
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#") or bare == "---":
            continue
        depth, odd = divmod(len(line) - len(line.lstrip(" ")), 2)
        key, colon, value = bare.partition(":")
        if odd or not colon or depth > len(path) or bare.startswith(("- ", "&", "*")) or (value and value[0] != " "):
            raise ValueError(f"no key: {line!r}")
        path = [*path[:depth], key.strip("\"'")]
        value = value.strip()
        if value in ("|", ">") or value.startswith(("[", "{", "&", "*")):
            raise ValueError(f"no plain value: {line!r}")
        out[".".join(path)] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
        if depth:
            out.pop(".".join(path[:-1]), None)  # its parent is a mapping
    return out


def yaml_documents(files: DataFrame) -> DataFrame:
    """(path, fields, error) for (path, value): what can't be parsed is listed with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["value"], strict=True):
                try:
                    out.append((path, flat_yaml(text), None))
                except Exception as e:  # noqa: BLE001  any parser's error is the row's
                    out.append((path, None, str(e).split("\n")[0]))
            yield pd.DataFrame(out, columns=["path", "fields", "error"])

    return files.mapInPandas(run, "path string, fields map<string,string>, error string")


def _yaml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("id: "), F.col("p_partkey").cast("string"), F.lit("\nsource_meta:\n  duration_ms: "), (F.col("p_size") * 1000).cast("string"), F.lit("\n  fps: 25.0\nrights:\n  source: "), F.col("p_brand"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("tenants/t/clip/"), F.col("p_partkey").cast("string"), F.lit(".yaml")).alias("path"), F.when(F.col("p_partkey") % 50 == 0, "no key here").otherwise(body).alias("value"))


@query("s14_document_listing", "SELECT 'tenants/t/clip/' || CAST(p_partkey AS VARCHAR) || '.yaml' AS path, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey % 50 <> 0")
def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yaml_documents(_yaml_files(spark, sf_dir)).filter("error IS NULL").select("path", F.col("fields")["id"].alias("id"))


@query("s15_clip_descriptors", "SELECT 'tenants/t/clip/' || CAST(p_partkey AS VARCHAR) || '.yaml' AS path, CASE WHEN p_partkey % 50 <> 0 THEN CAST(p_size AS BIGINT) * 1000 END AS duration_ms, CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS rights, p_partkey % 50 = 0 AS unreadable FROM part")
def clip_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yaml_documents(_yaml_files(spark, sf_dir)).select("path", F.col("fields")["source_meta.duration_ms"].cast("long").alias("duration_ms"), F.col("fields")["rights.source"].alias("rights"), F.col("error").isNotNull().alias("unreadable"))


_CUE = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{2}[.,]\d{3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2}[.,]\d{3})[^\n]*")
_STAMP = re.compile(r"<(?:(\d+):)?(\d{1,2}):(\d{2}\.\d{3})>")
_TAG = re.compile(r"<[^>]*>")
#: Characters of captions in which a line is looked for that only rolls on.
ROLL = 400


def _seconds(h: str | None, m: str, s: str) -> float:
    return int(h or 0) * 3600 + int(m) * 60 + float(s.replace(",", "."))


def timed_words(text: str) -> list[tuple[float, str]]:
    """Words of a caption file with their times.

    Captions roll: a cue shows again what the one before said.  Where a cue has words with times of their own, only
    those lines are new (a line's head has the cue's time); else a line counts if it wasn't shown just before.  Cues of
    less than 50 ms only space others.
    """
    out: list[tuple[float, str]] = []
    shown = " "

    def say(at: float, words: list[str]) -> None:
        nonlocal shown
        out.extend((at, w) for w in words)
        said = " ".join(words)
        shown = (shown + said + " ")[-max(ROLL, len(said) + 2) :] if words else shown

    for block in unescape(text.replace("\r\n", "\n").replace("\r", "\n")).split("\n\n"):
        cue = _CUE.search(block)
        if not cue:
            continue
        begin, end = _seconds(*cue.groups()[:3]), _seconds(*cue.groups()[3:])
        lines = block[cue.end() :].splitlines()
        timed = [line for line in lines if _STAMP.search(line)]
        for line in timed:
            head, *rest = _STAMP.split(line)
            say(begin, _TAG.sub(" ", head).split())
            for k in range(0, len(rest), 4):
                say(_seconds(*rest[k : k + 3]), _TAG.sub(" ", rest[k + 3]).split())
        for line in lines if not timed and end - begin >= 0.05 else ():
            words = _TAG.sub(" ", line).split()
            if words and f" {' '.join(words)} " not in shown:
                say(begin, words)
    return sorted(out, key=lambda x: x[0])


@query("s16_captions", r"""WITH w AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS ws FROM conversations))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS INTEGER) AS idx, CAST(turn AS DOUBLE) AS start_s, word FROM w""")
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as rolling cues: each line is shown once more in the cue after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    line = F.regexp_replace("text", r"\s+", " ")
    stamp = lambda s: F.format_string("%02d:%02d:%02d.000", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    at = F.col("turn").cast("long")
    cue = F.concat(stamp(at), F.lit(" --> "), stamp(at + 1), F.lit("\n"), F.coalesce(F.concat(F.lag(line).over(w), F.lit("\n")), F.lit("")), line)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", cue.alias("cue"))
    vtt = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "cue"))).alias("cues")).select("conv_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("cues", lambda c: c["cue"]), "\n\n")).alias("vtt"))

    def work(conv: int, text: str) -> Iterator[tuple]:
        return ((conv, i, t, w) for i, (t, w) in enumerate(timed_words(text)))

    return through_python(vtt, "conv_id long, idx int, start_s double, word string", work)


@query("s19_harvest_bundle", """SELECT c_custkey AS party, 'identifier' AS entity, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'fact', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'metric', CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) FROM customer""")
def harvest_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed JSON per party, exploded to its entities."""
    js = F.to_json(F.struct(F.struct(F.lit("identifier").alias("entity"), F.col("c_name").alias("value")).alias("a"), F.struct(F.lit("fact").alias("entity"), F.col("c_mktsegment").alias("value")).alias("b"), F.struct(F.lit("metric").alias("entity"), F.round("c_acctbal").cast("long").cast("string").alias("value")).alias("c")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("party"), F.from_json(js, "map<string,struct<entity:string,value:string>>").alias("m"))
    return rows.select("party", F.explode(F.map_values("m")).alias("e")).select("party", "e.entity", "e.value")
