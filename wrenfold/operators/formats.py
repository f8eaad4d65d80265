"""The report of a video format's rules (M-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.functions.rows import table
from wrenfold.registry import query

# What a format asks for where it says nothing else.
FORMAT = {"must_end_on": "hard_cut", "max_ms": 8000, "hook_beats": 8, "off_grid_ms": 20, "most_words": 9, "least_words": 3, "pre_roll_bars": 2, "least_items": 3, "carousel_beats": 9, "axis_run": 2, "peak_within_last": 0.34, "least_lift": 0.5, "escalates_from": 6}
MOVES = ("in", "out", "in")


def format_report(videos: DataFrame, items: DataFrame) -> DataFrame:
    """(video, rule): the rules that each video breaks.

    ``videos``: video, dur, cut_kind, can_lead, words, min_useful, ai, style, bpm, axes (declared);
    ``items`` of their carousels: video, position, beats, intensity, axis.  What a video leaves open isn't judged.
    """
    f = FORMAT
    one = F.array_sort(F.collect_list(F.struct("position", "beats", "intensity", "axis")))  # a carousel has a few dozen pictures
    v = videos.join(items.groupBy("video").agg(one.alias("items")), "video", "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<position:int,beats:int,intensity:int,axis:string>>")))
    n, beat, dur = F.size("items"), 60000.0 / F.col("bpm"), F.col("dur")
    body = F.slice("items", F.lit(1), F.greatest(n - 1, F.lit(0)))
    levels = F.transform(body, lambda x: x["intensity"])
    size, peak = F.size(levels), F.array_max(levels)
    third = F.greatest(F.lit(1), F.floor(size / 3)).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    lift = mean(F.slice(levels, size - third + 1, third)) - mean(F.slice(levels, F.lit(1), third))
    last_peak = size - F.array_position(F.reverse(levels), peak)
    escalates = size >= f["escalates_from"]
    move = lambda i: F.element_at(F.array(*map(F.lit, MOVES)), (i % len(MOVES) + 1).cast("int"))
    axis = F.transform("items", lambda x: x["axis"])
    at = lambda a, i: F.element_at(a, (i + 1).cast("int"))
    run = f["axis_run"]
    long_run = F.exists(F.sequence(F.lit(0), n - 1 - run), lambda i: F.forall(F.sequence(F.lit(1), F.lit(run)), lambda j: at(axis, i) == at(axis, i + j)))
    rules: dict[str, Column] = {
        "hook may not lead": ~F.col("can_lead"),
        "hook says nothing": F.col("words") == 0,
        "hook ends on no cut": F.col("cut_kind") != f["must_end_on"],
        "hook under its own least": dur < F.col("min_useful"),
        "hook too long": dur > f["max_ms"],
        "generated hook off its grid": F.col("ai") & (F.abs(dur - F.bround(f["hook_beats"] * beat)) > f["off_grid_ms"]),
        "line too long": F.col("words") > f["most_words"],
        "line too short": F.col("words").between(1, f["least_words"] - 1),
        "no prompt on record": F.col("ai") & (F.coalesce(F.trim("style"), F.lit("")) == ""),
        "tempo not measured": F.col("bpm").isNull(),
        "pre-roll longer than the hook": f["pre_roll_bars"] * 4 * beat > dur,
        "too few pictures": n < f["least_items"],
        "beats differ": F.aggregate("items", F.lit(0), lambda s, x: s + x["beats"]) != f["carousel_beats"],
        "same move twice": F.when(n > 1, F.exists(F.sequence(F.lit(0), n - 2), lambda i: move(i) == move(i + 1))),
        "peak too early": escalates & (last_peak < F.floor(size * (1 - f["peak_within_last"]))),
        "end card too loud": escalates & (F.element_at("items", -1)["intensity"] >= peak),
        "no rise": escalates & (lift < f["least_lift"]),
        "undeclared axis": F.exists(axis, lambda x: ~F.array_contains("axes", x)),
        "axis never hit": F.exists("axes", lambda x: ~F.array_contains(axis, x)),
        "axis runs on": F.when(n > run, long_run),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return v.select("video", F.explode(broken).alias("rule"))


@query("m15_rule_checks", """WITH v AS (SELECT o_orderkey AS video, 1500 + o_orderkey * 37 % 9000 AS dur, CASE WHEN o_orderkey % 4 = 0 THEN 'fade' ELSE 'hard_cut' END AS cut_kind, o_orderkey % 5 <> 0 AS can_lead, o_orderkey % 13 AS words, CASE WHEN o_orderkey % 3 = 0 THEN 2000 END AS min_useful, o_orderkey % 2 = 0 AS ai, CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE 'film' END AS style,
CASE WHEN o_orderkey % 7 <> 0 THEN 60000.0::DOUBLE / (90 + o_orderkey % 60) END AS beat, CASE WHEN o_orderkey % 4 = 1 THEN ['light', 'motion', 'scale'] ELSE ['light', 'motion'] END AS axes FROM orders),
i AS (SELECT l_orderkey AS video, l_linenumber AS pos, 1 + CAST(l_quantity AS INTEGER) % 2 AS beats, l_partkey % 5 + 1 AS lvl, CASE WHEN l_quantity < 30 THEN 'light' WHEN l_quantity < 49 THEN 'motion' ELSE 'temp' END AS axis FROM lineitem),
a AS (SELECT video, list(beats ORDER BY pos, beats, lvl, axis) AS beats, list(lvl ORDER BY pos, beats, lvl, axis) AS lvls, list(axis ORDER BY pos, beats, lvl, axis) AS ax FROM i GROUP BY 1),
j AS (SELECT v.*, coalesce(beats, []) AS beats, coalesce(lvls, []) AS lvls, coalesce(ax, []) AS ax, coalesce(len(lvls), 0) AS n FROM v LEFT JOIN a USING (video)),
k AS (SELECT *, lvls[1:greatest(n - 1, 0)] AS body, greatest(n - 1, 0) AS m, list_max(lvls[1:greatest(n - 1, 0)]) AS peak FROM j),
l AS (SELECT *, greatest(1, m // 3) AS third, list_max(list_filter(range(0, m), lambda q: body[q + 1] = peak)) AS peak_at FROM k)
SELECT video, unnest(list_filter([CASE WHEN NOT can_lead THEN 'hook may not lead' END, CASE WHEN words = 0 THEN 'hook says nothing' END, CASE WHEN cut_kind <> 'hard_cut' THEN 'hook ends on no cut' END, CASE WHEN dur < min_useful THEN 'hook under its own least' END, CASE WHEN dur > 8000 THEN 'hook too long' END,
CASE WHEN ai AND abs(dur - round_even(8 * beat, 0)) > 20 THEN 'generated hook off its grid' END, CASE WHEN words > 9 THEN 'line too long' END, CASE WHEN words BETWEEN 1 AND 2 THEN 'line too short' END, CASE WHEN ai AND trim(style) = '' THEN 'no prompt on record' END, CASE WHEN beat IS NULL THEN 'tempo not measured' END, CASE WHEN 8 * beat > dur THEN 'pre-roll longer than the hook' END,
CASE WHEN n < 3 THEN 'too few pictures' END, CASE WHEN coalesce(list_sum(beats), 0) <> 9 THEN 'beats differ' END, CASE WHEN n >= 4 THEN 'same move twice' END, CASE WHEN m >= 6 AND peak_at < floor(m * (1 - 0.34)) THEN 'peak too early' END, CASE WHEN m >= 6 AND lvls[n] >= peak THEN 'end card too loud' END,
CASE WHEN m >= 6 AND list_avg(body[m - third + 1:m]) - list_avg(body[1:third]) < 0.5 THEN 'no rise' END, CASE WHEN len(list_filter(ax, lambda x: NOT list_contains(axes, x))) > 0 THEN 'undeclared axis' END, CASE WHEN len(list_filter(axes, lambda x: NOT list_contains(ax, x))) > 0 THEN 'axis never hit' END,
CASE WHEN len(list_filter(range(1, n - 1), lambda q: ax[q] = ax[q + 1] AND ax[q] = ax[q + 2])) > 0 THEN 'axis runs on' END], lambda x: x IS NOT NULL)) AS rule FROM l""")
def rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    videos = table(spark, sf_dir, "orders").select(
        k.alias("video"), (1500 + k * 37 % 9000).alias("dur"), F.when(k % 4 == 0, "fade").otherwise("hard_cut").alias("cut_kind"), (k % 5 != 0).alias("can_lead"), (k % 13).alias("words"), F.when(k % 3 == 0, 2000).alias("min_useful"), (k % 2 == 0).alias("ai"),
        F.when(k % 6 == 0, " ").otherwise("film").alias("style"), F.when(k % 7 != 0, 90 + k % 60).alias("bpm"), F.when(k % 4 == 1, F.array(*map(F.lit, ("light", "motion", "scale")))).otherwise(F.array(F.lit("light"), F.lit("motion"))).alias("axes"),
    )
    q = F.col("l_quantity")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video"), F.col("l_linenumber").cast("int").alias("position"), (1 + q.cast("int") % 2).alias("beats"), (F.col("l_partkey") % 5 + 1).cast("int").alias("intensity"), F.when(q < 30, "light").when(q < 49, "motion").otherwise("temp").alias("axis")
    )
    return format_report(videos, items)
