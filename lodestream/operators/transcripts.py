"""Transcripts: subtitle documents, fixed windows of time, and the selection of videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestream.functions.text import strip
from lodestream.session import cut, small_side

WINDOW_S = 120
JSON3 = "events ARRAY<STRUCT<tStartMs: BIGINT, dDurationMs: BIGINT, segs: ARRAY<STRUCT<utf8: STRING>>>>"


def parse_json3(df: DataFrame, body: str = "body") -> DataFrame:
    """``<other columns>, pos, text, start, duration`` of subtitle documents; broken ones and empty events give no rows."""
    rest = [c for c in df.columns if c != body]
    events = df.select(*rest, F.posexplode(F.from_json(body, JSON3)["events"]).alias("pos", "e"))
    text = strip(F.array_join(F.transform(F.coalesce("e.segs", F.array().cast("array<struct<utf8:string>>")), lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    rows = events.select(*rest, "pos", text.alias("text"), (F.coalesce("e.tStartMs", F.lit(0)) / 1000.0).alias("start"), (F.coalesce("e.dDurationMs", F.lit(0)) / 1000.0).alias("duration"))
    return rows.filter(F.col("text") != "")


def segment(entries: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """``video_id, segment_index, total_segments, start_s, end_s, text`` of ``video_id, pos, text, start, duration``.

    Windows of ``window_s`` follow each other from the start of the first entry (least ``start``, then
    ``pos``). A window starts at its first entry's start and ends at its last entry's end; blank windows
    are left out and the rest numbered from 0. Null texts are blank, null starts and durations 0, repeated
    rows count once.
    """
    ms = lambda c: F.round(F.coalesce(c, F.lit(0.0)) * 1000).cast("long")
    rows = entries.select("video_id", "pos", strip(F.coalesce("text", F.lit(""))).alias("text"), ms(F.col("start")).alias("s"), ms(F.col("duration")).alias("d")).distinct()
    placed = rows.withColumn("w", F.floor((F.col("s") - F.min("s").over(W.partitionBy("video_id"))) / (window_s * 1000)))
    parts = F.array_sort(F.collect_list(F.struct("s", "pos", "d", "text")))
    grouped = placed.groupBy("video_id", "w").agg(parts.alias("p"))
    text = strip(F.array_join(F.transform("p", lambda x: x["text"]), " "))
    last = F.element_at("p", -1)
    windows = grouped.select("video_id", "w", (F.col("p")[0]["s"] / 1000.0).alias("start_s"), ((last["s"] + last["d"]) / 1000.0).alias("end_s"), text.alias("text")).filter(F.col("text") != "")
    by = W.partitionBy("video_id")
    return windows.select("video_id", (F.row_number().over(by.orderBy("w")) - 1).alias("segment_index"), F.count(F.lit(1)).over(by).alias("total_segments"), "start_s", "end_s", "text")


def passes_gates(duration: Column, views: Column, min_s: int = 0, max_s: int | None = None, min_views: int = 0) -> Column:
    """Whether a video's length and views are wanted; an unknown length passes, unknown views count as 0."""
    d = F.coalesce(duration, F.lit(0))
    longest = F.lit(True) if max_s is None else d <= max_s
    return ((d == 0) | ((d >= min_s) & longest)) & (F.lit(min_views <= 0) | (F.coalesce(views, F.lit(0)) >= min_views))


def fresh(upload_date: Column, cutoff: str | None) -> Column:
    """Whether a ``YYYYMMDD`` text is not before the cut-off; an empty date passes, no cut-off passes all."""
    return F.lit(True) if cutoff is None else (F.coalesce(upload_date, F.lit("")) == "") | (upload_date >= cutoff)


def select_videos(videos: DataFrame, gate: Column, order: str, limit: int, by: str = "source_name") -> DataFrame:
    """The first ``limit`` videos of each source that pass the gate, with what was skipped before them.

    Adds ``place`` and, as the listing stops at the last one taken, ``skipped`` for the rows examined.
    """
    judged = videos.withColumn("_ok", F.coalesce(gate, F.lit(False)))
    place = F.row_number().over(W.partitionBy(by).orderBy(order))
    # each task keeps its first ``limit`` of a source before anything is moved
    taken = cut(judged.filter("_ok").withColumn("place", place).filter(F.col("place") <= limit).withColumn("place", F.col("place").cast("long")).drop("_ok"))
    few = small_side(taken.select(F.col(by).alias("_by"), F.col(order).alias("_at")))
    passed_over = judged.filter(~F.col("_ok")).join(few, F.col(by).eqNullSafe(F.col("_by")) & (F.col(order) < F.col("_at")))
    skipped = cut(passed_over.groupBy("_by", "_at").agg(F.count(F.lit(1)).alias("skipped")))
    with_counts = taken.join(small_side(skipped), F.col(by).eqNullSafe(F.col("_by")) & F.col(order).eqNullSafe(F.col("_at")), "left").drop("_by", "_at")
    return with_counts.withColumn("skipped", F.coalesce("skipped", F.lit(0)).cast("long"))


def recheck(picked: DataFrame, details: DataFrame, gate: Column, key: str) -> DataFrame:
    """The picked videos whose details, which a listing may not have had, pass the gate as well; one without details stays."""
    known = details.dropDuplicates([key])
    return picked.join(known.withColumn("_there", F.lit(True)), key, "left").filter(F.col("_there").isNull() | F.coalesce(gate, F.lit(False))).drop("_there")
