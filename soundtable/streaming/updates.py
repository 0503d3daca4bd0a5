"""Event streams; each function plans alike for a stream and for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundtable.functions.scalars import lufs


def coalesce_updates(events: DataFrame, subscriptions: DataFrame, every: str = "100 milliseconds", watermark: str = "3 seconds") -> DataFrame:
    """(window_start, uri): resources that events (ts, kind, track) touch, those subscribed to, once for each window."""
    project, graph = F.lit("project/state"), F.lit("project/routing")
    track = F.concat(F.lit("track/"), F.col("track").cast("string"), F.lit("/chunk"))
    uris = F.when(F.col("kind") == "TrackList", F.array(project, graph)).when(F.col("kind") == "PlayState", F.array(project)).when(F.col("kind") == "Other", F.array(F.lit("")).cast("array<string>")).otherwise(F.array(project, track))
    touched = events.withWatermark("ts", watermark).select("ts", F.explode(uris).alias("uri"))
    mine = touched.join(F.broadcast(subscriptions), "uri", "left_semi")
    return mine.groupBy(F.window("ts", every).alias("w"), "uri").agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "uri", "events")


def live_peaks(peaks: DataFrame, every: str = "1 hour", watermark: str = "3 seconds") -> DataFrame:
    """Greatest and latest peak of each track and channel (ts, track, channel, peak) in each window."""
    w = F.window("ts", every).alias("w")
    out = peaks.withWatermark("ts", watermark).groupBy(w, "track", "channel").agg(F.max("peak").alias("most"), F.max_by("peak", F.struct("ts", "peak")).alias("latest"))
    return out.select(F.col("w.start").alias("window_start"), "track", "channel", "most", "latest")


def head_orientation(messages: DataFrame) -> DataFrame:
    """The last yaw, pitch and roll of each source of a table (ts, seq, source, axis, value); a missing axis carries over."""
    at = F.struct("ts", "seq")
    axes = [F.max_by(F.when(F.col("axis") == a, F.col("value")), F.when(F.col("axis") == a, at)).alias(a) for a in ("yaw", "pitch", "roll")]
    return messages.groupBy("source").agg(*axes)


def silence_sessions(levels: DataFrame, threshold_db: float = -60.0, gap: str = "300 milliseconds", watermark: str = "3 seconds") -> DataFrame:
    """Sessions of frames (ts, program_id, level_db) above the threshold; what lies between them is silence."""
    w = F.session_window("ts", gap).alias("w")
    out = levels.where(F.col("level_db") > threshold_db).withWatermark("ts", watermark).groupBy(w, "program_id").agg(F.count("*").alias("frames"))
    return out.select("program_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames")


def live_loudness(powers: DataFrame, length: str = "400 milliseconds", bins: int = 4, every: str = "100 milliseconds", watermark: str = "3 seconds") -> DataFrame:
    """(window_start, program_id, loudness, full_window) over sliding windows of weighted power bins (ts, program_id, power).

    Windows of 400 ms are momentary, of 3 seconds (30 bins) short-term loudness; `full_window` where all bins are there."""
    w = F.window("ts", length, every).alias("w")
    out = powers.withWatermark("ts", watermark).groupBy(w, "program_id").agg(lufs(F.avg("power")).alias("loudness"), F.count("power").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "program_id", "loudness", (F.col("n") >= bins).alias("full_window"))
