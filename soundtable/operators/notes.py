"""MIDI notes: rows (take_id, start, length, pitch, velocity, channel) in beats, ordered within a take by given columns."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundtable.functions.scalars import clamp, groove_slot, half_away, rounded


def select_notes(notes: DataFrame, pitch_min: int = 0, pitch_max: int = 127, channel: int | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """notes with `selected`: pitch within closed bounds, start within a half-open range."""
    found = F.col("pitch").between(pitch_min, pitch_max)
    for limit, test in ((channel, lambda v: F.col("channel") == v), (start, lambda v: F.col("start") >= v), (end, lambda v: F.col("start") < v)):
        found = found if limit is None else found & test(limit)
    return notes.withColumn("selected", found)


def extract_groove(notes: DataFrame, grid: float = 0.25, steps: int = 2, reference: float = 96.0) -> DataFrame:
    """(take_id, slot, time_offset, vel_scale) for each slot; empty slots 0 and 1."""
    slot = groove_slot(F.col("start"), grid, steps)
    found = notes.groupBy("take_id", slot.alias("slot")).agg(F.avg(F.col("start") - half_away(F.col("start") / grid) * grid).alias("o"), F.avg(F.col("velocity") / reference).alias("v"))
    slots = notes.select("take_id").distinct().select("take_id", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("slot"))
    return slots.join(found, ["take_id", "slot"], "left").select("take_id", "slot", F.coalesce("o", F.lit(0.0)).alias("time_offset"), F.coalesce("v", F.lit(1.0)).alias("vel_scale"))


def apply_groove(notes: DataFrame, template: DataFrame, grid: float = 0.25, steps: int = 2, strength: float = 1.0) -> DataFrame:
    """notes moved and scaled by a (take_id, slot, time_offset, vel_scale) template."""
    s = min(1.0, max(0.0, strength))
    wide = notes.withColumn("slot", groove_slot(F.col("start"), grid, steps)).join(template, ["take_id", "slot"], "left")
    moved = F.col("start") + s * F.coalesce("time_offset", F.lit(0.0))
    # Rounded to nine places first, so that the order in which a mean was summed decides no half.
    louder = clamp(half_away(rounded(F.col("velocity") * (1 + s * (F.coalesce("vel_scale", F.lit(1.0)) - 1)), 9)), 1, 127).cast("int")
    return wide.withColumns({"start": moved, "velocity": louder}).select(*notes.columns)


def legato(notes: DataFrame, order: list[str], gap: float = 0.0, least: float = 0.03125) -> DataFrame:
    """Each note reaches to the next start less a gap; the last one of a take keeps its length."""
    ahead = F.lead("start").over(W.partitionBy("take_id").orderBy(*order))
    return notes.withColumn("length", F.when(ahead.isNull(), F.col("length")).otherwise(F.greatest(ahead - F.col("start") - gap, F.lit(least))))


def ordered(df: DataFrame, parent: str, order: list[str], out: str = "idx") -> DataFrame:
    """df with the row's index within its parent; never a global sort."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(parent).orderBy(*order)) - 1)


def clear_range(points: DataFrame, start: float, end: float, time: str = "time") -> DataFrame:
    """Without the points in [start, end)."""
    if end < start:
        raise ValueError("end before start")
    return points.where(~((F.col(time) >= start) & (F.col(time) < end)))


def envelope_window(points: DataFrame, keys: list[str], start: float | None = None, end: float | None = None) -> DataFrame:
    """Points in the closed range, with the unfiltered count of their envelope."""
    counted = points.withColumn("point_count", F.count("*").over(W.partitionBy(*keys)))
    for bound in ([F.col("time") >= start] if start is not None else []) + ([F.col("time") <= end] if end is not None else []):
        counted = counted.where(bound)
    return counted


def tempo_positions(tempo: DataFrame, key: str) -> DataFrame:
    """Markers (time, bpm) with `qn`, the beats before each, and the next marker's time; tempo is constant between markers."""
    w = W.partitionBy(key).orderBy("time")
    step = (F.lead("time").over(w) - F.col("time")) * F.col("bpm") / 60
    laid = tempo.withColumns({"until": F.lead("time").over(w), "step": step})
    return laid.withColumn("qn", F.coalesce(F.sum("step").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).drop("step")


def _through_map(df: DataFrame, laid: DataFrame, key: str, at: str, out: str, value) -> DataFrame:
    """df with `out`: value(place, marker) by the last marker (struct of laid) at or before each row's place, null marker where
    there is none. Rows and markers meet in one ordered window of a key, so a map of any length costs a sort."""
    rows = df.select("*", F.col(key).alias("__map"), F.col(at).cast("double").alias("__at"), F.lit(None).cast(laid.schema["marker"].dataType).alias("__marker"), F.lit(1).alias("__row"))
    marks = laid.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields], F.col(key).alias("__map"), F.col("place").alias("__at"), F.col("marker").alias("__marker"), F.lit(0).alias("__row"))
    w = W.partitionBy("__map").orderBy("__at", "__row").rowsBetween(W.unboundedPreceding, 0)
    met = rows.union(marks).withColumn("__marker", F.last("__marker", ignorenulls=True).over(w)).where("__row = 1")
    return met.withColumn(out, value(F.col("__at"), F.col("__marker"))).drop("__map", "__at", "__marker", "__row")


def time_to_qn(df: DataFrame, tempo: DataFrame, key: str, time: str) -> DataFrame:
    """df with `qn` through the tempo map (our definition); 120 bpm from 0 where a key has no marker before. Markers have their
    place in `time`, whatever else they have; markers without a time or tempo are none, a null time gives null."""
    laid = tempo_positions(tempo.where("time IS NOT NULL AND bpm IS NOT NULL").select(key, "time", "bpm"), key).select(key, F.col("time").alias("place"), F.struct("time", "bpm", "qn").alias("marker"))
    return _through_map(df, laid, key, time, "qn", lambda at, m: F.coalesce(m["qn"] + (at - m["time"]) * m["bpm"] / 60, at * 2.0))


def qn_to_time(df: DataFrame, tempo: DataFrame, key: str, qn: str) -> DataFrame:
    """df with `time`, the way back from time_to_qn: beats from a map's first marker on through its segments, those before it (and
    where a key has no map) at 120 bpm from 0."""
    laid = tempo_positions(tempo.where("time IS NOT NULL AND bpm IS NOT NULL").select(key, "time", "bpm"), key).select(key, F.col("qn").alias("place"), F.struct("time", "bpm", "qn").alias("marker"))
    return _through_map(df, laid, key, qn, "time", lambda at, m: F.coalesce(m["time"] + (at - m["qn"]) * 60 / m["bpm"], at * 0.5))


@lru_cache(maxsize=8)
def _draws(seed: int, pairs: int) -> np.ndarray:
    """The first pairs of numbers in [-1, 1) of the xorshift64* generator."""
    # State of seed 0, shifts, multiplier.
    state, multiplier, mask = seed or 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D, (1 << 64) - 1
    out = np.empty(2 * pairs)
    for i in range(2 * pairs):
        state ^= state >> 12
        state = (state ^ state << 25) & mask
        state ^= state >> 27
        out[i] = (state * multiplier & mask) >> 11
    return (out / 2.0**52 - 1).reshape(pairs, 2)


def humanize(notes: DataFrame, order: list[str], timing: float = 0.02, velocity: int = 8, seed: int = 1) -> DataFrame:
    """notes whose starts (not below 0) and velocities are nudged; lengths stay.

    The k-th note of every take gets the k-th pair of one generator's numbers, so a row needs its place in the take
    only, and no take is gathered in Python.
    """

    @F.pandas_udf("timing double, velocity double")
    def draw(place: pd.Series) -> pd.DataFrame:
        # Sizes of powers of two, so that a worker makes few tables.
        table = _draws(seed, 1 << int(place.max()).bit_length())
        return pd.DataFrame(table[place.to_numpy()], columns=["timing", "velocity"])

    place = F.row_number().over(W.partitionBy("take_id").orderBy(*order)) - 1
    wide = notes.withColumn("__place", place).withColumn("__draw", draw("__place"))
    moved = F.greatest(F.col("start") + F.col("__draw.timing") * timing, F.lit(0.0))
    louder = clamp(F.col("velocity") + half_away(F.col("__draw.velocity") * velocity), 1, 127).cast("int")
    return wide.withColumns({"start": moved, "velocity": louder}).select(*notes.columns)
