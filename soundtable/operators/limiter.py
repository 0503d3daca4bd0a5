"""A look-ahead limiter over sample chunks of any length, run chunk by chunk in parallel.

The gain envelope takes a step g -> min(d, r g + 1 - r) for each frame, the smoothing s -> e + c (s - e). Steps of either
kind compose to one of their kind, so what a chunk does to the state that comes in is a few numbers. Those of a stream are
composed in order by a window over its chunks; then each chunk is run once more from the state at its beginning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Decibels of a doubling, head room in dB below the ceiling, longest and shortest smoothing in seconds, its
#: share of the look-ahead, frames of history of the peak estimate, and places between two frames where it looks.
DOUBLING, HEADROOM, SMOOTH, SMOOTH_LEAST, SMOOTH_SHARE, HISTORY, BETWEEN = 6.020599913, 0.2, 0.0002, 0.00002, 0.3, 3, 8
#: Frames of delay at most.
MAX_DELAY = 8191


class Setting:
    """Numbers that a rate and the limiter's parameters make."""

    def __init__(self, rate: float, ceiling_db: float = -1.0, release_ms: float = 100.0, lookahead_ms: float = 1.5, lfe: int = 4, linked: bool = True):
        self.ceiling = 2 ** ((ceiling_db - HEADROOM) / DOUBLING)
        self.delay = int(min(max(np.floor(lookahead_ms * 0.001 * rate + 0.5), 1), MAX_DELAY))
        self.release = float(np.exp(-1.0 / (max(release_ms, 1.0) * 0.001 * rate)))
        self.smooth = float(np.exp(-1.0 / (max(min(SMOOTH, lookahead_ms * 0.001 * SMOOTH_SHARE), SMOOTH_LEAST) * rate)))
        self.lfe, self.linked = lfe - 1, linked


def peaks(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Greatest absolute value between the second and the first frame before each of x (frames x channels) on a cubic through
    four frames; `before` are the HISTORY frames before x."""
    whole = np.concatenate([before, x])
    p0, p1, p2, p3 = (whole[i : i + len(x)] for i in range(4))
    a, b, d = (3 * (p1 - p2) + p3 - p0) / 2, p0 - 2.5 * p1 + 2 * p2 - p3 / 2, (p2 - p0) / 2
    out = np.maximum(np.abs(p1), np.abs(p2))
    for k in range(1, BETWEEN):
        t = k / BETWEEN
        out = np.maximum(out, np.abs(((a * t + b) * t + d) * t + p1))
    return out


def desired(x: np.ndarray, before: np.ndarray, now: Setting) -> np.ndarray:
    """The gain that each frame asks of each channel; linked channels ask alike, the LFE asks for nothing."""
    peak = peaks(x, before)
    mains = [c for c in range(x.shape[1]) if c != now.lfe]
    if now.linked and mains:
        peak[:, mains] = peak[:, mains].max(axis=1, keepdims=True)
    peak[:, [c for c in range(x.shape[1]) if c == now.lfe]] = 0.0
    return np.where(peak > now.ceiling, now.ceiling / np.maximum(peak, 1e-300), 1.0)


def envelope(want: np.ndarray, start: np.ndarray, now: Setting) -> np.ndarray:
    """The envelope after each frame, from the one before the first.

    What it lacks to 1 is the greatest of what frames up to now asked for, each fallen by the release since."""
    out, decay = np.empty_like(want), np.log(now.release)
    lack, step = np.log(np.maximum(1.0 - np.minimum(want, 1.0), 1e-300)), max(1, int(min(4096, 500 / -decay)))
    before = np.log(np.maximum(1.0 - start, 1e-300))
    for first in range(0, len(want), step):
        part = lack[first : first + step]
        fall = decay * np.arange(1, len(part) + 1)[:, None]
        part = np.maximum.accumulate(np.maximum(part - fall, before), axis=0) + fall
        out[first : first + step], before = 1.0 - np.exp(part), part[-1]
    return out


def smoothed(env: np.ndarray, start: np.ndarray, now: Setting) -> np.ndarray:
    """env after a one-pole filter, from its value before the first frame; all terms are positive, so sums stay exact."""
    out, c, s = np.empty_like(env), now.smooth, start
    step = int(min(4096, 500 / max(-np.log(c), 1e-9))) if c > 0 else 0
    if step < 1:
        return env.copy()
    for first in range(0, len(env), step):
        part = env[first : first + step]
        power = c ** np.arange(1, len(part) + 1)[:, None]
        out[first : first + step] = power * (s + np.cumsum((1 - c) * part / power, axis=0))
        s = out[first + len(part) - 1]
    return out


def _with_halo(chunks: DataFrame, keys: list[str], frames: int) -> DataFrame:
    """chunks with `before`, the samples of the `frames` frames before each (fewer at a stream's start).

    A chunk is needed if the one after it begins fewer than `frames` frames before: so each row first takes the end of the
    one before it, then what the rows of that range have taken."""
    w, length = W.partitionBy(*keys).orderBy("frame0"), frames * F.col("channels")
    end = F.slice("samples", F.greatest(F.lit(1), F.size("samples") - length + 1), length)
    taken = chunks.withColumn("__before", F.lag(end).over(w))
    joined = F.flatten(F.collect_list("__before").over(w.rangeBetween(1 - frames, 0)))
    return taken.withColumn("before", F.slice(joined, F.greatest(F.lit(1), F.size(joined) - length + 1), length)).drop("__before")


def limit_corpus(chunks: DataFrame, keys: list[str], rate: float, **parameters) -> DataFrame:
    """(keys, frame0, channels, samples, gains): chunks (keys, frame0 long, channels int, samples array of doubles, frame by
    frame) behind the limiter, and the gain of each sample. `parameters`: those of Setting.

    The LFE is only delayed. Chunks have any length, follow one another without gaps and begin at frame 0; where a stream
    is cut makes no difference. Null and NaN samples count as silence. An empty table gives an empty result.
    """
    now = Setting(rate, **parameters)
    names = [*keys, "frame0", "channels"]
    chunks = chunks.select(*names, F.transform("samples", lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))).alias("samples")).where(F.size("samples") > 0)
    halo = _with_halo(chunks, keys, now.delay + HISTORY)
    fields = [chunks.schema[n] for n in names]
    doubles = T.ArrayType(T.DoubleType())

    def each(frame: pd.DataFrame) -> Iterator[tuple]:
        """The row's key columns with its samples, those before it and what its frames ask for."""
        for row in frame.itertuples(index=False):
            n = int(row.channels)
            x, past = (np.asarray(v, float).reshape(-1, n) for v in (row.samples, row.before))
            past = np.concatenate([np.zeros((now.delay + HISTORY - len(past), n)), past])
            yield row, x, past, desired(x, past[-HISTORY:], now)

    def asked(frames):
        for frame in frames:
            yield pd.DataFrame([(*row[: len(names)], len(x), envelope(want, np.full(x.shape[1], 1.0), now)[-1]) for row, x, _, want in each(frame)], columns=[*names, "frames", "low"])

    def settled(frames):
        for frame in frames:
            yield pd.DataFrame([(*row[: len(names)], len(x), smoothed(envelope(want, np.asarray(row.envelope), now), np.zeros(x.shape[1]), now)[-1]) for row, x, _, want in each(frame)], columns=[*names, "frames", "last"])

    def limited(frames):
        for frame in frames:
            out = []
            for row, x, past, want in each(frame):
                gain = smoothed(envelope(want, np.asarray(row.envelope), now), np.asarray(row.smooth), now)
                if 0 <= now.lfe < x.shape[1]:
                    gain[:, now.lfe] = 1.0
                late = np.concatenate([past, x])[HISTORY : HISTORY + len(x)]
                out.append((*row[: len(names)], (late * gain).ravel(), gain.ravel()))
            yield pd.DataFrame(out, columns=[*names, "samples", "gains"])

    schema = lambda *more: T.StructType([*fields, *more])
    frames_field = T.StructField("frames", T.LongType())
    lows = halo.mapInPandas(asked, schema(frames_field, T.StructField("low", doubles)))
    starts = _envelope_starts(lows, keys, float(np.log(now.release)))
    opened = halo.join(starts, [*keys, "frame0"])
    lasts = opened.mapInPandas(settled, schema(frames_field, T.StructField("last", doubles)))
    return opened.join(_smooth_starts(lasts, keys, now.smooth), [*keys, "frame0"]).select(*names, "samples", "before", "envelope", "smooth").mapInPandas(limited, schema(T.StructField("samples", doubles), T.StructField("gains", doubles)))


def _envelope_starts(lows: DataFrame, keys: list[str], decay: float) -> DataFrame:
    """(keys, frame0, envelope): each channel's envelope before a chunk, the greatest lack of the chunks before, fallen since."""
    each = lows.select(*keys, "frame0", (F.col("frame0") + F.col("frames")).alias("end"), F.posexplode("low").alias("c", "low"))
    lack = F.when(F.col("low") < 1, F.log(1 - F.col("low")) - F.col("end") * decay)
    w = W.partitionBy(*keys, "c").orderBy("frame0").rowsBetween(W.unboundedPreceding, -1)
    before = 1 - F.coalesce(F.exp(F.max(lack).over(w) + F.col("frame0") * decay), F.lit(0.0))
    found = each.select(*keys, "frame0", F.struct("c", before.alias("v")).alias("one"))
    return found.groupBy(*keys, "frame0").agg(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["v"]).alias("envelope"))


def _smooth_starts(lasts: DataFrame, keys: list[str], c: float) -> DataFrame:
    """(keys, frame0, smooth): each channel's smoothed gain before a chunk, folded from 1 over the chunks of the time after
    which less than 1e-18 of it is left."""
    reach = int(np.ceil(42 / max(-np.log(max(c, 1e-300)), 1e-9)))
    w = W.partitionBy(*keys).orderBy("frame0")
    before = lasts.withColumn("__last", F.lag(F.struct("frames", "last")).over(w))
    listed = F.collect_list("__last").over(w.rangeBetween(-reach, 0))
    ones = F.array_repeat(F.lit(1.0), F.col("channels"))
    fold = F.aggregate(listed, ones, lambda s, x: F.zip_with(s, x["last"], lambda a, b: a * F.pow(F.lit(c), x["frames"]) + b))
    return before.select(*keys, "frame0", fold.alias("smooth"))


def gain_reduction(limited: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, channel, gain) of limit_corpus's result, a row for each sample."""
    each = limited.select(*keys, "frame0", "channels", F.posexplode("gains").alias("at", "gain"))
    return each.select(*keys, (F.col("frame0") + F.floor(F.col("at") / F.col("channels"))).alias("frame"), (F.col("at") % F.col("channels")).alias("channel"), "gain")
