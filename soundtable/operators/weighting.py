"""K-weighting over sample chunks, and what compares the loudness of two stems."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundtable.operators.meter import gated_loudness

#: Fixed values of the BS.1770 filters: corner in Hz, quality, and for the shelf its gain in dB and the band's exponent.
SHELF = (1681.9744509555319, 0.7071752369554193, 3.99984385397, 0.4996667741545416)
HIGH_PASS = (38.13547087602444, 0.5003270373238773)
#: Loudness at or below which a stem counts as silent: the floor and one LU.
SILENT = -143.0


def _digital(analog: tuple[float, float, float], corner: float, rate: float) -> np.ndarray:
    """Coefficients in 1, 1/z, 1/z^2 of c0 + c1 s + c2 s^2 under the bilinear transform, s in units of the corner."""
    k = np.tan(np.pi * corner / rate)
    c0, c1, c2 = analog
    return c2 * np.array([1.0, -2.0, 1.0]) + c1 * k * np.array([1.0, 0.0, -1.0]) + c0 * k * k * np.array([1.0, 2.0, 1.0])


def sections(rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numerator, denominator) of the shelf and of the high-pass."""
    corner, q, gain, exponent = SHELF
    high = 10 ** (gain / 20)
    out = [((1.0, high**exponent / q, high), corner, q), ((0.0, 0.0, 1.0), *HIGH_PASS)]
    return [(_digital(top, f, rate), _digital((1.0, 1 / quality, 1.0), f, rate)) for top, f, quality in out]


@lru_cache(maxsize=4)
def impulse_response(rate: float, frames: int) -> np.ndarray:
    """What both filters make of a unit impulse; after a second it is below 1e-13."""
    x = np.zeros(frames)
    x[0] = 1.0
    for top, bottom in sections(rate):
        b, a = (top / bottom[0]).tolist(), (bottom / bottom[0]).tolist()
        y, before = np.zeros(frames), [0.0, 0.0, 0.0, 0.0]
        for i, now in enumerate(x.tolist()):
            value = b[0] * now + b[1] * before[0] + b[2] * before[1] - a[1] * before[2] - a[2] * before[3]
            before = [now, before[0], value, before[2]]
            y[i] = value
        x = y
    return x


def k_weight(chunks: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """(keys, frame0, samples): chunks (keys, frame0, samples array) after both filters, from silence at each stream's start.

    A chunk gets the second before it as a halo from its predecessor, so chunks are filtered in parallel. Chunks follow
    one another without gaps, and all but a stream's last have at least `rate` samples. Null samples count as zero.
    """
    w = W.partitionBy(*keys).orderBy("frame0")
    halo = F.coalesce(F.lag(F.slice("samples", -F.least(F.size("samples"), F.lit(rate)), F.least(F.size("samples"), F.lit(rate)))).over(w), F.array().cast("array<double>"))

    # Chunks go to Python a hundred at a time; an Arrow batch would hold ten thousand, whatever their length.
    @F.udf("array<double>", useArrow=False)
    def weighted(x, past):
        joined = np.nan_to_num(np.concatenate([np.asarray(past, float), np.asarray(x, float)]))
        response = impulse_response(float(rate), rate)[: len(joined)]
        size = 1 << (len(joined) + len(response) - 1).bit_length()
        full = np.fft.irfft(np.fft.rfft(joined, size) * np.fft.rfft(response, size), size)
        return full[len(past) : len(joined)].tolist()

    filled = chunks.where(F.size("samples") > 0).select(*keys, "frame0", F.col("samples").cast("array<double>").alias("samples"))
    return filled.withColumn("__before", halo).select(*keys, "frame0", weighted("samples", "__before").alias("samples"))


def chunk_samples(samples: DataFrame, keys: list[str], frames: int) -> DataFrame:
    """Chunks of (keys, frame, x) rows: `frames` consecutive ones each, in order."""
    each = samples.groupBy(*keys, (F.floor(F.col("frame") / frames) * frames).alias("frame0"))
    return each.agg(F.sort_array(F.collect_list(F.struct("frame", "x"))).alias("rows")).select(*keys, "frame0", F.col("rows.x").alias("samples"))


def dialog_loudness(dialog: DataFrame, program: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, program_lufs, dialog_lufs, activity, offset_lu): how far the program lies above its dialog stem; both are power bins.

    A silent or absent dialog, or a silent program, has no offset.
    """
    spoken = gated_loudness(dialog, keys).select(*keys, F.col("integrated").alias("dialog_lufs"), "activity")
    whole = gated_loudness(program, keys).select(*keys, F.col("integrated").alias("program_lufs"))
    both = (F.col("dialog_lufs") > SILENT) & (F.col("program_lufs") > SILENT)
    return whole.join(spoken, keys, "left").select(*keys, "program_lufs", "dialog_lufs", "activity", F.when(both, F.col("program_lufs") - F.col("dialog_lufs")).alias("offset_lu"))


def loudest(stems: DataFrame, program: str, order: str, level: str) -> DataFrame:
    """The first of the highest levels of each program, in order."""
    best = stems.groupBy(program).agg(F.max(F.struct(F.col(level), (-F.col(order)).alias("back"))).alias("top"))
    return best.select(program, (-F.col("top.back")).alias(order), F.col(f"top.{level}").alias(level))
