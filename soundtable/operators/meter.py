"""Sample metering over rows (program_id, channel, frame, x), or over binned power (program_id, bin, power)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundtable.functions.scalars import clamp, lin_to_db, lufs, pow_to_db

#: Spec, aliases, loudness target, tolerance, mono target, short-term limit, true-peak limit.
SPECS = [
    ("atmos-music", [], -18.0, 1.0, None, None, -1.0),
    ("streaming-stereo", [], -14.0, 1.0, None, None, -1.0),
    ("apple-music-stereo", [], -16.0, 1.0, None, None, -1.0),
    ("ebu-r128", ["broadcast-r128"], -23.0, 0.5, None, None, -1.0),
    ("ebu-r128-s1", [], -23.0, 0.5, None, -18.0, -1.0),
    ("atsc-a85", ["calm-act"], -24.0, 2.0, None, None, -2.0),
    ("podcast", [], -16.0, 1.0, -19.0, None, -1.0),
    ("cinema-theatrical", ["theatrical"], None, None, None, None, -3.0),
]


def chunks_to_samples(chunks: DataFrame) -> DataFrame:
    """(program_id, channel, frame, x) of audio chunks; samples become doubles once."""
    return chunks.select("program_id", "channel", "frame0", F.posexplode("samples").alias("i", "s")).select("program_id", "channel", (F.col("frame0") + F.col("i")).alias("frame"), F.col("s").cast("double").alias("x"))


def channel_metrics(samples: DataFrame, keys: list[str]) -> DataFrame:
    x = F.col("x")
    sums = samples.groupBy(*keys).agg((F.sum(x * x) / F.count("x")).alias("p"), F.max(F.abs(x)).alias("m"))
    return sums.select(*keys, pow_to_db(F.col("p")).alias("rms_db"), lin_to_db(F.col("m")).alias("peak_db"))


def channel_correlation(samples: DataFrame, keys: list[str], a: int, b: int) -> DataFrame:
    """Pearson correlation of two channels, 0 where one is constant, with the band it falls in."""
    left = samples.where(F.col("channel") == a).select(*keys, "frame", F.col("x").alias("u"))
    right = samples.where(F.col("channel") == b).select(*keys, "frame", F.col("x").alias("v"))
    u, v = F.col("u"), F.col("v")
    s = left.join(right, [*keys, "frame"]).groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum(u).alias("su"), F.sum(v).alias("sv"), F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"))
    spread = F.sqrt(F.greatest(F.expr("(uu - su * su / n) * (vv - sv * sv / n)"), F.lit(0.0)))
    s = s.withColumn("spread", spread).withColumn("corr", F.when(F.col("spread") < 1e-20, 0.0).otherwise(clamp(F.expr("try_divide(uv - su * sv / n, spread)"), -1.0, 1.0)))
    return s.select(*keys, "n", "corr", F.when(F.col("corr") < -0.2, "out_of_phase").when(F.col("corr") < 0.4, "wide").otherwise("ok").alias("band"))


def dc_clip(samples: DataFrame, keys: list[str], threshold: float = 0.999) -> DataFrame:
    return samples.groupBy(*keys).agg(F.avg("x").alias("dc"), F.count_if(F.abs("x") >= threshold).alias("clipped"))


def waveform_overview(samples: DataFrame, keys: list[str], buckets: int = 512) -> DataFrame:
    """Least and greatest sample of equal frame ranges; at most one bucket for each frame."""
    frames = samples.groupBy(*keys).agg(F.count("*").alias("n"))
    wide = samples.join(frames, keys).withColumn("b", F.least(F.col("n"), F.lit(buckets)))
    bucket = F.expr("((frame + 1) * b - 1) div n")
    return wide.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def power_bins(samples: DataFrame, keys: list[str], frames_per_bin: int, weight: Column | None = None) -> DataFrame:
    """(keys, bin, power, frames): mean weighted square, summed over channels; a partial aggregation before anything is
    shuffled. The last bin of a program may have fewer than frames_per_bin `frames`; its mean is over those."""
    square = F.col("x") * F.col("x") * (F.lit(1.0) if weight is None else weight)
    frames = F.max(F.col("frame") % frames_per_bin) + 1
    binned = samples.groupBy(*keys, F.floor(F.col("frame") / frames_per_bin).alias("bin")).agg((F.sum(square) / frames).alias("power"), frames.alias("frames"))
    return binned.withColumn("whole", F.col("frames") == frames_per_bin)


def _counted(bins: DataFrame) -> DataFrame:
    """Bins of another origin than power_bins are whole and weigh alike. A bin whose power is null or NaN is silent: it counts as 0."""
    known = bins if "whole" in bins.columns else bins.withColumns({"frames": F.lit(1), "whole": F.lit(True)})
    return known.withColumn("power", F.coalesce(F.nanvl(F.col("power").cast("double"), F.lit(0.0)), F.lit(0.0)))


def blocks(bins: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Mean power of each full run of `length` whole bins, at its last bin."""
    bins = _counted(bins).where("whole")
    w = W.partitionBy(*keys).orderBy("bin").rowsBetween(1 - length, 0)
    return bins.select(*keys, "bin", (F.sum("power").over(w) / length).alias("p"), F.count("*").over(w).alias("n")).where(F.col("n") == length).drop("n")


def gated_loudness(bins: DataFrame, keys: list[str], length: int = 4) -> DataFrame:
    """BS.1770 gates: blocks above -70, then above the mean of those less 10 LU. A program shorter than a block is not
    gated; one whose blocks all fall below reads the floor. Null and NaN powers are silence, in blocks and means alike.

    Bins of a program are exchanged once: blocks, the first gate and the sums come from windows and groups of its rows."""
    own = W.partitionBy(*keys)
    row = own.orderBy(F.desc("whole"), "bin").rowsBetween(1 - length, 0)  # partial bins, if any, behind the whole ones
    full = F.col("whole") & (F.count("*").over(row) == length)
    block = _counted(bins).withColumn("__p", F.when(full, F.sum("power").over(row) / length))
    block = block.withColumn("__l", lufs(F.col("__p"))).withColumn("__mean1", F.avg(F.when(F.col("__l") > -70, F.col("__p"))).over(own))
    passed = (F.col("__l") > -70) & (F.col("__l") > lufs(F.col("__mean1")) - 10)
    out = block.groupBy(*keys).agg(
        (F.sum(F.col("power") * F.col("frames")) / F.sum("frames")).alias("all_power"),
        F.count("__p").alias("total_blocks"),
        F.avg(F.when(passed, F.col("__p"))).alias("mean2"),
        F.count_if(passed).alias("gated_blocks"),
    )
    total = F.col("total_blocks")
    integrated = F.when(total == 0, lufs(F.col("all_power"))).otherwise(lufs(F.coalesce("mean2", F.lit(0.0))))
    activity = F.when(total == 0, 0.0).otherwise(F.expr("try_divide(gated_blocks, total_blocks)"))
    return out.select(*keys, integrated.alias("integrated"), lufs(F.col("all_power")).alias("ungated"), "total_blocks", "gated_blocks", activity.alias("activity"))


def loudness_timeline(bins: DataFrame, keys: list[str], momentary: int = 4, short_term: int = 30) -> DataFrame:
    """Momentary and short-term loudness at each bin from the first full momentary block; the short-term window grows until it is full."""
    bins = _counted(bins).where("whole")
    order = W.partitionBy(*keys).orderBy("bin")
    m, s = order.rowsBetween(1 - momentary, 0), order.rowsBetween(1 - short_term, 0)
    wide = bins.select(*keys, "bin", F.avg("power").over(m).alias("pm"), F.count("*").over(m).alias("nm"), F.avg("power").over(s).alias("ps"), F.count("*").over(s).alias("ns"))
    return wide.where(F.col("nm") == momentary).select(*keys, "bin", lufs(F.col("pm")).alias("momentary"), lufs(F.col("ps")).alias("short_term"), (F.col("ns") == short_term).alias("full"))


def loudness_range(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """Tech 3342: full short-term values (all, where none is full) above -70 and above their mean power less 20 LU; 95th less 10th
    percentile. Both gates are windows of a program's rows, which are exchanged once."""
    own = W.partitionBy(*keys)
    counts = (F.col("full") | ~F.max("full").over(own)) & (F.col("short_term") > -70)
    pool = timeline.withColumn("__counts", counts)
    power = F.when(F.col("__counts"), F.pow(F.lit(10.0), (F.col("short_term") + 0.691) / 10))
    gated = pool.withColumn("__gate", lufs(F.avg(power).over(own)) - 20)
    kept = F.when(F.col("__counts") & (F.col("short_term") > F.col("__gate")), F.col("short_term"))
    q = gated.groupBy(*keys).agg(F.percentile(kept, F.array(F.lit(0.1), F.lit(0.95))).alias("__q"))
    return q.select(*keys, F.coalesce(F.get("__q", F.lit(1)) - F.get("__q", F.lit(0)), F.lit(0.0)).alias("lra"))


def detect_silence(bins: DataFrame, keys: list[str], threshold_db: float = -60.0, window: int = 1, least: int = 1) -> DataFrame:
    """Runs of at least `least` bins whose trailing mean power over `window` bins is below the threshold."""
    order = W.partitionBy(*keys).orderBy("bin")
    level = bins.select(*keys, "bin", (pow_to_db(F.avg("power").over(order.rowsBetween(1 - window, 0))) < threshold_db).alias("quiet"))
    run = F.col("bin") - F.row_number().over(W.partitionBy(*keys, "quiet").orderBy("bin"))
    runs = level.withColumn("run", run).where("quiet").groupBy(*keys, "run").agg(F.min("bin").alias("start"), (F.max("bin") + 1).alias("end"))
    ends = bins.groupBy(*keys).agg(F.max("bin").alias("last"))
    kind = F.when((F.col("start") == 0) & (F.col("end") == F.col("last") + 1), "all").when(F.col("start") == 0, "leading").when(F.col("end") == F.col("last") + 1, "trailing").otherwise("internal")
    return runs.where(F.col("end") - F.col("start") >= least).join(ends, keys).select(*keys, "start", "end", kind.alias("kind"))


def stem_loudness(bins: DataFrame, program: str, stem: str) -> DataFrame:
    """Gated loudness of each stem, its distance from the loudest, and its share of the program's ungated power."""
    loud = gated_loudness(bins, [program, stem])
    power = F.pow(F.lit(10.0), (F.col("ungated") + 0.691) / 10)
    w = W.partitionBy(program)
    return loud.select(program, stem, "integrated", (F.col("integrated") - F.max("integrated").over(w)).alias("delta"), (power / F.sum(power).over(w)).alias("energy_share"))


def downmix(samples: DataFrame, keys: list[str], coefficients: DataFrame) -> DataFrame:
    """(keys, frame, lo, ro): each channel times its (channel, left, right) coefficients, a small table."""
    wide = samples.join(F.broadcast(coefficients), "channel")
    return wide.groupBy(*keys, "frame").agg(F.sum(F.col("x") * F.col("left")).alias("lo"), F.sum(F.col("x") * F.col("right")).alias("ro"))


def downmix_check(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Level of the mono sum against the stereo fold: over -3.5 ok, over -6.5 wide, else cancellation."""
    mono = (F.col("lo") + F.col("ro")) * 0.5
    s = folded.groupBy(*keys).agg(F.avg(F.col("lo") * F.col("lo") + F.col("ro") * F.col("ro")).alias("stereo"), F.avg(mono * mono).alias("mono"))
    loss = pow_to_db(F.col("mono")) - pow_to_db(F.col("stereo"))
    return s.select(*keys, pow_to_db(F.col("stereo")).alias("stereo_db"), pow_to_db(F.col("mono")).alias("mono_db"), F.when(loss > -3.5, "ok").when(loss > -6.5, "wide").otherwise("cancellation").alias("verdict"))


def mid_side(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Level of side against mid of (lo, ro), each with 1/sqrt 2."""
    mid, side = (F.col("lo") + F.col("ro")) * 0.5**0.5, (F.col("lo") - F.col("ro")) * 0.5**0.5
    s = pairs.groupBy(*keys).agg(F.avg(mid * mid).alias("m"), F.avg(side * side).alias("s"))
    return s.select(*keys, pow_to_db(F.col("m")).alias("mid_db"), pow_to_db(F.col("s")).alias("side_db"), (pow_to_db(F.col("s")) - pow_to_db(F.col("m"))).alias("ratio_db"))


def active_fraction(bins: DataFrame, keys: list[str], threshold_db: float = -60.0) -> DataFrame:
    """Share of the whole windows whose power is above the threshold; 0 for a program shorter than one."""
    above = (pow_to_db(F.col("power")) > threshold_db).cast("double")
    return _counted(bins).groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("whole"), above)), F.lit(0.0)).alias("active"))


def spec_table(spark) -> DataFrame:
    schema = "spec string, aliases array<string>, target double, tol double, target_mono double, short_term_max double, true_peak_max double"
    named = spark.createDataFrame(SPECS, schema)
    return named.select("*", F.explode(F.concat(F.array("spec"), "aliases")).alias("asked"))


def check_deliverable(measures: DataFrame, spec: str, eps: float = 1e-6, tol: float | None = None) -> DataFrame:
    """measures (channels, lufs, true_peak, short_term, null where unknown) with a verdict for each gate and over all; null where nothing gates.

    A spec goes by its name or an alias, in any case; an unknown one is an error. `tol` takes the place of its tolerance.
    """
    spec = spec.strip().lower()
    if spec not in {name for row in SPECS for name in (row[0], *row[1])}:
        raise ValueError(f"no deliverable spec has the name {spec!r}")
    found = F.broadcast(spec_table(measures.sparkSession).where(F.col("asked") == spec).drop("asked", "aliases"))
    wide = measures.crossJoin(found)  # one row
    target = F.when((F.col("channels") == 1) & F.col("target_mono").isNotNull(), F.col("target_mono")).otherwise(F.col("target"))
    gates = {
        "lufs_pass": F.abs(F.col("lufs") - target) <= (F.col("tol") if tol is None else F.lit(tol)) + eps,
        "short_term_pass": F.col("short_term") <= F.col("short_term_max") + eps,
        "true_peak_pass": F.col("true_peak") <= F.col("true_peak_max") + eps,
    }
    wide = wide.withColumns({"delta": F.col("lufs") - target} | gates)
    known = [F.coalesce(g, F.lit(True)) for g in map(F.col, gates)]
    nothing = F.col("lufs_pass").isNull() & F.col("short_term_pass").isNull() & F.col("true_peak_pass").isNull()
    return wide.select(*measures.columns, "delta", *gates, F.when(~nothing, known[0] & known[1] & known[2]).alias("pass"))


def check_per_bed(checked: DataFrame, program: str, bed: str) -> DataFrame:
    """Beds of check_deliverable rolled up: all pass, how many fail, the worst peak and the largest distance, each with its bed."""
    return checked.groupBy(program).agg(
        F.bool_and("pass").alias("pass"),
        F.count_if(~F.col("pass")).alias("failing"),
        F.max_by(bed, F.struct("true_peak", bed)).alias("worst_peak_bed"),
        F.max_by(bed, F.struct(F.abs("delta"), bed)).alias("worst_lufs_bed"),
        F.max("true_peak").alias("worst_peak"),
    )


def true_peak_taps(phases: int = 4, taps: int = 12) -> list[list[float]]:
    """A Hann-windowed sinc for each phase between two samples; tap t weighs the sample t + 1 - taps / 2 places on."""
    t = np.arange(taps)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * (t + 0.5) / taps)
    return [(np.sinc(t + 1 - taps // 2 - p / phases) * window).tolist() for p in range(1, phases)]


def true_peak(samples: DataFrame, keys: list[str], block: int = 1 << 16) -> DataFrame:
    """Peak in dB of the samples and of three points between each two; frames of a key are gapless, x not null.

    A long program is cut into blocks of frames, each with the few neighbours its filters need, so that no task sorts a
    whole one.
    """
    taps = true_peak_taps()
    before, after = len(taps[0]) // 2 - 1, len(taps[0]) // 2
    at = lambda shift: F.floor((F.col("frame") + shift) / block)
    spread = samples.select(*keys, "frame", "x", F.explode(F.array_distinct(F.array(at(-after), at(0), at(before)))).alias("__block"))
    w = W.partitionBy(*keys, "__block").orderBy("frame")
    near = [F.coalesce(F.lag("x", -shift).over(w), F.lit(0.0)) for shift in range(-before, after + 1)]
    wide = spread.select(*keys, "frame", "__block", "x", *[n.alias(f"__{i}") for i, n in enumerate(near)]).where(at(0) == F.col("__block"))
    between = [F.abs(sum((F.col(f"__{i}") * c for i, c in enumerate(row)), F.lit(0.0))) for row in taps]
    return wide.groupBy(*keys).agg(lin_to_db(F.max(F.greatest(F.abs("x"), *between))).alias("true_peak_db"))


def channel_report(samples: DataFrame, weighted: DataFrame, keys: list[str]) -> DataFrame:
    """channel_metrics with the true peak and, of the K-weighted samples, the level `k_level`: all that is said of a channel.

    Each part is one aggregation by the keys, so the joins meet rows that lie together already."""
    loud = weighted.groupBy(*keys).agg(lufs(F.avg(F.col("x") * F.col("x"))).alias("k_level"))
    return channel_metrics(samples, keys).join(true_peak(samples, keys), keys, "left").join(loud, keys, "left")


def stem_report(samples: DataFrame, program: str, stem: str, frames_per_bin: int = 1) -> DataFrame:
    """stem_loudness with each stem's sample peak and true peak."""
    keys = [program, stem]
    loud = stem_loudness(power_bins(samples, keys, frames_per_bin), program, stem)
    peaks = channel_metrics(samples, keys).select(*keys, "peak_db")
    return loud.join(peaks, keys, "left").join(true_peak(samples, keys), keys, "left")
