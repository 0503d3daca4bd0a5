"""Beds and objects: channel labels with loudness weights, objects against a bed, two-channel monitoring, read windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundtable.functions.scalars import clamp, half_away, pow_to_db
from soundtable.operators.meter import gated_loudness

FLOOR = -144.0

#: Channel labels by width, names of widths, labels that weigh 1.41.
LABELS = {
    1: ["M"],
    2: ["L", "R"],
    6: ["L", "R", "C", "LFE", "Ls", "Rs"],
    8: ["L", "R", "C", "LFE", "Lss", "Rss", "Lsr", "Rsr"],
    12: ["L", "R", "C", "LFE", "Lss", "Rss", "Lsr", "Rsr", "Ltf", "Rtf", "Ltr", "Rtr"],
    16: ["L", "R", "C", "LFE", "Lss", "Rss", "Lsr", "Rsr", "Lw", "Rw", "Ltf", "Rtf", "Ltr", "Rtr", "Ltm", "Rtm"],
}
NAMES = {1: "mono", 2: "stereo", 6: "5.1", 8: "7.1", 12: "7.1.4", 16: "9.1.6", 24: "22.2"}
WIDE = ["Ls", "Rs", "Lss", "Rss", "Lw", "Rw"]


def _by_width(width: Column, values: dict) -> Column:
    return F.coalesce(*[F.when(width == w, v) for w, v in values.items()])


def label_channels(rows: DataFrame, width: str = "width", channel: str = "channel") -> DataFrame:
    """rows with `layout`, `label`, `lfe` and the loudness weight `weight` of a channel (from 0) in a bed of that width.

    Other widths are "multichannel" with labels ch0, ch1 ...; a null width or channel has no label and weighs 1."""
    w, c = F.col(width), F.col(channel)
    known = _by_width(w, {n: F.get(F.array(*map(F.lit, names)), c) for n, names in LABELS.items()})
    lfe = F.coalesce(((w >= 6) & (c == 3)) | ((w == 24) & (c == 9)), F.lit(False))
    out = rows.withColumns({"layout": F.coalesce(_by_width(w, {n: F.lit(s) for n, s in NAMES.items()}), F.lit("multichannel")), "label": F.coalesce(known, F.concat(F.lit("ch"), c.cast("string"))), "lfe": lfe})
    return out.withColumn("weight", F.when(F.col("lfe"), 0.0).when(F.col("label").isin(*WIDE), 1.41).otherwise(1.0))


def object_loudness(bins: DataFrame, program: str, name: str, bed: DataFrame | None = None, positions: DataFrame | None = None) -> DataFrame:
    """Gated loudness of each object, its distance from the program's loudest and its share of all objects' ungated power.

    bed: bins (program, bin, power) of one bed a program; `bed_vs_objects` is its loudness less the loudest object's,
    null where either is silent or absent. positions: (program, object, ...) columns to carry along. Bins come weighted
    (`k_weight`, weights of `label_channels`) where loudness is meant."""
    loud = gated_loudness(bins, [program, name])
    w = W.partitionBy(program)
    power = F.when(F.col("ungated") > FLOOR + 1, F.pow(F.lit(10.0), (F.col("ungated") + 0.691) / 10)).otherwise(0.0)
    out = loud.withColumns({"power": power, "best": F.max("integrated").over(w)}).withColumn("all_power", F.sum("power").over(w))
    share = F.when(F.col("all_power") > 1e-30, F.col("power") / F.col("all_power")).otherwise(0.0)
    out = out.select(program, name, "integrated", "ungated", "activity", "best", share.alias("energy_share"), (F.col("integrated") - F.col("best")).alias("delta"))
    if bed is not None:
        level = gated_loudness(bed, [program]).select(program, F.col("integrated").alias("bed"))
        heard = (F.col("bed") > FLOOR + 1) & (F.col("best") > FLOOR)
        out = out.join(level, program, "left").withColumn("bed_vs_objects", F.when(heard, F.col("bed") - F.col("best"))).drop("bed")
    out = out.drop("best")
    return out if positions is None else out.join(positions, [program, name], "left")


def binaural_verdict(samples: DataFrame, keys: list[str], weighted: DataFrame | None = None) -> DataFrame:
    """(keys, balance, corr, side_to_mid, verdict) of channels 0 and 1, over the frames that have both.

    balance: left less right in dB, of `weighted` samples (see `k_weight`) if given. A program without such a frame is
    not_binaural, with nulls; so are mono and those whose width (its highest channel and one) is that of a labelled bed.
    Two sums of frames by program, no join of the channels."""
    samples, names, own_names = _set_apart(samples, keys, "channel", "frame", "x")
    if weighted is not None:
        weighted, _, _ = _set_apart(weighted, keys, "channel", "frame", "x")
    keys = names
    beds_or_mono = [n for n in NAMES if n != 2]

    def pairs(rows: DataFrame) -> DataFrame:
        two = rows.groupBy(*keys, "frame").agg((F.max("channel") + 1).alias("width"), F.max(F.when(F.col("channel") == 0, F.col("x"))).alias("u"), F.max(F.when(F.col("channel") == 1, F.col("x"))).alias("v"))
        return two.withColumns({"u": F.when(F.col("v").isNotNull(), F.col("u")), "v": F.when(F.col("u").isNotNull(), F.col("v"))})

    u, v = F.col("u"), F.col("v")
    s = pairs(samples).groupBy(*keys).agg(F.max("width").alias("width"), F.count("u").cast("double").alias("n"), F.sum(u).alias("su"), F.sum(v).alias("sv"), F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"), F.sum((u + v) * (u + v) / 2).alias("mm"), F.sum((u - v) * (u - v) / 2).alias("ss"))
    if weighted is None:
        s = s.withColumns({"lp": F.expr("try_divide(uu, n)"), "rp": F.expr("try_divide(vv, n)")})
    else:
        levels = pairs(weighted).groupBy(*keys).agg(F.avg(u * u).alias("lp"), F.avg(v * v).alias("rp"))
        s = s.join(levels, keys, "left")
    spread = F.expr("sqrt(greatest((uu - try_divide(su * su, n)) * (vv - try_divide(sv * sv, n)), 0D))")
    s = s.withColumn("spread", F.when(F.col("n") > 0, spread))
    corr = F.when(F.col("spread") < 1e-20, 0.0).otherwise(clamp(F.expr("try_divide(uv - su * sv / n, spread)"), -1.0, 1.0))
    s = s.withColumn("n", F.when(~F.coalesce(F.col("width").isin(*beds_or_mono), F.lit(False)), F.col("n")))
    corr = F.when(F.col("n") > 0, corr)
    s = s.select(*keys, F.when(F.col("n") > 0, pow_to_db(F.col("lp")) - pow_to_db(F.col("rp"))).alias("balance"), F.when(F.col("n") > 0, corr).alias("corr"), F.when(F.col("n") > 0, pow_to_db(F.expr("try_divide(ss, n)")) - pow_to_db(F.expr("try_divide(mm, n)"))).alias("side_to_mid"))
    verdict = F.when(F.col("corr").isNull(), "not_binaural").when(F.col("corr") < -0.2, "out_of_phase").when(F.col("side_to_mid") < -20, "near_mono").when(F.abs("balance") > 3, "lopsided").otherwise("healthy")
    return s.select(*own_names, "balance", "corr", "side_to_mid", verdict.alias("verdict"))


def window_clamp(requests: DataFrame, rate: float) -> DataFrame:
    """requests (start, duration, source_start, source_end; seconds) with `read_start`, `frames`, `clamped` and `error`.

    A duration of zero or less, or null, reads to the end. error: empty_source, empty_window, or null."""
    first, last = F.col("source_start"), F.col("source_end")
    whole = F.coalesce(F.col("duration") <= 0, F.lit(True))
    end = F.col("start") + F.col("duration")
    low = F.least(F.greatest(F.col("start"), first), last)
    high = F.when(whole, last).otherwise(F.least(F.greatest(end, first), last))
    frames = half_away((high - low) * max(rate, 1.0)).cast("long")
    error = F.when(F.coalesce(last <= first, F.lit(True)), "empty_source").when((high <= low) | (frames == 0), "empty_window")
    beyond = (F.col("start") < first - 1e-6) | (~whole & (end > last + 1e-6))
    fine = error.isNull()
    return requests.withColumns({"read_start": F.when(fine, low), "frames": F.when(fine, frames), "clamped": F.when(fine, beyond), "error": error})


def compose_target(az: Column, el: Column, x: Column, y: Column, z: Column, now_az: Column) -> tuple[Column, Column]:
    """Azimuth and elevation to write, in degrees; null: not asked for. Angles win over x (right), y (front), z (up);
    where one of x and y lacks, the present azimuth gives it."""
    across = F.coalesce(x, -F.sin(F.radians(now_az)))
    ahead = F.coalesce(y, F.cos(F.radians(now_az)))
    flat = F.when(x.isNotNull() | y.isNotNull(), F.degrees(F.atan2(-across, ahead)))
    return F.coalesce(az, flat), F.coalesce(el, F.degrees(F.asin(F.when(z.isNotNull(), clamp(z, -1.0, 1.0)))))


def panner_values(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Values from 0 to 1 of a cartesian panner, whose x runs from right to left."""
    return clamp((1 - x) / 2, 0.0, 1.0), clamp((y + 1) / 2, 0.0, 1.0), clamp((z + 1) / 2, 0.0, 1.0)


def place_at_distance(distance: Column, az: Column, el: Column) -> tuple[Column, Column, Column]:
    """Front, left and up of a place in the room."""
    a, e = F.radians(az), F.radians(el)
    return distance * F.cos(e) * F.cos(a), distance * F.cos(e) * F.sin(a), distance * F.sin(e)


def param_roles(params: DataFrame, keys: list[str], idx: str, name: str, source: int = 0) -> DataFrame:
    """(keys, azimuth, elevation, distance, x, y, z, skipped_quaternion): which parameter of a panner plays which role.

    Names that hold the source's number (from 1) come first; a source above 0 needs one. x, y and z are looked for only
    without an azimuth, and never among quaternion parameters. One aggregation; null names match nothing."""
    low = F.lower(F.col(name))
    numbered, quaternion = low.contains(str(source + 1)), low.contains("quat")
    usable = numbered if source else F.lit(True)

    def best(hit: Column) -> Column:
        return F.min(F.when(hit & usable, F.struct(F.when(numbered, 0).otherwise(1).alias("rank"), F.col(idx).alias("idx"))))

    letters = ("x", "y", "z")
    found = [best(low.contains(part)).alias(role) for role, part in (("azimuth", "azim"), ("elevation", "elev"), ("distance", "dist"))]
    found += [best(low.contains(c) & ~quaternion).alias(c) for c in letters]
    found += [F.min(F.when(low.contains(c) & ~quaternion & numbered, F.col(idx))).alias(f"stop_{c}") for c in letters]
    found += [F.min(F.when(low.contains(c) & quaternion, F.col(idx))).alias(f"quat_{c}") for c in letters]
    out = params.groupBy(*keys).agg(*found)
    plain = F.col("azimuth").isNull()
    skipped = [F.col(f"quat_{c}").isNotNull() & (F.col(f"stop_{c}").isNull() | (F.col(f"quat_{c}") < F.col(f"stop_{c}"))) for c in letters]
    return out.select(*keys, F.col("azimuth.idx").alias("azimuth"), F.col("elevation.idx").alias("elevation"), F.col("distance.idx").alias("distance"), *[F.when(plain, F.col(f"{c}.idx")).alias(c) for c in letters], (plain & (skipped[0] | skipped[1] | skipped[2])).alias("skipped_quaternion"))


def _set_apart(rows: DataFrame, keys: list[str], *columns: str) -> tuple[DataFrame, list[str], list[Column]]:
    """rows of the keys under names that no working column has, the names, and the keys under their own names again."""
    names = [f"__key{i}" for i in range(len(keys))]
    return rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *columns), names, [F.col(n).alias(k) for k, n in zip(keys, names)]


def tone_plan(slots: int, lfe: tuple[int, ...] = ()) -> list[tuple[int, float]]:
    """(slot, hz) of identity tones for up to 128 slots; fixed values: 313 Hz and steps of 139, 40 Hz for LFE."""
    return [(k, 40.0 if k in lfe else 313.0 + 139.0 * k) for k in range(min(slots, 128))]


def tone_samples(programs: DataFrame, key: str, plan: list[tuple[int, float]], rate: float, frames: int, level_db: float = -18.0) -> DataFrame:
    """(key, channel, frame, x): each program's identity tones, a sine from phase 0 on each slot of the plan. Made row by row."""
    table = F.array(*[F.struct(F.lit(slot).alias("channel"), F.lit(float(hz)).alias("hz")) for slot, hz in plan])
    # One file of keys may be one task's, and its rows grow by slots x frames; so few bytes would be dealt to few tasks again.
    spread = programs.select(key).repartition(programs.sparkSession.sparkContext.defaultParallelism, key)
    each = spread.select(key, F.inline(table)).select(key, "channel", "hz", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame"))
    return each.select(key, "channel", "frame", (10 ** (level_db / 20) * F.sin(F.col("frame") * F.col("hz") * (2 * math.pi / rate))).alias("x"))


def verify_routing(samples: DataFrame, keys: list[str], plan: list[tuple[int, float]], rate: float, margin_db: float = 40.0, silence_db: float = -80.0) -> DataFrame:
    """(keys, channel, rms_db, detected, margin_db, coverage, verdict, paired): which slot's tone each channel carries.

    plan: (slot, hz), slots from 0, 128 at most. One aggregation by channel holds all tones' sums; the channels of a
    program (as many as slots) then meet in a window. A program whose channels are not the plan's slots has the verdict
    `channels` on each row. Verdicts in order: silent, dropped (no tone explains the channel), identity or bleed,
    swapped, duplicated, dropped."""
    samples, keys, own_names = _set_apart(samples, keys, "channel", "frame", "x")
    turn = F.col("frame") * (2 * math.pi / rate)
    sums = [F.sum(F.col("x") * f(turn * hz)).alias(f"{part}{slot}") for slot, hz in plan for part, f in (("c", F.cos), ("s", F.sin))]
    out = samples.groupBy(*keys, "channel").agg(F.count("x").alias("n"), F.sum(F.col("x") * F.col("x")).alias("xx"), *sums)
    powers = F.array(*[F.col(f"c{s}") * F.col(f"c{s}") + F.col(f"s{s}") * F.col(f"s{s}") for s, _ in plan])
    out = out.select(*keys, "channel", "n", F.sqrt(F.expr("try_divide(xx, n)")).alias("rms"), powers.alias("p"))
    out = out.withColumn("rms_db", F.when(F.col("rms") > 1e-12, 20 * F.log10("rms")).otherwise(FLOOR))
    out = out.withColumn("raw", F.when(F.col("rms_db") > silence_db, F.array_position("p", F.array_max("p")).cast("int") - 1).otherwise(-1))
    others = F.transform("p", lambda q, i: F.when(i == F.col("channel"), 0.0).otherwise(q))
    out = out.withColumns({"own": F.coalesce(F.get("p", F.col("channel")), F.lit(0.0)), "other": F.array_max(others), "other_at": F.array_position(others, F.array_max(others)).cast("int") - 1})
    out = out.withColumn("margin_db", 10 * F.log10(F.when(F.col("own") > 0, F.col("own")).otherwise(1e-300) / F.when(F.col("other") > 0, F.col("other")).otherwise(1e-300)))
    out = out.withColumn("coverage", F.when(F.col("raw") >= 0, F.sqrt(2 * F.get("p", F.col("raw"))) / F.col("n") / F.col("rms")).otherwise(0.0))
    w = W.partitionBy(*keys)
    seen = F.array_sort(F.collect_list(F.struct("channel", "raw")).over(w))
    out = out.withColumn("map", F.transform(seen, lambda m: m["raw"])).withColumn("fits", (F.size(seen) == len(plan)) & (F.max("channel").over(w) == len(plan) - 1))
    twins = F.array_position(F.transform("map", lambda m, o: (o != F.col("channel")) & (m == F.col("raw"))), F.lit(True)).cast("int") - 1
    back = F.get("map", F.col("raw")) == F.col("channel")
    own, lost = F.col("raw") == F.col("channel"), F.col("coverage") < 0.1
    out = out.withColumn("twin", twins)
    verdict = F.when(~F.col("fits"), "channels").when(F.col("raw") < 0, "silent").when(lost, "dropped").when(own & (F.col("margin_db") >= margin_db), "identity").when(own, "bleed").when(back, "swapped").when(F.col("twin") >= 0, "duplicated").otherwise("dropped")
    out = out.withColumn("verdict", verdict)
    paired = F.when(F.col("verdict") == "bleed", F.when(F.col("other") > 0, F.col("other_at"))).when(F.col("verdict") == "swapped", F.col("raw")).when(F.col("verdict") == "duplicated", F.col("twin")).when((F.col("verdict") == "dropped") & ~lost, F.col("raw"))
    detected = F.when(F.col("fits") & (F.col("raw") >= 0) & ~lost, F.col("raw"))
    return out.select(*own_names, "channel", "rms_db", detected.alias("detected"), "margin_db", "coverage", "verdict", paired.alias("paired"))
