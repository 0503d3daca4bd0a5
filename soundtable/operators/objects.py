"""Object trajectories: rows (object_id, t, az, el, gain) and blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundtable.functions import harmonics
from soundtable.functions.scalars import clamp, direction


def with_direction(traj: DataFrame) -> DataFrame:
    x, y, z = direction(F.col("az"), F.col("el"))
    return traj.withColumns({"x": x, "y": y, "z": z})


def angular_travel(traj: DataFrame, order: list[str]) -> DataFrame:
    """Great-circle degrees between consecutive directions, summed; static under one degree."""
    w = W.partitionBy("object_id").orderBy(*order)
    d = with_direction(traj)
    dot = F.col("x") * F.lag("x").over(w) + F.col("y") * F.lag("y").over(w) + F.col("z") * F.lag("z").over(w)
    step = d.withColumn("step", F.degrees(F.acos(clamp(dot, -1.0, 1.0))))
    out = step.groupBy("object_id").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("travel"), F.max("el").alias("max_el"), F.min("el").alias("min_el"))
    return out.withColumn("static", F.col("travel") < 1.0)


def sample_weights(traj: DataFrame, order: list[str]) -> DataFrame:
    """`weight`: time to the next sample, the last one's as before it, a lone one's 1; equal where all are zero."""
    w = W.partitionBy("object_id").orderBy(*order)
    ahead = F.greatest(F.lead("t").over(w) - F.col("t"), F.lit(0.0))
    behind = F.greatest(F.col("t") - F.lag("t").over(w), F.lit(0.0))
    raw = traj.withColumn("weight", F.coalesce(ahead, behind, F.lit(1.0)))
    total = F.sum("weight").over(W.partitionBy("object_id"))
    return raw.withColumn("weight", F.when(total > 0, F.col("weight")).otherwise(1.0))


def decode_timeline(traj: DataFrame, layout: str, order: int = 3) -> DataFrame:
    """(trajectory columns, idx, label, energy): each sample encoded and decoded on a layout. The gain between two
    directions depends on their angle only, so the dot product of their harmonics is a Legendre sum of its cosine."""
    speakers = [(i, *s) for i, s in enumerate(harmonics.speakers(layout))]
    table = traj.sparkSession.createDataFrame(speakers, "idx int, label string, sx double, sy double, sz double")
    met = with_direction(traj).crossJoin(F.broadcast(table))  # a layout is fixed and small
    cos = clamp(F.col("x") * F.col("sx") + F.col("y") * F.col("sy") + F.col("z") * F.col("sz"), -1.0, 1.0)
    before, now, total = F.lit(1.0), cos, F.lit(1.0) + cos
    for l in range(2, max(1, min(order, 7)) + 1):
        before, now = now, (cos * now * (2 * l - 1) - before * (l - 1)) / l
        total = total + now
    return met.select(*traj.columns, "idx", "label", (total * total * F.col("gain") * F.col("gain")).alias("energy"))


def mean_timeline(traj: DataFrame, layout: str, order: int = 3) -> DataFrame:
    """(object_id, label, energy): the mean over an object's samples of decode_timeline. All speakers are in a sample's row, so
    one row goes out for each object, not one for each sample or label of it. See object_timeline for all that a timeline has."""
    speakers, terms = harmonics.speakers(layout), harmonics.legendre_sum(max(1, min(order, 7)))
    x, y, z = direction(F.col("az"), F.col("el"))
    heard = traj.select("object_id", "gain", x.alias("__x"), y.alias("__y"), z.alias("__z"))
    means = heard.groupBy("object_id").agg(*[F.avg(_energy(terms, *s[1:])).alias(f"__{i}") for i, s in enumerate(speakers)])
    return means.select("object_id", F.inline(F.array(*[F.struct(F.lit(s[0]).alias("label"), F.col(f"__{i}").alias("energy")) for i, s in enumerate(speakers)])))


def dominant(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """The loudest speaker of each sample; the first where several are, to nine places."""
    best = decoded.groupBy(*keys).agg(F.max(F.struct(F.round(F.col("energy") * 1e9).alias("energy"), (-F.col("idx")).alias("back"), "label")).alias("b"))
    return best.select(*keys, F.col("b.label").alias("label"))


def _energy(terms: list[float], sx: float, sy: float, sz: float) -> Column:
    """The square of a Legendre sum of the cosine between __x, __y, __z and a speaker, times the squared gain."""
    cos = clamp(F.col("__x") * sx + F.col("__y") * sy + F.col("__z") * sz, -1.0, 1.0)
    total = F.lit(terms[-1])
    for term in reversed(terms[:-1]):
        total = total * cos + term
    return total * total * F.col("gain") * F.col("gain")


def with_dominant(traj: DataFrame, layout: str, order: int = 3) -> DataFrame:
    """traj with `label`, the loudest speaker of each sample: all speakers are in its row, nothing is shuffled. See dominant."""
    speakers, terms = harmonics.speakers(layout), harmonics.legendre_sum(max(1, min(order, 7)))
    x, y, z = direction(F.col("az"), F.col("el"))
    heard = traj.withColumns({"__x": x, "__y": y, "__z": z}).withColumn("__even", F.array(*[F.round(_energy(terms, *s[1:]) * 1e9) for s in speakers]))
    loudest = F.get(F.array(*[F.lit(s[0]) for s in speakers]), (F.array_position("__even", F.array_max("__even")) - 1).cast("int"))
    return heard.withColumn("label", loudest).drop("__x", "__y", "__z", "__even")


def decode_footprint(traj: DataFrame, layout: str, by: list[str], order: int = 3) -> DataFrame:
    """(object_id, idx, label, x, y, z, energy): each speaker's energy over an object's samples, each for the time that it holds (see
    sample_weights); goes into scene.coverage_stats. And `touched`, on how many speakers the object is loudest at some time."""
    speakers, terms = harmonics.speakers(layout), harmonics.legendre_sum(max(1, min(order, 7)))
    x, y, z = direction(F.col("az"), F.col("el"))
    held = with_dominant(sample_weights(traj, by), layout, order).withColumns({"__x": x, "__y": y, "__z": z})
    sums = [F.sum(_energy(terms, *s[1:]) * F.col("weight")).alias(f"__e{i}") for i, s in enumerate(speakers)]
    whole = held.groupBy("object_id").agg(*sums, F.count_distinct("label").alias("touched"))
    table = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("label"), *[F.lit(v).alias(c) for c, v in zip("xyz", spot, strict=True)], F.col(f"__e{i}").alias("energy")) for i, (n, *spot) in enumerate(speakers)])
    return whole.select("object_id", "touched", F.inline(table))


def _samples(traj: DataFrame) -> DataFrame:
    """traj with __x, __y, __z; a row without time, direction or gain is no sample."""
    x, y, z = direction(F.col("az"), F.col("el"))
    return traj.dropna(subset=["t", "az", "el", "gain"]).withColumns({"__x": x, "__y": y, "__z": z})


def _with_largest(df: DataFrame, name: str, values: list[Column]) -> DataFrame:
    """df with the place, from 0, of the largest value; the first where several are, to nine places."""
    ranked = df.withColumn("__even", F.array(*[F.round(v * 1e9) for v in values]))
    return ranked.withColumn(name, (F.array_position("__even", F.array_max("__even")) - 1).cast("int")).drop("__even")


def decode_slices(traj: DataFrame, layout: str, by: list[str], order: int = 3) -> DataFrame:
    """traj with `label`, the loudest speaker of each sample (see dominant), `share`, its part of the energy, `shares`, the part of
    each speaker, and `run`, how often the loudest speaker of the object changed until then. Without energy shares are zero."""
    speakers, terms = harmonics.speakers(layout), harmonics.legendre_sum(max(1, min(order, 7)))
    heard = _samples(traj).withColumn("__e", F.array(*[_energy(terms, *s[1:]) for s in speakers]))
    each = [F.get("__e", i) for i in range(len(speakers))]
    even = F.array(*[F.round(e * 1e9) for e in each])
    placed = heard.withColumns({"__at": (F.array_position(even, F.array_max(even)) - 1).cast("int"), "__sum": sum(each[1:], each[0])})
    shares = F.array(*[F.when(F.col("__sum") > 1e-30, e / F.col("__sum")).otherwise(0.0) for e in each])
    w = W.partitionBy("object_id").orderBy(*by)
    out = placed.select(*traj.columns, "__at", F.get(F.array(*[F.lit(s[0]) for s in speakers]), "__at").alias("label"), shares.alias("shares"))
    out = out.withColumns({"share": F.get("shares", "__at"), "__fresh": F.coalesce((F.col("__at") != F.lag("__at").over(w)).cast("int"), F.lit(0))})
    return out.withColumn("run", F.sum("__fresh").over(w)).drop("__at", "__fresh")


def object_timeline(traj: DataFrame, layout: str, by: list[str], order: int = 3, dead_zone: float = 0.1) -> DataFrame:
    """What decode_slices comes to, a row for each object. A sample counts for the time to the next one, the last for the
    time since the one before, a lone one for 1; all alike where no time passes.

    samples; touched, how many speakers are loudest at some time; travel between samples in degrees, static below one; max_el, min_el;
    statistics of the shares as in scene.coverage_stats, null as the shares without energy; speakers: of each the label, its mean
    energy, its share of the energy by time, dwell, the part of the time in which it is the loudest, on so many samples (slices)
    and in so many runs. All speakers are in one row, samples are exchanged once."""
    speakers, terms = harmonics.speakers(layout), harmonics.legendre_sum(max(1, min(order, 7)))
    n, w = len(speakers), W.partitionBy("object_id").orderBy(*by)
    heard = _with_largest(_samples(traj), "__at", [_energy(terms, *s[1:]) for s in speakers])
    ahead, back, t = F.lead("t").over(w), F.lag("t").over(w), F.col("t")
    since = lambda a, b: F.greatest(a - b, F.lit(0.0))
    held = F.when(ahead.isNotNull(), since(ahead, t)).when(back.isNotNull(), since(t, back)).otherwise(1.0)
    dot = sum((F.col(c) * F.lag(c).over(w) for c in ("__y", "__z")), F.col("__x") * F.lag("__x").over(w))
    step = F.when(back.isNotNull(), F.degrees(F.acos(clamp(dot, -1.0, 1.0)))).otherwise(0.0)
    fresh = F.coalesce(F.col("__at") != F.lag("__at").over(w), F.lit(True))
    timed = heard.select("object_id", "el", "gain", "__x", "__y", "__z", "__at", held.alias("__held"), step.alias("__step"), fresh.alias("__fresh"))
    sums = []
    for i, s in enumerate(speakers):
        energy, loudest = _energy(terms, *s[1:]), F.col("__at") == i
        sums += [F.sum(energy).alias(f"__e{i}"), F.sum(energy * F.col("__held")).alias(f"__h{i}"), F.sum(F.when(loudest, F.col("__held")).otherwise(0.0)).alias(f"__d{i}"), F.count_if(loudest).alias(f"__n{i}"), F.count_if(loudest & F.col("__fresh")).alias(f"__r{i}")]
    whole = timed.groupBy("object_id").agg(F.count("*").alias("samples"), F.sum("__held").alias("__time"), F.sum("__step").alias("travel"), F.max("el").alias("max_el"), F.min("el").alias("min_el"), *sums)
    by_time = lambda a, b: F.when(F.col("__time") > 0, a).otherwise(b)
    whole = whole.withColumn("__held", F.array(*[by_time(F.col(f"__h{i}"), F.col(f"__e{i}")) for i in range(n)]))
    whole = whole.withColumn("__sum", sum((F.get("__held", i) for i in range(1, n)), F.get("__held", 0)))
    whole = whole.withColumn("__p", F.when(F.col("__sum") > 1e-30, F.array(*[F.get("__held", i) / F.col("__sum") for i in range(n)])))
    whole = _with_largest(whole, "__most", [F.get("__p", i) for i in range(n)])
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    part = lambda test: sum((F.get("__p", i) for i, s in enumerate(speakers) if test(*s[1:])), F.get("__p", 0) * 0.0)
    known = lambda value: F.when(F.col("__p").isNotNull(), value)
    entropy = total(F.transform("__p", lambda p: F.when(p > 1e-30, -p * F.ln(p)).otherwise(0.0)))
    stats = {
        "touched": sum((F.when(F.col(f"__n{i}") > 0, 1).otherwise(0) for i in range(n)), F.lit(0)).cast("long"),
        "static": F.col("travel") < 1.0,
        "least": F.array_min("__p"),
        "most": F.array_max("__p"),
        "cv": F.sqrt(total(F.transform("__p", lambda p: (p - 1.0 / n) * (p - 1.0 / n))) / n) * n,
        "uniformity": known(clamp(entropy / math.log(n), 0.0, 1.0) if n > 1 else F.lit(1.0)),
        "dead_zones": known(F.size(F.filter("__p", lambda p: p < dead_zone / n)).cast("long")),
        "top_share": total(F.slice(F.sort_array("__p", asc=False), 1, -(-n // 10))),
        "front": part(lambda x, y, z: y > 0),
        "back": part(lambda x, y, z: y < 0),
        "left": part(lambda x, y, z: x < 0),
        "right": part(lambda x, y, z: x > 0),
        "upper": part(lambda x, y, z: z > 0),
        "lower": part(lambda x, y, z: z < 0),
        "ear_level": part(lambda x, y, z: abs(math.degrees(math.atan2(z, math.hypot(x, y)))) <= 15),
        "dominant": known(F.get(F.array(*[F.lit(s[0]) for s in speakers]), "__most")),
    }
    one = lambda i, label: F.struct(F.lit(label).alias("label"), (F.col(f"__e{i}") / F.col("samples")).alias("energy"), F.get("__p", i).alias("share"), by_time(F.col(f"__d{i}") / F.col("__time"), F.col(f"__n{i}") / F.col("samples")).alias("dwell"), F.col(f"__n{i}").alias("slices"), F.col(f"__r{i}").alias("runs"))
    rows = F.array(*[one(i, s[0]) for i, s in enumerate(speakers)])
    return whole.withColumns(stats).select("object_id", "samples", "travel", "max_el", "min_el", *stats, rows.alias("speakers"))


def migration_runs(dominants: DataFrame, order: list[str]) -> DataFrame:
    """Runs of one dominant speaker with their first and last time."""
    w = W.partitionBy("object_id").orderBy(*order)
    change = F.coalesce((F.col("label") != F.lag("label").over(w)).cast("int"), F.lit(0))
    runs = dominants.withColumn("change", change).withColumn("run", F.sum("change").over(w))
    return runs.groupBy("object_id", "run").agg(F.first("label").alias("label"), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("samples"))


def dwell_fractions(dominants: DataFrame, k: int = 6) -> DataFrame:
    """Share of an object's weight on each dominant speaker; the k largest."""
    sums = dominants.groupBy("object_id", "label").agg(F.sum("weight").alias("w"))
    part = F.col("w") / F.sum("w").over(W.partitionBy("object_id"))
    rank = F.row_number().over(W.partitionBy("object_id").orderBy(F.desc("w"), "label"))
    return sums.select("object_id", "label", part.alias("dwell"), rank.alias("rank")).where((F.col("rank") <= k) & (F.col("dwell") > 0))


def fill_block_durations(blocks: DataFrame, keys: list[str], order: list[str], end: Column) -> DataFrame:
    """A missing duration reaches to the next block, the last one's to the end, never negative; with the time a position is reached."""
    ahead = F.lead("rtime").over(W.partitionBy(*keys).orderBy(*order))
    filled = F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.greatest(F.coalesce(ahead, end) - F.col("rtime"), F.lit(0.0)))
    out = blocks.withColumn("duration", filled)
    return out.withColumn("reach", F.when(F.col("jump"), F.col("rtime")).otherwise(F.col("rtime") + F.col("duration")))


def sample_envelope(points: DataFrame, grid: DataFrame, key: str, at: str = "at") -> DataFrame:
    """Value of (key, time, value) points at the (key, at) times of a grid: linear between neighbours, held outside.

    An as-of join both ways: the points' intervals are laid out once, and points and grid meet in one ordered window of a
    key. Points of a key have different times; one without a time is no point.
    """
    p = points.where("time IS NOT NULL").select(key, F.col("time").alias("at"), F.struct("time", "value").alias("point"), F.lit(None).cast("boolean").alias("asked"))
    g = grid.select(key, F.col(at).alias("at"), F.lit(None).cast("struct<time:double,value:double>").alias("point"), F.lit(True).alias("asked")).distinct()
    w = W.partitionBy(key).orderBy("at", F.col("asked").isNotNull())
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    both = p.unionByName(g).withColumns({"prev": F.last("point", ignorenulls=True).over(back), "next": F.first("point", ignorenulls=True).over(ahead)})
    a, b = F.col("prev"), F.col("next")
    line = a["value"] + (b["value"] - a["value"]) * (F.col("at") - a["time"]) / (b["time"] - a["time"])
    value = F.when(a.isNull(), b["value"]).when(b.isNull() | (F.col("at") == a["time"]), a["value"]).otherwise(line)
    return both.where("asked").select(key, F.col("at").alias(at), value.alias("value"))


def sample_trajectory(points: DataFrame, spans: DataFrame, key: str, step: float = 0.1) -> DataFrame:
    """(key, slice, t, x, y, z, gain) at the middle of each slice of a span (key, start, end): max(1, rounded length / step) slices.

    Between points (key, t, az, el, dist, gain; times of a key differ) vectors and gains are interpolated along the
    chord; outside, the end points hold. A span without points faces front with gain one. Points and middles meet in one
    ordered window of a key.
    """
    x, y, z = direction(F.col("az"), F.col("el"))
    point = F.struct(F.col("t").cast("double").alias("t"), (x * F.col("dist")).alias("x"), (y * F.col("dist")).alias("y"), (z * F.col("dist")).alias("z"), F.col("gain").cast("double").alias("gain"))
    known = points.select(key, F.col("t").cast("double").alias("t"), point.alias("point"), F.lit(None).cast("long").alias("slice"))
    count = F.greatest(F.lit(1).cast("long"), F.floor((F.col("end") - F.col("start")) / step + 0.5))
    asked = spans.select(key, "start", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("slice"))
    asked = asked.select(key, (F.col("start") + (F.col("slice") + 0.5) * step).alias("t"), F.lit(None).cast(known.schema["point"].dataType).alias("point"), "slice")
    w = W.partitionBy(key).orderBy("t", F.col("slice").isNotNull())
    both = known.unionByName(asked).withColumns({"a": F.last("point", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "b": F.first("point", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))})
    part = (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))

    def at(name: str, absent: float):
        a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
        return F.when(F.col("a").isNull(), F.coalesce(b, F.lit(absent))).when(F.col("b").isNull(), a).otherwise(a + part * (b - a)).alias(name)

    return both.where("slice is not null").select(key, "slice", "t", at("x", 0.0), at("y", 1.0), at("z", 0.0), at("gain", 1.0))


def thin_timeline(slices: DataFrame, keys: list[str], order: list[str], most: int = 48) -> DataFrame:
    """At most `most` (2 to 512) rows of each key, evenly spaced in order: the indices round(r * (n - 1) / (most - 1)).

    Whether an index is one of them follows from the index alone, so nothing is joined.
    """
    if not 2 <= most <= 512:
        raise ValueError("2 to 512 rows")
    everything = W.partitionBy(*keys)
    wide = slices.withColumns({"idx": F.row_number().over(everything.orderBy(*order)) - 1, "__last": F.count("*").over(everything) - 1})
    idx, last = F.col("idx"), F.col("__last")
    r = F.ceil((2 * idx - 1) * (most - 1) / (2 * last))  # the first whose index is not below this one
    kept = (last < most) | (F.floor((2 * r * last + (most - 1)) / (2 * (most - 1))) == idx)
    return wide.where(kept).drop("__last")


def predict_decode(slices: DataFrame, layout: str, order: int = 3) -> DataFrame:
    """slices (x, y, z, gain) with `dominant`, the label of the loudest speaker, and `fractions`, each speaker's share of the energy.

    All speakers are columns of one row, so nothing is shuffled. A vector of no length faces front. Of several loudest
    speakers, to nine places, the first counts; a slice of no energy has shares of zero.
    """
    norm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    unit = lambda c, front: F.when(norm > 1e-12, F.col(c) / norm).otherwise(front)
    placed = slices.withColumns({"__x": unit("x", 0.0), "__y": unit("y", 1.0), "__z": unit("z", 0.0)})
    speakers, terms = harmonics.predicted_speakers(layout), harmonics.legendre_sum(max(1, order))

    heard = placed.withColumn("__energies", F.array(*[_energy(terms, *s[1:]) for s in speakers]))
    even = F.transform("__energies", lambda e: F.round(e * 1e9))
    loudest = F.get(F.array(*[F.lit(s[0]) for s in speakers]), (F.array_position(even, F.array_max(even)) - 1).cast("int"))
    total = F.aggregate("__energies", F.lit(0.0), lambda a, e: a + e)
    shares = F.transform("__energies", lambda e: F.when(F.col("__total") > 1e-30, e / F.col("__total")).otherwise(0.0))
    return heard.withColumns({"dominant": loudest, "__total": total}).withColumn("fractions", shares).drop("__x", "__y", "__z", "__energies", "__total")


def decode_shares(predicted: DataFrame, keys: list[str], layout: str) -> DataFrame:
    """(keys, label, coverage, dominant_slices): each speaker's mean share over the slices of predict_decode, and on how many it is the loudest."""
    labels = F.array(*[F.lit(s[0]) for s in harmonics.predicted_speakers(layout)])
    each = predicted.select(*keys, "dominant", F.inline(F.arrays_zip(labels.alias("label"), F.col("fractions").alias("share"))))
    return each.groupBy(*keys, "label").agg(F.avg("share").alias("coverage"), F.count(F.when(F.col("dominant") == F.col("label"), 1)).alias("dominant_slices"))


def object_trajectory(tracks: DataFrame, points: DataFrame, key: str, block_ms: float = 100.0, most: int = 1000) -> DataFrame:
    """(key, block, rtime, az, el, dist, gain, source) of each object over its span (key, start, end, panned, az, el, dist).

    An object without a panner has one block in front (source none), one without automation (points: key, axis az, el or
    dist, time, value) one where its panner stands (static); else (envelope) a block every `block_ms`, the last at the end,
    `most` at most by wider steps. Automation is linear between its points and held outside; an axis without any, or a null
    one, is 0 (distance 1). Distances lie in 0 to 1.5. A span that ends before it begins has no length."""
    length = F.greatest(F.coalesce(F.col("end") - F.col("start"), F.lit(0.0)), F.lit(0.0))
    step = block_ms / 1000 if block_ms > 0 else 0.1
    moved = points.where("axis IN ('az', 'el', 'dist') AND time IS NOT NULL").select(F.col(key).alias("__key"), F.lit(True).alias("__moves")).distinct()
    spans = tracks.join(moved, F.col(key) == F.col("__key"), "left").withColumn("__length", length)
    source = F.when(~F.coalesce("panned", F.lit(False)), "none").when(F.col("__moves").isNull(), "static").otherwise("envelope")
    n = F.when((source == "envelope") & (F.col("__length") > 0), F.least(F.ceil(F.col("__length") / step) + 1, F.lit(most))).otherwise(1)
    wide = F.when(F.ceil(F.col("__length") / step) + 1 > most, F.col("__length") / max(most - 1, 1)).otherwise(step)
    spans = spans.withColumns({"source": source, "__step": wide}).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    grid = spans.withColumn("rtime", F.least(F.col("block") * F.col("__step"), F.col("__length"))).withColumn("__at", F.coalesce("start", F.lit(0.0)) + F.col("rtime"))
    # All axes in one pass: an axis is part of the key of its points.
    asked = grid.where("source = 'envelope'").select(key, F.col("__at").alias("at"), F.explode(F.array(F.lit("az"), F.lit("el"), F.lit("dist"))).alias("axis"))
    asked = asked.select(F.struct(F.col(key).alias("k"), "axis").alias("of"), "at")
    told = points.where("axis IN ('az', 'el', 'dist')").select(F.struct(F.col(key).alias("k"), "axis").alias("of"), "time", F.col("value").cast("double").alias("value"))
    values = sample_envelope(told, asked, "of").groupBy(F.col("of.k").alias("__k"), F.col("at").alias("__t")).agg(*[F.max(F.when(F.col("of.axis") == a, F.col("value"))).alias(f"__{a}") for a in ("az", "el", "dist")])
    out = grid.join(values, (F.col(key) == F.col("__k")) & (F.col("__at") == F.col("__t")), "left")
    none = F.col("source") == "none"
    axis = lambda a, rest: F.when(none, rest).otherwise(F.coalesce(f"__{a}", F.col(a).cast("double"), F.lit(rest)))
    return out.select(key, "block", "rtime", axis("az", 0.0).alias("az"), axis("el", 0.0).alias("el"), F.greatest(F.least(axis("dist", 1.0), F.lit(1.5)), F.lit(0.0)).alias("dist"), F.lit(1.0).alias("gain"), "source")
