"""Ambisonic scenes: rows (program_id, frame, acn array of SN3D channels)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundtable.functions import harmonics
from soundtable.functions.scalars import azimuth, clamp, elevation


def _acn(k: int) -> Column:
    return F.element_at("acn", k + 1).cast("double")


def field_sums(n3d: bool = False) -> list[Column]:
    """The product sums of the first order that spatial_field needs; they can be added over any frames."""
    s = 1 / math.sqrt(3) if n3d else 1.0
    w, y, z, x = _acn(0), _acn(1) * s, _acn(2) * s, _acn(3) * s
    return [F.count("*").cast("double").alias("n"), F.sum(w * w).alias("ww"), F.sum(x * x + y * y + z * z).alias("dd"), F.sum(-(w * y)).alias("ix"), F.sum(w * x).alias("iy"), F.sum(w * z).alias("iz")]


def field_of_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Direction of arrival, diffuseness and velocity vector of the sums."""
    x, y, z = (F.col(c) / F.col("n") for c in ("ix", "iy", "iz"))
    size, energy = F.sqrt(x * x + y * y + z * z), 0.5 * (F.col("ww") + F.col("dd")) / F.col("n")
    diffuse = clamp(F.when(energy > 1e-20, 1 - size / energy).otherwise(1.0), 0.0, 1.0)
    velocity = F.when(F.col("ww") > 1e-20, size * F.col("n") / F.col("ww")).otherwise(0.0)
    return sums.select(*keys, azimuth(x, y).alias("az"), elevation(x, y, z).alias("el"), diffuse.alias("diffuseness"), velocity.alias("rv"))


def spatial_field(scene: DataFrame, keys: list[str], n3d: bool = False) -> DataFrame:
    return field_of_sums(scene.groupBy(*keys).agg(*field_sums(n3d)), keys)


def spatial_field_timeline(scene: DataFrame, keys: list[str], window: int, hop: int) -> DataFrame:
    """The field of each full window of `window` frames, a multiple of hop, at each hop: sums of hops first, then a frame
    over them. A program shorter than a window has one, over what it has."""
    if hop < 1 or window % hop:
        raise ValueError("the window must be a multiple of the hop")
    per = window // hop
    bins = scene.groupBy(*keys, F.floor(F.col("frame") / hop).alias("bin")).agg(*field_sums())
    w = W.partitionBy(*keys).orderBy("bin").rowsBetween(0, per - 1)
    names = ["n", "ww", "dd", "ix", "iy", "iz"]
    total = F.sum("n").over(W.partitionBy(*keys)).alias("total")
    rolled = bins.select(*keys, "bin", total, *[F.sum(c).over(w).alias(c) for c in names])
    return field_of_sums(rolled.where((F.col("n") == window) | (F.col("total") < window) & (F.col("bin") == 0)).drop("total"), [*keys, "bin"])


def covariance(scene: DataFrame, keys: list[str], channels: int) -> DataFrame:
    """(keys, c array): sums of channel products, upper triangle row by row; one pass whatever the number of speakers."""
    pairs = [(j, k) for j in range(channels) for k in range(j, channels)]
    return scene.groupBy(*keys).agg(F.array(*[F.sum(_acn(j) * _acn(k)) for j, k in pairs]).alias("c"))


#: Channels up to which the sums of all products are columns; above, tasks project their frames and send one sum a speaker.
COVARIANCE_CHANNELS = 16


def speaker_energies(scene: DataFrame, keys: list[str], layout: str | int, channels: int = 64, n3d: bool = False) -> DataFrame:
    """(keys, idx, label, x, y, z, energy) for each speaker of a layout, or each of so many directions of the sphere.

    Scenes of fewer channels have silent ones above, those of more are decoded at the order of `channels`; null channels
    are silent. Either way a task sends a few numbers for each program it has read."""
    basis = [[v / math.sqrt(2 * harmonics.degree(k) + 1) if n3d else v for k, v in enumerate(y)] for y in harmonics.basis(layout, channels)]
    places = [(i, *spot) for i, spot in enumerate(harmonics.speakers(layout))]
    spark = scene.sparkSession
    if channels > COVARIANCE_CHANNELS:
        table = spark.createDataFrame(places, "idx int, label string, x double, y double, z double")
        return _projected(scene, keys, np.array(basis)).join(F.broadcast(table), "idx").select(*keys, "idx", "label", "x", "y", "z", "energy")
    rows = [(*spot, [y[j] * y[k] * (1 if j == k else 2) for j in range(channels) for k in range(j, channels)]) for spot, y in zip(places, basis, strict=True)]
    table = spark.createDataFrame(rows, "idx int, label string, x double, y double, z double, w array<double>")
    sums = covariance(scene, keys, channels)
    # The table of speakers is fixed and small; each program meets each speaker once.
    met = sums.crossJoin(F.broadcast(table))
    return met.select(*keys, "idx", "label", "x", "y", "z", F.aggregate(F.zip_with("c", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("energy"))


def _projected(scene: DataFrame, keys: list[str], basis: np.ndarray) -> DataFrame:
    """(keys, idx, energy): sums of squares of the frames' projections on each row of the basis."""
    speakers, channels = basis.shape
    acn = F.concat(F.transform(F.slice("acn", 1, channels), lambda v: F.coalesce(v.cast("double"), F.lit(0.0))), F.array_repeat(F.lit(0.0), F.greatest(F.lit(channels) - F.size("acn"), F.lit(0))))
    narrow = scene.where("acn IS NOT NULL").select(*keys, acn.alias("__acn"))

    def run(frames):
        for frame in frames:
            for key, part in frame.groupby(keys, dropna=False, sort=False):
                energy = ((np.stack(part["__acn"].to_numpy()) @ basis.T) ** 2).sum(axis=0)
                yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "idx": np.arange(speakers), "energy": energy})

    schema = T.StructType([*[scene.schema[k] for k in keys], T.StructField("idx", T.IntegerType()), T.StructField("energy", T.DoubleType())])
    return narrow.mapInPandas(run, schema).groupBy(*keys, "idx").agg(F.sum("energy").alias("energy"))


def energy_vector(energies: DataFrame, keys: list[str]) -> DataFrame:
    e = F.col("energy")
    s = energies.groupBy(*keys).agg(F.sum(e).alias("t"), *[F.sum(e * F.col(c)).alias(c) for c in "xyz"])
    x, y, z = (F.when(F.col("t") > 1e-20, F.col(c) / F.col("t")).otherwise(F.col(c)) for c in "xyz")
    return s.select(*keys, F.sqrt(x * x + y * y + z * z).alias("re"), azimuth(x, y).alias("az"), elevation(x, y, z).alias("el"))


def acn_energy(scene: DataFrame, keys: list[str]) -> DataFrame:
    each = scene.select(*keys, F.posexplode("acn").alias("k", "a"))
    a = F.col("a").cast("double")
    sums = each.groupBy(*keys, "k").agg(F.sum(a * a).alias("e"), F.avg(a * a).alias("p"))
    total = F.sum("e").over(W.partitionBy(*keys))
    return sums.select(*keys, "k", F.when(total > 1e-20, F.col("e") / total).otherwise(0.0).alias("share"), F.when(F.col("p") > 1e-12, 10 * F.log10("p")).otherwise(-120.0).alias("rms_db"))


def coverage_stats(energies: DataFrame, keys: list[str], dead_zone: float = 0.1) -> DataFrame:
    """Statistics of energy shares over directions; programs without energy give no row."""
    w = W.partitionBy(*keys)
    shares = energies.withColumns({"t": F.sum("energy").over(w), "n": F.count("*").over(w)}).where("t > 1e-30").withColumn("p", F.col("energy") / F.col("t"))
    ranked = shares.withColumn("r", F.row_number().over(w.orderBy(F.desc("p"), "idx")))
    p, n = F.col("p"), F.col("n")
    flat = F.abs(elevation(F.col("x"), F.col("y"), F.col("z"))) <= 15
    part = lambda c: F.coalesce(F.sum(F.when(c, p)), F.lit(0.0))
    out = ranked.groupBy(*keys).agg(
        F.max("n").alias("speakers"),
        F.min("p").alias("least"),
        F.max("p").alias("most"),
        F.stddev_pop("p").alias("sd"),
        F.sum(F.when(p > 1e-30, -p * F.ln(p)).otherwise(0.0)).alias("entropy"),
        F.count_if(p < dead_zone / n).alias("dead_zones"),
        part(F.col("r") <= F.ceil(0.1 * n)).alias("top_share"),
        part(F.col("y") > 0).alias("front"),
        part(F.col("x") < 0).alias("left"),
        part(F.col("z") > 0).alias("upper"),
        part(flat).alias("ear_level"),
        F.min(F.when(F.col("r") == 1, F.col("label"))).alias("dominant"),
    )
    return out.withColumns({"cv": F.col("sd") * F.col("speakers"), "uniformity": F.when(F.col("speakers") > 1, clamp(F.col("entropy") / F.ln("speakers"), 0.0, 1.0)).otherwise(1.0)}).drop("sd", "entropy")


def top_hotspots(energies: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc("energy"), "idx")
    return energies.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scale_channels(acn: Column, gains: list[float]) -> Column:
    table = F.array(*[F.lit(float(g)) for g in gains])
    return F.zip_with(acn, F.slice(table, F.lit(1), F.size(acn)), lambda a, g: a.cast("double") * g)


def convert_normalization(acn: Column, mode: str, channels: int = 64) -> Column:
    """sn3d_n3d, n3d_sn3d for any order; ambix_fuma, fuma_ambix for the first."""
    root = [math.sqrt(2 * harmonics.degree(k) + 1) for k in range(channels)]
    one = lambda i: F.element_at(acn, i).cast("double")
    if mode == "sn3d_n3d":
        return scale_channels(acn, root)
    if mode == "n3d_sn3d":
        return scale_channels(acn, [1 / r for r in root])
    if mode == "ambix_fuma":
        return F.array(one(1) * math.sqrt(0.5), one(4), one(2), one(3))
    if mode == "fuma_ambix":
        return F.array(one(1) * math.sqrt(2), one(3), one(4), one(2))
    raise ValueError(f"unknown mode {mode}")


def convert_order(acn: Column, to: int) -> Column:
    """Drops the channels above an order, or adds silent ones."""
    wanted = (to + 1) ** 2
    return F.slice(F.concat(acn, F.array_repeat(F.lit(0.0).cast("float"), wanted)), 1, wanted)


def mirror(acn: Column, plane: str, channels: int = 64) -> Column:
    def sign(k: int) -> float:
        l, m = harmonics.degree(k), harmonics.order(k)
        flips = {"left_right": m < 0, "front_back": (abs(m) + (m < 0)) % 2, "up_down": (l + abs(m)) % 2}
        return -1.0 if flips[plane] else 1.0

    return scale_channels(acn, [sign(k) for k in range(channels)])


def rotate_yaw(acn: Column, degrees: float, channels: int = 64) -> Column:
    """The scene turned about the vertical axis: a source at azimuth a comes to a + degrees. Exact at any order."""
    order = [math.isqrt(k) for k in range(channels)]
    m = [k - n * n - n for k, n in enumerate(order)]
    cos, sin, partner = (F.array(*[F.lit(v) for v in row]) for row in ([math.cos(math.radians(j * degrees)) for j in m], [math.sin(math.radians(j * degrees)) for j in m], [k - 2 * j + 1 for k, j in enumerate(m)]))
    other = lambda k: F.element_at(acn, F.element_at(partner, k + 1)).cast("double")
    return F.transform(acn, lambda a, k: a.cast("double") * F.element_at(cos, k + 1) - other(k) * F.element_at(sin, k + 1))


def rotation_blocks(yaw: float, pitch: float, roll: float, order: int) -> list[np.ndarray]:
    """For each degree the matrix that turns its channels with the sources: roll about the front axis, then pitch (front
    upwards), then yaw (to the left), degrees.

    A degree's channels turn among themselves, so its matrix is settled by what they are in enough directions before
    and after the turn; the equations have an exact solution."""
    a, b, c = (math.radians(v) for v in (yaw, pitch, roll))
    turn_z = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    turn_x = np.array([[1, 0, 0], [0, math.cos(b), -math.sin(b)], [0, math.sin(b), math.cos(b)]])
    turn_y = np.array([[math.cos(c), 0, math.sin(c)], [0, 1, 0], [-math.sin(c), 0, math.cos(c)]])
    before = np.array(harmonics.sphere(4 * (order + 1) ** 2))
    after = before @ (turn_z @ turn_x @ turn_y).T
    out = []
    for degree in range(order + 1):
        of = [[[harmonics.at_vector(k, *d) for k in range(degree**2, (degree + 1) ** 2)] for d in spots] for spots in (before, after)]
        out.append(np.linalg.lstsq(np.array(of[0]), np.array(of[1]), rcond=None)[0].T)
    return out


def rotate_scene(acn: Column, yaw: float = 0.0, pitch: float = 0.0, roll: float = 0.0, order: int = 7) -> Column:
    """Scenes of up to that order turned by three angles (our definition, see rotation_blocks): channels of a degree mix, no
    others. A scene of fewer channels is turned degree by degree as far as its degrees are whole; what is above is dropped."""
    parts = []
    for degree, block in enumerate(rotation_blocks(yaw, pitch, roll, order)):
        first, width = degree**2, 2 * degree + 1
        rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in block])
        dots = F.transform(rows, _dot_with(F.slice(acn, first + 1, width)))
        parts.append(F.when(F.size(acn) >= first + width, dots).otherwise(F.array().cast("array<double>")))
    return F.concat(*parts)


def _dot_with(part: Column):
    def dot(row: Column) -> Column:
        return F.aggregate(F.zip_with(part, row, lambda v, w: v.cast("double") * w), F.lit(0.0), lambda s, v: s + v)

    return dot


def basis_columns(az: Column, el: Column, order: int) -> Column:
    """The SN3D harmonics of a direction (degrees, azimuth to the left) in ACN order, as an array."""
    a, e = F.radians(az), F.radians(el)
    sine, cosine, out = F.sin(e), F.cos(e), []
    for k in range((order + 1) ** 2):
        l, m = harmonics.degree(k), harmonics.order(k)
        value = F.lit(0.0)
        for c in reversed(harmonics.legendre_derivative(l, abs(m))):
            value = value * sine + F.lit(float(c))
        norm = math.sqrt((2 if m else 1) * math.factorial(l - abs(m)) / math.factorial(l + abs(m)))
        turn = F.sin(a * -m) if m < 0 else F.cos(a * m)
        out.append(value * norm * F.pow(cosine, F.lit(abs(m))) * turn)
    return F.array(*out)


def encode_source(sources: DataFrame, keys: list[str], order: int = 3) -> DataFrame:
    """(keys, acn): the scene of all sources (keys, x, az, el) of a frame. Null samples or directions are silent."""
    y = basis_columns(F.col("az"), F.col("el"), order)
    each = sources.where("x IS NOT NULL AND az IS NOT NULL AND el IS NOT NULL").select(*keys, F.transform(y, lambda v: v * F.col("x")).alias("v"))
    return each.groupBy(*keys).agg(F.array(*[F.sum(F.get("v", F.lit(k))) for k in range((order + 1) ** 2)]).alias("acn"))


def decode_scene(scene: DataFrame, keys: list[str], layout: str | int, channels: int = 64) -> DataFrame:
    """(keys, idx, label, value): each frame's projection on each speaker, for the channels that the scene has."""
    names = [label for label, *_ in harmonics.speakers(layout)]
    table = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("label"), F.array(*[F.lit(float(v)) for v in y]).alias("y")) for i, (n, y) in enumerate(zip(names, harmonics.basis(layout, channels), strict=True))])
    each = scene.select(*keys, "acn", F.inline(table))
    if channels > 16:
        dot = F.aggregate(F.zip_with(F.slice("acn", 1, channels), F.slice("y", F.lit(1), F.least(F.size("acn"), F.lit(channels))), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    else:  # written out, these few terms are compiled
        dot = F.when(F.col("acn").isNotNull(), F.lit(0.0))
        for k in range(channels):
            dot = dot + F.when(F.size("acn") > k, F.get("acn", F.lit(k)).cast("double") * F.get("y", F.lit(k))).otherwise(0.0)
    return each.select(*keys, "idx", "label", dot.alias("value"))


def beam(acn: Column, az: Column, el: Column, order: int = 3) -> Column:
    """What a scene of that order is towards a direction; strongest where its only source is."""
    y = basis_columns(az, el, order)
    return F.aggregate(F.zip_with(F.slice(acn, 1, (order + 1) ** 2), y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


#: Variation of energies and share of dead zones below which coverage is even, variation below which it is
#: balanced, share of upper energy below which a scene is planar, and layouts that have heights.
EVEN, EVEN_DEAD, BALANCED, PLANAR, HIGH_LAYOUTS = 0.35, 0.02, 0.8, 0.05, ("7.1.4", "9.1.6")


def coverage_verdict(stats: DataFrame, layout: str | int) -> DataFrame:
    """The coverage_stats of programs with `verdict` (even, balanced or directional) and `planar`, whether almost nothing comes
    from above where something could."""
    dead = F.col("dead_zones") / F.col("speakers")
    verdict = F.when((F.col("cv") < EVEN) & (dead < EVEN_DEAD), "even").when(F.col("cv") < BALANCED, "balanced").otherwise("directional")
    high = isinstance(layout, int) or layout in HIGH_LAYOUTS
    return stats.withColumns({"verdict": verdict, "planar": (F.col("upper") < PLANAR) if high else F.lit(False)})


def spatial_field_report(scene: DataFrame, keys: list[str], n3d: bool = False, speakers: int = 36, channels: int = 64) -> DataFrame:
    """spatial_field with the order that the scene's channels hold (`order`) and its energy vector: `re`, `re_az`, `re_el`."""
    field = spatial_field(scene, keys, n3d)
    held = scene.groupBy(*keys).agg((F.floor(F.sqrt(F.max(F.size("acn")).cast("double")) + 1e-9).cast("int") - 1).alias("order"))
    vector = energy_vector(speaker_energies(scene, keys, speakers, channels, n3d), keys)
    renamed = lambda df, tag: df.withColumnsRenamed({k: f"__{tag}_{k}" for k in keys})
    out = field
    for side, tag in ((held, "o"), (vector.withColumnsRenamed({"az": "re_az", "el": "re_el"}), "v")):
        on = None
        for k in keys:
            one = F.col(k).eqNullSafe(F.col(f"__{tag}_{k}"))
            on = one if on is None else on & one
        out = out.join(renamed(side, tag), on, "left").drop(*[f"__{tag}_{k}" for k in keys])
    return out
