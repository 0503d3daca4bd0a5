"""Projects as wholes: summaries, what scenes a track may hold, and the rows of planned sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundtable.operators.styles import classify_plugin

#: Channels of bed layouts, orders of scenes, channels of a track at most, spellings of normalisations.
BED_CHANNELS = {"5.1": 6, "7.1": 8, "7.1.4": 12, "9.1.6": 16, "22.2": 24}
HIGHEST_ORDER, MOST_CHANNELS, NORMALIZATIONS = 7, 128, ("SN3D", "N3D", "FuMa")
#: Fixed value: what a project without a tempo marker plays at.
TEMPO = 120.0


def even_clamp(channels: Column) -> Column:
    """A track's width: 2 to 128, and even."""
    held = F.greatest(F.least(channels, F.lit(MOST_CHANNELS)), F.lit(2))
    return held + held % 2


def order_from_channels(channels: Column) -> Column:
    """The order of a scene of so many channels, the first at least."""
    return F.greatest(F.floor(F.sqrt(channels.cast("double")) + 1e-9).cast("int") - 1, F.lit(1))


def project_summary(projects: DataFrame, tracks: DataFrame, items: DataFrame, markers: DataFrame, tempo: DataFrame, takes: DataFrame, notes: DataFrame, cc: DataFrame) -> DataFrame:
    """(project, name, tempo, length, tracks, items, takes, markers, regions, notes, cc), a row for each of projects (project, name).

    Counts are one aggregation a table, joined by project; the length is where the last item, marker or region ends, the tempo
    that of the first marker in time (TEMPO without any). Rows of projects that are not listed do not count; the master (-1) is
    no track."""

    def counted(rows: DataFrame, **more) -> DataFrame:
        return rows.groupBy(F.col("project").alias("__of")).agg(*[c.alias(n) for n, c in more.items()])

    end = F.max(F.when(F.coalesce("region", F.lit(False)), F.coalesce("end", "position")).otherwise(F.col("position")))
    parts = [
        counted(tracks.where("idx >= 0"), tracks=F.count("*")),
        counted(items, items=F.count("*"), items_end=F.max(F.col("position") + F.col("length"))),
        counted(markers, markers=F.count_if(~F.coalesce("region", F.lit(False))), regions=F.count_if(F.coalesce("region", F.lit(False))), markers_end=end),
        counted(tempo.where("time IS NOT NULL"), tempo=F.min_by("bpm", F.struct("time", "idx"))),
        counted(takes, takes=F.count("*")),
        counted(notes, notes=F.count("*")),
        counted(cc, cc=F.count("*")),
    ]
    out = projects.select("project", F.coalesce("name", F.lit("")).alias("name"))
    for part in parts:
        out = out.join(part, F.col("project") == F.col("__of"), "left").drop("__of")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    length = F.greatest(F.coalesce("items_end", F.lit(0.0)), F.coalesce("markers_end", F.lit(0.0)))
    return out.select("project", "name", F.coalesce("tempo", F.lit(TEMPO)).alias("tempo"), length.alias("length"), *map(zero, ("tracks", "items", "takes", "markers", "regions", "notes", "cc")))


def scene_state(tracks: DataFrame, fx: DataFrame) -> DataFrame:
    """(project, idx, channels, order, scene_channels, padded, surplus, encoders, decoders, rotators, binaurals) of each track.

    order is the highest whose channels fit (-1: none does), `surplus` the channels above it. Plug-ins (project, track, name)
    count by their role, those of no known suite too."""
    n = F.col("channels")
    order = F.coalesce(*[F.when(n >= (o + 1) ** 2, o) for o in range(HIGHEST_ORDER, 0, -1)], F.lit(-1))
    used = F.when(order >= 1, (order + 1) * (order + 1))
    role = classify_plugin(F.col("name"))[1]
    roles = ("encoder", "decoder", "rotator", "binaural")
    counts = fx.withColumn("__role", role).groupBy(F.col("project").alias("__p"), F.col("track").alias("__t")).agg(*[F.count_if(F.col("__role") == r).alias(f"{r}s") for r in roles])
    met = tracks.join(counts, (F.col("project") == F.col("__p")) & (F.col("idx") == F.col("__t")), "left")
    return met.select("project", "idx", "channels", order.alias("order"), used.alias("scene_channels"), F.coalesce(n > used, F.lit(False)).alias("padded"), F.coalesce(n - used, F.lit(0)).alias("surplus"), *[F.coalesce(f"{r}s", F.lit(0)).cast("long").alias(f"{r}s") for r in roles])


def parse_target(layout: Column, order: Column, normalization: Column) -> tuple[Column, Column, Column]:
    """(channels, tag, error) of a target that names a layout or an order of a scene: one of no_target, ambiguous_target,
    bad_order, bad_normalization and unknown_layout, or null."""
    both, none = layout.isNotNull() & order.isNotNull(), layout.isNull() & order.isNull()
    known = F.create_map(*[F.lit(x) for pair in BED_CHANNELS.items() for x in pair])[layout]
    norm = F.coalesce(normalization, F.lit("SN3D"))
    error = F.when(both, "ambiguous_target").when(none, "no_target").when(order.isNotNull() & ~order.between(1, HIGHEST_ORDER), "bad_order").when(order.isNotNull() & ~norm.isin(*NORMALIZATIONS), "bad_normalization").when(order.isNull() & known.isNull(), "unknown_layout")
    channels = F.when(order.isNotNull(), even_clamp((order + 1) * (order + 1))).otherwise(known)
    tag = F.when(order.isNotNull(), F.concat(order.cast("string"), F.lit("-order ambisonics ("), channels.cast("string"), F.lit("ch, "), norm, F.lit(")"))).otherwise(F.concat(layout, F.lit(" bed ("), channels.cast("string"), F.lit("ch)")))
    return F.when(error.isNull(), channels), F.when(error.isNull(), tag), error


def plan_session(sessions: DataFrame, key: str) -> DataFrame:
    """(key, step, action, target, detail) of sessions with a bed, objects, a monitor and sends to a renderer.

    sessions: (key, layout, objects, monitor, renderer). A layout that is not known gives one row, action refused. Steps are
    counted from 0 in the order in which they are done; null counts and flags are none."""
    known = F.create_map(*[F.lit(x) for pair in BED_CHANNELS.items() for x in pair])[F.col("layout")]
    objects = F.greatest(F.coalesce("objects", F.lit(0)), F.lit(0))
    row = lambda action, target, detail: F.struct(F.lit(action).alias("action"), target.alias("target"), detail.alias("detail"))
    bed = row("build_bed", F.concat("layout", F.lit(" Bed")), F.concat(known.cast("string"), F.lit(" ch")))
    each = F.when(objects > 0, F.transform(F.sequence(F.lit(1), objects), lambda i: row("add_object_track", F.concat(F.lit("Object "), i.cast("string")), F.lit("mono object track"))))
    monitor = F.when(F.coalesce("monitor", F.lit(False)), F.array(row("add_binaural_monitor", F.lit("monitor bus"), F.lit("object"))))
    renderer = F.when(F.coalesce("renderer", F.lit(False)), F.array(row("renderer_sends", F.lit("renderer bus"), F.concat(known.cast("string"), F.lit("-ch bed + "), objects.cast("string"), F.lit(" objects")))))
    none = F.array().cast("array<struct<action:string,target:string,detail:string>>")
    steps = F.when(known.isNull(), F.array(row("refused", F.coalesce("layout", F.lit("")), F.lit("unknown_layout")))).otherwise(F.concat(F.array(bed), F.coalesce(each, none), F.coalesce(monitor, none), F.coalesce(renderer, none)))
    return sessions.select(key, F.posexplode(steps).alias("step", "s")).select(key, "step", "s.*")


def nominal_direction(label: Column) -> tuple[Column, Column]:
    """Azimuth (to the left) and elevation in degrees where a bed label's speaker stands; null for labels that stand nowhere."""
    spots = {"L": (30, 0), "R": (-30, 0), "C": (0, 0), "M": (0, 0), "Ls": (110, 0), "Rs": (-110, 0), "Lss": (90, 0), "Rss": (-90, 0), "Lsr": (150, 0), "Rsr": (-150, 0), "Lw": (60, 0), "Rw": (-60, 0), "Ltf": (45, 45), "Rtf": (-45, 45), "Ltm": (90, 45), "Rtm": (-90, 45), "Ltr": (135, 45), "Rtr": (-135, 45)}
    az, el = (F.create_map(*[F.lit(x) for k, v in spots.items() for x in (k, float(v[i]))]) for i in (0, 1))
    return az[label], el[label]

