"""The renderer's roster: its limits, and its sends against those that exist."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Objects and channels that a master may have, and the width of its canonical bed.
MOST_OBJECTS, MOST_CHANNELS, BED_WIDTH = 118, 128, 10
#: Channel counts of beds.
BED_WIDTHS = (6, 8, 12, 16, 24)


def discover_objects(tracks: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Tracks named `Object ` and digits, with `number` and their place in its order, from 0."""
    found = tracks.where(F.col(name).rlike("^Object [0-9]+$")).withColumn("number", F.substring(F.col(name), 8, 20).cast("long"))
    return found.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("number", name)) - 1)


def detect_beds(tracks: DataFrame, width: str = "channels") -> DataFrame:
    return tracks.where(F.col(width).isin(*BED_WIDTHS))


def check_master_limits(masters: DataFrame) -> DataFrame:
    """masters (bed_width, 0 for none, and objects) with `codes`, in this order, and whether one of them is `fatal`."""
    over = [(F.col("objects") > MOST_OBJECTS, "over_118"), (F.col("bed_width") + F.col("objects") > MOST_CHANNELS, "over_128"), (F.col("bed_width") > BED_WIDTH, "wide_bed")]
    return masters.withColumn("codes", F.array_compact(F.array(*[F.when(c, n) for c, n in over]))).withColumn("fatal", over[0][0] | over[1][0])


def build_roster(beds: DataFrame, objects: DataFrame, bus: str) -> DataFrame:
    """(bus, slot, kind, source, dst, width): the bed (bus, source, width; at most one a bus) from channel 0, then a channel for each object (bus, source, number)."""
    bed = beds.where("width > 0").select(bus, F.lit(0).alias("slot"), F.lit("bed").alias("kind"), "source", F.lit(0).alias("dst"), "width")
    place = F.row_number().over(W.partitionBy(bus).orderBy("number", "source"))
    after = objects.join(bed.select(bus, F.col("width").alias("__base")), bus, "left")
    return bed.unionByName(after.select(bus, place.alias("slot"), F.lit("object").alias("kind"), "source", (F.coalesce("__base", F.lit(0)) + place - 1).alias("dst"), F.lit(1).alias("width")))


def _greedy(roster: pd.DataFrame, existing: pd.DataFrame) -> pd.DataFrame:
    """One source on one bus: in slot order, the first unused send that fits exactly, else the first unused one."""
    free = {s.send_index: (s.dst, s.width) for s in existing.sort_values("send_index").itertuples()}
    out = []
    for r in roster.sort_values("slot").itertuples():
        fits = [i for i, place in free.items() if place == (r.dst, r.width)]
        chosen = next(iter(fits or free), None)
        out.append((r.bus, r.slot, chosen, "add" if chosen is None else "reuse" if fits else "fix"))
        free.pop(chosen, None)
    return pd.DataFrame(out, columns=["bus", "slot", "send_index", "action"]).astype({"send_index": "Int64"})


def reconcile_sends(roster: DataFrame, existing: DataFrame) -> DataFrame:
    """(bus, slot, send_index, action): reuse, fix or add for each roster row, and a stray (no slot) for each send left over.

    roster: (bus, slot, source, dst, width); existing: audio sends (bus, send_index, source, dst, width), an index being
    unique on its bus. Sources with one roster row, nearly all, are matched by a join and an aggregation; only the sends
    of sources with several, bounded by a bus's channels, are matched in turn by source.
    """
    wanted = roster.select(F.col("bus").cast("long").alias("bus"), F.col("slot").cast("long").alias("slot"), F.col("source").cast("long").alias("source"), F.col("dst").cast("long").alias("dst"), F.col("width").cast("long").alias("width"))
    sends = existing.select(*[F.col(c).cast("long").alias(c) for c in ("bus", "send_index", "source", "dst", "width")])
    counted = wanted.withColumn("rows", F.count("*").over(W.partitionBy("bus", "source")))
    lone, several = counted.where("rows = 1").drop("rows"), counted.where("rows > 1").drop("rows")
    other = sends.select("bus", "source", F.col("dst").alias("d"), F.col("width").alias("w"), "send_index")
    differs = ~((F.col("dst") == F.col("d")) & (F.col("width") == F.col("w")))
    best = lone.join(other, ["bus", "source"], "left").groupBy("bus", "slot").agg(F.min(F.when(F.col("send_index").isNotNull(), F.struct(differs.alias("differs"), "send_index"))).alias("best"))
    action = F.when(F.col("best").isNull(), "add").when(F.col("best.differs"), "fix").otherwise("reuse")
    quick = best.select("bus", "slot", F.col("best.send_index").alias("send_index"), action.alias("action"))
    theirs = sends.join(several.select("bus", "source").distinct(), ["bus", "source"], "left_semi")
    slow = several.groupBy("bus", "source").cogroup(theirs.groupBy("bus", "source")).applyInPandas(_greedy, "bus long, slot long, send_index long, action string")
    entries = quick.unionByName(slow)
    strays = sends.join(entries.where("send_index is not null").select("bus", "send_index"), ["bus", "send_index"], "left_anti")
    return entries.unionByName(strays.select("bus", F.lit(None).cast("long").alias("slot"), "send_index", F.lit("stray").alias("action")))


#: Objects of a master and channels of its renderer at most.
MOST_OBJECTS, MOST_CHANNELS = 118, 128


def inspect_sends(receives: DataFrame, buses: DataFrame, bus: str) -> DataFrame:
    """(bus, code, channel, count) of everything wrong with a renderer bus's receives (bus, dst, width, audio), one row each.

    buses: (bus, bed_width, expected, channels), null or 0 bed and null (or negative) expected objects where none are
    declared; buses without receives count. collision and gap name a channel from 0 and its uses; bed_missing,
    bed_width_mismatch and object_width the declared or actual width; over_118, over_128 and unrouted how many there are.
    Receives that are not audio, or have no first channel, do not count. Channels are counted in an exploded table, so a
    bus of any number of receives is spread over tasks until its channels are known."""
    wide = F.greatest(F.coalesce("width", F.lit(1)), F.lit(1))
    live = receives.where("coalesce(audio, true) AND dst >= 0").select(F.col(bus).alias("of"), "dst", F.coalesce("width", F.lit(1)).alias("width"), wide.alias("wide"))
    declared = buses.groupBy(F.col(bus).alias("of")).agg(F.coalesce(F.max("bed_width"), F.lit(0)).alias("bed"), F.coalesce(F.max("expected"), F.lit(-1)).alias("expected"))
    every = declared.unionByName(live.select("of").distinct().join(declared, "of", "left_anti").select("of", F.lit(0).alias("bed"), F.lit(-1).alias("expected")))
    met = live.join(every.withColumnRenamed("of", "o"), F.col("of").eqNullSafe(F.col("o")))
    bed_send = F.col("dst") == 0
    behind = F.col("dst") >= F.col("bed")
    sums = met.groupBy("of").agg(
        F.max(F.col("dst") + F.col("wide")).alias("top"),
        F.count_if(bed_send & (F.col("width") == F.col("bed"))).alias("right"),
        F.count_if(bed_send & (F.col("width") != 1)).alias("wrong"),
        F.count_if(behind & (F.col("width") == 1)).alias("objects"),
    )
    used = live.select("of", F.explode(F.sequence(F.col("dst"), F.col("dst") + F.col("wide") - 1)).alias("channel")).groupBy("of", "channel").agg(F.count("*").alias("uses"))
    row = lambda code, channel, count: F.struct(F.lit(code).alias("code"), channel.cast("int").alias("channel"), count.cast("long").alias("count"))
    none = F.lit(None)
    collisions = used.where("uses > 1").select("of", row("collision", F.col("channel"), F.col("uses")).alias("i"))
    spans = sums.select("of", F.explode(F.sequence(F.lit(0), F.col("top") - 1)).alias("channel"))
    gaps = spans.join(used.select(F.col("of").alias("o"), F.col("channel").alias("c")), F.col("of").eqNullSafe(F.col("o")) & (F.col("channel") == F.col("c")), "left_anti").select("of", row("gap", F.col("channel"), F.lit(0)).alias("i"))
    widths = met.where(behind & (F.col("width") != 1)).select("of", row("object_width", F.col("dst"), F.col("width")).alias("i"))
    whole = every.join(sums.withColumnRenamed("of", "o"), F.col("of").eqNullSafe(F.col("o")), "left").fillna(0, ["top", "right", "wrong", "objects"])
    missing = (F.col("bed") > 0) & (F.col("right") == 0)
    found = F.array(
        F.when(missing & (F.col("wrong") > 0), row("bed_width_mismatch", none, F.col("bed"))),
        F.when(missing & (F.col("wrong") == 0), row("bed_missing", none, F.col("bed"))),
        F.when(F.col("objects") > MOST_OBJECTS, row("over_118", none, F.col("objects"))),
        F.when(F.col("top") > MOST_CHANNELS, row("over_128", none, F.col("top"))),
        F.when((F.col("expected") >= 0) & (F.col("objects") < F.col("expected")), row("unrouted", none, F.col("expected") - F.col("objects"))),
    )
    single = whole.select("of", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i"))
    return collisions.union(gaps).union(widths).union(single).select(F.col("of").alias(bus), "i.*")
