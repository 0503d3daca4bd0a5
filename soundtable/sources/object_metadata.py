"""The metadata half of object-audio authoring: objects and their blocks as tables that a container writer takes in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundtable.functions.scalars import clamp, clamp_el, direction, wrap_az
from soundtable.operators.objects import fill_block_durations

#: Range of a divergence that names none, in degrees and in shares of a room; importances; samples of later ramps.
SPHERICAL_RANGE, ROOM_RANGE, IMPORTANCES, RAMP = 45.0, 0.5, (0, 10), 250


def object_table(objects: DataFrame, program: str) -> DataFrame:
    """(program, idx, name, cartesian, importance, width, height, depth, divergence, divergence_range) of each object.

    objects: (program, idx, name, cartesian, size, width, height, depth, divergence, divergence_range, importance). `size` sets
    all extents that are not given on their own; null extents are none where no other is given, else 0. A divergence is held to
    0 to 1 and has a range of its kind if it names none or one below 0; an importance is held to 0 to 10; null stays null."""
    given = F.coalesce("width", "height", "depth", "size").isNotNull()
    extent = lambda c: F.when(given, F.coalesce(c, "size", F.lit(0.0)))
    room = F.coalesce("cartesian", F.lit(False))
    own = F.when(F.col("divergence_range") >= 0, F.col("divergence_range"))
    spread = F.when(F.col("divergence").isNotNull(), F.coalesce(own, F.when(room, ROOM_RANGE).otherwise(SPHERICAL_RANGE)))
    divergence = F.when(F.col("divergence").isNotNull(), clamp(F.col("divergence"), 0.0, 1.0))
    importance = F.when(F.col("importance").isNotNull(), F.greatest(F.least("importance", F.lit(IMPORTANCES[1])), F.lit(IMPORTANCES[0])))
    return objects.select(program, "idx", F.coalesce("name", F.lit("")).alias("name"), room.alias("cartesian"), importance.alias("importance"), *[extent(c).alias(c) for c in ("width", "height", "depth")], divergence.alias("divergence"), spread.alias("divergence_range"))


def block_table(objects: DataFrame, blocks: DataFrame, program: str, end: float, rate: int = 48000, profile: bool = False) -> DataFrame:
    """(program, object, block, rtime, duration, az, el, dist, x, y, z, gain, jump, interpolation) of each object's blocks in order.

    objects: object_table's rows; blocks: (program, object, rtime, duration, az, el, dist, gain, jump). Spherical objects have an
    azimuth in (-180, 180], an elevation in -90 to 90 and a distance not below 0, cartesian ones right, front and up, held to -1
    to 1 under the profile. Missing durations reach to the next block, the last one's to `end`. Under the profile every block
    jumps with a ramp: 0 seconds on the first, RAMP samples on the later ones; else a null flag is no jump. A null distance or
    gain is 1. Blocks of no object are left out; an object without blocks has one in front, as long as the program."""
    keys = [program, "object"]
    named = objects.select(F.col(program).alias("__p"), F.col("idx").alias("__o"), "cartesian")
    met = named.join(blocks.where("rtime IS NOT NULL"), (F.col(program) == F.col("__p")) & (F.col("object") == F.col("__o")), "left")
    whole = met.select(F.col("__p").alias(program), F.col("__o").alias("object"), "cartesian", F.coalesce("rtime", F.lit(0.0)).alias("rtime"), "duration", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("az", 0.0), ("el", 0.0), ("dist", 1.0), ("gain", 1.0))], F.coalesce("jump", F.lit(False)).alias("jump"))
    order = ["rtime", "az", "el", "dist"]
    filled = fill_block_durations(whole, keys, order, F.lit(float(end))).drop("reach")
    number = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    room = F.col("cartesian")
    places = [c * F.col("dist") for c in direction(F.col("az"), F.col("el"))]
    places = [F.when(room, clamp(c, -1.0, 1.0) if profile else c).alias(n) for n, c in zip("xyz", places, strict=True)]
    out = filled.withColumn("block", number)
    interpolation = F.when(F.col("block") == 0, 0.0).otherwise(RAMP / rate) if profile else F.lit(None).cast("double")
    spherical = [F.when(~room, c).alias(n) for n, c in (("az", wrap_az(F.col("az"))), ("el", clamp_el(F.col("el"))), ("dist", F.greatest("dist", F.lit(0.0))))]
    return out.select(*keys, "block", "rtime", "duration", *spherical, *places, "gain", (F.lit(True) if profile else F.col("jump")).alias("jump"), interpolation.alias("interpolation"))


def write_object_metadata(objects: DataFrame, blocks: DataFrame, program: str, folder: str, end: float, rate: int = 48000, profile: bool = False) -> None:
    """Writes object_table and block_table as Parquet to `folder`/objects and `folder`/blocks, over what is there."""
    table = object_table(objects, program)
    table.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/objects")
    block_table(table, blocks, program, end, rate, profile).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/blocks")
