"""What the fields of session tables take from an edit log: rules for `session.apply_edits`.

Each rule reads the string `value` of an edit; what is outside its range or does not read is null, and the row stays as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER, _WHOLE = "try_cast(value as double)", "try_cast(value as int)"


def number(low: float | None = None, high: float | None = None) -> Column:
    """A finite number within the limits."""
    x = F.expr(_NUMBER)
    fits = ~F.isnan(x) & (F.abs(x) < float("inf"))
    for bound, on in ((low, x >= F.lit(low)), (high, x <= F.lit(high))):
        fits = fits if bound is None else fits & on
    return F.when(fits, x)


def whole(low: int | None = None, high: int | None = None) -> Column:
    x, fits = F.expr(_WHOLE), F.lit(True)
    for bound, on in ((low, x >= F.lit(low)), (high, x <= F.lit(high))):
        fits = fits if bound is None else fits & on
    return F.when(fits, x)


def one_of(*values: int) -> Column:
    return F.when(F.expr(_WHOLE).isin(*values), F.expr(_WHOLE))


def flag() -> Column:
    return F.expr("try_cast(value as boolean)")


def text() -> Column:
    return F.col("value")


def send_fields() -> dict[str, Column]:
    """Sends, receives and hardware outputs; mode 0 is after the fader, 1 before effects, 3 after effects."""
    return {"vol_db": number(), "pan": number(-1, 1), "muted": flag(), "phase": flag(), "mode": one_of(0, 1, 3)}


def marker_fields() -> dict[str, Column]:
    """Markers and regions; see `ends` for what an edit of a marker's position does to its end."""
    return {"name": text(), "position": number(), "end": number(), "color": whole(0, 0xFFFFFF)}


def ends(position: Column, end: Column, region: Column) -> Column:
    """The end of a region; a marker ends where it is."""
    return F.when(region, end).otherwise(position)


def tempo_fields() -> dict[str, Column]:
    return {"bpm": number(1, 960), "beats": whole(1), "unit": whole(1), "linear": flag()}


def item_fields() -> dict[str, Column]:
    return {"position": number(0), "length": number(0), "muted": flag(), "vol_db": number(), "fade_in": number(0), "fade_out": number(0), "color": whole(0, 0xFFFFFF), "track": whole(0)}


def point_fields() -> dict[str, Column]:
    """Points of an envelope; shapes 0 to 5."""
    return {"time": number(), "value": number(), "shape": whole(0, 5), "tension": number(-1, 1)}


def note_fields() -> dict[str, Column]:
    return {"start": number(0), "length": number(0), "pitch": whole(0, 127), "velocity": whole(1, 127), "channel": whole(0, 15), "muted": flag()}


def track_fields() -> dict[str, Column]:
    """Tracks; widths are held to 2 to 128 and made even, not refused."""
    width = F.expr(_WHOLE)
    held = F.when(width.isNotNull(), F.greatest(F.least(width, F.lit(128)), F.lit(2)))
    return {"name": text(), "vol_db": number(), "pan": number(-1, 1), "width": number(-1, 1), "muted": flag(), "solo": whole(0, 2), "phase": flag(), "rec_arm": flag(), "rec_mode": whole(0), "color": whole(0, 0xFFFFFF), "folder": whole(-1, 1), "channels": held + held % 2}


def take_fields() -> dict[str, Column]:
    """Takes; a play rate is above zero."""
    rate = number()
    return {"name": text(), "vol_db": number(), "pan": number(-1, 1), "pitch": number(), "rate": F.when(rate > 0, rate)}


def cc_fields() -> dict[str, Column]:
    return {"at": number(0), "status": whole(128, 239), "msg2": whole(0, 127), "msg3": whole(0, 127), "muted": flag()}


def automation_fields() -> dict[str, Column]:
    """The automation mode of a track: 0 trim, 1 read, 2 touch, 3 write, 4 latch."""
    return {"mode": whole(0, 4)}


def fx_fields() -> dict[str, Column]:
    """A plug-in's parameter by its normalised value, and whether the plug-in is on."""
    return {"value": number(0, 1), "enabled": flag()}


# ---- rows that edits make


def insert_notes(requests: DataFrame) -> DataFrame:
    """requests (start, pitch, length, velocity, channel, ...) with `error`: null, or the first bound that a note is out of.

    Missing lengths are 1, velocities 96, channels 0; a missing start or pitch is an error. Nothing is inserted for a row with one."""
    filled = requests.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("length", 1.0), ("velocity", 96), ("channel", 0))})
    fits = lambda c, low, high: F.coalesce(F.col(c).between(low, high), F.lit(False))
    long = F.coalesce((F.col("length") > 0) & ~F.isnan(F.col("length").cast("double")), F.lit(False))
    error = F.when(~F.coalesce((F.col("start") >= 0) & ~F.isnan(F.col("start").cast("double")), F.lit(False)), "start").when(~long, "length").when(~fits("pitch", 0, 127), "pitch").when(~fits("velocity", 1, 127), "velocity").when(~fits("channel", 0, 15), "channel")
    return filled.withColumn("error", error)


def duplicate_items(items: DataFrame, copies: DataFrame, key: str) -> DataFrame:
    """items with `copy` 0, and for each of copies (key, copies, gap) so many more behind it, a length and `gap` apart, from 1 on.

    A count that is null or below one copies nothing, a null gap is none; items that copies does not name stay single."""
    asked = copies.groupBy(F.col(key).alias("__of")).agg(F.max("copies").alias("__n"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("__gap"))
    met = items.join(asked, F.col(key) == F.col("__of"), "left")
    out = met.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("__n", F.lit(0)), F.lit(0)).cast("int"))))
    return out.withColumn("position", F.col("position") + F.coalesce(F.col("copy") * (F.col("length") + F.col("__gap")), F.lit(0.0))).drop("__of", "__n", "__gap")


def crop_to_active(takes: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """takes (keys, idx, ...) without those that are not active in an item that `items` (keys, take) crops; what stays there is take 0."""
    crops = items.select(*[F.col(k).alias(f"__{k}") for k in keys], F.coalesce("take", F.lit(0)).alias("__take"))
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = one if on is None else on & one
    met = takes.join(crops, on, "left").where(F.col("__take").isNull() | (F.col("idx") == F.col("__take")))
    return met.withColumn("idx", F.when(F.col("__take").isNull(), F.col("idx")).otherwise(0)).drop("__take", *[f"__{k}" for k in keys])
