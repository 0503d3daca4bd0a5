"""Session tables of many projects as they are read out: one Parquet folder for each table, or rows of any other origin.

Each function takes a table as the host keeps it (`project` and what is named below; missing columns read as null) and
gives the columns of its list. Nothing is gathered by project; filters on project and track reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundtable.functions.scalars import cc_type, cc_value, gain_to_db

#: Columns of each stored table.
TABLES = {
    "tracks": "project long, idx int, guid string, name string, volume double, pan double, width double, channels int, mute int, solo int, phase int, rec_arm int, folder int, depth int",
    "items": "project long, track int, idx int, guid string, position double, length double, take int",
    "takes": "project long, track int, item int, idx int, name string",
    "notes": "project long, take string, idx int, start double, length double, pitch int, velocity int, channel int, selected boolean, muted boolean",
    "cc": "project long, take string, idx int, at double, status int, msg2 int, msg3 int, selected boolean, muted boolean",
    "points": "project long, track int, envelope string, idx int, time double, value double, shape int, tension double, selected boolean",
    "sends": "project long, track int, category int, idx int, other int, volume double, pan double, mute int",
    "markers": "project long, idx int, region boolean, number int, name string, position double, end double, color int",
    "tempo": "project long, idx int, time double, bpm double, num int, den int, linear boolean",
    "fx": "project long, track int, fx int, name string, enabled boolean, preset string",
    "params": "project long, track int, fx int, param int, name string, value double, low double, high double",
}
#: Categories of sends, and the meter of a marker that names none.
CATEGORIES = {-1: "receive", 0: "send", 1: "hardware"}
METER = (4, 4)


def session_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table with all its columns: those that its files lack are null, others are left out. A table that is not there is empty."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(path)


def _column(rows: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def _flag(rows: DataFrame, name: str) -> Column:
    """A number or boolean as true where it is not zero; null is false."""
    return F.coalesce(_column(rows, name, "int") != 0, F.lit(False)).alias(name)


def track_list(tracks: DataFrame) -> DataFrame:
    """(project, idx, guid, name, vol_db, pan, width, channels, mute, solo, phase, rec_arm, folder, depth); a null name is empty,
    a null volume full, a null pan the middle. Row -1 is the master."""
    volume = F.coalesce(_column(tracks, "volume", "double"), F.lit(1.0))
    return tracks.select("project", "idx", _column(tracks, "guid", "string").alias("guid"), F.coalesce("name", F.lit("")).alias("name"), gain_to_db(volume).alias("vol_db"), F.coalesce(_column(tracks, "pan", "double"), F.lit(0.0)).alias("pan"), F.coalesce(_column(tracks, "width", "double"), F.lit(1.0)).alias("width"), F.coalesce(_column(tracks, "channels", "int"), F.lit(2)).alias("channels"), *[_flag(tracks, c) for c in ("mute", "solo", "phase", "rec_arm")], _column(tracks, "folder", "int").alias("folder"), F.coalesce(_column(tracks, "depth", "int"), F.lit(0)).alias("depth"))


def master_rows(tracks: DataFrame) -> DataFrame:
    return track_list(tracks).where("idx = -1")


def item_list(items: DataFrame) -> DataFrame:
    """(project, track, idx, position, length, end, guid)."""
    return items.select("project", "track", "idx", "position", "length", (F.col("position") + F.col("length")).alias("end"), _column(items, "guid", "string").alias("guid"))


def take_list(takes: DataFrame, items: DataFrame) -> DataFrame:
    """(project, track, item, idx, name, active): the active take is the one that its item names (items: project, track, idx, take),
    the first where it names none."""
    of = items.select(F.col("project").alias("__p"), F.col("track").alias("__t"), F.col("idx").alias("__i"), F.coalesce("take", F.lit(0)).alias("__take"))
    met = takes.join(of, (F.col("project") == F.col("__p")) & (F.col("track") == F.col("__t")) & (F.col("item") == F.col("__i")), "left")
    return met.select("project", "track", "item", "idx", F.coalesce("name", F.lit("")).alias("name"), (F.col("idx") == F.coalesce("__take", F.lit(0))).alias("active"))


def note_list(notes: DataFrame, tempo: DataFrame) -> DataFrame:
    """(project, take, idx, start, length, start_time, pitch, velocity, channel, selected, muted): beats, and where the start is in
    seconds through the project's tempo map (see notes.qn_to_time). A null flag is false."""
    from soundtable.operators.notes import qn_to_time

    rows = notes.select("project", "take", "idx", "start", "length", "pitch", "velocity", F.coalesce("channel", F.lit(0)).alias("channel"), *[F.coalesce(_column(notes, c, "boolean"), F.lit(False)).alias(c) for c in ("selected", "muted")])
    return qn_to_time(rows, tempo, "project", "start").withColumnRenamed("time", "start_time")


def cc_list(cc: DataFrame) -> DataFrame:
    """(project, take, idx, at, type, channel, number, value): the kind by the upper half of the status byte, its channel by the lower."""
    status = F.col("status")
    number = F.when(status.bitwiseAND(240).isin(160, 176), F.col("msg2"))
    return cc.select("project", "take", "idx", "at", cc_type(status).alias("type"), status.bitwiseAND(15).alias("channel"), number.alias("number"), cc_value(status, F.col("msg2"), F.col("msg3")).alias("value"))


def envelope_list(points: DataFrame) -> DataFrame:
    """(project, track, envelope, points, first, last): how many points an envelope has, and its span."""
    return points.groupBy("project", "track", "envelope").agg(F.count("*").alias("points"), F.min("time").alias("first"), F.max("time").alias("last"))


def point_list(points: DataFrame) -> DataFrame:
    """(project, track, envelope, idx, time, value, shape, tension, selected): shapes lie in 0 to 5, others and null are 0."""
    shape = F.when(F.col("shape").between(0, 5), F.col("shape")).otherwise(0)
    return points.select("project", "track", "envelope", "idx", "time", "value", shape.alias("shape"), F.coalesce("tension", F.lit(0.0)).alias("tension"), F.coalesce("selected", F.lit(False)).alias("selected"))


def send_list(sends: DataFrame, category: str | None = None) -> DataFrame:
    """(project, track, category, idx, other, vol_db, pan, mute) of receives, sends and hardware outputs, or of one of them; rows
    of no known category are left out."""
    kind = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])[F.col("category")]
    rows = sends.withColumn("kind", kind).where("kind IS NOT NULL")
    rows = rows if category is None else rows.where(F.col("kind") == category)
    return rows.select("project", "track", F.col("kind").alias("category"), "idx", "other", gain_to_db(F.coalesce("volume", F.lit(1.0))).alias("vol_db"), F.coalesce("pan", F.lit(0.0)).alias("pan"), _flag(rows, "mute"))


def marker_list(markers: DataFrame, regions: bool | None = None) -> DataFrame:
    """(project, idx, region, number, name, position, end): markers end where they are; regions alone, or markers, if asked for."""
    region = F.coalesce("region", F.lit(False))
    rows = markers if regions is None else markers.where(region == regions)
    return rows.select("project", "idx", region.alias("region"), "number", F.coalesce("name", F.lit("")).alias("name"), "position", F.when(region, F.coalesce("end", "position")).otherwise(F.col("position")).alias("end"))


def tempo_list(tempo: DataFrame) -> DataFrame:
    """(project, idx, time, bpm, num, den, linear): a marker that names no meter has METER."""
    named = (F.col("num") > 0) & (F.col("den") > 0)
    meter = [F.when(named, F.col(c)).otherwise(v).alias(c) for c, v in zip(("num", "den"), METER, strict=True)]
    return tempo.select("project", "idx", "time", "bpm", *meter, F.coalesce("linear", F.lit(False)).alias("linear"))


def param_list(params: DataFrame, fx: DataFrame) -> DataFrame:
    """(project, track, fx, fx_name, enabled, param, name, value, normalized, shown): where a value lies between its bounds, clamped
    (0 where they do not part), and as text with two decimals. A parameter of no plug-in row keeps null names."""
    of = fx.select(F.col("project").alias("__p"), F.col("track").alias("__t"), F.col("fx").alias("__f"), F.col("name").alias("fx_name"), F.coalesce("enabled", F.lit(True)).alias("enabled"))
    met = params.join(of, (F.col("project") == F.col("__p")) & (F.col("track") == F.col("__t")) & (F.col("fx") == F.col("__f")), "left")
    share = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return met.select("project", "track", "fx", "fx_name", "enabled", "param", "name", "value", F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)).alias("normalized"), F.format_string("%.2f", "value").alias("shown"))
