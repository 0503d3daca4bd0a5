"""Masters of three files: a manifest, an event list and the samples; written as documents, read as tables."""

from __future__ import annotations

import struct
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundtable.functions.scalars import adm_to_room, fmt_num, half_away, xml_escape
from soundtable.sources.documents import write_documents
from soundtable.sources.files import opened

#: What follows the base name of a master's files.
MANIFEST, METADATA, AUDIO = ".atmos", ".atmos.metadata", ".atmos.audio"
HEAD = ("version:", "  major: 1", "  minor: 0", "  revision: 0")
ESSENCE = "path string, format string, channels int, bits int, rate double, is_float boolean, little_endian boolean, frames long, error string"


def number(x: Column) -> Column:
    """A coordinate as text, no minus before zero."""
    return fmt_num(F.when(F.abs(x) < 5e-7, 0.0).otherwise(x))


def master_events(beds: DataFrame, objects: DataFrame, blocks: DataFrame, program: str, rate: int = 48000) -> DataFrame:
    """(program, id, sample, x, y, z) of each event: one for each bed channel (no position), one for each block of an object
    (rtime, az, el, dist) where it is in the room, one in front for an object without blocks.

    beds and objects: (program, idx, ...), counted from 0 in the order of idx; ids go from 1, beds first."""
    bed_ids, object_ids = input_ids(beds, objects, program)
    none = F.lit(None).cast("double")
    still = bed_ids.select(program, "id", F.lit(0).cast("long").alias("sample"), none.alias("x"), none.alias("y"), none.alias("z"))
    x, y, z = adm_to_room(F.col("az"), F.col("el"), F.coalesce("dist", F.lit(1.0)))
    front = F.col("rtime").isNull()
    own = blocks.where("rtime IS NOT NULL").select(F.col(program).alias("__p"), F.col("object").alias("__o"), "rtime", "az", "el", "dist")
    met = object_ids.join(own, (F.col(program) == F.col("__p")) & (F.col("idx") == F.col("__o")), "left")
    moving = met.select(program, "id", F.when(front, 0).otherwise(half_away(F.col("rtime") * rate)).cast("long").alias("sample"), F.when(front, 0.0).otherwise(x).alias("x"), F.when(front, 1.0).otherwise(y).alias("y"), F.when(front, 0.0).otherwise(z).alias("z"))
    return still.union(moving)


def input_ids(beds: DataFrame, objects: DataFrame, program: str) -> tuple[DataFrame, DataFrame]:
    """beds and objects with `id`, the number of their input channel: from 1, beds first. Counted by a window of a program."""
    rank = F.row_number().over(W.partitionBy(program).orderBy("idx"))
    widths = beds.groupBy(program).agg(F.count("*").alias("__n")).withColumnRenamed(program, "__of")
    bed_ids = beds.withColumn("id", rank)
    object_ids = objects.withColumn("__rank", rank).join(widths, F.col(program) == F.col("__of"), "left").withColumn("id", (F.col("__rank") + F.coalesce("__n", F.lit(0))).cast("int"))
    return bed_ids, object_ids.drop("__rank", "__of", "__n")


def metadata_lines(events: DataFrame, program: str, rate: int = 48000) -> DataFrame:
    """(name, id, sample, line): the lines of each program's event list; its head has the ids -8 and up."""
    place = F.concat(F.lit(", pos: ["), number(F.col("x")), F.lit(", "), number(F.col("y")), F.lit(", "), number(F.col("z")), F.lit("]"))
    said = F.concat(F.lit("- {ID: "), "id", F.lit(", samplePos: "), "sample", F.lit(", active: true"), F.when(F.col("x").isNotNull(), place).otherwise(""), F.lit("}"))
    name = F.concat(F.col(program).cast("string"), F.lit(METADATA)).alias("name")
    head = (*HEAD, f"sampleRate: {rate}", "events:")
    heads = events.select(name).distinct().select("name", F.posexplode(F.array(*map(F.lit, head))).alias("at", "line")).select("name", (F.col("at") - 8).cast("int").alias("id"), F.lit(0).cast("long").alias("sample"), "line")
    return heads.union(events.select(name, F.col("id").cast("int"), "sample", said.alias("line")))


def manifest_lines(beds: DataFrame, objects: DataFrame, program: str) -> DataFrame:
    """(name, part, id, line): the lines of each program's manifest, its roster of bed channels (label) and objects (name)."""
    bed_ids, object_ids = input_ids(beds, objects, program)
    key = F.col(program).cast("string")
    name = F.concat(key, F.lit(MANIFEST)).alias("name")
    programs = beds.select(program).union(objects.select(program)).distinct()
    head = F.array(*map(F.lit, (*HEAD, "presentations:", "- type: home", "  simplified: false")), F.concat(F.lit("metadata: "), key, F.lit(METADATA)), F.concat(F.lit("audio: "), key, F.lit(AUDIO)))
    heads = programs.select(name, F.posexplode(head).alias("id", "line")).select("name", F.lit(0).alias("part"), "id", "line")
    titled = lambda rows, part, *lines: rows.select(name).distinct().select("name", F.lit(part).alias("part"), F.posexplode(F.array(*map(F.lit, lines))).alias("id", "line"))
    channel = F.concat(F.lit("  - {channel: "), F.coalesce("label", F.lit("")), F.lit(", ID: "), "id", F.lit("}"))
    entry = F.concat(F.lit("- {ID: "), "id", F.lit(', name: "'), xml_escape(F.coalesce("name", F.lit(""))), F.lit('"}'))
    return heads.union(titled(beds, 1, "bedInstances:", "- channels:")).union(bed_ids.select(name, F.lit(2), "id", channel)).union(titled(objects, 3, "objects:")).union(object_ids.select(name, F.lit(4), "id", entry))


def write_masters(beds: DataFrame, objects: DataFrame, blocks: DataFrame, program: str, folder: str, rate: int = 48000) -> None:
    """Writes the manifest and the event list of each program to `folder`, see write_documents: the same rows, the same bytes."""
    write_documents(metadata_lines(master_events(beds, objects, blocks, program, rate), program, rate), folder, "name", ["id", "sample", "line"])
    write_documents(manifest_lines(beds, objects, program), folder, "name", ["part", "id", "line"])


# ---- reading


def essence(source: BinaryIO, length: int) -> dict:
    """The description of a CAF file, samples passed over. A ValueError says why it is none."""

    def read(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    if read(0, 4) != b"caff" or length < 8:
        raise ValueError("not_caf")
    out, at, data, packet, per = {}, 8, None, 0, 1
    while at + 12 <= length:
        name, size = struct.unpack(">4sq", read(at, 12))
        at += 12
        if name == b"desc" and at + 32 <= length:
            rate, kind, flags, packet, per, channels, bits = struct.unpack(">d4sIIIII", read(at, 32))
            out = {"format": kind.decode("latin-1"), "channels": channels, "bits": bits, "rate": rate, "is_float": bool(flags & 1), "little_endian": bool(flags & 2)}
        elif name == b"data":
            data = size - 4 if size >= 4 else length - at - 4 if size < 0 else 0
        if size < 0:
            break
        at += size
    if not out:
        raise ValueError("no_desc_chunk")
    out["frames"] = max(0, data or 0) // packet * max(per, 1) if packet else 0
    return out


def _essences(spark: SparkSession, path: str) -> DataFrame:
    types = pa.schema([("path", pa.string()), ("format", pa.string()), ("channels", pa.int32()), ("bits", pa.int32()), ("rate", pa.float64()), ("is_float", pa.bool_()), ("little_endian", pa.bool_()), ("frames", pa.int64()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with opened(name) as source:
                        rows.append({"path": name, **essence(source, length)})
                except (ValueError, OSError, struct.error) as why:
                    rows.append({"path": name, "error": str(why)})
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{AUDIO}").load(path)
    return files.select("path", "length").mapInArrow(run, ESSENCE)


def _lines(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(path)
    return text.select(F.regexp_replace(F.col("_metadata.file_path"), r"\Q" + suffix + r"\E$", "").alias("master"), F.rtrim("value").alias("line"))


def _field(name: str) -> Column:
    return F.regexp_extract("line", name + r":\s*([^,}\s\[]+)", 1)


def read_damf_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Masters and events under `path`: (master, is_damf, bed_instances, bed_channels, objects, metadata_rate, events, format,
    channels, bits, rate, is_float, little_endian, frames, warnings) and (master, id, sample, active, x, y, z).

    A master is what files of one base name say. Texts are read as lines by any number of tasks, so an event list may be of
    any size; of the samples only the description is read. A missing or unreadable part is a warning; so are a channel
    count that is not the roster's, and little-endian samples. Lines that do not read are no events."""
    begins = lambda text: F.count_if(F.startswith("line", F.lit(text)))
    roster = _lines(spark, path, MANIFEST).groupBy("master").agg(begins("bedInstances:").alias("bed_instances"), begins("  - {channel:").alias("bed_channels"), begins("- {ID:").alias("objects"))
    said = _lines(spark, path, METADATA)
    rate = F.max(F.when(F.startswith("line", F.lit("sampleRate:")), F.regexp_extract("line", r"^sampleRate:\s*(\d+)", 1).try_cast("int")))
    lists = said.groupBy("master").agg(rate.alias("metadata_rate"), begins("- {ID:").alias("events"))
    sound = _essences(spark, path).withColumn("master", F.regexp_replace("path", r"\Q" + AUDIO + r"\E$", "")).drop("path")
    sides = [(roster, "__manifest"), (lists, "__metadata"), (sound, "__audio")]
    whole = None
    for side, mark in sides:
        side = side.withColumn(mark, F.lit(True))
        whole = side if whole is None else whole.join(side, "master", "full")
    n = F.coalesce("bed_channels", F.lit(0)) + F.coalesce("objects", F.lit(0))
    ok = F.col("__audio").isNotNull() & F.col("error").isNull()
    warnings = F.array(
        *[F.when(F.col(mark).isNull(), f"missing {mark[2:]}") for _, mark in sides],
        F.when(F.col("error").isNotNull(), F.concat(F.lit("audio: "), "error")),
        F.when(ok & (n > 0) & (F.col("channels") != n), F.concat(F.lit("channels "), "channels", F.lit(", roster "), n)),
        F.when(ok & F.col("little_endian"), "little-endian samples"),
    )
    masters = whole.select("master", (ok & (n > 0)).alias("is_damf"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bed_instances", "bed_channels", "objects")], "metadata_rate", F.coalesce("events", F.lit(0)).alias("events"), "format", "channels", "bits", "rate", "is_float", "little_endian", "frames", F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"))
    place = F.split(F.regexp_extract("line", r"pos:\s*\[([^\]]*)\]", 1), r"\s*,\s*")
    at = lambda i: F.get(place, F.lit(i)).try_cast("double")
    events = said.where("startswith(line, '- {ID:')").select("master", _field("ID").try_cast("int").alias("id"), _field("samplePos").try_cast("long").alias("sample"), (_field("active") == "true").alias("active"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    return masters, events.where("id IS NOT NULL")
