"""Object-audio WAVE files (RIFF, RF64, BW64): their chunks and metadata as tables, samples left unread."""

from __future__ import annotations

import decimal
import struct
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundtable.sources.files import opened

FILES = """path string, container string, is_adm boolean, channels int, rate long, bits int, frames long,
    chunks array<struct<id: string, size: decimal(20,0)>>, tracks int,
    uids array<struct<track_index: int, uid: string, track_ref: string, pack_ref: string>>, axml string, warnings array<string>, error string"""

#: Fixed values of the format: the size that stands for one in ds64, and the bytes of one entry of chna.
ELSEWHERE, ENTRY = 0xFFFFFFFF, 40
#: Channel formats of a file that are listed, and bytes of a metadata chunk that are read at most.
LISTED, LARGEST = 256, 1 << 30


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def _tracks(body: bytes) -> tuple[int, list[dict]]:
    tracks, count = struct.unpack_from("<HH", body)
    found = []
    for at in range(4, min(len(body) - ENTRY, 4 + (count - 1) * ENTRY) + 1, ENTRY):
        index, uid, track, pack = struct.unpack_from("<H12s14s11s", body, at)
        found.append({"track_index": index, "uid": _text(uid), "track_ref": _text(track), "pack_ref": _text(pack)})
    return tracks, found


def walk(source: BinaryIO, length: int) -> dict:
    """What the chunks of a file say. Headers and metadata are read where they lie; the samples are passed over.

    A chunk that reaches beyond the file is taken as far as the file goes, and ends the walk. A ValueError says why a file
    is none of the formats."""

    def read(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    head = read(0, 12)
    if len(head) < 12:
        raise ValueError("too_small")
    if head[:4] not in (b"RIFF", b"RF64", b"BW64"):
        raise ValueError("not_riff")
    if head[8:] != b"WAVE":
        raise ValueError("not_wave")
    wide = head[:4] != b"RIFF"
    out: dict = {"container": "BW64" if wide else "RIFF/WAVE", "channels": 0, "rate": 0, "bits": 0, "chunks": [], "tracks": None, "uids": [], "axml": None}
    seen, at, data, data64 = set(), 12, 0, 0
    while at + 8 <= length:
        raw, size = struct.unpack("<4sI", read(at, 8))
        name, at = raw.decode("latin-1"), at + 8
        if wide and size == ELSEWHERE and name == "data":
            size = data64
        out["chunks"].append({"id": name, "size": size})
        seen.add(name)
        if name == "ds64":
            data64 = struct.unpack_from("<Q", read(at + 8, 8).ljust(8, b"\0"))[0]
        elif name == "fmt ":
            form = read(at, 16).ljust(16, b"\0")
            _, out["channels"], out["rate"], _, _, out["bits"] = struct.unpack("<HHIIHH", form)
        elif name in ("chna", "axml"):
            body = read(at, min(size, length - at, LARGEST))
            if name == "axml":
                out["axml"] = body.decode("utf-8", "replace")
            elif len(body) >= 4:
                out["tracks"], out["uids"] = _tracks(body)
        elif name == "data":
            data = size
        at += size + size % 2
    frame = out["channels"] * (out["bits"] // 8)
    out["frames"] = data // frame if frame else 0
    out["is_adm"] = {"chna", "axml"} <= seen
    wanted = {"fmt ": "missing fmt chunk", "data": "missing data chunk", "chna": "missing chna chunk", "axml": "missing axml chunk"}
    out["warnings"] = [said for name, said in wanted.items() if name not in seen]
    if "fmt " in seen and out["tracks"] is not None and out["tracks"] != out["channels"]:
        out["warnings"].append("chna tracks differ from fmt channels")
    return out


def read_adm_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file under `path` (files, folders or patterns), see FILES.

    Spark lists the files; tasks read chunk headers, `fmt `, `chna` and `axml` by ranged reads, so a file of any size costs
    its metadata. A file that is none of the formats, or cannot be opened, gives a row with path and `error` alone and fails
    no job; one that is cut short gives what its beginning says, with warnings for what is missing. An `axml` of no text is
    an empty string. A file of no bytes has no row, as Spark passes over it; no file gives none.
    """
    schema = spark.createDataFrame([], FILES).schema

    def run(batches):
        for batch in batches:
            rows = []
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with opened(name) as source:
                        rows.append({"path": name, **walk(source, length)})
                except (ValueError, OSError, struct.error) as why:
                    rows.append({"path": name, "error": str(why)})
                if len(rows) == 64:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length").mapInArrow(run, schema)


_TYPES = pa.schema([
    ("path", pa.string()), ("container", pa.string()), ("is_adm", pa.bool_()), ("channels", pa.int32()), ("rate", pa.int64()), ("bits", pa.int32()), ("frames", pa.int64()),
    ("chunks", pa.list_(pa.struct([("id", pa.string()), ("size", pa.decimal128(20, 0))]))), ("tracks", pa.int32()),
    ("uids", pa.list_(pa.struct([("track_index", pa.int32()), ("uid", pa.string()), ("track_ref", pa.string()), ("pack_ref", pa.string())]))),
    ("axml", pa.string()), ("warnings", pa.list_(pa.string())), ("error", pa.string()),
])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    for row in rows:
        for chunk in row.get("chunks") or ():
            chunk["size"] = decimal.Decimal(chunk["size"])
    return pa.RecordBatch.from_pylist(rows, schema=_TYPES)


# ---- the metadata as tables


def track_uids(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, track_index, uid, track_ref, pack_ref) of each entry of `chna`."""
    return files.select(key, F.inline("uids"))


def file_chunks(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, chunk_no, id, size) of each chunk in file order."""
    return files.select(key, F.posexplode("chunks").alias("chunk_no", "c")).select(key, "chunk_no", "c.id", "c.size")


def attribute(text: Column, name: str) -> Column:
    """All values of an XML attribute, by literal text match: name="value"."""
    return F.regexp_extract_all(text, F.lit(f'{name}="([^"]*)"'), F.lit(1))


def elements(text: Column, name: str) -> Column:
    """All texts of elements without attributes."""
    return F.regexp_extract_all(text, F.lit(f"(?s)<{name}>(.*?)</{name}>"), F.lit(1))


def occurrences(text: Column, literal: str) -> Column:
    return F.regexp_count(text, F.lit(r"\Q" + literal + r"\E")).cast("int")


def _channel_formats(axml: Column) -> Column:
    return F.regexp_extract_all(axml, F.lit("(?s)<audioChannelFormat (.*?)</audioChannelFormat>"), F.lit(1))


def channel_formats(files: DataFrame, key: str = "path", listed: int = LISTED) -> DataFrame:
    """(key, channel_no, name, type, blocks, speaker, coordinate) of the first `listed` channel formats that a file defines."""
    each = files.select(key, F.posexplode(F.slice(_channel_formats(F.col("axml")), 1, listed)).alias("channel_no", "cf"))
    cf = F.col("cf")
    first = lambda found: F.coalesce(F.get(found, F.lit(0)), F.lit(""))
    coordinate = F.when(cf.contains("<cartesian>1</cartesian>"), "cartesian").when(cf.contains('coordinate="azimuth"'), "spherical").otherwise("none")
    return each.select(key, "channel_no", first(attribute(cf, "audioChannelFormatName")).alias("name"), first(attribute(cf, "typeDefinition")).alias("type"), occurrences(cf, "<audioBlockFormat").alias("blocks"), first(elements(cf, "speakerLabel")).alias("speaker"), coordinate.alias("coordinate"))


def metadata_counts(files: DataFrame, key: str = "path") -> DataFrame:
    """Counts and flags of a file's `axml`, by literal text match; a file without text has no row."""
    x = F.col("axml")
    version = F.regexp_extract(F.regexp_extract(x, r"(?s)<audioFormatExtended([^>]*)>", 1), r'version="([^"]*)"', 1)
    importance = F.filter(F.transform(attribute(x, "importance"), lambda v: F.regexp_extract(v, r"^\s*([+-]?\d+)", 1).try_cast("int")), lambda v: v.isNotNull())
    first = lambda found: F.coalesce(F.get(found, F.lit(0)), F.lit(""))
    counted = {"objects": "<audioObject ", "packs": "<audioPackFormat ", "channel_formats": "<audioChannelFormat ", "blocks": "<audioBlockFormat ", "uids_defined": "<audioTrackUID ", "extent_blocks": "<width>", "divergence_blocks": "<objectDivergence", "programmes": "<audioProgramme "}
    return files.where(F.length("axml") > 0).select(
        key,
        *[occurrences(x, literal).alias(name) for name, literal in counted.items()],
        F.when(x.contains("<cartesian>1</cartesian>"), "cartesian").otherwise("spherical").alias("coordinates"),
        x.contains("DirectSpeakers").alias("has_beds"),
        x.contains('typeDefinition="Objects"').alias("has_objects"),
        x.contains(' importance="').alias("has_importance"),
        importance.alias("importance"),
        attribute(x, "audioObjectName").alias("object_names"),
        first(attribute(x, "audioProgrammeName")).alias("programme"),
        version.alias("version"),
    )
