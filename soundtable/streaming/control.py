"""Streams of control packets, state events and edits; each plans alike for a table."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from soundtable.functions.scalars import quaternion_to_ypr
from soundtable.operators.session import edit_state
from soundtable.sources.files import opened, resolve

# ---- control packets

#: Fixed values of the format: how deep bundles nest, bytes before a bundle's first element, and the bytes of arguments by
#: their tag (of which f, i and d are numbers); others have no known length.
DEEPEST, BUNDLE_HEAD = 8, 16
NUMBERS = {"f": ">f", "i": ">i", "d": ">d"}
WIDTHS = {"f": 4, "i": 4, "d": 8, "h": 8, "t": 8, "T": 0, "F": 0, "N": 0, "I": 0}


def _string(data: bytes, at: int) -> tuple[str, int] | None:
    """A string and where its padding ends; None if it does not end."""
    end = data.find(b"\0", at)
    return None if end < 0 else (data[at:end].decode("utf-8", "replace"), end + 4 - (end - at) % 4)


def messages(data: bytes, depth: int = 0) -> Iterator[tuple[str, list[float]]]:
    """(address, numbers) of the messages of a packet, those of nested bundles in order. What does not read gives nothing;
    of a message that is cut short, what came before."""
    if depth > DEEPEST or len(data) < 4:
        return
    if data[:8] == b"#bundle\0":
        at = BUNDLE_HEAD
        while at + 4 <= len(data):
            (size,) = struct.unpack_from(">I", data, at)
            if size == 0 or at + 4 + size > len(data):
                return
            yield from messages(data[at + 4 : at + 4 + size], depth + 1)
            at += 4 + size
        return
    address = _string(data, 0) if data[:1] == b"/" else None
    if address is None:
        return
    tags, numbers = _string(data, address[1]), []
    if tags is not None and tags[0][:1] == ",":
        at = tags[1]
        for tag in tags[0][1:]:
            if tag in "sS":
                text = _string(data, at)
                width = None if text is None else text[1] - at
            elif tag == "b" and at + 4 <= len(data):
                width = 4 + -(-struct.unpack_from(">I", data, at)[0] // 4) * 4
            else:
                width = WIDTHS.get(tag)
            if width is None or at + width > len(data):
                break
            if tag in NUMBERS:
                numbers.append(float(struct.unpack_from(NUMBERS[tag], data, at)[0]))
            at += width
    yield address[0], numbers


def osc_messages(packets: DataFrame, value: str = "value") -> DataFrame:
    """(ts, seq, source, part, address, floats): packets (ts, seq, source, binary value) as rows, `part` counting the messages
    of a packet. A malformed or null packet has no row. For streams and tables."""
    schema = "ts timestamp, seq long, source string, part int, address string, floats array<double>"

    def run(batches):
        for batch in batches:
            found = [list(messages(data)) if data else [] for data in batch.column(3).to_pylist()]
            owner = pa.array([i for i, m in enumerate(found) for _ in m], pa.int64())
            each = [x for m in found for x in m]
            parts = [k for m in found for k in range(len(m))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(owner) for c in range(3)), pa.array(parts, pa.int32()), pa.array([a for a, _ in each], pa.string()), pa.array([n for _, n in each], pa.list_(pa.float64()))], names=["ts", "seq", "source", "part", "address", "floats"])

    return packets.select("ts", F.col("seq").cast("long"), F.col("source").cast("string"), F.col(value).alias("value")).mapInArrow(run, schema)


def orientation_axes(decoded: DataFrame) -> DataFrame:
    """(ts, seq, part, source, yaw, pitch, roll): what each message says of a head's turn in degrees, null where nothing.

    Addresses (in any case) with quat give all axes of four numbers, ypr, euler or orient of three, yaw, pitch or roll one.
    The first of these that an address names counts; a near-zero quaternion counts as it is."""
    low, f = F.lower("address"), lambda i: F.get(F.col("floats"), F.lit(i))
    small = F.sqrt(f(0) * f(0) + f(1) * f(1) + f(2) * f(2) + f(3) * f(3)) <= 1e-9
    turned = quaternion_to_ypr(f(0), f(1), f(2), f(3))
    quat, whole = low.contains("quat"), low.contains("ypr") | low.contains("euler") | low.contains("orient")
    named = F.lit(False)
    out = []
    for i, axis in enumerate(("yaw", "pitch", "roll")):
        one = F.when(~named & low.contains(axis), f(0))
        out.append(F.when(quat, F.when(F.size("floats") >= 4, F.when(small, 0.0).otherwise(turned[i]))).when(whole, F.when(F.size("floats") >= 3, f(i))).otherwise(one).alias(axis))
        named = named | low.contains(axis)
    return decoded.select("ts", "seq", "part", "source", *out)


def head_turns(axes: DataFrame) -> DataFrame:
    """(source, yaw, pitch, roll): the last of each axis by time, seq and part. An aggregation, so that in a stream an axis that
    later batches lack is carried over by its state."""
    at = F.struct("ts", "seq", "part")
    return axes.groupBy("source").agg(*[F.max_by(a, F.when(F.col(a).isNotNull(), at)).alias(a) for a in ("yaw", "pitch", "roll")])


def angle_to_param(degrees: Column, low: Column, high: Column, degrees_low: float = -180.0, degrees_high: float = 180.0) -> Column:
    """The value of a parameter from low to high: mapped from the range of degrees where its span is two at most, else degrees, clamped."""
    share = F.greatest(F.least((degrees - degrees_low) / (degrees_high - degrees_low), F.lit(1.0)), F.lit(0.0)) if degrees_high != degrees_low else None
    plain = F.when(high > low, F.greatest(F.least(degrees, high), low)).otherwise(degrees)
    return plain if share is None else F.when(high - low <= 2, low + share * (high - low)).otherwise(plain)


# ---- state events

#: Kinds of changes.
KINDS = ("TrackList", "PlayState", "Volume", "Pan", "Mute", "Solo", "RecArm", "Selection", "TrackTitle", "Other")
EVENTS = "ts timestamp, kind string, track long, value double"


def play_state(play: Column, pause: Column, record: Column) -> Column:
    """One number of three flags, null counting as false."""
    return sum((F.coalesce(flag.cast("double"), F.lit(0.0)) * n for flag, n in ((play, 1), (pause, 2), (record, 4))), F.lit(0.0))


class _Piece(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class _EventReader(DataSourceStreamReader):
    """Offsets are the bytes read of each log; a batch takes whole lines, so that one that is being written waits for its end."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, path = resolve(self.folder)
        found = {}
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.is_file and info.base_name.endswith(".jsonl"):
                found[info.base_name] = self._whole(system, info.path, info.size)
        return found

    @staticmethod
    def _whole(system, path: str, size: int, step: int = 1 << 16) -> int:
        """Where the last whole line of a log ends."""
        with system.open_input_file(path) as f:
            end = size
            while end > 0:
                begin = max(0, end - step)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        return [_Piece(f"{self.folder.rstrip('/')}/{name}", start.get(name, 0), to) for name, to in sorted(end.items()) if to > start.get(name, 0)]

    def read(self, piece: _Piece) -> Iterator[tuple]:
        import datetime

        with opened(piece.path) as f:
            f.seek(piece.begin)
            for line in f.read(piece.end - piece.begin).splitlines():
                try:
                    said = json.loads(line)
                    kind = said.get("kind")
                    ts = datetime.datetime.fromisoformat(said["ts"])
                    row = (ts, kind if kind in KINDS else "Other", None if said.get("track") is None else int(said["track"]), float(said.get("value") or 0))
                except (ValueError, TypeError, KeyError, AttributeError):
                    continue
                yield row


class StateEvents(DataSource):
    """Logs of state events (files *.jsonl of a folder, one JSON object a line: ts, kind, track, value) as a stream.

    Logs grow at their end and may be added. Lines that do not read have no row, kinds that are not known are Other."""

    @classmethod
    def name(cls) -> str:
        return "state_events"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _EventReader(self.options["path"])


def state_event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(ts, kind, track, value) of the logs in a folder that driver and executors share, as a stream. A restart from its
    checkpoint goes on after the last byte of the last batch: nothing is lost or repeated."""
    spark.dataSource.register(StateEvents)
    return spark.readStream.format("state_events").load(folder)


# ---- edits


def stream_edits(edits: DataFrame, key: str, fields: dict[str, Column], path: str, checkpoint: str):
    """A started stream query that keeps the edit_state of each key of a stream of edits under `path`.

    The state is the stream's own aggregation. Each batch writes the keys that it changed to a folder of its number, over
    what an attempt before may have left there, so that a batch that is run again changes nothing. Returns the
    DataStreamWriter; the caller sets its trigger and starts it."""
    states = edit_state(edits, key, fields)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)


def streamed_state(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, state) as the last batch that changed each key left it; goes into session.with_edits."""
    kept = spark.read.parquet(path)
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc("batch")))
    return kept.withColumn("__last", last).where("__last = 1").select(key, "state")
