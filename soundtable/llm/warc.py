"""Deterministic sharded WARC archives: range-sorted records, files rolled by compressed size, commits by rename and manifest."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundtable.llm.common import broadcast_within, new_path, sliced, write_table
from soundtable.llm.exact_dedup import digest_runs, merge_runs, rounds_for
from soundtable.llm.files import committed, opened
from soundtable.llm.ranges import range_bounds, shard_count, shard_of

#: Compressed bytes after which a file is closed.
ROLL_BYTES = 256 << 20
#: The date of all records: archives of the same pages are the same bytes.
WARC_DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64())])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def target_uri(url: str | None) -> str:
    """An address as a header line can hold it: blanks and control characters are percent-coded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, refers_to_url: str | None = None) -> bytes:
    """One gzip member. A revisit has the HTTP headers, whose Content-Length is the full payload's, but no payload; it
    names the response by record id, address and date, and by page id in a field of its own."""
    digest = base32_sha1(payload)
    uri = target_uri(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, uri, digest)}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        there = target_uri(refers_to_url)
        head += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: {record_id(refers_to, there, digest)}",
            f"WARC-Refers-To-Target-URI: {there}",
            f"WARC-Refers-To-Date: {WARC_DATE}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(raw: bytes) -> dict:
    """The fields of a record, its digests checked against its bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.lower().split(b"content-length:")[1].split(b"\r\n")[0])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    is_revisit = field["WARC-Type"] == "revisit"
    if f"sha1:{base32_sha1(block)}" != field["WARC-Block-Digest"] or not is_revisit and (base32_sha1(payload) != digest or len(payload) != size):
        raise ValueError(f"digest mismatch in {field['WARC-Record-ID']}")
    number = lambda name: int(field[name]) if name in field else None
    return {"page_id": number("X-Page-ID"), "url": field["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": field["WARC-Type"], "refers_to": number("X-Refers-To-Page")}


def members(source):
    """(offset, bytes) of each gzip member, one in memory at a time."""
    offset, waiting = 0, b""
    while True:
        unpack, out, used = zlib.decompressobj(31), io.BytesIO(), 0
        while not unpack.eof:
            chunk = waiting or source.read(1 << 20)
            if not chunk:
                if used:
                    raise ValueError("the archive ends inside a record")
                return
            out.write(unpack.decompress(chunk))
            used += len(chunk)
            waiting = b""
        waiting = unpack.unused_data
        yield offset, out.getvalue()
        offset += used - len(waiting)


def write_warc(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None) -> DataFrame:
    """Writes a record for each row and returns the manifest (shard, file, path, records, bytes), a row for each file.

    Of equal payloads (null: empty) of at least min_revisit_bytes bytes, the one with the largest id is a response and
    the others revisit it; rows that repeat that id are responses too. Rows without an id rank below all others, come
    first, and are responses where no row of their group has an id. Where rows share the largest id, the one with the
    largest url is what revisits name. Records are sorted by id, payload digest and url; where a shard begins follows
    from ids and digests alone, so the same pages make the same files, however they are partitioned. A file appears
    under its name when whole; the manifest lists the files of tasks that succeeded. An empty table makes no file.
    """
    folder = path or new_path(spark, "warc")
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    runs = write_table(spark, digest_runs(pages, id_col, payload_col, F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url")), "payload-runs")
    revisited = merge_runs(runs, rounds_for(runs), carry=("url",)).where((F.col("group_size") > 1) & (F.col("n_bytes") >= min_revisit_bytes))
    revisited = revisited.select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.col("url").alias("__there"))
    revisited = broadcast_within(write_table(spark, revisited, "revisited"))
    # Narrow rows only: which (id, digest) revisits which id.
    marks = runs.join(revisited, F.col("digest") == F.col("__digest")).where(~F.col("id").eqNullSafe(F.col("__keep"))).select(F.col("id").alias("__id"), "__digest", "__keep", "__there").distinct()
    marks = broadcast_within(write_table(spark, marks, "revisits"))
    place = [F.coalesce(F.col("page_id"), F.lit(-(2**63))), F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")]
    count, size = runs.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    keys = runs.select(F.col("id").cast("long").alias("page_id"), "digest").select(place[0].alias("a"), place[1].alias("b"))
    bounds = range_bounds(keys, count, shard_count(size + 512 * count))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    rows = rows.join(marks, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    rows = rows.select("page_id", "url", F.col("payload").cast("binary").alias("payload"), "__keep", F.col("__digest").isNotNull().alias("revisit"), "__there", shard_of(*place, bounds).alias("shard"), "digest")
    rows = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("page_id", "digest", "url")

    def run(batches):
        number, waiting = 0, _rows(batches)
        row = next(waiting, None)
        while row is not None:
            shard = row[6]  # that of all rows of the task
            name = f"{folder}/part-{shard:06d}-{number:04d}.warc.gz"
            records = size = 0
            with committed(name) as out:
                while row is not None and (not records or size < roll_bytes):
                    done = build_record(*row[:6])
                    out.write(done)
                    records, size = records + 1, size + len(done)
                    row = next(waiting, None)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": number, "path": name, "records": records, "bytes": size}], schema=_MANIFEST)
            number += 1

    return write_table(spark, rows.mapInArrow(run, "shard int, file int, path string, records long, bytes long"), "warc-manifest")


def _rows(batches):
    for batch in sliced(batches, 2):
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in range(7))


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, path, offset) of each record of a manifest's files.

    A wrong digest fails the job. A record without id has a null page_id, one of a null url an empty one; records that
    repeat are rows of their own; an empty manifest gives an empty result."""
    files = manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2), "path")

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                with opened(name) as source:
                    for offset, raw in members(source):
                        out.append(parse_record(raw) | {"path": name, "offset": offset})
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_pylist(out, schema=_RECORD)
                            out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_RECORD)

    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long")
