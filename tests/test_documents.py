"""Documents that appear together, and masters written and read back."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from soundtable.sources import damf
from soundtable.sources.documents import write_documents


def contents(folder):
    return {name: (folder / name).read_bytes() for name in os.listdir(folder)}


@pytest.mark.parametrize("partitions", [1, 5])
def test_same_bytes_for_any_partitioning(spark, tmp_path, partitions):
    rows = [(f"p{i % 7}.txt", i // 7, f"line {i} é") for i in range(100)] + [("null.txt", 0, None)]
    write_documents(spark.createDataFrame(rows, "name string, at int, line string").repartition(partitions), str(tmp_path), "name", ["at"])
    got = contents(tmp_path)
    assert set(got) == {f"p{i}.txt" for i in range(7)} | {"null.txt"} and got["null.txt"] == b""
    for i in range(7):
        assert got[f"p{i}.txt"].decode() == "".join(f"line {j} é\n" for j in range(i, 100, 7))
    write_documents(spark.createDataFrame([("p0.txt", 0, "new")], "name string, at int, line string"), str(tmp_path), "name", ["at"])
    assert contents(tmp_path)["p0.txt"] == b"new\n"


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("d"), F.col("id") % 20).alias("name"), F.col("id").alias("at"), F.when(F.col("id") == 150, F.raise_error(F.lit("lost"))).otherwise("x").alias("line"))
    with pytest.raises(Exception, match="lost"):
        write_documents(rows, str(tmp_path / "out"), "name", ["at"])
    assert not os.path.exists(tmp_path / "out") or contents(tmp_path / "out") == {}
    with pytest.raises(ValueError):
        write_documents(spark.createDataFrame([("a/b", 0, "x")], "name string, at int, line string"), str(tmp_path), "name", ["at"])
    write_documents(spark.createDataFrame([], "name string, at int, line string"), str(tmp_path), "name", ["at"])


def caf(channels, frames, flags=0, rate=48000.0, size=None):
    data = b"\0" * (frames * channels * 3)
    desc = struct.pack(">d4sIIIII", rate, b"lpcm", flags, channels * 3, 1, channels, 24)
    return b"caff\0\1\0\0" + b"desc" + struct.pack(">q", len(desc)) + desc + b"data" + struct.pack(">q", len(data) + 4 if size is None else size) + b"\0" * 4 + data


@pytest.fixture(scope="module")
def masters(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("damf")
    beds = spark.createDataFrame([("a", i, label) for i, label in enumerate(["L", "R", "C", "LFE"])] + [("c", 5, None)], "program string, idx int, label string")
    objects = spark.createDataFrame([("a", 3, 'Say "hi" & <go>'), ("a", 9, None), ("b", 0, "Only")], "program string, idx int, name string")
    blocks = spark.createDataFrame([("a", 3, 0.0, 0.0, 0.0, 1.0), ("a", 3, 0.5, 90.0, 0.0, 1.0), ("a", 3, 1.00001, 0.0, -30.0, None), ("b", 0, 0.25, -45.0, 45.0, 2.0), ("x", 0, 0.0, 0.0, 0.0, 1.0)], "program string, object int, rtime double, az double, el double, dist double")
    damf.write_masters(beds, objects, blocks, "program", str(folder))
    (folder / "a.atmos.audio").write_bytes(caf(6, 10))
    (folder / "b.atmos.audio").write_bytes(caf(2, 7, flags=2, size=-1))
    (folder / "c.atmos.audio").write_bytes(b"RIFF" + b"\0" * 20)
    (folder / "d.atmos.audio").write_bytes(caf(1, 1))
    return folder


def test_written_masters(masters):
    assert (masters / "a.atmos").read_text() == """version:
  major: 1
  minor: 0
  revision: 0
presentations:
- type: home
  simplified: false
metadata: a.atmos.metadata
audio: a.atmos.audio
bedInstances:
- channels:
  - {channel: L, ID: 1}
  - {channel: R, ID: 2}
  - {channel: C, ID: 3}
  - {channel: LFE, ID: 4}
objects:
- {ID: 5, name: "Say &quot;hi&quot; &amp; &lt;go&gt;"}
- {ID: 6, name: ""}
"""
    assert (masters / "a.atmos.metadata").read_text() == """version:
  major: 1
  minor: 0
  revision: 0
sampleRate: 48000
events:
- {ID: 1, samplePos: 0, active: true}
- {ID: 2, samplePos: 0, active: true}
- {ID: 3, samplePos: 0, active: true}
- {ID: 4, samplePos: 0, active: true}
- {ID: 5, samplePos: 0, active: true, pos: [0, 1, 0]}
- {ID: 5, samplePos: 24000, active: true, pos: [-1, 0, 0]}
- {ID: 5, samplePos: 48000, active: true, pos: [0, 0.866025, 0]}
- {ID: 6, samplePos: 0, active: true, pos: [0, 1, 0]}
"""
    assert "- {ID: 1, samplePos: 12000, active: true, pos: [1, 1, 1]}" in (masters / "b.atmos.metadata").read_text()


def test_read_masters(spark, masters):
    found, events = damf.read_damf_corpus(spark, str(masters))
    got = {r.master.rsplit("/", 1)[1]: r for r in found.collect()}
    assert set(got) == {"a", "b", "c", "d"}
    a, b, c, d = (got[x] for x in "abcd")
    assert (a.is_damf, a.bed_instances, a.bed_channels, a.objects, a.metadata_rate, a.events, a.channels, a.frames, a.warnings) == (True, 1, 4, 2, 48000, 8, 6, 10, [])
    assert (b.frames, b.little_endian, b.warnings) == (7, True, ["channels 2, roster 1", "little-endian samples"])
    assert not c.is_damf and c.warnings == ["audio: not_caf"]
    assert not d.is_damf and d.warnings == ["missing manifest", "missing metadata"]
    rows = sorted((r.master.rsplit("/", 1)[1], r.id, r.sample, r.active, r.x, r.y, r.z) for r in events.where("id = 5").collect())
    assert rows == [("a", 5, 0, True, 0.0, 1.0, 0.0), ("a", 5, 24000, True, -1.0, 0.0, 0.0), ("a", 5, 48000, True, 0.0, 0.866025, 0.0)]
    assert events.count() == 8 + 1 + 1
