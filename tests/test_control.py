"""Control packets, event logs and edits as streams with a restart, and line diffs against a plain dynamic program."""

import datetime
import difflib
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from soundtable.operators import session, text_diff
from soundtable.streaming import control

START = datetime.datetime(2024, 1, 1)


def osc(text):
    data = text.encode() + b"\0"
    return data + b"\0" * (-len(data) % 4)


def message(address, tags="", *values):
    return osc(address) + osc("," + tags) + b"".join(struct.pack(">" + t, v) for t, v in zip([t for t in tags if t in "fid"], values, strict=True))


def bundle(*parts):
    return b"#bundle\0" + b"\0" * 8 + b"".join(struct.pack(">I", len(p)) + p for p in parts)


def test_packets():
    got = lambda data: list(control.messages(data))
    assert got(message("/yaw", "f", 1.5)) == [("/yaw", [1.5])] and got(message("/a", "ifd", 3, 0.5, -2.0)) == [("/a", [3.0, 0.5, -2.0])]
    inner = bundle(message("/pitch", "i", 7), message("/roll", "f", 2.0))
    assert got(bundle(message("/yaw", "f", 1.0), inner)) == [("/yaw", [1.0]), ("/pitch", [7.0]), ("/roll", [2.0])]
    assert got(osc("/only")) == [("/only", [])] and got(b"") == got(b"abc") == got(b"xyz\0") == got(b"/never ends") == []
    assert got(message("/cut", "ff", 1.0, 2.0)[:-4]) == [("/cut", [1.0])]
    assert got(osc("/t") + osc(",sbTf") + osc("text") + struct.pack(">I", 3) + b"abc\0" + struct.pack(">f", 4.0)) == [("/t", [4.0])]
    assert got(osc("/u") + osc(",fzf") + struct.pack(">ff", 1.0, 2.0)) == [("/u", [1.0])]
    deep = message("/x", "f", 1.0)
    for _ in range(9):
        deep = bundle(deep)
    assert got(deep) == [] and got(bundle(message("/a", "f", 1.0))[:-1]) == []
    assert got(osc("/b") + osc(",bf") + struct.pack(">I", 0xFFFFFFFF) + b"abcd") == [("/b", [])]


PACKETS = "ts timestamp, seq long, source string, value binary"


def packets():
    half = math.sqrt(0.5)
    said = [message("/head/YAW", "f", 10.0), message("/pitch", "i", 5), b"junk", message("/quaternion", "ffff", half, 0.0, 0.0, half), message("/ypr", "ff", 1.0, 2.0), message("/roll", "f", -3.0), None, bundle(message("/euler", "fff", 1.0, 2.0, 3.0), message("/yaw", "d", 99.0))]
    return [(START + datetime.timedelta(seconds=i // 2), i, f"s{i % 2}" if i < 6 else "s0", data) for i, data in enumerate(said)]


def test_head_turns_as_a_stream(spark, tmp_path):
    """Two runs of one stream over two sets of packets equal the table of both."""
    rows = packets()
    make = lambda df: control.head_turns(control.orientation_axes(control.osc_messages(df)))
    want = {r.source: (r.yaw, r.pitch, r.roll) for r in make(spark.createDataFrame(rows, PACKETS)).collect()}
    assert want["s0"] == (99.0, 2.0, 3.0) and [round(v, 6) for v in want["s1"]] == [90.0, 0.0, -3.0]
    folder, got = str(tmp_path / "in"), {}

    def keep(batch, _):
        got.update({r.source: (r.yaw, r.pitch, r.roll) for r in batch.collect()})

    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, PACKETS).coalesce(1).write.mode("append").parquet(folder)
        made = make(spark.readStream.schema(PACKETS).parquet(folder))
        assert made.isStreaming
        made.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination(120)
    assert got == want


def test_state_events_resume(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    line = lambda i, kind="Volume": json.dumps({"ts": (START + datetime.timedelta(seconds=i)).isoformat(), "kind": kind, "track": i % 3, "value": i / 2})
    seen = []

    def run():
        stream = control.state_event_stream(spark, str(folder))
        stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: seen.extend(b.collect())).trigger(processingTime="0 seconds").start()
        query = spark.streams.active[0]
        query.processAllAvailable()
        query.stop()

    (folder / "a.jsonl").write_text("\n".join(line(i) for i in range(10)) + "\n" + line(10)[:20])  # the last line is being written
    run()
    assert len(seen) == 10
    with open(folder / "a.jsonl", "a") as f:
        f.write(line(10)[20:] + "\nnot json\n[]\n{}\n" + line(11, "Unheard") + "\n")
    (folder / "b.jsonl").write_text(line(12, "TrackList") + "\n")
    run()
    assert sorted((r.value, r.kind, r.track) for r in seen) == [(i / 2, "Other" if i == 11 else "TrackList" if i == 12 else "Volume", i % 3) for i in range(13)]


EDITS = "track long, op string, field string, value string, seq long"


def test_edits_as_a_stream(spark, tmp_path):
    """A stream of edits in several batches, started again once, leaves what all edits make of the table."""
    draw = random.Random(7)
    log = [(draw.randrange(30), draw.choice(["set", "set", "set", "delete"]), draw.choice(["vol_db", "pan"]), draw.choice(["1.5", "-2", "0.25", "bad"]), i) for i in range(300)]
    table = spark.createDataFrame([(i, float(i), 0.0, "x", i) for i in range(0, 40, 2)], "track long, vol_db double, pan double, deleted string, last_op int")
    number = F.expr("try_cast(value as double)")
    fields = {"vol_db": number, "pan": number}
    want = sorted(map(str, session.apply_edits(table, spark.createDataFrame(log, EDITS), "track", fields).collect()))
    folder, state = str(tmp_path / "edits"), str(tmp_path / "state")
    for part in (log[:80], log[80:100], log[100:]):
        spark.createDataFrame(part, EDITS).repartition(3).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 2).parquet(folder)
        control.stream_edits(stream, "track", fields, state, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    got = sorted(map(str, session.with_edits(table, control.streamed_state(spark, state, "track"), "track").collect()))
    assert got == want


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_opcodes_are_least():
    draw = random.Random(3)
    for _ in range(400):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(14))] for _ in range(2))
        codes = text_diff.opcodes(a, b)
        assert [x for k, i, j, u, v in codes for x in (a[i:j] if k == "equal" else [])] == [x for k, i, j, u, v in codes for x in (b[u:v] if k == "equal" else [])]
        assert sum(j - i for k, i, j, _, _ in codes if k == "equal") == longest(a, b)
        assert [c[1] for c in codes] + [len(a)] == [0] * bool(codes) + [c[2] for c in codes] if codes else a == b == []
        assert all(k != "equal" or a[i:j] == b[u:v] for k, i, j, u, v in codes)
        for context in (0, 1, 3):
            matcher = difflib.SequenceMatcher(None, a, b, autojunk=False)
            matcher.opcodes = codes or [("equal", 0, 0, 0, 0)]
            assert text_diff.hunks(codes, context) == [[c for c in g if c[1] < c[2] or c[3] < c[4]] for g in matcher.get_grouped_opcodes(context)] if a != b else True


def test_diffs(spark):
    base = [f"line {i}" for i in range(40)]
    added, removed, moved = [*base[:10], "new", "newer", *base[10:]], base[:5] + base[8:], base[:4] + base[20:24] + base[4:20] + base[24:]
    rows = [("added", base, added), ("removed", base, removed), ("moved", base, moved), ("same", base, base), ("both", base, ["x", *base[1:30], "y", *base[31:]])]
    df = spark.createDataFrame([(k, "\n".join(a) + "\n", "\r\n".join(b), 1) for k, a, b in rows] + [("null", None, "a\nb", 2), ("empty", "", None, 3), (None, "a", "b", 4)], "key string, before string, after string, hunk int")
    got = {}
    for r in text_diff.diff_chunks(df, "key", "before", "after").orderBy("hunk").collect():
        got.setdefault(r.key, []).append(r)
    assert set(got) == {"added", "removed", "moved", "both", "null", None}
    for k, a, b in rows:
        text = "\n".join(x for r in got.get(k, []) for x in (r.header, r.text))
        want = list(difflib.unified_diff(a, b, lineterm=""))[2:]
        assert text == "\n".join(want)
    assert [(r.removed, r.added) for r in got["moved"]] == [(0, 4), (4, 0)] and len(got["both"]) == 2
    assert (got["null"][0].header, got["null"][0].text) == ("@@ -0,0 +1,2 @@", "+a\n+b")
    assert text_diff.diff_chunks(df.where("false"), "key", "before", "after").count() == 0


@pytest.mark.parametrize("value,low,high,want", [(90.0, 0.0, 1.0, 0.75), (500.0, 0.0, 1.0, 1.0), (90.0, -180.0, 180.0, 90.0), (-200.0, -180.0, 180.0, -180.0)])
def test_angles_as_parameters(spark, value, low, high, want):
    assert spark.range(1).select(control.angle_to_param(F.lit(value), F.lit(low), F.lit(high)).alias("v")).first().v == want
