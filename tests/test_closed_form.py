"""Signals and notes whose answers are known."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from soundtable.functions import harmonics
from soundtable.functions import scalars as H
from soundtable.operators import deliveries, meter, notes, scene, sends, session, weighting
from soundtable.sources import wav


def test_sine_levels(spark):
    frames = spark.range(4800).select(F.lit("p").alias("program_id"), F.col("id").alias("frame"), F.sin(F.col("id") * 2 * math.pi * 1000 / 48000).alias("x"))
    row = meter.channel_metrics(frames, ["program_id"]).first()
    assert abs(row.peak_db) < 0.1 and abs(row.rms_db + 3.01) < 0.1


def test_steady_tone_is_not_gated(spark):
    bins = spark.range(40).select(F.lit("p").alias("program_id"), F.col("id").alias("bin"), F.lit(0.1).alias("power"))
    row = meter.gated_loudness(bins, ["program_id"]).first()
    assert abs(row.integrated - row.ungated) < 0.3 and row.activity > 0.95


def test_short_program_reads_ungated(spark):
    bins = spark.range(2).select(F.lit("p").alias("program_id"), F.col("id").alias("bin"), F.lit(0.1).alias("power"))
    row = meter.gated_loudness(bins, ["program_id"]).first()
    assert row.integrated == row.ungated and row.total_blocks == 0


def test_constant_channel_has_no_correlation(spark):
    rows = [("p", c, i, 1.0 if c else float(i)) for c in (0, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "program_id string, channel int, frame long, x double")
    assert meter.channel_correlation(df, ["program_id"], 0, 1).first()["corr"] == 0.0


def test_plane_wave_reads_its_azimuth(spark):
    az, el = math.radians(40), math.radians(10)
    acn = [harmonics.harmonic(k, az, el) for k in range(4)]
    df = spark.createDataFrame([("s", i, [x * math.sin(i + 1) for x in acn]) for i in range(20)], "program_id string, frame long, acn array<double>")
    row = scene.spatial_field(df, ["program_id"]).first()
    assert abs(row.az - 40) < 1e-6 and abs(row.el - 10) < 1e-6 and row.diffuseness < 1e-9 and abs(row.rv - 1) < 1e-9


def test_groove_arithmetic(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(H.quantize(F.lit(0.24))) == 0.25
    assert abs(one(H.quantize(F.lit(0.20), strength=0.5)) - 0.225) < 1e-12
    assert abs(one(H.quantize(F.lit(0.24), swing=0.5)) - 0.375) < 1e-12
    assert one(H.scale_velocity(F.lit(100), 0.5)) == 82


def test_send_codes_round_trip(spark):
    df = spark.createDataFrame([(w,) for w in (1, 2, 4, 10, 128)], "w int")
    rows = df.select("w", H.decode_send_width(H.encode_send(F.lit(5), F.col("w"))).alias("back")).collect()
    assert all(r.w == r.back for r in rows)


def test_chunk_depth(spark):
    df = spark.createDataFrame([(1, "<TRACK\nNAME x\n<FX\n>\n>"), (2, "<TRACK\n<A\n>")], "k int, t string")
    found = {r.k: (r.valid, r.open) for r in session.validate_chunks(session.chunk_lines(df, "k", "t"), "k").collect()}
    assert found == {1: (True, 0), 2: (False, 1)}


def test_true_peak_lies_above_the_samples(spark):
    """A tone at a quarter of the rate, sampled off its crests; small blocks give what one block gives."""
    frames = spark.range(400).select(F.lit("p").alias("program_id"), F.col("id").alias("frame"), F.sin(F.col("id") * math.pi / 2 + math.pi / 4).alias("x"))
    low = meter.channel_metrics(frames, ["program_id"]).first().peak_db
    one, many = (meter.true_peak(frames, ["program_id"], block).first().true_peak_db for block in (1 << 16, 16))
    assert abs(low + 3.01) < 0.2 and one > low + 2 and one == many
    assert meter.true_peak(frames.limit(0), ["program_id"]).count() == 0


def test_yaw_moves_a_source(spark):
    def acn(az):
        a = math.radians(az)
        return [1.0, math.sin(a), 0.0, math.cos(a), math.sin(2 * a), 0.0, -0.5, 0.0, math.cos(2 * a)]

    row = spark.createDataFrame([(acn(20.0),)], "acn array<double>").select(scene.rotate_yaw(F.col("acn"), 50.0).alias("a")).first()
    assert all(abs(u - v) < 1e-12 for u, v in zip(row.a, acn(70.0), strict=True))


def test_humanize_draws_in_note_order(spark):
    rows = [(take, i * 0.5, 0.25, 60, 100, 0) for take in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "take_id long, start double, length double, pitch int, velocity int, channel int")
    got = sorted(notes.humanize(df, ["start"], 0.02, 8, 7).collect())
    state, mask = 7, (1 << 64) - 1

    def draw():
        nonlocal state
        for shift in (-12, 25, -27):
            state ^= (state << shift if shift > 0 else state >> -shift) & mask
        return ((state * 0x2545F4914F6CDD1D & mask) >> 11) / 2**53 * 2 - 1

    for i in range(40):
        start, d = max(0.0, i * 0.5 + draw() * 0.02), draw() * 8
        velocity = min(127, max(1, 100 + int(math.copysign(math.floor(abs(d) + 0.5), d))))
        for r in (got[i], got[40 + i]):
            assert abs(r.start - start) < 1e-12 and (r.length, r.velocity) == (0.25, velocity)
    assert notes.humanize(df.limit(0), ["start"]).count() == 0


def test_wav_corpus(spark, tmp_path):
    def write(name, tag, bits, data, channels=2, extra=b""):
        form = struct.pack("<HHIIHH", tag, channels, 8000, 0, 0, bits) + extra
        body = b"WAVE" + b"junk" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data
        (tmp_path / name).write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)

    values = [[0.5, -0.25], [0.0, 1 / 1024], [-1.0, 0.75]]
    flat = [v for frame in values for v in frame]
    write("a16.wav", 1, 16, struct.pack("<6h", *[int(v * 32768) for v in flat]))
    write("b24.wav", 1, 24, b"".join(int(v * 8388608).to_bytes(3, "little", signed=True) for v in flat))
    write("c32.wav", 0xFFFE, 32, struct.pack("<6f", *flat), extra=struct.pack("<HHIH", 22, 32, 0, 3) + bytes(14))
    write("d64.wav", 3, 64, struct.pack("<6d", *flat))
    write("e8.wav", 1, 8, b"abcdef")
    write("f.wav", 1, 16, b"")
    write("g.wav", 1, 16, b"ab", channels=0)
    (tmp_path / "h.wav").write_bytes(b"no")
    rows = wav.read_wav_corpus(spark, str(tmp_path), chunk_sec=2 / 8000).collect()
    errors = {r.program_id[-5:]: r.error for r in rows if r.error}
    assert errors == {"8.wav": "invalid bit depth", "f.wav": "no data chunk / empty audio", "g.wav": "missing/invalid fmt chunk", "h.wav": "not a RIFF/WAVE file"}
    good = [r for r in rows if not r.error]
    assert len(good) == 4 * 2 * 2
    for r in good:
        assert r.samples == [v[r.channel] for v in values[r.frame0 : r.frame0 + 2]] and (r.rate, r.frame0) == (8000.0, 2 * r.chunk_no)
    assert meter.chunks_to_samples(spark.createDataFrame(good, wav.CHUNKS)).count() == 24


def test_k_weighting_of_chunks_is_that_of_the_stream(spark):
    """Against a sample loop over the whole stream, whose first sample is loud; and a full-scale 997 Hz tone reads -3.01."""
    rate, n = 8000, 20500
    x = [1.0] + [math.sin(i * i * 1e-4) * 0.3 for i in range(1, n)]
    chunks = spark.createDataFrame([("p", at, x[at : at + rate]) for at in range(0, n, rate)], "k string, frame0 long, samples array<double>")
    got = [v for r in weighting.k_weight(chunks, ["k"], rate).orderBy("frame0").collect() for v in r.samples]
    want = x
    for top, bottom in weighting.sections(rate):
        b, a = [float(v / bottom[0]) for v in top], [float(v / bottom[0]) for v in bottom]
        out, x1, x2, y1, y2 = [], 0.0, 0.0, 0.0, 0.0
        for v in want:
            y = b[0] * v + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
            x1, x2, y1, y2 = v, x1, y, y1
            out.append(y)
        want = out
    assert max(abs(u - v) for u, v in zip(got, want, strict=True)) < 1e-9
    tone = spark.range(48000).select(F.lit("p").alias("k"), F.col("id").alias("frame"), F.sin(F.col("id") * 2 * math.pi * 997 / 48000).alias("x"))
    level = weighting.k_weight(weighting.chunk_samples(tone, ["k"], 48000), ["k"], 48000).select(F.explode("samples").alias("y")).agg(H.lufs(F.avg(F.col("y") * F.col("y"))).alias("l")).first().l
    assert abs(level + 3.01) < 0.05


def test_sends_of_a_source_with_several_roster_rows(spark):
    """The exact fit of the first row is not taken; the third row finds nothing left; the other source's send is a stray."""
    roster = spark.createDataFrame([(1, 0, 7, 0, 1), (1, 1, 7, 5, 1), (1, 2, 7, 6, 1), (1, 3, 8, 9, 2)], "bus int, slot int, source int, dst int, width int")
    existing = spark.createDataFrame([(1, 10, 7, 5, 1), (1, 11, 7, 0, 1), (1, 12, 9, 1, 1), (1, 13, 8, 3, 2), (1, 14, 8, 9, 2)], "bus int, send_index int, source int, dst int, width int")
    got = {(r.slot, r.send_index, r.action) for r in sends.reconcile_sends(roster, existing).collect()}
    assert got == {(0, 11, "reuse"), (1, 10, "reuse"), (2, None, "add"), (3, 14, "reuse"), (None, 12, "stray"), (None, 13, "stray")}


def test_partial_last_bin(spark):
    """31 frames of 0.1, 10 a bin: no whole block of four bins; the mean is over the frames that there are."""
    samples = spark.range(31).select(F.lit("p").alias("program"), F.col("id").alias("frame"), F.lit(0.1).alias("x"))
    bins = meter.power_bins(samples, ["program"], 10)
    row = meter.gated_loudness(bins, ["program"]).first()
    level = -0.691 + 10 * math.log10(0.01)
    assert (row.total_blocks, row.gated_blocks) == (0, 0) and abs(row.ungated - level) < 1e-9 and abs(row.integrated - level) < 1e-9
    assert meter.loudness_timeline(bins, ["program"], 4, 30).count() == 0 and meter.loudness_timeline(bins, ["program"], 3, 30).count() == 1
    quiet = bins.withColumn("power", F.when(F.col("whole"), F.col("power")).otherwise(0.0))
    assert meter.active_fraction(quiet, ["program"]).first().active == 1.0


def test_deliverable_names(spark):
    measures = spark.createDataFrame([(2, -16.0, -2.0, None)], "channels int, lufs double, true_peak double, short_term double")
    assert meter.check_deliverable(measures, " Podcast").first()["pass"] is True
    assert meter.check_deliverable(measures.withColumn("lufs", F.col("lufs") - 3), "PODCAST", tol=5.0).first().lufs_pass
    with pytest.raises(ValueError):
        meter.check_deliverable(measures, "nobody")


def test_short_scene_has_one_window(spark):
    frames = spark.range(7).select(F.lit("p").alias("program"), F.col("id").alias("frame"), F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 1.0)]).alias("acn"))
    assert [r.bin for r in scene.spatial_field_timeline(frames, ["program"], 10, 5).collect()] == [0]
    assert scene.spatial_field_timeline(frames, ["program"], 6, 3).count() == 1
    with pytest.raises(ValueError):
        scene.spatial_field_timeline(frames, ["program"], 10, 4)


def test_sends_of_no_width_and_expected_channels(spark):
    sends = spark.createDataFrame([("a", 5, 0), ("a", 0, 2), ("a", -1, 2)], "bus string, dst int, width int")
    expected = spark.createDataFrame([("a", 8), ("b", 1)], "bus string, channels int")
    found = {(r.bus, r.channel): (r.uses, r.issue) for r in session.send_occupancy(sends, "bus", expected).collect()}
    gap, used = (0, "gap"), (1, None)
    assert found == {("a", i): used if i in (0, 1, 5) else gap for i in range(8)} | {("b", 0): gap}


def test_state_text_with_tabs_and_crlf(spark):
    text = "<TRACK\r\n\t<ITEM\r\n\t\tNAME x\r\n\t>\r\n>\r\n"
    lines = session.chunk_lines(spark.createDataFrame([(1, text)], "k int, text string"), "k", "text")
    assert [r.depth for r in lines.orderBy("line_no").collect()][:5] == [1, 2, 2, 1, 0]
    assert session.validate_chunks(lines, "k").first()[1:] == (0, True)


def test_infinite_stats_and_unmatched_names(spark):
    stats = deliveries.parse_render_stats(spark.createDataFrame([(1, "FILE:a.wav;LUFSI:-inf")], "k int, text string"), "k", "text").first()
    assert float("-inf") in stats.asDict().values()
    asked = spark.createDataFrame([("gain",), ("nothing",)], "asked string")
    params = spark.createDataFrame([(3, "Gain")], "idx int, name string")
    assert sorted(tuple(r) for r in session.resolve_params(asked, params, "asked", "name").collect()) == [("gain", 2, 1, 3), ("nothing", None, 0, None)]


def test_tempo_may_have_other_columns(spark):
    grid = spark.createDataFrame([("m", 3.0)], "map string, pos double")
    tempo = spark.createDataFrame([("m", 0.0, 60.0, 9.0), ("m", 2.0, 120.0, 9.0)], "map string, time double, bpm double, pos double")
    assert notes.time_to_qn(grid, tempo, "map", "pos").first().qn == 4.0
