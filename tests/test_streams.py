"""The stream operators read by readStream, against the same operators on the table."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from soundtable.operators import deliveries, edits, session
from soundtable.streaming import updates

START = datetime.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, kind string, track long, channel long, peak double, level_db double, program_id long, power double"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    draw = random.Random(4)
    path = str(tmp_path_factory.mktemp("events"))
    rows = [(START + datetime.timedelta(milliseconds=37 * i), draw.choice(["TrackList", "PlayState", "Volume", "Other"]), i % 5, i % 2, draw.random(), draw.choice([-80.0, -20.0]), i % 3, draw.random()) for i in range(400)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return path


def streamed(spark, path, tmp_path, make, name):
    out = make(spark.readStream.schema(SCHEMA).parquet(path))
    assert out.isStreaming
    running = out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    running.awaitTermination(90)
    return sorted(map(str, spark.table(name).collect()))


OPERATORS = {
    "coalesced": lambda e: updates.coalesce_updates(e, e.sparkSession.createDataFrame([("project/state",), ("track/3/chunk",)], "uri string")),
    "peaks": lambda e: updates.live_peaks(e, "1 second"),
    "loudness": lambda e: updates.live_loudness(e).withColumn("loudness", F.round("loudness", 9)),
    "sessions": lambda e: updates.silence_sessions(e),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_stream_as_table(spark, events, tmp_path, name):
    make = OPERATORS[name]
    want = sorted(map(str, make(spark.read.schema(SCHEMA).parquet(events)).collect()))
    assert want and streamed(spark, events, tmp_path, make, name) == want


def test_edits_out_of_range_leave_the_one_before(spark):
    sends = spark.createDataFrame([(1, -3.0, 0.0, False, False, 0)], "k long, vol_db double, pan double, muted boolean, phase boolean, mode int")
    log = [(1, "set", "pan", "0.5", 1), (1, "set", "pan", "2", 2), (1, "set", "mode", "2", 3), (1, "set", "mode", "3", 4), (1, "set", "vol_db", "NaN", 5), (1, "set", "muted", None, 6), (1, "set", "muted", "true", 7)]
    got = session.apply_edits(sends, spark.createDataFrame(log, "k long, op string, field string, value string, seq long"), "k", edits.send_fields()).first()
    assert (got.vol_db, got.pan, got.muted, got.phase, got.mode) == (-3.0, 0.5, True, False, 3)


def test_model_is_normalized_or_left(spark):
    models = spark.createDataFrame([(1, "5.1", 6, 48000), (2, None, None, None)], "model long, bed string, bed_channels int, rate int")
    objects = spark.createDataFrame([(1, None, 3), (2, False, 3), (3, True, None)], "model long, cartesian boolean, importance int")
    blocks = spark.createDataFrame([(1, True, 0.2, None, 3.0), (1, None, 0.0, 0.0, 0.0), (2, True, 0.2, 0.1, 0.0)], "model long, divergence boolean, width double, height double, depth double")
    judged, bent, sized = deliveries.normalize_model(models, objects, blocks)
    assert {r.model: r.error for r in judged.collect()} == {1: None, 2: "sample_rate_not_48k"}
    assert sorted((r.model, r.cartesian, r.importance, tuple(r.warnings)) for r in bent.collect()) == [(1, True, None, ("coordinate", "importance")), (2, False, 3, ()), (3, True, None, ())]
    assert sorted((r.model, r.width, r.height, r.depth, tuple(r.warnings)) for r in sized.collect()) == [(1, 0.0, 0.0, 0.0, ()), (1, 1.0, 1.0, 1.0, ("divergence", "extent")), (2, 0.2, 0.1, 0.0, ())]


def test_stems_match_by_order_or_name(spark):
    stems = spark.createDataFrame([(1, 0, "Bed"), (1, 1, "Vox"), (2, 0, "Bed"), (2, 1, ""), (2, 2, None), (3, 0, "x")], "project long, idx long, label string")
    files = spark.createDataFrame([(1, 5, "b.wav"), (1, 7, "a.wav"), (2, 1, "old.wav"), (2, 2, "my BED 1.wav"), (2, 3, "bed.wav"), (2, 4, "z.wav")], "project long, file_no long, path string")
    got = {(r.project, r.idx): (r.path, r.matched_by) for r in deliveries.match_stem_files(stems, files).collect()}
    assert got == {(1, 0): ("b.wav", "order"), (1, 1): ("a.wav", "order"), (2, 0): ("my BED 1.wav", "name"), (2, 1): (None, None), (2, 2): (None, None), (3, 0): (None, None)}
