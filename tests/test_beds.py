"""Closed forms of beds, objects and routing verdicts."""

import math

from pyspark.sql import functions as F

from soundtable.operators import beds, deliveries

PLAN = beds.tone_plan(3)
RATE, FRAMES = 8000.0, 8000


def routed(spark, carried):
    """A second of each channel, which carries {slot: level}."""
    hz = dict(PLAN)
    rows = None
    for channel, tones in carried.items():
        x = F.lit(0.0)
        for slot, level in tones.items():
            x = x + level * F.sin(F.col("id") * (2 * math.pi * hz.get(slot, 1000.0) / RATE))
        one = spark.range(FRAMES).select(F.lit(1).alias("p"), F.lit(channel).alias("channel"), F.col("id").alias("frame"), x.alias("x"))
        rows = one if rows is None else rows.union(one)
    out = beds.verify_routing(rows, ["p"], PLAN, RATE).orderBy("channel").collect()
    return [(r.verdict, r.detected, r.paired) for r in out]


def test_tone_plan():
    assert beds.tone_plan(3, lfe=(1,)) == [(0, 313.0), (1, 40.0), (2, 591.0)] and len(beds.tone_plan(500)) == 128


def test_routing_verdicts(spark):
    fine = ("identity", 0, None)
    assert routed(spark, {0: {0: 0.1}, 1: {1: 0.1}, 2: {2: 0.1}}) == [fine, ("identity", 1, None), ("identity", 2, None)]
    assert routed(spark, {0: {1: 0.1}, 1: {0: 0.1}, 2: {}}) == [("swapped", 1, 1), ("swapped", 0, 0), ("silent", None, None)]
    assert routed(spark, {0: {0: 0.1}, 1: {0: 0.1}, 2: {2: 0.1, 1: 0.01}}) == [fine, ("duplicated", 0, 0), ("bleed", 2, 1)]
    assert routed(spark, {0: {0: 0.1}, 1: {9: 0.1, 0: 0.001}, 2: {1: 0.1}}) == [fine, ("dropped", None, None), ("dropped", 1, 1)]
    assert {v for v, _, _ in routed(spark, {0: {0: 0.1}, 1: {1: 0.1}})} == {"channels"}


def test_labels_of_odd_widths(spark):
    rows = spark.createDataFrame([(6, 4), (6, 3), (24, 9), (3, 1), (None, None)], "width int, channel int")
    found = {(r.width, r.channel): (r.layout, r.label, r.lfe, r.weight) for r in beds.label_channels(rows).collect()}
    assert found[(6, 4)] == ("5.1", "Ls", False, 1.41) and found[(6, 3)] == ("5.1", "LFE", True, 0.0)
    assert found[(24, 9)] == ("22.2", "ch9", True, 0.0) and found[(3, 1)] == ("multichannel", "ch1", False, 1.0)
    assert found[(None, None)] == ("multichannel", None, False, 1.0)


def test_objects_against_a_silent_bed(spark):
    bins = spark.createDataFrame([(1, o, i, p) for o, p in (("a", 0.1), ("b", 0.3), ("c", 0.0)) for i in range(8)], "program int, object string, bin long, power double")
    bed = spark.createDataFrame([(1, i, 0.0) for i in range(8)], "program int, bin long, power double")
    out = {r.object: r for r in beds.object_loudness(bins, "program", "object", bed).collect()}
    assert abs(out["b"].energy_share - 0.75) < 1e-9 and out["b"].delta == 0 and out["c"].energy_share == 0
    assert all(r.bed_vs_objects is None for r in out.values())


def test_binaural_verdicts(spark):
    def verdict(left, right):
        rows = [(1, c, i, float(s)) for c, side in ((0, left), (1, right)) for i, s in enumerate(side)]
        return beds.binaural_verdict(spark.createDataFrame(rows, "n int, channel int, frame long, x double"), ["n"]).first().verdict

    a, b = [1, -1, 1, -1], [1, 1, -1, -1]
    assert verdict(a, [-x for x in a]) == "out_of_phase" and verdict(a, a) == "near_mono"
    assert verdict(a, [x / 10 for x in b]) == "lopsided" and verdict(a, b) == "healthy" and verdict(a, []) == "not_binaural"


def test_window_without_frames_and_null_source(spark):
    rows = spark.createDataFrame([(0.0, 0.01, 0.0, 5.0), (0.0, None, 0.0, 5.0), (0.0, 1.0, None, None), (9.0, 1.0, 0.0, 5.0)], "start double, duration double, source_start double, source_end double")
    found = [(r.frames, r.error) for r in beds.window_clamp(rows, 10.0).collect()]
    assert found == [(None, "empty_window"), (50, None), (None, "empty_source"), (None, "empty_window")]


def test_second_source_needs_its_number(spark):
    rows = spark.createDataFrame([("f", 0, "Azimuth"), ("f", 1, "Azimuth 2"), ("g", 0, "Azimuth"), ("g", 1, None)], "fx string, idx int, name string")
    assert {(r.fx, r.azimuth) for r in beds.param_roles(rows, ["fx"], "idx", "name", source=1).collect()} == {("f", 1), ("g", None)}
    assert {r.azimuth for r in beds.param_roles(rows, ["fx"], "idx", "name").collect()} == {0}


def test_model_with_nulls_and_without_objects(spark):
    models = spark.createDataFrame([(1, None, None, 48000), (2, "5.1", 6, None), (3, "5.1", 6, 48000)], "model int, bed string, bed_channels int, rate int")
    objects = spark.createDataFrame([(3, None, None), (3, True, 0)], "model int, cartesian boolean, importance int")
    blocks = spark.createDataFrame([(3, None, 0.5, 0.5, None), (3, True, 0.5, 0.5, 0.5)], "model int, divergence boolean, width double, height double, depth double")
    found = {tuple(r) for r in deliveries.validate_model(models, objects, blocks).collect()}
    assert found == {(1, "empty", 1), (2, "sample_rate", 1), (3, "coordinate", 1), (3, "importance", 1), (3, "divergence", 1), (3, "extent", 1)}
