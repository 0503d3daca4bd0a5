"""Nulls, empty tables, ties and clashing names in the operators of sessions, sends, loudness and look-ups."""

import math

import pytest
from pyspark.sql import functions as F

from soundtable.functions import scalars as H
from soundtable.operators import beds, edits, meter, notes, objects, project, sends, session, styles
from soundtable.sources import session_tables as S


def test_null_and_nan_bins_are_silence(spark):
    bins = spark.createDataFrame([("a", i, p) for i, p in enumerate([0.5, None, 0.2, float("nan"), 0.4, 0.1])] + [("b", 0, None)], "p string, bin long, power double")
    plain = spark.createDataFrame([("a", i, p) for i, p in enumerate([0.5, 0.0, 0.2, 0.0, 0.4, 0.1])] + [("b", 0, 0.0)], "p string, bin long, power double")
    assert sorted(map(str, meter.gated_loudness(bins, ["p"]).collect())) == sorted(map(str, meter.gated_loudness(plain, ["p"]).collect()))
    assert {r.p: round(r.ungated, 6) for r in meter.gated_loudness(bins, ["p"]).collect()} == {"a": round(-0.691 + 10 * math.log10(1.2 / 6), 6), "b": -144.0}
    assert meter.gated_loudness(bins.where("false"), ["p"]).count() == 0


def test_labelled_beds_and_mono_are_not_binaural(spark):
    rows = [(p, c, f, math.sin(f) + 0.5 * math.cos(f * (3 + c))) for p, width in (("mono", 1), ("two", 2), ("five", 5), ("bed", 6), ("high", 12)) for c in range(width) for f in range(40)]
    got = {r.p: (r.verdict, r.corr is None) for r in beds.binaural_verdict(spark.createDataFrame(rows, "p string, channel int, frame long, x double"), ["p"]).collect()}
    assert got == {"mono": ("not_binaural", True), "two": ("healthy", False), "five": ("healthy", False), "bed": ("not_binaural", True), "high": ("not_binaural", True)}


def test_beats_and_back(spark):
    tempo = spark.createDataFrame([("m", 2.0, 60.0), ("m", 5.0, 180.0), ("m", None, 90.0), ("n", 1.0, None)], "map string, time double, bpm double")
    times = spark.createDataFrame([("m", float(t)) for t in range(2, 12)] + [("m", 1.0), ("m", None), ("n", 3.0), (None, 4.0)], "map string, at double")
    there = notes.time_to_qn(times, tempo, "map", "at")
    got = {(r.map, r.at): r.qn for r in there.collect()}
    assert got["m", 5.0] == 3.0 and got["m", 6.0] == 6.0 and got["m", 1.0] == 2.0 and got["m", None] is None and got["n", 3.0] == 6.0 and got[None, 4.0] == 8.0
    back = notes.qn_to_time(there.where("map = 'm' AND at >= 2"), tempo, "map", "qn")
    assert all(math.isclose(r.time, r.at, abs_tol=1e-12) for r in back.collect())


def test_points_without_a_time(spark):
    points = spark.createDataFrame([("k", None, 99.0), ("k", 1.0, 5.0), ("k", 3.0, 7.0)], "key string, time double, value double")
    grid = spark.createDataFrame([("k", t) for t in (0.0, 1.0, 2.0, 4.0)], "key string, at double")
    assert {r.at: r.value for r in objects.sample_envelope(points, grid, "key").collect()} == {0.0: 5.0, 1.0: 5.0, 2.0: 6.0, 4.0: 7.0}


def test_trajectories_of_nulls(spark):
    tracks = spark.createDataFrame([(1, 0.0, 0.25, None, 10.0, None, None), (2, 0.0, 0.25, True, 10.0, None, 9.0), (3, 5.0, 1.0, True, 10.0, 5.0, 1.0), (4, None, None, True, None, None, None)], "k long, start double, end double, panned boolean, az double, el double, dist double")
    points = spark.createDataFrame([(3, "az", 5.0, 30.0), (2, "other", 1.0, 1.0), (4, "el", None, 3.0)], "k long, axis string, time double, value double")
    got = sorted((r.k, r.block, r.rtime, r.az, r.el, r.dist, r.source) for r in objects.object_trajectory(tracks, points, "k").collect())
    assert got == [(1, 0, 0.0, 0.0, 0.0, 1.0, "none"), (2, 0, 0.0, 10.0, 0.0, 1.5, "static"), (3, 0, 0.0, 30.0, 5.0, 1.0, "envelope"), (4, 0, 0.0, 0.0, 0.0, 1.0, "static")]
    assert objects.object_trajectory(tracks.where("false"), points, "k").count() == 0


def test_sends_of_nulls(spark):
    receives = spark.createDataFrame([(1, 0, None, None), (1, 0, 6, True), (1, 9, 1, False), (1, None, 2, True), (None, 3, 1, True)], "bus long, dst int, width int, audio boolean")
    buses = spark.createDataFrame([(1, 6, None, None), (2, 10, 3, 16)], "bus long, bed_width int, expected int, channels int")
    got = sorted(map(str, (tuple(r) for r in sends.inspect_sends(receives, buses, "bus").collect())))
    assert got == sorted(map(str, [(1, "collision", 0, 2), (2, "bed_missing", None, 10), (2, "unrouted", None, 3), (None, "gap", 0, 0), (None, "gap", 1, 0), (None, "gap", 2, 0)]))
    assert sends.inspect_sends(receives.where("false"), buses.where("false"), "bus").count() == 0


def test_styles_of_nulls(spark):
    asked = spark.createDataFrame([(1, "bright-master", None, None), (1, "immersive-master-atmos", -1.0, 12), (2, "unheard", -1.0, 2), (None, None, None, None)], "project long, style string, ceiling_db double, channels int")
    have = spark.createDataFrame([(1, 3, None), (1, 2, "fabfilter PRO-L"), (None, 1, "FabFilter Pro-Q")], "project long, idx long, name string")
    got = sorted((r.style, r.step, r.fx, r.detected, r.linked) for r in styles.resolve_style(asked, have, "project").collect())
    assert got == [("bright-master", 0, "ReaEQ", False, False), ("bright-master", 1, "FabFilter Pro-L", True, False), ("immersive-master-atmos", 0, "ReaEQ", False, False), ("immersive-master-atmos", 1, "ReaXcomp", False, False), ("immersive-master-atmos", 2, styles.LINKED_LIMITER, False, True)]
    assert styles.find_suites(have, "project").count() == 0


def test_names_with_several_hits(spark):
    params = spark.createDataFrame([(1, "Gain"), (2, "gain"), (3, "Gain Fine"), (4, None), (5, ""), (6, "É")], "idx long, name string")
    asked = spark.createDataFrame([("gain",), ("GAIN",), ("ain f",), ("a",), ("é",), ("",), (None,), ("gainx",), ("gain",)], "asked string")
    got = {r.asked: (r.tier, r.candidates, r.idx) for r in session.resolve_params(asked, params, "asked", "name").collect()}
    assert got == {"gain": (1, 1, 2), "GAIN": (2, 2, None), "ain f": (3, 1, 3), "a": (3, 3, None), "é": (2, 1, 6), "": (None, 0, None), None: (None, 0, None), "gainx": (None, 0, None)}
    assert sorted(r.idx for r in session.param_candidates(asked, params, "asked", "name").where("asked = 'GAIN'").collect()) == [1, 2]


def test_tables_of_few_columns(spark):
    tracks = spark.createDataFrame([(1, 0, None), (1, -1, "Master")], "project long, idx int, name string")
    assert sorted((r.idx, r.name, r.vol_db, r.pan, r.channels, r.mute) for r in S.track_list(tracks).collect()) == [(-1, "Master", 0.0, 0.0, 2, False), (0, "", 0.0, 0.0, 2, False)]
    assert [r.name for r in S.master_rows(tracks).collect()] == ["Master"]
    assert S.session_table(spark, "/no/such/folder", "fx").count() == 0
    empty = {name: spark.createDataFrame([], kinds) for name, kinds in S.TABLES.items()}
    summary = project.project_summary(spark.createDataFrame([(7, None)], "project long, name string"), *[empty[t] for t in ("tracks", "items", "markers", "tempo", "takes", "notes", "cc")]).first()
    assert (summary.name, summary.tempo, summary.length, summary.tracks, summary.cc) == ("", 120.0, 0.0, 0, 0)


def test_targets(spark):
    rows = [(None, None, None), ("5.1", 1, None), (None, 3, "N3D"), (None, 8, None), (None, 1, "odd"), ("6.1", None, None), ("7.1.4", None, None), (None, 2, None)]
    df = spark.createDataFrame(rows, "layout string, o int, norm string")
    channels, tag, error = project.parse_target(F.col("layout"), F.col("o"), F.col("norm"))
    assert [tuple(r) for r in df.select(channels, tag, error).collect()] == [(None, None, "no_target"), (None, None, "ambiguous_target"), (16, "3-order ambisonics (16ch, N3D)", None), (None, None, "bad_order"), (None, None, "bad_normalization"), (None, None, "unknown_layout"), (12, "7.1.4 bed (12ch)", None), (10, "2-order ambisonics (10ch, SN3D)", None)]
    assert [tuple(r) for r in df.limit(1).select(project.even_clamp(F.lit(1)), project.even_clamp(F.lit(9)), project.even_clamp(F.lit(500)), project.order_from_channels(F.lit(3)), project.order_from_channels(F.lit(16))).collect()] == [(2, 10, 128, 1, 3)]


def test_takes_after_a_crop(spark):
    takes = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 0), (None, 1)], "item long, idx int")
    crops = spark.createDataFrame([(1, 1), (None, None)], "item long, take int")
    assert sorted(map(str, (tuple(r) for r in edits.crop_to_active(takes, crops, ["item"]).collect()))) == sorted(map(str, [(1, 0), (2, 0), (None, 0)]))


@pytest.mark.parametrize("text,want", [('a"b\\c', '"a\\"b\\\\c"'), ("\n\t\r", '"\\n\\t\\r"'), ("\x01é", '"\\u0001é"'), (None, '""'), ("", '""')])
def test_json_strings(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(H.json_quote(F.col("t")).alias("q")).first().q == want
