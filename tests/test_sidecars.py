"""Sidecars that parse as JSON, manifests by the byte, refusals one by one."""

import json

from soundtable.sources import sidecars

PROGRAMS = "program string, tool string, version string, export string, rate int, start double, end double, slice double, layout string, bed_lufs double, order int"


def test_sidecars(spark, tmp_path):
    programs = spark.createDataFrame([("a", 'to"ol', "1\t\x01", "x\\y", 48000, 0.0, 2.5, 0.1, "5.1", -23.00049, 1), ("b", None, "2", "z", 44100, 0.0, 1.0, 0.5, None, None, None)], PROGRAMS)
    roster = spark.createDataFrame([("a", 1, "R", 4, None, -20.12345, None), ("a", 0, "L", 3, -18.0005, None, 0.5)], "program string, idx int, channel string, track int, rms_db double, lufs double, active double")
    objects = spark.createDataFrame([("a", 7, "Voice é", 1, -30.0, None, None), ("a", 8, None, 2, None, None, None)], "program string, id int, label string, track int, rms_db double, lufs double, active double")
    points = spark.createDataFrame([("a", 7, 0.5, -30.25, 0.0, 1.0, 1.0), ("a", 7, 0.0, 0.0, -0.0, 1.0, None)], "program string, object int, t double, az double, el double, dist double, gain double")
    scene = spark.createDataFrame([("a", k, -10.0 * k - 0.00049) for k in (2, 0, 3, 1)], "program string, k int, rms_db double")
    sidecars.write_intent_sidecars(programs, roster, objects, points, scene, str(tmp_path))
    a, b = (json.loads((tmp_path / f"{n}.intent.json").read_text()) for n in "ab")
    assert a["producer"] == {"tool": 'to"ol', "version": "1\t\x01", "export": "x\\y"} and a["program"] == {"sampleRate": 48000, "start": 0, "end": 2.5, "sliceSec": 0.1}
    assert a["bed"] == {"layout": "5.1", "expectLufs": -23, "roster": [{"channel": "L", "track": 3, "expectRmsDb": -18.001, "expectActive": 0.5}, {"channel": "R", "track": 4, "expectLufs": -20.123}]}
    assert a["objects"] == [{"id": 7, "label": "Voice é", "track": 1, "trajectory": [{"t": 0, "az": 0, "el": 0, "dist": 1, "gain": 0}, {"t": 0.5, "az": -30.25, "el": 0, "dist": 1, "gain": 1}], "expectRmsDb": -30}, {"id": 8, "label": "", "track": 2, "trajectory": []}]
    assert a["scene"] == {"order": 1, "norm": "SN3D", "expectRmsDb": [0, -10, -20, -30]} and a["tolerances"]["dominantFrac"] == 0.9
    assert set(b) == {"intent", "producer", "program", "tolerances"} and b["producer"]["tool"] == ""


def test_manifests(spark, tmp_path):
    packages = spark.createDataFrame([("p", 'A "title"', "flac", -16.5, True), ("q", "Plain", None, None, None)], "package string, title string, codec string, normalize_to double, binaural boolean")
    sources = spark.createDataFrame([("p", 0, "main", "wavs/main.wav", "bed", "5.1"), ("p", 1, "vo_en", "wavs/vo en.wav", "bed", "stereo"), ("q", 0, "scene", "s.wav", "ambisonics", None)], "package string, idx int, name string, path string, kind string, layout string")
    voices = spark.createDataFrame([("p", 0, "en", "vo_en", "English")], "package string, idx int, lang string, vo string, label string")
    targets = spark.createDataFrame([("p", 0, "iamf", "dist/p.iamf", None, "archive"), ("p", 1, "mp4", "dist/p.mp4", "v 1.mp4", None), ("q", 0, "iamf", "dist/q.iamf", "", "")], "package string, idx int, format string, out string, video string, preset string")
    sidecars.write_package_manifests(packages, sources, voices, targets, str(tmp_path), "format: 0")
    assert (tmp_path / "p.yaml").read_text() == """format: 0
title: "A \\"title\\""
sources:
  main: { path: wavs/main.wav, kind: bed, layout: "5.1" }
  vo_en: { path: "wavs/vo en.wav", kind: bed, layout: "stereo" }
elements:
  main: { from: main }
  vo_en: { from: vo_en }
presentations:
  - id: "main-{lang}"
    languages:
      - { lang: en, vo: vo_en, label: "English" }
    elements:
      - { ref: main, headphones: binaural }
      - { ref: "{vo}" }
policy:
  codec: { name: flac }
  loudness: { mode: measure, normalize: -16.5 }
targets:
  - { format: iamf, out: dist/p.iamf, preset: archive }
  - { format: mp4, out: dist/p.mp4, video: "v 1.mp4" }
"""
    assert (tmp_path / "q.yaml").read_text().splitlines()[4:9] == ["elements:", "  scene: { from: scene }", "presentations:", "  - id: main", '    annotations: { en-us: "Plain" }']


def test_refusals(spark):
    packages = spark.createDataFrame(
        [("ok", "5.1", True, False, False, None, None, None, None), ("all", "9.1.6", None, None, True, None, None, "lpcm", True), ("deep", "5.1", False, True, False, None, 36, "opus", False), ("asked", "5.1", False, True, False, 4, 36, "opus", False), ("thin", "stereo", False, True, False, None, 3, None, None), ("none", None, True, False, False, None, None, "flac", None)],
        "package string, layout string, bed boolean, scene boolean, objects boolean, asked_order int, scene_channels int, codec string, normalize boolean",
    )
    targets = spark.createDataFrame([("ok", "iamf", None, None), ("ok", "mp4", "v.mp4", "youtube"), ("deep", "wav", "v.mp4", "youtube"), ("deep", "iamf", None, "archive"), ("thin", "mp4", "", "youtube"), ("thin", "mp4", None, "archive"), ("none", "iamf", None, "archive")], "package string, format string, video string, preset string")
    voices = spark.createDataFrame([("ok", "en"), ("ok", "de"), ("none", "EN us"), ("none", "en_us"), ("none", None), ("none", None)], "package string, lang string")
    got = sorted(tuple(r) for r in sidecars.package_refusals(packages, targets, voices).collect())
    assert got == sorted([("all", "objects_not_supported"), ("all", "unknown_layout"), ("all", "no_sources"), ("all", "normalize_with_lpcm"), ("deep", "order_beyond_package"), ("deep", "preset_target_mismatch"), ("deep", "archive_needs_flac"), ("thin", "not_a_scene_bus"), ("thin", "youtube_needs_video"), ("thin", "preset_target_mismatch"), ("none", "unknown_layout"), ("none", "duplicate_lang")])
