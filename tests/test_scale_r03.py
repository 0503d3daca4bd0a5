"""What the findings of round 3 asked for: plans and steps whose memory does not grow with the tables, on edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from soundtable.operators import beds, deliveries, objects, scene, session, text_diff, weighting


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_looked_up_without_the_driver(spark, tmp_path):
    """All substrings of up to 40 characters against a plain search; no table of names or pieces is broadcast for a hash join."""
    draw = random.Random(5)
    names = ["".join(draw.choice("abA é") for _ in range(draw.randint(0, 40))) for _ in range(60)] + [None, "abab", "ABAB"]
    asked = {n[i : i + draw.randint(1, 36)] for n in names if n for i in (0, len(n) // 2)} | {n.upper() for n in names if n} | {"zz" * 20}
    spark.createDataFrame(list(enumerate(names)), "idx long, name string").write.parquet(str(tmp_path / "params"))  # the planner takes files for small
    params = spark.read.parquet(str(tmp_path / "params"))
    found = session.resolve_params(spark.createDataFrame([(a,) for a in asked], "asked string"), params, "asked", "name")
    assert "BroadcastHashJoin" not in plan(found)
    want = {}
    for a in asked:
        tiers = [[i for i, n in enumerate(names) if n and a and hit(a, n)] for hit in (str.__eq__, lambda a, n: a.lower() == n.lower(), lambda a, n: a.lower() in n.lower())]
        tier = next((t for t, rows in enumerate(tiers) if rows), None)
        rows = tiers[tier] if tier is not None else []
        want[a] = (None if tier is None else tier + 1, len(rows), rows[0] if len(rows) == 1 else None)
    assert {r.asked: (r.tier, r.candidates, r.idx) for r in found.collect()} == want


def test_diffs_are_not_batched_by_thousands(spark):
    """Pairs of texts go to Python in small batches, and the pairs may repeat or lack a key."""
    rows = [(None, "a\nb", "a\nc"), (1, "x", None), (1, "x", None), (2, "same", "same")]
    out = text_diff.diff_chunks(spark.createDataFrame(rows, "`the key` long, a string, b string"), "the key", "a", "b")
    assert "BatchEvalPython" in plan(out) and "InPandas" not in plan(out)
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(None, 0, "@@ -1,2 +1,2 @@", 1, 1, " a\n-b\n+c"), (1, 0, "@@ -1 +0,0 @@", 1, 0, "-x"), (1, 0, "@@ -1 +0,0 @@", 1, 0, "-x")]))


def test_render_stats_are_cut_inside_their_row(spark):
    """No exchange or sort; a key of two texts has the blocks of each, and blocks without measures stay."""
    rows = [(1, "PEAK:9;FILE:a;PEAK:-1;junk;PEAK:n/a;R M S:+inf;File:b:c;LRA:1;LRA:2e0x"), (1, "FILE:z"), (2, "PEAK:1"), (None, None), (3, "FILE:")]
    out = deliveries.parse_render_stats(spark.createDataFrame(rows, "k int, text string"), "k", "text")
    assert "Exchange" not in plan(out) and "Sort" not in plan(out)
    got = sorted((r.k, r.file_no, r.file, r.sample_peak, r.rms, r.loudness_range) for r in out.collect())
    assert got == sorted([(1, 1, "a", -1.0, float("inf"), None), (1, 2, "b:c", None, None, 2.0), (1, 1, "z", None, None, None), (3, 1, "", None, None, None)], key=lambda r: r[:3])


def test_chunks_are_weighted_in_small_batches(spark):
    """Chunks go to Python a hundred at a time; null samples are silence."""
    chunks = spark.createDataFrame([("a", 0, [1.0, None, 0.5] * 20), ("a", 60, [0.25])], "k string, frame0 long, samples array<double>")
    out = weighting.k_weight(chunks, ["k"], 60)
    assert "BatchEvalPython" in plan(out) and "ArrowEval" not in plan(out)
    assert [len(r.samples) for r in out.orderBy("frame0").collect()] == [60, 1]


def test_mean_timeline_is_the_mean_of_the_timeline(spark):
    """One row goes out for each object: equal to the mean of all decoded samples, nulls among them."""
    rows = [(i % 3 or None, float(7 * i % 360 - 180), None if i == 5 else float(i % 90), 1.0 + i % 2) for i in range(40)] + [(9, None, 0.0, 1.0)]
    traj = spark.createDataFrame(rows, "object_id long, az double, el double, gain double")
    got = {(r.object_id, r.label): r.energy for r in objects.mean_timeline(traj, "7.1.4").collect()}
    want = {(r.object_id, r.label): r.energy for r in objects.decode_timeline(traj, "7.1.4").groupBy("object_id", "label").agg(F.avg("energy").alias("energy")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert "Join" not in plan(objects.mean_timeline(traj, "7.1.4"))


def test_scenes_are_summed_in_one_row(spark):
    """One exchange makes a scene; short, long and null scenes decode as the terms that they have."""
    sources = spark.createDataFrame([(1, 1.0, 30.0, 10.0), (1, 0.5, -90.0, 0.0), (2, None, 0.0, 0.0), (None, 1.0, 0.0, 0.0)], "frame long, x double, az double, el double")
    made = scene.encode_source(sources, ["frame"], 3)
    assert plan(made).count("Exchange ") == 1 and "Generate" not in plan(made)
    assert {r.frame: len(r.acn) for r in made.collect()} == {1: 16, None: 16}
    odd = spark.createDataFrame([(0, [1.0]), (1, [0.5] * 30), (2, None), (3, []), (4, [1.0, None]), (5, [1.0] * 16)], "frame long, acn array<float>")
    few, many = ({(r.frame, r.label): r.value for r in scene.decode_scene(odd.withColumn("acn", F.slice("acn", 1, 16)), ["frame"], "7.1.4", n).collect()} for n in (16, 64))
    told = lambda rows: {k: v for k, v in rows.items() if v is not None}
    assert few.keys() == many.keys() and told(few) == pytest.approx(told(many), rel=1e-12) and {k[0] for k in few.keys() - told(few).keys()} == {2, 4}


def test_tones_of_one_file_are_made_by_many_tasks(spark):
    """The few keys are dealt out before they become rows."""
    out = beds.tone_samples(spark.range(8).coalesce(1), "id", beds.tone_plan(3), 48000.0, 4)
    assert "hashpartitioning" in plan(out) and out.count() == 8 * 3 * 4 and out.distinct().count() == 96
