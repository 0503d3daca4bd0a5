"""Rotations, encoding and beams in closed form."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundtable.functions import harmonics
from soundtable.operators import scene


def encoded(x, y, z, order):
    return np.array([harmonics.at_vector(k, x, y, z) for k in range((order + 1) ** 2)])


def turned(d, yaw, pitch, roll):
    a, b, c = map(math.radians, (yaw, pitch, roll))
    x, y, z = d
    x, z = x * math.cos(c) + z * math.sin(c), -x * math.sin(c) + z * math.cos(c)  # about the front axis
    y, z = y * math.cos(b) - z * math.sin(b), y * math.sin(b) + z * math.cos(b)  # front upwards
    return x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a), z


@pytest.mark.parametrize("order", range(1, 8))
def test_rotation_turns_sources(spark, order):
    angles = (40.0, -25.0, 110.0)
    spots = harmonics.sphere(7)
    df = spark.createDataFrame([(i, encoded(*d, order).tolist()) for i, d in enumerate(spots)], "i int, acn array<double>")
    for r in df.select("i", scene.rotate_scene(F.col("acn"), *angles, order=7).alias("acn")).collect():
        assert np.allclose(r.acn, encoded(*turned(spots[r.i], *angles), order), atol=1e-10)


def test_rotations_agree(spark):
    df = spark.createDataFrame([([float(v) for v in np.random.default_rng(1).normal(size=16)],)], "acn array<double>")
    r = df.select(scene.rotate_scene(F.col("acn"), 33.0, order=3).alias("a"), scene.rotate_yaw(F.col("acn"), 33.0, 16).alias("b"), scene.rotate_scene(F.slice("acn", 1, 7), 33.0, order=3).alias("c"), scene.rotate_scene(F.lit(None).cast("array<double>"), 1.0, order=1).alias("d")).first()
    assert np.allclose(r.a, r.b, atol=1e-12) and len(r.c) == 4 and np.allclose(r.c, r.b[:4], atol=1e-12)


def test_encode_and_beam(spark):
    sources = spark.createDataFrame([("p", 0, 0.5, 30.0, 10.0), ("p", 1, 1.0, -120.0, -45.0), ("p", 1, 0.25, 0.0, 90.0), ("p", 2, None, 0.0, 0.0), ("q", 0, 1.0, None, 0.0)], "program string, frame int, x double, az double, el double")
    got = {r.frame: np.array(r.acn) for r in scene.encode_source(sources, ["program", "frame"], 7).collect()}
    assert set(got) == {0, 1}
    for k in range(64):
        assert math.isclose(got[0][k], 0.5 * harmonics.harmonic(k, math.radians(30), math.radians(10)), abs_tol=1e-9)
    whole = scene.encode_source(sources.where("frame = 0"), ["program", "frame"], 3)
    looks = [(float(a), float(e)) for a in range(-180, 180, 15) for e in range(-80, 90, 10)]
    values = {(a, e): v for a, e, v in whole.crossJoin(spark.createDataFrame(looks, "a double, e double")).select("a", "e", scene.beam(F.col("acn"), F.col("a"), F.col("e"), 3).alias("v")).collect()}
    assert max(values, key=values.get) == (30.0, 10.0) and math.isclose(values[30.0, 10.0], 0.5 * 4, abs_tol=1e-9)


@pytest.mark.parametrize("layout", ["7.1.4", 20])
def test_energies_by_products_and_projections(spark, layout, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i % 3 if i % 5 else None, rng.normal(size=16).tolist()) for i in range(60)], "program int, acn array<double>")
    sums = lambda: {(r.program, r.label): r.energy for r in scene.speaker_energies(df, ["program"], layout, 16).collect()}
    columns = sums()
    monkeypatch.setattr(scene, "COVARIANCE_CHANNELS", 1)
    projected = sums()
    assert set(columns) == set(projected) and all(math.isclose(columns[k], projected[k], rel_tol=1e-9) for k in columns)
    short = scene.speaker_energies(df.select("program", F.slice("acn", 1, 9).alias("acn")), ["program"], layout, 64).count()
    assert short == len(columns)
