"""The limiter against a loop over samples, for chunks of any length."""

import math

import numpy as np
import pytest

from soundtable.operators.limiter import limit_corpus

KEYS = ["program_id"]


def looped(x, rate, ceiling_db=-1.0, release_ms=100.0, lookahead_ms=1.5, lfe=4, linked=True):
    """(output, gains) frame by frame."""
    top = 10 ** (ceiling_db / 20) * 10 ** (-0.2 / 20)
    delay = max(1, math.floor(lookahead_ms * 0.001 * rate + 0.5))
    release = math.exp(-1 / (max(release_ms, 1.0) * 0.001 * rate))
    smooth = math.exp(-1 / (max(min(0.0002, lookahead_ms * 0.001 * 0.3), 0.00002) * rate))
    n, channels = x.shape
    padded = np.concatenate([np.zeros((3, channels)), x])
    env, out_gain, gains = [1.0] * channels, [1.0] * channels, np.ones_like(x)
    for i in range(n):
        peak = []
        for c in range(channels):
            p0, p1, p2, p3 = padded[i : i + 4, c]
            a, b, d = -0.5 * p0 + 1.5 * p1 - 1.5 * p2 + 0.5 * p3, p0 - 2.5 * p1 + 2 * p2 - 0.5 * p3, -0.5 * p0 + 0.5 * p2
            peak.append(max(abs(p1), abs(p2), *(abs(((a * t + b) * t + d) * t + p1) for t in np.arange(1, 8) / 8)))
        main = max((p for c, p in enumerate(peak) if c != lfe - 1), default=0.0)
        for c in range(channels):
            pk = 0.0 if c == lfe - 1 else main if linked else peak[c]
            env[c] = min(1 - (1 - env[c]) * release, top / pk if pk > top else 1.0)
            out_gain[c] = env[c] + (out_gain[c] - env[c]) * smooth
            gains[i, c] = 1.0 if c == lfe - 1 else out_gain[c]
    late = np.concatenate([np.zeros((delay, channels)), x])[:n]
    return late * gains, gains


@pytest.mark.parametrize("length", [1, 7, 1000])
@pytest.mark.parametrize("options", [{}, {"linked": False, "lfe": 0, "release_ms": 5.0, "ceiling_db": -6.0}])
def test_chunks_make_no_difference(spark, length, options):
    rng, rate = np.random.default_rng(1), 8000
    streams = {"loud": rng.normal(0, 1, (220, 5)), "quiet": rng.normal(0, 0.05, (130, 2)), "burst": np.concatenate([np.zeros((60, 6)), np.full((9, 6), 3.0), np.zeros((90, 6))])}
    rows = [(p, i, x.shape[1], [None if v == 0 else float(v) for v in x[i : i + length].ravel()], "other", 7) for p, x in streams.items() for i in range(0, len(x), length)]
    df = spark.createDataFrame(rows, "program_id string, frame0 long, channels int, samples array<double>, before string, gains int")
    got = {}
    for r in limit_corpus(df, KEYS, rate, **options).orderBy("frame0").collect():
        got.setdefault(r.program_id, []).append((np.reshape(r.samples, (-1, r.channels)), np.reshape(r.gains, (-1, r.channels))))
    for p, x in streams.items():
        y, gains = looped(x, rate, **options)
        assert np.allclose(np.concatenate([a for a, _ in got[p]]), y, atol=1e-10, rtol=0)
        assert np.allclose(np.concatenate([b for _, b in got[p]]), gains, atol=1e-10, rtol=0)


def test_nothing_to_limit(spark):
    empty = spark.createDataFrame([], "program_id string, frame0 long, channels int, samples array<double>")
    assert limit_corpus(empty, KEYS, 48000).count() == 0
