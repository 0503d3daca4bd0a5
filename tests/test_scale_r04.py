"""What the findings of round 4 asked for."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from soundtable.functions import harmonics
from soundtable.operators import objects, text_diff


def aligned(a, b):
    """Runs of equal lines by a whole table of lengths: a pair where lines are equal, else on in a if that loses nothing."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        below, row = best[i + 1], best[i]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    i, j, pairs = 0, 0, []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def test_texts_are_aligned_whatever_their_size(spark):
    """Middles of more than 4,000,000 cells, of few and of many different lines, against the whole table; one is a row of a table."""
    draw = random.Random(4)
    many = [f"line {draw.randrange(9000)}" for _ in range(2300)]
    edited = ["begin", *[draw.choice([x, x, x, f"new {k}"]) for k, x in enumerate(many) if draw.random() > 0.1], "end"]
    few = [[draw.choice("abc") for _ in range(n)] for n in (2100, 2050)]
    for a, b in ((["first", *many, "last"], edited), (["x", *few[0], "x"], ["y", *few[1], "y"])):
        codes = text_diff.opcodes(a, b)
        assert len(a) * len(b) > 4_000_000 and [(i + k, u + k) for kind, i, j, u, _ in codes if kind == "equal" for k in range(j - i)] == aligned(a, b)
        assert [c[1] for c in codes] + [len(a)] == [0] + [c[2] for c in codes] and [c[3] for c in codes] + [len(b)] == [0] + [c[4] for c in codes]
    got = text_diff.diff_chunks(spark.createDataFrame([(1, "\n".join(["first", *many, "last"]), "\n".join(edited))], "key long, a string, b string"), "key", "a", "b").collect()
    kept = len(aligned(["first", *many, "last"], edited))
    assert (sum(r.removed for r in got), sum(r.added for r in got)) == (len(many) + 2 - kept, len(edited) - kept) and len(got) > 1


def test_small_texts_are_aligned_by_the_same_rule():
    """Lengths around those at which rows are kept or bits are set another way, lines without a partner, one side empty."""
    draw = random.Random(5)
    for n in range(1200):
        a, b = ([draw.choice("abcdefgh"[: 1 + n % 8]) for _ in range(draw.randrange(40 if n % 10 else 130))] for _ in range(2))
        pairs = [(i + k, u + k) for kind, i, j, u, _ in text_diff.opcodes(["<", *a, ">"], [*b]) if kind == "equal" for k in range(j - i)]
        assert pairs == aligned(["<", *a, ">"], b)


def timeline(samples, layout, order):
    """A timeline in plain loops: each sample (t, seq, az, el, gain) encoded to harmonics and decoded by a speaker's harmonics, then weighted by time."""
    speakers, channels = harmonics.speakers(layout), (max(1, min(order, 7)) + 1) ** 2
    decode, samples = harmonics.basis(layout, channels), sorted(samples)
    spans = [max(b[0] - a[0], 0.0) for a, b in itertools.pairwise(samples)]
    spans = [*spans, spans[-1]] if spans else [1.0]
    weights = spans if sum(spans) > 0 else [1.0] * len(samples)
    n, slices, held, run, at = len(speakers), [], [0.0] * len(speakers), 0, None
    told = {s[0]: {"energy": 0.0, "dwell": 0.0, "slices": 0, "runs": 0} for s in speakers}
    directions = []
    for (t, seq, az, el, gain), weight in zip(samples, weights, strict=True):
        encoded = [gain * harmonics.harmonic(k, math.radians(az), math.radians(el)) for k in range(channels)]
        energies = [sum(a * b for a, b in zip(encoded, row, strict=True)) ** 2 for row in decode]
        best = max(range(n), key=lambda i: (round(energies[i] * 1e9), -i))
        run += at not in (None, best)
        mine = told[speakers[best][0]]
        mine["dwell"], mine["slices"], mine["runs"], at = mine["dwell"] + weight / sum(weights), mine["slices"] + 1, mine["runs"] + (at != best), best
        for i, e in enumerate(energies):
            held[i] += e * weight
            told[speakers[i][0]]["energy"] += e / len(samples)
        whole = sum(energies)
        slices.append((seq, speakers[best][0], run, [e / whole if whole > 1e-30 else 0.0 for e in energies]))
        a, e = math.radians(az), math.radians(el)
        directions.append((-math.sin(a) * math.cos(e), math.cos(a) * math.cos(e), math.sin(e)))
    travel = sum(math.degrees(math.acos(max(-1.0, min(1.0, sum(u * v for u, v in zip(a, b, strict=True)))))) for a, b in itertools.pairwise(directions))
    of = {"samples": len(samples), "touched": sum(v["slices"] > 0 for v in told.values()), "travel": travel, "static": travel < 1, "max_el": max(s[3] for s in samples), "min_el": min(s[3] for s in samples)}
    p = [h / sum(held) for h in held] if sum(held) > 1e-30 else None
    part = lambda axis, sign: sum(q for q, s in zip(p, speakers, strict=True) if s[1 + axis] * sign > 0)
    stats = p and {"least": min(p), "most": max(p), "cv": math.sqrt(sum((q - 1 / n) ** 2 for q in p) / n) * n, "uniformity": sum(-q * math.log(q) for q in p if q > 1e-30) / math.log(n), "dead_zones": sum(q < 0.1 / n for q in p), "top_share": sum(sorted(p)[-math.ceil(0.1 * n) :]), "front": part(1, 1), "back": part(1, -1), "left": part(0, -1), "right": part(0, 1), "upper": part(2, 1), "lower": part(2, -1), "ear_level": sum(q for q, s in zip(p, speakers, strict=True) if abs(math.degrees(math.asin(s[3]))) <= 15), "dominant": speakers[max(range(n), key=lambda i: (round(p[i] * 1e9), -i))][0]}
    rows = {s[0]: told[s[0]] | {"share": p and p[i]} | of | (stats or dict.fromkeys(STATS)) for i, s in enumerate(speakers)}
    return slices, rows


STATS = ["least", "most", "cv", "uniformity", "dead_zones", "top_share", "front", "back", "left", "right", "upper", "lower", "ear_level", "dominant"]


@pytest.mark.parametrize("layout,order", [("7.1.4", 3), ("5.1", 1), ("9.1.6", 9)])
def test_timelines_have_all_steps(spark, layout, order):
    """Encoded and decoded by harmonics sample by sample: uneven times, a long last one, a lone sample, equal times, silence, one that stands still."""
    draw = random.Random(6)
    of = {1: [(float(t), t, draw.uniform(-180, 180), draw.uniform(-90, 90), draw.uniform(0.1, 2)) for t in sorted(draw.sample(range(100), 30))]}
    of |= {2: [(5.0, 1, 90.0, 0.0, 1.0)], 3: [(7.0, i, 60.0 * i, 10.0 * i, 1.0) for i in range(5)], 4: [(float(i), i, 20.0, 0.0, 0.0) for i in range(3)], 5: [(0.0, 0, 90.0, 0.0, 1.0), (1.0, 1, 90.0, 0.0, 1.0), (10.0, 2, -90.0, 0.0, 1.0)]}
    of |= {None: [(float(i), i, 30.0, 0.1 * i, 0.5) for i in range(4)]}
    rows = [(k, *s) for k, samples in of.items() for s in samples]
    traj = spark.createDataFrame([*rows, (1, None, 900, 0.0, 0.0, 1.0), (1, 3.0, 901, None, 0.0, 1.0), (6, 1.0, 0, 0.0, None, 1.0)], "object_id long, t double, seq long, az double, el double, gain double").repartition(3)
    slices = {}
    for r in objects.decode_slices(traj, layout, ["t", "seq"], order).orderBy("object_id", "t", "seq").collect():
        slices.setdefault(r.object_id, []).append(r)
    found = objects.object_timeline(traj, layout, ["t", "seq"], order)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    told = {(r.object_id, r.label): r for r in found.select(*[c for c in found.columns if c != "speakers"], F.inline("speakers")).collect()}
    assert slices.keys() == of.keys() == {k for k, _ in told} and len(told) == len(of) * len(harmonics.speakers(layout))
    near = lambda v: pytest.approx(v, rel=1e-6, abs=1e-6) if isinstance(v, float) else v
    for k, samples in of.items():
        steps, whole = timeline(samples, layout, order)
        assert [(r.seq, r.label, r.run) for r in slices[k]] == [s[:3] for s in steps]
        assert all(r.shares == pytest.approx(s[3], abs=1e-9) and r.share == r.shares[[x[0] for x in harmonics.speakers(layout)].index(r.label)] for r, s in zip(slices[k], steps, strict=True))
        for label, want in whole.items():
            got = told[k, label].asDict()
            assert got == {c: near(v) for c, v in (want | {"object_id": k, "label": label}).items()}, (k, label)
    assert objects.object_timeline(traj.where("false"), layout, ["t", "seq"]).count() == objects.decode_slices(traj.where("false"), layout, ["t", "seq"]).count() == 0


def test_long_last_samples_count(spark):
    """The last sample counts for the time since the one before it."""
    rows = [(k, float(t), i, az, 0.0, 1.0) for k, times in enumerate([(0, 1, 10), (0, 9, 10)]) for i, (t, az) in enumerate(zip(times, (90.0, 90.0, -90.0), strict=True))]
    traj = spark.createDataFrame(rows, "object_id long, t double, seq long, az double, el double, gain double")
    dwell = {(r.object_id, s.label): s.dwell for r in objects.object_timeline(traj, "7.1.4", ["t", "seq"]).collect() for s in r.speakers if s.dwell > 0}
    assert dwell == pytest.approx({(0, "Lss"): 10 / 19, (0, "Rss"): 9 / 19, (1, "Lss"): 10 / 11, (1, "Rss"): 1 / 11})
