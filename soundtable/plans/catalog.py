"""The registered queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from soundtable.functions import harmonics
from soundtable.functions import scalars as H
from soundtable.operators import beds, deliveries, edits, meter, notes, objects, scene, sends, session, weighting
from soundtable.plans import bindings as B
from soundtable.plans import masters, mixes, scenes, sessions
from soundtable.streaming import updates

FLAGSHIP = "check_deliverable"
QUERIES: dict = masters.QUERIES | mixes.QUERIES | scenes.QUERIES | sessions.QUERIES
ORACLE_SQL: dict = masters.ORACLE_SQL | mixes.ORACLE_SQL | scenes.ORACLE_SQL | sessions.ORACLE_SQL
P = ["program_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *names):
    return df.withColumns({n: H.rounded(F.col(n)) for n in names})


def r6(x: str) -> str:
    return f"(round(({x}) * 1000000.0::DOUBLE) / 1000000.0::DOUBLE + 0.0::DOUBLE)"


def db(p: str, floor: str = "-144.0") -> str:
    return f"(CASE WHEN {p} > 1e-24 THEN 10 * log10({p}) ELSE {floor}::DOUBLE END)"


def lufs(p: str) -> str:
    return f"(CASE WHEN {p} > 1e-24 THEN -0.691::DOUBLE + 10 * log10({p}) ELSE -144.0::DOUBLE END)"


# ---- metering

METRICS = f"SELECT program_id, {r6(db('avg(x * x)'))} AS rms_db, {r6('20 * log10(max(abs(x)))')} AS peak_db"


@query(f"WITH {B.SIGNAL} {METRICS} FROM signal GROUP BY program_id")
def channel_metrics(spark, sf):
    return rounded(meter.channel_metrics(B.signal(spark, sf), P), "rms_db", "peak_db")


@query(f"""WITH {B.MULTI}, j AS (SELECT a.program_id, a.x AS u, b.x AS v FROM multi a JOIN multi b USING (program_id, frame) WHERE a.channel = 0 AND b.channel = 1),
    s AS (SELECT program_id, count(*)::DOUBLE AS n, sum(u) su, sum(v) sv, sum(u * u) uu, sum(v * v) vv, sum(u * v) uv FROM j GROUP BY 1),
    d AS (SELECT *, sqrt(greatest((uu - su * su / n) * (vv - sv * sv / n), 0)) AS spread FROM s),
    c AS (SELECT program_id, n, CASE WHEN spread < 1e-20 THEN 0 ELSE greatest(least((uv - su * sv / n) / spread, 1), -1) END AS corr FROM d)
    SELECT program_id, n::BIGINT AS frames, {r6('corr')} AS corr, CASE WHEN corr < -0.2 THEN 'out_of_phase' WHEN corr < 0.4 THEN 'wide' ELSE 'ok' END AS band FROM c""")
def channel_correlation(spark, sf):
    out = meter.channel_correlation(B.multichannel(spark, sf), P, 0, 1)
    return rounded(out.withColumn("frames", F.col("n").cast("long")).drop("n"), "corr")


@query(f"WITH {B.SIGNAL} SELECT program_id, {r6('avg(x)')} AS dc, count(*) FILTER (abs(x) >= 0.9) AS clipped FROM signal GROUP BY 1")
def dc_clip(spark, sf):
    return rounded(meter.dc_clip(B.signal(spark, sf), P, 0.9), "dc")


@query(f"""WITH {B.SIGNAL}, n AS (SELECT program_id, count(*) AS n, least(count(*), 16) AS b FROM signal GROUP BY 1)
    SELECT program_id, ((frame + 1) * b - 1) // n AS bucket, min(x) AS low, max(x) AS high FROM signal JOIN n USING (program_id) GROUP BY 1, 2""")
def waveform_overview(spark, sf):
    return meter.waveform_overview(B.signal(spark, sf), P, 16)


GATED = f"""bins AS (SELECT program_id, frame AS bin, x * x AS power FROM signal),
    b0 AS (SELECT program_id, bin, sum(power) OVER w / 4 AS p, count(*) OVER w AS k FROM bins WINDOW w AS (PARTITION BY program_id ORDER BY bin ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    blk AS (SELECT program_id, p, {lufs('p')} AS l FROM b0 WHERE k = 4),
    g1 AS (SELECT program_id, count(*) AS total_blocks, avg(p) FILTER (l > -70) AS mean1 FROM blk GROUP BY 1),
    g2 AS (SELECT program_id, avg(p) AS mean2, count(*) AS gated_blocks FROM blk JOIN g1 USING (program_id) WHERE l > -70 AND l > {lufs('mean1')} - 10 GROUP BY 1),
    un AS (SELECT program_id, avg(power) AS pw FROM bins GROUP BY 1),
    loud AS (SELECT program_id, CASE WHEN coalesce(total_blocks, 0) = 0 THEN {lufs('pw')} ELSE {lufs('coalesce(mean2, 0)')} END AS integrated, {lufs('pw')} AS ungated,
        coalesce(total_blocks, 0) AS total_blocks, coalesce(gated_blocks, 0) AS gated_blocks, CASE WHEN coalesce(total_blocks, 0) = 0 THEN 0 ELSE coalesce(gated_blocks, 0) / total_blocks END AS activity
        FROM un LEFT JOIN g1 USING (program_id) LEFT JOIN g2 USING (program_id))"""


@query(f"WITH {B.SIGNAL}, {GATED} SELECT program_id, {r6('integrated')} AS integrated, {r6('ungated')} AS ungated, total_blocks, gated_blocks, {r6('activity')} AS activity FROM loud")
def gated_loudness(spark, sf):
    return rounded(meter.gated_loudness(meter.power_bins(B.signal(spark, sf), P, 1), P), "integrated", "ungated", "activity")


TIMELINE = f"""tl AS (SELECT program_id, frame AS bin, avg(x * x) OVER m AS pm, count(*) OVER m AS nm, avg(x * x) OVER s AS ps, count(*) OVER s AS ns FROM signal
    WINDOW m AS (PARTITION BY program_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), s AS (PARTITION BY program_id ORDER BY frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
    timeline AS (SELECT program_id, bin, {lufs('pm')} AS momentary, {lufs('ps')} AS short_term, ns = 30 AS full_window FROM tl WHERE nm = 4)"""


@query(f"WITH {B.SIGNAL}, {TIMELINE} SELECT program_id, bin, {r6('momentary')} AS momentary, {r6('short_term')} AS short_term, full_window FROM timeline")
def loudness_timeline(spark, sf):
    out = meter.loudness_timeline(meter.power_bins(B.signal(spark, sf), P, 1), P)
    return rounded(out.withColumnRenamed("full", "full_window"), "momentary", "short_term")


@query(f"""WITH {B.SIGNAL}, {TIMELINE}, af AS (SELECT program_id, bool_or(full_window) AS any_full FROM timeline GROUP BY 1),
    pool AS (SELECT program_id, short_term, pow(10, (short_term + 0.691) / 10) AS p FROM timeline JOIN af USING (program_id) WHERE (full_window OR NOT any_full) AND short_term > -70),
    gate AS (SELECT program_id, {lufs('avg(p)')} - 20 AS gate FROM pool GROUP BY 1),
    q AS (SELECT program_id, quantile_cont(short_term, 0.95) - quantile_cont(short_term, 0.1) AS lra FROM pool JOIN gate USING (program_id) WHERE short_term > gate GROUP BY 1)
    SELECT program_id, {r6('coalesce(lra, 0)')} AS lra FROM af LEFT JOIN q USING (program_id)""")
def loudness_range(spark, sf):
    return rounded(meter.loudness_range(meter.loudness_timeline(meter.power_bins(B.signal(spark, sf), P, 1), P), P), "lra")


@query(f"""WITH {B.SIGNAL}, l AS (SELECT program_id, frame AS bin, {db('avg(x * x) OVER (PARTITION BY program_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} < -20 AS quiet FROM signal),
    r AS (SELECT *, bin - row_number() OVER (PARTITION BY program_id, quiet ORDER BY bin) AS run FROM l),
    g AS (SELECT program_id, run, min(bin) AS "start", max(bin) + 1 AS "end" FROM r WHERE quiet GROUP BY 1, 2 HAVING max(bin) + 1 - min(bin) >= 2),
    e AS (SELECT program_id, max(frame) AS last FROM signal GROUP BY 1)
    SELECT program_id, "start", "end", CASE WHEN "start" = 0 AND "end" = last + 1 THEN 'all' WHEN "start" = 0 THEN 'leading' WHEN "end" = last + 1 THEN 'trailing' ELSE 'internal' END AS kind FROM g JOIN e USING (program_id)""")
def detect_silence(spark, sf):
    return meter.detect_silence(meter.power_bins(B.signal(spark, sf), P, 1), P, -20.0, 3, 2)


STEMS = "signal AS (SELECT program_id * 10 + channel AS program_id, frame, x FROM multi)"


@query(f"""WITH {B.MULTI}, {STEMS}, {GATED}, s AS (SELECT program_id // 10 AS program, program_id % 10 AS channel, integrated, pow(10, (ungated + 0.691) / 10) AS p FROM loud)
    SELECT program AS program_id, channel::INT AS channel, {r6('integrated')} AS integrated, {r6('integrated - max(integrated) OVER w')} AS delta, {r6('p / sum(p) OVER w')} AS energy_share FROM s WINDOW w AS (PARTITION BY program)""")
def stem_loudness(spark, sf):
    out = meter.stem_loudness(meter.power_bins(B.multichannel(spark, sf), ["program_id", "channel"], 1), "program_id", "channel")
    return rounded(out, "integrated", "delta", "energy_share")


FOLD = [(0, 1.0, 0.0), (1, 0.0, 1.0), (2, 0.5**0.5, 0.5**0.5), (3, 0.0, 0.0), (4, 0.5**0.5, 0.0)]
FOLDED = f"""coef(channel, l, r) AS (VALUES {', '.join(f'({c}, {a!r}::DOUBLE, {b!r}::DOUBLE)' for c, a, b in FOLD)}),
    fold AS (SELECT program_id, frame, sum(x * l) AS lo, sum(x * r) AS ro FROM multi JOIN coef USING (channel) GROUP BY 1, 2)"""


@query(f"""WITH {B.MULTI}, {FOLDED}, s AS (SELECT program_id, {db('avg(lo * lo + ro * ro)')} AS s, {db('avg((lo + ro) * 0.5 * (lo + ro) * 0.5)')} AS m FROM fold GROUP BY 1)
    SELECT program_id, {r6('s')} AS stereo_db, {r6('m')} AS mono_db, CASE WHEN m - s > -3.5 THEN 'ok' WHEN m - s > -6.5 THEN 'wide' ELSE 'cancellation' END AS verdict FROM s""")
def downmix_fold(spark, sf):
    coefficients = spark.createDataFrame(FOLD, "channel int, left double, right double")
    return rounded(meter.downmix_check(meter.downmix(B.multichannel(spark, sf), P, coefficients), P), "stereo_db", "mono_db")


@query(f"""WITH {B.MULTI}, {FOLDED}, s AS (SELECT program_id, {db(f'avg((lo + ro) * {0.5**0.5!r} * (lo + ro) * {0.5**0.5!r})')} AS m, {db(f'avg((lo - ro) * {0.5**0.5!r} * (lo - ro) * {0.5**0.5!r})')} AS s FROM fold GROUP BY 1)
    SELECT program_id, {r6('m')} AS mid_db, {r6('s')} AS side_db, {r6('s - m')} AS ratio_db FROM s""")
def mid_side(spark, sf):
    coefficients = spark.createDataFrame(FOLD, "channel int, left double, right double")
    return rounded(meter.mid_side(meter.downmix(B.multichannel(spark, sf), P, coefficients), P), "mid_db", "side_db", "ratio_db")


def _measures(spark, sf, samples, keys):
    bins = meter.power_bins(samples, keys, 1)
    loud = meter.gated_loudness(bins, keys).select(*keys, F.col("integrated").alias("lufs"))
    peak = meter.channel_metrics(samples, keys).select(*keys, F.col("peak_db").alias("true_peak"))
    short = meter.loudness_timeline(bins, keys).groupBy(*keys).agg(F.max("short_term").alias("short_term"))
    return loud.join(peak, keys).join(short, keys, "left").withColumn("channels", F.lit(1))


CHECK = f"""meas AS (SELECT program_id, integrated AS lufs, true_peak, short_term FROM loud JOIN (SELECT program_id, 20 * log10(max(abs(x))) AS true_peak FROM signal GROUP BY 1) USING (program_id)
        LEFT JOIN (SELECT program_id, max(short_term) AS short_term FROM timeline GROUP BY 1) USING (program_id)),
    chk AS (SELECT *, lufs + 19 AS delta, abs(lufs + 19) <= 1.0 + 1e-6 AS lufs_pass, NULL::BOOLEAN AS short_term_pass, true_peak <= -1 + 1e-6 AS true_peak_pass FROM meas)"""


@query(f"""WITH {B.SIGNAL}, {GATED}, {TIMELINE}, {CHECK}
    SELECT program_id, {r6('lufs')} AS lufs, {r6('true_peak')} AS true_peak, {r6('delta')} AS delta, lufs_pass, short_term_pass, true_peak_pass, coalesce(lufs_pass, true) AND coalesce(true_peak_pass, true) AS pass FROM chk""")
def check_deliverable(spark, sf):
    out = meter.check_deliverable(_measures(spark, sf, B.signal(spark, sf), P), "podcast")
    return rounded(out.drop("channels", "short_term"), "lufs", "true_peak", "delta")


@query(f"""WITH {B.MULTI}, {STEMS}, {GATED}, {TIMELINE}, {CHECK}, b AS (SELECT program_id // 10 AS program, (program_id % 10)::INT AS bed, *, lufs_pass AND true_peak_pass AS pass FROM chk)
    SELECT program AS program_id, bool_and(pass) AS pass, count(*) FILTER (NOT pass) AS failing, arg_max(bed, (true_peak, bed)) AS worst_peak_bed, arg_max(bed, (abs(delta), bed)) AS worst_lufs_bed, {r6('max(true_peak)')} AS worst_peak FROM b GROUP BY 1""")
def check_per_bed_rollup(spark, sf):
    m = B.multichannel(spark, sf)
    checked = meter.check_deliverable(_measures(spark, sf, m, ["program_id", "channel"]), "podcast")
    return rounded(meter.check_per_bed(checked, "program_id", "channel"), "worst_peak")


@query(f"WITH {B.SIGNAL} SELECT program_id, {r6('avg(CASE WHEN ' + db('x * x') + ' > -12 THEN 1.0::DOUBLE ELSE 0.0 END)')} AS active FROM signal GROUP BY 1")
def active_fraction(spark, sf):
    return rounded(meter.active_fraction(meter.power_bins(B.signal(spark, sf), P, 1), P, -12.0), "active")


# ---- scenes

FIELD = f"""SELECT {{keys}}, {r6('degrees(atan2(-ix / n, iy / n))')} AS az, {r6('degrees(atan2(iz / n, sqrt(ix / n * ix / n + iy / n * iy / n)))')} AS el,
    {r6('CASE WHEN 0.5 * (ww + dd) / n > 1e-20 THEN greatest(least(1 - sqrt(ix / n * ix / n + iy / n * iy / n + iz / n * iz / n) / (0.5 * (ww + dd) / n), 1), 0) ELSE 1 END')} AS diffuseness,
    {r6('CASE WHEN ww > 1e-20 THEN sqrt(ix / n * ix / n + iy / n * iy / n + iz / n * iz / n) * n / ww ELSE 0 END')} AS rv"""
SUMS = "count(*)::DOUBLE AS n, sum(acn[1] * acn[1]) AS ww, sum(acn[2] * acn[2] + acn[3] * acn[3] + acn[4] * acn[4]) AS dd, sum(-acn[1] * acn[2]) AS ix, sum(acn[1] * acn[4]) AS iy, sum(acn[1] * acn[3]) AS iz"


@query(f"WITH {B.SCENE}, s AS (SELECT program_id, {SUMS} FROM scene GROUP BY 1) {FIELD.format(keys='program_id')} FROM s")
def spatial_field(spark, sf):
    return rounded(scene.spatial_field(B.scene(spark, sf), P), "az", "el", "diffuseness", "rv")


@query(f"""WITH {B.SCENE}, h AS (SELECT program_id, frame // 5 AS bin, {SUMS} FROM scene GROUP BY 1, 2),
    s AS (SELECT program_id, bin, {', '.join(f'sum({c}) OVER w AS {c}' for c in ('n', 'ww', 'dd', 'ix', 'iy', 'iz'))} FROM h WINDOW w AS (PARTITION BY program_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
    {FIELD.format(keys='program_id, bin')} FROM s WHERE n = 10""")
def spatial_field_timeline(spark, sf):
    return rounded(scene.spatial_field_timeline(B.scene(spark, sf), P, 10, 5), "az", "el", "diffuseness", "rv")


def energies_sql(layout, channels=64) -> str:
    rows = [f"({i}, '{label}', {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE, {y_k!r}::DOUBLE[])" for i, ((label, x, y, z), y_k) in enumerate(zip(harmonics.speakers(layout), harmonics.basis(layout, channels), strict=True))]
    return f"""{B.SCENE}, spk(idx, label, sx, sy, sz, yk) AS (VALUES {', '.join(rows)}),
    en AS (SELECT program_id, idx, label, sx AS x, sy AS y, sz AS z, sum(list_inner_product(acn[1:{channels}], yk) * list_inner_product(acn[1:{channels}], yk)) AS energy FROM scene, spk GROUP BY ALL)"""


@query(f"""WITH {energies_sql(36)}, s AS (SELECT program_id, sum(energy * x) / sum(energy) AS x, sum(energy * y) / sum(energy) AS y, sum(energy * z) / sum(energy) AS z FROM en GROUP BY 1)
    SELECT program_id, {r6('sqrt(x * x + y * y + z * z)')} AS re, {r6('degrees(atan2(-x, y))')} AS az, {r6('degrees(atan2(z, sqrt(x * x + y * y)))')} AS el FROM s""")
def energy_vector(spark, sf):
    return rounded(scene.energy_vector(scene.speaker_energies(B.scene(spark, sf), P, 36), P), "re", "az", "el")


@query(f"""WITH {B.SCENE}, e AS (SELECT program_id, (k - 1)::INT AS k, acn[k] AS a FROM (SELECT program_id, acn, unnest(range(1, 65)) AS k FROM scene)), s AS (SELECT program_id, k, sum(a * a) AS e, avg(a * a) AS p FROM e GROUP BY 1, 2)
    SELECT program_id, k, {r6('e / sum(e) OVER (PARTITION BY program_id)')} AS share, {r6('CASE WHEN p > 1e-12 THEN 10 * log10(p) ELSE -120 END')} AS rms_db FROM s""")
def acn_energy(spark, sf):
    return rounded(scene.acn_energy(B.scene(spark, sf), P), "share", "rms_db")


@query(f"WITH {energies_sql('7.1.4')}, t AS (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY energy DESC, idx) AS rank FROM en) SELECT program_id, label, {r6('energy')} AS energy, rank::INT AS rank FROM t WHERE rank <= 5")
def decode_coverage(spark, sf):
    top = scene.top_hotspots(scene.speaker_energies(B.scene(spark, sf), P, "7.1.4"), P)
    return rounded(top.select("program_id", "label", "energy", "rank"), "energy")


@query(f"""WITH {energies_sql(64)}, p AS (SELECT *, energy / sum(energy) OVER w AS p, row_number() OVER (PARTITION BY program_id ORDER BY energy DESC, idx) AS r FROM en WINDOW w AS (PARTITION BY program_id))
    SELECT program_id, count(*) AS speakers, {r6('min(p)')} AS least, {r6('max(p)')} AS most, {r6('stddev_pop(p) * count(*)')} AS cv, {r6('sum(-p * ln(p)) / ln(count(*))')} AS uniformity, count(*) FILTER (p < 0.1 / 64) AS dead_zones,
    {r6('sum(p) FILTER (r <= 7)')} AS top_share, {r6('sum(p) FILTER (y > 0)')} AS front, {r6('sum(p) FILTER (x < 0)')} AS "left", {r6('sum(p) FILTER (z > 0)')} AS upper,
    {r6('coalesce(sum(p) FILTER (abs(degrees(atan2(z, sqrt(x * x + y * y)))) <= 15), 0)')} AS ear_level, min(label) FILTER (r = 1) AS dominant FROM p GROUP BY 1""")
def coverage_stats(spark, sf):
    out = scene.coverage_stats(scene.speaker_energies(B.scene(spark, sf), P, 64), P)
    return rounded(out, "least", "most", "cv", "uniformity", "top_share", "front", "left", "upper", "ear_level")


def _arrays(df, column="acn"):
    return df.select("program_id", "frame", F.posexplode(column).alias("k", "value")).withColumn("value", H.rounded(F.col("value").cast("double")))


@query(f"WITH {B.SCENE} SELECT program_id, frame, (k - 1)::INT AS k, {r6('acn[k] * sqrt(2 * floor(sqrt(k - 1)) + 1)')} AS value FROM (SELECT *, unnest(range(1, 65)) AS k FROM scene)")
def convert_normalization(spark, sf):
    return _arrays(B.scene(spark, sf).withColumn("acn", scene.convert_normalization(F.col("acn"), "sn3d_n3d")))


@query(f"""WITH {B.SCENE}, e AS (SELECT *, (k - 1 - l * l - l)::INT AS m FROM (SELECT *, floor(sqrt(k - 1))::INT AS l FROM (SELECT *, unnest(range(1, 65)) AS k FROM scene)))
    SELECT program_id, frame, (k - 1)::INT AS k, {r6('acn[k] * cos(radians(m * 33.0::DOUBLE)) - acn[k - 2 * m] * sin(radians(m * 33.0::DOUBLE))')} AS value FROM e""")
def rotate_yaw(spark, sf):
    return _arrays(B.scene(spark, sf).withColumn("acn", scene.rotate_yaw(F.col("acn"), 33.0)))


@query(f"WITH {B.SCENE} SELECT program_id, frame, (k - 1)::INT AS k, {r6('acn[k]')} AS value FROM (SELECT *, unnest(range(1, 10)) AS k FROM scene)")
def convert_order(spark, sf):
    return _arrays(B.scene(spark, sf).withColumn("acn", scene.convert_order(F.col("acn"), 2)))


@query(f"WITH {B.SCENE}, e AS (SELECT *, k - 1 - floor(sqrt(k - 1)) * floor(sqrt(k - 1)) - floor(sqrt(k - 1)) AS m FROM (SELECT *, unnest(range(1, 65)) AS k FROM scene)) SELECT program_id, frame, (k - 1)::INT AS k, {r6('CASE WHEN m < 0 THEN -acn[k] ELSE acn[k] END')} AS value FROM e")
def mirror_scene(spark, sf):
    return _arrays(B.scene(spark, sf).withColumn("acn", scene.mirror(F.col("acn"), "left_right")))


# ---- objects

XYZ = "xyz AS (SELECT *, -cos(radians(el)) * sin(radians(az)) AS x, cos(radians(el)) * cos(radians(az)) AS y, sin(radians(el)) AS z FROM traj)"


def decode_sql(layout: str) -> str:
    rows = [f"({i}, '{label}', {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for i, (label, x, y, z) in enumerate(harmonics.speakers(layout))]
    g = "(1 + c + (3 * c * c - 1) / 2 + (5 * c * c * c - 3 * c) / 2)"
    return f"""{B.TRAJ}, {XYZ}, spk(idx, label, sx, sy, sz) AS (VALUES {', '.join(rows)}),
    cs AS (SELECT object_id, seq, t, gain, idx, label, greatest(least(x * sx + y * sy + z * sz, 1), -1) AS c FROM xyz, spk),
    dec AS (SELECT object_id, seq, t, idx, label, {g} * {g} * gain * gain AS energy FROM cs)"""


DOMINANT = "dom AS (SELECT object_id, seq, t, arg_max(label, (round(energy * 1000000000.0::DOUBLE), -idx)) AS label FROM dec GROUP BY 1, 2, 3)"


@query(f"WITH {decode_sql('7.1.4')} SELECT object_id, label, {r6('avg(energy)')} AS energy FROM dec GROUP BY 1, 2")
def object_decode_timeline(spark, sf):
    return rounded(objects.mean_timeline(B.trajectory(spark, sf), "7.1.4"), "energy")


def _slice_sql() -> str:
    labels = [label for label, *_ in harmonics.speakers("7.1.4")]
    shares = ", ".join(f"max(CASE WHEN tot > 1e-30 THEN energy / tot ELSE 0 END) FILTER (idx = {i}) AS p{i}" for i in range(len(labels)))
    dealt = ", ".join(f"""{r6(f'p{i}')} AS "share_{label}" """ for i, label in enumerate(labels))
    dominant = " ".join(f"WHEN '{label}' THEN p{i}" for i, label in enumerate(labels))
    return f"""WITH {decode_sql('7.1.4')}, {DOMINANT}, sh AS (SELECT object_id, seq, {shares} FROM (SELECT *, sum(energy) OVER (PARTITION BY object_id, seq) AS tot FROM dec) GROUP BY 1, 2),
    c AS (SELECT *, CASE WHEN label <> lag(label) OVER w THEN 1 ELSE 0 END AS ch FROM dom WINDOW w AS (PARTITION BY object_id ORDER BY t, seq))
    SELECT object_id, seq, c.t, az, el, label, sum(ch) OVER (PARTITION BY object_id ORDER BY c.t, seq)::BIGINT AS run, {r6(f'CASE label {dominant} END')} AS share, {dealt} FROM c JOIN sh USING (object_id, seq) JOIN traj USING (object_id, seq)"""


@query(_slice_sql())
def object_decode_timeline_slices(spark, sf):
    """The timeline: the loudest speaker of each sample and the part of the energy of all."""
    slices = objects.decode_slices(B.trajectory(spark, sf), "7.1.4", ["t", "seq"])
    shares = [H.rounded(F.get("shares", i)).alias(f"share_{label}") for i, (label, *_) in enumerate(harmonics.speakers("7.1.4"))]
    return slices.select("object_id", "seq", "t", "az", "el", "label", "run", H.rounded(F.col("share")).alias("share"), *shares)


@query(f"""WITH {decode_sql('7.1.4')}, {DOMINANT},
    st AS (SELECT object_id, seq, dom.label, el, CASE WHEN lead(xyz.t) OVER w IS NOT NULL THEN greatest(lead(xyz.t) OVER w - xyz.t, 0) WHEN lag(xyz.t) OVER w IS NOT NULL THEN greatest(xyz.t - lag(xyz.t) OVER w, 0) ELSE 1 END AS span,
        dom.label IS DISTINCT FROM lag(dom.label) OVER w AS fresh, CASE WHEN lag(xyz.t) OVER w IS NULL THEN 0 ELSE degrees(acos(greatest(least(x * lag(x) OVER w + y * lag(y) OVER w + z * lag(z) OVER w, 1), -1))) END AS step
        FROM dom JOIN xyz USING (object_id, seq) WINDOW w AS (PARTITION BY object_id ORDER BY xyz.t, seq)),
    ob AS (SELECT object_id, count(*) AS samples, sum(span) AS spans, count(DISTINCT label) AS touched, sum(step) AS travel, max(el) AS max_el, min(el) AS min_el FROM st GROUP BY 1),
    wt AS (SELECT object_id, seq, label AS loudest, fresh, CASE WHEN spans > 0 THEN span ELSE 1 END AS w, CASE WHEN spans > 0 THEN spans ELSE samples END AS whole FROM st JOIN ob USING (object_id)),
    en AS (SELECT object_id, idx, label, avg(energy) AS energy, sum(energy * w) AS held, coalesce(sum(w) FILTER (loudest = label), 0) / min(whole) AS dwell, count(*) FILTER (loudest = label) AS slices, count(*) FILTER (loudest = label AND fresh) AS runs FROM dec JOIN wt USING (object_id, seq) GROUP BY 1, 2, 3),
    p AS (SELECT *, CASE WHEN sum(held) OVER o > 1e-30 THEN held / sum(held) OVER o END AS p FROM en WINDOW o AS (PARTITION BY object_id)), r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY p DESC) AS r FROM p),
    f AS (SELECT object_id, min(p) AS least, max(p) AS most, stddev_pop(p) * 11 AS cv, sum(CASE WHEN p > 1e-30 THEN -p * ln(p) ELSE 0 END) / ln(11) AS uniformity, count(*) FILTER (p < 0.1 / 11) AS dead_zones, sum(p) FILTER (r <= 2) AS top_share,
        sum(p) FILTER (sy > 0) AS front, sum(p) FILTER (sy < 0) AS back, sum(p) FILTER (sx < 0) AS "left", sum(p) FILTER (sx > 0) AS "right", sum(p) FILTER (sz > 0) AS upper, coalesce(sum(p) FILTER (sz < 0), 0) AS lower,
        sum(p) FILTER (abs(degrees(atan2(sz, sqrt(sx * sx + sy * sy)))) <= 15) AS ear_level, arg_max(label, (round(p * 1000000000.0::DOUBLE), -idx)) AS dominant FROM r JOIN spk USING (idx, label) GROUP BY 1)
    SELECT object_id, samples, touched, {r6('travel')} AS travel, travel < 1 AS static, max_el, min_el, {', '.join(f'{r6(c)} AS "{c.strip(chr(34))}"' for c in ('least', 'most', 'cv', 'uniformity', 'top_share', 'front', 'back', '"left"', '"right"', 'upper', 'lower', 'ear_level'))}, dead_zones, dominant,
        label, {r6('energy')} AS energy, {r6('p')} AS share, {r6('dwell')} AS dwell, slices, runs FROM p JOIN ob USING (object_id) JOIN f USING (object_id)""")
def object_decode_timeline_whole(spark, sf):
    """All steps of the method behind the mean energies of object_decode_timeline: its rows, and what comes of time and of the loudest speaker."""
    whole = objects.object_timeline(B.trajectory(spark, sf), "7.1.4", ["t", "seq"])
    whole = rounded(whole, "travel", "least", "most", "cv", "uniformity", "top_share", "front", "back", "left", "right", "upper", "lower", "ear_level")
    each = F.array(*[F.get("speakers", i) for i in range(len(harmonics.speakers("7.1.4")))])
    return rounded(whole.select(*[c for c in whole.columns if c != "speakers"], F.inline(each)), "energy", "share", "dwell")


@query(f"""WITH {B.TRAJ}, {XYZ}, s AS (SELECT object_id, el, degrees(acos(greatest(least(x * lag(x) OVER w + y * lag(y) OVER w + z * lag(z) OVER w, 1), -1))) AS step FROM xyz WINDOW w AS (PARTITION BY object_id ORDER BY t, seq))
    SELECT object_id, {r6('coalesce(sum(step), 0)')} AS travel, max(el) AS max_el, min(el) AS min_el, coalesce(sum(step), 0) < 1 AS static FROM s GROUP BY 1""")
def angular_travel(spark, sf):
    return rounded(objects.angular_travel(B.trajectory(spark, sf), ["t", "seq"]), "travel")


@query(f"""WITH {decode_sql('5.1')}, {DOMINANT}, c AS (SELECT *, CASE WHEN label <> lag(label) OVER w THEN 1 ELSE 0 END AS ch FROM dom WINDOW w AS (PARTITION BY object_id ORDER BY t, seq)),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY object_id ORDER BY t, seq) AS run FROM c)
    SELECT object_id, run::BIGINT AS run, min(label) AS label, min(t) AS "start", max(t) AS "end", count(*) AS samples FROM r GROUP BY 1, 2""")
def migration_runs(spark, sf):
    dominants = objects.with_dominant(B.trajectory(spark, sf), "5.1").select("object_id", "seq", "t", "label")
    return objects.migration_runs(dominants, ["t", "seq"])


@query(f"""WITH {decode_sql('5.1')}, {DOMINANT}, w0 AS (SELECT *, coalesce(greatest(lead(t) OVER w - t, 0), greatest(t - lag(t) OVER w, 0), 1) AS w FROM dom WINDOW w AS (PARTITION BY object_id ORDER BY t, seq)),
    w1 AS (SELECT object_id, label, CASE WHEN sum(w) OVER (PARTITION BY object_id) > 0 THEN w ELSE 1 END AS w FROM w0), s AS (SELECT object_id, label, sum(w) AS w FROM w1 GROUP BY 1, 2),
    d AS (SELECT object_id, label, w / sum(w) OVER (PARTITION BY object_id) AS dwell, row_number() OVER (PARTITION BY object_id ORDER BY w DESC, label) AS rank FROM s)
    SELECT object_id, label, {r6('dwell')} AS dwell, rank::INT AS rank FROM d WHERE rank <= 6 AND dwell > 0""")
def dwell_fractions(spark, sf):
    dominants = objects.with_dominant(B.trajectory(spark, sf), "5.1").select("object_id", "seq", "t", "label")
    return rounded(objects.dwell_fractions(objects.sample_weights(dominants, ["t", "seq"])), "dwell")


@query(f"""WITH {decode_sql('7.1.4')}, {DOMINANT}, w0 AS (SELECT object_id, seq, coalesce(greatest(lead(t) OVER w - t, 0), greatest(t - lag(t) OVER w, 0), 1) AS w FROM dom WINDOW w AS (PARTITION BY object_id ORDER BY t, seq)),
    w1 AS (SELECT object_id, seq, CASE WHEN sum(w) OVER (PARTITION BY object_id) > 0 THEN w ELSE 1 END AS w FROM w0), u AS (SELECT object_id, count(DISTINCT label) AS touched FROM dom GROUP BY 1),
    f AS (SELECT object_id, idx, label, sum(energy * w) AS energy FROM dec JOIN w1 USING (object_id, seq) GROUP BY 1, 2, 3), p AS (SELECT *, energy / sum(energy) OVER (PARTITION BY object_id) AS p FROM f)
    SELECT object_id, touched, {r6('stddev_pop(p) * count(*)')} AS cv, count(*) FILTER (p < 0.1 / 11) AS dead_zones, {r6('max(p)')} AS most FROM p JOIN u USING (object_id) GROUP BY 1, 2""")
def object_footprint(spark, sf):
    energies = objects.decode_footprint(B.trajectory(spark, sf), "7.1.4", ["t", "seq"])
    stats = scene.coverage_stats(energies, ["object_id", "touched"])
    return rounded(stats.select("object_id", "touched", "cv", "dead_zones", "most"), "cv", "most")


@query(f"""WITH {B.TRAJ}, b AS (SELECT object_id, seq, t AS rtime, CASE WHEN seq % 3 = 0 THEN 2.0::DOUBLE ELSE 0.0 END AS dur, seq % 2 = 0 AS jump FROM traj),
    f AS (SELECT object_id, seq, rtime, jump, CASE WHEN dur > 0 THEN dur ELSE greatest(coalesce(lead(rtime) OVER (PARTITION BY object_id ORDER BY rtime, seq), 3000.0) - rtime, 0) END AS duration FROM b)
    SELECT object_id, seq, rtime, jump, duration, CASE WHEN jump THEN rtime ELSE rtime + duration END AS reach FROM f""")
def fill_block_durations(spark, sf):
    seq = F.col("seq")
    blocks = B.trajectory(spark, sf).select("object_id", "seq", F.col("t").alias("rtime"), F.when(seq % 3 == 0, 2.0).otherwise(0.0).alias("duration"), (seq % 2 == 0).alias("jump"))
    return objects.fill_block_durations(blocks, ["object_id"], ["rtime", "seq"], F.lit(3000.0))


@query(f"""WITH pts AS (SELECT user_id AS env, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 3)::DOUBLE AS time, value FROM events),
    grid AS (SELECT DISTINCT o_custkey % 150 AS env, (o_orderkey % 200)::DOUBLE AS pos FROM orders),
    lo AS (SELECT grid.env, pos, max(time) AS t0 FROM grid LEFT JOIN pts ON pts.env = grid.env AND time <= pos GROUP BY 1, 2),
    hi AS (SELECT grid.env, pos, min(time) AS t1 FROM grid LEFT JOIN pts ON pts.env = grid.env AND time >= pos GROUP BY 1, 2),
    j AS (SELECT lo.env, lo.pos, t0, t1, a.value AS v0, b.value AS v1 FROM lo JOIN hi USING (env, pos) LEFT JOIN pts a ON a.env = lo.env AND a.time = t0 LEFT JOIN pts b ON b.env = lo.env AND b.time = t1)
    SELECT env, pos, {r6('CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR pos = t0 THEN v0 ELSE v0 + (v1 - v0) * (pos - t0) / (t1 - t0) END')} AS value FROM j""")
def sample_envelope(spark, sf):
    points = B.signal(spark, sf).select(F.col("program_id").alias("env"), ((F.col("frame") + 1) * 3).cast("double").alias("time"), (F.col("x") * 500).alias("value"))
    grid = B.table(spark, sf, "orders").select((F.col("o_custkey") % 150).alias("env"), (F.col("o_orderkey") % 200).cast("double").alias("pos"))
    return rounded(objects.sample_envelope(points, grid, "env", "pos"), "value")


# ---- notes

NK = "take_id, l_linenumber, l_partkey, l_suppkey"
HALF = "(sign({0}) * floor(abs({0}) + 0.5))"


def _note(df, *names):
    return df.select("take_id", "l_linenumber", "l_partkey", "l_suppkey", *names)


SLOT = HALF.format("start / 0.25::DOUBLE")


@query(f"WITH {B.NOTES} SELECT {NK}, {r6(f'greatest(start + 0.8::DOUBLE * ({SLOT} * 0.25 + CASE WHEN {SLOT}::BIGINT % 2 <> 0 THEN 0.3::DOUBLE * 0.25 ELSE 0 END - start), 0)')} AS start FROM notes")
def quantize_notes(spark, sf):
    return rounded(_note(B.notes(spark, sf).withColumn("start", H.quantize(F.col("start"), 0.25, 0.8, 0.3)), "start"), "start")


GROOVE = f"""g AS (SELECT take_id, ({SLOT}::BIGINT % 2)::INT AS slot, avg(start - {SLOT} * 0.25) AS o, avg(velocity / 96.0::DOUBLE) AS v FROM notes GROUP BY 1, 2),
    groove AS (SELECT take_id, slot, coalesce(o, 0) AS time_offset, coalesce(v, 1) AS vel_scale FROM (SELECT DISTINCT take_id, unnest([0, 1]) AS slot FROM notes) LEFT JOIN g USING (take_id, slot))"""


@query(f"WITH {B.NOTES}, {GROOVE} SELECT take_id, slot, {r6('time_offset')} AS time_offset, round(vel_scale * 1000000000.0::DOUBLE) / 1000000000.0::DOUBLE AS vel_scale FROM groove")
def groove_extract(spark, sf):
    return rounded(notes.extract_groove(B.notes(spark, sf)), "time_offset").withColumn("vel_scale", H.rounded(F.col("vel_scale"), 9))


@query(f"""WITH {B.NOTES}, {GROOVE}, w AS (SELECT *, ({SLOT}::BIGINT % 2)::INT AS slot FROM notes)
    SELECT {NK}, {r6('start + 0.5 * time_offset')} AS start, greatest(least({HALF.format('(round(velocity * (1 + 0.5 * (vel_scale - 1)) * 1000000000.0::DOUBLE) / 1000000000.0::DOUBLE)')}, 127), 1)::INT AS velocity FROM w JOIN groove USING (take_id, slot)""")
def groove_apply(spark, sf):
    n = B.notes(spark, sf)
    return rounded(_note(notes.apply_groove(n, notes.extract_groove(n), strength=0.5), "start", "velocity"), "start")


@query(f"""WITH {B.NOTES}, l AS (SELECT *, lead(start) OVER (PARTITION BY take_id ORDER BY {B.NOTE_ORDER_SQL}) AS nx FROM notes)
    SELECT {NK}, {r6('CASE WHEN nx IS NULL THEN length ELSE greatest(nx - start - 0.1, 0.03125) END')} AS length FROM l""")
def legato(spark, sf):
    return rounded(_note(notes.legato(B.notes(spark, sf), B.NOTE_ORDER, 0.1), "length"), "length")


@query(f"WITH {B.NOTES} SELECT {NK}, CASE WHEN pitch + 12 BETWEEN 0 AND 127 THEN pitch + 12 ELSE pitch END AS pitch FROM notes")
def transpose(spark, sf):
    return _note(B.notes(spark, sf).withColumn("pitch", H.transpose(F.col("pitch"), 12)), "pitch")


@query(f"WITH {B.NOTES} SELECT {NK}, greatest(least({HALF.format('(64 + (velocity - 64) * 1.25::DOUBLE + 3)')}, 127), 1)::INT AS velocity FROM notes")
def scale_velocity(spark, sf):
    return _note(B.notes(spark, sf).withColumn("velocity", H.scale_velocity(F.col("velocity"), 1.25, 3.0)), "velocity")


@query(f"WITH {B.NOTES} SELECT {NK}, {r6('4 + (start - 4) * 1.5::DOUBLE')} AS start FROM notes")
def stretch(spark, sf):
    return rounded(_note(B.notes(spark, sf).withColumn("start", H.stretch(F.col("start"), 1.5, 4.0)), "start"), "start")


@query(f"WITH {B.NOTES} SELECT {NK}, pitch BETWEEN 36 AND 84 AND start >= 10 AND start < 60 AS selected FROM notes")
def select_notes(spark, sf):
    return _note(notes.select_notes(B.notes(spark, sf), 36, 84, start=10.0, end=60.0), "selected")


@query(f"WITH {B.SIGNAL} SELECT program_id, frame, x FROM signal WHERE NOT (frame >= 10 AND frame < 20)")
def clear_range(spark, sf):
    return notes.clear_range(B.signal(spark, sf), 10, 20, "frame")


@query("""SELECT event_id, CASE s WHEN 160 THEN 'poly_aftertouch' WHEN 176 THEN 'cc' WHEN 192 THEN 'program_change' WHEN 208 THEN 'channel_pressure' WHEN 224 THEN 'pitch_bend' ELSE 'other' END AS type,
    CASE WHEN s = 224 THEN m2 | (m3 << 7) WHEN s IN (160, 176) THEN m3 ELSE m2 END AS value
    FROM (SELECT event_id, (128 + 16 * (event_id % 8))::INT AS s, (user_id % 128)::INT AS m2, (floor(value) % 128)::INT AS m3 FROM events)""")
def cc_decode(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", (128 + 16 * (F.col("event_id") % 8) + 3).cast("int").alias("status"), (F.col("user_id") % 128).cast("int").alias("m2"), (F.floor("value") % 128).cast("int").alias("m3"))
    return e.select("event_id", H.cc_type(F.col("status")).alias("type"), H.cc_value(F.col("status"), F.col("m2"), F.col("m3")).alias("value"))


# ---- routing and sessions


@query("""SELECT s_suppkey, dst, width, packed, CASE WHEN packed >> 10 = 0 THEN 2 WHEN packed >> 10 = 1 THEN 1 ELSE (packed >> 10) * 2 END AS decoded
    FROM (SELECT *, (dst & 1023) | (CASE width WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE width // 2 END << 10) AS packed FROM (SELECT s_suppkey, (s_suppkey % 16)::INT AS dst, (CASE WHEN s_suppkey % 3 = 2 THEN 4 + 2 * (s_suppkey % 5) ELSE 1 + s_suppkey % 3 END)::INT AS width FROM supplier))""")
def send_codec(spark, sf):
    k = F.col("s_suppkey")
    s = B.table(spark, sf, "supplier").select("s_suppkey", (k % 16).cast("int").alias("dst"), F.when(k % 3 == 2, 4 + 2 * (k % 5)).otherwise(1 + k % 3).cast("int").alias("width"))
    s = s.withColumn("packed", H.encode_send(F.col("dst"), F.col("width")))
    return s.withColumn("decoded", H.decode_send_width(F.col("packed")))


def _sends(spark, sf):
    k = F.col("s_suppkey")
    return B.table(spark, sf, "supplier").select(k.alias("source"), F.col("s_nationkey").alias("bus"), (k % 16).cast("int").alias("dst"), (1 + k % 2).cast("int").alias("width"))


@query("""WITH e AS (SELECT s_nationkey AS bus, unnest(range(s_suppkey % 16, s_suppkey % 16 + 1 + s_suppkey % 2)) AS channel FROM supplier), u AS (SELECT bus, channel, count(*) AS uses FROM e GROUP BY 1, 2),
    a AS (SELECT bus, unnest(range(0, max(channel) + 1)) AS channel FROM u GROUP BY bus)
    SELECT bus, channel::INT AS channel, coalesce(uses, 0) AS uses, CASE WHEN uses > 1 THEN 'collision' WHEN uses IS NULL THEN 'gap' END AS issue FROM a LEFT JOIN u USING (bus, channel)""")
def send_occupancy(spark, sf):
    return session.send_occupancy(_sends(spark, sf), "bus")


@query("""SELECT s_suppkey AS "from", CASE WHEN s_suppkey % 10 = 0 THEN -1 ELSE n_nationkey END AS "to", CASE WHEN s_suppkey % 10 = 0 THEN 'hwout' ELSE 'send' END AS kind, s_acctbal / 1000 AS vol_db, s_acctbal < 0 AS muted FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def routing_graph(spark, sf):
    tracks = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("idx"), F.concat(F.lit("g"), "n_nationkey").alias("guid"))
    sends = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source"), F.concat(F.lit("g"), "s_nationkey").alias("dest_guid"), (F.col("s_suppkey") % 10 == 0).alias("hardware"), (F.col("s_acctbal") / 1000).alias("vol_db"), (F.col("s_acctbal") < 0).alias("muted"))
    return session.routing_graph(tracks, sends)[1]


@query(f"""WITH t AS (SELECT n_regionkey AS map, (n_nationkey * 10)::DOUBLE AS time, (60 + 7 * n_nationkey)::DOUBLE AS bpm FROM nation),
    l AS (SELECT *, lead(time) OVER w AS until FROM t WINDOW w AS (PARTITION BY map ORDER BY time)), q AS (SELECT *, coalesce(sum((until - time) * bpm / 60) OVER (PARTITION BY map ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q0 FROM l),
    g AS (SELECT o_orderkey, (o_custkey % 5)::INT AS map, (o_orderkey % 300)::DOUBLE AS pos FROM orders)
    SELECT o_orderkey, g.map, pos, {r6('coalesce(q0 + (pos - time) * bpm / 60, pos * 2)')} AS qn FROM g LEFT JOIN q ON q.map = g.map AND pos >= time AND (until IS NULL OR pos < until)""")
def qn_time(spark, sf):
    n = F.col("n_nationkey")
    tempo = B.table(spark, sf, "nation").select(F.col("n_regionkey").alias("map"), (n * 10).cast("double").alias("time"), (60 + 7 * n).cast("double").alias("bpm"))
    grid = B.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5).cast("int").alias("map"), (F.col("o_orderkey") % 300).cast("double").alias("pos"))
    return rounded(notes.time_to_qn(grid, tempo, "map", "pos"), "qn").select("o_orderkey", "map", "pos", "qn")


@query(f"""WITH base AS (SELECT c_custkey AS track, c_acctbal / 1000 AS vol_db, 0.0::DOUBLE AS pan FROM customer),
    e AS (SELECT user_id AS track, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op, CASE WHEN event_type = 'click' THEN 'pan' ELSE 'vol_db' END AS field, value, event_id AS seq FROM events),
    l AS (SELECT track, arg_max(op, seq) AS last_op, max(seq) FILTER (op = 'delete') AS deleted FROM e GROUP BY 1),
    v AS (SELECT e.track, arg_max(value, seq) FILTER (field = 'vol_db') AS vol, arg_max(value, seq) FILTER (field = 'pan') AS pn FROM e JOIN l USING (track) WHERE op = 'set' AND (deleted IS NULL OR seq > deleted) GROUP BY 1),
    j AS (SELECT coalesce(base.track, l.track) AS track, vol_db, pan, last_op, deleted FROM base FULL JOIN l ON base.track = l.track WHERE coalesce(last_op <> 'delete', true))
    SELECT j.track, {r6("coalesce(vol, CASE WHEN deleted IS NULL THEN vol_db END)")} AS vol_db, {r6("coalesce(CASE WHEN pn IS NOT NULL THEN greatest(-1, least(1, pn / 250 - 1)) END, CASE WHEN deleted IS NULL THEN pan END)")} AS pan FROM j LEFT JOIN v USING (track)""")
def apply_edits(spark, sf):
    return _edited(spark, sf, B.table(spark, sf, "customer"))


@query(ORACLE_SQL["apply_edits"])
def apply_edits_whole(spark, sf):
    return _edited(spark, sf, B.table(spark, sf, "customer"))


def _edited(spark, sf, customers):
    tracks = customers.select(F.col("c_custkey").alias("track"), (F.col("c_acctbal") / 1000).alias("vol_db"), F.lit(0.0).alias("pan"))
    kind = F.col("event_type")
    edits = B.table(spark, sf, "events").select(F.col("user_id").alias("track"), F.when(kind == "error", "delete").otherwise("set").alias("op"), F.when(kind == "click", "pan").otherwise("vol_db").alias("field"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("seq"))
    number = F.expr("try_cast(value as double)")
    return rounded(session.apply_edits(tracks, edits, "track", {"vol_db": number, "pan": H.clamp(number / 250 - 1, -1.0, 1.0)}), "vol_db", "pan")


@query("""WITH i AS (SELECT o_orderkey AS item, (o_custkey % 50)::DOUBLE AS pos, (10 + o_orderkey % 7)::DOUBLE AS len, (o_orderkey % 70)::DOUBLE AS cut FROM orders), k AS (SELECT *, cut > pos AND cut < pos + len AS ok FROM i)
    SELECT item, ok, pos, CASE WHEN ok THEN cut - pos ELSE len END AS len FROM k UNION ALL SELECT item, ok, cut, pos + len - cut FROM k WHERE ok""")
def split_items(spark, sf):
    o = B.table(spark, sf, "orders")
    items = o.select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 50).cast("double").alias("pos"), (10 + F.col("o_orderkey") % 7).cast("double").alias("len"))
    return session.split_items(items, o.select(F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 70).cast("double").alias("cut")), "item")


ASKED = "CASE s_suppkey % 5 WHEN 0 THEN 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') WHEN 1 THEN 'cUSTOMER#' || lpad(s_suppkey::VARCHAR, 9, '0') WHEN 2 THEN '#' || lpad((s_suppkey // 10)::VARCHAR, 8, '0') WHEN 3 THEN right(lpad(s_suppkey::VARCHAR, 9, '0'), 1 + s_suppkey % 4) ELSE 'nobody ' || s_suppkey END"


@query(f"""WITH r AS (SELECT DISTINCT {ASKED} AS asked FROM supplier), m AS (SELECT asked, c_custkey AS idx, CASE WHEN asked = c_name THEN 1 WHEN lower(asked) = lower(c_name) THEN 2 ELSE 3 END AS tier FROM customer JOIN r ON contains(lower(c_name), lower(asked))),
    b AS (SELECT asked, tier, count(*) AS n, min(idx) AS idx FROM m GROUP BY 1, 2), f AS (SELECT asked, min(tier) AS tier FROM b GROUP BY 1), g AS (SELECT f.asked, f.tier, n, idx FROM f JOIN b ON b.asked = f.asked AND b.tier = f.tier)
    SELECT r.asked, tier, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN idx END AS idx FROM r LEFT JOIN g ON g.asked = r.asked""")
def param_resolve(spark, sf):
    k = F.col("s_suppkey")
    nine = F.lpad(k.cast("string"), 9, "0")
    asked = F.when(k % 5 == 0, F.concat(F.lit("Customer#"), nine)).when(k % 5 == 1, F.concat(F.lit("cUSTOMER#"), nine)).when(k % 5 == 2, F.concat(F.lit("#"), F.lpad(F.floor(k / 10).cast("string"), 8, "0"))).when(k % 5 == 3, F.right(nine, (1 + k % 4).cast("int"))).otherwise(F.concat(F.lit("nobody "), k))
    params = B.table(spark, sf, "customer").select("c_name", F.col("c_custkey").alias("idx"))
    return session.resolve_params(B.table(spark, sf, "supplier").select(asked.alias("asked")), params, "asked", "c_name")


NAMES = "CASE WHEN c_custkey % 4 = 0 THEN 'Track ' || c_custkey WHEN c_custkey % 4 = 1 THEN '' WHEN c_custkey % 4 = 2 THEN c_name ELSE '?? !' END"


@query(f"SELECT c_custkey, name = '' OR regexp_matches(name, '(?i)^(track|object|audio) ?[0-9]+$') AS default_shaped, CASE WHEN regexp_matches(s, '^_*$') THEN 'unnamed' ELSE s END AS slug FROM (SELECT *, regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') AS s FROM (SELECT c_custkey, {NAMES} AS name FROM customer))")
def name_hygiene(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Track "), k)).when(k % 4 == 1, "").when(k % 4 == 2, F.col("c_name")).otherwise("?? !")
    c = B.table(spark, sf, "customer").select("c_custkey", name.alias("name"))
    return c.select("c_custkey", H.default_shaped(F.col("name")).alias("default_shaped"), H.slug(F.col("name"), "unnamed").alias("slug"))


@query("""SELECT event_id, NOT (event_id % 50 = 0 OR name LIKE '%save project as%' OR name LIKE '%export project%') AS allowed, CASE WHEN event_id % 50 = 0 THEN 'command' WHEN name LIKE '%save project as%' THEN 'save project as' WHEN name LIKE '%export project%' THEN 'export project' END AS reason
    FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'file: save project as...' WHEN 'signup' THEN 'file: export project' ELSE 'item: ' || event_type END AS name FROM events)""")
def action_audit(spark, sf):
    kind = F.col("event_type")
    name = F.when(kind == "error", "File: Save project as...").when(kind == "signup", "File: EXPORT project").otherwise(F.concat(F.lit("Item: "), kind))
    log = B.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, 40860).otherwise(1).alias("command"), name.alias("name"))
    return session.audit_actions(log, "name", "command").select("event_id", "allowed", "reason")


LINES = """l AS (SELECT doc_id, unnest(range(len(p))) AS line_no, p FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
    d AS (SELECT doc_id, line_no, p[line_no + 1] AS line FROM l), c AS (SELECT *, CASE WHEN trim(line) LIKE '<%' THEN 1 WHEN trim(line) = '>' THEN -1 ELSE 0 END AS ch FROM d),
    lines AS (SELECT doc_id, line_no, line, sum(ch) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS depth FROM c)"""


@query(f"WITH {LINES} SELECT doc_id, line_no::INT AS line_no, depth, md5(line) AS line_md5 FROM lines")
def chunk_lines(spark, sf):
    lines = session.chunk_lines(B.table(spark, sf, "documents"), "doc_id", "text")
    return lines.select("doc_id", "line_no", "depth", F.md5("line").alias("line_md5"))


@query("""WITH r AS (SELECT o_custkey % 100 AS file, 'AP_' || lpad(hex(o_orderkey % 6), 8 - 4, '0') || lpad(lower(hex(o_custkey * 7 % 8192)), 4, '0') AS ref FROM orders),
    g AS (SELECT DISTINCT file, ref, substr(ref, 7, 1) AS type, o.n FROM r, LATERAL (SELECT ('0x' || substr(ref, 8, 4))::BIGINT AS n) o)
    SELECT file, count(*) FILTER (type = '1') AS type1, count(*) FILTER (type = '2') AS type2, count(*) FILTER (type = '3') AS type3, count(*) FILTER (type = '4') AS type4, count(*) FILTER (type = '5') AS type5, count(*) FILTER (n <= 4095) AS common, count(*) FILTER (type NOT IN ('1', '2', '3', '4', '5')) AS other FROM g GROUP BY 1""")
def pack_census(spark, sf):
    o = B.table(spark, sf, "orders")
    ref = F.concat(F.lit("AP_"), F.lpad(F.hex(F.col("o_orderkey") % 6), 4, "0"), F.lpad(F.lower(F.hex(F.col("o_custkey") * 7 % 8192)), 4, "0"))
    return session.pack_census(o.select((F.col("o_custkey") % 100).alias("file"), ref.alias("ref")), "file", "ref")


TONES = [(0, 1.0), (1, 2.0), (2, 3.5)]


@query(f"""WITH {B.MULTI}, plan(slot, hz) AS (VALUES {', '.join(f'({s}, {h}::DOUBLE)' for s, h in TONES)}),
    t AS (SELECT program_id, channel, slot, sum(x * cos(frame * hz * 2 * 3.141592653589793::DOUBLE / 10)) AS c, sum(x * sin(frame * hz * 2 * 3.141592653589793::DOUBLE / 10)) AS s FROM multi, plan GROUP BY ALL)
    SELECT program_id, channel::INT AS channel, slot, {r6('c * c + s * s')} AS power FROM t""")
def identity_tones(spark, sf):
    plan = spark.createDataFrame(TONES, "slot int, hz double")
    return rounded(session.identity_powers(B.multichannel(spark, sf), P, plan, 10.0), "power")


def _between(row):
    return "abs(" + " + ".join(f"coalesce(lag(x, {5 - i}) OVER w, 0) * {c!r}::DOUBLE" if i <= 5 else f"coalesce(lead(x, {i - 5}) OVER w, 0) * {c!r}::DOUBLE" for i, c in enumerate(row)) + ")"


@query(f"""WITH {B.SIGNAL}, p AS (SELECT program_id, greatest(abs(x), {', '.join(map(_between, meter.true_peak_taps()))}) AS m FROM signal WINDOW w AS (PARTITION BY program_id ORDER BY frame))
    SELECT program_id, {r6("CASE WHEN max(m) > 1e-12 THEN 20 * log10(max(m)) ELSE -144.0::DOUBLE END")} AS true_peak_db FROM p GROUP BY 1""")
def true_peak(spark, sf):
    return rounded(meter.true_peak(B.signal(spark, sf), P), "true_peak_db")


@query()
def humanize(spark, sf):
    return rounded(notes.humanize(B.notes(spark, sf), B.NOTE_ORDER), "start", "length")


# ---- streams, on tables


@query("""WITH e AS (SELECT time_bucket(INTERVAL '100 milliseconds', ts) AS window_start, CASE event_type WHEN 'signup' THEN ['project/state', 'project/routing'] WHEN 'view' THEN ['project/state'] ELSE ['project/state', 'track/' || user_id || '/chunk'] END AS u FROM events),
    x AS (SELECT window_start, unnest(u) AS uri FROM e) SELECT window_start, uri, count(*) AS events FROM x WHERE uri = 'project/routing' OR uri IN (SELECT 'track/' || n_nationkey || '/chunk' FROM nation) GROUP BY 1, 2""")
def coalesce_updates(spark, sf):
    kind = F.col("event_type")
    events = B.table(spark, sf, "events").select("ts", F.when(kind == "signup", "TrackList").when(kind == "view", "PlayState").otherwise("Volume").alias("kind"), F.col("user_id").alias("track"))
    subscribed = B.table(spark, sf, "nation").select(F.concat(F.lit("track/"), "n_nationkey", F.lit("/chunk")).alias("uri")).union(spark.range(1).select(F.lit("project/routing")))
    return updates.coalesce_updates(events, subscribed)


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, user_id AS track, event_type AS channel, max(value) AS most, arg_max(value, (ts, value)) AS latest FROM events GROUP BY 1, 2, 3""")
def live_peaks(spark, sf):
    return updates.live_peaks(B.table(spark, sf, "events").select("ts", F.col("user_id").alias("track"), F.col("event_type").alias("channel"), F.col("value").alias("peak")))


@query("""WITH m AS (SELECT user_id AS source, CASE event_type WHEN 'view' THEN 'yaw' WHEN 'click' THEN 'pitch' WHEN 'error' THEN 'roll' END AS axis, value, ts, event_id AS seq FROM events)
    SELECT source, arg_max(value, (ts, seq)) FILTER (axis = 'yaw') AS yaw, arg_max(value, (ts, seq)) FILTER (axis = 'pitch') AS pitch, arg_max(value, (ts, seq)) FILTER (axis = 'roll') AS roll FROM m GROUP BY 1""")
def head_orientation(spark, sf):
    kind = F.col("event_type")
    axis = F.when(kind == "view", "yaw").when(kind == "click", "pitch").when(kind == "error", "roll")
    return updates.head_orientation(B.table(spark, sf, "events").select("ts", F.col("event_id").alias("seq"), F.col("user_id").alias("source"), axis.alias("axis"), "value"))


# ---- rosters, stems against each other, thinned and sampled timelines


@query("""SELECT c_nationkey AS project, c_custkey AS number, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place FROM customer WHERE c_acctbal > 0""")
def discover_objects(spark, sf):
    name = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Object "), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("Object "), F.col("c_custkey").cast("string"), F.lit("b")))
    tracks = B.table(spark, sf, "customer").select(F.col("c_nationkey").alias("project"), name.alias("name"))
    return sends.discover_objects(tracks, ["project"]).select("project", "number", F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey AS track, (o_orderkey % 30)::BIGINT AS channels FROM orders WHERE o_orderkey % 30 IN (6, 8, 12, 16, 24)")
def detect_beds(spark, sf):
    return sends.detect_beds(B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("track"), (F.col("o_orderkey") % 30).cast("long").alias("channels")))


@query("""WITH m AS (SELECT o_custkey AS master, (o_custkey % 24)::BIGINT AS bed_width, 10 * count(*) AS objects FROM orders GROUP BY 1, 2)
    SELECT master, concat_ws(',', CASE WHEN objects > 118 THEN 'over_118' END, CASE WHEN bed_width + objects > 128 THEN 'over_128' END, CASE WHEN bed_width > 10 THEN 'wide_bed' END) AS codes, objects > 118 OR bed_width + objects > 128 AS fatal FROM m""")
def check_master_limits(spark, sf):
    masters = B.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("master")).agg((10 * F.count("*")).alias("objects")).withColumn("bed_width", F.col("master") % 24)
    return sends.check_master_limits(masters).select("master", F.array_join("codes", ",").alias("codes"), "fatal")


@query("""WITH b AS (SELECT n_nationkey AS bus, n_nationkey % 3 * 6 AS width FROM nation), o AS (SELECT c_nationkey AS bus, c_custkey AS source, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS slot FROM customer)
    SELECT bus::BIGINT AS bus, 0::BIGINT AS slot, 'bed' AS kind, -1::BIGINT AS source, 0::BIGINT AS dst, width::BIGINT AS width FROM b WHERE width > 0
    UNION ALL SELECT bus, slot, 'object', source, width + slot - 1, 1 FROM o JOIN b USING (bus)""")
def build_roster(spark, sf):
    beds = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("bus"), F.lit(-1).alias("source"), (F.col("n_nationkey") % 3 * 6).alias("width"))
    tracks = B.table(spark, sf, "customer").select(F.col("c_nationkey").alias("bus"), F.col("c_custkey").alias("source"), F.col("c_custkey").alias("number"))
    out = sends.build_roster(beds, tracks, "bus")
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("bus", "slot", "source", "dst", "width")], "kind")


@query("""WITH r AS (SELECT o_orderkey % 100 AS bus, o_orderkey AS source, o_custkey % 4 AS dst FROM orders), e AS MATERIALIZED (SELECT l_orderkey % 100 AS bus, l_orderkey AS source, row_number() OVER (PARTITION BY l_orderkey % 100 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS send_index, l_partkey % 4 AS dst, 1 + l_suppkey % 2 AS width FROM lineitem),
    j AS (SELECT r.bus, r.source AS slot, send_index, CASE WHEN send_index IS NULL THEN 'add' WHEN r.dst = e.dst AND width = 1 THEN 'reuse' ELSE 'fix' END AS action, row_number() OVER (PARTITION BY r.bus, r.source ORDER BY CASE WHEN r.dst = e.dst AND width = 1 THEN 0 ELSE 1 END, send_index) AS n FROM r LEFT JOIN e ON e.source = r.source),
    c AS MATERIALIZED (SELECT bus, slot, send_index, action FROM j WHERE n = 1)
    SELECT bus::BIGINT AS bus, slot::BIGINT AS slot, send_index, action FROM c UNION ALL SELECT e.bus, NULL, e.send_index, 'stray' FROM e LEFT JOIN c ON c.bus * 1000000 + c.send_index = e.bus * 1000000 + e.send_index WHERE c.bus IS NULL""")
def reconcile_sends(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    roster = B.table(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("bus"), F.col("o_orderkey").alias("slot"), F.col("o_orderkey").alias("source"), (F.col("o_custkey") % 4).alias("dst"), F.lit(1).alias("width"))
    lines = B.table(spark, sf, "lineitem").withColumn("bus", F.col("l_orderkey") % 100)
    existing = notes.ordered(lines, "bus", order, "send_index").select("bus", (F.col("send_index") + 1).alias("send_index"), F.col("l_orderkey").alias("source"), (F.col("l_partkey") % 4).alias("dst"), (1 + F.col("l_suppkey") % 2).alias("width"))
    return sends.reconcile_sends(roster, existing)


@query(f"""SELECT program_id, arg_max(channel, (integrated, -channel)) AS channel, max(integrated) AS integrated FROM ({ORACLE_SQL["stem_loudness"]}) GROUP BY 1""")
def loudest_stem(spark, sf):
    return weighting.loudest(stem_loudness(spark, sf), "program_id", "channel", "integrated")


@query(f"""SELECT p.program_id, {r6('p.integrated')} AS program_lufs, {r6('d.integrated')} AS dialog_lufs, {r6('d.activity')} AS activity, {r6('CASE WHEN p.integrated > -143 AND d.integrated > -143 THEN p.integrated - d.integrated END')} AS offset_lu
    FROM (WITH {B.SIGNAL}, {GATED} SELECT * FROM loud) p LEFT JOIN (WITH {B.MULTI}, signal AS (SELECT program_id, frame, x FROM multi WHERE channel = 0), {GATED} SELECT * FROM loud) d USING (program_id)""")
def dialog_loudness(spark, sf):
    spoken = meter.power_bins(B.multichannel(spark, sf).where("channel = 0"), P, 1)
    out = weighting.dialog_loudness(spoken, meter.power_bins(B.signal(spark, sf), P, 1), P)
    return rounded(out, "program_lufs", "dialog_lufs", "activity", "offset_lu")


@query(f"""WITH {B.SIGNAL}, taps(k, h) AS (SELECT generate_subscripts(h, 1) - 1, unnest(h) FROM (SELECT {mixes.TAPS!r}::DOUBLE[] AS h)),
    y AS (SELECT s.program_id, s.frame, sum(p.x * h) AS y FROM signal s JOIN taps ON k <= s.frame JOIN signal p ON p.program_id = s.program_id AND p.frame = s.frame - k GROUP BY 1, 2)
    SELECT program_id, {r6(lufs('avg(y * y)'))} AS k_level FROM y GROUP BY 1""")
def k_weighted_level(spark, sf):
    """The table's frames taken as samples at 48 kHz. SQL convolves with the filters' response to one impulse, longer than any of these programs."""
    chunks = weighting.k_weight(weighting.chunk_samples(B.signal(spark, sf), P, 48_000), P, 48_000)
    samples = chunks.select(*P, "frame0", F.posexplode("samples").alias("i", "x")).select(*P, (F.col("frame0") + F.col("i")).alias("frame"), "x")
    return rounded(samples.groupBy(*P).agg(H.lufs(F.avg(F.col("x") * F.col("x"))).alias("k_level")), "k_level")


@query(f"""WITH {B.TRAJ}, pts AS (SELECT object_id, t, min(seq) AS seq FROM traj GROUP BY 1, 2), v AS (SELECT p.object_id, p.t, -cos(radians(el)) * sin(radians(az)) * 2 AS x, cos(radians(el)) * cos(radians(az)) * 2 AS y, sin(radians(el)) * 2 AS z, gain FROM pts p JOIN traj USING (object_id, seq)),
    g AS (SELECT object_id, s AS slice, (s + 0.5::DOUBLE) * 100 AS t FROM (SELECT DISTINCT object_id FROM traj), range(24) r(s)),
    m AS (SELECT g.object_id, slice, g.t, a.t AS ta, b.t AS tb, a.x AS px, a.y AS py, a.z AS pz, a.gain AS pg, b.x AS qx, b.y AS qy, b.z AS qz, b.gain AS qg FROM g ASOF LEFT JOIN v a ON g.object_id = a.object_id AND g.t >= a.t ASOF LEFT JOIN v b ON g.object_id = b.object_id AND g.t < b.t)
    SELECT object_id, slice::BIGINT AS slice, t, """ + ", ".join(f"{r6(f'CASE WHEN ta IS NULL THEN q{c} WHEN tb IS NULL THEN p{c} ELSE p{c} + (t - ta) / (tb - ta) * (q{c} - p{c}) END')} AS {n}" for c, n in (("x", "x"), ("y", "y"), ("z", "z"), ("g", "gain"))) + " FROM m")
def sample_trajectory(spark, sf):
    traj = B.trajectory(spark, sf).withColumn("dist", F.lit(2.0))
    one = traj.groupBy("object_id", "t").agg(F.min_by(F.struct("az", "el", "dist", "gain"), "seq").alias("p")).select("object_id", "t", "p.*")
    spans = traj.select("object_id").distinct().withColumns({"start": F.lit(0.0), "end": F.lit(2400.0)})
    return rounded(objects.sample_trajectory(one, spans, "object_id", 100.0), "x", "y", "z", "gain")


@query(f"""WITH {B.SIGNAL}, n AS (SELECT program_id, count(*) AS n FROM signal GROUP BY 1),
    k AS (SELECT DISTINCT program_id, CASE WHEN n <= 8 THEN r ELSE (2 * r * (n - 1) + 7) // 14 END AS frame FROM n, range(8) t(r) WHERE r < n)
    SELECT program_id, frame, x FROM signal JOIN k USING (program_id, frame)""")
def thin_timeline(spark, sf):
    return objects.thin_timeline(B.signal(spark, sf), P, ["frame"], 8).drop("idx")


@query("""SELECT event_id, row_number() OVER w - 1 AS take, first_value(event_id) OVER w AS "into" FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def implode_to_takes(spark, sf):
    items = B.table(spark, sf, "events").where("event_type = 'click'")
    return session.implode_to_takes(items, ["user_id"], ["ts", "event_id"], "event_id").select("event_id", F.col("take").cast("long").alias("take"), "into")


BLOCKED = "(SELECT doc_id, '<TRACK' || chr(10) || text || chr(10) || '>' AS text FROM documents)"


@query(f"""WITH {LINES.replace("FROM documents", "FROM " + BLOCKED)}, f AS (SELECT doc_id, min(depth) AS least, arg_max(depth, line_no) AS open FROM lines GROUP BY 1) SELECT doc_id, open, least >= 0 AND open = 0 AS valid FROM f""")
def validate_chunks(spark, sf):
    text = F.concat(F.lit("<TRACK\n"), F.col("text"), F.lit("\n>"))
    docs = B.table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return session.validate_chunks(session.chunk_lines(docs, "doc_id", "text"), "doc_id")


@query(f"WITH {B.SIGNAL}, c AS (SELECT *, count(*) OVER (PARTITION BY program_id) AS point_count FROM signal) SELECT program_id, frame AS time, x, point_count FROM c WHERE frame BETWEEN 3 AND 10")
def envelope_window(spark, sf):
    return notes.envelope_window(B.signal(spark, sf).withColumnRenamed("frame", "time"), P, 3, 10)


# ---- deliveries


@query(f"""SELECT o_custkey AS stats, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS file_no, 'mix' || o_orderkey || '.wav' AS file, {r6('-(o_totalprice / 10000)')} AS lufs_integrated, CASE WHEN o_orderkey % 2 = 0 THEN -(o_orderkey % 20)::DOUBLE END AS true_peak FROM orders""")
def parse_render_stats(spark, sf):
    o = B.table(spark, sf, "orders")
    peak = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("-"), (F.col("o_orderkey") % 20).cast("string"))).otherwise("n/a")
    one = F.concat(F.lit("FILE:mix"), F.col("o_orderkey").cast("string"), F.lit(".wav;LUFS-I:5;LUFSI:-"), F.format_string("%.8f", F.col("o_totalprice").cast("double") / 10000), F.lit(";True Peak:"), peak)
    texts = o.groupBy(F.col("o_custkey").alias("stats")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", one.alias("one")))).alias("all")).select("stats", F.concat(F.lit("RMS:1;"), F.array_join("all.one", ";")).alias("text"))
    out = deliveries.parse_render_stats(texts, "stats", "text").withColumn("true_peak", F.col("true_peak") + 0.0)
    return rounded(out.select("stats", F.col("file_no").cast("long").alias("file_no"), "file", "lufs_integrated", "true_peak"), "lufs_integrated")


PLACES = "places(descriptor, paz, pel, spread) AS (VALUES ('front', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('wide', NULL, 0.0, 45.0), ('side-right', -105.0, 0.0, 20.0), ('voice-of-god', 0.0, 90.0, 0.0), ('height', NULL, 45.0, 20.0), ('nowhere', 1000.0, 0.0, 0.0))"
ASKED = ["Front", " wide", "Side_Right", "Voice of God", "height ", "nowhere"]


@query(f"""WITH {PLACES}, s AS (SELECT o_orderkey AS stem, ['front', 'wide', 'side-right', 'voice-of-god', 'height', 'nowhere'][1 + (o_orderkey % 6)::INT] AS descriptor, (o_custkey % 90)::DOUBLE AS source_az, CASE WHEN o_orderkey % 7 = 0 THEN 12.0::DOUBLE END AS az FROM orders)
    SELECT stem, CASE WHEN az IS NOT NULL THEN az WHEN descriptor <> 'nowhere' THEN coalesce(paz, source_az) END AS az, CASE WHEN descriptor <> 'nowhere' THEN pel END AS el, CASE WHEN descriptor <> 'nowhere' THEN spread END AS spread, CASE WHEN descriptor = 'nowhere' AND az IS NULL THEN 'unknown_descriptor' END AS error FROM s JOIN places USING (descriptor)""")
def apply_placement(spark, sf):
    key = F.col("o_orderkey")
    asked = F.get(F.array(*[F.lit(a) for a in ASKED]), (key % 6).cast("int"))
    stems = B.table(spark, sf, "orders").select(key.alias("stem"), asked.alias("descriptor"), (F.col("o_custkey") % 90).cast("double").alias("source_az"), F.when(key % 7 == 0, 12.0).alias("az"), F.lit(None).cast("double").alias("el"))
    return deliveries.apply_placement(stems).select("stem", "az", "el", "spread", "error")


@query("""WITH t AS (SELECT c_nationkey AS project, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx, c_mktsegment AS name FROM customer), n AS (SELECT project, name, min(idx) AS idx FROM t GROUP BY 1, 2),
    r AS (SELECT c_nationkey AS project, c_custkey AS request, CASE c_custkey % 3 WHEN 0 THEN 'master' WHEN 1 THEN c_mktsegment ELSE (c_custkey % 40)::VARCHAR END AS want FROM customer),
    f AS (SELECT r.*, CASE WHEN want = 'master' THEN -1 WHEN try_cast(want AS INT) IS NOT NULL THEN t.idx ELSE n.idx END AS idx FROM r LEFT JOIN t ON r.project = t.project AND try_cast(want AS INT) = t.idx LEFT JOIN n ON r.project = n.project AND want = n.name)
    SELECT project, request, want, idx::BIGINT AS idx, CASE WHEN idx IS NULL THEN 'target_not_found' WHEN row_number() OVER (PARTITION BY project, idx ORDER BY request) > 1 THEN 'duplicate_stem' END AS error FROM f""")
def resolve_targets(spark, sf):
    c = B.table(spark, sf, "customer").withColumn("project", F.col("c_nationkey"))
    tracks = notes.ordered(c, "project", ["c_custkey"]).select("project", "idx", F.col("c_mktsegment").alias("name"))
    want = F.when(F.col("c_custkey") % 3 == 0, "master").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).otherwise((F.col("c_custkey") % 40).cast("string"))
    return deliveries.resolve_targets(c.select("project", F.col("c_custkey").alias("request"), want.alias("want")), tracks).withColumn("idx", F.col("idx").cast("long"))


@query("""SELECT o_orderkey AS track, CASE WHEN o_custkey % 5 > 0 THEN md5('<TRACK' || chr(10) || '  NAME new' || o_custkey || chr(10) || '  <FX' || chr(10) || '  PAN 9' || chr(10) || '  >' || chr(10) || '  PAN 1' || chr(10) || '  NAME b' || chr(10) || '>') END AS text_md5, CASE WHEN o_custkey % 5 > 0 THEN '' ELSE 'VOL' END AS missing FROM orders""")
def patch_keys(spark, sf):
    o = B.table(spark, sf, "orders").withColumn("track", F.col("o_orderkey"))
    text = F.concat(F.lit("<TRACK\n  NAME "), F.col("o_orderkey").cast("string"), F.lit("\n  <FX\n  PAN 9\n  >\n  PAN 0\n  NAME b\n>"))
    name = F.struct(F.lit("NAME").alias("name"), F.concat(F.lit("new"), F.col("o_custkey").cast("string")).alias("value"))
    other = F.struct(F.when(F.col("o_custkey") % 5 > 0, "PAN").otherwise("VOL").alias("name"), F.lit("1").alias("value"))
    lines = session.chunk_lines(o.select("track", text.alias("text")), "track", "text")
    out = deliveries.patch_keys(lines, o.select("track", F.inline(F.array(name, other))), "track")
    return out.select("track", F.md5("text").alias("text_md5"), F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {B.TRAJ}, b AS (SELECT object_id, seq, row_number() OVER (PARTITION BY object_id ORDER BY t, seq) = 1 AS first, CASE seq % 3 WHEN 0 THEN 250.0::DOUBLE / 48000 WHEN 1 THEN 0.0 END AS i FROM traj)
    SELECT object_id, seq, {r6('CASE WHEN first THEN 0 ELSE 250.0::DOUBLE / 48000 END')} AS ramp, coalesce(abs(i - CASE WHEN first THEN 0 ELSE 250.0::DOUBLE / 48000 END) <= 0.0001, first) AS ok FROM b""")
def check_ramp(spark, sf):
    length = F.when(F.col("seq") % 3 == 0, 250.0 / 48000).when(F.col("seq") % 3 == 1, 0.0)
    out = deliveries.check_ramp(B.trajectory(spark, sf).withColumn("interpolation", length), ["object_id"], ["t", "seq"], F.lit(48000.0))
    return rounded(out.select("object_id", "seq", "ramp", "ok"), "ramp")


# ---- beds, objects and routing verdicts

WIDTHS = [1, 2, 6, 8, 12, 16, 24, 5]
BED_LABELS = ", ".join(f"({n}, {i}, '{x}')" for n, names in beds.LABELS.items() for i, x in enumerate(names))
BED_NAMES = " ".join(f"WHEN {n} THEN '{x}'" for n, x in beds.NAMES.items())


@query(f"""WITH d(width, channel, label) AS (VALUES {BED_LABELS}), c AS (SELECT event_id, [{', '.join(map(str, WIDTHS))}][(user_id % 8 + 1)::INT] AS width FROM events), r AS (SELECT event_id, width, (event_id % width)::INT AS channel FROM c),
    l AS (SELECT event_id, width, channel, coalesce(label, 'ch' || channel) AS label, (width >= 6 AND channel = 3) OR (width = 24 AND channel = 9) AS lfe FROM r LEFT JOIN d USING (width, channel))
    SELECT event_id, CASE width {BED_NAMES} ELSE 'multichannel' END AS layout, label, lfe, CASE WHEN lfe THEN 0.0::DOUBLE WHEN label IN ('Ls', 'Rs', 'Lss', 'Rss', 'Lw', 'Rw') THEN 1.41::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM l""")
def label_channels(spark, sf):
    width = F.element_at(F.array(*map(F.lit, WIDTHS)), (F.col("user_id") % 8 + 1).cast("int"))
    rows = B.table(spark, sf, "events").select("event_id", width.alias("width")).withColumn("channel", (F.col("event_id") % F.col("width")).cast("int"))
    return beds.label_channels(rows).select("event_id", "layout", "label", "lfe", "weight")


@query(f"""WITH {B.MULTI}, {STEMS}, {GATED}, s AS (SELECT program_id // 10 AS program, program_id % 10 AS channel, integrated, CASE WHEN ungated > -143 THEN pow(10, (ungated + 0.691) / 10) ELSE 0 END AS p FROM loud),
    bed AS (SELECT program, integrated AS bed FROM s WHERE channel = 0)
    SELECT program AS program_id, channel::INT AS channel, {r6('integrated')} AS integrated, {r6('integrated - max(integrated) OVER w')} AS delta, {r6('CASE WHEN sum(p) OVER w > 1e-30 THEN p / sum(p) OVER w ELSE 0 END')} AS energy_share,
    {r6('CASE WHEN bed > -143 AND max(integrated) OVER w > -144 THEN bed - max(integrated) OVER w END')} AS bed_vs_objects FROM s LEFT JOIN bed USING (program) WHERE channel > 0 WINDOW w AS (PARTITION BY program)""")
def object_loudness(spark, sf):
    rows = B.multichannel(spark, sf)
    bed = meter.power_bins(rows.where("channel = 0"), P, 1)
    out = beds.object_loudness(meter.power_bins(rows.where("channel > 0"), ["program_id", "channel"], 1), "program_id", "channel", bed)
    return rounded(out.drop("ungated", "activity"), "integrated", "delta", "energy_share", "bed_vs_objects")


@query(f"""WITH {B.MULTI}, f AS (SELECT program_id, frame, max(x) FILTER (channel = 0) AS u, max(x) FILTER (channel = 1) AS v FROM multi WHERE program_id IN (SELECT program_id FROM multi GROUP BY 1 HAVING max(channel) + 1 NOT IN (1, 6, 8, 12, 16, 24)) GROUP BY 1, 2),
    s AS (SELECT program_id, count(*)::DOUBLE AS n, sum(u) su, sum(v) sv, sum(u * u) uu, sum(v * v) vv, sum(u * v) uv, sum((u + v) * (u + v) / 2) mm, sum((u - v) * (u - v) / 2) ss FROM f WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY 1),
    d AS (SELECT *, sqrt(greatest((uu - su * su / n) * (vv - sv * sv / n), 0)) AS spread FROM s),
    c AS (SELECT program_id, {db('uu / n')} - {db('vv / n')} AS balance, CASE WHEN spread < 1e-20 THEN 0 ELSE greatest(least((uv - su * sv / n) / spread, 1), -1) END AS corr, {db('ss / n')} - {db('mm / n')} AS side_to_mid FROM d)
    SELECT program_id, {r6('balance')} AS balance, {r6('corr')} AS corr, {r6('side_to_mid')} AS side_to_mid, CASE WHEN corr IS NULL THEN 'not_binaural' WHEN corr < -0.2 THEN 'out_of_phase' WHEN side_to_mid < -20 THEN 'near_mono' WHEN abs(balance) > 3 THEN 'lopsided' ELSE 'healthy' END AS verdict
    FROM (SELECT DISTINCT program_id FROM multi) LEFT JOIN c USING (program_id)""")
def binaural_verdict(spark, sf):
    return rounded(beds.binaural_verdict(B.multichannel(spark, sf), P), "balance", "corr", "side_to_mid")


@query(f"""WITH r AS (SELECT o_orderkey AS request, (o_orderkey % 120 - 10)::DOUBLE AS s, (o_orderkey % 31 - 3)::DOUBLE AS d, 2.0::DOUBLE AS a, (o_custkey % 100)::DOUBLE AS z FROM orders),
    w AS (SELECT *, least(greatest(s, a), z) AS lo, CASE WHEN d <= 0 THEN z ELSE least(greatest(s + d, a), z) END AS hi FROM r),
    e AS (SELECT *, CASE WHEN z <= a THEN 'empty_source' WHEN hi <= lo THEN 'empty_window' END AS error FROM w)
    SELECT request, CASE WHEN error IS NULL THEN lo END AS read_start, CASE WHEN error IS NULL THEN floor((hi - lo) * 10 + 0.5)::BIGINT END AS frames, CASE WHEN error IS NULL THEN s < a - 1e-6 OR (d > 0 AND s + d > z + 1e-6) END AS clamped, error FROM e""")
def window_clamp(spark, sf):
    o = B.table(spark, sf, "orders")
    request = o.select(F.col("o_orderkey").alias("request"), (F.col("o_orderkey") % 120 - 10).cast("double").alias("start"), (F.col("o_orderkey") % 31 - 3).cast("double").alias("duration"), F.lit(2.0).alias("source_start"), (F.col("o_custkey") % 100).cast("double").alias("source_end"))
    return beds.window_clamp(request, 10.0).select("request", "read_start", "frames", "clamped", "error")


@query(f"""WITH r AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), a AS (SELECT k, (c % 360 - 180)::DOUBLE AS cur, CASE WHEN k % 7 = 0 THEN (k % 360 - 180)::DOUBLE END AS az, CASE WHEN k % 5 = 0 THEN (k % 181 - 90)::DOUBLE END AS el,
    CASE WHEN k % 3 > 0 THEN (k % 8 - 3.5::DOUBLE) / 3 END AS x, CASE WHEN k % 2 = 0 THEN (c % 8 - 3.5::DOUBLE) / 3 END AS y, CASE WHEN c % 2 = 0 THEN (k % 10 - 4.5::DOUBLE) / 3 END AS z FROM r),
    t AS (SELECT k, coalesce(az, CASE WHEN x IS NOT NULL OR y IS NOT NULL THEN degrees(atan2(-coalesce(x, -sin(radians(cur))), coalesce(y, cos(radians(cur))))) END) AS az, coalesce(el, degrees(asin(CASE WHEN z IS NOT NULL THEN greatest(least(z, 1), -1) END))) AS el FROM a)
    SELECT k, {r6('az')} AS az, {r6('el')} AS el, {r6('1.5 * cos(radians(el)) * cos(radians(az))')} AS front, {r6('1.5 * cos(radians(el)) * sin(radians(az))')} AS "left", {r6('1.5 * sin(radians(el))')} AS up FROM t""")
def compose_target(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    az, el = F.when(k % 7 == 0, (k % 360 - 180).cast("double")), F.when(k % 5 == 0, (k % 181 - 90).cast("double"))
    x, y, z = F.when(k % 3 > 0, (k % 8 - 3.5) / 3), F.when(k % 2 == 0, (c % 8 - 3.5) / 3), F.when(c % 2 == 0, (k % 10 - 4.5) / 3)
    az, el = beds.compose_target(az, el, x, y, z, (c % 360 - 180).cast("double"))
    out = B.table(spark, sf, "orders").select(k.alias("k"), az.alias("az"), el.alias("el"))
    front, left, up = beds.place_at_distance(F.lit(1.5), F.col("az"), F.col("el"))
    return rounded(out.withColumns({"front": front, "left": left, "up": up}), "az", "el", "front", "left", "up")


ROLE_NAMES = ["Azimuth 1", "Elevation", "Distance 2", "Pos X", "Quat X", "Pos Y 1", "Quat Y 1", "Size Z", "Gain", "Azim 2", "Mix", "Quat Z"]


@query(f"""WITH n AS (SELECT p_partkey // 6 AS fx, p_partkey AS idx, lower([{', '.join(f"'{x}'" for x in ROLE_NAMES)}][((p_partkey * 7 + p_partkey // 6) % 12 + 1)::INT]) AS name FROM part),
    k(role, part) AS (VALUES ('azimuth', 'azim'), ('elevation', 'elev'), ('distance', 'dist'), ('x', 'x'), ('y', 'y'), ('z', 'z')),
    m AS (SELECT fx, role, idx, contains(name, '1') AS num, length(role) = 1 AND contains(name, 'quat') AS quat FROM n JOIN k ON contains(name, part)),
    b AS (SELECT fx, role, coalesce(min(idx) FILTER (num AND NOT quat), min(idx) FILTER (NOT quat)) AS idx, min(idx) FILTER (num AND NOT quat) AS stop, min(idx) FILTER (quat) AS q FROM m GROUP BY 1, 2),
    w AS (SELECT fx, max(idx) FILTER (role = 'azimuth') AS azimuth, max(idx) FILTER (role = 'elevation') AS elevation, max(idx) FILTER (role = 'distance') AS distance, max(idx) FILTER (role = 'x') AS x, max(idx) FILTER (role = 'y') AS y, max(idx) FILTER (role = 'z') AS z,
        coalesce(bool_or(q IS NOT NULL AND (stop IS NULL OR q < stop)), false) AS quat FROM (SELECT DISTINCT fx FROM n) LEFT JOIN b USING (fx) GROUP BY 1)
    SELECT fx, azimuth, elevation, distance, CASE WHEN azimuth IS NULL THEN x END AS x, CASE WHEN azimuth IS NULL THEN y END AS y, CASE WHEN azimuth IS NULL THEN z END AS z, azimuth IS NULL AND quat AS skipped_quaternion FROM w""")
def param_roles(spark, sf):
    name = F.element_at(F.array(*map(F.lit, ROLE_NAMES)), F.expr("int((p_partkey * 7 + p_partkey div 6) % 12 + 1)"))
    params = B.table(spark, sf, "part").select(F.expr("p_partkey div 6").alias("fx"), F.col("p_partkey").alias("idx"), name.alias("name"))
    return beds.param_roles(params, ["fx"], "idx", "name")


@query("""SELECT event_id, coalesce(event_id % 50 = 0 OR event_type = 'signup', false) AS allowed, CASE WHEN event_id % 50 = 0 OR event_type = 'signup' THEN NULL ELSE 'not_listed' END AS reason FROM events""")
def action_allow_list(spark, sf):
    log = B.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, 40860).otherwise(1).alias("command"), F.concat(F.lit("Item: "), F.upper("event_type")).alias("name"))
    return session.audit_actions(log, "name", "command", allowed_ids=(40860,), allowed_phrases=("signup",)).select("event_id", "allowed", "reason")


ROUTED = [(0, 0.7), (1, 1.3), (2, 1.9), (3, 2.6), (4, 3.7)]
ROUTED_HZ = f"[{', '.join(str(h) + '::DOUBLE' for _, h in ROUTED)}]"


@query(f"""WITH {B.MULTI}, v AS (SELECT program_id, channel, frame, x * 0.01 AS noise, CASE WHEN program_id % 6 = 1 AND channel < 2 THEN 1 - channel WHEN program_id % 6 = 2 AND channel = 2 THEN 0 WHEN program_id % 6 = 3 AND channel IN (3, 4) THEN 7 - channel ELSE channel END AS slot,
        CASE WHEN program_id % 6 = 3 AND channel = 0 THEN 0 WHEN program_id % 6 = 4 AND channel = 1 THEN 0.0000001 ELSE 1 END AS level FROM multi),
    rows AS (SELECT program_id, channel, frame, (noise + sin(frame * {ROUTED_HZ}[slot + 1] * (2 * pi() / 10))) * level AS x FROM v),
    plan(slot, hz) AS (VALUES {', '.join(f'({s}, {h}::DOUBLE)' for s, h in ROUTED)}),
    t AS (SELECT program_id, channel, slot, sum(x * cos(frame * (2 * pi() / 10) * hz)) AS c, sum(x * sin(frame * (2 * pi() / 10) * hz)) AS s FROM rows, plan GROUP BY ALL), p AS (SELECT program_id, channel, slot, c * c + s * s AS p FROM t),
    m AS (SELECT program_id, channel, count(*) AS n, sqrt(avg(x * x)) AS rms FROM rows GROUP BY ALL), l AS (SELECT *, CASE WHEN rms > 1e-12 THEN 20 * log10(rms) ELSE -144.0::DOUBLE END AS rms_db FROM m),
    b AS (SELECT program_id, channel, slot AS best, p AS best_p FROM p QUALIFY row_number() OVER (PARTITION BY program_id, channel ORDER BY p DESC, slot) = 1),
    o AS (SELECT program_id, channel, slot AS other_at, p AS other FROM p WHERE slot <> channel QUALIFY row_number() OVER (PARTITION BY program_id, channel ORDER BY p DESC, slot) = 1),
    d AS (SELECT l.*, other_at, other, p.p AS own, CASE WHEN rms_db > -80 THEN best ELSE -1 END AS raw, CASE WHEN rms_db > -80 THEN sqrt(2 * best_p) / n / rms ELSE 0 END AS coverage,
        count(*) OVER (PARTITION BY program_id) = 5 AS fits FROM l JOIN b USING (program_id, channel) JOIN o USING (program_id, channel) JOIN p ON p.program_id = l.program_id AND p.channel = l.channel AND p.slot = l.channel),
    g AS (SELECT d.*, 10 * log10(CASE WHEN own > 0 THEN own ELSE 1e-300 END / CASE WHEN other > 0 THEN other ELSE 1e-300 END) AS margin, (SELECT e.raw FROM d e WHERE e.program_id = d.program_id AND e.channel = d.raw) = channel AS back,
        (SELECT min(e.channel) FROM d e WHERE e.program_id = d.program_id AND e.channel <> d.channel AND e.raw = d.raw) AS twin FROM d),
    k AS (SELECT *, CASE WHEN NOT fits THEN 'channels' WHEN raw < 0 THEN 'silent' WHEN coverage < 0.1 THEN 'dropped' WHEN raw = channel AND margin >= 15 THEN 'identity' WHEN raw = channel THEN 'bleed' WHEN back THEN 'swapped' WHEN twin >= 0 THEN 'duplicated' ELSE 'dropped' END AS verdict FROM g)
    SELECT program_id, channel::INT AS channel, {r6('rms_db')} AS rms_db, CASE WHEN fits AND raw >= 0 AND coverage >= 0.1 THEN raw END::INT AS detected, {r6('coverage')} AS coverage, verdict,
    CASE verdict WHEN 'bleed' THEN CASE WHEN other > 0 THEN other_at END WHEN 'swapped' THEN raw WHEN 'duplicated' THEN twin WHEN 'dropped' THEN CASE WHEN coverage >= 0.1 THEN raw END END::INT AS paired FROM k""")
def verify_routing(spark, sf):
    u, c = F.col("program_id") % 6, F.col("channel")
    slot = F.when((u == 1) & (c < 2), 1 - c).when((u == 2) & (c == 2), 0).when((u == 3) & c.isin(3, 4), 7 - c).otherwise(c)
    level = F.when((u == 3) & (c == 0), 0.0).when((u == 4) & (c == 1), 0.0000001).otherwise(1.0)
    hz = F.get(F.array(*[F.lit(h) for _, h in ROUTED]), slot)
    tone = F.sin(F.col("frame") * hz * (2 * math.pi / 10))
    rows = B.multichannel(spark, sf).withColumn("x", (F.col("x") * 0.01 + tone) * level)
    out = beds.verify_routing(rows, P, ROUTED, 10.0, margin_db=15.0)
    return rounded(out.drop("margin_db"), "rms_db", "coverage")


@query("""WITH m AS (SELECT c_custkey AS model, ['', '5.1', '7.1', '7.1.2', '7.1.4'][(c_custkey % 5 + 1)::INT] AS bed, [0, 6, 8, 10, 12][(c_custkey % 5 + 1)::INT] AS ch, CASE WHEN c_custkey % 4 = 0 THEN 44100 ELSE 48000 END AS rate FROM customer),
    o AS (SELECT o_custkey AS model, count(*) AS objects, count(*) FILTER (o_orderkey % 3 = 0) AS coordinate, count(*) FILTER (o_orderkey % 4 = 0) AS importance FROM orders GROUP BY 1),
    b AS (SELECT o_custkey AS model, l_linenumber % 5 = 0 AS divergence, l_linenumber % 3 / 2.0::DOUBLE AS w, l_partkey % 2 / 2.0::DOUBLE AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    g AS (SELECT model, count(*) FILTER (divergence) AS divergence, count(*) FILTER (greatest(w, h) > 0 AND w <> h) AS extent FROM b GROUP BY 1),
    f AS (SELECT model, (bed = '7.1.4')::BIGINT AS bed_layout, (rate <> 48000)::BIGINT AS sample_rate, (coalesce(objects, 0) > 12)::BIGINT AS object_cap, (ch + coalesce(objects, 0) > 18)::BIGINT AS channel_cap, (ch + coalesce(objects, 0) = 0)::BIGINT AS "empty",
        coalesce(coordinate, 0) AS coordinate, coalesce(importance, 0) AS importance, coalesce(divergence, 0) AS divergence, coalesce(extent, 0) AS extent FROM m LEFT JOIN o USING (model) LEFT JOIN g USING (model))
    SELECT model, code, n FROM (UNPIVOT f ON COLUMNS(* EXCLUDE model) INTO NAME code VALUE n) WHERE n > 0""")
def validate_model(spark, sf):
    return deliveries.validate_model(*_models(spark, sf), max_objects=12, max_channels=18)


def _models(spark, sf):
    c, o = B.table(spark, sf, "customer"), B.table(spark, sf, "orders")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % 5 + 1).cast("int"))
    models = c.select(F.col("c_custkey").alias("model"), pick(["", "5.1", "7.1", "7.1.2", "7.1.4"]).alias("bed"), pick([0, 6, 8, 10, 12]).alias("bed_channels"), F.when(F.col("c_custkey") % 4 == 0, 44100).otherwise(48000).alias("rate"))
    kept = o.select(F.col("o_custkey").alias("model"), (F.col("o_orderkey") % 3 > 0).alias("cartesian"), F.when(F.col("o_orderkey") % 4 == 0, 5).alias("importance"))
    lines = B.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    width = F.col("l_linenumber") % 3 / 2
    blocks = lines.select(F.col("o_custkey").alias("model"), (F.col("l_linenumber") % 5 == 0).alias("divergence"), width.alias("width"), (F.col("l_partkey") % 2 / 2).alias("height"), width.alias("depth"))
    return models, kept, blocks


@query("""WITH m AS (SELECT c_custkey AS model, ['', '5.1', '7.1', '7.1.2', '7.1.4'][(c_custkey % 5 + 1)::INT] AS bed, [0, 6, 8, 10, 12][(c_custkey % 5 + 1)::INT] AS ch, CASE WHEN c_custkey % 4 = 0 THEN 44100 ELSE 48000 END AS rate FROM customer),
    k AS (SELECT o_custkey AS model, count(*) AS n FROM orders GROUP BY 1),
    e AS (SELECT model, CASE WHEN bed = '7.1.4' THEN 'bed_not_profile_conformant' WHEN rate <> 48000 THEN 'sample_rate_not_48k' WHEN n > 12 THEN 'too_many_objects' WHEN ch + coalesce(n, 0) > 18 THEN 'too_many_channels' END AS error FROM m LEFT JOIN k USING (model)),
    b AS (SELECT o_custkey AS model, l_linenumber % 5 = 0 AS divergence, l_linenumber % 3 / 2.0::DOUBLE AS w, l_partkey % 2 / 2.0::DOUBLE AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT model, error, CASE WHEN error IS NULL THEN greatest(w, h) ELSE w END AS width, CASE WHEN error IS NULL THEN greatest(w, h) ELSE h END AS height, error IS NOT NULL AND divergence AS divergence,
        concat_ws(',', CASE WHEN error IS NULL AND divergence THEN 'divergence' END, CASE WHEN error IS NULL AND w <> h THEN 'extent' END) AS warnings FROM b JOIN e USING (model)""")
def normalize_model(spark, sf):
    models, _, blocks = deliveries.normalize_model(*_models(spark, sf), max_objects=12, max_channels=18)
    return blocks.join(models.select("model", "error"), "model").select("model", "error", "width", "height", "divergence", F.concat_ws(",", "warnings").alias("warnings"))


@query("""WITH m AS (SELECT c_custkey AS model, CASE WHEN c_custkey % 5 = 4 OR c_custkey % 4 = 0 THEN 1 END AS bad, [0, 6, 8, 10, 12][(c_custkey % 5 + 1)::INT] AS ch FROM customer), k AS (SELECT o_custkey AS model, count(*) AS n FROM orders GROUP BY 1),
    f AS (SELECT model, bad IS NULL AND coalesce(n, 0) <= 12 AND ch + coalesce(n, 0) <= 18 AS fit FROM m LEFT JOIN k USING (model))
    SELECT o_custkey AS model, coalesce(fit, false) OR o_orderkey % 3 > 0 AS cartesian, CASE WHEN o_orderkey % 4 = 0 AND NOT coalesce(fit, false) THEN 5 END AS importance,
        concat_ws(',', CASE WHEN fit AND o_orderkey % 3 = 0 THEN 'coordinate' END, CASE WHEN fit AND o_orderkey % 4 = 0 THEN 'importance' END) AS warnings FROM orders LEFT JOIN f ON o_custkey = model""")
def normalize_objects(spark, sf):
    _, objects_, _ = deliveries.normalize_model(*_models(spark, sf), max_objects=12, max_channels=18)
    return objects_.select("model", "cartesian", "importance", F.concat_ws(",", "warnings").alias("warnings"))


@query("""WITH s AS (SELECT o_custkey AS project, o_orderkey AS idx, 'O' || o_orderkey % 10 AS label FROM orders), f AS (SELECT o_custkey AS project, o_orderkey AS file_no, 'Renders/Mix_o' || o_orderkey % 10 || '.wav' AS path FROM orders WHERE o_orderkey % 9 > 0),
    a AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY idx) AS r, count(*) OVER (PARTITION BY project) AS n FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file_no) AS r, count(*) OVER (PARTITION BY project) AS n FROM f),
    j AS (SELECT a.project, a.idx, a.label, a.n = b.n AS even, b.path, b.file_no FROM a LEFT JOIN b ON a.project = b.project AND CASE WHEN a.n = b.n THEN a.r = b.r ELSE contains(lower(b.path), lower(a.label)) END)
    SELECT project, idx, label, path, CASE WHEN path IS NOT NULL THEN CASE WHEN even THEN 'order' ELSE 'name' END END AS matched_by FROM j QUALIFY row_number() OVER (PARTITION BY project, idx ORDER BY file_no) = 1""")
def match_stem_files(spark, sf):
    o, k = B.table(spark, sf, "orders"), F.col("o_orderkey")
    digit = (k % 10).cast("string")
    stems = o.select(F.col("o_custkey").alias("project"), k.alias("idx"), F.concat(F.lit("O"), digit).alias("label"))
    files = o.where(k % 9 > 0).select(F.col("o_custkey").alias("project"), k.alias("file_no"), F.concat(F.lit("Renders/Mix_o"), digit, F.lit(".wav")).alias("path"))
    return deliveries.match_stem_files(stems, files)


PREDICTED_AT = ", ".join(f"({i}, '{label}', {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for i, (label, x, y, z) in enumerate(harmonics.predicted_speakers("7.1.4")))


@query(f"""WITH s AS ({ORACLE_SQL["sample_trajectory"]}), spk(idx, label, sx, sy, sz) AS (VALUES {PREDICTED_AT}), u AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM s),
    c AS (SELECT object_id, slice, gain, idx, label, greatest(least(CASE WHEN n > 1e-12 THEN x / n * sx + y / n * sy + z / n * sz ELSE sy END, 1), -1) AS c FROM u, spk),
    e AS (SELECT *, pow(1 + c + (3 * c * c - 1) / 2 + (5 * c * c * c - 3 * c) / 2, 2) * gain * gain AS energy FROM c),
    d AS (SELECT object_id, slice, sum(energy) AS total, arg_max(label, (round(energy * 1000000000.0::DOUBLE), -idx)) AS loudest FROM e GROUP BY 1, 2)
    SELECT object_id, label, {r6('avg(CASE WHEN total > 1e-30 THEN energy / total ELSE 0 END)')} AS coverage, count(*) FILTER (label = loudest) AS dominant_slices FROM e JOIN d USING (object_id, slice) GROUP BY 1, 2""")
def predict_decode(spark, sf):
    predicted = objects.predict_decode(sample_trajectory(spark, sf), "7.1.4")
    return rounded(objects.decode_shares(predicted, ["object_id"], "7.1.4"), "coverage")


# ---- edits of session tables: a row for each customer, an edit for each event; expressions that both engines read


def _edit_query(name: str, fields, columns: dict[str, tuple[str, str]]) -> None:
    """columns: of each field its first value and how SQL reads an edit's value."""
    pick = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(columns))
    log = f"""SELECT user_id AS k, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op, CASE event_id % {len(columns)} {pick} END AS field,
        CASE WHEN event_id % 11 = 0 THEN 'true' WHEN event_id % 11 = 1 THEN 'false' WHEN event_id % 11 = 2 THEN 'loud' ELSE CAST(event_id % 29 - 5 AS STRING) END AS value, event_id AS seq FROM events"""
    base = "SELECT c_custkey AS k, " + ", ".join(f'{first} AS "{f}"' for f, (first, _) in columns.items()) + " FROM customer"
    reads = ", ".join(f"arg_max({read}, seq) FILTER (field = '{f}' AND {read} IS NOT NULL) AS \"{f}\"" for f, (_, read) in columns.items())
    sql = f"""WITH base AS ({base}), e AS ({log}), l AS (SELECT k, arg_max(op, seq) AS last_op, max(seq) FILTER (op = 'delete') AS deleted FROM e GROUP BY 1),
        v AS (SELECT e.k, {reads} FROM e JOIN l USING (k) WHERE op = 'set' AND (deleted IS NULL OR seq > deleted) GROUP BY 1)
        SELECT coalesce(base.k, l.k) AS k, {', '.join(f'coalesce(v."{f}", CASE WHEN deleted IS NULL THEN base."{f}" END) AS "{f}"' for f in columns)}
        FROM base FULL JOIN l ON base.k = l.k LEFT JOIN v ON v.k = coalesce(base.k, l.k) WHERE coalesce(last_op <> 'delete', true)"""

    def run(spark, sf):
        first = B.table(spark, sf, "customer").selectExpr("c_custkey AS k", *[f"{e} AS `{f}`" for f, (e, _) in columns.items()])
        log_of = spark.sql(log.replace("FROM events", "FROM {events}"), events=B.table(spark, sf, "events"))
        return session.apply_edits(first, log_of, "k", fields())

    run.__name__ = name
    query(sql)(run)


def _number(low, high) -> str:
    return f"CASE WHEN try_cast(value AS DOUBLE) BETWEEN {low} AND {high} THEN try_cast(value AS DOUBLE) END"


def _whole(low, high) -> str:
    return f"CASE WHEN try_cast(value AS INT) BETWEEN {low} AND {high} THEN try_cast(value AS INT) END"


ANY, LATER, FLAG = _number(-1e300, 1e300), _number(0, 1e300), "try_cast(value AS BOOLEAN)"
COLOR = _whole(0, 0xFFFFFF)
SOME, NONE, OFF = "CAST(c_custkey % 7 AS DOUBLE)", "CAST(0 AS INT)", "CAST(false AS BOOLEAN)"
_edit_query("edit_sends", edits.send_fields, {"vol_db": (SOME, ANY), "pan": ("CAST(0 AS DOUBLE)", _number(-1, 1)), "muted": (OFF, FLAG), "phase": (OFF, FLAG), "mode": (NONE, "CASE WHEN try_cast(value AS INT) IN (0, 1, 3) THEN try_cast(value AS INT) END")})
_edit_query("edit_markers", edits.marker_fields, {"name": ("c_name", "value"), "position": (SOME, ANY), "end": (SOME, ANY), "color": (NONE, COLOR)})
_edit_query("edit_tempo", edits.tempo_fields, {"bpm": ("CAST(120 AS DOUBLE)", _number(1, 960)), "beats": ("CAST(4 AS INT)", _whole(1, 2147483647)), "unit": ("CAST(4 AS INT)", _whole(1, 2147483647)), "linear": (OFF, FLAG)})
_edit_query("edit_items", edits.item_fields, {"position": (SOME, LATER), "length": ("CAST(1 AS DOUBLE)", LATER), "muted": (OFF, FLAG), "vol_db": ("CAST(0 AS DOUBLE)", ANY), "fade_in": (SOME, LATER), "fade_out": (SOME, LATER), "color": (NONE, COLOR), "track": (NONE, _whole(0, 2147483647))})
_edit_query("edit_points", edits.point_fields, {"time": (SOME, ANY), "value": ("CAST(0 AS DOUBLE)", ANY), "shape": (NONE, _whole(0, 5)), "tension": ("CAST(0 AS DOUBLE)", _number(-1, 1))})
_edit_query("edit_notes", edits.note_fields, {"start": (SOME, LATER), "length": ("CAST(1 AS DOUBLE)", LATER), "pitch": ("CAST(60 AS INT)", _whole(0, 127)), "velocity": ("CAST(96 AS INT)", _whole(1, 127)), "channel": (NONE, _whole(0, 15)), "muted": (OFF, FLAG)})


@query(f"""WITH p AS (SELECT user_id AS program_id, ts, value * value / 250000 AS power FROM events), w AS (SELECT program_id, time_bucket(INTERVAL '100 milliseconds', ts) - i * INTERVAL '100 milliseconds' AS window_start, power FROM p, range(4) r(i))
    SELECT window_start, program_id, {r6(lufs('avg(power)'))} AS loudness, count(*) >= 4 AS full_window FROM w GROUP BY 1, 2""")
def live_loudness(spark, sf):
    powers = B.table(spark, sf, "events").select("ts", F.col("user_id").alias("program_id"), (F.col("value") * F.col("value") / 250000).alias("power"))
    return rounded(updates.live_loudness(powers), "loudness")


# ---- text formats of delivery files


@query(r"""WITH t AS (SELECT o_orderkey, floor(o_totalprice * 100000 + 0.5)::BIGINT AS ticks FROM orders)
    SELECT o_orderkey, printf('%02d:%02d:%02d.%05d', ticks // 360000000, ticks // 6000000 % 60, ticks // 100000 % 60, ticks % 100000) AS time, printf('%04x', o_orderkey & 65535) AS digits,
    regexp_replace(printf('%.6f', o_orderkey / 8.0::DOUBLE), '\.?0+$', '') AS number FROM t""")
def number_formats(spark, sf):
    key = F.col("o_orderkey")
    return B.table(spark, sf, "orders").select(key, H.adm_time(F.col("o_totalprice")).alias("time"), H.hex_digits(key).alias("digits"), H.fmt_num(key / 8).alias("number"))


@query(r"""WITH t AS (SELECT doc_id, text || '"\''' || chr(10) AS text FROM documents), x AS (SELECT doc_id, text, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM t)
    SELECT doc_id, md5(xml) AS xml, md5('"' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '"') AS yaml FROM x""")
def text_escapes(spark, sf):
    text = F.concat("text", F.lit("\"\\'\n"))
    return B.table(spark, sf, "documents").select("doc_id", F.md5(H.xml_escape(text)).alias("xml"), F.md5(H.yaml_quote(text)).alias("yaml"))
_edit_query("edit_tracks", edits.track_fields, {"name": ("c_name", "value"), "vol_db": (SOME, ANY), "pan": ("CAST(0 AS DOUBLE)", _number(-1, 1)), "width": ("CAST(1 AS DOUBLE)", _number(-1, 1)), "muted": (OFF, FLAG), "solo": (NONE, _whole(0, 2)), "phase": (OFF, FLAG), "rec_arm": (OFF, FLAG), "rec_mode": (NONE, _whole(0, 2147483647)), "color": (NONE, COLOR), "folder": (NONE, _whole(-1, 1)),
    "channels": ("CAST(2 AS INT)", "greatest(2, least(128, try_cast(value AS INT))) + greatest(2, least(128, try_cast(value AS INT))) % 2 + 0 * try_cast(value AS INT)")})
_edit_query("edit_takes", edits.take_fields, {"name": ("c_name", "value"), "vol_db": (SOME, ANY), "pan": ("CAST(0 AS DOUBLE)", _number(-1, 1)), "pitch": (SOME, ANY), "rate": ("CAST(1 AS DOUBLE)", _number(1e-300, 1e300))})
_edit_query("edit_cc", edits.cc_fields, {"at": (SOME, LATER), "status": ("CAST(176 AS INT)", _whole(128, 239)), "msg2": (NONE, _whole(0, 127)), "msg3": (NONE, _whole(0, 127)), "muted": (OFF, FLAG)})
_edit_query("edit_automation", edits.automation_fields, {"mode": (NONE, _whole(0, 4))})
_edit_query("edit_fx", edits.fx_fields, {"value": ("CAST(0.5 AS DOUBLE)", _number(0, 1)), "enabled": (OFF, FLAG)})


@query("""WITH r AS (SELECT l_orderkey AS take, l_linenumber, l_partkey, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE (l_partkey % 100) / 4.0::DOUBLE - 1 END AS start, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE (l_suppkey % 5)::DOUBLE END AS length, (l_partkey % 140)::INT AS pitch, CASE WHEN l_suppkey % 2 = 0 THEN (l_suppkey % 130)::INT END AS velocity, CASE WHEN l_suppkey % 7 < 3 THEN (l_suppkey % 18)::INT END AS channel FROM lineitem),
    f AS (SELECT take, l_linenumber, l_partkey, start, coalesce(length, 1) AS length, pitch, coalesce(velocity, 96) AS velocity, coalesce(channel, 0) AS channel FROM r)
    SELECT *, CASE WHEN start IS NULL OR start < 0 THEN 'start' WHEN length <= 0 THEN 'length' WHEN pitch > 127 THEN 'pitch' WHEN velocity NOT BETWEEN 1 AND 127 THEN 'velocity' WHEN channel > 15 THEN 'channel' END AS error FROM f""")
def insert_notes(spark, sf):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("take"), "l_linenumber", "l_partkey", F.when(p % 17 != 0, (p % 100) / 4.0 - 1).alias("start"), F.when(s % 3 != 0, (s % 5).cast("double")).alias("length"), (p % 140).cast("int").alias("pitch"), F.when(s % 2 == 0, (s % 130).cast("int")).alias("velocity"), F.when(s % 7 < 3, (s % 18).cast("int")).alias("channel"))
    return edits.insert_notes(rows)


@query("""WITH i AS (SELECT o_orderkey AS item, (o_custkey % 50)::DOUBLE AS position, (1 + o_orderkey % 7)::DOUBLE AS length, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 4 - 1)::INT ELSE 0 END AS n, CASE WHEN o_orderkey % 3 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS gap FROM orders)
    SELECT item, copy::INT AS copy, position + copy * (length + gap) AS position, length FROM (SELECT *, unnest(range(n + 1)) AS copy FROM i)""")
def duplicate_items(spark, sf):
    k = F.col("o_orderkey")
    o = B.table(spark, sf, "orders")
    items = o.select(k.alias("item"), (F.col("o_custkey") % 50).cast("double").alias("position"), (1 + k % 7).cast("double").alias("length"))
    copies = o.where(k % 4 > 0).select(k.alias("item"), (k % 4 - 1).cast("int").alias("copies"), F.when(k % 3 != 0, 0.5).alias("gap"))
    return edits.duplicate_items(items, copies, "item").select("item", "copy", "position", "length")


@query("""WITH c AS (SELECT event_id, ['poly_aftertouch', 'cc', 'program_change', 'channel_pressure', 'pitch_bend', 'odd'][(event_id % 6 + 1)::INT] AS kind, (event_id % 18)::INT AS channel, (user_id % 130)::INT AS number, (event_id * 7 % 17000)::INT AS big FROM events),
    v AS (SELECT *, CASE WHEN kind = 'pitch_bend' THEN big ELSE big % 140 END AS value FROM c), k AS (SELECT *, channel < 16 AND kind <> 'odd' AND value <= CASE WHEN kind = 'pitch_bend' THEN 16383 ELSE 127 END AND (kind NOT IN ('cc', 'poly_aftertouch') OR number < 128) AS ok FROM v)
    SELECT event_id, CASE WHEN ok THEN CASE kind WHEN 'poly_aftertouch' THEN 160 WHEN 'cc' THEN 176 WHEN 'program_change' THEN 192 WHEN 'channel_pressure' THEN 208 ELSE 224 END + channel END AS status, CASE WHEN ok THEN CASE WHEN kind = 'pitch_bend' THEN value % 128 WHEN kind IN ('program_change', 'channel_pressure') THEN value ELSE number END END AS msg2,
        CASE WHEN ok THEN CASE WHEN kind = 'pitch_bend' THEN value // 128 WHEN kind IN ('program_change', 'channel_pressure') THEN 0 ELSE value END END AS msg3 FROM k""")
def cc_encode(spark, sf):
    e, n = F.col("event_id"), (F.col("user_id") % 130).cast("int")
    kind = F.element_at(F.array(*map(F.lit, ("poly_aftertouch", "cc", "program_change", "channel_pressure", "pitch_bend", "odd"))), (e % 6 + 1).cast("int"))
    big = (e * 7 % 17000).cast("int")
    status, msg2, msg3 = H.cc_encode(kind, (e % 18).cast("int"), n, F.when(kind == "pitch_bend", big).otherwise(big % 140))
    return B.table(spark, sf, "events").select("event_id", status.alias("status"), msg2.alias("msg2"), msg3.alias("msg3"))


@query(f"""WITH s AS ({ORACLE_SQL["coverage_stats"]}) SELECT program_id, CASE WHEN cv < 0.35 AND dead_zones / speakers < 0.02 THEN 'even' WHEN cv < 0.8 THEN 'balanced' ELSE 'directional' END AS verdict, upper < 0.05 AS planar FROM s""")
def coverage_verdict(spark, sf):
    stats = scene.coverage_stats(scene.speaker_energies(B.scene(spark, sf), P, 64), P)
    return scene.coverage_verdict(stats, 64).select("program_id", "verdict", "planar")


@query(f"""WITH f AS ({ORACLE_SQL["spatial_field"]}), v AS ({ORACLE_SQL["energy_vector"]}) SELECT f.*, 7 AS "order", v.re, v.az AS re_az, v.el AS re_el FROM f JOIN v USING (program_id)""")
def spatial_field_report(spark, sf):
    return rounded(scene.spatial_field_report(B.scene(spark, sf), P), "az", "el", "diffuseness", "rv", "re", "re_az", "re_el")


@query("""WITH p AS (SELECT o_orderkey AS text, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'A B' WHEN 2 THEN NULL ELSE 'KEY' END AS name, CASE WHEN o_orderkey % 7 = 0 THEN 'x' || chr(10) || 'y' ELSE 'x' END AS value FROM orders UNION ALL SELECT o_orderkey, 'KEY', 'z' FROM orders WHERE o_orderkey % 3 = 0)
    SELECT text, name, 'bad_key' AS error FROM p WHERE name IS NULL OR name IN ('', 'A B') UNION ALL SELECT text, name, 'multi_line_value' FROM p WHERE contains(value, chr(10)) UNION ALL SELECT text, name, 'duplicate_key' FROM p GROUP BY text, name HAVING count(*) > 1""")
def check_patches(spark, sf):
    k = F.col("o_orderkey")
    o = B.table(spark, sf, "orders")
    first = o.select(k.alias("text"), F.when(k % 5 == 0, "").when(k % 5 == 1, "A B").when(k % 5 > 2, "KEY").alias("name"), F.when(k % 7 == 0, "x\ny").otherwise("x").alias("value"))
    more = o.where(k % 3 == 0).select(k.alias("text"), F.lit("KEY").alias("name"), F.lit("z").alias("value"))
    return deliveries.check_patches(first.union(more), "text")


@query(f"""WITH t(slot, hz) AS (VALUES {', '.join(f'({s}, {h}::DOUBLE)' for s, h in beds.tone_plan(6, (3,)))}) SELECT c_custkey AS program, slot AS channel, frame::INT AS frame, {r6('0.12589254117941673::DOUBLE * sin(frame * hz * 2 * 3.141592653589793::DOUBLE / 48000)')} AS x FROM customer, t, range(20) r(frame)""")
def tone_samples(spark, sf):
    programs = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("program"))
    return rounded(beds.tone_samples(programs, "program", beds.tone_plan(6, (3,)), 48000.0, 20), "x")


@query(f"""WITH a AS ({ORACLE_SQL["channel_metrics"]}), b AS ({ORACLE_SQL["true_peak"]}), c AS ({ORACLE_SQL["k_weighted_level"]}) SELECT a.*, true_peak_db, k_level FROM a JOIN b USING (program_id) JOIN c USING (program_id)""")
def channel_report(spark, sf):
    signal = B.signal(spark, sf)
    chunks = weighting.k_weight(weighting.chunk_samples(signal, P, 48_000), P, 48_000)
    samples = chunks.select(*P, "frame0", F.posexplode("samples").alias("i", "x")).select(*P, (F.col("frame0") + F.col("i")).alias("frame"), "x")
    return rounded(meter.channel_report(signal, samples, P), "rms_db", "peak_db", "true_peak_db", "k_level")


@query(f"""WITH l AS ({ORACLE_SQL["stem_loudness"]}), p AS (SELECT program_id, channel::INT AS channel, {r6('20 * log10(max(abs(x)))')} AS peak_db FROM (WITH {B.MULTI} FROM multi) GROUP BY 1, 2),
    t AS (WITH {B.MULTI}, {STEMS} SELECT program_id // 10 AS program_id, (program_id % 10)::INT AS channel, {r6("CASE WHEN max(m) > 1e-12 THEN 20 * log10(max(m)) ELSE -144.0::DOUBLE END")} AS true_peak_db
        FROM (SELECT program_id, greatest(abs(x), {', '.join(map(_between, meter.true_peak_taps()))}) AS m FROM signal WINDOW w AS (PARTITION BY program_id ORDER BY frame)) GROUP BY 1, 2)
    SELECT l.*, peak_db, true_peak_db FROM l JOIN p USING (program_id, channel) JOIN t USING (program_id, channel)""")
def stem_report(spark, sf):
    out = meter.stem_report(B.multichannel(spark, sf), "program_id", "channel")
    return rounded(out, "integrated", "delta", "energy_share", "peak_db", "true_peak_db")
