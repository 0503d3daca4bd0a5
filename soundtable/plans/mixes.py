"""Queries on limited and weighted programs, trajectories, tempo maps, renderer sends and plug-in look-ups."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from soundtable.functions import scalars as H
from soundtable.operators import beds, limiter, meter, notes, objects, sends, styles, weighting
from soundtable.plans import bindings as B

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(x: str) -> str:
    return f"(round(({x}) * 1000000.0::DOUBLE) / 1000000.0::DOUBLE + 0.0::DOUBLE)"


# ---- the limiter: five channels of events as a bed whose fourth is the LFE, in chunks of 16 frames

RATE, CHANNELS, CHUNK, LIMIT = 1000, 5, 16, {"ceiling_db": -6.0, "release_ms": 40.0, "lookahead_ms": 2.0, "lfe": 4}
_NOW = limiter.Setting(RATE, **LIMIT)


def _peak(c: int) -> str:
    p = [f"p{i}[{c + 1}]" for i in range(4)]
    a, b, d = f"(1.5::DOUBLE * ({p[1]} - {p[2]}) + 0.5::DOUBLE * ({p[3]} - {p[0]}))", f"({p[0]} - 2.5::DOUBLE * {p[1]} + 2 * {p[2]} - 0.5::DOUBLE * {p[3]})", f"(0.5::DOUBLE * ({p[2]} - {p[0]}))"
    between = [f"abs((({a} * {k / 8} + {b}) * {k / 8} + {d}) * {k / 8} + {p[1]})" for k in range(1, 8)]
    return f"greatest(abs({p[1]}), abs({p[2]}), {', '.join(between)})"


_SILENT = f"[{', '.join(['0.0::DOUBLE'] * CHANNELS)}]"
_FRAMES = f"f AS (SELECT program_id, frame, [{', '.join(f'coalesce(max(x) FILTER (channel = {c}), 0)::DOUBLE' for c in range(CHANNELS))}] AS p3 FROM multi GROUP BY 1, 2)"
LIMITED = f"""{B.MULTI}, {_FRAMES}, h AS (SELECT *, {', '.join(f'coalesce(lag(p3, {3 - i}) OVER w, {_SILENT}) AS p{i}' for i in range(3))}, coalesce(lag(p3, {_NOW.delay}) OVER w, {_SILENT}) AS late FROM f WINDOW w AS (PARTITION BY program_id ORDER BY frame)),
    k AS (SELECT *, greatest({', '.join(_peak(c) for c in range(CHANNELS) if c != 3)}) AS peak FROM h),
    d AS (SELECT *, CASE WHEN peak > {_NOW.ceiling!r} THEN ln(1 - {_NOW.ceiling!r} / peak) - frame * {math.log(_NOW.release)!r} END AS lack FROM k),
    e AS (SELECT *, 1 - coalesce(exp(max(lack) OVER (PARTITION BY program_id ORDER BY frame) + frame * {math.log(_NOW.release)!r}), 0) AS env FROM d),
    g AS (SELECT *, list_reduce(list_prepend(1.0::DOUBLE, list(env) OVER (PARTITION BY program_id ORDER BY frame)), lambda s, v: v + (s - v) * {_NOW.smooth!r}::DOUBLE) AS gain FROM e)"""


def _limited(spark, sf):
    frames = B.multichannel(spark, sf).groupBy("program_id", "frame").agg(*[F.coalesce(F.max(F.when(F.col("channel") == c, F.col("x"))), F.lit(0.0)).alias(f"c{c}") for c in range(CHANNELS)])
    one = F.struct("frame", F.array(*[f"c{c}" for c in range(CHANNELS)]).alias("v"))
    chunks = frames.groupBy("program_id", F.floor(F.col("frame") / CHUNK).alias("n")).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    chunks = chunks.select("program_id", (F.col("n") * CHUNK).alias("frame0"), F.lit(CHANNELS).alias("channels"), F.flatten(F.transform("rows", lambda x: x["v"])).alias("samples"))
    return limiter.limit_corpus(chunks, ["program_id"], RATE, **LIMIT)


@query(f"WITH {LIMITED} SELECT program_id, frame, c AS channel, {r6('CASE WHEN c = 3 THEN 1 ELSE gain END')} AS gain FROM (SELECT *, unnest(range({CHANNELS})) AS c FROM g)")
def gain_reduction(spark, sf):
    return limiter.gain_reduction(_limited(spark, sf), ["program_id"]).withColumn("gain", H.rounded(F.col("gain")))


@query(f"WITH {LIMITED} SELECT program_id, frame, c AS channel, {r6('late[c + 1] * CASE WHEN c = 3 THEN 1 ELSE gain END')} AS x FROM (SELECT *, unnest(range({CHANNELS})) AS c FROM g)")
def limit_corpus(spark, sf):
    each = _limited(spark, sf).select("program_id", "frame0", F.posexplode("samples").alias("at", "x"))
    return each.select("program_id", (F.col("frame0") + F.floor(F.col("at") / CHANNELS)).alias("frame"), (F.col("at") % CHANNELS).alias("channel"), H.rounded(F.col("x")).alias("x"))


# ---- loudness as delivered: K-weighted channels with the weights of a 5.1 bed

TAPS = [float(v) for v in weighting.impulse_response(48000.0, 400)]
WEIGHED = f"""{B.MULTI}, taps(k, h) AS (SELECT generate_subscripts(h, 1) - 1, unnest(h) FROM (SELECT {TAPS!r}::DOUBLE[] AS h)),
    y AS (SELECT m.program_id, m.channel, m.frame, sum(p.x * h) AS y FROM multi m JOIN taps ON k <= m.frame JOIN multi p ON p.program_id = m.program_id AND p.channel = m.channel AND p.frame = m.frame - k GROUP BY ALL)"""


def _weighted(spark, sf):
    rows = B.multichannel(spark, sf)
    keys = ["program_id", "channel"]
    chunks = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "x"))), lambda s: s["x"]).alias("samples")).withColumn("frame0", F.lit(0).cast("long"))
    out = weighting.k_weight(chunks, keys, 48000)
    return out.select(*keys, F.posexplode("samples").alias("frame", "x"))


@query(f"WITH {WEIGHED} SELECT program_id, channel::INT AS channel, {r6('CASE WHEN avg(y * y) > 1e-24 THEN -0.691 + 10 * log10(avg(y * y)) ELSE -144 END')} AS k_level FROM y GROUP BY 1, 2")
def channel_k_levels(spark, sf):
    levels = _weighted(spark, sf).groupBy("program_id", "channel").agg(H.lufs(F.avg(F.col("x") * F.col("x"))).alias("k_level"))
    return levels.withColumn("k_level", H.rounded(F.col("k_level")))


@query(f"""WITH {WEIGHED}, b AS (SELECT program_id, frame AS bin, sum(y * y * CASE channel WHEN 3 THEN 0 WHEN 4 THEN 1.41::DOUBLE ELSE 1 END) AS power FROM y GROUP BY 1, 2),
    p AS (SELECT *, CASE WHEN count(*) OVER w = 4 THEN sum(power) OVER w / 4 END AS p FROM b WINDOW w AS (PARTITION BY program_id ORDER BY bin ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    l AS (SELECT *, CASE WHEN p > 1e-24 THEN -0.691 + 10 * log10(p) WHEN p IS NOT NULL THEN -144 END AS l FROM p), m AS (SELECT *, avg(p) FILTER (l > -70) OVER (PARTITION BY program_id) AS m1 FROM l),
    s AS (SELECT program_id, avg(power) AS a, count(p) AS n, avg(p) FILTER (l > -70 AND l > -0.691 + 10 * log10(m1) - 10) AS m2 FROM m GROUP BY 1)
    SELECT program_id, {r6("CASE WHEN coalesce(CASE WHEN n = 0 THEN a ELSE m2 END, 0) > 1e-24 THEN -0.691 + 10 * log10(CASE WHEN n = 0 THEN a ELSE m2 END) ELSE -144 END")} AS integrated, {r6("CASE WHEN a > 1e-24 THEN -0.691 + 10 * log10(a) ELSE -144 END")} AS ungated, n AS total_blocks FROM s""")
def weighted_loudness(spark, sf):
    labelled = beds.label_channels(_weighted(spark, sf).withColumn("width", F.lit(6)))
    bins = meter.power_bins(labelled.where("weight > 0"), ["program_id"], 1, F.col("weight"))
    # Frames at which only the LFE sounds are silent bins.
    every = labelled.select("program_id", F.col("frame").cast("long").alias("bin")).distinct()
    loud = meter.gated_loudness(every.join(bins.select("program_id", F.col("bin").cast("long").alias("bin"), "power"), ["program_id", "bin"], "left"), ["program_id"])
    return loud.select("program_id", *[H.rounded(F.col(c)).alias(c) for c in ("integrated", "ungated")], "total_blocks")


# ---- trajectories and tempo maps

BLOCK_MS, MOST = 500.0, 20
SPANS = "spans AS (SELECT c_custkey AS k, (c_custkey % 100) / 10.0::DOUBLE AS s, (c_custkey % 100) / 10.0::DOUBLE + (c_custkey % 5) * 3.1::DOUBLE - 1 AS e, c_custkey % 6 <> 0 AS panned, (c_custkey % 50)::DOUBLE AS az, (c_custkey % 40)::DOUBLE AS el, 2.0::DOUBLE AS dist FROM customer)"
POINTS = "pts AS (SELECT o_custkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'az' WHEN 1 THEN 'el' WHEN 2 THEN 'dist' ELSE 'other' END AS axis, o_orderkey / 5000.0::DOUBLE AS time, (o_orderkey % 90)::DOUBLE AS value FROM orders WHERE o_custkey % 3 <> 0)"


@query(f"""WITH {SPANS}, {POINTS}, m AS (SELECT DISTINCT k, true AS moves FROM pts WHERE axis <> 'other'), t AS (SELECT spans.*, greatest(e - s, 0) AS len, CASE WHEN NOT panned THEN 'none' WHEN moves IS NULL THEN 'static' ELSE 'envelope' END AS source FROM spans LEFT JOIN m USING (k)),
    n AS (SELECT *, CASE WHEN source = 'envelope' AND len > 0 THEN least(ceil(len / 0.5) + 1, {MOST}) ELSE 1 END::BIGINT AS n, CASE WHEN ceil(len / 0.5) + 1 > {MOST} THEN len / {MOST - 1} ELSE 0.5::DOUBLE END AS step FROM t),
    g AS (SELECT *, least(block * step, len) AS rtime, s + least(block * step, len) AS "at" FROM (SELECT *, unnest(range(n)) AS block FROM n)),
    a AS (SELECT g.k, block, axis, "at" FROM g, (VALUES ('az'), ('el'), ('dist')) x(axis) WHERE source = 'envelope'),
    v AS (SELECT a.k, a.block, a.axis, CASE WHEN p.time IS NULL THEN q.value WHEN q.time IS NULL OR p.time = a."at" THEN p.value ELSE p.value + (q.value - p.value) * (a."at" - p.time) / (q.time - p.time) END AS value
        FROM a ASOF LEFT JOIN pts p ON p.k = a.k AND p.axis = a.axis AND p.time <= a."at" ASOF LEFT JOIN pts q ON q.k = a.k AND q.axis = a.axis AND q.time >= a."at"),
    w AS (SELECT k, block, max(value) FILTER (axis = 'az') AS vaz, max(value) FILTER (axis = 'el') AS vel, max(value) FILTER (axis = 'dist') AS vdist FROM v GROUP BY 1, 2)
    SELECT g.k AS object_id, g.block, {r6('rtime')} AS rtime, {r6("CASE WHEN source = 'none' THEN 0 ELSE coalesce(vaz, az) END")} AS az, {r6("CASE WHEN source = 'none' THEN 0 ELSE coalesce(vel, el) END")} AS el,
        {r6("greatest(0, least(1.5, CASE WHEN source = 'none' THEN 1 ELSE coalesce(vdist, dist) END))")} AS dist, source FROM g LEFT JOIN w ON w.k = g.k AND w.block = g.block""")
def object_trajectory(spark, sf):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    start = (k % 100) / 10.0
    tracks = B.table(spark, sf, "customer").select(k.alias("object_id"), start.alias("start"), (start + (k % 5) * 3.1 - 1).alias("end"), (k % 6 != 0).alias("panned"), (k % 50).cast("double").alias("az"), (k % 40).cast("double").alias("el"), F.lit(2.0).alias("dist"))
    axis = F.element_at(F.array(*map(F.lit, ("az", "el", "dist", "other"))), (o % 4 + 1).cast("int"))
    points = B.table(spark, sf, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("object_id"), axis.alias("axis"), (o / 5000.0).alias("time"), (o % 90).cast("double").alias("value"))
    out = objects.object_trajectory(tracks, points, "object_id", BLOCK_MS, MOST)
    return out.select("object_id", "block", *[H.rounded(F.col(c)).alias(c) for c in ("rtime", "az", "el", "dist")], "source")


@query(f"""WITH t AS (SELECT c_nationkey AS map, c_custkey::DOUBLE AS time, (60 + 7 * (c_custkey % 20))::DOUBLE AS bpm FROM customer),
    l AS (SELECT *, lead(time) OVER w AS until FROM t WINDOW w AS (PARTITION BY map ORDER BY time)), q AS (SELECT *, coalesce(sum((until - time) * bpm / 60) OVER (PARTITION BY map ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q0 FROM l),
    g AS (SELECT o_orderkey, (o_custkey % 27)::INT AS map, (o_orderkey % 9000) / 4.0::DOUBLE - 10 AS pos FROM orders)
    SELECT o_orderkey, {r6('CASE WHEN q.time IS NULL THEN pos / 2 ELSE q.time + (pos - q0) * 60 / bpm END')} AS time FROM g ASOF LEFT JOIN q ON q.map = g.map AND q.q0 <= g.pos""")
def qn_to_time(spark, sf):
    k = F.col("c_custkey")
    tempo = B.table(spark, sf, "customer").select(F.col("c_nationkey").alias("map"), k.cast("double").alias("time"), (60 + 7 * (k % 20)).cast("double").alias("bpm"))
    grid = B.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 27).cast("int").alias("map"), ((F.col("o_orderkey") % 9000) / 4.0 - 10).cast("double").alias("pos"))
    return notes.qn_to_time(grid, tempo, "map", "pos").select("o_orderkey", H.rounded(F.col("time")).alias("time"))


# ---- renderer sends

RECEIVES = "rec AS (SELECT c_nationkey AS bus, (c_custkey % CASE WHEN c_nationkey % 5 = 0 THEN 150 ELSE 24 END)::INT AS dst, CASE WHEN c_custkey % 31 = 0 THEN 6 WHEN c_custkey % 29 = 0 THEN 0 WHEN c_custkey % 23 = 0 THEN 2 ELSE 1 END AS width, c_custkey % 11 <> 0 AS audio FROM customer WHERE c_nationkey <> 7)"


@query(f"""WITH {RECEIVES}, live AS (SELECT *, greatest(width, 1) AS wide FROM rec WHERE audio), b AS (SELECT n_nationkey AS bus, CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 6 ELSE 10 END AS bed, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey * 20 END AS expected FROM nation),
    u AS (SELECT bus, channel, count(*) AS uses FROM (SELECT bus, unnest(range(dst, dst + wide)) AS channel FROM live) GROUP BY 1, 2), m AS (SELECT * FROM live JOIN b USING (bus)),
    s AS (SELECT b.bus, bed, expected, coalesce(max(dst + wide), 0) AS top, count(*) FILTER (dst = 0 AND width = bed) AS fits, count(*) FILTER (dst = 0 AND width <> 1) AS wrong, count(*) FILTER (dst >= bed AND width = 1) AS objects FROM b LEFT JOIN live USING (bus) GROUP BY ALL)
    SELECT bus, 'collision' AS code, channel::INT AS channel, uses AS count FROM u WHERE uses > 1 UNION ALL SELECT bus, 'gap', channel::INT, 0 FROM (SELECT bus, unnest(range(top)) AS channel FROM s) g WHERE NOT EXISTS (FROM u WHERE u.bus = g.bus AND u.channel = g.channel)
    UNION ALL SELECT bus, 'object_width', dst, width FROM m WHERE dst >= bed AND width <> 1 UNION ALL SELECT bus, CASE WHEN wrong > 0 THEN 'bed_width_mismatch' ELSE 'bed_missing' END, NULL, bed FROM s WHERE bed > 0 AND fits = 0
    UNION ALL SELECT bus, 'over_118', NULL, objects FROM s WHERE objects > 118 UNION ALL SELECT bus, 'over_128', NULL, top FROM s WHERE top > 128 UNION ALL SELECT bus, 'unrouted', NULL, expected - objects FROM s WHERE expected IS NOT NULL AND objects < expected""")
def inspect_sends(spark, sf):
    k, bus, n = F.col("c_custkey"), F.col("c_nationkey"), F.col("n_nationkey")
    width = F.when(k % 31 == 0, 6).when(k % 29 == 0, 0).when(k % 23 == 0, 2).otherwise(1)
    receives = B.table(spark, sf, "customer").where("c_nationkey <> 7").select(bus.alias("bus"), (k % F.when(bus % 5 == 0, 150).otherwise(24)).cast("int").alias("dst"), width.alias("width"), (k % 11 != 0).alias("audio"))
    buses = B.table(spark, sf, "nation").select(n.alias("bus"), F.when(n % 4 == 0, 0).when(n % 4 == 1, 6).otherwise(10).alias("bed_width"), F.when(n % 3 != 0, (n * 20).cast("int")).alias("expected"))
    return sends.inspect_sends(receives, buses, "bus")


# ---- plug-in look-ups

PLUGINS = ("VST3: Pro-Q 3 (FabFilter)", "VST: FABFILTER Pro-C 2", "VST3: Pro-L 2 (FabFilter)", "VST: C6 Multiband (Waves)", "StereoEncoder (IEM)", "GranularEncoder (IEM)", "SimpleDecoder (IEM)", "sparta_ambiENC", "sparta_binauraliser", "ATK FOA Transform RotateTiltTumble",
           "ambix_rotator_o3", "O3A Core decoder", "JS: plain", "AllRADecoder (IEM)", "BinauralDecoder (IEM)", "SceneRotator (IEM)", "FabFilter Pro-MB")
INSTALLED = f"ins AS (SELECT c_nationkey + 25 * (c_custkey % 7) AS project, c_custkey AS idx, [{', '.join(f"'{x}'" for x in PLUGINS)}][(c_custkey % {len(PLUGINS)} + 1)::INT] AS name FROM customer WHERE c_custkey % 3 <> 0)"


def _installed(spark, sf):
    k = F.col("c_custkey")
    return B.table(spark, sf, "customer").where("c_custkey % 3 <> 0").select((F.col("c_nationkey") + 25 * (k % 7)).alias("project"), k.alias("idx"), F.element_at(F.array(*map(F.lit, PLUGINS)), (k % len(PLUGINS) + 1).cast("int")).alias("name"))


_STYLES = list(styles.STYLES)
_CHAIN = ", ".join(f"('{s}', {i}, '{role}', '{stock}', {prefs!r})" for s, steps in styles.STYLES.items() for i, (role, stock, prefs) in enumerate(steps))


@query(f"""WITH {INSTALLED}, chain(style, step, role, stock, prefs) AS (VALUES {_CHAIN}), req AS (SELECT s_suppkey AS id, s_suppkey % 175 AS project, {_STYLES!r}[(s_suppkey % {len(_STYLES)} + 1)::INT] AS style, -1.0::DOUBLE - s_suppkey % 3 AS ceiling_db, (2 + 4 * (s_suppkey % 2))::INT AS channels FROM supplier),
    m AS (SELECT req.*, step, role, stock, prefs FROM req JOIN chain USING (style)), p AS (SELECT id, step, project, unnest(range(len(prefs))) AS i, prefs FROM m),
    h AS (SELECT DISTINCT id, step, i, prefs[i + 1] AS pref FROM p JOIN ins USING (project) WHERE len(list_filter(string_split(lower(prefs[i + 1]), ' '), lambda t: NOT contains(lower(name), t))) = 0),
    b AS (SELECT id, step, arg_min(pref, i) AS pref FROM h GROUP BY 1, 2), o AS (SELECT *, role = 'limiter' AND style = 'immersive-master-atmos' AND channels > 2 AS linked FROM m LEFT JOIN b USING (id, step))
    SELECT project, style, step, role, CASE WHEN linked THEN '{styles.LINKED_LIMITER}' ELSE coalesce(pref, stock) END AS fx, NOT linked AND pref IS NOT NULL AS detected, linked, CASE WHEN role = 'limiter' THEN ceiling_db END AS ceiling_db FROM o""")
def resolve_style(spark, sf):
    k = F.col("s_suppkey")
    requests = B.table(spark, sf, "supplier").select((k % 175).alias("project"), F.element_at(F.array(*map(F.lit, _STYLES)), (k % len(_STYLES) + 1).cast("int")).alias("style"), (F.lit(-1.0) - k % 3).cast("double").alias("ceiling_db"), (2 + 4 * (k % 2)).cast("int").alias("channels"))
    return styles.resolve_style(requests, _installed(spark, sf), "project")


def _first(words, value) -> str:
    return " ".join(f"WHEN {' OR '.join(f"contains(low, '{w}')" for w in ws)} THEN '{value(x)}'" for x, ws in words)


_SEEDS = " ".join("WHEN role = '%s' THEN CASE %s END" % (role, " ".join(f"WHEN contains(low, '{n}') THEN {i}" for i, n in enumerate(names))) for role, names in styles.PREFERRED.items())


@query(f"""WITH {INSTALLED}, k AS (SELECT *, CASE {_first(styles.SUITE_WORDS, str)} END AS suite, CASE {_first(styles.ROLE_WORDS, str)} ELSE 'other' END AS role FROM (SELECT *, lower(name) AS low FROM ins)),
    s AS (SELECT *, CASE {_SEEDS} END AS seed, list_position({list(styles.SUITES)!r}, suite) AS place FROM k WHERE suite IS NOT NULL AND role <> 'other'),
    r AS (SELECT *, row_number() OVER (PARTITION BY project, role ORDER BY (seed IS NULL)::INT, place, coalesce(seed, 0), idx, name) AS n, count(*) OVER (PARTITION BY project, role) AS plugins FROM s)
    SELECT project, role, suite, name, plugins FROM r WHERE n = 1""")
def find_suites(spark, sf):
    return styles.find_suites(_installed(spark, sf), "project")
