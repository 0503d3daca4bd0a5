"""Queries on session tables made of orders, line items, events and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundtable.functions import scalars as H
from soundtable.operators import project
from soundtable.plans import bindings as B
from soundtable.sources import session_tables as S

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


def gain(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN 20 * log10({x}) ELSE -150 END)"


#: Each stored table as SQL that both engines run.
TABLES = {
    "tracks": "SELECT c_nationkey AS project, CAST(c_custkey AS INT) - 1 AS idx, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE (c_custkey % 7) / CAST(4 AS DOUBLE) END AS volume, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 3) - CAST(1 AS DOUBLE) END AS pan, CAST(c_custkey % 70 AS INT) AS channels, CAST(c_custkey % 2 AS INT) AS mute, CAST(c_custkey % 4 AS INT) AS solo FROM customer",
    "items": "SELECT o_custkey % 25 AS project, CAST(o_custkey AS INT) - 1 AS track, o_orderkey AS idx, o_orderkey / CAST(8 AS DOUBLE) AS position, (o_orderkey % 50) / CAST(4 AS DOUBLE) AS length, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 3 AS INT) END AS take FROM orders",
    "takes": "SELECT o_custkey % 25 AS project, CAST(o_custkey AS INT) - 1 AS track, l_orderkey AS item, CAST(l_linenumber AS INT) - 1 AS idx, CASE WHEN l_linenumber > 1 THEN 'take' END AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "notes": "SELECT l_orderkey % 25 AS project, l_orderkey AS take, l_linenumber AS idx, l_extendedprice / 100 AS start, l_quantity AS length, CAST(l_partkey % 128 AS INT) AS pitch, CAST(l_suppkey % 128 AS INT) AS velocity FROM lineitem",
    "cc": "SELECT event_id % 25 AS project, user_id AS take, event_id AS idx, value AS at, CAST(128 + event_id % 128 AS INT) AS status, CAST(event_id % 127 AS INT) AS msg2, CAST(user_id % 127 AS INT) AS msg3 FROM events",
    "points": "SELECT event_id % 25 AS project, user_id AS track, event_type AS envelope, event_id AS idx, event_id / CAST(4 AS DOUBLE) AS time, value, CASE WHEN event_id % 11 > 0 THEN CAST(event_id % 8 AS INT) END AS shape, CAST(NULL AS DOUBLE) AS tension, event_id % 2 = 0 AS selected FROM events",
    "sends": "SELECT s_nationkey AS project, s_suppkey AS track, CAST(s_suppkey % 4 AS INT) - 1 AS category, s_suppkey AS idx, s_suppkey % 9 AS other, (s_suppkey % 5) / CAST(2 AS DOUBLE) AS volume, CAST(NULL AS DOUBLE) AS pan, CAST(s_suppkey % 2 AS INT) AS mute FROM supplier",
    "markers": "SELECT o_orderkey % 25 AS project, o_orderkey AS idx, o_custkey % 3 = 0 AS region, o_custkey AS number, CAST(NULL AS STRING) AS name, o_orderkey / CAST(4 AS DOUBLE) AS position, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey / CAST(2 AS DOUBLE) END AS \"end\" FROM orders",
    "tempo": "SELECT c_nationkey AS project, c_custkey AS idx, CAST(c_custkey AS DOUBLE) AS time, CAST(60 + 7 * (c_custkey % 20) AS DOUBLE) AS bpm, CAST(c_custkey % 5 AS INT) AS num, 4 AS den, c_custkey % 2 = 0 AS linear FROM customer WHERE c_nationkey <> 3",
    "fx": "SELECT c_nationkey AS project, CAST(c_custkey AS INT) - 1 AS track, CAST(c_custkey % 3 AS INT) AS fx, CASE c_custkey % 5 WHEN 0 THEN 'StereoEncoder (IEM)' WHEN 1 THEN 'sparta_ambiDEC' WHEN 2 THEN 'SceneRotator (IEM)' WHEN 3 THEN 'BinauralDecoder (IEM)' ELSE 'ReaEQ' END AS name, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 2 = 0 END AS enabled FROM customer WHERE c_custkey % 6 <> 0",
    "params": "SELECT c_nationkey AS project, CAST(c_custkey AS INT) - 1 AS track, CAST(o_orderkey % 3 AS INT) AS fx, o_orderkey AS param, o_orderpriority AS name, (o_orderkey % 40) / CAST(4 AS DOUBLE) AS value, CAST(1 AS DOUBLE) AS low, CASE WHEN o_orderkey % 13 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(9 AS DOUBLE) END AS high FROM orders JOIN customer ON c_custkey = o_custkey",
}


def _table(spark, sf, name):
    text = TABLES[name].replace('"end"', "`end`")
    tables = {t: B.table(spark, sf, t) for t in ("customer", "orders", "lineitem", "events", "supplier") if f" {t}" in text}
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **tables)


def _with(*names) -> str:
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n].replace('STRING', 'VARCHAR')})" for n in names)


@query(f"{_with('tracks')} SELECT project, idx, coalesce(name, '') AS name, {r6(gain('coalesce(volume, 1)'))} AS vol_db, coalesce(pan, 0) AS pan, channels, mute <> 0 AS mute, solo <> 0 AS solo FROM tracks")
def track_list(spark, sf):
    return S.track_list(_table(spark, sf, "tracks")).select("project", "idx", "name", H.rounded(F.col("vol_db")).alias("vol_db"), "pan", "channels", "mute", "solo")


@query(f"{_with('takes', 'items')} SELECT t.project, t.track, t.item, t.idx, coalesce(t.name, '') AS name, t.idx = coalesce(i.take, 0) AS active FROM takes t LEFT JOIN items i ON i.project = t.project AND i.track = t.track AND i.idx = t.item")
def take_list(spark, sf):
    return S.take_list(_table(spark, sf, "takes"), _table(spark, sf, "items"))


@query(f"""{_with('notes', 'tempo')}, l AS (SELECT *, lead(time) OVER w AS until FROM tempo WINDOW w AS (PARTITION BY project ORDER BY time)), q AS (SELECT *, coalesce(sum((until - time) * bpm / 60) OVER (PARTITION BY project ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q0 FROM l)
    SELECT n.project, take, n.idx, start, length, pitch, velocity, {r6('CASE WHEN q.time IS NULL THEN start / 2 ELSE q.time + (start - q0) * 60 / bpm END')} AS start_time FROM notes n ASOF LEFT JOIN q ON q.project = n.project AND q.q0 <= n.start""")
def note_list(spark, sf):
    notes = _table(spark, sf, "notes").withColumn("channel", F.lit(None).cast("int"))
    out = S.note_list(notes, _table(spark, sf, "tempo"))
    return out.select("project", "take", "idx", "start", "length", "pitch", "velocity", H.rounded(F.col("start_time")).alias("start_time"))


@query(f"""{_with('cc')} SELECT project, take, idx, "at", CASE status & 240 WHEN 160 THEN 'poly_aftertouch' WHEN 176 THEN 'cc' WHEN 192 THEN 'program_change' WHEN 208 THEN 'channel_pressure' WHEN 224 THEN 'pitch_bend' ELSE 'other' END AS type, status & 15 AS channel,
    CASE WHEN status & 240 IN (160, 176) THEN msg2 END AS number, CASE WHEN status & 240 = 224 THEN msg2 + 128 * msg3 WHEN status & 240 IN (160, 176) THEN msg3 ELSE msg2 END AS value FROM cc""".replace(" AS at,", ' AS "at",'))
def cc_list(spark, sf):
    return S.cc_list(_table(spark, sf, "cc"))


@query(f"{_with('points')} SELECT project, track, envelope, count(*) AS points, min(time) AS first, max(time) AS last FROM points GROUP BY ALL")
def envelope_list(spark, sf):
    return S.envelope_list(_table(spark, sf, "points"))


@query(f"{_with('points')} SELECT project, track, envelope, idx, time, value, CASE WHEN shape BETWEEN 0 AND 5 THEN shape ELSE 0 END AS shape, 0.0::DOUBLE AS tension, selected FROM points")
def point_list(spark, sf):
    return S.point_list(_table(spark, sf, "points"))


@query(f"{_with('sends')} SELECT project, track, CASE category WHEN -1 THEN 'receive' WHEN 0 THEN 'send' ELSE 'hardware' END AS category, idx, other, {r6(gain('volume'))} AS vol_db, 0.0::DOUBLE AS pan, mute <> 0 AS mute FROM sends WHERE category < 2")
def send_list(spark, sf):
    return S.send_list(_table(spark, sf, "sends")).withColumn("vol_db", H.rounded(F.col("vol_db")))


@query(f"""{_with('markers')} SELECT project, idx, region, number, '' AS name, position, CASE WHEN region THEN coalesce("end", position) ELSE position END AS "end" FROM markers""")
def marker_list(spark, sf):
    return S.marker_list(_table(spark, sf, "markers"))


@query(f"{_with('tempo')} SELECT project, idx, time, bpm, CASE WHEN num > 0 THEN num ELSE 4 END AS num, 4 AS den, linear FROM tempo")
def tempo_list(spark, sf):
    return S.tempo_list(_table(spark, sf, "tempo"))


@query(f"""{_with('params', 'fx')} SELECT p.project, p.track, p.fx, f.name AS fx_name, CASE WHEN f.fx IS NOT NULL THEN coalesce(enabled, true) END AS enabled, param, p.name, value, {r6('CASE WHEN high > low THEN greatest(0, least(1, (value - low) / (high - low))) ELSE 0 END')} AS normalized, printf('%.2f', value) AS shown
    FROM params p LEFT JOIN fx f ON f.project = p.project AND f.track = p.track AND f.fx = p.fx""")
def param_list(spark, sf):
    return S.param_list(_table(spark, sf, "params"), _table(spark, sf, "fx")).withColumn("normalized", H.rounded(F.col("normalized")))


@query(f"""{_with('tracks', 'items', 'markers', 'tempo', 'takes', 'notes', 'cc')}, n AS (SELECT n_nationkey AS project, n_name AS name FROM nation)
    SELECT project, name, coalesce((SELECT arg_min(bpm, (time, idx)) FROM tempo t WHERE t.project = n.project), 120) AS tempo,
        greatest(coalesce((SELECT max(position + length) FROM items i WHERE i.project = n.project), 0), coalesce((SELECT max(CASE WHEN region THEN coalesce("end", position) ELSE position END) FROM markers m WHERE m.project = n.project), 0)) AS length,
        (SELECT count(*) FROM tracks t WHERE t.project = n.project AND idx >= 0) AS tracks, (SELECT count(*) FROM items t WHERE t.project = n.project) AS items, (SELECT count(*) FROM takes t WHERE t.project = n.project) AS takes,
        (SELECT count(*) FROM markers t WHERE t.project = n.project AND NOT region) AS markers, (SELECT count(*) FROM markers t WHERE t.project = n.project AND region) AS regions, (SELECT count(*) FROM notes t WHERE t.project = n.project) AS notes, (SELECT count(*) FROM cc t WHERE t.project = n.project) AS cc FROM n""".replace(" AS at,", ' AS "at",'))
def project_summary(spark, sf):
    projects = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("project"), F.col("n_name").alias("name"))
    return project.project_summary(projects, *[_table(spark, sf, t) for t in ("tracks", "items", "markers", "tempo", "takes", "notes", "cc")])


@query(f"""{_with('tracks', 'fx')}, o AS (SELECT *, CASE WHEN channels >= 64 THEN 7 WHEN channels >= 49 THEN 6 WHEN channels >= 36 THEN 5 WHEN channels >= 25 THEN 4 WHEN channels >= 16 THEN 3 WHEN channels >= 9 THEN 2 WHEN channels >= 4 THEN 1 ELSE -1 END AS "order" FROM tracks),
    f AS (SELECT project, track, count(*) FILTER (name LIKE '%Encoder%') AS encoders, count(*) FILTER (name LIKE '%ambiDEC%') AS decoders, count(*) FILTER (name LIKE '%Rotator%') AS rotators, count(*) FILTER (name LIKE '%Binaural%') AS binaurals FROM fx GROUP BY 1, 2)
    SELECT o.project, idx, channels, "order", CASE WHEN "order" > 0 THEN ("order" + 1) * ("order" + 1) END AS scene_channels, "order" > 0 AND channels > ("order" + 1) * ("order" + 1) AS padded, CASE WHEN "order" > 0 THEN channels - ("order" + 1) * ("order" + 1) ELSE 0 END AS surplus,
        coalesce(encoders, 0) AS encoders, coalesce(decoders, 0) AS decoders, coalesce(rotators, 0) AS rotators, coalesce(binaurals, 0) AS binaurals FROM o LEFT JOIN f ON f.project = o.project AND f.track = o.idx""")
def scene_state(spark, sf):
    return project.scene_state(_table(spark, sf, "tracks"), _table(spark, sf, "fx"))


@query("""WITH s AS (SELECT c_custkey AS session, ['5.1', '7.1', '7.1.4', '9.1.6', '22.2', 'odd', NULL][(c_custkey % 7 + 1)::INT] AS layout, [6, 8, 12, 16, 24, NULL, NULL][(c_custkey % 7 + 1)::INT] AS ch, (c_custkey % 5)::INT AS objects, c_custkey % 2 = 0 AS monitor, c_custkey % 3 = 0 AS renderer FROM customer),
    k AS (SELECT session, 0 AS step, 'build_bed' AS action, layout || ' Bed' AS target, ch || ' ch' AS detail FROM s WHERE ch IS NOT NULL UNION ALL SELECT session, 0, 'refused', coalesce(layout, ''), 'unknown_layout' FROM s WHERE ch IS NULL
        UNION ALL SELECT session, i, 'add_object_track', 'Object ' || i, 'mono object track' FROM (SELECT *, unnest(range(1, objects + 1)) AS i FROM s WHERE ch IS NOT NULL)
        UNION ALL SELECT session, 1 + objects, 'add_binaural_monitor', 'monitor bus', 'object' FROM s WHERE ch IS NOT NULL AND monitor UNION ALL SELECT session, 1 + objects + monitor::INT, 'renderer_sends', 'renderer bus', ch || '-ch bed + ' || objects || ' objects' FROM s WHERE ch IS NOT NULL AND renderer)
    SELECT session, step::INT AS step, action, target, detail FROM k""")
def plan_session(spark, sf):
    k = F.col("c_custkey")
    layout = F.element_at(F.array(*map(F.lit, ("5.1", "7.1", "7.1.4", "9.1.6", "22.2", "odd", None))), (k % 7 + 1).cast("int"))
    rows = B.table(spark, sf, "customer").select(k.alias("session"), layout.alias("layout"), (k % 5).cast("int").alias("objects"), (k % 2 == 0).alias("monitor"), (k % 3 == 0).alias("renderer"))
    return project.plan_session(rows, "session")
