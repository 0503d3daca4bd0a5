"""Queries on turned, encoded and decoded scenes, control packets and line diffs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from soundtable.functions import harmonics
from soundtable.functions import scalars as H
from soundtable.operators import scene, text_diff
from soundtable.plans import bindings as B
from soundtable.streaming import control, updates

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


def basis_sql(order: int, az: str = "az", el: str = "el") -> str:
    """The harmonics of a direction as a list, ACN by ACN."""
    parts = []
    for k in range((order + 1) ** 2):
        l, m = harmonics.degree(k), harmonics.order(k)
        sine = " + ".join(f"{c!r}::DOUBLE * pow(sin(radians({el})), {i})" for i, c in enumerate(harmonics.legendre_derivative(l, abs(m))) if c)
        norm = math.sqrt((2 if m else 1) * math.factorial(l - abs(m)) / math.factorial(l + abs(m)))
        turn = f"sin({-m} * radians({az}))" if m < 0 else f"cos({m} * radians({az}))"
        parts.append(f"({sine}) * {norm!r}::DOUBLE * pow(cos(radians({el})), {abs(m)}) * {turn}")
    return f"[{', '.join(parts)}]"


ANGLES, ORDER = (33.0, -20.0, 71.0), 3


def _rotation_rows() -> str:
    rows = []
    for degree, block in enumerate(scene.rotation_blocks(*ANGLES, ORDER)):
        for i, row in enumerate(block):
            full = [0.0] * (ORDER + 1) ** 2
            full[degree**2 : degree**2 + len(row)] = [float(v) for v in row]
            rows.append(f"({degree**2 + i}, {full!r}::DOUBLE[])")
    return ", ".join(rows)


@query(f"WITH {B.SCENE}, m(k, w) AS (VALUES {_rotation_rows()}) SELECT program_id, frame, k::INT AS k, {r6('list_inner_product(acn[1:16], w)')} AS value FROM scene, m")
def rotate_scene(spark, sf):
    turned = B.scene(spark, sf).withColumn("acn", scene.rotate_scene(F.col("acn"), *ANGLES, order=ORDER))
    return turned.select("program_id", "frame", F.posexplode("acn").alias("k", "value")).withColumn("value", H.rounded(F.col("value")))


SOURCES = "src AS (SELECT o_custkey % 50 AS program_id, o_orderkey // 40 AS frame, (o_orderkey % 7 - 3) / 4.0::DOUBLE AS x, (o_orderkey % 360 - 180)::DOUBLE AS az, (o_orderkey % 181 - 90)::DOUBLE AS el FROM orders)"
ENCODED = f"{SOURCES}, y AS (SELECT program_id, frame, x, {basis_sql(ORDER)} AS y FROM src), e AS (SELECT program_id, frame, k, sum(x * y[k]) AS v FROM (SELECT *, unnest(range(1, 17)) AS k FROM y) GROUP BY 1, 2, 3), enc AS (SELECT program_id, frame, list(v ORDER BY k) AS acn FROM e GROUP BY 1, 2)"


def _encoded(spark, sf):
    k = F.col("o_orderkey")
    sources = B.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("program_id"), F.floor(k / 40).alias("frame"), ((k % 7 - 3) / 4.0).cast("double").alias("x"), (k % 360 - 180).cast("double").alias("az"), (k % 181 - 90).cast("double").alias("el"))
    return scene.encode_source(sources, ["program_id", "frame"], ORDER)


@query(f"WITH {ENCODED} SELECT program_id, frame, (k - 1)::INT AS k, {r6('v')} AS value FROM e")
def encode_source(spark, sf):
    return _encoded(spark, sf).select("program_id", "frame", F.posexplode("acn").alias("k", "value")).withColumn("value", H.rounded(F.col("value")))


def _speaker_rows(layout: str) -> str:
    return ", ".join(f"({i}, '{label}', {[float(v) for v in y]!r}::DOUBLE[])" for i, ((label, *_), y) in enumerate(zip(harmonics.speakers(layout), harmonics.basis(layout, (ORDER + 1) ** 2), strict=True)))


@query(f"WITH {ENCODED}, spk(idx, label, w) AS (VALUES {_speaker_rows('7.1.4')}) SELECT program_id, frame, label, {r6('list_inner_product(acn, w)')} AS value FROM enc, spk")
def decode_scene(spark, sf):
    out = scene.decode_scene(_encoded(spark, sf), ["program_id", "frame"], "7.1.4", (ORDER + 1) ** 2)
    return out.select("program_id", "frame", "label", H.rounded(F.col("value")).alias("value"))


@query(f"WITH {ENCODED} SELECT program_id, frame, {r6(f'list_inner_product(acn, {basis_sql(ORDER, '(frame % 360)', '(program_id - 25)')})')} AS value FROM enc")
def beam(spark, sf):
    value = scene.beam(F.col("acn"), (F.col("frame") % 360).cast("double"), (F.col("program_id") - 25).cast("double"), ORDER)
    return _encoded(spark, sf).select("program_id", "frame", H.rounded(value).alias("value"))


# ---- control packets

QUATERNION = """CASE WHEN q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3 <= 1e-18 THEN 0.0::DOUBLE ELSE {} END"""


@query(f"""WITH p AS (SELECT 's' || user_id % 50 AS source, ts, event_id AS seq, event_type, (event_id % 100)::DOUBLE AS a, (event_id % 37)::DOUBLE AS b, (event_id % 11)::DOUBLE AS c, (event_id % 5)::DOUBLE AS d FROM events),
    q AS (SELECT *, a / n AS w, b / n AS x, c / n AS y, d / n AS z, n <= 1e-9 AS small FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS n FROM p)),
    axes AS (SELECT source, ts, seq, CASE event_type WHEN 'click' THEN a WHEN 'view' THEN a WHEN 'purchase' THEN CASE WHEN small THEN 0 ELSE degrees(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))) END END AS yaw,
        CASE event_type WHEN 'view' THEN b WHEN 'purchase' THEN CASE WHEN small THEN 0 ELSE degrees(asin(greatest(-1, least(1, 2 * (w * y - z * x))))) END END AS pitch,
        CASE event_type WHEN 'view' THEN c WHEN 'signup' THEN d WHEN 'purchase' THEN CASE WHEN small THEN 0 ELSE degrees(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))) END END AS roll FROM q WHERE event_type <> 'error')
    SELECT source, {r6('arg_max(yaw, (ts, seq)) FILTER (yaw IS NOT NULL)')} AS yaw, {r6('arg_max(pitch, (ts, seq)) FILTER (pitch IS NOT NULL)')} AS pitch, {r6('arg_max(roll, (ts, seq)) FILTER (roll IS NOT NULL)')} AS roll FROM axes GROUP BY 1""")
def head_tracking(spark, sf):
    """Binary packets made of events (of which errors make packets that do not read), decoded and summed up to the last turn of each source."""
    k = F.col("event_id")
    four = [F.lpad(F.hex(k % n), 8, "0") for n in (100, 37, 11, 5)]
    text = lambda s: F.lit((s.encode() + b"\0" * (4 - len(s) % 4)).hex())
    kind = F.col("event_type")
    one = lambda address, tags, *values: F.concat(text(address), text("," + tags), *values)
    packet = F.when(kind == "click", one("/head/Yaw", "i", four[0])).when(kind == "view", one("/ypr", "iii", *four[:3])).when(kind == "purchase", one("/Quaternion", "iiii", *four)).when(kind == "signup", one("/roll", "i", four[3])).otherwise(F.lit("deadbeef"))
    packets = B.table(spark, sf, "events").select("ts", k.alias("seq"), F.concat(F.lit("s"), F.col("user_id") % 50).alias("source"), F.unhex(packet).alias("value"))
    turns = control.head_turns(control.orientation_axes(control.osc_messages(packets)))
    return turns.select("source", *[H.rounded(F.col(a)).alias(a) for a in ("yaw", "pitch", "roll")])


@query("""WITH e AS (SELECT user_id AS program_id, ts FROM events WHERE value >= 250), g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY program_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY program_id ORDER BY ts) AS session FROM g) SELECT program_id, min(ts) AS "start", max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS frames FROM s GROUP BY program_id, session""")
def silence_sessions(spark, sf):
    levels = B.table(spark, sf, "events").select("ts", F.col("user_id").alias("program_id"), F.when(F.col("value") >= 250, -20.0).otherwise(-80.0).alias("level_db"))
    return updates.silence_sessions(levels, gap="1 hour")


# ---- line diffs


@query()
def chunk_diff(spark, sf):
    """Each document's text against the one before it (by id). No SQL: tests compare with a dynamic program."""
    docs = B.table(spark, sf, "documents").select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") + 1).alias("next"), F.col("text").alias("before")), F.col("doc_id") == F.col("next")).select("doc_id", "before", F.col("text").alias("after"))
    return text_diff.diff_chunks(pairs, "doc_id", "before", "after")
