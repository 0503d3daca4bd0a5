"""Queries on object-audio masters: metadata texts and track tables made of customers and their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundtable.functions import scalars as H
from soundtable.operators import profile
from soundtable.plans import bindings as B
from soundtable.sources import adm, damf, object_metadata

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The metadata text of a master, in words that both engines read alike: pieces that depend on the customer's key k.
TEXT = """concat('<audioFormatExtended version="ITU-R_BS.2076-', k % 3, '">',
    CASE WHEN k % 13 = 0 THEN '<audioProgramme audioProgrammeID="APR_1002" audioProgrammeName="P">' ELSE '<audioProgramme audioProgrammeID="APR_1001" audioProgrammeName="Main">' END,
    CASE WHEN k % 17 = 0 THEN '<audioProgramme audioProgrammeID="APR_1003" audioProgrammeName="Q">' ELSE '' END,
    repeat('<audioObject audioObjectName="Obj" >', CAST(k % 125 AS INT)), CASE WHEN k % 4 = 0 THEN '<audioObject importance="0">' WHEN k % 9 = 0 THEN '<audioObject importance="7">' ELSE '' END,
    '<audioChannelFormat audioChannelFormatName="Ch', k % 10, '" typeDefinition="', CASE WHEN k % 3 = 0 THEN 'DirectSpeakers' ELSE 'Objects' END, '">',
    CASE WHEN k % 6 = 5 THEN '<position coordinate="azimuth">30</position>' ELSE '<cartesian>1</cartesian>' END, CASE WHEN k % 3 = 0 THEN '<speakerLabel>M+030</speakerLabel>' ELSE '' END,
    '<audioBlockFormat rtime="0">', CASE WHEN k % 8 = 0 THEN '<jumpPosition interpolationLength="0.5">1</jumpPosition>' WHEN k % 8 = 1 THEN '' ELSE '<jumpPosition interpolationLength="0">1</jumpPosition>' END,
    CASE WHEN k % 5 = 0 THEN '<width>0.5</width><depth>0.5</depth><height>0.4</height>' WHEN k % 5 = 1 THEN '<width>0.2</width><depth>0.2</depth><height>0.2</height>' ELSE '' END, '</audioBlockFormat>',
    '<audioBlockFormat rtime="1">', CASE WHEN k % 8 = 1 THEN '' WHEN k % 8 = 2 THEN '<jumpPosition interpolationLength="0.1">1</jumpPosition>' WHEN k % 8 = 3 THEN '<jumpPosition>1</jumpPosition>' ELSE '<jumpPosition interpolationLength="0.005208">1</jumpPosition>' END,
    CASE WHEN k % 21 = 0 THEN '<objectDivergence azimuthRange="30">0.5</objectDivergence>' ELSE '' END, '</audioBlockFormat></audioChannelFormat></audioFormatExtended>')"""
FILES = f"files AS (SELECT k AS path, k % 11 <> 0 AS is_adm, CASE WHEN k % 7 = 0 THEN 44100 ELSE 48000 END AS rate, CASE WHEN k % 5 = 4 THEN 16 ELSE 24 END AS bits, (k % 140)::INT AS channels, {TEXT} AS axml FROM (SELECT c_custkey AS k FROM customer))"
UIDS = """uids AS (SELECT o_custkey AS path, CASE WHEN o_orderkey % 29 = 0 THEN 'AP_x' ELSE 'AP_' || lpad(CASE WHEN o_orderkey % 10 < 5 THEN '1' WHEN o_orderkey % 10 < 8 THEN '3' ELSE (o_orderkey % 6)::VARCHAR END, 4, '0')
    || lpad(lower(hex(CASE WHEN o_orderkey % 2 = 0 THEN 1 + o_orderkey % 24 ELSE 4096 + o_orderkey % 3 END)), 4, '0') END AS pack_ref FROM orders)"""


def _files(spark, sf):
    k = F.col("k")
    rows = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return rows.select(k.alias("path"), (k % 11 != 0).alias("is_adm"), F.when(k % 7 == 0, 44100).otherwise(48000).alias("rate"), F.when(k % 5 == 4, 16).otherwise(24).alias("bits"), (k % 140).cast("int").alias("channels"), F.expr(TEXT).alias("axml"))


def _uids(spark, sf):
    k = F.col("o_orderkey")
    kind = F.when(k % 10 < 5, "1").when(k % 10 < 8, "3").otherwise((k % 6).cast("string"))
    number = F.when(k % 2 == 0, 1 + k % 24).otherwise(4096 + k % 3)
    ref = F.when(k % 29 == 0, "AP_x").otherwise(F.concat(F.lit("AP_"), F.lpad(kind, 4, "0"), F.lpad(F.lower(F.hex(number)), 4, "0")))
    return B.table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), ref.alias("pack_ref"))


def _count(literal: str, text: str = "axml") -> str:
    return f"len(regexp_extract_all({text}, '{literal}'))"


def _all(pattern: str, text: str = "axml") -> str:
    return f"regexp_extract_all({text}, '{pattern}', 1, 's')"


#: Beds of the common definitions that the profile refuses, as their ids say.
REFUSED = ", ".join(f"'AP_000100{k}'" for k, ok in profile.COMMON_BEDS.items() if not ok)
TAKEN = ", ".join(f"'AP_000100{k}'" for k, ok in profile.COMMON_BEDS.items() if ok)
NUMBER = "coalesce(try_cast({0} AS DOUBLE), -1)"


@query(rf"""WITH {FILES}, {UIDS}, p AS (SELECT path, pack_ref, count(*) AS used, substr(pack_ref, 4, 4) AS type FROM uids WHERE pack_ref LIKE 'AP\_%' ESCAPE '\' AND length(pack_ref) >= 11 GROUP BY 1, 2),
    c AS (SELECT path, count(*) FILTER (type = '0001') AS beds, count(*) FILTER (type = '0002') AS matrix, count(*) FILTER (type = '0003') AS objs, count(*) FILTER (type = '0004') AS hoa, count(*) FILTER (type = '0005') AS bin FROM p GROUP BY 1),
    w AS (SELECT files.*, coalesce(beds, 0) AS beds, coalesce(matrix, 0) AS matrix, coalesce(objs, 0) AS objs, coalesce(hoa, 0) AS hoa, coalesce(bin, 0) AS bin, contains(axml, 'typeDefinition="Objects"') OR coalesce(objs, 0) > 0 AS has_objects,
        contains(axml, 'DirectSpeakers') OR coalesce(beds, 0) > 0 AS has_beds, {_all('<audioChannelFormat (.*?)</audioChannelFormat>')} AS cfs, {_all('<width>(.*?)</width>')} AS ws, {_all('<height>(.*?)</height>')} AS hs, {_all('<depth>(.*?)</depth>')} AS ds
        FROM files LEFT JOIN c USING (path) WHERE is_adm),
    o AS (SELECT *, CASE WHEN objs > 0 THEN objs ELSE {_count('<audioObject ')} - has_beds::INT END AS n_objects,
        list_transform(list_filter(cfs, lambda f: contains(f, 'typeDefinition="Objects"')), lambda f: list_transform({_all('<audioBlockFormat(.*?)</audioBlockFormat>', 'f')}, lambda b: {_all('interpolationLength="([^"]*)"', 'b')}[1])) AS said FROM w),
    r AS (SELECT *, len(list_filter(said, lambda s: (s[1] IS NOT NULL AND NOT ({NUMBER.format('s[1]')} >= 0 AND {NUMBER.format('s[1]')} < 1e-9))
        OR len(list_filter(s[2:], lambda x: x IS NULL OR {NUMBER.format('x')} < 0 OR abs({NUMBER.format('x')} - 250.0::DOUBLE / rate) > 1e-4)) > 0)) > 0 AS bad_ramp FROM o)
    SELECT path, 'not_adm' AS code, 'no chna and axml' AS detail FROM files WHERE NOT is_adm
    UNION ALL SELECT path, 'sample_rate', 'rate ' || rate FROM r WHERE rate <> 48000 UNION ALL SELECT path, 'bit_depth', 'bits ' || bits FROM r WHERE bits <> 24 UNION ALL SELECT path, 'channel_cap', 'channels ' || channels FROM r WHERE channels > 128
    UNION ALL SELECT path, 'content_type', 'scene packs ' || hoa FROM r WHERE hoa > 0 UNION ALL SELECT path, 'content_type', 'binaural packs ' || bin FROM r WHERE bin > 0 UNION ALL SELECT path, 'content_type', 'matrix packs ' || matrix FROM r WHERE matrix > 0
    UNION ALL SELECT path, 'bed_layout', pack_ref FROM p JOIN r USING (path) WHERE type = '0001' AND (pack_ref IN ({REFUSED}) OR pack_ref NOT IN ({REFUSED}, {TAKEN}) AND used NOT IN (2, 3, 5, 6, 7, 8, 9, 10))
    UNION ALL SELECT path, 'object_cap', 'objects ' || n_objects FROM r WHERE n_objects > 118 UNION ALL SELECT path, 'coordinate', 'spherical' FROM r WHERE has_objects AND NOT contains(axml, '<cartesian>1</cartesian>')
    UNION ALL SELECT path, 'divergence', 'blocks ' || {_count('<objectDivergence')} FROM r WHERE {_count('<objectDivergence')} > 0
    UNION ALL SELECT path, 'importance', 'active' FROM r WHERE contains(axml, ' importance="') AND len(list_filter({_all('importance="([^"]*)"')}, lambda v: v::INT <> 0)) > 0
    UNION ALL SELECT path, 'programme_id', 'other' FROM r WHERE NOT contains(axml, 'audioProgrammeID="APR_1001"') UNION ALL SELECT path, 'programme_count', 'programmes ' || {_count('<audioProgramme ')} FROM r WHERE {_count('<audioProgramme ')} > 1
    UNION ALL SELECT path, 'extent', 'differs' FROM r WHERE ws <> hs OR hs <> ds UNION ALL SELECT path, 'interpolation', 'missing' FROM r WHERE has_objects AND NOT contains(axml, 'interpolationLength')
    UNION ALL SELECT path, 'interpolation_ramp', 'differs' FROM r WHERE has_objects AND contains(axml, 'interpolationLength') AND bad_ramp""")
def profile_check(spark, sf):
    return profile.profile_check(_files(spark, sf), _uids(spark, sf))


@query(f"""WITH {FILES}, m AS (SELECT path, unnest(list_transform({_all('<audioChannelFormat (.*?)</audioChannelFormat>')}, lambda f: f)) AS f FROM files)
    SELECT path, 0 AS channel_no, {_all('audioChannelFormatName="([^"]*)"', 'f')}[1] AS name, {_all('typeDefinition="([^"]*)"', 'f')}[1] AS type, {_count('<audioBlockFormat', 'f')}::INT AS blocks, coalesce({_all('<speakerLabel>(.*?)</speakerLabel>', 'f')}[1], '') AS speaker,
        CASE WHEN contains(f, '<cartesian>1</cartesian>') THEN 'cartesian' WHEN contains(f, 'coordinate="azimuth"') THEN 'spherical' ELSE 'none' END AS coordinate FROM m""")
def channel_formats(spark, sf):
    return adm.channel_formats(_files(spark, sf))


@query(f"""WITH {FILES} SELECT path, {_count('<audioObject ')}::INT AS objects, {_count('<audioBlockFormat ')}::INT AS blocks, {_count('<width>')}::INT AS extent_blocks, {_count('<objectDivergence')}::INT AS divergence_blocks,
    CASE WHEN contains(axml, '<cartesian>1</cartesian>') THEN 'cartesian' ELSE 'spherical' END AS coordinates, contains(axml, 'DirectSpeakers') AS has_beds, contains(axml, 'typeDefinition="Objects"') AS has_objects,
    {_all('audioProgrammeName="([^"]*)"')}[1] AS programme, {_all('<audioFormatExtended version="([^"]*)"')}[1] AS version, len({_all('importance="([^"]*)"')}) AS n_importance FROM files""")
def metadata_counts(spark, sf):
    found = adm.metadata_counts(_files(spark, sf))
    return found.select("path", "objects", "blocks", "extent_blocks", "divergence_blocks", "coordinates", "has_beds", "has_objects", "programme", "version", F.size("importance").cast("long").alias("n_importance"))


@query(f"WITH {FILES} SELECT path FROM files WHERE is_adm AND contains(axml, 'typeDefinition=\"Objects\"') AND path NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 40 = 0)")
def ingest_advisory(spark, sf):
    o = B.table(spark, sf, "orders")
    chunks = o.select(F.col("o_custkey").alias("path"), F.when(F.col("o_orderkey") % 40 == 0, "dbmd").otherwise("data").alias("id"))
    return profile.ingest_advisory(_files(spark, sf), chunks)


#: Labels of a master's bed channels in order, and which of them a master of key k has.
BED = ("L", "R", "C", "LFE", "Lss", "Rss", "Lrs", "Rrs", "Ltf", "Rtf")


@query(f"""WITH b AS (SELECT c_custkey AS master, i, CASE WHEN c_custkey % 19 = 0 AND i = 2 THEN 'Cb' ELSE [{', '.join(f"'{x}'" for x in BED)}][i + 1] END AS label FROM (SELECT *, unnest(range(2 + c_custkey % 9)) AS i FROM customer) WHERE NOT (i = 3 AND c_custkey % 2 = 0)),
    g AS (SELECT master, string_agg(replace(replace(label, 'Ltf', 'Lts'), 'Rtf', 'Rts'), ',' ORDER BY i) AS layout, max((label = 'Cb')::INT) AS odd FROM b GROUP BY 1)
    SELECT master, layout, CASE WHEN master % 5 = 0 THEN 'bit_depth' WHEN master % 7 = 0 THEN 'sample_rate' WHEN odd = 1 THEN 'unmapped_label' WHEN layout NOT IN ({', '.join(f"'{x}'" for x in profile.BED_ORDERS)}) THEN 'bed_layout' END AS refusal FROM g""")
def bed_gate(spark, sf):
    k = F.col("c_custkey")
    rows = B.table(spark, sf, "customer").select(k, F.posexplode(F.slice(F.array(*map(F.lit, BED)), 1, (2 + k % 9).cast("int"))).alias("i", "label")).where(~((F.col("i") == 3) & (k % 2 == 0)))
    rows = rows.select(k.alias("master"), "i", F.when((k % 19 == 0) & (F.col("i") == 2), "Cb").otherwise(F.col("label")).alias("label"), F.when(k % 5 == 0, 16).otherwise(24).alias("bits"), F.when(k % 7 == 0, 44100).otherwise(48000).alias("rate"))
    return profile.bed_gate(rows, "master", "label", "i", "bits", "rate")


# ---- event lists of masters: suppliers as bed channels, customers as objects, their orders as blocks


def _r6(x: str) -> str:
    return f"(round(({x}) * 1000000.0::DOUBLE) / 1000000.0::DOUBLE + 0.0::DOUBLE)"


EVENTS = f"""bed AS (SELECT s_nationkey AS program, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS id FROM supplier), n AS (SELECT program, count(*) AS n FROM bed GROUP BY 1),
    obj AS (SELECT c_nationkey AS program, c_custkey AS idx, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + coalesce(n, 0) AS id FROM customer LEFT JOIN n ON n.program = c_nationkey),
    blk AS (SELECT o_custkey AS idx, o_orderkey / 7.0::DOUBLE AS rtime, radians((o_orderkey % 360 - 180)::DOUBLE) AS az, radians((o_orderkey % 181 - 90)::DOUBLE) AS el, (o_orderkey % 4)::DOUBLE / 2 AS dist FROM orders),
    ev AS (SELECT program, id, 0::BIGINT AS sample, NULL::DOUBLE AS x, NULL::DOUBLE AS y, NULL::DOUBLE AS z FROM bed UNION ALL
        SELECT program, id, coalesce(floor(rtime * 48000 + 0.5), 0)::BIGINT, CASE WHEN rtime IS NULL THEN 0 ELSE greatest(-1, least(1, -dist * cos(el) * sin(az))) END, CASE WHEN rtime IS NULL THEN 1 ELSE greatest(-1, least(1, dist * cos(el) * cos(az))) END,
            CASE WHEN rtime IS NULL THEN 0 ELSE greatest(0, least(1, dist * sin(el))) END FROM obj LEFT JOIN blk USING (idx))"""


def _events(spark, sf):
    beds = B.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("program"), F.col("s_suppkey").alias("idx"))
    customers = B.table(spark, sf, "customer").select(F.col("c_nationkey").alias("program"), F.col("c_custkey").alias("idx"))
    k = F.col("o_orderkey")
    blocks = B.table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("idx")).select("program", F.col("idx").alias("object"), (k / 7.0).alias("rtime"), (k % 360 - 180).cast("double").alias("az"), (k % 181 - 90).cast("double").alias("el"), ((k % 4) / 2).cast("double").alias("dist"))
    return damf.master_events(beds, customers, blocks, "program")


@query(f"WITH {EVENTS} SELECT program, id::BIGINT AS id, sample, {_r6('x')} AS x, {_r6('y')} AS y, {_r6('z')} AS z FROM ev")
def master_events(spark, sf):
    return _events(spark, sf).select("program", F.col("id").cast("long").alias("id"), "sample", *[H.rounded(F.col(c)).alias(c) for c in "xyz"])


@query(f"""WITH {EVENTS} SELECT program || '.atmos.metadata' AS name, count(*) + 6 AS lines, count(x) AS places FROM ev GROUP BY program""")
def metadata_lines(spark, sf):
    lines = damf.metadata_lines(_events(spark, sf), "program")
    return lines.groupBy("name").agg(F.count("line").alias("lines"), F.count_if(F.contains("line", F.lit("pos: ["))).alias("places"))


# ---- object metadata

OBJECTS = """obj AS (SELECT c_nationkey AS program, c_custkey AS idx, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS cartesian, CASE WHEN c_custkey % 5 = 0 THEN CAST(0.5 AS DOUBLE) END AS size, CASE WHEN c_custkey % 7 = 0 THEN CAST(0.25 AS DOUBLE) END AS width,
    CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 9) / CAST(4 AS DOUBLE) - CAST(0.5 AS DOUBLE) END AS divergence, CASE WHEN c_custkey % 8 = 0 THEN (c_custkey % 3) * CAST(10 AS DOUBLE) - 5 END AS divergence_range, CASE WHEN c_custkey % 6 = 0 THEN CAST(c_custkey % 20 - 4 AS INT) END AS importance FROM customer)"""
BLOCKS = """blk AS (SELECT o_custkey AS object, o_orderkey / CAST(8 AS DOUBLE) AS rtime, CASE WHEN o_orderkey % 5 = 0 THEN CAST(2 AS DOUBLE) END AS duration, CAST(o_orderkey % 900 - 400 AS DOUBLE) AS az, CAST(o_orderkey % 241 - 120 AS DOUBLE) AS el, CASE WHEN o_orderkey % 9 > 0 THEN (o_orderkey % 7) / CAST(2 AS DOUBLE) - CAST(0.5 AS DOUBLE) END AS dist, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 = 2 END AS jump FROM orders)"""


def _object_rows(spark, sf):
    text = OBJECTS[OBJECTS.index("(") + 1 : -1].replace("FROM customer", "FROM {customer}")
    none = {c: F.lit(None).cast("double") for c in ("height", "depth")}
    return spark.sql(text, customer=B.table(spark, sf, "customer")).withColumns(none | {"name": F.lit(None).cast("string")})


@query(f"""WITH {OBJECTS}, r AS (SELECT *, coalesce(cartesian, false) AS room, width IS NOT NULL OR size IS NOT NULL AS given FROM obj)
    SELECT program, idx, room AS cartesian, greatest(0, least(10, importance)) + 0 * importance AS importance, CASE WHEN given THEN coalesce(width, size) END AS width, CASE WHEN given THEN coalesce(size, 0) END AS height,
        CASE WHEN divergence IS NOT NULL THEN greatest(0, least(1, divergence)) END AS divergence, CASE WHEN divergence IS NOT NULL THEN CASE WHEN divergence_range >= 0 THEN divergence_range WHEN room THEN 0.5 ELSE 45 END::DOUBLE END AS divergence_range FROM r""")
def object_table(spark, sf):
    return object_metadata.object_table(_object_rows(spark, sf), "program").drop("name", "depth")


@query(f"""WITH {OBJECTS}, {BLOCKS}, m AS (SELECT program, idx AS object, coalesce(cartesian, false) AS room, coalesce(rtime, 0) AS rtime, duration AS own, coalesce(az, 0) AS az, coalesce(el, 0) AS el, coalesce(dist, 1) AS dist FROM obj LEFT JOIN blk ON blk.object = idx),
    n AS (SELECT *, row_number() OVER w - 1 AS block, CASE WHEN own > 0 THEN own ELSE greatest(coalesce(lead(rtime) OVER w, 10000) - rtime, 0) END AS duration, ((az % 360) + 360) % 360 AS turned FROM m WINDOW w AS (PARTITION BY program, object ORDER BY rtime, az, el, dist))
    SELECT program, object, block::INT AS block, rtime, duration, CASE WHEN NOT room THEN CASE WHEN turned > 180 THEN turned - 360 ELSE turned END END AS az, CASE WHEN NOT room THEN greatest(-90, least(90, el)) END AS el, CASE WHEN NOT room THEN greatest(dist, 0) END AS dist,
        CASE WHEN room THEN {_r6('greatest(-1, least(1, -dist * cos(radians(el)) * sin(radians(az))))')} END AS x, CASE WHEN room THEN {_r6('greatest(-1, least(1, dist * cos(radians(el)) * cos(radians(az))))')} END AS y, CASE WHEN room THEN {_r6('greatest(-1, least(1, dist * sin(radians(el))))')} END AS z,
        CASE WHEN block = 0 THEN 0.0::DOUBLE ELSE 250.0::DOUBLE / 48000 END AS interpolation FROM n""")
def block_table(spark, sf):
    text = BLOCKS[BLOCKS.index("(") + 1 : -1].replace("FROM orders", "FROM {orders}")
    blocks = spark.sql(text, orders=B.table(spark, sf, "orders"))
    nations = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("of"), F.col("c_nationkey").alias("program"))
    blocks = blocks.join(nations, F.col("object") == F.col("of")).drop("of").withColumn("gain", F.lit(1.0))
    out = object_metadata.block_table(object_metadata.object_table(_object_rows(spark, sf), "program"), blocks, "program", 10000.0, profile=True)
    return out.drop("gain", "jump").withColumns({c: H.rounded(F.col(c)) for c in "xyz"})
