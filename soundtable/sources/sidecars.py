"""Documents beside a delivery: what its channels, objects and scene are meant to be, and what a package is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundtable.functions.scalars import fmt_num, half_away, json_quote, slug, yaml_path, yaml_quote
from soundtable.sources.documents import write_documents

#: Tolerances that a sidecar states, in order.
TOLERANCES = '  "tolerances": {"posDeg": 5, "levelLu": 0.5, "dominantFrac": 0.9, "covSilent": 0.01, "silentDb": -40}'


def _num(x: Column, places: int = 6) -> Column:
    scaled = half_away(x * 10**places) / 10**places
    return fmt_num(F.when(scaled == 0, 0.0).otherwise(scaled))


def _field(name: str, value: Column, places: int = 3) -> Column:
    """, "name": value, or nothing where there is no claim."""
    return F.when(value.isNotNull(), F.concat(F.lit(f', "{name}": '), _num(value, places))).otherwise("")


def _levels() -> Column:
    return F.concat(_field("expectRmsDb", F.col("rms_db")), _field("expectLufs", F.col("lufs")), _field("expectActive", F.col("active")))


def _comma(last: Column) -> Column:
    return F.when(last, "").otherwise(",")


def intent_lines(programs: DataFrame, roster: DataFrame, objects: DataFrame, trajectory: DataFrame, scene: DataFrame, program: str = "program") -> DataFrame:
    """(name, part, a, b, line): the lines of each program's JSON document, in the order of part, a and b.

    programs: (program, tool, version, export, rate, start, end, slice, layout, bed_lufs, order), layout and order null where
    there is no bed or scene. roster: (program, idx, channel, track, rms_db, lufs, active); objects: (program, id, label, track,
    rms_db, lufs, active); trajectory: (program, object, t, az, el, dist, gain); scene: (program, k, rms_db). A null level is no
    claim and has no field; blocks without rows are left out. Lines are made row by row: commas come from windows of a
    program's rows, nothing is gathered but the levels of a scene, of which there are 64."""
    p, key = F.col(program), F.col(program).cast("string")
    name = F.concat(key, F.lit(".intent.json")).alias("name")

    def line(rows: DataFrame, part: int, text: Column, a: Column | None = None, b: Column | None = None) -> DataFrame:
        zero = F.lit(0).cast("double")
        return rows.select(name, F.lit(part).alias("part"), (zero if a is None else a.cast("double")).alias("a"), (zero if b is None else b.cast("double")).alias("b"), text.alias("line"))

    has = lambda rows: rows.select(program).distinct().withColumn("__has", F.lit(True))
    bed, many = has(roster), has(objects)
    whole = programs.join(bed.withColumnRenamed("__has", "__bed"), program, "left").join(many.withColumnRenamed("__has", "__objects"), program, "left")
    beds = whole.where("__bed AND layout IS NOT NULL")
    listed = roster.join(beds.select(program), program, "left_semi")
    w = W.partitionBy(program).orderBy(F.desc("idx"))
    entry = F.concat(F.lit('      {"channel": '), json_quote(F.col("channel")), F.lit(', "track": '), F.col("track").cast("string"), _levels(), F.lit("}"), _comma(F.row_number().over(w) == 1))
    last = F.row_number().over(W.partitionBy(program).orderBy(F.desc("id"))) == 1
    placed = objects.withColumn("__last", last)
    points = trajectory.select(p.alias("__p"), F.col("object").alias("__o"), "t", "az", "el", "dist", "gain")
    met = placed.join(points, (p == F.col("__p")) & (F.col("id") == F.col("__o")))
    final = F.row_number().over(W.partitionBy(program, "id").orderBy(F.desc("t"))) == 1
    point = F.concat(F.lit('        {"t": '), _num(F.col("t")), *[x for c in ("az", "el", "dist", "gain") for x in (F.lit(f', "{c}": '), _num(F.coalesce(c, F.lit(0.0))))], F.lit("}"), _comma(final))
    levels = F.when(_levels() != "", F.concat(F.lit(",\n      "), F.substr(_levels(), F.lit(3)))).otherwise("")
    levels_of = scene.where("rms_db IS NOT NULL").groupBy(program).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "rms_db"))), lambda x: _num(x["rms_db"], 3)), ", ").alias("__levels"))
    scenes = whole.where("order IS NOT NULL").join(levels_of, program)
    quoted = lambda *names: [x for n in names for x in (F.lit(f'"{n}": '), json_quote(F.col(n)))]
    producer = F.concat(F.lit('  "producer": {'), *quoted("tool"), F.lit(", "), *quoted("version"), F.lit(", "), *quoted("export"), F.lit("},"))
    stated = F.concat(F.lit('  "program": {"sampleRate": '), F.col("rate").cast("string"), F.lit(', "start": '), _num(F.col("start")), F.lit(', "end": '), _num(F.col("end")), F.lit(', "sliceSec": '), _num(F.col("slice")), F.lit("},"))
    parts = [
        line(whole, 0, F.lit('{\n  "intent": 0,')),
        line(whole, 1, producer),
        line(whole, 2, stated),
        line(beds, 3, F.concat(F.lit('  "bed": {\n    "layout": '), json_quote(F.col("layout")), F.when(F.col("bed_lufs").isNotNull(), F.concat(F.lit(',\n    "expectLufs": '), _num(F.col("bed_lufs"), 3))).otherwise(""), F.lit(',\n    "roster": ['))),
        line(listed, 4, entry, F.col("idx")),
        line(beds, 5, F.lit("    ]\n  },")),
        line(whole.where("__objects"), 6, F.lit('  "objects": [')),
        line(placed, 7, F.concat(F.lit('    {\n      "id": '), F.col("id").cast("string"), F.lit(', "label": '), json_quote(F.col("label")), F.lit(', "track": '), F.col("track").cast("string"), F.lit(',\n      "trajectory": [')), F.col("id"), F.lit(-1e300)),
        line(met, 7, point, F.col("id"), F.col("t")),
        line(placed, 7, F.concat(F.lit("      ]"), levels, F.lit("\n    }"), _comma(F.col("__last"))), F.col("id"), F.lit(1e300)),
        line(whole.where("__objects"), 8, F.lit("  ],")),
        line(scenes, 9, F.concat(F.lit('  "scene": {"order": '), F.col("order").cast("string"), F.lit(', "norm": "SN3D", "expectRmsDb": ['), F.col("__levels"), F.lit("]},"))),
        line(whole, 10, F.lit(TOLERANCES + "\n}")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def write_intent_sidecars(programs: DataFrame, roster: DataFrame, objects: DataFrame, trajectory: DataFrame, scene: DataFrame, folder: str, program: str = "program") -> None:
    """One document a program, see intent_lines and write_documents."""
    write_documents(intent_lines(programs, roster, objects, trajectory, scene, program), folder, "name", ["part", "a", "b", "line"])


# ---- packages

#: Layouts of a package's beds, and how its channels are spelt where that differs; the highest order of its scenes.
PACKAGE_BEDS = ("stereo", "5.1", "7.1.4")
SPELT = {"Lsr": "Lrs", "Rsr": "Rrs", "Ltr": "Ltb", "Rtr": "Rtb"}
PACKAGE_ORDER = 4


def package_channel(label: Column) -> Column:
    """A bed label as packages spell it."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in SPELT.items() for x in pair])[label], label)


def package_order(asked: Column, channels: Column) -> Column:
    """The order of a scene: as asked, else the highest whose channels the track has; 0 where none fits."""
    fits = F.coalesce(*[F.when(channels >= (o + 1) ** 2, o) for o in range(7, 0, -1)], F.lit(0))
    return F.coalesce(asked, fits)


def package_refusals(packages: DataFrame, targets: DataFrame, voices: DataFrame, key: str = "package") -> DataFrame:
    """(key, code) of everything that stands against each package; one with none has no row.

    packages: (key, layout, bed, scene, objects, asked_order, scene_channels, codec, normalize), flags for what it has;
    targets: (key, format, video, preset); voices: (key, lang). The codec is null where none is asked for."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    order = package_order(F.col("asked_order"), F.col("scene_channels"))
    own = F.array(
        F.when(flag("objects"), "objects_not_supported"),
        F.when(~flag(F.col("layout").isin(*PACKAGE_BEDS)), "unknown_layout"),
        F.when(~flag("bed") & ~flag("scene"), "no_sources"),
        F.when(flag("scene") & ((order > PACKAGE_ORDER) | flag(F.col("asked_order") < 1)), "order_beyond_package"),
        F.when(flag("scene") & F.col("asked_order").isNull() & (order < 1), "not_a_scene_bus"),
        F.when(flag("normalize") & (F.col("codec") == "lpcm"), "normalize_with_lpcm"),
    )
    single = packages.select(key, F.explode(F.filter(own, lambda c: c.isNotNull())).alias("code"))
    youtube, archive = F.col("preset") == "youtube", F.col("preset") == "archive"
    codecs = packages.select(F.col(key).alias("__of"), "codec")
    met = targets.join(codecs, F.col(key) == F.col("__of"), "left")
    by_target = F.array(
        F.when(youtube & (F.col("format") != "mp4") | archive & (F.col("format") != "iamf"), "preset_target_mismatch"),
        F.when(youtube & (F.col("format") == "mp4") & (F.coalesce("video", F.lit("")) == ""), "youtube_needs_video"),
        F.when(archive & (F.col("format") == "iamf") & (F.col("codec") != "flac"), "archive_needs_flac"),
    )
    each = met.select(key, F.explode(F.filter(by_target, lambda c: c.isNotNull())).alias("code")).distinct()
    twice = voices.where("lang IS NOT NULL").groupBy(key, slug(F.lower("lang"), "lang").alias("__lang")).count().where("count > 1").select(key).distinct().withColumn("code", F.lit("duplicate_lang"))
    return single.union(each).union(twice)


def package_lines(packages: DataFrame, sources: DataFrame, voices: DataFrame, targets: DataFrame, head: str, key: str = "package") -> DataFrame:
    """(name, part, a, b, line): the lines of each package's manifest, the first one `head`.

    packages: (key, title, codec, normalize_to, binaural); sources: (key, idx, name, path, kind, layout), beds and scenes and
    voices alike; voices: (key, idx, lang, vo, label), vo the source's name; targets: (key, idx, format, out, video, preset).
    Nothing is gathered; a package of no voice has one presentation, else one for each language."""
    name = F.concat(F.col(key).cast("string"), F.lit(".yaml")).alias("name")

    def line(rows: DataFrame, part: int, text: Column, a: Column | None = None) -> DataFrame:
        return rows.select(name, F.lit(part).alias("part"), (F.lit(0) if a is None else a).cast("long").alias("a"), F.lit(0).alias("b"), text.alias("line"))

    idx = F.col("idx")
    spoken = voices.select(key).distinct().withColumn("__spoken", F.lit(True))
    whole = packages.join(spoken, key, "left").withColumn("__spoken", F.coalesce("__spoken", F.lit(False)))
    tag = F.concat(F.lit("  "), F.col("name"), F.lit(": { path: "), yaml_path(F.col("path")), F.lit(", kind: "), F.col("kind"), F.when(F.col("kind") == "bed", F.concat(F.lit(', layout: "'), F.coalesce("layout", F.lit("")), F.lit('"'))).otherwise(""), F.lit(" }"))
    vo = voices.select(F.col(key).alias("__vk"), F.col("vo").alias("__vo")).distinct()
    program = sources.join(vo, (F.col(key) == F.col("__vk")) & (F.col("name") == F.col("__vo")), "left_anti").join(packages.select(F.col(key).alias("__pk"), F.coalesce("binaural", F.lit(False)).alias("__hp")), F.col(key) == F.col("__pk"))
    row = F.concat(F.lit("      - { ref: "), F.col("name"), F.when(F.col("__hp"), ", headphones: binaural").otherwise(""), F.lit(" }"))
    language = F.concat(F.lit("      - { lang: "), F.col("lang"), F.lit(", vo: "), F.col("vo"), F.lit(", label: "), yaml_quote(F.coalesce("label", F.lit(""))), F.lit(" }"))
    said = whole.where("__spoken")
    only = whole.where("NOT __spoken")
    policy = whole.where("codec IS NOT NULL OR normalize_to IS NOT NULL")
    more = lambda c, label, quote: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f", {label}: "), quote(F.col(c)))).otherwise("")
    target = F.concat(F.lit("  - { format: "), F.col("format"), F.lit(", out: "), yaml_path(F.coalesce("out", F.lit(""))), more("video", "video", yaml_path), more("preset", "preset", lambda c: c), F.lit(" }"))
    parts = [
        line(whole, 0, F.concat(F.lit(head + "\ntitle: "), yaml_quote(F.coalesce("title", F.lit(""))), F.lit("\nsources:"))),
        line(sources, 1, tag, idx),
        line(whole, 2, F.lit("elements:")),
        line(sources, 3, F.concat(F.lit("  "), F.col("name"), F.lit(": { from: "), F.col("name"), F.lit(" }")), idx),
        line(whole, 4, F.lit("presentations:")),
        line(said, 5, F.lit('  - id: "main-{lang}"\n    languages:')),
        line(only, 5, F.concat(F.lit("  - id: main\n    annotations: { en-us: "), yaml_quote(F.coalesce("title", F.lit(""))), F.lit(" }"))),
        line(voices, 6, language, idx),
        line(whole, 7, F.lit("    elements:")),
        line(program, 8, row, idx),
        line(said, 9, F.lit('      - { ref: "{vo}" }')),
        line(policy, 10, F.lit("policy:")),
        line(policy.where("codec IS NOT NULL"), 11, F.concat(F.lit("  codec: { name: "), F.col("codec"), F.lit(" }"))),
        line(policy.where("normalize_to IS NOT NULL"), 12, F.concat(F.lit("  loudness: { mode: measure, normalize: "), fmt_num(F.col("normalize_to")), F.lit(" }"))),
        line(whole, 13, F.lit("targets:")),
        line(targets, 14, target, idx),
    ]
    out = parts[0]
    for rest in parts[1:]:
        out = out.union(rest)
    return out


def write_package_manifests(packages: DataFrame, sources: DataFrame, voices: DataFrame, targets: DataFrame, folder: str, head: str, key: str = "package") -> None:
    """One manifest a package, see package_lines and write_documents; packages that package_refusals names are the caller's to leave out."""
    write_documents(package_lines(packages, sources, voices, targets, head, key), folder, "name", ["part", "a", "line"])
