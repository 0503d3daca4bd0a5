"""What comes with a delivery: render statistics, placements, targets, key patches, interpolation ramps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Measure and the normalised keys that name it.
STAT_KEYS = {
    "lufs_integrated": ["LUFSI", "ILUFS"],
    "lufs_momentary_max": ["LUFSMMAX", "LUFSM"],
    "lufs_short_term_max": ["LUFSSMAX", "LUFSS"],
    "true_peak": ["TPEAK", "TRUEPEAK", "TP"],
    "sample_peak": ["PEAK"],
    "rms": ["RMS"],
    "loudness_range": ["LRA"],
}
#: Descriptors, azimuth (null: the source's own), elevation, spread, and whether LFE or diffuse.
PLACEMENTS = [
    (["front-center", "front-centre", "center", "centre", "front"], 0.0, 0.0, 0.0, False, False),
    (["front-left"], 30.0, 0.0, 0.0, False, False),
    (["front-right"], -30.0, 0.0, 0.0, False, False),
    (["wide"], None, 0.0, 45.0, False, False),
    (["side-left", "surround-left", "side", "surround"], 105.0, 0.0, 20.0, False, False),
    (["side-right", "surround-right"], -105.0, 0.0, 20.0, False, False),
    (["rear-left", "back-left", "rear", "back"], 135.0, 0.0, 20.0, False, False),
    (["rear-right", "back-right"], -135.0, 0.0, 20.0, False, False),
    (["overhead", "height"], None, 45.0, 20.0, False, False),
    (["top", "zenith", "voice-of-god"], 0.0, 90.0, 0.0, False, False),
    (["lfe", "sub", "subwoofer"], 0.0, 0.0, 0.0, True, False),
    (["diffuse", "ambient", "bed"], 0.0, 0.0, 90.0, False, True),
]


def parse_render_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, file_no, file and each measure of STAT_KEYS): a row for each FILE block of `KEY:VALUE;...` texts, from 1.

    Pairs before the first block do not count; of a measure's numeric values (infinities are) the last one holds. A text is
    cut inside its row, so nothing is sorted or exchanged.
    """
    name = lambda pair: F.upper(F.regexp_replace(F.substring_index(pair, ":", 1), "[^A-Za-z0-9]", ""))
    value = lambda pair: F.substr(pair, F.instr(pair, ":") + 1)
    pairs = df.select(key, F.filter(F.split(text, ";"), lambda p: F.instr(p, ":") > 0).alias("pairs"))
    named = pairs.select(key, F.transform("pairs", lambda p: F.struct(name(p).alias("name"), value(p).alias("value"))).alias("pairs"))
    starts = F.filter(F.transform("pairs", lambda p, i: F.when(p["name"] == "FILE", i + 1)), lambda i: i.isNotNull())
    begun = named.select(key, "pairs", F.concat(starts, F.array(F.size("pairs") + 1)).alias("starts"))
    cut = F.transform(F.slice("starts", F.lit(1), F.size("starts") - 1), lambda at, i: F.slice("pairs", at, F.get("starts", i + 1) - at))
    blocks = begun.select(key, F.posexplode(cut).alias("at", "block"))
    shape = r"(?i)^\s*([+-]?(?:inf(?:inity)?|[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"

    def last(names: list[str]) -> Column:
        told = F.filter("block", lambda p: p["name"].isin(*names))
        numbers = F.transform(told, lambda p: F.nullif(F.regexp_extract(p["value"], shape, 1), F.lit("")).cast("double"))
        known = F.filter(numbers, lambda v: v.isNotNull())
        return F.get(known, F.size(known) - 1)

    measures = [last(names).alias(measure) for measure, names in STAT_KEYS.items()]
    return blocks.select(key, (F.col("at") + 1).cast("long").alias("file_no"), F.get("block", F.lit(0))["value"].alias("file"), *measures)


def placement_table(spark: SparkSession) -> DataFrame:
    rows = [(name, *place) for names, *place in PLACEMENTS for name in names]
    return spark.createDataFrame(rows, "descriptor string, place_az double, place_el double, spread double, lfe boolean, diffuse boolean")


def placement_key(descriptor: Column) -> Column:
    return F.regexp_replace(F.lower(F.translate(descriptor, " _", "--")), "^-+|-+$", "")


def apply_placement(stems: DataFrame, descriptor: str = "descriptor", source_az: str = "source_az", az: str = "az", el: str = "el") -> DataFrame:
    """stems with az, el, spread, lfe, diffuse and `error` where a descriptor is unknown and no azimuth is given.

    Numbers that a stem brings itself win; wide and overhead placements keep the source's azimuth (null: front).
    """
    known = F.broadcast(placement_table(stems.sparkSession).withColumnRenamed("descriptor", "__descriptor"))
    wide = stems.withColumn("__key", placement_key(F.col(descriptor))).join(known, F.col("__key") == F.col("__descriptor"), "left")
    found = F.col("__descriptor").isNotNull()
    placed = F.when(found, F.coalesce("place_az", F.col(source_az), F.lit(0.0)))
    error = F.when(~found & F.col(az).isNull(), "unknown_descriptor")
    return wide.withColumns({az: F.coalesce(F.col(az), placed), el: F.coalesce(F.col(el), "place_el"), "error": error}).drop("__key", "__descriptor", "place_az", "place_el")


def resolve_targets(requests: DataFrame, tracks: DataFrame, project: str = "project") -> DataFrame:
    """requests (project, request, want) with `idx` (-1: master) and `error`: an index, an exact name (the lowest index wins), or "master".

    tracks: (project, idx, name). A target that an earlier request of the project has is a `duplicate_stem`.
    """
    number = F.expr("try_cast(want as int)")
    by_index = tracks.select(project, F.col("idx").alias("__number"), F.col("idx").alias("__at"))
    by_name = tracks.groupBy(project, F.col("name").alias("want")).agg(F.min("idx").alias("__named"))
    wide = requests.withColumn("__number", number).join(by_index, [project, "__number"], "left").join(by_name, [project, "want"], "left")
    idx = F.when(F.col("want") == "master", -1).when(F.col("__number").isNotNull(), F.col("__at")).otherwise(F.col("__named"))
    found = wide.withColumn("idx", idx).select(project, "request", "want", "idx")
    again = F.row_number().over(W.partitionBy(project, "idx").orderBy("request")) > 1
    return found.withColumn("error", F.when(F.col("idx").isNull(), "target_not_found").when(again, "duplicate_stem"))


def patch_keys(lines: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """(key, text, missing): the texts of chunk_lines with the first line of each patched key (key, name, value) at depth one replaced.

    A text that lacks one of its patches' names stays without a result: text is null, and `missing` lists the names in
    order. Indents are kept. Texts without patches are not among the rows.
    """
    bare = F.regexp_replace("line", r"^[ \t]+|[ \t\r]+$", "")
    plain = (F.col("depth") == 1) & (bare != "") & ~bare.startswith("<") & (bare != ">")
    named = lines.withColumn("name", F.when(plain, F.regexp_extract(bare, r"^[^ \t]+", 0)))
    first = named.where("name is not null").groupBy(key, "name").agg(F.min("line_no").alias("line_no"))
    hits = patches.join(first, [key, "name"], "left")
    missing = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("line_no").isNull(), F.col("name")))).alias("missing"))
    new = hits.where("line_no is not null").select(key, "line_no", F.rtrim(F.concat_ws(" ", "name", "value")).alias("__new"))
    indent = F.regexp_extract("line", r"^[ \t]*", 0)
    done = lines.join(new, [key, "line_no"], "left").withColumn("line", F.coalesce(F.concat(indent, "__new"), "line"))
    texts = done.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("all")).select(key, F.array_join("all.line", "\n").alias("text"))
    return texts.join(missing, key).select(key, F.when(F.size("missing") == 0, F.col("text")).alias("text"), "missing")


def check_patches(patches: DataFrame, key: str) -> DataFrame:
    """(key, name, error) of patches (key, name, value) that no text takes: a name that is empty or no bare word, a value of several
    lines, and a name that a text's patches have twice (once a name)."""
    bare = F.coalesce(F.col("name").rlike(r"^[^\s<>]+$"), F.lit(False))
    lines = F.coalesce(F.col("value").rlike(r"[\r\n]"), F.lit(False))
    single = patches.select(key, "name", F.explode(F.filter(F.array(F.when(~bare, "bad_key"), F.when(lines, "multi_line_value")), lambda e: e.isNotNull())).alias("error"))
    twice = patches.groupBy(key, "name").count().where("count > 1").select(key, "name", F.lit("duplicate_key").alias("error"))
    return single.union(twice)


def check_ramp(blocks: DataFrame, keys: list[str], order: list[str], rate: Column, length: str = "interpolation") -> DataFrame:
    """blocks with the ramp that the profile asks for, 0 on a channel's first block and 250 samples after, in seconds, and `ok`.

    A first block may leave it out; the tolerance is 0.0001 s.
    """
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1
    want = F.when(first, 0.0).otherwise(250.0 / rate)
    return blocks.withColumns({"ramp": want, "ok": F.coalesce(F.abs(F.col(length) - want) <= 1e-4, first)})


def validate_model(models: DataFrame, objects: DataFrame, blocks: DataFrame, max_objects: int = 118, max_channels: int = 128) -> DataFrame:
    """(model, code, n): violations of the delivery profile by a model of bed and objects; a conformant model has no row.

    models: (model, bed, bed_channels, rate), a null or empty bed has no channels; objects: (model, cartesian,
    importance), null importance: none; blocks: (model, divergence, width, height, depth), nulls count as none. Objects
    and blocks are counted by model before they are joined."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    kept = objects.groupBy("model").agg(F.count("*").alias("objects"), count(~F.coalesce("cartesian", F.lit(False))).alias("coordinate"), count(F.col("importance") >= 0).alias("importance"))
    w, h, d = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("width", "height", "depth"))
    uneven = F.greatest(w, h, d) > 0
    uneven = uneven & ~((w == h) & (h == d) & (w <= 1))
    sizes = blocks.groupBy("model").agg(count(F.col("divergence")).alias("divergence"), count(uneven).alias("extent"))
    all_of = models.select("model", F.coalesce("bed", F.lit("")).alias("bed"), F.coalesce("bed_channels", F.lit(0)).alias("bed_channels"), "rate")
    all_of = all_of.join(kept, "model", "left").join(sizes, "model", "left").fillna(0, ["objects", "coordinate", "importance", "divergence", "extent"])
    one = lambda c: F.coalesce(c, F.lit(True)).cast("long")
    found = {
        "bed_layout": one(~F.col("bed").isin("", "5.1", "7.1", "7.1.2")),
        "sample_rate": one(F.col("rate") != 48000),
        "object_cap": one(F.col("objects") > max_objects),
        "channel_cap": one(F.col("bed_channels") + F.col("objects") > max_channels),
        "empty": one((F.col("bed_channels") == 0) & (F.col("objects") == 0)),
    } | {c: F.col(c) for c in ("coordinate", "importance", "divergence", "extent")}
    rows = F.array(*[F.struct(F.lit(code).alias("code"), n.cast("long").alias("n")) for code, n in found.items()])
    return all_of.select("model", F.inline(F.filter(rows, lambda r: r["n"] > 0)))


def normalize_model(models: DataFrame, objects: DataFrame, blocks: DataFrame, max_objects: int = 118, max_channels: int = 128) -> tuple[DataFrame, DataFrame, DataFrame]:
    """models with `error`, the first rule that no change can mend (null: none), objects and blocks bent to the profile, each with `warnings`.

    Tables as in validate_model. Objects become cartesian and lose their importance; blocks lose their divergence, and
    their sizes become the largest of the three, at most 1. `warnings` names what changed. Rows of a model with an error,
    or of none, stay as they are."""
    kept = objects.groupBy("model").agg(F.count("*").alias("__objects"))
    count, channels = F.coalesce("__objects", F.lit(0)), F.coalesce("bed_channels", F.lit(0))
    rules = [(~F.coalesce("bed", F.lit("")).isin("", "5.1", "7.1", "7.1.2"), "bed_not_profile_conformant"), (~F.col("rate").eqNullSafe(F.lit(48000)), "sample_rate_not_48k"), (count > max_objects, "too_many_objects"), (channels + count > max_channels, "too_many_channels")]
    judged = models.join(kept, "model", "left").withColumn("error", F.coalesce(*[F.when(bad, name) for bad, name in rules])).drop("__objects")
    fit = judged.where("error is null").select("model", F.lit(True).alias("__fit"))
    mended = lambda df: df.join(fit, "model", "left").withColumn("__fit", F.coalesce("__fit", F.lit(False)))
    said = lambda *found: F.array_compact(F.array(*[F.when(F.col("__fit") & change, name) for change, name in found]))
    polar, important = ~F.coalesce("cartesian", F.lit(False)), F.coalesce(F.col("importance") >= 0, F.lit(False))
    new_objects = mended(objects).withColumn("warnings", said((polar, "coordinate"), (important, "importance")))
    new_objects = new_objects.withColumns({"cartesian": F.when(F.col("__fit"), True).otherwise(F.col("cartesian")), "importance": F.when(~F.col("__fit"), F.col("importance"))})
    w, h, d = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("width", "height", "depth"))
    size, split = F.greatest(w, h, d), F.coalesce("divergence", F.lit(False))
    uneven = (size > 0) & ~((w == h) & (h == d) & (w <= 1))
    new_blocks = mended(blocks).withColumns({"warnings": said((split, "divergence"), (uneven, "extent")), "__size": F.least(size, F.lit(1.0)), "__sized": F.col("__fit") & (size > 0)})
    new_blocks = new_blocks.withColumns({"divergence": F.when(F.col("__fit"), False).otherwise(F.col("divergence"))} | {c: F.when(F.col("__sized"), F.col("__size")).otherwise(F.col(c)) for c in ("width", "height", "depth")})
    return judged, new_objects.drop("__fit"), new_blocks.drop("__fit", "__size", "__sized")


def match_stem_files(stems: DataFrame, files: DataFrame, project: str = "project") -> DataFrame:
    """stems (project, idx, label) with the `path` of the file (project, file_no, path) each was rendered to, and `matched_by`.

    A project with as many files as stems matches them in order; in others a stem has its first file whose path contains
    its label, in any case. Without one, or with an empty label, path is null. idx and file_no are unique in a project."""
    def ranked(df: DataFrame, order: str) -> DataFrame:
        w = W.partitionBy(project)
        return df.withColumns({"__rank": F.row_number().over(w.orderBy(order)), "__count": F.count("*").over(w)})

    left = ranked(stems, "idx")
    right = ranked(files, "file_no").select(F.col(project).alias("__project"), "file_no", "path", F.col("__rank").alias("__file"), F.col("__count").alias("__files"))
    even = F.col("__count") == F.col("__files")
    named = (F.col("label") != "") & F.contains(F.lower("path"), F.lower("label"))
    on = (F.col(project) == F.col("__project")) & ((even & (F.col("__rank") == F.col("__file"))) | (~even & named))
    met = left.join(right, on, "left").groupBy(project, "idx").agg(F.first("label").alias("label"), F.min(F.struct("file_no", "path", even.alias("even"))).alias("best"))
    by = F.when(F.col("best.path").isNotNull(), F.when(F.col("best.even"), "order").otherwise("name"))
    return met.select(project, "idx", "label", F.col("best.path").alias("path"), by.alias("matched_by"))
