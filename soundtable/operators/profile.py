"""Delivery rules of object-audio files: one row for each thing that a file does wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundtable.sources.adm import attribute, elements, metadata_counts, occurrences

#: Fixed values of the profile: rate, sample width, channels, objects, the programme's id, and samples of later ramps.
RATE, BITS, CHANNELS, OBJECTS, PROGRAMME, RAMP = 48000, 24, 128, 118, "APR_1001", 250
#: Channel counts of beds that the profile knows.
BED_WIDTHS = (2, 3, 5, 6, 7, 8, 9, 10)
#: Beds of the common definitions by the last two digits of their id (AP_000100..), and whether the profile has them.
COMMON_BEDS = {
    "01": False, "02": True, "0a": True, "0b": False, "0c": True, "03": True, "0d": False, "0e": False, "0f": True, "04": False, "12": False,
    "13": False, "14": False, "16": True, "05": False, "10": False, "07": False, "15": False, "17": False, "08": False, "11": False, "09": False,
}
#: Layouts of beds, in order, and the rates, with which a master can carry its own metadata chunk.
BED_ORDERS = (
    "L,R", "L,R,C", "L,R,C,Ls,Rs", "L,R,C,LFE,Ls,Rs", "L,R,C,Lss,Rss,Lrs,Rrs", "L,R,C,LFE,Lss,Rss,Lrs,Rrs",
    "L,R,C,Lss,Rss,Lrs,Rrs,Lts,Rts", "L,R,C,LFE,Lss,Rss,Lrs,Rrs,Lts,Rts",
)
#: The labels that have a name there; the top fronts count as top sides.
BED_LABELS = ("L", "R", "C", "LFE", "Ls", "Rs", "Lss", "Rss", "Lrs", "Rrs", "Ltf", "Rtf")
MASTER_RATES = (48000, 96000)


def pack_uses(uids: DataFrame, key: str) -> DataFrame:
    """(key, pack_ref, type, used): how many tracks of a file use each well-formed pack."""
    shaped = F.col("pack_ref").startswith("AP_") & (F.length("pack_ref") >= 11)
    return uids.where(shaped).groupBy(key, "pack_ref").agg(F.count("*").alias("used")).withColumn("type", F.substring("pack_ref", 4, 4))


def _ramp_faults(axml: Column, rate: Column) -> Column:
    """Whether an object channel's first block says another interpolation length than 0, or a later one anything but the ramp."""
    formats = F.regexp_extract_all(axml, F.lit("(?s)<audioChannelFormat (.*?)</audioChannelFormat>"), F.lit(1))
    said = lambda block: F.get(attribute(block, "interpolationLength"), F.lit(0))
    number = lambda text: F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(-1.0))
    want = F.lit(float(RAMP)) / F.when(rate > 0, rate).otherwise(RATE)

    def faulty(channel: Column) -> Column:
        blocks = F.regexp_extract_all(channel, F.lit(r"(?s)<audioBlockFormat(.*?)(?:</audioBlockFormat>|\z)"), F.lit(1))
        first, later = F.slice(blocks, 1, 1), F.slice(blocks, 2, 1 << 30)
        wrong = F.exists(first, lambda b: said(b).isNotNull() & ~((number(said(b)) >= 0) & (number(said(b)) < 1e-9)))
        return wrong | F.exists(later, lambda b: said(b).isNull() | (number(said(b)) < 0) | (F.abs(number(said(b)) - want) > 1e-4))

    return F.exists(F.filter(formats, lambda c: c.contains('typeDefinition="Objects"')), faulty)


def profile_check(files: DataFrame, uids: DataFrame, key: str = "path") -> DataFrame:
    """(key, code, detail) of each violation of the profile; a conformant file has no row. See `profile_notes` for the rest.

    files: (key, is_adm, rate, bits, channels, axml); uids: (key, pack_ref), a row for each track. Rules that read one file
    are one pass over it; those on packs follow from one aggregation of the tracks. A file without track or metadata chunk
    is not_adm and judged no further. Null numbers count as 0, a null text as empty."""
    own = ["is_adm", "rate", "bits", "channels", "axml"]
    x = F.coalesce("axml", F.lit(""))
    adm = files.select(key, *own).where(F.coalesce("is_adm", F.lit(False))).withColumns({"axml": x, "rate": F.coalesce("rate", F.lit(0)), "bits": F.coalesce("bits", F.lit(0)), "channels": F.coalesce("channels", F.lit(0))})
    packs = pack_uses(uids, key)
    by_type = lambda t: F.count_if(F.col("type") == t)
    common = F.substring("pack_ref", 10, 2)
    named = (F.length("pack_ref") == 11) & F.col("pack_ref").startswith("AP_000100") & common.isin(*COMMON_BEDS)
    wrong = F.when(named, ~common.isin(*[k for k, ok in COMMON_BEDS.items() if ok])).otherwise(~F.col("used").isin(*BED_WIDTHS))
    bad_beds = F.array_sort(F.collect_list(F.when((F.col("type") == "0001") & wrong, F.col("pack_ref"))))
    census = packs.groupBy(key).agg(by_type("0001").alias("beds"), by_type("0002").alias("matrix"), by_type("0003").alias("object_packs"), by_type("0004").alias("hoa"), by_type("0005").alias("binaural"), bad_beds.alias("bad_beds"))
    counts = metadata_counts(adm, key).select(key, "objects", "coordinates", "has_beds", "has_objects", "divergence_blocks", "has_importance", "importance", F.lit(True).alias("told"))
    wide = adm.join(census, key, "left").join(counts, key, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    told, flag = F.coalesce("told", F.lit(False)), lambda c: F.coalesce(c, F.lit(False))
    has_objects, has_beds = flag("has_objects") | (n("object_packs") > 0), flag("has_beds") | (n("beds") > 0)
    n_objects = F.when(n("object_packs") > 0, F.col("object_packs")).when(told, F.col("objects") - has_beds.cast("int")).otherwise(0)
    widths, heights, depths = (elements(F.col("axml"), e) for e in ("width", "height", "depth"))
    ramps = F.col("axml").contains("interpolationLength")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    rules = [
        ("sample_rate", F.col("rate") != RATE, text("rate ", F.col("rate"))),
        ("bit_depth", F.col("bits") != BITS, text("bits ", F.col("bits"))),
        ("channel_cap", F.col("channels") > CHANNELS, text("channels ", F.col("channels"))),
        ("content_type", n("hoa") > 0, text("scene packs ", F.col("hoa"))),
        ("content_type", n("binaural") > 0, text("binaural packs ", F.col("binaural"))),
        ("content_type", n("matrix") > 0, text("matrix packs ", F.col("matrix"))),
        ("object_cap", n_objects > OBJECTS, text("objects ", n_objects)),
        ("coordinate", told & has_objects & (F.col("coordinates") != "cartesian"), F.lit("spherical")),
        ("divergence", told & (F.col("divergence_blocks") > 0), text("blocks ", F.col("divergence_blocks"))),
        ("importance", told & flag("has_importance") & F.exists("importance", lambda v: v != 0), F.lit("active")),
        ("programme_id", told & ~F.col("axml").contains(f'audioProgrammeID="{PROGRAMME}"'), F.lit("other")),
        ("programme_count", occurrences(F.col("axml"), "<audioProgramme ") > 1, text("programmes ", occurrences(F.col("axml"), "<audioProgramme "))),
        ("extent", told & ~((widths == heights) & (heights == depths)), F.lit("differs")),
        ("interpolation", told & has_objects & ~ramps, F.lit("missing")),
        ("interpolation_ramp", told & has_objects & ramps & _ramp_faults(F.col("axml"), F.col("rate")), F.lit("differs")),
    ]
    found = F.array(*[F.when(holds, F.struct(F.lit(code).alias("code"), detail.alias("detail"))) for code, holds, detail in rules])
    beds = F.transform(F.coalesce("bad_beds", F.array().cast("array<string>")), lambda p: F.struct(F.lit("bed_layout").alias("code"), p.alias("detail")))
    out = wide.select(key, F.inline(F.concat(F.filter(found, lambda v: v.isNotNull()), beds)))
    none = files.where(~F.coalesce("is_adm", F.lit(False))).select(key, F.lit("not_adm").alias("code"), F.lit("no chna and axml").alias("detail"))
    return out.union(none)


def ingest_advisory(files: DataFrame, chunks: DataFrame, key: str = "path") -> DataFrame:
    """(key) of files with objects in their metadata and no `dbmd` chunk (chunks: key, id): importers of the common path refuse them."""
    objects = files.where(F.coalesce("is_adm", F.lit(False)) & F.coalesce(F.col("axml").contains('typeDefinition="Objects"'), F.lit(False))).select(key)
    return objects.join(chunks.where("id = 'dbmd'").select(key).distinct(), key, "left_anti")


def bed_gate(beds: DataFrame, key: str, label: str, order: str, bits: str, rate: str) -> DataFrame:
    """(key, layout, refusal) of masters that want a metadata chunk: null, or the first of what stands against it.

    beds: a row for each bed channel with the master's bits and rate. Labels are joined in order; Ltf and Rtf count as the
    top sides. A label of no name there (null too) is unmapped. Sample widths that are not written (16, 24, 32 are) count
    as 24; a null rate is refused."""
    named = F.when(F.col(label) == "Ltf", "Lts").when(F.col(label) == "Rtf", "Rts").otherwise(F.col(label))
    known = F.coalesce(F.col(label).isin(*BED_LABELS), F.lit(False))
    whole = beds.groupBy(key).agg(F.max(bits).alias("bits"), F.max(rate).alias("rate"), F.count_if(~known).alias("unmapped"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), named.alias("label")))).alias("channels"))
    layout = F.array_join(F.transform("channels", lambda c: c["label"]), ",")
    refusal = F.when(F.coalesce(F.col("bits").isin(16, 32), F.lit(False)), "bit_depth").when(~F.coalesce(F.col("rate").isin(*MASTER_RATES), F.lit(False)), "sample_rate").when(F.col("unmapped") > 0, "unmapped_label").when(~layout.isin(*BED_ORDERS), "bed_layout")
    return whole.select(key, layout.alias("layout"), refusal.alias("refusal"))
