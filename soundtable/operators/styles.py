"""Plug-in look-ups: which of the installed ones a mixing style takes, and which spatial suites cover which role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The steps of each style in order: role, stock plug-in, preferred ones.
STYLES = {
    "pop-bright": [("eq", "ReaEQ", ["FabFilter Pro-Q", "Pro-Q 3"]), ("comp", "ReaComp", ["FabFilter Pro-C", "Waves SSL Comp"]), ("limiter", "ReaLimit", ["FabFilter Pro-L", "Pro-L 2"])],
    "cinema-warm": [("eq", "ReaEQ", ["FabFilter Pro-Q"]), ("multiband", "ReaXcomp", ["FabFilter Pro-MB", "Waves C6"]), ("limiter", "ReaLimit", ["FabFilter Pro-L"])],
    "dialog-clear": [("eq", "ReaEQ", ["FabFilter Pro-Q"]), ("comp", "ReaComp", ["FabFilter Pro-C", "Waves Renaissance Vox"]), ("limiter", "ReaLimit", ["FabFilter Pro-L"])],
    "immersive-master-atmos": [("eq", "ReaEQ", ["FabFilter Pro-Q"]), ("multiband", "ReaXcomp", ["FabFilter Pro-MB"]), ("limiter", "ReaLimit", ["FabFilter Pro-L"])],
    "warm-master": [("eq", "ReaEQ", ["FabFilter Pro-Q"]), ("comp", "ReaComp", ["FabFilter Pro-C"]), ("limiter", "ReaLimit", ["FabFilter Pro-L"])],
    "bright-master": [("eq", "ReaEQ", ["FabFilter Pro-Q"]), ("limiter", "ReaLimit", ["FabFilter Pro-L"])],
}
#: Styles for beds, whose limiter on more than two channels is the linked one, and what that is called here.
IMMERSIVE, LINKED_LIMITER = ("immersive-master-atmos",), "multichannel true-peak limiter"
#: Suites in order of priority with what names them, and in which order names are tried.
SUITES = ("IEM", "SPARTA", "ATK", "ambiX", "BlueRipple")
SUITE_WORDS = (("IEM", ("(iem)",)), ("SPARTA", ("sparta",)), ("ambiX", ("ambix",)), ("BlueRipple", ("o3a", "blue ripple", "toa ")), ("ATK", ("atk ",)))
ROLE_WORDS = (("binaural", ("binaural",)), ("rotator", ("rotat",)), ("decoder", ("decod", "ambidec", "allrad")), ("encoder", ("encod", "ambienc")))
#: Names that are preferred for a role, best first.
PREFERRED = {
    "encoder": ("stereoencoder", "multiencoder", "ambienc", "ambix_encoder", "foa encode"),
    "decoder": ("simpledecoder", "allradecoder", "ambidec", "ambix_decoder", "foa decode"),
    "rotator": ("scenerotator", "rotator", "ambix_rotator", "foa transform rotate"),
    "binaural": ("binauraldecoder", "binauralis", "binaural", "ambix_binaural"),
}


def _holds(low: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | low.contains(word)
    return out


def resolve_style(requests: DataFrame, installed: DataFrame, project: str, name: str = "name", styles: dict | None = None) -> DataFrame:
    """(project, style, step, role, fx, detected, linked, ceiling_db) for each step of each asked style (project, style, ceiling_db, channels).

    The first preferred plug-in wins all of whose words are in one installed name (project, name), in any case; else the
    stock one. A limiter has the ceiling of the request, and in an immersive style on more than two channels it is the
    linked one. Which preferred ones a name stands for is decided in its row, against the fixed palette; no names are
    joined. A style that is not known, or null, has no step; a request may repeat."""
    palette = styles or STYLES
    spark = requests.sparkSession
    chain = [(s, i, role, stock, list(prefs)) for s, steps in palette.items() for i, (role, stock, prefs) in enumerate(steps)]
    wanted = sorted({p for *_, prefs in chain for p in prefs})
    low = F.lower(F.col(f"`{name}`"))
    stands = F.array(*[F.when(F.forall(F.array(*[F.lit(w) for w in p.lower().split()]), lambda w: low.contains(w)), F.lit(p)) for p in wanted])
    have = installed.select(F.col(project).alias("__of"), F.explode(F.filter(stands, lambda x: x.isNotNull())).alias("__pref")).distinct()
    steps = spark.createDataFrame(chain, "style string, step int, role string, stock string, prefs array<string>")  # the palette: fixed and small
    asked = requests.select(F.col(project).alias("__project"), "style", "ceiling_db", "channels").withColumn("__request", F.monotonically_increasing_id())
    met = asked.join(F.broadcast(steps), "style")
    tried = met.select("__request", "step", "__project", F.posexplode("prefs").alias("__at", "__name")).join(have, F.col("__project").eqNullSafe(F.col("__of")) & (F.col("__name") == F.col("__pref")))
    best = tried.groupBy(F.col("__request").alias("__r"), F.col("step").alias("__s")).agg(F.min(F.struct("__at", "__name")).alias("best"))
    out = met.join(best, (F.col("__request") == F.col("__r")) & (F.col("step") == F.col("__s")), "left")
    limiter = F.col("role") == "limiter"
    linked = F.coalesce(limiter & F.col("style").isin(*IMMERSIVE) & (F.col("channels") > 2), F.lit(False))
    fx = F.when(linked, LINKED_LIMITER).otherwise(F.coalesce("best.__name", "stock"))
    return out.select(F.col("__project").alias(project), "style", "step", "role", fx.alias("fx"), (~linked & F.col("best").isNotNull()).alias("detected"), linked.alias("linked"), F.when(limiter, F.col("ceiling_db")).alias("ceiling_db"))


def classify_plugin(name: Column) -> tuple[Column, Column]:
    """Suite (null: none of them) and role of a plug-in by words in its name, in any case; the first that fits decides."""
    low = F.lower(name)
    suite = F.coalesce(*[F.when(_holds(low, words), F.lit(s)) for s, words in SUITE_WORDS])
    role = F.coalesce(*[F.when(_holds(low, words), F.lit(r)) for r, words in ROLE_WORDS], F.lit("other"))
    return suite, role


def find_suites(installed: DataFrame, project: str, name: str = "name", order: str = "idx") -> DataFrame:
    """(project, role, suite, name, plugins): the plug-in that each project takes for encoding, decoding, turning and binaural.

    Preferred names win over others, suites by priority, then the order of the preferred names, then that of installation
    (column `order`, ties by name). plugins: how many of the suites' plug-ins have the role. A role that none has has no row."""
    suite, role = classify_plugin(F.col(f"`{name}`"))
    known = installed.select(F.col(project), F.col(f"`{name}`").alias("__name"), F.col(order).alias("__order"), suite.alias("suite"), role.alias("role")).where("suite IS NOT NULL AND role <> 'other'")
    low, seeds = F.lower("__name"), []
    for r, names in PREFERRED.items():
        seeds.append(F.when(F.col("role") == r, F.coalesce(*[F.when(low.contains(n), i) for i, n in enumerate(names)])))
    seed = F.coalesce(*seeds)
    place = F.array_position(F.array(*map(F.lit, SUITES)), F.col("suite"))
    best = F.min_by(F.struct("suite", "__name"), F.struct(seed.isNull().alias("plain"), place.alias("suite"), F.coalesce(seed, F.lit(0)).alias("seed"), "__order", "__name"))
    out = known.groupBy(project, "role").agg(best.alias("best"), F.count("*").alias("plugins"))
    return out.select(project, "role", "best.suite", F.col("best.__name").alias("name"), "plugins")
