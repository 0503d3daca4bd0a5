"""Sessions: routing, edits, names, action logs, text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Phrases of actions that open a dialog or end the session.
DENIED_PHRASES = ("close project", "close all project", "close all, no save", "save project as", "save all projects", "save live output", "open project", "recent project", "render project to disk", "consolidate/export", "export project", "insert media file", "options: preferences")
#: Fixed value: the command that closes the project.
DENIED_IDS = (40860,)


def send_occupancy(sends: DataFrame, bus: str, expected: DataFrame | None = None) -> DataFrame:
    """(bus, channel, uses, issue) for each channel up to the highest in use: collision, gap or null.

    A send takes one channel at least; sends without a first channel are silent and take none. `expected` (bus, channels)
    names buses and how many channels they should have: channels up to that are listed too, as gaps where nothing uses them.
    """
    wide = F.greatest(F.col("width"), F.lit(1))
    each = sends.where("dst >= 0").select(bus, F.explode(F.sequence(F.col("dst"), F.col("dst") + wide - 1)).alias("channel"))
    used = each.groupBy(bus, "channel").agg(F.count("*").alias("uses"))
    top = used.groupBy(bus).agg(F.max("channel").alias("top"))
    if expected is not None:
        more = expected.groupBy(bus).agg((F.max("channels") - 1).cast("int").alias("top")).where("top >= 0")
        top = top.unionByName(more).groupBy(bus).agg(F.max("top").alias("top"))
    every = top.select(bus, F.explode(F.sequence(F.lit(0), F.col("top"))).alias("channel"))
    out = every.join(used, [bus, "channel"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return out.withColumn("issue", F.when(F.col("uses") > 1, "collision").when(F.col("uses") == 0, "gap"))


def routing_graph(tracks: DataFrame, sends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and edges of kind send (to a track) or hwout (to -1)."""
    edges = sends.join(tracks.select(F.col("guid").alias("dest_guid"), F.col("idx").alias("to")), "dest_guid", "left")
    kind = F.when(F.col("hardware"), "hwout").otherwise("send")
    return tracks, edges.select(F.col("source").alias("from"), F.when(F.col("hardware"), -1).otherwise(F.coalesce("to", F.lit(-1))).alias("to"), kind.alias("kind"), "vol_db", "muted")


def edit_state(edits: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, state): what an edit log says of each key, one aggregation that can go on over any later edits (a stream's too).

    edits: (key, op set or delete, field, value string, seq, unique within a key). fields: how each field reads the string
    `value` it is given, clamps included; a value that does not read (null) is no edit. state has the last operation, the
    last deletion, and of each field the last value with its seq."""
    op, seq = F.col("op"), F.col("seq")
    last = [F.max_by(F.struct(seq.alias("seq"), read.alias("value")), F.when((op == "set") & (F.col("field") == f) & read.isNotNull(), seq)).alias(f) for f, read in fields.items()]
    parts = edits.groupBy(key).agg(F.max_by("op", "seq").alias("__op"), F.max(F.when(op == "delete", seq)).alias("__deleted"), *[c.alias(f"__f{i}") for i, c in enumerate(last)])
    values = F.struct(*[F.col(f"__f{i}").alias(f) for i, f in enumerate(fields)])
    return parts.select(key, F.struct(F.col("__op").alias("op"), F.col("__deleted").alias("deleted"), values.alias("fields")).alias("state"))


def with_edits(table: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """table after the edits that `states` (key, state; see edit_state) sum up: a key whose last operation is delete goes,
    one that the table lacks is added, with nulls where no edit says anything. What was set before a deletion is lost."""
    told = unused("__state", table)
    state, out = F.col(told), []
    base = table.join(states.select(key, F.col("state").alias(told)), key, "full").where(F.coalesce(state["op"] != "delete", F.lit(True)))
    edited = states.schema["state"].dataType["fields"].dataType.names
    for c in table.columns:
        kept = F.when(state["deleted"].isNull(), F.col(f"`{c}`"))
        one = state["fields"][c] if c in edited else None
        fresh = None if one is None else F.when(state["deleted"].isNull() | (one["seq"] > state["deleted"]), one["value"])
        out.append(F.col(f"`{c}`") if one is None else F.coalesce(fresh, kept).alias(c))
    return base.select(*out)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def apply_edits(table: DataFrame, edits: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """The last edit of each field wins, see edit_state and with_edits."""
    return with_edits(table, edit_state(edits, key, fields), key)


def split_items(items: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """Items (key, pos, len) cut at an absolute time (key, cut) strictly inside; others stay, `ok` false."""
    wide = items.join(cuts, key, "left")
    inside = (F.col("cut") > F.col("pos")) & (F.col("cut") < F.col("pos") + F.col("len"))
    part = lambda p, n: F.struct(p.alias("pos"), n.alias("len"))
    two = F.array(part(F.col("pos"), F.col("cut") - F.col("pos")), part(F.col("cut"), F.col("pos") + F.col("len") - F.col("cut")))
    one = F.array(part(F.col("pos"), F.col("len")))
    ok = F.coalesce(inside, F.lit(False))
    return wide.select(key, ok.alias("ok"), F.inline(F.when(ok, two).otherwise(one)))


def audit_actions(actions: DataFrame, name: str, ident: str, denied_ids=DENIED_IDS, phrases=DENIED_PHRASES, allowed_ids=(), allowed_phrases=()) -> DataFrame:
    """actions with `allowed` and `reason`: denied by command or by a phrase in its name, in any case.

    With any `allowed_ids` or `allowed_phrases` only what they name is allowed, even if it would be denied otherwise."""
    low = F.lower(F.col(name))
    if allowed_ids or allowed_phrases:
        listed = F.lit(False)
        for test in [F.col(ident).isin(*allowed_ids)] * bool(allowed_ids) + [low.contains(p.lower()) for p in allowed_phrases]:
            listed = listed | F.coalesce(test, F.lit(False))
        return actions.withColumns({"allowed": listed, "reason": F.when(~listed, "not_listed")})
    hit = F.coalesce(*[F.when(low.contains(p), p) for p in phrases])
    by_id = F.col(ident).isin(*denied_ids)
    return actions.withColumns({"allowed": ~(by_id | hit.isNotNull()), "reason": F.when(by_id, "command").otherwise(hit)})


def chunk_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, depth, line): lines of a state text with their block depth, counted after a line that opens and before one that closes.

    Lines may end in CR LF; blanks and tabs around a line do not count for its depth."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.when(F.endswith("line", F.lit("\r")), F.substr("line", F.lit(1), F.length("line") - 1)).otherwise(F.col("line")))
    bare = F.btrim("line", F.lit(" \t\r"))
    change = F.when(bare.startswith("<"), 1).when(bare == ">", -1).otherwise(0)
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("depth", F.sum(change).over(w))


def validate_chunks(lines: DataFrame, key: str) -> DataFrame:
    """(key, open, valid): a track's text begins with its block, the depth never falls below zero and ends there; `open` blocks stay."""
    bare = F.btrim("line", F.lit(" \t\r"))
    first = F.min(F.when(bare != "", F.struct("line_no", bare.startswith("<TRACK").alias("begins"))))
    out = lines.groupBy(key).agg(F.min("depth").alias("least"), F.max_by("depth", "line_no").alias("open"), first.alias("first"))
    valid = F.coalesce(F.col("first.begins"), F.lit(False)) & (F.col("least") >= 0) & (F.col("open") == 0)
    return out.select(key, "open", valid.alias("valid"))


def implode_to_takes(items: DataFrame, keys: list[str], order: list[str], item: str) -> DataFrame:
    """Selected items as takes of the first of them: `take` from 0 in order, `into` the item that they join."""
    w = W.partitionBy(*keys).orderBy(*order)
    return items.withColumns({"take": F.row_number().over(w) - 1, "into": F.first(item).over(w)})


#: Lengths of the pieces by which names are looked up; a name that is asked for has pieces of the longest that fits.
PIECES = (1, 2, 3, 4, 8, 16, 32)


def _grams(low: Column, n: Column) -> Column:
    """The different substrings of n characters."""
    last = F.length(low) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(low, i, n)))).otherwise(F.array().cast("array<string>"))


def param_candidates(requests: DataFrame, params: DataFrame, asked: str, name: str, idx: str = "idx") -> DataFrame:
    """(asked, tier, idx, name): of each asked name the parameters of the first tier with a hit: equal, equal in any case, substring.

    Equal names meet by their text. What has none is looked for in an inverted index of pieces, only where its rarest piece
    is; pieces are long (see PIECES), so work grows with the hits, not with names times parameters. Tables are joined by
    merges: pieces are many times what the planner reckons, and no side is sent to the driver. Null and empty names match
    nothing."""
    ask = requests.select(F.col(f"`{asked}`").alias("asked")).where(F.length("asked") > 0).distinct().withColumn("low", F.lower("asked"))
    known = params.select(F.col(f"`{name}`").alias("name"), F.col(f"`{idx}`").alias("idx")).where(F.length("name") > 0)
    met = lambda left, on, how="inner": left.join(known.hint("merge"), on, how)
    equal, cased = F.col("asked") == F.col("name"), F.col("low") == F.lower("name")
    other = met(ask, equal, "left_anti")
    rest = met(other, cased, "left_anti").withColumn("n", F.greatest(*[F.when(F.length("low") >= n, n) for n in PIECES]))
    # A row that holds the lengths in use (at most all of PIECES).
    lengths = F.broadcast(rest.agg(F.collect_set("n").alias("lengths")))
    cut = F.flatten(F.transform("lengths", lambda n: _grams(F.lower("name"), n)))
    pieces = known.repartition("name", "idx").crossJoin(lengths).select("name", "idx", F.explode(cut).alias("piece"))
    counts = pieces.groupBy("piece").agg(F.count("*").alias("hits"))
    own = rest.select("asked", "low", F.explode(_grams(F.col("low"), F.col("n"))).alias("own"))
    each = own.join(counts.hint("merge"), F.col("own") == F.col("piece"), "left")
    rarest = each.groupBy("asked", "low").agg(F.min(F.struct(F.coalesce("hits", F.lit(0)).alias("hits"), "own")).alias("best")).where("best.hits > 0").select("asked", "low", F.col("best.own").alias("own"))
    within = rarest.join(pieces.hint("merge"), (F.col("own") == F.col("piece")) & F.contains(F.lower("name"), "low"))
    tier = lambda rows, t: rows.select("asked", F.lit(t).alias("tier"), "idx", "name")
    return tier(met(ask, equal), 1).union(tier(met(other, cased), 2)).union(tier(within, 3))


def resolve_params(requests: DataFrame, params: DataFrame, asked: str, name: str) -> DataFrame:
    """(asked, tier, candidates, idx) for each different asked name: how many param_candidates it has, and the index if that is one.

    Several are ambiguous and give no index; without any there is no tier. Null is a name that matches nothing."""
    found = param_candidates(requests, params, asked, name).groupBy("asked").agg(F.min("tier").alias("tier"), F.count("*").alias("n"), F.min("idx").alias("least"))
    names = requests.select(F.col(f"`{asked}`").alias("name_asked")).distinct()
    out = names.join(found, F.col("name_asked") == F.col("asked"), "left")
    return out.select(F.col("name_asked").alias(asked), "tier", F.coalesce("n", F.lit(0)).cast("long").alias("candidates"), F.when(F.col("n") == 1, F.col("least")).alias("idx"))


def pack_census(refs: DataFrame, key: str, ref: str) -> DataFrame:
    """Of the distinct pack references of a file: how many of each type (01 to 05), of others, and of common definitions.
    A reference that is short or lacks its prefix counts as other, row by row."""
    shaped = F.col(ref).startswith("AP_") & (F.length(ref) >= 11)
    odd = refs.groupBy(key).agg(F.count_if(~F.coalesce(shaped, F.lit(False))).alias("odd"))
    good = refs.where(shaped).select(key, F.substring(ref, 7, 1).alias("type"), F.conv(F.substring(ref, 8, 4), 16, 10).cast("long").alias("n"), ref).distinct()
    kinds = [F.count_if(F.col("type") == str(t)).alias(f"type{t}") for t in range(1, 6)]
    counted = good.groupBy(key).agg(*kinds, F.count_if(~F.col("type").isin(*map(str, range(1, 6)))).alias("rest"), F.count_if(F.col("n") <= 0x0FFF).alias("common"))
    return odd.join(counted, key, "left").fillna(0).withColumn("other", F.col("odd") + F.col("rest")).drop("odd", "rest")


def identity_powers(samples: DataFrame, keys: list[str], plan: DataFrame, rate: float) -> DataFrame:
    """(keys, channel, slot, power) of each tone of a plan (slot, hz; small and fixed) in each channel, by two sums that can be added over any frames."""
    met = samples.crossJoin(F.broadcast(plan))
    phase = F.col("frame") * F.col("hz") * 2 * 3.141592653589793 / rate
    sums = met.groupBy(*keys, "channel", "slot").agg(F.sum(F.col("x") * F.cos(phase)).alias("c"), F.sum(F.col("x") * F.sin(phase)).alias("s"))
    return sums.select(*keys, "channel", "slot", (F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("power"))
