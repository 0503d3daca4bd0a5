"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into parts so that two fingerprints within the threshold differ by at most one bit in some part.
Each part is covered by a direct sum of Hamming codes and free bits: every word has exactly one anchor (code word) within
the covering radius. A fingerprint is at home at that anchor, and visits all anchors within covering radius plus one;
the anchor at which x is at home is visited by every y that differs from it by one bit. So each linked pair meets at
some anchor, where fingerprints are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundtable.llm.common import broadcast_within, discard, remove_rows, sliced, text_key, write_table
from soundtable.llm.components import connected_components

SEED = 42
#: Fingerprints at home at an anchor above which its pairs are found by midpoints instead.
HOT_HOMES = 32

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BLOCK_BYTES = 1 << 20


def word_blocks(text: str, size: int = _BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, a block of about `size` bytes at a time."""
    data = text.encode().translate(_LOWER)
    start = 0
    while start < len(data):
        cut = _BLANK.search(data, start + size)
        end = cut.start() if cut else len(data)
        yield _WORD.findall(data, start, end)
        start = end


def _hashes(block: list[bytes], k: int) -> np.ndarray:
    """Hashes of the k-word shingles of a list of at least k words."""
    joined, hashed = b" ".join(block), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in block]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([hashed(joined[i:j], SEED) for i, j in zip(starts[: len(block) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: str | None, k: int = 3, distinct: bool = False) -> int:
    """64 bits, each set where more than half of the shingles' hashes have it. distinct: each shingle counts once. No word: 0."""
    ones, count, carry, seen = np.zeros(64, np.int64), 0, [], [np.zeros(0, np.uint64)]
    for block in word_blocks(text or ""):
        block = carry + block
        if len(block) >= k:
            found = np.array([xxhash.xxh64_intdigest(w, SEED) for w in set(block)], np.uint64) if distinct and k == 1 else _hashes(block, k)
            if distinct:
                seen.append(np.unique(found))
            else:
                ones, count = ones + _ones(found), count + len(found)
            block = block[len(block) - k + 1 :] if k > 1 else []
        carry = block
    if distinct and len(seen) > 1:
        found = np.unique(np.concatenate(seen))
        ones, count = _ones(found), len(found)
    if not count and carry:
        ones, count = _ones(_hashes(carry, len(carry))), 1
    return int.from_bytes(np.packbits(ones * 2 > count, bitorder="little").tobytes(), "little", signed=True)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(df: DataFrame, keep: list[Column], text: Column, k: int = 3, distinct: bool = False) -> DataFrame:
    """The `keep` columns and `fp` (long), one row for each row of df.

    Null and empty texts have fingerprint zero; rows may repeat; other columns are not read; `keep` must not name a
    column "fp" or "__text". A text is split into words a block at a time. An empty table gives an empty result.
    """
    narrow = df.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    names = narrow.columns[:-1]

    def run(batches):
        for batch in sliced(batches, len(names)):
            found = [fingerprint(x.as_py(), k, distinct) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.int64())], names=[*names, "fp"])

    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:-1], T.StructField("fp", T.LongType(), False)]))


# ---- the code

#: For a part of so many bits: lengths of its Hamming blocks (2^r - 1); what is left over are free bits.
CODES = {32: (31,)}


def _flips(width: int) -> list[int]:
    """By syndrome: the bits to turn to get to the code word within the covering radius. A code of several blocks has mixed syndromes."""
    out, offset = [0], 0
    for length in CODES[width]:
        out = [m | (1 << (offset + s - 1) if s else 0) for s in range(length + 1) for m in out]
        offset += length
    return out


def _bit_syndromes(width: int) -> list[int]:
    """What turning each bit of a part adds (XOR) to the syndrome."""
    out, shift = [], 0
    for length in CODES[width]:
        out += [(i + 1) << shift for i in range(length)]
        shift += length.bit_length()
    return out + [0] * (width - len(out))


def _syndrome(value: Column, width: int) -> Column:
    bits, out = _bit_syndromes(width), None
    for j in range(max(bits).bit_length()):
        mask = sum(1 << i for i, s in enumerate(bits) if s >> j & 1)
        bit = F.shiftleft(F.bit_count(value.bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(1)), j)
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def _parts(width: int) -> list[Column]:
    mask = F.lit((1 << width) - 1).cast("long")
    return [F.shiftrightunsigned("fp", width * p).bitwiseAND(mask) for p in range(64 // width)]


def _to_anchors(fps: DataFrame, width: int, turns: list[list[int]]) -> DataFrame:
    """fps with (part, anchor): each part's value with the bits turned that its syndrome has in `turns`, a row for each."""
    if {"__value", "__syndrome", "__turn"} & set(fps.columns):
        raise ValueError("column names in use")
    each = F.array(*[F.struct(F.lit(p).alias("part"), v.alias("__value"), _syndrome(v, width).alias("__syndrome")) for p, v in enumerate(_parts(width))])
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in turns])
    turned = fps.select("*", F.inline(each)).select("*", F.explode(F.get(table, F.col("__syndrome"))).alias("__turn"))
    return turned.withColumn("anchor", F.col("__value").bitwiseXOR(F.col("__turn"))).drop("__value", "__syndrome", "__turn")


def homes(fps: DataFrame, width: int) -> DataFrame:
    """fps with (part, anchor): where each fingerprint is at home, a row for each part."""
    return _to_anchors(fps, width, [[m] for m in _flips(width)])


def visits(fps: DataFrame, width: int) -> DataFrame:
    """fps with (part, anchor): all anchors within covering radius plus one bit of each fingerprint, its home among them.

    The code is linear, so which bits lead from a value to those anchors depends on its syndrome alone.
    """
    flips, bits = _flips(width), _bit_syndromes(width)
    turns = [sorted({flips[s]} | {(1 << i) ^ flips[s ^ e] for i, e in enumerate(bits)}) for s in range(len(flips))]
    return _to_anchors(fps, width, turns)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def midpoints(fps: DataFrame) -> DataFrame:
    """fps with `mid`: the fingerprint and its 64 neighbours at one bit."""
    mids = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(i, F.lit(0))))))
    return fps.select("*", F.explode(mids).alias("mid"))


# ---- linking fingerprints within two bits


def fingerprint_links(spark: SparkSession, fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Edges (a, b) between different fingerprints of fps (distinct, column fp) that connect all within `threshold` (0 to 2) bits.

    Anchors of 32-bit halves: within two bits, one half differs by at most one. Homes and visits meet in a shuffled
    join, whatever the optimizer takes their sizes for: a fingerprint makes 66 visits. At an anchor at most HOT_HOMES
    fingerprints are at home, so pairs grow with the visits, not with their square. Fingerprints at hotter anchors are
    linked exactly by another road: two are within two bits if and only if both are within one bit of a third point, and
    at most 65 fingerprints are that near to a point; each is linked to the smallest of them. (For thresholds below two
    these links are compared directly.)
    """
    if threshold > 2:
        raise ValueError("halves cover at most two bits here")
    home = homes(fps, 32)
    hot = write_table(spark, home.groupBy("part", "anchor").count().where(F.col("count") > HOT_HOMES).select("part", "anchor"), "hot-anchors")
    hot = broadcast_within(hot)
    visit = visits(fps, 32)
    left = home.join(hot, ["part", "anchor"], "left_anti").withColumnRenamed("fp", "a")
    right = visit.join(hot, ["part", "anchor"], "left_anti").select(F.col("part").alias("p"), F.col("anchor").alias("c"), F.col("fp").alias("b"))
    cold = left.join(right.hint("merge"), (F.col("part") == F.col("p")) & (F.col("anchor") == F.col("c")) & (F.col("a") < F.col("b")) & (_distance("a", "b") <= threshold)).select("a", "b")
    crowded = visit.join(hot, ["part", "anchor"], "left_semi").select("fp").distinct()
    mids = midpoints(crowded)
    if threshold == 2:
        centre = mids.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a != top").select("mid", "a")
        warm = mids.join(centre.hint("merge"), "mid").where("a != fp").select("a", F.col("fp").alias("b"))
    else:
        one = mids.select("mid", F.col("fp").alias("a")).join(crowded.select(F.col("fp").alias("b")).hint("merge"), F.col("mid") == F.col("b"))
        warm = one.where((F.col("a") < F.col("b")) & (_distance("a", "b") <= threshold)).select("a", "b")
    return cold.union(warm).distinct()


def near_groups(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, threshold: int = 2) -> DataFrame:
    """(id, fp, component_id, group_size), one row for each row of df.

    Rows link when their fingerprints (k-word shingles, repeats included) differ by at most `threshold` bits;
    component_id is the smallest id reachable. Null and empty texts have fingerprint zero and link like any other. Null
    ids take no part in the minimum; a component with none but null ids has a null component_id. Repeated rows and ids
    are rows of their own. An empty table gives an empty result. Other columns are not read. Equal fingerprints are
    grouped before the search, so copies never meet pair by pair; fingerprints, not texts, are shuffled.
    """
    rows = write_table(spark, fingerprints(df, [F.col(f"`{id_col}`").alias("id")], F.col(f"`{text_col}`"), k), "fingerprints")
    groups = write_table(spark, rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "fingerprint-groups")
    linked = connected_components(spark, fingerprint_links(spark, groups.select("fp"), threshold))
    named = groups.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label"))
    named = write_table(spark, named, "fingerprint-labels")
    # Written before each join: small, they are broadcast; else Spark can split the partition of a hot label or fingerprint.
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size")).where("group_size > 1")
    least = broadcast_within(write_table(spark, least, "component-ids"))
    shared = broadcast_within(write_table(spark, named.join(least, "label").select("fp", "component_id", "group_size"), "linked-fingerprints"))
    found = rows.join(shared, "fp", "left")
    alone = F.col("group_size").isNull()
    return found.select("id", "fp", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))


# ---- verified near-duplicates at five-word shingles, for filtering


def _shingle_sets(spark: SparkSession, docs: DataFrame, key: Column, text: Column, needed: DataFrame, k: int) -> DataFrame:
    """(key, s): the shingle hashes of the needed texts, a row for each text; texts under k words have their whole sequence."""
    needed = broadcast_within(needed.select(F.col("key").alias("__need")))
    chosen = docs.select(key.alias("key"), F.coalesce(text, F.lit("")).alias("text")).join(needed, F.col("key") == F.col("__need"), "left_semi")

    def run(batches):
        for batch in sliced(batches, 1):
            sets = [_text_shingles(x.as_py(), k).view(np.int64) for x in batch.column(1)]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["key", "s"])

    return write_table(spark, chosen.mapInArrow(run, "key binary, s array<long>").dropDuplicates(["key"]), "shingle-sets")


def _verified(spark: SparkSession, docs: DataFrame, key: Column, text: Column, pairs: DataFrame, similarity: float, k: int) -> DataFrame:
    """The pairs (a, b) of keys whose shingle sets have at least that Jaccard similarity."""
    pairs = write_table(spark, pairs.distinct(), "candidates")
    needed = write_table(spark, pairs.select(F.col("a").alias("key")).distinct().union(pairs.select("b").distinct()).distinct(), "candidate-keys")
    sets = _shingle_sets(spark, docs, key, text, needed, k)
    sizes = sets.select("key", F.size("s").alias("n"))
    sized = pairs.join(sizes.withColumnRenamed("key", "a"), "a").withColumnRenamed("n", "na").join(sizes.withColumnRenamed("key", "b"), "b")
    sized = sized.where((F.least("n", "na") >= F.greatest("n", "na") * similarity)).select("a", "b")
    both = sized.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    close = common >= (F.size("sa") + F.size("sb") - common) * similarity
    links = write_table(spark, both.where(close).select("a", "b"), "links")
    discard(spark, pairs, needed, sets)
    return links


#: One text in so many is counted for the order of shingles, and so many frequent shingles at most are told apart. Any
#: order gives the same groups; these decide how long the lists of texts with a shingle are.
SAMPLE, FREQUENT = 16, 1 << 17

#: Texts of a list with a shingle from which several of them, and about how many, are compared with the others first.
LONG_LIST, HUBS = 64, 16


def _text_shingles(text: str, k: int) -> np.ndarray:
    """The different hashes of the k-word shingles; a text under k words has its whole sequence, one without words nothing."""
    found, carry = [np.zeros(0, np.uint64)], []
    for block in word_blocks(text):
        block = carry + block
        if len(block) >= k:
            found.append(np.unique(_hashes(block, k)))
            block = block[len(block) - k + 1 :] if k > 1 else []
        carry = block
    if len(found) == 1 and carry:
        found.append(_hashes(carry, len(carry)))
    return np.unique(np.concatenate(found))


#: Longs of a text's parities (below), and rows up to which a table of them may be broadcast (about 50 MB).
PARITY_LONGS, PARITY_ROWS = 4, 500_000
_PARITIES = [f"p{i}" for i in range(PARITY_LONGS)]


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bits, as longs: each says whether an odd number of the hashes falls on it.

    Each hash that only one of two sets has turns one bit, so their parities differ in at most as many bits as the sets in hashes."""
    bits = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * PARITY_LONGS), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view(np.int64)


def _number(key: Column) -> Column:
    """Eight bytes for a text's sixteen where there is a row for each of its shingles. Two texts of one number (odds of 1 in 2^64)
    are both candidates of what either meets, and whole sets decide."""
    return F.xxhash64(key)


def _prefixes(spark: SparkSession, docs: DataFrame, key: Column, text: Column, similarity: float, k: int) -> DataFrame:
    """(key, h, n, parities), written: of each text's n shingles the first n - ceil(similarity n) + 1 in an order that is the same for all texts.

    Here a key is a 64-bit hash of a text's key (see _number). The first row of a text has the parities of all its shingles,
    the others nulls.

    Texts of that similarity share a shingle of these. The order puts those last that are frequent in a sample; any
    order is right, this one keeps the lists of texts with a shingle short.
    """
    rows = docs.select(_number(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))

    def sampled(batches):
        for batch in sliced(batches, 0):
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_text_shingles(x.as_py(), k).view(np.int64))], names=["h"])

    counts = rows.where(F.pmod(F.col("key"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(sampled, "h long").groupBy("h").count()
    often = counts.where("count >= 4").orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas()
    hashes = often["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    shared = spark.sparkContext.broadcast((hashes[order], often["count"].to_numpy(np.int64)[order]))

    def run(batches):
        frequent, times = shared.value
        for batch in sliced(batches, 1):
            hs, ns, sizes, odd = [np.zeros(0, np.uint64)], [], [], [np.zeros((0, PARITY_LONGS), np.int64)]
            for x in batch.column(1):
                found = _text_shingles(x.as_py(), k)
                if len(found) and len(frequent):
                    place = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
                    found = found[np.lexsort((found, np.where(frequent[place] == found, times[place], 0)))]
                size = len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1 if len(found) else 0
                hs.append(found[:size])
                ns.append(len(found))
                sizes.append(size)
                if size:
                    odd.append(parities(found)[None])
            sizes = np.array(sizes, np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            columns = [batch.column(0).take(pa.array(owner)), pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.array(ns, np.int32)[owner])]
            # The place among the batch's texts with shingles at the first row of each, null elsewhere.
            first = np.diff(owner, prepend=-1) != 0
            place = pa.array(np.cumsum(first) - 1, mask=~first)
            columns += [pa.array(column).take(place) for column in np.concatenate(odd).T]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "h", "n", *_PARITIES])

    schema = ", ".join(["key long", "h long", "n int", *[f"{p} long" for p in _PARITIES]])
    found = write_table(spark, rows.mapInArrow(run, schema), "prefixes")
    shared.destroy()
    return found


def _prefix_links(spark: SparkSession, docs: DataFrame, key: Column, text: Column, nodes: DataFrame, links: DataFrame, similarity: float, k: int) -> DataFrame:
    """Links (a, b) that, with the given ones, connect all texts of that similarity: an exact join by prefixes.

    Only texts not connected yet are compared, inside the join by shingle. What two texts with n and m shingles have in
    common is at most what their prefixes share and the larger rest behind the prefixes: of the two prefixes one ends
    first in the common order, and its shingles are in the other text only if they are in the other prefix. So pairs
    whose prefixes share too little never get as far as their whole sets. Nor, by the join's condition, do pairs whose
    parities differ in more bits than sets of that similarity differ in shingles. Where several texts share a shingle, the one
    with the least hash (of many texts some more) is first compared with the others; that connects large groups by few pairs.
    """
    posted = _prefixes(spark, docs, key, text, similarity, k)
    one = F.col("key")
    many = posted.groupBy("h").agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low != high").select("h")
    many = write_table(spark, many, "shared-shingles")
    met = posted.select("h", "key", "n").join(broadcast_within(many), "h", "left_semi").dropDuplicates(["h", "key"])
    odd = posted.where("p0 IS NOT NULL").select("key", *_PARITIES).dropDuplicates(["key"])
    odd = broadcast_within(write_table(spark, odd, "parities"), PARITY_ROWS)
    met = write_table(spark, met.join(odd, "key").select("h", "key", "n", *_PARITIES), "shared-prefixes")
    discard(spark, posted, many, odd)
    rest = lambda n: F.ceil(F.col(n) * F.lit(similarity) - 1e-9) - 1
    needed = (F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-6

    def meeting(left: DataFrame, links: DataFrame, parts: int = 1) -> DataFrame:
        labels = connected_components(spark, links).select(_number(F.col("node")).alias("node"), _number(F.col("label")).alias("label"))
        labels = broadcast_within(labels)
        named = lambda df: df.join(labels, F.col("key") == F.col("node"), "left").select("key", "h", "n", *_PARITIES, F.coalesce("label", "key").alias("comp"))
        other = named(met).select(F.col("h").alias("g"), F.col("key").alias("b"), F.col("n").alias("m"), F.col("comp").alias("comp_b"), *[F.col(p).alias(f"{p}_b") for p in _PARITIES])
        differ = sum((_distance(p, f"{p}_b") for p in _PARITIES), F.lit(0))
        alike = differ <= (F.col("n") + F.col("m")) * ((1 - similarity) / (1 + similarity)) + 1e-6
        long = F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-6
        once = F.lit(True) if left is not met else F.col("a") < F.col("b")
        pairs = named(left).withColumnRenamed("key", "a").join(other, (F.col("h") == F.col("g")) & (F.col("comp") != F.col("comp_b")) & long & once & alike)
        shared = pairs.groupBy("a", "b", "n", "m").agg(F.count("*").alias("both"))
        return shared.where(F.col("both") * parts + F.greatest(rest("n"), rest("m")) >= needed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    sizes = write_table(spark, met.groupBy("h").agg(F.count("*").alias("c"), F.min(one).alias("least")).where("c > 2"), "prefix-list-sizes")
    # Of a long list about HUBS texts, those with low hashes, so that lists with the same texts have the same hubs.
    low = F.pmod(one, F.lit(1 << 30)) * F.col("c") < F.lit(HUBS << 30)
    hubs = met.join(broadcast_within(sizes), "h").where((one == F.col("least")) | (F.col("c") > LONG_LIST) & low)
    hubs = write_table(spark, hubs.select("h", "key", "n", *_PARITIES), "prefix-hubs")

    def keys_of(pairs: DataFrame) -> DataFrame:
        numbered = nodes.select(_number(F.col("key")).alias("number"), "key")
        for side in ("a", "b"):
            pairs = pairs.join(numbered, F.col(side) == F.col("number")).drop(side, "number").withColumnRenamed("key", side)
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b")

    # What two texts share may have several hubs, so here a part of it will do. What this leaves out is left to the whole join.
    star = _verified(spark, docs, key, text, keys_of(meeting(hubs, links, 4)), similarity, k)
    others = _verified(spark, docs, key, text, keys_of(meeting(met, links.union(star))), similarity, k)
    discard(spark, met, hubs, sizes)
    return star.union(others)


def near_duplicate_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, similarity: float = 0.8, k: int = 5) -> DataFrame:
    """(key, id, label, linked): each distinct text, its smallest id and its group, for texts linked by similarity.

    Two texts link when the Jaccard similarity of their sets of k-word shingles is at least `similarity`; groups are
    connected components of all such pairs. First, texts whose fingerprints differ by at most `threshold` bits are found
    by anchors and verified: copies of one fingerprint against one of them, and fingerprints that anchors link against
    each other, so candidates grow with the texts. That connects most near copies. An exact join of shingle prefixes
    then finds every pair between texts that are not connected yet, so the groups depend on neither fingerprints nor
    table size. Null counts as empty; an empty text links with none but itself. A null id counts only where a text has
    no other. Repeated rows are one text. An empty table gives an empty result; other columns are not read.
    """
    key, text = text_key(text_col), F.col(f"`{text_col}`")
    rows = fingerprints(docs, [key.alias("key"), F.col(f"`{id_col}`").alias("id")], text)
    nodes = write_table(spark, rows.groupBy("key").agg(F.min("id").alias("id"), F.first("fp").alias("fp")), "texts")
    groups = write_table(spark, nodes.where("fp != 0").groupBy("fp").agg(F.min("key").alias("head"), F.count("*").alias("n")), "text-fingerprints")
    several = broadcast_within(write_table(spark, groups.where("n > 1").select("fp", "head"), "shared-fingerprints"))
    same = nodes.join(several, "fp").where("key != head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    near = write_table(spark, fingerprint_links(spark, groups.select("fp"), threshold), "fingerprint-links")
    head = groups.select("fp", "head")
    apart = near.join(head.withColumnsRenamed({"fp": "a", "head": "ha"}), "a").join(head.withColumnsRenamed({"fp": "b", "head": "hb"}), "b")
    links = _verified(spark, docs, key, text, same.union(apart.select(F.least("ha", "hb"), F.greatest("ha", "hb"))), similarity, k)
    discard(spark, near)
    links = links.union(_prefix_links(spark, docs, key, text, nodes, links, similarity, k))
    labels = connected_components(spark, links)
    return nodes.join(labels, F.col("key") == F.col("node"), "left").select("key", "id", F.coalesce("label", "key").alias("label"), F.col("node").isNotNull().alias("linked"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, similarity: float = 0.8, k: int = 5) -> DataFrame:
    """docs with one document of each group of near_duplicate_texts: the one with the smallest id (nulls last, ties by text key).

    Exact copies count as one group too; rows that repeat an id and its text share its fate. Columns stay as they are.
    """
    texts = write_table(spark, near_duplicate_texts(spark, docs, id_col, text_col, threshold, similarity, k), "near-groups")
    best = texts.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("best"))
    keep = texts.join(best, "label").select("key", F.col("best.id").alias("keep_id"), F.col("best.key").alias("keep_key"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(text_col).alias("key"))
    # Texts that stay and have no copies need no decision.
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    open_ = keep.join(many.withColumn("copied", F.lit(True)), "key", "left").where("copied or key != keep_key").select("key", "keep_id", "keep_key")
    gone = rows.join(open_, "key").where(~(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key")))).select("id", "key")
    return remove_rows(docs, write_table(spark, gone, "near-copies"), {"id": F.col(f"`{id_col}`"), "key": text_key(text_col)})
