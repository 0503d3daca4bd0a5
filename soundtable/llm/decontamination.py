"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact check; DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundtable.llm.common import BROADCAST_ROWS, ascii_lower, broadcast_within, remove_rows, shingle_hashes, words, write_table

#: Bits within which all fingerprints are found. At the similarity 0.8 about 10 bits differ, with a deviation of 3.
RADIUS = 23
#: Blocks of the multi-index; two fingerprints within RADIUS agree up to RADIUS // BLOCKS bits in some block.
BLOCKS = 8


def simhash_of(hashes: Column) -> Column:
    """64 bits, each set where more than half of the hashes have it."""
    one = F.lit(1).cast("long")

    def bit(b: Column) -> Column:
        ones = F.size(F.filter(hashes, lambda h: F.call_function("shiftrightunsigned", h, b).bitwiseAND(one) == one))
        return F.call_function("shiftleft", F.when(ones * 2 > F.size(hashes), one).otherwise(one - 1), b)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), one - 1, lambda a, b: a.bitwiseOR(b))


def _block(fp: Column, b: int) -> Column:
    width = 64 // BLOCKS
    return F.shiftrightunsigned(fp, width * b).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _index(items: DataFrame, radius: int) -> DataFrame:
    """items with (block, value): each block of the fingerprint with up to radius // BLOCKS bits turned."""
    width = 64 // BLOCKS
    turns = [sum(1 << i for i in bits) for n in range(radius // BLOCKS + 1) for bits in combinations(range(width), n)]
    turned = F.array(*[F.lit(t).cast("long") for t in turns])

    def entries(b: int) -> Column:
        return F.transform(turned, lambda t: F.struct(F.lit(b).alias("block"), _block(F.col("item_fp"), b).bitwiseXOR(t).alias("value")))

    return items.select("*", F.inline(F.concat(*[entries(b) for b in range(BLOCKS)])))


def item_table(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(item_id, width, item, item_fp): the number of words, shingle hashes and fingerprint of each item of at least k words.

    Null and shorter texts give no row, repeated rows one, null ids stay null; an empty table gives an empty result."""
    split = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), words(ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("w"))
    items = split.where(F.size("w") >= k).select("item_id", F.size("w").alias("width"), shingle_hashes(F.col("w"), k).alias("item")).distinct()
    return items.select("*", simhash_of(F.col("item")).alias("item_fp"))


def _common(window: Column, item: Column) -> Column:
    """Shingles in common, each as often as in the poorer of the two."""
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    return F.aggregate(F.array_intersect(window, item), F.lit(0), lambda n, x: n + F.least(times(window, x), times(item, x)))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_cols: dict[str, Column] | None = None, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, k: int = 5, radius: int = RADIUS) -> DataFrame:
    """(the id columns, item_id, similarity, position), a row for each document and item that it contains.

    A document contains an item when a window of as many words (the whole text, if that is shorter) has at least that
    weighted Jaccard similarity to it: shingles of k words, weighted by how often they occur, sum of minima over sum of
    maxima. The best similarity is given, and the first word (from 0) of the first window that has it among those
    compared. Moving a window on past a shingle that the item lacks never lowers its similarity, so only windows that
    begin with a shingle of the benchmark, or that end the text, are compared; those are fingerprinted, and the blocks
    lead to all items of their length within `radius` bits, whose similarity is then computed.

    Null and empty texts, and items of fewer than k words, contain and match nothing. Rows that repeat an id count as
    one document. Items with a null id take part under it. Tables may be empty; other columns are not read. A document
    stays with its task: the benchmark's shingles go to the documents, in blocks of at most BROADCAST_ROWS rows.
    """
    id_cols = id_cols or {"doc_id": F.col("doc_id")}
    names, ids = list(id_cols), [f"__id{i}" for i in range(len(id_cols))]  # no name of an id meets one of ours
    items = write_table(spark, item_table(benchmark, item_id_col, item_text_col, k), "items")
    # Which item widths a shingle calls for.
    starts = write_table(spark, items.select("width", F.explode(F.array_distinct("item")).alias("shingle")).distinct(), "item-shingles")
    count = starts.count()
    split = docs.select(*[c.alias(n) for n, c in zip(ids, id_cols.values(), strict=True)], words(ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("__w"))
    hashed = split.select(*ids, F.size("__w").alias("__words"), shingle_hashes(F.col("__w"), k).alias("__h"))
    each = hashed.select(*ids, "__words", "__h", F.posexplode_outer("__h").alias("__p", "__s"))
    blocks = max(1, -(-count // BROADCAST_ROWS))
    windows = None
    for b in range(blocks):
        part = starts if blocks == 1 else starts.where(F.pmod(F.xxhash64("shingle"), F.lit(blocks)) == b)
        hits = each.join(F.broadcast(part), F.col("__s") == F.col("shingle"))
        start = F.least(F.col("__p"), F.greatest(F.col("__words") - F.col("width"), F.lit(0)))
        one = hits.select(*ids, "width", start.alias("position"), F.slice("__h", start + 1, F.col("width") - (k - 1)).alias("__window"))
        windows = one if windows is None else windows.union(one)
    index = _index(items, radius)
    index = F.broadcast(index) if items.count() * 37 * BLOCKS <= BROADCAST_ROWS else index
    # Written here: the few windows are then fingerprinted once, and no later condition is evaluated on whole documents.
    windows = write_table(spark, windows, "windows")
    fp = windows.select("*", simhash_of(F.col("__window")).alias("__fp"))
    keyed = fp.select("*", F.inline(F.array(*[F.struct(F.lit(b).alias("__block"), _block(F.col("__fp"), b).alias("__value")) for b in range(BLOCKS)])))
    index = index.withColumnRenamed("width", "__width")
    near = (F.col("__block") == F.col("block")) & (F.col("__value") == F.col("value")) & (F.col("width") == F.col("__width")) & (F.bit_count(F.coalesce("__fp", F.lit(0)).bitwiseXOR(F.col("item_fp"))) <= radius)
    # Of the blocks that lead to an item, the first one keeps it.
    first = F.lit(BLOCKS)
    for b in reversed(range(BLOCKS)):
        first = F.when(F.bit_count(_block(F.coalesce("__fp", F.lit(0)).bitwiseXOR(F.col("item_fp")), b)) <= radius // BLOCKS, F.lit(b)).otherwise(first)
    found = keyed.join(index, near & (F.col("__block") == first))
    scored = found.select(*ids, "item_id", "position", F.size("__window").alias("__n"), F.size("item").alias("__m"), _common(F.col("__window"), F.col("item")).alias("__common"))
    value = F.col("__common") / (F.col("__n") + F.col("__m") - F.col("__common"))
    scored = scored.withColumn("similarity", value)
    best = scored.groupBy(*ids, "item_id").agg(F.max(F.struct("similarity", (-F.col("position")).alias("back"))).alias("best"))
    return best.where(F.col("best.similarity") >= similarity).select(*[F.col(i).alias(n) for i, n in zip(ids, names, strict=True)], "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("long").alias("position"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that contain an item. Rows with the same id and text share their fate, a null id is a value like any
    other, null and empty texts stay. Columns stay as they are, whatever their names. Either table may be empty."""
    keys = {"id": F.col(f"`{id_col}`"), "hash": F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))}
    found = contaminated(spark, docs, benchmark, keys, text_col)
    return remove_rows(docs, write_table(spark, found.select(*keys).distinct(), "contaminated"), keys)
