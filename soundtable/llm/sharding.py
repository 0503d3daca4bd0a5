"""Proportional stratified interleaving into shards; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that one ordered window should hold on average.
BUCKET_ROWS = 5_000


def _rank(df: DataFrame, within: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """df with `out`, the rank from 0 by (bucket, *order) within groups. Each window holds one bucket of a group, and what
    precedes the bucket comes from counts, so a group of any size is ranked by many tasks."""
    sizes = df.groupBy(*within, bucket).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*within).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(*within, bucket, F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy(*within, bucket).orderBy(*order)).cast("long") - 1
    return df.withColumn("__inside", inside).join(starts, [*within, bucket]).withColumn(out, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def stratified_shards(docs: DataFrame, shards: int = 24, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, source, size, text_crc32, position, shard, slot) for each row.

    Rows of a source are shuffled by the MD5 of seed and id and ranked; all rows are sorted by fractional rank
    (rank + 1/2) / rows of the source, and the order is cut into `shards` runs whose lengths differ by one at most. So
    each shard holds each source in proportion, give or take a row. Size is the text's UTF-8 bytes plus 8. Null text:
    size 8, checksum 0. Null sources form one stratum; null ids are shuffled as the empty string. Rows that tie in
    everything are alike, so their order does not matter. An empty table gives an empty result; with fewer rows than
    shards some shards are empty. Texts are not shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ident = F.col(f"`{id_col}`")
    rows = docs.select(
        ident.alias("doc_id"),
        F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source"),
        F.col(f"`{source_col}`").isNull().alias("__no_source"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))).alias("__draw"),
    )
    total = docs.count()
    buckets = max(1, -(-total // bucket_rows))
    drawn = F.conv(F.substring("__draw", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__bucket", F.shiftright(drawn * buckets, 32))
    strata = ["__no_source", "source"]
    order = ["__draw", "doc_id", "text_crc32", "size"]
    ranked = _rank(rows, strata, "__bucket", order, "__rank").drop("__bucket")
    in_source = rows.groupBy(*strata).agg(F.count("*").alias("__in_source"))
    fraction = (F.col("__rank") + F.lit(0.5)) / F.col("__in_source")
    placed = ranked.join(in_source, strata).withColumn("__fraction", fraction).withColumn("__bucket", F.floor(F.col("__fraction") * buckets)).withColumn("__all", F.lit(0))
    placed = _rank(placed, ["__all"], "__bucket", ["__fraction", *strata, *order], "position")
    shard = F.expr(f"cast(position * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select("doc_id", F.when(~F.col("__no_source"), F.col("source")).alias("source"), "size", "text_crc32", "position", "shard", (F.col("position") - first).alias("slot"))
