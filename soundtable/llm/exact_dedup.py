"""Exact dedup as a tree merge of digest runs; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundtable.llm.common import broadcast_within, remove_rows, write_table

#: Runs merged into one in a round, as a power of two.
FAN_IN_BITS = 4

_KEY = ["digest", "n_bytes", "check_hash"]


def digest_runs(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """id, SHA-256, length and a second hash of each row's text (null: empty), and `more`: one row for each row, ids null or
    repeated as they are; an empty table gives an empty result."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check_hash"),
        *more,
    )


def rounds_for(runs: DataFrame, fan_in_bits: int = FAN_IN_BITS) -> int:
    """Rounds after which every run has met every other: each joins 2^fan_in_bits of them."""
    last = runs.select(F.spark_partition_id().alias("run")).agg(F.max("run")).first()[0] or 0
    return max(1, -(-last.bit_length() // fan_in_bits))


def _merged(level: DataFrame) -> DataFrame:
    """Each run sorted by digest, with one row for each text: within partitions, which are runs, so nothing is exchanged."""
    return level.sortWithinPartitions("run", *_KEY).groupBy("run", *_KEY).agg(F.max("keep").alias("keep"), F.sum("group_size").alias("group_size"))


def dealt(level: DataFrame, r: int, rounds: int, fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """The rows of round r, each in the partition that has the number of its new run (column `run`)."""
    leading = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int")
    digit = ((1 << fan_in_bits) - 1) << r * fan_in_bits
    kept = F.col("run").bitwiseAND(F.lit(~digit)).bitwiseOR(leading.bitwiseAND(F.lit(digit)))
    return level.withColumn("run", kept).repartitionById(1 << rounds * fan_in_bits, F.col("run"))


def merge_runs(runs: DataFrame, rounds: int, fan_in_bits: int = FAN_IN_BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(digest, n_bytes, check_hash, keep_id, the `carry` columns, group_size) for each distinct text.

    A partition's rows, sorted by digest and reduced to one for each text, are a leaf run. In round r, the 2^fan_in_bits
    runs whose numbers agree in all but their r-th digit exchange their rows: each keeps those digests that have its digit
    in that place. Partitions are runs all the way, so a task takes in rows of a fan-in of runs and no others. After all
    rounds a run's number is the beginning of its digests, and equal texts have met. Of equal texts only the row with the
    largest id (ties: the largest `carry`) and the count go up, so a hot text sends one row for each run. Length and second
    hash are part of the key at each level: rows of one digest that differ in them never merge.
    """
    count = 1 << rounds * fan_in_bits
    number = F.pmod(F.spark_partition_id(), F.lit(count))
    level = runs.select(*_KEY, number.alias("run"), F.struct(F.col("id").alias("keep_id"), *carry).alias("keep"), F.lit(1).cast("long").alias("group_size"))
    level = _merged(level.repartitionById(count, F.col("run")))
    for r in range(rounds):
        level = _merged(dealt(level, r, rounds, fan_in_bits))
    return level.select(*_KEY, "keep.*", "group_size")


def exact_groups(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """(id, digest, keep_id, group_size, kept), one row for each row of df.

    Texts are equal when identical; null counts as empty. The row with the largest id stays. Rows that repeat an id and
    its text share its fate. A null id ranks below all others; a group with none but null ids keeps all of them. An
    empty table gives an empty result. Other columns are not read. Texts are read once: their digests are written to
    the shared folder, and only groups of two or more are joined back. The number of rounds follows the number of runs.
    """
    runs = write_table(spark, digest_runs(df, id_col, text_col), "digest-runs")
    # Written: small, it is broadcast; else both sides are plain shuffles, and Spark can split the partition of a hot text.
    merged = merge_runs(runs, rounds or rounds_for(runs)).where("group_size > 1")
    groups = broadcast_within(write_table(spark, merged, "digest-groups"))
    out = runs.join(groups, _KEY, "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        "id",
        "digest",
        keep.alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
    )


def drop_exact_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups does not keep; columns and other rows stay as they are."""
    found = exact_groups(spark, docs, id_col, text_col).where("not kept").select("id", "digest")
    gone = write_table(spark, found, "exact-copies")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return remove_rows(docs, gone, {"id": F.col(f"`{id_col}`"), "digest": F.unhex(F.sha2(text, 256))})
