"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundtable.llm.common import discard, write_table


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of each node that is not the smallest of its component; label is the smallest.

    edges has two columns of one orderable type. Each step links nodes to the smallest neighbour, found by a partial
    aggregation, so a hub of any degree sends one row for each task; the number of steps grows with the logarithm of the
    longest path. Each step is written to the shared folder and replaces the one before. No edge gives no row.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")
    now = write_table(spark, pairs.distinct(), "edges")
    mark = _mark(now)
    if not mark[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(low, F.col("u") == F.col("c")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = write_table(spark, small.union(low.select("c", "m")).distinct(), "edges")
        discard(spark, now)
        now, (before, mark) = step, (mark, _mark(step))
        if before == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
