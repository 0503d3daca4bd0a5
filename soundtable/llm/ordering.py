"""Places in a global order, found by a range sort over many tasks: no group or table is sorted in one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundtable.llm.common import unused, write_table

_IN_PARTITION = 33  # bits of monotonically_increasing_id below the partition's number


def ranked(spark: SparkSession, df: DataFrame, by: list, out: str, label: str) -> DataFrame:
    """df with `out` (long): each row's place from 0 in the order of `by`, nulls where `by` puts them.

    The rows are range-sorted and written; what goes through the driver is one count for each partition. Rows that tie
    in all of `by` meet in one task, so `by` should end in columns that tell rows apart. An empty table stays empty.
    """
    mark = unused("__mark", df)
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(mark, F.monotonically_increasing_id())
    placed = write_table(spark, dealt, label)
    part, start = unused("__part", placed), unused("__start", placed)
    sizes = sorted(tuple(r) for r in placed.groupBy(F.shiftright(mark, _IN_PARTITION)).count().collect())
    starts, done = [], 0
    for number, n in sizes:
        starts.append((number, done))
        done += n
    offsets = spark.createDataFrame(starts, f"{part} long, {start} long")  # a row for each partition
    met = placed.withColumn(part, F.shiftright(mark, _IN_PARTITION)).join(F.broadcast(offsets), part)
    inside = F.col(mark).bitwiseAND(F.lit((1 << _IN_PARTITION) - 1))
    return met.withColumn(out, F.col(start) + inside).drop(mark, part, start)
