"""The driver's tables seen as audio tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RATE = 10
NOTE_ORDER = ["start", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark, sf_dir) -> DataFrame:
    """A program for each user, one channel, a frame for each event."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("program_id"), (F.row_number().over(w) - 1).cast("long").alias("frame"), (F.col("value") / 500).alias("x"))


SIGNAL = "signal AS (SELECT user_id AS program_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value / 500 AS x FROM events)"


def multichannel(spark, sf_dir) -> DataFrame:
    """A program for each user, a channel for each event type in alphabetical order."""
    events = table(spark, sf_dir, "events")
    types = events.select("event_type").distinct().withColumn("channel", F.row_number().over(W.orderBy("event_type")) - 1)
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = events.select(F.col("user_id").alias("program_id"), "event_type", (F.row_number().over(w) - 1).cast("long").alias("frame"), (F.col("value") / 500).alias("x"))
    return rows.join(F.broadcast(types), "event_type").drop("event_type")


MULTI = """multi AS (SELECT user_id AS program_id, c.channel, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS frame, value / 500 AS x
    FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS channel FROM (SELECT DISTINCT event_type FROM events)) c USING (event_type))"""


def scene(spark, sf_dir) -> DataFrame:
    """A program for each label, a frame of 64 channels for each vector."""
    w = W.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("program_id"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("embedding").alias("acn"))


SCENE = "scene AS (SELECT label AS program_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding::DOUBLE[] AS acn FROM embeddings)"


def notes(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("take_id"), (F.col("l_extendedprice") / 1000).alias("start"), (F.col("l_quantity") / 50).alias("length"), (F.col("l_partkey") % 128).cast("int").alias("pitch"), (1 + F.col("l_suppkey") % 127).cast("int").alias("velocity"), (F.col("l_linenumber") % 16).cast("int").alias("channel"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


NOTES = """notes AS (SELECT l_orderkey AS take_id, l_extendedprice / 1000 AS start, l_quantity / 50 AS length, (l_partkey % 128)::INT AS pitch, (1 + l_suppkey % 127)::INT AS velocity,
    (l_linenumber % 16)::INT AS channel, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice FROM lineitem)"""
NOTE_ORDER_SQL = ", ".join(NOTE_ORDER)


def trajectory(spark, sf_dir) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("object_id"), key.alias("seq"), days.alias("t"), (key % 360 - 180).cast("double").alias("az"), (key % 181 - 90).cast("double").alias("el"), F.lit(1.0).alias("gain"))


TRAJ = """traj AS (SELECT o_custkey AS object_id, o_orderkey AS seq, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS t,
    (o_orderkey % 360 - 180)::DOUBLE AS az, (o_orderkey % 181 - 90)::DOUBLE AS el, 1.0::DOUBLE AS gain FROM orders)"""
