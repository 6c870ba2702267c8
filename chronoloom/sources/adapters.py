"""The test tables as series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import nanos_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four transactions of events; no two rows share key and time."""
    key = F.concat_ws("/", "event_type", F.lpad(F.col("user_id").cast("string"), 6, "0"))
    return table(spark, sf_dir, "events").select(key.alias("key"), nanos_of("ts").alias("ts_nanos"), (F.col("event_id") % 4).alias("txid"), F.col("value").alias("v1"), F.col("props").alias("v2"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at the precision of a day, each in a transaction of its own: many collisions, numbers only."""
    key = F.concat_ws("/", "event_type", F.lpad(F.col("user_id").cast("string"), 6, "0"))
    df = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("DAY", "ts").cast("timestamp_ntz"))
    return df.select(key.alias("key"), nanos_of("day").alias("ts_nanos"), F.col("event_id").alias("txid"), F.col("value").alias("v1"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer and date, each in a transaction of its own."""
    key = F.concat(F.lit("cust/"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    return table(spark, sf_dir, "orders").select(key.alias("key"), nanos_of("o_orderdate").alias("ts_nanos"), F.col("o_orderkey").alias("txid"), F.col("o_totalprice").alias("v1"), F.col("o_orderstatus").alias("v2"))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by part and ship date; key and time may repeat."""
    key = F.concat(F.lit("part/"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"))
    return table(spark, sf_dir, "lineitem").select(key.alias("key"), nanos_of("l_shipdate").alias("ts_nanos"), F.col("l_quantity").alias("v1"), F.col("l_extendedprice").alias("v2"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations: strings only."""
    key = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    return table(spark, sf_dir, "conversations").select(key.alias("key"), F.col("turn").alias("ts_nanos"), F.lit(0).cast("long").alias("txid"), F.col("role").alias("v1"), F.col("text").alias("v2"))
