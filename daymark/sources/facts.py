"""Tables of the scale-factor folders as observation facts: subject, signal, occurred_at, observation_id, value, ..."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as facts; props.k is a revision, dimension or counter epoch, as a query needs."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"), F.col("event_type").alias("signal"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("observation_id"),
        "value", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_date("ts").alias("local_date"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a long-horizon series per customer."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject"), F.lit("spend").alias("signal"), F.col("o_orderdate").alias("occurred_at"), F.col("o_orderkey").alias("observation_id"),
        F.col("o_totalprice").alias("value"), F.to_date("o_orderdate").alias("local_date"), F.col("o_orderstatus").alias("state"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as states (return flag) with quantities per supplier."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject"), F.lit("shipment").alias("signal"), F.to_date("l_shipdate").alias("local_date"), F.col("l_returnflag").alias("state"),
        F.col("l_quantity").alias("value"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
    )
