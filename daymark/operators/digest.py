"""Digests for readers: glance flags, a board over domains, top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glance(latest: DataFrame, flags: dict[str, Column], keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Booleans only: whether any of a subject's rows meets each condition, and a fingerprint of them."""
    rows = latest.groupBy(*keys).agg(*(F.bool_or(c).alias(k) for k, c in flags.items()))
    text = F.concat_ws(",", *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in sorted(flags)))
    return rows.withColumn("fingerprint", F.sha2(text, 256))


def board(trend: DataFrame, domains: dict[str, Sequence[str]], keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Signals up, down and flat of each domain."""
    domain = F.lit(None).cast("string")
    for name, signals in domains.items():
        domain = F.when(F.col("signal").isin(*signals), F.lit(name)).otherwise(domain)
    rows = trend.withColumn("domain", domain).where("domain IS NOT NULL")
    count = lambda d: F.count_if(F.col("direction") == d).alias(f"n_{d}")
    return rows.groupBy(*keys, "domain").agg(count("up"), count("down"), count("flat"))
