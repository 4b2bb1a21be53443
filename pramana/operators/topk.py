"""Ranking with explicit rules for ties, and orders by hash in place of random ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranks(df: DataFrame, group: list[str], score: str, tie: str, digits: int = 9) -> DataFrame:
    """Add ``rank`` (bigint, from 1) within the group: by score, rounded so that rounding errors make no order, then by ``tie``."""
    w = Window.partitionBy(*group).orderBy(F.round(score, digits).desc_nulls_last(), tie)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint"))


def top_k(df: DataFrame, group: list[str], score: str, tie: str, k: int, digits: int = 9) -> DataFrame:
    """The k best rows of each group, with ``rank``; each task keeps k rows a group before the exchange."""
    return ranks(df, group, score, tie, digits).where(F.col("rank") <= k)


def hash_order(key: Column, seed: int) -> Column:
    """A number in [0, 2**60) by which to order at random: the same for a key and seed on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("bigint")


def hash_order_sql(key: str, seed: int) -> str:
    return f"CAST(('0x' || substr(md5('{seed}|' || {key}), 1, 15)) AS BIGINT)"
