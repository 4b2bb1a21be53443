"""Session helpers: reading tables, cutting lineage, joins with hot keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; make one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def frequent(df: DataFrame, key: str, most: int) -> DataFrame:
    """The values of ``key`` that more than one in ``most`` rows have: fewer than ``most``, whatever the size of ``df``. Null is none."""
    counts = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    return counts.where(F.col("__n") * most > total).select(key)


def lookup(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has each ``key`` once, where some keys of ``left`` may hold most of its rows.

    ``hot``: those keys, of proven small number (see ``frequent``): their rows of ``right`` are sent to all tasks, so that no
    task gets a hot key's rows; all others are joined by exchange.
    """
    marks = F.broadcast(hot.select(key).distinct())
    known = right.join(marks, key, "left_semi")
    return left.join(marks, key, "left_semi").join(F.broadcast(known), key, how).unionByName(left.join(marks, key, "left_anti").join(right, key, how))
