"""Pieces that several corpus operators share: checkpoints, size-checked joins, components."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a side may be broadcast; a larger side goes through a shuffled join.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs on one machine a temporary folder is taken.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate results, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Has shuffle files of plans that nothing refers to any more removed now, and not whenever the driver next collects its garbage.

    To be called where large shuffles lie behind a checkpoint.
    """
    gc.collect()
    time.sleep(1)  # the driver hears of dropped references a little later
    spark._jvm.System.gc()


def join_sized(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a side that is usually small: broadcast when it counts ``limit`` rows at most, else by shuffle.

    ``small`` must be cheap to count (checkpointed or a small aggregate).
    """
    few = small.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(small) if few else small, on, how)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def empty_if_null(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns node, root: the smallest node that can be reached, for every node that ``edges`` (a, b) names.

    Alternating large-star and small-star steps; each step is one aggregate and one join, so
    a node with very many edges is pre-aggregated and its rows can be split between tasks.
    Null ends, loops and repeated edges have no effect. No edge gives an empty result.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = checkpointed(pairs)
    before = None
    for _ in range(max_rounds):
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        state = checkpointed(small.union(down.select("u", F.col("m").alias("v"))).distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
