"""Tables in buckets of their keys, several of which one batch brings forward together."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import latest


@dataclass(frozen=True)
class Bucketed:
    """A table of a load: its key, what decides between rows of one key in a batch (the last counts), and its buckets."""

    name: str
    key: Sequence[str]
    order: str
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets).cast("long")).cast("int")


def manifest(spark: SparkSession, folder: str) -> dict[tuple[str, int], str]:
    """The folder of each bucket of each table, from the newest manifest; no more entries than buckets."""
    newest = _newest(spark, folder)
    if newest is None:
        return {}
    return {(r["name"], r["bucket"]): r["path"] for r in spark.read.json(f"{folder}/_manifest/{newest:020d}").collect()}


def _newest(spark: SparkSession, folder: str) -> int | None:
    """The highest number of a manifest that was written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    whole = [int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(whole, default=None)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table as the newest manifest has it; null before its first row."""
    paths = [p for (n, _), p in sorted(manifest(spark, folder).items()) if n == name]
    return spark.read.parquet(*paths) if paths else None


def load(spark: SparkSession, folder: str, batch: int, rows: Mapping[str, DataFrame], tables: Sequence[Bucketed]) -> None:
    """Upserts rows of several tables, parents first, and shows them together.

    Only buckets that the rows touch are written again, each whole into a folder of its own;
    the others stay where they are. Readers see the new buckets once the batch's manifest,
    which names the folders of all, is complete: a batch that fails before leaves nothing to
    be seen, and one that is run again after its manifest was written changes nothing.
    """
    newest = _newest(spark, folder)
    if newest is not None and newest >= batch:
        return
    before = manifest(spark, folder)
    now = dict(before)
    for t in tables:
        if t.name not in rows:
            continue
        fresh = latest(rows[t.name], t.key, F.col(t.order).desc_nulls_last()).withColumn("_bucket", t.bucket())
        touched = sorted(r["_bucket"] for r in fresh.select("_bucket").distinct().collect())  # as many as there are buckets
        old = [before[t.name, b] for b in touched if (t.name, b) in before]
        if old:
            kept = spark.read.parquet(*old).withColumn("_bucket", t.bucket())
            same = [kept[k].eqNullSafe(fresh[k]) for k in t.key] + [kept["_bucket"] == fresh["_bucket"]]
            fresh = fresh.unionByName(kept.join(fresh, same, "left_anti"), allowMissingColumns=True)
        place = f"{folder}/{t.name}/{batch:020d}-{uuid.uuid4().hex}"
        fresh.repartition("_bucket").write.partitionBy("_bucket").parquet(place)
        now |= {(t.name, b): f"{place}/_bucket={b}" for b in touched}
    listed = [(name, b, path) for (name, b), path in sorted(now.items())]
    spark.createDataFrame(listed, "name string, bucket int, path string").coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest/{batch:020d}")
