"""Leases that expire by timers alone, and loads that touch some buckets of several tables."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from lattica.streaming import bucketed, leases

STORE = "spark.sql.streaming.stateStore.providerClass"


def test_leases_expire_without_new_input(spark, tmp_path):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, n = "work_id long, event string, at long", iter(range(100))

    def arrive(*events):
        spark.createDataFrame([(w, e, next(n)) for w, e in events], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    arrive((1, "claimed"), (2, "claimed"), (2, "claimed"), (3, "claimed"), (3, "unsupported"), (4, "claimed"), (4, "done"), (5, "failed"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = leases.leases(stream, lease_ms=2000, retry_ms=1000, attempts=2)
    query = out.writeStream.format("memory").queryName("leases").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).start()

    def said(work, reasons, within=90):
        until = time.time() + within
        while time.time() < until:
            query.exception() and pytest.fail(str(query.exception()))
            found = [(r["reason"], r["status"], r["attempts"]) for r in spark.sql(f"select * from leases where work_id = {work}").collect()]
            if {r for r, _, _ in found} >= set(reasons):
                return found
            time.sleep(1)
        pytest.fail(f"{work}: {found}")

    try:
        assert ("lease_expired", "pending", 1) in said(1, ["claimed", "lease_expired"])  # no event after the claim
        assert [r[0] for r in said(2, ["ignored", "lease_expired"])][:2] == ["claimed", "ignored"]
        assert said(3, ["unsupported"])[-1] == ("unsupported", "unsupported", 1) and said(4, ["done"])[-1] == ("done", "done", 1) and said(5, ["ignored"]) == [("ignored", "pending", 0)]
        arrive((1, "claimed"), (1, "failed"), (2, "claimed"), (2, "failed"), (3, "claimed"), (6, "claimed"), (6, "failed"))
        assert ("attempts_used_up", "given_up", 2) in said(1, ["attempts_used_up"]) and ("attempts_used_up", "given_up", 2) in said(2, ["attempts_used_up"])
        assert said(3, ["ignored"])[-1] == ("ignored", "unsupported", 1)
        assert ("retry_due", "retry", 1) in said(6, ["failed", "retry_due"])
    finally:
        query.stop()
        spark.conf.unset(STORE)


PARENT, CHILD = bucketed.Bucketed("parent", ["id"], "at", 8), bucketed.Bucketed("child", ["id", "n"], "at", 4)


def test_batches_touch_their_buckets_and_show_tables_together(spark, tmp_path):
    folder = str(tmp_path / "load")
    parents = spark.range(100).select("id", F.lit(1).alias("at"), F.lit("old").alias("v"))
    children = parents.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), "at", "v")
    assert bucketed.read(spark, folder, "parent") is None
    bucketed.load(spark, folder, 0, {"parent": parents, "child": children}, [PARENT, CHILD])
    before = bucketed.manifest(spark, folder)
    assert len(before) == 12 and bucketed.read(spark, folder, "child").count() == 200
    more = spark.createDataFrame([(7, 2, "new"), (7, 3, "newest"), (7, 1, "late"), (None, 1, "none")], "id long, at int, v string")
    bucketed.load(spark, folder, 1, {"parent": more}, [PARENT, CHILD])
    after = bucketed.manifest(spark, folder)
    changed = {k for k in after if after[k] != before[k]}
    assert {name for name, _ in changed} == {"parent"} and len(changed) <= 2
    got = {r["id"]: r["v"] for r in bucketed.read(spark, folder, "parent").collect()}
    assert len(got) == 101 and got[7] == "newest" and got[None] == "none" and got[8] == "old"
    files = sorted(glob.glob(f"{folder}/**/*.parquet", recursive=True))
    bucketed.load(spark, folder, 1, {"parent": parents}, [PARENT, CHILD])  # run again: nothing happens
    assert sorted(glob.glob(f"{folder}/**/*.parquet", recursive=True)) == files
    bad = parents.select("id", "at", F.when(F.col("id") == 50, F.raise_error(F.lit("stop"))).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="stop"):
        bucketed.load(spark, folder, 2, {"parent": more, "child": bad.withColumn("n", F.lit(1))}, [PARENT, CHILD])
    assert bucketed.manifest(spark, folder) == after and os.path.exists(folder)
