"""Incremental state: appends, upserts, snapshots, claims, retention.

Every operator takes the state and what is new as DataFrames and returns the next state, so
that a writer can put it in place atomically; ``now`` is always a parameter.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import uuid5


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def _differs(columns: Sequence[str], old: str = "o", new: str = "n") -> Column:
    tests = [~F.col(f"{new}.{c}").eqNullSafe(F.col(f"{old}.{c}")) for c in columns]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def same_columns(state: DataFrame, rows: DataFrame) -> None:
    if set(state.columns) != set(rows.columns):
        raise ValueError(f"columns differ: {sorted(set(state.columns) ^ set(rows.columns))}")


def latest(rows: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the given order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def insert_ignore(state: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows whose key the state lacks, one for each key; to be appended."""
    return rows.dropDuplicates(list(key)).join(state, list(key), "left_anti").select(*rows.columns)


def upsert(state: DataFrame, rows: DataFrame, key: Sequence[str], stamp: str = "updated_at", now: Column | None = None) -> DataFrame:
    """The next state with change: inserted, updated, same or kept.

    ``stamp`` moves only when some other value is distinct from before, null included. The
    rows must have one row for each key.
    """
    values = [c for c in rows.columns if c not in key and c != stamp]
    now = F.current_timestamp() if now is None else now
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key])
    # Presence marks, since any column may be null.
    joined = state.withColumn("_old", F.lit(True)).alias("o").join(rows.withColumn("_new", F.lit(True)).alias("n"), on, "full")
    old, new = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()
    change = F.when(~old, "inserted").when(~new, "kept").when(_differs(values), "updated").otherwise("same")
    out = [F.when(new, F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in key]
    out += [F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values]
    moved = F.when(change.isin("inserted", "updated"), now).otherwise(F.col(f"o.{stamp}")).alias(stamp)
    return joined.select(*out, moved, change.alias("change"))


def snapshot(state: DataFrame, rows: DataFrame, key: str, misses: str = "missing_count", active: str = "is_active", limit: int = 2) -> DataFrame:
    """Merges a full snapshot: what is present is overwritten and active with no misses.

    What is absent has one more miss and is inactive from ``limit`` misses in a row on.
    """
    values = [c for c in rows.columns if c not in (key, misses, active)]
    joined = state.withColumn("_old", F.lit(True)).alias("o").join(rows.withColumn("_new", F.lit(True)).alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    new = F.col("n._new").isNotNull()
    missed = F.coalesce(F.col(f"o.{misses}"), F.lit(0)) + 1
    return joined.select(
        F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key),
        *[F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values],
        F.when(new, 0).otherwise(missed).alias(misses),
        F.when(new, True).otherwise(F.col(f"o.{active}") & (missed < limit)).alias(active),
    )


def snapshot_faults(rows: DataFrame, key: str, required: Sequence[str], previous_active: int, least: float = 0.9) -> DataFrame:
    """One row of counts and ok: not empty, required values present, keys unique, not much smaller than before."""
    blank = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in required], F.lit(False))
    counts = rows.agg(F.count("*").alias("n_rows"), F.count_if(blank).alias("n_blank"), F.countDistinct(key).alias("n_keys"))
    ok = (F.col("n_rows") > 0) & (F.col("n_blank") == 0) & (F.col("n_keys") == F.col("n_rows")) & (F.col("n_rows") >= least * previous_active)
    return counts.withColumn("ok", ok)


def claim(work: DataFrame, now: Column, limit: int, max_attempts: int = 3) -> DataFrame:
    """The next ``limit`` items to work on, oldest first, as they look once claimed."""
    ready = (F.col("status").isin("pending", "failed")) & (F.col("attempts") < max_attempts) & F.coalesce(F.col("next_retry_at") <= now, F.lit(True))
    chosen = work.where(ready).orderBy(F.col("created_at").asc_nulls_last(), "work_id").limit(limit)
    return chosen.withColumn("status", F.lit("processing")).withColumn("attempts", F.col("attempts") + 1).withColumn("claimed_at", now)


def reclaim(work: DataFrame, now: Column, lease: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Work that has been claimed for longer than the lease is pending again."""
    stale = (F.col("status") == "processing") & (F.col("claimed_at") < now - F.expr(lease))
    return work.withColumn("status", F.when(stale, "pending").otherwise(F.col("status"))).withColumn("claimed_at", F.when(~F.coalesce(stale, F.lit(False)), F.col("claimed_at")))


def expired(rows: DataFrame, deadline: str, days: int, busy: DataFrame, key: str, now: Column, limit: int) -> DataFrame:
    """Rows whose deadline is past by so many days and on which no work is going on, oldest first."""
    past = rows.where(F.col(deadline) + F.make_dt_interval(F.lit(days)) < now)
    return past.join(busy.select(key).distinct(), key, "left_anti").orderBy(F.col(deadline).asc_nulls_last(), key).limit(limit)


def windows(start: str, end: str, days: int, spark) -> DataFrame:
    """Closed windows of so many days from start to end; the last one may be shorter."""
    bounds = spark.range(1).select(F.to_date(F.lit(start)).alias("a"), F.to_date(F.lit(end)).alias("z"))
    each = bounds.select("z", F.explode(F.sequence("a", "z", F.make_dt_interval(F.lit(days)))).alias("window_start"))
    return each.select("window_start", F.least(F.date_add("window_start", days - 1), F.col("z")).alias("window_end"))


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and centre: the smallest node that can be reached, of every node of ``edges`` (a, b) that has another as its smallest.

    Each round first ties what lies above a node to the least of its neighbours, then what lies
    below it, until every node hangs on its centre: some rounds more than the logarithm of the
    longest way. Raises if that takes more than ``rounds``.
    """
    ties = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    before = None
    for _ in range(rounds):
        ends = ties.union(ties.select("low", "high")).toDF("node", "other")
        least = ends.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
        up = ends.where("other > node").join(least, "node").select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()
        lowest = up.groupBy("high").agg(F.min("low").alias("least"))
        across = up.join(lowest, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        ties = checkpointed(across.union(lowest.select("high", F.col("least").alias("low"))).distinct())
        now = ties.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == before:
            return ties.select(F.col("high").alias("node"), F.col("low").alias("centre"))
        before = now
    raise RuntimeError("stars did not settle")


def covered(rows: DataFrame, group: str, failed: Column, links: Sequence[str], key: str, rounds: int = 60) -> DataFrame:
    """Failed rows that some row of their group, not failed, covers over shared values of ``links``, directly or through others.

    The values of a row are tied to each other, and what hangs on one centre is covered if some
    row of it hasn't failed. Null values tie nothing; the null group is a group.
    """
    values = F.array_compact(F.array(*[F.when(F.col(link).isNotNull(), F.to_json(F.struct(F.col(group).alias("g"), F.lit(i).alias("i"), F.col(link).alias("v")))) for i, link in enumerate(links)]))
    own = checkpointed(rows.select(group, key, failed.alias("_failed"), values.alias("_values")).where(F.size("_values") > 0))
    first = F.get("_values", F.lit(0))
    edges = own.where(F.size("_values") > 1).select(first.alias("a"), F.explode(F.slice("_values", 2, len(links))).alias("b")).distinct()
    placed = own.select(group, key, "_failed", first.alias("node")).join(stars(edges, rounds), "node", "left").withColumn("centre", F.coalesce("centre", "node"))
    alive = placed.where(~F.col("_failed")).select("centre").distinct()
    return placed.where("_failed").join(alive, "centre", "left_semi").select(group, key)


def advanced(checkpoints: DataFrame, rows: DataFrame, now: Column, key: str = "pipeline_id") -> DataFrame:
    """The next checkpoints: what is given replaces what was there, without comparing cursors; others stay.

    To be called only after a load has succeeded.
    """
    fresh = rows.withColumn("updated_at", now).select(*checkpoints.columns)
    return checkpoints.join(fresh.select(key), key, "left_anti").select(*checkpoints.columns).union(fresh)


def runs(started: DataFrame, finished: DataFrame, key: str = "execution_id") -> DataFrame:
    """Runs with their status: running, or completed or failed as ``finished`` (key, finished_at, error, counts) says; errors are cut at 500 characters."""
    ended = finished.withColumn("error", F.left("error", F.lit(500)))
    status = F.when(F.col("finished_at").isNull(), "running").when(F.col("error").isNotNull(), "failed").otherwise("completed")
    return started.join(ended, key, "left").withColumn("status", status)


def without_nul(value: Column, kind: T.DataType) -> Column:
    """A value with a space for each NUL character in its texts, however deep they lie."""
    if isinstance(kind, T.StringType):
        return F.replace(value, F.lit("\x00"), F.lit(" "))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_nul(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _k, x: without_nul(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[without_nul(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def cleaned(df: DataFrame) -> DataFrame:
    """All columns without NUL characters."""
    return df.select(*[without_nul(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _identified(extractions: DataFrame, done: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Trees that are not done yet with their ids, and their requirements (r) with theirs."""
    fresh = cleaned(extractions).dropDuplicates(["notice_id", "fingerprint"])
    if done is not None:
        seen = done.groupBy("notice_id").agg(F.collect_set("fingerprint").alias("_seen"))
        fresh = fresh.join(seen, "notice_id", "left").where(~F.coalesce(F.array_contains("_seen", F.col("fingerprint")), F.lit(False))).drop("_seen")
    named = fresh.withColumn("extraction_id", uuid5(F.concat_ws(":", F.lit("extraction"), F.col("notice_id").cast("string"), "fingerprint")))
    needs = named.select("extraction_id", F.explode("requirements").alias("r"))
    needs = needs.withColumn("requirement_id", uuid5(F.concat_ws(":", F.lit("requirement"), "extraction_id", "r.id")))
    return named, needs


def extraction_tables(extractions: DataFrame, done: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six relations of extraction trees, with ids that follow from what they stand for.

    ``extractions`` has notice_id, fingerprint, expression, unresolved, and requirements: an
    array of structs of id, text, evidence (structs of source_id and excerpt) and proofs
    (structs of id, document_type and evidence). Those whose notice_id and fingerprint are
    among ``done`` are left out, so that a repeated load adds nothing. Trees and
    what is done, if both are partitioned by notice_id over as many tasks, are not moved.
    """
    named, needs = _identified(extractions, done)
    proofs = needs.select("requirement_id", F.explode("r.proofs").alias("p")).withColumn("proof_id", uuid5(F.concat_ws(":", F.lit("proof"), "requirement_id", "p.id")))

    def evidence(rows: DataFrame, owner: str, items: str) -> DataFrame:
        each = rows.select(owner, F.posexplode(items).alias("place", "e"))
        return each.select(uuid5(F.concat_ws(":", F.lit("evidence"), owner, F.col("place").cast("string"))).alias("evidence_id"), owner, "e.*")

    return {
        "extractions": named.select("extraction_id", "notice_id", "fingerprint", F.lit("completed").alias("status")),
        "requirement_sets": named.select("extraction_id", "expression", "unresolved"),
        "requirements": needs.select("requirement_id", "extraction_id", F.col("r.id").alias("local_id"), F.col("r.text").alias("text")),
        "evidence": evidence(needs, "requirement_id", "r.evidence"),
        "proofs": proofs.select("proof_id", "requirement_id", F.col("p.id").alias("local_id"), F.col("p.document_type").alias("document_type")),
        "proof_evidence": evidence(proofs, "proof_id", "p.evidence"),
    }


def extraction_nodes(extractions: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """relation, id and parent of all extractions, requirements and proofs, as ``extraction_tables`` has them.

    Trees are made once for requirements and proofs together; a union of the relations makes them once for each.
    """
    named, needs = _identified(extractions, done)
    own = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit(False).alias("proof")))
    proofs = F.transform("r.proofs", lambda p: F.struct(p["id"].cast("string").alias("id"), F.lit(True).alias("proof")))
    each = needs.select("extraction_id", "requirement_id", F.explode(F.coalesce(F.concat(own, proofs), own)).alias("p"))
    proof_id = uuid5(F.concat_ws(":", F.lit("proof"), "requirement_id", "p.id"))
    pick = lambda yes, no: F.when(F.col("p.proof"), yes).otherwise(no)
    under = each.select(pick(F.lit("proofs"), F.lit("requirements")).alias("relation"), pick(proof_id, F.col("requirement_id")).alias("id"), pick(F.col("requirement_id"), F.col("extraction_id")).alias("parent"))
    return named.select(F.lit("extractions").alias("relation"), F.col("extraction_id").alias("id"), F.lit(None).cast("string").alias("parent")).union(under)


def failures(inputs: DataFrame, error: str = "error") -> DataFrame:
    """Rows of failed work: the error cut at 500 characters, status failed, to be reviewed."""
    return inputs.withColumns({error: F.left(error, F.lit(500)), "status": F.lit("failed"), "requires_review": F.lit(True)})


def purge_claimed(documents: DataFrame, chosen: DataFrame, key: str, now: Column) -> DataFrame:
    """The documents with those chosen marked as being purged, one attempt more."""
    marked = documents.join(chosen.select(key).distinct().withColumn("_chosen", F.lit(True)), key, "left")
    mine = F.col("_chosen").isNotNull()
    return marked.withColumns({
        "storage_status": F.when(mine, "purging").otherwise(F.col("storage_status")), "purge_attempts": F.col("purge_attempts") + mine.cast("int"),
        "purge_error": F.when(~mine, F.col("purge_error")), "updated_at": F.when(mine, now).otherwise(F.col("updated_at")),
    }).drop("_chosen")


def purge_finished(documents: DataFrame, results: DataFrame, key: str, now: Column) -> DataFrame:
    """The documents after a purge: ``results`` has key and error, null where the object is gone."""
    joined = documents.join(results.select(key, F.col("error").alias("_error"), F.lit(True).alias("_done")), key, "left")
    done, bad = F.col("_done").isNotNull(), F.col("_error").isNotNull()
    good = done & ~bad
    return joined.withColumns({
        "storage_status": F.when(good, "purged").when(done, "purge_failed").otherwise(F.col("storage_status")), "object_key": F.when(~good, F.col("object_key")),
        "purge_error": F.when(done, F.col("_error")).otherwise(F.col("purge_error")), "purge_reason": F.when(good, "retention_expired").otherwise(F.col("purge_reason")),
        "updated_at": F.when(done, now).otherwise(F.col("updated_at")),
    }).drop("_error", "_done")


def purge_audit(results: DataFrame, days: int) -> DataFrame:
    """One row of counts of a purge."""
    return results.agg(F.lit(days).alias("retention_days"), F.count("*").alias("target_count"), F.count_if(F.col("error").isNull()).alias("purged_count"), F.count_if(F.col("error").isNotNull()).alias("failed_count"))
