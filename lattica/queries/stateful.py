"""Loads that keep state: windows, appends, upserts, snapshots, claims, retention, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_id
from ..operators import state
from ..streaming.incremental import lookback
from .registry import query, table


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as they were, and a batch of new and changed ones."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("note"), "o_orderdate")
    old = o.where("o_orderdate < timestamp_ntz'1999-06-01'").drop("o_orderdate").withColumn("updated_at", F.lit("2024-01-01"))
    changed = F.when(F.col("o_totalprice") > 250000, F.lit("X")).otherwise(F.col("o_orderstatus"))
    new = o.where("o_orderdate >= timestamp_ntz'1997-03-01'").drop("o_orderdate").withColumn("o_orderstatus", changed).withColumn("note", F.when(F.col("note") != "3-MEDIUM", F.col("note"))).withColumn("updated_at", F.lit("2024-02-01"))
    return old, new


_VERSIONS = """
WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS note, o_orderdate FROM orders),
old AS (SELECT * EXCLUDE (o_orderdate), '2024-01-01' AS updated_at FROM o WHERE o_orderdate < TIMESTAMP '1999-06-01'),
new AS (SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice,
  CASE WHEN note <> '3-MEDIUM' THEN note END AS note FROM o WHERE o_orderdate >= TIMESTAMP '1997-03-01')
"""


@query(_VERSIONS + """
SELECT coalesce(n.o_orderkey, p.o_orderkey) AS o_orderkey,
  CASE WHEN n.o_orderkey IS NULL THEN p.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus,
  CASE WHEN n.o_orderkey IS NULL THEN p.o_totalprice ELSE n.o_totalprice END AS o_totalprice,
  CASE WHEN n.o_orderkey IS NULL THEN p.note ELSE n.note END AS note,
  CASE WHEN n.o_orderkey IS NULL THEN 'kept' WHEN p.o_orderkey IS NULL THEN 'inserted'
    WHEN n.o_orderstatus IS DISTINCT FROM p.o_orderstatus OR n.o_totalprice IS DISTINCT FROM p.o_totalprice OR n.note IS DISTINCT FROM p.note THEN 'updated' ELSE 'same' END AS change,
  CASE WHEN change IN ('inserted', 'updated') THEN '2024-02-02' ELSE p.updated_at END AS updated_at
FROM old p FULL JOIN new n ON n.o_orderkey = p.o_orderkey
""")
def upsert_changed(spark: SparkSession, folder: str) -> DataFrame:
    """A keyed upsert whose stamp moves only when a value changed."""
    old, new = _versions(spark, folder)
    state.same_columns(old, new)
    return state.upsert(old, new, ["o_orderkey"], "updated_at", F.lit("2024-02-02"))


@query(_VERSIONS + "SELECT n.o_orderkey, n.o_orderstatus, n.o_totalprice, n.note, '2024-02-01' AS updated_at FROM new n WHERE NOT EXISTS (SELECT 1 FROM old p WHERE p.o_orderkey = n.o_orderkey)")
def insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    """Only what the state lacks is appended."""
    old, new = _versions(spark, folder)
    return state.insert_ignore(old, new, ["o_orderkey"])


@query("""
WITH h AS (SELECT o_orderkey, sha256(o_orderstatus || '|' || o_orderpriority) AS old_hash, o_orderpriority <> '1-URGENT' AS enriched,
  sha256((CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END) || '|' || o_orderpriority) AS new_hash FROM orders)
SELECT o_orderkey, CASE WHEN old_hash <> new_hash THEN 'hash' ELSE 'never_enriched' END AS reason FROM h WHERE old_hash <> new_hash OR NOT enriched
""")
def changed_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys whose hash differs, or that were never enriched."""
    o = table(spark, folder, "orders")
    hashed = lambda status: F.sha2(F.concat_ws("|", status, F.col("o_orderpriority")), 256)
    new_status = F.when(F.col("o_totalprice") > 300000, F.lit("X")).otherwise(F.col("o_orderstatus"))
    h = o.select("o_orderkey", hashed(F.col("o_orderstatus")).alias("a"), hashed(new_status).alias("b"), (F.col("o_orderpriority") != "1-URGENT").alias("enriched"))
    return h.where("a <> b or not enriched").select("o_orderkey", F.when(F.col("a") != F.col("b"), "hash").otherwise("never_enriched").alias("reason"))


@query("""
WITH p AS (SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-01-01' AS checked FROM orders WHERE o_orderstatus = 'F'),
c AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
SELECT o_orderkey, checked OR l_orderkey IS NOT NULL AS checked FROM p LEFT JOIN c ON l_orderkey = o_orderkey
""")
def mark_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Parents whose children have been loaded are marked."""
    p = table(spark, folder, "orders").where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).alias("checked"))
    c = table(spark, folder, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("loaded", F.lit(True))
    return p.join(c, "o_orderkey", "left").select("o_orderkey", (F.col("checked") | F.coalesce("loaded", F.lit(False))).alias("checked"))


@query("""
WITH s0 AS (SELECT s_suppkey, s_name, CAST(floor(abs(s_acctbal) / 3000) AS INTEGER) AS missing_count, abs(s_acctbal) < 6000 AS is_active FROM supplier WHERE s_nationkey < 20),
n AS (SELECT s_suppkey, s_name || '*' AS s_name FROM supplier WHERE s_nationkey >= 6)
SELECT coalesce(n.s_suppkey, s0.s_suppkey) AS s_suppkey, CASE WHEN n.s_suppkey IS NOT NULL THEN n.s_name ELSE s0.s_name END AS s_name,
  CASE WHEN n.s_suppkey IS NOT NULL THEN 0 ELSE s0.missing_count + 1 END AS missing_count,
  CASE WHEN n.s_suppkey IS NOT NULL THEN true ELSE s0.is_active AND s0.missing_count + 1 < 2 END AS is_active
FROM s0 FULL JOIN n ON n.s_suppkey = s0.s_suppkey
""")
def snapshot_soft_delete(spark: SparkSession, folder: str) -> DataFrame:
    """What a snapshot lacks twice in a row becomes inactive."""
    s = table(spark, folder, "supplier")
    misses = F.floor(F.abs("s_acctbal") / 3000).cast("int")
    old = s.where("s_nationkey < 20").select("s_suppkey", "s_name", misses.alias("missing_count"), (F.abs("s_acctbal") < 6000).alias("is_active"))
    new = s.where("s_nationkey >= 6").select("s_suppkey", F.concat("s_name", F.lit("*")).alias("s_name"))
    return state.snapshot(old, new, "s_suppkey")


@query("""
SELECT count(*) AS n_rows, count(*) FILTER (s_name IS NULL OR trim(s_name) = '') AS n_blank, count(DISTINCT s_suppkey) AS n_keys,
  count(*) > 0 AND n_blank = 0 AND n_keys = count(*) AND count(*) >= 0.9 * 5 AS ok FROM supplier
""")
def snapshot_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a snapshot is safe to merge."""
    return state.snapshot_faults(table(spark, folder, "supplier"), "s_suppkey", ["s_name"], 5)


@query("""
WITH m AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS z FROM events)
SELECT w::DATE AS window_start, least(w::DATE + 2, z)::DATE AS window_end, count(event_id) AS n
FROM m, generate_series(a, z, INTERVAL 3 DAY) AS g(w) LEFT JOIN events ON ts::DATE BETWEEN w::DATE AND least(w::DATE + 2, z) GROUP BY ALL
""")
def daily_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Closed windows of three days over a range, with the rows of each."""
    e = table(spark, folder, "events")
    m = e.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("z"))
    w = m.select("z", F.explode(F.expr("sequence(a, z, interval 3 days)")).alias("window_start")).select("window_start", F.least(F.date_add("window_start", 2), "z").alias("window_end"))
    by_day = e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return w.join(by_day, F.col("day").between(F.col("window_start"), F.col("window_end")), "left").groupBy("window_start", "window_end").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("SELECT event_id FROM events WHERE ts::DATE BETWEEN DATE '2024-01-10' - 6 AND DATE '2024-01-10'")
def lookback_window(spark: SparkSession, folder: str) -> DataFrame:
    """The days that are read again, today included."""
    return lookback(table(spark, folder, "events"), "ts", 7, "2024-01-10").select("event_id")


@query("""
SELECT event_id, 'processing' AS status, CAST(floor(value / 20) AS BIGINT) + 1 AS attempts FROM events
WHERE event_type IN ('click', 'error') AND floor(value / 20) < 3 AND (value < 5 OR ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20')
ORDER BY ts, event_id LIMIT 100
""")
def claim_next(spark: SparkSession, folder: str) -> DataFrame:
    """The next hundred pieces of work whose time has come, oldest first."""
    e = table(spark, folder, "events")
    work = e.select(
        F.col("event_id").alias("work_id"), F.when(F.col("event_type").isin("click"), "pending").when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"),
        F.floor(F.col("value") / 20).alias("attempts"), F.when(F.col("value") >= 5, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("next_retry_at"), F.col("ts").alias("created_at"),
    )
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    return state.claim(work, now, 100).select(F.col("work_id").alias("event_id"), "status", "attempts")


@query("""
SELECT event_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 1 HOUR THEN 'pending' WHEN event_type = 'click' THEN 'processing' ELSE 'done' END AS status FROM events
""")
def reclaim_stale(spark: SparkSession, folder: str) -> DataFrame:
    """Claims older than their lease are given back."""
    work = table(spark, folder, "events").select("event_id", F.when(F.col("event_type") == "click", "processing").otherwise("done").alias("status"), F.col("ts").alias("claimed_at"))
    return state.reclaim(work, F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id", "status")


@query("""
SELECT event_id, ts FROM events WHERE ts + INTERVAL 10 DAY < TIMESTAMP '2024-01-25'
  AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60) ORDER BY ts, event_id LIMIT 500
""")
def retention(spark: SparkSession, folder: str) -> DataFrame:
    """What is past its time and not worked on."""
    e = table(spark, folder, "events")
    busy = e.where("event_type = 'error' and value > 60").select("user_id").distinct()
    past = e.where(F.col("ts") + F.make_dt_interval(F.lit(10)) < F.lit("2024-01-25").cast("timestamp_ntz"))
    return past.join(busy, "user_id", "left_anti").orderBy("ts", "event_id").limit(500).select("event_id", "ts")


@query("""
SELECT doc_id, sha256('{"lang":"' || lang || '","source":"' || source || '","text":"' || sha256(text) || '"}') AS fingerprint FROM documents
""")
def input_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """A hash of the canonical JSON of what a computation reads."""
    return table(spark, folder, "documents").select("doc_id", content_id({"text": F.sha2("text", 256), "lang": F.col("lang"), "source": F.col("source")}).alias("fingerprint"))


@query("""
WITH f AS (SELECT doc_id, source, sha256(text) AS fp FROM documents), done AS (SELECT DISTINCT fp FROM f WHERE source = 'src1')
SELECT doc_id FROM f WHERE fp NOT IN (SELECT fp FROM done)
""")
def not_yet_done(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs whose fingerprint has no result yet."""
    f = table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("fp"))
    return f.join(f.where("source = 'src1'").select("fp").distinct(), "fp", "left_anti").select("doc_id")


@query("""
SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each key."""
    return state.latest(table(spark, folder, "events"), ["user_id"], F.col("ts").desc_nulls_last(), F.col("event_id").desc()).select("user_id", "event_id", "event_type")


@query("SELECT event_type, arg_min(event_id, event_id) AS event_id, arg_min(user_id, event_id) AS user_id FROM events GROUP BY 1")
def first_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of each key, by an aggregate, since few keys hold all rows."""
    return table(spark, folder, "events").groupBy("event_type").agg(F.min("event_id").alias("event_id"), F.min_by("user_id", "event_id").alias("user_id"))


@query("""
WITH RECURSIVE d AS (SELECT doc_id, lang AS notice, sha256(text) AS checksum, left(text, 6) AS stem, source < 'src3' AS failed FROM documents),
c(doc_id) AS (SELECT doc_id FROM d WHERE NOT failed UNION
  SELECT x.doc_id FROM c JOIN d y ON y.doc_id = c.doc_id JOIN d x ON x.notice = y.notice AND (x.stem = y.stem OR x.checksum = y.checksum))
SELECT doc_id FROM c JOIN d USING (doc_id) WHERE failed
""")
def coverage_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Failed documents that a parsed one covers over checksum or stem, also through others."""
    d = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("notice"), F.sha2("text", 256).alias("checksum"), F.left("text", F.lit(6)).alias("stem"), "source")
    return state.covered(d, "notice", F.col("source") < "src3", ["checksum", "stem"], "doc_id").select("doc_id")


@query("""
SELECT user_id, count(*) AS n_rows, count(*) FILTER (event_type = 'error') AS n_failed, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, left(string_agg(event_type, '' ORDER BY event_id), 500) AS log
FROM events GROUP BY 1
""")
def load_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The sums of each load, its log cut at five hundred characters."""
    log = F.left(F.expr("listagg(event_type, '') WITHIN GROUP (ORDER BY event_id)"), F.lit(500))
    return table(spark, folder, "events").groupBy("user_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("event_type") == "error").alias("n_failed"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), log.alias("log")
    )
