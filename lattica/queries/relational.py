"""Scans, filters, joins, aggregates, order and sets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.match import contains_either, squeezed, valid_on
from ..operators.relation import Filter, Page, Query, Relation, Search, Sort, restricted, roots_page, run, totals
from .registry import query, table

ORDERS = Relation("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), ("o_orderkey",))
CUSTOMER = Relation("customer", ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), ("c_custkey",))
LINES = Relation("lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag"), ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
YEAR = Query((Filter("o_orderdate", "gte", datetime(1997, 1, 1)), Filter("o_orderdate", "lte", datetime(1997, 12, 31))))


def money(c: str | Column) -> Column:
    return F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31'
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 20
""")
def scan_filter_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of a filtered relation, newest first."""
    q = Query(YEAR.filters, order_by=[Sort("o_orderdate", "desc", "last")], page=Page(2, 20))
    return run(ORDERS.scan(spark, folder), ORDERS, q)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def unpaginated_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Without pages a query stops at a thousand rows in the order of the key."""
    return run(ORDERS.scan(spark, folder), ORDERS, Query()).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(r"""
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE c_mktsegment ILIKE '%chin%' ESCAPE '\' OR c_name ILIKE '%chin%' ESCAPE '\' ORDER BY c_custkey LIMIT 1000
""")
def search_many_fields(spark: SparkSession, folder: str) -> DataFrame:
    """One of several fields contains a text, in either case."""
    df = CUSTOMER.scan(spark, folder)
    q = Query(search=Search(("c_mktsegment", "c_name"), "CHIN"))
    return run(df, CUSTOMER, q).select("c_custkey", "c_name", "c_mktsegment")


@query(r"""
SELECT doc_id FROM documents WHERE text ILIKE '%\%\%\%%' ESCAPE '\' OR source ILIKE '%\_%' ESCAPE '\'
""")
def search_escaped(spark: SparkSession, folder: str) -> DataFrame:
    """Signs of patterns in the searched text stand for themselves."""
    r = Relation("documents", ("doc_id", "text", "source"), ("doc_id",))
    found = [restricted(r.scan(spark, folder), r, Query(search=Search((f,), v))).select("doc_id") for f, v in (("text", "%%%"), ("source", "_"))]
    return found[0].union(found[1]).distinct()


@query("""
SELECT count(DISTINCT l_orderkey) AS total_items, CAST(ceil(count(DISTINCT l_orderkey) / 20.0) AS BIGINT) AS total_pages
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'
""")
def pagination_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals count distinct roots."""
    return totals(LINES.scan(spark, folder), LINES, Query((Filter("l_shipdate", "gte", datetime(1998, 1, 1)),), page=Page(1, 20, "l_orderkey")))


@query("""
WITH roots AS (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY l_orderkey LIMIT 20 OFFSET 40)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM roots)
""")
def page_of_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of whole roots, so that rows and totals agree."""
    return roots_page(LINES.scan(spark, folder), LINES, Query(page=Page(3, 20, "l_orderkey"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("""
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL AND (o_totalprice > 400000) IS TRUE AND coalesce(o_orderpriority, '') ILIKE '%high%'
""")
def optional_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Filters that are only there when asked for."""
    wanted = {"status": "F", "priced": True, "large": True, "priority": "high"}
    df = ORDERS.scan(spark, folder)
    if (status := wanted.get("status")) is not None:
        df = df.where(F.col("o_orderstatus") == status)
    if (priced := wanted.get("priced")) is not None:
        df = df.where(F.col("o_totalprice").isNotNull() if priced else F.col("o_totalprice").isNull())
    if (large := wanted.get("large")) is not None:
        df = df.where((F.col("o_totalprice") > 400000).eqNullSafe(F.lit(large)))
    if wanted.get("priority"):
        df = df.where(F.coalesce("o_orderpriority", F.lit("")).ilike(f"%{wanted['priority']}%"))
    return df.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE (l_partkey, l_suppkey) IN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)
""")
def tuple_in(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that are in a list of pairs."""
    lines = table(spark, folder, "lineitem")
    pairs = lines.where("l_quantity = 50 and l_discount = 0.1").select("l_partkey", "l_suppkey").distinct()
    return lines.join(pairs, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("""
SELECT c_custkey, c_mktsegment FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000) OR c_nationkey IN (1, 2)
""")
def semi_exists(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a match in another table, or a plain condition."""
    rich = table(spark, folder, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("rich", F.lit(True))
    return table(spark, folder, "customer").join(rich, "c_custkey", "left").where("rich or c_nationkey in (1, 2)").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus <> 'F')")
def anti_not_exists(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without unfinished work."""
    open_orders = table(spark, folder, "orders").where("o_orderstatus <> 'F'")
    c = table(spark, folder, "customer")
    return c.join(open_orders, c["c_custkey"] == open_orders["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query("""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS n_numbers FROM documents
WHERE regexp_matches(text, '[0-9]{3}') AND NOT regexp_matches(text, '(^|[^a-z])token[^a-z]')
""")
def regex_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Matching, not matching and counting patterns."""
    d = table(spark, folder, "documents")
    return d.where(F.col("text").rlike("[0-9]{3}") & ~F.col("text").rlike("(^|[^a-z])token[^a-z]")).select("doc_id", F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("n_numbers"))


@query("""
SELECT doc_id, nullif(regexp_extract(text, '\\+1 \\(([0-9]{3})\\)', 1), '') AS area FROM documents
""".replace("\\\\", "\\"))
def captured_text(spark: SparkSession, folder: str) -> DataFrame:
    """The first capture, null where there is none."""
    return table(spark, folder, "documents").select("doc_id", F.nullif(F.regexp_extract("text", r"\+1 \(([0-9]{3})\)", 1), F.lit("")).alias("area"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_shipdate > TIMESTAMP '2000-06-01' THEN 'scheduled'
  WHEN l_shipdate + INTERVAL 30 DAY >= TIMESTAMP '2000-06-01' THEN 'open' ELSE 'closed' END AS status, l_orderkey || ':' || l_linenumber AS line_id
FROM lineitem
""")
def status_case(spark: SparkSession, folder: str) -> DataFrame:
    """A status from two times and a given now; an id put together."""
    now = F.lit("2000-06-01").cast("timestamp_ntz")
    end = F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS")
    status = F.when(F.col("l_shipdate") > now, "scheduled").when(end >= now, "open").otherwise("closed")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.alias("status"), F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("line_id"))


@query("""
SELECT n_nationkey, n_name, CASE r_name WHEN 'AFRICA' THEN '01' WHEN 'AMERICA' THEN '02' WHEN 'ASIA' THEN '03' WHEN 'EUROPE' THEN '04' ELSE NULL END AS region_code
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
""")
def code_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of names by a fixed table, unknown names null."""
    from ..functions.codecs import coded

    codes = {"AFRICA": "01", "AMERICA": "02", "ASIA": "03", "EUROPE": "04"}
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("n_nationkey", "n_name", coded(F.col("r_name"), {v: k for v, k in codes.items()}).alias("region_code"))


@query("""
SELECT 'discount_range' AS rule, count(*) AS n_broken FROM lineitem WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.09, false)
UNION ALL SELECT 'flag_known', count(*) FROM lineitem WHERE NOT coalesce(l_returnflag IN ('A', 'N'), false)
UNION ALL SELECT 'status_known', count(*) FROM lineitem WHERE NOT coalesce(l_linestatus IN ('O', 'F'), false)
""")
def check_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """C14: how many rows break each declared constraint, in one pass."""
    rules = {"discount_range": F.col("l_discount").between(0, 0.09), "flag_known": F.col("l_returnflag").isin("A", "N"), "status_known": F.col("l_linestatus").isin("O", "F")}
    counts = table(spark, folder, "lineitem").agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(r) for r, ok in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n_broken")) for r in rules])).alias("x")).select("x.*")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE coalesce(l_shipdate <= TIMESTAMP '1999-03-01', true)
  AND coalesce(TIMESTAMP '1999-03-01' <= CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_shipdate + INTERVAL 60 DAY END, true)
""")
def validity_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Periods that hold a day, a null end being open."""
    day = F.lit("1999-03-01").cast("timestamp_ntz")
    until = F.when(F.col("l_returnflag") != "N", F.col("l_shipdate") + F.expr("INTERVAL 60 DAYS"))
    return table(spark, folder, "lineitem").where(valid_on(F.col("l_shipdate"), until, day)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
WITH p AS (SELECT DISTINCT p_name, lower(regexp_replace(p_name, '[\\s\\-_,./()]', '', 'g')) AS x FROM part),
w AS (SELECT DISTINCT lower(regexp_replace(p_type, '[\\s\\-_,./()]', '', 'g')) AS y, p_type FROM part
  UNION SELECT 'ring', 'RI-NG' UNION SELECT 'smallringbox', 'small (ring) box')
SELECT p_name, p_type AS wanted FROM p JOIN w ON x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x))
""".replace("\\\\", "\\"))
def containment_match(spark: SparkSession, folder: str) -> DataFrame:
    """Names that contain each other once squeezed, distinct names against a fixed short list."""
    p = table(spark, folder, "part")
    extra = spark.range(1).select(F.explode(F.array(F.lit("RI-NG"), F.lit("small (ring) box"))).alias("wanted"))
    wanted = p.select(F.col("p_type").alias("wanted")).union(extra).distinct()
    names = p.select("p_name").distinct()
    return names.join(wanted, contains_either(F.col("p_name"), F.col("wanted"))).select("p_name", "wanted")


@query("""
SELECT r_name, n_name, c_mktsegment, count(*) AS n_lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY ALL
""")
def join_chain(spark: SparkSession, folder: str) -> DataFrame:
    """A chain of inner joins, summed by small dimensions."""
    line, o, c, n, r = (table(spark, folder, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    joined = line.join(o.where("o_orderdate >= timestamp_ntz'1998-01-01'"), line["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    joined = joined.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n_lines"), F.sum(money("l_extendedprice")).cast("double").alias("revenue"))


@query("""
WITH last AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1)
SELECT c_custkey, c_name, o_orderkey, o_orderdate, n_name FROM customer LEFT JOIN last ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
""")
def left_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with their latest child and a dimension, kept without them too."""
    from ..operators.state import latest

    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    last = latest(table(spark, folder, "orders"), ["o_custkey"], F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc())
    return c.join(last, c["c_custkey"] == last["o_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("c_custkey", "c_name", "o_orderkey", "o_orderdate", "n_name")


@query("""
WITH a AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags,
    string_agg(l_linenumber || concat_ws('/', '', l_linestatus), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY 1),
b AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(*) AS n_events FROM events GROUP BY 1)
SELECT o_orderkey, flags, lines, kinds, coalesce(n_events, 0) AS n_events FROM orders LEFT JOIN a ON l_orderkey = o_orderkey LEFT JOIN b ON user_id = o_custkey
""")
def fanout_preaggregated(spark: SparkSession, folder: str) -> DataFrame:
    """Two children of a row, each put together before the join, so that none multiplies the other."""
    o = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem").withColumn("_t", F.concat(F.col("l_linenumber").cast("string"), F.concat_ws("/", F.lit(""), F.col("l_linestatus"))))
    a = lines.groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"),
        F.expr("listagg(_t, ' ') WITHIN GROUP (ORDER BY struct(l_linenumber, l_partkey, l_suppkey))").alias("lines"),
    )
    b = table(spark, folder, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"), F.count("*").alias("n_events"))
    return o.join(a, o["o_orderkey"] == a["l_orderkey"], "left").join(b, o["o_custkey"] == b["user_id"], "left").select("o_orderkey", "flags", "lines", "kinds", F.coalesce("n_events", F.lit(0)).alias("n_events"))


@query("""
WITH k AS (SELECT lower(regexp_replace(p_name, '[\\s\\-_,./()]', '', 'g')) AS key, min(p_partkey) AS code FROM part WHERE p_size > 2 GROUP BY 1 HAVING count(*) <= 40)
SELECT p_partkey, p_name, code FROM part JOIN k ON k.key = lower(regexp_replace(p_name, '[\\s\\-_,./()]', '', 'g')) WHERE p_brand = 'Brand#7'
""".replace("\\\\", "\\"))
def normalized_key_join(spark: SparkSession, folder: str) -> DataFrame:
    """A join on normalised names, with keys that occur seldom enough to be resolved."""
    p = table(spark, folder, "part")
    k = p.where("p_size > 2").groupBy(squeezed(F.col("p_name")).alias("key")).agg(F.min("p_partkey").alias("code"), F.count("*").alias("n")).where("n <= 40")
    left = p.where("p_brand = 'Brand#7'").withColumn("key", squeezed(F.col("p_name")))
    return left.join(k, "key").select("p_partkey", "p_name", "code")


@query("""
SELECT doc_id, sha256(text) AS checksum FROM documents d WHERE source < 'src3'
AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.source >= 'src3' AND sha256(e.text) = sha256(d.text))
""")
def self_anti_checksum(spark: SparkSession, folder: str) -> DataFrame:
    """Failed rows (here those of some sources) without a sibling of the same checksum that didn't fail."""
    d = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"), (F.col("source") < "src3").alias("failed"))
    return d.where("failed").join(d.where("not failed").select("checksum").distinct(), "checksum", "left_anti").select("doc_id", "checksum")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def scalar_subquery_count(spark: SparkSession, folder: str) -> DataFrame:
    """Children of each row, zero included."""
    n = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, folder, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_first(spark: SparkSession, folder: str) -> DataFrame:
    """A value inside JSON, only where its key is there."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, folder, "events").select("event_id", k.alias("k")).where("k is not null")


@query("""
SELECT o_orderkey, first.l_partkey AS part, first.l_quantity AS quantity FROM (SELECT o_orderkey, (SELECT x FROM (SELECT l AS x FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l.l_returnflag = 'A' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 1)) AS first FROM orders)
""")
def first_element(spark: SparkSession, folder: str) -> DataFrame:
    """Of an array inside JSON the first element that fits."""
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    lists = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("items"))
    parsed = F.from_json("items", "array<struct<l_partkey:long,l_quantity:double,l_returnflag:string>>")
    fit = F.get(F.filter(parsed, lambda x: x["l_returnflag"] == "A"), F.lit(0))
    o = table(spark, folder, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", fit["l_partkey"].alias("part"), fit["l_quantity"].alias("quantity"))


@query("SELECT count(*) AS n_all, count(*) FILTER (o_totalprice > 200000) AS n_large, count(DISTINCT o_custkey) AS n_customers FROM orders")
def counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts with a filter and of distinct values."""
    return table(spark, folder, "orders").agg(F.count("*").alias("n_all"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"), F.countDistinct("o_custkey").alias("n_customers"))


@query("""
SELECT c_custkey, c_name, c_nationkey, c_mktsegment, count(*) AS n_orders, CAST(max(o_totalprice) AS DOUBLE) AS largest
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_nationkey, c_mktsegment
""")
def wide_group(spark: SparkSession, folder: str) -> DataFrame:
    """Grouped by the key alone before the join, since the other columns depend on it."""
    n = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("largest"))
    return table(spark, folder, "customer").join(n, "c_custkey").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "n_orders", "largest")


@query("""
SELECT user_id, coalesce(list(event_id ORDER BY event_id) FILTER (event_type = 'error'), []) AS errors FROM events GROUP BY 1
""")
def filtered_list(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of what passes a filter, empty rather than null."""
    return table(spark, folder, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.when(F.col("event_type") == "error", F.col("event_id")))).alias("errors"))


@query("""
SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders
ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50
""")
def priority_order(spark: SparkSession, folder: str) -> DataFrame:
    """Urgent first, then the newest."""
    first = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    return table(spark, folder, "orders").orderBy(first, F.col("o_orderdate").desc_nulls_last(), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
q AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN (o_orderstatus = 'F' AND n <= 80) OR (o_orderstatus <> 'F' AND n <= 20) THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS place
  FROM r WHERE n <= 100)
SELECT o_orderkey, o_orderstatus FROM q WHERE place <= 100
""")
def quota_with_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred rows, eighty of one class and twenty of the other, filled up from either."""
    done = F.col("o_orderstatus") == "F"
    n = F.row_number().over(Window.partitionBy(done).orderBy("o_orderdate", "o_orderkey"))
    r = table(spark, folder, "orders").withColumn("n", n).where("n <= 100")  # two hundred rows at most
    inside = F.when((done & (F.col("n") <= 80)) | (~done & (F.col("n") <= 20)), 0).otherwise(1)
    return r.orderBy(inside, "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_orderstatus")


@query("""
WITH t AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200)
SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 200 AS truncated FROM t
""")
def truncated_result(spark: SparkSession, folder: str) -> DataFrame:
    """The first objects, and whether there are more."""
    first = table(spark, folder, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(201)  # one more than are shown
    w = Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    counted = first.withColumn("place", F.row_number().over(w)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > 200)
    return counted.where("place <= 200").select("o_orderkey", "o_totalprice", "truncated")


@query("""
SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier
""")
def bag_union(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of two operations in one relation."""
    c = table(spark, folder, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = table(spark, folder, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s)


@query("""
SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier
""")
def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    """H03."""
    return table(spark, folder, "nation").select("n_nationkey").subtract(table(spark, folder, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersection(spark: SparkSession, folder: str) -> DataFrame:
    """H04."""
    c = table(spark, folder, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    return c.intersect(table(spark, folder, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("""
SELECT user_id, list_distinct_ordered AS kinds FROM (SELECT user_id, string_agg(event_type, '>' ORDER BY first_id) AS list_distinct_ordered
FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2) GROUP BY 1)
""")
def ordered_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct values in the order of first appearance."""
    firsts = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    ordered = F.array_sort(F.collect_list(F.struct("first_id", "event_type")))
    return firsts.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), ">").alias("kinds"))
