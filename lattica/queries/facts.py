"""Facts extracted, repaired, bound and validated; capabilities run from their declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relation import Sort
from ..plans import capability as c
from ..plans import facts, rules
from .registry import query, table
from .relational import ORDERS
from .semantic import ORDER_GRAPH

SEARCH_ORDERS = c.Capability(
    "search_orders", ORDERS, ORDER_GRAPH,
    [
        c.Input("status", column="o_orderstatus", values=("F", "O", "P")),
        c.Input("least_price", "number", column="o_totalprice", operator="gte", default=100000.0),
        c.Input("text", searches=("o_orderpriority",)),
    ],
    {"newest": [Sort("o_orderdate", "desc", "last")], "key": [Sort("o_orderkey")]},
    returns=("order",),
)


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS number, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_orderpriority ILIKE '%low%'
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 50
""")
def capability_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs checked, bound, run, and the returned type alone kept."""
    found = SEARCH_ORDERS.objects(spark, folder, status="F", text="low", page=2, page_size=50)
    return found.select(F.col("properties")["number"].alias("number"), F.col("properties")["status"].alias("status"))


@query("SELECT count(*) AS total_items, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_orderpriority ILIKE '%low%'")
def capability_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The totals that go with a capability's pages."""
    return SEARCH_ORDERS.totals(spark, folder, status="F", text="low", page_size=50)


@query(r"""
WITH f AS (SELECT doc_id, 'email' AS fact_type, unnest(regexp_extract_all(text, '([a-z]+[.][0-9]+@[a-z0-9.]+)', 1)) AS value FROM documents WHERE regexp_matches(text, '@')
UNION ALL SELECT doc_id, 'area', unnest(regexp_extract_all(text, '\+1 \(([0-9]{3})\)', 1)) FROM documents WHERE regexp_matches(text, '555'))
SELECT doc_id, fact_type, value, count(*) AS n FROM f GROUP BY ALL
""")
def extracted_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that patterns find in whole texts."""
    patterns = {"email": ("([a-z]+[.][0-9]+@[a-z0-9.]+)", "@"), "area": (r"\+1 \(([0-9]{3})\)", "555")}
    found = facts.extracted(table(spark, folder, "documents").select("doc_id", "text"), "text", patterns)
    return found.groupBy("doc_id", "fact_type", "value").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 50000 THEN 'O' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '3-MEDIUM' WHEN (CASE WHEN o_orderstatus = 'P' AND o_totalprice < 50000 THEN 'O' ELSE o_orderstatus END) = 'O' AND o_orderpriority = '5-LOW' THEN '4-DEFERRED' ELSE o_orderpriority END AS priority,
  CAST((o_orderstatus = 'P' AND o_totalprice < 50000)::INT + (o_orderpriority = '4-NOT SPECIFIED')::INT
    + ((CASE WHEN o_orderstatus = 'P' AND o_totalprice < 50000 THEN 'O' ELSE o_orderstatus END) = 'O' AND o_orderpriority = '5-LOW')::INT AS INTEGER) AS n_repairs
FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 480000)
""")
def repaired_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Repair rules in their order, each seeing what the ones before did."""
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    plan = [
        facts.Repair("small_part", (F.col("status") == "P") & (F.col("o_totalprice") < 50000), {"status": F.lit("O")}),
        facts.Repair("unspecified", F.col("priority") == "4-NOT SPECIFIED", {"priority": F.lit("3-MEDIUM")}),
        facts.Repair("deferred", (F.col("status") == "O") & (F.col("priority") == "5-LOW"), {"priority": F.lit("4-DEFERRED")}),
        facts.Repair("too_large", (F.col("status") == "F") & (F.col("o_totalprice") > 480000), drop=True),
    ]
    return facts.repaired(rows, plan).select("o_orderkey", "status", "priority", F.size("repairs").alias("n_repairs"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' THEN 'industry_registration_matches' WHEN o_orderpriority = '2-HIGH' THEN 'participation_region_matches'
  WHEN o_orderpriority = '5-LOW' THEN 'no_active_sanction' END AS rule FROM orders
""")
def rule_binding(spark: SparkSession, folder: str) -> DataFrame:
    """The standard rule of each requirement; an industry without a code has none."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "industry").when(F.col("o_orderpriority") == "2-HIGH", "region").when(F.col("o_orderpriority") == "5-LOW", "sanction").otherwise("other")
    code = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, folder, "orders").select("o_orderkey", rules.bound_rule(kind, code).alias("rule"))


@query("""
WITH g AS (SELECT l_orderkey AS k, l_returnflag AS g, string_agg(DISTINCT 's' || l_suppkey, ',' ORDER BY 's' || l_suppkey) AS p, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1, 2),
e AS (SELECT k, g, CASE WHEN n = 1 THEN p ELSE 'any(' || p || ')' END AS e FROM g),
d AS (SELECT k, e, min(g) AS g FROM e GROUP BY 1, 2), a AS (SELECT k, count(*) AS n, string_agg(e, ',' ORDER BY g) AS p FROM d GROUP BY 1)
SELECT k AS l_orderkey, CASE WHEN n = 1 THEN p ELSE 'all(' || p || ')' END AS expression FROM a
""")
def structured_requirements(spark: SparkSession, folder: str) -> DataFrame:
    """Any of the members of each group, all of the groups."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("r"))
    return facts.structured_expression(rows, "l_orderkey", "l_returnflag", "r")


@query("""
SELECT o_orderkey, o_orderstatus AS status, coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, c_mktsegment) AS segment, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey
""")
def hydrated_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Attributes of a structured source, where the fact has none of its own."""
    o = table(spark, folder, "orders")
    own = F.map_filter(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("segment"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))), lambda _k, v: v.isNotNull())
    source = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name").alias("attributes"))
    a = F.col("attributes")
    return facts.hydrated(o.select("o_orderkey", "o_custkey", own.alias("attributes")), source, ["o_custkey"]).select("o_orderkey", a["status"].alias("status"), a["segment"].alias("segment"), a["name"].alias("name"))


@query("""
WITH x AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS own FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN own > 0 AND o_orderstatus = 'F' THEN own WHEN n - own > 0 AND o_orderstatus = 'O' THEN n - own ELSE n END AS n_evidence FROM orders JOIN x ON l_orderkey = o_orderkey
""")
def pruned_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of the fact's own source, or all if it has none of its own."""
    e = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linestatus").alias("source"), "l_linenumber")).alias("evidence"))
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("source")).join(e, "o_orderkey")
    return facts.pruned(rows, "evidence").select("o_orderkey", F.size("evidence").cast("long").alias("n_evidence"))


@query("""
WITH q AS (SELECT item_id, text, substr(text, 1, 10) AS proposition, CASE WHEN length(text) > 150 THEN 0 ELSE 1 END AS a, length(text) > 200 AS positive, substr(text, 1, 2) AS merge_key FROM benchmark)
SELECT item_id, 'span' AS code FROM q WHERE substr(text, a + 1, 10) <> proposition
UNION ALL SELECT item_id, 'duplicate' FROM (SELECT *, count(*) OVER (PARTITION BY merge_key, positive) AS n FROM q) WHERE n > 1
UNION ALL SELECT item_id, 'conflict' FROM (SELECT *, min(positive) OVER (PARTITION BY merge_key) AS low, max(positive) OVER (PARTITION BY merge_key) AS high FROM q) WHERE low <> high
""")
def fact_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Spans that don't hold, duplicates, and opposites under one key."""
    start = F.when(F.length("text") > 150, 0).otherwise(1)
    q = table(spark, folder, "benchmark").select("item_id", "text", F.substring("text", 1, 10).alias("proposition"), start.alias("a"), (start + 10).alias("z"), (F.length("text") > 200).alias("positive"), F.substring("text", 1, 2).alias("merge_key"))
    return facts.violations(q, ["item_id"], "text", "proposition", "a", "z", ["merge_key"], "positive")


@query("""
WITH l AS (SELECT l_orderkey AS t, l_returnflag AS p, CASE WHEN l_quantity >= 40 THEN 'large' ELSE 's' || l_suppkey END AS leaf FROM lineitem)
SELECT t AS tree_id, p AS parent_id, leaf AS leaf_id FROM l GROUP BY ALL
""")
def aliased_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves that were merged take the new name and count once below a parent."""
    line = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("tree_id"), F.col("l_returnflag").alias("parent_id"), F.concat_ws("/", "l_suppkey", "l_quantity", "l_partkey", "l_linenumber").alias("leaf_id"), "l_quantity", "l_suppkey").distinct()
    nodes = line.select("tree_id", F.concat_ws("|", "parent_id", "leaf_id").alias("node_id"), "parent_id", F.lit("leaf").alias("op"), "leaf_id")
    name = F.when(F.col("l_quantity") >= 40, "large").otherwise(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    aliases = line.select("tree_id", "leaf_id", name.alias("new_id")).distinct()
    return facts.realiased(nodes, aliases).select("tree_id", "parent_id", "leaf_id")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R'
""")
def parent_combinations(spark: SparkSession, folder: str) -> DataFrame:
    """Children with each of their parents, none without."""
    line = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return facts.combinations(facts.combinations(line, [p], ["l_partkey"]), [s], ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "s_name")
