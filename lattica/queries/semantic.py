"""Codecs, objects and links, three-valued rules and expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs, logic
from ..functions.hashing import content_id, uuid5
from ..operators.relation import Filter, Page, Query, Search, Sort, run
from ..plans import expression, graph, rules
from .registry import query, table
from .relational import ORDERS

ORDER_GRAPH = graph.Mapping(
    "orders",
    "list_orders",
    ["o_orderkey"],
    [
        graph.Role("customer", "customer", ["number"], [graph.Binding("number", ["o_custkey"])]),
        graph.Role(
            "order", "order", ["number"],
            [graph.Binding("number", ["o_orderkey"]), graph.Binding("status", ["o_orderstatus"]), graph.Binding("ordered_on", ["o_orderdate"], codecs.format_date)],
            parents=["customer"], constants={"system": "erp"},
        ),
    ],
    [graph.Link("placed", "customer", "order")],
    ontology="erp",
)


@query("""
WITH p AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31' AND o_orderpriority ILIKE '%urgent%'
  ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20),
c AS (SELECT DISTINCT o_custkey, sha256('erp:customer:{"number":"' || o_custkey || '","parents":[]}') AS id FROM p),
o AS (SELECT p.*, sha256('erp:order:{"number":"' || o_orderkey || '","parents":["' || c.id || '"]}') AS id, c.id AS parent FROM p JOIN c USING (o_custkey))
SELECT 'object' AS kind, 'customer' AS type, id, NULL AS target, CAST(o_custkey AS VARCHAR) AS number FROM c
UNION ALL SELECT 'object', 'order', id, NULL, CAST(o_orderkey AS VARCHAR) FROM o
UNION ALL SELECT 'link', 'placed', parent, id, NULL FROM o
""")
def search_capability(spark: SparkSession, folder: str) -> DataFrame:
    """A search as objects and links; the flagship query."""
    from datetime import datetime

    q = Query(
        [Filter("o_orderdate", "gte", datetime(1997, 1, 1)), Filter("o_orderdate", "lte", datetime(1997, 12, 31))],
        Search(["o_orderpriority"], "urgent"), [Sort("o_orderdate", "desc", "last")], Page(1, 20),
    )
    rows = run(ORDERS.scan(spark, folder), ORDERS, q)
    found = graph.objects(graph.fragments(rows, ORDER_GRAPH, F.lit("1")))
    objects = found.select(F.lit("object").alias("kind"), F.col("object_type").alias("type"), F.col("object_id").alias("id"), F.lit(None).cast("string").alias("target"), F.col("properties")["number"].alias("number"))
    links = graph.links(rows, ORDER_GRAPH).select(F.lit("link").alias("kind"), F.col("link_type").alias("type"), F.col("source_id").alias("id"), F.col("target_id").alias("target"), F.lit(None).cast("string").alias("number"))
    return objects.union(links)


@query("""
WITH c AS (SELECT DISTINCT o_custkey, sha256('erp:customer:{"number":"' || o_custkey || '","parents":[]}') AS cid FROM orders)
SELECT 'customer' AS object_type, cid AS object_id, CAST(o_custkey AS VARCHAR) AS number, NULL AS status, NULL AS ordered_on, NULL AS system, count(*) AS n_records FROM orders JOIN c USING (o_custkey) GROUP BY cid, o_custkey
UNION ALL SELECT 'order', sha256('erp:order:{"number":"' || o_orderkey || '","parents":["' || cid || '"]}'), CAST(o_orderkey AS VARCHAR), o_orderstatus, strftime(o_orderdate, '%Y%m%d'), 'erp', 1 FROM orders JOIN c USING (o_custkey)
""")
def graph_objects(spark: SparkSession, folder: str) -> DataFrame:
    """All objects with their properties and the number of records that state them."""
    rows = table(spark, folder, "orders")
    p = F.col("properties")
    found = graph.fragments(rows, ORDER_GRAPH, F.col("o_orderdate").cast("string"))
    return graph.counted(found).select("object_type", "object_id", *[p[n].alias(n) for n in ("number", "status", "ordered_on", "system")], "n_records")


@query("""
SELECT 'placed' AS link_type, sha256('erp:customer:{"number":"' || o_custkey || '","parents":[]}') AS source_id,
  sha256('erp:order:{"number":"' || o_orderkey || '","parents":["' || sha256('erp:customer:{"number":"' || o_custkey || '","parents":[]}') || '"]}') AS target_id, count(*) AS n_records FROM orders GROUP BY ALL
""")
def graph_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links between the objects of each record."""
    return graph.links(table(spark, folder, "orders"), ORDER_GRAPH)


@query("""
SELECT 'customer' AS object_type, sha256('erp:customer:{"number":"' || o_custkey || '","parents":[]}') AS object_id, 'erp' AS source,
  string_agg('list_orders:' || o_orderkey, ',' ORDER BY 'list_orders:' || o_orderkey) AS record_keys FROM orders GROUP BY o_custkey
""")
def object_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """From which records each customer is known."""
    found = graph.fragments(table(spark, folder, "orders"), ORDER_GRAPH, F.lit("1")).where("object_type = 'customer'")
    p = graph.provenance(found, "erp", "list_orders", "orders", "2024-01-01T00:00:00Z").withColumn("p", F.col("provenance")[0])
    return p.select("object_type", "object_id", F.col("p.source").alias("source"), F.array_join("p.record_keys", ",").alias("record_keys"))


@query("""
WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS o, event_id, event_type, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v FROM events)
SELECT user_id, arg_max(v, struct_pack(o := o, k := event_id)) FILTER (event_type = 'click') AS click, arg_max(v, struct_pack(o := o, k := event_id)) FILTER (event_type = 'error') AS error,
  arg_max(v, struct_pack(o := o, k := event_id)) FILTER (event_type = 'purchase') AS purchase FROM e GROUP BY 1
""")
def latest_non_empty_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Of each property the last value that isn't empty, order compared as text."""
    e = table(spark, folder, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("o"), "event_id", "event_type", F.col("value").cast("decimal(18,2)").cast("string").alias("v"))
    last = e.where("v <> ''").groupBy("user_id", "event_type").agg(F.max_by("v", F.struct("o", "event_id")).alias("v"))
    kinds = ("click", "error", "purchase")
    return last.groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == k, F.col("v"))).alias(k) for k in kinds])


@query("""
SELECT n_nationkey AS id, 'domestic' AS period, n_name AS name FROM nation UNION ALL SELECT n_nationkey, 'region', r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA'
""")
def qualifier_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Wide columns to one row for each qualifier; empty groups give none."""
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    wide = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("id"), "n_name", F.when(F.col("r_name") != "ASIA", F.col("r_name")).alias("r_name"))
    return graph.variants(wide, ["id"], {"domestic": {"name": "n_name"}, "region": {"name": "r_name"}}, "period")


@query("""
WITH e AS (SELECT o_custkey AS s, o_orderkey AS t FROM orders), n AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0)
SELECT 'customer:' || id AS node_id, false AS external FROM n
UNION ALL SELECT DISTINCT 'customer:' || s, true FROM e WHERE s NOT IN (SELECT id FROM n) UNION ALL SELECT DISTINCT 'order:' || t, true FROM e
""")
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes, with those that only edges name added."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    edges = o.select(F.concat(F.lit("customer:"), "o_custkey").alias("source_id"), F.concat(F.lit("order:"), "o_orderkey").alias("target_id"))
    return graph.nodes_of(edges, c.where("c_acctbal > 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("node_id")))


@query("""
SELECT DISTINCT r_name AS source, c_mktsegment AS capability, o_orderpriority AS type FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
""")
def lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Which sources reach which types through which capabilities; distinct before the small joins."""
    o, c, n, r = (table(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    short = o.join(c, o["o_custkey"] == c["c_custkey"]).select("c_nationkey", "c_mktsegment", "o_orderpriority").distinct()
    named = short.join(n, short["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return named.select(F.col("r_name").alias("source"), F.col("c_mktsegment").alias("capability"), F.col("o_orderpriority").alias("type")).distinct()


@query("""
SELECT user_id, max(CASE event_type WHEN 'view' THEN 1 ELSE 0 END) AS has_view, bool_or(event_type = 'error') AS any_error,
  CASE WHEN bool_or(event_type = 'error' AND value > 60) THEN 'failing' WHEN bool_or(event_type = 'error') THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY 1
""")
def any_match_status(spark: SparkSession, folder: str) -> DataFrame:
    """Labels from whether any row matches."""
    error = F.col("event_type") == "error"
    return table(spark, folder, "events").groupBy("user_id").agg(
        F.max((F.col("event_type") == "view").cast("int")).alias("has_view"), F.bool_or(error).alias("any_error"),
        F.when(F.bool_or(error & (F.col("value") > 60)), "failing").when(F.bool_or(error), "degraded").otherwise("healthy").alias("status"),
    )


_LEAF = "CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_linestatus = 'O' AND l_quantity < 10 THEN 1 ELSE 2 END"


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    leaf = F.when(F.col("l_returnflag") == "A", 0).when((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 10), 1).otherwise(2)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", leaf.alias("outcome"))


@query(f"""
WITH l AS (SELECT l_orderkey, {_LEAF} AS x FROM lineitem)
SELECT o_orderkey, coalesce(min(x), 1) AS all_of, coalesce(max(x), 1) AS any_of, 2 - coalesce(min(x), 1) AS not_all FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1
""")
def tri_state(spark: SparkSession, folder: str) -> DataFrame:
    """All, any and not over outcomes; an order without lines needs review."""
    x = _outcomes(spark, folder).groupBy("l_orderkey").agg(logic.all_of(F.col("outcome")).alias("a"), logic.any_of(F.col("outcome")).alias("b"))
    o = table(spark, folder, "orders").select("o_orderkey").join(x, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    review = F.lit(logic.REVIEW)
    return o.select("o_orderkey", F.coalesce("a", review).alias("all_of"), F.coalesce("b", review).alias("any_of"), logic.not_of(F.col("a")).alias("not_all"))


@query(f"""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag AS g FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, min({_LEAF}) AS x FROM lineitem GROUP BY 1, 2),
b AS (SELECT l.l_orderkey, g, min(x) AS v FROM l JOIN x USING (l_orderkey, l_linenumber) GROUP BY 1, 2)
SELECT l_orderkey AS tree_id, max(v) AS outcome FROM b GROUP BY 1
""")
def tri_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Any over the flags of an order, all over the lines of a flag, folded level by level."""
    lines = _outcomes(spark, folder)
    leaves = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("outcome").alias("outcome")).select(F.col("l_orderkey").alias("tree_id"), F.col("l_linenumber").cast("string").alias("leaf_id"), "outcome")
    each = lines.select(F.col("l_orderkey").alias("tree_id"), "l_linenumber", "l_returnflag").distinct()
    no_leaf = F.lit(None).cast("string").alias("leaf_id")
    root = each.select("tree_id", F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit("any").alias("op"), no_leaf).distinct()
    branch = each.select("tree_id", F.col("l_returnflag").alias("node_id"), F.lit("root").alias("parent_id"), F.lit(1).alias("depth"), F.lit("all").alias("op"), no_leaf).distinct()
    leaf = each.select("tree_id", F.concat_ws("/", "l_returnflag", F.col("l_linenumber").cast("string")).alias("node_id"), F.col("l_returnflag").alias("parent_id"), F.lit(2).alias("depth"), F.lit("leaf").alias("op"), F.col("l_linenumber").cast("string").alias("leaf_id"))
    return expression.folded(root.union(branch).union(leaf), leaves, 2)


@query(f"""
WITH x AS (SELECT l_orderkey, min({_LEAF}) AS v FROM lineitem GROUP BY 1),
o AS (SELECT o_orderpriority AS p, CASE WHEN coalesce(v, 1) = 2 AND o_orderstatus = 'P' THEN 1 ELSE coalesce(v, 1) END AS v FROM orders LEFT JOIN x ON l_orderkey = o_orderkey)
SELECT p AS o_orderpriority, count(*) FILTER (v = 2) AS satisfied, count(*) FILTER (v = 1) AS needs_review, count(*) FILTER (v = 0) AS unsatisfied FROM o GROUP BY 1
""")
def outcome_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes, downgraded where evidence isn't complete, counted."""
    x = _outcomes(spark, folder).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("outcome").alias("v"))
    v = logic.downgraded(F.coalesce("v", F.lit(logic.REVIEW)), F.col("o_orderstatus") != "P")
    o = table(spark, folder, "orders").join(x, "o_orderkey", "left").withColumn("v", v)
    return o.groupBy("o_orderpriority").agg(*[F.count_if(F.col("v") == i).alias(logic.NAMES[i]) for i in (2, 1, 0)])


@query("""
WITH d AS (SELECT lang, source, count(*) AS total, count(*) FILTER (n_chars > 50) AS parsed, bool_or(n_chars > 20000) AS long FROM documents GROUP BY 1, 2)
SELECT *, CASE WHEN parsed = total AND NOT long THEN 'complete' WHEN parsed > 0 THEN 'partial' ELSE 'api_only' END AS completeness FROM d
""")
def coverage_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How far the documents of a group could be read."""
    d = table(spark, folder, "documents").groupBy("lang", "source").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") > 50).alias("parsed"), F.bool_or(F.col("n_chars") > 20000).alias("long"))
    return d.withColumn("completeness", F.when((F.col("parsed") == F.col("total")) & ~F.col("long"), "complete").when(F.col("parsed") > 0, "partial").otherwise("api_only"))


@query("""
WITH p AS (SELECT DISTINCT l_orderkey AS k, 'r' || l_linenumber AS r, CASE WHEN l_returnflag = 'A' THEN 'common' WHEN l_returnflag = 'N' THEN 'single' ELSE 'consortium' END AS s FROM lineitem),
x AS (SELECT k, s, count(*) AS n, string_agg(r, ',' ORDER BY r) AS t FROM p GROUP BY 1, 2),
y AS (SELECT k, s, CASE WHEN n = 1 THEN t ELSE 'all(' || t || ')' END AS t FROM x),
z AS (SELECT k, max(t) FILTER (s = 'common') AS c, max(t) FILTER (s = 'single') AS a, max(t) FILTER (s = 'consortium') AS b FROM y GROUP BY 1),
w AS (SELECT k, c, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR a = b THEN a ELSE 'any(' || a || ',' || b || ')' END AS o FROM z)
SELECT k AS case_id, CASE WHEN c IS NULL THEN o WHEN o IS NULL OR o = c THEN c ELSE 'all(' || c || ',' || o || ')' END AS expression FROM w
""")
def expression_compile(spark: SparkSession, folder: str) -> DataFrame:
    """Requirements of three scopes to one expression for each order."""
    scope = F.when(F.col("l_returnflag") == "A", "common").when(F.col("l_returnflag") == "N", "single").otherwise("consortium")
    none = F.lit(None).cast("string")
    p = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("requirement_id"), scope.alias("scope"), none.alias("alternative_group"), none.alias("alternative_branch"))
    return expression.compiled(p.distinct())


@query("""
WITH b AS (SELECT l_orderkey AS k, l_returnflag AS g, list_sort(list(DISTINCT l_linenumber)) AS s FROM lineitem GROUP BY 1, 2)
SELECT x.k AS case_id, x.g AS branch, y.g AS absorbed_by FROM b x JOIN b y ON x.k = y.k AND x.g <> y.g AND list_has_all(x.s, y.s)
""")
def absorbed_branches(spark: SparkSession, folder: str) -> DataFrame:
    """Alternatives that hold all requirements of another one."""
    b = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("branch")).agg(F.collect_set("l_linenumber").alias("leaves"))
    return expression.absorbed(b.withColumn("alternative_group", F.lit("g"))).select("case_id", "branch", "absorbed_by")


@query("""
WITH p AS (SELECT DISTINCT l_orderkey AS case_id, l_returnflag AS b, 'r' || l_linenumber AS r FROM lineitem),
s AS (SELECT case_id, b, list_sort(list(r)) AS x FROM p GROUP BY 1, 2),
d AS (SELECT DISTINCT u.case_id, u.b FROM s u JOIN s v ON u.case_id = v.case_id AND u.b <> v.b AND list_has_all(u.x, v.x) WHERE NOT (list_has_all(v.x, u.x) AND u.b < v.b)),
k AS (SELECT * FROM p WHERE (case_id, b) NOT IN (SELECT (case_id, b) FROM d))
SELECT 'kept' AS state, case_id, b AS branch, r AS requirement_id FROM k UNION ALL SELECT 'unresolved', case_id, NULL, r FROM (SELECT DISTINCT case_id, r FROM p EXCEPT SELECT case_id, r FROM k)
""")
def simplified_placements(spark: SparkSession, folder: str) -> DataFrame:
    """Alternatives that hold all of another one are dropped; requirements that stood only there are left over. Cases are brought together once."""
    p = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("requirement_id"), F.lit("common").alias("scope"), F.lit("g").alias("alternative_group"), F.col("l_returnflag").alias("alternative_branch")).repartition("case_id").distinct()
    kept, left = expression.simplified(p)
    none = F.lit(None).cast("string")
    return kept.select(F.lit("kept").alias("state"), "case_id", F.col("alternative_branch").alias("branch"), "requirement_id").union(left.select(F.lit("unresolved"), "case_id", none, "requirement_id"))


@query("""
WITH q AS (SELECT o_orderkey AS notice_id, o_custkey AS company_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'industry_registration_matches' WHEN '2-HIGH' THEN 'business_status_active'
    WHEN '3-MEDIUM' THEN 'qualification_valid' WHEN '5-LOW' THEN 'procurement_supplier_registered' END AS rule, o_orderstatus AS wanted FROM orders),
f AS (SELECT user_id AS company_id, count(*) FILTER (event_type = 'click') AS n_industry, bool_or(event_type = 'click' AND lower(props) = '{"k": 7}') AS m7,
    count(*) FILTER (event_type = 'view') AS n_status, bool_or(event_type = 'view' AND value > 5) AS active,
    count(*) FILTER (event_type = 'purchase') AS n_qualification, bool_or(event_type = 'purchase' AND ts::DATE <= DATE '2024-01-15' AND DATE '2024-01-15' <= ts::DATE + 10) AS valid,
    count(*) FILTER (event_type = 'error') AS n_supplier FROM events GROUP BY 1)
SELECT company_id, notice_id, CASE WHEN rule IS NULL THEN 1
  WHEN rule = 'business_status_active' THEN CASE WHEN coalesce(n_status, 0) = 0 THEN 1 WHEN active THEN 2 ELSE 0 END
  WHEN rule = 'qualification_valid' THEN CASE WHEN coalesce(valid, false) THEN 2 ELSE 0 END
  WHEN rule = 'procurement_supplier_registered' THEN CASE WHEN coalesce(n_supplier, 0) > 0 THEN 2 ELSE 0 END
  ELSE CASE WHEN coalesce(m7, false) THEN 2 ELSE 0 END END AS outcome,
  CASE WHEN rule IS NULL THEN 'unsupported_standard_rule'
  WHEN rule = 'business_status_active' THEN CASE WHEN coalesce(n_status, 0) = 0 THEN 'evidence_missing' WHEN active THEN 'business_active' ELSE 'business_closed' END
  WHEN rule = 'qualification_valid' THEN CASE WHEN coalesce(valid, false) THEN 'qualification_valid' WHEN coalesce(n_qualification, 0) > 0 THEN 'qualification_expired' ELSE 'qualification_missing' END
  WHEN rule = 'procurement_supplier_registered' THEN CASE WHEN coalesce(n_supplier, 0) > 0 THEN 'procurement_supplier_registered' ELSE 'procurement_supplier_not_registered' END
  ELSE CASE WHEN coalesce(m7, false) THEN 'industry_code_matched' ELSE 'industry_code_mismatched' END END AS reason
FROM q LEFT JOIN f USING (company_id)
""")
def rule_assessment(spark: SparkSession, folder: str) -> DataFrame:
    """Requirements judged against what is known of a company."""
    kinds = {"click": "industry", "view": "business_status", "purchase": "qualification", "error": "supplier"}
    e = table(spark, folder, "events")
    day = F.to_date("ts")
    # Codes have one length, so that none is part of another.
    facts = e.where(F.col("event_type").isin(*kinds)).select(
        F.col("user_id").alias("company_id"), codecs.coded(F.col("event_type"), kinds).alias("fact_type"), F.lpad(F.get_json_object("props", "$.k"), 3, "0").alias("code"),
        F.lit("women_owned_business").alias("kind"), F.when((F.col("event_type") == "view") & (F.col("value") > 5), "active").when(F.col("event_type") == "view", "closed").alias("status"),
        F.when(F.col("event_type") == "purchase", day).alias("valid_from"), F.when(F.col("event_type") == "purchase", F.date_add(day, 10)).alias("valid_until"),
    )
    rule = codecs.coded(F.col("o_orderpriority"), {"1-URGENT": "industry_registration_matches", "2-HIGH": "business_status_active", "3-MEDIUM": "qualification_valid", "5-LOW": "procurement_supplier_registered"})
    requirements = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("notice_id"), rule.alias("rule"),
        F.lit('{"expected_value": ["007"], "qualification_type": "women_owned_business"}').alias("arguments"),
    )
    return rules.assess(requirements, facts, F.lit("2024-01-15").cast("date")).select("company_id", "notice_id", "outcome", "reason")


@query("""
WITH q AS (SELECT o_orderkey AS notice_id, o_custkey AS company_id, o_orderkey % 10 AS k, o_orderstatus AS s, substr(o_orderpriority, 1, 1) AS p FROM orders),
f AS (SELECT o_custkey AS company_id, l_linenumber AS t, l_partkey AS code, l_suppkey % 7 AS sup, l_returnflag AS flag, l_linestatus AS st, l_shipdate::DATE AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
a AS (SELECT company_id, count(*) FILTER (t = 1) AS n1, bool_or(t = 1 AND flag = 'N') AS open, count(*) FILTER (t = 2) AS n2,
  list(DISTINCT sup) FILTER (t = 2) AS regions, list(DISTINCT code % 50) FILTER (t = 3) AS i_all, list(DISTINCT code % 50) FILTER (t = 3 AND flag <> 'R' AND d <= DATE '1996-01-01') AS i_active,
  bool_or(t = 4 AND d <= DATE '1996-01-01' AND DATE '1996-01-01' <= d + 900) AS q_valid, count(*) FILTER (t = 4) AS n4,
  list(DISTINCT code % 50) FILTER (t = 5 AND d <= DATE '1996-01-01') AS certs, list(DISTINCT code % 50) FILTER (t = 6) AS products, bool_or(t = 7 AND d <= DATE '1996-01-01' AND DATE '1996-01-01' <= d + 900) AS barred
  FROM f GROUP BY 1)
SELECT notice_id, CASE k
  WHEN 0 THEN CASE WHEN coalesce(n1, 0) = 0 THEN 'evidence_missing' WHEN open THEN 'business_active' ELSE 'business_closed' END
  WHEN 1 THEN CASE WHEN coalesce(n2, 0) > 0 THEN 'procurement_supplier_registered' ELSE 'procurement_supplier_not_registered' END
  WHEN 2 THEN CASE WHEN coalesce(list_contains(i_active, company_id % 50), false) THEN 'industry_code_matched' WHEN coalesce(list_contains(i_all, company_id % 50), false) THEN 'industry_registration_inactive' ELSE 'industry_code_mismatched' END
  WHEN 3 THEN CASE WHEN s = 'P' THEN 'ambiguous_requirement' WHEN coalesce(n2, 0) = 0 THEN 'evidence_missing' WHEN list_contains(regions, company_id % 7) THEN 'region_matched' ELSE 'region_mismatched' END
  WHEN 4 THEN CASE s WHEN 'F' THEN CASE WHEN coalesce(q_valid, false) THEN 'qualification_valid' WHEN coalesce(n4, 0) > 0 THEN 'qualification_expired' ELSE 'qualification_missing' END
    WHEN 'O' THEN 'qualification_missing' ELSE 'unsupported_qualification_type' END
  WHEN 5 THEN CASE WHEN s = 'F' THEN 'ambiguous_requirement' ELSE 'company_scale_document_required' END
  WHEN 6 THEN CASE p WHEN '1' THEN 'single_participation_selected' WHEN '2' THEN 'ambiguous_participation_mode' WHEN '3' THEN 'consortium_participation_allowed' WHEN '4' THEN 'ambiguous_requirement' ELSE 'consortium_participation_prohibited' END
  WHEN 7 THEN CASE WHEN CASE WHEN s = 'F' THEN len(coalesce(certs, [])) > 0 ELSE coalesce(list_contains(certs, company_id % 50), false) END THEN 'direct_production_matched' ELSE 'direct_production_mismatched' END
  WHEN 8 THEN CASE WHEN coalesce(list_contains(products, company_id % 50), false) THEN 'product_registration_matched' ELSE 'product_registration_mismatched' END
  ELSE CASE WHEN s = 'P' THEN 'ambiguous_requirement' WHEN coalesce(barred, false) THEN 'active_sanction_found' ELSE 'active_sanction_not_found' END END AS reason
FROM q LEFT JOIN a USING (company_id)
""")
def rule_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """K11a-K11j C16 C17 D15 I55 I56: each of the ten evaluators, with arguments, values and facts of every kind."""
    o, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    kinds = {1: "business_status", 2: "supplier", 3: "industry", 4: "qualification", 5: "product_certificate", 6: "product_registration", 7: "sanction"}
    day, number = F.to_date("l_shipdate"), F.col("l_linenumber")
    code = F.concat(F.lit("c"), F.lpad((F.col("l_partkey") % 50).cast("string"), 2, "0"))
    facts = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("company_id"), codecs.coded(number.cast("string"), {str(k): v for k, v in kinds.items()}).alias("fact_type"),
        F.concat_ws(":", F.col("l_orderkey").cast("string"), number.cast("string")).alias("object_id"), F.when(number != 2, code).alias("code"),
        F.when(number == 2, F.concat(F.lit("Region ("), (F.col("l_suppkey") % 7).cast("string"), F.lit("), Main St."))).alias("address"),
        F.when(number == 1, F.when(F.col("l_returnflag") == "N", "active").otherwise("closed")).when((number == 3) & (F.col("l_returnflag") == "R"), " 등록 말소 ").alias("status"),
        F.when(number == 4, "women_owned_business").alias("kind"), F.when(number.isin(3, 4, 5, 7), day).alias("valid_from"), F.when(number.isin(4, 7), F.date_add(day, 900)).alias("valid_until"),
    )
    names = ["business_status_active", "procurement_supplier_registered", "industry_registration_matches", "participation_region_matches", "qualification_valid",
             "company_scale_qualification_valid", "consortium_participation_allowed", "product_certificate_valid", "product_registration_matches", "no_active_sanction"]
    status, priority, k = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1), F.col("o_orderkey") % 10
    own = F.concat(F.lit("C-"), F.lpad((F.col("o_custkey") % 50).cast("string"), 2, "0"))
    arguments = (
        F.when(k == 2, F.concat(F.lit('{"expected_value": ["'), own, F.lit('"]}')))
        .when((k == 4) & (status == "O"), '{"qualification_type": "innobiz"}').when((k == 4) & (status == "P"), '{"qualification_type": "other"}')
        .when((k == 5) & (status == "F"), '{"company_scale": []}').when(k == 5, '{"company_scale": "small"}')
        .when((k == 6) & (priority == "5"), '{"consortium_allowed": "no"}')
        .when((k == 7) & (status != "F"), F.concat(F.lit('{"product_code": "c'), F.lpad((F.col("o_custkey") % 50).cast("string"), 2, "0"), F.lit('"}')))
        .otherwise("not an object")
    )
    value = (
        F.when((k == 3) & (status != "P"), F.concat(F.lit('{"items": ["region '), (F.col("o_custkey") % 7).cast("string"), F.lit(', main"]}')))
        .when((k == 6) & (priority == "3"), '{"boolean": true}').when(k == 8, F.concat(F.lit('{"attributes": [{"name": "code", "value": "'), own, F.lit('"}]}')))
    )
    requirements = o.select(
        F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("notice_id"), F.get(F.array(*[F.lit(n) for n in names]), k.cast("int")).alias("rule"),
        F.when(status == "F", "is_valid_women_owned_business").alias("rule_id"), arguments.alias("arguments"), value.alias("value"),
        F.when(status == "F", "not_exists").alias("operator"), F.when(status == "O", "제재 없음").alias("original_text"),
        F.when(priority == "2", "other").when(priority.isin("3", "4", "5"), "consortium").alias("mode"),
    )
    return rules.assess(requirements, facts, F.lit("1996-01-01").cast("date")).select("notice_id", "reason")


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, lpad(CAST(year(o_orderdate) AS VARCHAR), 4, '0') AS year, CAST(o_totalprice AS DECIMAL(38,2))::DOUBLE AS price,
  o_orderstatus = 'F' AS finished, list_distinct_names AS parts FROM (SELECT *, [split_part(o_orderpriority, '-', 1), split_part(o_orderpriority, '-', 2)] AS list_distinct_names FROM orders)
""")
def codec_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values through codecs and back."""
    o = table(spark, folder, "orders")
    day = codecs.format_date(codecs.parse_date(F.date_format("o_orderdate", "yyyy/MM/dd")))
    price = codecs.to_number(F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)).cast("double")
    finished = codecs.yes_no(F.when(F.col("o_orderstatus") == "F", " y ").otherwise("No"))
    return o.select("o_orderkey", day.alias("day"), codecs.format_year(F.year("o_orderdate")).alias("year"), price.alias("price"), finished.alias("finished"), codecs.names(F.regexp_replace("o_orderpriority", "-", " , ")).alias("parts"))


@query("""
SELECT o_orderkey, list_extract(x, 1) AS customer, list_extract(x, 2) AS status FROM (SELECT o_orderkey, [o_custkey::VARCHAR, '[' || o_orderstatus || ']'] AS x FROM orders)
""")
def bracket_records(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of records in brackets, with brackets inside fields."""
    text = F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit("^["), "o_orderstatus", F.lit("]]"))
    rows = table(spark, folder, "orders").select("o_orderkey", F.explode(codecs.bracket_list(text, 2)).alias("r"))
    return rows.select("o_orderkey", F.col("r")[0].alias("customer"), F.col("r")[1].alias("status"))


@query("""
SELECT c_custkey, sha256('{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}') AS content_id,
  lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS uuid
FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer)
""")
def content_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids from canonical content and from names."""
    return table(spark, folder, "customer").select("c_custkey", content_id({"segment": F.col("c_mktsegment"), "name": F.col("c_name")}).alias("content_id"), uuid5(F.col("c_name")).alias("uuid"))


@query("""
WITH m AS (SELECT l_orderkey, l_partkey, min(l_tax) AS confidence, bool_or(l_returnflag = 'A') AS mandatory, list_sort(list(DISTINCT l_suppkey)) AS evidence,
  arg_min(l_linestatus, struct_pack(q := l_quantity, s := l_suppkey, n := l_linenumber, t := l_linestatus)) AS shortest FROM lineitem GROUP BY 1, 2)
SELECT * FROM m WHERE len(evidence) > 1
""")
def semantic_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicates of a requirement in one: least confidence, any mandatory, all evidence, shortest text."""
    m = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.min("l_tax").alias("confidence"), F.bool_or(F.col("l_returnflag") == "A").alias("mandatory"), F.sort_array(F.collect_set("l_suppkey")).alias("evidence"),
        F.min_by("l_linestatus", F.struct("l_quantity", "l_suppkey", "l_linenumber", "l_linestatus")).alias("shortest"),
    )
    return m.where(F.size("evidence") > 1)


@query("""
WITH r AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY n DESC) AS place, count(*) OVER (PARTITION BY p_brand, n) AS ties FROM r)
SELECT p_brand, p_type, n FROM k WHERE place = 1 AND ties = 1
""")
def unambiguous_best(spark: SparkSession, folder: str) -> DataFrame:
    """The best of each group, unless it shares its rank."""
    r = table(spark, folder, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    k = r.withColumn("place", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("n")))).withColumn("ties", F.count("*").over(Window.partitionBy("p_brand", "n")))
    return k.where("place = 1 and ties = 1").select("p_brand", "p_type", "n")
