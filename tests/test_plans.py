"""Capabilities and facts on small declarations and frames."""

import pytest
from pyspark.sql import functions as F

from lattica.operators.relation import QueryError, Relation, Sort
from lattica.plans import capability as c
from lattica.plans import facts, graph
from lattica.queries.facts import SEARCH_ORDERS


def test_binding_rules():
    q = SEARCH_ORDERS.bind(status="F", text="", page=3)
    assert [(f.field, f.operator, f.value) for f in q.filters] == [("o_orderstatus", "eq", "F"), ("o_totalprice", "gte", 100000.0)]
    assert q.page.page == 3 and q.page.size == 20 and q.order_by[0].field == "o_orderdate" and q.search.value == ""
    for bad in ({"colour": 1}, {"status": "X"}, {"status": 1}, {"least_price": True}, {"sort": "oldest"}, {"page_size": 101}):
        with pytest.raises(QueryError):
            SEARCH_ORDERS.bind(**bad)
    needed = c.Capability("n", SEARCH_ORDERS.relation, SEARCH_ORDERS.mapping, [c.Input("day", "date", required=True, column="o_orderdate")])
    with pytest.raises(QueryError):
        needed.bind()
    assert str(needed.bind(day="2024-02-29").filters[0].value) == "2024-02-29"


def test_faults_of_declarations():
    assert c.faults(SEARCH_ORDERS) == []
    r = Relation("r", ("id",), ("key",))
    m = graph.Mapping("m", "op", ["id"], [graph.Role("x", "t", ["no"], [graph.Binding("no", ["nope"])], ["y"])], [graph.Link("l", "x", "z")])
    bad = c.Capability("b", r, m, [c.Input("a", "money", column="c"), c.Input("a", required=True, default=1, column="id")], {"s": [Sort("d")]}, ["u"])
    assert len(c.faults(bad)) == 10


def test_repairs_see_what_came_before(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    plan = [facts.Repair("one", F.col("x") == "a", {"x": F.lit("b")}), facts.Repair("two", F.col("x") == "b", {"x": F.lit("c")}), facts.Repair("out", F.col("x") == "z", drop=True)]
    got = sorted((r["x"] or "", tuple(r["repairs"])) for r in facts.repaired(df, plan).collect())
    assert got == [("", ()), ("c", ("one", "two")), ("c", ("two",))]


def test_aliases_merge_leaves(spark):
    nodes = spark.createDataFrame([("t", "0", None, "all", None), ("t", "1", "0", "leaf", "a"), ("t", "2", "0", "leaf", "b")], "tree_id string, node_id string, parent_id string, op string, leaf_id string")
    aliases = spark.createDataFrame([("t", "b", "a")], "tree_id string, leaf_id string, new_id string")
    assert sorted((r["node_id"], r["leaf_id"]) for r in facts.realiased(nodes, aliases).select("node_id", "leaf_id").collect()) == [("0", None), ("1", "a")]
