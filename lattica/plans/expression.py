"""Requirement expressions: compiled from placements, folded over outcomes.

A tree is a table of nodes (tree_id, node_id, parent_id, depth, op, leaf_id); op is all, any,
not or leaf.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logic
from ..operators.state import checkpointed


def compiled(placements: DataFrame, case: str = "case_id") -> DataFrame:
    """case, expression (compact text) of (case, requirement_id, scope, alternative_group, alternative_branch).

    Within a scope, leaves outside alternatives and one any() for each group of alternatives;
    a branch is the all() of its leaves. Scopes single and consortium are alternatives of each
    other, common holds for both. One part alone stands for itself, equal parts count once.
    """

    def joined(op: str, parts: Column) -> Column:
        own = F.array_distinct(F.filter(parts, lambda p: p.isNotNull() & (p != "")))
        return F.when(F.size(own) == 1, own[0]).when(F.size(own) > 1, F.concat(F.lit(f"{op}("), F.array_join(own, ","), F.lit(")")))

    def ordered(value: str, by: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.col(value).alias("v")))), lambda x: x["v"])

    rows = placements.withColumn("_branch", F.coalesce("alternative_branch", F.lit("")))
    branches = rows.groupBy(case, "scope", "alternative_group", "_branch").agg(joined("all", ordered("requirement_id", "requirement_id")).alias("_part"), F.min("requirement_id").alias("_first"))
    alternatives = branches.where("alternative_group is not null").groupBy(case, "scope", "alternative_group").agg(joined("any", ordered("_part", "_branch")).alias("_part"), F.min("_first").alias("_first"))
    plain = rows.where("alternative_group is null").select(case, "scope", F.lit(None).cast("string").alias("alternative_group"), F.col("requirement_id").alias("_part"), F.col("requirement_id").alias("_first"))
    parts = plain.unionByName(alternatives).withColumn("_order", F.struct(F.col("alternative_group").isNotNull(), "_first", "_part"))
    scopes = parts.groupBy(case, "scope").agg(joined("all", ordered("_part", "_order")).alias("_scope_part"))
    by_case = scopes.groupBy(case).agg(*[F.max(F.when(F.col("scope") == s, F.col("_scope_part"))).alias(s) for s in ("common", "single", "consortium")])
    root = joined("all", F.array(F.col("common"), joined("any", F.array("single", "consortium"))))
    return by_case.select(case, F.coalesce(root, F.lit("all()")).alias("expression"))


def folded(nodes: DataFrame, outcomes: DataFrame, depth: int) -> DataFrame:
    """tree_id and outcome of the root, from outcomes (tree_id, leaf_id, outcome).

    One aggregate for each level, from the deepest up, over that level and its leaves alone;
    ``depth`` is the greatest depth, the
    root's is 0. Missing leaves, operators without children, a not with other than one child
    and unknown operators need review.
    """
    found = nodes.where("op = 'leaf'").join(outcomes, ["tree_id", "leaf_id"], "left")
    leaves = checkpointed(found.select("tree_id", "node_id", "parent_id", "depth", F.coalesce("outcome", F.lit(logic.REVIEW)).alias("outcome")))
    inner = nodes.where("op <> 'leaf'")
    known = leaves.where(F.col("depth") == depth)
    for level in range(depth - 1, -1, -1):
        below = known.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(
            F.min("outcome").alias("least"), F.max("outcome").alias("most"), F.count("*").alias("n")
        )
        here = inner.where(F.col("depth") == level).join(below, ["tree_id", "node_id"], "left")
        result = (
            F.when(F.coalesce("n", F.lit(0)) == 0, logic.REVIEW)
            .when(F.col("op") == "all", F.col("least"))
            .when(F.col("op") == "any", F.col("most"))
            .when((F.col("op") == "not") & (F.col("n") == 1), 2 - F.col("least"))
            .otherwise(logic.REVIEW)
        )
        known = leaves.where(F.col("depth") == level).union(here.select("tree_id", "node_id", "parent_id", "depth", result.alias("outcome")))
    return known.where("parent_id is null").select("tree_id", "outcome")


def faults(nodes: DataFrame) -> DataFrame:
    """tree_id and code: not_arity, empty, repeated_leaf (a leaf twice in one tree)."""
    children = nodes.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    sized = nodes.where("op <> 'leaf'").join(children, ["tree_id", "node_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    arity = sized.where("op = 'not' and n <> 1").select("tree_id", F.lit("not_arity").alias("code"))
    empty = sized.where("op <> 'not' and n = 0").select("tree_id", F.lit("empty").alias("code"))
    twice = nodes.where("op = 'leaf'").groupBy("tree_id", "leaf_id").count().where("count > 1").select("tree_id", F.lit("repeated_leaf").alias("code"))
    return arity.union(empty).union(twice).distinct()


def checked(nodes: DataFrame, expected: DataFrame, depth: int) -> DataFrame:
    """tree_id and code of what breaks a rule of expressions, with ``expected`` (tree_id, leaf_id) and the greatest depth.

    invalid_expression_leaf (a leaf that isn't expected, or has children);
    invalid_expression_node (an unknown operator, or one with a leaf's name);
    invalid_expression_not (other than one child); redundant_conjunctive_requirement (a leaf
    below two children of an all: under different children of an any it may stand twice);
    expression_requirement_coverage (an expected leaf that is nowhere).

    Every node carries the path of the alls above it and of the children that lead down from
    them, so that a leaf twice below one all shows as two children of one path.
    """
    parent = F.col("parent_id").alias("node_id")
    sizes = nodes.where("parent_id is not null").groupBy("tree_id", parent).agg(F.count("*").alias("n"))
    sized = nodes.join(sizes, ["tree_id", "node_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    known = sized.where("op = 'leaf'").join(expected.select("tree_id", "leaf_id", F.lit(True).alias("_expected")).distinct(), ["tree_id", "leaf_id"], "left")
    code = lambda df, name: df.select("tree_id", F.lit(name).alias("code"))
    found = [
        code(known.where("_expected is null or n > 0"), "invalid_expression_leaf"),
        code(sized.where("op <> 'leaf' and (op not in ('all', 'any', 'not') or leaf_id is not null)"), "invalid_expression_node"),
        code(sized.where("op = 'not' and n <> 1"), "invalid_expression_not"),
    ]
    none = F.array().cast("array<struct<node:string,child:string>>")
    name = F.col("node_id").cast("string")
    level = nodes.where("parent_id is null").select("tree_id", "node_id", "op", "leaf_id", none.alias("path"))
    leaves = level.where("op = 'leaf'")
    for d in range(1, depth + 1):
        above = level.where("op <> 'leaf'").select("tree_id", F.col("node_id").alias("parent_id"), F.col("op").alias("_op"), F.col("path").alias("_path"))
        step = F.when(F.col("_op") == "all", F.array_append("_path", F.struct(F.col("parent_id").cast("string").alias("node"), name.alias("child")))).otherwise(F.col("_path"))
        level = nodes.where(F.col("depth") == d).join(above, ["tree_id", "parent_id"]).select("tree_id", "node_id", "op", "leaf_id", step.alias("path"))
        leaves = leaves.union(level.where("op = 'leaf'"))
    ways = leaves.select("tree_id", "leaf_id", F.explode("path").alias("p")).groupBy("tree_id", "leaf_id", "p.node").agg(F.count_distinct("p.child").alias("ways"))
    found.append(code(ways.where("ways > 1"), "redundant_conjunctive_requirement"))
    missing = expected.select("tree_id", "leaf_id").join(nodes.where("op = 'leaf'").select("tree_id", "leaf_id"), ["tree_id", "leaf_id"], "left_anti")
    found.append(code(missing, "expression_requirement_coverage"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def simplified(placements: DataFrame, case: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """Placements without branches that hold all of another branch of their group, and requirements that are left without any.

    A or (A and B) is A. Of equal branches the first by name stays. Since holding all of a
    branch carries over, one pass leaves nothing more to drop. Every step keeps the case in its
    key, so that placements partitioned by case aren't shuffled again.
    """
    own = ["scope", "alternative_group", "alternative_branch"]
    grouped = placements.where("alternative_group is not null and alternative_branch is not null")
    sets = grouped.groupBy(case, *own).agg(F.collect_set("requirement_id").alias("leaves"))
    pairs = absorbed(sets.withColumnRenamed("alternative_branch", "branch"), [case, "scope"])
    back = pairs.select(case, "scope", "alternative_group", F.col("branch").alias("absorbed_by"), F.col("absorbed_by").alias("branch"), F.lit(True).alias("_mutual"))
    gone = pairs.join(back, [case, "scope", "alternative_group", "branch", "absorbed_by"], "left").where("_mutual is null or branch > absorbed_by")
    dropped = gone.select(case, "scope", "alternative_group", F.col("branch").alias("alternative_branch")).distinct()
    kept = placements.join(dropped, [case, *own], "left_anti").select(*placements.columns)
    left = placements.select(case, "requirement_id").distinct().join(kept.select(case, "requirement_id").distinct(), [case, "requirement_id"], "left_anti")
    return kept, left


def absorbed(branches: DataFrame, case: Sequence[str] = ("case_id",)) -> DataFrame:
    """Pairs of branches of one group (case_id, alternative_group, branch, leaves) of which the first holds all the second's leaves.

    ``case`` names the columns that stand for case_id; a branch has one row. Found by the
    leaves they share, so that only such branches meet.
    """
    group = [*case, "alternative_group"]
    leaves = F.array_distinct("leaves")
    one = branches.select(*group, "branch", F.explode(leaves).alias("leaf"))
    other = branches.select(*group, F.col("branch").alias("absorbed_by"), F.size(leaves).alias("size"), F.explode(leaves).alias("leaf"))
    shared = one.join(other, [*group, "leaf"]).where("branch <> absorbed_by")
    common = shared.groupBy(*group, "branch", "absorbed_by").agg(F.count("*").alias("common"), F.min("size").alias("size"))
    return common.where("common = size").select(*group, "branch", "absorbed_by")
