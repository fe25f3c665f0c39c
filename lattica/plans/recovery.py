"""Requirements that were left out, recovered from the blocks: uncovered spans, gates as data, alternatives."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.match import let

#: What a gate may say of the requirement that it makes, besides its text; all are strings but number.
FACTS = ("type", "operator", "value_text", "holder_scope", "reference_date_type", "assessment_stage", "failure_effect", "comparison_mode")


def uncovered(spans: DataFrame, covers: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """The spans (key, start, end, ...) that lie in no single cover (key, start, end).

    One sweep over starts: a span is covered if a cover that starts no later ends no earlier.
    No span meets a cover otherwise, so many of both in one document cost a sort. Null ends
    are in no cover; repeated spans stay.
    """
    own = spans.select(F.col(key), F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_z"), F.lit(1).alias("_kind"), F.struct("*").alias("_row"))
    other = covers.select(F.col(key), F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_z"), F.lit(0).alias("_kind"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"))
    so_far = Window.partitionBy(key).orderBy("_a", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when((F.col("_kind") == 0) & F.col("_a").isNotNull(), F.col("_z"))).over(so_far)
    swept = own.where(F.col(key).isNotNull()).union(other).withColumn("_reach", reach)
    open_ = F.col("_a").isNull() | F.col("_z").isNull() | F.col("_reach").isNull() | (F.col("_reach") < F.col("_z"))
    return swept.where((F.col("_kind") == 1) & open_).select("_row.*").union(spans.where(F.col(key).isNull()))


def letters(text: Column) -> Column:
    """Letters and digits alone."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


@dataclass(frozen=True)
class Gate:
    """A sentence that stands for a requirement, and the requirement.

    ``facts`` and ``attributes`` are values, or functions that make a column of the match
    (original_text, number, name). ``number`` and ``names`` are groups of the pattern: the
    value's number, and the first of those that hold something. ``heading`` must begin no later
    in the block, and end ``within`` characters before at most. ``column`` is what is searched.

    ``known`` is an SQL condition that says of a row of requirements whether it is this one
    already; with ``once`` "number" only if its number is the same. ``said`` is one that says
    whose texts may hold this one's already; with ``further`` other texts may as well. ``once`` is how often a gate is recovered in a
    case: "case", or for each "text" or "number". ``proposition`` is the part of the match
    that says it.
    """

    name: str
    pattern: str
    facts: Mapping[str, str | Callable[[], Column]]
    attributes: Mapping[str, str | Callable[[], Column]] = field(default_factory=dict)
    known: str | None = None
    said: str | None = None
    further: bool = False
    once: str = "case"
    heading: str | None = None
    within: int = 1500
    number: int | None = None
    names: tuple[int, ...] = ()
    column: str = "text"
    proposition: str | None = None
    prunes: bool = False


def with_next(blocks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds joined: a block's text, with the next one's where both are pieces of one parent."""
    w = Window.partitionBy(*key).orderBy("block_index")
    goes_on = F.coalesce(F.col("parent") == F.lead("parent").over(w), F.lit(False))
    return blocks.withColumn("joined", F.when(goes_on, F.concat(F.rtrim("text"), F.lit(" "), F.ltrim(F.lead("text").over(w)))).otherwise(F.col("text")))


def matches(blocks: DataFrame, gates: Sequence[Gate], case: str) -> DataFrame:
    """case, document, block_index, gate, original_text, number and name of the first match of each gate in each block. One scan of the blocks."""
    found = []
    for g in gates:
        text = F.col(g.column)
        whole, group = F.regexp_extract(text, g.pattern, 0), lambda i, g=g, text=text: F.regexp_extract(text, g.pattern, i)
        hit = text.rlike(g.pattern)
        if g.heading:
            head = F.regexp_extract(text, g.heading, 0)
            begun = F.position(head, text)
            hit = hit & text.rlike(g.heading) & (F.position(whole, text) >= begun) & (F.position(whole, text) - begun - F.length(head) <= g.within)
        number = group(g.number).cast("double") if g.number is not None else F.lit(None).cast("double")
        name = F.coalesce(*[F.when(group(i) != "", F.trim(group(i))) for i in g.names], F.lit(None).cast("string"))
        found.append(F.when(hit, F.struct(F.lit(g.name).alias("gate"), F.regexp_replace(whole, r"(?U)^\s+|\s+$", "").alias("original_text"), number.alias("number"), name.alias("name"))))
    each = F.explode(F.array_compact(F.array(*found))).alias("_m")
    return blocks.select(case, "document", "block_index", each).select(case, "document", "block_index", "_m.*")


def _given(gates: Sequence[Gate], of: Callable[[Gate], str | Callable[[], Column] | None]) -> Column:
    """A value for each gate."""
    out = F.lit(None).cast("string")
    for g in gates:
        value = of(g)
        if value is not None:
            out = F.when(F.col("gate") == g.name, F.lit(value) if isinstance(value, str) else value()).otherwise(out)
    return out


def recovered(blocks: DataFrame, requirements: DataFrame, gates: Sequence[Gate], case: str, said: DataFrame | None = None) -> DataFrame:
    """The requirements that gates find in blocks (case, document, block_index, text) and that a case lacks.

    Columns: case, id, gate, document, block_index, original_text, proposition_text and its
    places, number, attributes and FACTS. ``requirements`` has case, id, original_text and what
    the gates' conditions look at; ``said`` (case, text) are further texts that may hold a match
    already. Of several matches in a case the first by document and block counts, or the first
    of each text or number. Ids go on from the case's number of requirements, past those in
    use. Null texts match nothing; a case may have no requirements.
    """
    own = requirements.withColumn("_letters", letters(F.coalesce("original_text", F.lit(""))))
    known, saying = [g for g in gates if g.known], [g for g in gates if g.said]
    numbers = F.col("number") if "number" in requirements.columns else F.lit(None)
    hit = lambda g: F.coalesce(F.expr(g.known), F.lit(False))
    by_case = own.groupBy(case).agg(
        F.count("*").alias("_rows"),
        *[(F.collect_set(F.when(hit(g), numbers.cast("double"))) if g.once == "number" else F.bool_or(hit(g))).alias(f"_known_{g.name}") for g in known],
        *[F.concat_ws("\n", F.collect_list(F.when(F.coalesce(F.expr(g.said), F.lit(False)), F.col("_letters")))).alias(f"_said_{g.name}") for g in saying],
    )
    found = matches(blocks, gates, case).join(by_case, case, "left")
    if said is not None:
        more = said.groupBy(case).agg(F.concat_ws("\n", F.collect_list(letters(F.col("text")))).alias("_more"))
        found = found.join(more, case, "left")
    else:
        found = found.withColumn("_more", F.lit(""))
    text = letters(F.col("original_text"))
    has = F.lit(False)
    for g in gates:
        own_has = F.lit(False)
        if g.known:
            own_has = own_has | (F.array_contains(f"_known_{g.name}", F.col("number")) if g.once == "number" else F.col(f"_known_{g.name}"))
        if g.said:
            own_has = own_has | F.coalesce(F.col(f"_said_{g.name}"), F.lit("")).contains(text)
        if g.further:
            own_has = own_has | F.coalesce("_more", F.lit("")).contains(text)
        has = F.when(F.col("gate") == g.name, F.coalesce(own_has, F.lit(False))).otherwise(has)
    apart = F.when(F.col("gate").isin([g.name for g in gates if g.once == "text"]), text).when(F.col("gate").isin([g.name for g in gates if g.once == "number"]), F.col("number").cast("string"))
    first = Window.partitionBy(case, "gate", apart).orderBy("document", "block_index")
    left = found.where(~has).withColumn("_place", F.row_number().over(first)).where("_place = 1").select(case, "gate", "document", "block_index", "original_text", "number", "name")
    order = F.element_at(F.create_map(*[x for i, g in enumerate(gates) for x in (F.lit(g.name), F.lit(i))]), F.col("gate"))
    out = numbered(left, requirements, case, [F.col("document"), F.col("block_index"), order])
    part = _given(gates, lambda g: (lambda: F.regexp_extract("original_text", g.proposition, 0)) if g.proposition else None)
    names = sorted({a for g in gates for a in g.attributes})
    attributes = F.create_map(*[x for a in names for x in (F.lit(a), _given(gates, lambda g, a=a: g.attributes.get(a)))]) if names else F.create_map().cast("map<string,string>")
    out = out.withColumn("proposition_text", F.coalesce(part, F.col("original_text"))).withColumn("proposition_start", F.position("proposition_text", "original_text") - 1)
    return out.select(
        case, "id", "gate", "document", "block_index", "original_text", "proposition_text", "proposition_start", (F.col("proposition_start") + F.length("proposition_text")).alias("proposition_end"), "number",
        F.map_filter(attributes, lambda _k, v: v.isNotNull()).alias("attributes"), *[_given(gates, lambda g, n=n: g.facts.get(n)).alias(n) for n in FACTS],
    )


def candidates(blocks: DataFrame, pattern: str, case: str, said: DataFrame, prefix: str, least: int) -> DataFrame:
    """case and text of all matches in blocks that no text of ``said`` (case, text) holds already, by letters and digits: without ``prefix``, of ``least`` characters or more, each once."""
    every = F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    found = blocks.select(case, every.alias("text")).select(case, F.regexp_replace(F.regexp_replace("text", prefix, ""), r"(?U)^\s+|\s+$", "").alias("text"))
    texts = said.groupBy(case).agg(F.concat_ws("\n", F.collect_list(letters(F.col("text")))).alias("_said"))
    left = found.where(F.length("text") >= least).join(texts, case, "left").where(~F.coalesce("_said", F.lit("")).contains(letters(F.col("text"))))
    return left.groupBy(case, letters(F.col("text")).alias("_letters")).agg(F.min("text").alias("text")).drop("_letters")


def placements(rows: DataFrame, case: str) -> DataFrame:
    """Recovered requirements hold in any case: scope common, no alternatives."""
    none = F.lit(None).cast("string")
    return rows.select(case, F.col("id").alias("requirement_id"), F.lit("common").alias("scope"), none.alias("alternative_group"), none.alias("alternative_branch"))


def pruned(unresolved: DataFrame, rows: DataFrame, gates: Sequence[Gate], case: str) -> DataFrame:
    """Unresolved candidates (case, text) that neither hold nor are part of what a pruning gate has recovered."""
    said = rows.where(F.col("gate").isin([g.name for g in gates if g.prunes])).groupBy(case).agg(F.collect_set(letters(F.col("original_text"))).alias("_said"))
    within = F.exists(F.coalesce("_said", F.array().cast("array<string>")), lambda s: let(letters(F.col("text")), lambda t: t.contains(s) | s.contains(t)))
    return unresolved.join(said, case, "left").where(~within).drop("_said")


def numbered(rows: DataFrame, used: DataFrame, case: str, order: Sequence[Column]) -> DataFrame:
    """Adds id: r and the next numbers of the case that ``used`` (case, id) has not, beyond how many it has."""
    taken = F.regexp_extract("id", "^r([0-9]+)$", 1)
    counts = used.groupBy(case).agg(F.count_distinct("id").cast("int").alias("_n"), F.collect_set(F.when(taken != "", taken.cast("int"))).alias("_taken"))
    w = Window.partitionBy(case)
    out = rows.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.count("*").over(w).cast("int")).join(counts, case, "left")
    n, none = F.coalesce("_n", F.lit(0)), F.array().cast("array<int>")
    free = F.array_except(F.sequence(n + 1, n + F.col("_all") + F.size(F.coalesce("_taken", none))), F.coalesce("_taken", none))
    return out.withColumn("id", F.concat(F.lit("r"), F.element_at(free, F.col("_k")))).drop("_k", "_all", "_n", "_taken")


def alternatives(requirements: DataFrame, clauses: DataFrame, terms: Mapping[str, str], case: str) -> DataFrame:
    """Both sides of an explicit "or" as branches of one group.

    ``clauses`` (case, block, clause) hold all ``terms``; ``requirements`` are (case, id, block,
    value_text). Where a clause's block has requirements, each term gets the first of them whose
    value names it and that no earlier term has taken; a term without one gets a copy of the
    first of the block under a new id. Columns: case, id, copy_of (null unless copied), block,
    value_text (the term), kind (what the term stands for), clause, proposition_start,
    proposition_end, alternative_group, alternative_branch. These rows replace the requirements
    of the same id, and their placements.
    """
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("int")
    told = clauses
    for term in terms:
        told = told.where(F.col("clause").contains(term))
    told = told.groupBy(case, "block").agg(F.min("clause").alias("clause"))
    near = requirements.join(told, [case, "block"]).withColumn("_order", F.struct(number.alias("n"), "id"))
    first = near.groupBy(case, "block").agg(F.min("_order").alias("_first"))
    rows, left = None, near
    for i, (term, kind) in enumerate(terms.items(), 1):
        own = left.where(F.col("value_text").contains(term)).groupBy(case, "block").agg(F.min("_order").alias("_own"))
        part = told.join(first, [case, "block"]).join(own, [case, "block"], "left").select(
            case, "block", F.col("_own.id").alias("id"), F.when(F.col("_own").isNull(), F.col("_first.id")).alias("copy_of"), F.lit(term).alias("value_text"), F.lit(kind).alias("kind"),
            "clause", (F.position(F.lit(term), "clause") - 1).alias("proposition_start"), (F.position(F.lit(term), "clause") - 1 + F.length(F.lit(term))).alias("proposition_end"),
            F.concat(F.lit("alternatives_"), F.col("block").cast("string")).alias("alternative_group"), F.lit(f"branch_{i}").alias("alternative_branch"),
        )
        rows = part if rows is None else rows.union(part)
        left = left.join(own.select(case, "block", F.col("_own").alias("_order")), [case, "block", "_order"], "left_anti")
    fresh = numbered(rows.where("id is null").drop("id"), requirements, case, [F.col("block"), F.col("alternative_branch")])
    return rows.where("id is not null").unionByName(fresh)
