"""Facts of requirements: extraction by patterns, repair rules, binding, hydration, validation, aliases."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.match import let
from ..operators.state import checkpointed
from ..sources.blocks import clauses


@dataclass(frozen=True)
class Repair:
    """Where the condition holds, columns get new values; or, with drop, the row goes. With review the text becomes an unresolved candidate."""

    name: str
    when: Column
    then: dict[str, Column] | None = None
    drop: bool = False
    #: Why the row's text is left to a person, and whether that blocks a decision.
    review: str | None = None
    blocks: bool = True


def extracted(rows: DataFrame, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each match of each pattern: fact_type, value (its group 1) and all other columns.

    ``patterns`` maps a fact type to a pattern and a condition pattern that the text must hold.
    """
    found = [_matches(text, kind, p, needed) for kind, (p, needed) in patterns.items()]
    return rows.withColumn("_f", F.explode(F.concat(*found))).select(*[c for c in rows.columns if c != text], "_f.*")


def _matches(text: str, kind: str, pattern: str, needed: str) -> Column:
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    structs = F.transform(values, lambda v: F.struct(F.lit(kind).alias("fact_type"), v.alias("value")))
    return F.when(F.col(text).rlike(needed), structs).otherwise(F.array().cast("array<struct<fact_type:string,value:string>>"))


def repaired(rows: DataFrame, repairs: Sequence[Repair]) -> DataFrame:
    """All repairs in order, each on what the ones before have left; adds repairs, the names of those that applied."""
    out = rows.withColumn("repairs", F.array().cast("array<string>"))
    for r in repairs:
        hit = F.coalesce(r.when, F.lit(False))
        if r.drop:
            out = out.where(~hit)
            continue
        out = out.withColumn("_hit", hit)
        for column, value in (r.then or {}).items():
            out = out.withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column)))
        out = out.withColumn("repairs", F.when(F.col("_hit"), F.array_append("repairs", F.lit(r.name))).otherwise(F.col("repairs"))).drop("_hit")
    return out


def repaired_with_review(rows: DataFrame, repairs: Sequence[Repair], case: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``repaired`` rows, and the candidates (case, text, review_reason, blocks) that repairs left to a person, each once.

    A dropped row sees no later repair. Both sides come from one pass over the rows, which is
    written to the shared folder: else the optimiser would push what tells them apart through
    every repair, into a condition that doubles with each.
    """
    none = F.array().cast("array<struct<reason:string,blocks:boolean>>")
    out = rows.withColumns({"repairs": F.array().cast("array<string>"), "_reviews": none, "_gone": F.lit(False)})
    for r in repairs:
        out = out.withColumn("_hit", ~F.col("_gone") & F.coalesce(r.when, F.lit(False)))
        for column, value in (r.then or {}).items():
            out = out.withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column)))
        added = {"repairs": F.when(F.col("_hit"), F.array_append("repairs", F.lit(r.name))).otherwise(F.col("repairs"))}
        if r.review:
            added["_reviews"] = F.when(F.col("_hit"), F.array_append("_reviews", F.struct(F.lit(r.review).alias("reason"), F.lit(r.blocks).alias("blocks")))).otherwise(F.col("_reviews"))
        if r.drop:
            added["_gone"] = F.col("_gone") | F.col("_hit")
        out = out.withColumns(added).drop("_hit")
    out = checkpointed(out)
    candidates = out.where(F.size("_reviews") > 0).select(case, F.col(text).alias("text"), F.explode("_reviews").alias("_r")).select(case, "text", F.col("_r.reason").alias("review_reason"), F.col("_r.blocks").alias("blocks"))
    return out.where(~F.col("_gone")).drop("_reviews", "_gone"), candidates.distinct()


def reconciled(rows: DataFrame) -> DataFrame:
    """original_text that stands in some evidence, and a proposition that stands in it.

    Of rows with original_text, proposition_text, value_text and evidence (texts): where no
    evidence holds the original text, the shortest takes its place, the first of equals; where
    the original doesn't hold the proposition, the value's text does if it is there, else the
    whole original. Adds proposition_start and proposition_end (exclusive), in code points.
    """
    texts = F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: e.isNotNull())
    shortest = F.array_min(F.transform(texts, lambda e, i: F.struct(F.length(e).alias("n"), i.alias("i"), e.alias("e"))))["e"]
    held = F.exists(texts, lambda e: e.contains(F.col("original_text")))
    out = rows.withColumn("original_text", F.when(F.coalesce(held, F.lit(False)), F.col("original_text")).otherwise(F.coalesce(shortest, F.col("original_text"))))
    original = F.col("original_text")
    trimmed = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", "")
    stands = lambda c: (trimmed(c) != "") & original.contains(trimmed(c))
    out = out.withColumn("proposition_text", F.when(stands("proposition_text"), trimmed("proposition_text")).when(stands("value_text"), trimmed("value_text")).otherwise(original))
    start = F.position("proposition_text", original) - 1
    return out.withColumn("proposition_start", start).withColumn("proposition_end", start + F.length("proposition_text"))


#: Length and line ends from which a proposition that is its whole original is too wide.
WIDE, LINE_ENDS = 240, 3
_WORDS = "[0-9A-Za-z가-힣]+"


def atomic(rows: DataFrame, key: str, markers: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose wide propositions are cut to one clause, and the (key, original_text) of those for which none is certain.

    A proposition that is its whole original (or isn't in it) is too wide if that has 240
    characters or three line ends. Of its clauses (``sources.blocks.clauses``) that the type's
    marker finds, the one with most of the value's words (value_words, of two letters or more)
    counts, the shorter of equals; not if none has a word and there are several, or if the
    second has as many words and another text. A type without a marker is never certain.
    """
    original = F.col("original_text")
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    both = F.struct(trimmed(F.coalesce(F.col("proposition_text"), F.lit(""))).alias("p"), trimmed(original).alias("o"))
    whole = let(both, lambda t: (t["p"] == "") | (t["p"] == t["o"]) | ~original.contains(t["p"]))
    wide = ((F.length(original) >= WIDE) | (F.length(original) - F.length(F.replace(original, F.lit("\n"), F.lit(""))) >= LINE_ENDS)) & whole
    marked = rows.withColumn("_wide", F.coalesce(wide, F.lit(False)))
    wanted = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.lower(F.concat_ws(" ", F.col("value_words"))), F.lit(_WORDS), F.lit(0)), lambda w: w), lambda w: F.length(w) >= 2))
    open_ = marked.where("_wide").select(key, F.col("type").alias("_type"), wanted.alias("_wanted"), "original_text")
    hit = F.lit(False)
    for kind, pattern in markers.items():
        hit = F.when(F.col("_type") == kind, F.col("clause").rlike(pattern)).otherwise(hit)
    # What a clause is judged by travels with it, so that no text is joined.
    parts = clauses(open_, key, "original_text", ["_type", "_wanted"]).where(hit)
    words = F.array_distinct(F.regexp_extract_all(F.lower("clause"), F.lit(_WORDS), F.lit(0)))
    overlap = F.size(F.array_intersect("_wanted", words)) / F.greatest(F.size("_wanted"), F.lit(1))
    w = Window.partitionBy(key).orderBy(F.desc("_overlap"), F.length("clause"), "clause_start")
    ranked = parts.withColumn("_overlap", overlap).withColumns({"_place": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(key)), "_next": F.lead(F.struct("_overlap", "clause")).over(w)})
    same = F.coalesce((F.col("_next._overlap") == F.col("_overlap")) & (F.col("_next.clause") != F.col("clause")), F.lit(False))
    best = ranked.where((F.col("_place") == 1) & ~((F.col("_overlap") == 0) & (F.col("_n") > 1)) & ~same).select(key, F.col("clause").alias("_clause"), F.col("clause_start").alias("_start"), F.col("clause_end").alias("_end"))
    best = checkpointed(best)
    cut = {"proposition_text": "_clause", "proposition_start": "_start", "proposition_end": "_end"}
    wide_rows = marked.where("_wide")
    certain = wide_rows.drop(*cut).join(best.withColumnsRenamed({v: k for k, v in cut.items()}), key).select(*rows.columns)
    return marked.where("not _wide").select(*rows.columns).union(certain), wide_rows.join(best, key, "left_anti").select(key, "original_text")


#: Types whose codes tell requirements apart, what a code looks like, and the wording that forbids joint bids.
CODED_TYPES = ("industry_license", "product_registration", "certificate", "procurement_registration")
_CODE = "^[0-9A-Za-z-]{3,}$"
_JOINT_DENIAL = r"(공동수급|공동계약|공동도급|컨소시엄).{0,16}(불가|불허|금지|허용하지|인정하지)|단독이행이?\s*가능해야|단독(이행|\s*참가).{0,8}(하여야|해야|한함)|단독으로만"


def merge_key(letters: Callable[[Column], Column], joint: str = _JOINT_DENIAL) -> Column:
    """What requirements with one meaning have in common: the base fields with codes, else the value's text, else the original; null without any.

    Of rows with the base fields, value_text, items, attributes (an array of name and value),
    proposition_text and original_text. ``letters`` gives a text's letters and digits.
    """
    base = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("type", "operator", "holder_scope", "reference_date_type", "assessment_stage", "failure_effect", "comparison_mode")]
    items = F.filter(F.coalesce("items", F.array().cast("array<string>")), lambda i: i.rlike(_CODE))
    named = F.filter(F.coalesce("attributes", F.array().cast("array<struct<name:string,value:string>>")), lambda a: (F.lower(a["name"]).contains("code") | a["name"].contains("번호")) & F.trim(a["value"]).rlike(_CODE))
    codes = F.array_sort(F.array_distinct(F.transform(F.concat(items, F.transform(named, lambda a: F.trim(a["value"]))), lambda c: F.lower(c))))
    said = F.concat_ws(" ", F.when(F.trim(F.coalesce("proposition_text", F.lit(""))) != "", F.col("proposition_text")).otherwise(F.col("original_text")), "value_text")
    forbids = (F.col("type") == "consortium") & said.rlike(joint)
    text, original = letters(F.lower(F.coalesce("value_text", F.lit("")))), letters(F.lower(F.coalesce("original_text", F.lit(""))))
    key = lambda *parts: F.concat_ws("|", *parts)
    return (
        F.when(forbids, key(base[0], F.lit("joint_participation_not_allowed"), *base[2:6]))
        .when((F.size(codes) > 0) & F.col("type").isin(*CODED_TYPES), key(*base, F.lit("codes"), F.array_join(codes, ",")))
        .when((F.col("type") != "custom") & (text != ""), key(*base, F.lit("text"), text))
        .when(original != "", key(*base, F.lit("exact"), original))
    )


#: What failing a requirement of a stage can lead to.
EFFECTS = {"bid_entry": ("cannot_bid", "invalid_bid", "needs_review"), "qualification_review": ("qualification_rejection", "needs_review"), "contracting": ("cannot_contract", "needs_review")}


def semantic_faults(rows: DataFrame, case: str, key: Sequence[str]) -> DataFrame:
    """case, id and code of requirements that break a rule.

    duplicate_requirement_id; assessment_stage_effect_mismatch; ambiguous_effect_requires_review;
    duplicate_proof_id; invalid_proposition_span; original_text_must_be_verbatim_evidence;
    custom_duplicates_known_requirement (a custom one with the ``key`` of another type);
    duplicate_requirement_proposition (type and ``key`` twice). Rows have id, type,
    assessment_stage, failure_effect, review_status, proof_ids, original_text,
    proposition_text, proposition_start, proposition_end and evidence (texts).
    """
    allowed = F.create_map(*[x for stage, effects in EFFECTS.items() for x in (F.lit(stage), F.array(*map(F.lit, effects)))])
    stage, effect = F.coalesce("assessment_stage", F.lit("bid_entry")), F.coalesce("failure_effect", F.lit("cannot_bid"))
    start, end = F.col("proposition_start"), F.col("proposition_end")
    same = Window.partitionBy(case, *key)
    counted = rows.withColumns({
        "_ids": F.count("*").over(Window.partitionBy(case, "id")), "_same": F.count("*").over(Window.partitionBy(case, "type", *key)),
        "_custom": F.max((F.col("type") == "custom").cast("int")).over(same), "_known": F.max((F.col("type") != "custom").cast("int")).over(same),
    })
    proofs = F.coalesce("proof_ids", F.array().cast("array<string>"))
    span = (start >= 0) & (end > start) & (F.substr("original_text", start + 1, end - start) == F.col("proposition_text"))
    held = F.exists(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: e.contains(F.col("original_text")))
    codes = {
        "duplicate_requirement_id": F.col("_ids") > 1,
        "assessment_stage_effect_mismatch": ~F.coalesce(F.array_contains(F.element_at(allowed, stage), effect), F.lit(False)),
        "ambiguous_effect_requires_review": (effect == "needs_review") & ~F.coalesce(F.col("review_status") == "needs_review", F.lit(False)),
        "duplicate_proof_id": F.size(proofs) != F.size(F.array_distinct(proofs)),
        "invalid_proposition_span": ~F.coalesce(span, F.lit(False)),
        "original_text_must_be_verbatim_evidence": ~F.coalesce(held, F.lit(False)),
        "custom_duplicates_known_requirement": (F.col("type") == "custom") & (F.col("_known") == 1),
        "duplicate_requirement_proposition": F.col("_same") > 1,
    }
    found = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in codes.items()]))
    return counted.select(case, "id", F.explode(found).alias("code")).distinct()


def hydrated(rows: DataFrame, source: DataFrame, key: Sequence[str], attributes: str = "attributes") -> DataFrame:
    """Attributes of a structured source added to a row's own map; the row's own values stay."""
    joined = rows.join(source.withColumnRenamed(attributes, "_more"), list(key), "left")
    none = F.create_map().cast("map<string,string>")
    own, more = F.coalesce(attributes, none), F.coalesce("_more", none)
    fresh = F.map_filter(more, lambda k, v: ~F.map_contains_key(own, k) & v.isNotNull())
    return joined.withColumn(attributes, F.map_concat(own, fresh)).drop("_more")


def pruned(rows: DataFrame, evidence: str, source: str = "source") -> DataFrame:
    """Evidence of other sources than the row's own removed, unless that would leave none."""
    own = F.filter(evidence, lambda e: e["source"].eqNullSafe(F.col(source)))
    return rows.withColumn(evidence, F.when(F.size(own) > 0, own).otherwise(F.col(evidence)))


def structured_expression(rows: DataFrame, notice: str, group: str, requirement: str) -> DataFrame:
    """any() within each group of a notice, all() across groups; single parts stand for themselves."""
    parts = rows.select(notice, group, requirement).distinct().groupBy(notice, group).agg(F.array_sort(F.collect_list(requirement)).alias("_p"))

    def of(op: str, p: Column) -> Column:
        return F.when(F.size(p) == 1, p[0]).otherwise(F.concat(F.lit(f"{op}("), F.array_join(p, ","), F.lit(")")))

    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), of("any", F.col("_p")).alias("e")))), lambda x: x["e"])
    return parts.groupBy(notice).agg(ordered.alias("_all")).select(notice, of("all", F.array_distinct("_all")).alias("expression"))


def violations(rows: DataFrame, key: Sequence[str], text: str, proposition: str, start: str, end: str, merge: Sequence[str], polarity: str) -> DataFrame:
    """key and code: span (the proposition isn't the text between its offsets), duplicate, conflict (one merge key, two polarities)."""
    span = F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start)) == F.col(proposition)
    spans = rows.where(~F.coalesce(span, F.lit(False))).select(*key, F.lit("span").alias("code"))
    w = Window.partitionBy(*merge)
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*merge, polarity))).withColumn("_low", F.min(polarity).over(w)).withColumn("_high", F.max(polarity).over(w))
    twice = counted.where("_n > 1").select(*key, F.lit("duplicate").alias("code"))
    conflict = counted.where("_low <> _high").select(*key, F.lit("conflict").alias("code"))
    return spans.union(twice).union(conflict)


def realiased(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Leaves renamed by (tree_id, leaf_id, new_id); siblings that are then the same count once, the first node stays."""
    named = nodes.join(aliases, ["tree_id", "leaf_id"], "left").withColumn("leaf_id", F.coalesce("new_id", "leaf_id")).drop("new_id")
    place = F.row_number().over(Window.partitionBy("tree_id", "parent_id", "leaf_id").orderBy("node_id"))
    leaves = named.where("op = 'leaf'").withColumn("_n", place).where("_n = 1").drop("_n")
    return named.where("op <> 'leaf'").unionByName(leaves)


def combinations(children: DataFrame, parents: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Each child with every combination of its record's parents; none without a parent of each role. A record's roles bound the product."""
    out = children
    for p in parents:
        out = out.join(p, list(key))
    return out
