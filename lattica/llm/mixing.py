"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its size gives floor(r) whole copies of each document for
certain. The words that remain are drawn with unequal probabilities: a document's inclusion
probability grows with its weight, up to 1, so that the expected words are those that remain;
documents that reach 1 get one more certain copy. The others are ranked by random odds over
inclusion odds and taken in that order while this brings the sum of words nearer to what
remains.

Only sizes are sorted: where a source's order is cut is worked out on (key, size) rows, and
documents are then judged by that cut where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, empty_if_null, join_sized

#: Weights of the sources in the order of their names, repeating; null comes last.
WEIGHTS = (1, 2, 3)
#: A target stops at so many times its source's size.
MOST = 3
_BEFORE = (Window.unboundedPreceding, -1)
_FROM_HERE = (0, Window.unboundedFollowing)


def n_words(column: str = "text") -> Column:
    return F.regexp_count(empty_if_null(column), F.lit(WORD)).cast("long")


def inclusion_weight(size: Column) -> Column:
    """Whole square root of the size: longer documents are likelier to be drawn, but not in proportion."""
    return F.floor(F.sqrt(size.cast("double"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, rank, source_size, target for each source of ``sizes`` (source, size).

    The targets share the sum of all sizes by weight; what would exceed ``most`` times a
    source's size goes to the others by weight. With level L, a target is the lesser of its
    limit and L times its weight; L is the greatest of the levels that result when the
    sources with the least limits for their weight are filled first. One row for each source
    is all that the windows see.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = by_source.withColumn("rank", place)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    limited = ranked.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(*_BEFORE)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(*_FROM_HERE))
    level = F.max("own_level").over(everything)
    return (
        limited.withColumn("own_level", left / open_weight)
        .withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight")))
        .select("source", "rank", "source_size", "target")
    )


def shares(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row for each source: what it gives for certain, and the factor of its inclusion probabilities.

    ``sized`` has source, size and weight (of inclusion, a whole number). Columns: source,
    rank, source_size, target, n_docs, whole (certain copies of each document), share (what
    remains, as a part of the source), factor (a document's inclusion probability is factor
    times weight, 1 at most) and open_words (words to draw from documents below 1). The
    factor solves sum of size * least(1, factor * weight) = words that remain; the greatest
    weights are filled first, as sources are in ``targets``.
    """
    classes = checkpointed(sized.groupBy("source", "weight").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    plan = targets(classes, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("share", ratio - F.floor(ratio))
    remaining = F.col("target") - F.col("whole") * F.col("source_size")
    own = classes.withColumnRenamed("source", "s")
    joined = plan.join(own, plan["source"].eqNullSafe(own["s"])).drop("s").withColumn("remaining", remaining)
    order = Window.partitionBy("rank").orderBy(F.col("weight").desc())
    left = F.col("remaining") - F.coalesce(F.sum("size").over(order.rowsBetween(*_BEFORE)), F.lit(0))
    open_weight = F.sum(F.col("weight") * F.col("size")).over(order.rowsBetween(*_FROM_HERE))
    level = F.when((F.col("share") > 0) & (open_weight > 0), left / F.nullif(open_weight, F.lit(0)))
    factored = joined.withColumn("level", level).withColumn("factor", F.coalesce(F.max("level").over(Window.partitionBy("rank")), F.lit(0.0)))
    certain = F.when(F.col("factor") * F.col("weight") >= 1, F.col("size")).otherwise(0)
    return factored.groupBy("source", "rank", "source_size", "target", "whole", "share", "factor").agg(
        F.sum("n").alias("n_docs"), (F.max("remaining") - F.sum(certain)).alias("open_words")
    )


def _placed(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Adds the columns of the plan, and certain, open, odds and part, to rows with key, source, size and weight."""
    named = plan.select(F.col("source").isNotNull().alias("source_known"), F.coalesce("source", F.lit("")).alias("source_key"), *[c for c in plan.columns if c != "source"])
    # The null source is joined like any other value.
    both = rows.withColumn("source_known", F.col("source").isNotNull()).withColumn("source_key", F.coalesce("source", F.lit("")))
    joined = join_sized(both, named, ["source_known", "source_key"]).drop("source_known", "source_key")
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key")).cast("binary")), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    chance = F.col("factor") * F.col("weight")
    ranks = (F.col("share") > 0) & (F.col("size") > 0)
    # As many parts as a part has documents. Only the one where the order is cut is sorted. That is near odds of 1, where a part holds
    # 4 * chance * (1 - chance) times the average or less, whatever the probabilities are.
    return (
        joined.withColumn("certain", ranks & (chance >= 1))
        .withColumn("open", ranks & (chance < 1))
        .withColumn("odds", F.when(F.col("open"), uniform / (1 - uniform) / (chance / (1 - chance))))
        .withColumn("part", F.when(F.col("open"), F.floor((1 - 1 / (1 + F.col("odds"))) * F.ceil(F.sqrt("n_docs")))))
    )


_ORDER = ("odds", "key", "size")


def cuts(sized: DataFrame, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``shares`` with the place where each source's order is cut; ``sized`` (key, source, size, weight) must be cheap to read again.

    Parts of the order before stop_part are drawn, later ones not. Of stop_part, rows are
    drawn up to ``last``, in order of odds, key and size; of ``tied`` rows that equal it, ``drawn``.
    """
    plan = checkpointed(shares(sized, weights, most))
    placed = _placed(sized, plan, seed).where("open")
    sums = placed.groupBy("rank", "part", "open_words").agg(F.sum("size").alias("part_size"))
    upto = F.sum("part_size").over(Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    stops = sums.withColumn("upto", upto).where("upto > open_words").groupBy("rank").agg(
        F.min("part").alias("stop_part"), F.min_by(F.col("upto") - F.col("part_size"), "part").alias("before")
    )
    stops = checkpointed(stops)
    near = join_sized(placed, stops, ["rank"]).where("part = stop_part")
    within = F.sum("size").over(Window.partitionBy("rank").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0))
    judged = near.withColumn("taken", F.col("before") + within - F.col("size") / 2 <= F.col("open_words"))
    counted = judged.groupBy("rank", F.struct(*_ORDER).alias("place")).agg(F.count("*").alias("tied"), F.count_if("taken").alias("drawn")).where("drawn > 0")
    last = counted.groupBy("rank").agg(F.max("place").alias("last"), F.max_by("tied", "place").alias("tied"), F.max_by("drawn", "place").alias("drawn"))
    return checkpointed(plan.join(stops.drop("before"), "rank", "left").join(last, "rank", "left"))


def copies_of(rows: DataFrame, plan: DataFrame, seed: str = "mix") -> DataFrame:
    """The columns of ``rows`` (key, source, size, weight and others), source_size, target and copies, by a plan of ``cuts``.

    A narrow step, but for rows that repeat key and size just where the order is cut: of
    these, as many as the plan says.
    """
    kept = [*rows.columns, "source_size", "target"]
    placed = _placed(rows, plan, seed)
    place = F.struct(*_ORDER)
    before = F.col("stop_part").isNull() | (F.col("part") < F.col("stop_part"))
    here = F.coalesce(F.col("part") == F.col("stop_part"), F.lit(False)) & F.col("last").isNotNull()
    drawn = F.coalesce(F.col("certain") | (F.col("open") & (before | (here & (place <= F.col("last"))))), F.lit(False))
    copies = F.col("whole") + drawn.cast("long")
    if not plan.where("drawn < tied").limit(1).count():
        return placed.select(*kept, copies.alias("copies"))
    cut = F.coalesce(F.col("open") & here & (place == F.col("last")) & (F.col("drawn") < F.col("tied")), F.lit(False))
    number = F.row_number().over(Window.partitionBy("rank").orderBy("key"))
    split = placed.where(cut).withColumn("number", number).select(*kept, (F.col("whole") + (F.col("number") <= F.col("drawn")).cast("long")).alias("copies"))
    return placed.where(~cut).select(*kept, copies.alias("copies")).union(split)


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(empty_if_null("text").cast("binary")))
    counted = docs.select(key.alias("key"), F.col("source").cast("string").alias("source"), n_words().alias("size"), *more)
    return counted.withColumn("weight", inclusion_weight(F.col("size")))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document.

    Null text has size 0; documents without words get whole copies only; the null source is a
    source of its own and comes last; rows without a doc_id are told apart by their texts;
    repeated rows are drawn each for itself; an empty table gives an empty result. Reruns
    agree, since the random numbers are hashes of ``seed`` and doc_id. Extra columns have no
    effect.
    """
    sized = checkpointed(_sized(docs, F.col("doc_id")))
    return copies_of(sized, cuts(sized, seed), seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents as the mix takes them: each as many times as it has copies, all columns kept.

    Nulls, repeated rows and empty tables as in ``mix``. Texts are read twice and never shuffled.
    """
    plan = cuts(checkpointed(_sized(docs)), seed)
    chosen = copies_of(_sized(docs, F.struct(*docs.columns).alias("row")), plan, seed).where("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS k,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
weighted AS (SELECT *, CAST(floor(sqrt(CAST(size AS DOUBLE))) AS BIGINT) AS w FROM sized),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk FROM by_source),
limited AS (SELECT *, CAST(rnk % 3 + 1 AS DOUBLE) AS weight, 3 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM by_source) - coalesce(sum(cap) OVER (
      ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM limited),
aimed AS (SELECT *, least(CAST(cap AS DOUBLE), (SELECT max(own_level) FROM levels) * weight) AS target FROM levels),
shared AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio, floor(ratio) AS whole, ratio - floor(ratio) AS share,
    target - whole * source_size AS remaining FROM aimed),
classes AS (SELECT source, w, CAST(sum(size) AS BIGINT) AS class_size FROM weighted GROUP BY source, w),
filled AS (
  SELECT s.rnk, c.w, c.class_size, s.remaining, s.share,
    CAST(s.remaining - coalesce(sum(c.class_size) OVER (PARTITION BY s.rnk ORDER BY c.w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS remains,
    CAST(sum(c.w * c.class_size) OVER (PARTITION BY s.rnk ORDER BY c.w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open_weight
  FROM classes c JOIN shared s ON c.source IS NOT DISTINCT FROM s.source),
factors AS (SELECT rnk, coalesce(max(CASE WHEN share > 0 AND open_weight > 0 THEN remains / open_weight END), 0.0) AS factor FROM filled GROUP BY rnk),
opened AS (
  SELECT f.rnk, any_value(x.factor) AS factor, max(f.remaining) - sum(CASE WHEN x.factor * f.w >= 1 THEN f.class_size ELSE 0 END) AS open_words
  FROM filled f JOIN factors x ON f.rnk = x.rnk GROUP BY f.rnk),
chances AS (
  SELECT d.doc_id, d.k, d.size, s.source_size, s.target, s.rnk, s.whole, o.open_words, o.factor * d.w AS chance, s.share > 0 AND d.size > 0 AS ranks,
    (CAST(CAST('0x' || substr(md5('mix:' || d.k), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM weighted d JOIN shared s ON d.source IS NOT DISTINCT FROM s.source JOIN opened o ON s.rnk = o.rnk),
drawn AS (
  SELECT *, CASE WHEN ranks AND chance < 1 THEN 1 ELSE 0 END AS open, CASE WHEN ranks AND chance < 1 THEN u / (1 - u) / (chance / (1 - chance)) END AS odds FROM chances),
summed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY rnk, open ORDER BY odds, k, size ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto FROM drawn)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN ranks AND (chance >= 1 OR upto - size / 2.0 <= open_words) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM summed
"""
