"""Order MinHash fingerprints of documents, in DataFrame functions only.

The k-mers of a document are runs of K words, each numbered among its equals. Every sketch of
BINS keeps its TUPLE smallest, puts them back into the order of the text and hashes that tuple.
Equal order counts, so the share of equal sketches follows edit distance and not only the set
of k-mers.

The sketches are filled in rounds ("fast similarity sketching", Dahlgaard, Knudsen and Thorup,
2017) and not by BINS hashes of every k-mer: in each round every k-mer is hashed anew into one
sketch, and a k-mer of an earlier round is smaller than any of a later one. A round that comes
after a sketch is full changes nothing in it, so texts of different lengths stay comparable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, empty_if_null, shuffle_partitions

K = 5
BINS = 64
TUPLE = 2
#: K-mers that are hashed at least, over all rounds: ten for each sketch.
FILL = 10 * BINS
#: Bits of a packed element: 6 for the sketch, 34 of order, 24 for the place among the words.
#: The order is a 0 and 33 bits of hash in the first round, a 1, the round and 23 bits later.
_PLACE_BITS = 24
_MIX_BITS = 34
_LATER = 1 << 57
_ROUND = 47
_FIRST_HASH = ~(_LATER | ((1 << _PLACE_BITS) - 1))
_LATER_HASH = ~((1 << 58) - (1 << _ROUND) | ((1 << _PLACE_BITS) - 1))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def sketches(text: Column, k: int = K) -> Column:
    """An array of BINS sketches of 16 bits; -1 where a sketch has no k-mer.

    Texts of fewer than k words count as one k-mer, texts without words as none. K-mers beyond
    the first 16,777,215 share one place; among them the order of their hashes counts.
    """
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))
    place_mask = (1 << _PLACE_BITS) - 1

    def kmers(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        runs = let(
            hashed,
            lambda h: F.transform(
                F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
            ),
        )
        return F.when(F.size(w) >= k, runs).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>"))

    def packed(h: Column) -> Column:
        """Sorted, so that equal k-mers lie together in the order of the text."""
        return F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, _PLACE_BITS), _PLACE_BITS).bitwiseOR(F.least(i.cast("long"), F.lit(place_mask)))))

    def numbered(s: Column) -> Column:
        """The number of each element of ``s`` among its equals."""
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.shiftrightunsigned(F.get(s, i), _PLACE_BITS) != F.shiftrightunsigned(F.get(s, i - 1), _PLACE_BITS)),
        )
        return let(
            starts,
            lambda r: F.when(F.size(r) == F.size(s), F.array_repeat(F.lit(1), F.size(s))).otherwise(
                F.flatten(F.transform(r, lambda x, j: F.sequence(F.lit(1), F.coalesce(F.get(r, j + 1), F.size(s)) - x)))
            ),
        )

    def elements(s: Column) -> Column:
        """Sketch, order and place of every numbered k-mer in every round, sorted."""

        def kmer(x: Column, number: Column) -> list[Column]:
            return [F.shiftrightunsigned(x, _PLACE_BITS), number]

        def place(x: Column) -> Column:
            return x.bitwiseAND(F.lit(place_mask))

        def filled(o: Column) -> Column:
            first = F.transform(s, lambda x, i: F.xxhash64(*kmer(x, F.get(o, i))).bitwiseAND(F.lit(_FIRST_HASH)).bitwiseOR(place(x)))
            rounds = F.transform(F.sequence(F.lit(1), F.ceil(F.lit(FILL) / F.size(s)).cast("int") - 1), lambda r: F.shiftleft(r.cast("long"), _ROUND).bitwiseOR(F.lit(_LATER)))
            later = F.flatten(
                F.transform(rounds, lambda r: F.transform(s, lambda x, i: F.xxhash64(*kmer(x, F.get(o, i)), r).bitwiseAND(F.lit(_LATER_HASH)).bitwiseOR(r).bitwiseOR(place(x))))
            )
            return F.when(F.size(s) >= FILL, F.sort_array(first)).otherwise(let(F.sort_array(F.concat(first, later)), unlike))

        def unlike(e: Column) -> Column:
            """Without a k-mer right behind itself: the smallest of a sketch are different ones."""
            return F.filter(e, lambda x, i: (i == 0) | (bin_of(F.get(e, i - 1)) != bin_of(x)) | (place(F.get(e, i - 1)) != place(x)))

        return let(numbered(s), filled)

    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, 58)

    def smallest(e: Column) -> Column:
        """The TUPLE first of each sketch, with the place moved in front of the hash, sorted."""
        first = F.filter(e, lambda x, i: (i < TUPLE) | (bin_of(F.get(e, i - TUPLE)) != bin_of(x)))
        moved = F.transform(
            first,
            lambda x: F.shiftleft(bin_of(x), 58)
            .bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(place_mask)), _MIX_BITS))
            .bitwiseOR(F.shiftrightunsigned(x, _PLACE_BITS).bitwiseAND(F.lit((1 << _MIX_BITS) - 1))),
        )
        return F.sort_array(moved)

    def signature(z: Column) -> Column:
        def own(x: Column) -> Column:
            return x.bitwiseAND(F.lit((1 << _MIX_BITS) - 1))

        def tuple_hash(x: Column, i: Column) -> Column:
            """Of the elements of one sketch from place i on; its elements are TUPLE at most and adjacent."""
            rest = [F.when(bin_of(F.get(z, i + j)) == bin_of(x), own(F.get(z, i + j))) for j in range(1, TUPLE)]
            return F.xxhash64(own(x), *rest)

        heads = F.filter(
            F.transform(z, lambda x, i: F.when((i == 0) | (bin_of(F.get(z, i - 1)) != bin_of(x)), F.struct(bin_of(x).cast("int").alias("b"), F.pmod(tuple_hash(x, i), F.lit(65536)).cast("int").alias("v")))),
            lambda s: s.isNotNull(),
        )
        found = F.map_from_entries(heads)
        return let(found, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at(m, b.cast("int")), F.lit(-1))))

    none = F.array_repeat(F.lit(-1), BINS)
    return let(
        let(words, kmers),
        lambda h: F.when(F.size(h) == 0, none).otherwise(let(let(let(packed(h), elements), smallest), signature)),
    )


def written(sketch: Column) -> Column:
    """Four hexadecimal digits, or four dashes, for each sketch."""
    return F.array_join(F.transform(sketch, lambda v: F.when(v < 0, "----").otherwise(F.lower(F.lpad(F.hex(v), 4, "0")))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches among those that either has; 1 if neither has any."""
    either = F.zip_with(a, b, lambda x, y: F.when((x >= 0) | (y >= 0), F.when(x == y, 1.0).otherwise(0.0)))
    return let(
        F.array_compact(either),
        lambda e: F.when(F.size(e) == 0, 1.0).otherwise(F.aggregate(e, F.lit(0.0), lambda s, x: s + x) / F.size(e)),
    )


def _bounds(ids: DataFrame, parts: int) -> list[int]:
    """Distinct doc_ids that split the ids into ranges of like size, without the greatest."""
    row = ids.agg(
        F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], F.lit(max(10_000, 20 * parts))).alias("q"),
        F.max("doc_id").alias("top"),
    ).first()
    return sorted({q for q in row["q"] or [] if q < row["top"]}) if row["top"] is not None else []


def with_next(docs: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """Adds next_<column>: the values of the next document in descending order of doc_id.

    The first follows the last. Documents are dealt out by ranges of doc_id; the first of each
    range is also sent to the range before it in the order, so that no join is needed.
    """
    spark = docs.sparkSession
    parts = parts or min(4 * shuffle_partitions(spark), 10_000)
    bounds = _bounds(docs.select("doc_id"), parts)
    top = F.lit(len(bounds))
    if bounds:
        steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        all_bounds = F.array(*[F.lit(b) for b in bounds]).cast("array<long>")
        own = F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda low, step: F.when(F.try_element_at(all_bounds, low + step) < F.col("doc_id"), low + step).otherwise(low),
        )
        heads = F.when(F.try_element_at(all_bounds, F.col("range") + 1) == F.col("doc_id"), F.col("range") + 1)
    else:
        own, heads = F.lit(0), F.lit(None).cast("int")
    greatest = docs.agg(F.max("doc_id")).first()[0]
    last_of_all = F.when(F.col("doc_id").eqNullSafe(F.lit(greatest).cast("long")), F.struct(F.lit(0).alias("range"), F.lit(2).alias("guest")))
    homes = F.array_compact(F.array(
        F.struct(F.col("range"), F.lit(0).alias("guest")),
        F.when(heads.isNotNull(), F.struct(heads.alias("range"), F.lit(1).alias("guest"))),
        last_of_all,
    ))
    dealt = docs.withColumn("range", own).withColumn("home", F.explode(homes)).withColumn("range", F.col("home.range")).withColumn("guest", F.col("home.guest")).drop("home")
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), *[F.col(c) for c in columns])
    for c in columns:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    return dealt.where("guest = 0").drop("range", "guest")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    The edited text has its last third replaced by as much of the start of the next document,
    in descending order of doc_id; the first follows the last, a single document follows
    itself. Null text counts as empty. Rows that repeat a doc_id are ordered by text; a null
    doc_id comes last. An empty table gives an empty result. Equal texts have equal
    fingerprints.
    """
    base = docs.select(F.col("doc_id").cast("long"), empty_if_null("text").alias("text")).withColumn("sketch", sketches(F.col("text")))
    follow = with_next(base, ["text", "sketch"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = follow.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    )
    both = edited.select("doc_id", "n_chars", "edited", "sketch", "next_sketch", sketches(F.col("edited")).alias("edited_sketch"))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
