"""SimHash near-duplicates, linked by pigeonring filtering.

Fingerprints are cut into segments on a ring. If two differ in at most ``budget`` bits, then
from some segment on every chain of l consecutive segments differs in at most
l * budget / segments bits. The longest chain whose share rounds down to zero must therefore
agree exactly, which is the join key; the longer chains and then the full distance are
checked on the pairs that meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components
from .packing import chunks

BITS = 64
BUDGET = 2
SEGMENTS = 7
#: Fingerprints with one key up to which they are joined in pairs; larger groups are linked by stars.
PAIRED = 256

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(words) - shingle] + 1)).tolist()
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    n, counts = len(hashes), np.zeros(BITS, np.int64)
    array = np.array(hashes, dtype="<u8")
    for at in range(0, n, 65536):
        counts += np.unpackbits(array[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def fingerprints(docs: DataFrame, shingle: int = 3, digest: bool = False) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text, and its digest if wanted; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            prints = np.array([fingerprint_of(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(prints.view(np.int64)), **{c: batch.column(c) for c in more}})

    more = ["digest"] if digest else []
    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string"), *[text_digest(F.col("text")).alias(c) for c in more]]
    return docs.select(*columns).mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} binary" for c in more))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _ring(segments: int) -> list[int]:
    """The mask of each segment."""
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _chain(ring: list[int], start: int, length: int) -> int:
    return sum(ring[(start + i) % len(ring)] for i in range(length))


def links(prints: DataFrame, budget: int = BUDGET, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all at ``budget`` or fewer bits.

    Every pair within the budget is joined by an edge or by two edges through a third
    fingerprint that is itself within the budget of both.
    """
    ring = _ring(segments)
    exact = max(n for n in range(1, segments + 1) if n * budget // segments == 0)
    keys = [_signed(_chain(ring, i, exact)) for i in range(segments)]
    keyed = prints.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(k)) for k in keys])).alias("start", "key")
    )
    groups = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(keyed.join(groups, ["start", "key"]))

    few = shared.where(F.col("n") <= paired)
    other = few.select("start", "key", F.col("fp").alias("gp"))
    differing = F.col("fp").bitwiseXOR(F.col("gp"))
    viable = F.col("fp") < F.col("gp")
    for length in range(exact + 1, segments + 1):
        chains = F.array(*[F.lit(_signed(_chain(ring, i, length))) for i in range(segments)])
        viable &= F.bit_count(differing.bitwiseAND(F.element_at(chains, F.col("start") + 1))) <= length * budget // segments
    pairs = few.join(other, ["start", "key"]).where(viable).select(F.col("fp").alias("a"), F.col("gp").alias("b"))

    # Larger groups: all that agree outside ``budget`` free bits are within the budget of each other.
    def free(start: int) -> list[int]:
        rest = [bit for bit in range(BITS) if not _chain(ring, start, exact) >> bit & 1]
        return [_signed(sum(1 << b for b in chosen)) for chosen in combinations(rest, budget)]

    many = shared.where(F.col("n") > paired)
    stars = None
    if many.limit(1).count():
        for start in range(segments):
            masks = F.array(*[F.lit(~m) for m in free(start)])
            spread = many.where(F.col("start") == start).select("fp", F.explode(masks).alias("mask")).withColumn(
                "core", F.col("fp").bitwiseAND(F.col("mask"))
            )
            centre = spread.groupBy("mask", "core").agg(F.min("fp").alias("b"), F.count("*").alias("c")).where("c > 1")
            edges = spread.join(centre, ["mask", "core"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
            stars = edges if stars is None else stars.union(edges)
    return pairs if stars is None else pairs.union(stars)


def _rooted(prints: DataFrame, first: Column, budget: int) -> DataFrame:
    """fp, ``first`` of its rows, and root, which names its component, of every distinct fingerprint."""
    least = checkpointed(prints.groupBy("fp").agg(first))
    parts = connected_components(links(least.select("fp"), budget))
    return least.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document.

    component_id is the smallest doc_id reachable over links of ``budget`` or fewer
    differing bits, the document's own included. Equal fingerprints are merged before
    linking, so copies cost no pairs. Null and word-less texts have fingerprint zero and link
    like any other; repeated rows stay; a null doc_id keeps its row and never names a
    component that has another id; an empty table gives an empty result.
    """
    prints = checkpointed(fingerprints(docs, shingle))
    rooted = _rooted(prints, F.min("doc_id").alias("first_id"), budget)
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, shingle: int = 3, budget: int = BUDGET) -> DataFrame:
    """The documents with one of each component left, the one with the smallest doc_id.

    All columns stay. A null doc_id comes after all others; among equal ids the digest of the
    text decides, so rows without an id and rows that repeat one are documents like any other.
    Of rows equal in doc_id and text one stays, chosen by all its columns. Null and word-less
    texts are near-duplicates of each other; a text of any length is one row; an empty table
    gives an empty result; extra columns stay, whatever their names.
    """
    prints = checkpointed(fingerprints(docs, shingle, digest=True))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first")
    kept = _rooted(prints, one, budget).groupBy("root").agg(F.min("first").alias("k")).select("k.doc_id", "k.digest")
    rows = prints.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    same = kept["doc_id"].eqNullSafe(rows["doc_id"]) & (kept["digest"] == rows["digest"])
    counted = checkpointed(kept.join(rows, same).select(kept["doc_id"], kept["digest"], "n"))

    def those(keys: DataFrame) -> DataFrame:
        return docs.join(keys, docs["doc_id"].eqNullSafe(keys["doc_id"]) & (text_digest(docs["text"]) == keys["digest"]), "left_semi")

    if not counted.where("n > 1").limit(1).count():
        return those(counted)
    # One row of each, the same in any rerun: packed, so that no column's name can clash, and the least as JSON.
    packed = those(counted.where("n > 1")).select(F.struct("*").alias("row"))
    one = packed.groupBy(F.col("row.doc_id").alias("id"), text_digest(F.col("row.text")).alias("digest")).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return those(counted.where("n = 1")).union(one.select("row.*"))
