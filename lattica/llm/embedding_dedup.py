"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected onto Gaussian directions, shifted and cut into steps of
WIDTH; K such numbers name a bucket, and there are several tables of them. Vectors that meet
in a bucket are compared exactly, in double precision. K grows with the logarithm of the
number of vectors, so that chance meetings stay few, and the number of tables follows from
the wanted recall at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, connected_components, join_sized

LEAST = 0.95
WIDTH = 2.0
#: Share of the pairs right at the threshold that at least one table must bring together.
RECALL = 0.995
SEED = 20240229
#: Vectors of one bucket that a task compares at once; a larger bucket is dealt out as pairs of blocks.
BLOCK = 1024
_FOUND = "a binary, b binary, n long"


def meeting_chance(distance: float, width: float = WIDTH) -> float:
    """That two vectors at this distance share one quantised projection."""
    r = width / distance
    return 1 - 2 * 0.5 * math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(vectors: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """Projections for each bucket, and tables, for so many vectors."""
    far, near = meeting_chance(math.sqrt(2)), meeting_chance(math.sqrt(2 * (1 - least)))
    k = max(4, math.ceil(math.log(max(vectors, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**k))))


def _directions(size: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([SEED, size, k, tables])
    return random.standard_normal((size, k * tables)), random.uniform(0, WIDTH, k * tables)


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signatures(vectors: DataFrame, k: int, tables: int, kind: str = "<f8") -> DataFrame:
    """Adds marks: a 64-bit name of the vector's bucket in each table, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            marks: list[bytes | None] = [None] * len(raw)
            for size in {len(r) for r in raw}:
                own = [i for i, r in enumerate(raw) if len(r) == size]
                directions, shifts = _directions(size // int(kind[-1]), k, tables)
                for at in range(0, len(own), 512):
                    some = own[at : at + 512]
                    steps = np.floor((_unit([raw[i] for i in some], kind) @ directions + shifts) / WIDTH).astype("<i4")
                    for i, row in zip(some, steps.reshape(len(some), tables, k), strict=True):
                        marks[i] = np.array([xxhash.xxh64_intdigest(t.tobytes(), size) for t in row], "<u8").tobytes()
            yield pa.record_batch({"rep": batch.column("rep"), "copies": batch.column("copies"), "raw": batch.column("raw"), "marks": pa.array(marks, pa.binary())})

    return vectors.select("rep", "copies", "raw").mapInArrow(run, "rep binary, copies long, raw binary, marks binary")


def _met_before(a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    return (a[:, :table] == b[:, :table]).any(axis=1) if table else np.zeros(len(a), bool)


def _compare(table: int, left: dict, right: dict, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs of two blocks that no earlier table has brought together."""
    if left["x"].shape[1] != right["x"].shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.nonzero(left["x"] @ right["x"].T >= least)
    if same:
        i, j = i[i < j], j[i < j]
    fresh = ~_met_before(left["marks"][i], right["marks"][j], table)
    return i[fresh], j[fresh]


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each place to the smallest that it is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return [(a, int(b)) for a, b in enumerate(label.tolist()) if a != b]
        label = new


def _blocks(rows: list[dict], kind: str) -> dict[int, dict]:
    """Rows of a pair of blocks, side by side; ids keep their order."""
    out = {}
    for side in {r["side"] for r in rows}:
        own = [r for r in rows if r["side"] == side]
        out[side] = {
            "x": _unit([r["raw"] for r in own], kind), "copies": np.array([r["copies"] for r in own]), "rep": [r["rep"] for r in own],
            "marks": np.array([np.frombuffer(r["marks"], "<u8") for r in own]),
        }
    return out


def _links_of(table: int, rows: list[dict], least: float, kind: str) -> list[tuple]:
    """(a, None, n): rep a has n more links; (a, b, 0): a and b are connected."""
    out: list[tuple] = []
    for size in {len(r["raw"]) for r in rows}:
        blocks = _blocks([r for r in rows if len(r["raw"]) == size], kind)
        if len(blocks) == 1:
            if not rows[0]["within"]:  # the other block has no vector of this size
                continue
            (block,) = blocks.values()
            left = right = block
            # A first table whose mark all share has compared all of them already.
            if table and (block["marks"][:, :table] == block["marks"][:1, :table]).all(axis=0).any():
                continue
        else:
            left, right = blocks[0], blocks[1]
        same = left is right
        i, j = _compare(table, left, right, same, least)
        if not len(i):
            continue
        n = len(left["rep"])
        reps = left["rep"] if same else left["rep"] + right["rep"]
        other = j if same else j + n
        links = np.zeros(len(reps), np.int64)
        np.add.at(links, i, right["copies"][j])
        np.add.at(links, other, left["copies"][i])
        out += [(reps[p], None, int(links[p])) for p in np.flatnonzero(links).tolist()]
        out += [(reps[a], reps[b], 0) for a, b in _spanning(len(reps), i, other)]
    return out


def links(vectors: DataFrame, tables: int, least: float = LEAST, block: int = BLOCK, kind: str = "<f8") -> DataFrame:
    """Counts of links and connections of distinct vectors (rep, copies, raw, marks).

    Only the buckets' names and hashes of their members are counted in all tables. A bucket
    whose members are exactly those of a bucket of an earlier table is dropped there, since
    all its pairs have met; vectors go to the buckets that remain.
    """
    marks = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.substring("marks", t * 8 + 1, F.lit(8)))
    named = vectors.select("rep", F.posexplode(marks).alias("table", "bucket"))
    of_all = [F.sum(F.xxhash64(F.lit(seed), "rep").cast("decimal(20,0)")).alias(f"hash_{seed}") for seed in (1, 2)]
    buckets = named.groupBy("table", "bucket").agg(F.count("*").alias("members"), *of_all).where("members > 1")
    first = buckets.groupBy("members", "hash_1", "hash_2").agg(F.min(F.struct("table", "bucket")).alias("first"))
    sizes = first.select("first.table", "first.bucket", "members")
    placed = vectors.select("rep", "copies", "raw", "marks", F.posexplode(marks).alias("table", "bucket"))
    meeting = placed.join(sizes, ["table", "bucket"])
    # A bucket of more than a block is dealt out as pairs of blocks: each row goes to the pairs of its own block.
    split = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), split.cast("long")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), split - 1), lambda o: F.struct(F.least(o, own).alias("low"), F.greatest(o, own).alias("high"))))
    dealt = meeting.withColumn("pair", pair).select(
        "table", "rep", "copies", "raw", "marks",
        F.when((F.col("pair.low") == F.col("pair.high")) | (own == F.col("pair.low")), 0).otherwise(1).alias("side"),
        (F.col("pair.low") == F.col("pair.high")).alias("within"), F.xxhash64("table", "bucket", "pair").alias("group"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        found: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["group"] != held[0]["group"]:
                    found += _links_of(held[0]["table"], held, least, kind) if len(held) > 1 else []
                    held = []
                held.append(row)
            if found:
                yield _as_batch(found)
                found = []
        found += _links_of(held[0]["table"], held, least, kind) if len(held) > 1 else []
        if found:
            yield _as_batch(found)

    return dealt.repartition("group").sortWithinPartitions("group", "side", "rep").mapInArrow(run, _FOUND)


def _as_batch(found: list[tuple]) -> pa.RecordBatch:
    a, b, n = zip(*found, strict=True)
    return pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array(n, pa.int64())})


def near_duplicates(embeddings: DataFrame, least: float = LEAST, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Equal vectors are merged first, and count as linked with each other. Null, empty and zero
    vectors and such with null or non-finite components link with nothing, nor do vectors of
    different sizes. A row that repeats a vec_id counts as another vector. component_id is
    the smallest vec_id reachable; a null vec_id never names a component that has another. An
    empty table gives an empty result.
    """
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    usable = (
        F.col("v").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("v", lambda x: x != 0)
    )

    # Components are kept as wide as they are given; cosines are of doubles in either case.
    kind = "<f4" if embeddings.schema["embedding"].dataType == T.ArrayType(T.FloatType(), True) else "<f8"

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A power of two as scale keeps all bits and keeps squares within range.
            raw = []
            for v in batch.column("v"):
                x = np.array(v.as_py(), "<f8")
                raw.append((np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0).astype(kind).tobytes())
            rep = [xxhash.xxh128_digest(r) for r in raw]
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "raw": pa.array(raw, pa.binary()), "rep": pa.array(rep, pa.binary())})

    good = checkpointed(rows.where(usable).mapInArrow(as_bytes, "vec_id long, raw binary, rep binary"))
    distinct = good.groupBy("rep").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first("raw").alias("raw"))
    distinct = checkpointed(distinct)
    k, tables = shape(distinct.count(), least, recall)
    marked = checkpointed(signatures(distinct, k, tables, kind))
    found = checkpointed(links(marked, tables, least, block, kind))

    # Components over numbers: a vector's own is its place in the order of a hash, unique here.
    numbered = checkpointed(distinct.select("rep", "copies", "least_id").withColumn("node", F.monotonically_increasing_id()))
    nodes = numbered.select("rep", "node")
    edges = found.where(F.col("b").isNotNull())
    ends = edges.join(nodes.withColumnsRenamed({"rep": "a", "node": "m"}), "a").join(nodes.withColumnsRenamed({"rep": "b", "node": "n2"}), "b")
    parts = connected_components(ends.select(F.col("m").alias("a"), F.col("n2").alias("b")))
    counts = found.where(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("others"))
    rooted = numbered.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = (
        rooted.join(named, "root")
        .join(counts.withColumnRenamed("a", "rep"), "rep", "left")
        .select("rep", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    linked = join_sized(good.select("vec_id", "rep"), checkpointed(known), ["rep"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
