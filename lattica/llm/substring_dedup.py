"""Repeated passages, by prefix-partitioned suffix trees.

Of all suffixes a sparse set is indexed: those that start at an anchor, the smallest K-gram
(by hash) of some window. Two equal windows have their anchor in the same place, so every
repeat as long as a window holds an indexed suffix. A suffix belongs to the subtree of its
first K words. Prefixes that only one suffix has are dropped before any words travel; the
others bring their words, from the first window that they anchor to the end of the last.

A subtree is kept as its suffixes in lexicographic order with the lengths of common prefixes
between neighbours: a stretch of neighbours with d words in common is the internal node at
depth d. A window with o words before its anchor is repeated if another leaf below its node
at depth ``window`` - o has the same o words before it. Words are compared themselves.

A prefix with more than GROUP suffixes is lengthened to the whole window, so that its subtree
falls into leaves that are counted, by 128-bit hashes, without coming together. Copies of
whole texts are counted first; one of each is indexed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, empty_if_null, join_sized, release

WINDOW = 35
#: Words of a prefix, before it is lengthened.
K = 8
#: Suffixes of one prefix that a task holds at once.
GROUP = 100_000
#: Words, or suffixes, that are worked on at once; a longer document is worked on alone.
_WORDS, _SUFFIXES = 1 << 20, 20_000
#: Keys of texts that a task remembers, to index copies once.
_TEXTS = 1 << 18
_INDEX_BITS = np.uint64(28)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEY = "k1 long, k2 long"


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def _spans(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words that start at each word, by doubling."""
    done, size, power, result, at = h, 1, int(_BASE), None, 0
    while True:
        if length & size:
            if result is None:
                result, at = done, size
            else:
                n = len(done) - at
                result = result[:n] * np.uint64(power) + done[at : at + n]
                at += size
        if size * 2 > length:
            return result[: max(0, len(h) - length + 1)]
        done = done[: len(done) - size] * np.uint64(power) + done[size:]
        size, power = size * 2, power * power % (1 << 64)


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of the ``width`` that start at each place."""
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[: len(keys) - size], keys[size:])
        size *= 2
    return keys if size == width else np.minimum(keys[: len(keys) - (width - size)], keys[width - size :])


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _anchored(docs: list[tuple[int, int, np.ndarray]], window: int) -> pa.RecordBatch | None:
    """Indexed suffixes of documents (k1, k2, word hashes).

    One row for each stretch of neighbouring windows with one anchor: the hash of its K-gram,
    and the start of the first window, the words from there to the anchor and the number of
    windows, packed.
    """
    docs = [d for d in docs if len(d[2]) >= window]
    if not docs:
        return None
    k = min(K, window)
    lengths = np.array([len(d[2]) for d in docs])
    offsets = np.cumsum(lengths) - lengths
    h = np.concatenate([d[2] for d in docs])
    # The last places of a document, whose window would run into the next one, don't count.
    begin = np.concatenate([np.arange(o, o + n - window + 1) for o, n in zip(offsets.tolist(), lengths.tolist(), strict=True)])
    grams = _mixed(_spans(h, k), 0xBF58476D1CE4E5B9)
    index = np.arange(len(grams), dtype=np.uint64)
    order = (_mixed(grams, 0x94D049BB133111EB) >> _INDEX_BITS << _INDEX_BITS) | index
    anchor = (_smallest(order, window - k + 1)[begin] & np.uint64((1 << 28) - 1)).astype(np.int64)
    doc = np.searchsorted(offsets, begin, side="right") - 1
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, len(begin)))
    start = begin[first] - offsets[doc[first]]
    packed = (start << 16) | ((anchor[first] - begin[first]) << 8) | counts
    keys = np.array([d[:2] for d in docs], dtype=np.int64)[doc[first]]
    return pa.record_batch({"prefix": pa.array(grams[anchor[first]].view(np.int64)), "k1": pa.array(keys[:, 0]), "k2": pa.array(keys[:, 1]), "packed": pa.array(packed)})


def anchors(keyed: DataFrame, window: int) -> DataFrame:
    """prefix, k1, k2 and packed of the indexed suffixes of texts (k1, k2, text); copies within a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        size, seen = 0, set()
        for batch in batches:
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            for i, text in enumerate(batch.column("text")):
                if (k1[i], k2[i]) in seen:
                    continue
                if len(seen) >= _TEXTS:
                    seen.clear()
                seen.add((k1[i], k2[i]))
                words = _words(text.as_py())
                if size and size + len(words) > _WORDS:
                    if (out := _anchored(held, window)) is not None:
                        yield out
                    held, size = [], 0
                held.append((k1[i], k2[i], np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))))
                size += len(words)
        if (out := _anchored(held, window)) is not None:
            yield out

    return keyed.select("k1", "k2", "text").mapInArrow(run, f"prefix long, {_KEY}, packed long")


_SLICE = f"prefix long, h1 long, h2 long, {_KEY}, packed long, copied boolean, words binary"


def slices(texts: DataFrame, window: int) -> DataFrame:
    """Words of shared suffixes of texts (k1, k2, text, copied, shared: array of prefix, packed and large).

    A suffix of a large prefix becomes one row for each of its windows, named by the hash of
    all its words (h1, h2) and without words of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k1, k2, text, copied, shared in zip(*(batch.column(c) for c in ("k1", "k2", "text", "copied", "shared")), strict=True):
                words, key = _words(text.as_py()), (k1.as_py(), k2.as_py())
                for s in shared.as_py():
                    start, windows = s["packed"] >> 16, s["packed"] & 255
                    if not s["large"]:
                        rows.append((s["prefix"], None, None, *key, s["packed"], copied.as_py(), b" ".join(words[start : start + windows + window - 1])))
                        continue
                    for at in range(start, start + windows):
                        name = xxhash.xxh3_128_digest(b" ".join(words[at : at + window]))
                        rows.append((None, *np.frombuffer(name, "<i8").tolist(), *key, (at << 16) | 1, copied.as_py(), None))
                if len(rows) > _SUFFIXES:
                    yield _as_batch(rows, _SLICE)
                    rows = []
            if rows:
                yield _as_batch(rows, _SLICE)

    return texts.mapInArrow(run, _SLICE)


_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _subtrees(rows: pa.Table, window: int) -> pa.RecordBatch | None:
    """Repeated windows of whole groups, as a start and a bit for each window from there."""
    n = rows.num_rows
    prefix = rows.column("prefix").to_numpy()
    packed = rows.column("packed").to_numpy()
    copied = np.asarray(rows.column("copied").combine_chunks())
    before, count = (packed >> 8) & 255, packed & 255
    if n < 2 or copied.all():
        return None
    # Every word gets a number of its own, so that equal numbers are equal words; none is below 0.
    numbers: dict[bytes, int] = {}
    split = [w.split() for w in rows.column("words").to_pylist()]
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in split for w in ws), np.int64)
    sizes = np.fromiter(map(len, split), np.int64, n)
    starts = np.cumsum(sizes) - sizes
    row, column = np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)
    at = column - before[row]
    # What ends early differs from everything that goes on.
    right = np.broadcast_to(-1 - np.arange(n)[:, None], (n, window)).copy()
    ahead = (at >= 0) & (at < window)
    right[row[ahead], at[ahead]] = flat[ahead]
    left = np.broadcast_to(-1 - np.arange(n)[:, None], (n, max(1, int(before.max())))).copy()
    behind = at < 0
    left[row[behind], -1 - at[behind]] = flat[behind]

    order = np.lexsort((*right.T[::-1], prefix))
    right, prefix_in_order = right[order], prefix[order]
    equal = (right[1:] == right[:-1]) & (prefix_in_order[1:] == prefix_in_order[:-1])[:, None]
    common = np.concatenate(([0], np.logical_and.accumulate(equal, axis=1).sum(axis=1)))
    left, before, count, copied = left[order], before[order], count[order], copied[order]
    mask, same_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(int(before.max()) + 1):
        if o:
            same_left = np.unique(same_left * (len(numbers) + n + 1) + left[:, o - 1] + n, return_inverse=True)[1]
        node = np.cumsum(common < window - o)  # leaves below one internal node at this depth
        own = np.flatnonzero((before >= o) & (before - o < count))
        if not len(own):
            continue
        _, name, leaves = np.unique(node[own] * (n + 1) + same_left[own], return_inverse=True, return_counts=True)
        repeated = own[leaves[name] > 1]
        mask[repeated] |= np.int64(1) << (before[repeated] - o)
    found = np.flatnonzero((mask != 0) & ~copied)
    if not len(found):
        return None
    back = order[found]
    return pa.record_batch({
        "k1": rows.column("k1").to_numpy()[back], "k2": rows.column("k2").to_numpy()[back], "start": packed[back] >> 16, "mask": mask[found],
    })


def _trees(shared: DataFrame, window: int) -> DataFrame:
    """k1, k2, start and mask (bit j stands for the window that starts at start + j) of repeated windows, from slices of prefixes that aren't large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            carried.append(batch)
            rows += batch.num_rows
            if rows < _SUFFIXES:
                continue
            table = pa.Table.from_batches(carried)
            prefix = table.column("prefix").to_numpy()
            last = int(np.searchsorted(prefix, prefix[-1], side="left"))  # the last group may go on
            if last and (out := _subtrees(table.slice(0, last), window)) is not None:
                yield out
            rest = table.slice(last)
            carried, rows = rest.to_batches(), rest.num_rows
        if carried and (out := _subtrees(pa.Table.from_batches(carried), window)) is not None:
            yield out

    return shared.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, f"{_KEY}, start long, mask long")


def repeated_windows(keyed: DataFrame, texts: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """k1, k2, start and mask of the repeated windows of texts that have no copy.

    ``keyed`` has id_key, k1, k2 and text, ``texts`` k1, k2, copies and id_key, the least of each text.
    """
    found = anchors(keyed, window)
    prefixes = checkpointed(found.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"))
    # The suffixes of a frequent prefix are dealt out by their texts before they meet its count.
    salts = F.floor(F.col("n") / _SUFFIXES).cast("long") + 1
    frequent = prefixes.where(F.col("n") >= _SUFFIXES).select("prefix", salts.alias("salts"))
    dealt = join_sized(found, frequent, ["prefix"], "left").withColumn("salt", F.coalesce(F.pmod("k1", "salts"), F.lit(0)))
    counted = prefixes.select("prefix", (F.col("n") > group).alias("large"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    shared = dealt.join(counted, ["prefix", "salt"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("prefix", "packed", "large")).alias("shared"))
    chosen = shared.join(texts, ["k1", "k2"]).select("k1", "k2", "id_key", (F.col("copies") > 1).alias("copied"), "shared")
    with_text = keyed.join(chosen, ["k1", "k2", "id_key"]).select("k1", "k2", "text", "copied", "shared")
    parts = checkpointed(slices(with_text, window))
    out = _trees(parts.where("prefix is not null"), window)
    large = parts.where("prefix is null")
    some = large.limit(1).count()
    release(keyed.sparkSession)
    if some:
        leaves = large.groupBy("h1", "h2").agg(F.sum(F.when(F.col("copied"), 2).otherwise(1)).alias("n")).where("n > 1").select("h1", "h2")
        repeated = join_sized(large.where("not copied"), checkpointed(leaves), ["h1", "h2"])
        out = out.union(repeated.select("k1", "k2", F.shiftright("packed", 16), F.lit(1).cast("long")))
    return out


def _keep(text: str, cover: list[dict] | None, copied: bool, window: int) -> tuple[int, list[bytes]]:
    words = _words(text)
    if copied and len(words) >= window:
        return len(words), []
    if not cover:
        return len(words), words
    change = np.zeros(len(words) + 1, np.int64)
    for c in cover:
        mask, start = c["mask"], c["start"]
        while mask:
            low = (mask & -mask).bit_length() - 1
            change[start + low] += 1
            change[start + low + window] -= 1
            mask &= mask - 1
    kept = np.cumsum(change[:-1]) == 0
    return len(words), [words[i] for i in np.flatnonzero(kept).tolist()]


def cleaned(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed and text: the words left, joined by one space.

    A word goes if it lies in a window of ``window`` words whose words also start elsewhere,
    in the same document or another one; null text has no words. A row that repeats another's
    text, with the same doc_id or not, counts as elsewhere, so that both lose their windows.
    Null ids stay; an empty table gives an empty result; extra columns have no effect.
    ``window`` may be 2 to 60 (a suffix's windows must fit into a mask).
    """
    keyed = docs.select(F.col("doc_id").cast("long"), empty_if_null("text").cast("string").alias("text")).withColumns(
        {"id_key": F.coalesce("doc_id", F.lit(-(1 << 63))), "k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")}
    )
    texts = checkpointed(keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("id_key").alias("id_key")))
    found = repeated_windows(keyed, texts, window, group)
    # A text's own windows bound its set.
    cover = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "mask")).alias("cover")).withColumn("copied", F.lit(False))
    copied = texts.where("copies > 1").select("k1", "k2", F.lit(None).cast(cover.schema["cover"].dataType).alias("cover"), F.lit(True).alias("copied"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, left, text = [], [], []
            for t, c, twice in zip(batch.column("text"), batch.column("cover"), batch.column("copied"), strict=True):
                n, kept = _keep(t.as_py(), c.as_py(), bool(twice.as_py()), window)
                total.append(n)
                left.append(n - len(kept))
                text.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(left, pa.int64()), "text": pa.array(text, pa.string())})

    both = keyed.join(cover.union(copied), ["k1", "k2"], "left").select("doc_id", "text", "cover", "copied")
    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def digested(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """As ``cleaned``, with the SHA-256 of the text that is left in its place."""
    return cleaned(docs, window, group).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The same for a few rows by counting every window; for tests."""
    from collections import Counter

    split = [(i, _words(t or "")) for i, t in texts]
    seen = Counter(tuple(w[s : s + window]) for _, w in split for s in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
