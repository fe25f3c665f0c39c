"""Mixture-controlled packing of token sequences.

Every source is a queue of its documents' tokens, with a weight: its target proportion of
every window, by default its share of all tokens. Deficit round-robin fills each window of
``length`` tokens: a source is credited its proportion, sends whole tokens of what it has
been credited and carries the rest, its deficit, to the next window. When a queue is empty
the others share its credit by weight. Since the queues' lengths are known, what a source
has been credited and has sent up to any window has a closed form, so that each partition
works out the deficits that it starts with by itself and cuts its documents there.

A token is due when its queue has been credited its place and a half: at time (place + 1/2)
/ weight. Tokens are sent in order of due time, ties in order of source, which keeps each
source's deficit within about one token at every window's end.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, join_sized
from .tokens import encoder

LENGTH = 4096
END = 2
#: Queues at most. With more sources, all but the largest share the last queue.
QUEUES = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is worked out for a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """row, doc_id, source, n and ids (little-endian, 16 or 32 bits each) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        small = len(coder.stops) <= 1 << 16 and end < 1 << 16
        for batch in chunks(batches):
            ids, sizes = coder.encode_many([t or "" for t in batch.column("text").to_pylist()])
            whole = np.insert(ids, np.cumsum(sizes), end).astype("<u2" if small else "<u4").tobytes()
            width = 2 if small else 4
            ends = (np.cumsum(sizes + 1) * width).tolist()
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "source": batch.column("source"),
                "n": pa.array(sizes + 1, pa.int64()), "width": pa.array([width] * len(ends), pa.int32()),
                "ids": pa.array([whole[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary()),
            })

    own = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, source string, n long, width int, ids binary").withColumn("row", F.monotonically_increasing_id())


def window_ends(total: int, length: int) -> list[int]:
    """Ends of the sequences of the last, incomplete window: powers of two, the largest first."""
    ends, at = [], total // length * length
    for bit in reversed(range(length.bit_length())):
        if total % length >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


class Schedule:
    """What each queue has been credited and has sent by the end of any window, for queues of the given lengths and weights."""

    def __init__(self, queues: list[int], length: int, weights: list[float] | None = None) -> None:
        self.queues = np.array(queues, dtype=np.int64)
        self.weights = np.maximum(self.queues, 1).astype(float) if weights is None else np.array(weights, dtype=float)
        if not (self.weights > 0).all():
            raise ValueError("every source needs a weight above 0")
        # Credit grows evenly between the times at which queues run out.
        runs_out = self.queues / self.weights
        order = np.argsort(runs_out, kind="stable")
        self._times = runs_out[order]
        self._gone = np.concatenate(([0.0], np.cumsum(self.queues[order].astype(float))))
        self._pace = np.concatenate((np.cumsum(self.weights[order][::-1])[::-1], [0.0]))
        self._done = self._gone[:-1] + self._times * self._pace[:-1]
        self.length, self.total = length, int(self.queues.sum())
        self.full = self.total // length
        self.tail = np.array(window_ends(self.total, length), dtype=np.int64)
        self.windows = self.full + len(self.tail)

    def ends(self, windows: np.ndarray) -> np.ndarray:
        """Tokens sent before each of ``windows`` begins; ``self.windows`` stands for the very end."""
        tail = np.concatenate(([self.full * self.length], self.tail))
        late = np.clip(windows - self.full, 0, len(self.tail))
        return np.where(windows <= self.full, windows * self.length, tail[late])

    def credit(self, times: np.ndarray) -> np.ndarray:
        """Tokens that all queues together have been credited by each of ``times``."""
        at = np.searchsorted(self._times, times, side="left")
        return self._gone[at] + times * self._pace[at]

    def _times_of(self, goal: np.ndarray) -> np.ndarray:
        """When all queues together have been credited so many tokens."""
        at = np.minimum(np.searchsorted(self._done, goal.astype(float), side="left"), len(self.queues) - 1)
        return np.where(self._pace[at] > 0, (goal - self._gone[at]) / np.maximum(self._pace[at], 1e-300), 0.0)

    def deficits(self, windows: np.ndarray) -> np.ndarray:
        """For each of ``windows`` (rows), what each queue carries into it: credited and not yet sent, or sent ahead if below 0."""
        times = self._times_of(self.ends(windows))
        return np.minimum(self.queues[None, :], self.weights[None, :] * times[:, None]) - self.sent(windows)

    def sent(self, windows: np.ndarray) -> np.ndarray:
        """For each of ``windows`` (rows), tokens that each queue has sent before it begins."""
        goal = self.ends(windows)
        q = self.queues[None, :]

        def due(time: np.ndarray) -> np.ndarray:
            return np.clip(np.floor(self.weights[None, :] * time[:, None] + 0.5).astype(np.int64), 0, q)

        # A queue's tokens are half a token from its credit at most, so that the time lies close to that of the goal.
        top = float(self._times[-1]) * (1 + 1e-9) if len(self._times) else 1.0
        low = self._times_of(np.maximum(goal - len(self.queues), 0)) * (1 - 1e-9)
        high = np.minimum(self._times_of(np.minimum(goal + len(self.queues), self.total)) * (1 + 1e-9), top)
        low, high = np.where(due(low).sum(axis=1) > goal, 0.0, low), np.where(due(high).sum(axis=1) > goal, high, top)
        at = np.arange(len(goal))
        for _ in range(64):
            middle = (low[at] + high[at]) / 2
            sums = due(middle).sum(axis=1)
            over = sums > goal[at]
            high[at], low[at] = np.where(over, middle, high[at]), np.where(over, low[at], middle)
            at = at[sums != goal[at]]  # nothing falls due between a time that has just the goal and the end
            if not len(at):
                break
        before = due(low)
        # Tokens that fall due in the same instant go out in order of source.
        more = np.maximum(due(high) - before, 0)
        earlier = np.cumsum(more, axis=1) - more
        return before + np.clip((goal - before.sum(axis=1))[:, None] - earlier, 0, more)


def _queues(tokens: DataFrame) -> tuple[list[tuple[str | None, int, int]], tuple[int, int]]:
    """(source, documents, tokens) of each queue in order, the null source last, and documents and tokens of all other sources."""
    by_source = checkpointed(tokens.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("n")))
    every = by_source.agg(F.count("*"), F.sum("docs"), F.sum("n")).first()
    own = QUEUES if every[0] <= QUEUES else QUEUES - 1
    largest = by_source.orderBy(F.desc("n"), F.col("source").asc_nulls_last()).limit(own).collect()
    queues = sorted(((r["source"], r["docs"], r["n"]) for r in largest), key=lambda q: (q[0] is None, q[0] or ""))
    return queues, ((every[1] or 0) - sum(q[1] for q in queues), (every[2] or 0) - sum(q[2] for q in queues))


def packed(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """The pieces of all documents, each id in exactly one piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, deficit (what
    the source carried into the window), source and ids (binary, little-endian, unsigned 32
    bits). Windows are filled to ``weights``, the target proportions of the sources (1 for a
    source that has none, and for the queue that the smallest sources share beyond QUEUES), by
    default to the sources' shares of all tokens; a source that has run out leaves its share
    to the others. What remains after the last full window becomes sequences of powers of two,
    so nothing is padded. Null text is empty and has the end token alone; the null source is
    a queue of its own; repeated rows are packed each for itself; an empty table gives an
    empty result; extra columns have no effect. Within a queue, documents come in the order of
    a hash of doc_id and ids, so that reruns agree.
    """
    tokens = checkpointed(encoded(docs, tokenizer or default_tokenizer(), end))
    spark = tokens.sparkSession
    queues, rest = _queues(tokens.select("source", "n"))
    if not queues:
        return _empty(spark)
    shared = [rest] if rest[0] else []
    lengths = [n for *_, n in queues] + [n for _, n in shared]
    given = None if weights is None else [float(weights.get(s, 1.0)) for s, *_ in queues] + [1.0] * len(shared)
    schedule = Schedule(lengths, length, given)
    named = [(s is not None, s or "", i, math.isqrt(d) + 1) for i, (s, d, _) in enumerate(queues)]
    lanes = F.broadcast(spark.createDataFrame(named, "source_known boolean, source_key string, queue int, parts long"))  # QUEUES rows at most

    keyed = tokens.select("row", "source", "doc_id", "n", F.xxhash64("doc_id", "ids").alias("place"))
    keyed = keyed.withColumn("source_known", F.col("source").isNotNull()).withColumn("source_key", F.coalesce("source", F.lit("")))
    laned = keyed.join(lanes, ["source_known", "source_key"], "left").withColumn("queue", F.coalesce("queue", F.lit(len(queues))))
    # As many parts of a queue as a part has documents; parts are summed up before single documents are.
    # The order within a queue follows from doc_id and ids alone, so that reruns agree however rows are stored.
    top = F.shiftrightunsigned("place", 32)
    known = laned.withColumn("top", top).withColumn("part", F.shiftright(top * F.coalesce("parts", F.lit(math.isqrt(rest[0]) + 1)), 32))
    sums = checkpointed(known.groupBy("queue", "part").agg(F.sum("n").alias("part_n")))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("queue", "part", F.coalesce(F.sum("part_n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("queue", "part").orderBy("top", "place", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    starts = join_sized(placed, before, ["queue", "part"]).select("row", "queue", (F.col("before") + F.col("inside")).alias("queue_start"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cut(batch, schedule)

    placed_ids = tokens.join(starts, "row").select("doc_id", "source", "n", "width", "ids", "queue", "queue_start")
    return placed_ids.mapInArrow(cut, _SCHEMA)


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, deficit double, source string, ids binary"
#: Entries of sums (windows times sources) that are worked out at once.
_STEP = 1 << 18


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _SCHEMA)


def _candidates(first: int, last: int, queue: int, schedule: Schedule) -> np.ndarray:
    """Windows that may hold the tokens from ``first`` to ``last`` of a queue, in order.

    A token's rank differs from its due time's share of all tokens by at most one for each
    queue. A queue that skips windows is followed token by token.
    """
    slack = 2 + len(schedule.queues) // schedule.length

    def window_of(tokens: np.ndarray) -> np.ndarray:
        return (schedule.credit((tokens + 0.5) / schedule.weights[queue]) / schedule.length).astype(np.int64)

    lo, hi = (window_of(np.array([first, last])) + np.array([-slack, slack + len(schedule.tail)])).tolist()
    if hi - lo <= 8 * (last - first + 1) * slack + len(schedule.tail):
        found = np.arange(lo, hi + 1)
    else:
        near = window_of(np.arange(first, last + 1))
        found = np.unique(near[:, None] + np.arange(-slack, slack + len(schedule.tail) + 1)[None, :])
    return found[(found >= 0) & (found < schedule.windows)]


def _cut(batch: pa.RecordBatch, schedule: Schedule) -> Iterator[pa.RecordBatch]:
    """Cuts the documents of a batch where their windows end."""
    queue, starts, sizes, widths = (batch.column(c).to_pylist() for c in ("queue", "queue_start", "n", "width"))
    step = max(64, _STEP // len(schedule.queues))
    group: list[tuple[int, np.ndarray]] = []
    held = 0
    for doc in range(len(queue)):
        windows = _candidates(starts[doc], starts[doc] + sizes[doc] - 1, queue[doc], schedule)
        for at in range(0, len(windows), step):
            group.append((doc, windows[at : at + step]))
            held += len(group[-1][1])
            if held >= step:
                yield _pieces(batch, group, queue, starts, sizes, widths, schedule)
                group, held = [], 0
    if group:
        yield _pieces(batch, group, queue, starts, sizes, widths, schedule)


def _pieces(batch: pa.RecordBatch, group: list[tuple[int, np.ndarray]], queue: list[int], starts: list[int], sizes: list[int], widths: list[int], schedule: Schedule) -> pa.RecordBatch:
    own = np.unique(np.concatenate([w for _, w in group]))
    windows = np.unique(np.concatenate([own, own + 1]))
    sent = schedule.sent(windows)
    deficits = schedule.deficits(own)
    ahead = np.cumsum(sent, axis=1) - sent  # by the sources that come before in a window
    out: list[tuple] = []
    for doc, mine in group:
        s, begin = queue[doc], starts[doc]
        at, carried = np.searchsorted(windows, mine), np.searchsorted(own, mine)
        froms, tos = np.maximum(sent[at, s], begin), np.minimum(sent[at + 1, s], begin + sizes[doc])
        filled = np.flatnonzero(tos > froms)
        if not len(filled):
            continue
        ids = np.frombuffer(batch.column("ids")[doc].as_py(), "<u2" if widths[doc] == 2 else "<u4").astype("<u4")
        offsets = ahead[at + 1, s] - ahead[at, s] + froms - sent[at, s]
        for k in filled.tolist():
            f, t = int(froms[k]) - begin, int(tos[k]) - begin
            raw = ids[f:t].tobytes()
            out.append((doc, f, t - f, zlib.crc32(raw), sizes[doc], int(mine[k]), int(offsets[k]), float(deficits[carried[k], s]), raw))
    docs, start, size, crc, total, window, offset, deficit, raw = zip(*out, strict=True) if out else [()] * 9
    take = pa.array(docs, pa.int64())
    return pa.record_batch({
        "doc_id": batch.column("doc_id").take(take), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()),
        "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64()), "sequence_id": pa.array(window, pa.int64()),
        "offset": pa.array(offset, pa.int64()), "deficit": pa.array(deficit, pa.float64()), "source": batch.column("source").take(take), "ids": pa.array(raw, pa.binary()),
    })


def pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The pieces without their ids."""
    return packed(docs, tokenizer).drop("ids", "source")
