"""Edit-aware token counts.

The tree of a document keeps its pre-token segments as leaves: runs of about SPAN code points
that end before white space, where no token can cross. Inner nodes keep sums of tokens and
code points. An edit re-encodes only the leaves that it touches, widened to the white space
around it, and updates the sums on the way to the root.

Trees are rows of a table (leaves and their counts), so that they can be saved and edited
later; the inner sums follow from the leaves without encoding anything.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import chunks, default_tokenizer
from .tokens import encoder

#: Code points of a leaf before the next white space ends it.
SPAN = 256
#: Spans that a leaf may grow to by edits before it is split, which builds the inner sums anew.
GROWTH = 4
_WHITE = re.compile(r"[\x20\x09-\x0D]")


def segments(text: str, span: int = SPAN) -> list[str]:
    """The text in pieces that start with white space, but for the first, and have ``span`` code points or more, but for the last."""
    out, start = [], 0
    while len(text) - start > span and (white := _WHITE.search(text, start + span)):
        out.append(text[start : white.start()])
        start = white.start()
    out.append(text[start:])
    return out


class SegmentTree:
    """Sums over the leaves of one document, in arrays of levels from the leaves to the root."""

    def __init__(self, leaves: list[str], tokens: Sequence[int], encode: Callable[[list[str]], Sequence[int]], span: int = SPAN) -> None:
        self.leaves, self.encode, self.span = leaves, encode, span
        self.encoded = 0
        self._build(np.array(tokens, dtype=np.int64), np.array([len(x) for x in leaves], dtype=np.int64))

    def _build(self, tokens: np.ndarray, sizes: np.ndarray) -> None:
        self.tokens, self.sizes = [tokens], [sizes]
        while len(self.tokens[-1]) > 1:
            for levels in (self.tokens, self.sizes):
                below = levels[-1]
                levels.append(np.add.reduceat(below, np.arange(0, len(below), 2)))

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[-1][0])

    @property
    def n_chars(self) -> int:
        return int(self.sizes[-1][0])

    def leaf_at(self, offset: int) -> tuple[int, int]:
        """The leaf that holds a code point, and where it starts; the end belongs to the last leaf."""
        node, start = 0, 0
        for level in range(len(self.sizes) - 1, 0, -1):
            node *= 2
            below = self.sizes[level - 1]
            if node + 1 < len(below) and offset - start >= below[node]:
                start += int(below[node])
                node += 1
        return node, start

    def _update(self, leaf: int) -> None:
        for level in range(1, len(self.tokens)):
            leaf //= 2
            for levels in (self.tokens, self.sizes):
                levels[level][leaf] = levels[level - 1][2 * leaf : 2 * leaf + 2].sum()

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts ``new`` in place of the code points from start to end; returns the tokens then."""
        start, end = max(0, min(start, self.n_chars)), max(0, min(max(start, end), self.n_chars))
        first, at = self.leaf_at(start)
        last, last_at = self.leaf_at(end)
        # The leaf before is context when the edit reaches its end, for its last word may go on. Edits may leave empty leaves.
        while first and start == at:
            first -= 1
            at -= len(self.leaves[first])
        whole = "".join(self.leaves[first : last + 1])
        whole = whole[: start - at] + new + whole[end - at :]
        # Where the touched leaves no longer end before white space, the next one is context too.
        while last + 1 < len(self.leaves) and not _WHITE.match(self.leaves[last + 1]):
            last += 1
            whole += self.leaves[last]
        parts, touched = segments(whole, self.span) if len(whole) > 2 * self.span else [whole], last - first + 1
        if len(parts) < touched:
            parts += [""] * (touched - len(parts))
        elif len(parts) > touched and len(whole) <= GROWTH * self.span * touched:
            parts = ["".join(parts[len(parts) * i // touched : len(parts) * (i + 1) // touched]) for i in range(touched)]
        counts = self.encode(parts)
        self.encoded += len(whole)
        if len(parts) == last - first + 1:
            for leaf, text, n in zip(range(first, last + 1), parts, counts, strict=True):
                self.leaves[leaf] = text
                self.tokens[0][leaf], self.sizes[0][leaf] = n, len(text)
                self._update(leaf)
        else:  # another number of leaves: the levels are summed up anew from the counts at hand
            self.leaves[first : last + 1] = parts
            tokens = np.concatenate([self.tokens[0][:first], np.array(counts, dtype=np.int64), self.tokens[0][last + 1 :]])
            sizes = np.concatenate([self.sizes[0][:first], np.array([len(p) for p in parts], dtype=np.int64), self.sizes[0][last + 1 :]])
            self._build(tokens, sizes)
        return self.n_tokens


def production_edits(text: str) -> list[tuple[int, int, str]]:
    """Three edits, one after the other: a word put in at a third, a hundredth of the text taken out at the middle, and a correction appended."""
    n = len(text)
    third, half = n // 3, n // 2
    return [(third, third, " [sic] "), (half, half + n // 100, ""), (n, n + 7, " (revised)")]


TREE = "doc_id long, leaves array<string>, tokens array<int>"


def trees(docs: DataFrame, tokenizer: str | None = None, span: int = SPAN) -> DataFrame:
    """The tree of every whole text, to be saved: doc_id, leaves and tokens (of each leaf).

    Null text counts as empty and has one empty leaf; repeated rows have a tree each; null
    ids stay; an empty table gives an empty result; extra columns have no effect.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in chunks(batches):
            leaves = [segments(t or "", span) for t in batch.column("text").to_pylist()]
            flat = coder.encode_many([x for own in leaves for x in own])[1]
            ends = np.cumsum([len(own) for own in leaves]).tolist()
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "leaves": pa.array(leaves, pa.list_(pa.string())),
                "tokens": pa.array([flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.list_(pa.int32())),
            })

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TREE)


def edited(saved: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] | None = None, tokenizer: str | None = None, span: int = SPAN, keep: bool = True) -> DataFrame:
    """Saved trees after edits: the columns of ``trees`` (if ``keep``), and the counts of ``counted``.

    ``edits`` gives (start, end, new text) in code points of the text as the edits before have
    left it; ends beyond the text are cut off. Without it, each row's own edits are in the
    column edits, an array of structs of these three. Only leaves that edits touch are encoded.
    """
    path = tokenizer or default_tokenizer()
    names = ("n_chars", "n_tokens", "edited_chars", "edited_tokens", "encoded_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)

        def counts(parts: list[str]) -> Sequence[int]:
            return coder.encode_many(parts)[1]

        for batch in chunks(batches):
            rows, after = [], []
            for i, (leaves, tokens) in enumerate(zip(batch.column("leaves").to_pylist(), batch.column("tokens").to_pylist(), strict=True)):
                tree = SegmentTree(leaves, tokens, counts, span)
                before = (tree.n_chars, tree.n_tokens)
                own = edits("".join(leaves)) if edits else [tuple(e.values()) for e in batch.column("edits")[i].as_py() or []]
                for edit in own:
                    tree.replace(*edit)
                rows.append((*before, tree.n_chars, tree.n_tokens, tree.encoded))
                after.append(tree)
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            kept = {"leaves": pa.array([t.leaves for t in after], pa.list_(pa.string())), "tokens": pa.array([t.tokens[0] for t in after], pa.list_(pa.int32()))} if keep else {}
            yield pa.record_batch({"doc_id": batch.column("doc_id"), **kept, **{n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)}})

    given = ["doc_id", "leaves", "tokens"] + ([] if edits else ["edits"])
    return saved.select(*given).mapInArrow(run, (TREE if keep else "doc_id long") + "".join(f", {n} long" for n in names))


def counted(docs: DataFrame, tokenizer: str | None = None, edits: Callable[[str], list[tuple[int, int, str]]] = production_edits, span: int = SPAN) -> DataFrame:
    """Tokens of every whole text before and after its edits.

    Columns: doc_id, n_chars, n_tokens, edited_chars, edited_tokens, encoded_chars (code points
    encoded again for the edits). Trees go straight on to their edits here; to edit them later,
    write ``trees`` to a table. Null text counts as empty; repeated rows are counted each for
    itself; an empty table gives an empty result.
    """
    return edited(trees(docs, tokenizer, span), edits, tokenizer, span, keep=False)
