"""Alignment of two tokenizers' ids over whole texts.

Both tokenizers' cumulative byte ends are keys of dictionaries to token indexes. Their key
sets' intersection, sorted, slices both id lists into groups; where the ends of an A and a B
token are one, the two are linked. Neither tokenizer joins what stands before a single space
with what follows, so texts are cut there and each distinct segment is aligned once by a
worker that remembers it.

Of two linked tokens the bytes of one end with those of the other. So the vocabularies alone
bound which id pairs there can be, whatever the corpus; pairs are numbered by that list.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .packing import chunks
from .tokens import _Memory

#: Segments that a worker remembers, and their characters, beyond which it starts anew.
SEGMENTS, CHARACTERS = 400_000, 8_000_000
#: New segments that are aligned as one text.
STRETCH = 1000
#: A single space after anything but white space, where both tokenizers can be cut.
_CUT = re.compile(r"(?<=\S)(?= )")
_UNEVEN = re.compile(r"\s | $")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1 stands for itself, all else for 256 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def align(a_sizes: list[int], b_sizes: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ends of the groups as token counts of both sides, and the links as token indexes; no token is empty."""
    a_ends = {end: n for n, end in enumerate(accumulate(a_sizes), 1)}
    b_ends = {end: n for n, end in enumerate(accumulate(b_sizes), 1)}
    common = sorted(a_ends.keys() & b_ends.keys())
    groups = [(a_ends[end], b_ends[end]) for end in common]
    # Tokens aren't empty: of each side just one token of a group ends where the group does.
    return groups, [(a - 1, b - 1) for a, b in groups]


class Aligner:
    """Both tokenizers, the bytes behind their ids, and the segments that were aligned already."""

    def __init__(self, a_path: str, b_path: str, segments: int = SEGMENTS, characters: int = CHARACTERS) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        names = sorted((i, t) for t, i in self.a.get_vocab().items())
        self.a_bytes = [b""] * (names[-1][0] + 1)
        for i, t in names:
            self.a_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_space = self.b.piece_to_id("▁")
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.a_sizes, self.b_sizes = np.array(self.a_size), np.array(self.b_size)
        self.names = [str(i) for i in range(max(len(self.a_size), len(self.b_size)))]
        # A token in which a space follows anything but white space, or an empty one, would forbid what this module rests on.
        if any("▁" in p.lstrip("▁") for p in pieces) or any(_CUT.search(t.decode("utf-8", "replace")) for t in self.a_bytes) or not all(self.a_size) or not all(self.b_size):
            raise ValueError("tokens are empty or hold a space after something else")
        self.keys = pair_keys(self.a_bytes, self.b_bytes)
        self.limits = segments, characters
        self.forget()

    def forget(self) -> None:
        self.rank: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts, self.links = _Memory(), _Memory()
        self.characters = 0

    def encode(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both sides of strings that start with a space."""
        coded = self.a.encode_batch_fast(segments, add_special_tokens=False)
        # B adds the space itself, but gives nothing for an empty text.
        for a, s, b in zip(coded, segments, self.b.encode([s[1:] for s in segments], num_threads=1), strict=True):
            yield a.ids, [self.b_space] if s == " " else b

    def codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of id pairs."""
        return np.searchsorted(self.keys, a.astype(np.int64) << 32 | b.astype(np.int64))

    def learn(self, segments: list[str]) -> None:
        """Aligns new segments and remembers their counts, links and groups.

        Segments that may stand side by side are aligned as one text, STRETCH at a time.
        """
        plain = [s for s in segments if not s[-1].isspace()]
        if len(plain) < len(segments):  # what ends in white space can't be followed by a cut
            rest = [s for s in segments if s[-1].isspace()]
            segments[:] = plain + rest
        for at in range(0, len(plain), STRETCH):
            if not self._learn(plain[at : at + STRETCH]):
                for one in plain[at : at + STRETCH]:
                    self._learn([one], True)
        for one in segments[len(plain) :]:
            self._learn([one], True)

    def _learn(self, segments: list[str], odd: bool = False) -> bool:
        """One stretch of segments; false, and nothing remembered, if its bytes differ, unless such are to be marked as odd."""
        whole = "".join(segments)
        ((a, b),) = self.encode([whole])
        if not self.kept(whole, a, b):
            if odd:
                self.counts.append(np.array([0, 0, 0, 1], np.uint32), np.array([4]))
                self.links.append(np.zeros(0, np.uint32), np.array([0]))
                self.texts.append("")
            return odd
        groups, links = align([self.a_size[i] for i in a], [self.b_size[i] for i in b])
        ends = np.cumsum([len(s.encode()) for s in segments])
        a_ends, b_ends = (np.cumsum(size[ids]) for size, ids in ((self.a_sizes, a), (self.b_sizes, b)))
        to_a, to_b = (np.searchsorted(x, ends) + 1 for x in (a_ends, b_ends))
        to_group = np.searchsorted(a_ends[[i for i, _ in links]], ends) + 1
        texts = group_texts(self.names, a, b, groups)
        starts = [0, *to_group.tolist()]
        self.texts += [";".join(texts[i:j]) for i, j in zip(starts, starts[1:], strict=False)]
        n_links = np.diff(to_group, prepend=0)
        counts = np.stack([np.diff(to_a, prepend=0), np.diff(to_b, prepend=0), n_links, np.zeros(len(segments), np.int64)], axis=1)
        self.counts.append(counts.astype(np.uint32).ravel(), np.full(len(segments), 4))
        left, right = np.array(a)[[i for i, _ in links]], np.array(b)[[j for _, j in links]]
        self.links.append(self.codes(left, right).astype(np.uint32), n_links)
        return True

    def kept(self, whole: str, a: list[int], b: list[int]) -> bool:
        """Whether both sides' bytes are the text's."""
        want = whole.encode()
        return b"".join([self.b_bytes[i] for i in b]) == want == b"".join([self.a_bytes[i] for i in a])

    def run(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """Tokens of A and of B, groups, the groups as text, and the links' numbers, of each text."""
        if len(self.rank) > self.limits[0] or self.characters > self.limits[1]:
            self.forget()
        parts: list[str] = []
        sizes = []
        for text in texts:
            whole = " " + text
            if not text:
                own = []
            elif _UNEVEN.search(whole):
                own = [p[1:] for p in _CUT.split(whole)]
            else:
                own = text.split(" ")
            parts += own
            sizes.append(len(own))
        new = [" " + p for p in dict.fromkeys(parts) if p not in self.rank]
        if new:
            self.learn(new)
            for s in new:
                self.rank[s[1:]] = len(self.rank)
            self.characters += sum(map(len, new))
        at = np.fromiter(map(self.rank.__getitem__, parts), np.int64, len(parts))
        counts = self.counts.gather(at)[0].reshape(-1, 4).astype(np.int64)
        links, each = self.links.gather(at)
        ends = np.cumsum(sizes)
        sums = np.vstack([np.zeros((1, 4), np.int64), np.cumsum(counts, axis=0)])
        link_ends = np.concatenate([[0], np.cumsum(each)])
        for start, end, text in zip((ends - sizes).tolist(), ends.tolist(), texts, strict=True):
            n_a, n_b, n_groups, odd = (sums[end] - sums[start]).tolist()
            if odd:  # some segment's bytes differ; the text counts as a whole
                yield self.whole(text)
            else:
                yield n_a, n_b, n_groups, ";".join([self.texts[r] for r in at[start:end].tolist()]), links[link_ends[start] : link_ends[end]]

    def whole(self, text: str) -> tuple[int, int, int, str, np.ndarray]:
        """A text at one go."""
        ((a, b),) = self.encode([" " + text])
        if not self.kept(" " + text, a, b):
            return 0, 0, 0, "", np.zeros(0, np.uint32)
        groups, links = align([self.a_size[i] for i in a], [self.b_size[i] for i in b])
        codes = self.codes(np.array([a[i] for i, _ in links]), np.array([b[j] for _, j in links]))
        return len(a), len(b), len(groups), ";".join(group_texts(self.names, a, b, groups)), codes.astype(np.uint32)


def group_texts(names: list[str], a: list[int], b: list[int], groups: list[tuple[int, int]]) -> list[str]:
    """``a1,a2|b1`` of each group; ``names`` are the ids as text."""
    out, i, j = [], 0, 0
    for to_a, to_b in groups:
        left = names[a[i]] if to_a == i + 1 else ",".join([names[x] for x in a[i:to_a]])
        right = names[b[j]] if to_b == j + 1 else ",".join([names[x] for x in b[j:to_b]])
        out.append(f"{left}|{right}")
        i, j = to_a, to_b
    return out


def pair_keys(a_bytes: list[bytes], b_bytes: list[bytes]) -> np.ndarray:
    """All id pairs (A in the upper, B in the lower half) of which one's bytes end with the other's, sorted."""
    found = set()
    for own, other, left in ((a_bytes, b_bytes, True), (b_bytes, a_bytes, False)):
        ids: dict[bytes, list[int]] = {}
        for i, t in enumerate(other):
            ids.setdefault(t, []).append(i)
        for i, t in enumerate(own):
            for cut in range(len(t)):
                for j in ids.get(t[cut:], ()):
                    found.add(i << 32 | j if left else j << 32 | i)
    return np.array(sorted(found), np.int64)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker."""
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, groups_sha256 and links of every whole text.

    groups is the text ``a1,a2|b1;a3|b2,b3`` of ids (left out if not ``groups``), links the
    numbers of the linked id pairs (see ``pairs``) in order. Null and empty texts, and those
    whose bytes a tokenizer doesn't keep, have no tokens: zeros, no links, and an empty text
    in place of the hash. Rows are independent: repeated rows give repeated results, null ids
    stay; a text of any length is one row; an empty table gives an empty result; extra
    columns have no effect.
    """
    paths = (a or default_tokenizers()[0], b or default_tokenizers()[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for batch in chunks(batches):
            rows = list(own.run([t or "" for t in batch.column("text").to_pylist()]))
            ends = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])]).astype(np.int32)
            flat = np.concatenate([r[4] for r in rows]).astype(np.int32) if rows else np.zeros(0, np.int32)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                **{n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(("n_a", "n_b", "n_groups"))},
                **({"groups": pa.array([r[3] for r in rows], pa.string())} if groups else {}),
                "groups_sha256": pa.array([hashlib.sha256(r[3].encode()).hexdigest() if r[0] else "" for r in rows], pa.string()),
                "links": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            })

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, f"doc_id long, n_a long, n_b long, n_groups long, {'groups string, ' if groups else ''}groups_sha256 string, links array<int>")


def pairs(rows: DataFrame) -> DataFrame:
    """How many links of ``aligned`` rows hold each id pair: pair, n. At most as many rows as ``pair_keys`` lists."""
    return rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def weighed(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """``aligned`` without groups and links, with n_links, n_best and count_sum.

    A pair's count is over all rows; n_best are links whose count no other pair with their B
    id exceeds, count_sum is the sum of the links' counts. The counts are sent to every task:
    there are no more than the vocabularies' ``pair_keys``, some hundred thousand numbers.
    """
    paths = (a or default_tokenizers()[0], b or default_tokenizers()[1])
    rows = checkpointed(aligned(docs, *paths, groups=False))
    counted = pairs(rows).toArrow()  # bounded by the vocabularies
    keys = aligner(*paths).keys
    counts = np.zeros(len(keys), np.int64)
    counts[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    right = (keys & 0xFFFFFFFF).astype(np.int64)
    most = np.zeros(int(right.max()) + 1, np.int64)
    np.maximum.at(most, right, counts)
    sent = docs.sparkSession.sparkContext.broadcast((counts, counts == most[right]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = sent.value
        for batch in batches:
            links = batch.column("links")
            at, ends = links.flatten().to_numpy(), np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))])
            summed = [np.concatenate([[0], np.cumsum(x[at])])[ends] for x in (counts, best)]
            yield pa.record_batch({
                **{n: batch.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups")},
                "n_links": pa.array(np.diff(ends), pa.int64()), "n_best": pa.array(np.diff(summed[1]), pa.int64()),
                "count_sum": pa.array(np.diff(summed[0]), pa.int64()), "groups_sha256": batch.column("groups_sha256"),
            })

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
