"""Fast exact token ids of whole texts, by a tokenizer whose tokens never cross white space.

Texts are cut at white space; each piece is encoded once and remembered. New pieces of Latin
text are cut further into the tokenizer's own pre-tokens, which recur far more often than
pieces do. All memories are bounded.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Pieces and pre-tokens that are remembered, beyond which either memory starts anew.
PIECES, WORDS = 200_000, 500_000
#: Characters of what either memory remembers, beyond which it starts anew as well.
CHARACTERS = 16_000_000

# Fixed values of the tokenizer's pre-token rule for the characters of Latin-1.
_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that str.split() takes for white space and the tokenizer doesn't.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class _Ranked(dict):
    """Numbers its keys in order of first use."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        self.new.append(key)
        return at


class _Memory:
    """Ids of remembered strings, end to end."""

    def __init__(self) -> None:
        self.rank = _Ranked()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.known = self.characters = 0

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the strings that were ranked last, end to end."""
        first = int(self.ends[self.known - 1]) if self.known else 0
        while first + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(sizes) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[first : first + len(ids)] = ids
        self.ends[self.known : self.known + len(sizes)] = first + np.cumsum(sizes)
        self.known += len(sizes)
        self.rank.new = []

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings of the given ranks, end to end, and how many each has."""
        starts = np.where(at > 0, self.ends[at - 1], 0)
        sizes = self.ends[at] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)], sizes


class Encoder:
    """Ids of texts, without special tokens added, equal to those of encoding each text whole."""

    def __init__(self, path: str, pieces: int = PIECES, words: int = WORDS, characters: int = CHARACTERS) -> None:
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.cut = regex.compile(_PRE_TOKEN).findall
        vocabulary = self.tokenizer.get_vocab()
        self.stops = np.zeros(max(vocabulary.values()) + 1, bool)
        self.stops[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.limits = pieces, words, characters
        self.pieces, self.words = _Memory(), _Memory()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn_words(self) -> None:
        new = self.words.rank.new
        self.words.characters += sum(map(len, new))
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            ids = np.array(self._whole(" ".join(some)), dtype=np.uint32)
            ends = np.flatnonzero(self.stops[ids]) + 1
            if len(ends) != len(some):  # a word without an end of its own in the vocabulary
                each = [self._whole(w) for w in some]
                ids, ends = np.array([i for e in each for i in e], dtype=np.uint32), np.cumsum([len(e) for e in each])
            known, self.words.rank.new = self.words.rank.new, []
            self.words.append(ids, np.diff(ends, prepend=0))
            self.words.rank.new = known
        self.words.rank.new = []

    def _learn_pieces(self) -> None:
        """Latin pieces by their pre-tokens, others as they are."""
        rank, counts, ranks, others = self.words.rank.__getitem__, [], [], {}
        self.pieces.characters += sum(map(len, self.pieces.rank.new))
        for n, piece in enumerate(self.pieces.rank.new):
            if piece.isascii() or _latin(piece):
                if piece.isalpha():
                    ranks.append(rank(piece.lower()))
                    counts.append(1)
                elif "<|" not in piece:
                    parts = self.cut(piece.lower())
                    ranks.extend(map(rank, parts))
                    counts.append(len(parts))
                else:
                    others[n] = self._whole(piece)
                    counts.append(0)
            else:
                others[n] = self._whole(piece)
                counts.append(0)
        self._learn_words()
        ids, sizes = self.words.gather(np.array(ranks, dtype=np.int64))
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
        sizes = np.diff(ends, prepend=0)
        if others:
            at = np.cumsum(sizes)
            parts, last = [], 0
            for n, own in others.items():
                parts += [ids[last : at[n]], np.array(own, dtype=np.uint32)]
                last, sizes[n] = at[n], len(own)
            ids = np.concatenate([*parts, ids[last:]])
        self.pieces.append(ids, sizes)

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has."""
        if len(self.pieces.rank) > self.limits[0] or self.pieces.characters > self.limits[2]:
            self.pieces = _Memory()
        if len(self.words.rank) > self.limits[1] or self.words.characters > self.limits[2]:
            self.words = _Memory()
        pieces: list[str] = []
        counts = []
        for text in texts:
            if "<|" not in text and _latin(text):
                text = text.lower()
            own = _SPACE.split(text) if any(c in text for c in _ODD_SPACE) else text.split()
            pieces += own
            counts.append(len(own))
        at = np.fromiter(map(self.pieces.rank.__getitem__, pieces), np.int64, len(pieces))
        if self.pieces.rank.new:
            self._learn_pieces()
        ids, sizes = self.pieces.gather(at)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts, dtype=np.int64)]
        return ids, np.diff(ends, prepend=0)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker, so that what it remembers outlives a task."""
    return Encoder(path)
