"""Secret scans: fixed patterns, and Markov models of random strings and ordinary identifiers.

Both character models are first-order chains over ASCII. They are trained over all
documents: values inside the fixed patterns are the samples of random strings, names of
several parts (``user_name``, ``maxValue``, ``part-2``) elsewhere those of ordinary
identifiers, with plain words, as they stand and put together to names, behind them where
identifiers say nothing. Further tokens are
reported where the log-likelihood ratio of the two models favours a random string clearly.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import chunks

KINDS = ("assign", "access", "hex", "markov")

# Fixed values of the base patterns. Letters of the names match in either case, in ASCII only.
_NAMES = "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)
    for name in ("password", "passwd", "secret", "token", "api_?key")
)
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Names of two parts or more, which are joined by signs, humps or digits.
IDENTIFIER = re.compile(r"[A-Za-z]+(?:[_-][A-Za-z0-9]+)+|[A-Za-z]?[a-z]+(?:[A-Z][a-z]+)+|[A-Za-z]{3,}[0-9]{1,4}")
#: Tokens that the models judge.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Mean log-likelihood ratio for each character from which a token is reported.
LEAST_RATIO = 0.8

_SIZE = 128
_WORDLIKE = np.zeros(256, bool)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_WORDLIKE[[ord(c) for c in "+/_=-" "0123456789" "ABCDEFGHIJKLMNOPQRSTUVWXYZ" "abcdefghijklmnopqrstuvwxyz"]] = True
#: Of what a token's characters are: 1 a small letter, 2 a capital, 3 a sign that joins names or a digit.
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[ord(c) for c in "_-"]] = 1, 2, 3, 3
_SIGNS = [ord(c) for c in "+/_=-"]
_ALNUM = np.zeros(_SIZE, bool)
_ALNUM[[i for i in range(_SIZE) if chr(i).isalnum()]] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base matches, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _values(text: str) -> list[str]:
    """What the base patterns hold to be random strings."""
    found = [m[0] for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [m[0] for m in ACCESS.finditer(text)]
    if ":" in text or "=" in text:
        found += [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 8 and not HEX.search(m[2]) and not ACCESS.search(m[2])]
    return found


def _counted(b: np.ndarray) -> np.ndarray:
    """Counts of neighbouring word-like characters."""
    near = b[:-1].astype(np.uint16) * _SIZE + b[1:]
    return np.bincount(near[_WORDLIKE[b[:-1]] & _WORDLIKE[b[1:]]], minlength=_SIZE * _SIZE)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _pairs(text: str) -> np.ndarray:
    return _counted(np.where(_bytes(text) < _SIZE, _bytes(text), 0))


def _names(b: np.ndarray) -> tuple[list[str], list[int]]:
    """The tokens that are identifiers, and where each starts. Only those with a sign, a hump or a digit inside are looked at."""
    inside = _WORDLIKE[b]
    steps = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    kind = _KIND[b]
    turns = np.flatnonzero((kind[:-1] == 1) & (kind[1:] > 1) | (kind[:-1] == 2) & (kind[1:] > 2))
    some = np.unique(np.searchsorted(starts, turns, side="right") - 1)
    whole = b.tobytes()
    found = [(whole[i:j].decode(), i) for i, j in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
    kept = [(t, i) for t, i in found if IDENTIFIER.fullmatch(t)]
    return [t for t, _ in kept], [i for _, i in kept]


def _plain_pairs(b: np.ndarray) -> np.ndarray:
    """Counts over texts as they stand, with their words put together in capitals, and with a sign between words.

    The last two are what names look like that are made of plain words. Texts are parted by a
    zero, so that no pair crosses from one to the next.
    """
    letter, apart = _LETTER[b], b == 0
    before = np.concatenate([[False], letter[:-1]])
    first = letter & ~(before | np.concatenate([[False], b[:-1] >= _SIZE]))
    capital = np.where(letter, np.where(first, b & 0xDF, b | 0x20), 0)[letter | apart]
    begins = before | np.concatenate([[True], apart[:-1]])
    signed = np.where(letter, b, np.where(apart, 0, ord("/")))[letter | apart | begins]
    return _counted(np.where(b < _SIZE, b, 0)) + _counted(capital) + _counted(signed)


def _chances(counts: np.ndarray, prior: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Transition probabilities: ``share`` from the counts of a row, where it has any, the rest from the prior."""
    sums = counts.sum(axis=1, keepdims=True)
    weight = (sums > 0) * share
    return weight * counts / np.maximum(sums, 1) + (1 - weight) * prior


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each pair of characters, from counts over all documents.

    A uniform chain over letters and digits is the prior of random strings; plain words are
    the prior of identifiers, and a flat chain theirs, so that the ratio is defined without
    any sample.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random, plain, named = (np.zeros(_SIZE * _SIZE, np.int64) for _ in range(3))
        for batch in chunks(batches, 200):
            texts = [t for t in batch.column("text").to_pylist() if t]
            joined = _bytes("\0".join(texts))
            plain += _plain_pairs(joined)
            known = []
            for text in texts:
                values = _values(text)
                known.append(set(values))
                if values:
                    inner = _pairs(" ".join(values))
                    random += inner
                    plain -= np.minimum(inner, plain)
            names, at = _names(joined)
            of = np.searchsorted(np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts]), at, side="right").tolist() if at else []
            named += _pairs(" ".join([n for n, k in zip(names, of, strict=True) if n not in known[k]]))
        at = np.flatnonzero(random + plain + named)
        yield pa.record_batch({"pair": pa.array(at), "random": pa.array(random[at]), "plain": pa.array(plain[at]), "named": pa.array(named[at])})

    sums = docs.select(F.col("text").cast("string")).mapInArrow(count, "pair long, random long, plain long, named long")
    rows = sums.groupBy("pair").agg(F.sum("random"), F.sum("plain"), F.sum("named")).collect()  # a row for each pair of characters at most
    random, plain, named = (np.zeros((_SIZE, _SIZE)) for _ in range(3))
    for pair, *counts in rows:
        for to, n in zip((random, plain, named), counts, strict=True):
            to[pair // _SIZE, pair % _SIZE] = n
    # Any sign may join the words of a name.
    plain[:, _SIGNS] = plain[:, _SIGNS].mean(axis=1, keepdims=True)
    plain[_SIGNS, :] = plain[_SIGNS, :].mean(axis=0, keepdims=True)
    # As much prior as data, so that one frequent alphabet doesn't stand for all random strings.
    prior = np.where(_ALNUM, 1.0, 0.05) * _WORDLIKE[:_SIZE]
    usual = _chances(named, (plain + 0.5) / (plain + 0.5).sum(axis=1, keepdims=True))
    return np.log(np.maximum(_chances(random, prior[None, :] / prior.sum()), 1e-6)) - np.log(usual)


def is_random(token: str, ratios: np.ndarray, least: float = LEAST_RATIO) -> bool:
    """Judges a token that has letters and digits; others are ordinary."""
    if token.isalpha() or not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token):
        return False
    b = np.frombuffer(token.encode(), np.uint8)
    return float(ratios[b[:-1], b[1:]].mean()) >= least


def scan_text(text: str, ratios: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    more = []
    for m in CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())  # base spans that start before the token ends
        if (not before or reach[before - 1] <= m.start()) and is_random(m[0], ratios):
            more.append((m.start(), 3, m.end()))
    return base, sorted(base + more)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, hash of the base spans, and all spans of every whole text.

    Null text counts as empty. Offsets are code points, ends exclusive. Spans of one kind
    don't overlap; base spans with one start stand in the order of their kinds; repeated rows
    give repeated results; null ids stay; an empty table gives an empty result; extra columns
    have no effect.
    """
    ratios = train(docs)

    def written(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t or "", ratios) for t in batch.column("text").to_pylist()]
            counts = [np.bincount([k for _, k, _ in base], minlength=3) if base else (0, 0, 0) for base, _ in found]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                **{f"n_{kind}": pa.array([int(c[k]) for c in counts], pa.int64()) for k, kind in enumerate(KINDS[:3])},
                "base_sha256": pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                "spans": pa.array([written(spans) for _, spans in found], pa.string()),
            })

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
