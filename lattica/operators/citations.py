"""Citations to the blocks they stand for: tiers from word-for-word to similar.

Similarity is costly, so it is bounded first. The share of words that a block has bounds it from
below and often settles which block leads. What two texts share in order can't exceed the
characters they have in common, nor their longest common subsequence, which big-integer
arithmetic finds in a fraction of the time, for all blocks of a slice at once. Blocks whose bound
can't matter are not compared.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import checkpointed

# The least similarity of a pointed block and of any other, the lead over the
# second that the best must have, characters of a part around an ellipsis, what counts as a word.
POINTED, LEAST, MARGIN, PART = 0.58, 0.65, 0.08, 12
_WORD = re.compile(r"[0-9A-Za-z가-힣]+")

#: Citations and blocks of one document that a task compares at once.
CITATIONS, BLOCKS = 256, 512


def squeezed(text: str | None) -> str:
    """NFKC with single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text or "").split())


@dataclass
class Form:
    """What comparisons need of a text, each worked out once and only if asked for."""

    text: str

    @staticmethod
    def of(text: str | None) -> Form:
        return Form(squeezed(text))

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.text.casefold())

    @cached_property
    def known(self) -> set[str]:
        return set(self.words)

    @cached_property
    def letters(self) -> str:
        return "".join(filter(str.isalnum, self.text.casefold()))

    @cached_property
    def text_bag(self) -> Counter:
        return Counter(self.text)

    @cached_property
    def letter_bag(self) -> Counter:
        return Counter(self.letters)


def fragments_in_order(quote: str, text: str) -> bool:
    """Whether a quote with ellipses has two parts of twelve characters or more, all of which occur in order."""
    if "..." not in quote and "…" not in quote:
        return False
    parts = [p for p in (squeezed(x).strip(" .…") for x in quote.replace("…", "...").split("...")) if len(p) >= PART]
    at = 0
    for part in parts:
        found = text.find(part, at)
        if found < 0:
            return False
        at = found + len(part)
    return len(parts) > 1


def word_share(a: Form, b: Form) -> float:
    """The share of a's words, repeats included, that b has."""
    return sum(w in b.known for w in a.words) / len(a.words) if a.words else 0.0


def matched(a: str, b: str, least: float = 0.0) -> int:
    """The characters of the matching blocks that ``difflib`` finds where nothing is junk; some number below ``least`` if they can't be as many.

    The longest run that both have, the first in a, then in b, then the same on its left and on its
    right. A place of a counts only if a longer run than so far begins there, which a search for
    that run tells.
    """
    total, left, room = 0, [(a, b)], min(len(a), len(b))
    while left and total + room >= least:
        x, y = left.pop()
        room -= min(len(x), len(y))
        at = size = i = 0
        while i + size < len(x):
            while i + size < len(x) and x[i : i + size + 1] in y:
                size, at = size + 1, i
            i += 1
        if size:
            total += size
            j = y.find(x[at : at + size])
            for p, q in (x[:at], y[:j]), (x[at + size :], y[j + size :]):
                if p and q:
                    left.append((p, q))
                    room += min(len(p), len(q))
    return total


def similarity(a: Form, b: Form, need: float = 0.0) -> float:
    """The greatest of: ratio of characters, share of a's words, ratio of letters, share of a's letters; some number below ``need`` if it is below."""
    if not a.text or not b.text:
        return 0.0
    if not a.letters and not b.letters:
        return 1.0
    half = (len(a.letters) + len(b.letters)) / 2.0
    letters = matched(a.letters, b.letters, need * min(half, len(a.letters)) - 1e-6)
    found = [word_share(a, b), letters / half]
    if a.letters:
        found.append(letters / len(a.letters))
    half, most = (len(a.text) + len(b.text)) / 2.0, max(need - 1e-9, *found)
    if (a.text_bag & b.text_bag).total() > most * half - 1e-6:
        found.append(matched(a.text, b.text, most * half - 1e-6) / half)
    return max(found)


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest, by additions of integers with a bit for each character of the longer one."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        masks[c] |= 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        met = row & masks.get(c, 0)
        row = (row + met | row - met) & every
    return len(a) - row.bit_count()


def _most(a: Form, b: Form, shared: int, letters: int) -> float:
    """The most that ``similarity`` can be if texts and letters share so many characters in order."""
    if not a.text or not b.text:
        return 0.0
    ratio = 2.0 * shared / (len(a.text) + len(b.text))
    if not a.letters:
        return max(ratio, 1.0)  # two empty strings of letters are equal
    return max(ratio, 2.0 * letters / (len(a.letters) + len(b.letters)), letters / len(a.letters), word_share(a, b))


def bag_bound(a: Form, b: Form) -> float:
    return _most(a, b, (a.text_bag & b.text_bag).total(), (a.letter_bag & b.letter_bag).total())


def order_bound(a: Form, b: Form) -> float:
    return _most(a, b, common_subsequence(a.text, b.text), common_subsequence(a.letters, b.letters))


def below(a: Form, b: Form, need: float) -> bool:
    """Whether a bound, the cheapest first, tells that the similarity is less than ``need``."""
    if word_share(a, b) >= need:
        return False
    if bag_bound(a, b) < need:
        return True
    letters = common_subsequence(a.letters, b.letters)
    return _most(a, b, 0, letters) < need and _most(a, b, common_subsequence(a.text, b.text), letters) < need


class Texts:
    """Texts that are bounded together: each has its stretch of bits in one integer, with a bit between that carries end in."""

    CLASSES = 256

    def __init__(self, texts: list[str]) -> None:
        self.sizes = np.array([len(t) for t in texts])
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        self.codes[self.starts + self.sizes] = -1
        self.every = self._bits(self.codes >= 0)
        self.masks: dict[str, int] = {}

    @staticmethod
    def _bits(which: np.ndarray) -> int:
        return int.from_bytes(np.packbits(which, bitorder="little").tobytes(), "little")

    @cached_property
    def bags(self) -> np.ndarray:
        """How many characters of each class the texts have."""
        of = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)[self.codes >= 0]
        kinds = of * self.CLASSES + self.codes[self.codes >= 0] % self.CLASSES
        return np.bincount(kinds, minlength=len(self.sizes) * self.CLASSES).reshape(-1, self.CLASSES)

    def in_common(self, a: str) -> np.ndarray:
        """The most characters that each text can share with ``a``."""
        codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4") % self.CLASSES
        return np.minimum(self.bags, np.bincount(codes, minlength=self.CLASSES)).sum(axis=1)

    def in_order(self, a: str) -> np.ndarray:
        """The length of the longest common subsequence of ``a`` and each text, as ``common_subsequence`` does it, for all at once."""
        row = self.every
        for c in a:
            if (mask := self.masks.get(c)) is None:
                mask = self.masks[c] = self._bits(self.codes == ord(c))
            met = row & mask
            row = (row + met | row - met) & self.every
        bits = np.unpackbits(np.frombuffer(row.to_bytes(len(self.codes) // 8 + 1, "little"), np.uint8), bitorder="little")
        return self.sizes - np.add.reduceat(bits, self.starts, dtype=np.int64)


class Slice:
    """Blocks of one document, compared with its citations one by one."""

    def __init__(self, blocks: list[tuple[int, str]]) -> None:
        self.at = [i for i, _ in blocks]
        self.forms = [Form.of(t) for _, t in blocks]
        self.compared = 0

    @cached_property
    def texts(self) -> Texts:
        return Texts([f.text for f in self.forms])

    @cached_property
    def letters(self) -> Texts:
        return Texts([f.letters for f in self.forms])

    def score(self, a: Form, n: int, need: float) -> float:
        self.compared += 1
        return similarity(a, self.forms[n], need)

    def containing(self, a: Form) -> int | None:
        """The first block that holds the citation."""
        return next((self.at[n] for n, f in enumerate(self.forms) if a.text in f.text), None) if a.text else None

    def bounds(self, a: Form, shares: np.ndarray, need: float) -> np.ndarray:
        """The most that the similarity to each block can be, as close as it takes to tell that it is less than ``need``."""
        if not a.text:
            return np.zeros(len(shares))
        ratio = 2.0 / (self.texts.sizes + len(a.text))

        def by_letters(shared: np.ndarray) -> np.ndarray:
            if not a.letters:
                return np.ones(len(shares))  # two empty strings of letters are equal
            return np.maximum(shares, shared * np.maximum(2.0 / (self.letters.sizes + len(a.letters)), 1.0 / len(a.letters)))

        rough = self.texts.in_common(a.text) * ratio
        letters = by_letters(self.letters.in_common(a.letters))
        if ((np.maximum(letters, rough) >= need) & (shares < need)).any():
            letters = by_letters(self.letters.in_order(a.letters))
            if ((letters < need) & (rough >= need)).any():
                rough = self.texts.in_order(a.text) * ratio
        return np.where(self.texts.sizes > 0, np.maximum(letters, rough), 0.0)

    def best(self, a: Form, least: float, margin: float, alone: bool = False, scored: bool = True) -> tuple[float, int, float]:
        """The best score, its block, and the second, as far as they can matter: what can't come within the margin of a best of ``least`` is passed over.

        A block scores its share of words at least, so that the greatest share tells from the start
        what can matter. If no other slice has blocks (alone) and two are within the margin, only
        what would lead both is compared; and where the greatest share leads for certain, it is
        the score unless ``scored``.
        """
        if not self.forms:
            return 0.0, -1, 0.0
        shares = np.array([word_share(a, f) for f in self.forms])
        top = int(shares.argmax())
        floor = max(least, float(shares[top]))
        most = self.bounds(a, shares, floor - margin - 1e-9)
        most[top] += 2.0  # comes first
        order = [n for n in np.argsort(-most, kind="stable").tolist() if most[n] >= floor - margin - 1e-9]
        most[top] -= 2.0
        if alone and not scored and shares[top] >= least and order == [top]:
            return float(shares[top]), self.at[top], 0.0
        best, where, second = 0.0, -1, 0.0
        while order:
            later = []
            for n in order:
                close = alone and best - second < margin
                need = (best + margin if close else max(floor, best) - margin) - 1e-9
                found = self.score(a, n, need) if most[n] >= need else -1.0
                if found < need:
                    later += [n] if close else []
                elif found > best or found == best and self.at[n] < where:
                    best, where, second = found, self.at[n], max(best, second)
                else:
                    second = max(second, found)
            # If one leads after all, what was passed over may be within its margin.
            order = later if best - second >= margin else []
        return best, where, second


def _slices(df: DataFrame, doc: str, size: int, order: Column) -> DataFrame:
    """Numbers rows of a document by slices of about ``size``, and counts the slices."""
    counts = df.groupBy(doc).agg(F.ceil(F.count("*") / size).cast("int").alias("slices"))
    return df.join(counts, doc).withColumn("slice", F.pmod(F.xxhash64(order), F.col("slices").cast("long")).cast("int"))


def cited(citations: DataFrame, blocks: DataFrame, doc: str, least: float = LEAST, margin: float = MARGIN, pointed: float = POINTED, scored: bool = True) -> DataFrame:
    """The block that each citation (doc, citation_id, quote) stands for: citation_id, block_index, tier, score, excerpt, compared.

    A citation may point to a block (column pointed, may be null). In this order: the pointed
    block if it contains the quote; the first block that does; the pointed block if it has the
    parts around the quote's ellipses in order, or a similarity of ``pointed``; then the block of
    the best similarity, if it is ``least`` or more and leads the second by ``margin``. Others
    stay without a block (null). excerpt is the quote where a block contains it, else the
    block's text; score is null but for similar ones, and for them too unless ``scored``; compared
    counts the blocks whose similarity was worked out, which shares of words and bounds often save.

    citation_id tells citations apart. Null quotes contain nothing but count as empty: a
    pointed block holds them. Citations of a document without blocks stay without a block.
    Null ids and null documents stay without one too. Documents with many blocks or citations are dealt out in slices of both.
    """
    own = checkpointed(citations.select(doc, F.col("citation_id").cast("long"), F.col("quote").cast("string"), (F.col("pointed") if "pointed" in citations.columns else F.lit(None)).cast("int").alias("pointed")))
    rows = checkpointed(blocks.select(doc, F.col("block_index").cast("int"), F.col("text").cast("string")))
    left = _slices(own, doc, CITATIONS, F.col("citation_id"))
    right = _slices(rows.join(own.select(doc).distinct(), doc, "left_semi"), doc, BLOCKS, F.floor(F.col("block_index") / 8))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = [d.select(doc, F.col("slices").alias("others")).distinct() for d in (right, left)]
    left = left.join(sizes[0], doc).select(doc, F.col("slice").alias("i"), each("others").alias("j"), F.col("citation_id").alias("n"), F.col("quote").alias("text"), "pointed", F.lit(0).alias("side"), (F.col("others") == 1).alias("alone"))
    right = right.join(sizes[1], doc).select(doc, each("others").alias("i"), F.col("slice").alias("j"), F.col("block_index").cast("long").alias("n"), "text", F.lit(None).cast("int").alias("pointed"), F.lit(1).alias("side"), F.lit(False).alias("alone"))
    schema = "citation_id long, held int, points boolean, parts boolean, near boolean, best double, at int, second double, compared long"

    def run(group: pa.Table) -> pa.Table:
        return _compared(group.to_pylist(), least, margin, pointed, scored)

    found = left.unionByName(right).groupBy(doc, "i", "j").applyInArrow(run, schema)
    scores = F.reverse(F.array_sort(F.flatten(F.collect_list(F.array("best", "second")))))
    merged = found.groupBy("citation_id").agg(
        F.min("held").alias("held"), F.bool_or("points").alias("points"), F.bool_or("parts").alias("parts"), F.bool_or("near").alias("near"),
        F.max(F.struct("best", (-F.col("at")).alias("before"))).alias("top"), scores.alias("scores"), F.sum("compared").alias("compared"),
    )
    leads = (F.col("top.best") >= least) & (F.col("top.best") - F.col("scores")[1] >= margin)
    tier = F.when(F.col("points"), "pointed").when(F.col("held").isNotNull(), "exact").when(F.col("parts"), "ellipsis").when(F.col("near"), "near_pointed").when(leads, "similar")
    named = own.join(merged, "citation_id", "left").withColumn("tier", tier)
    at = F.when(F.col("tier") == "exact", F.col("held")).when(F.col("tier") == "similar", -F.col("top.before")).when(F.col("tier").isNotNull(), F.col("pointed"))
    placed = named.select(doc, "citation_id", "quote", at.alias("block_index"), "tier", F.when((F.col("tier") == "similar") & F.lit(scored), F.col("top.best")).alias("score"), F.coalesce("compared", F.lit(0)).alias("compared"))
    texts = placed.join(rows, [doc, "block_index"], "left")
    return texts.select("citation_id", "block_index", "tier", "score", F.when(F.col("tier").isin("pointed", "exact"), F.col("quote")).otherwise(F.col("text")).alias("excerpt"), "compared")


def _compared(rows: list[dict], least: float, margin: float, pointed: float, scored: bool = True) -> pa.Table:
    """What one slice of blocks says of one slice of citations; where it has all blocks (alone), one that leads for certain is compared for its score only."""
    blocks = sorted((r["n"], r["text"]) for r in rows if r["side"])
    own = Slice([(n, t or "") for n, t in blocks])
    place = {n: k for k, n in enumerate(own.at)}
    out = []
    for r in rows:
        if r["side"]:
            continue
        a, before = Form.of(r["text"]), own.compared
        row = dict.fromkeys(("held", "points", "parts", "near"), None) | {"citation_id": r["n"], "best": 0.0, "at": -1, "second": 0.0}
        row["held"] = own.containing(a)
        k = place.get(r["pointed"])
        if k is not None:
            row["points"] = a.text in own.forms[k].text
            row["parts"] = fragments_in_order(a.text, own.forms[k].text)
            settled = row["points"] or row["parts"] or row["held"] is not None
            row["near"] = not settled and (word_share(a, own.forms[k]) >= pointed or not below(a, own.forms[k], pointed) and own.score(a, k, pointed) >= pointed)
        if row["held"] is None and not (row["points"] or row["parts"] or row["near"]):
            row["best"], row["at"], row["second"] = own.best(a, least, margin, r["alone"], scored)
        out.append(row | {"compared": own.compared - before})
    kinds = {"citation_id": pa.int64(), "held": pa.int32(), "points": pa.bool_(), "parts": pa.bool_(), "near": pa.bool_(), "best": pa.float64(), "at": pa.int32(), "second": pa.float64(), "compared": pa.int64()}
    return pa.table({c: pa.array([r[c] for r in out], t) for c, t in kinds.items()})


def invalid(evidence: DataFrame, blocks: DataFrame, doc: str) -> DataFrame:
    """The evidence rows (doc, block_index, excerpt, citation_id) whose block is missing or doesn't hold the excerpt, with code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("excerpt").to_pylist(), b.column("text").to_pylist(), b.column("there").to_pylist(), strict=True)
            codes = ["missing_block" if not there else None if squeezed(e) in squeezed(t) else "not_in_block" for e, t, there in pairs]
            keep = np.array([c is not None for c in codes], bool)
            yield pa.record_batch({"citation_id": b.column("citation_id").filter(pa.array(keep)), "code": pa.array([c for c in codes if c], pa.string())})

    there = blocks.select(doc, F.col("block_index").cast("int"), F.col("text").cast("string"), F.lit(True).alias("there"))
    joined = evidence.select(doc, F.col("block_index").cast("int"), F.col("citation_id").cast("long"), F.col("excerpt").cast("string")).join(there, [doc, "block_index"], "left")
    return joined.select("citation_id", "excerpt", "text", F.coalesce("there", F.lit(False)).alias("there")).mapInArrow(run, "citation_id long, code string")
