"""Fill-in-middle transformation of whole texts.

A text is cut into units by one ``fullmatch`` of ``(unit)*`` of the regex library, which keeps
every repetition of its group: ``match.ends(1)`` gives the number of units and the offset of
every cut. Two hashed numbers choose the cuts; prefix, suffix and middle are put in one of two
orders behind sentinels, from which the text can be rebuilt exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import chunks

#: A line with its end, or what follows the last one.
LINE = r"[^\n]*\n|[^\n]+"
#: Code points up to which a text is matched at once. The regex library can't keep more than some millions of repetitions.
WHOLE = 1 << 20


@dataclass(frozen=True)
class Fim:
    """How texts are transformed: a pattern of units that covers any text, per cent of texts that are transformed, per cent of those with the suffix first, sentinels, seed."""

    unit: str = LINE
    rate: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "7"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        # Else the end of a text and the start of a sentinel might look like a sentinel.
        if len(set(marks)) < 3 or len({m[:1] for m in marks}) > 1 or any(not m or m[0] in m[1:] for m in marks) or any(a != b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("sentinels must differ, none starting another, and begin with one character that is nowhere else in them")


def hashed(doc_id: int | None, seed: str) -> list[int]:
    """Four unsigned 32-bit numbers of a document; a null id is written as nothing."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def unit_ends(text: str, pattern, whole: int = WHOLE) -> list[int]:
    """Ends of all units. ``pattern`` is the compiled ``(unit)*``.

    A text beyond ``whole`` code points is matched in stretches; the last unit of a stretch may
    have been cut, so the next one starts with it again.
    """
    ends, start, size = [], 0, whole
    while True:
        stop = min(start + size, len(text))
        found = pattern.fullmatch(text, start, stop)
        if found is None:
            raise ValueError("the pattern of units doesn't cover a text")
        own = found.ends(1)
        if stop == len(text):
            return ends + own
        if len(own) > 1:
            ends += own[:-1]
            start, size = own[-2], whole
        else:  # one unit longer than the stretch
            size *= 2


def transform(text: str, numbers: list[int], how: Fim, pattern) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, output. ``pattern`` is the compiled ``(unit)*``."""
    ends = unit_ends(text, pattern)
    n = len(ends)
    if not text or how.prefix in text or how.suffix in text or how.middle in text or numbers[2] % 100 >= how.rate:
        return n, "plain", None, None, text
    first, last = sorted(h % (n + 1) for h in numbers[:2])
    a, b = (ends[i - 1] if i else 0 for i in (first, last))
    if numbers[3] % 100 < how.suffix_first:
        return n, "spm", a, b - a, how.suffix + text[b:] + how.prefix + text[:a] + how.middle + text[a:b]
    return n, "psm", a, b - a, how.prefix + text[:a] + how.suffix + text[b:] + how.middle + text[a:b]


def transformed(docs: DataFrame, how: Fim = Fim()) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every whole text.

    Null text counts as empty and stays plain, as does a text that holds a sentinel; offsets
    are code points, null where plain. Texts of more than WHOLE code points are matched in
    stretches of that length, so that a hundred MB of empty lines pass too. Rows are independent: repeated ones give repeated results, null ids
    are hashed as an empty number; an empty table gives an empty result; extra columns have
    no effect.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pattern = regex.compile(f"({how.unit})*")
        names = ("n", "form", "prefix_chars", "middle_chars", "output")
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in chunks(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = [transform(t or "", hashed(i, how.seed), how, pattern) for i, t in zip(ids, texts, strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), **{c: pa.array(v, t) for c, v, t in zip(names, columns, types, strict=True)}})

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, how: Fim = Fim()) -> Column:
    """The text behind an output, from the output and its form alone."""

    def between(first: str, second: str) -> Column:  # <first>x<second>y<middle>z
        head = F.substring_index(output, second, 1)
        tail = F.substring_index(output, second, -1)
        x = F.substr(head, F.lit(len(first) + 1))
        y, z = F.substring_index(tail, how.middle, 1), F.substring_index(tail, how.middle, -1)
        return F.concat(x, z, y) if first == how.prefix else F.concat(y, z, x)

    return F.when(form == "plain", output).when(form == "psm", between(how.prefix, how.suffix)).when(form == "spm", between(how.suffix, how.prefix))


def digested(docs: DataFrame, how: Fim = Fim()) -> DataFrame:
    """``transformed`` with hashes of the output and of the text rebuilt from it in their place."""
    rebuilt = restored(F.col("output"), F.col("form"), how)
    return transformed(docs, how).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, string_split(t, chr(10)) AS parts, CAST('0x' || x[1:8] AS UBIGINT) AS h1, CAST('0x' || x[9:16] AS UBIGINT) AS h2, CAST('0x' || x[17:24] AS UBIGINT) AS h3, CAST('0x' || x[25:32] AS UBIGINT) AS h4 FROM d),
u AS (SELECT *, CAST(len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS n FROM h),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b FROM u),
e AS (SELECT *, CASE WHEN a = 0 THEN 0 WHEN a < len(parts) THEN length(array_to_string(parts[1:a], chr(10))) + 1 ELSE length(t) END AS p,
  CASE WHEN b = 0 THEN 0 WHEN b < len(parts) THEN length(array_to_string(parts[1:b], chr(10))) + 1 ELSE length(t) END AS q,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
o AS (SELECT *, substr(t, 1, p) AS pre, substr(t, p + 1, q - p) AS mid, substr(t, q + 1) AS suf FROM e)
SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN p END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN q - p END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM o
"""
