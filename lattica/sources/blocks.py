"""Documents to ordered blocks: pages, paragraphs, refined pieces with offsets; office archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of an archive: members, bytes of one and of all.
MEMBERS, MEMBER_BYTES, ARCHIVE_BYTES = 50, 20 << 20, 100 << 20
#: Fixed value: the length beyond which a block is cut.
REFINE = 900


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, page, block_index and text of the paragraphs: pages end at form feeds, paragraphs at blank lines.

    A document's blocks are numbered within its row, without a shuffle.
    """

    def blocks_of(page: Column, at: Column) -> Column:
        parts = F.transform(F.split(page, r"\n[ \t]*\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", "")))
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct((at + 1).alias("page"), p.alias("text")))

    every = F.flatten(F.transform(F.split(text, "\f"), blocks_of))
    return docs.select(key, F.posexplode(every).alias("block_index", "_block")).select(key, "_block.page", "_block.text", "block_index")


def parse_diagnostics(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks, characters and replacement characters of each document."""
    return blocks.groupBy(key).agg(
        F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.regexp_count("text", F.lit("�"))).alias("n_replaced")
    )


#: Fixed value: where a block may end a piece, after line ends and after the end of a sentence before what begins one.
_STOPS = re.compile(r"\n+|(?<=[.!?다함됨음])\s+(?=[※①-⑳가-하0-9「『])")


_BLANK = re.compile(r"\s*")


def pieces_of(text: str, limit: int = REFINE) -> list[tuple[int, int]]:
    """Places of the pieces of a text, none longer than ``limit``.

    A piece goes on to the first stop at which it would have ``limit`` characters; what is
    too long by then is cut at its last space before the limit, or at the limit where it has
    none. White space after a cut belongs to no piece.
    """
    places: list[tuple[int, int]] = []
    start = 0

    def cut(end: int) -> int:
        if text[start:end].strip():
            places.append((start, end))
        return _BLANK.match(text, end).end()

    for stop in [*(m.end() for m in _STOPS.finditer(text)), len(text)]:
        if stop - start < limit and stop < len(text):
            continue
        while stop - start > limit:
            space = text.rfind(" ", start + 1, start + limit)
            start = cut(space if space > 0 else start + limit)
        if stop > start:
            start = cut(stop)
    return places


def refined(blocks: DataFrame, key: list[str], limit: int = REFINE) -> DataFrame:
    """Blocks with those longer than ``limit`` cut: key, parent_start, parent_end, piece and text.

    Places are those in the block's text without white space around. A block that stays whole
    is piece 0, the pieces of others count from 1. Null text counts as empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *k, t in batch.itertuples(index=False):
                t = (t or "").strip()
                places = pieces_of(t, limit) if len(t) > limit else []
                if len(places) < 2:
                    rows.append((*k, 0, len(t), 0, t))
                else:
                    rows += [(*k, a, b, i, t[a:b].strip()) for i, (a, b) in enumerate(places, 1)]
            yield pd.DataFrame(rows, columns=[*key, "parent_start", "parent_end", "piece", "text"])

    own = blocks.select(*key, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "text")
    return own.mapInPandas(run, f"{schema}, parent_start int, parent_end int, piece int, text string")


#: Fixed value: where a clause ends, at a full stop or in the white space before a numbered item.
_ENDS = re.compile(r"([.!?])(?=\s|$)|(?<!\s)\s++(?=(?:\d++|[가-힣])[.)]\s)")


def clauses_of(text: str) -> list[tuple[int, int]]:
    """Places of the clauses: what ``[^\\n]+?(?:[.!?](?=\\s|$)|(?=\\s+(?:\\d+|[가-힣])[.)]\\s)|$)`` finds, one after the other.

    Ends are looked up once for the whole text. The pattern itself would try every place of a
    line without an end again, for a time that grows with the square of the line.
    """
    # The first and last place at which each end may be, and what it adds to the clause.
    ends = [(m.start(), m.start(), 1) if m[1] else (m.start(), m.end() - 1, 0) for m in _ENDS.finditer(text)]
    if text.endswith("\n"):
        ends.append((len(text) - 1, len(text) - 1, 0))
    ends.append((len(text), len(text), 0))
    found = []
    at, i, line = 0, 0, -1
    while at < len(text):
        if text[at] == "\n":
            at += 1
            continue
        if line < at:
            line = text.find("\n", at)
            line = len(text) if line < 0 else line
        while ends[i][1] <= at:
            i += 1
        stop = max(ends[i][0], at + 1)
        if stop > line:  # nothing ends in what is left of the line
            at = line
            continue
        found.append((at, stop + ends[i][2]))
        at = found[-1][1]
    return found


def clauses(rows: DataFrame, key: str, text: str = "text", carried: Sequence[str] = ()) -> DataFrame:
    """Clauses of the size of a sentence or a line, as they stand in the text: key, clause_start, clause_end and clause, without white space around; and the columns ``carried`` of the text's row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for k, t, *more in batch.itertuples(index=False):
                for a, z in clauses_of(t or ""):
                    inner = t[a:z].strip()
                    if inner:
                        start = a + t[a:z].index(inner)
                        found.append((k, start, start + len(inner), inner, *more))
            yield pd.DataFrame(found, columns=[key, "clause_start", "clause_end", "clause", *carried])

    kind = lambda c: f"{c} {rows.schema[c].dataType.simpleString()}"
    schema = [kind(key), "clause_start int", "clause_end int", "clause string", *map(kind, carried)]
    return rows.select(key, text, *carried).mapInPandas(run, ", ".join(schema))


def kind_of(content: Column, name: Column) -> Column:
    """By signature first, then by name."""
    head = F.hex(F.substring(content, 1, 8))
    lower = F.lower(name)
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B0304"), F.when(lower.endswith(".hwpx"), "hwpx").when(lower.endswith(".xlsx"), "xlsx").otherwise("zip"))
        .when(head.startswith("D0CF11E0A1B11AE1"), F.when(lower.endswith(".xls"), "xls").otherwise("hwp"))
        .when(lower.rlike(r"\.(txt|md|csv)$"), "text")
        .otherwise("unknown")
    )


def _texts(xml: bytes, names: tuple[str, ...]) -> list[str]:
    return ["".join(n.itertext()).strip() for n in ElementTree.fromstring(xml).iter() if n.tag.rpartition("}")[2] in names]


def _office(content: bytes, name: str) -> list[tuple[str, str]]:
    """(section, text) of the blocks of an XLSX or HWPX archive."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        members = safe_members(archive)
        if name.lower().endswith(".xlsx"):
            shared = []
            if "xl/sharedStrings.xml" in members:
                shared = _texts(archive.read("xl/sharedStrings.xml"), ("si",))
            out = []
            for sheet in sorted(m for m in members if re.fullmatch(r"xl/worksheets/[^/]+\.xml", m)):
                for row in ElementTree.fromstring(archive.read(sheet)).iter():
                    if row.tag.rpartition("}")[2] != "row":
                        continue
                    cells = []
                    for cell in row:
                        value = "".join(cell.itertext()).strip()
                        cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
                    if any(cells):
                        out.append((sheet, "\t".join(cells)))
            return out
        return [(m, t) for m in sorted(members) if re.search(r"section\d*\.xml$", m) for t in _texts(archive.read(m), ("p",)) if t]


def safe_members(archive: zipfile.ZipFile) -> list[str]:
    """Names of the members; raises ValueError beyond the limits and for names that leave the archive."""
    infos = [i for i in archive.infolist() if not i.is_dir()]
    if len(infos) > MEMBERS or any(i.file_size > MEMBER_BYTES for i in infos) or sum(i.file_size for i in infos) > ARCHIVE_BYTES:
        raise ValueError("archive too large")
    for i in infos:
        if i.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", i.filename) or ":" in i.filename:
            raise ValueError(f"unsafe name {i.filename}")
    return [i.filename for i in infos]


def parsed_files(files: DataFrame) -> DataFrame:
    """Blocks of files as ``binaryFile`` reads them: path, block_index, section, text, error.

    Text, XLSX, HWPX and archives of those are parsed; another kind, and any failure, gives one
    row with an error and no text.
    """

    def one(content: bytes, name: str, nested: bool) -> list[tuple[str, str]]:
        lower = name.lower()
        if lower.endswith((".xlsx", ".hwpx")):
            return _office(content, name)
        if lower.endswith(".zip") and not nested:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                return [(f"{m}/{s}", t) for m in sorted(safe_members(archive)) for s, t in one(archive.read(m), m, True)]
        if lower.endswith((".txt", ".md", ".csv")):
            text = content.decode("utf-8", "replace")
            return [(f"page {i + 1}", p.strip()) for i, page in enumerate(text.split("\f")) for p in re.split(r"\n[ \t]*\n", page) if p.strip()]
        raise ValueError("unsupported kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, i, s, t, None) for i, (s, t) in enumerate(one(bytes(content), path, False))]
                except (ValueError, zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError) as error:
                    rows.append((path, 0, None, None, str(error)[:500]))
            yield pd.DataFrame(rows, columns=["path", "block_index", "section", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, block_index int, section string, text string, error string")
