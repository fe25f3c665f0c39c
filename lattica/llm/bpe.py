"""BPE encoding and decoding through tables of distinct words.

The tokenizer's tokens never cross white space, so what a word encodes to doesn't depend on
where it stands. Spark splits texts into words; each stretch of rows that a task holds makes a
table of its distinct words and the words' places in it. Every word of the table is encoded
once, the ids of a text are the table's ids taken by the places of its words, and its decoded
text is the join of those ids with the vocabulary's pieces, made once for each word too.

The table is a task's own. A table over the whole corpus, joined back by shuffles, was built
first; the README has its figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import default_tokenizer
from .tokens import encoder

#: Words that end a stretch of rows with one table; a text of more words has a table of its own.
STRETCH = 1_000_000

#: White space as the tokenizer sees it (a fixed value, Unicode's property White_Space).
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def words_of(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE), lambda w: w != "")


@lru_cache(maxsize=2)
def pieces(tokenizer: str) -> pa.Array:
    """The piece of every id of a vocabulary, null where there is none."""
    vocabulary = encoder(tokenizer).tokenizer.get_vocab(with_added_tokens=True)
    table: list[str | None] = [None] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        table[i] = piece
    return pa.array(table, pa.string())


class WordTable:
    """The distinct words of some texts, with the ids of each, encoded once, and their pieces."""

    def __init__(self, words: pa.Array, tokenizer: str) -> None:
        coded = words.dictionary_encode()
        self.places = coded.indices.to_numpy()
        self.words = coded.dictionary
        self.ids, self.sizes = encoder(tokenizer).encode_many(self.words.to_pylist())
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.decoded = np.array(decoded(self.ids, self.sizes, tokenizer), object)

    def ids_at(self, start: int, end: int) -> np.ndarray:
        """The ids of the words from one position to another."""
        at = self.places[start:end]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]

    def text_at(self, start: int, end: int) -> str:
        """Their decoded text; a word may have no ids."""
        return " ".join(filter(None, self.decoded[self.places[start:end]].tolist()))


def decoded(ids: np.ndarray, sizes: np.ndarray, tokenizer: str) -> list[str]:
    """The texts of id lists that lie end to end: their pieces with a space between, as the tokenizer without a decoder has it.

    Ids that the vocabulary lacks are left out.
    """
    table = pieces(tokenizer)
    ids = np.where(ids < len(table), ids, len(table)).astype(np.int64)
    found = pa.concat_arrays([table, pa.nulls(1, pa.string())]).take(pa.array(ids))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if found.null_count:
        there = np.concatenate([[0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))])
        ends, found = there[ends], found.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), " ").to_pylist()


def stretches(batches: Iterator[pa.RecordBatch], words: int = STRETCH) -> Iterator[pa.RecordBatch]:
    """Batches cut where their lists reach so many words."""
    for batch in batches:
        sizes = batch.column("words").value_lengths().to_numpy(zero_copy_only=False)
        start, used = 0, 0
        for row, n in enumerate(sizes.tolist()):
            if row > start and used + n > words:
                yield batch.slice(start, row - start)
                start, used = row, 0
            used += n
        if start < batch.num_rows:
            yield batch.slice(start)


def encoded(docs: DataFrame, tokenizer: str | None = None, digests: bool = False, stretch: int = STRETCH) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every whole text, or (``digests``) hashes of the last two.

    Null text counts as empty and has no tokens. Rows are independent: repeated rows give
    repeated results, null ids stay; a text of any length is one row, with a table of its own
    if it has more than ``stretch`` words; an empty table gives an empty result; extra columns
    have no effect.
    """
    path = tokenizer or default_tokenizer()
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stretches(batches, stretch):
            lists = batch.column("words")
            table = WordTable(lists.flatten(), path)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            sizes, ids, texts = [], [], []
            for start, end in zip(ends, ends[1:], strict=False):
                own, text = table.ids_at(start, end), table.text_at(start, end)
                sizes.append(len(own))
                ids.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest() if digests else own.astype(np.int32))
                texts.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64()),
                names[0]: pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), names[1]: pa.array(texts, pa.string()),
            })

    schema = f"doc_id long, n_tokens long, {names[0]} {'string' if digests else 'array<int>'}, {names[1]} string"
    return docs.select(F.col("doc_id").cast("long"), words_of(F.col("text")).alias("words")).mapInArrow(run, schema)


def texts_of(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and the decoded text of rows with lists of ids; null or empty lists give an empty text, unknown or null ids are left out."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(decoded(lists.flatten().to_numpy(), sizes, path), pa.string())})

    known = F.filter(F.coalesce(F.col("ids"), F.array()).cast("array<long>"), lambda i: i >= 0)
    return rows.select(F.col("doc_id").cast("long"), known.alias("ids")).mapInArrow(run, "doc_id long, text string")
