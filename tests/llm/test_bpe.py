"""Ids and decoded texts against the tokenizers library over whole texts."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import bpe

from . import edge

TRICKY = ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "İΣς É é", "tabs\t\tand　wide  spaces \x85 x", "x\x1cy\x1dz w", "don't WE'LL 's", "😀👩‍👩‍👧", " a b", "word" * 4000, "\x1c", "﻿bom ᠎ ​", "𝔘𝔫𝔦 \U0001f600\x00nul"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(bpe.default_tokenizer())

    def run(text):
        ids = tk.encode(text or "", add_special_tokens=False).ids
        return ids, tk.decode(ids, skip_special_tokens=False)

    return run


@pytest.fixture(scope="module")
def docs(spark, small):
    return edge.documents(spark, small, [(1_000_000 + i, t, "en", "s", len(t)) for i, t in enumerate(TRICKY)]).cache()


def test_equals_the_library(docs, whole):
    want = sorted((repr(r["doc_id"]), *whole(r["text"])) for r in docs.collect())
    for stretch in (bpe.STRETCH, 500):
        got = bpe.encoded(docs, stretch=stretch).collect()
        assert sorted((repr(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in got) == want
        assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_digests(docs, whole):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs.collect():
        ids, text = whole(r["text"])
        want.append(repr((r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode()))))
    got = bpe.encoded(docs, digests=True)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(want)


def test_each_word_is_encoded_once(monkeypatch):
    asked = []
    own = bpe.encoder(bpe.default_tokenizer())
    monkeypatch.setattr(bpe, "encoder", lambda path: type("Coder", (), {"encode_many": lambda _, words: (asked.extend(words), own.encode_many(words))[1], "tokenizer": own.tokenizer})())
    table = bpe.WordTable(pa.array(["b", "a", "b", "a", "c", "b"]), bpe.default_tokenizer())
    assert asked == ["b", "a", "c"] and table.text_at(1, 4) == "a</w> b</w> a</w>" and len(table.ids_at(0, 6)) == 6 and table.text_at(3, 3) == ""


def test_stretches_hold_so_many_words():
    sizes = [3, 0, 4, 9, 1, 1, 0, 5]
    batch = pa.record_batch({"words": pa.array([["w"] * n for n in sizes], pa.list_(pa.string()))})
    parts = [[len(x) for x in b.column("words").to_pylist()] for b in bpe.stretches(iter([batch, batch.slice(0, 0)]), 5)]
    assert parts == [[3, 0], [4], [9], [1, 1, 0], [5]]


def test_ids_decode_by_themselves(spark, docs, whole):
    rows = spark.createDataFrame([(1, [320, 1125, 49407]), (2, []), (3, None), (4, [99_999, 320, -5, None])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.texts_of(rows).collect()}
    assert got == {1: "a</w> photo</w> <|endoftext|>", 2: "", 3: "", 4: "a</w>"}
    both = bpe.encoded(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    again = {r["doc_id"]: r["text"] for r in bpe.texts_of(both).collect()}
    assert all(again[r["doc_id"]] == r["decoded"] for r in both.collect()) and len(again) > 100


def test_empty(spark):
    assert bpe.encoded(edge.empty(spark), digests=True).collect() == []
