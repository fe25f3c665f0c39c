"""Edited counts against counting the edited text whole."""

import random

import pytest

from lattica.llm import token_counts as t

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def whole():
    tk = tokenizers.Tokenizer.from_file(t.default_tokenizer())
    return lambda text: len(tk.encode(text, add_special_tokens=False).ids)


HARD = ["", "a", " ", "word" * 300, "x " * 500, "It's <|endoftext|> don't\x1cso 　 中文 😀 İΣς" * 40, "\n\n\t " * 200]


def test_random_edits(whole):
    from lattica.llm.tokens import Encoder

    coder, rng = Encoder(t.default_tokenizer(), pieces=50, words=80), random.Random(5)
    for text in HARD:
        parts = t.segments(text, 20)
        assert "".join(parts) == text
        tree = t.SegmentTree(parts, coder.encode_many(parts)[1], lambda p: coder.encode_many(p)[1], 20)
        assert tree.n_tokens == whole(text)
        for _ in range(25):
            a, b = sorted(rng.choices(range(len(text) + 3), k=2))
            b, new = min(b, a + rng.choice([0, 1, 5, 90])), rng.choice(["", "'s", "q", " new words ", "ss\n" * 30, "|>", "<|"])
            text = text[:a] + new + text[b:] if a <= len(text) else text + new
            assert tree.replace(a, b, new) == whole(text), (a, b, new)
            assert tree.n_chars == len(text) and "".join(tree.leaves) == text


def test_saved_trees_are_edited_again_and_again(spark, small, whole):
    from . import edge

    docs = edge.documents(spark, small)
    saved = t.trees(docs).checkpoint()
    assert saved.count() == docs.count() and t.trees(edge.empty(spark)).count() == 0
    texts = sorted("".join(r["leaves"]) for r in saved.collect())
    assert texts == sorted(r["text"] or "" for r in docs.collect())
    schema = "doc_id long, edits array<struct<start:long,end:long,new:string>>"
    plan = spark.createDataFrame([(-3, [(0, 1, "x"), (2, 2, " more words")]), (-6, [(5, 90_000, "")]), (-1, [(0, 0, "new text")])], schema)
    once = t.edited(saved.join(plan, "doc_id", "left")).checkpoint()
    again = t.edited(once.join(plan, "doc_id", "left")).collect()
    assert len(again) == saved.count()
    for r in once.collect() + again:
        text = "".join(r["leaves"])
        assert sum(r["tokens"]) == r["edited_tokens"] == whole(text) and r["edited_chars"] == len(text)


def test_sums_are_rarely_built_anew(whole, monkeypatch):
    from lattica.llm.tokens import Encoder

    coder, built = Encoder(t.default_tokenizer()), []
    build = t.SegmentTree._build
    monkeypatch.setattr(t.SegmentTree, "_build", lambda self, *a: (built.append(1), build(self, *a))[1])
    text = "some words of a text " * 2000
    parts = t.segments(text)
    tree = t.SegmentTree(parts, coder.encode_many(parts)[1], lambda p: coder.encode_many(p)[1])
    rng = random.Random(2)
    for _ in range(300):
        a = rng.randrange(len(text))
        text = text[:a] + " put in " + text[a + 3 :]
        assert tree.replace(a, a + 3, " put in ") == whole(text) if rng.random() < 0.1 else tree.replace(a, a + 3, " put in ")
        assert tree.n_chars == len(text)
    assert len(built) <= 3 and tree.n_tokens == whole(text)


def test_query_equals_counting_whole(spark, small, whole):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(-i - 1, x) for i, x in enumerate([*HARD, None])], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = t.counted(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["n_tokens"] == whole(text) and r["n_chars"] == len(text)
        for a, b, new in t.production_edits(text):
            text = text[:a] + new + text[b:]
        assert r["edited_tokens"] == whole(text) and r["edited_chars"] == len(text)
        assert r["encoded_chars"] < len(text) / 2 or len(text) < 12 * t.SPAN
    assert t.counted(docs.limit(0)).count() == 0


def test_memories_start_anew_beyond_their_characters(whole):
    from lattica.llm.tokens import Encoder

    coder, longest = Encoder(t.default_tokenizer(), characters=100), max(map(len, HARD))
    for text in HARD * 2:
        assert len(coder.encode(text)) == whole(text)
        assert coder.pieces.characters <= 100 + longest and coder.words.characters <= 100 + longest
