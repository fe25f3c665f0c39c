"""Alignments against encoding each text whole and comparing all ends with all others."""

import hashlib
import random
from collections import Counter

import pytest

from lattica.llm import alignment as al

from . import edge

TRICKY = ["  ", " ", "a ", "  a  b ", "a\n b", "a\n  b\n\n  c", "tabs\t\t and \t spaces", "literal ▁ sign", "<s> <0x41> <|endoftext|> </s>", "Ａﬁ ﬃ 中文字 日本語 　 x", "nul\x00l", "é é",
          "word" * 500, "😀👩‍👩‍👧 ok", "'s don't WE'LL", " nbsp   x", "x\x1cy z", "1234567890 3.14", "\r\n\r\n a"]


@pytest.fixture(scope="module")
def whole():
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = al.default_tokenizers()
    ta, tb = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    ta.encode_special_tokens = True
    letters = al.byte_letters()

    def run(text):
        """Ids of both sides and the pairs that end together, or none."""
        if not text:
            return None
        want = (" " + text).encode()
        a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
        a_bytes = [bytes(letters[c] for c in ta.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            return None
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        places = {e: k for k, e in enumerate(b_ends)}
        linked = [(k, places[e]) for k, e in enumerate(a_ends) if e in places]
        groups, i, j = [], 0, 0
        for k, m in linked:
            groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : m + 1])))
            i, j = k + 1, m + 1
        return len(a), len(b), ";".join(groups), [(a[k], b[m]) for k, m in linked]

    return run


def test_query_equals_plain_version(spark, small, whole):
    docs = edge.documents(spark, small, [(1_000_000 + i, t, "en", "s", len(t)) for i, t in enumerate(TRICKY)])
    texts = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 60_000]
    few = spark.createDataFrame([(*t, "q") for t in texts], "doc_id long, text string, links string")
    found = [(d, whole(t)) for d, t in texts]
    counts = Counter(p for _, w in found if w for p in w[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    want = []
    for d, w in found:
        if w is None:
            want.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, text, links = w
            want.append((d, n_a, n_b, len(links), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    assert sum(w is None for _, w in found) >= 3
    assert sorted(map(repr, map(tuple, al.weighed(few).collect()))) == sorted(map(repr, want))
    kept = {r["doc_id"]: r for r in al.aligned(few).collect()}
    assert all(kept[d]["groups"] == (w[2] if w else "") for d, w in found if d is not None and d != -7)


def test_segments_of_random_texts(whole):
    own, rng = al.Aligner(*al.default_tokenizers(), segments=40, characters=400), random.Random(3)
    bits = ["a", "The", " ", "  ", "\n", "\t", ".", "中", "é", "▁", "'s", "12", "-", " ", "<s>", "　", "x y"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        for text, (n_a, n_b, n_groups, groups, links) in zip(texts[at : at + 100], own.run(texts[at : at + 100]), strict=True):
            w = whole(text)
            assert (n_a, n_b, n_groups, groups, len(links)) == ((w[0], w[1], len(w[3]), w[2], len(w[3])) if w else (0, 0, 0, "", 0)), repr(text)
            assert [divmod(int(own.keys[c]), 1 << 32) for c in links] == (w[3] if w else [])


def test_empty(spark):
    assert al.weighed(edge.empty(spark)).collect() == []
