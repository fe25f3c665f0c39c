"""Against counting every window, with small windows, split groups and repeats across documents."""

import random

import pytest

from lattica.llm import substring_dedup as s

from . import edge


def result(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -(10**9), *r[1:]) for r in df.collect())


def expected(docs, window):
    rows = s.brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], window)
    return sorted((r[0] if r[0] is not None else -(10**9), *r[1:]) for r in rows)


def test_documents(spark, small):
    docs = edge.documents(spark, small)
    assert result(s.digested(docs)) == expected(docs, 35)
    assert s.digested(edge.empty(spark)).count() == 0


@pytest.mark.parametrize(("window", "group"), [(4, 100_000), (4, 3), (9, 5), (35, 2)])
def test_random_texts(spark, window, group):
    rng = random.Random(window + group)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = [rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(rng.randrange(0, 90))]
        at, a = rng.randrange(len(words) + 1), rng.randrange(0, 30)
        if i % 2:
            words[at:at] = passage[a : a + rng.randrange(5, 60)]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(s.digested(docs, window, group)) == expected(docs, window)


def test_thousands_of_copies_and_a_shared_passage(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(7, text)] * 1000 + [(None, text)] * 1000 + [(i, text + " end") for i in range(100, 103)]
    rows += [(1000 + i, f"a{i} b{i} {passage} c{i} " + " ".join(f"own{i}x{j}" for j in range(20))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for group in (s.GROUP, 100):
        got = result(s.digested(docs, group=group))
        assert len(got) == len(rows)
        by_id = {}
        for d, n, removed, _ in got:
            by_id.setdefault(d, set()).add((n, removed))
        assert by_id[7] == by_id[-(10**9)] == {(3000, 3000)}
        assert all(by_id[i] == {(3001, 3001)} for i in range(100, 103))
        assert all(by_id[1000 + i] == {(73, 50)} for i in range(1500))
