"""Fingerprints by hand, and components against all pairs."""

import random

import numpy as np
import xxhash

from lattica.llm import simhash

from . import edge


def by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints, budget=2):
    values = np.array(prints, dtype=np.uint64)
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= budget)
            low = min(label[j] for j in near)
            for j in near:
                if label[j] != low:
                    label[j], changed = low, True
    return label


def test_documents(spark, small):
    docs = edge.documents(spark, small)
    rows = simhash.near_duplicates(docs).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = {i: by_hand(t) for i, t in texts}
    assert len(rows) == len(texts)
    ids = sorted((i for i in prints if i is not None))
    label = components([prints[i] for i in ids])
    least = {g: min(ids[k] for k in range(len(ids)) if label[k] == g) for g in set(label)}
    want = {i: least[g] for i, g in zip(ids, label, strict=True)}
    for r in rows:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["doc_id"] is None or r["component_id"] == want[r["doc_id"]]
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0


def test_links_connect_all_pairs_in_pairs_and_by_stars(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        for _ in range(12):
            values.add(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    label = components(values)
    for paired in (1000, 2):
        from lattica.llm.common import connected_components

        roots = {r["node"]: r["root"] for r in connected_components(simhash.links(df, paired=paired)).collect()}
        groups = {}
        for v, g in zip(signed, label, strict=True):
            groups.setdefault(g, set()).add(roots.get(v, v))
        assert all(len(s) == 1 for s in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_one_of_each_group_stays(spark, small):
    docs = edge.documents(spark, small).where("doc_id is not null")
    kept = simhash.deduplicated(docs)
    rows = simhash.near_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in rows})
    assert kept.columns == docs.columns


def test_rows_without_id_and_repeated_ids_are_documents(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(80)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (3, texts[2]), (4, texts[3]), (4, texts[4]), (4, texts[4]), (5, texts[4]), (6, texts[5]), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    for some in (docs, docs.where("doc_id is not null"), docs.where("doc_id is null")):
        got = [(r["doc_id"], r["text"] or "") for r in simhash.deduplicated(some).collect()]
        want = {t or "" for _, t in (tuple(r)[:2] for r in some.collect())}
        assert len(got) == len(set(got)) and sorted(t for _, t in got) == sorted(want)
        least = {t: min((i is None, i or 0) for i, u, _ in some.collect() if (u or "") == t) for t in want}
        assert {t: (i is None, i or 0) for i, t in got} == least


def test_repeated_rows_leave_the_same_one_whatever_their_order_and_names(spark):
    rows = [(7, "some words of one text", "y", 2, {"k": 1}), (7, "some words of one text", "x", 9, {"k": 2}), (7, "some words of one text", "x", 3, None), (8, "another text of other words entirely", "z", 1, None)]
    got = []
    for some in (rows, rows[::-1], rows[1:] + rows[:1]):
        docs = spark.createDataFrame([(*r, "d", "r") for r in some], "doc_id long, text string, source string, digest int, extra map<string,int>, _digest string, row string")
        kept = simhash.deduplicated(docs)
        assert kept.columns == docs.columns
        got.append(sorted(map(repr, kept.collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 2
