"""Base spans against Python's re on a small table and on hard cases; the added spans; redaction."""

import hashlib
import re

import random

from pyspark.sql import functions as F

from lattica.llm import pii

from . import edge

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def expected(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = [
    "", None, "a@b.co_x@y.com a@b..c x@y z@w.", "@a.b a@.b é@b.co é.x@b.co 😀 q@r.st", "%%a@b.c-.d", "a@b.c@d.e@f.g.h",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 0000000255.1.1.1 99999999999999999999.1.1.1 1.2.3. 4.5.6.7",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 4111111111111111 41111111111111111111 1 2-3",
    "+1 (555) 123-4567 +123 +1234567 +12345678 +1-2-3-4-5-6-7-8. +12(34)56.78.90.12.34.56.78 ++49 30 1234567 x",
    "😀😀 +49 30 1234567 😀 a@b.de 10.0.0.1 4111111111111111", "7" * 5000, "a" * 5000 + "@b.c", "a@" + "b." * 3000 + "c", "1 " * 3000, "x@y.zz " * 2000,
]


def test_base_spans_equal_those_of_re(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    every = docs.union(extra)
    texts = {r["doc_id"]: r["text"] for r in every.collect()}
    rows = pii.detected(every).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = expected(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), (r["doc_id"], base[:5], r["spans"][:200])
        assert set(base) <= set(r["spans"].split(",")) | {""}
        for kind in PATTERNS:
            assert r[f"n_{kind}"] == sum(b.startswith(kind) for b in base)


def test_proposals_need_support(spark):
    rows = [(1, "please call (555) 123-4567 today", 1), (2, "order no 555-123-4567", 2), (3, "write to bob (at) example (dot) com", 3), (4, "plain words", 4)]
    found = {r["doc_id"]: r["spans"] for r in pii.detected(spark.createDataFrame(rows, "doc_id long, text string, extra int")).collect()}
    assert found[1] == "phone:12:26" and found[2] == "" and found[3].startswith("email:9:") and found[4] == ""


def test_redaction_keeps_columns_and_nulls(spark):
    rows = [(1, "mail a@b.com or +1 (555) 123-4567!", "s", 0), (2, None, None, None), (3, "nothing", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, n_chars long")
    out = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert out[1]["text"] == "mail [EMAIL] or [PHONE]!" and out[1]["n_chars"] == 24 and out[1]["base"] == "s"
    assert out[2]["text"] is None and out[3]["text"] == "nothing"


def test_edge_rows_and_empty_tables(spark, small):
    docs = edge.documents(spark, small)
    out = pii.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count() == pii.detected(docs).count()
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == sorted(r["doc_id"] or 0 for r in docs.collect())
    assert pii.detected(edge.empty(spark)).count() == 0 and pii.redacted(edge.empty(spark)).count() == 0


def _plain_em(rows, rounds=30):
    """The same estimates row by row."""
    right, prior = list(pii.BELIEFS), 0.5
    for _ in range(rounds + 1):
        posts = []
        for votes, _n in rows:
            odds = prior / (1 - prior)
            for r, v in zip(right, votes):
                odds *= (r / (1 - r)) ** v
            posts.append(odds / (1 + odds))
        before = list(right)
        total = sum(n for _, n in rows)
        prior = min(0.98, max(0.02, (5 + sum(p * n for p, (_, n) in zip(posts, rows))) / (10 + total)))
        for j in range(len(right)):
            voted = sum(n for v, n in rows if v[j])
            hits = sum(n * (p if v[j] > 0 else 1 - p) for p, (v, n) in zip(posts, rows) if v[j])
            right[j] = min(0.995, max(0.51, (10 * pii.BELIEFS[j] + hits) / (10 + voted)))
    return posts, before


def _proposals(truth_rate=0.5, n=4000, seed=5):
    """Counts of made-up proposals whose labelers err independently; the length tells the truth too."""
    rng, counts = random.Random(seed), {}
    reliable = (0.9, 0.6, 0.97, 0.99)
    for _ in range(n):
        true = rng.random() < truth_rate
        right = [rng.random() < r for r in reliable]
        votes = (1 if true == right[0] else -1, 1 if true == right[1] else -1, int(true and right[2]), -int(not true and right[3] and rng.random() < 0.3))
        length = 1 if (true if rng.random() < 0.95 else not true) else 3
        features = (length, 2, 1, 0, 0, 0, votes[2], 0, -votes[3], int(votes[1] > 0))
        key = (3, votes, features, rng.random() < 0.2, true)
        counts[key] = counts.get(key, 0) + 1
    return counts


def test_expectation_maximisation_equals_a_plain_version():
    import numpy as np

    counts = _proposals()
    rows = [(k[1], n) for k, n in counts.items()]
    posts, right = pii.posteriors(np.array([v for v, _ in rows], float), np.array([n for _, n in rows], float))
    want, reliabilities = _plain_em(rows)
    assert max(abs(a - b) for a, b in zip(posts, want)) < 1e-9 and max(abs(a - b) for a, b in zip(right, reliabilities)) < 1e-9
    assert right[0] > right[1]  # the better labeler is found without labels


def test_classifier_is_trained_beyond_the_votes():
    counts = _proposals()
    merged = {}
    for (kind, votes, features, held, _), n in counts.items():
        merged[kind, votes, features, held] = merged.get((kind, votes, features, held), 0) + n
    model = pii.learn([(*k, n) for k, n in sorted(merged.items())])
    before, after = model.losses[3]
    assert after < 0.6 * before  # trained: better than its start on proposals that it has not seen
    assert model.weights[3][0][1] - model.weights[3][0][3] > 0.3  # the shape counts where the votes are the same
    assert pii.learn([]).weights[3] != model.weights[3] and pii.learn([]).losses == (None,) * 4
    limit = 0.847
    right = sum(n for (k, _, f, _, true), n in counts.items() if (model.score(k, f) >= limit) == true)
    assert right / sum(counts.values()) > 0.85


def test_column_and_plain_scores_agree(spark):
    model = pii.learn([(k[0], k[1], k[2], k[3], n) for k, n in sorted(_proposals().items())])
    features = sorted({k[2] for k in _proposals()})
    df = spark.createDataFrame([(3, list(f)) for f in features], "kind int, features array<int>")
    got = [r[0] for r in df.select(model.accepts(F.col("kind"), F.col("features"))).collect()]
    assert got == [model.score(3, f) >= 0.8472978603872034 for f in features] and True in got and False in got


def test_spans_apart_equal_all_pairs(spark):
    rng = random.Random(11)
    rows = []
    for case in range(60):
        n = (3, 30, 400)[case % 3] if case < 57 else 0
        spans = [[(s, s + rng.randrange(1, 9)) for s in sorted(rng.sample(range(12 * n + 12), n))] for _ in range(2)]
        rows.append((case, [((0, a, b, ""), "", "") for a, b in spans[0]], [(0, a, b, "") for a, b in spans[1]]))
    kind = "struct<kind:int,start:int,end:int,match:string>"
    df = spark.createDataFrame(rows, f"case int, found array<struct<span:{kind},before:string,after:string>>, base array<{kind}>").checkpoint()
    for r in df.select("found", "base", pii._apart(F.col("found"), F.col("base")).alias("apart")).collect():
        base = [(b["start"], b["end"]) for b in r["base"]]
        want = [s for s in (tuple(f["span"]) for f in r["found"]) if not any(a < s[2] and s[1] < b for a, b in base)]
        assert sorted(tuple(a["span"]) for a in r["apart"]) == sorted(want)


def test_many_spans_in_one_text(spark):
    import time

    text = " ".join(f"call +49 30 {1000000 + i} or 555-{100 + i % 900}-{1000 + i % 9000}" for i in range(8000))
    began = time.monotonic()
    row = pii.detected(spark.createDataFrame([(1, text)], "doc_id long, text string").checkpoint()).first()
    assert row["n_phone"] == 8000 and time.monotonic() - began < 60
