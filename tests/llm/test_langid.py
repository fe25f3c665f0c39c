"""Held-out accuracy, and that nothing but text of documents to learn from is used."""

import zlib

from pyspark.sql import functions as F

from lattica.llm import langid

from . import edge


def test_held_out_accuracy_and_edges(spark):
    docs = edge.documents(spark, "/root/testdata/sf0.01")
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    rows = langid.identified(docs).collect()
    assert len(rows) == docs.count()
    tested = [r for r in rows if r["held_out"] and (r["doc_id"] or -1) >= 0]
    assert sum(r["lang_pred"] == lang[r["doc_id"]][0] for r in tested) / len(tested) > 0.98
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 3 == 1)
        assert 0 <= r["score"] <= 1
        text = lang[r["doc_id"]][1]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))


def test_labels_of_held_out_documents_change_nothing(spark, small):
    docs = edge.documents(spark, small)
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    key = lambda df: sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in langid.identified(df).collect()))
    assert key(docs) == key(other)


def test_training_equals_a_plain_version():
    import math
    import random

    import numpy as np

    rng = random.Random(7)
    rows = []
    for _ in range(60):
        at = sorted(rng.sample(range(12), 4))
        values = [rng.random() for _ in at]
        rows.append((np.array(at), np.array(values), rng.randrange(3)))
    alpha, beta, l1, l2 = 0.5, 1.0, 0.5, 1e-3
    z, n = ([[0.0] * 3 for _ in range(13)] for _ in range(2))

    def weight(f, c):
        if abs(z[f][c]) <= l1:
            return 0.0
        return -(z[f][c] - math.copysign(l1, z[f][c])) / ((beta + math.sqrt(n[f][c])) / alpha + l2)

    for _ in range(2):
        for at, values, label in rows:
            own = [*((12, 1.0),), *zip(at.tolist(), values.tolist(), strict=True)]
            w = {f: [weight(f, c) for c in range(3)] for f, _ in own}
            scores = [sum(w[f][c] * x for f, x in own) for c in range(3)]
            top = max(scores)
            p = [math.exp(s - top) for s in scores]
            for f, x in own:
                for c in range(3):
                    g = x * (p[c] / sum(p) - (c == label))
                    z[f][c] += g - (math.sqrt(n[f][c] + g * g) - math.sqrt(n[f][c])) / alpha * w[f][c]
                    n[f][c] += g * g
    weights, bias = langid._train(rows, 3, alpha, beta, l1, l2, 2)
    # In the operator the bias stands behind all features.
    assert np.allclose(weights[:12], [[weight(f, c) for c in range(3)] for f in range(12)], atol=1e-6)
    assert np.allclose(bias, [weight(12, c) for c in range(3)], atol=1e-6) and not weights[12:].any()
    assert (weights[:12] == 0).any()  # sparse


def test_every_language_is_learnt_within_bounds(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 300)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    rows = []
    for lang in range(60):
        own = [syllables[(lang * 7 + k * k) % len(syllables)] + syllables[(lang * 3 + k) % len(syllables)] for k in range(12)]
        rows += [(lang * 100 + i, " ".join(own[(i * 5 + j * (1 + i % 3)) % 12] for j in range(40)), f"l{lang:02d}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 60
    right = sum(model.predict(t)[0] == lang for _, t, lang in rows[::7])
    assert right / len(rows[::7]) > 0.9


def test_nothing_to_learn_from(spark, small):
    docs = edge.documents(spark, small).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identified(docs).collect()} == {"und"}
    assert langid.identified(edge.empty(spark)).count() == 0
    clash = edge.documents(spark, small).withColumn("score", F.lit("s"))
    kept = langid.recognised(clash)
    assert kept.columns == clash.columns and kept.select("score").distinct().collect()[0][0] == "s"
