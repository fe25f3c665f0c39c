"""Order MinHash against a plain version, and what likeness must say."""

import hashlib
import re

import xxhash

from lattica.llm import fingerprints as f

from . import edge

M64 = (1 << 64) - 1


def chained(longs, seed=42):
    for x in longs:
        seed = xxhash.xxh64_intdigest((x & M64).to_bytes(8, "little"), seed)
    return seed


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if len(words) >= f.K:
        kmers = [chained(hashed[i : i + f.K]) for i in range(len(words) - f.K + 1)]
    elif words:
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(w.encode(), seed)
        kmers = [seed]
    else:
        kmers = []
    count, numbered = {}, []
    for place, k in enumerate(kmers):
        k >>= 24
        count[k] = count.get(k, 0) + 1
        numbered.append((xxhash.xxh64_intdigest(count[k].to_bytes(4, "little"), xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42)), place))
    elements = []
    for r in range(-(-f.FILL // len(kmers)) if kmers else 0):
        for h, place in numbered:
            if r:
                tag = (1 << 33) | (r << 23)
                h = xxhash.xxh64_intdigest((tag << 24).to_bytes(8, "little"), h)
                elements.append((h >> 58, tag | ((h >> 24) & ((1 << 23) - 1)), place))
            else:
                elements.append((h >> 58, (h >> 24) & ((1 << 33) - 1), place))
    out = []
    for b in range(f.BINS):
        own = []
        for _, order, place in sorted(e for e in elements if e[0] == b):
            if len(own) < f.TUPLE and place not in [p for p, _ in own]:
                own.append((place, order))
        out.append(f"{chained([order for _, order in sorted(own)]) % 65536:04x}" if own else "----")
    return out


def like(a, b):
    either = [(x, y) for x, y in zip(a, b, strict=True) if x != "----" or y != "----"]
    return sum(x == y for x, y in either) / len(either) if either else 1.0


def test_documents(spark, small):
    docs = edge.documents(spark, small).where("doc_id is null or doc_id <> -7")
    rows = docs.select("doc_id", "text").collect()
    ordered = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    nexts = {r["doc_id"]: ordered[(i + 1) % len(ordered)]["text"] or "" for i, r in enumerate(ordered)}
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    got = f.fingerprinted(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["doc_id"]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nexts[r["doc_id"]][:cut]
        own, other, follow = plain(text), plain(edited), plain(nexts[r["doc_id"]])
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(own) and r["edited_fingerprint"] == "".join(other)
        assert abs(r["near_edited"] - like(own, other)) < 1e-9 and abs(r["near_next"] - like(own, follow)) < 1e-9


def test_order_of_the_text_counts(spark):
    words = [f"w{i}" for i in range(600)]
    halves = words[300:] + words[:300]
    rows = [(3, " ".join(words)), (2, " ".join(halves)), (1, " ".join(words[:595] + ["x"]))]
    got = {r["doc_id"]: r for r in f.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: [r["fingerprint"][j : j + 4] for j in range(0, 256, 4)] for i, r in got.items()}
    assert like(prints[3], prints[1]) > 0.9 and like(prints[3], prints[2]) < 0.75


def test_order_counts_in_short_texts(spark):
    n = 20
    words = [[f"{t}w{i}" for i in range(30)] for t in range(n)]
    rows = [(2 * t + 1, " ".join(w)) for t, w in enumerate(words)] + [(2 * t, " ".join(w[15:] + w[:15])) for t, w in enumerate(words)]
    got = f.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 1").collect()
    assert sum(r["near_next"] for r in got) / n < 0.4
    assert all("----" not in r["fingerprint"] for r in got)


def test_many_ranges_and_edges(spark):
    docs = spark.createDataFrame([(i * 7 % 101, f"text {i} of many") for i in range(101)], "doc_id long, text string")
    rows = f.with_next(docs, ["text"], 13).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == 101 and all(r["next_text"] == texts[(r["doc_id"] - 1) % 101] for r in rows)
    one = f.fingerprinted(spark.createDataFrame([(5, "abc def")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0
    twice = f.fingerprinted(edge.documents(spark, "/root/testdata/sf0.001").where("doc_id = -7")).collect()
    assert len(twice) == 2
    assert f.fingerprinted(edge.empty(spark)).count() == 0
