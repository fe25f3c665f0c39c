"""Against all pairs, with copies, large buckets and vectors that link with nothing."""

import numpy as np
import pytest

from lattica.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<float>, label int, rep string"


def brute(rows, least=0.95):
    good = [(i, np.array(v, dtype="f8")) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, label = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    pairs = []
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                pairs.append((good[a][0], good[b][0]))
                links[good[a][0]] += 1
                links[good[b][0]] += 1
    for _ in range(len(rows)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return links, label


@pytest.mark.parametrize("block", [1024, 8])
def test_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 32))
    rows, n = [], 0
    for i in range(260):
        near = base[i % 40] if i % 3 else base[0]
        v = (near / np.linalg.norm(near) + rng.standard_normal(32) * rng.choice([0.0, 0.005, 0.02, 0.06])) * rng.choice([1.0, 3.7])
        rows.append((n, [float(np.float32(x)) for x in v]))
        n += 1
    rows += [(n, None), (n + 1, [0.0] * 32), (n + 2, []), (n + 3, [float("nan")] + [1.0] * 31), (n + 4, [float("inf")] * 32), (n + 5, [None] + [1.0] * 31), (n + 6, [1.0, 0.0]), (n + 7, [2.0, 0.01])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA).repartition(3)
    links, label = brute(rows)
    got = {r["vec_id"]: r for r in e.near_duplicates(df, block=block).collect()}
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= links[i] for i in links) and found >= 0.97 * sum(links.values())
    assert [got[i]["n_links"] for i in range(n, n + 6)] == [0] * 6 and got[n + 6]["n_links"] == 1
    assert sum(got[i]["component_id"] == label[i] for i in label) >= 0.98 * len(label)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_empty_table(spark):
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shape_reaches_the_recall():
    for n in (10, 10_000, 10**9):
        k, tables = e.shape(n)
        near = e.meeting_chance(np.sqrt(0.1)) ** k
        assert 1 - (1 - near) ** tables >= e.RECALL
