"""An exact round trip, whole sequences, and the sources' shares of every window."""

import zlib

import numpy as np
import pytest

from lattica.llm import packing

from . import edge


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_tokenizer())
    return lambda text: [*tk.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("length", [4096, 64])
def test_round_trip(spark, small, ids_of, length):
    docs = edge.documents(spark, small)
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -(10**9), tuple(ids_of(r["text"]))) for r in docs.collect())
    pieces = packing.packed(docs, length=length).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert p["ids_crc32"] == zlib.crc32(p["ids"]) and len(ids) == p["length"] > 0
        by_doc.setdefault(p["doc_id"] if p["doc_id"] is not None else -(10**9), []).append((p["start"], ids, p["doc_tokens"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["source"]))
    got = []
    for d, parts in by_doc.items():
        parts = sorted(parts, key=lambda x: x[0])
        copies = sum(p[0] == 0 for p in parts)
        assert len({p[2] for p in parts}) == 1
        total = parts[0][2]
        flat = np.zeros((total,), np.int64)
        covered = np.zeros(total, np.int64)
        for start, ids, _ in parts:
            flat[start : start + len(ids)] = ids
            covered[start : start + len(ids)] += 1
        assert (covered == copies).all()
        got += [(d, tuple(flat.tolist()))] * copies
    assert sorted(got) == want
    total = sum(len(w[1]) for w in want)
    for n, parts in by_sequence.items():
        at = 0
        for offset, size, _ in sorted(parts):
            assert offset == at
            at += size
        assert at == length if n < total // length else at & (at - 1) == 0
    # Every source is within two tokens of its share in every full window.
    share = {}
    for p in pieces:
        share[p["source"]] = share.get(p["source"], 0) + p["length"]
    for n in range(total // length):
        for source, tokens in share.items():
            sent = sum(size for _, size, s in by_sequence[n] if s == source)
            assert abs(sent - tokens / total * length) <= 2 + len(share) / 2
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_schedule_with_ties_and_tiny_queues():
    s = packing.Schedule([5, 5, 5, 1, 10_000, 0], 16)
    every = np.arange(s.windows + 1)
    sent = s.sent(every)
    assert (np.diff(sent, axis=0) >= 0).all() and (sent.sum(axis=1) == s.ends(every)).all() and sent[-1].tolist() == [5, 5, 5, 1, 10_000, 0]
    for queue in range(5):
        for token in range(int(s.queues[queue])):
            found = packing._candidates(token, token, queue, s)
            at = int(np.searchsorted(sent[:, queue], token, side="right")) - 1
            assert at in found


def _round_robin(queues, weights, length, windows):
    """Credit and deficits kept step by step; all credit goes to queues that aren't empty."""
    sent, credit = [0.0] * len(queues), [0.0] * len(queues)
    for _ in range(windows):
        left = float(length)
        while left > 1e-9:
            active = [i for i in range(len(queues)) if credit[i] < queues[i] - 1e-9]
            if not active:
                break
            pace = sum(weights[i] for i in active)
            step = min(left / pace, *((queues[i] - credit[i]) / weights[i] for i in active))
            for i in active:
                credit[i] += step * weights[i]
            left -= step * pace
        yield list(credit)


def test_target_proportions_and_deficits():
    queues, weights, length = [4000, 900, 2500, 17], [1.0, 3.0, 2.0, 0.5], 64
    s = packing.Schedule(queues, length, weights)
    every = np.arange(s.windows + 1)
    sent, deficits = s.sent(every), s.deficits(every)
    assert (sent.sum(axis=1) == s.ends(every)).all() and sent[-1].tolist() == queues and (np.diff(sent, axis=0) >= 0).all()
    for n, credit in enumerate(_round_robin(queues, weights, length, s.full)):
        assert np.allclose(sent[n + 1] + deficits[n + 1], credit, atol=1e-6)
    assert np.abs(deficits).max() <= 1.5 and np.abs(deficits).max() > 0.1 and np.allclose(deficits.sum(axis=1), 0, atol=1e-6)
    # 3 of 6.5 parts of every window as long as the queue lasts, none thereafter
    assert abs((sent[3] - sent[0])[1] - 3 * 64 * 3 / 6.5) <= 2 and sent[30][1] == 900
    for queue in range(4):
        for token in range(0, queues[queue], 7):
            at = int(np.searchsorted(sent[:, queue], token, side="right")) - 1
            assert at in packing._candidates(token, token, queue, s)
    with pytest.raises(ValueError):
        packing.Schedule([1, 2], 4, [0.0, 1.0])


def test_weights_and_many_sources(spark, small, ids_of, monkeypatch):
    docs = edge.documents(spark, small)
    total = sum(len(ids_of(r["text"])) for r in docs.collect())
    sources = [r[0] for r in docs.select("source").distinct().collect()]
    rows = packing.packed(docs, weights={s: 1.0 for s in sources}).collect()
    first = {}
    for p in rows:
        if p["sequence_id"] == 0:
            first[p["source"]] = first.get(p["source"], 0) + p["length"]
        assert abs(p["deficit"]) <= len(sources)
    assert sum(p["length"] for p in rows) == total and max(first.values()) - min(first.values()) <= 4096
    monkeypatch.setattr(packing, "QUEUES", 2)
    few = packing.packed(docs).collect()
    assert sum(p["length"] for p in few) == total
    by_sequence = {}
    for p in few:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size


def test_empty_table(spark):
    assert packing.pieces(edge.empty(spark)).count() == 0


def test_windows_are_found_in_few_rounds(monkeypatch):
    schedule = packing.Schedule([1_234_567, 7_654_321, 3_333_333, 999], 4096)
    rounds, floor = [], np.floor
    monkeypatch.setattr(packing.np, "floor", lambda x: rounds.append(len(x)) or floor(x))
    windows = np.arange(0, schedule.windows + 1)
    sent = schedule.sent(windows)
    assert (sent.sum(axis=1) == schedule.ends(windows)).all() and (np.diff(sent, axis=0) >= 0).all()
    assert sum(rounds) < 24 * len(windows), sum(rounds) / len(windows)
