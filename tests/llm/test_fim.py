"""Cuts and outputs against a plain version, and exact restoring."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica.llm import fim

from . import edge


def plain(doc_id, text):
    text = text or ""
    x = hashlib.sha256(b"7:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h = [int(x[i : i + 8], 16) for i in range(0, 32, 8)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert "".join(lines) == text
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TRICKY = ["\n", "\n\n\n", "a\r\nb c\n", "x<P>y\nz", "ends with <\n<P\n<S", "<M", "😀\n" * 40, "last without end", "a\n" * 20_000, "one line " * 200_000]


@pytest.fixture(scope="module")
def docs(spark, small):
    return edge.documents(spark, small, [(1_000_000 + i, t, "en", "s", len(t)) for i, t in enumerate(TRICKY)]).cache()


def test_equals_plain_version(docs):
    out = fim.transformed(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: repr(r)
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out), key=key)
    assert got == sorted(((r["doc_id"], *plain(r["doc_id"], r["text"]), r["text"] or "") for r in docs.collect()), key=key)
    assert {r["form"] for r in out} == {"plain", "spm", "psm"}


def test_equals_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    cursor = con.execute(fim.ORACLE)
    names = [d[0] for d in cursor.description]
    got = fim.digested(docs)
    assert got.columns == names
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, cursor.fetchall()))


def test_other_settings(spark):
    how = fim.Fim(unit=r"\S+\s*|\s+", rate=40, suffix_first=0, prefix="p", suffix="s", middle="m")
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("repeat('some words ', int(id % 9))").alias("text"))
    rows = fim.transformed(docs, how).withColumn("back", fim.restored(F.col("output"), F.col("form"), how)).join(docs, "doc_id").collect()
    assert len(rows) == 300 and all(r["back"] == r["text"] and r["n"] == 2 * (r["doc_id"] % 9) for r in rows)
    cut = sum(r["form"] == "psm" for r in rows)
    assert {r["form"] for r in rows} == {"plain", "psm"} and 60 < cut < 160
    with pytest.raises(ValueError):
        fim.Fim(prefix="<P>", suffix="<S<", middle="<M>")
    with pytest.raises(ValueError):
        fim.Fim(prefix="<P>", suffix="<P>x", middle="<M>")


def test_stretches():
    import regex

    pattern = regex.compile(f"({fim.LINE})*")
    for text in ["", "\n", "abc\n" * 50 + "d" * 100 + "\nx", "\n" * 101, "a" * 99, *TRICKY[:7]]:
        want = [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
        assert all(fim.unit_ends(text, pattern, size) == want for size in (1, 2, 7, 50, 10**6))
    assert len(fim.unit_ends("\n" * 6_000_000, pattern)) == 6_000_000


def test_empty(spark):
    assert fim.digested(edge.empty(spark)).collect() == []
