"""The SQL of the mix on edge rows, how near the targets the mix comes, and what its probabilities do."""

import duckdb
from pyspark.sql import functions as F

from lattica.llm import mixing

from . import edge


def test_equals_sql(spark, small, tmp_path):
    docs = edge.documents(spark, small)
    docs.select("doc_id", "text", "source").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    key = lambda r: (r[0] is None, *[x or 0 for x in r])
    want = sorted(con.execute("select doc_id, size, source_size, target, taken from (" + mixing.ORACLE + ")").fetchall(), key=key)
    got = sorted((tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=key)
    assert [(*w[:3], w[4]) for w in want] == [(*g[:3], g[4]) for g in got]
    assert all(abs(w[3] - g[3]) <= 1e-9 * max(1, w[3]) for w, g in zip(want, got, strict=True))


def test_targets_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(3)).collect())
    by = {}
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(sources[r["doc_id"]], []).append(r)
    assert abs(sum(v[0]["target"] for v in by.values()) - sum(r["size"] for r in rows)) < 1e-3
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1
    copies = mixing.mixed(docs).groupBy("doc_id").count().collect()
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in rows if r["size"] and r["taken"]}
    assert {r["doc_id"]: r["count"] for r in copies} == taken


def test_limits_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 10), ("d", 88), (None, 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # weights 1, 2, 3, 1, 2: b stops at 3, c at 30; a gets the most it may, d the rest
    assert got["a"] == 3 and got["b"] == 3 and got["c"] == 30 and abs(got["d"] - 64) < 1e-9 and got[None] == 0
    assert mixing.mix(edge.empty(spark)).count() == 0
    only_null = mixing.mix(spark.createDataFrame([(1, None, None), (2, "two words", None)], "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: r["taken"] for r in only_null} == {1: 0, 2: 2}


def _two_sources(spark, n):
    """Source a of n documents of 4 to 400 words has to give 1/3 of all words, b the other two thirds."""
    docs = spark.range(2 * n).selectExpr("cast(id as string) as key", "if(id % 2 = 0, 'a', 'b') as source", "if(id % 4 < 2, 4L, 400L) as size")
    return docs.withColumn("weight", mixing.inclusion_weight(F.col("size"))).checkpoint()


def test_longer_documents_are_likelier(spark):
    sized = _two_sources(spark, 4000)
    plan = mixing.cuts(sized)
    placed = mixing._placed(sized, plan, "mix").where("source = 'a' and open").select("odds", "key").collect()
    digest = lambda key: __import__("hashlib").md5(f"mix:{key}".encode()).hexdigest()[:13]
    by_odds = [r["key"] for r in sorted(placed, key=lambda r: r["odds"])]
    assert by_odds != sorted(by_odds, key=digest)  # not the plain random order
    got = mixing.copies_of(sized, plan).where("source = 'a'").groupBy("size").agg(F.avg("copies").alias("c")).collect()
    rate = {r["size"]: r["c"] for r in got}
    # 2/3 of the words of a: with probability factor * weight, weights 2 and 20; of the small ones a tenth of that of the large ones
    factor = 2 / 3 * 404 / (4 * 2 + 400 * 20)
    assert abs(rate[400] - 20 * factor) < 0.05 and abs(rate[4] - 2 * factor) < 0.03


def test_words_that_are_certain_and_equal_rows_at_the_cut(spark):
    docs = [("x", "a", 100)] * 9 + [("y", "a", 10_000)] + [("z", "b", 10_000)] * 3
    sized = spark.createDataFrame(docs, "key string, source string, size long").withColumn("weight", mixing.inclusion_weight(F.col("size"))).checkpoint()
    plan = {r["source"]: r for r in mixing.cuts(sized).collect()}
    rows = mixing.copies_of(sized, mixing.cuts(sized)).collect()
    taken = sum(r["copies"] * r["size"] for r in rows if r["source"] == "a")
    # a has 10,900 words and a target of 40,900 / 3, so 2,733 remain beyond one copy each
    assert plan["a"]["whole"] == 1 and abs(plan["a"]["target"] - 40_900 / 3) < 1e-6 and taken >= 10_900
    equal = sorted(r["copies"] for r in rows if r["key"] == "z")
    assert len(equal) == 3 and abs(sum(equal) * 10_000 - 2 * 40_900 / 3) <= 5_000


def test_little_of_a_source_is_sorted(spark):
    sized = _two_sources(spark, 4000)
    plan = mixing.cuts(sized)
    sorted_at_once = mixing._placed(sized, plan, "mix").where("open and part = stop_part").groupBy("rank").count().collect()
    assert {r["count"] for r in sorted_at_once} and max(r["count"] for r in sorted_at_once) < 200
    assert sorted(mixing.copies_of(sized, plan).select("key", "copies").collect()) == sorted(mixing.copies_of(sized, mixing.cuts(sized)).select("key", "copies").collect())
    one = spark.range(500).selectExpr("cast(id as string) as key", "'s' as source", "2L as size", "1L as weight")
    assert {r["copies"] for r in mixing.copies_of(one, mixing.cuts(one)).collect()} == {1}
