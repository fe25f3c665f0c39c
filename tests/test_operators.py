"""Operators on small frames: queries and pages, codecs, state, rules, expressions, text, sources, streams."""

import hashlib
import io
import json
import random
import re
import zipfile
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattica.functions import codecs, hashing, logic, match
from lattica.operators import citations, relation, state, text
from lattica.plans import expression, graph, rules
from lattica.sources import blocks, landing
from lattica.streaming import incremental


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


R = relation.Relation("r", ("id", "name", "n"), ("id",))


def rows(spark):
    return spark.createDataFrame([(1, "a%b", 5), (2, "A_B", None), (3, "axb", 1), (4, None, 9)], "id int, name string, n int")


def test_query_rules(spark):
    df = rows(spark)
    ids = lambda q: [r["id"] for r in relation.run(df, R, q).collect()]
    assert ids(relation.Query(search=relation.Search(["name"], "a%b"))) == [1]
    assert ids(relation.Query(search=relation.Search(["name"], "a_b"))) == [2]
    assert ids(relation.Query(search=relation.Search(["name"], ""))) == [1, 2, 3, 4]
    assert ids(relation.Query(order_by=[relation.Sort("n")])) == [3, 1, 4, 2]
    assert ids(relation.Query(order_by=[relation.Sort("n", "desc")])) == [2, 4, 1, 3]
    assert ids(relation.Query(order_by=[relation.Sort("n", "desc", "last")], page=relation.Page(2, 2))) == [3, 2]
    for bad in (relation.Query([relation.Filter("x", "eq", 1)]), relation.Query([relation.Filter("n", "gt", 1)]), relation.Query(order_by=[relation.Sort("x")]), relation.Query(page=relation.Page(0, 1))):
        with pytest.raises(relation.QueryError):
            relation.run(df, R, bad)
    assert relation.pages_of(21, 20) == 2 and relation.pages_of(0, 20) == 0


@pytest.mark.parametrize(("value", "day"), [("20240229", date(2024, 2, 29)), ("2024-02-29", date(2024, 2, 29)), ("2024/02/29", date(2024, 2, 29)), ("24/02/29", date(2024, 2, 29)), ("  ", None)])
def test_dates(spark, value, day):
    assert one(spark, codecs.parse_date(F.lit(value))) == day


def test_codecs(spark):
    for bad in (codecs.parse_date(F.lit("29.2.2024")), codecs.yes_no(F.lit("maybe")), codecs.to_number(F.lit("x")), codecs.bracket_list(F.lit("[a^b^c]"), 2)):
        with pytest.raises(PySparkException):
            one(spark, bad)
    assert float(one(spark, codecs.to_number(F.lit("1,234.5%")))) == 1234.5 and one(spark, codecs.to_integer(F.lit("1,000"))) == 1000
    assert one(spark, codecs.bracket_list(F.lit("[a^[b]],[c^d]"), 2)) == [["a", "[b]"], ["c", "d"]]
    assert one(spark, codecs.names(F.lit("x, y,x,"))) == ["x", "y"] and one(spark, codecs.address(F.lit(" a "), F.lit(None), F.lit(""))) == "a"
    assert one(spark, codecs.name_code(F.lit("n/c"))).asDict() == {"name": "n", "code": "c"} and one(spark, codecs.name_code(F.lit("n"))) is None
    assert one(spark, codecs.permitted(F.lit("[x],[y]"))) == ["x", "y"] and one(spark, codecs.permitted(F.lit("x, y"))) == ["x", "y"]
    assert one(spark, codecs.period_end(F.lit("2024-01-01 ~ 2024-02-01"))) == date(2024, 2, 1)
    assert one(spark, codecs.parse_datetime(F.lit("202401021530"))) == datetime(2024, 1, 2, 15, 30)
    assert one(spark, hashing.uuid5(F.lit("http://python.org/"))) == "4c565f0d-3f5a-5890-b41b-20cf47701c5e"


def test_matches(spark):
    yes = [match.contains_either(F.lit("A-b (c)"), F.lit("abc")), match.contains_either(F.lit("ab"), F.lit("x a b")), match.valid_on(F.lit(None).cast("date"), F.lit(None).cast("date"), F.current_date()),
           match.period_contains(F.lit("2024-01-01~2024-01-31"), F.lit("2024-01-31").cast("date")), match.ordered_fragments(F.lit("one two three"), F.lit("one ... three"))]
    no = [match.contains_either(F.lit(""), F.lit("a")), match.contains_either(F.lit(None), F.lit("a")), match.active_status(F.lit("유효 기간 경과")), match.ordered_fragments(F.lit("one two three"), F.lit("three...one"))]
    assert all(one(spark, c) for c in yes) and not any(one(spark, c) for c in no)


def test_upsert_marks_changes(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, None, "t0"), (3, "c", "t0")], "k int, v string, updated_at string")
    new = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t1"), (4, None, "t1")], "k int, v string, updated_at string")
    got = {r["k"]: (r["v"], r["updated_at"], r["change"]) for r in state.upsert(old, new, ["k"], now=F.lit("t1")).collect()}
    assert got == {1: ("a", "t0", "same"), 2: ("b", "t1", "updated"), 3: ("c", "t0", "kept"), 4: (None, "t1", "inserted")}
    with pytest.raises(ValueError):
        state.same_columns(old, new.drop("v"))


def test_snapshot_needs_two_misses(spark):
    s = spark.createDataFrame([(1, "a", 0, True), (2, "b", 1, True)], "k int, v string, missing_count int, is_active boolean")
    got = {r["k"]: (r["missing_count"], r["is_active"]) for r in state.snapshot(s, spark.createDataFrame([(3, "c")], "k int, v string"), "k").collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (0, True)}


def test_windows(spark):
    assert [tuple(r) for r in state.windows("2024-01-01", "2024-01-05", 2, spark).collect()] == [(date(2024, 1, 1), date(2024, 1, 2)), (date(2024, 1, 3), date(2024, 1, 4)), (date(2024, 1, 5), date(2024, 1, 5))]
    d = date(2024, 1, 10)
    assert incremental.collection_window(d, 2, date(2024, 1, 12)) == (date(2024, 1, 8), date(2024, 1, 12))
    with pytest.raises(ValueError):
        incremental.collection_window(None, 2, d)
    assert incremental.backfill_window(d, d, 30, date(2024, 1, 12)) == (date(2024, 1, 11), date(2024, 1, 11))
    assert incremental.backfill_window(d, d, 30, date(2024, 1, 11)) is None


def test_three_valued_logic(spark):
    cases = [([2, 2], 2, 2), ([2, 1], 1, 2), ([1, 0], 0, 1), ([0, 2], 0, 2), ([None], 1, 1), ([], 1, 1)]
    for values, every, some in cases:
        df = spark.createDataFrame([(v,) for v in values], "o int")
        assert tuple(df.agg(logic.all_of(F.col("o")), logic.any_of(F.col("o"))).first()) == (every, some)


def test_expressions(spark):
    rows = [("a", "r1", "single", None, None), ("b", "r1", "single", None, None), ("b", "r2", "consortium", None, None), ("c", "r1", "common", None, None),
            ("c", "r2", "common", "g", "x"), ("c", "r3", "common", "g", "y"), ("c", "r4", "common", "g", "y")]
    df = spark.createDataFrame(rows, "case_id string, requirement_id string, scope string, alternative_group string, alternative_branch string")
    assert {r[0]: r[1] for r in expression.compiled(df).collect()} == {"a": "r1", "b": "any(r1,r2)", "c": "all(r1,any(r2,all(r3,r4)))"}
    nodes = spark.createDataFrame([("t", "0", None, 0, "not", None), ("t", "1", "0", 1, "all", None), ("t", "2", "1", 2, "leaf", "a"), ("t", "3", "1", 2, "leaf", "b"), ("u", "0", None, 0, "any", None)], "tree_id string, node_id string, parent_id string, depth int, op string, leaf_id string")
    outcomes = spark.createDataFrame([("t", "a", 0)], "tree_id string, leaf_id string, outcome int")
    assert {r[0]: r[1] for r in expression.folded(nodes, outcomes, 2).collect()} == {"t": 2, "u": 1}
    assert {tuple(r) for r in expression.faults(nodes).collect()} == {("u", "empty")}


def test_rules(spark):
    day = F.lit("2024-06-01").cast("date")
    facts = spark.createDataFrame(
        [(1, "industry", "10", "Road works", None, None, date(2024, 1, 1), None), (2, "industry", "10", "Road works", "등록 말소", None, None, None), (3, "sanction", None, None, "취소", None, date(2024, 1, 1), date(2024, 12, 1)),
         (4, "qualification", None, None, None, "disabled_owned_business", None, date(2024, 1, 1)), (4, "venture_disclosure", None, None, None, None, None, None)],
        "company_id long, fact_type string, code string, name string, status string, kind string, valid_from date, valid_until date")
    kind = lambda k: f'{{"qualification_type": "{k}"}}'
    need = [(1, 9, "r1", "industry_registration_matches", '{"expected_value": "100"}', None, None, None, True), (2, 9, "r2", "industry_registration_matches", '{"expected_value": ["road"]}', None, None, None, True),
            (3, 9, "r3", "no_active_sanction", None, None, "not_exists", None, True), (4, 9, "r4", "qualification_valid", kind("disabled_owned_business"), None, None, None, True),
            (4, 9, "r8", "qualification_valid", kind("women_owned_business"), None, None, None, False), (4, 9, "r9", "qualification_valid", kind("venture_business"), None, None, None, False),
            (1, 9, "r5", "consortium_participation_allowed", None, '{"boolean": false}', None, "consortium", True), (1, 9, "r10", "consortium_participation_allowed", None, None, None, None, False),
            (1, 9, "r6", None, None, None, None, None, False), (1, 8, "r7", "unknown", None, None, None, None, True)]
    df = spark.createDataFrame(need, "company_id long, notice_id long, requirement_id string, rule string, arguments string, value string, operator string, mode string, mandatory boolean")
    got = {r["requirement_id"]: r["reason"] for r in rules.assess(df, facts, day).collect()}
    assert got == {"r1": "industry_code_matched", "r2": "industry_registration_inactive", "r3": "active_sanction_found", "r4": "qualification_expired", "r5": "consortium_participation_prohibited", "r6": "unsupported_standard_rule",
                   "r7": "unsupported_rule_evaluator", "r8": "qualification_missing", "r9": "qualification_valid", "r10": "single_participation_selected"}
    missing = spark.createDataFrame([(1, "industry")], "company_id long, fact_type string")
    again = {r["requirement_id"]: r["reason"] for r in rules.assess(df, facts, day, missing).collect()}
    assert again["r1"] == "source_unavailable" and again["r5"] == got["r5"]
    coverage = spark.createDataFrame([(9, True), (8, True)], "notice_id long, complete boolean")
    total = {(r["company_id"], r["notice_id"]): r["outcome"] for r in rules.overall(rules.assess(df, facts, day), coverage).collect()}
    assert total == {(1, 9): 0, (1, 8): 1, (2, 9): 0, (3, 9): 0, (4, 9): 0}


def test_cover_spreads_to_the_end_of_a_chain(spark):
    rows = [("g", i, f"a{i // 2}", f"b{(i + 1) // 2}", i > 0) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, id int, x string, y string, bad boolean")
    assert state.covered(df, "g", F.col("bad"), ["x", "y"], "id").count() == 59
    with pytest.raises(RuntimeError):
        state.covered(df, "g", F.col("bad"), ["x", "y"], "id", rounds=3)


def test_generated_properties_echo_and_provenance(spark):
    role = graph.Role("c", "company", ["no"], [graph.Binding("no", ["no"], echo="asked")], id_property="key", timestamps=["seen_at"], ontology="other")
    m = graph.Mapping("m", "op", ["id"], [role], [graph.Link("same", "c", "c")], ontology="o")
    df = spark.createDataFrame([(1, "7", "8"), (2, None, "7"), (3, None, None)], "id int, no string, asked string")
    found = graph.fragments(df, m, F.col("id"), "2024-01-01")
    (one,) = graph.objects(found).collect()
    import hashlib

    want = hashlib.sha256(b'other:company:{"no":"7","parents":[]}').hexdigest()
    assert one["object_id"] == want and one["properties"] == {"no": "7", "key": want, "seen_at": "2024-01-01"} and one["record_keys"] == ["op:1", "op:2"]
    kinds = {r["name"]: (r["kind"], r["record_key"]) for r in graph.property_provenance(found, m).collect()}
    assert kinds == {"no": ("source", "op:2"), "key": ("execution", None), "seen_at": ("execution", None)}
    assert sorted(r["record_key"] for r in graph.link_provenance(df, m).collect()) == ["op:1", "op:2"]


def test_graph_merge(spark):
    m = graph.Mapping("m", "op", ["id"], [graph.Role("c", "company", ["no"], [graph.Binding("no", ["no"]), graph.Binding("name", ["name"])])])
    df = spark.createDataFrame([(1, "7", "old", "9"), (2, "7", "", "95"), (3, "", "none", "3"), (4, "7", "new", "10")], "id int, no string, name string, o string")
    got = graph.objects(graph.fragments(df, m, F.col("o"))).collect()
    assert len(got) == 1 and got[0]["properties"] == {"no": "7", "name": "old"}  # orders compare as text: "10" comes before "9"
    with pytest.raises(ValueError):
        graph.identified(df, graph.Mapping("m", "op", ["id"], [graph.Role("x", "t", ["no"], [], ["y"])]))


def test_text_operators(spark):
    b = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate([("a" * 60, 3), ("b" * 50, 2), ("c" * 30, 1)])], "d long, block_index int, text string, score int")
    assert {r["block_index"] for r in text.within_budget(b, "d", 100).collect()} == {0, 2}
    assert text.compact("Ａb-1 c") == "ab1c"


def test_nearest_looks_at_all_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((90, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, [0.0] * 6), (101, None), (102, [1.0, 2.0])]
    e = spark.createDataFrame(rows, "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, i) for q in range(0, 90, 20) for i in sorted(range(90), key=lambda i: (-round(float(u[q] @ u[i]), 6), i))[:10]}
    assert {(r["query_id"], r["id"]) for r in text.nearest(e.where("id % 20 = 0 and id < 90"), e, "id", "v", 10, block=16).collect()} == want


def test_cited_tiers(spark):
    lines = ["the lazy dog sleeps all the day near the old mill", "zebra quilt vortex jumble", "before the lazy dog sleeps all the day near the old mill", "alpha beta gamma delta epsilon zeta eta theta"]
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "d long, block_index int, text string")
    quotes = [
        (1, 1, "lazy dog sleeps", 2), (1, 2, "lazy dog sleeps", 1), (1, 3, "the lazy dog sleeps ... near the old mill", 2),
        (1, 4, "alpha beta gamma delta omega psi chi", 3), (1, 5, "near the old mill ... the lazy dog sleeps, qq ww ee rr tt yy uu", 1), (1, 6, "the lazy dog sleeps ... near the old mill", None),
    ]
    found = citations.cited(spark.createDataFrame(quotes, "d long, citation_id long, quote string, pointed int"), blocks, "d").collect()
    assert {tuple(r)[:3] for r in found if r["tier"]} == {(1, 2, "pointed"), (2, 0, "exact"), (3, 2, "ellipsis"), (4, 3, "near_pointed")} and len(found) == 6


def by_hand(rows, wanted):
    """Near copies one by one over all pairs; rows of (key, group, text)."""
    need = lambda t: {"".join(c for c in line if c.isascii() and c.isalnum()).lower() for line in t.split("\n") if re.search(wanted, line)}
    kept, out = [], []
    for k, g, t in sorted((r for r in rows if r[2] and r[2].strip()), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[2].encode()).hexdigest())):
        for k2, g2, t2 in kept:
            if g == g2 and need(t) == need(t2) and min(len(t), len(t2)) >= 0.75 * max(len(t), len(t2)) and (t == t2 or text.text_ratio(t2, t) >= 0.88):
                out.append((g, k2, k))
                break
        else:
            kept.append((k, g, t))
    return out


def test_near_copies_equal_all_pairs(spark, small):
    rng = random.Random(5)
    words = lambda n: [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(400)}x" for _ in range(n)]
    licence, rows = words(60), []
    for i in range(12):  # different texts with one licence, and near copies of each that lack the first's words
        own = words(40)
        rows += [(100 + i, "en", " ".join(own + licence)), (200 + i, None if i % 2 else "en", " ".join([*own[:20], "new", *own[21:], *licence]))]
    rows += [(300 + i, None, " ".join(licence + own)) for i in range(3) for own in [words(40)] for _ in range(2)]
    base = words(100)
    for i in range(5):  # a chain: each is like the next only
        base = [*base[: i * 9], *words(9), *base[i * 9 + 9 :]]
        rows.append((400 + i, "de", " ".join(base)))
    rows += [(None, "de", " ".join(base)), (None, "de", " ".join(words(50))), (500, "de", ""), (501, "de", None), (502, "de", " ".join(base) + "\nno 7"), (503, "de", " ".join(base) + "\nno 8")]
    rows += [(r["doc_id"], r["lang"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
    want = sorted(by_hand(rows, "no [0-9]"), key=key)
    assert len(want) > 20
    got = text.near_copies(docs, "lang", "doc_id", "text", "no [0-9]").collect()
    assert sorted(((r["lang"], r["keep"], r["copy"]) for r in got), key=key) == want
    # By leaders, and in blocks of two.
    text_rows = docs.where("doc_id is null or doc_id >= 100")
    few = [r for r in rows if r[0] is None or r[0] >= 100]
    got = text.near_copies(text_rows, "lang", "doc_id", "text", "no [0-9]", block=2, pairs_each=0).collect()
    assert sorted(((r["lang"], r["keep"], r["copy"]) for r in got), key=key) == sorted(by_hand(few, "no [0-9]"), key=key)


def test_sources(spark):
    pages = spark.createDataFrame([(1, '{"body":{"items":{"item":{"a":1}},"totalCount":1}}'), (2, '{"body":{"totalCount":0}}')], "page long, body string")
    assert [(r["page"], r["payload"]) for r in landing.records(pages, "body", "body.items.item[]", "body.totalCount").collect()] == [(1, '{"a":1}')]
    with pytest.raises(PySparkException):
        landing.records(spark.createDataFrame([(3, '{"body":{"totalCount":2}}')], "page long, body string"), "body", "body.items.item[]", "body.totalCount").collect()
    xml = one(spark, landing.decoded_xml(F.lit("<r xmlns:n='u'><n:item><a> 1 </a></n:item></r>"), "item array<struct<a:string>>"))
    assert xml["item"][0]["a"] == "1"
    bodies = [(1, "<r xmlns:n='u'><n:item> x </n:item><item/><a>1</a><b><c>2</c><!-- no --></b></r>"), (2, "<one> t </one>"), (3, "<open>"), (4, None), (5, "<r><item>only</item></r>")]
    as_json = {r["k"]: r["json"] for r in landing.xml_json(spark.createDataFrame(bodies, "k int, x string"), "x").collect()}
    assert {k: v and json.loads(v) for k, v in as_json.items()} == {1: {"item": ["x", ""], "a": "1", "b": {"c": "2"}}, 2: "t", 3: None, 4: None, 5: {"item": "only"}}
    landed = spark.createDataFrame([(o, p, '{"total": %d, "o": %d}' % (t, p)) for o, ps, t in (("a", (1, 2, 3, 4), 5), ("b", (1, 3), 9), ("c", (1, 2), 0), ("d", (2,), 9), ("e", (1, 2), 2)) for p in ps], "o string, page int, body string")
    read = lambda most: sorted((r["o"], r["page"]) for r in landing.read_pages(landed, 2, most, "body", "total", ["o"]).collect())
    assert read(3) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1), ("e", 1)]
    with pytest.raises(PySparkException):
        read(2)
    mixed = spark.createDataFrame([(1, "<table class='y'><tr><th>name</th><td>v<td>w</tr><tr><th>only</th></tr><tr><td>a<table class='y'><tr><td>in</td></tr></table>b</td></tr></table><table><tr><td>other</td></tr></table>")], "k long, h string")
    assert [r["cells"] for r in landing.html_rows(mixed, "k", "h", "y").collect()] == [["v", "w"], ["ainb"]]
    html = spark.createDataFrame([(1, "<table class='x'><tr><td>no</td></tr></table><table class='y z'><tr><th>h</th></tr><tr><td>a<br>b</td><td><table><tr><td>in</td></tr></table> c </td></tr></table>")], "k long, h string")
    assert [r["cells"] for r in landing.html_rows(html, "k", "h", "y").collect()] == [["a b", "in c"]]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "p1\n\np2\fp3")
        z.writestr("../evil.txt", "x")
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("a.txt", "p1\n\np2\fp3")
    files = spark.createDataFrame([("e.zip", bytearray(buffer.getvalue())), ("g.zip", bytearray(good.getvalue())), ("x.doc", bytearray(b"?"))], "path string, content binary")
    got = {}
    for r in blocks.parsed_files(files).collect():
        got.setdefault(r["path"], []).append((r["text"], bool(r["error"])))
    assert got == {"e.zip": [(None, True)], "g.zip": [("p1", False), ("p2", False), ("p3", False)], "x.doc": [(None, True)]}
    assert one(spark, blocks.kind_of(F.lit(b"PK\x03\x04"), F.lit("a.XLSX"))) == "xlsx"


def test_stream_upserts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, o int").write.parquet(source)
    read = lambda: spark.readStream.schema("k int, v string, o int").parquet(source)
    incremental.upsert_stream(read(), target, str(tmp_path / "cp"), ["k"], "o").awaitTermination(120)
    spark.createDataFrame([(2, "d", 3), (3, "e", 1)], "k int, v string, o int").write.mode("append").parquet(source)
    incremental.upsert_stream(read(), target, str(tmp_path / "cp"), ["k"], "o").awaitTermination(120)
    last = max(int(p.name[2:]) for p in (tmp_path / "out").iterdir() if p.name.startswith("v="))
    assert {r["k"]: (r["v"], r["updated_batch"]) for r in incremental.version(spark, target, last).collect()} == {1: ("b", 0), 2: ("d", last), 3: ("e", last)}
