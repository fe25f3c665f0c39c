"""What grew faster than the tables: small inputs that show it, and the plans that say how often work is done."""

import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from lattica.operators import citations, state, text
from lattica.plans import assessment
from lattica.queries import ORACLE, QUERIES, landed
from lattica.sources import blocks


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_are_parsed_once(spark, small):
    for name, records in (("region_rows", 1), ("region_conflicts", 2), ("notice_slots", 1)):
        assert plan(QUERIES[name](spark, small)).count("from_json") == records, name


def test_clauses_of_odd_texts(spark):
    slow = re.compile(r"[^\n]+?(?:[.!?](?=\s|$)|(?=\s+(?:\d+|[가-힣])[.)]\s)|$)")
    odd = ["", "\n", "a\n", "a. b", ".", "..", " . ", "x\n\n 1. y", "a  가) b 2) ", "a 1.", "no end\nend.", "no end\nlast\n", "\t12)\n", " 1. 2. 3. ", "a! b?\r\nc", "x 1. \n2) y\n"]
    for text in odd:
        assert blocks.clauses_of(text) == [m.span() for m in slow.finditer(text)], text
    # A line of 400,000 characters without an end, one of white space, and one of digits.
    long = spark.createDataFrame([(1, "word " * 80_000 + "\nx"), (2, "x" + " " * 400_000 + "y\n"), (3, "x " + "1" * 400_000 + "\ny")], "k long, text string")
    begun = time.time()
    assert sorted((r["k"], r["clause"][-1]) for r in blocks.clauses(long, "k").collect()) == [(1, "x"), (2, "y"), (3, "y")]
    assert time.time() - begun < 30


def test_more_than_a_thousand_pages(spark, tmp_path):
    days = F.lit("1996-02-01").cast("timestamp")
    spark.range(4100).select(F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), days.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, QUERIES["extracted_pages"](spark, str(tmp_path)).select("page", "place", "source_record_hash").collect()))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(con.execute("select page, place, source_record_hash from (" + ORACLE["extracted_pages"] + ")").fetchall())
    assert got == want and len(got) == 4100


def test_assessments_move_no_hashes(spark, small):
    day = "1996-01-01"
    row = "company_id long, notice_id string, requirement_id string, requirement_object string, mandatory boolean, rule string, value_text string, outcome int, reason string, actual string, evidence array<string>"
    rows = [(c, "n", i, o, True, "q", "v", k, "r", "a", e) for c in (1, 2) for i, o, k, e in (("a", "x", 2, ["s1", "p"]), ("b", "x", 1, ["s1", None]), ("c", "y", 0, None))]
    kinds = spark.createDataFrame([("s1", "qualification")], "object_id string, object_type string")
    objects, links = assessment.materialized(spark.createDataFrame(rows, row), spark.createDataFrame([("n", True)], "notice_id string, complete boolean"), day, fact_types=kinds)
    ids, ties = [r["object_id"] for r in objects.collect()], list(map(tuple, links.collect()))
    assert len(ids) == len(set(ids)) == 2 + 4 + 4 and len(ties) == len(set(ties)) == 4 + 4 * 3 + 8 + 1
    assert {s for _, s, _ in ties} <= set(ids) | {"1", "2"}
    physical = QUERIES["assessment_graph"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*(object_id|source_id|evidence_id|decision_id)", physical)


def shuffles(df):
    """The keys of each shuffle of a plan before it runs, broadcasts off."""
    session = df.sparkSession
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        session.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*), \d+\)", text)]


def test_objects_travel_once(spark, small):
    assert shuffles(QUERIES["graph_objects"](spark, small)) == ["object_type, object_id"]


def test_trees_stay_with_their_order(spark, small, monkeypatch):
    """Lines travel once, to more tasks as there are more of them, and no tree is moved."""
    monkeypatch.setattr(landed, "_LINES_OF_A_TASK", 100)
    tree = QUERIES["extraction_tree"](spark, small)
    assert set(shuffles(tree)) <= {"l_orderkey", "o_orderkey", "notice_id"}
    physical = tree._jdf.queryExecution().executedPlan().toString()
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert set(re.findall(r"hashpartitioning\(l_orderkey#\d+L, (\d+)\)", physical)) == {str(-(-lines // 100))}
    # Trees that come twice count once, and what is done is told by both values, nulls never.
    needs = [("1", "t", [], [("p", "d", [])])]
    kind = "notice_id long, fingerprint string, expression string, unresolved array<string>, requirements array<struct<id string, text string, evidence array<struct<source_id string, excerpt string>>, proofs array<struct<id string, document_type string, evidence array<struct<source_id string, excerpt string>>>>>>"
    trees = [(n, f, "e", [], needs) for n, f in [(1, "a"), (1, "a"), (1, "b"), (1, "c"), (2, None), (None, "a"), (3, "x\0"), (4, "a")]]
    done = spark.createDataFrame([(1, "b"), (1, "b"), (1, None), (2, None), (2, "q"), (None, "a"), (3, "x ")], "notice_id long, fingerprint string")
    t = state.extraction_tables(spark.createDataFrame(trees, kind), done)
    got = {(r["notice_id"], r["fingerprint"]) for r in t["extractions"].collect()}
    assert got == {(1, "a"), (1, "c"), (2, None), (None, "a"), (4, "a")}
    pairs = {"extractions": [None], "requirements": ["extraction_id"], "proofs": ["requirement_id"]}
    want = sorted((k, r[f"{k[:-1]}_id"], r[of] if of else "") for k, (of,) in pairs.items() for r in t[k].collect())
    nodes = state.extraction_nodes(spark.createDataFrame(trees, kind), done)
    assert sorted((r["relation"], r["id"], r["parent"] or "") for r in nodes.collect()) == want and len(want) == 15
    # One sort of lines: requirements and proofs come from the same trees.
    assert physical.count("collect_list") == physical.count("partial_collect_list") * 2 == 2


def test_placements_come_together_by_case(spark, small):
    keys = shuffles(QUERIES["simplified_placements"](spark, small))
    assert "case_id" in keys and not any("scope, g, alternative_branch" in k or "requirement_id, scope" in k for k in keys)


def test_texts_are_not_shuffled_by_block(spark, small):
    for name in ("selected_blocks", "selection_summary", "budget_selection"):
        assert {k for k in shuffles(QUERIES[name](spark, small))} == {"doc_id"}, name


def test_bounds_of_near_copies(spark, monkeypatch):
    """Pairs that sizes, words and ends rule out are not compared, and none that is alike is ruled out."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(300)]
    texts = []
    for n in (1, 3, 8, 40, 300, 3000):
        base = rng.choices(words, k=n)
        for share in (0.0, 0.0, 0.02, 0.05, 0.1, 0.2):
            texts.append(" ".join("".join(rng.sample(w, len(w))) if rng.random() < share else w for w in base) + rng.choice(["", " end", "x"]))
        texts.append(" ".join([*base[: n // 2], *rng.choices(words, k=n // 20), *base[n // 2 :]]))
    docs = spark.createDataFrame([("h", i, t) for i, t in enumerate(texts)], "home string, k long, text string").select("home", F.struct("k").alias("rank"), "text")
    marked = text._sketched(docs, 16)
    placed = marked.selectExpr("'h' as home", "id", "0 as band", "0L as mark", "0 as class")
    roles = marked.selectExpr("id", "true as heads", "true as tails", "cast(null as long) as least")
    key = {r["id"]: r["rank"]["k"] for r in marked.select("id", "rank").collect()}
    got = {(key[r["a"]], key[r["b"]]) for r in text._candidates(placed, roles, marked, 0.75, 0.88, 16).collect()}
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if min(len(texts[i]), len(texts[j])) >= 0.75 * max(len(texts[i]), len(texts[j])) and text.shared_ratio(texts[i], texts[j]) >= 0.88}
    assert alike <= got and 20 < len(alike) and len(got) < len(texts) * (len(texts) - 1) / 8, (len(alike), len(got))
    assert all(text.shared_ratio(texts[i], texts[j], 0.88) == text.shared_ratio(texts[i], texts[j]) for i, j in alike)
    # Words apart by others share no white space: such a pair is settled by its words alone.
    a, b = ["one"] * 400, ["one"] * 400
    b[::3] = ["two"] * len(b[::3])
    monkeypatch.setattr(text.difflib, "SequenceMatcher", None)
    assert text.shared_ratio(" ".join(a), " ".join(b), 0.88) < 0.88


def test_citations_settled_by_words(spark, small):
    """Most citations of altered blocks need no similarity at all, where before each needed one or more; with scores, one for each similar one at least."""
    rows = QUERIES["cited_blocks"](spark, small).collect()
    alike = [r["compared"] for r in rows if r["tier"] in ("near_pointed", "similar")]
    assert len(alike) > 200 and sum(n == 0 for n in alike) > len(alike) / 2
    own = ["alpha beta gamma delta epsilon zeta", "quick brown foxes jump over lazy dogs", "13 57 91 24 68 80"]
    blocks = [(1, i, text) for i, text in enumerate(own)]
    given = spark.createDataFrame([(1, 7, "kciuq brown foxes jump over lazy dogs")], "d int, citation_id int, quote string")
    have = spark.createDataFrame(blocks, "d int, block_index int, text string")
    with_score, without = (citations.cited(given, have, "d", scored=s).first() for s in (True, False))
    assert with_score["score"] == citations.similarity(citations.Form.of(given.first()["quote"]), citations.Form.of(own[1])) and with_score["compared"] >= 1
    assert (without["block_index"], without["tier"], without["score"], without["compared"]) == (1, "similar", None, 0)


def test_matches_and_leads_of_citations(monkeypatch):
    """Matching blocks without difflib's steps for each pair of characters, and leads as all similarities tell them, with fewer of these worked out."""
    rng = random.Random(5)
    compared = possible = led = 0
    for _ in range(500):
        letters = rng.choice(["abc", "abcdefgh"])
        texts = [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 5))) for _ in range(rng.choice([0, 1, 4, 8, 30]))) + rng.choice(["", ".", "!!"]) for _ in range(rng.randrange(1, 14))]
        a = citations.Form.of(" ".join(w[::-1] if rng.random() < 0.3 else w for w in rng.choice(texts).split()))
        forms = list(map(citations.Form.of, texts))
        for f in forms:
            blocks_of = text.difflib.SequenceMatcher(None, a.text, f.text, autojunk=False).get_matching_blocks()
            assert citations.matched(a.text, f.text) == sum(m.size for m in blocks_of)
        true = sorted(((citations.similarity(a, f), -i) for i, f in enumerate(forms)), reverse=True) + [(0.0, 0)]
        want = true[0][0] >= 0.65 and true[0][0] - true[1][0] >= 0.08
        for alone in (True, False):
            own = citations.Slice(list(enumerate(texts)))
            best, at, second = own.best(a, 0.65, 0.08, alone)
            assert (best >= 0.65 and best - second >= 0.08) == want and (not want or (best, at) == (true[0][0], -true[0][1]))
            compared, possible, led = compared + own.compared, possible + len(texts), led + want
    assert led > 40 and compared < possible / 2, (led, compared, possible)
    # Two texts of 20,000 letters, no two words alike, were 10 million steps of difflib for a run alone.
    long = ["".join(rng.choices("abcdefghijkl", k=20_000)) for _ in range(2)]
    begun = time.time()
    assert 0 < citations.matched(*long, least=19_000) < 19_000
    assert time.time() - begun < 5


def test_assessments_stay_with_their_notice(spark, small):
    """Lines and orders travel once, as numbers; what the graph is made of does not, but for facts that meet their types."""
    graph = QUERIES["assessment_graph"](spark, small)
    assert set(shuffles(graph)) <= {"l_orderkey", "o_orderkey", "fact", "fact, qualification"}
    # Within notices or not, the same objects and links, each once: companies share evidence, requirements and coverage come twice.
    row = "company_id long, notice_id string, requirement_id string, requirement_object string, mandatory boolean, rule string, value_text string, outcome int, reason string, actual string, evidence array<string>"
    needs = [("a", "x", True, 2, ["s1", "p"]), ("b", "x", False, 1, ["s1", None]), ("c", "y", None, 0, None), ("c", "y", None, 0, None), ("d", None, True, None, ["s1"]), ("e", "", True, 2, [])]
    rows = [(c, n, i, o and o + n, m, "q", "v", k, "r", "a", e) for c in (1, 2, None) for n in ("n", "k") for i, o, m, k, e in needs]
    assessed, covered = spark.createDataFrame(rows, row), spark.createDataFrame([("n", True), ("n", True), ("k", False), ("z", True)], "notice_id string, complete boolean")
    kinds = spark.createDataFrame([("s1", "qualification"), ("s1", "qualification"), ("p", "other")], "object_id string, object_type string")
    own = assessed.where("requirement_object <> ''")
    both = [sorted(map(repr, assessment.stated(own, covered, "1996-01-01", fact_types=kinds, within_notice=w).collect())) for w in (True, False)]
    assert both[0] == both[1] and len(both[0]) == len(set(both[0]))
    whole = assessment.stated(assessed, covered, "1996-01-01", fact_types=kinds).collect()
    objects, links = assessment.materialized(assessed, covered, "1996-01-01", fact_types=kinds)
    assert {r["object_id"] for r in objects.collect()} == {r["source_id"] for r in whole if r["properties"] is not None}
    assert sorted(map(repr, links.collect())) == sorted(repr(r) for r in spark.createDataFrame([r for r in whole if r["properties"] is None], assessment.stated(assessed, covered, "d").schema).selectExpr("type link_type", "source_id", "target_id").collect())
    # Requirements of "" and null are one decision that speaks of both; its outcome is the least.
    of = [r["properties"] for r in whole if r["type"] == assessment.DECISION]
    assert len(of) == 2 * 2 * 3 and sorted(p["outcome"] for p in of if p["requirement_id"] == "a") == ["satisfied"] * 4
    tops = [r["properties"] for r in whole if r["type"] == assessment.ASSESSMENT]
    assert [(p["satisfied_count"], p["unsatisfied_count"], p["needs_review_count"]) for p in tops] == [("2", "2", "1")] * 4


def test_large_groups_of_sketches(spark, monkeypatch):
    """In a large group of strangers few pairs are judged one by one, and none that is alike is lost; roles and orders count as in small ones."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randrange(2, 9))) for _ in range(5000)]
    strangers = [" ".join(rng.choices(words, k=rng.randrange(250, 350))) for _ in range(6000)]
    copies = [" ".join(w[::-1] if 100 <= i < 110 else w for i, w in enumerate(t.split())) for t in strangers[:40]]
    docs = [("h", i, t) for i, t in enumerate(strangers + copies)]
    marked = text._sketched(spark.createDataFrame(docs, "home string, k long, text string").select("home", F.struct("k").alias("rank"), "text"), 16)
    key = {r["id"]: r["rank"]["k"] for r in marked.select("id", "rank").collect()}
    roles = ["pmod(id, 9) < 8 as heads", "pmod(id, 7) < 6 as tails", "if(pmod(id, 5) = 0, id - 1, null) as least", "false as part", "false as across", "false as upper"]
    whole = marked.orderBy("id").selectExpr("'g' as group", "0 as band", "*", *roles).toArrow().combine_chunks()

    def pairs(rows):
        (batch,) = rows.to_batches()
        return [(key[a], key[b]) for x, y in text._may_be_alike(batch, 0.75, 0.88) for a, b in zip(x.tolist(), y.tolist(), strict=True)]

    begun = time.time()
    found = pairs(whole)
    assert time.time() - begun < 15  # 67 s when all pairs were judged
    alike = {(i, 6000 + i) for i in range(40) if text.shared_ratio(strangers[i], copies[i]) >= 0.88}
    given = {key[r["id"]]: r for r in whole.select(["id", "heads", "tails", "least"]).to_pylist()}
    of = {(i, j) for i, j in alike if given[i]["heads"] and given[j]["tails"] and (given[j]["least"] is None or given[j]["least"] > given[i]["id"])}
    assert len(of) > 15 and of <= set(found) and len(found) == len(set(found)) < 10_000
    some = whole.filter([key[i] < 400 or key[i] >= 6000 for i in whole["id"].to_pylist()]).combine_chunks()
    by_lookup = pairs(some)
    monkeypatch.setattr(text, "FEW", 10**9)
    one_by_one = pairs(some)
    assert set(by_lookup) <= set(one_by_one) and of <= set(by_lookup)
    lengths = [len(t) for _, _, t in docs]
    assert all(max(lengths[a], lengths[b]) * 0.88 > min(lengths[a], lengths[b]) * 1.12 for a, b in set(one_by_one) - set(by_lookup))
