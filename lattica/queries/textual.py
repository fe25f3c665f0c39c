"""Pages, paragraphs, choosing blocks, similar documents, vectors, turns of conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.match import word_runs
from ..operators import citations as cite
from ..operators import text as t
from ..sources import blocks as b
from ..sources import landing
from .registry import query, table

_PARAGRAPHS = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, trim(line, ' ' || chr(9) || chr(13)) AS text, i FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
blocks AS (SELECT doc_id, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS block_index FROM p)
"""


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the documents as paragraphs: these texts have no blank lines, so each line counts as one."""
    docs = table(spark, folder, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return b.paragraphs(docs, "doc_id", "text").select("doc_id", "block_index", "text")


@query(_PARAGRAPHS + "SELECT doc_id, block_index, sha256(text) AS hash FROM blocks")
def paragraph_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered paragraphs of every text."""
    return _blocks(spark, folder).select("doc_id", "block_index", F.sha2("text", 256).alias("hash"))


@query(_PARAGRAPHS + "SELECT doc_id, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(length(text) - length(replace(text, chr(65533), ''))) AS BIGINT) AS n_replaced FROM blocks GROUP BY 1")
def parse_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """What was parsed of each document."""
    return b.parse_diagnostics(_blocks(spark, folder), "doc_id")


@query(_PARAGRAPHS + """
SELECT doc_id, block_index FROM (SELECT *, max(regexp_matches(text, '@|token')) OVER (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM blocks) WHERE near
""")
def block_context(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with a hit, and three before and after."""
    return t.with_context(_blocks(spark, folder), "doc_id", F.col("text").rlike("@|token")).where("near").select("doc_id", "block_index")


@query(_PARAGRAPHS + "SELECT doc_id, block_index FROM blocks WHERE block_index < 50")
def leading_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """the first fifty blocks of each document (the number is the rule of this pass)."""
    return _blocks(spark, folder).where(F.col("block_index") < t.LEADING).select("doc_id", "block_index")


@query(_PARAGRAPHS + """
, h AS (SELECT *, length(text) < 12 AS heading, regexp_matches(text, '^[A-M]') AS wanted FROM blocks),
s AS (SELECT *, max(CASE WHEN heading THEN block_index END) OVER w AS begun,
  last_value(CASE WHEN heading THEN wanted END IGNORE NULLS) OVER w AS inside FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY block_index ROWS UNBOUNDED PRECEDING))
SELECT doc_id, block_index FROM s WHERE inside AND block_index - begun <= 30
""")
def heading_section(spark: SparkSession, folder: str) -> DataFrame:
    """the blocks under certain headings, to the next heading or thirty blocks."""
    found = t.in_section(_blocks(spark, folder), "doc_id", F.length("text") < 12, F.col("text").rlike("^[A-M]"))
    return found.where("section").select("doc_id", "block_index")


@query(_PARAGRAPHS + """
SELECT doc_id, block_index, coalesce(NOT regexp_matches(lag(text) OVER (PARTITION BY doc_id ORDER BY block_index), '[.!?]\\s*$'), false) AS continues FROM blocks
""".replace("\\\\", "\\"))
def continuation(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks that go on with an unfinished one before."""
    return t.continues(_blocks(spark, folder), "doc_id").select("doc_id", "block_index", "continues")


@query()
def budget_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The best blocks that fit a budget of each document, passing over what doesn't fit."""
    scored = t.with_context(_blocks(spark, folder), "doc_id", F.col("text").rlike("@|token")).withColumn("score", F.col("near").cast("int") * 2 + (F.col("block_index") < 5).cast("int"))
    return t.within_budget(scored, "doc_id", 2000).select("doc_id", "block_index", F.length("text").alias("n"))


_SELECTION = t.Selection("@|token", "^[A-M].{0,10}$", "^.{0,11}$", "[0-9]{4}", "xx", supplement_name="src1", budget=2000)


def _refined(spark: SparkSession, folder: str) -> DataFrame:
    """The paragraphs in pieces of at most 900 characters, numbered anew; a piece names its paragraph as parent, a whole one has none."""
    cut = b.refined(_blocks(spark, folder), ["doc_id", "block_index"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_index", "piece")) - 1
    parent = F.when(F.col("piece") > 0, F.col("block_index"))
    return cut.select("doc_id", place.alias("block_index"), (F.col("block_index") / 4).cast("int").alias("page"), parent.alias("parent"), "text").withColumn("page", F.col("page") + 1)


def _selection(spark: SparkSession, folder: str) -> tuple:
    docs, blocks = table(spark, folder, "documents"), _refined(spark, folder)
    asked = blocks.where(F.pmod(F.col("doc_id") + F.col("block_index"), F.lit(97)) == 0)
    return blocks, "doc_id", _SELECTION, docs.select("doc_id", F.col("source").alias("file_name")), asked


@query()
def selected_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Refined blocks by all passes, retrieved ones included, within a budget by score; compared with a plain version in the tests."""
    return t.selected(*_selection(spark, folder)).select("doc_id", "block_index", "strategy")


@query()
def selection_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Strategy, counts and passes of every document; compared with a plain version in the tests."""
    return t.selection_summary(*_selection(spark, folder))


@query()
def cited_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """For four citations of every document, the block that they stand for and how it was found.

    Each document quotes one of its own blocks (by its number): a part of it, its first and last
    third around an ellipsis, and the block with every fifth word spelt backwards, once with
    and once without pointing to the block.
    """
    blocks = _refined(spark, folder)
    n = F.count("*").over(Window.partitionBy("doc_id"))
    chosen = blocks.withColumn("n", n).where("block_index = pmod(doc_id, n)")
    size, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    parts = F.concat(F.substring("text", F.lit(1), third), F.lit(" ... "), F.substring("text", size - third + 1, third))
    altered = F.array_join(F.transform(F.split("text", " "), lambda w, i: F.when(i % 5 == 0, F.reverse(w)).otherwise(w)), " ")
    none = F.lit(None).cast("int")
    made = [(F.substring("text", F.lit(4), size - 6), none), (parts, F.col("block_index")), (altered, F.col("block_index")), (altered, none)]
    quotes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), q.alias("quote"), p.alias("pointed")) for i, (q, p) in enumerate(made)]))
    citations = chosen.select("doc_id", quotes.alias("q")).select("doc_id", (F.col("doc_id") * 4 + F.col("q.i")).alias("citation_id"), "q.quote", "q.pointed")
    return cite.cited(citations, blocks, "doc_id", scored=False).select("citation_id", "block_index", "tier", F.sha2("excerpt", 256).alias("excerpt_sha256"), "compared")


@query(_PARAGRAPHS + """
, n AS (SELECT doc_id, block_index, text, lead(text) OVER (PARTITION BY doc_id ORDER BY block_index) AS following FROM blocks)
SELECT doc_id, block_index, length(text) + CASE WHEN NOT regexp_matches(text, '[.!?]\\s*$') THEN 1 + coalesce(length(following), -1) ELSE 0 END AS n FROM n
""".replace("\\\\", "\\"))
def joined_siblings(spark: SparkSession, folder: str) -> DataFrame:
    """blocks with the next one added where they don't end a sentence."""
    w = Window.partitionBy("doc_id").orderBy("block_index")
    following = F.when(~F.col("text").rlike(r"[.!?]\s*$"), F.lead("text").over(w))
    joined = _blocks(spark, folder).withColumn("joined", F.concat_ws(" ", "text", following))
    return joined.select("doc_id", "block_index", F.length("joined").cast("long").alias("n"))


@query()
def clause_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses with their places; compared with a plain version in the tests."""
    return b.clauses(table(spark, folder, "documents"), "doc_id").select("doc_id", "clause_start", "clause_end", F.sha2("clause", 256).alias("hash"))


@query(_PARAGRAPHS + """
, m AS (SELECT doc_id, string_agg(DISTINCT lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), '|' ORDER BY lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))) AS s
  FROM blocks WHERE regexp_matches(text, '[0-9]') GROUP BY 1)
SELECT doc_id, sha256(s) AS fingerprint FROM m
""")
def requirement_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """A hash of the set of normalised blocks that match."""
    hits = _blocks(spark, folder).where(F.col("text").rlike("[0-9]")).withColumn("s", F.lower(F.regexp_replace("text", "[^A-Za-z0-9]", "")))
    return hits.groupBy("doc_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("s")), "|"), 256).alias("fingerprint"))


@query()
def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Similar documents of one language and the same lines with digits (L04), each with the first that stays."""
    return t.near_copies(table(spark, folder, "documents"), "lang", "doc_id", "text", "[0-9]")


@query()
def refined_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Long blocks cut at ends of sentences, with offsets."""
    return b.refined(_blocks(spark, folder), ["doc_id", "block_index"]).select("doc_id", "block_index", "piece", "parent_start", "parent_end")


@query("""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_items, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages
""")
def page_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of raw pages by patterns."""
    return table(spark, folder, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("n_items"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")
    )


@query("""
SELECT page_id, 0 AS place, [host, CAST(n AS VARCHAR)] AS cells FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(html) AS n FROM pages)
""")
def html_table_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a table of one class inside pages; the raw pages have none, so each gets one after its own text."""
    cells = F.concat(F.lit("<tr><th>h</th><th>n</th></tr><tr><td>"), F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("<br/></td><td> "), F.length("html").cast("string"), F.lit(" </td></tr>"))
    pages = table(spark, folder, "pages").select("page_id", F.concat("html", F.lit('<table class="a wanted">'), cells, F.lit("</table>")).alias("html"))
    return landing.html_rows(pages, "page_id", "html", "wanted")


@query("""
SELECT event_id, user_id, sha256('{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}') AS source_record_hash FROM events
""")
def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads with the hash of their canonical form."""
    return landing.raw_records(table(spark, folder, "events"), "props").select("event_id", "user_id", "source_record_hash")


@query("""
SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1 AS INTEGER) AS place, CAST(l_linenumber AS VARCHAR) AS number, l_returnflag AS flag FROM lineitem
""")
def xml_records(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of XML to JSON without a schema, with one item or many, and the records in them."""
    item = F.concat(F.lit("<n:item><no> "), F.col("l_linenumber").cast("string"), F.lit(" </no><n:flag x='1'>"), F.col("l_returnflag"), F.lit("</n:flag></n:item>"))
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("x")))).alias("items"))
    xml = F.concat(F.lit("<?xml version='1.0'?><r xmlns:n='urn:x'><body><items>"), F.array_join(F.transform("items", lambda i: i["x"]), "\n"), F.lit("</items></body></r>"))
    pages = landing.xml_json(lines.select(F.col("l_orderkey").alias("page_id"), xml.alias("xml")), "xml")
    found = landing.records(pages.drop("xml"), "json", "body.items.item[]", "body.totalCount")
    return found.select("page_id", "place", F.get_json_object("payload", "$.no").alias("number"), F.get_json_object("payload", "$.flag").alias("flag"))


@query("""
WITH o AS (SELECT o_orderstatus AS operation, CAST(o_orderdate AS DATE) AS day, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, date_trunc('month', o_orderdate) ORDER BY o_orderkey) AS i,
  count(*) OVER (PARTITION BY o_orderstatus, date_trunc('month', o_orderdate)) AS n, date_trunc('month', o_orderdate) AS m FROM orders)
SELECT operation, CAST(m AS DATE) AS window_start, CAST(1 + (i - 1) // 4 AS INTEGER) AS page, CAST((i - 1) % 4 AS INTEGER) AS place, sha256('{"key":' || o_orderkey || '}') AS source_record_hash
FROM o WHERE operation <> 'P' AND m >= DATE '1996-01-01' AND m < DATE '1999-01-01'
""")
def extracted_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Landed pages of operations and monthly windows, read up to the total of each, to raw records.

    Each window has its pages of four records, as many as its orders need, and one more that
    landed beyond the total.
    """
    orders = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("operation"), F.trunc("o_orderdate", "month").alias("window_start"), "o_orderkey")
    key = ["operation", "window_start"]
    w = Window.partitionBy(*key)
    placed = orders.withColumn("i", F.row_number().over(w.orderBy("o_orderkey")) - 1).withColumn("n", F.count("*").over(w))
    items = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.struct(k.alias("key")))
    full = placed.groupBy(*key, (F.floor(F.col("i") / 4) + 1).cast("int").alias("page")).agg(items.alias("item"), F.max("n").alias("totalCount"))
    last = full.groupBy(*key).agg((F.max("page") + 1).alias("page"), F.max_by("item", "page").alias("item"), F.max("totalCount").alias("totalCount"))
    bodies = full.unionByName(last).select(*key, "page", F.to_json(F.struct(F.struct("item", "totalCount").alias("body"))).alias("body"))
    wanted = bodies.where((F.col("operation") != "P") & (F.col("window_start") >= "1996-01-01") & (F.col("window_start") < "1999-01-01"))
    pages = landing.read_pages(wanted, 4, None, "body", "body.totalCount", key)
    found = landing.raw_records(landing.records(pages, "body", "body.item[]", "body.totalCount"))
    return found.select(*key, "page", "place", "source_record_hash")


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END AS day FROM events
""")
def tolerant_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates at the start of texts, null where there is none."""
    day, i = F.date_format("ts", "yyyy-MM-dd"), F.col("event_id")
    written = F.when(i % 3 == 0, F.concat(day, F.lit("T09:00 or so"))).when(i % 3 == 1, F.concat(F.lit(" "), day)).otherwise(F.lit("2024-13-45"))
    return table(spark, folder, "events").select("event_id", codecs.tolerant_date(written).alias("day"))


@query("SELECT user_id, CAST(place AS INTEGER) AS place, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events)")
def record_path(spark: SparkSession, folder: str) -> DataFrame:
    """Records inside pages of JSON, one page for each user."""
    bodies = table(spark, folder, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id"))).alias("item"), F.count("*").alias("totalCount"))
    pages = bodies.select("user_id", F.to_json(F.struct(F.struct(F.struct("item").alias("items"), "totalCount").alias("body"))).alias("page"))
    found = landing.records(pages, "page", "body.items.item[]", "body.totalCount")
    return found.select("user_id", "place", F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"))


@query("""
SELECT event_id, code FROM (SELECT event_id, unnest([CASE WHEN NOT (value >= 0 AND value < 80) THEN 'value_range' END, CASE WHEN NOT event_type IN ('click', 'view', 'purchase') THEN 'unknown_type' END]) AS code FROM events) WHERE code IS NOT NULL
""")
def contract_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Which rules of its contract each record breaks."""
    rules = {"value_range": (F.col("value") >= 0) & (F.col("value") < 80), "unknown_type": F.col("event_type").isin("click", "view", "purchase")}
    return landing.diagnostics(table(spark, folder, "events"), ["event_id"], rules)


@query("""
SELECT conv_id, turn, role, length(text) AS n_chars, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS same_speaker,
  CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS so_far FROM conversations
""")
def conversation_turns(spark: SparkSession, folder: str) -> DataFrame:
    """turns with what came before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", n.alias("n_chars"), F.coalesce(F.col("role") == F.lag("role").over(w), F.lit(False)).alias("same_speaker"), F.sum(n).over(w).alias("so_far"))


@query("""
WITH q AS (SELECT label, list(embedding) AS e FROM embeddings GROUP BY 1),
d AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS centre FROM d GROUP BY 1),
s AS (SELECT vec_id, embeddings.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre) AS cosine FROM embeddings JOIN c ON c.label = embeddings.label)
SELECT label, vec_id, round(cosine, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(cosine, 6) DESC, vec_id) <= 10
""")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Of each label the ten vectors nearest to its mean."""
    e = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = F.round(dot(F.col("v"), F.col("c")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("c"), F.col("c"))), 6)
    scored = e.join(centres, "label").select("label", "vec_id", cosine.alias("cosine"))
    w = Window.partitionBy("label").orderBy(F.desc("cosine"), "vec_id")
    return scored.withColumn("place", F.row_number().over(w)).where("place <= 10").select("label", "vec_id", "cosine")


@query("""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS cosine
  FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0)
SELECT query_id, vec_id, cosine FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 10
""")
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Of every twentieth vector the ten nearest of all, whatever their labels."""
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return t.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "v", 10)


@query("""
SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2
""")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by event-time window, as the streaming operator makes them."""
    e = table(spark, folder, "events")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""
SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)
""")
def cited_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of the benchmark word for word.

    Wherever a passage starts and ends, its words but the first and the last are whole words of
    the document; up to eight of them are the join key, the whole passage is checked after.
    """
    d = table(spark, folder, "documents").select("doc_id", "text", F.split("text", r"\s+").alias("w"))
    items = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("quote"), F.split("text", r"\s+").alias("w"))
    sized = items.withColumn("n", F.greatest(F.least(F.size("w") - 2, F.lit(8)), F.lit(0)))
    found = []
    for n in sorted(r["n"] for r in sized.select("n").distinct().collect()):  # nine lengths at most
        own = sized.where(F.col("n") == n)
        if n:
            keyed = own.select("item_id", "quote", F.xxhash64(F.slice("w", 2, n)).alias("key"))
            places = d.where(F.size("w") >= n).select("doc_id", "text", F.explode(F.array_distinct(word_runs(F.col("w"), n))).alias("key"))
            found.append(places.join(keyed, "key").where(F.col("text").contains(F.col("quote"))))
        else:  # one or two words have no key
            found.append(d.join(own.select("item_id", "quote"), F.col("text").contains(F.col("quote"))))
    hits = [f.select("item_id", "doc_id") for f in found]
    none = spark.createDataFrame([], "item_id long, doc_id long")
    return reduce(DataFrame.union, hits, none).distinct()
