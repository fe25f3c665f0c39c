"""Rows that every corpus operator must handle: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, part string, base string"


def documents(spark, small, extra=()):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 as rank", "'p' as part", "'b' as base")
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (-1, None, None, None, None), (-2, "", "en", "", 0), (-3, " \n\t ", "en", "s", 4), (-4, "one", None, "s", 3), (-5, "... !!! 123", "en", "s", 11),
        (-6, long, "en", "s", len(long)), (-7, "same text twice " * 30, "en", "s", 480), (-7, "same text twice " * 30, "en", "s", 480), (-8, "same text twice " * 30, "en", "t", 480),
        (None, "a row without an id, but with some words in it", "en", "t", 46), (-9, "😀 ünï cödé 中文 x\x1cy z", "de", "t", 20), *extra,
    ]
    return docs.unionByName(spark.createDataFrame([(*r, 2, "q", "c") for r in rows], SCHEMA))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
