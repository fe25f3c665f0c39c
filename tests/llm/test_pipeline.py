"""Each stage on its own input, and the whole run."""

from pyspark.sql import functions as F

import corpus_pipeline as c

from . import edge


def test_stages(spark, small, tmp_path):
    docs = edge.documents(spark, small).where("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
    clean = spark.read.parquet(str(tmp_path / "language"))
    assert clean.where("doc_id >= 0").count() == docs.where("doc_id >= 0").count()
    assert clean.where(F.col("doc_id").isin(-1, -2, -3, -5)).count() == 0
    single = spark.read.parquet(str(tmp_path / "near_duplicates"))
    assert single.groupBy("doc_id").count().where("count > 1").count() == 0
    assert spark.read.parquet(str(tmp_path / "personal_data")).where(F.col("text").rlike(r"[A-Za-z0-9]@[a-z]+[0-9]\.example")).count() == 0
    whole = c.run(spark, str(tmp_path))
    parts = c.STAGES[-1][1](spark, kept, "")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_empty(spark, tmp_path):
    edge.empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert c.run(spark, str(tmp_path)).count() == 0
