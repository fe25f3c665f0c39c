"""Incremental loads: date windows, checkpoints, and micro-batches upserted into a table folder."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import latest, upsert


def collection_window(checkpoint: date | None, overlap: int, today: date, start: date | None = None, end: date | None = None) -> tuple[date, date]:
    """The closed window to load: the one given, or from the checkpoint less the overlap up to today."""
    if start is None and end is None:
        if checkpoint is None:
            raise ValueError("the first load needs an explicit window")
        start, end = checkpoint - timedelta(days=overlap), today
    if start is None or end is None or end < start:
        raise ValueError("a window needs a start and an end that isn't before it")
    return start, end


def backfill_window(checkpoint: date | None, first: date, days: int, today: date) -> tuple[date, date] | None:
    """The next days after the checkpoint, strictly before today; none if there are no such days."""
    start = first if checkpoint is None else checkpoint + timedelta(days=1)
    end = min(start + timedelta(days=days - 1), today - timedelta(days=1))
    return (start, end) if start <= end else None


def lookback(rows: DataFrame, day: str, days: int, today: str) -> DataFrame:
    """Rows of the last ``days`` days, today included."""
    return rows.where(F.to_date(day).between(F.date_sub(F.lit(today).cast("date"), days - 1), F.lit(today).cast("date")))


def version(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/v={n}")


def upsert_stream(stream: DataFrame, folder: str, checkpoint: str, key: Sequence[str], order: str) -> StreamingQuery:
    """Upserts each micro-batch into a new version of the table in ``folder``.

    Of a batch's rows with one key the last by ``order`` counts. A batch that is run again
    writes the version of its own number again, from the one before, so reruns agree.
    """

    def load(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = latest(batch, key, F.col(order).desc_nulls_last())
        if n:
            state = version(spark, folder, n - 1)
            rows = upsert(state, rows.withColumn("updated_batch", F.lit(n)), key, "updated_batch", F.lit(n)).drop("change").select(*state.columns)
        else:
            rows = rows.withColumn("updated_batch", F.lit(n))
        rows.write.mode("overwrite").parquet(f"{folder}/v={n}")

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_by_window(stream: DataFrame, ts: str, late: str, width: str, by: str) -> DataFrame:
    """Counts by event-time window and value; rows later than the watermark are left out."""
    windows = stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("window_start"), by, "n")
