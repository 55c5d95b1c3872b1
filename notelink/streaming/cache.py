"""Append-only caches and windowed streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_write(log: DataFrame, key: str, order: str) -> DataFrame:
    """The latest valid row of each key of an append-only log; a partial aggregate, so a hot key stays cheap."""
    rest = [c for c in log.columns if c != key]
    return log.where(F.col("valid")).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def missing(records: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Records without a finished row of the same identity and hashes: what a resumed run has to do."""
    return records.join(done.select(*keys), keys, "left_anti")


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each kind by tumbling window; works on a table and, with a watermark, on a stream."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def keep_latest(stream: DataFrame, path: str, checkpoint: str, key: str, order: str):
    """Appends the latest row of each key of every micro-batch to a log; :func:`last_write` reads it.

    A batch lies in a folder of its own number, so a batch that runs again after a loss
    replaces itself.
    """
    def put(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        one = batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
        one.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
