"""Streaming forms of the batch operators: windowed scores, duplicates within a watermark, incremental state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.state import next_held


def windowed_scores(stream: DataFrame, time: str, key: str, value: str, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, end, key, n, total, mean) per event-time window; rows later than ``late`` are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = stream.withWatermark(time, late).groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n", "total", "mean")


def first_seen(stream: DataFrame, time: str, key: str, late: str = "21 days") -> DataFrame:
    """Rows whose key did not occur before within the watermark; state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def held_states(stream: DataFrame, threshold: float, months: int, only_below: float | None = None) -> DataFrame:
    """(key, date, reported_state, reason) of the hysteresis filter carried across batches, one small state per key.

    ``stream``: key string, date date, raw_state string, confidence double. Within a batch rows are taken in order of
    date; a row without state neither advances nor resets the count; a null confidence is weak.
    """

    def fold(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("date").itertuples():
            raw = row.raw_state if isinstance(row.raw_state, str) else None
            held, why = next_held(held, raw, row.confidence if row.confidence == row.confidence and row.confidence is not None else 0.0, threshold, months, only_below)
            out.append((key[0], row.date, None if raw is None else held[0], why))
        state.update(held)
        yield pd.DataFrame(out, columns=["key", "date", "reported_state", "reason"])

    return stream.groupBy("key").applyInPandasWithState(fold, "key string, date date, reported_state string, reason string", "cur string, pend string, n int", "append", GroupStateTimeout.NoTimeout)


def decayed_scores(stream: DataFrame, time: str, key: str, value: str, days: int, half_life: float, late: str = "21 days") -> DataFrame:
    """(day, key, n, score): each row counts on its day and the ``days`` after it, less by its age; sliding windows of a day's step, with the decay inside the sum."""
    w = F.window(time, f"{days} days", "1 day")
    s = stream.withWatermark(time, late).withColumn("_w", w).withColumn("_age", F.datediff(F.to_date(F.col("_w.end") - F.expr("interval 1 second")), F.to_date(time)))
    g = s.groupBy("_w", F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value) * F.pow(F.lit(0.5), F.col("_age") / half_life)).alias("score"))
    return g.select(F.to_date(F.col("_w.end") - F.expr("interval 1 second")).alias("day"), "key", "n", "score")


def in_time(stream: DataFrame, time: str, ahead: str = "interval 0 days", behind: str = "interval 21 days") -> DataFrame:
    """Rows no later than now plus ``ahead`` and no older than ``behind``; rows without a time are dropped."""
    now = F.current_timestamp()
    return stream.where((F.col(time) <= now + F.expr(ahead)) & (F.col(time) >= now - F.expr(behind)))


def not_yet(stream: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of a stream whose key a table doesn't have yet: each batch meets the table as it then is."""
    known = done.select(F.col(key).alias("_k")).distinct().withColumn("_done", F.lit(True))
    return stream.join(known, F.col(key) == F.col("_k"), "left_outer").where("_done is null").drop("_k", "_done")


def replayed(stream: DataFrame, day: str, time: str) -> DataFrame:
    """What a replayed day may see: an item of a later day is an error, not a result."""
    late = F.to_date(time) > F.to_date(F.lit(day))
    return stream.where(F.when(late, F.raise_error(F.lit("item later than the replayed day")).cast("boolean")).otherwise(F.lit(True)))


def by_batch(stream: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """All that has arrived, batch by batch, through an incremental operator (a history or a cap's state), then stop."""
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
