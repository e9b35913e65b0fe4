"""Streams over growing logs: tailing, change events, exactly-once hooks, event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from corpusmill.sources.readers import METRICS


def tail_metrics(spark: SparkSession, path: str, schema: str = METRICS, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the whole lines of a folder of JSON lines; a torn line gives no row.

    Offsets live in the query's checkpoint; a file counts once it is complete, so writers put
    files in place by a rename.
    """
    raw = spark.readStream.schema(f"{schema}, _corrupt string").option("maxFilesPerTrigger", files_a_batch).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.filter("_corrupt is null").drop("_corrupt")


def with_event_time(rows: DataFrame, column: str, delay: str) -> DataFrame:
    """rows with the column as a timestamp and a watermark on it."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows delivered twice within the watermark come out once."""
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def windowed(rows: DataFrame, time: str, width: str, keys: list[str], *aggs: Column, slide: str | None = None) -> DataFrame:
    """Aggregates by event-time window and keys: tumbling, or sliding if `slide` is given."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[c for c in _names(aggs)])


def sessions(rows: DataFrame, time: str, gap: str, keys: list[str], *aggs: Column) -> DataFrame:
    """Aggregates by session: rows of a key no further apart than the gap."""
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[c for c in _names(aggs)])


def _names(aggs: tuple[Column, ...]) -> list[str]:
    return [c._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for c in aggs]


def state_change_events(rows: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """(key, before, state, at): a row whenever a key's state differs from the one last seen.

    rows: key and state are strings, order a long. Keeps one state a key.
    """

    def on(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        before = held.get[0] if held.exists else None
        out = []
        pdf = pd.concat(list(frames)).sort_values(order)
        for s, at in zip(pdf[state], pdf[order], strict=True):
            if s != before:
                out.append((k[0], before, s, int(at)))
                before = s
        held.update((before,))
        yield pd.DataFrame(out, columns=["key", "before", "state", "at"])

    return rows.select(key, state, order).groupBy(key).applyInPandasWithState(on, "key string, before string, state string, at long", "last string", "append", GroupStateTimeout.NoTimeout)


def exactly_once(rows: DataFrame, checkpoint: str, done: str, keys: list[str], act: Callable[[DataFrame, int], None], trigger: dict | None = None) -> StreamingQuery:
    """Calls act(new rows, batch) once for every key, over restarts.

    Keys are written down after act has returned, and a later batch leaves them out. If the
    driver is lost between the two, the same batch number runs again: an act that writes under
    its batch number is then exact as well.
    """

    def on(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(done)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            new = new.join(spark.read.parquet(done).select(*keys), keys, "left_anti")
        new = new.persist()
        try:
            if not new.isEmpty():
                act(new, number)
                new.select(*keys).write.mode("append").parquet(done)
        finally:
            new.unpersist()

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(on).start()
