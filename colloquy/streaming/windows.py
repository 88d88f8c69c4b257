"""Windowed counts that run on a table or on a stream, and a stateful presence machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, time: str, width: str, late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) per fixed window; on a stream rows later than ``late`` are left out."""
    e = events.where(F.col(time).isNotNull())
    if events.isStreaming:
        e = e.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = e.groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def presence_stream(rows: DataFrame) -> DataFrame:
    """(bank, topic, print_no, present, delta) as prints arrive: per bank and topic the last presence is state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for b in batches:
            for no, n in sorted(zip(b["print_no"], b["n_turns"], strict=True)):
                now = bool(n > 0)
                delta = ("first_seen" if now else "first_absent") if last is None else "continued" if now and last else "appeared" if now else "disappeared" if last else "still_absent"
                out.append((*key, int(no), now, delta))
                last = now
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["bank", "topic", "print_no", "present", "delta"])

    return rows.groupBy("bank", "topic").applyInPandasWithState(
        step, "bank string, topic string, print_no int, present boolean, delta string", "last boolean", "append", GroupStateTimeout.NoTimeout
    )


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give its rows, from an in-memory table (for small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def parquet_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A stream of the parquet files of a folder, with the schema of a table."""
    return spark.readStream.schema(like.schema).parquet(folder)
