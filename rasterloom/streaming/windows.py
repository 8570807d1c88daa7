"""Event-time windows and keyed state over the events table, as batch plans and as streams of the same plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _stream(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    source = spark.readStream.schema(batch(spark, sf_dir).schema)
    source = source.option("maxFilesPerTrigger", files) if files else source
    # A table is one file beside the others, or a folder of files.
    one = not list(Path(sf_dir.removeprefix("file://"), "events.parquet").glob("*.parquet"))
    source = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if one else source.parquet(f"{sf_dir}/events.parquet")
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", lateness)
    s = events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"))
    return s.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    s = events.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"))
    return s.select(F.col("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    s = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("session_start"), "user_id", "n")


def _drained(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what its source holds now; results are files, not driver memory."""
    spark = df.sparkSession
    base = shared_folder(spark, "stream")
    epochs: list[str] = []

    def keep(part: DataFrame, epoch: int) -> None:
        path = f"{base}/out/epoch={epoch}"
        part.write.mode("overwrite").parquet(path)
        if mode == "complete":  # each epoch holds the whole result
            epochs.clear()
        if path not in epochs:
            epochs.append(path)

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(*epochs) if epochs else spark.createDataFrame([], df.schema)


def streamed(spark: SparkSession, sf_dir: str, plan: Callable[[DataFrame], DataFrame], files: int | None = None) -> DataFrame:
    """The plan over the events as a stream. files: how many a trigger takes at most."""
    out = _drained(plan(_stream(spark, sf_dir, files)), "complete")
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes])


def streamed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and last time of every user, kept as the group's own state."""

    def work(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, pd.Timestamp(0))
        for p in parts:
            n, last = n + len(p), max(last, p["ts"].max())
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_ts": [last]})

    s = _stream(spark, sf_dir).select("user_id", "ts").groupBy("user_id")
    out = s.applyInPandasWithState(work, "user_id bigint, n bigint, last_ts timestamp", "n bigint, last timestamp", "update", GroupStateTimeout.NoTimeout)
    return _drained(out, "update").groupBy("user_id").agg(F.max("n").alias("n"), F.max("last_ts").cast("timestamp_ntz").alias("last_ts"))
