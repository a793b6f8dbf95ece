"""Samples and distinct stacks per buffer window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.session import configure, new_path, stash


def stack_counts(samples: DataFrame, duration: str) -> DataFrame:
    """(window_start, host, stack, n) over ``ts``: what a window's counts are made of, on streams as well.

    It can be merged: counts add up, and a stack is distinct however often it is
    seen.  So longer windows and later batches need no sample again.
    """
    return samples.groupBy(F.window("ts", duration), "host", "stack").agg(F.count("*").alias("n")).select(
        F.unix_seconds(F.col("window.start")).alias("window_start"), "host", "stack", "n")


def longer_windows(counts: DataFrame, seconds: int) -> DataFrame:
    """The same of windows of ``seconds``, a multiple of the present length."""
    start = F.col("window_start") - F.pmod(F.col("window_start"), F.lit(seconds))
    return counts.groupBy(start.alias("window_start"), "host", "stack").agg(F.sum("n").alias("n"))


def window_counts(counts: DataFrame) -> DataFrame:
    """Sample and distinct stack counts per window and host."""
    return counts.groupBy("window_start", "host").agg(F.sum("n").alias("samples"), F.count("*").alias("stacks"))


def buffer_windows(samples: DataFrame, duration: str) -> DataFrame:
    """Tumbling windows over ``ts`` per ``host``: sample and distinct stack counts."""
    return window_counts(stack_counts(samples, duration))


def buffer_curve(samples: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """``size_curve`` of several window lengths, each a multiple of the one before; samples are read once."""
    counts, per_length = stash(stack_counts(samples, f"{lengths[0]} seconds"), "stack-counts"), []
    for n, seconds in enumerate(lengths):
        if n:
            counts = stash(longer_windows(counts, seconds), "stack-counts")
        per_length.append(window_counts(counts).withColumn("buffer_seconds", F.lit(seconds).cast("bigint")))
    return size_curve(reduce(DataFrame.unionByName, per_length))


def stream_buffer_windows(stream: DataFrame, duration: str, lateness: str) -> DataFrame:
    """As ``stack_counts`` on a stream; rows later than ``lateness`` are dropped."""
    return stack_counts(stream.withWatermark("ts", lateness), duration)


def run_to_completion(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """Run a stream of ``stack_counts`` over all available input and read its windows back, open ones included.

    Every batch writes the counts it changed to its own folder, which a
    repeated batch overwrites.
    """
    configure(spark)
    out, checkpoint = new_path(spark, "windows"), new_path(spark, "windows-checkpoint")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{batch_id}")

    query = (
        counts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.lastProgress is None:  # no input, so no batch has written
        return window_counts(spark.createDataFrame([], counts.schema))
    changed = spark.read.schema(counts.schema).option("recursiveFileLookup", "true").parquet(out)
    # A count never shrinks, so its largest value is its latest.
    return window_counts(changed.groupBy("window_start", "host", "stack").agg(F.max("n").alias("n")))


def size_curve(windows: DataFrame) -> DataFrame:
    """Mean samples and stacks per window length: how much of a longer buffer repeats known stacks."""
    return windows.groupBy("buffer_seconds").agg(
        F.count("*").alias("windows"), F.avg("samples").alias("mean_samples"), F.avg("stacks").alias("mean_stacks"),
        F.try_divide(F.sum("samples").cast("double"), F.sum("stacks").cast("double")).alias("samples_per_stack"),
    )
