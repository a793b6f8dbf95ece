"""Process context snapshots seen in the ``events`` table.

pid = user, host = user mod 7, published time = event time (0 for ``error``
events, as during an update).  Some snapshots break a rule on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators.context import KEY_MAP_KEY, SIGNATURE, VERSION
from emberframe.session import configure


def _pair(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def event_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    event, user = F.col("event_id"), F.col("user_id")
    pairs = [
        _pair("deployment.environment.name", F.lit("prod")),
        _pair("service.instance.id", user.cast("string")),
        _pair("service.name", F.col("event_type")),
        F.when(event % 20 != 3, _pair("service.version", F.concat(F.lit("1."), (user % 5).cast("string")))),
        _pair("telemetry.sdk.language", F.lit("python")),
        _pair("telemetry.sdk.version", F.lit("1.0")),
        _pair("telemetry.sdk.name", F.lit("sdk")),
        F.when(event % 25 == 4, _pair("service.name", F.lit("again"))),
        _pair("props", F.col("props")),
    ]
    extra = [F.when(event % 40 == 7, _pair(KEY_MAP_KEY, F.lit("a")))]
    present = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return events.select(
        F.concat(F.lit("host-"), (user % 7).cast("string")).alias("host"), user.alias("pid"),
        F.when(event % 50 == 0, "BAD_SIGN").otherwise(SIGNATURE).alias("signature"),
        F.when(event % 60 == 0, 1).otherwise(VERSION).alias("version"),
        F.when(F.col("event_type") == "error", 0).otherwise(
            F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("bigint").alias("published_at_ns"),
        present(pairs).alias("attributes"), present(extra).alias("extra"),
    )
