"""Quantiles of a growing fleet from sketches that are kept and merged.

A sketch of a part (a day, a file, a host) is a small binary value.  Kept sketches
of all parts are merged without reading the parts' rows again.  The rank of a
quantile is off by about 1.7 / k of the rows at most; parts with at most ``k`` rows in
all are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile_sketches(rows: DataFrame, by: Sequence[str | Column], value: str, k: int = 2000) -> DataFrame:
    """One sketch of the non-null values per part."""
    kept = rows.where(F.col(value).isNotNull()).withColumn("_value", F.col(value).cast("double"))
    return kept.groupBy(*by).agg(F.kll_sketch_agg_double("_value", F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """The sketches of several parts as one, per ``by`` or of all."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def percentiles(sketches: DataFrame, wanted: Sequence[int] = tuple(range(101))) -> DataFrame:
    """(..., percentile, n, value) of every sketch: the least value with at least that share of the n rows up to it."""
    shares = F.array(*[F.lit(p / 100) for p in wanted])
    values = F.arrays_zip(F.array(*map(F.lit, wanted)).alias("percentile"), F.kll_sketch_get_quantile_double("sketch", shares).alias("value"))
    kept = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*kept, F.kll_sketch_get_n_double("sketch").alias("n"), F.inline(values).alias("percentile", "value"))
