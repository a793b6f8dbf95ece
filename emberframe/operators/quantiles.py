"""Exact order statistics without sorting everything inside one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.operators.ordinals import before_in_group, range_sorted


def nearest(q: float):
    """Rank of the ``nearest`` quantile: round((n - 1) * q), halves away from zero."""
    return lambda n: F.round((n - 1).cast("double") * F.lit(float(q))).cast("bigint")


def lower_middle(n: Column) -> Column:
    return F.floor((n - 1) / 2).cast("bigint")


def upper_middle(n: Column) -> Column:
    return F.ceil((n - 1) / 2).cast("bigint")


def order_statistics(df: DataFrame, group: Sequence[str], value: str, targets: Mapping[str, object]) -> DataFrame:
    """(group, target, value): the value at each target rank of the sorted non-null values.

    ``group`` names at least one column.  ``targets`` maps a name to a function from the group's row count to a
    0-based rank.  Equal values are counted first, so a value shared by most
    rows is one row; the counted values are range-sorted, and only the
    partitions that contain a wanted rank are scanned for it.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_value")).agg(
        F.count("*").alias("_count"))
    ranged = range_sorted(counted, [*group, "_value"], "order-statistics")
    parts = ranged.groupBy(*group, "_part").agg(F.sum("_count").alias("_n"), F.min("_row").alias("_first"))
    starts = parts.select(*group, "_part", "_n", before_in_group(parts, group, "_n").alias("_start"))
    totals = parts.groupBy(*group).agg(F.sum("_n").alias("_total"))
    spans = starts.join(totals, list(group))
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("target"), rank(F.col("_total")).alias("rank")) for name, rank in targets.items()
    ]))
    hits = spans.select(*group, "_part", "_start", "_n", wanted.alias("t")).where(
        (F.col("t.rank") >= F.col("_start")) & (F.col("t.rank") < F.col("_start") + F.col("_n"))
    ).select(*group, "_part", "_start", "t.target", "t.rank")
    w = Window.partitionBy(*group, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    touched = ranged.join(hits.select(*group, "_part").distinct(), [*group, "_part"], "left_semi").withColumn(
        "_upto", F.sum("_count").over(w))
    return touched.join(hits, [*group, "_part"]).where(
        (F.col("rank") < F.col("_start") + F.col("_upto"))
        & (F.col("rank") >= F.col("_start") + F.col("_upto") - F.col("_count"))
    ).select(*group, "target", F.col("_value").alias("value"))
