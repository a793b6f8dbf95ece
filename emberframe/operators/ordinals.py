"""Row numbers and ranks that never sort a whole group inside one task.

``row_number().over(partitionBy(group))`` puts each group into one task, and
without a group the whole table.  Here rows are range-partitioned on
(group, order), so a large group spans many partitions.  Every partition knows
its local positions; the start of a group inside a partition is the sum of the
group's counts in earlier partitions, taken from a table with one row per
(group, partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.session import stash

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, position below


def range_sorted(df: DataFrame, keys: Sequence[str], label: str, spread_ties: bool = False) -> DataFrame:
    """Store ``df`` in global ``keys`` order with ``_part`` and ``_row`` positions.

    Rows that are equal on all keys meet in one partition.  ``spread_ties``
    separates them by input position; it is meant for frames read straight from
    files, where a repeated task sees its rows in the same order.
    """
    if spread_ties:
        df, keys = df.withColumn("_tie", F.monotonically_increasing_id()), [*keys, "_tie"]
    ordered = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_tie")
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", _ROW_BITS).cast("int"))
    )
    return stash(ordered, label)


def before_in_group(runs: DataFrame, group: Sequence[str], amount: str) -> Column:
    """Sum of ``amount`` over the group's earlier partitions (one row per partition)."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    w = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(w), F.lit(0))


def grouped_ordinal(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, start: int = 0, spread_ties: bool = False, kind: str = "int"
) -> DataFrame:
    """Add ``name``: the position of each row in its group, counted from ``start``.

    ``kind`` is its type; an int is for groups inside a message, which are shorter
    than 2^31, a bigint for any other.
    """
    ranged = range_sorted(df, [*group, *order], f"ordinal-{name}", spread_ties)
    runs = ranged.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    offsets = runs.select(
        *group, "_part", (before_in_group(runs, group, "_n") - F.col("_first") + start).alias("_offset")
    )
    joined = ranged.join(offsets, [*group, "_part"])
    return joined.withColumn(name, (F.col("_row") + F.col("_offset")).cast(kind)).drop(
        "_row", "_part", "_offset"
    )
