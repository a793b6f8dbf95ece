"""CSV form of the statistics rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions.values import shortest_decimal
from emberframe.schema import STATS_COLUMNS
from emberframe.sources.ordered_csv import write_ordered_csv


def utc_parts(ns: Column, pattern: str) -> tuple[Column, Column]:
    """Formatted whole seconds and the fraction digits without trailing zeros."""
    below = F.pmod(ns, F.lit(1_000_000_000))
    # Rounded down, without a subtraction that could overflow.
    micros = F.call_function("div", ns, F.lit(1000).cast("bigint")) - F.when((ns < 0) & (F.pmod(ns, F.lit(1000)) != 0), 1).otherwise(0)
    fraction = F.regexp_replace(F.lpad(below.cast("string"), 9, "0"), "0+$", "")
    return F.date_format(F.timestamp_micros(micros), pattern), fraction


def rfc3339_nanos(ns: Column) -> Column:
    """UTC time text with up to nine fraction digits, trailing zeros dropped."""
    text, fraction = utc_parts(ns, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(text, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))


def formatted(stats: DataFrame, *more: str) -> DataFrame:
    """All cells as text: plain integers, shortest floats, RFC 3339 times, '' for NULL."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(name)
        if name in ("start_ts", "end_ts"):
            text = rfc3339_nanos(c)
        elif kind == "double":
            text = F.expr(f"CASE WHEN NOT isnan({name}) THEN {shortest_decimal(name)} END")
        else:
            text = c.cast("string")
        return F.coalesce(text, F.lit("")).alias(name)

    return stats.select(*[cell(n, k) for n, k in STATS_COLUMNS], *more)


def write_stats_csv(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one CSV folder in id order, part by part, with a header per part; NULL becomes an empty cell."""
    formatted(stats.repartitionByRange("id").sortWithinPartitions("id")).write.mode(mode).csv(path, header=True, emptyValue="")


def write_stats_file(stats: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write one CSV file with one header, rows in id order."""
    names = [n for n, _ in STATS_COLUMNS]
    cells = formatted(stats.withColumn("_id", F.col("id")), "_id")
    write_ordered_csv(cells, path, ["_id"], names, overwrite)


def read_stats_csv(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """Read statistics CSV files; times stay text, empty cells are NULL."""
    if infer:
        return spark.read.csv(path, header=True, inferSchema=True)
    types = {n: "string" if n in ("start_ts", "end_ts") else k for n, k in STATS_COLUMNS}
    return spark.read.csv(path, header=True, schema=",".join(f"{n} {k}" for n, k in types.items()))
