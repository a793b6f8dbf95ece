"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.session import new_path, ship_package, stash

__all__ = ["map_rows", "new_path", "read_table", "smallest_hashes", "stash", "text_table"]

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.large_string(),
          "binary": pa.large_binary(), "boolean": pa.bool_()}
_BATCH_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id, text), so that further columns of any name cannot clash; a null text is empty."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], ddl: str) -> DataFrame:
    """``rows`` turns a partition's tuples into tuples of ``ddl``; one call per task.

    Values stream through Arrow batches and are turned into Python objects a
    few megabytes at a time, so that long texts do not pile up.
    """
    ship_package(df.sparkSession)
    fields = T.StructType.fromDDL(ddl)
    names = [f.name for f in fields]
    kinds = [_ARROW[f.dataType.simpleString()] for f in fields]

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            step = max(1, min(1024, batch.num_rows * _BATCH_BYTES // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in rows(tuples(batches)):
            held.append(row)
            size += 64 + sum(len(v) for v in row if isinstance(v, str | bytes))
            if len(held) >= 4096 or size >= _BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def _batch(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return df.mapInArrow(run, fields)


def smallest_hashes(texts: DataFrame, column: str, rows: int, cut: Callable[[str], str] | None = None) -> list[str]:
    """At most ``rows`` distinct texts, those with the smallest hashes; tasks send hashes first, then only these texts, or their ``cut`` form."""
    hashed = texts.select(F.col(column).alias("t"), F.xxhash64(column).alias("k"))
    chosen = [r.k for r in hashed.select("k").distinct().orderBy("k").limit(rows).collect()]
    found = hashed.where(F.col("k").isin(chosen)).distinct() if chosen else hashed.limit(0)
    if cut is not None:
        found = map_rows(found.select("t", "k"), lambda pairs: ((cut(t), k) for t, k in pairs), "t string, k bigint")
    return [r.t for r in found.orderBy("k", "t").limit(rows).collect()]
