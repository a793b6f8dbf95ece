"""Session settings and the shared scratch folder.

Intermediate tables (ids that must not change between two reads of the same
frame) are written once as Parquet under the folder the cluster names in
``spark.checkpoint.dir`` and read back.  A lost executor then only re-reads
files; no result depends on a recomputed partition layout.
"""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split hot keys in joins even if that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Parquet holds repetitive columns in a tenth of their size and less; without the factor, Spark
    # takes a table of millions of rows for one that can be broadcast through the driver.
    "spark.sql.sources.fileCompressionFactor": "40",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows handed to Python are whole payloads (megabytes each), so batches stay short.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "32",
}

# Largest estimate of a side that Spark may broadcast.  Rows take several times their estimate in the driver, and a
# query has dozens of broadcasts.
_BROADCAST_BYTES = 2 << 20

#: Rows of the longest table that a task sorts and joins at once.
ROWS_PER_TASK = 250_000

_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every operator relies on."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    name = "spark.sql.autoBroadcastJoinThreshold"
    if _as_bytes(spark.conf.get(name)) > _BROADCAST_BYTES:
        spark.conf.set(name, str(_BROADCAST_BYTES))
    return spark


def _as_bytes(text: str) -> int:
    """Of a setting such as ``10485760b``, ``256k``, ``10MB`` or ``-1``."""
    number, unit = re.fullmatch(r"(-?\d+)([a-z]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks among which ``rows`` are dealt out, so that a task's share does not grow with the input.

    Spark merges shuffle partitions up to a number of compressed bytes, which for
    narrow, repetitive rows are more rows than a task can sort in memory.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


@contextmanager
def by_payload(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside may join on several keys where rows lie by ``payload_id`` alone.

    For steps whose payloads are bounded: rows are moved once, and all joins,
    windows and groups of a payload follow in the same task.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def long_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside hand narrow rows to Python, by the thousand; Spark still bounds a batch's bytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application)."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='emberframe-')}/emberframe", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables, reachable by all executors."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            root = tempfile.mkdtemp(prefix="emberframe-")
        _scratch[app] = f"{root.rstrip('/')}/emberframe-{app}-{uuid.uuid4().hex[:8]}"
    return _scratch[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
