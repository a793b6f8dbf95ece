"""Payload files: listing, decoding, compressing, writing."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.operators.ordinals import grouped_ordinal
from emberframe.schema import NESTED
from emberframe.session import configure, long_batches, ship_package, stash
from emberframe.sources import codec
from emberframe.sources.encoder import messages, pieces
from emberframe.sources.nested import flatten
from emberframe.sources.payload_spans import SPAN_BYTES, list_files, read_spans, readable
from emberframe.tables import ProfileTables

_DECODED = [f.strip() for f in NESTED.split("payload_id bigint,")][1]


def list_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(id, path, length) of a file or of the files directly inside a folder, ids in path order from 1."""
    uri = qualified(spark, path)
    files = list_files(spark, uri) if readable(uri) else spark.read.format("binaryFile").load(path).select("path", "length")
    return grouped_ordinal(files, [], ["path"], "id", start=1, kind="bigint").select("id", "path", "length")


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def message_row(path: str, number: int, frame: bytes, message, mode: str) -> dict:
    """Row of a message, or of the error in its place; mode FAILFAST raises the error."""
    place = {"path": path, "frame_no": number, "n_bytes": len(frame)}
    if not isinstance(message, Exception):
        return place | {"error": None} | codec.to_row(message)
    if mode == "FAILFAST":
        raise ValueError(f"{path}, message {number}: {message}") from message
    return place | {"error": f"{type(message).__name__}: {message}"}


def decode(files: DataFrame, framed: bool = True, mode: str = "PERMISSIVE") -> DataFrame:
    """Decode ``path, content`` rows into nested rows, one per message.

    ``framed`` also accepts length-prefixed files.  What cannot be decoded, a
    message or a frame, becomes a row with ``error`` set and leaves the other
    frames of its file alone; mode FAILFAST raises instead.
    """
    schema = T.StructType.fromDDL(_DECODED)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                for number, (frame, message) in enumerate(codec.read_messages(data.as_py(), framed)):
                    yield pa.RecordBatch.from_pylist([message_row(path, number, frame, message, mode)], schema=arrow)

    ship_package(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, schema)


def read_nested(
    spark: SparkSession, path: str, framed: bool = True, mode: str = "FAILFAST", span_bytes: int = SPAN_BYTES
) -> DataFrame:
    """Decoded rows of a file or folder, stored once as Parquet.

    A file that cannot be decoded stops the job, naming its path.  With mode
    PERMISSIVE it becomes a row of ``decode_errors`` instead.

    Files are read by spans (``payload_spans``).  Paths with a pattern or a scheme
    without a reader by position are read whole by Spark, which leaves out files
    whose names start with ``_`` or ``.``.  Decoding cannot be pruned or pushed
    down, so it runs once; later reads prune the stored nested columns.
    """
    configure(spark)
    uri = qualified(spark, path)
    if readable(uri):
        decoded = read_spans(spark, uri, T.StructType.fromDDL(_DECODED), framed, mode, span_bytes)
    else:
        decoded = decode(spark.read.format("binaryFile").load(path), framed, mode)
    decoded = decoded.withColumn("payload_id", F.monotonically_increasing_id())
    return stash(decoded.select("payload_id", *[c for c in decoded.columns if c != "payload_id"]), "decoded")


def read_payloads(spark: SparkSession, path: str, framed: bool = True, mode: str = "FAILFAST") -> ProfileTables:
    return flatten(read_nested(spark, path, framed, mode))


def decode_errors(nested: DataFrame) -> DataFrame:
    return nested.where("error IS NOT NULL").select("path", "error")


def measured_sizes(t: ProfileTables) -> DataFrame:
    """(payload_id, uncompressed_bytes, gzip_6_bytes) of the encoded messages of every payload."""
    return measured_variants({"": t})[""]


def measured_variants(variants: dict[str, ProfileTables]) -> dict[str, DataFrame]:
    """``measured_sizes`` of tables of the same payloads, by name; frames that they share are encoded and moved once."""
    schema = "variant int,payload_id bigint,n bigint,z bigint"
    arrow = arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in messages(batches):
            whole = [m.as_buffer() for m in batch.column("message")]
            sizes = [pa.array([m.size for m in whole], pa.int64()),
                     pa.array([len(gzip.compress(m, 6, mtime=0)) for m in whole], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("variant"), batch.column("payload_id"), *sizes], schema=arrow)

    rows = pieces(*variants.values())
    ship_package(rows.sparkSession)
    with long_batches(rows.sparkSession):
        sizes = stash(rows.mapInArrow(run, T.StructType.fromDDL(schema)), "measured-sizes")
    return {name: sizes.where(F.col("variant") == i).select(
        "payload_id", F.col("n").alias("uncompressed_bytes"), F.col("z").alias("gzip_6_bytes")) for i, name in enumerate(variants)}


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark's readers take for it."""
    if "://" in path:
        return path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def write_payload_files(messages: DataFrame, uri: str, framed: bool = False) -> DataFrame:
    """Write messages below ``uri`` and return the written (file, n_messages).

    Plain: one file per message.  Framed: one length-prefixed file per
    ``file_no`` text; callers keep the number of messages per ``file_no`` small.
    Names depend only on the keys, so a repeated task rewrites the same file.
    """
    if framed:
        prefixed = F.concat(F.unhex(F.lpad(F.hex(F.octet_length("message")), 8, "0")), F.col("message"))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("payload_id", prefixed.alias("m")))), lambda x: x["m"])
        body = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))
        files = messages.groupBy("file_no").agg(body.alias("body"), F.count("*").alias("n_messages")).select(
            F.concat(F.lit("frames-"), F.col("file_no"), F.lit(".bin")).alias("file"),
            "body", "n_messages")
    else:
        name = F.concat(F.lit("payload-"), F.lpad(F.col("payload_id").cast("string"), 12, "0"), F.lit(".bin"))
        files = messages.select(name.alias("file"), F.col("message").alias("body"), F.lit(1).cast("bigint").alias("n_messages"))
    ddl = "file string,n_messages bigint"
    uri = qualified(messages.sparkSession, uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, body in zip(batch.column("file").to_pylist(), batch.column("body")):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(body.as_py())
            yield batch.select(["file", "n_messages"])

    return files.mapInArrow(run, T.StructType.fromDDL(ddl))
