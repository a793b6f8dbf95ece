"""Payload files read by spans, so that one length-prefixed file is the work of many tasks.

1. The driver lists the folder, every entry that is not a folder, whatever its
   name, as Spark's own file index would hold it.
2. ``file_spans``: one row per file finds out how it may be cut.  A message
   cannot begin with byte 0, since no field has number 0, so a file that does is
   a run of frames (of which the first has less than 16 MiB).  Only the four
   bytes in front of each frame are read, and about every ``span_bytes`` a new
   span starts at a frame.  Any other file is one span.
3. ``decode_spans``: spans are dealt to tasks; a task reads one frame at a time.

Rows are those of ``payloads.decode``: one per message, with its number in the
file.  An empty file is an empty message; a size in front of a frame that passes
the end of the file ends it with an error row.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.session import ship_package, stash
from emberframe.sources import codec

SPAN_BYTES = 16 << 20
_SPAN = "path string,whole boolean,first_no bigint,start bigint,stop bigint"
_FILE = "path string,length bigint"
#: Decoded rows are handed over when their frames have this many bytes.
_BATCH_BYTES = 1 << 20
_SCHEMES = ("file", "hdfs", "s3", "gs")


def readable(uri: str) -> bool:
    """Whether files at ``uri`` can be read by position: a scheme with such a reader, and no pattern."""
    return urlsplit(uri).scheme in _SCHEMES and not any(c in uri for c in "*?[{")


def _store(uri: str):
    """(file system, path in it)"""
    from pyarrow import fs

    if uri.startswith("file://"):
        return fs.LocalFileSystem(), uri.removeprefix("file://")
    return fs.FileSystem.from_uri(quote(uri, safe=":/@?&=+,~"))


def list_files(spark: SparkSession, uri: str) -> DataFrame:
    """(path, length) of a file or of every file directly inside a folder."""
    from pyarrow import fs

    store, root = _store(uri)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        rows = [(uri, info.size)]
    else:
        entries = store.get_file_info(fs.FileSelector(root))
        rows = [(f"{uri.rstrip('/')}/{x.base_name}", x.size) for x in entries if x.type == fs.FileType.File]
    return spark.createDataFrame(rows, _FILE)


def _cut(path: str, length: int, framed: bool, span_bytes: int) -> Iterator[tuple]:
    whole = (path, True, 0, 0, length)
    if not framed or length <= span_bytes:
        yield whole
        return
    store, name = _store(path)
    with store.open_input_file(name) as file:
        if file.read(1) != b"\0":
            yield whole
            return
        at = start = number = first = 0
        while at < length:
            if at - start >= span_bytes:
                yield path, False, first, start, at
                start, first = at, number
            file.seek(at)
            size = codec.frame_size(file.read(codec.PREFIX_BYTES))
            at = length if size is None else at + codec.PREFIX_BYTES + size
            number += 1
        yield path, False, first, start, length


def file_spans(files: DataFrame, framed: bool = True, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """(path, whole, first_no, start, stop) of the parts that are decoded by themselves."""
    schema = T.StructType.fromDDL(_SPAN)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(*(batch.column(c).to_pylist() for c in ("path", "length")), strict=True):
                spans = zip(*_cut(path, length, framed, span_bytes), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in spans], names=names)

    ship_package(files.sparkSession)
    return files.select("path", "length").mapInArrow(run, schema)


def _messages(path: str, whole: bool, first_no: int, start: int, stop: int, framed: bool) -> Iterator[tuple]:
    """(number in the file, bytes, message or error)"""
    store, name = _store(path)
    with store.open_input_file(name) as file:
        if whole:
            found = codec.read_messages(file.read(), framed)
        else:
            file.seek(start)
            found = codec.read_frames(file, stop)
        for i, (frame, message) in enumerate(found):
            yield first_no + i, frame, message


def decode_spans(spans: DataFrame, schema: T.StructType, framed: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """Nested rows of all spans, in columns filled for about a megabyte of frames at a time."""
    from emberframe.sources.payloads import arrow_schema, message_row

    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for span in batch.to_pylist():
                for number, frame, message in _messages(**span, framed=framed):
                    held.append(message_row(span["path"], number, frame, message, mode))
                    size += len(frame)
                    if size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    ship_package(spans.sparkSession)
    return spans.mapInArrow(run, schema)


def read_spans(
    spark: SparkSession, uri: str, schema: T.StructType, framed: bool = True, mode: str = "FAILFAST", span_bytes: int = SPAN_BYTES
) -> DataFrame:
    """Decode a file or folder; spans are dealt evenly, about ``span_bytes`` or more a task."""
    files = list_files(spark, uri)
    tasks = spark.sparkContext.defaultParallelism
    spans = stash(file_spans(files.repartition(tasks), framed, span_bytes), "spans")
    n, n_bytes = spans.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    return decode_spans(spans.repartition(max(1, min(n, max(tasks, n_bytes // span_bytes)))), schema, framed, mode)
