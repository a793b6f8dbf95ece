"""Web archives (WARC 1.1) compressed with Zstandard: one frame per record, the dictionary in front.

Layout of an archive: a skippable frame (magic 0x184D2A5D, 4-byte length) with
the dictionary, plain or itself compressed, then one Zstandard frame per record.
Without a dictionary the leading frame is missing.

``write_archives`` makes a record of every row.  Of rows with equal payloads of
at least ``least_bytes`` the one with the largest key is a response, the others
are revisits that refer to it and carry only their HTTP header.  Each task writes
its own files of about ``file_bytes`` under names of their own and reports them;
files of tasks that were lost or repeated are in no report and are never read.

``read_archives`` opens the reported files, streams them in small blocks, and
decodes one frame at a time.  It stops with the file and the record's place if a
frame is damaged, a header is malformed or missing, or a length, record number
or digest is wrong.

Payloads move once, to the join on digest that finds equal ones.  A very common
payload is split by the adaptive skew join, and its keys are reduced before.

Defined results: a null payload is empty; rows that tie at the largest key are
all responses; a null key is smaller than any other and reads back as null;
repeated rows give a record each; an empty table gives no archive and an empty
result; further columns are not read.  A record has to fit into memory.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm.common import map_rows, new_path, smallest_hashes
from emberframe.sources.payloads import qualified

_SKIPPABLE, _ZSTD, _DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest")
_ID = "urn:page:"


class WarcError(ValueError):
    pass


def record_id(key: int | None) -> str:
    return f"<{_ID}{'none' if key is None else key}>"


def key_of(record: str) -> int | None:
    if not (record.startswith(f"<{_ID}") and record.endswith(">")):
        raise WarcError(f"not a record number of these archives: {record}")
    body = record[len(_ID) + 1 : -1]
    return None if body == "none" else int(body)


def build_record(key: int | None, url: str, payload: bytes, digest: str, response: int | None, revisit: bool) -> bytes:
    """The bytes of one record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(response)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes, first: bytes) -> dict[str, str]:
    lines = raw.split(b"\r\n")
    if not lines[0].startswith(first):
        raise WarcError(f"starts with {lines[0][:40]!r}, not {first!r}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"malformed header line {line[:80]!r}")
        if name.decode("utf-8") in out:
            raise WarcError(f"header {name.decode()} appears twice")
        out[name.decode("utf-8")] = value.strip().decode("utf-8")
    return out


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(key, payload bytes, digest, type, key referred to, payload) of a record, after validation."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("the header has no end")
    named = _headers(head, b"WARC/1.1")
    if missing := [n for n in _NEEDED if n not in named]:
        raise WarcError(f"headers are missing: {', '.join(missing)}")
    length = named["Content-Length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length}, but {len(rest) - 4} bytes")
    block = rest[:-4]
    if named.get("WARC-Block-Digest", "") != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise WarcError("wrong block digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("the HTTP header has no end")
    size = _headers(http, b"HTTP/1.1 ").get("Content-Length", "")
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    kind, refers = named["WARC-Type"], None
    if not size.isdigit():
        raise WarcError("the HTTP header has no Content-Length")
    if kind == "response":
        if len(payload) != int(size) or hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("wrong payload length or digest")
    elif kind == "revisit":
        if payload or "WARC-Refers-To" not in named:
            raise WarcError("a revisit has a payload or refers to nothing")
        refers = key_of(named["WARC-Refers-To"])
    else:
        raise WarcError(f"unknown record type {kind}")
    return key_of(named["WARC-Record-ID"]), int(size), digest, kind, refers, payload


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; the dictionary is compressed in it."""
    packed = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", _SKIPPABLE, len(packed)) + packed


def read_frames(stream, block_bytes: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the records' frames of a readable stream."""
    head = stream.read(8)
    if not head:
        return
    if len(head) < 8:
        raise WarcError("the archive is shorter than a frame header")
    magic, length = struct.unpack("<II", head)
    place, dictionary, data = 0, None, head
    if magic == _SKIPPABLE:
        body = stream.read(length)
        if len(body) != length:
            raise WarcError(f"the dictionary frame has {len(body)} of {length} bytes")
        kind = int.from_bytes(body[:4], "little")
        if kind == _ZSTD:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            kind = int.from_bytes(body[:4], "little")
        if kind != _DICTIONARY:
            raise WarcError("the leading frame holds no dictionary")
        dictionary, place, data = zstandard.ZstdCompressionDict(body), 8 + length, b""
    maker = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        data = data or stream.read(block_bytes)
        if not data:
            return
        decoder, parts, used = maker.decompressobj(), [], 0
        while True:
            parts.append(decoder.decompress(data))
            used += len(data)
            if decoder.eof:
                break
            data = stream.read(block_bytes)
            if not data:
                raise WarcError(f"the frame at {place} has no end")
        data = decoder.unused_data
        used -= len(data)
        yield place, b"".join(parts)
        place += used


def _store(uri: str):
    """The file system of a folder and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def train_dictionary(
    pages: DataFrame, html_col: str = "html", rows: int = 400, row_bytes: int = 16_384, dictionary_bytes: int = 32_768
) -> bytes:
    """A dictionary from the starts of at most ``rows`` payloads, those with the smallest hash; empty if there is too little."""
    text = F.col(f"`{html_col}`")
    sample = pages.where(F.octet_length(text) > 0).select(F.substring(text, 1, row_bytes // 4).alias("t"))
    starts = [t.encode("utf-8", "replace") for t in smallest_hashes(sample, "t", rows)]
    try:
        return zstandard.train_dictionary(dictionary_bytes, starts).as_bytes() if len(starts) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def linked(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(id, url, payload, digest, response, revisit): equal large payloads know the largest key among them."""
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    large = rows.where(F.col("n") >= least_bytes)
    again = large.groupBy(F.col("digest").alias("d")).agg(F.max("id").alias("response"), F.count("*").alias("rows")).where("rows > 1")
    other = (F.col("n") >= least_bytes) & F.col("d").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    return rows.join(again, rows.digest == again.d, "left").select("id", "url", "payload", "digest", "response", other.alias("revisit"))


def write_archives(
    pages: DataFrame, uri: str, dictionary: bytes = b"", id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 1000, file_bytes: int = 32 << 20,
) -> DataFrame:
    """Write the rows below ``uri``; (file, records, bytes) of every archive.  The write runs when the result is read.

    A path without scheme lies where Spark's own writers put it.
    """
    uri = qualified(pages.sparkSession, uri)

    def rows(pages: Iterator[tuple]) -> Iterable[tuple]:
        store, root = _store(uri)
        store.create_dir(root, recursive=True)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True)
        out, name, n, size = None, "", 0, 0
        for key, url, payload, digest, response, revisit in pages:
            if out is None:
                name = f"{root}/pages-{uuid.uuid4().hex}.warc.zst"
                out, n, size = store.open_output_stream(name), 0, 0
                if known:
                    out.write(dictionary_frame(dictionary))
            frame = compressor.compress(build_record(key, url, payload, digest, response, revisit))
            out.write(frame)
            n, size = n + 1, size + len(frame)
            if size >= file_bytes:
                out.close()
                yield name, n, size
                out = None
        if out is not None:
            out.close()
            yield name, n, size

    return map_rows(linked(pages, id_col, url_col, html_col, least_bytes), rows, "file string, records bigint, bytes bigint")


def read_archives(files: DataFrame, uri: str, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all records of the ``file`` column."""
    uri = qualified(files.sparkSession, uri)

    def rows(names: Iterator[tuple]) -> Iterable[tuple]:
        store, _ = _store(uri)
        for name, records in names:
            n = 0
            with store.open_input_stream(name) as stream:
                for place, raw in read_frames(stream):
                    try:
                        *fields, payload = parse_record(raw)
                    except (WarcError, UnicodeDecodeError) as error:
                        raise WarcError(f"{name}, frame at {place}: {error}") from error
                    n += 1
                    yield (*fields, payload) if with_payload else tuple(fields)
            if n != records:
                raise WarcError(f"{name} has {n} of {records} records")

    ddl = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return map_rows(files.select("file", "records"), rows, ddl + (", payload binary" if with_payload else ""))


def archive_round_trip(spark: SparkSession, pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    uri = new_path(spark, "warc")
    manifest = new_path(spark, "warc-files")
    write_archives(pages, uri, train_dictionary(pages, columns.get("html_col", "html")), **columns).write.parquet(manifest)
    files = spark.read.schema("file string, records bigint, bytes bigint").parquet(manifest)
    # Largest archives first, a few per task.
    n = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism))
    return read_archives(files.repartitionByRange(n, "file"), uri)
