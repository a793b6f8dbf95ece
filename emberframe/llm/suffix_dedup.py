"""Removal of passages that repeat byte for byte: prefix doubling on sampled suffixes.

A byte goes if a string of ``LENGTH`` (200) bytes that covers it also starts
anywhere else.  All such strings ("windows") are judged, exactly.

Prefix doubling gives every position a rank by its first bytes and doubles their
number by pairing it with the rank at a growing offset, until ranks are unique or
long enough.  Ranking every byte of the corpus would move about a hundred times
its size, so the positions are sampled so that no window is missed:

1. Texts that are equal are one text with a weight of two; all of their bytes go,
   but others may repeat them.
2. Every window has a sample: of its 128 grams of 73 bytes, the one with the least
   hash, the first of equals.  Equal windows have the same sample at the same
   offset.  Windows with the same sample are neighbours, and there is one sample in
   about 64 bytes.  A rank is counted over all samples; a unique gram means that
   none of its windows repeats, and ends there (nearly all text does).
3. For the others, Spark groups (rank, span) pairs.  The rank stands for the bytes
   that all windows of a sample at certain offsets have in common, the span for all
   bytes that these windows cover.  A unique rank: no window repeats.  A span that
   occurs twice: all windows repeat.  Else the offsets are halved, and each half's
   rank is paired with the next 64, then 32, 16, ... 1 bytes, right of the common
   bytes for the smaller offsets, left of them for the larger ones.  After the last
   step rank and span are one window.
4. The windows found are joined to spans of removed bytes per text.

Only ranks of one span each go to the next round, so that groups of any size are
counted with partial aggregation and never gathered.  Ranks are 128-bit digests of
(rank, bytes), equal exactly if the bytes are, and not order numbers: they need
no global sort to be assigned, and a repeated task gives the same.

A bitmap of bounded size (32 MB) of repeated grams keeps other samples out of the
shuffles; one it lets through needlessly only costs time.  Texts are scanned three
times and shuffled only where bytes of them go.

Defined results: a null text is empty; texts shorter than a window keep all bytes,
also where they are equal; rows with equal texts have equal results, whatever
their ids, null included; an empty table gives an empty result; further columns are
not read.  Long texts are scanned in pieces of 256 kB; one task must hold a text
and its spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import map_rows, stash
from emberframe.session import ship_package

LENGTH = 200
_OFFSETS = 128  # a power of two
_GRAM = LENGTH - _OFFSETS + 1
_PIECE = 1 << 18  # windows hashed at once
_PLACE = np.uint64((1 << 20) - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MAX_BITS = 1 << 28


# --- samples ------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number per byte value, powers of the multiplier and of its inverse (modulo 2^64)."""
    size = 2 * _PIECE + LENGTH + 1
    powers = []
    for base in (_MULTIPLIER, np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))):
        factors = np.full(size, base)
        factors[0] = 1
        powers.append(np.multiply.accumulate(factors))
    draw = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64)
    return draw * np.uint64(2) + np.uint64(1), *powers


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``_GRAM`` bytes from every position."""
    values, up, down = _tables()
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    h = (sums[_GRAM:] - sums[:-_GRAM]) * down[: n - _GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _samples(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, hash) of the samples of texts that end at ``ends`` in ``data``."""
    with np.errstate(over="ignore"):
        hashes = _gram_hashes(data)
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    step = 1
    while step < _OFFSETS:  # least of 2, 4, ... neighbours
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    place = (least & _PLACE).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int64)  # windows that cross an end of a text are none
    starts = np.concatenate(([0], ends[:-1]))
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.maximum(ends - LENGTH + 1, starts), -1)
    window = np.flatnonzero(np.cumsum(inside)[: len(place)] > 0)
    place = place[window]
    first = np.flatnonzero(np.concatenate((place[:1] == place[:1], place[1:] != place[:-1])))
    last = np.append(first[1:], len(place)) - 1 if len(place) else first
    return place[first], window[first], window[last], hashes[place[first]]


def _sampled(texts: Iterator[tuple[object, bytes]]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, index of the text, place, first, last window, hash): samples of whole texts, many texts at a time."""
    held, size = [], 0
    for key, text in texts:
        if len(text) < LENGTH:
            continue
        if len(text) > _PIECE:
            yield [(key, text)], *_long(text)
            continue
        held.append((key, text))
        size += len(text)
        if size >= _PIECE:
            yield held, *_joined(held)
            held, size = [], 0
    if held:
        yield held, *_joined(held)


def _joined(held: list) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(t) for _, t in held])
    ends = np.cumsum(sizes)
    place, first, last, h = _samples(np.frombuffer(b"".join(t for _, t in held), np.uint8), ends)
    of = np.searchsorted(ends, place, "right")
    start = (ends - sizes)[of]
    return of, place - start, first - start, last - start, h


def _long(text: bytes) -> tuple[np.ndarray, ...]:
    """Samples of a text taken piece by piece; one whose windows lie in two pieces is joined."""
    parts = []
    for at in range(0, len(text) - LENGTH + 1, _PIECE):
        data = np.frombuffer(text[at : at + _PIECE + LENGTH - 1], np.uint8)
        place, first, last, h = _samples(data, np.array([len(data)]))
        parts.append((place + at, first + at, last + at, h))
    place, first, last, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return np.zeros(len(new), np.int64), place[new], first[new], last[np.append(new[1:], len(place)) - 1], h[new]


# --- scans --------------------------------------------------------------------------


class Texts:
    """Distinct texts as rows (key, weight, mark, text): all rows but those whose mark is in a bitmap, and distinct copies."""

    def __init__(self, rows: DataFrame, copied: DataFrame, bitmap):
        self.frame, self.bitmap = rows.unionAll(copied), bitmap

    def reader(self):
        bitmap = self.bitmap

        def read(rows: Iterable[tuple]) -> Iterator[tuple[tuple[bytes, int], bytes]]:
            for key, weight, mark, text in rows:
                if mark is None or not _is_set(bitmap.value, np.array([mark]).view(np.uint64))[0]:
                    yield (key, weight), text

        return read


def _grams(texts: Texts) -> DataFrame:
    """The hash of every sample's gram."""
    ship_package(texts.frame.sparkSession)
    read = texts.reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
        for *_, h in _sampled(read(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return texts.frame.mapInArrow(run, T.StructType.fromDDL("h bigint"))


def _bitmap(hashes: DataFrame, rows: int) -> np.ndarray:
    """One bit per value of ``h``: 16 bits a row, up to a fixed size."""
    bits = min(_MAX_BITS, max(1 << 16, 1 << (16 * rows).bit_length()))
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    found = hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(mask).alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return out


def _is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = (hashes & np.uint64(64 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) == 1


def _digest(*parts: bytes) -> bytes:
    return hashlib.md5(b"".join(parts), usedforsecurity=False).digest()


def _names(held: list, of: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of every sample's text and place."""
    starts = np.array([int.from_bytes(key[:8], "little") for (key, _), _ in held], np.uint64)[of]
    h = ((place.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER ^ starts) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _candidates(texts: Texts, bitmap) -> DataFrame:
    """(key, weight, place, low, high, rank, span, h): the samples whose gram is in the bitmap; windows start ``low`` to ``high`` before."""
    read = texts.reader()

    def rows(parts: Iterator[tuple]) -> Iterable[tuple]:
        for held, of, place, first, last, h in _sampled(read(parts)):
            chosen = np.flatnonzero(_is_set(bitmap.value, h))
            names = _names(held, of[chosen], place[chosen]).view(np.int64)
            for i, x, a, b, name in zip(*(v.tolist() for v in (of[chosen], place[chosen], first[chosen], last[chosen], names)), strict=True):
                (key, weight), text = held[i]
                yield (key, weight, x, x - b, x - a, _digest(text[x : x + _GRAM]),
                       _digest(b"%d,%d:" % (x - b, x - a), text[a : b + LENGTH]), name)

    return map_rows(texts.frame, rows, "key binary, weight int, place bigint, low int, high int, rank binary, span binary, h bigint")


def _bodies(texts: Texts, bitmap) -> DataFrame:
    """(key, place, body): the bytes that the windows of a sample in the bitmap cover."""
    read = texts.reader()

    def rows(parts: Iterator[tuple]) -> Iterable[tuple]:
        for held, of, place, first, last, _ in _sampled(read(parts)):
            for i in np.flatnonzero(_is_set(bitmap.value, _names(held, of, place))).tolist():
                (key, _), text = held[of[i]]
                yield key, int(place[i]), text[first[i] : last[i] + LENGTH]

    return map_rows(texts.frame, rows, "key binary, place bigint, body binary")


def _chosen(rows: DataFrame, bitmap) -> DataFrame:
    """(key, text) of the rows whose mark is in the bitmap."""

    def found(parts: Iterator[tuple]) -> Iterable[tuple]:
        for key, mark, text in parts:
            if _is_set(bitmap.value, np.array([mark]).view(np.uint64))[0]:
                yield key, text

    return map_rows(rows.select("key", "mark", "text"), found, "key binary, text binary")


# --- rounds -------------------------------------------------------------------------

_FOUND = ["key", "place", "low", "high"]


def _judged(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` whose rank isn't unique, with n (how often the span occurs) and mixed (if a span of the rank occurs once)."""
    spans = rows.groupBy("rank", "span").agg(F.sum("weight").alias("n"))
    spans = stash(spans, f"{label}-spans")
    ranks = spans.groupBy("rank").agg(F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1")
    kept = spans.join(ranks.select("rank", (F.col("least") == 1).alias("mixed")), "rank").drop("rank")  # the span determines it
    return stash(rows.join(kept, "span"), label)


def _representatives(judged: DataFrame) -> DataFrame:
    """Of mixed ranks: spans that occur once, and one of each that occurs more often, of weight two."""
    mixed = judged.where("mixed")
    return mixed.where("n = 1").drop("n", "mixed").unionAll(
        mixed.where("n > 1").dropDuplicates(["span"]).withColumn("weight", F.lit(2)).drop("n", "mixed"))


def _cut(start: Column, length: Column) -> Column:
    return F.substring(F.col("body"), start + 1, length)


def _halved(rows: DataFrame, width: int) -> DataFrame:
    """The halves, of ``width`` offsets each, of rows whose offsets are a block of twice as many."""
    low, high = F.col("low"), F.col("high")
    base = (low - low % (2 * width)).cast("int")
    # The body starts ``high`` bytes before the sample; the common bytes reach from ``base`` before it on.
    right = _cut(high - base + LENGTH + 1 - 2 * width, F.lit(width))
    left = _cut(high - base - width, F.lit(width))

    def half(at: Column, side: str, more: Column) -> DataFrame:
        lower, upper = F.greatest(low, at), F.least(high, at + width - 1)
        part = _cut(high - upper, upper - lower + LENGTH)
        return rows.where(lower <= upper).select(
            "key", "weight", "place", lower.cast("int").alias("low"), upper.cast("int").alias("high"),
            F.unhex(F.md5(F.concat(F.col("rank"), F.lit(side).cast("binary"), more))).alias("rank"),
            F.unhex(F.md5(F.concat(F.concat_ws(",", lower.cast("string"), upper.cast("string"), F.lit("")).cast("binary"), part))).alias("span"), part.alias("body"))

    return half(base, "r", right).unionAll(half(base + width, "l", left))


def repeated_windows(texts: Texts) -> DataFrame:
    """(key, place, low, high): windows that start ``low`` to ``high`` bytes before ``place`` occur more than once; of texts of weight one."""
    spark = texts.frame.sparkSession
    grams = stash(_grams(texts).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "grams")
    bitmap = spark.sparkContext.broadcast(_bitmap(grams, grams.count()))
    judged = _judged(stash(_candidates(texts, bitmap), "candidates"), "round-0")
    found = [judged.where("n > 1 AND weight = 1").select(_FOUND)]

    chosen = _representatives(judged)
    named = stash(chosen, "representatives")
    rows = named.count()
    if rows:
        bitmap = spark.sparkContext.broadcast(_bitmap(named.select("h"), rows))
        now = stash(named.drop("h", "span").join(_bodies(texts, bitmap), ["key", "place"]), "bodies")
        width = _OFFSETS // 2
        while width:
            judged = _judged(_halved(now, width), f"round-{width}")
            found.append(judged.where("n > 1 AND weight = 1").select(_FOUND))
            now = _representatives(judged).drop("span")
            width //= 2
            if width and judged.where("mixed").isEmpty():
                break
    return reduce(DataFrame.unionAll, found)


# --- documents ----------------------------------------------------------------------


def _merged(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of sorted (start, end) spans."""
    out: list[list[int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _cleaned(texts: DataFrame, with_text: bool) -> DataFrame:
    """What is left of the texts with spans (starts, ends)."""

    def rows(parts: Iterator[tuple]) -> Iterable[tuple]:
        for key, text, spans in parts:
            runs = _merged([(s["a"], s["b"]) for s in spans])
            kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(text)], strict=True))
            yield key, sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else None

    return map_rows(texts, rows, "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and the bytes that are left (``kept``) if asked for."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    sha = F.sha2("text", 256)
    keyed = rows.select("id", F.unhex(F.substring(sha, 1, 32)).alias("key"), F.octet_length("text").cast("bigint").alias("n_bytes"),
                        sha.alias("sha"))
    keyed = stash(keyed, "keys")
    copies = stash(keyed.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")

    # Texts that may be copies, by a bitmap, are made distinct; the others are.
    mark = F.xxhash64("key")
    bitmap = spark.sparkContext.broadcast(_bitmap(copies.select(mark.alias("h")), copies.count()))
    long = rows.where(F.octet_length("text") >= LENGTH).select(F.unhex(F.substring(sha, 1, 32)).alias("key"), "text").select(
        "key", F.lit(1).alias("weight"), mark.alias("mark"), "text")
    again = _chosen(long, bitmap).groupBy("key").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("weight"), F.first("text").alias("text"))
    again = stash(again.select("key", "weight", F.lit(None).cast("bigint").alias("mark"), "text"), "copied")

    windows = repeated_windows(Texts(long, again, bitmap))
    spans = windows.groupBy("key").agg(F.sort_array(F.collect_set(F.struct(
        (F.col("place") - F.col("high")).alias("a"), (F.col("place") - F.col("low") + LENGTH).alias("b")))).alias("spans"))
    spans = stash(spans, "spans")
    touched = spark.sparkContext.broadcast(_bitmap(spans.select(mark.alias("h")), spans.count()))
    cleaned = stash(_cleaned(_chosen(long, touched).join(spans, "key"), with_text), "cleaned")

    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)
    out = keyed.join(cleaned, "key", "left").join(copies, "key", "left").select(
        "id", "key", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"))
    if not with_text:
        return out.drop("key", "kept")
    whole = rows.withColumn("key", F.unhex(F.substring(sha, 1, 32))).dropDuplicates(["key"]).select("key", "text")
    return out.join(whole, "key", "left").withColumn("kept", F.coalesce("kept", "text")).drop("key", "text")
