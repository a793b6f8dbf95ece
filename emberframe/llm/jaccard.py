"""Exact n-gram Jaccard join as a blocked sparse product of the document-shingle incidence matrix with its transpose.

A document is the set of its distinct word shingles, as 64-bit hashes.  Two
documents link if their sets' Jaccard similarity is at least ``percent`` %.

1. One scan gives every row its number of shingles and the key of its word
   sequence, and counts shingles in a table of fixed size (a counting sketch over
   all documents, merged by summing).  Rows with equal keys are one class,
   represented by the smallest id.
2. Columns of the matrix are ordered by (order of magnitude of the sketched
   count, hash), rare ones first.  Two sets of sizes n that reach the similarity
   share one of their first n - ceil(percent n / 100) + 1 columns, so only these
   entries of the representatives form the product; they are shuffled once, in
   blocks of equal columns.  The sketch only orders columns: any order gives the
   same result, and frequent passages come last and stay out of the product.
3. Every column ties its documents to its smallest one; the distinct ties of
   suitable sizes are checked by exact overlap.  This is linear in the size of a
   group of near copies.  Links so found give components.
4. Columns whose documents are not yet all in one component multiply out the
   pairs of different components, where enough columns are left in both for the
   size-derived bound; overlap counts are accumulated per pair, and pairs whose
   count plus remaining columns stays below the bound are discarded.  The rest are checked exactly.  Links between documents of the
   same component would change nothing and are not formed.

For exact checks, texts of the documents in question are read again, compressed,
and joined to the pairs.  A bitmap of bounded size keeps other texts out of
these shuffles; a text that it lets through needlessly only costs time.

Defined results: a null, empty or blank text has no shingles and is its own
component; a text shorter than a shingle is one shingle; rows with a null id link
with nothing and have a null component; rows that share an id count as one
document with either text; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import map_rows, stash, text_table
from emberframe.llm.components import smallest_reachable
from emberframe.llm.shingles import sequence_key, shingle_set, words_of
from emberframe.session import ship_package

_CELLS = 1 << 21  # of the counting sketch
_BLOCK = 1 << 13
_SHIFT = np.uint64(64 - 21)
_STEPS = 8  # of magnitude per factor of two
_MAX_BITS = 1 << 28  # of a bitmap: 32 MB at most


# --- first scan: sizes, sequence keys, sketch --------------------------------------


def _keys_and_counts(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, key) of every row, and (task, block, counts) of the tasks' sketches."""

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        counts = np.zeros(_CELLS, np.uint32)
        for key, text in texts:
            words = words_of(text)
            found = shingle_set(words, width)
            np.add.at(counts, (found >> _SHIFT).astype(np.int64), 1) if len(found) < 64 else _count(counts, found)
            yield key, len(found), sequence_key(words), None, None, None
        task = TaskContext.get().partitionId()
        for block in range(_CELLS // _BLOCK):
            part = counts[block * _BLOCK : (block + 1) * _BLOCK]
            if part.any():
                yield None, None, None, task, block, zlib.compress(part.tobytes(), 1)

    return map_rows(docs, rows, f"id {dict(docs.dtypes)['id']}, n bigint, key binary, task int, block int, counts binary")


def _count(counts: np.ndarray, found: np.ndarray) -> None:
    cells, times = np.unique((found >> _SHIFT).astype(np.int64), return_counts=True)
    counts[cells] += times.astype(np.uint32)


def _magnitudes(scanned: DataFrame) -> np.ndarray:
    """Order of magnitude (a multiple of log2) of every cell of the summed sketch: one byte per cell."""
    schema = "task int, block int, counts binary"

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_BLOCK, np.uint32)
        for packed in group["counts"]:
            total += np.frombuffer(zlib.decompress(packed), np.uint32)
        return pd.DataFrame({"task": [int(group["task"].iloc[0])], "block": [int(group["block"].iloc[0])],
                             "counts": [zlib.compress(total.tobytes(), 1)]})

    parts = scanned.where("block IS NOT NULL").select("task", "block", "counts")
    parts = parts.withColumn("task", F.col("task") % 64).groupBy("block", "task").applyInPandas(add, schema)
    out = np.zeros(_CELLS, np.uint8)
    for row in parts.groupBy("block").applyInPandas(add, schema).select("block", "counts").collect():
        total = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
        out[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.minimum(255, _STEPS * np.log2(np.maximum(total, 1))).astype(np.uint8)
    return out


# --- bitmaps of ids -----------------------------------------------------------------


def _bit(bits: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(bits))


def _bitmap(ids: DataFrame, rows: int) -> np.ndarray:
    """One bit per hash of ``ids`` (a long column): 16 bits a row, up to a fixed size."""
    bits = min(_MAX_BITS, max(1 << 16, 1 << (16 * rows).bit_length()))
    found = ids.select(_bit(bits).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(64)).cast("int"))).alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return out


def _is_set(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) == 1


# --- the product --------------------------------------------------------------------


def _entries(docs: DataFrame, bitmap: np.ndarray, magnitude: np.ndarray, width: int, percent: int) -> DataFrame:
    """(h, id, n, pos): the first columns of every document in the bitmap."""
    ship_package(docs.sparkSession)
    fields = T.StructType.fromDDL("id bigint, n int, columns array<bigint>")
    arrow = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("columns", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = np.flatnonzero(_is_set(bitmap, batch.column("bit").to_numpy()))
            for at in range(0, len(chosen), 512):
                ids, sizes, parts = [], [], []
                for i in chosen[at : at + 512].tolist():
                    found = shingle_set(words_of(batch.column("text")[i].as_py()), width)
                    n = len(found)
                    if not n:
                        continue
                    first = n - -(-percent * n // 100) + 1
                    order = np.lexsort((found, magnitude[(found >> _SHIFT).astype(np.int64)]))[:first]
                    ids.append(batch.column("id")[i].as_py())
                    sizes.append(n)
                    parts.append(found[order].view(np.int64))
                offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, values)], schema=arrow)

    source = docs.where("id IS NOT NULL").select("id", "text", _bit(64 * len(bitmap)).alias("bit"))
    return source.mapInArrow(run, fields).select("id", "n", F.posexplode("columns").alias("pos", "h")).select("h", "id", "n", "pos")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _needed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of sets of these sizes: 100 i >= percent (a + b - i)."""
    return percent * (a + b) / (100 + percent)


def _verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity.  ``b`` may repeat little, ``a`` often."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id")))
    bitmap = _bitmap(ids, 2 * pairs.count())

    def pack(rows: Iterator[tuple]) -> Iterable[tuple]:
        for key, text, bit in rows:
            if (bitmap[bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1):
                yield key, zlib.compress(b" ".join(words_of(text)), 1)

    texts = map_rows(docs.where("id IS NOT NULL").select("id", "text", _bit(64 * len(bitmap)).alias("bit")), pack, "id bigint, body binary")
    texts = stash(texts, "texts")
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("body").alias("b_body")), "b")
    with_both = with_b.join(texts.select(F.col("id").alias("a"), F.col("body").alias("a_body")), "a")

    def check(rows: Iterator[tuple]) -> Iterable[tuple]:
        held, known = None, np.zeros(0, np.uint64)
        for a, a_body, b, b_body in rows:
            if a_body != held:
                held, known = a_body, shingle_set(zlib.decompress(a_body).split(), width)
            other = shingle_set(zlib.decompress(b_body).split(), width)
            both = len(np.intersect1d(known, other, assume_unique=True))
            if 100 * both >= percent * (len(known) + len(other) - both):
                yield a, b

    return stash(map_rows(with_both.select("a", "a_body", "b", "b_body"), check, "a bigint, b bigint").distinct(), "links")


def link_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id, class_id) of every row; ``class_id`` is the smallest id with the same words."""
    docs = text_table(docs, id_col, text_col).withColumn("id", F.col("id").cast("bigint"))
    scanned = stash(_keys_and_counts(docs, width), "keys")
    keys = scanned.where("block IS NULL").select("id", "n", "key")
    magnitude = _magnitudes(scanned)
    classes = stash(keys.where("id IS NOT NULL AND n > 0").groupBy("key").agg(F.min("id").alias("class_id")), "classes")
    bitmap = _bitmap(classes.select(F.col("class_id").alias("id")), classes.count())

    entries = _entries(docs, bitmap, magnitude, width, percent)
    entries = entries.repartition("h")  # one shuffle for both uses
    hubs = entries.groupBy("h").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("df")).where("df > 1")
    shared = stash(entries.join(hubs.select("h", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "h"), "product")

    ties = shared.where((F.col("id") != F.col("hub")) & _sizes_fit(F.col("n"), F.col("hub_n"), percent)).select(
        F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = _verify(stash(ties, "ties"), docs, width, percent)
    roots = stash(smallest_reachable(links), "roots")

    rooted = shared.select("h", "id", "n", "pos").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn(
        "root", F.coalesce("root", "id"))
    rooted = stash(rooted, "rooted")
    open_ = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    rest = rooted.join(open_, "h", "left_semi")
    x, y = (rest.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "pos", "root")]) for s in "ab")
    n_a, n_b, p_a, p_b = (F.col(c) for c in ("n_a", "n_b", "pos_a", "pos_b"))
    left = F.least(n_a - p_a, n_b - p_b)  # this column and those behind it
    product = x.join(y, "h").where(
        (F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & _sizes_fit(n_a, n_b, percent)
        & (left >= _needed(n_a, n_b, percent)))  # holds for the first column that a similar pair shares, and all before it
    counted = product.groupBy("id_a", "id_b", "n_a", "n_b").agg(
        F.count("*").alias("c"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b"))
    open_pairs = counted.where(F.col("c") - 1 + left >= _needed(n_a, n_b, percent)).select(
        F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    more = _verify(stash(open_pairs, "pairs"), docs, width, percent)
    roots = stash(smallest_reachable(links.unionAll(more)), "roots")

    grouped = classes.join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left").select(
        "key", "class_id", F.coalesce("root", "class_id").alias("component"))
    return keys.join(grouped, "key", "left").select(
        "id", F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, broadcast_rows: int = 2_000_000
) -> DataFrame:
    """One document of each component, the one with the smallest id; rows without shingles or id stay.

    Of rows that repeat the id of a kept document, one stays (that with the
    smallest values).  The ids to remove are broadcast if they are at most
    ``broadcast_rows``; beyond, the rows are shuffled to them.
    """
    linked = stash(link_documents(docs, id_col, text_col, width, percent), "linked")
    lost = linked.where("component_id <> id").select(F.col("id").alias("_lost")).distinct()
    lost = stash(lost, "lost")
    if lost.count() <= broadcast_rows:
        lost = F.broadcast(lost)
    kept = docs.join(lost, F.col(f"`{id_col}`") == F.col("_lost"), "left_anti")
    again = linked.where("n_shingles > 0 AND component_id = id").groupBy("id").count().where("count > 1")
    return kept if again.isEmpty() else _first_rows(kept, again, id_col)


def _first_rows(docs: DataFrame, again: DataFrame, id_col: str) -> DataFrame:
    """Rows whose key is in ``again`` are reduced to the smallest one by value."""
    row = docs.select(F.col(f"`{id_col}`").alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    keys = again.select(F.col("id").alias("_key"))
    once = row.join(keys, "_key", "left_anti").select("_row").unionAll(
        row.join(keys, "_key", "left_semi").groupBy("_key").agg(F.min("_row").alias("_row")).select("_row"))
    return once.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
