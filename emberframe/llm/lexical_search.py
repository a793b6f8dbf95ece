"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to a few owners.  For every block of documents a bundle of items
passes the owners one after the other; it carries a sparse accumulator per item
(documents of the block and their scores so far), and each owner adds its terms'
integer contributions.  The last owner selects a block's best documents.

1. Items are taken in groups of about ``group_bytes`` of text, each with its own
   vocabulary, which is sent to every task; so its size is bounded, whatever the
   number of items.  The following steps run once per group.
2. One scan over the documents splits whole texts into terms and writes, per
   block of documents, the postings of the group's terms.  From these the counts
   N, L and df, then the largest contribution of each term, are summed up.
3. The terms are ordered by df.  The first owner has the rarest ones, with 5 % of
   all postings, the second those up to 30 %, the last the rest.
4. Owner by owner, bundles and postings meet by block in a ``cogroup``.  A bundle
   leaves an owner with the documents that can still be among the block's ``top``:
   if ``top`` documents already have a score of s, one that cannot reach s with the
   largest contributions of all later terms is left out.  This bound is exact: what
   is left out, and met again later with too low a score, stays below s.
5. ``top`` rows per block and item are ranked per item.

The bundles grow with blocks x items x about ``top``, not with matching documents;
a frequent term's postings are spread over blocks.

Defined results: a null text has no term; an item without terms, or without
documents that score above 0, has no row; equal scores rank by id, null last;
repeated rows are documents, and items, of their own, so that rows with the same
item id are each ranked from 1 (by ``item_row``); an empty table gives no row;
very long texts are split a megabyte at a time; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import map_rows, stash
from emberframe.session import ship_package

_SHARES = (0.05, 0.3, 1.0)  # of all postings that the owners up to this one have
_CHUNK = 1 << 20
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of UTF-8 text, a bounded number at a time: runs of ASCII letters, digits and all other characters, A-Z in lower case."""
    at = 0
    while at < len(text):
        part = text[at : at + _CHUNK].translate(_LETTERS)
        at += len(part)
        while at < len(text) and part[-1] != 32:  # the last term goes on
            more = text[at : at + _CHUNK].translate(_LETTERS)
            end = more.find(32)
            part += more if end < 0 else more[: end + 1]
            at += len(more) if end < 0 else end + 1
        yield part.split()


# --- items --------------------------------------------------------------------------


def _item_groups(items: DataFrame, item_col: str, text_col: str, group_bytes: int) -> Iterator[list[tuple[int, int, Counter]]]:
    """Lists of (row number, item id, terms), a bounded part of the items at a time."""
    numbered = stash(items.select(
        F.col(f"`{item_col}`").alias("item"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"),
        F.monotonically_increasing_id().alias("row")), "items")
    size = numbered.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    groups = -(-size // group_bytes)
    for group in range(groups):
        chosen = numbered.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == group).orderBy("row").collect()
        counted = [(r["row"], r["item"], sum((Counter(part) for part in terms_of(bytes(r["text"]))), Counter())) for r in chosen]
        yield [x for x in counted if x[2]]


# --- postings -----------------------------------------------------------------------


def _blocks(docs: DataFrame, vocabulary, block_docs: int) -> DataFrame:
    """One row per block: documents, their numbers of terms, and (term, place, tf) of the vocabulary's terms, by term."""

    def packed(block: int, ids: list, sizes: list, terms: list, places: list, tfs: list) -> tuple:
        terms, places, tfs = (np.concatenate([*x, np.zeros(0, np.int32)]).astype(np.int32) for x in (terms, places, tfs))
        order = np.argsort(terms, kind="stable")
        none = np.array([i for i, key in enumerate(ids) if key is None], np.int32)
        ids = np.array([0 if key is None else key for key in ids], np.int64)
        return (block, ids.tobytes(), none.tobytes(), np.array(sizes, np.int64).tobytes(),
                *(x[order].tobytes() for x in (terms, places, tfs)))

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        number = vocabulary.value
        block = TaskContext.get().partitionId() << 32
        held: tuple[list, ...] = ([], [], [], [], [])
        for key, text in texts:
            found, n = Counter(), 0
            for part in terms_of(text or b""):
                n += len(part)
                found.update(filter(number.__contains__, part))
            held[0].append(key)
            held[1].append(n)
            held[2].append(np.array([number[t] for t in found], np.int32))
            held[3].append(np.full(len(found), len(held[0]) - 1, np.int32))
            held[4].append(np.fromiter(found.values(), np.int32, len(found)))
            if len(held[0]) == block_docs:
                yield packed(block, *held)
                held, block = ([], [], [], [], []), block + 1
        if held[0]:
            yield packed(block, *held)

    return map_rows(docs, rows, "block bigint, ids binary, no_id binary, sizes binary, terms binary, places binary, tfs binary")


def _counts(blocks: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and df of every term."""

    def rows(parts: Iterator[tuple]) -> Iterable[tuple]:
        df, some, total = np.zeros(n_terms, np.int64), 0, 0
        for sizes, terms in parts:
            sizes = np.frombuffer(sizes, np.int64)
            some, total = some + int((sizes > 0).sum()), total + int(sizes.sum())
            df += np.bincount(np.frombuffer(terms, np.int32), minlength=n_terms)
        yield -1, some, total
        for term in np.flatnonzero(df).tolist():
            yield term, int(df[term]), 0

    df, some, total = np.zeros(n_terms, np.int64), 0, 0
    partial = map_rows(blocks.select("sizes", "terms"), rows, "term int, n bigint, total bigint")
    for row in partial.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        if row["term"] < 0:
            some, total = row["n"], row["total"]
        else:
            df[row["term"]] = row["n"]
    return some, total, df


def _impacts(sizes: bytes, places: bytes, tfs: bytes, some: int, total: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m) of every posting."""
    sizes = np.frombuffer(sizes, np.int64)
    if 25 * int(sizes.max(initial=0)) * some < 1 << 63:
        m = 75 + 25 * sizes * some // max(total, 1)
    else:  # beyond 64 bits on the way
        m = np.array([75 + 25 * n * some // total for n in sizes.tolist()], np.int64)
    tf = np.frombuffer(tfs, np.int32).astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m[np.frombuffer(places, np.int32)])


def _largest(blocks: DataFrame, n_terms: int, some: int, total: int) -> np.ndarray:
    """The largest contribution of every term."""

    def rows(parts: Iterator[tuple]) -> Iterable[tuple]:
        most = np.zeros(n_terms, np.int64)
        for sizes, terms, places, tfs in parts:
            np.maximum.at(most, np.frombuffer(terms, np.int32), _impacts(sizes, places, tfs, some, total))
        for term in np.flatnonzero(most).tolist():
            yield term, int(most[term])

    most = np.zeros(n_terms, np.int64)
    for row in map_rows(blocks.select("sizes", "terms", "places", "tfs"), rows, "term int, most bigint").groupBy("term").agg(
            F.max("most").alias("most")).collect():
        most[row["term"]] = row["most"]
    return most


def owners(df: np.ndarray, shares: tuple[float, ...] = _SHARES) -> np.ndarray:
    """The owner of every term: the rarest terms to the first, by shares of all postings."""
    order = np.argsort(df, kind="stable")
    upto = np.cumsum(df[order]) / max(1, int(df.sum()))
    owner = np.empty(len(df), np.int64)
    owner[order] = np.minimum(np.searchsorted(np.array(shares), upto, "left"), len(shares) - 1)
    return owner


def _owned(blocks: DataFrame, owner: np.ndarray, n_owners: int, some: int, total: int) -> DataFrame:
    """(block, owner, docs, terms, starts, places, impacts): every owner's postings; the last also has the documents' ids."""

    def rows(parts: Iterator[tuple]) -> Iterable[tuple]:
        for block, ids, no_id, sizes, terms, places, tfs in parts:
            impact = _impacts(sizes, places, tfs, some, total).astype(np.int32)
            terms, places = np.frombuffer(terms, np.int32), np.frombuffer(places, np.int32)
            for k in range(n_owners):
                mine = owner[terms] == k
                held = terms[mine]
                starts = np.flatnonzero(np.concatenate((held[:1] == held[:1], held[1:] != held[:-1])))
                last = k == n_owners - 1
                yield (block, k, len(ids) // 8, held[starts].tobytes(), np.append(starts, len(held)).astype(np.int32).tobytes(),
                       places[mine].astype(np.uint16).tobytes(), impact[mine].tobytes(), ids if last else None, no_id if last else None)

    return map_rows(blocks, rows, "block bigint, owner int, docs int, terms binary, starts binary, places binary, impacts binary, ids binary, no_id binary")


# --- the pipeline -------------------------------------------------------------------

_BUNDLE = "block bigint, items binary, counts binary, places binary, scores binary"
_BEST = "item int, doc_id bigint, score bigint"


def _unpacked(bundles: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Accumulators by item."""
    held = {}
    for items, counts, places, scores in zip(*(bundles[c] for c in ("items", "counts", "places", "scores")), strict=True):
        if items is None or not len(items):
            continue
        ends = np.cumsum(np.frombuffer(counts, np.int32))
        places, scores = np.frombuffer(places, np.uint16), np.frombuffer(scores, np.int64)
        for item, start, end in zip(np.frombuffer(items, np.int32).tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            held[item] = places[start:end], scores[start:end]
    return held


def _stage(k: int, last: bool, top: int, plan):
    """The function of owner ``k``; ``plan``: per item its terms there with weights, and the most that later owners can add."""

    def added(bundles: pd.DataFrame, postings: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        held = _unpacked(bundles)
        docs = int(postings["docs"].iloc[0])
        terms, starts = np.frombuffer(postings["terms"].iloc[0], np.int32), np.frombuffer(postings["starts"].iloc[0], np.int32)
        places, impacts = np.frombuffer(postings["places"].iloc[0], np.uint16), np.frombuffer(postings["impacts"].iloc[0], np.int32)
        at = {t: (s, e) for t, s, e in zip(terms.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True)}
        score = np.zeros(docs, np.int64)
        for item, (own, later) in enumerate(plan.value[k]):
            score[:] = 0
            if item in held:
                score[held[item][0]] = held[item][1]
            for term, weight in own:
                if term in at:
                    s, e = at[term]
                    score[places[s:e]] += weight * impacts[s:e].astype(np.int64)
            found = np.flatnonzero(score)
            if len(found) > top:
                least = np.partition(score[found], -top)[-top]  # ``top`` documents have so much already
                found = found[score[found] + later >= least]
            if len(found):
                yield item, found, score[found]

    def carry(bundles: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        rows = list(added(bundles, postings))
        items, counts = np.array([r[0] for r in rows], np.int32), np.array([len(r[1]) for r in rows], np.int32)
        places = np.concatenate([*(r[1] for r in rows), np.zeros(0, np.int64)]).astype(np.uint16)
        scores = np.concatenate([*(r[2] for r in rows), np.zeros(0, np.int64)]).astype(np.int64)
        return pd.DataFrame({"block": [int(postings["block"].iloc[0])], "items": [items.tobytes()], "counts": [counts.tobytes()],
                             "places": [places.tobytes()], "scores": [scores.tobytes()]})

    def select(bundles: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        ids = pd.array(np.frombuffer(postings["ids"].iloc[0], np.int64), dtype="Int64")
        ids[np.frombuffer(postings["no_id"].iloc[0], np.int32)] = pd.NA
        parts = [(np.full(len(found), item, np.int32), found, score) for item, found, score in added(bundles, postings)]
        if not parts:
            return pd.DataFrame({"item": pd.Series(dtype="int32"), "doc_id": pd.Series(dtype="Int64"), "score": pd.Series(dtype="int64")})
        item, found, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({"item": item, "doc_id": ids[found], "score": score})

    return select if last else carry


def _search_group(docs: DataFrame, items: list[tuple[int, int, Counter]], top: int, block_docs: int) -> DataFrame:
    """(item, doc_id, score) with at least the ``top`` best documents of every item; ``item`` is the position in ``items``."""
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(dict.fromkeys(t for *_, terms in items for t in terms))}
    blocks = stash(_blocks(docs, spark.sparkContext.broadcast(number), block_docs), "blocks")
    some, total, df = _counts(blocks, len(number))
    largest = _largest(blocks, len(number), some, total)
    owner = owners(df)
    weight = [math.floor(1000 * math.log((2 * some + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()]

    n_owners = len(_SHARES)
    plan: list[list[tuple[list, int]]] = [[] for _ in range(n_owners)]
    for *_, terms in items:
        own: list[list[tuple[int, int]]] = [[] for _ in range(n_owners)]
        most = [0] * n_owners
        for term, times in terms.items():
            i = number[term]
            own[owner[i]].append((i, times * weight[i]))
            most[owner[i]] += times * weight[i] * int(largest[i])
        for k in range(n_owners):
            plan[k].append((own[k], sum(most[k + 1 :])))
    sent = spark.sparkContext.broadcast(plan)

    owned = stash(_owned(blocks, owner, n_owners, some, total), "owned")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bundles = blocks.select("block", *[F.lit(None).cast("binary").alias(c) for c in ("items", "counts", "places", "scores")])
    for k in range(n_owners):
        last = k == n_owners - 1
        # A stated number of partitions: their work, not their bytes, is what counts.
        left, right = bundles.repartition(parts, "block"), owned.where(F.col("owner") == k).repartition(parts, "block")
        bundles = left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(_stage(k, last, top, sent), _BEST if last else _BUNDLE)
    return bundles


def search(
    docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", group_bytes: int = 4 << 20, block_docs: int = 4096,
) -> DataFrame:
    """(item_id, item_row, rank, doc_id, score): the ``top`` best documents with a score above 0 of every item.

    A block has ``block_docs`` documents (65536 at most).
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    kind = dict(items.select(F.col(f"`{item_col}`").alias("item")).dtypes)["item"]
    found = []
    for group in _item_groups(items, item_col, item_text_col, group_bytes):
        if not group:
            continue
        names = spark.createDataFrame([(i, row, item) for i, (row, item, _) in enumerate(group)], f"item int, item_row bigint, item_id {kind}")
        best = stash(_search_group(docs, group, top, block_docs), "best")
        # First within parts of an item's rows, so that no task gets all of them.
        for keys in (["item", "part"], ["item"]):
            order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            best = best.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(32))).withColumn("rank", F.row_number().over(order)).where(
                F.col("rank") <= top)
        found.append(best.join(names, "item").select("item_id", "item_row", "rank", "doc_id", "score"))
    empty = spark.createDataFrame([], f"item_id {kind}, item_row bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionAll, found) if found else empty
