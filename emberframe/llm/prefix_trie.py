"""Prefix trie of conversations, from padded matrices of turn ids.

A node is a distinct sequence of first turns; conversations that start with it
are its members, the root has all.

1. Every turn becomes a 128-bit digest of (role, text) and its text's size, so
   that texts are read once and never shuffled.  A conversation is a row: its id,
   the digests of its turns in order, their sizes.
2. Rows are range-partitioned on (digests, id) into shards.  A node's members are
   neighbours in this order, so a node lies in one shard or in adjacent ones, and
   copies of one conversation are split by their ids.
3. Inside a shard digests become dense ids in a padded matrix, which ``lexsort``
   orders.  Comparing each row with the one above and OR-accumulating along the
   columns marks where nodes start, and ``reduceat`` aggregates every depth.
   Columns are taken 64 at a time with only the rows that reach them, so that one
   long conversation doesn't widen the matrix for all others.
4. Nodes with the first or last row of a shard may go on in another one.  Of these
   a shard gives partial values, without what such nodes add themselves.  They are
   summed by node; what a node adds itself (saved tokens, a leaf) is added in the
   first shard that has it and summed along that shard's two boundary paths.

Only rows of boundary nodes, two paths a shard, are shuffled after step 3; other
nodes are joined by (shard, node) to the parent's value if their parent is one of
them.  The digest over the members that end at a boundary node is a chained
function of all their ids: one task streams them in order, a batch at a time.

Defined results: a null role or text is empty; turns are ordered by number, null
first, and equal numbers by digest; repeated rows are turns of their own; rows
with a null conversation id belong to none; an empty table has no node; further
columns are not read.  A conversation is one row of its turns' digests (24 bytes a
turn), which one task must hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import map_rows, stash

_WIDTH = 64  # columns of a matrix
_CHUNK = 1 << 16  # ids in a piece of a boundary node's list
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- conversations as rows ----------------------------------------------------------


def turn_sequences(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(id, seq): a conversation's turns in order, as structs of digest and bytes of text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    each = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("bigint").alias("id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("size")).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return each.groupBy("id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("seq"))


def share_heads(sequences: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """Every conversation c starts with the first h turns of conversation c - c % ``group``; h = crc32(c) % ``heads``."""
    sequences = stash(sequences, "turns")
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % heads).cast("int")
    own = sequences.select("id", (F.col("id") - F.col("id") % group).alias("base"), h.alias("h"), "seq")
    base = sequences.where(F.col("id") % group == 0).select(F.col("id").alias("base"), F.slice("seq", 1, heads - 1).alias("head"))
    head = F.slice(F.coalesce("head", F.slice("seq", 1, 0)), F.lit(1), F.col("h"))
    return own.join(base, "base", "left").select("id", F.concat(head, F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq"), F.lit(1)))).alias("seq"))


# --- one shard ----------------------------------------------------------------------


def _over(ufunc: np.ufunc, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``ufunc`` over every [start, end)."""
    if not len(starts):
        return values[:0]
    return ufunc.reduceat(np.append(values, values[-1]), np.stack((starts, ends), 1).ravel())[::2]


def _matrix(ids: np.ndarray, first: np.ndarray, lengths: np.ndarray, rows: np.ndarray, column: int, width: int) -> np.ndarray:
    """The turns from ``column`` on of ``rows``; 0 pads."""
    at = column + np.arange(width)
    inside = at < lengths[rows][:, None]
    return np.where(inside, ids[np.where(inside, first[rows][:, None] + at, 0)], 0)


def _levels(ids: np.ndarray, first: np.ndarray, lengths: np.ndarray, conv: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Order of the rows, and for every depth from 0 (starts, ends) of its nodes in that order."""
    deepest = int(lengths.max(initial=0))
    rest = np.zeros(len(conv), np.int64)  # rank of what lies beyond the block
    for column in reversed(range(0, max(deepest, 1), _WIDTH)):
        rows = np.flatnonzero(lengths > column)
        block = _matrix(ids, first, lengths, rows, column, min(_WIDTH, deepest - column))
        order = np.lexsort((rest[rows], *block.T[::-1]))
        sorted_, beyond = block[order], rest[rows][order]
        new = (sorted_[1:] != sorted_[:-1]).any(axis=1) | (beyond[1:] != beyond[:-1])
        rest[rows[order]] = np.concatenate(([1], 1 + np.cumsum(new))) if len(rows) else 0
    order = np.lexsort((conv, rest))
    first, lengths = first[order], lengths[order]

    levels = [(np.array([0]), np.array([len(conv)]))]
    changed = np.zeros(len(conv), bool)  # in an earlier column
    for column in range(0, deepest, _WIDTH):
        rows = np.flatnonzero(lengths > column)
        block = _matrix(ids, first, lengths, rows, column, min(_WIDTH, deepest - column))
        marks = np.ones(block.shape, bool)
        marks[1:] = block[1:] != block[:-1]
        marks[1:, 0] |= np.diff(rows) > 1
        marks[:, 0] |= changed[rows]
        np.logical_or.accumulate(marks, axis=1, out=marks)
        changed[rows] = marks[:, -1]
        for j in range(block.shape[1]):
            starts = np.flatnonzero(marks[:, j])
            ends = np.append(starts[1:], len(rows))
            real = block[starts, j] != 0
            levels.append((rows[starts[real]], rows[ends[real] - 1] + 1))
    return order, levels


def _digests(conv: np.ndarray, lengths: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, list[str]]:
    """How many members end at each node, and the digest of their ids."""
    n = _over(np.add, (lengths == depth).astype(np.int64), starts, ends)
    return n, [hashlib.sha256(",".join(map(str, conv[s : s + k].tolist())).encode()).hexdigest() if k else NO_ENDS
               for s, k in zip(starts.tolist(), n.tolist(), strict=True)]


_SHARD = (
    "conv_id bigint, depth int, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
    "ends_sha256 string, shard int, branch string, node binary, parent binary, size bigint, n_ends bigint, part int, ids string")


def _shard_nodes(rows: Iterator[tuple]) -> Iterable[tuple]:
    """Rows of ``_SHARD``: whole nodes (no branch), boundary nodes (branch: both, first or last), id lists (part)."""
    conv, keys, sizes = [], [], []
    for key, digests, size in rows:
        conv.append(key)
        keys.append(digests)
        sizes.append(np.asarray(size, np.int64))
    if not conv:
        return
    shard = TaskContext.get().partitionId()
    lengths = np.fromiter((len(k) // 16 for k in keys), np.int64, len(keys))
    first = np.cumsum(lengths) - lengths
    halves = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2)
    by = np.lexsort((halves[:, 1], halves[:, 0]))
    ids = np.zeros(max(1, len(by)), np.int64)
    ids[by] = np.cumsum(np.concatenate(([True], (halves[by][1:] != halves[by][:-1]).any(axis=1)))) if len(by) else 0
    size = np.concatenate([*sizes, np.zeros(1, np.int64)])
    order, levels = _levels(ids, first, lengths, np.asarray(conv, np.int64))
    conv, lengths, first = np.asarray(conv, np.int64)[order], lengths[order], first[order]
    edges = [keys[order[0]], keys[order[-1]]]
    # Names of the boundary nodes by depth, on the path of the first row and on that of the last one.
    names = [[hashlib.md5(str(d).encode() + b":" + e[: 16 * d], usedforsecurity=False).digest() for d in range(len(e) // 16 + 1)] for e in edges]

    saved, leaves, child = (np.zeros(len(conv), np.int64) for _ in range(3))
    for depth in reversed(range(len(levels))):
        starts, ends = levels[depth]
        n = ends - starts
        at_first, at_last = starts == 0, ends == len(conv)
        whole = ~(at_first | at_last)
        children = _over(np.add, child, starts, ends)
        last_size = size[first[starts] + depth - 1] if depth else np.zeros(1, np.int64)
        saved[starts[whole]] += ((n - 1) * last_size)[whole]
        leaves[starts[whole & (children == 0)]] += 1
        below, leaf = _over(np.add, saved, starts, ends), _over(np.add, leaves, starts, ends)
        child[:] = 0
        child[starts[whole]] = 1
        least = _over(np.minimum, conv, starts, ends)
        n_ends, shas = _digests(conv, lengths, starts[whole], ends[whole], depth)
        if depth:
            up_starts, up_ends = levels[depth - 1]
            up = np.searchsorted(up_starts, starts, "right") - 1
            up_least = _over(np.minimum, conv, up_starts, up_ends)[up]
            up_whole = (up_starts[up] > 0) & (up_ends[up] < len(conv))
            # A boundary parent is on the first row's path if it has that row.
            up_name = [None if w else names[0 if s == 0 else 1][depth - 1]
                       for w, s in zip(up_whole.tolist(), up_starts[up].tolist(), strict=True)]
        else:
            up_least, up_whole, up_name = np.zeros(1, np.int64), np.zeros(1, bool), [None]
        sha = iter(shas)
        for i in range(len(starts)):
            if whole[i]:
                yield (int(least[i]), depth, int(up_least[i]) if up_whole[i] else None, int(n[i]), int(children[i]), int(leaf[i]),
                       int(below[i]), next(sha), shard, None, None, up_name[i], None, None, None, None)
                continue
            name = names[0 if at_first[i] else 1][depth]
            ending = int((lengths[starts[i] : ends[i]] == depth).sum())
            branch = "both" if at_first[i] and at_last[i] else "first" if at_first[i] else "last"
            yield (int(least[i]), depth, None, int(n[i]), int(children[i]), int(leaf[i]), int(below[i]), None, shard, branch, name,
                   up_name[i], int(last_size[i]), ending, None, None)
            for part, at in enumerate(range(0, ending, _CHUNK)):
                some = conv[starts[i] + at : starts[i] + min(ending, at + _CHUNK)]
                yield (None, None, None, None, None, None, None, None, shard, None, name, None, None, None, part, ",".join(map(str, some.tolist())))


# --- boundary nodes -----------------------------------------------------------------


def _chained(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of each boundary node's ids, streamed in order."""

    def rows(pieces: Iterator[tuple]) -> Iterable[tuple]:
        now, state = None, None
        for node, ids in pieces:
            if node != now:
                if state is not None:
                    yield now, state.hexdigest()
                now, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if state is not None:
            yield now, state.hexdigest()

    ordered = parts.repartition("node").sortWithinPartitions("node", "shard", "part")
    return map_rows(ordered.select("node", "ids"), rows, "node binary, ends_sha256 string")


def _recombined(edge: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per boundary node, from the shards' partial values."""
    merged = stash(edge.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.first("parent").alias("parent"),
        F.first("size").alias("size"), F.sum("n_ends").alias("n_ends"), F.min("shard").alias("home")), "boundary")
    own = merged.select(
        "node", F.col("home").alias("shard"), ((F.col("n_convs") - 1) * F.col("size")).alias("own_saved"),
        (F.col("n_convs") == F.col("n_ends")).cast("bigint").alias("own_leaf"))
    placed = edge.join(own, ["node", "shard"], "left").fillna(0, ["own_saved", "own_leaf"])
    # Both branches hang below the nodes that have both boundary rows.
    deeper = Window.orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    along, all_ = deeper.partitionBy("shard", "branch"), deeper.partitionBy("shard")

    def summed(name: str) -> Column:
        return F.when(F.col("branch") == "both", F.sum(name).over(all_)).otherwise(F.sum(name).over(along))

    sums = placed.withColumns({"more_saved": summed("own_saved"), "more_leaves": summed("own_leaf")}).groupBy("node").agg(
        F.sum("n_children").alias("inner"), F.sum(F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"),
        F.sum(F.col("saved_tokens") + F.col("more_saved")).alias("saved_tokens"))
    outer = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("outer"))
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        merged.drop("size", "n_ends", "home").join(sums, "node").join(outer, "node", "left").join(_chained(parts), "node", "left")
        .join(parents, "parent", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", (F.col("inner") + F.coalesce("outer", F.lit(0))).alias("n_children"),
                "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "node"))


def prefix_trie(sequences: DataFrame, shard_turns: int = 250_000) -> DataFrame:
    """One row per node of the trie over ``sequences`` (id, seq); see above.

    A shard has about ``shard_turns`` turns, or fewer where Spark's own number of
    partitions is larger.
    """
    spark = sequences.sparkSession
    keyed = stash(sequences.select(
        "id", F.unhex(F.array_join(F.transform("seq", lambda t: t["digest"]), "")).alias("key"),
        F.transform("seq", lambda t: t["size"]).alias("sizes")), "sequences")
    total = keyed.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_turns))
    found = stash(map_rows(keyed.repartitionByRange(shards, "key", "id"), _shard_nodes, _SHARD), "nodes")

    edge = found.where("branch IS NOT NULL")
    joined = stash(_recombined(edge, found.where("part IS NOT NULL").select("node", "shard", "part", "ids")), "recombined")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    known = edge.select("shard", "node").join(joined.select("node", F.col("conv_id").alias("up")), "node").withColumnRenamed("node", "parent")
    inner = found.where("branch IS NULL AND part IS NULL")
    below = inner.where("parent IS NOT NULL").join(known, ["shard", "parent"]).withColumn("parent_conv_id", F.col("up"))
    return inner.where("parent IS NULL").select(columns).unionAll(below.select(columns)).unionAll(joined.select(columns)).withColumn(
        "depth", F.col("depth").cast("bigint"))
