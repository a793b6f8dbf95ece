"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a hash in (0, 1); the shard with the largest
``-weight / ln(hash)`` gets the record.  A record's shard depends on nothing but
its key, the number of shards and their weights; a further shard only takes
records away from others, about its share of the weight, and moves none between
the old ones.

Nothing is gathered by key: the shard is an expression of the row.  Only the
numbering inside the shards shuffles, and it range-partitions the numbers of a
row, never its text, so that a shard may span many partitions.

Defined results: a null key is a key like any other, so all rows without a key
meet in one shard; rows repeated with one key share its shard and have slots of
their own; a null text has no bytes; an empty table gives an empty result;
columns of the input other than key and text are not used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.operators.ordinals import grouped_ordinal


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) that ``key`` belongs to; ``weights`` has one positive number per shard."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, one per shard")

    def score(shard: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, shard["i"]), 11)
        u = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0 ** -53)
        u = F.least(u, F.lit(1 - 2.0 ** -53))  # the largest hash would round to 1
        return F.struct((-shard["w"] / F.ln(u)).alias("s"), shard["i"].alias("i"))

    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    return F.array_max(F.transform(shards, score))["i"]


def shard_rows(
    docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", grown_by: float | None = None
) -> DataFrame:
    """(id, size, text_crc32, shard, slot[, grown_shard]) of every row.

    ``size`` is the text's UTF-8 bytes plus 8.  ``slot`` counts a shard's rows
    from 0 in key order.  ``grown_by`` is the weight of one more shard.
    """
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    columns = [
        key.alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), shard_of(key, weights).alias("shard"),
    ]
    if grown_by is not None:
        columns.append(shard_of(key, [*weights, grown_by]).alias("grown_shard"))
    return grouped_ordinal(docs.select(*columns), ["shard"], ["id"], "slot", spread_ties=True, kind="bigint")
