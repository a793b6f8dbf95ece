"""Encoded sizes of profile messages as SQL expressions (proto3 wire format).

All field numbers of the profile messages are below 16, so every tag is one
byte.  Zero scalars and empty strings are omitted; a value inside a ``oneof``
is always written.  Functions take and return SQL text, so a message size is
one parsed expression.  Size expressions repeat their argument, so each nested
length is first selected as a column of its own (``_staged``); the optimizer
does not inline such columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def varint(n: str, unsigned: bool = False) -> str:
    """Bytes of one varint; negative numbers take ten, NULL stays NULL.

    ``unsigned`` is for 64-bit numbers held as DECIMAL(20,0).
    """
    steps = " ".join(f"WHEN {n} < {1 << (7 * k)} THEN {k}" for k in range(1, 10 if unsigned else 9))
    return f"CAST(CASE WHEN {n} < 0 THEN 10 {steps} WHEN {n} IS NOT NULL THEN {10 if unsigned else 9} END AS BIGINT)"


def framed(length: str) -> str:
    """Tag + length prefix + content of a message, string or bytes field."""
    return f"(1 + {varint(length)} + {length})"


def scalar(n: str, unsigned: bool = False) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0L ELSE 1 + {varint(n, unsigned)} END)"


def fixed64(n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0L ELSE 9L END)"


def text(s: str) -> str:
    """String or bytes field, omitted when empty or NULL."""
    return f"(CASE WHEN coalesce(octet_length({s}), 0) = 0 THEN 0L ELSE {framed(f'octet_length({s})')} END)"


def total(array: str, size) -> str:
    """Sum of ``size(element)`` over an array; NULL and empty give 0."""
    return f"coalesce(aggregate(transform({array}, x -> {size('x')}), 0L, (acc, x) -> acc + x), 0L)"


def length_of(array: str) -> str:
    """Array length, 0 for NULL."""
    return f"CAST(coalesce(size({array}), 0) AS BIGINT)"


def packed(n: str) -> str:
    """Packed list whose elements take ``n`` bytes (an element takes at least one)."""
    return f"(CASE WHEN {n} = 0 THEN 0L ELSE {framed(n)} END)"


def optional(present: str, length: str) -> str:
    """Message field that is absent unless ``present``."""
    return f"(CASE WHEN {present} THEN {framed(length)} ELSE 0L END)"


def value_field(value: str) -> str:
    """The ``value`` field of an attribute: nothing when the value is NULL."""
    return optional(f"{value} IS NOT NULL", f"coalesce({value}.wire_bytes, 0L)")


def varint_column(n: Column) -> Column:
    """``varint`` for an unnamed column."""
    return F.ceil(F.length(F.bin(n.cast("bigint"))) / 7).cast("bigint")


def framed_column(n: Column) -> Column:
    return F.lit(1) + varint_column(n) + n


def _staged(df: DataFrame, keep: Sequence[str], totals: dict[str, str], carry: Sequence[str], content: Sequence[str]) -> DataFrame:
    first = df.selectExpr(*keep, *carry, *[f"CAST({sql} AS BIGINT) AS {name}" for name, sql in totals.items()])
    return first.selectExpr(*keep, f"CAST({' + '.join(content)} AS BIGINT) AS content")


def sample_content(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return _staged(
        df, keep,
        {"_v": total("values", varint), "_a": total("attribute_indices", varint), "_t": f"8 * {length_of('timestamps')}"},
        ["stack_index", "link_index"],
        [scalar("stack_index"), packed("_v"), packed("_a"), scalar("link_index"), packed("_t")],
    )


def profile_content(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Profiles without their samples."""
    kind = lambda c: f"{scalar(f'{c}.type_strindex')} + {scalar(f'{c}.unit_strindex')}"
    carry = ["time_unix_nano", "duration_nano", "period", "profile_id", "dropped_attributes_count",
             "original_payload_format", "original_payload"]
    return _staged(
        df, keep,
        {"_st": kind("sample_type"), "_pt": kind("period_type"), "_a": total("attribute_indices", varint)}, carry,
        [optional("_st IS NOT NULL", "_st"), fixed64("time_unix_nano"), scalar("duration_nano"),
         optional("_pt IS NOT NULL", "_pt"), scalar("period"), text("profile_id"), scalar("dropped_attributes_count"),
         text("original_payload_format"), text("original_payload"), packed("_a")],
    )


def key_value_content(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return _staged(df, keep, {}, ["key", "key_ref", "value"], [text("key"), value_field("value"), scalar("key_ref")])


def mapping_content(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    numbers = ["memory_start", "memory_limit", "file_offset"]
    return _staged(
        df, keep, {"_a": total("attribute_indices", varint)}, [*numbers, "filename_strindex"],
        [*[scalar(c, unsigned=True) for c in numbers], scalar("filename_strindex"), packed("_a")],
    )


def location_content(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    line = "transform(lines, y -> " + " + ".join(scalar(f"y.{c}") for c in ("function_index", "line", "column")) + ")"
    return _staged(
        df, keep, {"_l": total(line, framed), "_a": total("attribute_indices", varint)}, ["mapping_index", "address"],
        [scalar("mapping_index"), scalar("address", unsigned=True), "_l", packed("_a")],
    )


def function_content(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    fields = ["name_strindex", "system_name_strindex", "filename_strindex", "start_line"]
    return _staged(df, keep, {}, fields, [scalar(c) for c in fields])


def link_content(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return _staged(df, keep, {}, ["trace_id", "span_id"], [text("trace_id"), text("span_id")])


def stack_content(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return _staged(df, keep, {"_l": total("location_indices", varint)}, [], [packed("_l")])


def string_content(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """String-table entries, written even when empty."""
    return _staged(df, keep, {}, ["value"], ["octet_length(value)"])


def attribute_content(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    fields = ["key_strindex", "value", "unit_strindex"]
    return _staged(df, keep, {}, fields, [scalar("key_strindex"), value_field("value"), scalar("unit_strindex")])
