"""Attribute values: construction, text forms and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberframe.functions import wire
from emberframe.schema import VALUE


def make_value(kind: str, c: Column, ref_length: Column | None = None) -> Column:
    """A VALUE struct of one flat kind.

    ``ref_length`` is the byte length of the string a ``string_ref`` points to.
    """
    field = {"string": "s", "string_ref": "s_ref", "bool": "b", "int": "i", "double": "d", "bytes": "bytes"}[kind]
    if kind in ("string", "bytes"):
        payload = F.octet_length(c).cast("bigint")
        size = wire.framed_column(payload)
    elif kind == "string_ref":
        payload = F.coalesce(ref_length, F.lit(0)).cast("bigint")
        size = F.lit(1) + wire.varint_column(c)
    else:
        payload = F.lit(0).cast("bigint")
        size = {"bool": F.lit(2), "int": F.lit(1) + wire.varint_column(c), "double": F.lit(9)}[kind]
    slots = {
        "kind": F.lit(kind), "s": None, "s_ref": None, "b": None, "i": None, "d": None,
        "bytes": None, "nested_json": None, "payload_bytes": payload, "wire_bytes": size,
    }
    slots[field] = c
    return F.struct(
        *[(v if v is not None else F.lit(None)).alias(k) for k, v in slots.items()]
    ).cast(VALUE)


def no_value() -> Column:
    return F.lit(None).cast(VALUE)


def shortest_decimal(d: str) -> str:
    """Shortest decimal form of a double without exponent and without trailing ``.0``."""
    raw = f"CAST({d} AS STRING)"
    return (
        f"CASE WHEN {d} = 0 THEN '0' WHEN isnan({d}) THEN 'NaN' WHEN contains({raw}, 'E')"
        f" THEN regexp_replace({_plain_decimal(raw)}, '\\\\.?0+$', '') ELSE regexp_replace({raw}, '\\\\.0$', '') END"
    )


def _plain_decimal(raw: str) -> str:
    """Expand ``1.5E-7`` to ``0.00000015`` with string operations (any exponent)."""
    whole = f"ltrim('-', substring_index({raw}, '.', 1))"
    fraction = f"substring_index(substring_index({raw}, '.', -1), 'E', 1)"
    exponent = f"CAST(substring_index({raw}, 'E', -1) AS INT)"
    digits = f"concat({whole}, {fraction})"
    small = f"concat('0.', repeat('0', -{exponent} - 1), {digits})"
    padded = f"concat({digits}, repeat('0', {exponent} - length({fraction})))"
    large = f"concat(left({padded}, 1 + {exponent}), '.', substring({padded}, 2 + {exponent}), '0')"
    return f"concat(CASE WHEN startswith({raw}, '-') THEN '-' ELSE '' END, CASE WHEN {exponent} < 0 THEN {small} ELSE {large} END)"


def value_text(value: str, ref_text: str) -> str:
    """Plain text of a value; kinds without a plain text give ''.

    ``ref_text`` is the string a ``string_ref`` points to, NULL if out of range.
    """
    return (
        f"coalesce(CASE {value}.kind WHEN 'string' THEN {value}.s WHEN 'string_ref' THEN {ref_text}"
        f" WHEN 'bool' THEN CAST({value}.b AS STRING) WHEN 'int' THEN CAST({value}.i AS STRING)"
        f" WHEN 'double' THEN {shortest_decimal(f'{value}.d')} END, '')"
    )


# Characters with a short escape inside a quoted string.
_ESCAPES = {
    "\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t",
    "\a": "\\a", "\b": "\\b", "\f": "\\f", "\v": "\\v",
}


def quoted(c: str) -> str:
    """Double-quoted form with the usual short escapes."""
    literal = lambda s: "concat(" + ", ".join(f"chr({ord(x)})" for x in s) + ")"
    out = c
    for raw, escaped in _ESCAPES.items():
        out = f"replace({out}, {literal(raw)}, {literal(escaped)})"
    return f"concat(chr(34), {out}, chr(34))"


def listing_text(value: str, ref_text: str) -> str:
    """Text of a value in listings: strings quoted, references marked with ``&``."""
    ref = f"coalesce({ref_text}, '')"
    return (
        f"CASE WHEN {value}.kind = 'string' THEN {quoted(f'{value}.s')} WHEN {value}.kind = 'string_ref'"
        f" THEN concat('&', {quoted(ref)}) WHEN {value}.nested_json IS NOT NULL THEN {value}.nested_json"
        f" ELSE {value_text(value, ref_text)} END"
    )


def payload_bytes(value: str, ref_text: str) -> str:
    """Text bytes carried by a value; nested kinds use the count taken while decoding."""
    return (
        f"CAST(coalesce(CASE {value}.kind WHEN 'string' THEN octet_length({value}.s)"
        f" WHEN 'bytes' THEN octet_length({value}.bytes) WHEN 'string_ref' THEN octet_length({ref_text})"
        f" WHEN 'array' THEN {value}.payload_bytes WHEN 'kvlist' THEN {value}.payload_bytes END, 0) AS BIGINT)"
    )
