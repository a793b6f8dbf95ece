"""Array and key-value attribute values, opened level by level.

A nested value is kept as JSON text: ``{"array": [value, ...]}``,
``{"kvlist": [[key, key_ref, value], ...]}``, or a flat value under its kind's
name; a value without a kind is null.  Each level is parsed by one projection,
whose inner values stay JSON text for the next; there are as many rounds as the
deepest value has levels, which decoding bounds.  No row is regrouped on the way.

Defined results: a null text has no entries; a null value inside is an entry
without a kind; a key of an entry without a value counts; a reference out of the
string table has no bytes; no values, no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.session import stash

_FLAT = ("string", "bytes", "string_ref", "bool", "int", "double")
#: Fields that are not plain texts are taken as their JSON text.
_VALUE = ", ".join(f"`{name}` string" for name in _FLAT) + ", `array` array<string>, kvlist array<array<string>>"


def _child(path: str, key: str, key_ref: str, json: str) -> str:
    return f"named_struct('path', {path}, 'key', {key}, 'key_ref', {key_ref}, 'json', {json})"


def nested_entries(values: DataFrame, keys: Sequence[str], json: str = "nested_json") -> DataFrame:
    """(keys, depth, path, key, key_ref, kind, text, string_ref, text_bytes) of every value inside the JSON column, itself included.

    Paths start with ``$``; list places are in brackets, keys follow a dot.
    ``text`` is that of flat values, bytes in base 64; ``text_bytes`` counts the
    literal key and a string or bytes value, not what a reference points to.
    """
    level = values.select(*keys, F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("key_ref"),
                          F.col(json).alias("json")).where("json IS NOT NULL")
    found: list[DataFrame] = []
    while not found or level is not None:
        opened = level.withColumn("v", F.from_json("json", _VALUE)).selectExpr(
            *keys, "path", "key", "key_ref", "json_object_keys(json)[0] AS kind",
            f"coalesce({', '.join(f'v.`{name}`' for name in _FLAT)}) AS text", "CAST(v.string_ref AS INT) AS string_ref",
            "CAST(coalesce(octet_length(key), 0) + coalesce(octet_length(v.string), 0)"
            " + coalesce(octet_length(unbase64(v.bytes)), 0) AS BIGINT) AS text_bytes",
            f"""concat(
              coalesce(transform(v.`array`, (x, i) -> {_child("concat(path, '[', i, ']')", "CAST(NULL AS STRING)", "0", "x")}), array()),
              coalesce(transform(v.kvlist, x -> {_child("concat(path, '.', x[0])", "x[0]", "CAST(x[1] AS INT)", "x[2]")}), array())
            ) AS inner""")
        stored = stash(opened, "nested-level")
        found.append(stored.drop("inner").withColumn("depth", F.lit(len(found))))
        below = stored.select(*keys, F.explode("inner").alias("x")).select(*keys, "x.*")
        level = None if below.isEmpty() else below
    columns = [*keys, "depth", "path", "key", "key_ref", "kind", "text", "string_ref", "text_bytes"]
    return reduce(DataFrame.unionByName, found).select(*columns)


def nested_bytes(entries: DataFrame, keys: Sequence[str], strings: DataFrame | None = None) -> DataFrame:
    """(keys, n_entries, depth, text_bytes) per value; ``strings`` (payload_id, idx, value) resolves references, ``payload_id`` being a key."""
    counted = entries
    if strings is not None:
        texts = strings.select("payload_id", F.col("idx").alias("string_ref"), F.octet_length("value").alias("_ref"))
        counted = entries.join(texts, ["payload_id", "string_ref"], "left").withColumn(
            "text_bytes", F.col("text_bytes") + F.coalesce("_ref", F.lit(0)))
    return counted.groupBy(*keys).agg(
        F.count("*").alias("n_entries"), F.max("depth").alias("depth"), F.sum("text_bytes").alias("text_bytes"))
