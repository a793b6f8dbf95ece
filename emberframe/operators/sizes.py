"""Encoded sizes of payloads, summed bottom-up over the message tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions import wire
from emberframe.schema import DICTIONARY_TABLES, PROFILE_ID, RESOURCE_ID, SCOPE_ID
from emberframe.tables import ProfileTables

_EMPTY_SLOT = 2  # tag + zero length of a message without content


def _sum(sql: str, name: str) -> Column:
    return F.expr(f"CAST(coalesce(sum({sql}), 0) AS BIGINT) AS {name}")


def _or_zero(name: str) -> str:
    return f"coalesce({name}, 0L) AS {name}"


def _key_values(df: DataFrame, owner: list[str]) -> DataFrame:
    return wire.key_value_content(df, owner).groupBy(*owner).agg(_sum(wire.framed("content"), "attribute_bytes"))


def profile_bytes(t: ProfileTables) -> DataFrame:
    """Content bytes of each profile; samples are reduced per profile before the join."""
    samples = wire.sample_content(t.samples, PROFILE_ID).groupBy(*PROFILE_ID).agg(
        _sum(wire.framed("content"), "framed_samples"), _sum("content", "sample_bytes"))
    return wire.profile_content(t.profiles, PROFILE_ID).join(samples, PROFILE_ID, "left").selectExpr(
        *PROFILE_ID, _or_zero("sample_bytes"), "content + coalesce(framed_samples, 0L) AS profile_bytes")


def scope_bytes(t: ProfileTables) -> DataFrame:
    profiles = profile_bytes(t).groupBy(*SCOPE_ID).agg(
        _sum(wire.framed("profile_bytes"), "framed_profiles"), _sum("profile_bytes", "profile_bytes"),
        _sum("sample_bytes", "sample_bytes"), F.count("*").alias("filled"))
    message = (
        f"{wire.text('scope_name')} + {wire.text('scope_version')} + coalesce(attribute_bytes, 0L)"
        f" + {wire.scalar('dropped_attributes_count')}"
    )
    # Profiles declared but not filled are encoded as empty messages.
    rest = (
        f"coalesce(framed_profiles, 0L) + (n_profiles - coalesce(filled, 0L)) * {_EMPTY_SLOT} + {wire.text('schema_url')}")
    joined = (
        t.scope_profiles.join(profiles, SCOPE_ID, "left")
        .join(_key_values(t.scope_attributes, SCOPE_ID), SCOPE_ID, "left")
        .selectExpr(
            *SCOPE_ID, "has_scope", f"CASE WHEN has_scope THEN {message} ELSE 0L END AS scope_message",
            _or_zero("sample_bytes"), _or_zero("profile_bytes"), f"{rest} AS _rest")
    )
    return joined.selectExpr(
        *SCOPE_ID, "sample_bytes", "profile_bytes", "scope_message",
        f"{wire.optional('has_scope', 'scope_message')} + _rest AS scope_bytes")


def _entity_refs(array: str) -> str:
    names = lambda a: wire.total(f"transform({a}, s -> CAST(octet_length(s) AS BIGINT))", wire.framed)
    content = f"{wire.text('e.schema_url')} + {wire.text('e.type')} + {names('e.id_keys')} + {names('e.description_keys')}"
    return wire.total(f"transform({array}, e -> {content})", wire.framed)


def scope_totals(t: ProfileTables) -> DataFrame:
    """What a resource's size takes from the scopes below it: (resource, sums, number of scopes with rows)."""
    return scope_bytes(t).groupBy(*RESOURCE_ID).agg(
        _sum(wire.framed("scope_bytes"), "framed_scopes"),
        *[_sum(c, c) for c in ("scope_message", "profile_bytes", "sample_bytes")], F.count("*").alias("filled"))


def resource_bytes(t: ProfileTables, scopes: DataFrame | None = None) -> DataFrame:
    """Content bytes of each resource, on ``scopes``, the ``scope_totals``, if these are known."""
    scopes = scope_totals(t) if scopes is None else scopes
    message = (
        f"coalesce(attribute_bytes, 0L) + {wire.scalar('dropped_attributes_count')} + {_entity_refs('entity_refs')}")
    rest = f"coalesce(framed_scopes, 0L) + (n_scopes - coalesce(filled, 0L)) * {_EMPTY_SLOT} + {wire.text('schema_url')}"
    passed = ("scope_message", "profile_bytes", "sample_bytes")
    joined = (
        t.resource_profiles.join(scopes, RESOURCE_ID, "left")
        .join(_key_values(t.resource_attributes, RESOURCE_ID), RESOURCE_ID, "left")
        .selectExpr(
            *RESOURCE_ID, "has_resource", *[_or_zero(c) for c in passed],
            f"CASE WHEN has_resource THEN {message} ELSE 0L END AS resource_message", f"{rest} AS _rest")
    )
    return joined.selectExpr(
        *RESOURCE_ID, *passed, "resource_message",
        f"{wire.optional('has_resource', 'resource_message')} + _rest AS resource_bytes")


def dictionary_entries(t: ProfileTables) -> DataFrame:
    """(payload_id, table_name, content bytes) of every entry of the seven tables."""
    contents = {
        "string": wire.string_content(t.dict_strings, ["payload_id"]),
        "mapping": wire.mapping_content(t.dict_mappings, ["payload_id"]),
        "location": wire.location_content(t.dict_locations, ["payload_id"]),
        "function": wire.function_content(t.dict_functions, ["payload_id"]),
        "link": wire.link_content(t.dict_links, ["payload_id"]),
        "attribute": wire.attribute_content(t.dict_attributes, ["payload_id"]),
        "stack": wire.stack_content(t.dict_stacks, ["payload_id"]),
    }
    named = [df.withColumn("table_name", F.lit(name)) for name, df in contents.items()]
    return reduce(DataFrame.unionByName, named)


def dictionary_table_bytes(t: ProfileTables) -> DataFrame:
    per_table = dictionary_entries(t).groupBy("payload_id", "table_name").agg(_sum(wire.framed("content"), "n"))
    columns = [
        _sum(f"CASE WHEN table_name = '{name}' THEN n END", f"dict_{name}_table_proto_bytes") for name in DICTIONARY_TABLES
    ]
    return per_table.groupBy("payload_id").agg(*columns, _sum("n", "dictionary_bytes"))


def message_bytes(t: ProfileTables) -> DataFrame:
    """The 13 message-size columns per payload."""
    tree = resource_bytes(t).groupBy("payload_id").agg(
        _sum(wire.framed("resource_bytes"), "resource_profiles_proto_bytes"),
        _sum("resource_message", "resource_messages_proto_bytes"),
        _sum("scope_message", "scope_messages_proto_bytes"),
        _sum("profile_bytes", "profile_messages_proto_bytes"),
        _sum("sample_bytes", "sample_messages_proto_bytes"),
    )
    tables = dictionary_table_bytes(t)
    names = [c for c in [*tree.columns, *tables.columns] if c.endswith("_proto_bytes")]
    joined = t.payloads.select("payload_id", "has_dictionary").join(tree, "payload_id", "left").join(
        tables, "payload_id", "left").withColumn("dictionary_bytes", F.expr("coalesce(dictionary_bytes, 0L)"))
    return joined.selectExpr(
        "payload_id", *[_or_zero(c) for c in names],
        f"{wire.optional('has_dictionary', 'dictionary_bytes')} AS dictionary_proto_bytes")


def payload_bytes(t: ProfileTables) -> DataFrame:
    """Encoded size of each payload: (payload_id, uncompressed_bytes)."""
    return message_bytes(t).selectExpr(
        "payload_id", "resource_profiles_proto_bytes + dictionary_proto_bytes AS uncompressed_bytes")


def string_table_bytes(t: ProfileTables) -> DataFrame:
    """(payload_id, string_bytes) of the string tables alone."""
    return wire.string_content(t.dict_strings, ["payload_id"]).groupBy("payload_id").agg(_sum(wire.framed("content"), "string_bytes"))


def bytes_of_parts(t: ProfileTables, resources: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(payload_id, uncompressed_bytes) from ``resource_bytes`` and (payload_id, dictionary_bytes)."""
    tree = resources.groupBy("payload_id").agg(_sum(wire.framed("resource_bytes"), "tree_bytes"))
    joined = t.payloads.select("payload_id", "has_dictionary").join(tree, "payload_id", "left").join(
        dictionary.select("payload_id", "dictionary_bytes"), "payload_id", "left")
    return joined.selectExpr("payload_id", "has_dictionary", _or_zero("tree_bytes"), _or_zero("dictionary_bytes")).selectExpr(
        "payload_id", f"tree_bytes + {wire.optional('has_dictionary', 'dictionary_bytes')} AS uncompressed_bytes")
