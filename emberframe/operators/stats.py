"""One statistics row per payload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.numeric import ratio, unsigned
from emberframe.functions.wire import length_of
from emberframe.operators.frames import language_fractions, symbol_fractions
from emberframe.operators.lookups import (
    deref, resolved_attributes, resolved_resource_attributes,
)
from emberframe.operators.ordinals import grouped_ordinal
from emberframe.operators.sizes import message_bytes
from emberframe.schema import STATS_COLUMNS
from emberframe.tables import ProfileTables


def _per_payload(df: DataFrame, **aggregates: Column) -> DataFrame:
    return df.groupBy("payload_id").agg(*[c.cast("bigint").alias(n) for n, c in aggregates.items()])


def _merge(t: ProfileTables, parts: list[DataFrame]) -> DataFrame:
    """Put per-payload parts side by side, 0 where a payload has no rows in a part."""
    names = [c for part in parts for c in part.columns if c != "payload_id"]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.payloads.select("payload_id"), *parts])
    return united.groupBy("payload_id").agg(*[F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias(n) for n in names])


def payload_tree_counts(t: ProfileTables) -> DataFrame:
    n = F.count("*")
    size = lambda c: F.expr(f"sum({length_of(c)})")
    return _merge(t, [
        _per_payload(t.resource_profiles, resource_profiles_count=n),
        _per_payload(t.resource_attributes, resource_profiles_attrs_count=n),
        _per_payload(t.scope_profiles, scope_profiles_count=n),
        _per_payload(t.scope_attributes, scope_profiles_attrs_count=n),
        _per_payload(
            t.profiles, profiles_count=n, profiles_attrs_count=size("attribute_indices"),
            original_payloads_sum_bytes=F.sum(F.coalesce(F.octet_length("original_payload"), F.lit(0))),
        ),
        _per_payload(
            t.samples, samples_count=n, values_count=size("values"), timestamps_count=size("timestamps"),
            sample_attrs_count=size("attribute_indices"),
        ),
    ])


def payload_dict_counts(t: ProfileTables) -> DataFrame:
    n = F.count("*")
    size = lambda c: F.expr(f"sum({length_of(c)})")
    return _merge(t, [
        _per_payload(t.dict_strings, dict_strings_count=n),
        _per_payload(t.dict_mappings, dict_mappings_count=n, mapping_attribute_indices_count=size("attribute_indices")),
        _per_payload(
            t.dict_locations, dict_locations_count=n, location_lines_count=size("lines"),
            location_attribute_indices_count=size("attribute_indices"),
        ),
        _per_payload(t.dict_functions, dict_functions_count=n),
        _per_payload(t.dict_links, dict_links_count=n),
        _per_payload(t.dict_attributes, dict_attributes_count=n),
        _per_payload(
            t.dict_stacks, dict_stacks_count=n, stack_locations_count=size("location_indices"),
            max_stack_depth=F.expr(f"max({length_of('location_indices')})"),
        ),
    ])


def _bytes(name: str) -> Column:
    return F.coalesce(F.octet_length(name), F.lit(0))


def payload_string_bytes(t: ProfileTables) -> DataFrame:
    functions = t.dict_functions
    for column in ("name", "system_name", "filename"):
        functions = deref(functions, t.dict_strings, f"{column}_strindex", f"_{column}")
    mappings = deref(t.dict_mappings, t.dict_strings, "filename_strindex", "_filename")
    return _merge(t, [
        _per_payload(t.dict_strings, dict_string_bytes=F.sum(_bytes("value")), dict_string_max_bytes=F.max(_bytes("value"))),
        _per_payload(
            functions, function_name_bytes=F.sum(_bytes("_name")), function_name_max_bytes=F.max(_bytes("_name")),
            function_system_name_bytes=F.sum(_bytes("_system_name")), function_filename_bytes=F.sum(_bytes("_filename")),
        ),
        _per_payload(mappings, mapping_filename_bytes=F.sum(_bytes("_filename"))),
        _per_payload(
            resolved_attributes(t), dict_attribute_key_bytes=F.sum(_bytes("key")),
            dict_attribute_unit_bytes=F.sum(_bytes("unit")), dict_attribute_value_bytes=F.sum("value_bytes"),
        ),
        _per_payload(
            resolved_resource_attributes(t), resource_attribute_key_bytes=F.sum(_bytes("key")),
            resource_attribute_value_bytes=F.sum("value_bytes"),
        ),
    ])


def payload_time_span(t: ProfileTables) -> DataFrame:
    """First start and last end over profiles with a start time; times beyond the signed range count as its last value."""
    start = unsigned(F.col("time_unix_nano"))
    end = start + unsigned(F.col("duration_nano"))
    within = lambda c: F.least(c, F.lit(2**63 - 1).cast("decimal(21,0)")).cast("bigint")
    span = t.profiles.where("time_unix_nano <> 0").groupBy("payload_id").agg(
        within(F.min(start)).alias("start_ts"), within(F.max(end)).alias("end_ts"),
    )
    return t.payloads.select("payload_id").join(span, "payload_id", "left").select(
        "payload_id", "start_ts", "end_ts", ((F.col("end_ts") - F.col("start_ts")) / F.lit(1e9)).alias("duration_sec"))


def payload_hosts(t: ProfileTables, host_key: str = "host.name") -> DataFrame:
    """(payload_id, host): a payload's first non-empty ``host_key`` attribute in tree order."""
    named = resolved_resource_attributes(t).where((F.col("key") == host_key) & (F.col("text") != ""))
    return named.groupBy("payload_id").agg(F.min_by("text", F.struct("rp_idx", "pos")).alias("host"))


def numbered_hosts(t: ProfileTables, hosts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(host, host_id) by the first payload that names a host; hosts in ``known`` keep their ids, new ones follow the largest."""
    placed = hosts.join(t.payloads.select("payload_id", "position"), "payload_id")
    first = placed.groupBy("host").agg(F.min("position").alias("first_payload"))
    if known is None:
        return grouped_ordinal(first, [], ["first_payload"], "host_id", start=1, kind="bigint").select("host", "host_id")
    known = known.select("host", F.col("host_id").cast("bigint").alias("host_id"))
    last = known.agg(F.coalesce(F.max("host_id"), F.lit(0))).first()[0]
    fresh = grouped_ordinal(first.join(known, "host", "left_anti"), [], ["first_payload"], "host_id", start=last + 1, kind="bigint")
    return known.unionByName(fresh.select("host", "host_id"))


def host_ids(t: ProfileTables, host_key: str = "host.name", known: DataFrame | None = None) -> DataFrame:
    """Hosts numbered 1.. by the first payload that names them; payloads without a host get 0.

    ``known`` (host, host_id) are hosts of earlier payloads, which keep their ids.
    """
    hosts = payload_hosts(t, host_key)
    numbered = hosts.join(numbered_hosts(t, hosts, known), "host")
    return t.payloads.select("payload_id").join(numbered, "payload_id", "left").select(
        "payload_id", F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("host_id", F.lit(0)).cast("bigint").alias("host_id"),
    )


def payload_stats(t: ProfileTables, host_key: str = "host.name", known_hosts: DataFrame | None = None) -> DataFrame:
    """The 86-column statistics row per payload; ``id`` is its position in path order."""
    parts = [
        payload_tree_counts(t), payload_dict_counts(t), payload_string_bytes(t), message_bytes(t),
        payload_time_span(t), language_fractions(t), symbol_fractions(t), host_ids(t, host_key, known_hosts).drop("host"),
    ]
    row = t.payloads.select("payload_id", "position", "n_bytes")
    for part in parts:
        row = row.join(part, "payload_id", "left")
    derived = {
        "id": F.col("position"),
        "uncompressed_bytes": F.coalesce(
            F.col("n_bytes"), F.col("resource_profiles_proto_bytes") + F.col("dictionary_proto_bytes")),
        "sampled_stack_frames_count": F.coalesce("sampled_stack_frames_count", F.lit(0)),
        "mean_stack_depth": ratio(F.col("stack_locations_count"), F.col("dict_stacks_count")),
        "mean_lines_per_location": ratio(F.col("location_lines_count"), F.col("dict_locations_count")),
        "mean_sample_attrs": ratio(F.col("sample_attrs_count"), F.col("samples_count")),
        "mean_timestamps_per_sample": ratio(F.col("timestamps_count"), F.col("samples_count")),
        "mean_values_per_sample": ratio(F.col("values_count"), F.col("samples_count")),
    }
    return row.select(*[derived.get(name, F.col(name)).cast(kind).alias(name) for name, kind in STATS_COLUMNS])
