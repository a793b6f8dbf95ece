"""Dictionary look-ups: index columns resolved by equi-joins on (payload_id, idx).

Joining on both columns spreads a payload that holds a large share of all rows
over many partitions.  An index outside its table finds no row, which is the
"not set" case of every look-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions import values
from emberframe.schema import SAMPLE_ID
from emberframe.tables import ProfileTables


def deref(df: DataFrame, strings: DataFrame, index: Column | str, name: str) -> DataFrame:
    """Add ``name``: the string at ``index``, NULL when out of range."""
    index = F.col(index) if isinstance(index, str) else index
    lookup = strings.select(
        F.col("payload_id"), F.col("idx").alias("_idx"), F.col("value").alias(name)
    )
    return df.withColumn("_idx", index).join(lookup, ["payload_id", "_idx"], "left").drop("_idx")


def deref_function_names(t: ProfileTables) -> DataFrame:
    named = deref(t.dict_functions, t.dict_strings, "name_strindex", "_name")
    name = F.coalesce("_name", F.lit(""))
    return named.select(
        "payload_id", F.col("idx").alias("function_index"), name.alias("function_name"),
        F.octet_length(name).cast("bigint").alias("name_bytes"),
    )


def _value_forms() -> list[str]:
    return [
        f"{values.value_text('value', 'ref_text')} AS text", f"{values.listing_text('value', 'ref_text')} AS listing",
        f"{values.payload_bytes('value', 'ref_text')} AS value_bytes",
    ]


def resolved_attributes(t: ProfileTables) -> DataFrame:
    """dict_attributes with key, unit, text forms and payload bytes of the value."""
    df = deref(t.dict_attributes, t.dict_strings, "key_strindex", "key")
    df = deref(df, t.dict_strings, "unit_strindex", "unit")
    df = deref(df, t.dict_strings, F.col("value")["s_ref"], "ref_text")
    return df.selectExpr(
        "payload_id", "idx", "key_strindex", "unit_strindex", "key", "unit", "value", *_value_forms())


def anyvalue_text(t: ProfileTables) -> DataFrame:
    df = resolved_attributes(t)
    return df.select(
        "payload_id", F.col("idx").alias("attribute_index"), F.coalesce("key", F.lit("")).alias("key"), "text"
    )


def resolved_resource_attributes(t: ProfileTables) -> DataFrame:
    df = deref(t.resource_attributes, t.dict_strings, F.col("value")["s_ref"], "ref_text")
    df = deref(df, t.dict_strings, F.when(F.col("key_ref") != 0, F.col("key_ref")), "ref_key")
    return df.selectExpr("payload_id", "rp_idx", "pos", "key", "key_ref", "value", "ref_key", *_value_forms())


def anyvalue_bytes(t: ProfileTables) -> DataFrame:
    """Payload bytes of every dictionary and resource attribute value."""
    entries = resolved_attributes(t).select(
        F.lit("attribute").alias("owner"), "payload_id", F.lit(-1).alias("rp_idx"),
        F.col("idx").alias("pos"), "value_bytes",
    )
    resources = resolved_resource_attributes(t).select(
        F.lit("resource").alias("owner"), "payload_id", "rp_idx", "pos", "value_bytes"
    )
    return entries.unionByName(resources)


def attribute_lists(t: ProfileTables, owner: DataFrame) -> DataFrame:
    """Distinct ``attribute_indices`` lists of ``owner`` exploded and resolved, list order in ``pos``."""
    lists = owner.select("payload_id", "attribute_indices").where(
        F.size("attribute_indices") > 0).distinct()
    items = lists.select(
        "payload_id", "attribute_indices", F.posexplode("attribute_indices").alias("pos", "idx")
    )
    return items.join(resolved_attributes(t), ["payload_id", "idx"], "left")


def canonical_lists(t: ProfileTables, owner: DataFrame) -> DataFrame:
    """(payload_id, attribute_indices) -> canonical text ``&k=v[ &unit]``, sorted by key.

    An index without an entry is ``&?[index]`` and comes first.
    """
    unit = F.when(F.col("unit_strindex") != 0, F.concat(F.lit(" &"), F.coalesce("unit", F.lit("")))).otherwise("")
    key = F.coalesce("key", F.lit(""))
    part = F.struct(
        key.alias("key"), F.col("pos"),
        F.when(F.col("key_strindex").isNull(), F.concat(F.lit("&?["), F.col("idx").cast("string"), F.lit("]")))
        .otherwise(F.concat(F.lit("&"), key, F.lit("="), F.col("listing"), unit)).alias("part"),
    )
    # A list is one message field, so the group is as small as one row of the input.
    return attribute_lists(t, owner).groupBy("payload_id", "attribute_indices").agg(
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"])).alias("attributes_text")
    )


def canonical_sample_attrs(t: ProfileTables) -> DataFrame:
    return t.samples.select(*SAMPLE_ID, "attribute_indices").join(
        canonical_lists(t, t.samples), ["payload_id", "attribute_indices"], "left"
    ).select(*SAMPLE_ID, F.coalesce("attributes_text", F.lit("")).alias("attributes_text"))


def canonical_resources(t: ProfileTables, attributes: DataFrame | None = None) -> DataFrame:
    """(payload_id, rp_idx) -> canonical text of the resource attributes, sorted by resolved key."""
    return _canonical_key_values(
        resolved_resource_attributes(t) if attributes is None else attributes, ["payload_id", "rp_idx"]
    )


def _canonical_key_values(df: DataFrame, owner: list[str]) -> DataFrame:
    key = F.when(F.col("key_ref") != 0, F.coalesce("ref_key", F.lit(""))).otherwise(F.col("key"))
    shown = F.when(F.col("key_ref") != 0, F.concat(F.lit("&"), key)).otherwise(key)
    part = F.struct(key.alias("key"), F.col("pos"), F.concat(shown, F.lit("="), F.col("listing")).alias("part"))
    return df.groupBy(*owner).agg(
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"])).alias("resource_text")
    )


def canonical_scopes(t: ProfileTables) -> DataFrame:
    df = deref(t.scope_attributes, t.dict_strings, F.col("value")["s_ref"], "ref_text")
    df = deref(df, t.dict_strings, F.when(F.col("key_ref") != 0, F.col("key_ref")), "ref_key")
    df = df.withColumn("listing", F.expr(values.listing_text("value", "ref_text")))
    return _canonical_key_values(df, ["payload_id", "rp_idx", "sp_idx"]).withColumnRenamed(
        "resource_text", "scope_text")


def observation_weight() -> Column:
    """Number of timestamps, else of values, else 1."""
    n_ts, n_values = F.size("timestamps"), F.size("values")
    return F.when(n_ts > 0, n_ts).when(n_values > 0, n_values).otherwise(1).cast("bigint")


# Names of the sample shapes.
SHAPE_BOTH, SHAPE_VALUES = "both_values_and_timestamps", "values_only"
SHAPE_TIMESTAMPS, SHAPE_INVALID = "timestamps_only", "unspecified"


def sample_shape() -> Column:
    has_values, has_ts = F.size("values") > 0, F.size("timestamps") > 0
    return (
        F.when(has_values & has_ts, SHAPE_BOTH).when(has_values, SHAPE_VALUES)
        .when(has_ts, SHAPE_TIMESTAMPS).otherwise(SHAPE_INVALID)
    )


def sample_weights(t: ProfileTables) -> DataFrame:
    return t.samples.select(*SAMPLE_ID, observation_weight().alias("weight"))


def sample_shapes(t: ProfileTables) -> DataFrame:
    return t.samples.select(*SAMPLE_ID, sample_shape().alias("shape"))
