"""Stack frames by language, and how many frames carry a function name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.functions import values
from emberframe.functions.language import FRAME_TYPE_KEY, GO_BUILD_ID_KEY, frame_language
from emberframe.functions.numeric import ratio
from emberframe.operators.lookups import deref, observation_weight
from emberframe.schema import FRACTION_COLUMNS, LANGUAGES, SYMBOL_FRACTION_COLUMNS
from emberframe.tables import ProfileTables


def _attributes_with_key(t: ProfileTables, key: str) -> DataFrame:
    keys = t.dict_strings.where(F.col("value") == key).select("payload_id", F.col("idx").alias("key_strindex"))
    return t.dict_attributes.join(keys, ["payload_id", "key_strindex"], "left_semi")


def go_mappings(t: ProfileTables) -> DataFrame:
    """Mappings of Go binaries: (payload_id, mapping_index)."""
    marked = _attributes_with_key(t, GO_BUILD_ID_KEY).select("payload_id", F.col("idx").alias("attr"))
    return (
        t.dict_mappings.select("payload_id", F.col("idx").alias("mapping_index"),
                               F.explode("attribute_indices").alias("attr"))
        .join(marked, ["payload_id", "attr"], "left_semi")
        .select("payload_id", "mapping_index").distinct()
    )


def location_frame_types(t: ProfileTables) -> DataFrame:
    """First frame-type attribute of a location in list order, even if its text is empty."""
    typed = deref(_attributes_with_key(t, FRAME_TYPE_KEY), t.dict_strings, F.col("value")["s_ref"], "ref_text")
    typed = typed.select(
        "payload_id", F.col("idx").alias("attr"),
        F.expr(values.value_text("value", "ref_text")).alias("frame_type"),
    )
    return (
        t.dict_locations.select("payload_id", "idx", F.posexplode("attribute_indices").alias("pos", "attr"))
        .join(typed, ["payload_id", "attr"])
        .groupBy("payload_id", "idx").agg(F.min_by("frame_type", "pos").alias("frame_type"))
    )


def location_language(t: ProfileTables) -> DataFrame:
    """(payload_id, location_index, language) for every dictionary location."""
    go = go_mappings(t).withColumn("is_go", F.lit(True))
    return (
        t.dict_locations.select("payload_id", "idx", "mapping_index")
        .join(location_frame_types(t), ["payload_id", "idx"], "left")
        .join(go, ["payload_id", "mapping_index"], "left")
        .select(
            "payload_id", F.col("idx").alias("location_index"),
            frame_language(F.coalesce("frame_type", F.lit("")), F.coalesce("is_go", F.lit(False))).alias("language"),
        )
    )


def location_symbolized(t: ProfileTables) -> DataFrame:
    """1 for locations with any line whose function has a non-empty name."""
    named = t.dict_functions.join(
        t.dict_strings.where("value <> ''").select("payload_id", F.col("idx").alias("name_strindex")),
        ["payload_id", "name_strindex"], "left_semi",
    ).select("payload_id", F.col("idx").alias("function_index"))
    hit = (
        t.dict_locations.select("payload_id", "idx", F.explode("lines.function_index").alias("function_index"))
        .join(named, ["payload_id", "function_index"], "left_semi")
        .select("payload_id", "idx").distinct().withColumn("symbolized", F.lit(1))
    )
    return t.dict_locations.select("payload_id", "idx").join(hit, ["payload_id", "idx"], "left").select(
        "payload_id", F.col("idx").alias("location_index"), F.coalesce("symbolized", F.lit(0)).alias("symbolized")
    )


def frames_by_language(t: ProfileTables) -> DataFrame:
    """Observed frames per (payload, language).

    Weights are summed per stack before the stack is expanded, and per location
    before the language is looked up, so no join or expansion runs per sample
    and a stack that most samples share is one row.
    """
    per_stack = t.samples.groupBy("payload_id", F.col("stack_index").alias("idx")).agg(
        F.sum(observation_weight()).alias("weight"))
    per_location = (
        per_stack.join(t.dict_stacks, ["payload_id", "idx"])
        .select("payload_id", "weight", F.explode("location_indices").alias("location_index"))
        .groupBy("payload_id", "location_index").agg(F.sum("weight").alias("weight"))
    )
    return (
        per_location.join(location_language(t), ["payload_id", "location_index"], "left")
        .groupBy("payload_id", F.coalesce("language", F.lit("unknown")).alias("language"))
        .agg(F.sum("weight").cast("bigint").alias("frames"))
    )


def language_fractions(t: ProfileTables) -> DataFrame:
    """One row per payload with frames: total frames and the share of each language."""
    frames = frames_by_language(t)
    total = F.sum("frames").cast("bigint").alias("sampled_stack_frames_count")
    sums = [
        F.coalesce(F.sum(F.when(F.col("language") == name, F.col("frames"))), F.lit(0)).alias(f"_{name}")
        for name in LANGUAGES
    ]
    row = frames.groupBy("payload_id").agg(total, *sums)
    shares = [
        ratio(F.col(f"_{name}"), F.col("sampled_stack_frames_count")).alias(column)
        for name, column in zip(LANGUAGES, FRACTION_COLUMNS)
    ]
    return row.select("payload_id", "sampled_stack_frames_count", *shares)


def symbol_fractions(t: ProfileTables) -> DataFrame:
    """Share of dictionary locations with a function name, per payload and language; NULL if none."""
    both = location_language(t).join(location_symbolized(t), ["payload_id", "location_index"])
    per_language = both.groupBy("payload_id", "language").agg(
        F.sum("symbolized").alias("named"), F.count("*").alias("total"))
    columns = [
        ratio(
            F.sum(F.when(F.col("language") == name, F.col("named"))),
            F.sum(F.when(F.col("language") == name, F.col("total"))),
        ).alias(column)
        for name, column in zip(LANGUAGES, SYMBOL_FRACTION_COLUMNS)
    ]
    return per_language.groupBy("payload_id").agg(*columns)
