"""Readable listing of payloads: Resource, Scope, Profile and Sample lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.numeric import wrapped
from emberframe.operators.lookups import (
    canonical_resources, canonical_sample_attrs, canonical_scopes, deref,
)
from emberframe.schema import PROFILE_ID, RESOURCE_ID, SCOPE_ID
from emberframe.sources.stats_csv import utc_parts
from emberframe.tables import ProfileTables

LINE_ID = ("rp_idx", "sp_idx", "p_idx", "s_idx")


def _time(ns: Column) -> Column:
    text, fraction = utc_parts(ns, "yyyy-MM-dd HH:mm:ss")
    return F.concat(text, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit(" +0000 UTC"))


def _lines(df: DataFrame, line: Column) -> DataFrame:
    ordinal = lambda c: (F.col(c) if c in df.columns else F.lit(-1)).cast("int").alias(c)
    return df.select("payload_id", *[ordinal(c) for c in LINE_ID], line.alias("line"))


def listing(t: ProfileTables) -> DataFrame:
    """One row per line; levels that do not apply have ordinal -1.

    In listings a profile's time is its end and the start is one duration
    before it, unlike in the checks and statistics.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    resources = t.resource_profiles.select(*RESOURCE_ID).join(canonical_resources(t), RESOURCE_ID, "left")
    scopes = t.scope_profiles.select(*SCOPE_ID, "scope_name").join(canonical_scopes(t), SCOPE_ID, "left")
    profiles = t.profiles.select(
        *PROFILE_ID, F.col("sample_type")["type_strindex"].alias("_type"), F.col("sample_type")["unit_strindex"].alias("_unit"),
        F.col("time_unix_nano").alias("_end"),
        wrapped(F.col("time_unix_nano").cast("decimal(20,0)") - F.col("duration_nano").cast("decimal(20,0)")).alias("_start"))
    profiles = deref(deref(profiles, t.dict_strings, "_type", "type"), t.dict_strings, "_unit", "unit")
    samples = canonical_sample_attrs(t)
    parts = [
        _lines(resources, F.concat(F.lit("Resource: "), text("resource_text"))),
        _lines(scopes, F.concat(F.lit("  Scope: "), text("scope_name"), F.lit(": "), text("scope_text"))),
        _lines(profiles, F.concat(
            F.lit("    Profile: "), text("type"), F.lit("="), text("unit"), F.lit(" ("), _time(F.col("_start")), F.lit(" - "),
            _time(F.col("_end")), F.lit(")"))),
        _lines(samples, F.concat(F.lit("      Sample: "), F.col("attributes_text"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_listing(t: ProfileTables, path: str, mode: str = "errorifexists") -> None:
    """Write the listing as text, globally sorted across the part files."""
    ordered = listing(t).orderBy("payload_id", *LINE_ID)
    ordered.select(F.col("line").alias("value")).write.mode(mode).text(path)
