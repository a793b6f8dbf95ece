"""Process context snapshots: validation and the current context of each process."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions import wire
from emberframe.operators.lookups import resolved_resource_attributes
from emberframe.tables import ProfileTables

# Fixed values of the published context format.
SIGNATURE = "OTEL_CTX"
VERSION = 2
REQUIRED_KEYS = (
    "deployment.environment.name", "service.instance.id", "service.name", "service.version",
    "telemetry.sdk.language", "telemetry.sdk.version", "telemetry.sdk.name",
)
KEY_VALUE_LIMIT = 4096
RESOURCE_SIZE_LIMIT = 16383
OTHER_PAIRS_LIMIT = 100
SCHEMA_VERSION_KEY = "threadlocal.schema_version"
KEY_MAP_KEY = "threadlocal.attribute_key_map"

SNAPSHOT = (
    "host string,pid bigint,signature string,version int,published_at_ns bigint,"
    "attributes array<struct<key:string,value:string>>,extra array<struct<key:string,value:string>>"
)


def encoded_pairs_bytes(c: str) -> Column:
    """Encoded size of string pairs as repeated key-value messages."""
    size = lambda s: wire.framed(f"octet_length({s})")
    # Each stage binds a length to a variable that the next size expression repeats.
    pairs = f"transform({c}, p -> struct({size('p.key')} AS k, {size('p.value')} AS v))"
    entries = f"transform({pairs}, q -> q.k + {wire.framed('q.v')})"
    return F.expr(wire.total(entries, wire.framed))


def context_findings(snapshots: DataFrame) -> DataFrame:
    """(host, pid, published_at_ns, rule, message) for every broken rule of a snapshot."""
    # Keys are extracted once; counting by removal needs no function per element.
    times = lambda array, key: f"size({array}) - size(array_remove({array}, '{key}'))"
    counts = {f"_n{i}": times("_keys", key) for i, key in enumerate(REQUIRED_KEYS)}
    reserved = " - ".join(f"({times('_extra_keys', k)})" for k in (SCHEMA_VERSION_KEY, KEY_MAP_KEY))
    staged = snapshots.selectExpr("*", "attributes.key AS _keys", "extra.key AS _extra_keys").selectExpr(
        "*", *[f"{sql} AS {name}" for name, sql in counts.items()],
        "greatest(array_max(transform(_keys, k -> octet_length(k))), array_max(transform(_extra_keys, k -> octet_length(k)))) AS _longest_key",
        "greatest(array_max(transform(attributes, x -> octet_length(x.value))), array_max(transform(extra, x -> octet_length(x.value))))"
        " AS _longest_value",
    )
    others = F.expr(f"size(_keys) - {' - '.join(counts)}")
    extra_others = F.expr(f"size(_extra_keys) - {reserved}")
    has = lambda key: F.array_contains("_extra_keys", key)
    rules = [
        (F.col("signature") != SIGNATURE, "signature", F.lit("invalid signature")),
        (F.col("version") != VERSION, "version", F.lit("invalid version")),
        (F.col("_longest_key") > KEY_VALUE_LIMIT, "key_length", F.lit("length of key exceeds 4096 limit")),
        (F.col("_longest_value") > KEY_VALUE_LIMIT, "value_length", F.lit("length of value exceeds 4096 limit")),
        (F.col("_resource_bytes") > RESOURCE_SIZE_LIMIT, "resource_size",
         F.concat(F.lit("encoded size of resource attributes is "), F.col("_resource_bytes").cast("string"))),
        (others > OTHER_PAIRS_LIMIT, "resource_pairs", F.lit("too many resource attributes")),
        (extra_others > OTHER_PAIRS_LIMIT, "extra_pairs", F.lit("too many extra attributes")),
        (has(KEY_MAP_KEY) & ~has(SCHEMA_VERSION_KEY), "key_map", F.lit("attribute_key_map requires schema_version")),
    ]
    for n, key in zip(counts, REQUIRED_KEYS):
        rules.append((F.col(n) == 0, "missing_key", F.lit(f"missing {key}")))
        rules.append((F.col(n) > 1, "repeated_key", F.lit(f"repeated {key}")))
    found = F.filter(
        F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), m.alias("message"))) for c, r, m in rules]),
        lambda x: x.isNotNull())
    return staged.withColumn("_resource_bytes", encoded_pairs_bytes("attributes")).select(
        "host", "pid", "published_at_ns", F.inline(found))


def current_context(snapshots: DataFrame) -> DataFrame:
    """Newest published snapshot per (host, pid); time 0 marks an update in progress."""
    columns = [c for c in snapshots.columns if c not in ("host", "pid", "published_at_ns")]
    return (
        snapshots.where("published_at_ns > 0").groupBy("host", "pid")
        .agg(F.max(F.struct("published_at_ns", *columns)).alias("c"))
        .select("host", "pid", "c.*")
    )


def attach_context(t: ProfileTables, current: DataFrame, host_key: str = "host.name") -> DataFrame:
    """Resources that name a process, with the context published by that process."""
    attrs = resolved_resource_attributes(t).withColumn("name", F.coalesce(
        F.when(F.col("key_ref") != 0, F.col("ref_key")), F.col("key")))
    wide = attrs.where(F.col("name").isin(host_key, "process.pid")).groupBy("payload_id", "rp_idx").agg(
        F.max(F.when(F.col("name") == host_key, F.col("text"))).alias("host"),
        F.max(F.when(F.col("name") == "process.pid", F.col("text"))).cast("bigint").alias("pid"))
    return wide.where("pid IS NOT NULL").join(current, ["host", "pid"], "left")
