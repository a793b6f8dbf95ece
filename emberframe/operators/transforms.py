"""Payload rewrites: repeated samples, split by process, resource attributes in the string table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.values import make_value
from emberframe.operators.lookups import attribute_lists, canonical_resources, resolved_attributes
from emberframe.operators.ordinals import grouped_ordinal
from emberframe.schema import KEY_VALUE, PROFILE_ID, RESOURCE_ID, SCOPE_ID
from emberframe.session import by_payload, stash
from emberframe.tables import ProfileTables

# Sample attributes that describe a process.
PROCESS_KEYS = ("process.pid", "process.executable.name", "process.executable.path")

# A payload of more samples is split across partitions; it need not fit a task.
SMALL_PAYLOAD = 20_000
_GROUP = ["payload_id", "r_key", "process_text"]
_ENCOUNTER = ["rp_idx", "sp_idx", "p_idx", "s_idx"]


def scale_samples(t: ProfileTables, factor: int) -> ProfileTables:
    """Repeat the sample list of every profile ``factor`` times, in order (list, list, ...)."""
    if factor <= 1:
        return t
    counts = t.samples.groupBy(*PROFILE_ID).agg(F.count("*").alias("_n"))
    copies = t.samples.join(counts, PROFILE_ID).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    samples = copies.withColumn("s_idx", (F.col("_copy") * F.col("_n") + F.col("s_idx")).cast("int"))
    return t.with_tables(samples=samples.select(*t.samples.columns))


def process_lists(t: ProfileTables) -> DataFrame:
    """Per distinct attribute list: its process attributes (list order), their key text, and the rest."""
    items = attribute_lists(t, t.samples)
    key = F.coalesce("key", F.lit(""))
    is_process = key.isin(*PROCESS_KEYS)
    shown = F.struct(
        key.alias("key"), F.col("pos"), F.concat(F.lit("&"), key, F.lit("="), F.col("listing")).alias("part"))
    moved = F.struct(F.col("pos"), F.struct(key.alias("key"), F.lit(0).alias("key_ref"), "value").cast(KEY_VALUE).alias("kv"))
    kept = F.struct("pos", "idx")
    checked = items.withColumn("value", F.when(
        is_process & (F.col("unit_strindex") != 0),
        F.raise_error(F.lit("cannot split by a process attribute that has a unit")).cast(items.schema["value"].dataType),
    ).otherwise(F.col("value")))
    collect = lambda cond, c: F.array_sort(F.collect_list(F.when(cond, c)))
    return checked.groupBy("payload_id", "attribute_indices").agg(
        F.concat_ws(", ", F.transform(collect(is_process, shown), lambda x: x["part"])).alias("process_text"),
        F.transform(_in_order(is_process, moved), lambda x: x["kv"]).alias("process_attrs"),
        F.transform(_in_order(~is_process, kept), lambda x: x["idx"]).alias("other_indices"),
    )


def _in_order(condition, c):
    """Collect structs whose first field is ``pos`` and sort on it (values need not be comparable)."""
    return F.array_sort(
        F.collect_list(F.when(condition, c)),
        lambda a, b: a["pos"] - b["pos"],
    )


def split_by_process(t: ProfileTables, limit: int = SMALL_PAYLOAD) -> ProfileTables:
    """Move process attributes from samples to resources.

    Samples are regrouped under (resource text, process text); scope and profile
    slots keep their ordinals.  Groups are numbered by the first sample that
    opens them, and metadata comes from that sample's resource, scope and profile.
    Payloads of up to ``limit`` samples are regrouped where they lie, larger ones
    across partitions.
    """
    large = t.samples.groupBy("payload_id").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("payload_id")
    large = stash(large, "split-large-payloads")
    restricted = lambda how: t.with_tables(samples=t.samples.join(large, "payload_id", how))
    with by_payload(t.payloads.sparkSession):
        numbered, slots, samples = _regrouped_in_place(restricted("left_anti"))
    if not large.isEmpty():
        spread = _regrouped(restricted("left_semi"))
        numbered, slots, samples = (a.unionByName(b) for a, b in zip((numbered, slots, samples), spread))

    scopes = slots.groupBy("payload_id", "new_rp", "sp_idx").agg(
        F.min("rp_idx").alias("rp_idx"), F.max("p_idx").alias("last_p"))
    n_slots = scopes.groupBy("payload_id", "new_rp").agg(F.max("sp_idx").alias("last_sp"))

    profiles = slots.join(_without_payload(t.profiles), PROFILE_ID).drop("rp_idx")
    scope_profiles = scopes.join(t.scope_profiles, SCOPE_ID).withColumn(
        "n_profiles", F.greatest("n_profiles", F.col("last_p") + 1)).drop("rp_idx", "last_p")
    scope_attributes = scopes.join(t.scope_attributes, SCOPE_ID).drop("rp_idx", "last_p")
    resource_profiles = (
        numbered.select("payload_id", "new_rp", "rp_idx").join(t.resource_profiles, RESOURCE_ID)
        .join(n_slots, ["payload_id", "new_rp"])
        .withColumn("n_scopes", F.greatest("n_scopes", F.col("last_sp") + 1))
        .withColumn("has_resource", F.lit(True)).drop("rp_idx", "last_sp")
    )
    resource_attributes = _split_resource_attributes(t, numbered)

    rename = lambda df, like: df.withColumnRenamed("new_rp", "rp_idx").select(*like.columns)
    tables = dict(
        resource_profiles=rename(resource_profiles, t.resource_profiles),
        resource_attributes=rename(resource_attributes, t.resource_attributes),
        scope_profiles=rename(scope_profiles, t.scope_profiles),
        scope_attributes=rename(scope_attributes, t.scope_attributes),
        profiles=rename(profiles, t.profiles),
        samples=samples.select(*t.samples.columns),
    )
    counts = numbered.groupBy("payload_id").agg(F.count("*").cast("int").alias("_n"))
    payloads = t.payloads.join(counts, "payload_id", "left").withColumn(
        "n_resource_profiles", F.coalesce("_n", F.lit(0))).withColumn("n_bytes", F.lit(None).cast("bigint"))
    return t.with_tables(payloads=payloads.select(*t.payloads.columns), **tables)


def _without_payload(profiles: DataFrame) -> DataFrame:
    """A decoded profile without original payload has an empty one."""
    return profiles.withColumn("original_payload", F.when(
        F.octet_length("original_payload") > 0,
        F.raise_error(F.lit("cannot split a profile that carries its original payload")).cast("binary"),
    ))


def _resource_keys(t: ProfileTables) -> DataFrame:
    """Group keys are short: a resource is named by the first resource with the same text."""
    resources = t.resource_profiles.select(*RESOURCE_ID).join(canonical_resources(t), RESOURCE_ID, "left").select(
        *RESOURCE_ID, F.coalesce("resource_text", F.lit("")).alias("resource_text"))
    same_text = resources.groupBy("payload_id", "resource_text").agg(F.min("rp_idx").alias("r_key"))
    return resources.join(same_text, ["payload_id", "resource_text"]).select(*RESOURCE_ID, "r_key")


def _keyed(samples: DataFrame, lists: DataFrame, resource_keys: DataFrame) -> DataFrame:
    return samples.join(lists, ["payload_id", "attribute_indices"], "left").join(resource_keys, RESOURCE_ID).withColumn(
        "process_text", F.coalesce("process_text", F.lit("")))


def _opened(keyed: DataFrame) -> DataFrame:
    """One row per group: the sample that opens it, and that sample's process attributes."""
    encounter = F.struct(*_ENCOUNTER)
    opened = keyed.groupBy(*_GROUP).agg(F.min(encounter).alias("first"), F.min_by("process_attrs", encounter).alias("process_attrs"))
    return opened.select(*_GROUP, "process_attrs", *[F.col("first")[c].alias(c) for c in _ENCOUNTER])


def _moved(keyed: DataFrame, numbered: DataFrame) -> DataFrame:
    return keyed.join(numbered.select(*_GROUP, "new_rp"), _GROUP).select(
        "payload_id", "new_rp", *_ENCOUNTER, "stack_index", "values",
        F.coalesce("other_indices", F.array().cast("array<int>")).alias("attribute_indices"), "link_index", "timestamps")


def _process_entries(t: ProfileTables) -> DataFrame:
    """Per payload its process attributes: their indexes, and in the same order keys, texts and what becomes of them."""
    key = F.coalesce("key", F.lit(""))
    entry = F.struct(
        "idx", key.alias("key"), F.concat(F.lit("&"), key, F.lit("="), F.col("listing")).alias("part"),
        (F.col("unit_strindex") != 0).alias("has_unit"),
        F.struct(key.alias("key"), F.lit(0).alias("key_ref"), "value").cast(KEY_VALUE).alias("kv"))
    entries = resolved_attributes(t).where(key.isin(*PROCESS_KEYS)).groupBy("payload_id").agg(
        F.array_sort(F.collect_list(entry), lambda a, b: a["idx"] - b["idx"]).alias("entries"))
    each = lambda c: F.transform("entries", lambda e: e[c]).alias(f"process_{c}")
    return entries.select("payload_id", *[each(c) for c in ("idx", "key", "part", "has_unit", "kv")])


def _regrouped_in_place(t: ProfileTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, slots with their old resources, and samples renumbered; run inside ``session.by_payload``.

    Samples move by payload once, and are grouped and numbered where they lie.
    """
    entries = stash(_process_entries(t), "process-entries")
    light = entries.drop("process_kv").repartition("payload_id")
    resource_keys = stash(_resource_keys(t), "split-resource-keys").repartition("payload_id")
    at = lambda i: F.coalesce(F.array_position("process_idx", i), F.lit(0))
    names = F.transform("_at", lambda k, pos: F.struct(
        F.col("process_key")[(k - 1).cast("int")].alias("key"), pos.alias("pos"),
        F.col("process_part")[(k - 1).cast("int")].alias("part")))
    unit = F.exists("_at", lambda k: F.col("process_has_unit")[(k - 1).cast("int")])
    refused = F.raise_error(F.lit("cannot split by a process attribute that has a unit")).cast("string")
    keyed = (
        t.samples.repartition("payload_id").join(resource_keys, RESOURCE_ID).join(light, "payload_id", "left")
        .withColumn("process_indices", F.filter("attribute_indices", lambda i: at(i) > 0))
        .withColumn("_at", F.transform("process_indices", at))
        .select(
            *_ENCOUNTER, "payload_id", "r_key", "stack_index", "values", "link_index", "timestamps", "process_indices",
            F.when(unit, refused).otherwise(
                F.concat_ws(", ", F.transform(F.array_sort(names), lambda x: x["part"]))).alias("process_text"),
            F.coalesce(F.filter("attribute_indices", lambda i: at(i) == 0), F.array().cast("array<int>")).alias("attribute_indices"))
    )
    encounter = F.struct(*_ENCOUNTER)
    opened = keyed.withColumn("_first", F.min(encounter).over(Window.partitionBy(*_GROUP)))
    order = Window.partitionBy("payload_id").orderBy("_first", "r_key", "process_text")
    numbered = opened.withColumn("new_rp", F.dense_rank().over(order) - 1)
    # Several input resources may share a slot; their samples follow in input order.
    order = Window.partitionBy("payload_id", "new_rp", "sp_idx", "p_idx").orderBy("rp_idx", "s_idx")
    opens = encounter.eqNullSafe(F.col("_first")) & (F.col("_s") == 0)
    placed = stash(numbered.withColumn("_s", F.row_number().over(order) - 1).select(
        "payload_id", "new_rp", "rp_idx", "sp_idx", "p_idx", F.col("_s").alias("s_idx"), "stack_index", "values", "attribute_indices",
        "link_index", "timestamps", opens.alias("opens"), F.when(opens, F.col("process_indices")).alias("process_indices"),
    ), "split-samples")

    kv = F.transform("process_indices", lambda i: F.col("process_kv")[(F.array_position("process_idx", i) - 1).cast("int")])
    groups = placed.where("opens").select("payload_id", "new_rp", "rp_idx", "process_indices")
    groups = stash(groups.join(entries.select("payload_id", "process_idx", "process_kv"), "payload_id", "left").select(
        "payload_id", "new_rp", "rp_idx", kv.alias("process_attrs")), "split-groups")
    # A slot's first sample comes from the first of its old resources.
    slots = placed.where("s_idx = 0").select("payload_id", "new_rp", "sp_idx", "p_idx", "rp_idx")
    samples = placed.where("sp_idx IS NOT NULL AND p_idx IS NOT NULL").drop("rp_idx", "opens", "process_indices")
    return groups, slots, samples.withColumnRenamed("new_rp", "rp_idx")


def _regrouped(t: ProfileTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``_regrouped_in_place``, of payloads that may be as large as the table: each is spread over many partitions."""
    lists = stash(process_lists(t), "process-lists")
    keyed = _keyed(t.samples, lists, _resource_keys(t))
    numbered = stash(grouped_ordinal(_opened(keyed), ["payload_id"], _ENCOUNTER, "new_rp"), "split-groups")
    placed = stash(_moved(keyed, numbered), "split-samples")
    samples = grouped_ordinal(
        placed.withColumnRenamed("s_idx", "_s"), ["payload_id", "new_rp", "sp_idx", "p_idx"], ["rp_idx", "_s"], "s_idx")
    slots = placed.groupBy("payload_id", "new_rp", "sp_idx", "p_idx").agg(F.min("rp_idx").alias("rp_idx"))
    return (numbered.select("payload_id", "new_rp", "rp_idx", "process_attrs"), slots,
            samples.drop("rp_idx", "_s").withColumnRenamed("new_rp", "rp_idx"))


def _split_resource_attributes(t: ProfileTables, numbered: DataFrame) -> DataFrame:
    """Original attributes first, then the process attributes of the opening sample."""
    opening = numbered.select("payload_id", "new_rp", "rp_idx", "process_attrs")
    original = opening.drop("process_attrs").join(t.resource_attributes, RESOURCE_ID).drop("rp_idx")
    n_original = t.resource_attributes.groupBy(*RESOURCE_ID).agg((F.max("pos") + 1).alias("_n"))
    added = (
        opening.join(n_original, RESOURCE_ID, "left")
        .select("payload_id", "new_rp", F.coalesce("_n", F.lit(0)).alias("_n"), F.posexplode("process_attrs").alias("_i", "_kv"))
        .select("payload_id", "new_rp", (F.col("_n") + F.col("_i")).alias("pos"), "_kv.key", "_kv.key_ref", "_kv.value")
    )
    return original.unionByName(added)


def new_resource_strings(t: ProfileTables) -> DataFrame:
    """Every literal string of resource attributes in encounter order: value before key.

    Attributes whose key is already a reference stay untouched.  ``at`` orders by
    resource, position and which of the two, in one number, so that the least is
    found without a sort.
    """
    literal = t.resource_attributes.where("key_ref = 0")
    order = lambda which: F.shiftleft(F.col("rp_idx").cast("bigint"), 32) + F.col("pos").cast("bigint") * 2 + which
    texts = literal.select("payload_id", F.explode(F.array(
        F.struct(F.when(F.col("value")["kind"] == "string", F.col("value")["s"]).alias("value"), order(0).alias("at")),
        F.struct(F.col("key").alias("value"), order(1).alias("at")),
    )).alias("x"))
    return texts.select("payload_id", "x.value", "x.at").where("value IS NOT NULL").groupBy("payload_id", "value").agg(
        F.min("at").alias("at"))


def intern_resource_strings(t: ProfileTables) -> DataFrame:
    """(payload_id, value, idx, is_new): index of every resource string after interning."""
    wanted = new_resource_strings(t)
    known = t.dict_strings.join(wanted.select("payload_id", "value"), ["payload_id", "value"], "left_semi").groupBy(
        "payload_id", "value").agg(F.min("idx").alias("idx"))
    both = stash(wanted.join(known, ["payload_id", "value"], "left"), "intern-strings")
    fresh = both.where("idx IS NULL").select("payload_id", "value", "at")
    numbered = grouped_ordinal(fresh, ["payload_id"], ["at"], "_n")
    appended = numbered.join(t.payloads.select("payload_id", "n_strings"), "payload_id").select(
        "payload_id", "value", (F.col("n_strings") + F.col("_n")).cast("int").alias("idx"), F.lit(1).alias("is_new"))
    return both.where("idx IS NOT NULL").select("payload_id", "value", "idx", F.lit(0).alias("is_new")).unionByName(appended)


def resource_attr_dict(t: ProfileTables) -> ProfileTables:
    """Replace literal resource keys and string values by string-table indexes."""
    interned = stash(intern_resource_strings(t), "interned")
    index = lambda source, out: interned.select(
        "payload_id", F.col("value").alias(source), F.col("idx").alias(out))
    attrs = t.resource_attributes.withColumn("_s", F.when(
        (F.col("key_ref") == 0) & (F.col("value")["kind"] == "string"), F.col("value")["s"]))
    joined = attrs.join(index("key", "_k"), ["payload_id", "key"], "left").join(
        index("_s", "_v"), ["payload_id", "_s"], "left")
    untouched = F.col("key_ref") != 0
    resource_attributes = joined.select(
        *RESOURCE_ID, "pos",
        F.when(untouched, F.col("key")).otherwise("").alias("key"),
        F.when(untouched, F.col("key_ref")).otherwise(F.col("_k")).alias("key_ref"),
        F.when(F.col("_v").isNotNull(), make_value("string_ref", F.col("_v"), F.octet_length("_s")))
        .otherwise(F.col("value")).alias("value"),
    )
    added = interned.where("is_new = 1").select("payload_id", "idx", "value")
    counts = added.groupBy("payload_id").agg(F.count("*").cast("int").alias("_n"))
    payloads = t.payloads.join(counts, "payload_id", "left").withColumn(
        "n_strings", (F.col("n_strings") + F.coalesce("_n", F.lit(0))).cast("int")).withColumn(
        "n_bytes", F.lit(None).cast("bigint"))
    return t.with_tables(
        payloads=payloads.select(*t.payloads.columns), resource_attributes=resource_attributes,
        dict_strings=t.dict_strings.select("payload_id", "idx", "value").unionByName(added),
    )
