"""Profiles seen in the order tables: ``lineitem`` and ``part`` as payload tables.

payload = supplier, resource = return flag, scope = line status, profile = ship
year, sample = line item, stack = part (frames: the words of its name and its
type), process = order key mod 8 with the brand as executable.  Some payloads
carry faults on purpose (duplicate strings and mappings, orphans, mixed sample
shapes, broken links), so every check has findings.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberframe.functions.values import make_value, no_value
from emberframe.operators.ordinals import grouped_ordinal
from emberframe.schema import ENTITY_REF, LINE, PROFILE_ID, RESOURCE_ID, SAMPLE_ID, SCOPE_ID, VALUE_TYPE
from emberframe.session import by_payload, configure, stash, tasks_for
from emberframe.tables import ProfileTables

DAY_NS = 86_400_000_000_000

# Fixed string-table head of every payload.
HEAD_STRINGS = (
    "", "samples", "count", "process.pid", "process.executable.name", "thread.id",
    "profile.frame.type", "process.executable.build_id.go", "go.bin", "lib.so", "app.src",
)
S_SAMPLES, S_COUNT, S_PID, S_EXE, S_THREAD, S_FRAME_TYPE, S_GO, S_GO_BIN, S_LIB, S_SRC = range(1, 11)

# Attribute table: 0 zero, 1-8 process ids, 9-15 threads, 16-22 frame types, 23 Go marker, 24.. executables.
FRAME_TYPES = ("native", "kernel", "jvm", "cpython", "", "v8js", "wasm")
A_PID, A_THREAD, A_FRAME_TYPE, A_GO, A_EXE = 1, 9, 16, 23, 24

# A payload of more line items is numbered across partitions; it need not fit a task.
SMALL_PAYLOAD = 20_000
_STACK = ["payload_id", "part", "p_name", "p_brand", "p_type"]
_SAMPLE_ORDER = ["l_orderkey", "l_linenumber", "part", "v0", "l_extendedprice", "ts0", "d", "t"]

_views: dict[tuple[str, str], ProfileTables] = {}


def profile_view(spark: SparkSession, sf_dir: str) -> ProfileTables:
    """The view's tables, built once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _views:
        configure(spark)
        _views[key] = build_profile_view(spark, sf_dir).stored("view", keep=["samples"])
    return _views[key]


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        F.col("l_suppkey").cast("bigint").alias("payload_id"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END").alias("rp_idx"),
        F.expr("CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END").alias("sp_idx"),
        (F.year("l_shipdate") - 1995).cast("int").alias("p_idx"),
        F.col("l_partkey").cast("bigint").alias("part"),
        F.col("l_quantity").cast("bigint").alias("v0"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts0"),
        F.round(F.col("l_discount") * 100).cast("int").alias("d"),
        F.round(F.col("l_tax") * 100).cast("int").alias("t"),
        "l_orderkey", "l_linenumber", "l_extendedprice",
    )


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").cast("bigint").alias("part"), "p_name", "p_brand", "p_type"
    )


def _frame_type(fn: Column) -> Column:
    return (
        F.when(fn.isin("ECONOMY", "LARGE"), "native").when(fn == "MEDIUM", "kernel")
        .when(fn == "PROMO", "jvm").when(fn == "SMALL", "cpython").when(fn == "STANDARD", "")
        .when(fn.isin("red", "blue"), "v8js").when(fn == "hot", "wasm").otherwise("native")
    )


def _frame_type_index(fn: Column) -> Column:
    kind = _frame_type(fn)
    index = F.when(kind == FRAME_TYPES[0], F.lit(A_FRAME_TYPE))
    for i, name in enumerate(FRAME_TYPES[1:], start=1):
        index = index.when(kind == name, F.lit(A_FRAME_TYPE + i))
    return index


def _ints(*columns: Column) -> Column:
    return F.array(*[c.cast("int") for c in columns])


def _no_ints() -> Column:
    return F.array().cast("array<int>")


def build_profile_view(spark: SparkSession, sf_dir: str, limit: int = SMALL_PAYLOAD) -> ProfileTables:
    items = _line_items(spark, sf_dir)
    parts = _parts(spark, sf_dir)

    large = items.where("payload_id IS NOT NULL").groupBy("payload_id").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    large = stash(large.select("payload_id"), "view-large-payloads")
    tasks = tasks_for(spark, items.count())
    stacks, samples = _small_payloads(items, parts, large, tasks)
    if not large.isEmpty():
        more_stacks, more_samples = _large_payloads(items.join(large, "payload_id", "left_semi"), parts)
        stacks, samples = stacks.unionByName(more_stacks), samples.unionByName(more_samples)

    brands = stash(stacks.select("payload_id", "p_brand", "exe_attr").distinct(), "view-executables")

    # Distinct frame names are the locations.
    frames = stacks.select("payload_id", "stack_index", F.posexplode(_frames()).alias("pos", "fn"))
    names = frames.select("payload_id", "fn").distinct()
    locations = stash(grouped_ordinal(names, ["payload_id"], ["fn"], "location_index", start=1), "view-locations")
    named = ~F.col("fn").isin("ECONOMY", "LARGE", "rod") & (F.col("fn") != "")
    fn_strings = stash(
        grouped_ordinal(
            locations.where(named).select("payload_id", "fn"), ["payload_id"], ["fn"], "str_index",
            start=len(HEAD_STRINGS),
        ),
        "view-function-names",
    )
    payload_ids = stacks.groupBy("payload_id").agg(F.count("*").cast("int").alias("n_parts"))
    per_payload = (
        payload_ids
        .join(brands.groupBy("payload_id").agg(F.count("*").cast("int").alias("n_exe")), "payload_id")
        .join(locations.groupBy("payload_id").agg(F.count("*").cast("int").alias("n_fn")), "payload_id")
        .join(
            fn_strings.groupBy("payload_id").agg(F.count("*").cast("int").alias("n_named")), "payload_id", "left"
        )
        .withColumn("n_named", F.coalesce("n_named", F.lit(0)))
    )
    per_payload = stash(per_payload, "view-payloads")

    tree = _tree(samples)
    dictionary = _dictionary(per_payload, brands, locations, fn_strings) | {"dict_stacks": _dict_stacks(stacks, locations, large)}
    resources = tree["resource_profiles"].groupBy("payload_id").agg(
        F.count("*").cast("int").alias("n_resource_profiles")
    )
    payloads = per_payload.join(resources, "payload_id").select(
        "payload_id",
        F.concat(F.lit("supplier-"), F.col("payload_id").cast("string")).alias("path"),
        F.lit(0).alias("frame_no"), F.col("payload_id").alias("position"),
        F.lit(None).cast("bigint").alias("n_bytes"),
        (F.lit(len(HEAD_STRINGS)) + F.col("n_named") + (F.col("payload_id") % 10 == 0).cast("int")
         + (F.col("payload_id") % 7 == 0).cast("int")).alias("n_strings"),
        (F.lit(3) + (F.col("payload_id") % 5 == 0).cast("int")).alias("n_mappings"),
        (F.col("n_fn") + 1).alias("n_locations"),
        (F.col("n_fn") + 1).alias("n_functions"),
        F.lit(2).alias("n_links"),
        (F.lit(A_EXE) + F.col("n_exe")).alias("n_attributes"),
        (F.col("n_parts") + 1).alias("n_stacks"),
        "n_resource_profiles",
        F.lit(True).alias("has_dictionary"),
    )
    return ProfileTables(payloads=payloads, samples=samples, **tree, **dictionary)


def _frames() -> Column:
    """Names of a stack's frames, leaf first."""
    return F.concat(F.split("p_name", " "), F.array("p_type"))


def _dict_stacks(stacks: DataFrame, locations: DataFrame, large: DataFrame) -> DataFrame:
    """Frames as location indexes; a frame without a name has a location that no stack refers to."""
    zero = locations.select("payload_id").distinct().select("payload_id", F.lit(0).alias("idx"), _no_ints().alias("location_indices"))
    # A payload's names in the order of their indexes; stacks are not opened and put together again.
    names = locations.join(large, "payload_id", "left_anti").groupBy("payload_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("location_index", "fn"))), lambda x: x["fn"]).alias("names"))
    index = F.transform(_frames(), lambda fn: F.array_position("names", fn).cast("int"))
    # A stack without a name has no list.  The list itself is not tested: Spark would look it up in the join and again after it.
    small = stacks.where("p_name IS NOT NULL").join(names, "payload_id").select(
        "payload_id", F.col("stack_index").alias("idx"), F.filter(index, lambda i: i.isNotNull()).alias("location_indices"))
    spread = stacks.join(large, "payload_id", "left_semi").select(
        "payload_id", "stack_index", F.posexplode(_frames()).alias("pos", "fn"))
    leaf_first = F.transform(F.array_sort(F.collect_list(F.struct("pos", "location_index"))), lambda x: x["location_index"])
    rest = spread.join(locations, ["payload_id", "fn"]).groupBy("payload_id", F.col("stack_index").alias("idx")).agg(
        leaf_first.alias("location_indices"))
    return zero.unionByName(small).unionByName(rest)


def _small_payloads(items: DataFrame, parts: DataFrame, large: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Stacks and samples of the payloads that are not ``large``, stored.

    Rows are moved by payload once, to so many ``tasks``, and everything inside a
    payload is numbered where they lie.
    """
    items = items.where("payload_id IS NOT NULL").join(large, "payload_id", "left_anti")
    used = items.select("payload_id", "part").distinct().join(parts, "part").repartition(tasks, "payload_id")
    payload = Window.partitionBy("payload_id")
    stacks = stash(used.select(
        *_STACK, F.row_number().over(payload.orderBy("part", "p_name", "p_brand", "p_type")).alias("stack_index"),
        (F.dense_rank().over(payload.orderBy("p_brand")) + (A_EXE - 1)).alias("exe_attr")), "view-stacks")

    order = Window.partitionBy(*PROFILE_ID).orderBy(*_SAMPLE_ORDER)
    placed = items.where("p_idx IS NOT NULL").repartition(tasks, "payload_id").withColumn("s_idx", F.row_number().over(order) - 1)
    samples = _samples(placed, stacks.repartition(tasks, "payload_id")).sortWithinPartitions(*SAMPLE_ID, "stack_index")
    with by_payload(items.sparkSession):
        return stacks, stash(samples, "view-samples")


def _large_payloads(items: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``_small_payloads``, of payloads that may be as large as the table: each is spread over many partitions."""
    used = items.select("payload_id", "part").distinct().join(parts, "part")
    stacks = grouped_ordinal(used, ["payload_id"], ["part"], "stack_index", start=1)
    stacks = stash(stacks, "view-large-stacks")
    brands = grouped_ordinal(
        stacks.select("payload_id", "p_brand").distinct(), ["payload_id"], ["p_brand"], "exe_attr", start=A_EXE)
    same = (stacks["payload_id"] == brands["payload_id"]) & stacks["p_brand"].eqNullSafe(brands["p_brand"])
    stacks = stash(stacks.join(brands, same).select(
        *[stacks[c] for c in _STACK], "stack_index", "exe_attr"), "view-stacks")
    placed = grouped_ordinal(items, PROFILE_ID, _SAMPLE_ORDER, "s_idx", spread_ties=True)
    return stacks, stash(_samples(placed, stacks), "view-samples")


def _samples(numbered: DataFrame, stacks: DataFrame) -> DataFrame:
    stack_of_part = stacks.where("p_brand IS NOT NULL").select("payload_id", "part", "stack_index", "exe_attr")
    # Derived here, after rows have moved.
    numbered = numbered.withColumn("pid", (F.col("l_orderkey") % 8).cast("int")).withColumn("thread", F.col("l_linenumber").cast("int"))
    n_timestamps = F.when(F.col("d") < 4, 0).otherwise(1 + F.col("thread") % 3)
    n_values = (
        F.when(F.col("d") < 4, 1).when(F.col("d") < 7, 0)
        .when(F.col("t") == 8, F.col("n_timestamps") + 1).otherwise(F.col("n_timestamps"))
    )
    broken = (F.col("d") == 10) & (F.col("t") == 8)
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(_no_ints())
    attrs = _ints(F.col("pid") + A_PID, F.col("exe_attr"), F.col("thread") + (A_THREAD - 1))
    joined = numbered.join(stack_of_part, ["payload_id", "part"])
    return joined.withColumn("n_timestamps", n_timestamps).withColumn("n_values", n_values).select(
        *PROFILE_ID, "s_idx", "stack_index",
        F.transform(upto("n_values"), lambda i: F.col("v0") + i).cast("array<bigint>").alias("values"),
        F.when(broken, F.concat(attrs, _ints(F.lit(A_THREAD)))).otherwise(attrs).alias("attribute_indices"),
        F.when(broken, 2).when(F.col("thread") == 1, 1).otherwise(0).cast("int").alias("link_index"),
        F.transform(upto("n_timestamps"), lambda i: F.col("ts0") + i * 1000).cast("array<bigint>").alias("timestamps"),
    )


def _tree(samples: DataFrame) -> dict[str, DataFrame]:
    """Resources, scopes and profiles; ordinals are filled up from 0 to the largest one used."""
    last_p = samples.groupBy(*SCOPE_ID).agg(F.max("p_idx").alias("last"))
    last_sp = last_p.groupBy(*RESOURCE_ID).agg(F.max("sp_idx").alias("last"))
    last_rp = last_sp.groupBy("payload_id").agg(F.max("rp_idx").alias("last"))
    upto = F.explode(F.sequence(F.lit(0), F.col("last")))

    resources = last_rp.select("payload_id", upto.alias("rp_idx")).join(
        last_sp.select(*RESOURCE_ID, (F.col("last") + 1).alias("n_scopes")), RESOURCE_ID, "left"
    ).select(
        *RESOURCE_ID, F.col("n_scopes").isNotNull().alias("has_resource"), F.lit("").alias("schema_url"),
        F.lit(0).cast("bigint").alias("dropped_attributes_count"),
        F.array().cast(f"array<{ENTITY_REF}>").alias("entity_refs"),
        F.coalesce("n_scopes", F.lit(0)).alias("n_scopes"),
    )
    scopes = last_sp.select(*RESOURCE_ID, upto.alias("sp_idx")).join(
        last_p.select(*SCOPE_ID, (F.col("last") + 1).alias("n_profiles")), SCOPE_ID, "left"
    ).select(
        *SCOPE_ID, F.lit(True).alias("has_scope"),
        F.when(F.col("sp_idx") == 0, "scope.F").otherwise("scope.O").alias("scope_name"),
        F.lit("1.0").alias("scope_version"), F.lit(0).cast("bigint").alias("dropped_attributes_count"),
        F.lit("").alias("schema_url"), F.coalesce("n_profiles", F.lit(0)).alias("n_profiles"),
    )
    scope_attributes = scopes.where("sp_idx = 0").select(
        *SCOPE_ID, F.lit(0).alias("pos"), F.lit("scope.kind").alias("key"), F.lit(0).alias("key_ref"),
        make_value("string", F.lit("cpu")).alias("value"),
    )
    year_start = F.unix_micros(F.make_timestamp(
        F.lit(1995) + F.col("p_idx"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")
    )) * 1000
    sample_type = F.struct(F.lit(S_SAMPLES).alias("type_strindex"), F.lit(S_COUNT).alias("unit_strindex"))
    profiles = last_p.select(*SCOPE_ID, upto.alias("p_idx")).select(
        *PROFILE_ID, sample_type.cast(VALUE_TYPE).alias("sample_type"),
        year_start.alias("time_unix_nano"), F.lit(365 * DAY_NS).cast("bigint").alias("duration_nano"),
        F.lit(None).cast(VALUE_TYPE).alias("period_type"), F.lit(0).cast("bigint").alias("period"),
        F.lit(None).cast("binary").alias("profile_id"), F.lit(0).cast("bigint").alias("dropped_attributes_count"),
        F.lit("").alias("original_payload_format"), F.lit(None).cast("binary").alias("original_payload"),
        F.when(F.col("p_idx") == 6, _ints(F.lit(A_GO), F.lit(A_GO))).otherwise(_no_ints()).alias("attribute_indices"),
    )
    payload = F.col("payload_id")
    entry = lambda pos, key, value: F.struct(
        F.lit(pos).alias("pos"), F.lit(key).alias("key"), F.lit(0).alias("key_ref"), value.alias("value")
    )
    attrs = F.array(
        entry(0, "host.name", make_value("string", F.concat(F.lit("host-"), (payload % 7).cast("string")))),
        entry(1, "container.id", make_value("string", F.concat(F.lit("c-"), F.col("rp_idx").cast("string")))),
        entry(2, "host.cpu.count", make_value("int", payload % 16 + 1)),
        entry(3, "host.arm", make_value("bool", payload % 2 == 0)),
        entry(4, "host.load", make_value("double", (payload % 9).cast("double") / 4)),
    )
    resource_attributes = resources.where("has_resource").select(
        *RESOURCE_ID, F.explode(attrs).alias("a")
    ).select(*RESOURCE_ID, "a.pos", "a.key", "a.key_ref", "a.value").where(
        "NOT (pos = 0 AND payload_id % 11 = 0)"
    )
    return {
        "resource_profiles": resources, "resource_attributes": resource_attributes,
        "scope_profiles": scopes, "scope_attributes": scope_attributes, "profiles": profiles,
    }


def _dictionary(
    per_payload: DataFrame, brands: DataFrame, locations: DataFrame, fn_strings: DataFrame,
) -> dict[str, DataFrame]:
    ids = per_payload.select("payload_id")
    payload = F.col("payload_id")

    head = ids.select("payload_id", F.posexplode(F.array(*[F.lit(s) for s in HEAD_STRINGS])).alias("idx", "value"))
    named = fn_strings.select("payload_id", F.col("str_index").alias("idx"), F.col("fn").alias("value"))
    end = F.lit(len(HEAD_STRINGS)) + F.col("n_named")
    orphan = per_payload.where("payload_id % 10 = 0").select("payload_id", end.alias("idx"), F.lit("orphan").alias("value"))
    repeated = per_payload.where("payload_id % 7 = 0").select(
        "payload_id", (end + (payload % 10 == 0).cast("int")).alias("idx"), F.lit("count").alias("value")
    )
    strings = head.unionByName(named).unionByName(orphan).unionByName(repeated)

    u64 = lambda n: F.lit(Decimal(n)).cast("decimal(20,0)")
    mapping = lambda idx, start, limit, name, attrs: F.struct(
        F.lit(idx).alias("idx"), start.alias("memory_start"), limit.alias("memory_limit"),
        u64(0).alias("file_offset"), F.lit(name).alias("filename_strindex"), attrs.alias("attribute_indices"),
    )
    high = u64(0xFFFFFFFF80000000)
    lib_limit = F.when(payload % 9 == 0, high).otherwise(u64(0xFFFFFFFF80200000))
    lib = lambda idx: mapping(idx, high, lib_limit, S_LIB, _no_ints())
    mappings = ids.select("payload_id", F.inline(F.filter(F.array(
        mapping(0, u64(0), u64(0), 0, _no_ints()),
        mapping(1, u64(0x400000), u64(0x800000), S_GO_BIN, _ints(F.lit(A_GO))),
        lib(2),
        F.when(payload % 5 == 0, lib(3)),
    ), lambda m: m.isNotNull())))

    line = F.array(F.struct(
        F.col("location_index").alias("function_index"),
        (F.col("location_index") * 10).cast("bigint").alias("line"), F.lit(0).cast("bigint").alias("column"),
    )).cast(f"array<{LINE}>")
    no_lines = F.array().cast(f"array<{LINE}>")
    zero_location = ids.select(
        "payload_id", F.lit(0).alias("idx"), F.lit(0).alias("mapping_index"), u64(0).alias("address"),
        no_lines.alias("lines"), _no_ints().alias("attribute_indices"),
    )
    dict_locations = zero_location.unionByName(locations.select(
        "payload_id", F.col("location_index").alias("idx"),
        F.when(F.col("fn") == "LARGE", 1).otherwise(2).alias("mapping_index"),
        (F.col("location_index") * 4096).cast("decimal(20,0)").alias("address"), line.alias("lines"),
        _ints(_frame_type_index(F.col("fn"))).alias("attribute_indices"),
    ))
    zero_function = ids.select(
        "payload_id", *[F.lit(0).alias(c) for c in ("idx", "name_strindex", "system_name_strindex", "filename_strindex")],
        F.lit(0).cast("bigint").alias("start_line"),
    )
    dict_functions = zero_function.unionByName(
        locations.join(fn_strings, ["payload_id", "fn"], "left").select(
            "payload_id", F.col("location_index").alias("idx"),
            F.coalesce("str_index", F.lit(0)).alias("name_strindex"), F.lit(0).alias("system_name_strindex"),
            F.when(F.col("str_index").isNotNull(), S_SRC).otherwise(0).alias("filename_strindex"),
            F.col("location_index").cast("bigint").alias("start_line"),
        )
    )
    links = ids.select("payload_id", F.posexplode(F.array(F.lit(16), F.lit(8))).alias("idx", "n")).select(
        "payload_id", "idx",
        F.when(F.col("idx") == 1, F.unhex(F.repeat(F.lit("ab"), F.lit(16)))).alias("trace_id"),
        F.when(F.col("idx") == 1, F.unhex(F.repeat(
            F.lit("cd"), F.when(payload % 13 == 0, 4).otherwise(8)))).alias("span_id"),
    )
    attribute = lambda idx, key, value: F.struct(
        F.lit(idx).alias("idx"), F.lit(key).alias("key_strindex"), F.lit(0).alias("unit_strindex"), value.alias("value")
    )
    fixed = [attribute(0, 0, no_value())]
    fixed += [attribute(A_PID + i, S_PID, make_value("int", F.lit(i).cast("bigint"))) for i in range(8)]
    fixed += [attribute(A_THREAD + i, S_THREAD, make_value("int", F.lit(i + 1).cast("bigint"))) for i in range(7)]
    fixed += [attribute(A_FRAME_TYPE + i, S_FRAME_TYPE, make_value("string", F.lit(n))) for i, n in enumerate(FRAME_TYPES)]
    fixed += [attribute(A_GO, S_GO, make_value("string_ref", F.lit(S_GO_BIN), F.lit(len("go.bin"))))]
    attributes = ids.select("payload_id", F.inline(F.array(*fixed))).unionByName(brands.select(
        "payload_id", F.col("exe_attr").alias("idx"), F.lit(S_EXE).alias("key_strindex"),
        F.lit(0).alias("unit_strindex"), make_value("string", F.col("p_brand")).alias("value"),
    ))
    return {
        "dict_strings": strings, "dict_mappings": mappings, "dict_locations": dict_locations,
        "dict_functions": dict_functions, "dict_links": links, "dict_attributes": attributes,
    }
