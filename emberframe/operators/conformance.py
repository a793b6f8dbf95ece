"""Conformance findings: broken references, sample shapes, duplicates, orphans.

Every rule is a query over whole tables.  Large tables are first reduced to one
row per payload, profile or distinct attribute list; only rows that belong to a
failing key are read in full.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.numeric import unsigned
from emberframe.functions.values import quoted
from emberframe.operators.lookups import SHAPE_BOTH, SHAPE_INVALID, SHAPE_TIMESTAMPS, SHAPE_VALUES, deref
from emberframe.schema import DICTIONARY_TABLES, PROFILE_ID, SAMPLE_ID
from emberframe.session import stash
from emberframe.tables import ProfileTables

FINDING_COLUMNS = (
    "payload_id", "rule", "table_name", "rp_idx", "sp_idx", "p_idx", "s_idx", "entry_idx", "pos", "path", "message",
)
_ORDINALS = ("rp_idx", "sp_idx", "p_idx", "s_idx", "entry_idx", "pos")

TABLE_NAMES = {name: f"{name}_table" for name in DICTIONARY_TABLES}


def _finding(rule: str, message: Column, *path: Column | str, pos: Column | None = None) -> Column:
    """A finding struct; the parts of ``path`` are concatenated."""
    return F.struct(
        F.lit(rule).alias("rule"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in path]).alias("path"),
        message.alias("message"), (pos if pos is not None else F.lit(None)).cast("int").alias("pos"),
    )


def _emit(df: DataFrame, table: str, *candidates: tuple[Column, Column]) -> DataFrame:
    """One output row per failing (condition, finding) pair, in a single pass over ``df``."""
    found = F.filter(F.array(*[F.when(cond, item) for cond, item in candidates]), lambda x: x.isNotNull())
    return _shape(df.select("*", F.explode(found).alias("_f")), table)


def _shape(df: DataFrame, table: str) -> DataFrame:
    present = set(df.columns)
    ordinal = lambda c: F.col(c) if c in present else F.lit(None)
    columns = {c: ordinal(c).cast("int") for c in _ORDINALS}
    columns["pos"] = F.col("_f")["pos"]
    return df.select(
        "payload_id", F.col("_f")["rule"].alias("rule"), F.lit(table).alias("table_name"),
        *[columns[c].alias(c) for c in _ORDINALS],
        F.col("_f")["path"].alias("path"), F.col("_f")["message"].alias("message"),
    )


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _index(idx: Column | str) -> Column:
    return F.concat(F.lit("["), _s(idx), F.lit("]"))


def _outside(idx: Column | str, n: Column | str) -> Column:
    idx, n = (F.col(c) if isinstance(c, str) else c for c in (idx, n))
    return (idx < 0) | (idx >= n)


def _range_message(idx: Column | str, n: Column | str) -> Column:
    return F.concat(F.lit("index "), _s(idx), F.lit(" is out of range [0.."), _s(n), F.lit(")"))


def _negative_message(c: Column | str) -> Column:
    return F.concat(_s(c), F.lit(" < 0, must be non-negative"))


def _profile_path() -> Column:
    return F.concat(
        F.lit("resource_profiles["), _s("rp_idx"), F.lit("]: scope_profiles["), _s("sp_idx"),
        F.lit("]: profile["), _s("p_idx"), F.lit("]"),
    )


def _sample_path() -> Column:
    return F.concat(_profile_path(), F.lit(": sample["), _s("s_idx"), F.lit("]"))


def _checked(t: ProfileTables) -> DataFrame:
    """Payloads with at least one resource; the others get no further finding.

    Such payloads have no tree rows, so only dictionary rules need this filter.
    """
    return t.payloads.where("n_resource_profiles > 0")


def _with_counts(df: DataFrame, t: ProfileTables, *counts: str) -> DataFrame:
    return df.join(_checked(t).select("payload_id", *counts), "payload_id")


# --- tree -------------------------------------------------------------------


def check_tree(t: ProfileTables) -> DataFrame:
    """Empty payloads, resources without scopes, scopes without profiles."""
    payloads = _emit(t.payloads, "payload", (
        F.col("n_resource_profiles") == 0, _finding("R1", F.lit("resource profiles are empty"), "")))
    rp_path = F.concat(F.lit("resource_profiles["), _s("rp_idx"), F.lit("]"))
    resources = _emit(t.resource_profiles, "resource_profiles", (
        F.col("n_scopes") == 0, _finding("R2", F.lit("resource profiles has no scope profiles"), rp_path)))
    sp_path = F.concat(rp_path, F.lit(": scope_profiles["), _s("sp_idx"), F.lit("]"))
    scopes = _emit(t.scope_profiles, "scope_profiles", (
        F.col("n_profiles") == 0, _finding("R3", F.lit("scope profiles has no profiles"), sp_path)))
    return payloads.unionByName(resources).unionByName(scopes)


def check_profiles(t: ProfileTables) -> DataFrame:
    """sample_type and period_type indexes; a missing type counts as index 0."""
    df = _with_counts(t.profiles.select(*PROFILE_ID, "sample_type", "period_type"), t, "n_strings")
    candidates = []
    for rule, field in (("R5", "sample_type"), ("R6", "period_type")):
        for part in ("unit_strindex", "type_strindex"):
            idx = F.coalesce(F.col(field)[part], F.lit(0))
            candidates.append((
                _outside(idx, "n_strings"),
                _finding(rule, _range_message(idx, "n_strings"), _profile_path(), f": {field}: {part}"),
            ))
    return _emit(df, "profile", *candidates)


# --- attribute lists ----------------------------------------------------------


def sample_usage(t: ProfileTables) -> DataFrame:
    """What samples refer to, from one scan and one shuffle, stored.

    Rows are (payload_id, attribute_indices) for every distinct list, and
    (payload_id, table_name, word, mask) with a bit for every stack and link in use.
    """
    bit = lambda table, c: F.struct(
        F.lit(None).cast("array<int>").alias("attribute_indices"), F.lit(table).alias("table_name"),
        *_word_and_bit(F.col(c).cast("bigint")))
    attributes = F.struct(
        F.col("attribute_indices"), F.lit("").alias("table_name"), F.lit(0).cast("bigint").alias("word"), F.lit(0).cast("bigint").alias("bit"))
    used = t.samples.select("payload_id", F.inline(F.array(attributes, bit("stack", "stack_index"), bit("link", "link_index"))))
    used = used.where("word >= 0 AND (table_name <> '' OR size(attribute_indices) > 0)")
    return stash(used.groupBy("payload_id", "table_name", "attribute_indices", "word").agg(F.bit_or("bit").alias("mask")), "sample-usage")


def attribute_lists(t: ProfileTables, usage: DataFrame) -> DataFrame:
    """(payload_id, attribute_indices) of all owners; distinct per owner."""
    owners = [df.select("payload_id", "attribute_indices").where(F.size("attribute_indices") > 0).distinct()
              for df in (t.profiles, t.dict_mappings, t.dict_locations)]
    return reduce(DataFrame.unionByName, owners, usage.where("table_name = ''").select("payload_id", "attribute_indices"))


def _suspicious_lists(t: ProfileTables, lists: DataFrame) -> DataFrame:
    """Lists with a bad index or a repeated key, by one look-up per list.

    A payload's attributes become one array: at every index a number that is
    equal for equal keys, or -1 where the key is out of range.  It has four bytes per
    attribute, less than the message that holds them.  Only lists found here are
    resolved element by element.
    """
    strings = t.dict_strings
    again = strings.groupBy("payload_id", "value").agg(F.min("idx").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = strings.join(again.select("payload_id", "value", "first"), ["payload_id", "value"]).select(
        "payload_id", F.col("idx").alias("key_strindex"), "first")
    keys = _with_counts(t.dict_attributes.select("payload_id", "idx", "key_strindex"), t, "n_strings").join(
        same, ["payload_id", "key_strindex"], "left")
    number = F.when(_outside("key_strindex", "n_strings"), -1).otherwise(F.coalesce("first", "key_strindex"))
    by_payload = keys.groupBy("payload_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("idx", number.alias("key")))), lambda x: x["key"]).alias("keys"))
    known = _checked(t).select("payload_id").join(by_payload, "payload_id", "left").select(
        "payload_id", F.coalesce("keys", F.array().cast("array<int>")).alias("keys"))
    at = F.transform("attribute_indices", lambda i: F.when(i >= 0, F.coalesce(F.get("keys", i), F.lit(-1))).otherwise(-1))
    return lists.join(known, "payload_id").select("payload_id", "attribute_indices", at.alias("at")).where(
        F.array_contains("at", -1) | (F.size(F.array_distinct("at")) < F.size("at"))).drop("at").distinct()


def bad_attribute_lists(t: ProfileTables, lists: DataFrame | None = None) -> DataFrame:
    """Findings per distinct attribute list of any owner: bad index, bad key index, repeated key.

    A bad element takes no part in the search for repeated keys.
    """
    lists = _suspicious_lists(t, attribute_lists(t, sample_usage(t)) if lists is None else lists)
    elements = lists.select("payload_id", "attribute_indices", F.posexplode("attribute_indices").alias("pos", "idx"))
    keyed = deref(t.dict_attributes.select("payload_id", "idx", "key_strindex"), t.dict_strings, "key_strindex", "key")
    items = _with_counts(elements.join(keyed, ["payload_id", "idx"], "left"), t, "n_attributes", "n_strings")
    bad_index = _outside("idx", "n_attributes")
    bad_key = ~bad_index & _outside("key_strindex", "n_strings")
    element = F.concat(F.lit("["), _s("pos"), F.lit("]"))
    broken = items.where(bad_index | bad_key).select(
        "payload_id", "attribute_indices", "pos",
        F.when(bad_index, element).otherwise(F.concat(element, F.lit(".key_strindex"))).alias("sub"),
        F.when(bad_index, _range_message("idx", "n_attributes"))
        .otherwise(_range_message("key_strindex", "n_strings")).alias("message"),
    )
    usable = items.where(~bad_index & ~bad_key)
    list_key = ["payload_id", "attribute_indices", "key"]
    firsts = usable.groupBy(*list_key).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = usable.join(firsts, list_key).where("pos > first").select(
        "payload_id", "attribute_indices", "pos",
        F.concat(F.lit("["), _s("pos"), F.lit("].key_strindex")).alias("sub"),
        F.concat(F.lit("duplicate key "), F.expr(quoted("key")), F.lit(", previously seen at ["), _s("first"),
                 F.lit("].key_strindex")).alias("message"),
    )
    return broken.unionByName(repeated)


def _list_findings(df: DataFrame, bad: DataFrame, rule: str, table: str, prefix: Column) -> DataFrame:
    """Findings of ``bad`` lists for the owners that have them."""
    finding = _finding(rule, F.col("message"), prefix, F.col("sub"), pos=F.col("pos"))
    return _shape(df.join(bad, ["payload_id", "attribute_indices"]).withColumn("_f", finding).drop("pos"), table)


def _owners_of_bad_lists(t: ProfileTables, bad: DataFrame) -> DataFrame:
    """Attribute-list findings of profiles, mappings and locations."""
    dictionary = lambda name, idx: F.concat(F.lit(f"dictionary: {name}_table: "), _index(idx), F.lit(".attribute_indices: "))
    entries = lambda df: df.selectExpr("payload_id", "idx AS entry_idx", "attribute_indices")
    return reduce(DataFrame.unionByName, [
        _list_findings(t.profiles.select(*PROFILE_ID, "attribute_indices"), bad, "R4", "profile",
                       F.concat(_profile_path(), F.lit(": attribute_indices: "))),
        _list_findings(entries(t.dict_mappings.where("idx >= 1")), bad, "R22", "mapping_table",
                       dictionary("mapping", F.col("entry_idx") - 1)),
        _list_findings(entries(t.dict_locations), bad, "R25", "location_table", dictionary("location", "entry_idx")),
    ])


def _samples_of_bad_lists(samples: DataFrame, bad: DataFrame) -> DataFrame:
    prefix = F.concat(_sample_path(), F.lit(": attribute_indices: "))
    return _list_findings(samples.select(*SAMPLE_ID, "attribute_indices"), bad, "R8", "sample", prefix)


def check_duplicate_keys(t: ProfileTables) -> DataFrame:
    """Attribute-list findings of profiles, samples, mappings and locations.

    The findings per distinct list are stored once; each owner is then joined
    with its own bad lists only.
    """
    bad = stash(bad_attribute_lists(t), "bad-attribute-lists")
    return _samples_of_bad_lists(t.samples, bad).unionByName(_owners_of_bad_lists(t, bad))


# --- samples -------------------------------------------------------------------

_SHAPES = (SHAPE_BOTH, SHAPE_VALUES, SHAPE_TIMESTAMPS, SHAPE_INVALID)
_INDEX_RULES, _TIME_RULES, _SHAPE_RULES = ("R7", "R9"), ("R10",), ("R11", "R12", "R13", "R14")
SAMPLE_RULES = (*_INDEX_RULES, *_TIME_RULES, *_SHAPE_RULES)


def _shape_code() -> Column:
    """The position of the sample's shape in ``_SHAPES``."""
    has_values, has_ts = F.size("values") > 0, F.size("timestamps") > 0
    return F.when(has_values & has_ts, 0).when(has_values, 1).when(has_ts, 2).otherwise(3)


def _wrong_lengths() -> Column:
    n_values, n_ts = F.size("values"), F.size("timestamps")
    return F.when(n_ts > 0, (n_values > 0) & (n_values != n_ts)).otherwise(n_values != 1)


def _profile_faults(t: ProfileTables, rules: tuple[str, ...]) -> DataFrame:
    """Profiles with a sample that breaks a rule, and what is needed to name it; from one aggregate over all samples."""
    samples = t.samples
    code = _shape_code()
    wanted: dict[str, Column] = {}
    if "R7" in rules:
        wanted |= {n: f(c) for c, lo, hi in (("stack_index", "s0", "s1"), ("link_index", "l0", "l1")) for n, f in ((lo, F.min), (hi, F.max))}
    if "R10" in rules:
        wanted |= {"t0": F.min(F.array_min("timestamps")), "t1": F.max(F.array_max("timestamps"))}
    if "R14" in rules:
        wanted |= {"lo": F.min(code), "hi": F.max(code), "first": F.min(F.col("s_idx").cast("bigint") * 4 + code),
                   "uneven": F.max(F.when(_wrong_lengths(), 1).otherwise(0))}
    facts = samples.groupBy(*PROFILE_ID).agg(*[c.alias(n) for n, c in wanted.items()])
    start = unsigned(F.col("time_unix_nano"))
    span = t.profiles.select(*PROFILE_ID, start.alias("start_ns"), (start + unsigned(F.col("duration_nano"))).alias("end_ns"))
    facts = _with_counts(facts, t, "n_stacks", "n_links").join(span, PROFILE_ID, "left")
    faults = [F.lit(False)]
    if "R7" in rules:
        faults += [_outside("s0", "n_stacks"), _outside("s1", "n_stacks"), _outside("l0", "n_links"), _outside("l1", "n_links")]
    if "R10" in rules:
        # Negative extremes stand for times of 2^63 and more; such profiles are read in full, as failing ones are.
        faults += [(F.col("t0") < 0) | (F.col("t0") < F.col("start_ns")) | (F.col("t1") >= F.col("end_ns"))]
    if "R14" in rules:
        faults += [F.col("lo") != F.col("hi"), F.col("uneven") == 1]
    failing = reduce(lambda x, y: x | y, [F.coalesce(f, F.lit(False)) for f in faults])
    expected = (F.col("first") % 4).cast("int") if "R14" in rules else F.lit(None).cast("int")
    return facts.where(failing).select(*PROFILE_ID, "n_stacks", "n_links", "start_ns", "end_ns", expected.alias("expected"))


def sample_findings(t: ProfileTables, rules: tuple[str, ...] = SAMPLE_RULES, bad_lists: DataFrame | None = None) -> DataFrame:
    """Findings of the sample rules, and of ``bad_lists`` if given (R8).

    Samples are read by one aggregate per profile, and those of failing profiles
    again to name what is wrong in them.  Bad lists are joined with the ids of
    their samples alone.  Of values, only the number moves.
    """
    faults = stash(_profile_faults(t, rules), "profile-faults")
    needed = [*SAMPLE_ID, "stack_index", "link_index", *(["timestamps"] if "R10" in rules else [])]
    rows = t.samples.select(
        *needed, F.size("values").alias("n_values"), F.size("timestamps").alias("n_ts"), _shape_code().alias("code")).join(faults, PROFILE_ID)
    n_values, n_ts, code = F.col("n_values"), F.col("n_ts"), F.col("code")
    named = lambda c: F.element_at(F.array(*[F.lit(n) for n in _SHAPES]), c + 1)
    index = lambda rule, field, n: (
        _outside(field, n), _finding(rule, _range_message(field, n), _sample_path(), f": {field}"))
    checks = {
        "R7": index("R7", "stack_index", "n_stacks"),
        "R9": index("R9", "link_index", "n_links"),
        "R11": ((code == 0) & (n_values != n_ts), _finding("R11", F.concat(
            F.lit("values (len="), _s(n_values), F.lit(") and timestamps_unix_nano (len="), _s(n_ts),
            F.lit(") must contain the same number of elements")), _sample_path())),
        "R12": ((code == 1) & (n_values != 1), _finding("R12", F.concat(
            F.lit("values (len="), _s(n_values),
            F.lit(") must contain a single element if timestamps_unix_nano is not set")), _sample_path())),
        "R13": (code == 3, _finding(
            "R13", F.lit("sample must have at least one values or timestamps_unix_nano entry"), _sample_path())),
        "R14": (code != F.col("expected"), _finding("R14", F.concat(
            F.lit("sample shape "), named(code), F.lit(" does not match expected sample shape "), named(F.col("expected"))),
            _sample_path())),
    }
    single = F.filter(F.array(*[F.when(c, f) for r, (c, f) in checks.items() if r in rules] or [F.lit(None)]), lambda x: x.isNotNull())
    parts = [single] if set(rules) & set(checks) else []
    if "R10" in rules:
        def outside(ts: Column, i: Column) -> Column:
            ts = unsigned(ts)
            message = F.concat(
                F.lit("timestamps_unix_nano["), _s(i), F.lit("]="), _s(ts), F.lit(" is outside profile time range ["),
                _s("start_ns"), F.lit(", "), _s("end_ns"), F.lit(")"))
            return F.when((ts < F.col("start_ns")) | (ts >= F.col("end_ns")), _finding("R10", message, _sample_path(), pos=i))

        parts.append(F.filter(F.transform(F.coalesce("timestamps", F.array().cast("array<bigint>")), outside), lambda x: x.isNotNull()))
    found = _shape(rows.select(*SAMPLE_ID, F.explode(F.concat(*parts)).alias("_f")), "sample")
    if bad_lists is None:
        return found
    return found.unionByName(_samples_of_bad_lists(t.samples.dropna(subset=PROFILE_ID), bad_lists))


def check_stack_index(t: ProfileTables) -> DataFrame:
    """Stack and link indexes of samples."""
    return sample_findings(t, _INDEX_RULES)


def check_timestamps(t: ProfileTables) -> DataFrame:
    """Timestamps outside [start, start + duration) of their profile, one finding per element."""
    return sample_findings(t, _TIME_RULES)


def check_sample_shapes(t: ProfileTables) -> DataFrame:
    """Length rules per sample and agreement with the profile's first sample."""
    return sample_findings(t, _SHAPE_RULES)


# --- dictionary ------------------------------------------------------------------

EMPTY_TABLE = "empty table, must have at least zero value entry"


def _empty_list(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) == 0


def _zero_entry_rules(t: ProfileTables) -> dict[str, tuple[str, DataFrame, Column]]:
    """table -> (rule, table frame, condition that entry 0 is the zero value)."""
    bytes_empty = lambda c: F.coalesce(F.octet_length(c), F.lit(0)) == 0
    zero = lambda *cs: reduce(lambda a, b: a & b, [F.col(c) == 0 for c in cs])
    value = F.col("value")
    return {
        "mapping": ("R15", t.dict_mappings, zero("memory_start", "memory_limit", "file_offset", "filename_strindex")
                    & _empty_list("attribute_indices")),
        "location": ("R16", t.dict_locations, zero("mapping_index", "address") & _empty_list("lines")
                     & _empty_list("attribute_indices")),
        "function": ("R17", t.dict_functions, zero("name_strindex", "system_name_strindex", "filename_strindex", "start_line")),
        "link": ("R18", t.dict_links, bytes_empty("trace_id") & bytes_empty("span_id")),
        "stack": ("R19", t.dict_stacks, _empty_list("location_indices")),
        "attribute": ("R20", t.dict_attributes, zero("key_strindex", "unit_strindex")
                      & (value.isNull() | value["kind"].isNull())),
    }


def check_zero_entries(t: ProfileTables) -> DataFrame:
    """Every dictionary table starts with its zero value; the string table with ''."""
    parts = []
    for table, (rule, df, is_zero) in _zero_entry_rules(t).items():
        path = f"dictionary: {table}_table"
        parts.append(_emit(_checked(t), TABLE_NAMES[table], (
            F.col(f"n_{table}s") == 0, _finding(rule, F.lit(EMPTY_TABLE), path))))
        first = _with_counts(df.where("idx = 0"), t).withColumn("entry_idx", F.col("idx"))
        if table == "attribute":
            bad_index = (F.col("key_strindex") != 0) | (F.col("unit_strindex") != 0)
            message = F.when(bad_index, F.concat(
                F.lit("first attribute must have zero key/unit indices, got KeyStrindex="), _s("key_strindex"),
                F.lit(", UnitStrindex="), _s("unit_strindex"),
            )).otherwise(F.concat(F.lit("first attribute value must be nil, got "), F.to_json(F.struct("value"))))
        else:
            message = F.concat(F.lit("must have zero value at index 0, got "), F.to_json(F.struct(
                *[c for c in df.columns if c not in ("payload_id", "idx")])))
        parts.append(_emit(first, TABLE_NAMES[table], (~is_zero, _finding(rule, message, path))))
    parts.append(_emit(_checked(t), "string_table", (
        F.col("n_strings") == 0,
        _finding("R21", F.lit("empty string table, must have at least empty string"), "dictionary: string_table"))))
    first = _with_counts(t.dict_strings.where("idx = 0"), t).withColumn("entry_idx", F.col("idx"))
    parts.append(_emit(first, "string_table", (F.col("value") != "", _finding(
        "R21", F.concat(F.lit("must have empty string at index 0, got "), F.expr(quoted("value"))),
        "dictionary: string_table"))))
    return reduce(DataFrame.unionByName, parts)


def check_dictionary_indexes(t: ProfileTables) -> DataFrame:
    """Index, range, sign and id-length rules of the dictionary entries."""

    def entries(df: DataFrame, *counts: str) -> DataFrame:
        return _with_counts(df, t, *counts).withColumn("entry_idx", F.col("idx"))

    def rule(name: str, table: str, field: str, n: str, idx: Column | str = "idx") -> tuple[Column, Column]:
        return _outside(field, n), _finding(
            name, _range_message(field, n), f"dictionary: {table}_table: ", _index(idx), f".{field}")

    # Mappings and links are listed from entry 1; their printed position starts at 0.
    shifted = F.col("idx") - 1
    hex16 = lambda c: F.lower(F.lpad(F.conv(_s(c), 10, 16), 16, "0"))
    both_zero = (F.col("memory_start") == 0) & (F.col("memory_limit") == 0)
    mappings = _emit(
        entries(t.dict_mappings.where("idx >= 1"), "n_strings"), "mapping_table",
        rule("R22", "mapping", "filename_strindex", "n_strings", shifted),
        (~both_zero & ~(F.col("memory_start") < F.col("memory_limit")), _finding("R23", F.concat(
            F.lit("memory_start="), hex16("memory_start"), F.lit(", memory_limit="), hex16("memory_limit"),
            F.lit(": must be both zero or start < limit")), "dictionary: mapping_table: ", _index(shifted))),
    )
    locations = entries(t.dict_locations, "n_mappings", "n_functions")
    mapping_refs = _emit(locations, "location_table", rule("R25", "location", "mapping_index", "n_mappings"))
    lines = locations.select("*", F.posexplode("lines").alias("line_idx", "line_row"))
    line_path = lambda field: (
        "dictionary: location_table: ", _index("idx"), F.concat(F.lit(".line["), _s("line_idx"), F.lit("]: ")), field)
    fn = F.col("line_row")["function_index"]
    sign = lambda field: (
        F.col("line_row")[field] < 0,
        _finding("R26", _negative_message(F.col("line_row")[field]), *line_path(field), pos=F.col("line_idx")))
    line_rules = _emit(
        lines, "location_table",
        (_outside(fn, F.col("n_functions")), _finding(
            "R26", _range_message(fn, "n_functions"), *line_path("function_index"), pos=F.col("line_idx"))),
        sign("line"), sign("column"),
    )
    functions = _emit(
        entries(t.dict_functions, "n_strings"), "function_table",
        *[rule("R27", "function", c, "n_strings") for c in ("name_strindex", "system_name_strindex", "filename_strindex")],
        (F.col("start_line") < 0, _finding(
            "R27", _negative_message("start_line"), "dictionary: function_table: ", _index("idx"), ".start_line")),
    )

    def id_length(field: str, wanted: int) -> tuple[Column, Column]:
        got = F.coalesce(F.octet_length(field), F.lit(0))
        return got != wanted, _finding("R28", F.concat(
            F.lit("len(["), _s(shifted), F.lit(f"].{field}) == "), _s(got), F.lit(f", want {wanted}")),
            "dictionary: link_table")

    links = _emit(entries(t.dict_links.where("idx >= 1")), "link_table", id_length("trace_id", 16), id_length("span_id", 8))
    attributes = _emit(
        entries(t.dict_attributes, "n_strings"), "attribute_table",
        rule("R30", "attribute", "key_strindex", "n_strings"), rule("R30", "attribute", "unit_strindex", "n_strings"),
    )
    frames = entries(t.dict_stacks, "n_locations").select(
        "payload_id", "entry_idx", "idx", "n_locations", F.posexplode("location_indices").alias("j", "loc"))
    stacks = _emit(frames, "stack_table", (_outside("loc", "n_locations"), _finding(
        "R31", _range_message("loc", "n_locations"), "dictionary: stack_table: ", _index("idx"),
        F.concat(F.lit(".location_indices["), _s("j"), F.lit("]")), pos=F.col("j"))))
    return reduce(DataFrame.unionByName, [mappings, mapping_refs, line_rules, functions, links, attributes, stacks])


def check_duplicate_strings(t: ProfileTables) -> DataFrame:
    """Repeats of a string, naming its first index; only for tables that start with ''."""
    valid = t.dict_strings.where("idx = 0 AND value = ''").join(
        _checked(t), "payload_id", "left_semi").select("payload_id")
    strings = t.dict_strings.join(valid, "payload_id", "left_semi")
    firsts = strings.groupBy("payload_id", "value").agg(
        F.min("idx").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = strings.join(firsts, ["payload_id", "value"]).where("idx > first").withColumn("entry_idx", F.col("idx"))
    message = F.concat(
        F.lit("duplicate string at index "), _s("idx"), F.lit(", orig index "), _s("first"), F.lit(": "), F.col("value"))
    return _shape(repeats.withColumn("_f", _finding("R29", message, "dictionary: string_table")), "string_table")


def check_duplicate_mappings(t: ProfileTables) -> DataFrame:
    """Repeats of (filename, attribute set, start, limit, offset) from entry 1 on."""
    identity = ["payload_id", "filename_strindex", "attrs", "memory_start", "memory_limit", "file_offset"]
    entries = _with_counts(t.dict_mappings.where("idx >= 1"), t).withColumn("attrs", F.array_sort("attribute_indices"))
    firsts = entries.groupBy(*identity).agg(F.min("idx").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = entries.join(firsts, identity).where("idx > first").withColumn("entry_idx", F.col("idx"))
    listed = F.concat(F.lit("["), F.concat_ws(" ", F.transform("attrs", lambda x: x.cast("string"))), F.lit("]"))
    message = F.concat(
        F.lit("duplicate mapping at index "), _s(F.col("idx") - 1), F.lit(": filename_strindex="), _s("filename_strindex"),
        F.lit(", attribute_indices="), listed, F.lit(", memory_start="), _s("memory_start"), F.lit(", memory_limit="),
        _s("memory_limit"), F.lit(", file_offset="), _s("file_offset"),
    )
    return _shape(repeats.withColumn("_f", _finding("R24", message, "dictionary: mapping_table")), "mapping_table")


# --- orphans ---------------------------------------------------------------------

_ORPHAN_RULES = {
    "string": "R32", "attribute": "R33", "mapping": "R34", "function": "R35", "location": "R36", "stack": "R37", "link": "R38",
}


def _word_and_bit(idx: Column) -> tuple[Column, Column]:
    """Which 64-bit word of a table's bitmap has the bit of ``idx``, and that bit."""
    return (F.shiftright(idx, 6).alias("word"),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), idx.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))


def reference_bitmaps(t: ProfileTables, usage: DataFrame, lists: DataFrame) -> DataFrame:
    """(payload_id, table_name, word, mask): bit i of word w is set if some row refers to entry 64 w + i.

    Every table is read once and its references become bits at once; ``bit_or``
    has partial aggregation, so a table's references shrink to a bit per entry
    before they are shuffled.  Strings referred to by attribute values or resource
    attributes do not count, and a reference from an entry that is itself an
    orphan does.
    """
    def bits(df: DataFrame, **tables: Column) -> DataFrame:
        each = F.inline(F.array(*[F.struct(F.lit(n).alias("table_name"), c.cast("array<bigint>").alias("idxs")) for n, c in tables.items()]))
        found = df.select("payload_id", each).select("payload_id", "table_name", F.explode("idxs").alias("idx"))
        return found.where("idx >= 0").select("payload_id", "table_name", *_word_and_bit(F.col("idx")))

    columns = lambda *cs: F.array(*[F.col(c) for c in cs])
    many = [
        bits(t.profiles, string=columns("sample_type.type_strindex", "sample_type.unit_strindex",
                                        "period_type.type_strindex", "period_type.unit_strindex")),
        bits(t.dict_mappings, string=columns("filename_strindex")),
        bits(t.dict_functions, string=columns("name_strindex", "system_name_strindex", "filename_strindex")),
        bits(t.dict_attributes, string=columns("key_strindex", "unit_strindex")),
        bits(t.dict_locations, mapping=columns("mapping_index"), function=F.col("lines.function_index")),
        bits(t.dict_stacks, location=F.col("location_indices")),
        bits(lists, attribute=F.col("attribute_indices")),
        usage.where("table_name <> ''").select("payload_id", "table_name", "word", F.col("mask").alias("bit")),
    ]
    return reduce(DataFrame.unionByName, many).groupBy("payload_id", "table_name", "word").agg(F.bit_or("bit").alias("mask"))


def _table_bitmaps(t: ProfileTables) -> DataFrame:
    """As ``reference_bitmaps``, with a bit for every entry but the first, from the tables' lengths alone."""
    tables = F.inline(F.array(*[
        F.struct(F.lit(n).alias("table_name"), F.col(f"n_{n}s").cast("bigint").alias("n")) for n in _ORPHAN_RULES]))
    lengths = _checked(t).select("payload_id", tables).where("n > 1")
    # In two steps, so that a large table is no long array.
    blocks = lengths.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.col("n") - 1, 18))).alias("block"))
    last = F.least(F.shiftright(F.col("n") - 1, 6), F.col("block") * 4096 + 4095)
    words = blocks.select("payload_id", "table_name", "n", F.explode(F.sequence(F.col("block") * 4096, last)).alias("word"))
    used = F.least(F.col("n") - F.col("word") * 64, F.lit(64))
    ones = F.lit(-1).cast("bigint")
    mask = F.when(used == 64, ones).otherwise(F.bitwise_not(F.call_function("shiftleft", ones, used.cast("int"))))
    first = F.when(F.col("word") == 0, F.lit(-2).cast("bigint")).otherwise(ones)
    return words.select("payload_id", "table_name", "word", mask.bitwiseAND(first).alias("entries"))


def check_orphans(t: ProfileTables, usage: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """Dictionary entries that nothing refers to; entry 0 is always in use.

    The bitmap of a table's entries without the bits of its references: an
    entry is a row again only if it is an orphan.
    """
    usage = sample_usage(t) if usage is None else usage
    lists = attribute_lists(t, usage) if lists is None else lists
    both = _table_bitmaps(t).join(reference_bitmaps(t, usage, lists), ["payload_id", "table_name", "word"], "left")
    left = F.col("entries").bitwiseAND(F.bitwise_not(F.coalesce("mask", F.lit(0).cast("bigint"))))
    found = both.select("payload_id", "table_name", "word", left.alias("left")).where("left <> 0")
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(F.col("left"), b) == 1)
    orphans = found.select("payload_id", "table_name", F.explode(F.transform(places, lambda b: F.col("word") * 64 + b)).alias("idx"))
    rule = F.create_map(*[F.lit(x) for pair in _ORPHAN_RULES.items() for x in pair])[F.col("table_name")]
    blank = F.lit(None).cast("int")
    return orphans.select(
        "payload_id", rule.alias("rule"), F.concat("table_name", F.lit("_table")).alias("table_name"),
        *[(F.col("idx").cast("int") if c == "entry_idx" else blank).alias(c) for c in _ORDINALS],
        F.concat(F.lit("dictionary: "), F.col("table_name"), F.lit("_table")).alias("path"),
        F.concat(F.lit("unreferenced entry at index "), _s("idx")).alias("message"),
    )


def check_all(
    t: ProfileTables, duplicates: bool = True, sample_shapes: bool = True, orphans: bool = True
) -> DataFrame:
    """All findings as one frame; the three flags switch the optional rule groups.

    Scans are shared between the rules: samples are read for what they refer
    to, for one aggregate per profile, (failing profiles only) for the findings, and
    for the ids of those with bad lists.
    """
    usage = sample_usage(t)
    lists = attribute_lists(t, usage)
    bad = stash(bad_attribute_lists(t, lists), "bad-attribute-lists")
    rules = SAMPLE_RULES if sample_shapes else (*_INDEX_RULES, *_TIME_RULES)
    parts = [
        check_tree(t), check_profiles(t), sample_findings(t, rules, bad), _owners_of_bad_lists(t, bad),
        check_zero_entries(t), check_dictionary_indexes(t),
    ]
    if duplicates:
        parts += [check_duplicate_strings(t), check_duplicate_mappings(t)]
    if orphans:
        parts.append(check_orphans(t, usage, lists))
    return reduce(DataFrame.unionByName, parts)


def in_traversal_order(findings: DataFrame) -> DataFrame:
    """Findings sorted as a walk over the payload meets them: tree, dictionary, orphans."""
    section = F.when(F.col("path").startswith("dictionary"), F.when(
        F.col("rule").between("R32", "R38"), 2).otherwise(1)).otherwise(0)
    # Fixed order of the dictionary sections of the walk.
    walk = ["mapping_table", "location_table", "function_table", "link_table", "string_table", "attribute_table", "stack_table"]
    orphan_walk = ["string_table", "attribute_table", "mapping_table", "function_table", "location_table", "stack_table", "link_table"]
    place = lambda names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col("table_name"))
    rule_no = F.substring("rule", 2, 3).cast("int")
    return findings.orderBy(
        "payload_id", section, F.when(section == 1, place(walk)).when(section == 2, place(orphan_walk)).otherwise(0),
        *[F.col(c).asc_nulls_first() for c in ("rp_idx", "sp_idx", "p_idx", "s_idx", "entry_idx")], rule_no,
        F.col("pos").asc_nulls_first(),
    )


def report(findings: DataFrame) -> DataFrame:
    """Text lines ``path: message`` in traversal order."""
    line = F.when(F.col("path") == "", F.col("message")).otherwise(F.concat("path", F.lit(": "), "message"))
    return in_traversal_order(findings).select("payload_id", line.alias("line"))
