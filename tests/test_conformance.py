"""Conformance cases: one hand-made payload each, all decoded and checked together."""

import pytest

from emberframe.operators import conformance
from payload_builder import dictionary, message, payload, tables_of

V = lambda s: {"string": s}
#: A profile from 5 000 to 5 060.
HOUR = {"time_unix_nano": 5_000, "duration_nano": 60}
LATEST = (1 << 64) - 1
profile_with = lambda *samples, **other: payload({"samples": list(samples)} | other)
at_times = lambda *times: profile_with({"timestamps": list(times)}, **HOUR)
out_of_hour = lambda i, ts: f"timestamps_unix_nano[{i}]={ts} is outside profile time range [5000, 5060)"
TWICE = payload(dict_tables={"strings": ["", "north", "south", "north", "south"]})
UNEVEN = profile_with({"timestamps": [5_001]}, {"values": [4]}, **HOUR)
SPARE = payload(dict_tables={"strings": ["", "spare"]})
TABLE_KEYS = {"strings": ["", "libcore.so", "os", "arch"],
              "attributes": [{}, {"key_strindex": 2, "value": V("linux")}, {"key_strindex": 3, "value": V("arm")}]}
loaded = lambda *attributes: {"filename_strindex": 1, "attribute_indices": list(attributes), "memory_start": 0x10, "memory_limit": 0x90}

# name, payload, (duplicates, shapes, orphans), expected text or None
CASES = [
    # tree
    ("no resources", {}, (1, 0, 0), "resource profiles are empty"),
    ("resource without scopes", {"dictionary": dictionary(), "resource_profiles": [{}]}, (1, 0, 0), "resource profiles has no scope profiles"),
    ("scope without profiles", {"dictionary": dictionary(), "resource_profiles": [{"scope_profiles": [{}]}]}, (1, 0, 0),
     "scope profiles has no profiles"),
    ("least payload", payload(), (1, 1, 1), None),
    # times, also beyond 2^63
    ("time just before", at_times(4_999, 5_001), (1, 0, 0), out_of_hour(0, 4_999)),
    ("first and last time", at_times(5_000, 5_059), (1, 0, 0), None),
    ("time at the end", at_times(5_030, 5_060), (1, 0, 0), out_of_hour(1, 5_060)),
    ("far time", at_times(5_030, LATEST), (1, 0, 0), out_of_hour(1, LATEST)),
    ("far profile", profile_with({"timestamps": [LATEST - 1]}, time_unix_nano=LATEST - 5, duration_nano=5), (1, 0, 0), None),
    ("before a far profile", profile_with({"timestamps": [9]}, time_unix_nano=LATEST - 5, duration_nano=5), (1, 0, 0),
     f"timestamps_unix_nano[0]=9 is outside profile time range [{LATEST - 5}, {LATEST})"),
    # shapes
    ("empty sample", profile_with({}), (1, 1, 0), "sample must have at least one values or timestamps_unix_nano entry"),
    ("one value", profile_with({"values": [8]}, {"values": [9]}), (1, 1, 0), None),
    ("two values", profile_with({"values": [8, 9]}), (1, 1, 0),
     "values (len=2) must contain a single element if timestamps_unix_nano is not set"),
    ("times alone", at_times(5_010, 5_020), (1, 1, 0), None),
    ("as many values as times", profile_with({"values": [3, 4], "timestamps": [5_010, 5_020]}, **HOUR), (1, 1, 0), None),
    ("fewer times than values", profile_with({"values": [3, 4, 5], "timestamps": [5_010, 5_020]}, **HOUR), (1, 1, 0),
     "values (len=3) and timestamps_unix_nano (len=2) must contain the same number of elements"),
    ("uneven shapes", UNEVEN, (1, 1, 0),
     "profile[0]: sample[1]: sample shape values_only does not match expected sample shape timestamps_only"),
    ("uneven after an empty one", profile_with({"timestamps": [5_001]}, {"timestamps": [5_002]}, {}, **HOUR), (1, 1, 0),
     "sample[2]: sample shape unspecified does not match expected sample shape timestamps_only"),
    ("uneven shapes allowed", UNEVEN, (1, 0, 0), None),
    # repeated entries
    ("string not empty at 0", payload(dict_tables={"strings": ["north", ""]}), (1, 0, 0), 'must have empty string at index 0, got "north"'),
    ("string twice", TWICE, (1, 0, 0), "duplicate string at index 4, orig index 2: south"),
    ("string twice allowed", TWICE, (0, 0, 0), None),
    ("mapping twice, attributes in other order", payload(dict_tables=TABLE_KEYS | {"mappings": [{}, loaded(2, 1), {"memory_limit": 5}, loaded(1, 2)]}),
     (1, 0, 0), "duplicate mapping at index"),
    ("key twice", payload(dict_tables={
        "stacks": [{}], "locations": [{}, {"address": 6, "attribute_indices": [0, 1, 2]}], "strings": ["", "zone"],
        "attributes": [{}, {"key_strindex": 1, "value": V("a")}, {"key_strindex": 1, "value": {"int": 3}}]}), (1, 0, 0),
     'dictionary: location_table: [1].attribute_indices: [2].key_strindex: duplicate key "zone", previously seen at [1].key_strindex'),
    # orphans
    ("spare string", SPARE, (1, 0, 1), "string_table: unreferenced entry at index 1"),
    ("spare string allowed", SPARE, (1, 0, 0), None),
    ("spare mapping", payload(dict_tables={"mappings": [{}, {}, {"memory_limit": 7}]}), (0, 0, 1), "mapping_table: unreferenced entry at index 2"),
    ("spare stack", payload(dict_tables={"stacks": [{}, {"location_indices": [0]}]}), (1, 0, 1), "stack_table: unreferenced entry at index 1"),
    ("spare link", payload(dict_tables={"links": [{}, {"trace_id": b"t" * 16, "span_id": b"s" * 8}]}), (1, 0, 1),
     "link_table: unreferenced entry at index 1"),
    ("nothing spare", payload(
        {"period_type": {"type_strindex": 1, "unit_strindex": 2}, "attribute_indices": [1], "samples": [{"stack_index": 1, "link_index": 1, "values": [6]}]},
        {"strings": ["", "wall", "ns", "main", "main.c", "app", "color"], "links": [{}, {"trace_id": b"t" * 16, "span_id": b"s" * 8}],
         "attributes": [{}, {"key_strindex": 6, "value": V("red")}], "mappings": [{}, {"filename_strindex": 5}],
         "functions": [{}, {"name_strindex": 3, "filename_strindex": 4}],
         "locations": [{}, {"mapping_index": 1, "address": 3, "lines": [{"function_index": 1, "line": 12}]}],
         "stacks": [{}, {"location_indices": [1]}]}), (1, 1, 1), None),
    # indexes and entry values
    ("stack index", payload({"samples": [{"stack_index": 5, "values": [1]}]}), (1, 1, 0), "sample[0]: stack_index: index 5 is out of range [0..1)"),
    ("negative stack index", payload({"samples": [{"stack_index": -1, "values": [1]}]}), (1, 1, 0), "stack_index: index -1 is out of range [0..1)"),
    ("link index", payload({"samples": [{"link_index": 2, "values": [1]}]}), (1, 1, 0), "link_index: index 2 is out of range [0..1)"),
    ("sample attribute index", payload({"samples": [{"attribute_indices": [0, 7], "values": [1]}]}), (1, 1, 0),
     "sample[0]: attribute_indices: [1]: index 7 is out of range [0..1)"),
    ("attribute key index", payload({"attribute_indices": [1]}, {"attributes": [{}, {"key_strindex": 9}]}), (1, 1, 0),
     "profile[0]: attribute_indices: [0].key_strindex: index 9 is out of range [0..1)"),
    ("sample type", payload({"sample_type": {"type_strindex": 4}}), (1, 1, 0), "profile[0]: sample_type: type_strindex: index 4 is out of range [0..1)"),
    ("empty string table", payload(dict_tables={"strings": []}), (1, 1, 0), "empty string table, must have at least empty string"),
    ("empty link table", payload(dict_tables={"links": []}), (1, 1, 0), "dictionary: link_table: empty table, must have at least zero value entry"),
    ("nonzero location", payload(dict_tables={"locations": [{"address": 1}]}), (1, 1, 0), "location_table: must have zero value"),
    ("nonzero attribute", payload(dict_tables={"attributes": [{"value": V("x")}]}), (1, 1, 0), "first attribute value must be nil"),
    ("attribute indexes at 0", payload(dict_tables={"attributes": [{"key_strindex": 1}], "strings": ["", "a"]}), (1, 1, 0),
     "first attribute must have zero key/unit indices, got KeyStrindex=1, UnitStrindex=0"),
    ("memory range", payload(dict_tables={"mappings": [{}, {"memory_start": 0xFFFFFFFF80000000, "memory_limit": 16}]}), (1, 1, 0),
     "mapping_table: [0]: memory_start=ffffffff80000000, memory_limit=0000000000000010: must be both zero or start < limit"),
    ("line", payload(dict_tables={"locations": [{}, {"lines": [{"line": -1, "function_index": 3}]}]}), (1, 1, 0),
     "dictionary: location_table: [1].line[0]: function_index: index 3 is out of range [0..1)"),
    ("negative line", payload(dict_tables={"locations": [{}, {"lines": [{"line": -1}]}]}), (1, 1, 0), "line[0]: line: -1 < 0, must be non-negative"),
    ("start line", payload(dict_tables={"functions": [{}, {"start_line": -2}]}), (1, 1, 0), "[1].start_line: -2 < 0, must be non-negative"),
    ("link lengths", payload(dict_tables={"links": [{}, {"trace_id": b"abc"}]}), (1, 1, 0), "len([0].trace_id) == 3, want 16"),
    ("stack location", payload(dict_tables={"stacks": [{}, {"location_indices": [0, 4]}]}), (1, 1, 0),
     "stack_table: [1].location_indices[1]: index 4 is out of range [0..1)"),
    ("mapping file", payload(dict_tables={"mappings": [{}, {"filename_strindex": 3}]}), (1, 1, 0),
     "mapping_table: [0].filename_strindex: index 3 is out of range [0..1)"),
    ("unit index", payload(dict_tables={"attributes": [{}, {"unit_strindex": 3}]}), (1, 1, 0), "attribute_table: [1].unit_strindex: index 3"),
]


@pytest.fixture(scope="module")
def lines(spark):
    """Report lines per case; cases are grouped by their flags so each group is one check."""
    out = {}
    for flags in sorted({c[2] for c in CASES}):
        group = [c for c in CASES if c[2] == flags]
        t = tables_of(spark, *[c[1] for c in group])
        for name, *_ in group:
            out[name] = []
        for row in conformance.report(conformance.check_all(t, *map(bool, flags))).collect():
            out[group[row.payload_id][0]].append(row.line)
    return out


@pytest.mark.parametrize("name,expected", [(c[0], c[3]) for c in CASES], ids=[c[0] for c in CASES])
def test_case(lines, name, expected):
    if expected is None:
        assert lines[name] == []
    else:
        assert any(expected in line for line in lines[name]), lines[name]


def test_empty_payload_has_only_one_finding(lines):
    assert lines["no resources"] == ["resource profiles are empty"]


def test_message_is_stable():
    assert message(payload()) == message(payload())
