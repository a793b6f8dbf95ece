"""Decoding, encoding, framing, files, CSV and listing."""

import csv
import random
import struct

import pytest
from pyspark.sql import functions as F

from emberframe.functions.values import quoted, shortest_decimal
from emberframe.operators import nested_values, sizes, stats
from emberframe.schema import STATS_COLUMNS
from emberframe.session import new_path
from emberframe.sources import codec, encoder, listing, payloads, stats_csv
from emberframe.sources.ordered_csv import write_ordered_csv
from payload_builder import dictionary, fill, message, payload, tables_of


def random_value(rng, depth=0):
    kinds = ["string", "bool", "int", "double", "bytes", "string_ref"] + (["array", "kvlist"] if depth < 2 else [])
    kind = rng.choice(kinds)
    if kind == "array":
        return {"array": {"values": [random_value(rng, depth + 1) for _ in range(rng.randrange(3))]}}
    if kind == "kvlist":
        return {"kvlist": {"values": [{"key": "k%d" % i, "value": random_value(rng, depth + 1)} for i in range(rng.randrange(3))]}}
    return {kind: {
        "string": "v" * rng.randrange(200), "bool": rng.random() < 0.5, "int": rng.randrange(-5, 1 << 40),
        "double": rng.uniform(-1e6, 1e6), "bytes": rng.randbytes(rng.randrange(5)), "string_ref": rng.randrange(5)}[kind]}


def random_payload(seed):
    rng = random.Random(seed)
    ints = lambda top, n=4: [rng.randrange(-1, top) for _ in range(rng.randrange(n))]
    kv = lambda: {"key": rng.choice(["", "a", "host.name"]), "value": random_value(rng), "key_ref": rng.randrange(3)}
    samples = lambda: [{
        "stack_index": rng.randrange(-1, 300), "values": [rng.randrange(-3, 1 << 50) for _ in range(rng.randrange(4))],
        "attribute_indices": ints(400), "link_index": rng.randrange(3), "timestamps": [rng.randrange(1 << 62) for _ in range(rng.randrange(4))],
    } for _ in range(rng.randrange(6))]
    profile = lambda: {
        "samples": samples(), "time_unix_nano": rng.randrange(1 << 61), "duration_nano": rng.randrange(1 << 40),
        "period": rng.randrange(-2, 9), "profile_id": rng.randbytes(16), "original_payload": rng.randbytes(rng.randrange(300)),
        "original_payload_format": rng.choice(["", "pprof"]), "attribute_indices": ints(20), "dropped_attributes_count": rng.randrange(3),
    } | ({"sample_type": {"type_strindex": rng.randrange(300)}} if rng.random() < 0.7 else {})
    scope = lambda: {"profiles": [profile() for _ in range(rng.randrange(3))], "schema_url": rng.choice(["", "s"])} | (
        {"scope": {"name": "n", "attributes": [kv()]}} if rng.random() < 0.7 else {})
    resource = lambda: {"scope_profiles": [scope() for _ in range(rng.randrange(3))]} | (
        {"resource": {"attributes": [kv() for _ in range(rng.randrange(4))], "entity_refs": [{"type": "t", "id_keys": ["a", ""]}]}}
        if rng.random() < 0.8 else {})
    return {
        "resource_profiles": [resource() for _ in range(rng.randrange(1, 4))],
        "dictionary": dictionary(
            strings=["", *("s" * rng.randrange(150) for _ in range(5))],
            mappings=[{}, {"memory_start": rng.randrange(1 << 64), "attribute_indices": ints(300)}],
            locations=[{}, {"address": rng.randrange(1 << 64), "lines": [{"function_index": 1, "line": rng.randrange(-1, 500)}, {}]}],
            functions=[{}, {"name_strindex": 1, "start_line": 7}], links=[{}, {"trace_id": b"x" * 16}],
            attributes=[{}, {"key_strindex": 1, "value": random_value(rng)}, {"unit_strindex": 300}],
            stacks=[{}, {"location_indices": ints(300, 9)}]),
    }


@pytest.fixture(scope="module")
def randomized(spark):
    contents = [random_payload(seed) for seed in range(25)]
    return contents, tables_of(spark, *contents)


def test_encode_is_the_inverse_of_decode(randomized):
    contents, t = randomized
    got = {r.payload_id: bytes(r.message) for r in encoder.encode(t).collect()}
    parse = codec.message_classes()["Request"].FromString
    for i, content in enumerate(contents):
        assert parse(got[i]) == fill(codec.message_classes()["Request"](), content), i


def test_computed_sizes_equal_encoded_lengths(randomized):
    contents, t = randomized
    got = {r.payload_id: r.uncompressed_bytes for r in sizes.payload_bytes(t).collect()}
    assert got == {i: len(message(c)) for i, c in enumerate(contents)}


def test_a_payload_is_one_message(spark):
    long = {"resource_profiles": [{"scope_profiles": [{"profiles": [{"samples": [{"values": [1]}] * 100_500}]}]}], "dictionary": dictionary()}
    t = tables_of(spark, long, payload())
    got = {r.payload_id: r.n for r in encoder.encode(t).select("payload_id", F.octet_length("message").alias("n")).collect()}
    assert got == {i: len(message(c)) for i, c in enumerate([long, payload()])}
    assert got == {r.payload_id: r.uncompressed_bytes for r in sizes.payload_bytes(t).collect()}


def test_reading_stops_at_an_undecodable_file(spark, tmp_path):
    (tmp_path / "good").write_bytes(message(payload()))
    (tmp_path / "poor").write_bytes(b"\0\0\1")
    with pytest.raises(Exception, match="poor"):
        payloads.read_payloads(spark, str(tmp_path))
    nested = payloads.read_nested(spark, str(tmp_path), mode="PERMISSIVE")
    assert [r.path.rsplit("/", 1)[1] for r in payloads.decode_errors(nested).collect()] == ["poor"]


def test_doubles_and_varints(spark):
    rng = random.Random(7)
    doubles = [0.0, -0.0, 1.0, 0.5, -3.25, 5e-324, 1.7976931348623157e308, float("inf"), 1.9999999999999998] + [
        rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(500)]
    df = spark.createDataFrame([(d,) for d in doubles], "d double")
    for r in df.select("d", F.expr(encoder.little_endian(encoder.double_bits("d"))).alias("h")).collect():
        assert r.h == struct.pack("<d", r.d).hex().upper()


def test_text_forms(spark):
    df = spark.createDataFrame([(1.5e-7,), (123456789012.5,), (0.25,), (3.0,), (-2.5e-9,), (1e22,)], "d double")
    assert [r[0] for r in df.select(F.expr(shortest_decimal("d"))).collect()] == [
        "0.00000015", "123456789012.5", "0.25", "3", "-0.0000000025", "10000000000000000000000"]
    assert spark.createDataFrame([('a"b\\c\n',)], "s string").select(F.expr(quoted("s"))).first()[0] == '"a\\"b\\\\c\\n"'


def test_framed_files(spark):
    one = message(payload())
    prefixed = lambda b: len(b).to_bytes(4, "big") + b
    cases = {
        "a": one, "b": prefixed(one) * 3, "c": b"", "d": b"\0\0\1", "e": (99).to_bytes(4, "big") + one, "f": prefixed(b"\0\1\2"),
        "g": prefixed(one) + prefixed(b"\0\1\2") + prefixed(one),
    }
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "path string, content binary")
    got = {r.path: (r.n, r.e) for r in payloads.decode(files).groupBy("path").agg(
        F.count_if(F.col("error").isNull()).alias("n"), F.max("error").alias("e")).collect()}
    assert got["g"][0] == 2  # the frames around a poor one stay
    assert {k: v[0] for k, v in got.items() if v[1] is None} == {"a": 1, "b": 3, "c": 1}
    assert "inside a frame's size" in got["d"][1] and "inside a frame:" in got["e"][1] and "DecodeError" in got["f"][1]
    with pytest.raises(Exception, match="ends inside a frame|Error parsing"):
        payloads.decode(files, mode="FAILFAST").collect()


def test_nested_values_are_opened_level_by_level(spark):
    """Text bytes computed from the JSON text equal those counted while decoding."""
    rng = random.Random(5)
    values = [random_value(rng) for _ in range(200)] + [{"array": {"values": [{}, {"kvlist": {"values": [{"key": "alone"}]}}]}}, {"kvlist": {"values": []}}]
    t = tables_of(spark, {"dictionary": dictionary(strings=["", "é", "three"], attributes=[{}, *({"value": v} for v in values)])})
    attributes = t.dict_attributes.select("payload_id", "idx", "value", "value.nested_json")
    entries = nested_values.nested_entries(attributes, ["payload_id", "idx"])
    got = {r.idx: r.text_bytes for r in nested_values.nested_bytes(entries, ["payload_id", "idx"], t.dict_strings).collect()}
    want = {r.idx: r.value["payload_bytes"] for r in attributes.where("nested_json IS NOT NULL").collect()}
    assert got == want and len(want) > 30 and max(want.values()) > 0
    one = '{"kvlist":[["a",0,{"array":[{"string":"x{"},null,{"bytes":"AAEC"}]}],["",2,{"int":7}],["z",0,null]]}'
    rows = nested_values.nested_entries(spark.createDataFrame([(1, one), (2, None)], "id int, nested_json string"), ["id"])
    assert sorted((r.depth, r.path, r.key, r.key_ref, r.kind, r.text, r.text_bytes) for r in rows.collect()) == [
        (0, "$", None, 0, "kvlist", None, 0), (1, "$.", "", 2, "int", "7", 0), (1, "$.a", "a", 0, "array", None, 1),
        (1, "$.z", "z", 0, None, None, 1), (2, "$.a[0]", None, 0, "string", "x{", 2), (2, "$.a[1]", None, 0, None, None, 0),
        (2, "$.a[2]", None, 0, "bytes", "AAEC", 3)]
    none = nested_values.nested_entries(spark.createDataFrame([], "id int, nested_json string"), ["id"])
    assert nested_values.nested_bytes(none, ["id"]).count() == 0


def test_framed_file_is_read_by_spans(spark, tmp_path):
    """Whatever the spans, rows are those of the whole file; a large one is the work of several tasks."""
    contents = [message(random_payload(seed)) for seed in range(40)]
    prefixed = lambda b: len(b).to_bytes(4, "big") + b
    cases = {
        "many": b"".join(prefixed(c) for c in contents), "poor": prefixed(contents[0]) + prefixed(b"\0\1\2") + prefixed(contents[1]),
        "cut": prefixed(contents[0]) + prefixed(contents[1])[:-3], "size": prefixed(contents[0]) + b"\0\0", "none": b"",
        "one": contents[2], "_hidden": contents[3], ".dot": prefixed(contents[4]) * 2, "a b%20c": contents[5], "zero": prefixed(b"") * 3,
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "folder").mkdir()
    content = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "path string, content binary")
    told = lambda df: sorted((r.path.rsplit("/", 1)[-1], r.frame_no, r.n_bytes, r.error or "", str(r.dictionary)) for r in df.collect())
    want = told(payloads.decode(content))
    for span_bytes in (1, 700, 1 << 20):
        nested = payloads.read_nested(spark, str(tmp_path), mode="PERMISSIVE", span_bytes=span_bytes)
        assert told(nested) == want
        ids = [r.payload_id for r in nested.select("payload_id").collect()]
        assert len(set(ids)) == len(ids)
    one = payloads.read_nested(spark, str(tmp_path / "many"), span_bytes=len(cases["many"]) // 6)
    assert one.count() == 40 and one.select(F.shiftright("payload_id", 33)).distinct().count() > 1
    assert {r.path.rsplit("/", 1)[1]: r.length for r in payloads.list_payloads(spark, str(tmp_path)).collect()} == {
        k: len(v) for k, v in cases.items()}
    assert payloads.read_nested(spark, str(tmp_path / "folder")).count() == 0
    with pytest.raises(FileNotFoundError, match="absent"):
        payloads.read_nested(spark, str(tmp_path / "absent"))
    with pytest.raises(Exception, match="poor, message 1"):
        payloads.read_nested(spark, str(tmp_path / "poor"), span_bytes=1)


def test_files_round_trip_with_positions(spark, view):
    path = new_path(spark, "test-files")
    payloads.write_payload_files(encoder.encode(view), path).count()
    assert [r.id for r in payloads.list_payloads(spark, path).orderBy("path").collect()] == list(range(1, 11))
    t = payloads.read_payloads(spark, path)
    drop = lambda df: sorted(tuple(r) for r in df.drop("id").collect())
    assert drop(stats.payload_stats(t)) == drop(stats.payload_stats(view))


def test_measured_sizes_agree_with_computed(view):
    measured = {r.payload_id: (r.uncompressed_bytes, r.gzip_6_bytes) for r in payloads.measured_sizes(view).collect()}
    computed = {r.payload_id: r.uncompressed_bytes for r in sizes.payload_bytes(view).collect()}
    assert {k: v[0] for k, v in measured.items()} == computed
    assert all(0 < z < n for n, z in measured.values())


def test_stats_csv(spark, tmp_path):
    row = {n: 1 if k == "bigint" else 0.5 for n, k in STATS_COLUMNS} | {
        "start_ts": 1_500_000_000_120_000_000, "end_ts": None, "go_fraction": None, "perl_fraction": 1e-7}
    df = spark.createDataFrame([row], ",".join(f"{n} {k}" for n, k in STATS_COLUMNS))
    stats_csv.write_stats_csv(df, str(tmp_path / "csv"))
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "csv").glob("*.csv"))]
    text = parts[0][:1] + [line for part in parts for line in part[1:]]
    assert text[0].split(",") == [n for n, _ in STATS_COLUMNS]
    cells = dict(zip(text[0].split(","), text[1].split(",")))
    assert cells["start_ts"] == "2017-07-14T02:40:00.12Z" and cells["end_ts"] == "" and cells["go_fraction"] == ""
    assert cells["perl_fraction"] == "0.0000001" and cells["id"] == "1"
    back = stats_csv.read_stats_csv(spark, str(tmp_path / "csv")).first()
    assert back.go_fraction is None and back.perl_fraction == 1e-7


def test_listing(spark):
    t = tables_of(spark, {
        "resource_profiles": [{"resource": {"attributes": [
            {"key": "b", "value": {"string": 'q"'}}, {"key_ref": 1, "value": {"string_ref": 2}}, {"key": "c", "value": {"int": 5}}]},
            "scope_profiles": [{"scope": {"name": "sc"}, "profiles": [{
                "sample_type": {"type_strindex": 3, "unit_strindex": 4}, "time_unix_nano": 10_500_000_000, "duration_nano": 500_000_000,
                "samples": [{"attribute_indices": [2, 1]}, {"attribute_indices": [2, 999, -1]}]}]}]}],
        "dictionary": dictionary(strings=["", "a", "x", "cpu", "ms", "z.key", "y.key", "unit"], attributes=[
            {}, {"key_strindex": 5, "value": {"int": 1}}, {"key_strindex": 6, "value": {"string": "s"}, "unit_strindex": 7}]),
    })
    lines = [r.line for r in listing.listing(t).orderBy(*listing.LINE_ID).collect()]
    assert lines == [
        'Resource: &a=&"x", b="q\\"", c=5', "  Scope: sc: ",
        "    Profile: cpu=ms (1970-01-01 00:00:10 +0000 UTC - 1970-01-01 00:00:10.5 +0000 UTC)",
        '      Sample: &y.key="s" &unit, &z.key=1', '      Sample: &?[999], &?[-1], &y.key="s" &unit']


def test_ordered_csv_is_one_file(spark, tmp_path):
    path = tmp_path / "out" / "rows.csv"
    rows = spark.range(5_000).repartition(16).selectExpr("id", "id % 7 AS g", "IF(id % 3 = 0, NULL, concat('a,\"', id, '\n')) AS text")
    write_ordered_csv(rows, str(path), ["g", "id"], ["id", "text"])
    with path.open(newline="") as source:
        header, *lines = csv.reader(source)
    assert header == ["id", "text"]
    assert [int(r[0]) for r in lines] == sorted(range(5_000), key=lambda i: (i % 7, i))
    assert all(text == ("" if int(i) % 3 == 0 else f'a,"{i}\n') for i, text in lines)
    assert [p.name for p in path.parent.iterdir() if not p.name.endswith(".crc")] == ["rows.csv"]  # nothing else is left
    with pytest.raises(Exception, match="rows.csv"):
        write_ordered_csv(rows, str(path), ["id"], ["id"])
    write_ordered_csv(rows.limit(0), str(path), ["id"], ["id"], overwrite=True)
    assert path.read_text() == "id\n"


def test_variants_are_encoded_together(spark, randomized):
    """each variant was encoded alone, its rows as text; frames that variants share now move once."""
    contents, t = randomized
    fewer = t.with_tables(resource_attributes=t.resource_attributes.where("pos = 0"))
    rows = encoder.pieces(t, fewer)
    assert rows.where("variants = 3").count() == rows.count() - 2 * fewer.resource_attributes.count() - t.resource_attributes.where("pos > 0").count()
    got = payloads.measured_variants({"whole": t, "fewer": fewer})
    for name, tables in (("whole", t), ("fewer", fewer)):
        want = {r.payload_id: (r.uncompressed_bytes, r.gzip_6_bytes) for r in payloads.measured_sizes(tables).collect()}
        assert {r.payload_id: (r.uncompressed_bytes, r.gzip_6_bytes) for r in got[name].collect()} == want
    whole = {r.payload_id: r.uncompressed_bytes for r in got["whole"].collect()}
    assert whole == {i: len(message(c)) for i, c in enumerate(contents)}
