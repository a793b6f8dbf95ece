"""Numbering, order statistics, statistics, transforms and the study against brute force."""

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from emberframe.functions.numeric import ieee_div, next_power_of_two
from emberframe.operators import context, encodings, frames, lookups, sizes, sketches, stats, study, transforms
from emberframe.operators.ordinals import grouped_ordinal
from emberframe.operators.quantiles import lower_middle, nearest, order_statistics, upper_middle
from emberframe.schema import STATS_COLUMNS
from emberframe.sources import listing
from payload_builder import dictionary, payload, tables_of


def test_grouped_ordinal_with_one_large_group(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 > 0 THEN 0 ELSE id % 50 END AS g", "hash(id) % 500 AS x", "id")
    got = grouped_ordinal(df, ["g"], ["x", "id"], "n", start=1).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append(r)
    assert len(got) == 20_000
    for rows in groups.values():
        rows.sort(key=lambda r: (r.x, r.id))
        assert [r.n for r in rows] == list(range(1, len(rows) + 1))


def test_ordinals_beyond_an_int(spark):
    got = grouped_ordinal(spark.range(5), [], ["id"], "n", start=2**31 + 7, kind="bigint").collect()
    assert sorted(r.n for r in got) == [2**31 + 7 + i for i in range(5)]


def test_merged_sketches_are_within_one_percent(spark):
    """Ranks of merged sketches against exact ranks, with a value held by a third of the rows."""
    rng = random.Random(9)
    xs = [4.0 if i % 3 == 0 else rng.lognormvariate(1, 2) for i in range(60_000)]
    df = spark.createDataFrame([(i % 40, x) for i, x in enumerate(xs)] + [(50, None)], "part int, x double")
    kept = sketches.quantile_sketches(df, ["part"], "x", k=400)
    assert kept.count() == 40
    xs.sort()
    for r in sketches.percentiles(sketches.merged(kept)).collect():
        low, high = bisect.bisect_left(xs, r.value) / len(xs), bisect.bisect_right(xs, r.value) / len(xs)
        assert r.n == len(xs) and low - 0.01 <= r.percentile / 100 <= high + 0.01
    small = sketches.percentiles(sketches.merged(sketches.quantile_sketches(spark.range(1, 11), [], "id")), [0, 10, 50, 95, 100])
    assert [(r.percentile, r.value) for r in small.collect()] == [(0, 1), (10, 1), (50, 5), (95, 10), (100, 10)]


def test_order_statistics_with_a_value_held_by_a_third_of_the_rows(spark):
    rng = random.Random(3)
    xs = [rng.choice([5.0, rng.uniform(0, 10), rng.uniform(0, 10)]) for _ in range(4001)]
    df = spark.createDataFrame([("m", x) for x in xs] + [("m", None)], "m string, x double")
    qs = {"lo": lower_middle, "hi": upper_middle} | {str(q): nearest(q) for q in (0, 0.01, 0.5, 0.99, 0.999, 1)}
    got = {r.target: r.value for r in order_statistics(df, ["m"], "x", qs).collect()}
    xs.sort()
    assert got["lo"] == got["hi"] == xs[2000]
    for q in (0, 0.01, 0.5, 0.99, 0.999, 1):
        assert got[str(q)] == xs[math.floor(4000 * q + 0.5)]


def test_arithmetic(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "a double, b double")
    a, b, c, d = [r[0] for r in df.select(ieee_div(F.col("a"), F.col("b"))).collect()]
    assert a == math.inf and b == -math.inf and math.isnan(c) and d == 0.25
    ns = [0, 1, 2, 3, 4, 5, 1023, 1024, 1025, 1 << 25]
    got = spark.createDataFrame([(n,) for n in ns], "n bigint").select(next_power_of_two(F.col("n"))).collect()
    assert [r[0] for r in got] == [2 ** (n - 1).bit_length() if n else 2 for n in ns]


def test_language_rules(spark):
    attr = lambda key, text: {"key_strindex": key, "value": {"string": text}}
    t = tables_of(spark, payload(
        {"samples": [{"stack_index": 1, "values": [1, 2, 3]}, {"stack_index": 1, "timestamps": [7, 8]}, {"stack_index": 9}, {"stack_index": 2}]},
        {"strings": ["", "profile.frame.type", "process.executable.build_id.go", "main"],
         "attributes": [{}, attr(1, "native"), attr(1, ""), attr(1, "jvm"), attr(2, "id"), attr(1, "wasm")],
         "mappings": [{}, {"attribute_indices": [4]}], "functions": [{}, {"name_strindex": 3}, {"name_strindex": 77}],
         "locations": [{}, {"attribute_indices": [1], "mapping_index": 1}, {"attribute_indices": [1], "mapping_index": 5},
                       {"attribute_indices": [2, 3]}, {"attribute_indices": [4, 3], "lines": [{"function_index": 2}, {"function_index": 1}]},
                       {"attribute_indices": [5], "lines": [{"function_index": 8}]}],
         "stacks": [{}, {"location_indices": [1, 2, 4, 4]}, {"location_indices": [5, 3, 99, -1]}]}))
    assert {r.location_index: r.language for r in frames.location_language(t).collect()} == {
        0: "unknown", 1: "go", 2: "native", 3: "unknown", 4: "java", 5: "other"}
    assert {r.location_index for r in frames.location_symbolized(t).where("symbolized = 1").collect()} == {4}
    assert {r.language: r.frames for r in frames.frames_by_language(t).collect()} == {
        "go": 5, "native": 5, "java": 10, "other": 1, "unknown": 3}


def test_values_and_host(spark):
    kv = lambda k, **v: {"key": k, "value": v}
    nested = {"array": {"values": [{"string": "ab"}, {"bytes": b"xyz"}, {"string_ref": 1}, {"int": 4}]}}
    res = lambda *attrs: {"resource": {"attributes": list(attrs)}, "scope_profiles": []}
    one = {"resource_profiles": [
        res(kv("host.name", string=""), kv("d", double=2.5), kv("n", **nested)), res(kv("host.name", string="B"))],
        "dictionary": dictionary(strings=["", "four"])}
    two = {"resource_profiles": [res(kv("host.name", string="A"))], "dictionary": dictionary()}
    t = tables_of(spark, one, two, one, payload())
    assert [r.host_id for r in stats.host_ids(t).orderBy("payload_id").collect()] == [1, 2, 1, 0]
    rows = {(r.rp_idx, r.pos): r for r in lookups.resolved_resource_attributes(t).where("payload_id = 0").collect()}
    assert rows[0, 1].text == "2.5" and rows[0, 2].value_bytes == 2 + 3 + 4 and rows[0, 2].text == ""


def test_empty_payload_statistics(spark):
    row = stats.payload_stats(tables_of(spark, payload())).first().asDict()
    assert list(row) == [n for n, _ in STATS_COLUMNS]
    assert row["samples_count"] == 0 and row["mean_values_per_sample"] is None and row["go_fraction"] is None
    assert row["start_ts"] is None and row["unknown_frame_type_symbol_fraction"] == 0.0


def process_payload(unit=None, original=None):
    attr = lambda k, s, **x: {"key_strindex": k, "value": {"string": s}} | x
    attributes = [{}, attr(1, "31", **({"unit_strindex": 4} if unit else {})), attr(2, "indexer"), attr(3, "t-7"), attr(1, "64"), attr(2, "crawler"), attr(3, "t-2")]
    profile = {"samples": [{"values": [i], "attribute_indices": a} for i, a in enumerate(([1, 2, 3], [4, 5, 6], [2, 1], []))]}
    if original:
        profile["original_payload"] = b"raw"
    return {
        "resource_profiles": [{"resource": {"attributes": [{"key": "service.name", "value": {"string": "search"}}]},
                               "scope_profiles": [{"profiles": []}, {"scope": {"name": "sc"}, "profiles": [{}, profile]}]}],
        "dictionary": dictionary(strings=["", "process.pid", "process.executable.name", "thread.id", "u"], attributes=attributes)}


def test_split_by_process(spark):
    t = tables_of(spark, process_payload())
    s = transforms.split_by_process(t)
    texts = {r.rp_idx: r.resource_text for r in lookups.canonical_resources(s).collect()}
    assert texts == {
        0: 'process.executable.name="indexer", process.pid="31", service.name="search"',
        1: 'process.executable.name="crawler", process.pid="64", service.name="search"', 2: 'service.name="search"'}
    got = sorted((r.rp_idx, r.sp_idx, r.p_idx, r.s_idx, list(r["values"]), list(r.attribute_indices)) for r in s.samples.collect())
    assert got == [(0, 1, 1, 0, [0], [3]), (0, 1, 1, 1, [2], []), (1, 1, 1, 0, [1], [6]), (2, 1, 1, 0, [3], [])]
    # The new resources declare two scopes and two profiles each; the unfilled ones take two bytes.
    assert {r.n_scopes for r in s.resource_profiles.collect()} == {2}
    assert {r.n_profiles for r in s.scope_profiles.collect()} == {2}
    keys = lookups.attribute_lists(s, s.samples).select("key").distinct().collect()
    assert {r.key for r in keys} == {"thread.id"}


@pytest.mark.parametrize("kwargs,text", [({"unit": True}, "process attribute that has a unit"), ({"original": True}, "original payload")])
def test_split_refusals(spark, kwargs, text):
    with pytest.raises(Exception, match=text):
        s = transforms.split_by_process(tables_of(spark, process_payload(**kwargs)))
        s.profiles.collect()
        s.resource_attributes.collect()


def test_dictionary_encoding_of_resources(spark):
    res = lambda *attrs: {"resource": {"attributes": list(attrs)}, "scope_profiles": []}
    kv = lambda k, **v: {"key": k, "value": v}
    t = tables_of(spark, {
        "resource_profiles": [res(kv("service.name", string="x"), kv("port", int=8080), {"key_ref": 1, "value": {"string": "kept"}}),
                              res(kv("service.name", string="known"), kv("ok", bool=True))],
        "dictionary": dictionary(strings=["", "known", "known"])})
    d = transforms.resource_attr_dict(t)
    strings = {r.idx: r.value for r in d.dict_strings.collect()}
    assert [strings[i] for i in range(len(strings))] == ["", "known", "known", "x", "service.name", "port", "ok"]
    assert d.payloads.first().n_strings == 7
    rows = {(r.rp_idx, r.pos): r for r in lookups.resolved_resource_attributes(d).collect()}
    assert rows[0, 0].ref_key == "service.name" and rows[0, 0].text == "x" and rows[0, 0].key == ""
    assert rows[1, 0].value["s_ref"] == 1 and rows[0, 1].value["i"] == 8080 and rows[0, 2].value["s"] == "kept"


def test_shared_sizes_are_those_of_each_variant(spark, view):
    """On the view, and on payloads without a dictionary, strings, resources or samples."""
    kv = lambda k, v: {"key": k, "value": {"string": v}}
    sample = lambda *attrs: {"attribute_indices": list(attrs), "values": [1]}
    long = "n" * 300
    odd = tables_of(
        spark, {}, {"dictionary": {}}, {"resource_profiles": [{}]},
        {"resource_profiles": [{"resource": {"attributes": [kv("a", long), kv("b", "x")]}, "schema_url": "s", "scope_profiles": [
            {"profiles": [{"samples": [sample(1, 2), sample(2), sample()]}, {}]}, {"scope": {"name": "sc"}}]}],
         "dictionary": dictionary(strings=["", "process.pid", "x", "thread"], attributes=[
             {}, {"key_strindex": 1, "value": {"int": 7}}, {"key_strindex": 3, "value": {"string": "t"}}])})
    for t in (view, odd):
        for factor in (1, 3):
            variants = encodings.encoding_variants(t, factor)
            for name, got in encodings.shared_sizes(variants).items():
                want = {r.payload_id: r.uncompressed_bytes for r in sizes.payload_bytes(variants[name]).collect()}
                assert {r.payload_id: r.uncompressed_bytes for r in got.collect()} == want, name


def test_transform_invariants(view):
    scaled = transforms.scale_samples(view, 3)
    assert scaled.samples.count() == 3 * view.samples.count()
    assert transforms.scale_samples(view, 1) is view
    weight = lambda t: t.samples.agg(F.sum(lookups.observation_weight())).first()[0]
    split = transforms.split_by_process(view)
    assert split.samples.count() == view.samples.count() and weight(split) == weight(view)
    total = lambda t: sizes.payload_bytes(t).agg(F.sum("uncompressed_bytes")).first()[0]
    base, grown, reduced = total(view), total(split), total(transforms.resource_attr_dict(split))
    assert base < reduced < grown


def test_summary_order_and_gain(spark):
    """Two payloads a file: sums per file and encoding, in the fixed order of the encodings."""
    rows = [(f, e, size + k) for f in ("x", "w") for k in (0, 10) for e, size in zip(encodings.ENCODINGS, (100, 200, 150))]
    summary = encodings.encoding_summary(spark.createDataFrame(rows, "file string, encoding string, uncompressed_bytes bigint"))
    got = [tuple(r) for r in encodings.in_file_order(summary).collect()]
    assert got == [(f, e, 2, 2 * size + 10) for f in ("w", "x") for e, size in zip(encodings.ENCODINGS, (100, 200, 150))]
    assert [round(r.uncompressed_gain_pct, 6) for r in encodings.encoding_gain(summary).collect()] == [round(100 * (1 - 310 / 410), 6)] * 2


def test_times_beyond_the_signed_range(spark):
    late = (1 << 63) + 5
    t = tables_of(spark, payload({"time_unix_nano": 7, "duration_nano": (1 << 64) - 1}), payload({"time_unix_nano": late}))
    spans = {r.payload_id: (r.start_ts, r.end_ts) for r in stats.payload_time_span(t).collect()}
    last = (1 << 63) - 1
    assert spans == {0: (7, last), 1: (last, last)}
    assert {r.payload_id for r in listing.listing(t).where("line LIKE '%Profile:%'").collect()} == {0, 1}


def stats_rows(spark, rows):
    base = {n: None for n, _ in STATS_COLUMNS}
    return spark.createDataFrame([base | r for r in rows], ",".join(f"{n} {k}" for n, k in STATS_COLUMNS))


def test_study(spark):
    rng = random.Random(5)
    rows = [{
        "id": i, "host_id": i % 7, "uncompressed_bytes": rng.randrange(1 << 20, 1 << 23), "samples_count": rng.randrange(100, 9000),
        "duration_sec": None if i % 10 == 0 else 60.0, "resource_profiles_count": 2, "resource_profiles_attrs_count": rng.randrange(4, 30),
        "dict_stacks_count": rng.randrange(50, 900), "sampled_stack_frames_count": 1000, "go_fraction": None if i % 4 == 0 else 0.25,
        "java_fraction": 0.25 if i % 4 else None, "go_symbol_fraction": 0.5,
    } for i in range(1, 200)]
    derived = study.upscale(study.derive_metrics(stats_rows(spark, rows))).cache()
    languages = {r.id: r.primary_language for r in derived.select("id", "primary_language").collect()}
    assert languages[1] == "go" and languages[4] == "go"

    xs = sorted(r["uncompressed_bytes"] / 2**20 for r in rows)
    s = study.summary(derived, "uncompressed_mib").first()
    assert s.median == xs[99] and s.q99 == xs[round(198 * 0.99)] and s.max == xs[-1]

    # The fit keeps rows without a CPU value in the mean and spread of x.
    pts = [(r["uncompressed_bytes"] / 2**20, r["samples_count"] / 20 / r["duration_sec"] if r["duration_sec"] else None) for r in rows]
    mx = sum(x for x, _ in pts) / len(pts)
    ys = [y for _, y in pts if y is not None]
    my = sum(ys) / len(ys)
    slope = sum((x - mx) * (y - my) for x, y in pts if y is not None) / sum((x - mx) ** 2 for x, _ in pts)
    fit = study.line_fit(derived).first()
    assert fit.slope == pytest.approx(slope) and fit.intercept == pytest.approx(my - slope * mx)
    assert fit.label == f"one core adds {1 / slope:.2f} MiB"

    ranking = [r["column"] for r in study.correlation_ranking(derived).collect()]
    assert "resource_profiles_count" not in ranking and "samples_count" in ranking and "mean_bytes_per_sample" not in ranking
    share = {r.language: r.stack_frame_percentage for r in study.language_share(derived).collect()}
    assert share["go"] == pytest.approx(50) and share["perl"] == 0 and len(share) == 13
    symbolized = study.symbolized_share(derived).collect()
    assert {r.language: r.symbolized_stack_frame_percentage for r in symbolized} == {"go": pytest.approx(50), "java": 0}
    limit = study.size_limit(derived).first()
    assert limit.recommended_limit == 2 ** (int(limit.size_limit) - 1).bit_length()
    assert 0 <= study.over_limit_share(derived).first().over_limit_share <= 0.02


def test_histogram_steps(spark):
    assert study.nice_step(0, 100, 40) == 5 and study.nice_step(0, 1, 50) == pytest.approx(0.02) and study.nice_step(3, 3, 40) > 0
    df = spark.createDataFrame([(float(x),) for x in range(101)], "uncompressed_mib double")
    bins = study.histogram(df, "uncompressed_mib").orderBy("bin_start").collect()
    assert len(bins) == 21 and bins[0].n == 5 and bins[-1].n == 1 and sum(b.n for b in bins) == 101


def test_context_rules(spark):
    good = [(k, "v") for k in context.REQUIRED_KEYS]
    snap = lambda pid, attrs, extra=(), sig=context.SIGNATURE, version=2, at=5: ("h", pid, sig, version, at, attrs, list(extra))
    df = spark.createDataFrame([
        snap(1, good), snap(2, good[1:]), snap(3, good + [good[0]]), snap(4, good + [("k" * 4097, "v")]), snap(5, good, sig="x"),
        snap(6, good, version=1), snap(7, good + [(f"k{i}", "v") for i in range(101)]), snap(8, good, [(context.KEY_MAP_KEY, "a")]),
        snap(9, good + [(f"k{i}", "v" * 4096) for i in range(4)]), snap(1, good[:2], at=9), snap(1, good, at=0),
    ], context.SNAPSHOT)
    got = {(r.pid, r.rule) for r in context.context_findings(df.where("published_at_ns = 5")).collect()}
    assert got == {
        (2, "missing_key"), (3, "repeated_key"), (4, "key_length"), (5, "signature"), (6, "version"), (7, "resource_pairs"),
        (8, "key_map"), (9, "resource_size")}
    newest = {r.pid: r.published_at_ns for r in context.current_context(df).collect()}
    assert newest[1] == 9 and len(newest) == 9


def test_encoded_pair_sizes(spark):
    from emberframe.sources import codec

    pairs = [("a", "b"), ("key", "v" * 200), ("k" * 130, "")]
    df = spark.createDataFrame([("h", 1, "s", 2, 1, pairs, [])], context.SNAPSHOT)
    message = codec.message_classes()["KeyValueList"]()
    for k, v in pairs:
        message.values.add(key=k).value.string = v
    assert df.select(context.encoded_pairs_bytes("attributes")).first()[0] == message.ByteSize()


def test_histogram_of_values_that_are_not_finite(spark):
    metric = next(iter(study.MAX_BINS))
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("nan"),), (None,)], f"{metric} double")
    rows = {r.bin_start: r.n for r in study.histogram(df, metric).collect()}
    assert rows[None] == 2 and sum(rows.values()) == 4
