"""How far rows move: estimates of stored tables, numbering by payload, messages put together in one place."""

from dataclasses import fields
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberframe import session
from emberframe.operators import conformance, transforms
from emberframe.session import by_payload, configure, stash
from emberframe.sources import view as views
from emberframe.sources.encoder import encode


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repetitive_tables_are_not_broadcast(spark):
    """300 000 rows of long texts take few megabytes in Parquet; F1 to F8 sent such tables through the driver."""
    configure(spark)
    rows = spark.range(300_000).select(
        F.xxhash64("id").alias("k"), F.repeat(F.concat(F.lit("process.executable.name="), (F.col("id") % 50).cast("string")), F.lit(9)).alias("text"))
    kept = stash(rows, "repetitive")
    joined = kept.join(kept.select("k", F.col("text").alias("other")), "k")
    assert "BroadcastHashJoin" not in _plan(joined) and "SortMergeJoin" in _plan(joined)


def test_large_payloads_are_numbered_alike(spark, sf_dir, view):
    """Payloads over the bound take the way across partitions and give the same tables, all of them or some."""
    sizes = [r["count"] for r in view.samples.groupBy("payload_id").count().collect()]
    for limit in (0, sorted(sizes)[len(sizes) // 2]):
        spread = views.build_profile_view(spark, sf_dir, limit)
        for f in fields(view):
            a, b = getattr(view, f.name), getattr(spread, f.name)
            assert b.dtypes == a.dtypes, f.name
            assert sorted(map(repr, b.collect())) == sorted(map(repr, a.collect())), f.name


def test_text_of_a_message_moves_once(spark, view):
    """Inside ``by_payload`` no level of the tree is moved by its own ids."""
    with by_payload(spark):
        plan = _plan(encode(view))
    moved = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert moved and not [keys for keys in moved if "rp_idx" in keys and "p_idx" in keys.replace("rp_idx", "").replace("sp_idx", "")]


def test_small_payloads_are_split_where_they_lie(view, monkeypatch):
    """Groups and samples of a small payload are numbered without a range sort over all rows."""
    monkeypatch.setattr(transforms, "grouped_ordinal", None)
    assert transforms.split_by_process(view).samples.count() == view.samples.count()


def test_large_payloads_are_split_alike(view):
    """Payloads over the bound take the way across partitions and give the same tables, all of them or some."""
    sizes = [r["count"] for r in view.samples.groupBy("payload_id").count().collect()]
    whole = transforms.split_by_process(view)
    for limit in (0, sorted(sizes)[len(sizes) // 2]):
        spread = transforms.split_by_process(view, limit)
        for f in fields(view):
            a, b = getattr(whole, f.name), getattr(spread, f.name)
            assert b.dtypes == a.dtypes, f.name
            assert sorted(map(repr, b.collect())) == sorted(map(repr, a.collect())), f.name


def test_checked_samples_move_without_their_values(spark, view):
    """Samples meet bad lists by their ids alone, and no join of the checker moves their values."""
    bad = stash(conformance.bad_attribute_lists(view), "bad")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = _plan(conformance.sample_findings(view, bad_lists=bad)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [(line, below) for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning(" in line]
    by_list = [below for line, below in moved if "attribute_indices" in line]
    assert by_list and not [x for x in by_list if "timestamps" in x]
    assert not [x for _, x in moved if ", values#" in x]


@pytest.mark.parametrize("given, kept", [("10485760b", 2 << 20), ("10MB", 2 << 20), ("256k", 256 << 10), ("-1", -1)])
def test_broadcasts_have_a_bound(spark, given, kept):
    """dozens of relations of up to 29 MB met in the driver; a lower threshold stays as the user set it."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, given)
    try:
        configure(spark)
        assert session._as_bytes(spark.conf.get(name)) == kept
    finally:
        spark.conf.set(name, before)


def test_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    """Samples and stacks are dealt out by their number, however few shuffle partitions are set; F12 to F27 read them."""
    rows = [(i, i % 400, i % 50, 1, 1 + i % 7, 100.0 + i, 0.05, 0.02, "A", "F", datetime(1996, 1, 1 + i % 28)) for i in range(4000)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_quantity long, l_linenumber int, l_extendedprice double,"
                          " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(i, "red ring", f"Brand#{i % 5}", "SMALL") for i in range(50)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    built = views.build_profile_view(spark, str(tmp_path))
    assert built.samples.count() == 4000
    assert len(built.samples.inputFiles()) > 20


def test_frames_are_looked_up_once(spark):
    """Names are searched after the join with the stacks, not in it too; F22 waited for both. A stack without a name has no list."""
    stacks = spark.createDataFrame(
        [(1, 1, "red ring", "SMALL"), (1, 2, None, "SMALL"), (1, 3, "ring red", None), (2, 1, "red", "SMALL")],
        "payload_id long, stack_index int, p_name string, p_type string")
    locations = spark.createDataFrame(
        [(1, "SMALL", 1), (1, "red", 2), (1, "ring", 3), (1, None, 4), (2, "SMALL", 1), (2, "red", 2)],
        "payload_id long, fn string, location_index int")
    found = views._dict_stacks(stacks, locations, spark.createDataFrame([], "payload_id long"))
    assert sorted((r["payload_id"], r["idx"], r["location_indices"]) for r in found.collect()) == [
        (1, 0, []), (1, 1, [2, 3, 1]), (1, 3, [3, 2]), (2, 0, []), (2, 1, [2, 1])]
    assert not [line for line in _plan(found).splitlines() if "Join" in line and "array_position" in line]


def test_small_payloads_samples_move_once(spark, view, monkeypatch):
    """samples moved with their lists, for the groups, and with their values; lists were opened and put together again."""
    written = {}
    monkeypatch.setattr(transforms, "stash", lambda df, label: written.setdefault(label, _plan(df)) and stash(df, label))
    monkeypatch.setattr(transforms, "process_lists", None)
    with by_payload(spark):
        groups, slots, samples = transforms._regrouped_in_place(view)
    assert samples.count() == view.samples.count()
    lines = written["split-samples"].splitlines()
    read = [line for line in lines if "FileScan" in line and "link_index" in line]
    assert len(read) == 1 and "attribute_indices" in read[0] and not [line for line in lines if "Generate" in line]
    assert len([line for line in lines if "Exchange hashpartitioning(" in line]) <= 3
    key = ["payload_id", "new_rp", "sp_idx", "p_idx"]
    renamed = samples.withColumnRenamed("rp_idx", "new_rp")
    assert slots.count() == slots.select(*key).distinct().count() == renamed.select(*key).distinct().count()
    assert groups.count() == groups.select("payload_id", "new_rp").distinct().count()


def test_resource_strings_are_grouped_without_a_sort(spark, view):
    """the first place of a string was a struct, for which Spark sorts all attributes of all resources."""
    strings = transforms.new_resource_strings(view)
    assert "SortAggregate" not in _plan(strings) and "HashAggregate" in _plan(strings)
    attributes = spark.createDataFrame(
        [(1, 70_000, 0, "b", 0, "x"), (1, 3, 9, "k", 0, "x"), (1, 3, 10, "x", 0, "b"), (1, 0, 0, "k", 4, "b")],
        "payload_id long, rp_idx int, pos int, key string, key_ref int, s string")
    t = view.with_tables(resource_attributes=attributes.selectExpr(
        "payload_id", "rp_idx", "pos", "key", "key_ref", "named_struct('kind', 'string', 's', s) AS value"))
    assert [r.value for r in transforms.new_resource_strings(t).orderBy("at").collect()] == ["x", "k", "b"]
