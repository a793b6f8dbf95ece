"""Registered queries against their SQL equivalents on the smallest tables, and streaming."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from emberframe.operators import conformance, stats
from emberframe.session import new_path
from emberframe.sources import encoder, payloads
from emberframe.streaming.ingest import ingest
from payload_builder import dictionary, message

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = (
    "frames_by_language", "symbol_fractions", "anyvalue_bytes", "anyvalue_nested", "listing_samples", "payload_stats", "check_all", "check_all_rules", "split_samples",
    "resource_attr_dict", "encoding_summary", "summary_upscaled_mib", "percentile_table", "histogram_uncompressed_mib",
    "correlation_ranking", "cpu_vs_size_fit", "src_decode", "src_framed", "src_payload_ids", "sink_stats_csv", "context_findings", "resource_context",
    "stream_buffer_windows", "buffer_size_curve", "amortization_curve", "stream_ingest", "sink_encoding_summary", "sketch_percentiles",
)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return repr([None if isinstance(x, float) and math.isnan(x) else x for x in row])


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    sql_types = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    assert {c: sql_types[k] for c, k in df.dtypes} == {
        r[0]: r[1] for r in duck.execute("DESCRIBE " + entry.oracle_sql()[name]).fetchall()}
    result = duck.execute(entry.oracle_sql()[name])
    expected = sorted(_key([r[names.index(c)] for c in columns]) for r in result.fetchall())
    assert sorted(_key([r[c] for c in columns]) for r in df.collect()) == expected


def test_every_query_has_sql_or_is_known_not_to():
    assert set(entry.QUERIES) - set(entry.ORACLES) == {"encoding_gzip"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["payload_id", "language", "frames"]
    assert df.count() == 80 and df.agg({"frames": "sum"}).first()[0] == 30_051


def test_every_rule_has_findings(spark, sf_dir):
    rules = {r.rule for r in entry.queries()["check_all_rules"](spark, sf_dir).select("rule").distinct().collect()}
    assert rules == {f"R{i}" for i in range(1, 39)}


def test_samples_are_read_three_times(spark, view):
    """Once for what they refer to, once per profile, and once for the findings."""
    counter = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    rows = view.samples.count()
    t = view.with_tables(samples=view.samples.mapInArrow(counted, view.samples.schema))
    found = conformance.check_all(t)
    found.write.format("noop").mode("overwrite").save()
    assert counter.value <= 3 * rows


def test_ingest_numbers_go_on(spark):
    """Two batches: a host keeps its id, a new one gets the next, and a repeated batch changes nothing."""
    named = lambda host: message({"dictionary": dictionary(), "resource_profiles": [{
        "resource": {"attributes": [{"key": "host.name", "value": {"string": host}}]}, "scope_profiles": [{"profiles": [{}]}]}]})
    path, out, checkpoint = (new_path(spark, n) for n in ("in", "out", "checkpoint"))
    Path(path).mkdir(parents=True)
    seen = {}
    for batch in ({"b": "north", "a": "south"}, {"d": "south", "c": "west", "e": ""}):
        for name, host in batch.items():
            Path(path, name).write_bytes(named(host))
        ingest(spark, path, out, checkpoint).awaitTermination()
        rows = spark.read.parquet(f"{out}/stats").select("file", "id", "host_id").collect()
        seen = {r.file.rsplit("/", 1)[1]: (r.id, r.host_id) for r in rows}
    assert seen == {"a": (1, 1), "b": (2, 2), "c": (3, 3), "d": (4, 1), "e": (5, 0)}
    assert {(r.host, r.host_id, r.batch) for r in spark.read.parquet(f"{out}/hosts").collect()} == {
        ("south", 1, 0), ("north", 2, 0), ("west", 3, 1)}


def test_stream_ingest(spark, view):
    path, out, checkpoint = (new_path(spark, n) for n in ("in", "out", "checkpoint"))
    payloads.write_payload_files(encoder.encode(view), path).count()
    for _ in range(2):  # the second run finds no new files
        ingest(spark, path, out, checkpoint).awaitTermination()
    got = spark.read.parquet(f"{out}/stats")
    assert got.count() == 10
    want = stats.payload_stats(view)
    assert got.agg({"samples_count": "sum"}).first()[0] == want.agg({"samples_count": "sum"}).first()[0]
    assert spark.read.parquet(f"{out}/findings").where("rule = 'R11'").count() == 134
    assert spark.read.parquet(f"{out}/errors").count() == 0
