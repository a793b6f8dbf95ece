"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators import conformance, context, encodings, frames, lookups, nested_values, sizes, sketches, stats, study, transforms
from emberframe.schema import FRACTION_COLUMNS, SAMPLE_ID, STATS_COLUMNS, SYMBOL_FRACTION_COLUMNS
from emberframe.session import configure, long_batches, new_path, stash
from emberframe.sources import listing as listings
from emberframe.sources import payloads, stats_csv
from emberframe.sources.encoder import encode
from emberframe.sources.faults import with_faults
from emberframe.sources.snapshots import event_snapshots
from emberframe.sources.view import profile_view
from emberframe.streaming import windows
from emberframe.streaming.ingest import ingest
from emberframe.tables import ProfileTables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_derived: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, what: str, build: Callable[[], object]):
    """Derived tables shared by several queries are written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _derived:
        _derived[key] = build()
    return _derived[key]


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def on_view(name: str, operator: Callable[[ProfileTables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(profile_view(spark, sf_dir))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def joined(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# --- look-ups and frames ---------------------------------------------------------

on_view("frames_by_language", frames.frames_by_language)
on_view("language_fractions", lambda t: rounded(frames.language_fractions(t), 9, *FRACTION_COLUMNS))
on_view("location_language", frames.location_language)
on_view("location_symbolized", frames.location_symbolized)
on_view("symbol_fractions", lambda t: rounded(frames.symbol_fractions(t), 9, *SYMBOL_FRACTION_COLUMNS))
on_view("deref_function_names", lookups.deref_function_names)
on_view("sample_weights", lookups.sample_weights)
on_view("sample_shapes", lookups.sample_shapes)
on_view("canonical_sample_attrs", lookups.canonical_sample_attrs)
on_view("listing_samples", listings.listing)
on_view("anyvalue_text", lookups.anyvalue_text)
on_view("anyvalue_bytes", lookups.anyvalue_bytes)


@query("anyvalue_nested")
def _anyvalue_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested values: a list of lines, each a list of pairs; entries, levels and text bytes of each."""
    configure(spark)
    pair = lambda key, value: F.concat(F.lit(f'["{key}",0,'), value, F.lit("]"))
    flat = lambda kind, c: F.to_json(F.create_map(F.lit(kind), c))
    line = F.concat(F.lit('{"kvlist":['), F.concat_ws(
        ",", pair("flag", flat("string", F.col("l_returnflag"))), pair("status", flat("bytes", F.base64(F.encode("l_linestatus", "UTF-8")))),
        pair("part", flat("int", F.col("l_partkey")))), F.lit("]}"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    value = F.concat(F.lit('{"kvlist":['), pair("lines", F.concat(F.lit('{"array":['), F.concat_ws(",", "lines"), F.lit("]}"))), F.lit("]}"))
    entries = nested_values.nested_entries(lines.select("l_orderkey", value.alias("nested_json")), ["l_orderkey"])
    return nested_values.nested_bytes(entries, ["l_orderkey"])


# --- statistics ------------------------------------------------------------------

on_view("host_ids", stats.host_ids)
on_view("payload_tree_counts", stats.payload_tree_counts)
on_view("payload_dict_counts", stats.payload_dict_counts)
on_view("payload_string_bytes", stats.payload_string_bytes)
on_view("message_bytes", sizes.message_bytes)
on_view("payload_time_span", stats.payload_time_span)

_STATS_DOUBLES = [n for n, kind in STATS_COLUMNS if kind == "double"]


def view_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "stats", lambda: stash(stats.payload_stats(profile_view(spark, sf_dir)), "stats"))


@query("payload_stats")
def _payload_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.payload_stats(profile_view(spark, sf_dir)), 9, *_STATS_DOUBLES)


# --- conformance -----------------------------------------------------------------

for _name in (
    "check_stack_index", "check_timestamps", "check_duplicate_keys", "check_duplicate_strings",
    "check_duplicate_mappings", "check_sample_shapes", "check_dictionary_indexes", "check_orphans", "check_all",
):
    on_view(_name, getattr(conformance, _name))


@query("check_all_rules")
def _check_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checker over payloads that break every rule."""
    broken = once(spark, sf_dir, "faults", lambda: with_faults(profile_view(spark, sf_dir)).stored("faults"))
    return conformance.check_all(broken)


# --- transforms and sizes ----------------------------------------------------------


def split_view(spark: SparkSession, sf_dir: str) -> ProfileTables:
    return once(spark, sf_dir, "split", lambda: transforms.split_by_process(profile_view(spark, sf_dir)))


def variants(spark: SparkSession, sf_dir: str) -> dict[str, ProfileTables]:
    split = split_view(spark, sf_dir)
    dictified = once(spark, sf_dir, "dictified", lambda: transforms.resource_attr_dict(split))
    return dict(zip(encodings.ENCODINGS, (profile_view(spark, sf_dir), split, dictified)))


def _sample_rows(t: ProfileTables) -> DataFrame:
    return t.samples.select(*SAMPLE_ID, "stack_index", joined("attribute_indices").alias("attributes"))


on_view("scale_samples", lambda t: _sample_rows(transforms.scale_samples(t, 3)))


@query("split_by_process")
def _split_by_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = split_view(spark, sf_dir)
    per_resource = t.samples.groupBy("payload_id", "rp_idx").agg(
        F.count("*").alias("samples"), F.sum(lookups.observation_weight()).alias("weight"))
    return (
        t.resource_profiles.select("payload_id", "rp_idx", "n_scopes")
        .join(lookups.canonical_resources(t), ["payload_id", "rp_idx"]).join(per_resource, ["payload_id", "rp_idx"])
    )


@query("split_samples")
def _split_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample_rows(split_view(spark, sf_dir))


on_view("intern_resource_strings", transforms.intern_resource_strings)


@query("resource_attr_dict")
def _resource_attr_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = variants(spark, sf_dir)["resource-attr-dict"]
    value = F.col("value")
    return t.resource_attributes.select(
        "payload_id", "rp_idx", "pos", "key", "key_ref", value["kind"].alias("kind"), value["s_ref"].alias("s_ref"))


def _encoding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.encoding_summary(encodings.encoding_sizes(variants(spark, sf_dir)))


QUERIES["encoding_summary"] = _encoding_summary


@query("encoding_gain")
def _encoding_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(encodings.encoding_gain(_encoding_summary(spark, sf_dir)), 6, "uncompressed_gain_pct")


@query("encoding_gzip")
def _encoding_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = variants(spark, sf_dir)
    return encodings.encoding_summary(encodings.with_files(encoded, payloads.measured_variants(encoded)))


# --- size study ----------------------------------------------------------------------

_DIGITS = {
    "uncompressed_mib": 9, "mean_bytes_per_sample": 6, "mean_cpu_usage_cores": 15, "mean_attrs_per_resource": 9,
    "mean_samples_per_stack": 9, "upscaled_bytes": 3, "upscaled_mib": 6,
}


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.upscale(study.derive_metrics(view_stats(spark, sf_dir)))


@query("derived_metrics")
def _derived_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["uncompressed_mib", "mean_bytes_per_sample", "mean_cpu_usage_cores", "mean_attrs_per_resource", "mean_samples_per_stack"]
    return derived(spark, sf_dir).select("id", *[F.round(n, _DIGITS[n]).alias(n) for n in names])


@query("primary_language")
def _primary_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).select("id", "primary_language")


@query("upscaled_sizes")
def _upscaled_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).select(
        "id", F.round("upscaled_bytes", 3).alias("upscaled_bytes"), F.round("upscaled_mib", 6).alias("upscaled_mib"))


def _add_metric_queries(metric: str) -> None:
    QUERIES[f"summary_{metric}"] = lambda spark, sf_dir: rounded(
        study.summary(derived(spark, sf_dir), metric), 6, "median", "mean", "q99", "q99_9", "max")
    QUERIES[f"histogram_{metric}"] = lambda spark, sf_dir: rounded(
        study.histogram(derived(spark, sf_dir), metric), 6, "bin_start", "bin_end")
    unit = "MiB" if metric.endswith("_mib") else ""
    QUERIES[f"reference_lines_{metric}"] = lambda spark, sf_dir: rounded(
        study.reference_lines(derived(spark, sf_dir), metric, unit), 6, "value")


for _metric in study.METRICS:
    _add_metric_queries(_metric)


@query("percentile_table")
def _percentile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.percentile_table(derived(spark, sf_dir)), 6, "upscaled_mib")


@query("sketch_percentiles")
def _sketch_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from one kept sketch per host, merged."""
    rows = derived(spark, sf_dir)
    kept = once(spark, sf_dir, "size-sketches", lambda: stash(
        sketches.quantile_sketches(rows, ["host_id"], "upscaled_mib"), "size-sketches"))
    return rounded(sketches.percentiles(sketches.merged(kept)), 6, "value")


@query("recommended_limit")
def _recommended_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.size_limit(derived(spark, sf_dir)), 3, "size_limit")


@query("over_limit_share")
def _over_limit_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.over_limit_share(derived(spark, sf_dir)), 9, "over_limit_share")


@query("cpu_vs_size_fit")
def _cpu_vs_size_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        study.line_fit(derived(spark, sf_dir)).drop("label"), 12, "slope", "intercept", "x_min", "x_max", "y_at_min", "y_at_max")


@query("cpu_vs_size_line")
def _cpu_vs_size_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.fit_line_points(derived(spark, sf_dir)), 12, "uncompressed_mib", "mean_cpu_usage_cores")


@query("correlation_ranking")
def _correlation_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = study.derive_metrics(view_stats(spark, sf_dir))
    return rounded(study.correlation_ranking(metrics), 6, "pearson_correlation", "absolute_correlation")


@query("language_share")
def _language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.language_share(view_stats(spark, sf_dir)), 6, "stack_frame_count", "stack_frame_percentage")


@query("symbolized_share")
def _symbolized_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        study.symbolized_share(view_stats(spark, sf_dir)), 6, "stack_frame_count", "symbolized_stack_frame_count",
        "symbolized_stack_frame_percentage")


@query("dataset_profile")
def _dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(study.dataset_profile(derived(spark, sf_dir)), 9, "p99_uncompressed_mib"), 15, "max_cpu_usage_cores")


@query("scatter_points")
def _scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = study.scatter(derived(spark, sf_dir))
    return points.withColumns({c: F.round(c, _DIGITS[c]) for c in points.columns if c in _DIGITS})


def _elapsed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours since the first event that saw an event: the time axis of the amortization model."""
    configure(spark)
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(seconds.alias("s"))
    first = events.agg(F.min("s")).first()[0]
    return events.select(F.floor((F.col("s") - F.lit(first)) / 3600).alias("time")).distinct()


@query("amortization_curve")
def _amortization_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = study.amortization_curve(_elapsed_hours(spark, sf_dir))
    return rounded(curve, 9, *[c for c in curve.columns if c.endswith(("size", "rate"))])


@query("amortization_long")
def _amortization_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.amortization_long(study.amortization_curve(_elapsed_hours(spark, sf_dir))), 9, "component_size")


@query("amortization_rates")
def _amortization_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        study.amortization_rates_long(study.amortization_curve(_elapsed_hours(spark, sf_dir))), 9, "component_data_rate")


# --- sources and sinks ---------------------------------------------------------------


def _view_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        messages = encode(profile_view(spark, sf_dir))
        with long_batches(spark):
            return stash(messages, "messages")

    return once(spark, sf_dir, "messages", build)


def payload_folder(spark: SparkSession, sf_dir: str) -> str:
    """Folder with one encoded file per payload of the view."""

    def build() -> str:
        path = new_path(spark, "payload-files")
        payloads.write_payload_files(_view_messages(spark, sf_dir), path).write.format("noop").mode("overwrite").save()
        return path

    return once(spark, sf_dir, "files", build)


def framed_folder(spark: SparkSession, sf_dir: str) -> str:
    """Folder of length-prefixed files with up to four payloads each."""

    def build() -> str:
        path = new_path(spark, "framed-files")
        group = lambda c: F.lpad(F.floor(F.col(c) / 4).cast("string"), 9, "0")
        messages = _view_messages(spark, sf_dir).withColumn(
            "file_no", group("payload_id"))
        payloads.write_payload_files(messages, path, framed=True).write.format("noop").mode("overwrite").save()
        return path

    return once(spark, sf_dir, "framed", build)


def _file_name(c: str) -> Column:
    return F.element_at(F.split(c, "/"), -1)


#: Payloads that arrive first: some hosts are only theirs, one is in both parts, the others are new later.
ARRIVES_FIRST = "payload_id % 7 IN (1, 3) OR payload_id % 14 = 0"


@query("stream_ingest")
def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive in two parts, with a restart in between: numbers, hosts and findings of all."""

    def build() -> str:
        path, out, checkpoint = (new_path(spark, n) for n in ("arriving", "ingested", "ingest-checkpoint"))
        for part in (ARRIVES_FIRST, f"NOT ({ARRIVES_FIRST})"):
            messages = _view_messages(spark, sf_dir).where(part)
            payloads.write_payload_files(messages, path).write.format("noop").mode("overwrite").save()
            ingest(spark, path, out, checkpoint).awaitTermination()
        return out

    out = once(spark, sf_dir, "ingested", build)
    findings = spark.read.parquet(f"{out}/findings").groupBy("id").agg(
        F.count("*").alias("findings"), F.count_distinct("rule").alias("rules"))
    rows = spark.read.parquet(f"{out}/stats").select("id", _file_name("file").alias("file"), "host_id", "samples_count", "dict_strings_count")
    return rows.join(findings, "id", "left").fillna(0, ["findings", "rules"])


@query("src_payload_ids")
def _src_payload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.list_payloads(spark, payload_folder(spark, sf_dir)).select(
        F.col("id").cast("bigint").alias("id"), _file_name("path").alias("file"), "length")


@query("src_decode")
def _src_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = once(spark, sf_dir, "decoded", lambda: payloads.read_payloads(spark, payload_folder(spark, sf_dir)))
    counts = stats.payload_tree_counts(t).join(t.payloads.select("payload_id", "path", "n_bytes"), "payload_id")
    return counts.withColumn("file", _file_name("path")).drop("payload_id", "path")


@query("src_framed")
def _src_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames_read = once(spark, sf_dir, "decoded-frames", lambda: payloads.read_nested(spark, framed_folder(spark, sf_dir)))
    return frames_read.select(
        _file_name("path").alias("file"), "frame_no", "n_bytes",
        F.size("resource_profiles").alias("resources"), F.coalesce("error", F.lit("")).alias("error"))


def _stats_csv_file(spark: SparkSession, sf_dir: str) -> str:
    def build() -> str:
        path = f"{new_path(spark, 'stats-csv')}/stats.csv"
        stats_csv.write_stats_file(view_stats(spark, sf_dir), path)
        return path

    return once(spark, sf_dir, "stats-csv", build)


@query("sink_stats_csv")
def _sink_stats_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as written: every column as text, empty cells as ''."""
    text = spark.read.csv(_stats_csv_file(spark, sf_dir), header=True, schema=",".join(f"{n} string" for n, _ in STATS_COLUMNS))
    return text.na.fill("")


@query("src_stats_csv")
def _src_stats_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats_csv.read_stats_csv(spark, _stats_csv_file(spark, sf_dir)), 9, *_STATS_DOUBLES)


@query("sink_encoding_summary")
def _sink_encoding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the written file, in its order."""

    def build() -> str:
        path = f"{new_path(spark, 'encoding-summary')}/summary.csv"
        encodings.write_summary(_encoding_summary(spark, sf_dir), path)
        return path

    whole = spark.read.text(once(spark, sf_dir, "encoding-summary", build), wholetext=True)
    lines = F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n"))
    return whole.select(lines.alias("line_no", "line"))


# --- process contexts and windows -----------------------------------------------------


@query("context_findings")
def _context_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.context_findings(event_snapshots(spark, sf_dir))


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.filter("attributes", lambda x: x["key"] == "service.name")[0]["value"]
    return context.current_context(event_snapshots(spark, sf_dir)).select(
        "host", "pid", "published_at_ns", "signature", "version", name.alias("service_name"))


QUERIES["current_context"] = _current


@query("resource_context")
def _resource_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    attached = context.attach_context(split_view(spark, sf_dir), _current(spark, sf_dir))
    return attached.select("payload_id", "rp_idx", "host", "pid", "service_name", "published_at_ns")


def _event_samples(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("host"), F.col("event_type").alias("stack"))


@query("buffer_windows")
def _buffer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return windows.buffer_windows(_event_samples(spark.read.parquet(f"{sf_dir}/events.parquet")), "1 hour")


@query("buffer_size_curve")
def _buffer_size_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    curve = windows.buffer_curve(_event_samples(spark.read.parquet(f"{sf_dir}/events.parquet")), (60, 3600, 86400))
    return rounded(curve, 6, "mean_samples", "mean_stacks", "samples_per_stack")


@query("stream_buffer_windows")
def _stream_buffer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return windows.run_to_completion(
        spark, windows.stream_buffer_windows(_event_samples(stream), "1 hour", "10 minutes"))
