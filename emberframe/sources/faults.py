"""Payloads with broken parts: every rule of the checker has something to find in them.

The faults are put into given payloads, by id, so that their number grows with the
input.  Entries are appended behind those that are there, and zero entries
are changed, so that what was found before is still found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.values import make_value, no_value
from emberframe.tables import ProfileTables

#: Payloads that get broken entries, those whose zero entries change, and those beside which an empty payload stands.
BROKEN, CHANGED, EMPTY = "payload_id % 3 = 0", "payload_id % 5 = 1", "payload_id % 4 = 0"
EMPTY_FROM = 1_000_000_000


def _like(rows: DataFrame, table: DataFrame, **values: Column) -> DataFrame:
    """``rows`` in the columns of ``table``; what is not given is null."""
    return rows.select(*[values.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in table.schema])


def _changed(table: DataFrame, **values: Column) -> DataFrame:
    first = F.expr(f"idx = 0 AND {CHANGED}")
    return table.withColumns({c: F.when(first, v.cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def with_faults(t: ProfileTables) -> ProfileTables:
    n = lambda name, more=0: F.col(f"n_{name}") + more
    at = lambda c: F.lit(c)
    ints = lambda *cs: F.array(*[c.cast("int") if isinstance(c, Column) else F.lit(c) for c in cs])
    payloads = t.payloads
    broken = payloads.where(BROKEN)

    # Behind the resources: one with an empty scope and one profile, and one without scopes.
    resource, first = n("resource_profiles"), F.lit(0).cast("bigint")
    resources = [
        _like(broken, t.resource_profiles, rp_idx=resource + i, has_resource=at(False), schema_url=at(""), dropped_attributes_count=first,
              entity_refs=F.array(), n_scopes=at(scopes))
        for i, scopes in enumerate((2, 0))]
    scopes = [
        _like(broken, t.scope_profiles, rp_idx=resource, sp_idx=at(i), has_scope=at(True), scope_name=at(""), scope_version=at(""),
              dropped_attributes_count=first, schema_url=at(""), n_profiles=at(i))
        for i in range(2)]
    kind = lambda type_, unit: F.struct(type_.alias("type_strindex"), unit.alias("unit_strindex"))
    profile = _like(
        broken, t.profiles, rp_idx=resource, sp_idx=at(1), p_idx=at(0), sample_type=kind(n("strings", 6), at(0)),
        period_type=kind(at(0), at(-1)), time_unix_nano=first, duration_nano=first, period=first, dropped_attributes_count=first,
        original_payload_format=at(""), attribute_indices=ints(n("attributes", 7)))
    sample = lambda i, values, times, attributes, stack=at(0), link=at(0): _like(
        broken, t.samples, rp_idx=resource, sp_idx=at(1), p_idx=at(0), s_idx=at(i), stack_index=stack, link_index=link,
        values=F.array(*map(F.lit, values)).cast("array<bigint>"), timestamps=F.array(*map(F.lit, times)).cast("array<bigint>"),
        attribute_indices=attributes)
    samples = [
        sample(0, [1], [], ints(n("attributes", 7)), n("stacks", 9), at(-3)), sample(1, [1, 2], [], ints(n("attributes"))),
        sample(2, [], [], ints()), sample(3, [], [5], ints())]

    line = F.struct((n("functions", 2)).alias("function_index"), at(-7).cast("bigint").alias("line"), at(-8).cast("bigint").alias("column"))
    string = _like(broken, t.dict_strings, idx=n("strings"), value=F.concat(at("spare-"), F.col("payload_id").cast("string")))
    mapping = _like(broken, t.dict_mappings, idx=n("mappings"), memory_start=at(0), memory_limit=at(0), file_offset=at(0),
                    filename_strindex=at(-4), attribute_indices=ints())
    location = _like(broken, t.dict_locations, idx=n("locations"), mapping_index=n("mappings", 3), address=at(0), lines=F.array(line),
                     attribute_indices=ints())
    function = _like(broken, t.dict_functions, idx=n("functions"), name_strindex=n("strings", 2), system_name_strindex=at(-1),
                     filename_strindex=at(0), start_line=at(-9))
    links = [
        _like(broken, t.dict_links, idx=n("links", i), trace_id=F.unhex(F.repeat(at("ab"), at(size))), span_id=F.unhex(F.repeat(at("cd"), at(8))))
        for i, size in enumerate((3, 16))]
    attributes = [
        _like(broken, t.dict_attributes, idx=n("attributes"), key_strindex=n("strings", 4), unit_strindex=at(-2), value=no_value()),
        _like(broken, t.dict_attributes, idx=n("attributes", 1), key_strindex=at(0), unit_strindex=at(0), value=make_value("string", at("x")))]
    stack = _like(broken, t.dict_stacks, idx=n("stacks"), location_indices=ints(0, n("locations", 5)))

    appended = {"strings": 1, "mappings": 1, "locations": 1, "functions": 1, "links": 2, "attributes": 2, "stacks": 1, "resource_profiles": 2}
    more = F.expr(f"CAST({BROKEN} AS INT)")
    lengths = {f"n_{c}": (n(c) + more * k).cast(payloads.schema[f"n_{c}"].dataType) for c, k in appended.items()}
    empty = _like(
        payloads.where(EMPTY), payloads, payload_id=F.col("payload_id") + EMPTY_FROM, path=F.concat("path", at("-empty")),
        position=F.col("position") + EMPTY_FROM, has_dictionary=at(False), **{f"n_{c}": at(0) for c in appended})

    def all_of(table: DataFrame, *rows: DataFrame) -> DataFrame:
        for r in rows:
            table = table.unionByName(r)
        return table

    return t.with_tables(
        payloads=payloads.withColumns(lengths).unionByName(empty),
        resource_profiles=all_of(t.resource_profiles, *resources), scope_profiles=all_of(t.scope_profiles, *scopes),
        profiles=all_of(t.profiles, profile), samples=all_of(t.samples, *samples),
        dict_strings=all_of(_changed(t.dict_strings, value=at("zero")), string),
        dict_mappings=all_of(_changed(t.dict_mappings, memory_limit=at(7)), mapping),
        dict_locations=all_of(_changed(t.dict_locations, address=at(5)), location),
        dict_functions=all_of(_changed(t.dict_functions, start_line=at(5)), function),
        dict_links=all_of(_changed(t.dict_links, span_id=F.unhex(at("cd"))), *links),
        dict_attributes=all_of(_changed(t.dict_attributes, unit_strindex=at(1)), *attributes),
        dict_stacks=all_of(_changed(t.dict_stacks, location_indices=ints(0)), stack),
    )
