"""SQL equivalents of the registered queries, written against the raw tables.

Each entry is one statement: the common table expressions it needs are put in
front of it.  The SQL computes row by row with plain joins and windows, so it
shares no shortcut (pre-aggregation, screening, range numbering) with the
DataFrame code.
"""

from __future__ import annotations

import re

from emberframe.functions.language import FRAME_TYPE_LANGUAGE
from emberframe.operators.study import MAX_BINS, METRICS
from emberframe.schema import (
    DICTIONARY_TABLES, FRACTION_COLUMNS, LANGUAGES, STATS_COLUMNS, SYMBOL_FRACTION_COLUMNS,
)
from emberframe.sources.view import FRAME_TYPES, HEAD_STRINGS

ORACLES: dict[str, str] = {}
_CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    _CTES[name] = sql


def _uses(sql: str) -> list[str]:
    words = set(re.findall(r"\b[a-z_0-9]+\b", sql))
    return [n for n in _CTES if n in words]


def oracle(name: str, sql: str) -> None:
    needed: set[str] = set()
    todo = _uses(sql)
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += [m for m in _uses(_CTES[n]) if m != n]
    parts = [f"{n} AS ({_CTES[n]})" for n in _CTES if n in needed]
    ORACLES[name] = (f"WITH {', '.join(parts)} " if parts else "") + sql


# --- expression helpers ------------------------------------------------------------


def v(n: str) -> str:
    """Bytes of a varint."""
    steps = " ".join(f"WHEN {n} < {1 << (7 * k)} THEN {k}" for k in range(1, 10))
    return f"(CASE WHEN {n} < 0 THEN 10 {steps} ELSE 10 END)"


def fr(n: str) -> str:
    """Tag, length and content."""
    return f"(1 + {v(n)} + {n})"


def sc(n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE 1 + {v(n)} END)"


def text(s: str) -> str:
    return f"(CASE WHEN {s} = '' THEN 0 ELSE {fr(f'strlen({s})')} END)"


def packed(n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE {fr(n)} END)"


def total(items: str, size) -> str:
    return f"coalesce(list_sum([{size('x')} for x in {items}]), 0)"


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def quoted(s: str) -> str:
    return f"""('"' || replace(replace({s}, '\\', '\\\\'), '"', '\\"') || '"')"""


ID = "payload_id, rp_idx, sp_idx, p_idx"
SID = ID + ", s_idx"

# --- the view ------------------------------------------------------------------------

cte("items", """
SELECT CAST(l_suppkey AS BIGINT) AS payload_id,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rp_idx,
  CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS sp_idx, CAST(year(l_shipdate) - 1995 AS INT) AS p_idx,
  CAST(l_partkey AS BIGINT) AS part, p_brand AS exe, p_name, p_type, CAST(l_orderkey % 8 AS INT) AS pid,
  CAST(l_linenumber AS INT) AS thread, CAST(l_quantity AS BIGINT) AS v0, epoch_us(l_shipdate) * 1000 AS ts0,
  CAST(round(l_discount * 100) AS INT) AS d, CAST(round(l_tax * 100) AS INT) AS t, l_orderkey, l_linenumber, l_extendedprice
FROM lineitem JOIN part ON l_partkey = p_partkey""")
cte("smp0", """
SELECT *, CASE WHEN d < 4 THEN 0 ELSE 1 + thread % 3 END AS n_ts, (d = 10 AND t = 8) AS broken,
  CAST(row_number() OVER (PARTITION BY payload_id, rp_idx, sp_idx, p_idx
    ORDER BY l_orderkey, l_linenumber, part, v0, l_extendedprice, ts0, d, t) - 1 AS INT) AS s_idx,
  CAST(dense_rank() OVER (PARTITION BY payload_id ORDER BY part) AS INT) AS stack_index,
  CAST(23 + dense_rank() OVER (PARTITION BY payload_id ORDER BY exe) AS INT) AS exe_attr
FROM items""")
cte("smp1", """
SELECT *, CASE WHEN d < 4 THEN 1 WHEN d < 7 THEN 0 WHEN t = 8 THEN n_ts + 1 ELSE n_ts END AS n_val FROM smp0""")
cte("smp", """
SELECT *, CASE WHEN n_val > 0 THEN [v0 + i for i in range(n_val)] ELSE [] END AS vals,
  CASE WHEN n_ts > 0 THEN [ts0 + i * 1000 for i in range(n_ts)] ELSE [] END AS tss,
  CASE WHEN broken THEN [pid + 1, exe_attr, thread + 8, 9] ELSE [pid + 1, exe_attr, thread + 8] END AS attrs,
  CASE WHEN broken THEN 2 WHEN thread = 1 THEN 1 ELSE 0 END AS link_index,
  CAST(CASE WHEN n_ts > 0 THEN n_ts WHEN n_val > 0 THEN n_val ELSE 1 END AS BIGINT) AS weight,
  CASE WHEN n_val > 0 AND n_ts > 0 THEN 'both_values_and_timestamps' WHEN n_val > 0 THEN 'values_only'
    WHEN n_ts > 0 THEN 'timestamps_only' ELSE 'unspecified' END AS shape
FROM smp1""")
cte("stk", "SELECT DISTINCT payload_id, stack_index, p_name, p_type FROM smp0")
cte("frm", """
SELECT payload_id, stack_index, CAST(unnest(range(len(names))) AS INT) AS pos, unnest(names) AS fn
FROM (SELECT *, list_append(string_split(p_name, ' '), p_type) AS names FROM stk) x""")
cte("loc0", """
SELECT payload_id, fn, CAST(dense_rank() OVER (PARTITION BY payload_id ORDER BY fn) AS INT) AS location_index,
  CASE WHEN fn IN ('ECONOMY', 'LARGE') THEN 'native' WHEN fn = 'MEDIUM' THEN 'kernel' WHEN fn = 'PROMO' THEN 'jvm'
    WHEN fn = 'SMALL' THEN 'cpython' WHEN fn = 'STANDARD' THEN '' WHEN fn IN ('red', 'blue') THEN 'v8js'
    WHEN fn = 'hot' THEN 'wasm' ELSE 'native' END AS ftype,
  CASE WHEN fn IN ('ECONOMY', 'LARGE', 'rod') THEN '' ELSE fn END AS fname
FROM (SELECT DISTINCT payload_id, fn FROM frm) x""")
_language = " ".join(f"WHEN ftype = '{k}' THEN '{lang}'" for k, lang in FRAME_TYPE_LANGUAGE.items())
cte("loc", f"""
SELECT *, CASE WHEN ftype = 'native' THEN CASE WHEN fn = 'LARGE' THEN 'go' ELSE 'native' END {_language} ELSE 'other' END AS language,
  CASE WHEN fname = '' THEN 0 ELSE {len(HEAD_STRINGS) - 1} + rank() OVER (PARTITION BY payload_id, fname = '' ORDER BY fname) END AS name_str
FROM loc0""")
cte("pl", """
SELECT a.payload_id, n_parts, n_exe, n_fn, n_named FROM
  (SELECT payload_id, count(DISTINCT part) AS n_parts, count(DISTINCT exe) AS n_exe FROM items GROUP BY 1) a
  JOIN (SELECT payload_id, count(*) AS n_fn, count(*) FILTER (WHERE fname <> '') AS n_named FROM loc GROUP BY 1) b
  ON a.payload_id = b.payload_id""")
_head = ", ".join(f"({i}, '{s}')" for i, s in enumerate(HEAD_STRINGS))
cte("str", f"""
SELECT payload_id, idx, value FROM pl, (VALUES {_head}) h(idx, value)
UNION ALL SELECT payload_id, name_str, fname FROM loc WHERE fname <> ''
UNION ALL SELECT payload_id, {len(HEAD_STRINGS)} + n_named, 'orphan' FROM pl WHERE payload_id % 10 = 0
UNION ALL SELECT payload_id, {len(HEAD_STRINGS)} + n_named + CASE WHEN payload_id % 10 = 0 THEN 1 ELSE 0 END, 'count'
  FROM pl WHERE payload_id % 7 = 0""")
_fixed = [(0, 0, "", "", "NULL", "NULL", 0, -1)]
_fixed += [(1 + i, 3, "process.pid", str(i), str(i), "int", 0, 2) for i in range(8)]
_fixed += [(9 + i, 5, "thread.id", str(i + 1), str(i + 1), "int", 0, 2) for i in range(7)]
_fixed += [(16 + i, 6, "profile.frame.type", n, f'"{n}"', "string", len(n), len(n) + 2) for i, n in enumerate(FRAME_TYPES)]
_fixed += [(23, 7, "process.executable.build_id.go", "go.bin", '&"go.bin"', "string_ref", 6, 2)]
_rows = ", ".join(f"({i}, {ks}, '{k}', '{t}', '{li}', '{kind}', {b}, {w})" for i, ks, k, t, li, kind, b, w in _fixed)
cte("att", f"""
SELECT payload_id, idx, key_str, key, txt, lst, kind, vbytes, wire
FROM pl, (VALUES {_rows}) f(idx, key_str, key, txt, lst, kind, vbytes, wire)
UNION ALL SELECT DISTINCT payload_id, exe_attr, 4, 'process.executable.name', exe, '"' || exe || '"', 'string', strlen(exe),
  1 + {v('strlen(exe)')} + strlen(exe) FROM smp0""")
cte("psp", "SELECT payload_id, rp_idx, sp_idx, max(p_idx) + 1 AS n FROM items GROUP BY ALL")
cte("prp", "SELECT payload_id, rp_idx, max(sp_idx) + 1 AS n FROM items GROUP BY ALL")
cte("rp0", """
SELECT payload_id, unnest(range(last + 1)) AS rp_idx FROM (SELECT payload_id, max(rp_idx) AS last FROM items GROUP BY 1) x""")
cte("rps", """
SELECT r.payload_id, CAST(r.rp_idx AS INT) AS rp_idx, coalesce(n, 0) AS n_scopes, n IS NOT NULL AS has_resource
FROM rp0 r LEFT JOIN prp USING (payload_id, rp_idx)""")
cte("sp0", "SELECT payload_id, rp_idx, unnest(range(n)) AS sp_idx FROM prp")
cte("sps", """
SELECT s.payload_id, s.rp_idx, CAST(s.sp_idx AS INT) AS sp_idx, coalesce(n, 0) AS n_profiles
FROM sp0 s LEFT JOIN psp USING (payload_id, rp_idx, sp_idx)""")
cte("prf", """
SELECT *, epoch_us(make_timestamp(1995 + p_idx, 1, 1, 0, 0, 0)) * 1000 AS start_ns,
  epoch_us(make_timestamp(1995 + p_idx, 1, 1, 0, 0, 0)) * 1000 + 31536000000000000 AS end_ns
FROM (SELECT payload_id, rp_idx, sp_idx, CAST(unnest(range(n)) AS INT) AS p_idx FROM psp) x""")
_load = "CAST((payload_id % 9) / 4.0 AS DOUBLE)"
_load_text = f"regexp_replace(CAST({_load} AS VARCHAR), '\\.0$', '')"
_cpu = "(payload_id % 16 + 1)"
cte("rat", f"""
SELECT payload_id, rp_idx, 0 AS pos, 'host.name' AS key, 'host-' || (payload_id % 7) AS txt, 'string' AS kind FROM rps
  WHERE has_resource AND payload_id % 11 <> 0
UNION ALL SELECT payload_id, rp_idx, 1, 'container.id', 'c-' || rp_idx, 'string' FROM rps WHERE has_resource
UNION ALL SELECT payload_id, rp_idx, 2, 'host.cpu.count', CAST({_cpu} AS VARCHAR), 'int' FROM rps WHERE has_resource
UNION ALL SELECT payload_id, rp_idx, 3, 'host.arm', CASE WHEN payload_id % 2 = 0 THEN 'true' ELSE 'false' END, 'bool'
  FROM rps WHERE has_resource
UNION ALL SELECT payload_id, rp_idx, 4, 'host.load', {_load_text}, 'double' FROM rps WHERE has_resource""")
cte("rtx", f"""
SELECT payload_id, rp_idx, string_agg(key || '=' || CASE WHEN kind = 'string' THEN {quoted('txt')} ELSE txt END, ', ' ORDER BY key, pos) AS rtext
FROM rat GROUP BY 1, 2""")
cte("satt", "SELECT payload_id, rp_idx, sp_idx, p_idx, s_idx, unnest(attrs) AS idx, generate_subscripts(attrs, 1) - 1 AS pos FROM smp")
cte("stx", """
SELECT s.payload_id, rp_idx, sp_idx, p_idx, s_idx,
  string_agg('&' || key || '=' || lst, ', ' ORDER BY key, pos) AS attributes_text
FROM satt s JOIN att a USING (payload_id, idx) GROUP BY ALL""")
cte("mpg", """
SELECT payload_id, 0 AS idx, CAST(0 AS HUGEINT) AS ms, CAST(0 AS HUGEINT) AS ml, 0 AS fname, CAST([] AS INT[]) AS attrs FROM pl
UNION ALL SELECT payload_id, 1, 4194304, 8388608, 8, [23] FROM pl
UNION ALL SELECT payload_id, unnest(CASE WHEN payload_id % 5 = 0 THEN [2, 3] ELSE [2] END), 18446744071562067968,
  CASE WHEN payload_id % 9 = 0 THEN 18446744071562067968 ELSE 18446744071564165120 END, 9, [] FROM pl""")
cte("spanlen", "SELECT payload_id, CASE WHEN payload_id % 13 = 0 THEN 4 ELSE 8 END AS n FROM pl")

# --- look-ups and frames ---------------------------------------------------------------

cte("fbl", """
SELECT s.payload_id, language, CAST(sum(weight) AS BIGINT) AS frames
FROM smp s JOIN frm f ON s.payload_id = f.payload_id AND s.stack_index = f.stack_index
  JOIN loc l ON l.payload_id = f.payload_id AND l.fn = f.fn GROUP BY 1, 2""")
oracle("frames_by_language", "SELECT payload_id, language, frames FROM fbl")
_fractions = ", ".join(
    f"coalesce(sum(frames) FILTER (WHERE language = '{n}'), 0)::DOUBLE / sum(frames) AS {c}" for n, c in zip(LANGUAGES, FRACTION_COLUMNS))
cte("frac", f"SELECT payload_id, CAST(sum(frames) AS BIGINT) AS sampled_stack_frames_count, {_fractions} FROM fbl GROUP BY 1")


def _round(columns: list[str], digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


oracle("language_fractions", f"SELECT payload_id, sampled_stack_frames_count, {_round(FRACTION_COLUMNS, 9)} FROM frac")
cte("loclang", """
SELECT payload_id, location_index, language, CASE WHEN fname <> '' THEN 1 ELSE 0 END AS symbolized FROM loc
UNION ALL SELECT payload_id, 0, 'unknown', 0 FROM pl""")
oracle("location_language", "SELECT payload_id, location_index, language FROM loclang")
oracle("location_symbolized", "SELECT payload_id, location_index, symbolized FROM loclang")
_symbols = ", ".join(
    f"avg(symbolized) FILTER (WHERE language = '{n}') AS {c}" for n, c in zip(LANGUAGES, SYMBOL_FRACTION_COLUMNS))
cte("symf", f"SELECT payload_id, {_symbols} FROM loclang GROUP BY 1")
oracle("symbol_fractions", f"SELECT payload_id, {_round(SYMBOL_FRACTION_COLUMNS, 9)} FROM symf")
oracle("deref_function_names", f"""
SELECT payload_id, location_index AS function_index, fname AS function_name, {big('strlen(fname)', 'name_bytes')} FROM loc
UNION ALL SELECT payload_id, 0, '', 0 FROM pl""")
oracle("sample_weights", f"SELECT {SID}, weight FROM smp")
oracle("sample_shapes", f"SELECT {SID}, shape FROM smp")
oracle("canonical_sample_attrs", f"SELECT {SID}, attributes_text FROM stx")


def _stamp(ns: str) -> str:
    return f"strftime(make_timestamp(({ns}) // 1000), '%Y-%m-%d %H:%M:%S') || ' +0000 UTC'"


oracle("listing_samples", f"""
SELECT payload_id, rp_idx, -1 AS sp_idx, -1 AS p_idx, -1 AS s_idx, 'Resource: ' || coalesce(rtext, '') AS line
FROM rps LEFT JOIN rtx USING (payload_id, rp_idx)
UNION ALL SELECT payload_id, rp_idx, sp_idx, -1, -1, CASE WHEN sp_idx = 0 THEN '  Scope: scope.F: scope.kind="cpu"' ELSE '  Scope: scope.O: ' END FROM sps
UNION ALL SELECT payload_id, rp_idx, sp_idx, p_idx, -1, '    Profile: samples=count (' || {_stamp('start_ns - 31536000000000000')}
  || ' - ' || {_stamp('start_ns')} || ')' FROM prf
UNION ALL SELECT payload_id, rp_idx, sp_idx, p_idx, s_idx, '      Sample: ' || attributes_text FROM stx""")
oracle("anyvalue_text", "SELECT payload_id, idx AS attribute_index, key, txt AS text FROM att")
oracle("anyvalue_bytes", f"""
SELECT 'attribute' AS owner, payload_id, -1 AS rp_idx, idx AS pos, {big('vbytes', 'value_bytes')} FROM att
UNION ALL SELECT 'resource', payload_id, rp_idx, pos, CASE WHEN kind = 'string' THEN strlen(txt) ELSE 0 END FROM rat""")
oracle("anyvalue_nested", f"""
SELECT l_orderkey, {big('2 + 4 * count(*)', 'n_entries')}, 3 AS depth,
  {big("strlen('lines') + sum(strlen('flagstatuspart') + strlen(coalesce(l_returnflag, '')) + strlen(coalesce(l_linestatus, '')))", 'text_bytes')}
FROM lineitem GROUP BY l_orderkey""")

# --- statistics --------------------------------------------------------------------------

cte("hosts", """
SELECT payload_id, coalesce(host, '') AS host, CAST(coalesce(host_id, 0) AS BIGINT) AS host_id FROM pl LEFT JOIN (
  SELECT payload_id, host, dense_rank() OVER (ORDER BY first_payload) AS host_id FROM (
    SELECT payload_id, arg_min(txt, rp_idx) AS host, min(payload_id) OVER (PARTITION BY arg_min(txt, rp_idx)) AS first_payload
    FROM rat WHERE key = 'host.name' GROUP BY payload_id) a) b USING (payload_id)""")
oracle("host_ids", "SELECT payload_id, host, host_id FROM hosts")
cte("tree", """
SELECT pl.payload_id, CAST(r AS BIGINT) AS resource_profiles_count, CAST(ra AS BIGINT) AS resource_profiles_attrs_count,
  CAST(sc AS BIGINT) AS scope_profiles_count, CAST(sa AS BIGINT) AS scope_profiles_attrs_count, CAST(p AS BIGINT) AS profiles_count,
  CAST(pa AS BIGINT) AS profiles_attrs_count, CAST(0 AS BIGINT) AS original_payloads_sum_bytes, CAST(s AS BIGINT) AS samples_count,
  CAST(sv AS BIGINT) AS values_count, CAST(st AS BIGINT) AS timestamps_count, CAST(sat AS BIGINT) AS sample_attrs_count
FROM pl JOIN (SELECT payload_id, count(*) AS r FROM rps GROUP BY 1) USING (payload_id)
JOIN (SELECT payload_id, count(*) AS ra FROM rat GROUP BY 1) USING (payload_id)
JOIN (SELECT payload_id, count(*) AS sc, count(*) FILTER (WHERE sp_idx = 0) AS sa FROM sps GROUP BY 1) USING (payload_id)
JOIN (SELECT payload_id, count(*) AS p, 2 * count(*) FILTER (WHERE p_idx = 6) AS pa FROM prf GROUP BY 1) USING (payload_id)
JOIN (SELECT payload_id, count(*) AS s, sum(len(vals)) AS sv, sum(len(tss)) AS st, sum(len(attrs)) AS sat FROM smp GROUP BY 1) USING (payload_id)""")
oracle("payload_tree_counts", "SELECT * FROM tree")
cte("dcount", f"""
SELECT payload_id, {big(f"{len(HEAD_STRINGS)} + n_named + (payload_id % 10 = 0)::INT + (payload_id % 7 = 0)::INT", 'dict_strings_count')},
  {big('3 + (payload_id % 5 = 0)::INT', 'dict_mappings_count')}, CAST(1 AS BIGINT) AS mapping_attribute_indices_count,
  {big('n_fn + 1', 'dict_locations_count')}, {big('n_fn', 'location_lines_count')}, {big('n_fn', 'location_attribute_indices_count')},
  {big('n_fn + 1', 'dict_functions_count')}, CAST(2 AS BIGINT) AS dict_links_count, {big('24 + n_exe', 'dict_attributes_count')},
  {big('n_parts + 1', 'dict_stacks_count')}, {big('3 * n_parts', 'stack_locations_count')}, CAST(3 AS BIGINT) AS max_stack_depth
FROM pl""")
oracle("payload_dict_counts", "SELECT * FROM dcount")
cte("sbytes", f"""
SELECT payload_id, {big('a', 'dict_string_bytes')}, {big('b', 'dict_string_max_bytes')}, {big('c', 'function_name_bytes')},
  {big('d', 'function_name_max_bytes')}, CAST(0 AS BIGINT) AS function_system_name_bytes, {big('e', 'function_filename_bytes')},
  {big('f', 'mapping_filename_bytes')}, {big('g', 'dict_attribute_key_bytes')}, CAST(0 AS BIGINT) AS dict_attribute_unit_bytes,
  {big('h', 'dict_attribute_value_bytes')}, {big('i', 'resource_attribute_key_bytes')}, {big('j', 'resource_attribute_value_bytes')}
FROM (SELECT payload_id, sum(strlen(value)) AS a, max(strlen(value)) AS b FROM str GROUP BY 1)
JOIN (SELECT payload_id, sum(strlen(fname)) AS c, max(strlen(fname)) AS d, 7 * count(*) FILTER (WHERE fname <> '') AS e FROM loc GROUP BY 1) USING (payload_id)
JOIN (SELECT payload_id, 6 * count(*) FILTER (WHERE fname > 0) AS f FROM mpg GROUP BY 1) USING (payload_id)
JOIN (SELECT payload_id, sum(strlen(key)) AS g, sum(vbytes) AS h FROM att GROUP BY 1) USING (payload_id)
JOIN (SELECT payload_id, sum(strlen(key)) AS i, sum(CASE WHEN kind = 'string' THEN strlen(txt) ELSE 0 END) AS j FROM rat GROUP BY 1) USING (payload_id)""")
oracle("payload_string_bytes", "SELECT * FROM sbytes")

# --- sizes -----------------------------------------------------------------------------------


def sized(prefix: str, samples: str, profiles: str, scopes: str, resources: str, kvs: str) -> None:
    """CTE chain <prefix>_tree(payload_id, five byte sums) from a variant's row sources.

    samples: ids, st, vn, an, ln, tn (content parts); profiles: ids, pan; scopes: ids, n_profiles;
    resources: ids, n_scopes, has_resource; kvs: ids, content.
    """
    cte(f"{prefix}_s", f"""SELECT {ID}, {sc('st')} + {packed('vn')} + {packed('an')} + {sc('ln')} + {packed('tn')} AS c FROM ({samples}) x""")
    cte(f"{prefix}_p", f"""
SELECT p.payload_id, p.rp_idx, p.sp_idx, p.p_idx, coalesce(sb, 0) AS sb,
  6 + 9 + {sc('31536000000000000')} + {packed('pan')} + coalesce(fs, 0) AS c
FROM ({profiles}) p LEFT JOIN (SELECT {ID}, sum(c) AS sb, sum({fr('c')}) AS fs FROM {prefix}_s GROUP BY ALL) s USING ({ID})""")
    message = "(9 + 5 + CASE WHEN sp_idx = 0 THEN 21 ELSE 0 END)"
    cte(f"{prefix}_c", f"""
SELECT c.payload_id, c.rp_idx, c.sp_idx, {message} AS msg, coalesce(sb, 0) AS sb, coalesce(pb, 0) AS pb,
  {fr(message)} + coalesce(fp, 0) + 2 * (n_profiles - coalesce(n, 0)) AS c
FROM ({scopes}) c LEFT JOIN (SELECT payload_id, rp_idx, sp_idx, sum(sb) AS sb, sum(c) AS pb, sum({fr('c')}) AS fp, count(*) AS n
  FROM {prefix}_p GROUP BY ALL) p USING (payload_id, rp_idx, sp_idx)""")
    cte(f"{prefix}_r", f"""
SELECT r.payload_id, r.rp_idx, coalesce(kv, 0) AS msg, coalesce(sb, 0) AS sb, coalesce(pb, 0) AS pb, coalesce(sm, 0) AS sm,
  CASE WHEN has_resource THEN {fr('coalesce(kv, 0)')} ELSE 0 END + coalesce(fc, 0) + 2 * (n_scopes - coalesce(n, 0)) AS c
FROM ({resources}) r
LEFT JOIN (SELECT payload_id, rp_idx, sum(sb) AS sb, sum(pb) AS pb, sum(msg) AS sm, sum({fr('c')}) AS fc, count(*) AS n FROM {prefix}_c GROUP BY ALL) c
  USING (payload_id, rp_idx)
LEFT JOIN (SELECT payload_id, rp_idx, sum({fr('content')}) AS kv FROM ({kvs}) k GROUP BY ALL) k USING (payload_id, rp_idx)""")
    cte(f"{prefix}_tree", f"""
SELECT payload_id, sum({fr('c')}) AS resource_profiles_proto_bytes, sum(msg) AS resource_messages_proto_bytes,
  sum(sm) AS scope_messages_proto_bytes, sum(pb) AS profile_messages_proto_bytes, sum(sb) AS sample_messages_proto_bytes
FROM {prefix}_r GROUP BY 1""")


def _wire(kind: str, txt: str) -> str:
    return (f"CASE {kind} WHEN 'string' THEN 1 + {v(f'strlen({txt})')} + strlen({txt}) WHEN 'int' THEN 1 + {v(f'CAST({txt} AS BIGINT)')}"
            f" WHEN 'bool' THEN 2 ELSE 9 END")


def _samples_source(table: str, attrs: str) -> str:
    return (f"SELECT {ID}, stack_index AS st, {total('vals', v)} AS vn, {total(attrs, v)} AS an, link_index AS ln, 8 * len(tss) AS tn FROM {table}")


_PROFILE_SOURCE = "SELECT payload_id, rp_idx, sp_idx, p_idx, CASE WHEN p_idx = 6 THEN 2 ELSE 0 END AS pan FROM "
cte("base_kv", f"SELECT payload_id, rp_idx, {text('key')} + {fr('w')} AS content FROM (SELECT *, {_wire('kind', 'txt')} AS w FROM rat) x")
sized("base", _samples_source("smp", "attrs"), _PROFILE_SOURCE + "prf", "SELECT * FROM sps", "SELECT * FROM rps", "SELECT * FROM base_kv")
cte("stkloc", """
SELECT f.payload_id, stack_index, list(location_index ORDER BY pos) AS locs
FROM frm f JOIN loc l ON f.payload_id = l.payload_id AND f.fn = l.fn GROUP BY 1, 2""")
cte("dent", f"""
SELECT payload_id, 'string' AS tab, strlen(value) AS c FROM str
UNION ALL SELECT payload_id, 'mapping', {sc('ms')} + {sc('ml')} + {sc('fname')} + CASE WHEN len(attrs) = 0 THEN 0 ELSE 2 + len(attrs) END FROM mpg
UNION ALL SELECT payload_id, 'location', 2 + {sc('location_index * 4096')} + {fr(f"({sc('location_index')} + {sc('location_index * 10')})")} + 3 FROM loc
UNION ALL SELECT payload_id, 'location', 0 FROM pl
UNION ALL SELECT payload_id, 'function', {sc('name_str')} + CASE WHEN name_str = 0 THEN 0 ELSE 2 END + {sc('location_index')} FROM loc
UNION ALL SELECT payload_id, 'function', 0 FROM pl
UNION ALL SELECT payload_id, 'link', unnest([0, 18 + 2 + n]) FROM spanlen
UNION ALL SELECT payload_id, 'attribute', {sc('key_str')} + CASE WHEN wire < 0 THEN 0 ELSE {fr('wire')} END FROM att
UNION ALL SELECT payload_id, 'stack', {packed('n')} FROM (SELECT payload_id, {total('locs', v)} AS n FROM stkloc) x
UNION ALL SELECT payload_id, 'stack', 0 FROM pl""")
_tables = ", ".join(f"sum({fr('c')}) FILTER (WHERE tab = '{n}') AS dict_{n}_table_proto_bytes" for n in DICTIONARY_TABLES)
cte("dtab", f"SELECT payload_id, {_tables}, sum({fr('c')}) AS dict_bytes FROM dent GROUP BY 1")
_TREE_BYTES = ["resource_profiles_proto_bytes", "resource_messages_proto_bytes", "scope_messages_proto_bytes",
               "profile_messages_proto_bytes", "sample_messages_proto_bytes"]
_TABLE_BYTES = [f"dict_{n}_table_proto_bytes" for n in DICTIONARY_TABLES]
cte("mbytes", f"""
SELECT payload_id, {', '.join(big(c, c) for c in _TREE_BYTES + _TABLE_BYTES)}, {big(fr('dict_bytes'), 'dictionary_proto_bytes')}
FROM base_tree JOIN dtab USING (payload_id)""")
oracle("message_bytes", "SELECT * FROM mbytes")
cte("span", """
SELECT payload_id, min(start_ns) AS start_ts, max(end_ns) AS end_ts, (max(end_ns) - min(start_ns)) / 1e9 AS duration_sec FROM prf GROUP BY 1""")
oracle("payload_time_span", "SELECT payload_id, start_ts, end_ts, duration_sec FROM span")
_means = {
    "mean_stack_depth": "stack_locations_count::DOUBLE / dict_stacks_count",
    "mean_lines_per_location": "location_lines_count::DOUBLE / dict_locations_count",
    "mean_sample_attrs": "sample_attrs_count::DOUBLE / samples_count",
    "mean_timestamps_per_sample": "timestamps_count::DOUBLE / samples_count",
    "mean_values_per_sample": "values_count::DOUBLE / samples_count",
    "id": "payload_id",
    "uncompressed_bytes": "resource_profiles_proto_bytes + dictionary_proto_bytes",
}
cte("stat", f"""
SELECT {', '.join(f'{_means.get(n, n)} AS {n}' for n, _ in STATS_COLUMNS)}
FROM tree JOIN dcount USING (payload_id) JOIN sbytes USING (payload_id) JOIN mbytes USING (payload_id) JOIN span USING (payload_id)
JOIN frac USING (payload_id) JOIN symf USING (payload_id) JOIN hosts USING (payload_id)""")
_stat_rounded = ", ".join(f"round({n}, 9) AS {n}" if kind == "double" else n for n, kind in STATS_COLUMNS)
oracle("payload_stats", f"SELECT {_stat_rounded} FROM stat")
oracle("src_stats_csv", f"""
SELECT {', '.join(
    f"strftime(make_timestamp({n} // 1000), '%Y-%m-%dT%H:%M:%SZ') AS {n}" if n in ('start_ts', 'end_ts')
    else f'round({n}, 9) AS {n}' if kind == 'double' else n for n, kind in STATS_COLUMNS)} FROM stat""")
oracle("sink_stats_csv", f"""
SELECT {', '.join(
    f"strftime(make_timestamp({n} // 1000), '%Y-%m-%dT%H:%M:%SZ') AS {n}" if n in ('start_ts', 'end_ts')
    else f"coalesce(regexp_replace(CAST({n} AS VARCHAR), '\\.0$', ''), '') AS {n}" for n, _ in STATS_COLUMNS)} FROM stat""")

# --- conformance ---------------------------------------------------------------------------------

_PPATH = "'resource_profiles[' || rp_idx || ']: scope_profiles[' || sp_idx || ']: profile[' || p_idx || ']'"
_SPATH = _PPATH + " || ': sample[' || s_idx || ']'"


def finding(rule: str, table: str, source: str, path: str, message: str, where: str = "TRUE", **ordinals: str) -> str:
    names = ("rp_idx", "sp_idx", "p_idx", "s_idx", "entry_idx", "pos")
    columns = ", ".join(f"CAST({ordinals.get(n, 'NULL')} AS INT) AS {n}" for n in names)
    return (f"SELECT payload_id, '{rule}' AS rule, '{table}' AS table_name, {columns}, {path} AS path, {message} AS message "
            f"FROM {source} WHERE {where}")


_P = {"rp_idx": "rp_idx", "sp_idx": "sp_idx", "p_idx": "p_idx"}
_S = _P | {"s_idx": "s_idx"}
_link = finding("R9", "sample", "smp", f"{_SPATH} || ': link_index'", "'index ' || link_index || ' is out of range [0..2)'", "link_index >= 2", **_S)
_stack = finding(
    "R7", "sample", "(SELECT s.*, n_parts + 1 AS n FROM smp s JOIN pl USING (payload_id)) x", f"{_SPATH} || ': stack_index'",
    "'index ' || stack_index || ' is out of range [0..' || n || ')'", "stack_index < 0 OR stack_index >= n", **_S)
cte("c_stack", f"{_link} UNION ALL {_stack}")
cte("tsx", f"""
SELECT s.payload_id, s.rp_idx, s.sp_idx, s.p_idx, s_idx, unnest(tss) AS ts, generate_subscripts(tss, 1) - 1 AS i, start_ns, end_ns
FROM smp s JOIN prf p USING ({ID})""")
cte("c_ts", finding(
    "R10", "sample", "tsx", _SPATH,
    "'timestamps_unix_nano[' || i || ']=' || ts || ' is outside profile time range [' || start_ns || ', ' || end_ns || ')'",
    "ts < start_ns OR ts >= end_ns", pos="i", **_S))
cte("keyed", """
SELECT s.payload_id, rp_idx, sp_idx, p_idx, s_idx, s.pos, key,
  min(s.pos) OVER (PARTITION BY s.payload_id, rp_idx, sp_idx, p_idx, s_idx, key) AS prev
FROM satt s JOIN att USING (payload_id, idx)""")
_dup = lambda key, prev: f"'duplicate key \"' || {key} || '\", previously seen at [' || {prev} || '].key_strindex'"
_r8 = finding("R8", "sample", "keyed", f"{_SPATH} || ': attribute_indices: [' || pos || '].key_strindex'", _dup("key", "prev"),
              "pos > prev", pos="pos", **_S)
_r4 = finding("R4", "profile", "prf", f"{_PPATH} || ': attribute_indices: [1].key_strindex'",
              _dup("'process.executable.build_id.go'", "'0'"), "p_idx = 6", pos="1", **_P)
cte("c_keys", f"{_r4} UNION ALL {_r8}")
_r11 = finding("R11", "sample", "smp", _SPATH, "'values (len=' || n_val || ') and timestamps_unix_nano (len=' || n_ts || ') must contain the same number of elements'",
               "n_val > 0 AND n_ts > 0 AND n_val <> n_ts", **_S)
_r12 = finding("R12", "sample", "smp", _SPATH, "'values (len=' || n_val || ') must contain a single element if timestamps_unix_nano is not set'",
               "n_ts = 0 AND n_val > 1", **_S)
_r13 = finding("R13", "sample", "smp", _SPATH, "'sample must have at least one values or timestamps_unix_nano entry'", "n_ts = 0 AND n_val = 0", **_S)
cte("shaped", f"SELECT *, first_value(shape) OVER (PARTITION BY {ID} ORDER BY s_idx) AS want FROM smp")
_r14 = finding("R14", "sample", "shaped", _SPATH, "'sample shape ' || shape || ' does not match expected sample shape ' || want", "shape <> want", **_S)
cte("c_shape", f"{_r11} UNION ALL {_r12} UNION ALL {_r13} UNION ALL {_r14}")
_r23 = finding(
    "R23", "mapping_table", "mpg", "'dictionary: mapping_table: [' || (idx - 1) || ']'",
    "'memory_start=' || lower(printf('%016x', CAST(ms AS UBIGINT))) || ', memory_limit=' || lower(printf('%016x', CAST(ml AS UBIGINT))) || ': must be both zero or start < limit'",
    "idx >= 1 AND NOT (ms = 0 AND ml = 0) AND NOT ms < ml", entry_idx="idx")
_r28 = finding("R28", "link_table", "spanlen", "'dictionary: link_table'", "'len([0].span_id) == ' || n || ', want 8'", "n <> 8", entry_idx="1")
cte("c_dict", f"{_r23} UNION ALL {_r28}")
cte("strdup", "SELECT *, min(idx) OVER (PARTITION BY payload_id, value) AS orig FROM str")
cte("c_dupstr", finding("R29", "string_table", "strdup", "'dictionary: string_table'",
                        "'duplicate string at index ' || idx || ', orig index ' || orig || ': ' || value", "idx > orig", entry_idx="idx"))
cte("mapdup", "SELECT *, min(idx) OVER (PARTITION BY payload_id, fname, list_sort(attrs), ms, ml) AS orig FROM mpg WHERE idx >= 1")
cte("c_dupmap", finding(
    "R24", "mapping_table", "mapdup", "'dictionary: mapping_table'",
    "'duplicate mapping at index ' || (idx - 1) || ': filename_strindex=' || fname || ', attribute_indices=[], memory_start=' || ms || ', memory_limit=' || ml || ', file_offset=0'",
    "idx > orig", entry_idx="idx"))
_orphans = {
    "R32": ("string_table", """(SELECT str.payload_id, idx FROM str ANTI JOIN (
      SELECT DISTINCT * FROM (SELECT payload_id, unnest([1, 2, 8, 9, 10]) AS i FROM pl UNION ALL SELECT payload_id, name_str FROM loc
        UNION ALL SELECT payload_id, key_str FROM att)) r ON r.payload_id = str.payload_id AND r.i = str.idx WHERE idx > 0) x"""),
    "R33": ("attribute_table", """(SELECT att.payload_id, idx FROM att ANTI JOIN (
      SELECT DISTINCT * FROM (SELECT payload_id, idx AS i FROM satt UNION ALL SELECT payload_id, 23 FROM pl
        UNION ALL SELECT payload_id, CASE ftype WHEN 'native' THEN 16 WHEN 'kernel' THEN 17 WHEN 'jvm' THEN 18 WHEN 'cpython' THEN 19
          WHEN '' THEN 20 WHEN 'v8js' THEN 21 ELSE 22 END FROM loc)) r ON r.payload_id = att.payload_id AND r.i = att.idx WHERE idx > 0) x"""),
    "R34": ("mapping_table", """(SELECT mpg.payload_id, idx FROM mpg ANTI JOIN (
      SELECT DISTINCT payload_id, CASE WHEN fn = 'LARGE' THEN 1 ELSE 2 END AS i FROM loc) r
      ON r.payload_id = mpg.payload_id AND r.i = mpg.idx WHERE idx > 0) x"""),
    "R38": ("link_table", """(SELECT pl.payload_id, 1 AS idx FROM pl ANTI JOIN (
      SELECT DISTINCT payload_id FROM smp WHERE link_index = 1) r ON r.payload_id = pl.payload_id) x"""),
}
cte("c_orphan", " UNION ALL ".join(
    finding(rule, table, source, f"'dictionary: {table}'", "'unreferenced entry at index ' || idx", entry_idx="idx")
    for rule, (table, source) in _orphans.items()))
_r2 = finding("R2", "resource_profiles", "rps", "'resource_profiles[' || rp_idx || ']'", "'resource profiles has no scope profiles'", "n_scopes = 0", rp_idx="rp_idx")
_r3 = finding("R3", "scope_profiles", "sps", "'resource_profiles[' || rp_idx || ']: scope_profiles[' || sp_idx || ']'",
              "'scope profiles has no profiles'", "n_profiles = 0", rp_idx="rp_idx", sp_idx="sp_idx")
cte("c_tree", f"{_r2} UNION ALL {_r3}")
for _name, _source in {
    "check_stack_index": "c_stack", "check_timestamps": "c_ts", "check_duplicate_keys": "c_keys",
    "check_duplicate_strings": "c_dupstr", "check_duplicate_mappings": "c_dupmap", "check_sample_shapes": "c_shape",
    "check_dictionary_indexes": "c_dict", "check_orphans": "c_orphan",
}.items():
    oracle(_name, f"SELECT * FROM {_source}")
oracle("check_all", " UNION ALL ".join(f"SELECT * FROM {c}" for c in (
    "c_tree", "c_stack", "c_ts", "c_keys", "c_shape", "c_dict", "c_dupstr", "c_dupmap", "c_orphan")))

# Payloads with faults: their lengths before and after, and what is found besides.
cte("fa", """
SELECT payload_id, dict_strings_count + 1 AS ns, dict_mappings_count AS m0, dict_locations_count AS l0, dict_functions_count AS f0,
  dict_attributes_count AS a0, dict_stacks_count AS k0, r AS rp_idx
FROM dcount JOIN (SELECT payload_id, count(*) AS r FROM rps GROUP BY 1) x USING (payload_id) WHERE payload_id % 3 = 0""")
cte("fz", "SELECT payload_id FROM pl WHERE payload_id % 5 = 1")
_range = lambda idx, n: f"'index ' || ({idx}) || ' is out of range [0..' || ({n}) || ')'"
_fp = {"rp_idx": "rp_idx", "sp_idx": "1", "p_idx": "0"}
_fpath = "'resource_profiles[' || rp_idx || ']: scope_profiles[1]: profile[0]'"


def _of_sample(rule: str, s_idx: int, field: str, message: str, pos: str = "NULL") -> str:
    return finding(rule, "sample", "fa", f"{_fpath} || ': sample[{s_idx}]{field}'", message, s_idx=str(s_idx), pos=pos, **_fp)


def _of_entry(rule: str, table: str, at: str, field: str, message: str, pos: str = "NULL", shown: str = "") -> str:
    return finding(rule, f"{table}_table", "fa", f"'dictionary: {table}_table: [' || ({shown or at}) || ']{field}'", message, entry_idx=at, pos=pos)


def _spare(rule: str, table: str, at: str, where: str = "TRUE") -> str:
    return finding(rule, f"{table}_table", "fa", f"'dictionary: {table}_table'", f"'unreferenced entry at index ' || ({at})", where, entry_idx=at)


def _zero(rule: str, table: str, message: str) -> str:
    return finding(rule, f"{table}_table", "fz", f"'dictionary: {table}_table'", message, entry_idx="0")


def _zero_value(rule: str, table: str, got: str) -> str:
    return _zero(rule, table, f"'must have zero value at index 0, got {got}'")


_shape_differs = lambda got: f"'sample shape {got} does not match expected sample shape values_only'"
_FAULTS = [
    finding("R1", "payload", "(SELECT payload_id + 1000000000 AS payload_id FROM pl WHERE payload_id % 4 = 0) x", "''",
            "'resource profiles are empty'"),
    finding("R2", "resource_profiles", "fa", "'resource_profiles[' || (rp_idx + 1) || ']'", "'resource profiles has no scope profiles'",
            rp_idx="rp_idx + 1"),
    finding("R3", "scope_profiles", "fa", "'resource_profiles[' || rp_idx || ']: scope_profiles[0]'", "'scope profiles has no profiles'",
            rp_idx="rp_idx", sp_idx="0"),
    finding("R4", "profile", "fa", f"{_fpath} || ': attribute_indices: [0]'", _range("a0 + 7", "a0 + 2"), pos="0", **_fp),
    finding("R5", "profile", "fa", f"{_fpath} || ': sample_type: type_strindex'", _range("ns + 5", "ns"), **_fp),
    finding("R6", "profile", "fa", f"{_fpath} || ': period_type: unit_strindex'", _range("-1", "ns"), **_fp),
    _of_sample("R7", 0, ": stack_index", _range("k0 + 9", "k0 + 1")),
    _of_sample("R8", 0, ": attribute_indices: [0]", _range("a0 + 7", "a0 + 2"), "0"),
    _of_sample("R8", 1, ": attribute_indices: [0].key_strindex", _range("ns + 3", "ns"), "0"),
    _of_sample("R9", 0, ": link_index", _range("-3", "4")),
    _of_sample("R10", 3, "", "'timestamps_unix_nano[0]=5 is outside profile time range [0, 0)'", "0"),
    _of_sample("R12", 1, "", "'values (len=2) must contain a single element if timestamps_unix_nano is not set'"),
    _of_sample("R13", 2, "", "'sample must have at least one values or timestamps_unix_nano entry'"),
    _of_sample("R14", 2, "", _shape_differs("unspecified")), _of_sample("R14", 3, "", _shape_differs("timestamps_only")),
    _zero_value("R15", "mapping", '{"memory_start":0,"memory_limit":7,"file_offset":0,"filename_strindex":0,"attribute_indices":[]}'),
    _zero_value("R16", "location", '{"mapping_index":0,"address":5,"lines":[],"attribute_indices":[]}'),
    _zero_value("R17", "function", '{"name_strindex":0,"system_name_strindex":0,"filename_strindex":0,"start_line":5}'),
    _zero_value("R18", "link", '{"span_id":"zQ=="}'), _zero_value("R19", "stack", '{"location_indices":[0]}'),
    _zero("R20", "attribute", "'first attribute must have zero key/unit indices, got KeyStrindex=0, UnitStrindex=1'"),
    _zero("R21", "string", "'must have empty string at index 0, got \"zero\"'"),
    _of_entry("R22", "mapping", "m0", ".filename_strindex", _range("-4", "ns"), shown="m0 - 1"),
    _of_entry("R25", "location", "l0", ".mapping_index", _range("m0 + 3", "m0 + 1")),
    _of_entry("R26", "location", "l0", ".line[0]: function_index", _range("f0 + 2", "f0 + 1"), "0"),
    _of_entry("R26", "location", "l0", ".line[0]: line", "'-7 < 0, must be non-negative'", "0"),
    _of_entry("R26", "location", "l0", ".line[0]: column", "'-8 < 0, must be non-negative'", "0"),
    _of_entry("R27", "function", "f0", ".name_strindex", _range("ns + 1", "ns")),
    _of_entry("R27", "function", "f0", ".system_name_strindex", _range("-1", "ns")),
    _of_entry("R27", "function", "f0", ".start_line", "'-9 < 0, must be non-negative'"),
    finding("R28", "link_table", "fa", "'dictionary: link_table'", "'len([1].trace_id) == 3, want 16'", entry_idx="2"),
    _of_entry("R30", "attribute", "a0", ".key_strindex", _range("ns + 3", "ns")),
    _of_entry("R30", "attribute", "a0", ".unit_strindex", _range("-2", "ns")),
    _of_entry("R31", "stack", "k0", ".location_indices[1]", _range("l0 + 5", "l0 + 1"), "1"),
    _spare("R32", "string", "ns - 1"), _spare("R33", "attribute", "a0 + 1"), _spare("R34", "mapping", "m0"), _spare("R35", "function", "f0"),
    _spare("R36", "location", "l0"), _spare("R37", "stack", "k0"),
    _spare("R38", "link", "3"), _spare("R38", "link", "2", "payload_id NOT IN (SELECT payload_id FROM smp WHERE link_index = 2)"),
]
oracle("check_all_rules", " UNION ALL ".join([
    *(f"SELECT * FROM {c}" for c in ("c_tree", "c_ts", "c_keys", "c_shape", "c_dict", "c_dupmap", "c_orphan")),
    "SELECT * FROM c_stack WHERE payload_id % 3 <> 0", "SELECT * FROM c_dupstr WHERE payload_id % 5 <> 1", *_FAULTS]))

# --- transforms ----------------------------------------------------------------------------------


def _list_text(c: str) -> str:
    return f"array_to_string({c}, ',')"


oracle("scale_samples", f"""
SELECT {ID}, CAST(k.i * n + s_idx AS INT) AS s_idx, stack_index, {_list_text('attrs')} AS attributes
FROM (SELECT *, count(*) OVER (PARTITION BY {ID}) AS n FROM smp) s, (VALUES (0), (1), (2)) k(i)""")
cte("spl0", f"""
SELECT smp.*, '&process.executable.name="' || exe || '", &process.pid=' || pid AS ptext, rtext,
  CASE WHEN broken THEN [thread + 8, 9] ELSE [thread + 8] END AS rest,
  row_number() OVER (PARTITION BY payload_id ORDER BY rp_idx, sp_idx, p_idx, s_idx) AS enc
FROM smp JOIN rtx USING (payload_id, rp_idx)""")
cte("grp", """
SELECT payload_id, rtext, ptext, CAST(row_number() OVER (PARTITION BY payload_id ORDER BY min(enc)) - 1 AS INT) AS new_rp,
  arg_min(rp_idx, enc) AS old_rp, arg_min(exe, enc) AS exe, arg_min(pid, enc) AS pid, max(sp_idx) AS last_sp
FROM spl0 GROUP BY 1, 2, 3""")
cte("spl", """
SELECT s.payload_id, new_rp AS rp_idx, sp_idx, p_idx, stack_index, vals, tss, rest, link_index, weight,
  CAST(row_number() OVER (PARTITION BY s.payload_id, new_rp, sp_idx, p_idx ORDER BY rp_idx, s_idx) - 1 AS INT) AS s_idx
FROM spl0 s JOIN grp g ON s.payload_id = g.payload_id AND s.rtext = g.rtext AND s.ptext = g.ptext""")
cte("srp", """
SELECT g.payload_id, g.new_rp AS rp_idx, greatest(r.n_scopes, last_sp + 1) AS n_scopes, TRUE AS has_resource, g.old_rp, g.exe, g.pid
FROM grp g JOIN rps r ON r.payload_id = g.payload_id AND r.rp_idx = g.old_rp""")
cte("nrat", "SELECT payload_id, rp_idx AS old_rp, max(pos) + 1 AS n FROM rat GROUP BY ALL")
cte("srat", """
SELECT g.payload_id, g.rp_idx, a.pos, a.key, a.txt, a.kind FROM srp g JOIN rat a ON a.payload_id = g.payload_id AND a.rp_idx = g.old_rp
UNION ALL SELECT g.payload_id, g.rp_idx, n, 'process.pid', CAST(pid AS VARCHAR), 'int' FROM srp g JOIN nrat USING (payload_id, old_rp)
UNION ALL SELECT g.payload_id, g.rp_idx, n + 1, 'process.executable.name', exe, 'string' FROM srp g JOIN nrat USING (payload_id, old_rp)""")
oracle("split_by_process", f"""
SELECT payload_id, rp_idx, n_scopes, resource_text, samples, weight FROM srp
JOIN (SELECT payload_id, rp_idx, string_agg(key || '=' || CASE WHEN kind = 'string' THEN {quoted('txt')} ELSE txt END, ', ' ORDER BY key, pos)
  AS resource_text FROM srat GROUP BY 1, 2) a USING (payload_id, rp_idx)
JOIN (SELECT payload_id, rp_idx, count(*) AS samples, CAST(sum(weight) AS BIGINT) AS weight FROM spl GROUP BY 1, 2) b USING (payload_id, rp_idx)""")
oracle("split_samples", f"SELECT {SID}, stack_index, {_list_text('rest')} AS attributes FROM spl")


def interning(prefix: str, attributes: str) -> None:
    """CTE <prefix>_int(payload_id, value, idx, is_new)."""
    cte(f"{prefix}_want", f"""
SELECT payload_id, value, min(seen) AS seen FROM (
  SELECT payload_id, txt AS value, [rp_idx, pos, 0] AS seen FROM {attributes} WHERE kind = 'string'
  UNION ALL SELECT payload_id, key, [rp_idx, pos, 1] FROM {attributes}) x GROUP BY 1, 2""")
    cte(f"{prefix}_int", f"""
SELECT w.payload_id, w.value, CAST(coalesce(s.idx, n - 1 + row_number() OVER (PARTITION BY w.payload_id, s.idx IS NULL ORDER BY seen)) AS INT) AS idx,
  CASE WHEN s.idx IS NULL THEN 1 ELSE 0 END AS is_new
FROM {prefix}_want w JOIN (SELECT payload_id, count(*) AS n FROM str GROUP BY 1) c ON c.payload_id = w.payload_id
LEFT JOIN (SELECT payload_id, value, min(idx) AS idx FROM str GROUP BY 1, 2) s ON s.payload_id = w.payload_id AND s.value = w.value""")


interning("bi", "rat")
oracle("intern_resource_strings", "SELECT payload_id, value, idx, is_new FROM bi_int")
interning("si", "srat")
cte("drat", """
SELECT a.payload_id, a.rp_idx, a.pos, k.idx AS key_ref, a.kind, a.txt, x.idx AS s_ref
FROM srat a JOIN si_int k ON k.payload_id = a.payload_id AND k.value = a.key
LEFT JOIN si_int x ON x.payload_id = a.payload_id AND x.value = a.txt AND a.kind = 'string'""")
oracle("resource_attr_dict", """
SELECT payload_id, rp_idx, pos, '' AS key, key_ref, CASE WHEN kind = 'string' THEN 'string_ref' ELSE kind END AS kind, s_ref FROM drat""")
cte("sprf", f"SELECT DISTINCT {ID} FROM spl")
cte("ssps", """
SELECT x.payload_id, x.rp_idx, x.sp_idx, greatest(n_profiles, last_p + 1) AS n_profiles
FROM (SELECT payload_id, rp_idx, sp_idx, max(p_idx) AS last_p FROM spl GROUP BY ALL) x
JOIN srp g ON g.payload_id = x.payload_id AND g.rp_idx = x.rp_idx
JOIN sps s ON s.payload_id = x.payload_id AND s.rp_idx = g.old_rp AND s.sp_idx = x.sp_idx""")
cte("split_kv", f"SELECT payload_id, rp_idx, {text('key')} + {fr('w')} AS content FROM (SELECT *, {_wire('kind', 'txt')} AS w FROM srat) x")
cte("dict_kv", f"""
SELECT payload_id, rp_idx, {sc('key_ref')} + {fr('w')} AS content FROM (
  SELECT *, CASE WHEN kind = 'string' THEN 1 + {v('s_ref')} ELSE {_wire('kind', "CASE WHEN kind = 'int' THEN txt ELSE '0' END")} END AS w FROM drat) x""")
for _prefix, _kv in (("split", "split_kv"), ("dict", "dict_kv")):
    sized(_prefix, _samples_source("spl", "rest"), _PROFILE_SOURCE + "sprf", "SELECT * FROM ssps", "SELECT * FROM srp", f"SELECT * FROM {_kv}")
cte("newstr", f"SELECT payload_id, sum({fr('strlen(value)')}) AS extra FROM si_int WHERE is_new = 1 GROUP BY 1")
cte("encs", f"""
SELECT payload_id, 'baseline' AS encoding, resource_profiles_proto_bytes + {fr('dict_bytes')} AS n FROM base_tree JOIN dtab USING (payload_id)
UNION ALL SELECT payload_id, 'split-by-process', resource_profiles_proto_bytes + {fr('dict_bytes')} FROM split_tree JOIN dtab USING (payload_id)
UNION ALL SELECT payload_id, 'resource-attr-dict', resource_profiles_proto_bytes + {fr('(dict_bytes + coalesce(extra, 0))')}
  FROM dict_tree JOIN dtab USING (payload_id) LEFT JOIN newstr USING (payload_id)""")
oracle("encoding_summary", f"""
SELECT 'supplier-' || payload_id AS file, encoding, count(*) AS payloads, {big('sum(n)', 'uncompressed_bytes')} FROM encs GROUP BY 1, 2""")
cte("encsum", """
SELECT 'supplier-' || payload_id AS file, encoding, count(*) AS payloads, sum(n) AS nb,
  CASE encoding WHEN 'baseline' THEN 0 WHEN 'split-by-process' THEN 1 ELSE 2 END AS place FROM encs GROUP BY payload_id, encoding""")
oracle("sink_encoding_summary", """
SELECT 0 AS line_no, 'file,encoding,payloads,uncompressed_bytes' AS line
UNION ALL SELECT CAST(row_number() OVER (ORDER BY file, place) AS INT), file || ',' || encoding || ',' || payloads || ',' || CAST(nb AS BIGINT) FROM encsum""")
oracle("encoding_gain", """
SELECT 'supplier-' || payload_id AS file, round(100.0 * (1 - max(n) FILTER (WHERE encoding = 'resource-attr-dict')::DOUBLE
  / max(n) FILTER (WHERE encoding = 'split-by-process')::DOUBLE), 6) AS uncompressed_gain_pct FROM encs GROUP BY payload_id""")

# --- size study ----------------------------------------------------------------------------------

_primary = "CASE " + " ".join(
    "WHEN " + " AND ".join(f"coalesce({c}, '-inf'::DOUBLE) >= coalesce({o}, '-inf'::DOUBLE)" for o in FRACTION_COLUMNS if o != c)
    + f" THEN '{c.removesuffix('_fraction')}'" for c in FRACTION_COLUMNS) + " END"
cte("der", f"""
SELECT *, uncompressed_bytes / 1048576.0::DOUBLE AS uncompressed_mib, uncompressed_bytes::DOUBLE / samples_count AS mean_bytes_per_sample,
  samples_count::DOUBLE / 20.0::DOUBLE / duration_sec AS mean_cpu_usage_cores,
  resource_profiles_attrs_count::DOUBLE / resource_profiles_count AS mean_attrs_per_resource,
  samples_count::DOUBLE / dict_stacks_count AS mean_samples_per_stack, {_primary} AS primary_language FROM stat""")
cte("ups", """
SELECT *, mean_bytes_per_sample * 76800.0::DOUBLE AS upscaled_bytes, mean_bytes_per_sample * 76800.0::DOUBLE / 1048576.0::DOUBLE AS upscaled_mib FROM der""")
_DIGITS = {"uncompressed_mib": 9, "mean_bytes_per_sample": 6, "mean_cpu_usage_cores": 15, "mean_attrs_per_resource": 9, "mean_samples_per_stack": 9}
oracle("derived_metrics", "SELECT id, " + ", ".join(f"round({n}, {d}) AS {n}" for n, d in _DIGITS.items()) + " FROM ups")
oracle("primary_language", "SELECT id, primary_language FROM ups")
oracle("upscaled_sizes", "SELECT id, round(upscaled_bytes, 3) AS upscaled_bytes, round(upscaled_mib, 6) AS upscaled_mib FROM ups")
oracle("scatter_points", f"""
SELECT id, {', '.join(f'round({n}, {d}) AS {n}' for n, d in _DIGITS.items())}, samples_count, duration_sec, dict_string_bytes, primary_language FROM ups""")


def nearest_of(metric: str, q: str) -> str:
    return (f"(SELECT x FROM (SELECT {metric} AS x, row_number() OVER (ORDER BY {metric}) - 1 AS r, count(*) OVER () AS n FROM ups"
            f" WHERE {metric} IS NOT NULL) y WHERE r = CAST(round((n - 1)::DOUBLE * {q}::DOUBLE) AS BIGINT))")


def summary_sql(metric: str) -> str:
    return (f"SELECT '{metric}' AS metric, round(median({metric}), 6) AS median, round(avg({metric}), 6) AS mean, "
            f"round({nearest_of(metric, '0.99')}, 6) AS q99, round({nearest_of(metric, '0.999')}, 6) AS q99_9, round(max({metric}), 6) AS max FROM ups")


def label(name: str, value: str, unit: str) -> str:
    return f"'{name}: ' || format('{{:,.2f}}', {value}) || '{unit}'"


for _metric in METRICS:
    oracle(f"summary_{_metric}", summary_sql(_metric))
    _unit = " MiB" if _metric.endswith("_mib") else ""
    _values = {"Median": f"(SELECT median({_metric}) FROM ups)", "Mean": f"(SELECT avg({_metric}) FROM ups)",
               "p99": nearest_of(_metric, "0.99"), "p99.9": nearest_of(_metric, "0.999"), "Max": f"(SELECT max({_metric}) FROM ups)"}
    oracle(f"reference_lines_{_metric}", " UNION ALL ".join(
        f"SELECT '{_metric}' AS metric, '{n}' AS statistic, round({e}, 6) AS value, {label(n, e, _unit)} AS label" for n, e in _values.items()))
    _bins = MAX_BINS[_metric]
    _level = 2
    oracle(f"histogram_{_metric}", f"""
SELECT round(b * step, 6) AS bin_start, round((b + 1) * step, 6) AS bin_end, count(*) AS n FROM (
  SELECT CAST(floor(x / step) AS BIGINT) AS b, step FROM (SELECT {_metric} AS x FROM ups WHERE {_metric} IS NOT NULL) d, (
    SELECT CASE WHEN span / (s2 / 2.0::DOUBLE) <= {_bins} THEN s2 / 2.0::DOUBLE ELSE s2 END AS step FROM (
      SELECT span, CASE WHEN span / (s1 / 5.0::DOUBLE) <= {_bins} THEN s1 / 5.0::DOUBLE ELSE s1 END AS s2 FROM (
        SELECT span, CASE WHEN ceil(span / s0) <= {_bins} THEN s0 WHEN ceil(span / (s0 * 10)) <= {_bins} THEN s0 * 10 ELSE s0 * 100 END AS s1 FROM (
          SELECT span, pow(10.0::DOUBLE, floor(log10(span) + 0.5) - {_level}) AS s0 FROM (
            SELECT CASE WHEN max({_metric}) > min({_metric}) THEN max({_metric}) - min({_metric}) WHEN min({_metric}) <> 0 THEN abs(min({_metric})) ELSE 1.0 END AS span FROM ups) a) b) c) e) f) g
GROUP BY b, step""")
cte("ranked", "SELECT upscaled_mib AS x, row_number() OVER (ORDER BY upscaled_mib) - 1 AS r, count(*) OVER () AS n FROM ups")
oracle("percentile_table", """
SELECT CAST(p AS INT) AS percentile, round(x, 6) AS upscaled_mib FROM (SELECT unnest(range(101)) AS p) q
JOIN ranked ON r = CAST(round((n - 1)::DOUBLE * (p / 100.0::DOUBLE)) AS BIGINT)""")
oracle("sketch_percentiles", """
SELECT CAST(p AS INT) AS percentile, n, round(x, 6) AS value FROM (SELECT unnest(range(101)) AS p) q
JOIN ranked ON r = greatest(0, CAST(ceil(n * p / 100.0::DOUBLE) AS BIGINT) - 1)""")
_limit = nearest_of("upscaled_bytes", "0.99")
cte("lim", f"SELECT {_limit} AS size_limit")
cte("rec", "SELECT size_limit, CAST(pow(2, length(bin(CAST(floor(size_limit) AS BIGINT) - 1))) AS BIGINT) AS recommended_limit FROM lim")
oracle("recommended_limit", "SELECT round(size_limit, 3) AS size_limit, recommended_limit FROM rec")
oracle("over_limit_share", """
SELECT recommended_limit, round(avg((upscaled_bytes > recommended_limit)::INT), 9) AS over_limit_share FROM ups, rec GROUP BY 1""")
cte("mean_xy", """SELECT avg(uncompressed_mib) AS mx, avg(mean_cpu_usage_cores) AS my, min(uncompressed_mib) AS lo, max(uncompressed_mib) AS hi FROM ups""")
cte("fit", """
SELECT slope, my - slope * mx AS intercept, lo, hi FROM (
  SELECT sum((uncompressed_mib - mx) * (mean_cpu_usage_cores - my)) / sum((uncompressed_mib - mx) * (uncompressed_mib - mx)) AS slope FROM ups, mean_xy) s, mean_xy""")
oracle("cpu_vs_size_fit", """
SELECT round(slope, 12) AS slope, round(intercept, 12) AS intercept, round(lo, 12) AS x_min, round(hi, 12) AS x_max,
  round(intercept + slope * lo, 12) AS y_at_min, round(intercept + slope * hi, 12) AS y_at_max FROM fit""")
oracle("cpu_vs_size_line", """
SELECT round(lo, 12) AS uncompressed_mib, round(intercept + slope * lo, 12) AS mean_cpu_usage_cores FROM fit
UNION ALL SELECT round(hi, 12), round(intercept + slope * hi, 12) FROM fit""")
_numeric = [n for n, _ in STATS_COLUMNS if n not in ("uncompressed_bytes", "start_ts", "end_ts")] + [
    "uncompressed_mib", "mean_cpu_usage_cores", "mean_attrs_per_resource", "mean_samples_per_stack"]
_corr = ", ".join(
    f"{{'c': '{n}', 'r': covar_pop(mean_bytes_per_sample, {n}::DOUBLE) / nullif(stddev_pop(mean_bytes_per_sample) FILTER (WHERE {n} IS NOT NULL)"
    f" * stddev_pop({n}::DOUBLE) FILTER (WHERE mean_bytes_per_sample IS NOT NULL), 0)}}" for n in _numeric)
oracle("correlation_ranking", f"""
SELECT x.c AS "column", round(x.r, 6) AS pearson_correlation, round(abs(x.r), 6) AS absolute_correlation
FROM (SELECT unnest([{_corr}]) AS x FROM der) y WHERE x.r IS NOT NULL AND isfinite(x.r)""")
_shares = " UNION ALL ".join(
    f"SELECT '{c.removesuffix('_fraction')}' AS language, sum(coalesce({c}, 0) * sampled_stack_frames_count) AS n FROM stat" for c in FRACTION_COLUMNS)
cte("share", _shares)
oracle("language_share", """
SELECT language, round(n, 6) AS stack_frame_count, round(100.0 * n / (SELECT sum(n) FROM share), 6) AS stack_frame_percentage FROM share""")
cte("symshare", " UNION ALL ".join(
    f"SELECT '{c.removesuffix('_fraction')}' AS language, sum(coalesce({c}, 0) * sampled_stack_frames_count) AS n, "
    f"sum(coalesce({s}, 0) * coalesce({c}, 0) * sampled_stack_frames_count) AS m FROM stat" for c, s in zip(FRACTION_COLUMNS, SYMBOL_FRACTION_COLUMNS)))
oracle("symbolized_share", """
SELECT language, round(n, 6) AS stack_frame_count, round(m, 6) AS symbolized_stack_frame_count,
  round(100.0 * m / n, 6) AS symbolized_stack_frame_percentage FROM symshare WHERE n > 0""")
oracle("dataset_profile", f"""
SELECT count(*) AS profiles, count(DISTINCT host_id) AS hosts, round({nearest_of('uncompressed_mib', '0.99')}, 9) AS p99_uncompressed_mib,
  round(max(mean_cpu_usage_cores), 15) AS max_cpu_usage_cores FROM ups""")
cte("hours", """
SELECT DISTINCT (epoch_us(ts) // 1000000 - (SELECT min(epoch_us(ts) // 1000000) FROM events)) // 3600 AS "time" FROM events""")
cte("curve", """
SELECT CAST("time" AS BIGINT) AS "time", 24.0::DOUBLE * ln(1 + "time"::DOUBLE) AS dictionary_size, 1.8::DOUBLE * "time" AS sample_size,
  24.0::DOUBLE / (1 + "time") AS dictionary_data_rate, 1.8::DOUBLE AS sample_data_rate,
  CASE WHEN "time" <= 50 THEN 'dictionary-bound' ELSE 'sample-bound' END AS region
FROM hours""")
oracle("amortization_curve", """
SELECT "time", round(dictionary_size, 9) AS dictionary_size, round(sample_size, 9) AS sample_size, round(dictionary_data_rate, 9) AS dictionary_data_rate,
  round(sample_data_rate, 9) AS sample_data_rate, round(dictionary_size + sample_size, 9) AS size,
  round(dictionary_data_rate + sample_data_rate, 9) AS data_rate, region FROM curve""")
oracle("amortization_long", """
SELECT "time", 'dictionary_size' AS component, round(dictionary_size, 9) AS component_size, 'Dictionary Size' AS component_label FROM curve
UNION ALL SELECT "time", 'sample_size', round(sample_size, 9), 'Sample Size' FROM curve""")
oracle("amortization_rates", """
SELECT "time", 'dictionary_data_rate' AS component, round(dictionary_data_rate, 9) AS component_data_rate, 'Dictionary Data Rate' AS component_label FROM curve
UNION ALL SELECT "time", 'sample_data_rate', round(sample_data_rate, 9), 'Sample Data Rate' FROM curve""")

# --- sources -------------------------------------------------------------------------------------

cte("files", "SELECT *, printf('payload-%012d.bin', payload_id) AS file, resource_profiles_proto_bytes + dictionary_proto_bytes AS nb FROM mbytes")
oracle("src_payload_ids", f"SELECT row_number() OVER (ORDER BY file) AS id, file, {big('nb', 'length')} FROM files")
oracle("src_decode", f"SELECT tree.* EXCLUDE (payload_id), file, {big('nb', 'n_bytes')} FROM tree JOIN files USING (payload_id)")
oracle("src_framed", f"""
SELECT printf('frames-%09d.bin', payload_id // 4) AS file,
  CAST(row_number() OVER (PARTITION BY payload_id // 4 ORDER BY payload_id) - 1 AS INT) AS frame_no, {big('nb', 'n_bytes')},
  CAST(r AS INT) AS resources, '' AS error
FROM files JOIN (SELECT payload_id, count(*) AS r FROM rps GROUP BY 1) x USING (payload_id)""")

cte("allfound", " UNION ALL ".join(f"SELECT payload_id, rule FROM {c}" for c in (
    "c_tree", "c_stack", "c_ts", "c_keys", "c_shape", "c_dict", "c_dupstr", "c_dupmap", "c_orphan")))
cte("arrived", """
SELECT payload_id, host, row_number() OVER (ORDER BY NOT (payload_id % 7 IN (1, 3) OR payload_id % 14 = 0), payload_id) AS id FROM hosts""")
cte("arrived_hosts", """
SELECT host, row_number() OVER (ORDER BY first_id) AS host_id FROM (SELECT host, min(id) AS first_id FROM arrived WHERE host <> '' GROUP BY host) x""")
oracle("stream_ingest", """
SELECT a.id, file, coalesce(h.host_id, 0) AS host_id, samples_count, dict_strings_count, coalesce(n, 0) AS findings, coalesce(r, 0) AS rules
FROM arrived a JOIN files USING (payload_id) JOIN tree USING (payload_id) JOIN dcount USING (payload_id)
LEFT JOIN arrived_hosts h ON h.host = a.host
LEFT JOIN (SELECT payload_id, count(*) AS n, count(DISTINCT rule) AS r FROM allfound GROUP BY 1) f USING (payload_id)""")

# --- process contexts and windows ----------------------------------------------------------------

cte("snap", """
SELECT event_id, 'host-' || (user_id % 7) AS host, user_id AS pid, CASE WHEN event_id % 50 = 0 THEN 'BAD_SIGN' ELSE 'OTEL_CTX' END AS signature,
  CASE WHEN event_id % 60 = 0 THEN 1 ELSE 2 END AS version, event_type AS service_name,
  CASE WHEN event_type = 'error' THEN 0 ELSE epoch_us(ts) * 1000 END AS published_at_ns FROM events""")
_context_rules = [
    ("signature", "invalid signature", "signature <> 'OTEL_CTX'"), ("version", "invalid version", "version <> 2"),
    ("missing_key", "missing service.version", "event_id % 20 = 3"), ("repeated_key", "repeated service.name", "event_id % 25 = 4"),
    ("key_map", "attribute_key_map requires schema_version", "event_id % 40 = 7"),
]
oracle("context_findings", " UNION ALL ".join(
    f"SELECT host, pid, published_at_ns, '{r}' AS rule, '{m}' AS message FROM snap WHERE {w}" for r, m, w in _context_rules))
cte("curctx", """
SELECT host, pid, published_at_ns, signature, version, service_name FROM (
  SELECT *, row_number() OVER (PARTITION BY host, pid ORDER BY published_at_ns DESC) AS rn FROM snap WHERE published_at_ns > 0) x WHERE rn = 1""")
oracle("current_context", "SELECT * FROM curctx")
oracle("resource_context", """
SELECT g.payload_id, g.rp_idx, h.txt AS host, CAST(g.pid AS BIGINT) AS pid, c.service_name, c.published_at_ns
FROM srp g LEFT JOIN rat h ON h.payload_id = g.payload_id AND h.rp_idx = g.old_rp AND h.key = 'host.name'
LEFT JOIN curctx c ON c.host = h.txt AND c.pid = g.pid""")


def _windows(seconds: int) -> str:
    start = f"(epoch_us(ts) // 1000000) // {seconds} * {seconds}"
    return (f"SELECT CAST({start} AS BIGINT) AS window_start, user_id AS host, count(*) AS samples, count(DISTINCT event_type) AS stacks "
            f"FROM events GROUP BY 1, 2")


oracle("buffer_windows", _windows(3600))
oracle("buffer_size_curve", " UNION ALL ".join(
    f"SELECT CAST({s} AS BIGINT) AS buffer_seconds, count(*) AS windows, round(avg(samples), 6) AS mean_samples, round(avg(stacks), 6) AS mean_stacks, "
    f"round(sum(samples)::DOUBLE / sum(stacks), 6) AS samples_per_stack FROM ({_windows(s)}) w" for s in (60, 3600, 86400)))
oracle("stream_buffer_windows", _windows(3600))
