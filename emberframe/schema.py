"""Column layouts of the normalized tables, the nested payload row and the statistics row."""

from __future__ import annotations

from pyspark.sql import types as T

# One attribute value.  ``kind`` is one of VALUE_KINDS or NULL (no value set).
# Arrays and key-value lists are kept as canonical JSON in ``nested_json`` and
# encoded in ``bytes``; their byte counts are taken while decoding.
VALUE_KINDS = ("string", "string_ref", "bool", "int", "double", "bytes", "array", "kvlist")
VALUE = (
    "struct<kind:string,s:string,s_ref:int,b:boolean,i:bigint,d:double,bytes:binary,"
    "nested_json:string,payload_bytes:bigint,wire_bytes:bigint>"
)
KEY_VALUE = f"struct<key:string,key_ref:int,value:{VALUE}>"
VALUE_TYPE = "struct<type_strindex:int,unit_strindex:int>"
ENTITY_REF = "struct<schema_url:string,type:string,id_keys:array<string>,description_keys:array<string>>"
LINE = "struct<function_index:int,line:bigint,column:bigint>"

SAMPLE = (
    "struct<stack_index:int,values:array<bigint>,attribute_indices:array<int>,"
    "link_index:int,timestamps:array<bigint>>"
)
PROFILE_FIELDS = (
    f"sample_type:{VALUE_TYPE},time_unix_nano:bigint,duration_nano:bigint,period_type:{VALUE_TYPE},"
    "period:bigint,profile_id:binary,dropped_attributes_count:bigint,original_payload_format:string,"
    "original_payload:binary,attribute_indices:array<int>"
)
SCOPE = (
    f"struct<present:boolean,name:string,version:string,attributes:array<{KEY_VALUE}>,"
    "dropped_attributes_count:bigint>"
)
RESOURCE = (
    f"struct<present:boolean,attributes:array<{KEY_VALUE}>,dropped_attributes_count:bigint,"
    f"entity_refs:array<{ENTITY_REF}>>"
)
DICTIONARY = (
    "struct<present:boolean,"
    "mappings:array<struct<memory_start:decimal(20,0),memory_limit:decimal(20,0),"
    "file_offset:decimal(20,0),filename_strindex:int,attribute_indices:array<int>>>,"
    f"locations:array<struct<mapping_index:int,address:decimal(20,0),lines:array<{LINE}>,"
    "attribute_indices:array<int>>>,"
    "functions:array<struct<name_strindex:int,system_name_strindex:int,filename_strindex:int,"
    "start_line:bigint>>,"
    "links:array<struct<trace_id:binary,span_id:binary>>,"
    "strings:array<string>,"
    f"attributes:array<struct<key_strindex:int,unit_strindex:int,value:{VALUE}>>,"
    "stacks:array<struct<location_indices:array<int>>>>"
)
PROFILE = f"struct<{PROFILE_FIELDS},samples:array<{SAMPLE}>>"
SCOPE_PROFILES = f"struct<scope:{SCOPE},schema_url:string,profiles:array<{PROFILE}>>"
RESOURCE_PROFILES = f"struct<resource:{RESOURCE},schema_url:string,scope_profiles:array<{SCOPE_PROFILES}>>"

# One row per decoded message.  ``error`` is set instead of the content when
# the bytes could not be decoded.
NESTED = (
    "payload_id bigint,path string,frame_no int,n_bytes bigint,"
    f"resource_profiles array<{RESOURCE_PROFILES}>,dictionary {DICTIONARY},error string"
)

PAYLOAD_ID = ["payload_id"]
RESOURCE_ID = ["payload_id", "rp_idx"]
SCOPE_ID = ["payload_id", "rp_idx", "sp_idx"]
PROFILE_ID = ["payload_id", "rp_idx", "sp_idx", "p_idx"]
SAMPLE_ID = ["payload_id", "rp_idx", "sp_idx", "p_idx", "s_idx"]

LANGUAGES = (
    "go", "native", "kernel", "java", "python", "javascript", "dotnet",
    "ruby", "php", "beam", "perl", "other", "unknown",
)

# Statistics columns name the last two languages after the frame type.
LANGUAGE_COLUMN = {name: name for name in LANGUAGES} | {
    "other": "other_frame_type",
    "unknown": "unknown_frame_type",
}
FRACTION_COLUMNS = [f"{LANGUAGE_COLUMN[name]}_fraction" for name in LANGUAGES]
SYMBOL_FRACTION_COLUMNS = [f"{LANGUAGE_COLUMN[name]}_symbol_fraction" for name in LANGUAGES]

DICTIONARY_TABLES = ("string", "mapping", "location", "function", "link", "attribute", "stack")
COUNT_NAMES = ("strings", "mappings", "locations", "functions", "links", "attributes", "stacks")

# The statistics row, in output order.
STATS_COLUMNS: list[tuple[str, str]] = [
    ("id", "bigint"), ("host_id", "bigint"),
    ("start_ts", "bigint"), ("end_ts", "bigint"), ("duration_sec", "double"),
    ("uncompressed_bytes", "bigint"),
    *[(name, "bigint") for name in (
        "resource_profiles_count", "resource_profiles_attrs_count", "scope_profiles_count",
        "scope_profiles_attrs_count", "profiles_count", "profiles_attrs_count", "samples_count",
        "values_count", "timestamps_count", "sample_attrs_count", "original_payloads_sum_bytes",
        "resource_profiles_proto_bytes", "dictionary_proto_bytes", "resource_messages_proto_bytes",
        "scope_messages_proto_bytes", "profile_messages_proto_bytes", "sample_messages_proto_bytes",
    )],
    *[(f"dict_{name}_count", "bigint") for name in COUNT_NAMES],
    *[(f"dict_{name}_table_proto_bytes", "bigint") for name in DICTIONARY_TABLES],
    *[(name, "bigint") for name in (
        "dict_string_bytes", "dict_string_max_bytes", "function_name_bytes", "function_name_max_bytes",
        "function_system_name_bytes", "function_filename_bytes", "mapping_filename_bytes",
        "dict_attribute_key_bytes", "dict_attribute_unit_bytes", "dict_attribute_value_bytes",
        "resource_attribute_key_bytes", "resource_attribute_value_bytes",
        "stack_locations_count", "max_stack_depth", "location_lines_count",
        "location_attribute_indices_count", "mapping_attribute_indices_count",
    )],
    *[(name, "double") for name in (
        "mean_stack_depth", "mean_lines_per_location", "mean_sample_attrs",
        "mean_timestamps_per_sample", "mean_values_per_sample",
    )],
    ("sampled_stack_frames_count", "bigint"),
    *[(name, "double") for name in FRACTION_COLUMNS],
    *[(name, "double") for name in SYMBOL_FRACTION_COLUMNS],
]


def ddl(text: str) -> T.DataType:
    """Parse a DDL type string without needing an active session."""
    return T.DataType.fromDDL(text)
