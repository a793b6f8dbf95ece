"""Language of a stack frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frame type -> language.  Native frames of a Go binary are "go";
# an empty type is "unknown"; any other type is "other".
FRAME_TYPE_LANGUAGE = {
    "kernel": "kernel",
    "jvm": "java",
    "cpython": "python",
    "v8js": "javascript",
    "dotnet": "dotnet",
    "ruby": "ruby",
    "php": "php",
    "beam": "beam",
    "perl": "perl",
    "": "unknown",
}

# Attribute keys that decide the language.
FRAME_TYPE_KEY = "profile.frame.type"
GO_BUILD_ID_KEY = "process.executable.build_id.go"


def frame_language(frame_type: Column, is_go: Column) -> Column:
    language = F.when(frame_type == "native", F.when(is_go, F.lit("go")).otherwise(F.lit("native")))
    for name, value in FRAME_TYPE_LANGUAGE.items():
        language = language.when(frame_type == name, F.lit(value))
    return language.otherwise(F.lit("other"))
