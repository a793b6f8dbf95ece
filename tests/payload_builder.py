"""Small hand-made payloads: plain dictionaries turned into messages and tables."""

from emberframe.sources import codec
from emberframe.sources.nested import flatten
from emberframe.sources.payloads import decode
from emberframe.session import stash
from pyspark.sql import functions as F


def fill(message, content):
    """Assign nested dict/list content to a message."""
    for name, value in content.items():
        if isinstance(value, list):
            target = getattr(message, name)
            for item in value:
                if isinstance(item, dict):
                    fill(target.add(), item)
                else:
                    target.append(item)
        elif isinstance(value, dict):
            child = getattr(message, name)
            child.SetInParent()
            fill(child, value)
        else:
            setattr(message, name, value)
    return message


def message(content) -> bytes:
    return fill(codec.message_classes()["Request"](), content).SerializeToString()


def dictionary(**tables):
    base = {"mappings": [{}], "locations": [{}], "functions": [{}], "links": [{}], "strings": [""], "attributes": [{}], "stacks": [{}]}
    return base | tables


def payload(profile=None, dict_tables=None, **other):
    """One resource, one scope, one profile over a zero dictionary."""
    profiles = [profile or {}]
    return {"resource_profiles": [{"scope_profiles": [{"profiles": profiles}]}], "dictionary": dictionary(**(dict_tables or {}))} | other


def tables_of(spark, *contents):
    """Decoded tables of messages; payload ids follow the argument order."""
    rows = [(f"f{i:03d}", bytearray(message(c) if isinstance(c, dict) else c)) for i, c in enumerate(contents)]
    files = spark.createDataFrame(rows, "path string, content binary")
    nested = decode(files, framed=False).withColumn("payload_id", F.substring("path", 2, 3).cast("bigint"))
    return flatten(stash(nested, "test")).stored("test")
