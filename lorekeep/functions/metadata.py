"""Search in JSON metadata. Every key can be looked for; values only as strings, by their JSON type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_key(metadata: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(metadata), key), F.lit(False))


def string_value(metadata: Column, key: str) -> Column:
    """The value of a key if it is a JSON string, else null: the number 3 is not the string "3"."""
    path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
    value = F.variant_get(F.try_parse_json(metadata), path, "variant")
    # in an array of one, that the text is parsed once
    return F.transform(F.array(value), lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string")))[0]


def has_value(metadata: Column, key: str, value: str) -> Column:
    return F.coalesce(string_value(metadata, key) == value, F.lit(False))
