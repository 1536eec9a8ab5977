"""Navigation and functional update of parsed values.

A VARIANT column is for reading, ordered JSON text for what depends on key order, and arrays or maps of
VARIANT for updates: columns can't be changed in place, so each update returns a new one. Nothing here
leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of VARIANT's own types by kind; numbers have several.
_KINDS = {"VOID": "null", "BOOLEAN": "bool", "STRING": "string", "DATE": "datetime", "TIMESTAMP": "datetime", "TIMESTAMP_NTZ": "datetime"}


def kind(v: Column) -> Column:
    """null, bool, number, string, datetime, array or object; null where there is no value at all."""
    schema = F.schema_of_variant(v)
    out = F.when(v.isNull(), None)
    for name, what in _KINDS.items():
        out = out.when(schema == name, what)
    return out.when(schema.startswith("ARRAY<"), "array").when(schema.startswith("OBJECT<"), "object").otherwise("number")


def is_kind(v: Column, what: str) -> Column:
    return kind(v) == what


def is_null(v: Column) -> Column:
    """The document's own null, not a missing value."""
    return F.is_variant_null(v)


def _as(v: Column, what: str, cast: str) -> Column:
    return F.when(is_kind(v, what), F.try_variant_get(v, "$", cast))


def as_bool(v: Column) -> Column:
    return _as(v, "bool", "boolean")


def as_number(v: Column) -> Column:
    """The number as a double; text that looks like one stays text."""
    return _as(v, "number", "double")


def as_string(v: Column) -> Column:
    return _as(v, "string", "string")


def as_array(v: Column) -> Column:
    return _as(v, "array", "array<variant>")


def as_object(v: Column) -> Column:
    """A map; keys in VARIANT's own order."""
    return _as(v, "object", "map<string, variant>")


def as_datetime(v: Column) -> Column:
    """Text of a date or time, which JSON text has as a string."""
    text = as_string(v)
    return F.when(text.rlike(r"^(\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?|\d{2}:\d{2}:\d{2}(\.\d+)?)$"), text)


def datetime_parts(text: Column) -> Column:
    """STRUCT<kind, instant, local, day, time, zone> of a date or time's text; instants keep their offset in ``zone``."""
    zone = F.regexp_extract(text, r"(Z|[+-]\d{2}:\d{2})$", 1)
    kind_ = F.when(text.rlike(r"^\d{2}:"), "time").when(~text.rlike("[T ]"), "date").when(zone != "", "offset").otherwise("local")
    spaced = F.regexp_replace(text, " ", "T")
    return F.struct(
        kind_.alias("kind"), F.when(kind_ == "offset", F.try_to_timestamp(spaced)).alias("instant"), F.when(kind_ == "local", spaced.try_cast("timestamp_ntz")).alias("local"),
        F.when(kind_ == "date", text.try_cast("date")).alias("day"), F.when(kind_ == "time", text).alias("time"), F.when(kind_ == "offset", zone).alias("zone"),
    )


def _path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def get(v: Column, key: str) -> Column:
    """An object's member as VARIANT, null if it has none."""
    return F.try_variant_get(v, _path(key), "variant")


def at(v: Column, index: int) -> Column:
    """An array's element as VARIANT, null beyond its end."""
    return F.try_variant_get(v, f"$[{index}]", "variant")


def contains_key(json: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def keys(json: Column) -> Column:
    """Keys in the document's order; takes the ordered text."""
    return F.json_object_keys(json)


def values(v: Column, names: Column) -> Column:
    """Members of an object in the order of ``names``."""
    members = as_object(v)
    return F.transform(names, lambda k: members[k])


def items(v: Column) -> Column:
    """An array's elements; an empty array for anything else."""
    return F.coalesce(as_array(v), F.array().cast("array<variant>"))


def length(v: Column) -> Column:
    return F.when(is_kind(v, "array"), F.size(as_array(v))).when(is_kind(v, "object"), F.size(as_object(v)))


def is_empty(v: Column) -> Column:
    return length(v) == 0


# Updates of arrays (ARRAY<T>) and objects (MAP<STRING, T>); entries keep their order.


def push(items_: Column, value: Column) -> Column:
    return F.array_append(items_, value)


def pop(items_: Column) -> Column:
    """STRUCT<items, popped>."""
    n = F.size(items_)
    return F.struct(F.when(n > 0, F.slice(items_, 1, F.greatest(n - 1, F.lit(0)))).otherwise(items_).alias("items"), F.try_element_at(items_, F.lit(-1)).alias("popped"))


def insert_at(items_: Column, index: int, value: Column) -> Column:
    """``value`` before the element at ``index`` (from 0)."""
    return F.concat(F.slice(items_, 1, index), F.array(value), F.slice(items_, index + 1, F.greatest(F.size(items_) - index, F.lit(0))))


def remove_at(items_: Column, index: int) -> Column:
    return F.filter(items_, lambda _, i: i != index)


def clear(items_: Column) -> Column:
    return F.slice(items_, 1, 0)


def put(members: Column, key: Column, value: Column) -> Column:
    """A member set; one that was there keeps its place."""
    replaced = F.transform_values(members, lambda k, v: F.when(k == key, value).otherwise(v))
    return F.when(F.map_contains_key(members, key), replaced).otherwise(F.map_concat(members, F.create_map(key, value)))


def drop(members: Column, key: Column) -> Column:
    return F.map_filter(members, lambda k, _: k != key)


def array_of(*columns: Column) -> Column:
    """VARIANT array of scalars."""
    return F.array(*(c.cast("variant") for c in columns))


def object_of(**columns: Column) -> Column:
    """VARIANT object of named columns."""
    return F.to_variant_object(F.struct(*(c.alias(n) for n, c in columns.items())))
