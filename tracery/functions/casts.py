"""Attribute types and casts of JSON values (VARIANT) to them; what can't be cast is NULL."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .times import parse_date

#: Attribute types with a column type of their own, and that column type.
COLUMN_TYPES = {
    "Array": "array<string>", "Boolean": "boolean", "DateTime": "timestamp", "ISO8601": "timestamp", "Integer": "bigint", "Number": "double",
    "Relationship": "string", "StructuredValue": "variant", "Text": "string", "geo:json": "string", "GeoProperty": "string",
    "geo:point": "string", "geo:line": "string", "geo:polygon": "string", "geo:box": "string",
}
_NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


#: Kinds of JSON values by the first letters of their VARIANT type.
_KINDS = {"BOOL": "boolean", "BIGI": "integer", "INT": "integer", "DECI": "number", "DOUB": "number", "FLOA": "number", "STRI": "text", "OBJE": "object", "ARRA": "array"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind(value: Column) -> Column:
    """What a JSON value is: boolean, integer, number, text, object, array; NULL for null or missing."""
    names = F.create_map(*[F.lit(x) for item in _KINDS.items() for x in item])
    return F.element_at(names, F.substring(F.schema_of_variant(value), 1, 4))


def json_path_get(value: Column, path: str, type_: str = "string") -> Column:
    """The value at a path of keys such as a.b, NULL where there is none."""
    return F.try_variant_get(value, "$." + path, type_)


def is_text_type(ngsi_type: Column) -> Column:
    """Text, no type, or a type without a column type of its own."""
    return ngsi_type.isNull() | (ngsi_type == "Text") | ~ngsi_type.isin(*COLUMN_TYPES)


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def cast_number(value: Column) -> Column:
    k, t = kind(value), _text(value)
    return F.when(k.isin("integer", "number"), F.try_variant_get(value, "$", "double")).when((k == "text") & (t.rlike(_NUMERIC) | (F.lower(F.trim(t)) == "nan")), t.try_cast("double"))


def cast_integer(value: Column) -> Column:
    k, t = kind(value), _text(value)
    text = F.when(t.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(t).try_cast("bigint")).when(t.rlike(_NUMERIC), t.try_cast("double").try_cast("bigint"))
    return F.when(k == "integer", F.try_variant_get(value, "$", "bigint")).when(k == "number", F.try_variant_get(value, "$", "double").try_cast("bigint")).when(k == "text", text)


def cast_datetime(value: Column) -> Column:
    return F.when(kind(value) == "text", parse_date(_text(value)))


def cast_ld_datetime(value: Column) -> Column:
    """A value of the form {"@type": "DateTime", "@value": iso}."""
    own = F.try_variant_get(value, "$['@value']", "string")
    return F.when(F.try_variant_get(value, "$['@type']", "string") == "DateTime", parse_date(own))


def cast_boolean(value: Column) -> Column:
    k, t = kind(value), F.lower(F.trim(_text(value)))
    return (
        F.when(k == "boolean", F.try_variant_get(value, "$", "boolean")).when((k == "text") & t.isin("true", "false"), t == "true")
        .when((k == "integer") & F.try_variant_get(value, "$", "bigint").isin(0, 1), F.try_variant_get(value, "$", "bigint") == 1)
    )


@F.pandas_udf(T.StringType())
def _nested_text(value: pd.Series) -> pd.Series:
    """Nested JSON as the text that Python prints for it."""
    return value.map(lambda v: None if v is None else repr(json.loads(v)))


def cast_text(value: Column, nested: str = "python") -> Column:
    """Text of anything; booleans are True and False. Objects and arrays are written as Python prints them, or
    with nested="json" as JSON; only the former needs a Python worker, and only for such rows."""
    k = kind(value)
    inner = F.to_json(value)
    if nested == "python":
        inner = _nested_text(F.when(k.isin("object", "array"), inner))
    return F.when(k == "boolean", F.initcap(_text(value))).when(k.isin("object", "array"), inner).otherwise(_text(value))


def cast_structured(value: Column) -> Column:
    """Objects as they are."""
    return F.when(kind(value) == "object", value)


def cast_array(value: Column) -> Column:
    """Lists as arrays of text; items other than text are JSON."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.when(kind(value) == "array", F.transform(items, lambda v: F.when(kind(v) == "text", _text(v)).otherwise(F.to_json(v))))


def cast_relationship(attr: Column) -> Column:
    """The value of a relationship, else its object."""
    return F.coalesce(F.try_variant_get(attr, "$.value", "string"), F.try_variant_get(attr, "$.object", "string"))


def infer_attr_type(attr: Column) -> Column:
    """The type of an attribute: the declared one unless that is Property or missing; then by value."""
    declared, value = F.try_variant_get(attr, "$.type", "string"), F.try_variant_get(attr, "$.value", "variant")
    return F.when(declared.isNotNull() & (declared != "Property"), declared).otherwise(infer_value_type(value))


def infer_value_type(value: Column) -> Column:
    """Array, StructuredValue, Boolean, Integer, Number, DateTime (ISO text or an LD date) or Text."""
    plain = {"array": "Array", "boolean": "Boolean", "integer": "Integer", "number": "Number"}

    def of(k: Column) -> Column:
        own = F.element_at(F.create_map(*[F.lit(x) for item in plain.items() for x in item]), k)
        other = F.when(k == "object", F.when(cast_ld_datetime(value).isNotNull(), "DateTime").otherwise("StructuredValue")).when((k == "text") & parse_date(_text(value)).isNotNull(), "DateTime")
        return F.coalesce(own, other, F.lit("Text"))

    return let(kind(value), of)


def infer_column_type(ngsi_type: Column, value: Column) -> Column:
    """The column type of an attribute: by its type where that has one, else by its value."""
    pairs = [F.lit(x) for item in COLUMN_TYPES.items() for x in item]
    own = F.element_at(F.create_map(*pairs), F.when(ngsi_type.isin(*COLUMN_TYPES), ngsi_type).otherwise(infer_value_type(value)))
    return F.when((ngsi_type == "StructuredValue") & (kind(value) == "array"), "array<string>").otherwise(own)


def cast_attribute(attr: Column, ngsi_type: str, nested: str = "json") -> Column:
    """The value of an attribute as the column type of ``ngsi_type``."""
    value = F.try_variant_get(attr, "$.value", "variant")
    casts = {
        "Number": cast_number, "Integer": cast_integer, "Boolean": cast_boolean, "Array": cast_array, "StructuredValue": cast_structured,
        "DateTime": lambda v: F.coalesce(cast_datetime(v), cast_ld_datetime(v)), "ISO8601": lambda v: F.coalesce(cast_datetime(v), cast_ld_datetime(v)),
        "Relationship": lambda v: cast_relationship(attr), "geo:json": F.to_json, "GeoProperty": F.to_json,
    }
    return casts.get(ngsi_type, lambda v: cast_text(v, nested))(value)
