"""Typed answer values.

Answers and labels are JSON values of any type. They are carried as VARIANT
inside a stage and as canonical JSON text between stages (VARIANT cannot be
grouped or compared). These helpers render a VARIANT the way the reference's
Python code sees it: ``str(value)`` for text compares, ``float(value)`` for
numeric compares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker the reference uses for "no answer found" (fixed value).
PARSE_ERROR = "JSONParsingError"


def once(v: Column, body: Callable[[Column], Column]) -> Column:
    """``body(v)`` with ``v`` computed once, however often ``body`` uses it (inside a lambda every use counts)."""
    return F.get(F.transform(F.array(v), body), F.lit(0))


#: base type of a VARIANT's schema -> type tag; other types are objects
_KINDS = {"STRING": "string", "BIGINT": "integer", "INT": "integer", "SMALLINT": "integer", "TINYINT": "integer", "DECIMAL": "number",
          "DOUBLE": "number", "FLOAT": "number", "BOOLEAN": "boolean", "VOID": "null", "ARRAY": "array"}


def kind(v: Column) -> Column:
    """Coarse type tag of a VARIANT value: string, integer, number, boolean, null, array, object."""
    base = F.substring_index(F.substring_index(F.schema_of_variant(v), "(", 1), "<", 1)
    tags = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.when(v.isNotNull(), F.coalesce(F.try_element_at(tags, base), F.lit("object")))


def as_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def double_text(d: Column) -> Column:
    """Text of a double as Python prints it: plain from 1e-4 up to 1e16, else ``1e+16``."""
    s = d.cast("string")
    plain = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.regexp_extract(s, r"E-?(\d+)$", 1)
    science = F.concat(F.regexp_replace(F.regexp_extract(s, r"^(-?[\d.]+)E", 1), r"\.0$", ""),
                       F.when(s.contains("E-"), "e-").otherwise("e+"), F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power))
    return (F.when(F.abs(d) == float("inf"), F.when(d > 0, "inf").otherwise("-inf")).when(~s.contains("E"), s)
            .when(F.abs(d).between(1e-4, 9.999999999999998e15), plain).otherwise(science))


def py_float_text(v: Column) -> Column:
    """Text of a JSON number as Python prints the float (``900.0``, ``900.1``, ``1e-11``)."""
    d = F.try_variant_get(v, "$", "double")
    return F.when(d.isNotNull(), double_text(d)).otherwise(F.to_json(v))


def py_str(v: Column) -> Column:
    """``str(value)`` of the decoded JSON value, exact for scalars.

    Containers render as their JSON text (Python would print its repr).
    """
    def text(x: Column, k: Column) -> Column:
        return (F.when(k == "string", as_string(x))
                .when(k == "null", F.lit("None"))
                .when(k == "boolean", F.when(F.try_variant_get(x, "$", "boolean"), "True").otherwise("False"))
                .when(k == "number", py_float_text(x))
                .otherwise(F.to_json(x)))

    return once(v, lambda x: once(kind(x), lambda k: text(x, k)))


def py_float(v: Column) -> Column:
    """``float(value)`` as DECIMAL(38,10); NULL where Python raises."""
    k = kind(v)
    return (F.when(k == "string", text_to_decimal(as_string(v)))
            .when(k.isin("integer", "number"), F.try_variant_get(v, "$", "decimal(38,10)"))
            .when(k == "boolean", F.when(F.try_variant_get(v, "$", "boolean"), F.lit(1)).otherwise(F.lit(0))
                  .cast("decimal(38,10)")))


def py_double(v: Column) -> Column:
    """``float(value)`` as DOUBLE; NULL where Python raises, and for NaN, which equals nothing."""
    k = kind(v)
    d = (F.when(k == "string", F.trim(as_string(v)).try_cast("double"))
         .when(k.isin("integer", "number"), F.try_variant_get(v, "$", "double"))
         .when(k == "boolean", F.when(F.try_variant_get(v, "$", "boolean"), 1.0).otherwise(0.0)))
    return F.when(~F.isnan(d), d)


def text_to_decimal(s: Column) -> Column:
    """Tolerant numeric parse of text (``float(text)``), as DECIMAL(38,10)."""
    return F.trim(s).try_cast("decimal(38,10)")


def json_variant(text: Column) -> Column:
    """Parse JSON text into VARIANT; NULL when the text is not JSON."""
    return F.try_parse_json(text)


def field(v: Column, key: str) -> Column:
    """Field ``key`` of a VARIANT object as VARIANT (JSON null stays a variant null)."""
    return F.try_variant_get(v, "$['" + key.replace("'", "\\'") + "']", "variant")


def string_array(v: Column) -> Column:
    """Elements of a JSON array as strings (``str(x)`` per element); NULL if not an array."""
    arr = F.try_variant_get(v, "$", "array<variant>")
    return F.transform(arr, lambda e: py_str(e))
