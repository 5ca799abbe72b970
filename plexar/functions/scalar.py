"""Scalar helpers: JSON paths, topics, safe names, hashes, float equality, type names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: SQL type names of the engine and the Spark types that stand for them.
SQL_TYPES = {
    "INT": "bigint", "INTEGER": "bigint", "SMALLINT": "bigint", "BIGINT": "bigint",
    "FLOAT": "double", "DOUBLE": "double", "REAL": "double", "DECIMAL": "decimal(38,18)", "NUMERIC": "decimal(38,18)",
    "TEXT": "string", "VARCHAR": "string", "STRING": "string", "CHAR": "string", "JSON": "string", "JSONB": "string", "UUID": "string",
    "BOOLEAN": "boolean", "BOOL": "boolean", "TIMESTAMP": "timestamp", "DATE": "date", "BLOB": "binary", "BYTEA": "binary", "BINARY": "binary",
    "VECTOR": "array<float>",
}


def spark_type(sql: str) -> str:
    """The Spark type of an engine type: VECTOR(n) is an array of float, DECIMAL(p,s) keeps its digits."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\(([^)]*)\))?\s*", sql)
    name = m[1].upper() if m else ""
    if name not in SQL_TYPES:
        raise ValueError(f"unsupported type: {sql}")
    if name in ("DECIMAL", "NUMERIC") and m[2]:
        return f"decimal({m[2]})"
    return SQL_TYPES[name]


def vector_dims(sql: str) -> int | None:
    m = re.fullmatch(r"(?i)\s*VECTOR\s*\(\s*(\d+)\s*\)\s*", sql)
    return int(m[1]) if m else None


def infer_sql_type(value: object) -> str:
    """The engine's name for the type of a Python value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "BOOLEAN"
    if isinstance(value, int):
        return "INTEGER"
    if isinstance(value, float):
        return "REAL"
    if isinstance(value, str):
        return "TEXT"
    if isinstance(value, bytes | bytearray):
        return "BLOB"
    if isinstance(value, list | tuple) and value and all(isinstance(x, int | float) and not isinstance(x, bool) for x in value):
        return "VECTOR"
    return "JSON"


def json_path(data: Column | str, path: str) -> Column:
    """The value at a dotted path of a JSON string, as string; null where missing."""
    return F.get_json_object(F.col(data) if isinstance(data, str) else data, "$." + path)


def topic_pattern(pattern: str, mode: str = "segment") -> str:
    """A topic pattern as a regular expression.

    segment: ``*`` is exactly one segment between slashes, ``**`` any number of them, none included. glob: ``*`` is
    any run of characters, slashes included.
    """
    if mode == "glob":
        return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"
    if mode != "segment":
        raise ValueError(f"unknown mode: {mode}")
    out, parts = "", pattern.split("/")
    for k, p in enumerate(parts):
        if p == "**":
            if len(parts) == 1:
                return "^.*$"
            out += "(?:/[^/]+)*" if k else "(?:[^/]+/)*"
        else:
            lead = "" if k == 0 or (k == 1 and parts[0] == "**") else "/"
            out += lead + ("[^/]+" if p == "*" else re.escape(p))
    return f"^{out}$"


def topic_match(topic: Column | str, pattern: str, mode: str = "segment") -> Column:
    """Whether a topic matches a pattern, see ``topic_pattern``."""
    return (F.col(topic) if isinstance(topic, str) else topic).rlike(topic_pattern(pattern, mode))


def near(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """Equality of floating-point values."""
    return F.abs(a - b) < eps


def bucket(cols: list[Column | str], n: int) -> Column:
    """A bucket of 0 to n - 1 by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def safe_name(name: str) -> str:
    """The name, unless it could carry more than a name into SQL."""
    if not name or any(x in name for x in (";", "--", "/*")):
        raise ValueError(f"unsafe column name: {name!r}")
    return name


def coerce(value: object, kind: T.DataType) -> object:
    """A Python value for a column: null passes, int widens to float and decimal, JSON, booleans and bytes become text
    for text columns, vectors must not be empty. Anything else raises TypeError."""
    import decimal
    import json

    if value is None:
        return None
    if isinstance(kind, T.BooleanType) and isinstance(value, bool):
        return value
    if isinstance(kind, T.LongType | T.IntegerType) and isinstance(value, int) and not isinstance(value, bool):
        return value
    if isinstance(kind, T.DoubleType | T.FloatType) and isinstance(value, int | float) and not isinstance(value, bool):
        return float(value)
    if isinstance(kind, T.DecimalType) and isinstance(value, int | float | decimal.Decimal) and not isinstance(value, bool):
        return decimal.Decimal(str(value))
    if isinstance(kind, T.StringType):
        if isinstance(value, str):
            return value
        if isinstance(value, bool):
            return "true" if value else "false"
        if isinstance(value, bytes | bytearray):
            return bytes(value).hex()
        if isinstance(value, dict | list):
            return json.dumps(value)
    if isinstance(kind, T.BinaryType) and isinstance(value, bytes | bytearray):
        return bytes(value)
    if isinstance(kind, T.ArrayType) and isinstance(value, list | tuple):
        if not value:
            raise TypeError("vector is empty")
        return [float(x) for x in value]
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType) and not isinstance(value, int | float | str | bool):
        return value
    raise TypeError(f"{value!r} does not fit {kind.simpleString()}")
