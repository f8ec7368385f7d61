"""Types of the dialect and their Spark counterparts.

A type is a name (INT64, FLOAT64, FLOAT32, NUMERIC, STRING, BYTES, BOOL, DATE, TIMESTAMP, DATETIME for a timestamp without
zone, JSON, UUID, INTERVAL, TOKENLIST, NULL) or ("ARRAY", type) or ("STRUCT", [(name, type), ...]).
"""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import InvalidArgument

INTERVAL_SQL = "struct<months:int,days:int,nanos:bigint>"
TOKENLIST_SQL = "struct<kind:string,source:string,tokens:array<string>,nmin:int,nmax:int>"
# Spark's name of each type.
SPARK = {
    "INT64": "bigint", "INT32": "bigint", "FLOAT64": "double", "FLOAT32": "float", "NUMERIC": "decimal(38,9)", "BIGNUMERIC": "decimal(38,9)", "STRING": "string", "BYTES": "binary", "BOOL": "boolean", "DATE": "date",
    "TIMESTAMP": "timestamp", "DATETIME": "timestamp_ntz", "JSON": "string", "UUID": "string", "INTERVAL": INTERVAL_SQL, "TOKENLIST": TOKENLIST_SQL, "NULL": "void",
}
NUMBERS = ("INT64", "NUMERIC", "FLOAT32", "FLOAT64")


def spark_type(t) -> str:
    """Spark SQL's spelling of a type."""
    if isinstance(t, tuple):
        if t[0] == "ARRAY":
            return f"array<{spark_type(t[1])}>"
        return "struct<" + ",".join(f"`{n or f'_{i}'}`:{spark_type(x)}" for i, (n, x) in enumerate(t[1])) + ">"
    if t not in SPARK:
        return "binary" if "." in t else _unknown(t)
    return SPARK[t]


def _unknown(t):
    raise InvalidArgument(f"unknown type {t}")


def of_spark(d: T.DataType, logical: str | None = None):
    """The dialect's type of a Spark type; logical, from a column's metadata, tells JSON and the like from STRING."""
    if logical:
        return logical
    if isinstance(d, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "INT64"
    for kind, name in ((T.DoubleType, "FLOAT64"), (T.FloatType, "FLOAT32"), (T.DecimalType, "NUMERIC"), (T.StringType, "STRING"), (T.BinaryType, "BYTES"), (T.BooleanType, "BOOL"), (T.DateType, "DATE"), (T.TimestampNTZType, "DATETIME"), (T.TimestampType, "TIMESTAMP"), (T.NullType, "NULL")):
        if isinstance(d, kind):
            return name
    if isinstance(d, T.ArrayType):
        return ("ARRAY", of_spark(d.elementType))
    if isinstance(d, T.StructType):
        names = [f.name for f in d.fields]
        if names == ["months", "days", "nanos"]:
            return "INTERVAL"
        if names == ["kind", "source", "tokens", "nmin", "nmax"]:
            return "TOKENLIST"
        return ("STRUCT", [(f.name, of_spark(f.dataType)) for f in d.fields])
    raise InvalidArgument(f"unsupported Spark type {d}")


def is_array(t) -> bool:
    return isinstance(t, tuple) and t[0] == "ARRAY"


def is_struct(t) -> bool:
    return isinstance(t, tuple) and t[0] == "STRUCT"


def common(types: list):
    """The type that all of them coerce to."""
    found = None
    for t in types:
        if t == "NULL" or found == t:
            continue
        if found is None:
            found = t
        elif t in NUMBERS and found in NUMBERS:
            found = max(t, found, key=NUMBERS.index)
        elif {t, found} <= {"DATE", "TIMESTAMP", "DATETIME", "STRING", "JSON", "UUID"}:
            found = t if found == "STRING" else found if t == "STRING" else "TIMESTAMP" if "TIMESTAMP" in (t, found) else "DATETIME" if "DATETIME" in (t, found) else found
        elif is_array(t) and is_array(found):
            found = ("ARRAY", common([t[1], found[1]]))
        elif is_struct(t) and is_struct(found) and len(t[1]) == len(found[1]):
            found = ("STRUCT", [(a[0] or b[0], common([a[1], b[1]])) for a, b in zip(found[1], t[1], strict=True)])
        else:
            raise InvalidArgument(f"no common type of {found} and {t}")
    return found or "NULL"
