"""JSON functions. JSON is kept as text, so keys keep their order."""

from __future__ import annotations

from ..errors import InvalidArgument
from ..types import is_array, is_struct
from .base import X, cast, fn, q, rejected

JSON_TYPES = {"BOOL": "boolean", "INT64": "bigint", "FLOAT64": "double", "STRING": "string", "FLOAT32": "float"}


def literal(x: X) -> str:
    """JSON text of a value; SQL NULL gives SQL NULL."""
    t = x.type
    if t == "JSON":
        return x.sql
    if t == "NULL":
        return "cast(null as string)"
    if t in ("INT64", "BOOL", "NUMERIC"):
        v = x.sql if t != "NUMERIC" else f"regexp_replace(regexp_replace(cast({x.sql} as string), '(\\\\.[0-9]*?)0+$', '$1'), '\\\\.$', '')"
        return f"cast({v} as string)"
    if t in ("FLOAT64", "FLOAT32"):
        v = f"cast({x.sql} as double)"
        return f"CASE WHEN isnan({v}) THEN '\"NaN\"' WHEN {v} = double('Infinity') THEN '\"Infinity\"' WHEN {v} = double('-Infinity') THEN '\"-Infinity\"' WHEN {v} = floor({v}) AND abs({v}) < 1e15D THEN cast(cast({v} as bigint) as string) ELSE cast({v} as string) END"
    if is_array(t):
        inner = literal(X("e", t[1]))
        return f"concat('[', array_join(transform({x.sql}, e -> coalesce({inner}, 'null')), ','), ']')"
    if is_struct(t):
        pairs = ", ',', ".join(f"{q(quoted(n or f'_{i}') + ':')}, coalesce({literal(X(f'{x.sql}.`{n or f"_{i}"}`', k))}, 'null')" for i, (n, k) in enumerate(t[1]))
        return f"IF({x.sql} IS NULL, NULL, concat('{{', {pairs or q('')}, '}}'))"
    text = {"BYTES": f"base64({x.sql})", "TIMESTAMP": f"date_format({x.sql}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"}.get(t, f"cast({x.sql} as string)")
    return f"regexp_extract(to_json(named_struct('v', {text})), '^\\\\{{\"v\":(.*)\\\\}}$', 1)" if t != "TIMESTAMP" else f"concat('\"', regexp_replace({text}, '\\\\.?0*Z$', 'Z'), '\"')"


def quoted(s: str) -> str:
    import json

    return json.dumps(s, ensure_ascii=False)


@fn("TO_JSON SAFE_TO_JSON", 1, 2)
def _to_json(c, a):
    return X(literal(a[0]), "JSON")


@fn("TO_JSON_STRING", 1, 2)
def _to_json_string(c, a):
    if a[0].type not in ("JSON", "NULL"):
        raise InvalidArgument("TO_JSON_STRING takes JSON")
    return X(f"{c.udf('json_compact')}({a[0].sql})", "STRING")


@fn("PARSE_JSON", 1, 2)
def _parse(c, a):
    ok = f"try_parse_json({a[0].sql}) IS NULL AND {a[0].sql} IS NOT NULL"
    return X(c.guard(ok, "invalid JSON", a[0].sql), "JSON")


def _path(a, at=1):
    return a[at].sql if len(a) > at else "'$'"


def _variant(x: X) -> str:
    return f"try_parse_json({x.sql})"


@fn("JSON_VALUE", 1, 2)
def _value(c, a):
    p = _path(a)
    node = f"try_variant_get({_variant(a[0])}, {p}, 'variant')"
    return X(f"CASE WHEN schema_of_variant({node}) LIKE 'ARRAY%' OR schema_of_variant({node}) LIKE 'OBJECT%' OR schema_of_variant({node}) LIKE 'STRUCT%' THEN NULL ELSE get_json_object({a[0].sql}, {p}) END", "STRING")


def _of(name, udf, out, least=1, most=None):
    fn(name, least, most)(lambda c, a: X(f"{c.udf(udf)}({', '.join(cast(x, 'STRING') if x.type == 'NULL' else x.sql for x in a)})", out))


@fn("JSON_QUERY", 1, 2)
def _query(c, a):
    return X(f"{c.udf('json_query')}({a[0].sql}, {_path(a)})", "JSON" if a[0].type == "JSON" else "STRING")


@fn("JSON_QUERY_ARRAY", 1, 2)
def _query_array(c, a):
    return X(f"{c.udf('json_query_array')}({a[0].sql}, {_path(a)})", ("ARRAY", "JSON" if a[0].type == "JSON" else "STRING"))


@fn("JSON_VALUE_ARRAY", 1, 2)
def _value_array(c, a):
    return X(f"{c.udf('json_value_array')}({a[0].sql}, {_path(a)})", ("ARRAY", "STRING"))


@fn("JSON_TYPE", 1)
def _type(c, a):
    s = f"schema_of_variant({_variant(a[0])})"
    return X(f"CASE WHEN {s} LIKE 'OBJECT%' OR {s} LIKE 'STRUCT%' THEN 'object' WHEN {s} LIKE 'ARRAY%' THEN 'array' WHEN {s} = 'STRING' THEN 'string' WHEN {s} = 'BOOLEAN' THEN 'boolean' WHEN {s} = 'VOID' THEN 'null' WHEN {s} IS NULL THEN NULL ELSE 'number' END", "STRING")


rejected("JSON_EXTRACT JSON_EXTRACT_SCALAR JSON_EXTRACT_ARRAY")


def _typed(name, kind, out, lax):
    def build(c, a):
        v = f"try_variant_get({_variant(a[0])}, '$', '{kind}')"
        if lax:
            return X(v, out)
        strict = f"try_variant_get({_variant(a[0])}, '$', 'variant')"
        shape = {"boolean": "= 'BOOLEAN'", "string": "= 'STRING'"}.get(kind)
        bad = f"{a[0].sql} IS NOT NULL AND ({v} IS NULL" + (f" OR schema_of_variant({strict}) NOT {shape.replace('= ', 'IN (') + ')'}" if shape else "") + ")"
        return X(c.guard(bad, f"JSON is no {name}", v), out)

    fn(("LAX_" if lax else "") + name, 1, 2)(build)


for _lax in (False, True):
    for _name, _kind, _out in (("BOOL", "boolean", "BOOL"), ("INT64", "bigint", "INT64"), ("INT32", "bigint", "INT64"), ("FLOAT64", "double", "FLOAT64"), ("FLOAT32", "double", "FLOAT64"), ("STRING", "string", "STRING")):
        _typed(_name, _kind, _out, _lax)


@fn("STRING", 1, 2)
def _string(c, a):
    if a[0].type in ("TIMESTAMP", "DATE", "DATETIME"):
        return X(c.text(a[0]), "STRING")
    v = f"try_variant_get({_variant(a[0])}, '$', 'string')"
    return X(c.guard(f"{a[0].sql} IS NOT NULL AND {v} IS NULL", "JSON is no STRING", v), "STRING")


for _name, _kind, _out in (("FLOAT64_ARRAY", "double", "FLOAT64"), ("FLOAT32_ARRAY", "float", "FLOAT32"), ("INT64_ARRAY", "bigint", "INT64"), ("BOOL_ARRAY", "boolean", "BOOL"), ("STRING_ARRAY", "string", "STRING")):

    def _array(c, a, kind=_kind, out=_out, name=_name):
        v = f"try_variant_get({_variant(a[0])}, '$', 'array<{kind}>')"
        return X(c.guard(f"{a[0].sql} IS NOT NULL AND {v} IS NULL", f"JSON is no {name}", v), ("ARRAY", out))

    fn(_name, 1, 2)(_array)


@fn("JSON_ARRAY", 0, 99)
def _json_array(c, a):
    return X("concat('[', " + ", ',', ".join(f"coalesce({literal(x)}, 'null')" for x in a) + (", " if a else "") + "']')", "JSON")


@fn("JSON_OBJECT", 0, 99)
def _json_object(c, a):
    if len(a) % 2:
        raise InvalidArgument("JSON_OBJECT takes pairs")
    pairs = [f"{literal(X(a[i].sql, 'STRING'))}, ':', coalesce({literal(a[i + 1])}, 'null')" for i in range(0, len(a), 2)]
    return X("concat('{', " + ", ',', ".join(pairs) + (", " if pairs else "") + "'}')", "JSON")


def _edit(name, udf, pairs):
    def build(c, a):
        rest = [literal(x) if i % 2 else x.sql for i, x in enumerate(a[1:])] if pairs else [x.sql if i == 0 else literal(x) for i, x in enumerate(a[1:])]
        if udf == "json_remove":
            rest = [x.sql for x in a[1:]]
        return X(f"{c.udf(udf)}({a[0].sql}, array({', '.join(f'coalesce({r}, {q("null")})' if udf != 'json_remove' else r for r in rest)}))", "JSON")

    fn(name, 1 if udf == "json_remove" else 3, 99)(build)


_edit("JSON_SET", "json_set", True)
_edit("JSON_ARRAY_APPEND", "json_append", False)
_edit("JSON_ARRAY_INSERT", "json_insert", True)
_edit("JSON_REMOVE", "json_remove", False)
_of("JSON_STRIP_NULLS", "json_strip", "JSON")
_of("JSON_CONTAINS", "json_contains", "BOOL", 2)


@fn("JSON_KEYS", 1, 2)
def _keys(c, a):
    return X(f"json_object_keys({a[0].sql})", ("ARRAY", "STRING"))
