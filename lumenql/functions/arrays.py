"""Array functions."""

from __future__ import annotations

from ..errors import InvalidArgument
from ..types import common, is_array, spark_type
from .base import X, array_of, cast, fn, rejected, simple, unify

same = lambda t: t[0]
element = lambda t: t[0][1] if is_array(t[0]) else "NULL"
simple("ARRAY_LENGTH", "cast(array_size({0}) as bigint)", "INT64")


@fn("ARRAY_CONCAT", 1, 99)
def _concat(c, a):
    sql, t = unify(a)
    bad = " OR ".join(f"{x} IS NULL" for x in sql)
    return X(c.guard(bad, "NULL argument of ARRAY_CONCAT", f"concat({', '.join(sql)})"), t)


@fn("ARRAY_TO_STRING", 2, 3)
def _to_string(c, a):
    kind = array_of(a[0])
    if kind not in ("STRING", "BYTES", "NULL"):
        raise InvalidArgument("ARRAY_TO_STRING needs an array of STRING or BYTES")
    if kind == "BYTES":
        v = f"filter({a[0].sql}, e -> e IS NOT NULL)" if len(a) < 3 else f"transform({a[0].sql}, e -> coalesce(e, {a[2].sql}))"
        return X(f"unhex(array_join(transform({v}, e -> hex(e)), hex({a[1].sql})))", "BYTES")
    return X(f"array_join({', '.join(x.sql for x in a)})", "STRING")


simple("ARRAY_REVERSE", "reverse({0})", same)


@fn("GENERATE_ARRAY", 2, 3)
def _generate(c, a):
    step = a[2] if len(a) > 2 else X("1", "INT64")
    t = common([x.type for x in [*a, step]])
    x, y, s = (cast(v, t) for v in [*a[:2], step])
    bad = f"{s} = 0" + (f" OR isnan({x}) OR isnan({y}) OR isnan({s})" if t in ("FLOAT64", "FLOAT32") else "")
    values = f"sequence({x}, {y}, {s})" if t == "INT64" else f"transform(sequence(0, cast(floor(({y} - {x}) / {s}) as int)), i -> cast({x} + i * {s} as {spark_type(t)}))"
    body = f"IF(({s} > 0 AND {x} <= {y}) OR ({s} < 0 AND {x} >= {y}), {values}, cast(array() as array<{spark_type(t)}>))"
    return X(f"IF({x} IS NULL OR {y} IS NULL OR {s} IS NULL, NULL, {c.guard(bad, 'invalid step of GENERATE_ARRAY', body)})", ("ARRAY", t))


@fn("ARRAY_INCLUDES", 2)
def _includes(c, a):
    return X(f"IF({a[0].sql} IS NULL, NULL, coalesce(array_contains({a[0].sql}, {a[1].sql}), false))", "BOOL")


@fn("ARRAY_INCLUDES_ANY", 2)
def _any(c, a):
    return X(f"IF({a[0].sql} IS NULL OR {a[1].sql} IS NULL, NULL, size(array_intersect({a[0].sql}, {a[1].sql})) > 0)", "BOOL")


@fn("ARRAY_INCLUDES_ALL", 2)
def _all(c, a):
    return X(f"IF({a[0].sql} IS NULL OR {a[1].sql} IS NULL, NULL, size(array_except({a[1].sql}, {a[0].sql})) = 0)", "BOOL")


def _end(at):
    return lambda c, a: X(c.guard(f"size({a[0].sql}) = 0", "empty array", f"get({a[0].sql}, {at.format(a[0].sql)})"), array_of(a[0]))


fn("ARRAY_FIRST", 1)(_end("0"))
fn("ARRAY_LAST", 1)(_end("size({0}) - 1"))
simple("ARRAY_MIN", "array_min({0})", element)
simple("ARRAY_MAX", "array_max({0})", element)


@fn("ARRAY_SLICE", 3)
def _slice(c, a):
    v, n = a[0].sql, f"size({a[0].sql})"
    low, high = (f"IF({x.sql} < 0, {n} + {x.sql}, {x.sql})" for x in a[1:])
    start, stop = f"greatest({low}, 0)", f"least({high}, {n} - 1)"
    return X(f"IF({v} IS NULL OR {a[1].sql} IS NULL OR {a[2].sql} IS NULL, NULL, slice({v}, cast({start} + 1 as int), cast(greatest({stop} - {start} + 1, 0) as int)))", a[0].type)


@fn("ARRAY_FILTER", 1, 2)
def _filter(c, a):
    return X(f"filter({a[0].sql}, e -> e IS NOT NULL)", a[0].type)


@fn("ARRAY_TRANSFORM", 1, 2)
def _transform(c, a):
    return a[0]


simple("ARRAY_IS_DISTINCT", "(size(array_distinct({0})) = size({0}))", "BOOL")
rejected("ARRAY_SUM ARRAY_AVG", "Function not found")
