"""Mathematical, bit and trigonometric functions, and vector distances."""

from __future__ import annotations

from ..errors import InvalidArgument
from ..types import common, is_array
from .base import X, cast, fn, simple, unify

same = lambda t: t[0]
number = lambda t: common(list(t))


def dbl(x: X) -> str:
    return cast(x, "FLOAT64")


simple("ABS", "abs({0})", same)


@fn("MOD", 2)
def _mod(c, a):
    s, t = unify(a)
    return X(c.guard(f"{s[1]} = 0", "division by zero: MOD", f"({s[0]} % nullif({s[1]}, 0))" if c.safe else f"({s[0]} % {s[1]})"), t)


def _whole(name):
    # beyond 2**53 doubles are whole, and a cast to bigint would overflow
    return lambda c, a: X(f"IF(abs({dbl(a[0])}) < 9007199254740992D, cast({name}({dbl(a[0])}) as double), {dbl(a[0])})", "FLOAT64")


fn("CEIL CEILING", 1)(_whole("ceil"))
fn("FLOOR", 1)(_whole("floor"))


@fn("ROUND", 1, 2)
def _round(c, a):
    n = cast(a[1], "INT64") if len(a) > 1 else "0"
    if len(a) > 1 and not (a[1].lit or a[1].sql.lstrip("-").isdigit()):
        p = f"power(10D, {n})"
        return X(f"(signum({dbl(a[0])}) * floor(abs({dbl(a[0])}) * {p} + 0.5D) / {p})", "FLOAT64")
    return X(f"IF(abs({dbl(a[0])}) < 1e300D, cast(round({dbl(a[0])}, {a[1].lit[0] if len(a) > 1 and a[1].lit else a[1].sql if len(a) > 1 else 0}) as double), {dbl(a[0])})", "FLOAT64")


@fn("TRUNC", 1, 2)
def _trunc(c, a):
    p = f"power(10D, {dbl(a[1])})" if len(a) > 1 else "1D"
    v = dbl(a[0])
    return X(f"IF(abs({v}) * {p} < 9007199254740992D, signum({v}) * floor(abs({v}) * {p}) / {p}, {v})", "FLOAT64")


def _extreme(name):
    def build(c, a):
        s, t = unify(a)
        nulls = " OR ".join(f"{x} IS NULL" for x in s)
        body = f"{name}({', '.join(s)})" if len(s) > 1 else s[0]
        nan = f"WHEN {' OR '.join(f'isnan({x})' for x in s)} THEN double('NaN') " if t in ("FLOAT64", "FLOAT32") else ""
        return X(f"CASE WHEN {nulls} THEN NULL {nan}ELSE {body} END", t)

    return build


fn("GREATEST", 1, 99)(_extreme("greatest"))
fn("LEAST", 1, 99)(_extreme("least"))


@fn("SIGN", 1)
def _sign(c, a):
    return X(cast(X(f"signum({a[0].sql})", "FLOAT64" if a[0].type != "NUMERIC" else "?"), a[0].type), a[0].type)


@fn("DIV", 2)
def _div(c, a):
    s, t = unify(a)
    if t == "NUMERIC":
        body = f"cast(IF(({s[0]} / {s[1]}) < 0, ceil({s[0]} / {s[1]}), floor({s[0]} / {s[1]})) as decimal(38,9))"
    else:
        body = f"({s[0]} div {s[1]})"
    return X(c.guard(f"{s[1]} = 0", "division by zero: DIV", body), t)


@fn("IEEE_DIVIDE", 2)
def _ieee(c, a):
    x, y = dbl(a[0]), dbl(a[1])
    return X(f"CASE WHEN {y} = 0 THEN CASE WHEN {x} = 0 OR isnan({x}) THEN double('NaN') WHEN {x} > 0 THEN double('Infinity') ELSE double('-Infinity') END ELSE {x} / {y} END", "FLOAT64")


def _finite(out: str, *xs: str) -> str:
    """NULL where finite doubles gave an infinity."""
    return f"CASE WHEN abs({out}) = double('Infinity') AND {' AND '.join(f'abs({x}) < double(' + chr(39) + 'Infinity' + chr(39) + ')' for x in xs)} THEN NULL ELSE {out} END"


def _safe(name, op):
    def build(c, a):
        s, t = unify(a)
        if t == "INT64":
            return X(f"{name}({s[0]}, {s[1]})", t)
        if t == "NUMERIC":
            return X(f"try_cast(({s[0]} {op} {s[1]}) as decimal(38,9))", t)
        return X(_finite(f"({s[0]} {op} {s[1]})", *s), "FLOAT64")

    return build


fn("SAFE_ADD", 2)(_safe("try_add", "+"))
fn("SAFE_SUBTRACT", 2)(_safe("try_subtract", "-"))
fn("SAFE_MULTIPLY", 2)(_safe("try_multiply", "*"))


@fn("SAFE_NEGATE", 1)
def _negate(c, a):
    return X(f"try_subtract(0, {a[0].sql})" if a[0].type == "INT64" else f"(-{a[0].sql})", a[0].type)


@fn("SAFE_DIVIDE", 2)
def _safe_divide(c, a):
    s, t = unify(a)
    if t == "NUMERIC":
        return X(f"try_cast(try_divide({s[0]}, {s[1]}) as decimal(38,9))", t)
    x, y = dbl(a[0]), dbl(a[1])
    return X(f"CASE WHEN {y} = 0 THEN NULL ELSE {_finite(f'({x} / {y})', x, y)} END", "FLOAT64")


def checked(names: str, body: str, bad: str):
    """A function of doubles that raises where bad holds; {0} and {1} stand for its arguments."""

    def build(c, a):
        v = [dbl(x) for x in a]
        put = lambda s: s.replace("{0}", v[0]).replace("{1}", v[-1])
        return X(c.guard(put(bad), f"invalid argument of {names.split()[0]}", put(body)) if bad else put(body), "FLOAT64")

    two = 2 if "{1}" in body else 1
    fn(names, two)(build)


_INF = "double('Infinity')"
checked("SQRT", "sqrt({0})", "{0} < 0")
checked("POW POWER", "power({0}, {1})", "({0} < 0 AND {1} <> floor({1}) AND abs({1}) < 1e15D) OR ({0} = 0 AND {1} < 0)")
checked("EXP", "exp({0})", f"exp({{0}}) = {_INF} AND {{0}} < {_INF}")
checked("LN", "ln({0})", "{0} <= 0")
checked("LOG10", "log10({0})", "{0} <= 0")


@fn("LOG", 1, 2)
def _log(c, a):
    x = dbl(a[0])
    if len(a) == 1:
        return X(c.guard(f"{x} <= 0", "invalid argument of LOG", f"ln({x})"), "FLOAT64")
    b = dbl(a[1])
    return X(c.guard(f"{x} <= 0 OR {b} <= 0 OR {b} = 1", "invalid argument of LOG", f"log({b}, {x})"), "FLOAT64")


simple("IS_NAN", "CASE WHEN {0} IS NOT NULL THEN isnan({0}) END", "BOOL")
simple("IS_INF", "(abs({0}) = double('Infinity'))", "BOOL")
for name in ("SIN", "COS", "TAN"):
    checked(name, f"{name.lower()}({{0}})", "")
for name in ("ATAN", "TANH", "ASINH"):
    checked(name, f"{name.lower()}({{0}})", "")
for name in ("ASIN", "ACOS"):
    checked(name, f"{name.lower()}({{0}})", "abs({0}) > 1 AND NOT isnan({0})")
for name in ("SINH", "COSH"):
    checked(name, f"{name.lower()}({{0}})", f"abs({name.lower()}({{0}})) = {_INF} AND abs({{0}}) < {_INF}")
checked("ACOSH", "acosh({0})", "{0} < 1")
checked("ATANH", "atanh({0})", "abs({0}) >= 1 AND NOT isnan({0})")
checked("ATAN2", "atan2({0}, {1})", "")


@fn("BIT_COUNT", 1)
def _bit_count(c, a):
    if a[0].type == "BYTES":
        return X(f"cast(length(replace(conv_bits({a[0].sql}), '0', '')) as bigint)".replace("conv_bits", c.udf("bits")), "INT64")
    return X(f"cast(bit_count({a[0].sql}) as bigint)", "INT64")


@fn("BIT_REVERSE", 2)
def _bit_reverse(c, a):
    x = a[0].sql
    whole = f"cast(conv(reverse(lpad(bin({x}), 64, '0')), 2, -10) as bigint)"
    low = f"cast(conv(reverse(lpad(bin({x} & 9223372036854775807), 63, '0')), 2, 10) as bigint)"
    return X(f"IF({a[1].sql}, {low} | ({x} & (-9223372036854775807 - 1)), {whole})", "INT64")


def _vectors(c, a, body: str, zero: bool):
    for x in a[:2]:
        if x.type != "NULL" and not is_array(x.type):
            raise InvalidArgument("a distance needs two arrays")
    u, v = a[0].sql, a[1].sql
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (l, r) -> cast(l as double) * cast(r as double)), 0D, (s, e) -> s + e)"
    bad = f"size({u}) <> size({v}) OR exists({u}, e -> e IS NULL) OR exists({v}, e -> e IS NULL)"
    if zero:
        bad += f" OR {dot(u, u)} = 0 OR {dot(v, v)} = 0"
    body = body.replace("{uv}", dot(u, v)).replace("{uu}", dot(u, u)).replace("{vv}", dot(v, v)).replace("{u}", u).replace("{v}", v)
    return X(f"IF({u} IS NULL OR {v} IS NULL, NULL, {c.guard(bad, 'invalid vectors', body)})", "FLOAT64")


fn("COSINE_DISTANCE APPROX_COSINE_DISTANCE", 2, 3)(lambda c, a: _vectors(c, a, "1D - {uv} / (sqrt({uu}) * sqrt({vv}))", True))
fn("DOT_PRODUCT APPROX_DOT_PRODUCT", 2, 3)(lambda c, a: _vectors(c, a, "{uv}", False))
fn("EUCLIDEAN_DISTANCE APPROX_EUCLIDEAN_DISTANCE", 2, 3)(lambda c, a: _vectors(c, a, "sqrt(aggregate(zip_with({u}, {v}, (l, r) -> pow(cast(l as double) - cast(r as double), 2)), 0D, (s, e) -> s + e))", False))
