"""What the function modules share: typed SQL fragments and the registry."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..errors import InvalidArgument, NotFound, Unimplemented
from ..types import common, is_array, spark_type


@dataclass
class X:
    """A Spark SQL expression with its dialect type; lit holds the value of a literal in a tuple, part that of INTERVAL n part."""

    sql: str
    type: Any
    lit: tuple | None = None
    interval: tuple | None = None
    extra: dict = field(default_factory=dict)


REGISTRY: dict[str, tuple] = {}


def fn(names: str, least: int = 0, most: int | None = None):
    """Registers a builder (context, arguments) -> X under names."""

    def put(f):
        for n in names.split():
            REGISTRY[n] = (f, least, least if most is None else most)
        return f

    return put


def simple(names: str, template: str, out, least: int = 1, most: int | None = None):
    """A builtin as it is: {0}, {1}, ... stand for arguments, {*} for all; out is a type or a function of argument types."""

    def build(c, a):
        sql = template.replace("{*}", ", ".join(x.sql for x in a))
        for i, x in enumerate(a):
            sql = sql.replace("{%d}" % i, x.sql)
        return X(sql, out([x.type for x in a]) if callable(out) else out)

    for n in names.split():
        REGISTRY[n] = (build, least, least if most is None else most)


def rejected(names: str, message: str = "Unsupported built-in function"):
    def build(c, a):
        raise Unimplemented(message)

    for n in names.split():
        REGISTRY[n] = (build, 0, 99)


def q(text: str) -> str:
    """A Spark string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\0", "\\0") + "'"


def cast(x: X, t) -> str:
    """x as type t, implicitly."""
    if x.type == t or t == "NULL":
        return x.sql
    return f"cast({x.sql} as {spark_type(t)})"


def unify(xs: list[X]) -> tuple[list[str], Any]:
    t = common([x.type for x in xs])
    return [cast(x, t) for x in xs], t


def wants(x: X, *types: str, what: str = "argument") -> None:
    if x.type != "NULL" and x.type not in types:
        raise InvalidArgument(f"{what} has type {x.type}, not {' or '.join(types)}")


def array_of(x: X):
    if x.type == "NULL":
        return "NULL"
    if not is_array(x.type):
        raise InvalidArgument(f"an ARRAY is needed, not {x.type}")
    return x.type[1]


def call(c, name: str, args: list[X]) -> X:
    if name not in REGISTRY:
        raise NotFound(f"Function not found: {name}")
    f, least, most = REGISTRY[name]
    if not least <= len(args) <= most:
        raise InvalidArgument(f"{name} takes {least} to {most} arguments, not {len(args)}")
    return f(c, args)
