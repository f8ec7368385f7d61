"""Binds a parsed query and writes it as Spark SQL; Catalyst does the rest."""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass, field
from typing import Any

from ..errors import InvalidArgument, NotFound, OutOfRange, Unimplemented
from ..functions import call, dates, jsons
from ..functions.base import X, cast, q, unify
from ..sql.parser import PARTS, N
from ..types import NUMBERS, common, is_array, is_struct, spark_type

AGGREGATES = frozenset("COUNT SUM AVG MIN MAX COUNTIF ANY_VALUE LOGICAL_AND LOGICAL_OR BIT_AND BIT_OR BIT_XOR STDDEV STDDEV_SAMP VARIANCE VAR_SAMP STRING_AGG ARRAY_AGG ARRAY_CONCAT_AGG APPROX_COUNT_DISTINCT".split())
WINDOWS = frozenset("ROW_NUMBER RANK DENSE_RANK NTILE LAG LEAD FIRST_VALUE LAST_VALUE NTH_VALUE PERCENT_RANK CUME_DIST".split())
FLOATS = ("FLOAT64", "FLOAT32")


def b(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Column:
    name: str
    type: Any
    sql: str
    hidden: bool = False


@dataclass
class Source:
    alias: str
    columns: list[Column]
    value: X | None = None  # an unnested element, which the alias itself stands for
    whole: bool = True
    merged: set = field(default_factory=set)  # columns that USING has merged into the left side's

    def find(self, name: str) -> Column | None:
        return next((x for x in self.columns if x.name.lower() == name.lower()), None)


@dataclass
class Scope:
    sources: list[Source] = field(default_factory=list)
    parent: Scope | None = None
    aliases: dict = field(default_factory=dict)

    def chain(self):
        x = self
        while x is not None:
            yield x
            x = x.parent


@dataclass
class Rel:
    sql: str
    columns: list[tuple[str, Any]]


def literal(v, t=None) -> X:
    """A value as a typed literal."""
    if isinstance(v, X):
        return v
    if v is None:
        return X(f"cast(null as {spark_type(t)})" if t and t != "NULL" else "NULL", t or "NULL", (None,))
    if isinstance(v, bool):
        return X("true" if v else "false", "BOOL", (v,))
    if isinstance(v, int):
        if not -(1 << 63) <= v < 1 << 63:
            raise OutOfRange(f"{v} is no INT64")
        return X(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)", "INT64", (v,))
    if isinstance(v, float):
        return X(f"double('{v}')" if v != v or abs(v) == float("inf") else f"{v!r}D", "FLOAT64", (v,))
    if isinstance(v, decimal.Decimal):
        return X(f"cast('{v}' as decimal(38,9))", "NUMERIC", (v,))
    if isinstance(v, str):
        return X(q(v), t or "STRING", (v,))
    if isinstance(v, (bytes, bytearray)):
        return X(f"X'{bytes(v).hex()}'", "BYTES", (bytes(v),))
    if isinstance(v, datetime.datetime):
        if v.tzinfo:
            return X(f"timestamp_micros({round(v.timestamp() * 10**6)}L)", "TIMESTAMP", (v,))
        return X(f"timestamp_ntz'{v.isoformat(' ')}'", "DATETIME", (v,))
    if isinstance(v, datetime.date):
        return X(f"date'{v.isoformat()}'", "DATE", (v,))
    if isinstance(v, (list, tuple)):
        items = [literal(x) for x in v]
        if not items:
            return X("array()", ("ARRAY", "NULL"))
        sql, k = unify(items)
        return X(f"array({', '.join(sql)})", ("ARRAY", k))
    if isinstance(v, dict):
        return X("named_struct(" + ", ".join(f"{q(k)}, {literal(x).sql}" for k, x in v.items()) + ")", ("STRUCT", [(k, literal(x).type) for k, x in v.items()]))
    raise InvalidArgument(f"cannot take {type(v).__name__} as a parameter")


class Compiler:
    """Compiles queries against a catalog. extended allows the window functions that the dialect rejects."""

    def __init__(self, catalog, params: dict | None = None, extended: bool = False):
        self.catalog, self.extended = catalog, extended
        self.params = {k.lower().lstrip("@"): v for k, v in (params or {}).items()}
        self.safe, self.named, self.count, self.many = False, {}, 0, False
        self.shown = False  # whether an expression's value is shown, rather than a condition
        self.ctes: dict[str, list[tuple[str, Any]]] = {}

    # for function builders
    def guard(self, bad: str, message: str, body: str) -> str:
        """body, but an error (NULL under SAFE.) where bad holds."""
        return f"IF({bad}, {'NULL' if self.safe else f'raise_error({q(message)})'}, {body})"

    def udf(self, name: str) -> str:
        return f"lq_safe_{name}" if self.safe else f"lq_{name}"

    def next_value(self, name: str) -> str:
        return self.catalog.next_value(name, self.many)

    def sequence_state(self, name: str) -> str:
        return self.catalog.sequence_state(name)

    def fresh(self) -> str:
        self.count += 1
        return f"__x{self.count}"

    def compare_sql(self, op: str, x: X, y: X) -> str:
        (l, r), t = unify([x, y])
        if is_array(t) or t in ("JSON", "TOKENLIST"):
            raise InvalidArgument(f"{t if isinstance(t, str) else 'ARRAY'} values cannot be compared")
        out = f"({l} {op} {r})"
        if t in FLOATS:
            may = [s for s, v in ((l, x), (r, y)) if v.type in FLOATS and not (v.lit and v.lit[0] == v.lit[0])]
            if may and op == "!=":
                return f"({out} OR isnan({may[0]}))"
            if may and op == "=":
                return f"({out} AND NOT isnan({may[0]}))" if len(may) == 2 else out
            for s in may:
                out += f" AND NOT isnan({s})"
            return f"({out})" if may else out
        return out

    def text(self, x: X) -> str:
        """x as STRING by the rules of CAST."""
        t = x.type
        if t in ("STRING", "JSON", "UUID"):
            return x.sql
        if t in FLOATS:
            v = cast(x, "FLOAT64") if t == "FLOAT64" else f"cast(cast({x.sql} as string) as double)"
            return f"CASE WHEN isnan({v}) THEN 'nan' WHEN {v} = double('Infinity') THEN 'inf' WHEN {v} = double('-Infinity') THEN '-inf' WHEN {v} = floor({v}) AND abs({v}) < 1e15D THEN cast(cast({v} as bigint) as string) ELSE replace(cast({v} as string), 'E', 'e') END"
        if t == "NUMERIC":
            return f"regexp_replace(regexp_replace(cast({x.sql} as string), '(\\\\.[0-9]*?)0+$', '$1'), '\\\\.$', '')"
        if t == "TIMESTAMP":
            wall = dates.local(x)
            micros = f"lpad(cast((unix_micros({wall}) % 1000000 + 1000000) % 1000000 as string), 6, '0')"
            hours = f"cast((unix_seconds({wall}) - unix_seconds({x.sql})) div 3600 as int)"
            return f"concat(date_format({wall}, 'yyyy-MM-dd HH:mm:ss'), IF({micros} = '000000', '', concat('.', regexp_replace({micros}, '0+$', ''))), IF({hours} < 0, '-', '+'), lpad(cast(abs({hours}) as string), 2, '0'))"
        if t == "INTERVAL":
            return dates.interval_text(x.sql)
        if is_array(t):
            return f"concat('[', array_join(transform({x.sql}, e -> coalesce({self.text(X('e', t[1]))}, 'NULL')), ', '), ']')"
        if is_struct(t):
            return "concat('(', " + ", ', ', ".join(f"coalesce({self.text(X(f'{x.sql}.{b(n or f"_{i}")}', k))}, 'NULL')" for i, (n, k) in enumerate(t[1])) + ", ')')"
        return f"cast({x.sql} as string)"

    def literal_text(self, x: X) -> str:
        """x as an SQL literal."""
        t = x.type
        quoted = lambda v: f"concat('\"', replace(replace({v}, '\\\\', '\\\\\\\\'), '\"', '\\\\\"'), '\"')"
        if t == "STRING":
            return quoted(x.sql)
        if t == "BYTES":
            return f"concat('b', {quoted(f'cast({x.sql} as string)')})"
        if t in ("DATE", "TIMESTAMP", "NUMERIC", "JSON"):
            return f"concat('{t} ', {quoted(self.text(x))})"
        if t in FLOATS:
            return f"CASE WHEN {x.sql} = floor({x.sql}) AND abs({x.sql}) < 1e15D THEN concat({self.text(x)}, '.0') ELSE {self.text(x)} END"
        if is_array(t):
            return f"concat('[', array_join(transform({x.sql}, e -> coalesce({self.literal_text(X('e', t[1]))}, 'NULL')), ', '), ']')"
        return self.text(x)

    # names
    def column(self, path: list[str], scope: Scope) -> X:
        first = path[0]
        for s in scope.chain():
            if len(path) > 1:
                for src in s.sources:
                    if src.alias and src.alias.lower() == first.lower():
                        if src.value is not None:
                            return self.fields(src.value, path[1:])
                        c = src.find(path[1])
                        if c is None:
                            raise NotFound(f"column {'.'.join(path)}")
                        return self.fields(X(c.sql, c.type), path[2:])
            hits = [c for src in s.sources if (c := src.find(first)) and not (first.lower() in src.merged)]
            if len(hits) > 1:
                raise InvalidArgument(f"column {first} is ambiguous")
            if hits:
                return self.fields(X(hits[0].sql, hits[0].type), path[1:])
            for src in s.sources:
                if src.alias and src.alias.lower() == first.lower():
                    if src.value is not None:
                        return src.value
                    if len(path) == 1:
                        cols = [c for c in src.columns if not c.hidden]
                        return X("named_struct(" + ", ".join(f"{q(c.name)}, {c.sql}" for c in cols) + ")", ("STRUCT", [(c.name, c.type) for c in cols]))
                if src.value is not None and is_struct(src.value.type) and any(n.lower() == first.lower() for n, _ in src.value.type[1]):
                    return self.fields(src.value, path)
            if first.lower() in s.aliases:
                node = s.aliases[first.lower()]
                held, s.aliases = s.aliases, {k: v for k, v in s.aliases.items() if k != first.lower()}
                try:
                    return self.fields(self.expr(node, s), path[1:])
                finally:
                    s.aliases = held
        raise NotFound(f"column {'.'.join(path)}")

    def fields(self, x: X, names: list[str]) -> X:
        for n in names:
            if x.type == "JSON":
                x = X(f"{self.udf('json_query')}({x.sql}, {q('$.' + n)})", "JSON")
                continue
            if not is_struct(x.type):
                raise InvalidArgument(f"{n} is no field of {x.type}")
            found = next(((k, t) for k, t in x.type[1] if k.lower() == n.lower()), None)
            if found is None:
                raise NotFound(f"field {n}")
            x = X(f"{x.sql}.{b(found[0])}", found[1])
        return x

    # expressions
    def expr(self, n: N, scope: Scope) -> X:
        return getattr(self, f"e_{n.kind}")(n, scope)

    def e_literal(self, n, scope):
        return literal(n.value)

    def e_param(self, n, scope):
        key = n.name.lower()
        if key not in self.params:
            raise InvalidArgument(f"no value for parameter @{n.name}")
        return literal(self.params[key])

    def e_column(self, n, scope):
        return self.column(n.path, scope)

    def e_typed(self, n, scope):
        v = X(q(n.value), "STRING", (n.value,))
        if n.type == "DATE":
            return X(f"date{q(n.value)}", "DATE", (datetime.date.fromisoformat(n.value.strip()[:10]),))
        if n.type == "TIMESTAMP":
            return X(dates.stamp(v).sql, "TIMESTAMP")
        if n.type == "DATETIME":
            return X(f"cast({v.sql} as timestamp_ntz)", "DATETIME")
        if n.type == "JSON":
            return X(v.sql, "JSON", v.lit)
        return X(f"cast({v.sql} as decimal(38,9))", "NUMERIC")

    def e_interval(self, n, scope):
        return dates.interval_literal(self.expr(n.n, scope), n.part)

    def e_binary(self, n, scope):
        return X(f"({self.expr(n.left, scope).sql} {n.op} {self.expr(n.right, scope).sql})", "BOOL")

    def e_not(self, n, scope):
        if n.arg.kind == "literal" and n.arg.value is None:
            raise InvalidArgument("NOT NULL")
        if n.arg.kind == "in_query":
            return X(self.e_in_query(n.arg, scope, "NOT ").sql, "BOOL")
        return X(f"(NOT {self.expr(n.arg, scope).sql})", "BOOL")

    def operands(self, *nodes, scope):
        xs = [self.expr(k, scope) for k in nodes]
        if any(k.kind == "literal" and k.value is None for k in nodes):
            raise InvalidArgument("a literal NULL cannot be compared")
        return xs

    def e_compare(self, n, scope):
        return X(self.compare_sql(n.op, *self.operands(n.left, n.right, scope=scope)), "BOOL")

    def e_between(self, n, scope):
        x, low, high = self.operands(n.arg, n.low, n.high, scope=scope)
        return X(f"({self.compare_sql('>=', x, low)} AND {self.compare_sql('<=', x, high)})", "BOOL")

    def e_is(self, n, scope):
        return X(f"({self.expr(n.arg, scope).sql} IS {'NOT ' if n.no else ''}{n.what})", "BOOL")

    def e_in(self, n, scope):
        x, items = self.expr(n.arg, scope), [self.expr(k, scope) for k in n.items]
        sql, t = unify([x, *items])
        if is_array(t):
            raise InvalidArgument("ARRAY values cannot be compared")
        out = f"({sql[0]} IN ({', '.join(sql[1:])}))"
        if t in FLOATS and x.type in FLOATS:
            nulls = " OR ".join(f"{s} IS NULL" for s in sql[1:])
            out = f"CASE WHEN isnan({sql[0]}) THEN IF({nulls}, NULL, false) ELSE {out} END"
        return X(out, "BOOL")

    def e_in_query(self, n, scope, no=""):
        x, rel = self.expr(n.arg, scope), self.query(n.query, scope)
        if len(rel.columns) != 1:
            raise InvalidArgument("an IN subquery has one column")
        t = common([x.type, rel.columns[0][1]])
        inner = rel.sql if rel.columns[0][1] == t else f"SELECT cast({b(rel.columns[0][0])} as {spark_type(t)}) FROM ({rel.sql})"
        one = f"({cast(x, t)} {no}IN ({inner}))"
        if not self.shown:
            return X(one, "BOOL")
        # a filter may take NULL for FALSE, a value that is shown may not
        k = self.fresh()
        held = f"SELECT * FROM ({inner}) AS {b(k)}(v)"
        return X(f"CASE WHEN {x.sql} IN ({inner}) THEN {'false' if no else 'true'} WHEN EXISTS ({held} WHERE v IS NULL) OR ({x.sql} IS NULL AND EXISTS ({held})) THEN NULL ELSE {'true' if no else 'false'} END", "BOOL")

    def e_in_unnest(self, n, scope):
        x, a = self.expr(n.arg, scope), self.expr(n.array, scope)
        return X(f"CASE WHEN {x.sql} IS NULL AND {a.sql} IS NOT NULL AND size({a.sql}) > 0 THEN NULL WHEN {a.sql} IS NULL THEN false ELSE array_contains({a.sql}, {cast(x, a.type[1]) if is_array(a.type) else x.sql}) END", "BOOL")

    def e_like(self, n, scope):
        x, p = self.operands(n.arg, n.pattern, scope=scope)
        if x.type == "BYTES":
            x, p = (X(f"cast({v.sql} as string)", "STRING") for v in (x, p))
        return X(f"({x.sql} LIKE {p.sql})", "BOOL")

    def e_arith(self, n, scope):
        l, r = self.expr(n.left, scope), self.expr(n.right, scope)
        if n.op == "||":
            sql, t = unify([l, r])
            return X(f"concat({', '.join(sql)})", "STRING" if t == "NULL" else t)
        if l.type == "DATE" and n.op in "+-" and r.type == "INT64":
            return X(f"date_add({l.sql}, cast({'-' if n.op == '-' else ''}{r.sql} as int))", "DATE")
        if r.type == "INTERVAL" and l.type in ("TIMESTAMP", "DATE", "DATETIME"):
            return self.shifted(l, r, n.op)
        for v in (l, r):
            if v.type not in (*NUMBERS, "NULL"):
                raise InvalidArgument(f"no operator {n.op} for {l.type} and {r.type}")
        (a, c), t = unify([l, r])
        if n.op == "/":
            if t in ("INT64", "NULL"):
                t, a, c = "FLOAT64", cast(l, "FLOAT64"), cast(r, "FLOAT64")
            if self.safe:
                return X(self.guard(f"{c} = 0", "", f"({a} / {c})"), t)
        if t == "INT64" and self.safe:
            return X(f"{ {'+': 'try_add', '-': 'try_subtract', '*': 'try_multiply'}[n.op] }({a}, {c})", t)
        if t == "NUMERIC":
            return X(f"cast(({a} {n.op} {c}) as decimal(38,9))", t)
        return X(f"({a} {n.op} {c})", t)

    def shifted(self, x: X, i: X, op: str) -> X:
        """x moved by an interval of months, days and nanoseconds."""
        s, v = ("" if op == "+" else "-"), i.sql
        wall = dates.local(x)
        out = f"timestamp_micros(unix_micros(cast(concat(cast(date_add(add_months(cast({wall} as date), {s}({v}.months)), {s}({v}.days)) as string), date_format({wall}, ' HH:mm:ss.SSSSSS')) as timestamp)) + {s}(({v}.nanos) div 1000))"
        return X(f"to_utc_timestamp({out}, {dates.ZONE})", "TIMESTAMP") if x.type == "TIMESTAMP" else X(f"cast({out} as timestamp_ntz)", "DATETIME")

    def e_negate(self, n, scope):
        x = self.expr(n.arg, scope)
        if x.type == "INTERVAL":
            return X(dates.interval(f"-{x.sql}.months", f"-{x.sql}.days", f"-{x.sql}.nanos"), "INTERVAL")
        return X(f"(-{x.sql})", x.type)

    def e_case(self, n, scope):
        subject = self.expr(n.subject, scope) if n.subject is not None else None
        values, t = unify([self.expr(v, scope) for _, v in n.arms] + ([self.expr(n.other, scope)] if n.other is not None else []))
        arms = []
        for (w, _), v in zip(n.arms, values, strict=False):
            c = self.expr(w, scope)
            arms.append(f"WHEN {c.sql if subject is None else self.compare_sql('=', subject, c)} THEN {v}")
        return X(f"CASE {' '.join(arms)}{f' ELSE {values[-1]}' if n.other is not None else ''} END", t)

    def e_array(self, n, scope):
        items = [self.expr(k, scope) for k in n.items]
        if any(is_array(x.type) for x in items):
            raise InvalidArgument("an ARRAY cannot hold ARRAY values")
        if n.type:
            return X(f"cast(array({', '.join(x.sql for x in items)}) as array<{spark_type(n.type)}>)", ("ARRAY", n.type))
        if not items:
            return X("array()", ("ARRAY", "NULL"))
        sql, t = unify(items)
        return X(f"array({', '.join(sql)})", ("ARRAY", t))

    def e_struct(self, n, scope):
        fields = []
        for i, (name, v) in enumerate(n.fields):
            x = self.expr(v, scope)
            if n.types:
                name, t = n.types[i][0] or name, n.types[i][1]
                x = X(cast(x, t), t)
            fields.append((name or f"_{i}", x))
        return X("named_struct(" + ", ".join(f"{q(k)}, {x.sql}" for k, x in fields) + ")", ("STRUCT", [(k, x.type) for k, x in fields]))

    def e_field(self, n, scope):
        return self.fields(self.expr(n.arg, scope), [n.name])

    def e_subscript(self, n, scope):
        a, i = self.expr(n.arg, scope), self.expr(n.index, scope)
        if a.type == "JSON":
            path = f"concat('$[', {i.sql}, ']')" if i.type == "INT64" else f"concat('$.', {i.sql})"
            return X(f"{self.udf('json_query')}({a.sql}, {path})", "JSON")
        if not is_array(a.type):
            raise InvalidArgument("a subscript needs an ARRAY")
        at = f"({i.sql} - 1)" if "ORDINAL" in n.mode else i.sql
        got = f"get({a.sql}, cast({at} as int))"
        if not n.mode.startswith("SAFE"):
            got = f"IF({a.sql} IS NULL OR {i.sql} IS NULL, NULL, {self.guard(f'{at} < 0 OR {at} >= size({a.sql})', 'array index is out of bounds', got)})"
        return X(got, a.type[1])

    def e_cast(self, n, scope):
        held, self.safe = self.safe, self.safe or n.safe
        try:
            return self.converted(self.expr(n.arg, scope), n.to)
        finally:
            self.safe = held

    def converted(self, x: X, t) -> X:
        f = "try_cast" if self.safe else "cast"
        s = x.sql
        if t == "INT32":
            t = "INT64"
        if x.type == t:
            return x
        if x.type == "NULL":
            return X(f"cast(null as {spark_type(t)})", t, (None,))
        if t == "INT64" and x.type in (*FLOATS, "NUMERIC"):
            return X(f"{f}(round({s}, 0) as bigint)" if x.type == "NUMERIC" else f"{f}(IF(abs({s}) < 4503599627370496D, signum({s}) * floor(abs({s}) + 0.5D), {s}) as bigint)", t)
        if t == "INT64" and x.type == "STRING":
            return X(f"IF(regexp_like({s}, '^[+-]?0[xX]'), {f}(concat(IF(startswith({s}, '-'), '-', ''), conv(regexp_replace({s}, '^[+-]?0[xX]', ''), 16, 10)) as bigint), {f}({s} as bigint))", t)
        if t == "INT64" and x.type == "BOOL" or t == "BOOL" and x.type in ("INT64", "STRING"):
            return X(f"{f}({s} as {spark_type(t)})", t)
        if t in (*FLOATS, "NUMERIC") and x.type in (*NUMBERS, "STRING"):
            return X(f"{f}({s} as {spark_type(t)})", t)
        if t == "STRING":
            if x.type == "BYTES":
                return X(self.guard(f"NOT is_valid_utf8(cast({s} as string))", "invalid UTF-8", f"cast({s} as string)"), t)
            return X(self.text(x), t)
        if t == "BYTES" and x.type == "STRING":
            return X(f"cast({s} as binary)", t)
        if t == "DATE" and x.type in ("STRING", "TIMESTAMP", "DATETIME"):
            return X(f"{f}({s} as date)" if x.type == "STRING" else dates.day(x), t)
        if t == "TIMESTAMP" and x.type in ("STRING", "DATE", "DATETIME"):
            v = dates.stamp(x).sql if x.type != "DATETIME" else f"to_utc_timestamp(cast({s} as timestamp), {dates.ZONE})"
            return X(v.replace("cast(", "try_cast(") if self.safe else v, t)
        if t == "DATETIME" and x.type in ("STRING", "DATE", "TIMESTAMP"):
            return X(f"{f}({dates.local(x) if x.type == 'TIMESTAMP' else s} as timestamp_ntz)", t)
        if t == "JSON":
            return X(s if x.type == "STRING" else jsons.literal(x), t)
        if t == "UUID" and x.type == "STRING":
            return X(s, t)
        if is_array(t) and is_array(x.type) and (x.type[1] in ("NULL", t[1])) or is_struct(t) and is_struct(x.type):
            return X(f"{f}({s} as {spark_type(t)})", t)
        raise InvalidArgument(f"cannot cast {x.type} to {t}")

    # subqueries
    def e_scalar_query(self, n, scope):
        rel = self.query(n.query, scope)
        if len(rel.columns) != 1:
            raise InvalidArgument("a scalar subquery has one column")
        return X(f"({rel.sql})", rel.columns[0][1])

    def e_exists(self, n, scope):
        return X(f"EXISTS ({self.query(n.query, scope).sql})", "BOOL")

    def e_array_query(self, n, scope):
        q_ = n.query
        order = q_.order if q_.kind == "select" and not q_.distinct else None
        if order and q_.limit is None and q_.offset is None:
            # the sort keys go with the values, as collecting keeps no order
            parts = {**q_.__dict__, "order": None, "items": [*q_.items, *[N("item", expr=e, alias=f"__k{i}") for i, (e, _, _) in enumerate(order)]]}
            parts.pop("kind")
            inner = N("select", **parts)
            rel = self.query(inner, scope)
            name, t = rel.columns[0]
            keys = [(f"__k{i}", k[1], d) for i, (k, (_, d, _)) in enumerate(zip(rel.columns[1:], order, strict=True))]
            struct = f"struct({b(name)} AS v{''.join(f', {b(k)} AS k{i}' for i, (k, _, _) in enumerate(keys))})"
            got = sorted_array(f"collect_list({struct})", [(t_, d) for _, t_, d in keys])
        else:
            rel = self.query(q_, scope)
            if len(rel.columns) != 1:
                raise InvalidArgument("an ARRAY subquery has one column")
            name, t = rel.columns[0]
            got = f"collect_list(struct({b(name)} AS v))"
        return X(f"(SELECT transform({got}, e -> e.v) FROM ({rel.sql}))", ("ARRAY", t))

    # calls
    def e_call(self, n, scope):
        if n.over is not None:
            return self.window(n, scope)
        if n.name in AGGREGATES:
            return self.aggregate(n, scope)
        if n.name in WINDOWS or n.name == "IS_FIRST":
            raise Unimplemented(f"{n.name} needs OVER")
        if n.name == "EXTRACT":
            return dates.extract(self, n.part, self.expr(n.args[0], scope), self.expr(n.zone, scope).sql if n.zone is not None else None)
        held = self.safe, self.named
        self.safe = self.safe or bool(n.safe)
        try:
            self.named = {k: self.expr(v, scope) for k, v in (n.named or {}).items()}
            args = [self.argument(a, scope) for a in n.args]
            if self.named and n.name == "MAKE_INTERVAL":
                args += [self.named.get(k, X("0", "INT64")) for k in ("year", "month", "day", "hour", "minute", "second")[len(args) :]]
            return call(self, n.name, args)
        finally:
            self.safe, self.named = held

    def argument(self, a: N, scope: Scope) -> X:
        """An argument; a bare word that names no column is a part or a mode."""
        if a.kind == "column" and len(a.path) == 1 and a.path[0].upper() in PARTS | {"NFC", "NFD", "NFKC", "NFKD"}:
            try:
                x = self.expr(a, scope)
                x.extra["word"] = a.path[0]
                return x
            except NotFound:
                return X(q(a.path[0]), "STRING", extra={"word": a.path[0]})
        if a.kind == "call" and a.name in ("WEEK",) and len(a.args) == 1:
            raise Unimplemented("WEEK with a day")
        return self.expr(a, scope)

    def window_spec(self, n, scope):
        by = ", ".join(self.expr(e, scope).sql for e in n.over.by)
        order = ", ".join(self.order_sql(self.expr(e, scope), d) for e, d, _ in n.over.order)
        frame = ""
        if n.over.frame:
            unit, lo, hi = n.over.frame
            side = lambda s: s if isinstance(s, str) else f"{self.expr(s[0], scope).sql.rstrip('L')} {s[1]}"
            frame = f" {unit} BETWEEN {side(lo)} AND {side(hi)}"
        return f"({f'PARTITION BY {by} ' if by else ''}{f'ORDER BY {order}' if order else ''}{frame})"

    def window(self, n, scope):
        if n.name == "IS_FIRST":
            if len(n.args) != 1 or n.args[0].kind == "literal" and (n.args[0].value is None or n.args[0].value < 0):
                raise InvalidArgument("IS_FIRST takes a count that is not negative")
            k = self.expr(n.args[0], scope).sql
            spec = self.window_spec(n, scope)
            if not n.over.order:
                spec = spec.rstrip(")") + (" " if n.over.by else "") + "ORDER BY 1)"
            return X(f"(row_number() OVER {spec} <= {k})", "BOOL")
        if not self.extended:
            raise Unimplemented(f"Unsupported built-in function: {n.name}")
        spec = self.window_spec(n, scope)
        args = [self.expr(a, scope) for a in n.args]
        if n.name in AGGREGATES:
            over, n.over = n.over, None
            try:
                x = self.aggregate(n, scope)
            finally:
                n.over = over
            return X(f"{x.sql} OVER {spec}", x.type)
        names = {"ROW_NUMBER": "INT64", "RANK": "INT64", "DENSE_RANK": "INT64", "NTILE": "INT64", "PERCENT_RANK": "FLOAT64", "CUME_DIST": "FLOAT64"}
        if n.name in ("LAG", "LEAD", "NTH_VALUE") and len(args) > 1:
            args[1] = X(args[1].sql.rstrip("L"), "INT64")
        if n.name == "NTILE":
            args[0] = X(args[0].sql.rstrip("L"), "INT64")
        out = f"{n.name.lower()}({', '.join(a.sql for a in args)}) OVER {spec}"
        return X(f"cast({out} as bigint)" if names.get(n.name) == "INT64" else out, names.get(n.name) or args[0].type)

    def order_sql(self, x: X, desc: bool) -> str:
        if is_array(x.type) or is_struct(x.type):
            raise InvalidArgument("ORDER BY needs simple values")
        way = "DESC NULLS LAST" if desc else "ASC NULLS FIRST"
        lead = f"(CASE WHEN {x.sql} IS NULL THEN 0 WHEN isnan({x.sql}) THEN 1 ELSE 2 END) {way}, " if x.type in FLOATS else ""
        return f"{lead}{x.sql} {way}"

    def aggregate(self, n, scope) -> X:
        held, self.safe = self.safe, False
        try:
            return self.aggregated(n, scope)
        finally:
            self.safe = held

    def aggregated(self, n, scope) -> X:
        name = n.name
        if n.star:
            return X("count(1)", "INT64")
        args = [self.expr(a, scope) for a in n.args]
        x = args[0]
        d = "DISTINCT " if n.distinct else ""
        if n.distinct and (is_array(x.type) or is_struct(x.type)):
            raise InvalidArgument("DISTINCT needs simple values")
        where = ""
        if n.having is not None:
            y = self.expr(n.having[1], scope)
            if name == "ANY_VALUE":
                return X(f"{'max_by' if n.having[0] == 'MAX' else 'min_by'}({x.sql}, {y.sql})", x.type)
            where = f" FILTER (WHERE {y.sql} = {scope.aliases['__extremes'][id(n)]})"
        if name in ("ARRAY_AGG", "STRING_AGG", "ARRAY_CONCAT_AGG"):
            return self.collected(n, x, args, where, scope)
        forms = {
            "COUNT": ("count({})", "INT64"), "COUNTIF": ("count_if({})", "INT64"), "MIN": ("min({})", x.type), "MAX": ("max({})", x.type), "ANY_VALUE": ("any_value({}, true)", x.type),
            "LOGICAL_AND": ("bool_and({})", "BOOL"), "LOGICAL_OR": ("bool_or({})", "BOOL"), "BIT_AND": ("bit_and({})", "INT64"), "BIT_OR": ("bit_or({})", "INT64"), "BIT_XOR": ("bit_xor({})", "INT64"),
            "STDDEV": ("stddev_samp({})", "FLOAT64"), "STDDEV_SAMP": ("stddev_samp({})", "FLOAT64"), "VARIANCE": ("var_samp({})", "FLOAT64"), "VAR_SAMP": ("var_samp({})", "FLOAT64"),
            "SUM": ("sum({})", "FLOAT64" if x.type in FLOATS else x.type), "AVG": ("avg({})", "NUMERIC" if x.type == "NUMERIC" else "FLOAT64"), "APPROX_COUNT_DISTINCT": ("approx_count_distinct({})", "INT64"),
        }
        form, t = forms[name]
        if name == "MIN" and x.type in FLOATS:  # NaN is the result if there is one, as it is of MAX
            return X(f"IF(bool_or(isnan({x.sql})){where}, cast('nan' as {spark_type(x.type)}), min({x.sql}){where})", x.type)
        if name in ("SUM", "AVG") and x.type not in (*NUMBERS, "NULL"):
            raise InvalidArgument(f"{name} of {x.type}")
        sql = form.format(d + x.sql) + where
        return X(f"cast({sql} as decimal(38,9))" if t == "NUMERIC" else sql, t)

    def collected(self, n, x, args, where, scope) -> X:
        keep = n.name == "ARRAY_AGG" and n.nulls != "IGNORE"
        if n.name == "ARRAY_AGG" and is_array(x.type):
            raise InvalidArgument("ARRAY_AGG of ARRAY")
        if not keep:
            where = f"{where[:-1]} AND {x.sql} IS NOT NULL)" if where else f" FILTER (WHERE {x.sql} IS NOT NULL)"
        keys = [(self.expr(e, scope), desc) for e, desc, _ in n.order or []]
        item = f"struct({''.join(f'{k.sql} AS k{i}, ' for i, (k, _) in enumerate(keys))}{x.sql} AS v)"
        got = f"collect_list({item}){where}"
        if keys and len({bool(desc) for _, desc in keys}) == 1 and isinstance(x.type, str) and not {*FLOATS} & {k.type for k, _ in keys}:
            got = f"sort_array({got}, {'false' if keys[0][1] else 'true'})"  # equal keys by value
        elif keys:
            got = sorted_array(got, [(k.type, desc) for k, desc in keys])
        got = f"transform({got}, e -> e.v)"
        if n.distinct:
            got = f"array_distinct({got})"
        if n.limit is not None:
            got = f"slice({got}, 1, {self.whole(n.limit, scope)})"
        if n.name == "STRING_AGG":
            sep = args[1].sql if len(args) > 1 else ("X'2c'" if x.type == "BYTES" else "','")
            if x.type == "BYTES":
                return X(f"IF(size({got}) = 0, NULL, unhex(array_join(transform({got}, e -> hex(e)), hex({sep}))))", "BYTES")
            return X(f"IF(size({got}) = 0, NULL, array_join({got}, {sep}))", "STRING")
        if n.name == "ARRAY_CONCAT_AGG":
            return X(f"IF(size({got}) = 0, NULL, flatten({got}))", x.type)
        return X(f"IF(size({got}) = 0, NULL, {got})", ("ARRAY", x.type))

    def whole(self, n: N, scope: Scope) -> int:
        x = self.expr(n, scope)
        if not x.lit or not isinstance(x.lit[0], int) or x.lit[0] < 0:
            raise InvalidArgument("LIMIT and OFFSET take literals that are not negative")
        return x.lit[0]

    # sources
    def source(self, n: N, scope: Scope, left: list[Source]) -> tuple[str, list[Source]]:
        return getattr(self, f"s_{n.kind}")(n, scope, left)

    def columns_of(self, alias: str, columns) -> list[Column]:
        return [Column(c[0], c[1], f"{b(alias)}.{b(c[0])}", len(c) > 2 and c[2]) for c in columns]

    def s_table(self, n, scope, left):
        name = n.name
        alias = n.alias or name.split(".")[-1]
        head = name.split(".")[0].lower()
        if any(s.alias and s.alias.lower() == head for s in left) and "." in name or any(s.alias and s.alias.lower() == head for p in scope.chain() for s in p.sources) and "." in name:
            return self.s_unnest(N("unnest", array=N("column", path=name.split(".")), alias=n.alias or name.split(".")[-1], offset=n.offset), scope, left)
        if name.lower() in self.ctes:
            return f"{b(name.lower())} AS {b(alias)}", [Source(alias, self.columns_of(alias, self.ctes[name.lower()]))]
        if (view := self.catalog.view(name)) is not None:
            rel = Compiler(self.catalog, extended=self.extended).statement(view)
            return f"({rel.sql}) AS {b(alias)}", [Source(alias, self.columns_of(alias, rel.columns))]
        sql, columns = self.catalog.scan(name)
        if n.method:
            size = self.expr(n.size, scope).sql.rstrip("LD")
            if (n.unit == "PERCENT") != (n.method == "BERNOULLI"):
                raise InvalidArgument("BERNOULLI takes PERCENT, RESERVOIR takes ROWS")
            if float(size) < 0 or n.unit == "PERCENT" and float(size) > 100:
                raise InvalidArgument("invalid sample size")
            sql = f"(SELECT * FROM {sql} TABLESAMPLE ({size} PERCENT))" if n.method == "BERNOULLI" else f"(SELECT * FROM {sql} ORDER BY rand() LIMIT {size})"
        return f"{sql} AS {b(alias)}", [Source(alias, self.columns_of(alias, columns))]

    def s_derived(self, n, scope, left):
        rel = self.query(n.query, scope)
        alias = n.alias or self.fresh()
        return f"({rel.sql}) AS {b(alias)}", [Source(alias if n.alias else "", self.columns_of(alias, rel.columns))]

    def s_unnest(self, n, scope, left):
        x = self.expr(n.array, Scope(left, scope) if left else scope)
        if not is_array(x.type):
            raise InvalidArgument("UNNEST needs an ARRAY")
        alias, call_ = n.alias or self.fresh(), "posexplode_outer" if n.outer else "posexplode"
        name = n.alias or alias
        value = X(f"{b(alias)}.{b(name)}", x.type[1])
        sources = [Source(alias, [] if is_struct(x.type[1]) else [Column(name, x.type[1], value.sql)], value)]
        if n.offset:
            sources.append(Source("", [Column(n.offset, "INT64", f"cast({b(alias)}.`__pos` as bigint)")]))
        table = f"{call_}({x.sql}) AS {b(alias)}(`__pos`, {b(name)})"
        return f"LATERAL {table}" if left else table, sources

    def s_join(self, n, scope, left):
        sql, sources = self.source(n.left, scope, left)
        right = n.right
        path = right.name.split(".") if right.kind == "table" else []
        if right.kind == "table" and len(path) > 1 and any(s.alias.lower() == path[0].lower() for s in sources):
            right = N("unnest", array=N("column", path=path), alias=right.alias or path[-1], offset=right.offset)
        if right.kind == "unnest":
            if n.how not in ("CROSS", "INNER", "LEFT"):
                raise InvalidArgument(f"{n.how} JOIN UNNEST")
            right.outer = n.how == "LEFT"
            right.outer &= n.on is None  # with a condition the join itself keeps the left rows
            r, more = self.s_unnest(right, scope, [*left, *sources])
            sources = [*sources, *more]
            if n.on is None:
                return f"{sql} {'LEFT' if n.how == 'LEFT' else 'CROSS'} JOIN {r}", sources
            return f"{sql} {'LEFT JOIN' if n.how == 'LEFT' else 'JOIN'} {r} ON {self.expr(n.on, Scope([*left, *sources], scope)).sql}", sources
        r, more = self.source(right, scope, [])
        if right.kind == "join":
            r = f"({r})"
        how = {"CROSS": "CROSS JOIN", "INNER": "JOIN", "LEFT": "LEFT JOIN", "RIGHT": "RIGHT JOIN", "FULL": "FULL JOIN"}[n.how]
        both = [*sources, *more]
        if n.using:
            on = []
            for c in n.using:
                x, y = self.column([c], Scope(sources)), self.column([c], Scope(more))
                on.append(self.compare_sql("=", x, y))
                (u, v), t = unify([x, y])
                merged = f"coalesce({u}, {v})" if n.how == "FULL" else v if n.how == "RIGHT" else u
                for s in sources:
                    if (k := s.find(c)) is not None:
                        s.columns[s.columns.index(k)] = Column(k.name, t, merged if n.how in ("FULL", "RIGHT") else k.sql)
                for s in more:
                    if s.find(c):
                        s.merged = s.merged | {c.lower()}
            return f"{sql} {how} {r} ON {' AND '.join(on)}", both
        if n.on is None:
            if n.how not in ("CROSS", "INNER"):
                raise InvalidArgument(f"{n.how} JOIN needs ON or USING")
            return f"{sql} CROSS JOIN {r}", both
        return f"{sql} {how} {r} ON {self.expr(n.on, Scope([*left, *both], scope)).sql}", both

    # queries
    def statement(self, n: N) -> Rel:
        return self.query(n, None)

    def query(self, n: N, scope: Scope | None) -> Rel:
        if n.kind == "select":
            return self.select(n, scope)
        held, self.ctes = self.ctes, dict(self.ctes)
        try:
            with_ = []
            for name, cols, body in n.ctes or []:
                key = name.lower()
                if n.recursive and body.kind == "query" and body.ops and self.mentions(body, key):
                    first = self.query(body.arms[0], scope)
                    self.ctes[key] = [(c, t) for c, (_, t) in zip(cols or [x for x, _ in first.columns], first.columns, strict=True)]
                    if any(o != "UNION ALL" for o in body.ops):
                        raise InvalidArgument("a recursive query needs UNION ALL")
                rel = self.query(body, scope)
                if cols and len(cols) != len(rel.columns):
                    raise InvalidArgument(f"{name} has {len(rel.columns)} columns")
                self.ctes[key] = [(c, t) for c, (_, t) in zip(cols or [x for x, _ in rel.columns], rel.columns, strict=True)]
                with_.append(f"{b(key)}({', '.join(b(c) for c, _ in self.ctes[key])}) AS ({rel.sql})")
            arms = [self.query(a, scope) for a in n.arms]
            if len({len(a.columns) for a in arms}) > 1:
                raise InvalidArgument("set operations need equal numbers of columns")
            columns = [(arms[0].columns[i][0], common([a.columns[i][1] for a in arms])) for i in range(len(arms[0].columns))]
            if n.ops and any(is_array(t) for _, t in columns) and not all(o == "UNION ALL" for o in n.ops):
                raise InvalidArgument("set operations need values that can be compared")

            def arm(a: Rel) -> str:
                if [t for _, t in a.columns] == [t for _, t in columns] or not n.ops:
                    return f"({a.sql})"
                s = self.fresh()
                cols = ", ".join(f"cast({b(s)}.{b(c)} as {spark_type(t)}) AS {b(c)}" if k != t else f"{b(s)}.{b(c)}" for (c, k), (_, t) in zip(a.columns, columns, strict=True))
                return f"(SELECT {cols} FROM ({a.sql}) AS {b(s)})"

            sql = arm(arms[0]) if n.ops else arms[0].sql
            for op, a in zip(n.ops, arms[1:], strict=True):
                sql = f"{sql} {op} {arm(a)}"
            if n.order or n.limit is not None or n.offset is not None:
                s = self.fresh()
                outer = Scope([Source("", self.columns_of(s, columns))], scope)
                tail = self.tail(n, outer, columns)
                sql = f"SELECT * FROM ({sql}) AS {b(s)}{tail}"
            if with_:
                sql = f"WITH {'RECURSIVE ' if n.recursive else ''}{', '.join(with_)} {sql if sql.startswith('SELECT') or sql.startswith('(') else f'SELECT * FROM ({sql})'}"
            return Rel(sql, columns)
        finally:
            self.ctes = held

    def mentions(self, n, name: str) -> bool:
        if isinstance(n, N):
            return n.kind == "table" and n.__dict__.get("name", "").lower() == name or any(self.mentions(v, name) for v in n.__dict__.values())
        return any(self.mentions(v, name) for v in n) if isinstance(n, (list, tuple)) else False

    def tail(self, n: N, scope: Scope, columns) -> str:
        out = ""
        if n.order:
            keys = []
            for e, desc, nulls in n.order:
                if nulls and (nulls == "FIRST") == bool(desc):
                    raise Unimplemented("only the default place of NULLs is supported")
                keys.append(self.order_sql(self.ordered(e, scope, columns), desc))
            out += f" ORDER BY {', '.join(keys)}"
        if n.limit is not None:
            out += f" LIMIT {self.whole(n.limit, scope)}"
        if n.offset is not None:
            out += f" OFFSET {self.whole(n.offset, scope)}"
        return out

    def ordered(self, e: N, scope: Scope, columns) -> X:
        if e.kind == "literal" and isinstance(e.value, int) and not isinstance(e.value, bool):
            if not 1 <= e.value <= len(columns):
                raise InvalidArgument(f"ORDER BY {e.value}")
            name, t = columns[e.value - 1]
            return X(b(name), t)
        return self.expr(e, scope)

    def aggregates(self, n, out: list) -> list:
        """Aggregate calls in a tree, not those of subqueries."""
        if isinstance(n, N):
            if n.kind == "call" and n.name in AGGREGATES and n.over is None:
                out.append(n)
            elif n.kind not in ("scalar_query", "exists", "array_query"):
                for k, v in n.__dict__.items():
                    if not (n.kind == "in_query" and k == "query"):
                        self.aggregates(v, out)
        elif isinstance(n, (list, tuple)):
            for v in n:
                self.aggregates(v, out)
        return out

    def select(self, n: N, outer: Scope | None) -> Rel:
        held, self.shown = self.shown, False
        try:
            return self._select(n, outer)
        finally:
            self.shown = held

    def _select(self, n: N, outer: Scope | None) -> Rel:
        scope = Scope([], outer)
        from_ = ""
        if n.source is not None:
            self.many = True  # from here on a call may be made for more than one row
            from_, scope.sources = self.source(n.source, outer or Scope(), [])
            from_ = f" FROM {from_}"
        if n.where is not None:
            from_ += f" WHERE {self.expr(n.where, scope).sql}"
        items = []  # (name, node or X)
        for it in n.items:
            items += self.starred(it, scope) if it.kind == "star" else [(it.alias or self.named_by(it.expr), it.expr)]
        scope.aliases = {it.alias.lower(): it.expr for it in n.items if it.kind == "item" and it.alias}
        group = []
        for e in n.group or []:
            if e.kind == "literal" and isinstance(e.value, int):
                if not 1 <= e.value <= len(items):
                    raise InvalidArgument(f"GROUP BY {e.value}")
                e = items[e.value - 1][1]
            group.append(e)
        found = self.aggregates([v for _, v in items if isinstance(v, N)] + [n.having, n.qualify, [k[0] for k in n.order or []]], [])
        if self.aggregates(n.where, []) or self.aggregates(group, []):
            raise InvalidArgument("an aggregate is not allowed here")
        if special := [a for a in found if a.having is not None and a.name != "ANY_VALUE"]:
            from_ = self.extremes(from_, scope, group, special)
        compiled = []
        used: dict[str, int] = {}
        for i, (name, v) in enumerate(items):
            self.shown = True
            x = v if isinstance(v, X) else self.expr(v, scope)
            self.shown = False
            name = name or f"_c{i}"
            if name.lower() in used:
                used[name.lower()] += 1
                name = f"{name}_{used[name.lower()]}"
            used.setdefault(name.lower(), 0)
            compiled.append((name, x))
        if n.distinct and any(is_array(x.type) for _, x in compiled):
            raise InvalidArgument("SELECT DISTINCT needs values that can be compared")
        columns = [(name, x.type) for name, x in compiled]
        groups = [g if isinstance(g, X) else self.expr(g, scope) for g in group]
        if any(is_array(g.type) for g in groups):
            raise InvalidArgument("GROUP BY needs values that can be compared")
        body = from_
        if groups:
            body += f" GROUP BY {', '.join(g.sql if not (g.lit and isinstance(g.lit[0], int)) else f'({g.sql} + 0L)' for g in groups)}"
        if n.having is not None:
            body += f" HAVING {self.expr(n.having, scope).sql}"
        cols = ", ".join(f"{x.sql if x.type != 'NULL' else 'cast(null as string)' if x.sql == 'NULL' else x.sql} AS {b(name)}" for name, x in compiled)
        if n.qualify is not None:
            sql = f"SELECT * EXCEPT (`__q`) FROM (SELECT {cols}, {self.expr(n.qualify, scope).sql} AS `__q`{body}) WHERE `__q`"
            if n.distinct:
                sql = sql.replace("SELECT *", "SELECT DISTINCT *", 1)
            s = self.fresh()
            sql = f"SELECT * FROM ({sql}) AS {b(s)}"
            tail = self.tail(n, Scope([Source("", self.columns_of(s, columns))], outer), columns)
        else:
            sql = f"SELECT {'DISTINCT ' if n.distinct else ''}{cols}{body}"
            inner = Scope(scope.sources, outer, scope.aliases)
            outputs = {name.lower(): (name, x) for name, x in compiled}
            order = []
            for e, desc, nulls in n.order or []:
                if nulls and (nulls == "FIRST") == bool(desc):
                    raise Unimplemented("only the default place of NULLs is supported")
                if e.kind == "column" and len(e.path) == 1 and e.path[0].lower() in outputs:
                    name, x = outputs[e.path[0].lower()]
                    x = X(b(name), x.type)
                elif e.kind == "literal":
                    x = self.ordered(e, inner, columns)
                else:
                    x = self.expr(e, inner)
                    same = next((name for name, y in compiled if y.sql == x.sql), None)
                    x = X(b(same), x.type) if same and sum(k.lower() == same.lower() for k, _ in compiled) == 1 else x
                order.append(self.order_sql(x, desc))
            tail = f" ORDER BY {', '.join(order)}" if order else ""
            if n.limit is not None:
                tail += f" LIMIT {self.whole(n.limit, scope)}"
            if n.offset is not None:
                tail += f" OFFSET {self.whole(n.offset, scope)}"
        sql += tail
        if n.as_struct:
            fields = ", ".join(f"{q(c)}, {b(c)}" for c, _ in columns)
            return Rel(f"SELECT named_struct({fields}) AS `_struct` FROM ({sql})", [("_struct", ("STRUCT", columns))])
        return Rel(sql, columns)

    def named_by(self, e: N) -> str | None:
        return e.path[-1] if e.kind == "column" else e.name if e.kind == "field" else e.name.split(".")[-1] if e.kind == "call" else None

    def starred(self, it: N, scope: Scope) -> list:
        if it.of is None:
            if not scope.sources:
                raise InvalidArgument("* needs a FROM clause")
            cols = []
            for s in scope.sources:
                if s.value is not None and is_struct(s.value.type):
                    cols += [(k, X(f"{s.value.sql}.{b(k)}", t)) for k, t in s.value.type[1]]
                cols += [(c.name, X(c.sql, c.type)) for c in s.columns if not c.hidden and c.name.lower() not in s.merged]
        else:
            path = it.of.path if it.of.kind == "column" else []
            src = next((s for s in scope.sources if len(path) == 1 and s.alias.lower() == path[0].lower() and s.value is None), None)
            if src is not None:
                cols = [(c.name, X(c.sql, c.type)) for c in src.columns if not c.hidden]
            else:
                x = self.expr(it.of, scope)
                if not is_struct(x.type):
                    raise InvalidArgument(".* needs a table or a STRUCT")
                cols = [(k, X(f"{x.sql}.{b(k)}", t)) for k, t in x.type[1]]
        gone = {c.lower() for c in it.without or []}
        new = {k.lower(): v for k, v in it.replace or []}
        if missing := (gone | set(new)) - {c.lower() for c, _ in cols}:
            raise NotFound(f"column {sorted(missing)[0]}")
        return [(c, new.get(c.lower(), x)) for c, x in cols if c.lower() not in gone]

    def extremes(self, from_: str, scope: Scope, group: list, calls: list) -> str:
        """FROM clause that adds, for HAVING MAX and MIN, the group's extreme to each row; scope then reads from it.

        The extremes are aggregated by themselves and joined by the group's keys, so no group is gathered in one task.
        """
        alias = self.fresh()
        by = [self.expr(g, scope).sql for g in group if isinstance(g, N)]
        extra = {id(c): f"{c.having[0].lower()}({self.expr(c.having[1], scope).sql})" for c in calls}
        keys = ", ".join(f"{sql} AS `__g{j}`" for j, sql in enumerate(by))
        tops = ", ".join([*([keys] if by else []), *[f"{sql} AS `__e{j}`" for j, sql in enumerate(extra.values())]])
        tops = f"(SELECT {tops}{from_}{f' GROUP BY {", ".join(by)}' if by else ''})"
        cols, k = [keys] if by else [], 0
        for s in scope.sources:
            for c in s.columns:
                cols.append(f"{c.sql} AS `__s{k}`")
                c.sql = f"{b(alias)}.`__s{k}`"
                k += 1
            if s.value is not None:
                cols.append(f"{s.value.sql} AS `__s{k}`")
                s.value = X(f"{b(alias)}.`__s{k}`", s.value.type)
                k += 1
        names = {}
        for j, key in enumerate(extra):
            names[key] = f"{b(alias)}.`__e{j}`"
        scope.aliases["__extremes"] = names
        on = " AND ".join(f"r.`__g{j}` <=> t.`__g{j}`" for j in range(len(by)))
        found = ", ".join(f"t.`__e{j}`" for j in range(len(extra)))
        cols = cols or ["1 AS `__one`"]
        return f" FROM (SELECT r.*, {found} FROM (SELECT {', '.join(cols)}{from_}) AS r {f'JOIN {tops} AS t ON {on}' if by else f'CROSS JOIN {tops} AS t'}) AS {b(alias)}"


def sorted_array(items: str, keys: list[tuple[Any, bool]]) -> str:
    """An array of structs with fields k0, k1, ... sorted by these."""
    body = "0"
    for i in reversed(range(len(keys))):
        t, desc = keys[i]
        up, down = ("-1", "1") if desc else ("1", "-1")
        nan = f"WHEN isnan(l.k{i}) AND isnan(r.k{i}) THEN {body} WHEN isnan(l.k{i}) THEN {down} WHEN isnan(r.k{i}) THEN {up} " if t in FLOATS else ""
        body = f"CASE WHEN l.k{i} IS NULL AND r.k{i} IS NULL THEN {body} WHEN l.k{i} IS NULL THEN {down} WHEN r.k{i} IS NULL THEN {up} {nan}WHEN l.k{i} < r.k{i} THEN {down} WHEN l.k{i} > r.k{i} THEN {up} ELSE {body} END"
    return f"array_sort({items}, (l, r) -> {body})"
