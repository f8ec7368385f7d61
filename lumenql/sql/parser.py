"""Recursive-descent parser: text to a tree of N nodes."""

from __future__ import annotations

from ..errors import InvalidArgument
from .lexer import Token, tokens


class N:
    """A node: its kind and named parts."""

    def __init__(self, kind: str, **parts):
        self.kind = kind
        self.__dict__.update(parts)

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return None

    def __repr__(self):
        return f"N({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items())})"


RESERVED = frozenset("SELECT FROM WHERE GROUP HAVING QUALIFY ORDER LIMIT OFFSET UNION INTERSECT EXCEPT ON USING JOIN INNER LEFT RIGHT FULL CROSS OUTER AS AND OR NOT IN IS LIKE BETWEEN CASE WHEN THEN ELSE END WITH BY ASC DESC NULLS TABLESAMPLE DISTINCT ALL EXISTS INTERVAL UNNEST WINDOW SET VALUES FOR NULL TRUE FALSE ROWS RANGE".split())
PARTS = frozenset("YEAR QUARTER MONTH WEEK ISOWEEK ISOYEAR DAY DAYOFWEEK DAYOFYEAR HOUR MINUTE SECOND MILLISECOND MICROSECOND NANOSECOND DATE".split())


class Parser:
    def __init__(self, sql: str):
        self.t, self.i = tokens(sql), 0

    # token helpers
    @property
    def now(self) -> Token:
        return self.t[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.t[min(self.i + n, len(self.t) - 1)]

    def fail(self, what: str = ""):
        raise InvalidArgument(f"syntax error at {self.now.text or 'the end'!r} ({self.now.at}){': ' + what if what else ''}")

    def word(self, *names: str) -> bool:
        return self.now.up in names

    def words(self, *names: str) -> bool:
        return all(self.peek(k).up == n for k, n in enumerate(names))

    def take(self, *names: str) -> bool:
        """Skips these words if all of them come next."""
        if self.words(*names):
            self.i += len(names)
            return True
        return False

    def need(self, *names: str):
        if not self.take(*names):
            self.fail(f"expected {' '.join(names)}")

    def op(self, text: str) -> bool:
        if self.now.kind == "op" and self.now.text == text:
            self.i += 1
            return True
        return False

    def is_op(self, text: str, n: int = 0) -> bool:
        t = self.peek(n)
        return t.kind == "op" and t.text == text

    def need_op(self, text: str):
        if not self.op(text):
            self.fail(f"expected {text}")

    def name(self) -> str:
        t = self.now
        if t.kind == "quoted" or t.kind == "name" and t.up not in RESERVED:
            self.i += 1
            return t.text
        self.fail("expected a name")

    def any_name(self) -> str:
        t = self.now
        if t.kind in ("quoted", "name"):
            self.i += 1
            return t.text
        self.fail("expected a name")

    def path(self) -> str:
        out = self.name()
        while self.op("."):
            out += "." + self.any_name()
        return out

    def names(self) -> list[str]:
        self.need_op("(")
        out = [self.name()]
        while self.op(","):
            out.append(self.name())
        self.need_op(")")
        return out

    def listed(self, item, close: str = ")") -> list:
        out = []
        if self.op(close):
            return out
        while True:
            out.append(item())
            if self.op(close):
                return out
            self.need_op(",")

    # expressions, loosest first
    def expr(self) -> N:
        left = self.and_()
        while self.take("OR"):
            left = N("binary", op="OR", left=left, right=self.and_())
        return left

    def and_(self) -> N:
        left = self.not_()
        while self.take("AND"):
            left = N("binary", op="AND", left=left, right=self.not_())
        return left

    def not_(self) -> N:
        if self.take("NOT"):
            return N("not", arg=self.not_())
        return self.compare()

    def compare(self) -> N:
        left = self.additive()
        t = self.now
        if t.kind == "op" and t.text in ("=", "!=", "<>", "<", ">", "<=", ">="):
            self.i += 1
            return N("compare", op="!=" if t.text == "<>" else t.text, left=left, right=self.additive())
        if self.take("IS"):
            no = self.take("NOT")
            for what in ("NULL", "TRUE", "FALSE"):
                if self.take(what):
                    return N("is", what=what, no=no, arg=left)
            self.fail()
        no = self.word("NOT") and self.peek().up in ("IN", "LIKE", "BETWEEN") and self.take("NOT")
        if self.take("IN"):
            if self.take("UNNEST"):
                self.need_op("(")
                x = N("in_unnest", arg=left, array=self.expr())
                self.need_op(")")
            else:
                self.need_op("(")
                if self.word("SELECT", "WITH") or self.is_op("("):
                    x = N("in_query", arg=left, query=self.query())
                    self.need_op(")")
                else:
                    x = N("in", arg=left, items=self.listed(self.expr))
        elif self.take("LIKE"):
            if self.word("ANY", "SOME", "ALL") and self.is_op("(", 1):
                from ..errors import Unimplemented

                raise Unimplemented("LIKE ANY and LIKE ALL are not supported")
            x = N("like", arg=left, pattern=self.additive())
        elif self.take("BETWEEN"):
            low = self.additive()
            self.need("AND")
            x = N("between", arg=left, low=low, high=self.additive())
        else:
            if no:
                self.fail()
            return left
        return N("not", arg=x) if no else x

    def additive(self) -> N:
        left = self.term()
        while self.now.kind == "op" and self.now.text in ("+", "-", "||"):
            op = self.now.text
            self.i += 1
            left = N("arith", op=op, left=left, right=self.term())
        return left

    def term(self) -> N:
        left = self.unary()
        while self.now.kind == "op" and self.now.text in ("*", "/", "%"):
            op = self.now.text
            if op == "%":
                from ..errors import Unimplemented

                raise Unimplemented("operator % is not supported: use MOD")
            self.i += 1
            left = N("arith", op=op, left=left, right=self.unary())
        return left

    def unary(self) -> N:
        if self.op("-"):
            if self.now.kind in ("int", "float") and not (self.is_op(".", 1) or self.is_op("[", 1)):
                t = self.now
                self.i += 1
                return N("literal", value=-t.value, type="INT64" if t.kind == "int" else "FLOAT64")
            return N("negate", arg=self.unary())
        if self.op("+"):
            return self.unary()
        return self.postfix()

    def postfix(self) -> N:
        x = self.atom()
        while True:
            if self.op("["):
                mode = None
                if self.word("OFFSET", "ORDINAL", "SAFE_OFFSET", "SAFE_ORDINAL") and self.is_op("(", 1):
                    mode = self.now.up
                    self.i += 2
                    index = self.expr()
                    self.need_op(")")
                else:
                    mode, index = "OFFSET", self.expr()
                self.need_op("]")
                x = N("subscript", arg=x, mode=mode, index=index)
            elif self.is_op(".") and x.kind != "column" and not self.is_op("*", 1):
                self.i += 1
                x = N("field", arg=x, name=self.any_name())
            else:
                return x

    def type(self) -> object:
        name = self.any_name().upper()
        if name == "ARRAY":
            self.need_op("<")
            inner = self.type()
            self.need_op(">")
            return ("ARRAY", inner)
        if name == "STRUCT":
            self.need_op("<")
            fields = []
            while not self.op(">"):
                if self.peek().kind in ("name",) and not self.is_op("<", 1):
                    fields.append((self.any_name(), self.type()))
                else:
                    fields.append(("", self.type()))
                self.op(",")
            return ("STRUCT", fields)
        while self.is_op(".") and self.peek().kind == "name":
            self.i += 1
            name += "." + self.any_name()
        if self.op("("):
            while not self.op(")"):
                self.i += 1
        return name

    def atom(self) -> N:
        t = self.now
        if t.kind in ("int", "float", "string", "bytes"):
            self.i += 1
            return N("literal", value=t.value, type={"int": "INT64", "float": "FLOAT64", "string": "STRING", "bytes": "BYTES"}[t.kind])
        if t.kind == "param":
            self.i += 1
            return N("param", name=t.text)
        if self.op("("):
            if self.word("SELECT", "WITH"):
                q = self.query()
                self.need_op(")")
                return N("scalar_query", query=q)
            x = self.expr()
            if self.is_op(","):
                items = [x]
                while self.op(","):
                    items.append(self.expr())
                self.need_op(")")
                return N("struct", fields=[(None, v) for v in items])
            self.need_op(")")
            return x
        if self.op("["):
            return N("array", items=self.listed(self.expr, "]"), type=None)
        u = t.up
        if u in ("TRUE", "FALSE", "NULL"):
            self.i += 1
            return N("literal", value={"TRUE": True, "FALSE": False, "NULL": None}[u], type="NULL" if u == "NULL" else "BOOL")
        if u == "CASE":
            return self.case()
        if u in ("CAST", "SAFE_CAST") and self.is_op("(", 1):
            self.i += 2
            x = self.expr()
            self.need("AS")
            to = self.type()
            self.need_op(")")
            return N("cast", arg=x, to=to, safe=u == "SAFE_CAST")
        if u == "EXISTS" and self.is_op("(", 1):
            self.i += 2
            q = self.query()
            self.need_op(")")
            return N("exists", query=q)
        if u == "ARRAY" and self.is_op("(", 1):
            self.i += 2
            q = self.query()
            self.need_op(")")
            return N("array_query", query=q)
        if u == "ARRAY" and (self.is_op("<", 1) or self.is_op("[", 1)):
            to = None
            if self.is_op("<", 1):
                to = self.type()[1]
            else:
                self.i += 1
            self.need_op("[")
            return N("array", items=self.listed(self.expr, "]"), type=to)
        if u == "STRUCT" and (self.is_op("(", 1) or self.is_op("<", 1)):
            types = self.type()[1] if self.is_op("<", 1) else None
            if types is None:
                self.i += 1
            self.need_op("(")

            def item():
                v = self.expr()
                return (self.any_name() if self.take("AS") else (v.path[-1] if v.kind == "column" else v.name if v.kind == "field" else None), v)

            return N("struct", fields=self.listed(item), types=types)
        if u == "INTERVAL":
            self.i += 1
            n = self.unary()
            if n.kind == "literal" and n.type == "STRING":
                part = self.any_name().upper() if self.now.kind == "name" and self.now.up in PARTS else None
                if self.take("TO"):
                    part += "-" + self.any_name().upper()
            else:
                part = self.any_name().upper()
            return N("interval", n=n, part=part)
        if u in ("DATE", "TIMESTAMP", "NUMERIC", "JSON", "DATETIME", "BIGNUMERIC") and self.peek().kind == "string":
            self.i += 2
            return N("typed", type=u, value=self.t[self.i - 1].value)
        if u in ("CURRENT_TIMESTAMP", "CURRENT_DATE") and not self.is_op("(", 1):
            self.i += 1
            return N("call", name=u, args=[])
        if t.kind == "name" and u not in RESERVED | {"LEFT", "RIGHT"} or t.kind == "quoted" or u in ("LEFT", "RIGHT", "IF", "RANGE") and self.is_op("(", 1):
            path = [t.text]
            self.i += 1
            while self.is_op(".") and self.peek().kind in ("name", "quoted"):
                self.i += 1
                path.append(self.any_name())
            if self.is_op("(") and t.kind == "name":
                return self.call(path)
            return N("column", path=path)
        self.fail("expected an expression")

    def case(self) -> N:
        self.need("CASE")
        subject = None if self.word("WHEN") else self.expr()
        arms = []
        while self.take("WHEN"):
            c = self.expr()
            self.need("THEN")
            arms.append((c, self.expr()))
        other = self.expr() if self.take("ELSE") else None
        self.need("END")
        return N("case", subject=subject, arms=arms, other=other)

    def call(self, path: list[str]) -> N:
        self.need_op("(")
        name = ".".join(path).upper()
        safe = name.startswith("SAFE.")
        name = name.removeprefix("SAFE.")
        x = N("call", name=name, args=[], named={}, safe=safe)
        if name == "EXTRACT":
            x.part = self.any_name().upper()
            if self.op("("):
                self.any_name()
                self.need_op(")")
            self.need("FROM")
            x.args = [self.expr()]
            if self.take("AT", "TIME", "ZONE"):
                x.zone = self.expr()
            self.need_op(")")
            return x
        if self.op("*"):
            x.star = True
            self.need_op(")")
        elif not self.op(")"):
            x.distinct = self.take("DISTINCT")
            while True:
                if self.now.kind == "name" and self.is_op("=>", 1):
                    key = self.any_name().lower()
                    self.i += 1
                    x.named[key] = self.expr()
                elif name in ("GET_NEXT_SEQUENCE_VALUE", "GET_INTERNAL_SEQUENCE_STATE") and self.take("SEQUENCE"):
                    x.args.append(N("literal", value=self.path(), type="STRING"))
                else:
                    x.args.append(self.expr())
                if not self.op(","):
                    break
            if self.take("HAVING"):
                x.having = ("MAX" if self.take("MAX") else self.take("MIN") and "MIN" or self.fail(), self.expr())
            if self.take("IGNORE", "NULLS"):
                x.nulls = "IGNORE"
            elif self.take("RESPECT", "NULLS"):
                x.nulls = "RESPECT"
            if self.take("ORDER", "BY"):
                x.order = self.order_items()
            if self.take("LIMIT"):
                x.limit = self.expr()
            self.need_op(")")
        if self.take("OVER"):
            self.need_op("(")
            over = N("over", by=[], order=[], frame=None)
            if self.take("PARTITION", "BY"):
                over.by = [self.expr()]
                while self.op(","):
                    over.by.append(self.expr())
            if self.take("ORDER", "BY"):
                over.order = self.order_items()
            if self.word("ROWS", "RANGE"):
                unit = self.now.up
                self.i += 1

                def bound():
                    if self.take("UNBOUNDED", "PRECEDING") or self.take("UNBOUNDED", "FOLLOWING"):
                        return "UNBOUNDED " + self.t[self.i - 1].up
                    if self.take("CURRENT", "ROW"):
                        return "CURRENT ROW"
                    n = self.additive()
                    return (n, self.any_name().upper())

                if self.take("BETWEEN"):
                    a = bound()
                    self.need("AND")
                    over.frame = (unit, a, bound())
                else:
                    over.frame = (unit, bound(), "CURRENT ROW")
            self.need_op(")")
            x.over = over
        return x

    def order_items(self) -> list:
        out = []
        while True:
            e = self.expr()
            desc = self.take("DESC") or (self.take("ASC") and False)
            nulls = ("FIRST" if self.take("FIRST") else self.take("LAST") and "LAST" or self.fail()) if self.take("NULLS") else None
            out.append((e, desc, nulls))
            if not self.op(","):
                return out

    # queries
    def query(self) -> N:
        ctes, recursive = [], False
        if self.take("WITH"):
            recursive = self.take("RECURSIVE")
            while True:
                name = self.name()
                cols = self.names() if self.is_op("(") else None
                self.need("AS")
                self.need_op("(")
                ctes.append((name, cols, self.query()))
                self.need_op(")")
                if not self.op(","):
                    break
        first = self.primary()
        arms, ops = [first], []
        while self.word("UNION", "INTERSECT", "EXCEPT"):
            kind = self.now.up
            self.i += 1
            if self.take("ALL"):
                kind += " ALL"
            elif self.take("DISTINCT"):
                kind += " DISTINCT"
            else:
                self.fail("expected ALL or DISTINCT")
            ops.append(kind)
            arms.append(self.primary())
        if len(set(ops)) > 1:
            raise InvalidArgument("different set operations need parentheses")
        order = self.order_items() if self.take("ORDER", "BY") else None
        limit = self.expr() if self.take("LIMIT") else None
        offset = self.expr() if self.take("OFFSET") else None
        lock = self.take("FOR", "UPDATE")
        if not ops and not ctes and first.kind == "select" and not first.tail:
            first.order, first.limit, first.offset, first.lock = order, limit, offset, lock
            first.tail = True
            return first
        if not ops and not ctes and order is None and limit is None and offset is None:
            return first
        if not ops and first.kind == "select" and not first.tail:
            first.order, first.limit, first.offset, first.tail = order, limit, offset, True
            return N("query", ctes=ctes, recursive=recursive, arms=[first], ops=[])
        return N("query", ctes=ctes, recursive=recursive, arms=arms, ops=ops, order=order, limit=limit, offset=offset)

    def primary(self) -> N:
        if self.op("("):
            q = self.query()
            self.need_op(")")
            return q if q.kind == "query" else N("query", ctes=[], arms=[q], ops=[])
        return self.select()

    def select(self) -> N:
        self.need("SELECT")
        s = N("select", items=[])
        s.distinct = self.take("DISTINCT")
        self.take("ALL")
        s.as_struct = self.take("AS", "STRUCT")
        while True:
            s.items.append(self.item())
            if not self.op(",") or self.word("FROM"):
                break
        if self.take("FROM"):
            s.source = self.from_()
        if self.take("WHERE"):
            s.where = self.expr()
            if s.source is None:
                raise InvalidArgument("WHERE needs a FROM clause")
        if self.take("GROUP", "BY"):
            s.group = [self.expr()]
            while self.op(","):
                s.group.append(self.expr())
        if self.take("HAVING"):
            s.having = self.expr()
        if self.take("QUALIFY"):
            s.qualify = self.expr()
        return s

    def item(self) -> N:
        star = None
        if self.op("*"):
            star = N("star", of=None)
        else:
            e = self.expr()
            if self.is_op(".") and self.is_op("*", 1):
                self.i += 2
                star = N("star", of=e)
        if star is not None:
            if self.take("EXCEPT"):
                star.without = self.names()
            if self.take("REPLACE"):
                self.need_op("(")

                def one():
                    v = self.expr()
                    self.need("AS")
                    return (self.any_name(), v)

                star.replace = self.listed(one)
            return star
        alias = self.any_name() if self.take("AS") else None
        return N("item", expr=e, alias=alias)

    def from_(self) -> N:
        left = self.joined()
        while self.op(","):
            left = N("join", how="CROSS", left=left, right=self.joined())
        return left

    def joined(self) -> N:
        left = self.source()
        while True:
            how = None
            for kind in ("LEFT", "RIGHT", "FULL"):
                if self.word(kind):
                    self.i += 1
                    self.take("OUTER")
                    self.need("JOIN")
                    how = kind
                    break
            else:
                if self.take("CROSS", "JOIN"):
                    how = "CROSS"
                elif self.take("INNER", "JOIN") or self.take("JOIN"):
                    how = "INNER"
                else:
                    return left
            right = self.source()
            x = N("join", how=how, left=left, right=right)
            if self.take("ON"):
                x.on = self.expr()
            elif self.take("USING"):
                x.using = self.names()
            left = x

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.any_name()
        t = self.now
        if t.kind == "quoted" or t.kind == "name" and t.up not in RESERVED:
            self.i += 1
            return t.text
        return None

    def source(self) -> N:
        if self.take("UNNEST"):
            self.need_op("(")
            x = N("unnest", array=self.expr())
            self.need_op(")")
            x.alias = self.alias()
            if self.take("WITH", "OFFSET"):
                x.offset = self.alias() or "offset"
            return x
        if self.op("("):
            if self.word("SELECT", "WITH") or self.is_op("("):
                q = self.query()
                self.need_op(")")
                return N("derived", query=q, alias=self.alias())
            x = self.from_()
            self.need_op(")")
            return x
        x = N("table", name=self.path())
        x.alias = self.alias()
        if self.take("TABLESAMPLE"):
            x.method = self.any_name().upper()
            if x.method not in ("BERNOULLI", "RESERVOIR"):
                self.fail("expected BERNOULLI or RESERVOIR")
            self.need_op("(")
            x.size = self.expr()
            x.unit = self.any_name().upper()
            self.need_op(")")
        if x.alias is None and self.take("WITH", "OFFSET"):
            x.offset = self.alias() or "offset"
        return x

    # data changes
    def returning(self, x: N) -> N:
        if self.take("THEN", "RETURN"):
            if self.take("WITH", "ACTION"):
                x.action = self.any_name() if self.take("AS") else "ACTION"
            x.returning = [self.item()]
            while self.op(","):
                x.returning.append(self.item())
        return x

    def insert(self) -> N:
        self.need("INSERT")
        x = N("insert", mode="INSERT")
        if self.take("OR"):
            x.mode = "OR UPDATE" if self.take("UPDATE") else self.take("IGNORE") and "OR IGNORE" or self.fail()
        self.take("INTO")
        x.table = self.path()
        x.columns = self.names()
        if self.take("VALUES"):
            x.rows = []
            while True:
                self.need_op("(")
                x.rows.append(self.listed(lambda: None if self.take("DEFAULT") else self.expr()))
                if not self.op(","):
                    break
        else:
            x.query = self.query()
        if self.take("ON", "CONFLICT"):
            x.target = self.names() if self.is_op("(") else None
            if self.take("ON", "UNIQUE", "CONSTRAINT"):
                x.constraint = self.name()
            self.need("DO")
            if self.take("NOTHING"):
                x.conflict = "NOTHING"
            else:
                self.need("UPDATE", "SET")
                x.conflict, x.sets = "UPDATE", self.sets()
                if self.take("WHERE"):
                    x.conflict_where = self.expr()
        return self.returning(x)

    def sets(self) -> list:
        out = []
        while True:
            name = self.path().split(".")[-1]
            self.need_op("=")
            out.append((name, None if self.take("DEFAULT") else self.expr()))
            if not self.op(","):
                return out

    def update(self) -> N:
        self.need("UPDATE")
        x = N("update", table=self.path())
        x.alias = self.alias() if not self.word("SET") else None
        self.need("SET")
        x.sets = self.sets()
        self.need("WHERE")
        x.where = self.expr()
        return self.returning(x)

    def delete(self) -> N:
        self.need("DELETE")
        self.take("FROM")
        x = N("delete", table=self.path())
        x.alias = self.alias() if not self.word("WHERE") else None
        self.need("WHERE")
        x.where = self.expr()
        return self.returning(x)

    def end(self, x):
        self.op(";")
        if self.now.kind != "end":
            self.fail()
        return x


def parse_query(sql: str) -> N:
    p = Parser(sql)
    return p.end(p.query())


def parse_expression(sql: str) -> N:
    p = Parser(sql)
    return p.end(p.expr())


def parse(sql: str) -> N:
    """A query or a data change."""
    p = Parser(sql)
    for word, f in (("INSERT", p.insert), ("UPDATE", p.update), ("DELETE", p.delete)):
        if p.word(word):
            return p.end(f())
    return p.end(p.query())
