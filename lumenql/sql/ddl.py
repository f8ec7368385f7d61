"""Schema statements."""

from __future__ import annotations

from ..errors import InvalidArgument
from .parser import N, Parser


class DdlParser(Parser):
    def text_until(self) -> str:
        """Text inside the parentheses that open here."""
        self.need_op("(")
        start, depth = self.now.at, 1
        while depth:
            if self.now.kind == "end":
                self.fail("unclosed parenthesis")
            depth += self.is_op("(") - self.is_op(")")
            end = self.now.at
            self.i += 1
        return self.sql[start:end]

    def statement(self) -> N:
        if self.take("CREATE"):
            replace = self.take("OR", "REPLACE")
            if self.take("TABLE"):
                return self.table()
            if self.take("VIEW"):
                name = self.path()
                if self.take("SQL", "SECURITY"):
                    self.any_name()
                self.need("AS")
                return self.finish(N("create_view", name=name, text=self.sql[self.now.at :].rstrip("; \n"), replace=replace), skip=True)
            if self.take("SEQUENCE"):
                x = N("create_sequence", if_not=self.take("IF", "NOT", "EXISTS"), name=self.path(), options={})
                x.bit_reversed = self.take("BIT_REVERSED_POSITIVE") or None
                if self.take("OPTIONS"):
                    x.options = self.options()
                return self.finish(x)
            if self.take("CHANGE", "STREAM"):
                x = N("create_change_stream", name=self.path(), watch=None, options={})
                if self.take("FOR"):
                    x.watch = "ALL" if self.take("ALL") else []
                    while x.watch != "ALL":
                        t = self.path()
                        x.watch.append((t, self.listed(self.name) if self.op("(") else None))
                        if not self.op(","):
                            break
                if self.take("OPTIONS"):
                    x.options = self.options()
                return self.finish(x)
            if self.take("PROTO", "BUNDLE"):
                self.need_op("(")
                return self.finish(N("create_bundle", names=self.listed(self.path)))
            if self.word("SEARCH", "VECTOR", "PROPERTY"):
                return self.finish(N("noop"), skip=True)
            x = N("create_index", unique=self.take("UNIQUE"), filtered=self.take("NULL_FILTERED"))
            self.need("INDEX")
            x.if_not = self.take("IF", "NOT", "EXISTS")
            x.name = self.path()
            self.need("ON")
            x.table = self.path()
            self.need_op("(")
            x.columns = self.listed(self.keyed)
            if self.take("STORING"):
                x.storing = self.names()
            if self.op(","):
                self.need("INTERLEAVE", "IN")
                x.parent = self.path()
            return self.finish(x)
        if self.take("DROP"):
            if self.take("PROTO", "BUNDLE"):
                return self.finish(N("drop", what="BUNDLE", name=""))
            if self.word("SEARCH", "VECTOR", "PROPERTY"):
                return self.finish(N("noop"), skip=True)
            what = "CHANGE STREAM" if self.take("CHANGE", "STREAM") else self.any_name().upper()
            return self.finish(N("drop", what=what, if_=self.take("IF", "EXISTS"), name=self.path()))
        if self.take("ALTER"):
            return self.alter()
        self.fail("expected CREATE, DROP or ALTER")

    def finish(self, x: N, skip: bool = False) -> N:
        return x if skip else self.end(x)

    def keyed(self):
        name = self.name()
        desc = self.take("DESC") or (self.take("ASC") and False)
        if self.take("NULLS"):
            self.any_name()
        return (name, bool(desc))

    def options(self) -> dict:
        self.need_op("(")
        out = {}

        def one():
            key = self.any_name()
            self.need_op("=")
            t = self.now
            self.i += 1
            if t.kind == "op" and t.text == "[":
                out[key] = [v.value for v in self.listed(self.atom, "]")]
            else:
                out[key] = t.value if t.value is not None else {"TRUE": True, "FALSE": False, "NULL": None}.get(t.up, t.text)

        self.listed(one)
        return out

    def column_type(self):
        start = self.now.at
        name = self.any_name().upper()
        limit = None
        if name == "ARRAY":
            self.need_op("<")
            inner, limit, _ = self.column_type()
            if isinstance(inner, tuple):
                raise InvalidArgument("an ARRAY cannot hold ARRAY values")
            self.need_op(">")
            return ("ARRAY", inner), limit, self.sql[start : self.now.at].strip()
        while self.op("."):
            name += "." + self.any_name()
        if self.op("("):
            limit = None if self.take("MAX") else self.now.value
            if not self.op(")"):
                self.i += 1
                self.need_op(")")
        return name, limit, self.sql[start : self.now.at].strip()

    def column(self) -> N:
        x = N("column_def", name=self.name())
        x.type, x.limit, x.text = self.column_type()
        x.options = {}
        while True:
            if self.take("NOT", "NULL"):
                x.not_null = True
            elif self.take("DEFAULT"):
                x.default = self.text_until()
            elif self.take("AS"):
                x.generated = self.text_until()
                x.stored = self.take("STORED")
            elif self.take("HIDDEN"):
                x.hidden = True
            elif self.take("OPTIONS"):
                x.options = self.options()
            elif self.take("PRIMARY", "KEY"):
                x.primary = True
            else:
                return x

    def constraint(self) -> N | None:
        name = None
        at = self.i
        if self.take("CONSTRAINT"):
            name = self.name()
        if self.take("CHECK"):
            return N("check", name=name, text=self.text_until())
        if self.take("FOREIGN", "KEY"):
            x = N("foreign", name=name, columns=self.names())
            self.need("REFERENCES")
            x.table, x.to = self.path(), self.names()
            x.cascade = False
            if self.take("ON", "DELETE"):
                x.cascade = self.take("CASCADE") or not self.need("NO", "ACTION") and False
            x.enforced = not self.take("NOT", "ENFORCED")
            self.take("ENFORCED")
            return x
        self.i = at
        return None

    def deletion(self) -> tuple[str, int]:
        self.need_op("(")
        self.need("OLDER_THAN")
        self.need_op("(")
        column = self.name()
        self.need_op(",")
        self.need("INTERVAL")
        days = self.now.value
        self.i += 1
        self.need("DAY")
        self.need_op(")")
        self.need_op(")")
        return (column, days)

    def table(self) -> N:
        x = N("create_table", if_not=self.take("IF", "NOT", "EXISTS"), name=self.path(), columns=[], constraints=[])
        self.need_op("(")
        while not self.op(")"):
            c = self.constraint()
            if c is not None:
                x.constraints.append(c)
            elif self.take("PRIMARY", "KEY"):
                self.need_op("(")
                x.key = self.listed(self.keyed)
            else:
                x.columns.append(self.column())
            if not self.is_op(")"):
                self.need_op(",")
        if self.take("PRIMARY", "KEY"):
            self.need_op("(")
            x.key = self.listed(self.keyed)
        if x.key is None:
            x.key = [(c.name, False) for c in x.columns if c.primary]
        while self.op(","):
            if self.take("INTERLEAVE", "IN"):
                self.take("PARENT")
                x.parent = self.path()
                x.cascade = False
                if self.take("ON", "DELETE"):
                    x.cascade = self.take("CASCADE") or not self.need("NO", "ACTION") and False
            else:
                self.need("ROW", "DELETION", "POLICY")
                x.ttl = self.deletion()
        return self.finish(x)

    def alter(self) -> N:
        if self.take("DATABASE"):
            name = self.name()
            self.need("SET", "OPTIONS")
            return self.finish(N("alter_database", name=name, options=self.options()))
        if self.take("SEQUENCE", ):
            name = self.path()
            self.need("SET", "OPTIONS")
            return self.finish(N("alter_sequence", name=name, options=self.options()))
        if self.take("CHANGE", "STREAM"):
            x = N("alter_change_stream", name=self.path())
            if self.take("SET", "OPTIONS"):
                x.options = self.options()
            elif self.take("DROP", "FOR", "ALL"):
                x.watch = []
            else:
                self.need("SET", "FOR")
                x.watch = "ALL" if self.take("ALL") else []
                while x.watch != "ALL":
                    t = self.path()
                    x.watch.append((t, self.listed(self.name) if self.op("(") else None))
                    if not self.op(","):
                        break
            return self.finish(x)
        if not self.take("TABLE"):
            return self.finish(N("noop"), skip=True)
        x = N("alter_table", name=self.path())
        if self.take("ADD", "COLUMN"):
            x.if_not = self.take("IF", "NOT", "EXISTS")
            x.add = self.column()
        elif self.take("ADD", "ROW", "DELETION", "POLICY") or self.take("REPLACE", "ROW", "DELETION", "POLICY"):
            x.ttl = self.deletion()
        elif self.take("DROP", "ROW", "DELETION", "POLICY"):
            x.drop_ttl = True
        elif self.take("ADD"):
            x.constraint = self.constraint() or self.fail()
        elif self.take("DROP", "CONSTRAINT"):
            x.drop_constraint = self.name()
        elif self.take("DROP"):
            self.take("COLUMN")
            x.drop = self.name()
        elif self.take("SET", "ON", "DELETE"):
            x.on_delete = "CASCADE" if self.take("CASCADE") else self.need("NO", "ACTION") or "NO ACTION"
        else:
            self.need("ALTER", "COLUMN")
            x.column = self.name()
            if self.take("SET", "OPTIONS"):
                x.options = self.options()
            elif self.take("SET", "DEFAULT"):
                x.default = self.text_until()
            elif self.take("DROP", "DEFAULT"):
                x.drop_default = True
            else:
                x.type, x.limit, x.text = self.column_type()
                x.not_null = self.take("NOT", "NULL")
        return self.finish(x)


def parse_ddl(sql: str) -> N:
    p = DdlParser(sql)
    p.sql = sql
    return p.statement()
