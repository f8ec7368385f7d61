"""A database: queries, data changes, schema statements, key reads, transactions and state files."""

from __future__ import annotations

import contextlib
import datetime
import json
import time
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, ColumnDef, Index, Sequence, Table, empty
from .errors import AlreadyExists, EngineError, FailedPrecondition, InvalidArgument, NotFound, OutOfRange
from .functions import udfs
from .functions.base import X
from .plans.compiler import Compiler, Scope, Source, b, literal
from .session import configured
from .sources.storage import appended, snapshot
from .sql.ddl import parse_ddl
from .sql.parser import N, Parser, parse, parse_expression
from .types import NUMBERS, is_array, spark_type

#: Cells that one group of mutations may write.
MOST_CELLS = 80_000
#: Stands for the commit's timestamp in written values.
COMMIT_TIMESTAMP = object()


@dataclass(frozen=True)
class KeyRange:
    """Keys from start to end, each a tuple that may be a prefix; closed ends belong to it."""

    start: tuple = ()
    end: tuple = ()
    start_closed: bool = True
    end_closed: bool = False


@dataclass(frozen=True)
class KeySet:
    """All rows, or point keys and ranges."""

    keys: tuple = ()
    ranges: tuple = ()
    all: bool = False


@dataclass
class Mutation:
    kind: str  # insert, update, insert_or_update, replace, delete
    table: str
    columns: tuple = ()
    rows: tuple = ()
    keys: KeySet | None = None


@contextlib.contextmanager
def errors():
    """Spark's errors as the engine's."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as e:
        kind = e.getCondition() if isinstance(e, PySparkException) else ""
        text = str(e)
        if any(w in (kind or "") + text for w in ("OVERFLOW", "DIVIDE_BY_ZERO", "REMAINDER_BY_ZERO", "OUT_OF_RANGE", "INVALID_ARRAY_INDEX")):
            raise OutOfRange(text) from e
        raise InvalidArgument(text) from e


@dataclass(frozen=True)
class Partition:
    """One part of a query's rows; frame() reads it."""

    db: Database
    sql: str
    params: dict | None
    index: int
    count: int

    def frame(self) -> DataFrame:
        df = self.db.query(self.sql, self.params)
        return df.where(F.pmod(F.xxhash64(*[F.col(b(c)) for c in df.columns]), F.lit(self.count)) == self.index)


class Database:
    def __init__(self, spark: SparkSession, extended: bool = False):
        self.spark = configured(spark)
        if not getattr(spark, "_lq_udfs", False):
            udfs.register(spark)
            spark._lq_udfs = True
        self.catalog, self.extended = Catalog(spark), extended
        #: Called with the text of each statement before it runs: a request log, or a fault if one raises an EngineError.
        self.observers: list = []

    # queries
    def register(self, name: str, df: DataFrame, key: list[str] = ()) -> Database:
        """df as a table of this database."""
        self.catalog.register(name, df, key)
        return self

    def compile(self, sql: str, params: dict | None = None) -> str:
        """The Spark SQL of a query."""
        n = parse(sql)
        if n.kind not in ("select", "query"):
            raise InvalidArgument("a query is needed")
        return Compiler(self.catalog, params, self.extended).statement(n).sql

    def query(self, sql: str, params: dict | None = None) -> DataFrame:
        """A query as a lazy DataFrame."""
        self._observe(sql)
        return self._query(sql, params)

    def _query(self, sql: str, params: dict | None = None) -> DataFrame:
        with errors():
            return self.spark.sql(self.compile(sql, params))

    def _observe(self, sql: str) -> None:
        for f in self.observers:
            f(sql)

    def partition_query(self, sql: str, params: dict | None = None, count: int = 1) -> list[Partition]:
        """Parts of a query's rows by their hash: disjoint, together all of them, each to be read by itself, in any process."""
        return [Partition(self, sql, params, k, count) for k in range(count)]

    def profile(self, sql: str, params: dict | None = None) -> dict:
        """Runs a query for its plan, its number of rows and the seconds it took (query modes PROFILE and WITH_STATS)."""
        df, began = self.query(sql, params), time.perf_counter()
        with errors():
            n = df.count()
        return {"plan": self._plan(df), "rows_returned": n, "elapsed": time.perf_counter() - began}

    def rows(self, sql: str, params: dict | None = None) -> list:
        with errors():
            return self.query(sql, params).collect()

    def scalar(self, sql: str, params: dict | None = None):
        """The first cell, None without rows."""
        r = self.rows(sql, params)
        return r[0][0] if r else None

    def stream(self, sql: str, params: dict | None = None):
        """Rows one by one, a partition at a time on the driver."""
        return self.query(sql, params).toLocalIterator()

    def explain(self, sql: str, params: dict | None = None) -> str:
        """The physical plan (query mode PLAN)."""
        return self._plan(self.query(sql, params))

    def _plan(self, df: DataFrame) -> str:
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def execute(self, sql: str, params: dict | None = None):
        """Any statement: a query or THEN RETURN gives a DataFrame, a data change a row count, a schema statement None."""
        self._observe(sql)
        head = Parser(sql).now.up
        if head in ("CREATE", "DROP", "ALTER"):
            return self.ddl(sql)
        n = parse(sql)
        if n.kind in ("select", "query"):
            return self._query(sql, params)
        held, self.catalog = self.catalog, self.catalog.copy()
        try:
            with errors():
                count, returned = getattr(self, f"_{n.kind}")(n, params)
        except BaseException:
            self.catalog = held
            raise
        return count if returned is None else returned

    def batch(self, statements: list) -> list[int]:
        """Data changes one after another up to the first that fails; its error has the counts so far in .counts."""
        counts = []
        for s in statements:
            try:
                r = self.execute(*((s,) if isinstance(s, str) else s))
                counts.append(r.count() if isinstance(r, DataFrame) else r)
            except EngineError as e:
                e.counts = counts
                raise
        return counts

    # rows of a change
    def _view(self, df: DataFrame) -> str:
        from .catalog import _numbers

        name = f"lq_r{next(_numbers)}"
        df.createOrReplaceTempView(name)
        return name

    def _cast(self, x: X, c: ColumnDef) -> str:
        if x.type == c.type or x.type == "NULL":
            return f"cast({x.sql} as {spark_type(c.type)})"
        ok = c.type in NUMBERS and x.type in NUMBERS and not (c.type == "INT64") or x.type == "STRING" and c.type in ("DATE", "TIMESTAMP", "BYTES", "JSON", "UUID") or is_array(c.type) and is_array(x.type) or {c.type, x.type} <= {"STRING", "JSON", "UUID", "DATETIME", "TIMESTAMP"}
        if not ok and "." not in str(c.type):
            raise InvalidArgument(f"column {c.name} has type {c.type}, not {x.type}")
        if x.type == "STRING" and c.type == "TIMESTAMP":
            return Compiler(self.catalog).converted(x, "TIMESTAMP").sql
        return f"cast({x.sql} as {spark_type(c.type)})"

    def _completed(self, t: Table, df: DataFrame, given: list[str]) -> DataFrame:
        """df of the given columns with defaults for the others and generated columns."""
        c = Compiler(self.catalog)
        has = {g.lower() for g in given}
        cols = []
        for d in t.columns:
            if d.name.lower() in has:
                if d.generated:
                    raise InvalidArgument(f"column {d.name} is generated")
                cols.append(f"{b(d.name)}")
            elif d.default is not None and not d.generated:
                cols.append(f"{self._cast(c.expr(parse_expression(d.default), Scope()), d)} AS {b(d.name)}")
            else:
                cols.append(f"cast(null as {spark_type(d.type)}) AS {b(d.name)}")
        return self._generated(t, self.spark.sql(f"SELECT {', '.join(cols)} FROM {self._view(df)}"))

    def _generated(self, t: Table, df: DataFrame) -> DataFrame:
        if not any(d.generated for d in t.columns):
            return df
        view = self._view(df)
        scope = Scope([Source(t.name, Compiler(self.catalog).columns_of(view, [(d.name, d.type) for d in t.columns]))])
        cols = [f"{self._cast(Compiler(self.catalog).expr(parse_expression(d.generated), scope), d)} AS {b(d.name)}" if d.generated else f"{b(view)}.{b(d.name)}" for d in t.columns]
        return self.spark.sql(f"SELECT {', '.join(cols)} FROM {view}")

    def _same(self, left: DataFrame, right: DataFrame, keys: list[str], other: list[str] | None = None):
        return reduce(lambda x, y: x & y, [left[k].eqNullSafe(right[o]) for k, o in zip(keys, other or keys, strict=True)], F.lit(True))

    def _without(self, df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
        g = gone.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
        return df.join(g, self._same(df, g, keys, [f"__k{i}" for i in range(len(keys))]), "left_anti")

    def _among(self, df: DataFrame, some: DataFrame, keys: list[str], how: str = "left_semi", other: list[str] | None = None) -> DataFrame:
        g = some.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(other or keys)]).distinct()
        return df.join(g, self._same(df, g, keys, [f"__k{i}" for i in range(len(keys))]), how)

    def _check_rows(self, t: Table, df: DataFrame) -> None:
        """NOT NULL, length, CHECK, parent and foreign key rules of new rows."""
        bad = []
        for d in t.columns:
            if d.not_null or d.name in t.keys and d.not_null:
                bad.append((F.col(b(d.name)).isNull(), FailedPrecondition, f"column {d.name} is NULL"))
            if d.limit and d.type in ("STRING", "BYTES"):
                size = F.length(b(d.name)) if d.type == "STRING" else F.octet_length(b(d.name))
                bad.append((size > d.limit, FailedPrecondition, f"column {d.name} is longer than {d.limit}"))
        if t.checks:
            view = self._view(df)
            c = Compiler(self.catalog)
            scope = Scope([Source(t.name, c.columns_of(view, [(d.name, d.type) for d in t.columns]))])
            for k in t.checks:
                if not self.spark.sql(f"SELECT 1 FROM {view} WHERE NOT {c.expr(parse_expression(k.text), scope).sql} LIMIT 1").isEmpty():
                    raise OutOfRange(f"check constraint {k.name} is violated")
        if bad:
            found = df.agg(*[F.max(F.coalesce(cond, F.lit(False)).cast("int")).alias(f"c{i}") for i, (cond, _, _) in enumerate(bad)]).first()
            for i, (_, kind, message) in enumerate(bad):
                if found[i]:
                    raise kind(message)
        if t.parent:
            p = self.catalog.table(t.parent)
            if not self._among(df, p.df, [t.column(k).name for k in p.keys], "left_anti", p.keys).isEmpty():
                raise NotFound(f"a parent row in {p.name} is missing")
        for f in t.foreign:
            if f.enforced:
                p = t if f.table.lower() == t.name.lower() else self.catalog.table(f.table)
                rows = df.where(reduce(lambda x, y: x & y, [F.col(b(c)).isNotNull() for c in f.columns]))
                target = p.df.select(*f.to).union(df.select(*f.to)) if p is t else p.df
                if not self._among(rows, target, f.columns, "left_anti", f.to).isEmpty():
                    raise FailedPrecondition(f"foreign key {f.name} is violated")

    def _check_unique(self, t: Table, df: DataFrame) -> None:
        for i in self.catalog.indexes.values():
            if i.unique and i.table.lower() == t.name.lower():
                cols = [c for c, _ in i.columns]
                rows = df.where(reduce(lambda x, y: x & y, [F.col(b(c)).isNotNull() for c in cols])) if i.filtered else df
                if not rows.groupBy(*cols).count().where("count > 1").isEmpty():
                    raise AlreadyExists(f"unique index {i.name} is violated")

    def _store(self, t: Table, df: DataFrame, changed: DataFrame | None) -> None:
        """Checks and swaps in a new snapshot."""
        df = snapshot(df.select(*[b(c.name) for c in t.columns]), t.name)
        if changed is not None:
            self._check_rows(t, changed)
        self._check_unique(t, df)
        self.catalog.tables[t.name.lower()] = t.holding(df)

    def _append(self, t: Table, new: DataFrame) -> None:
        """Checks new rows and adds them; the old ones are not written again."""
        new = new.select(*[b(c.name) for c in t.columns])
        self._check_rows(t, new)
        df = appended(t.df, new, t.name)
        self._check_unique(t, df)
        self.catalog.tables[t.name.lower()] = t.holding(df)

    def _insert_rows(self, t: Table, new: DataFrame, given: list[str], mode: str, conflict=None, params=None) -> DataFrame:
        """Writes complete rows; returns the rows written, with __action."""
        keys, old = t.keys, t.df
        if keys and new.groupBy(*keys).count().where("count > 1").limit(1).count():
            if mode in ("OR IGNORE", "NOTHING"):
                new = new.dropDuplicates(keys)
            elif mode in ("INSERT", "UPDATE"):
                raise AlreadyExists(f"{t.name}: two rows have one key")
        target = [t.column(c).name for c in conflict.target] if conflict is not None and conflict.target else keys
        if conflict is not None and conflict.constraint:
            target = [c for c, _ in next((i.columns for i in self.catalog.indexes.values() if i.name.lower() == conflict.constraint.lower()), t.key)]
        hit = self._among(new, old, target) if keys else new.limit(0)
        fresh = self._among(new, old, target, "left_anti") if keys else new
        if mode == "INSERT":
            if not hit.isEmpty():
                raise AlreadyExists(f"{t.name}: a row with this key exists")
            self._append(t, new)
            return new.withColumn("__action", F.lit("INSERT"))
        if mode in ("OR IGNORE", "NOTHING"):
            self._append(t, fresh)
            return fresh.withColumn("__action", F.lit("INSERT"))
        if mode == "REPLACE":
            self._store(t, self._without(old, new, keys).unionByName(new), new)
            return new.withColumn("__action", F.lit("UPDATE"))
        o, e = self._view(old), self._view(hit)
        on = " AND ".join(f"{b(o)}.{b(k)} <=> {b(e)}.{b(k)}" for k in target)
        c = Compiler(self.catalog, params)
        if mode == "OR UPDATE":
            has = {g.lower() for g in given}
            cols = [f"{b(e if d.name.lower() in has or d.generated else o)}.{b(d.name)} AS {b(d.name)}" for d in t.columns]
            where = ""
        else:
            own = c.columns_of(o, [(d.name, d.type) for d in t.columns])
            scope = Scope([Source(t.name, own), Source("EXCLUDED", [replace_name(x, e) for x in own])])
            scope.sources[1].merged = {d.name.lower() for d in t.columns}
            sets = {k.lower(): v for k, v in conflict.sets}
            if any(k.lower() in sets for k in keys):
                raise InvalidArgument("a key column cannot be updated")
            cols = [f"{self._cast(c.expr(sets[d.name.lower()], scope), d)} AS {b(d.name)}" if d.name.lower() in sets else f"{b(o)}.{b(d.name)} AS {b(d.name)}" for d in t.columns]
            where = f" WHERE {c.expr(conflict.conflict_where, scope).sql}" if conflict.conflict_where is not None else ""
        merged = self._generated(t, self.spark.sql(f"SELECT {', '.join(cols)} FROM {o} JOIN {e} ON {on}{where}"))
        changed = merged.withColumn("__action", F.lit("UPDATE")).unionByName(fresh.withColumn("__action", F.lit("INSERT")))
        changed = snapshot(changed, t.name + "_changed")
        rows = changed.drop("__action")
        self._store(t, self._without(old, rows, keys).unionByName(rows), rows)
        return changed

    def _returning(self, n: N, t: Table, changed: DataFrame, params) -> tuple[int, DataFrame | None]:
        count = changed.count()
        if n.returning is None:
            return count, None
        view = self._view(changed)
        c = Compiler(self.catalog, params)
        columns = [*[(d.name, d.type, d.hidden) for d in t.columns], ("__action", "STRING", True)]
        scope = Scope([Source(n.alias or t.name, c.columns_of(view, columns))])
        items = []
        for it in n.returning:
            items += c.starred(it, scope) if it.kind == "star" else [(it.alias or c.named_by(it.expr) or "", c.expr(it.expr, scope))]
        items = [(name, x if isinstance(x, X) else c.expr(x, scope)) for name, x in items]
        if n.action:
            items.append((n.action, X(f"{b(view)}.`__action`", "STRING")))
        return count, self.spark.sql(f"SELECT {', '.join(f'{x.sql} AS {b(name or f"_c{i}")}' for i, (name, x) in enumerate(items))} FROM {view}")

    def _insert(self, n: N, params):
        t = self.catalog.table(n.table)
        defs = [t.column(c) for c in n.columns]
        c = Compiler(self.catalog, params)
        if n.rows is not None:
            lines = []
            for r in n.rows:
                if len(r) != len(defs):
                    raise InvalidArgument("a row has another number of values than columns")
                values = [self._cast(c.expr(parse_expression(d.default) if v is None and d.default else v or N("literal", value=None), Scope()), d) for v, d in zip(r, defs, strict=True)]
                lines.append("SELECT " + ", ".join(f"{v} AS {b(d.name)}" for v, d in zip(values, defs, strict=True)))
            df = self.spark.sql(" UNION ALL ".join(lines))
        else:
            rel = c.query(n.query, None)
            if len(rel.columns) != len(defs):
                raise InvalidArgument("the query has another number of columns")
            s = c.fresh()
            cols = ", ".join(f"{self._cast(X(f'{b(s)}.{b(name)}', k), d)} AS {b(d.name)}" for (name, k), d in zip(rel.columns, defs, strict=True))
            df = self.spark.sql(f"SELECT {cols} FROM ({rel.sql}) AS {b(s)}")
        new = snapshot(self._completed(t, df, n.columns), t.name + "_new")
        mode = n.conflict or n.mode
        changed = self._insert_rows(t, new, n.columns, mode, n if n.conflict else None, params)
        return self._returning(n, t, changed, params)

    def _update(self, n: N, params):
        t = self.catalog.table(n.table)
        if any(k.lower() in (x.lower() for x in t.keys) for k, _ in n.sets):
            raise InvalidArgument("a key column cannot be updated")
        c = Compiler(self.catalog, params)
        scan, cols = self.catalog.scan(t.name)
        alias = n.alias or t.name
        scope = Scope([Source(alias, c.columns_of(alias, cols))])
        sets = {}
        for k, v in n.sets:
            d = t.column(k)
            if d.generated:
                raise InvalidArgument(f"column {k} is generated")
            sets[d.name] = self._cast(c.expr(v if v is not None else parse_expression(d.default or "NULL"), scope), d)
        select = ", ".join(f"{sets.get(d.name, f'{b(alias)}.{b(d.name)}')} AS {b(d.name)}" for d in t.columns)
        changed = snapshot(self._generated(t, self.spark.sql(f"SELECT {select} FROM {scan} AS {b(alias)} WHERE {c.expr(n.where, scope).sql}")), t.name + "_changed")
        self._store(t, self._without(t.df, changed, t.keys).unionByName(changed), changed)
        return self._returning(n, t, changed.withColumn("__action", F.lit("UPDATE")), params)

    def _delete(self, n: N, params):
        t = self.catalog.table(n.table)
        c = Compiler(self.catalog, params)
        scan, cols = self.catalog.scan(t.name)
        alias = n.alias or t.name
        scope = Scope([Source(alias, c.columns_of(alias, cols))])
        gone = snapshot(self.spark.sql(f"SELECT {b(alias)}.* FROM {scan} AS {b(alias)} WHERE {c.expr(n.where, scope).sql}"), t.name + "_gone")
        self._remove(t, gone)
        return self._returning(n, t, gone.withColumn("__action", F.lit("DELETE")), params)

    def _remove(self, t: Table, gone: DataFrame) -> None:
        """Takes rows out, with what hangs on them."""
        if gone.isEmpty():
            return
        rest = self._without(t.df, gone, t.keys or [c.name for c in t.columns])
        self.catalog.tables[t.name.lower()] = t.holding(snapshot(rest, t.name))
        for k in self.catalog.children(t.name):
            hit = snapshot(self._among(k.df, gone, [k.column(x).name for x in t.keys], other=t.keys), k.name + "_gone")
            if not hit.isEmpty():
                if not k.cascade:
                    raise FailedPrecondition(f"{k.name} has rows below")
                self._remove(self.catalog.table(k.name), hit)
        for o in list(self.catalog.tables.values()):
            for f in o.foreign:
                if f.enforced and f.table.lower() == t.name.lower():
                    hit = snapshot(self._among(self.catalog.table(o.name).df, gone, f.columns, other=f.to), o.name + "_gone")
                    if not hit.isEmpty():
                        if not f.cascade:
                            raise FailedPrecondition(f"foreign key {f.name} refers to these rows")
                        self._remove(self.catalog.table(o.name), hit)

    # mutations and key reads
    def apply(self, mutations: list[Mutation]) -> datetime.datetime:
        """All mutations or none; returns the commit timestamp."""
        if sum(len(m.columns) * len(m.rows) for m in mutations) > MOST_CELLS:
            raise InvalidArgument(f"more than {MOST_CELLS} cells")
        now, held = datetime.datetime.now(datetime.UTC), self.catalog
        self.catalog = held.copy()
        try:
            with errors():
                for m in mutations:
                    self._mutate(m, now)
        except BaseException:
            self.catalog = held
            raise
        return now

    def apply_groups(self, groups: list[list[Mutation]]) -> list[EngineError | None]:
        """Each group on its own: None, or the error that left it unapplied."""
        out: list[EngineError | None] = []
        for g in groups:
            try:
                self.apply(g)
                out.append(None)
            except EngineError as e:
                out.append(e)
        return out

    def _mutate(self, m: Mutation, now) -> None:
        t = self.catalog.table(m.table)
        if m.kind == "delete":
            self._remove(t, snapshot(t.df.where(self._key_filter(t, m.keys)), t.name + "_gone"))
            return
        defs = [t.column(c) for c in m.columns]
        lines = []
        for r in m.rows:
            values = [self._cast(literal(now if v is COMMIT_TIMESTAMP else v), d) for v, d in zip(r, defs, strict=True)]
            lines.append("(" + ", ".join(values) + ")")
        df = self.spark.sql(f"SELECT * FROM VALUES {', '.join(lines)} AS v({', '.join(b(d.name) for d in defs)})")
        df = df.select(*[F.col(b(d.name)).cast(spark_type(d.type)).alias(d.name) for d in defs])
        new = snapshot(self._completed(t, df, list(m.columns)), t.name + "_new")
        if m.kind == "update":
            if self._among(new, t.df, t.keys).count() != len(m.rows):
                raise NotFound(f"{t.name}: a row to update is missing")
        mode = {"insert": "INSERT", "update": "OR UPDATE", "insert_or_update": "OR UPDATE", "replace": "REPLACE"}[m.kind]
        self._insert_rows(t, new, list(m.columns), mode)

    def _key_filter(self, t: Table, keys: KeySet, names: list[str] | None = None):
        if keys.all:
            return F.lit(True)
        names = names or t.keys
        value = lambda v, name: F.expr(self._cast(literal(v), t.column(name)))
        out = F.lit(False)
        for key in keys.keys:
            key = key if isinstance(key, tuple) else (key,)
            out = out | reduce(lambda x, y: x & y, [F.col(b(n)).eqNullSafe(value(v, n)) for n, v in zip(names, key, strict=True)])
        desc = {t.column(n).name: d for n, d in t.key}

        def beyond(key, closed, low):
            """Rows at or after a key (before it, for low False) in key order; a prefix stands for all keys that begin so."""
            cond = F.lit(bool(closed))
            for n, v in reversed(list(zip(names, key, strict=False))):
                x, y = F.col(b(n)), value(v, n)
                after = (x < y) if low == bool(desc.get(n)) else (x > y)
                after = F.coalesce(after, x.isNotNull() & F.lit(v is None) if low else x.isNull() & F.lit(v is not None))
                cond = after | (x.eqNullSafe(y) & cond)
            return cond

        for r in keys.ranges:
            out = out | ((beyond(r.start, r.start_closed, True) if r.start else F.lit(True)) & (beyond(r.end, r.end_closed, False) if r.end else F.lit(True)))
        return out

    def read(self, table: str, keys: KeySet, columns: list[str], limit: int = 0, index: str | None = None) -> DataFrame:
        """Rows by primary key, or by the columns of an index, in key order."""
        t = self.catalog.table(table)
        names = [c for c, _ in self.catalog.indexes[index.lower()].columns] if index else t.keys
        df = self.spark.sql(f"SELECT * FROM {self.catalog.scan(table)[0]}").where(self._key_filter(t, keys, names))
        desc = dict(self.catalog.indexes[index.lower()].columns if index else t.key)
        df = df.orderBy(*[F.col(b(n)).desc() if desc.get(n) else F.col(b(n)).asc() for n in names]).select(*[b(t.column(c).name) for c in columns])
        return df.limit(limit) if limit else df

    def clear(self, schema: bool = False) -> None:
        """Takes all rows, or the schema too, away."""
        if schema:
            self.catalog = Catalog(self.spark)
        for t in list(self.catalog.tables.values()):
            self.catalog.tables[t.name.lower()] = t.holding(t.df.limit(0))

    # transactions
    @contextlib.contextmanager
    def transaction(self, read_only: bool = False):
        """A database on a copy of the catalog; leaving the block commits, an error drops it.

        Commit fails if a table that the transaction changed was changed outside meanwhile.
        """
        tx = Database.__new__(Database)
        tx.spark, tx.extended, tx.catalog, tx.observers = self.spark, self.extended, self.catalog.copy(), self.observers
        before = dict(tx.catalog.tables)
        yield tx
        changed = {k for k in {*before, *tx.catalog.tables} if before.get(k) is not tx.catalog.tables.get(k)}
        if read_only and changed:
            raise FailedPrecondition("a read-only transaction cannot write")
        if any(self.catalog.tables.get(k) is not before.get(k) for k in changed):
            raise FailedPrecondition("a table was changed by another transaction")
        if changed:
            self.catalog = tx.catalog

    # schema statements
    def ddl(self, sql: str) -> None:
        n = parse_ddl(sql)
        held, self.catalog = self.catalog, self.catalog.copy()
        try:
            with errors():
                getattr(self, f"_ddl_{n.kind}")(n)
        except BaseException:
            self.catalog = held
            raise

    def _definition(self, d: N) -> ColumnDef:
        spark_type(d.type)
        return ColumnDef(d.name, d.type, d.text, d.limit, bool(d.not_null), d.default, d.generated, bool(d.stored), bool(d.hidden), tuple(sorted((d.options or {}).items())))

    def _constraint(self, t: Table, k: N, at: int) -> Table:
        if k.kind == "check":
            k.name = k.name or f"CK_{t.name}_{at}"
            return replace(t, checks=(*t.checks, k))
        p = t if k.table.lower() == t.name.lower() else self.catalog.table(k.table)
        for c in k.to:
            p.column(c)
        k.name = k.name or f"FK_{t.name}_{p.name}_{at}"
        return replace(t, foreign=(*t.foreign, k))

    def _ddl_create_table(self, n: N) -> None:
        if n.name.lower() in self.catalog.tables and n.if_not:
            return
        self.catalog.free(n.name)
        columns = tuple(self._definition(c) for c in n.columns)
        if len({c.name.lower() for c in columns}) < len(columns):
            raise InvalidArgument("two columns have one name")
        t = Table(n.name, columns, tuple(n.key or ()), parent=n.parent, cascade=bool(n.cascade), ttl=n.ttl)
        for k in t.keys:
            if is_array(t.column(k).type):
                raise InvalidArgument("a key column cannot be an ARRAY")
        if n.parent:
            p = self.catalog.table(n.parent)
            if [k.lower() for k in t.keys[: len(p.keys)]] != [k.lower() for k in p.keys]:
                raise InvalidArgument("the key must begin with the parent's")
        for i, k in enumerate(n.constraints, 1):
            t = self._constraint(t, k, i)
        self.catalog.tables[n.name.lower()] = t.holding(empty(self.spark, columns))

    def _ddl_alter_table(self, n: N) -> None:
        t = self.catalog.table(n.name)
        if n.add is not None:
            if any(c.name.lower() == n.add.name.lower() for c in t.columns):
                if n.if_not:
                    return
                raise AlreadyExists(f"column {n.add.name}")
            d = self._definition(n.add)
            df = t.df.withColumn(d.name, F.lit(None).cast(spark_type(d.type)))
            t = replace(t, columns=(*t.columns, d))
            if d.default is not None:
                df = df.withColumn(d.name, F.expr(self._cast(Compiler(self.catalog).expr(parse_expression(d.default), Scope()), d)))
            df = self._generated(t, df)
            if d.not_null and d.default is None and not t.df.isEmpty():
                raise FailedPrecondition(f"column {d.name} would be NULL")
            t = t.holding(df)
        elif n.drop:
            c = t.column(n.drop)
            if c.name in t.keys or any(c.name.lower() in [x.lower() for x, _ in i.columns] for i in self.catalog.indexes.values() if i.table.lower() == t.name.lower()):
                raise FailedPrecondition(f"column {c.name} is in use")
            t = replace(t, columns=tuple(x for x in t.columns if x is not c)).holding(t.df.drop(c.name))
        elif n.column:
            c = t.column(n.column)
            if n.type:
                if n.type != c.type and {n.type, c.type} != {"STRING", "BYTES"}:
                    raise InvalidArgument(f"column {c.name} cannot become {n.type}")
                new = replace(c, type=n.type, text=n.text, limit=n.limit, not_null=bool(n.not_null))
            elif n.default is not None:
                new = replace(c, default=n.default)
            elif n.drop_default:
                new = replace(c, default=None)
            else:
                new = replace(c, options=tuple(sorted({**dict(c.options), **n.options}.items())))
            t = replace(t, columns=tuple(new if x is c else x for x in t.columns)).holding(t.df.withColumn(c.name, F.col(b(c.name)).cast(spark_type(new.type))))
            self._check_rows(replace(t, checks=(), foreign=(), parent=None), t.df)
        elif n.constraint is not None:
            t = self._constraint(t, n.constraint, len(t.checks) + len(t.foreign) + 1)
            self._check_rows(t, t.df)
        elif n.drop_constraint:
            name = n.drop_constraint.lower()
            kept = [tuple(k for k in x if k.name.lower() != name) for x in (t.checks, t.foreign)]
            if len(kept[0]) + len(kept[1]) == len(t.checks) + len(t.foreign):
                raise NotFound(f"constraint {n.drop_constraint}")
            t = replace(t, checks=kept[0], foreign=kept[1])
        elif n.on_delete:
            t = replace(t, cascade=n.on_delete == "CASCADE")
        elif n.drop_ttl:
            t = replace(t, ttl=None)
        elif n.ttl:
            t.column(n.ttl[0])
            t = replace(t, ttl=n.ttl)
        self.catalog.tables[t.name.lower()] = t

    def _ddl_create_index(self, n: N) -> None:
        if n.name.lower() in self.catalog.indexes:
            if n.if_not:
                return
            raise AlreadyExists(f"index {n.name}")
        t = self.catalog.table(n.table)
        for c, _ in n.columns:
            t.column(c)
        self.catalog.indexes[n.name.lower()] = Index(n.name, t.name, tuple(n.columns), bool(n.unique), bool(n.filtered), tuple(n.storing or ()), n.parent)
        self._check_unique(t, t.df)

    def _ddl_create_view(self, n: N) -> None:
        if not (n.replace and n.name.lower() in self.catalog.views):
            self.catalog.free(n.name)
        from .sql.parser import parse_query

        Compiler(self.catalog, extended=self.extended).statement(parse_query(n.text))
        self.catalog.views[n.name.lower()] = (n.name, n.text)

    def _ddl_create_sequence(self, n: N) -> None:
        if n.name.lower() in self.catalog.sequences:
            if n.if_not:
                return
            raise AlreadyExists(f"sequence {n.name}")
        self.catalog.sequences[n.name.lower()] = Sequence(n.name, n.options, int(n.options.get("start_with_counter") or 1))

    def _ddl_alter_sequence(self, n: N) -> None:
        s = self.catalog.sequence(n.name)
        new = Sequence(s.name, {**s.options, **n.options}, s.counter)
        if n.options.get("start_with_counter"):
            new.counter = int(n.options["start_with_counter"])
        self.catalog.sequences[n.name.lower()] = new

    def _ddl_create_change_stream(self, n: N) -> None:
        if n.name in self.catalog.streams:
            raise AlreadyExists(f"change stream {n.name}")
        self.catalog.streams[n.name] = {"watch": n.watch, "options": n.options}

    def _ddl_alter_change_stream(self, n: N) -> None:
        if n.name not in self.catalog.streams:
            raise NotFound(f"change stream {n.name}")
        old = self.catalog.streams[n.name]
        self.catalog.streams[n.name] = {"watch": n.watch if n.watch is not None else old["watch"], "options": {**old["options"], **(n.options or {})}}

    def _ddl_create_bundle(self, n: N) -> None:
        self.catalog.bundle |= set(n.names)

    def _ddl_alter_database(self, n: N) -> None:
        self.catalog.options = {**self.catalog.options, **n.options}

    def _ddl_noop(self, n: N) -> None:
        """Search and vector indexes and property graphs are accepted and have no effect."""

    def _ddl_drop(self, n: N) -> None:
        c = self.catalog
        if n.what == "BUNDLE":
            c.bundle = set()
            return
        where: dict[str, Any] = {"TABLE": c.tables, "VIEW": c.views, "INDEX": c.indexes, "SEQUENCE": c.sequences, "CHANGE STREAM": c.streams}
        if n.what not in where:
            raise InvalidArgument(f"DROP {n.what}")
        key = n.name if n.what == "CHANGE STREAM" else n.name.lower()
        if key not in where[n.what]:
            if n.if_:
                return
            raise NotFound(f"{n.what.lower()} {n.name}")
        if n.what == "TABLE":
            c.drop_table(n.name)
        else:
            del where[n.what][key]

    # state files
    def export_state(self, path: str) -> None:
        """Schema statements' outcome as JSON text and rows as Parquet below path."""
        c = self.catalog
        state = {"tables": [_table_state(t) for t in c.tables.values()], "views": list(c.views.values()), "indexes": [i.__dict__ for i in c.indexes.values()], "sequences": [s.__dict__ for s in c.sequences.values()], "streams": c.streams, "bundle": sorted(c.bundle), "options": c.options}
        for t in c.tables.values():
            t.df.write.mode("overwrite").parquet(f"{path}/rows/{t.name.lower()}")
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    def import_state(self, path: str) -> None:
        state = json.loads(self.spark.read.text(f"{path}/state").first()[0])
        c = Catalog(self.spark)
        for s in state["tables"]:
            t = Table(s["name"], tuple(ColumnDef(**{**x, "type": _type(x["type"]), "options": tuple(map(tuple, x["options"]))}) for x in s["columns"]), tuple(map(tuple, s["key"])), parent=s["parent"], cascade=s["cascade"], foreign=tuple(N(**x) for x in s["foreign"]), checks=tuple(N(**x) for x in s["checks"]), ttl=tuple(s["ttl"]) if s["ttl"] else None)
            schema = empty(self.spark, t.columns).schema
            c.tables[t.name.lower()] = t.holding(self.spark.read.schema(schema).parquet(f"{path}/rows/{t.name.lower()}"))
        c.views = {v[0].lower(): tuple(v) for v in state["views"]}
        c.indexes = {i["name"].lower(): Index(**{**i, "columns": tuple(map(tuple, i["columns"])), "storing": tuple(i["storing"])}) for i in state["indexes"]}
        c.sequences = {s["name"].lower(): Sequence(**s) for s in state["sequences"]}
        c.streams, c.bundle, c.options = state["streams"], set(state["bundle"]), state["options"]
        self.catalog = c


def replace_name(c, view: str):
    from .plans.compiler import Column

    return Column(c.name, c.type, f"{b(view)}.{b(c.name)}", c.hidden)


def _type(t):
    return tuple(_type(x) for x in t) if isinstance(t, list) else t


def _table_state(t: Table) -> dict:
    out = {k: getattr(t, k) for k in ("name", "key", "parent", "cascade", "ttl")}
    out["columns"] = [c.__dict__ for c in t.columns]
    out["foreign"], out["checks"] = [k.__dict__ for k in t.foreign], [k.__dict__ for k in t.checks]
    return out
