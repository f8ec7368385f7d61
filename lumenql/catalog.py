"""Tables, views, sequences and the other objects of a database, and what the compiler asks about them."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import AlreadyExists, FailedPrecondition, NotFound, OutOfRange
from .types import of_spark

_numbers = itertools.count()
#: Values that a sequence sets aside for a call that may be made for many rows.
BLOCK = 1 << 46


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: Any
    text: str = ""
    limit: int | None = None
    not_null: bool = False
    default: str | None = None
    generated: str | None = None
    stored: bool = False
    hidden: bool = False
    options: tuple = ()


@dataclass(frozen=True)
class Table:
    """A table's definition with the snapshot of its rows; changes make a new Table."""

    name: str
    columns: tuple[ColumnDef, ...]
    key: tuple[tuple[str, bool], ...] = ()
    df: DataFrame | None = None
    view: str = ""
    parent: str | None = None
    cascade: bool = False
    foreign: tuple = ()
    checks: tuple = ()
    ttl: tuple[str, int] | None = None
    version: int = 0

    def column(self, name: str) -> ColumnDef:
        found = next((c for c in self.columns if c.name.lower() == name.lower()), None)
        if found is None:
            raise NotFound(f"column {name} of {self.name}")
        return found

    @property
    def keys(self) -> list[str]:
        return [self.column(k).name for k, _ in self.key]

    def holding(self, df: DataFrame) -> Table:
        """The table with other rows."""
        view = f"lq_t{next(_numbers)}"
        df.createOrReplaceTempView(view)
        return replace(self, df=df, view=view, version=self.version + 1)


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    columns: tuple
    unique: bool = False
    filtered: bool = False
    storing: tuple = ()
    parent: str | None = None


@dataclass
class Sequence:
    name: str
    options: dict = field(default_factory=dict)
    counter: int = 1


class Catalog:
    """Objects by lower-case name. A copy shares the immutable tables, so a transaction is a copy that is kept or dropped."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.views: dict[str, tuple[str, str]] = {}
        self.indexes: dict[str, Index] = {}
        self.sequences: dict[str, Sequence] = {}
        self.streams: dict[str, dict] = {}
        self.bundle: set[str] = set()
        self.options: dict = {}

    def copy(self) -> Catalog:
        out = Catalog(self.spark)
        for k in ("tables", "views", "indexes", "sequences", "streams", "bundle", "options"):
            setattr(out, k, type(getattr(self, k))(getattr(self, k)))
        return out

    def table(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise NotFound(f"table {name}")
        return self.tables[name.lower()]

    def free(self, name: str) -> None:
        if name.lower() in self.tables or name.lower() in self.views:
            raise AlreadyExists(f"{name} exists")

    def children(self, name: str) -> list[Table]:
        return [t for t in self.tables.values() if (t.parent or "").lower() == name.lower()]

    def register(self, name: str, df: DataFrame, key: list[str] = ()) -> None:
        """df as a table."""
        columns = []
        for f in df.schema.fields:
            t = of_spark(f.dataType, (f.metadata or {}).get("logical"))
            columns.append(ColumnDef(f.name, t, t if isinstance(t, str) else "", not_null=not f.nullable))
        self.tables[name.lower()] = Table(name, tuple(columns), tuple((k, False) for k in key)).holding(df)

    # for the compiler
    def view(self, name: str):
        if name.lower() not in self.views:
            return None
        from .sql.parser import parse_query

        return parse_query(self.views[name.lower()][1])

    def scan(self, name: str) -> tuple[str, list]:
        if name.lower().startswith("information_schema."):
            from .sources.information_schema import frame

            df = frame(self, name.split(".", 1)[1])
            view = f"lq_i{next(_numbers)}"
            df.createOrReplaceTempView(view)
            return view, [(f.name, of_spark(f.dataType)) for f in df.schema.fields]
        t = self.table(name)
        sql = f"`{t.view}`"
        if t.ttl:
            sql = f"(SELECT * FROM {sql} WHERE `{t.ttl[0]}` IS NULL OR cast(`{t.ttl[0]}` as timestamp) >= current_timestamp() - make_interval(0, 0, 0, {t.ttl[1]}))"
        return sql, [(c.name, c.type, c.hidden) for c in t.columns]

    def sequence(self, name: str) -> Sequence:
        if name.lower() not in self.sequences:
            raise NotFound(f"sequence {name}")
        return self.sequences[name.lower()]

    def next_value(self, name: str, many: bool = False) -> str:
        """SQL for the next value, bits reversed over 63; many: for the values of many rows.

        A call for many rows takes a block of the counter with room for all of Spark's row numbers (of 8,192 partitions),
        so no later call gives one of its values again; some 130,000 such calls use a sequence up.
        """
        s = self.sequence(name)
        if not many:
            start, s.counter = s.counter, s.counter + 1
            row = "0L"
        else:
            start = -(-s.counter // BLOCK) * BLOCK
            s.counter = start + BLOCK
            row = f"IF(monotonically_increasing_id() < {BLOCK}L, monotonically_increasing_id(), raise_error('more partitions than a sequence can number'))"
        if s.counter >= 1 << 63:
            raise OutOfRange(f"sequence {name} is used up")
        return f"cast(conv(reverse(lpad(bin({start}L + {row}), 63, '0')), 2, 10) as bigint)"

    def sequence_state(self, name: str) -> str:
        s = self.sequence(name)
        return f"{s.counter - 1}L" if s.counter > 1 else "cast(null as bigint)"

    def drop_table(self, name: str) -> None:
        t = self.table(name)
        if self.children(name):
            raise FailedPrecondition(f"{name} has interleaved tables")
        if any(i.table.lower() == name.lower() for i in self.indexes.values()):
            raise FailedPrecondition(f"{name} has indexes")
        if any(f.table.lower() == name.lower() and o.name != t.name for o in self.tables.values() for f in o.foreign):
            raise FailedPrecondition(f"{name} is referenced by a foreign key")
        del self.tables[name.lower()]


def empty(spark: SparkSession, columns) -> DataFrame:
    from .types import spark_type

    ddl = ", ".join(f"`{c.name}` {spark_type(c.type)}" for c in columns)
    return spark.createDataFrame([], T._parse_datatype_string(ddl))
