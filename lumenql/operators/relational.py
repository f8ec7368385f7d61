"""The same operators as a fluent API: each step adds a clause of dialect SQL, compiled by the same binder."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Relation:
    """A query that is being put together; steps return new relations. Expressions are dialect text."""

    db: object
    source: str
    columns: tuple = ("*",)
    filters: tuple = ()
    keys: tuple = ()
    groups: tuple = ()
    first: str = ""
    order: tuple = ()
    most: int | None = None
    skip: int | None = None
    unique: bool = False

    def where(self, *conditions: str) -> Relation:
        if self.keys or self.groups or self.most is not None or self.first:
            return self._nested().where(*conditions)
        return replace(self, filters=(*self.filters, *conditions))

    def select(self, *columns: str) -> Relation:
        return replace(self._nested() if self.columns != ("*",) else self, columns=columns)

    def group_by(self, *keys: str, **aggregates: str) -> Relation:
        """Keys, and aggregates as name="SUM(x)"."""
        base = self._nested() if self.columns != ("*",) or self.keys else self
        return replace(base, keys=keys, columns=(*keys, *[f"{v} AS {k}" for k, v in aggregates.items()]))

    def having(self, condition: str) -> Relation:
        return replace(self, groups=(*self.groups, condition))

    def is_first(self, k: int, by: str, order: str) -> Relation:
        """The first k rows of each partition."""
        return replace(self, first=f"IS_FIRST({k}) OVER (PARTITION BY {by} ORDER BY {order})")

    def distinct(self) -> Relation:
        return replace(self, unique=True)

    def order_by(self, *keys: str) -> Relation:
        return replace(self, order=keys)

    def limit(self, n: int, offset: int | None = None) -> Relation:
        return replace(self, most=n, skip=offset)

    def join(self, other: str | Relation, on: str, how: str = "INNER", alias: str = "r") -> Relation:
        right = other if isinstance(other, str) else f"({other.sql()}) AS {alias}"
        base = self._nested() if self.filters or self.columns != ("*",) else self
        return replace(base, source=f"{base.source} {how} JOIN {right} ON {on}")

    def union_all(self, other: Relation) -> Relation:
        return Relation(self.db, f"({self.sql()} UNION ALL {other.sql()})")

    def _nested(self) -> Relation:
        return Relation(self.db, f"({self.sql()})")

    def sql(self) -> str:
        text = f"SELECT {'DISTINCT ' if self.unique else ''}{', '.join(self.columns)} FROM {self.source}"
        if self.filters or self.first:
            text += " WHERE " + (" AND ".join(f"({c})" for c in self.filters) or "TRUE")
        if self.keys:
            text += " GROUP BY " + ", ".join(self.keys)
        if self.groups:
            text += " HAVING " + " AND ".join(f"({c})" for c in self.groups)
        if self.first:
            text += f" QUALIFY {self.first}"
        if self.order:
            text += " ORDER BY " + ", ".join(self.order)
        if self.most is not None:
            text += f" LIMIT {self.most}" + (f" OFFSET {self.skip}" if self.skip is not None else "")
        return text

    def frame(self, params: dict | None = None) -> DataFrame:
        return self.db.query(self.sql(), params)
