"""INFORMATION_SCHEMA tables, computed from the catalog."""

from __future__ import annotations

from ..errors import NotFound

# The columns of each table.
TABLES = {
    "TABLES": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME TABLE_TYPE PARENT_TABLE_NAME ON_DELETE_ACTION SPANNER_STATE",
    "COLUMNS": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME ORDINAL_POSITION IS_NULLABLE SPANNER_TYPE COLUMN_DEFAULT GENERATION_EXPRESSION IS_GENERATED IS_STORED SPANNER_STATE",
    "INDEXES": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME INDEX_NAME INDEX_TYPE PARENT_TABLE_NAME IS_UNIQUE IS_NULL_FILTERED INDEX_STATE SPANNER_IS_MANAGED",
    "INDEX_COLUMNS": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME INDEX_NAME COLUMN_NAME ORDINAL_POSITION COLUMN_ORDERING IS_NULLABLE SPANNER_TYPE",
    "TABLE_CONSTRAINTS": "CONSTRAINT_CATALOG CONSTRAINT_SCHEMA CONSTRAINT_NAME TABLE_CATALOG TABLE_SCHEMA TABLE_NAME CONSTRAINT_TYPE IS_DEFERRABLE INITIALLY_DEFERRED ENFORCED",
    "CONSTRAINT_COLUMN_USAGE": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME CONSTRAINT_CATALOG CONSTRAINT_SCHEMA CONSTRAINT_NAME",
    "REFERENTIAL_CONSTRAINTS": "CONSTRAINT_CATALOG CONSTRAINT_SCHEMA CONSTRAINT_NAME UNIQUE_CONSTRAINT_CATALOG UNIQUE_CONSTRAINT_SCHEMA UNIQUE_CONSTRAINT_NAME MATCH_OPTION UPDATE_RULE DELETE_RULE SPANNER_STATE",
    "CHECK_CONSTRAINTS": "CONSTRAINT_CATALOG CONSTRAINT_SCHEMA CONSTRAINT_NAME CHECK_CLAUSE SPANNER_STATE",
    "SCHEMATA": "CATALOG_NAME SCHEMA_NAME",
    "VIEWS": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME VIEW_DEFINITION",
    "SEQUENCES": "CATALOG SCHEMA NAME DATA_TYPE",
    "SEQUENCE_OPTIONS": "CATALOG SCHEMA NAME OPTION_NAME OPTION_TYPE OPTION_VALUE",
    "COLUMN_OPTIONS": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME OPTION_NAME OPTION_TYPE OPTION_VALUE",
    "KEY_COLUMN_USAGE": "CONSTRAINT_CATALOG CONSTRAINT_SCHEMA CONSTRAINT_NAME TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME ORDINAL_POSITION POSITION_IN_UNIQUE_CONSTRAINT",
    "DATABASE_OPTIONS": "CATALOG_NAME SCHEMA_NAME OPTION_NAME OPTION_TYPE OPTION_VALUE",
    "CONSTRAINT_TABLE_USAGE": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME CONSTRAINT_CATALOG CONSTRAINT_SCHEMA CONSTRAINT_NAME",
    "CHANGE_STREAMS": "CHANGE_STREAM_CATALOG CHANGE_STREAM_SCHEMA CHANGE_STREAM_NAME ALL",
    "CHANGE_STREAM_TABLES": "CHANGE_STREAM_CATALOG CHANGE_STREAM_SCHEMA CHANGE_STREAM_NAME TABLE_CATALOG TABLE_SCHEMA TABLE_NAME ALL_COLUMNS",
    "CHANGE_STREAM_COLUMNS": "CHANGE_STREAM_CATALOG CHANGE_STREAM_SCHEMA CHANGE_STREAM_NAME TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME",
    "CHANGE_STREAM_OPTIONS": "CHANGE_STREAM_CATALOG CHANGE_STREAM_SCHEMA CHANGE_STREAM_NAME OPTION_NAME OPTION_TYPE OPTION_VALUE",
    "SPANNER_STATISTICS": "CATALOG_NAME SCHEMA_NAME PACKAGE_NAME ALLOW_GC",
}
LONG, BOOL = ("ORDINAL_POSITION", "POSITION_IN_UNIQUE_CONSTRAINT"), ("IS_UNIQUE", "IS_NULL_FILTERED", "SPANNER_IS_MANAGED", "ALL_COLUMNS", "ALLOW_GC", "ALL")


def column_type(c) -> str:
    return c.text or (c.type if isinstance(c.type, str) else f"{c.type[0]}<{c.type[1]}>")


def _options(options, *head):
    kind = {bool: "BOOL", int: "INT64", float: "FLOAT64"}
    return [(*head, k, kind.get(type(v), "STRING"), str(v)) for k, v in sorted(dict(options).items())]


def rows(catalog, name: str) -> list[tuple]:
    tables = sorted(catalog.tables.values(), key=lambda t: t.name)
    indexes = sorted(catalog.indexes.values(), key=lambda i: i.name)
    s = ("", "")
    constraints = []  # (name, table, type, columns, node)
    for t in tables:
        if t.key:
            constraints.append((f"PK_{t.name}", t, "PRIMARY KEY", t.keys, None))
        constraints += [(f.name, t, "FOREIGN KEY", f.columns, f) for f in t.foreign] + [(k.name, t, "CHECK", [], k) for k in t.checks]
        constraints += [(f"CK_IS_NOT_NULL_{t.name}_{c.name}", t, "CHECK", [c.name], c) for c in t.columns if c.not_null]
    if name == "TABLES":
        return [(*s, t.name, "BASE TABLE", t.parent, ("CASCADE" if t.cascade else "NO ACTION") if t.parent else None, "COMMITTED") for t in tables] + [(*s, v, "VIEW", None, None, None) for v, _ in catalog.views.values()]
    if name == "COLUMNS":
        return [(*s, t.name, c.name, i, "NO" if c.not_null else "YES", column_type(c), c.default, c.generated, "ALWAYS" if c.generated else "NEVER", ("YES" if c.stored else "NO") if c.generated else None, "COMMITTED") for t in tables for i, c in enumerate(t.columns, 1)]
    if name == "INDEXES":
        return [(*s, t.name, "PRIMARY_KEY", "PRIMARY_KEY", "", True, False, None, False) for t in tables if t.key] + [(*s, i.table, i.name, "INDEX", i.parent or "", i.unique, i.filtered, "READ_WRITE", False) for i in indexes]
    if name == "INDEX_COLUMNS":
        out = []
        for t, index, cols, storing in [(t, "PRIMARY_KEY", t.key, ()) for t in tables if t.key] + [(catalog.table(i.table), i.name, i.columns, i.storing) for i in indexes]:
            for k, (c, desc) in enumerate(cols, 1):
                d = t.column(c)
                out.append((*s, t.name, index, d.name, k, "DESC" if desc else "ASC", "NO" if d.not_null else "YES", column_type(d)))
            for c in storing:
                d = t.column(c)
                out.append((*s, t.name, index, d.name, None, None, "NO" if d.not_null else "YES", column_type(d)))
        return out
    if name == "TABLE_CONSTRAINTS":
        return [(*s, n, *s, t.name, kind, "NO", "NO", "NO" if kind == "FOREIGN KEY" and not node.enforced else "YES") for n, t, kind, _, node in constraints]
    if name in ("CONSTRAINT_COLUMN_USAGE", "CONSTRAINT_TABLE_USAGE"):
        use = [(n, catalog.table(node.table).name if kind == "FOREIGN KEY" else t.name, node.to if kind == "FOREIGN KEY" else cols) for n, t, kind, cols, node in constraints]
        return [(*s, t, c, *s, n) for n, t, cols in use for c in cols] if name == "CONSTRAINT_COLUMN_USAGE" else [(*s, t, *s, n) for n, t, _ in use]
    if name == "REFERENTIAL_CONSTRAINTS":
        return [(*s, n, *s, f"PK_{node.table}", "SIMPLE", "NO ACTION", "CASCADE" if node.cascade else "NO ACTION", "COMMITTED") for n, _, kind, _, node in constraints if kind == "FOREIGN KEY"]
    if name == "CHECK_CONSTRAINTS":
        return [(*s, n, node.text if hasattr(node, "kind") else f"{node.name} IS NOT NULL", "COMMITTED") for n, _, kind, _, node in constraints if kind == "CHECK"]
    if name == "SCHEMATA":
        return [("", ""), ("", "INFORMATION_SCHEMA"), ("", "SPANNER_SYS")]
    if name == "VIEWS":
        return [(*s, v, text) for v, text in catalog.views.values()]
    if name == "SEQUENCES":
        return [(*s, q.name, "INT64") for q in catalog.sequences.values()]
    if name == "SEQUENCE_OPTIONS":
        return [r for q in catalog.sequences.values() for r in _options(q.options, *s, q.name)]
    if name == "COLUMN_OPTIONS":
        return [r for t in tables for c in t.columns for r in _options(c.options, *s, t.name, c.name)]
    if name == "KEY_COLUMN_USAGE":
        return [(*s, n, *s, t.name, c, i, i if kind == "FOREIGN KEY" else None) for n, t, kind, cols, _ in constraints if kind != "CHECK" for i, c in enumerate(cols, 1)]
    if name == "DATABASE_OPTIONS":
        return _options({"database_dialect": "GOOGLE_STANDARD_SQL", **catalog.options}, *s)
    streams = sorted(catalog.streams.items())
    if name == "CHANGE_STREAMS":
        return [(*s, k, v["watch"] == "ALL") for k, v in streams]
    if name == "CHANGE_STREAM_TABLES":
        return [(*s, k, *s, t, cols is None) for k, v in streams if v["watch"] not in (None, "ALL") for t, cols in v["watch"]]
    if name == "CHANGE_STREAM_COLUMNS":
        return [(*s, k, *s, t, c) for k, v in streams if v["watch"] not in (None, "ALL") for t, cols in v["watch"] for c in cols or ()]
    if name == "CHANGE_STREAM_OPTIONS":
        return [r for k, v in streams for r in _options(v["options"], *s, k)]
    if name == "SPANNER_STATISTICS":
        return [("", "", "auto", True)]
    raise NotFound(f"INFORMATION_SCHEMA.{name}")


def frame(catalog, name: str):
    name = name.upper()
    if name not in TABLES:
        raise NotFound(f"INFORMATION_SCHEMA.{name}")
    schema = ", ".join(f"`{c}` {'bigint' if c in LONG else 'boolean' if c in BOOL else 'string'}" for c in TABLES[name].split())
    return catalog.spark.createDataFrame(rows(catalog, name), schema)
