"""Registered queries on schema statements, data changes, mutations, reads, transactions and the catalog's tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from .database import Database, KeyRange, KeySet, Mutation
from .errors import EngineError, Unavailable
from .queries import ORACLES, QUERIES, change, database
from .sources.storage import folder

SCHEMA = (
    "CREATE TABLE Regions (Id INT64 NOT NULL, Name STRING(30), Big BOOL DEFAULT (FALSE), Label STRING(MAX) AS (CONCAT('r-', LOWER(Name))) STORED) PRIMARY KEY (Id)",
    "CREATE TABLE Nations (Id INT64 NOT NULL, Nation INT64 NOT NULL, Name STRING(30), Score INT64 DEFAULT (7), CONSTRAINT score_range CHECK (Score < 1000)) PRIMARY KEY (Id, Nation DESC), INTERLEAVE IN PARENT Regions ON DELETE CASCADE",
    "CREATE TABLE Traders (Trader INT64 NOT NULL, Region INT64, Note STRING(MAX), CONSTRAINT of_region FOREIGN KEY (Region) REFERENCES Regions (Id)) PRIMARY KEY (Trader)",
    "CREATE UNIQUE NULL_FILTERED INDEX RegionByName ON Regions (Name)",
    "CREATE INDEX NationByScore ON Nations (Score DESC) STORING (Name)",
    "CREATE VIEW BigNations SQL SECURITY INVOKER AS SELECT Id, Nation, Name FROM Nations WHERE Nation > 12",
    "CREATE SEQUENCE Numbers OPTIONS (sequence_kind = 'bit_reversed_positive')",
    "CREATE CHANGE STREAM Watch FOR Regions (Name), Nations OPTIONS (retention_period = '36h')",
    "CREATE CHANGE STREAM WatchAll FOR ALL",
)
FILL = ("INSERT INTO Regions (Id, Name) SELECT r_regionkey, r_name FROM region", "INSERT INTO Nations (Id, Nation, Name) SELECT n_regionkey, n_nationkey, n_name FROM nation", "INSERT INTO Traders (Trader, Region) SELECT s_suppkey, MOD(s_suppkey, 5) FROM supplier")
#: The tables above as DuckDB sees them.
REGIONS = "(SELECT CAST(r_regionkey AS BIGINT) AS Id, r_name AS Name, false AS Big, 'r-' || lower(r_name) AS Label FROM region)"
NATIONS = "(SELECT CAST(n_regionkey AS BIGINT) AS Id, CAST(n_nationkey AS BIGINT) AS Nation, n_name AS Name, CAST(7 AS BIGINT) AS Score FROM nation)"


def scene(name: str, do, oracle: str, fill: bool = True) -> None:
    """Registers do(db), run on a database with SCHEMA, filled from the driver's tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, "region nation supplier")
        for s in SCHEMA:
            db.ddl(s)
        for s in FILL if fill else ():
            db.execute(s)
        return do(db)

    QUERIES[name], ORACLES[name] = run, oracle


def values(columns: str, *rows: tuple) -> str:
    """DuckDB text of constant rows."""
    say = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) v({columns})"


def look(name: str, sql: str, oracle: str, *before: str) -> None:
    """Registers a query after schema statements or data changes on the scene."""

    def do(db: Database) -> DataFrame:
        for s in before:
            db.execute(s)
        return db.query(sql)

    scene(name, do, oracle)


def outcome(db: Database, *statements: str) -> DataFrame:
    """(step, result): the row count of each statement, or the name of the error it raises."""
    rows = []
    for k, s in enumerate(statements):
        try:
            r = db.execute(s)
            rows.append((k, str(r.count() if isinstance(r, DataFrame) else r)))
        except EngineError as e:
            rows.append((k, type(e).__name__))
    return db.spark.createDataFrame(rows, "step bigint, result string")


# the catalog's tables
look("is_tables", "SELECT TABLE_NAME, TABLE_TYPE, PARENT_TABLE_NAME AS parent, ON_DELETE_ACTION AS act FROM INFORMATION_SCHEMA.TABLES", values("TABLE_NAME, TABLE_TYPE, parent, act", ("Regions", "BASE TABLE", None, None), ("Nations", "BASE TABLE", "Regions", "CASCADE"), ("Traders", "BASE TABLE", None, None), ("region", "BASE TABLE", None, None), ("nation", "BASE TABLE", None, None), ("supplier", "BASE TABLE", None, None), ("BigNations", "VIEW", None, None)))
look("is_columns", "SELECT COLUMN_NAME, ORDINAL_POSITION AS k, IS_NULLABLE, SPANNER_TYPE, IS_GENERATED, IS_STORED FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_NAME = 'Regions'", values("COLUMN_NAME, k, IS_NULLABLE, SPANNER_TYPE, IS_GENERATED, IS_STORED", ("Id", 1, "NO", "INT64", "NEVER", None), ("Name", 2, "YES", "STRING(30)", "NEVER", None), ("Big", 3, "YES", "BOOL", "NEVER", None), ("Label", 4, "YES", "STRING(MAX)", "ALWAYS", "YES")))
look("is_indexes", "SELECT TABLE_NAME, INDEX_NAME, INDEX_TYPE, IS_UNIQUE, IS_NULL_FILTERED FROM INFORMATION_SCHEMA.INDEXES WHERE TABLE_NAME IN ('Regions', 'Nations')", values("TABLE_NAME, INDEX_NAME, INDEX_TYPE, IS_UNIQUE, IS_NULL_FILTERED", ("Regions", "PRIMARY_KEY", "PRIMARY_KEY", True, False), ("Nations", "PRIMARY_KEY", "PRIMARY_KEY", True, False), ("Regions", "RegionByName", "INDEX", True, True), ("Nations", "NationByScore", "INDEX", False, False)))
look("is_index_columns", "SELECT TABLE_NAME, INDEX_NAME, COLUMN_NAME, ORDINAL_POSITION AS k, COLUMN_ORDERING FROM INFORMATION_SCHEMA.INDEX_COLUMNS WHERE TABLE_NAME IN ('Regions', 'Nations')", values("TABLE_NAME, INDEX_NAME, COLUMN_NAME, k, COLUMN_ORDERING", ("Regions", "PRIMARY_KEY", "Id", 1, "ASC"), ("Nations", "PRIMARY_KEY", "Id", 1, "ASC"), ("Nations", "PRIMARY_KEY", "Nation", 2, "DESC"), ("Regions", "RegionByName", "Name", 1, "ASC"), ("Nations", "NationByScore", "Score", 1, "DESC"), ("Nations", "NationByScore", "Name", None, None)))
look("is_table_constraints", "SELECT CONSTRAINT_NAME, TABLE_NAME, CONSTRAINT_TYPE, ENFORCED FROM INFORMATION_SCHEMA.TABLE_CONSTRAINTS WHERE TABLE_NAME IN ('Nations', 'Traders')", values("CONSTRAINT_NAME, TABLE_NAME, CONSTRAINT_TYPE, ENFORCED", ("PK_Nations", "Nations", "PRIMARY KEY", "YES"), ("score_range", "Nations", "CHECK", "YES"), ("CK_IS_NOT_NULL_Nations_Id", "Nations", "CHECK", "YES"), ("CK_IS_NOT_NULL_Nations_Nation", "Nations", "CHECK", "YES"), ("PK_Traders", "Traders", "PRIMARY KEY", "YES"), ("of_region", "Traders", "FOREIGN KEY", "YES"), ("CK_IS_NOT_NULL_Traders_Trader", "Traders", "CHECK", "YES")))
look("is_constraint_columns", "SELECT CONSTRAINT_NAME, TABLE_NAME, COLUMN_NAME FROM INFORMATION_SCHEMA.CONSTRAINT_COLUMN_USAGE WHERE CONSTRAINT_NAME IN ('PK_Nations', 'of_region')", values("CONSTRAINT_NAME, TABLE_NAME, COLUMN_NAME", ("PK_Nations", "Nations", "Id"), ("PK_Nations", "Nations", "Nation"), ("of_region", "Regions", "Id")))
look("is_constraint_tables", "SELECT CONSTRAINT_NAME, TABLE_NAME FROM INFORMATION_SCHEMA.CONSTRAINT_TABLE_USAGE WHERE CONSTRAINT_NAME IN ('PK_Nations', 'of_region', 'score_range')", values("CONSTRAINT_NAME, TABLE_NAME", ("PK_Nations", "Nations"), ("of_region", "Regions"), ("score_range", "Nations")))
look("is_referential", "SELECT CONSTRAINT_NAME, UNIQUE_CONSTRAINT_NAME AS target, DELETE_RULE FROM INFORMATION_SCHEMA.REFERENTIAL_CONSTRAINTS", values("CONSTRAINT_NAME, target, DELETE_RULE", ("of_region", "PK_Regions", "NO ACTION")))
look("is_checks", "SELECT CONSTRAINT_NAME, CHECK_CLAUSE FROM INFORMATION_SCHEMA.CHECK_CONSTRAINTS WHERE CONSTRAINT_NAME LIKE '%Nations%' OR CONSTRAINT_NAME = 'score_range'", values("CONSTRAINT_NAME, CHECK_CLAUSE", ("score_range", "Score < 1000"), ("CK_IS_NOT_NULL_Nations_Id", "Id IS NOT NULL"), ("CK_IS_NOT_NULL_Nations_Nation", "Nation IS NOT NULL")))
look("is_schemata", "SELECT SCHEMA_NAME FROM INFORMATION_SCHEMA.SCHEMATA", values("SCHEMA_NAME", ("",), ("INFORMATION_SCHEMA",), ("SPANNER_SYS",)))
look("is_views", "SELECT TABLE_NAME, STRPOS(VIEW_DEFINITION, 'FROM Nations') > 0 AS reads FROM INFORMATION_SCHEMA.VIEWS", values("TABLE_NAME, reads", ("BigNations", True)))
look("is_sequences", "SELECT s.NAME AS name, s.DATA_TYPE AS kind, o.OPTION_NAME AS opt, o.OPTION_VALUE AS val FROM INFORMATION_SCHEMA.SEQUENCES s JOIN INFORMATION_SCHEMA.SEQUENCE_OPTIONS o ON s.NAME = o.NAME", values("name, kind, opt, val", ("Numbers", "INT64", "sequence_kind", "bit_reversed_positive")))
look("is_column_options", "SELECT TABLE_NAME, COLUMN_NAME, OPTION_NAME, OPTION_TYPE, OPTION_VALUE FROM INFORMATION_SCHEMA.COLUMN_OPTIONS", values("TABLE_NAME, COLUMN_NAME, OPTION_NAME, OPTION_TYPE, OPTION_VALUE", ("Traders", "Seen", "allow_commit_timestamp", "BOOL", "True")), "ALTER TABLE Traders ADD COLUMN Seen TIMESTAMP OPTIONS (allow_commit_timestamp = true)")
look("is_key_columns", "SELECT CONSTRAINT_NAME, COLUMN_NAME, ORDINAL_POSITION AS k, POSITION_IN_UNIQUE_CONSTRAINT AS u FROM INFORMATION_SCHEMA.KEY_COLUMN_USAGE WHERE TABLE_NAME IN ('Nations', 'Traders')", values("CONSTRAINT_NAME, COLUMN_NAME, k, u", ("PK_Nations", "Id", 1, None), ("PK_Nations", "Nation", 2, None), ("PK_Traders", "Trader", 1, None), ("of_region", "Region", 1, 1)))
look("is_database_options", "SELECT OPTION_NAME, OPTION_VALUE FROM INFORMATION_SCHEMA.DATABASE_OPTIONS", values("OPTION_NAME, OPTION_VALUE", ("database_dialect", "GOOGLE_STANDARD_SQL"), ("version_retention_period", "7d")), "ALTER DATABASE db SET OPTIONS (version_retention_period = '7d')")
look("is_streams", "SELECT CHANGE_STREAM_NAME AS s, `ALL` AS every FROM INFORMATION_SCHEMA.CHANGE_STREAMS", values("s, every", ("Watch", False), ("WatchAll", True)))
look("is_stream_tables", "SELECT CHANGE_STREAM_NAME AS s, TABLE_NAME, ALL_COLUMNS FROM INFORMATION_SCHEMA.CHANGE_STREAM_TABLES", values("s, TABLE_NAME, ALL_COLUMNS", ("Watch", "Regions", False), ("Watch", "Nations", True)))
look("is_stream_columns", "SELECT CHANGE_STREAM_NAME AS s, TABLE_NAME, COLUMN_NAME FROM INFORMATION_SCHEMA.CHANGE_STREAM_COLUMNS", values("s, TABLE_NAME, COLUMN_NAME", ("Watch", "Regions", "Name")))
look("is_stream_options", "SELECT CHANGE_STREAM_NAME AS s, OPTION_NAME, OPTION_VALUE FROM INFORMATION_SCHEMA.CHANGE_STREAM_OPTIONS", values("s, OPTION_NAME, OPTION_VALUE", ("Watch", "retention_period", "36h")))
look("is_statistics", "SELECT PACKAGE_NAME, ALLOW_GC FROM INFORMATION_SCHEMA.SPANNER_STATISTICS", values("PACKAGE_NAME, ALLOW_GC", ("auto", True)))
# views, defaults, generated columns, schema changes
look("view_scan", "SELECT v.Id, v.Name FROM BigNations v JOIN Regions r ON v.Id = r.Id WHERE r.Name <> 'ASIA'", f"SELECT n.Id, n.Name FROM {NATIONS} n JOIN {REGIONS} r ON n.Id = r.Id WHERE n.Nation > 12 AND r.Name <> 'ASIA'")
look("default_generated", "SELECT r.Id, r.Big, r.Label, n.Score FROM Regions r JOIN Nations n ON r.Id = n.Id", f"SELECT r.Id, r.Big, r.Label, n.Score FROM {REGIONS} r JOIN {NATIONS} n ON r.Id = n.Id")
look("generated_again", "SELECT Id, Label FROM Regions", f"SELECT Id, CASE WHEN Id = 2 THEN 'r-new' ELSE Label END AS Label FROM {REGIONS}", "UPDATE Regions SET Name = 'NEW' WHERE Id = 2")
look("alter_table", "SELECT * FROM Traders", "SELECT CAST(s_suppkey AS BIGINT) AS Trader, CAST(s_suppkey % 5 AS BIGINT) AS Region, CASE WHEN s_suppkey < 5 THEN 'x' END AS Extra FROM supplier", "ALTER TABLE Traders DROP COLUMN Note", "ALTER TABLE Traders ADD COLUMN Extra STRING(5)", "UPDATE Traders SET Extra = 'x' WHERE Trader < 5", "ALTER TABLE Traders ALTER COLUMN Extra STRING(9)")
scene(
    "drops", lambda db: outcome(db, "DROP TABLE Regions", "DROP VIEW BigNations", "DROP INDEX NationByScore", "DROP TABLE Nations", "DROP CHANGE STREAM Watch", "DROP SEQUENCE Numbers", "ALTER TABLE Traders DROP CONSTRAINT of_region", "INSERT INTO Traders (Trader, Region) VALUES (999999, 77)", "CREATE TABLE Traders (x INT64) PRIMARY KEY (x)", "DROP TABLE Nowhere"),
    values("step, result", (0, "FailedPrecondition"), (1, "None"), (2, "None"), (3, "None"), (4, "None"), (5, "None"), (6, "None"), (7, "1"), (8, "AlreadyExists"), (9, "NotFound")),
)
scene(
    "ddl_without_effect", lambda db: outcome(db, "CREATE SEARCH INDEX Words ON Traders (Note)", "CREATE PROPERTY GRAPH G NODE TABLES (Regions)", "CREATE PROTO BUNDLE (a.b.C)", "ALTER DATABASE db SET OPTIONS (x = 1)", "CREATE TABLE IF NOT EXISTS Traders (x INT64) PRIMARY KEY (x)"),
    values("step, result", *[(k, "None") for k in range(5)]),
)
# constraints
scene(
    "constraints", lambda db: outcome(
        db, "INSERT INTO Regions (Id, Name) VALUES (0, 'again')", "INSERT INTO Regions (Id, Name) VALUES (50, 'ASIA')", "INSERT INTO Regions (Id, Name) VALUES (51, NULL), (52, NULL)", "INSERT INTO Regions (Id, Name) VALUES (53, 'a name that is far too long to be kept')",
        "INSERT INTO Nations (Id, Nation, Score) VALUES (1, 800, 1000)", "INSERT INTO Nations (Id, Nation, Score) VALUES (1, 800, NULL)", "INSERT INTO Nations (Id, Nation) VALUES (77, 1)", "INSERT INTO Nations (Id) VALUES (1)",
        "INSERT INTO Traders (Trader, Region) VALUES (900001, 77)", "INSERT INTO Traders (Trader, Region) VALUES (900001, NULL)", "DELETE FROM Regions WHERE Id = 1", "DELETE FROM Regions WHERE Id = 51", "UPDATE Regions SET Id = 9 WHERE Id = 1", "DELETE FROM Regions", "UPDATE Regions SET Name = 'ASIA' WHERE Id = 0",
    ),
    values("step, result", (0, "AlreadyExists"), (1, "AlreadyExists"), (2, "2"), (3, "FailedPrecondition"), (4, "OutOfRange"), (5, "1"), (6, "NotFound"), (7, "FailedPrecondition"), (8, "FailedPrecondition"), (9, "1"), (10, "FailedPrecondition"), (11, "1"), (12, "InvalidArgument"), (13, "InvalidArgument"), (14, "AlreadyExists")),
)
look("delete_cascade", "SELECT Id, Nation, Name FROM Nations", f"SELECT Id, Nation, Name FROM {NATIONS} WHERE Id <> 3", "UPDATE Traders SET Region = NULL WHERE Region = 3", "DELETE FROM Regions WHERE Id = 3")
look("foreign_cascade", "SELECT Trader, Region FROM Traders", "SELECT CAST(s_suppkey AS BIGINT) AS Trader, CAST(s_suppkey % 5 AS BIGINT) AS Region FROM supplier WHERE s_suppkey % 5 <> 3", "ALTER TABLE Traders DROP CONSTRAINT of_region", "ALTER TABLE Traders ADD CONSTRAINT gone FOREIGN KEY (Region) REFERENCES Regions (Id) ON DELETE CASCADE", "DELETE FROM Regions WHERE Id = 3")
look("or_ignore", "SELECT Id, Name FROM Regions", f"SELECT Id, Name FROM {REGIONS} UNION ALL SELECT 8, 'EIGHT'", "INSERT OR IGNORE INTO Regions (Id, Name) VALUES (0, 'no'), (8, 'EIGHT')")


def _batch(db: Database) -> DataFrame:
    counts = db.batch(["UPDATE Nations SET Score = 8 WHERE Id = 1", "DELETE FROM Nations WHERE Id = 2", "INSERT INTO Nations (Id, Nation) VALUES (2, 100)"])
    try:
        db.batch(["DELETE FROM Traders WHERE Trader = 1", "DELETE FROM Nowhere WHERE TRUE", "DELETE FROM Traders WHERE TRUE"])
    except EngineError as e:
        counts += [*e.counts, -1]
    return db.spark.createDataFrame(list(enumerate(counts)), "step bigint, changed bigint")


scene("batch_changes", _batch, "SELECT CAST(0 AS BIGINT) AS step, COUNT(*) AS changed FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 1, COUNT(*) FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 2, 1 UNION ALL SELECT 3, 1 UNION ALL SELECT 4, -1")
scene("scalar_and_counts", lambda db: db.spark.createDataFrame([(db.scalar("SELECT MAX(Nation) FROM Nations"), db.execute("DELETE FROM Nations WHERE Id = 0"), len(list(db.stream("SELECT Id FROM Nations"))))], "top bigint, gone bigint, streamed bigint"), "SELECT CAST(MAX(n_nationkey) AS BIGINT) AS top, COUNT(*) FILTER (WHERE n_regionkey = 0) AS gone, COUNT(*) FILTER (WHERE n_regionkey <> 0) AS streamed FROM nation")


# mutations and key reads
def _mutations(db: Database) -> DataFrame:
    db.apply([
        Mutation("insert", "Regions", ("Id", "Name"), ((10, "TEN"), (11, "ELEVEN"))), Mutation("update", "Regions", ("Id", "Name"), ((0, "ZERO"),)), Mutation("insert_or_update", "Regions", ("Id", "Big"), ((1, True), (12, True))),
        Mutation("replace", "Regions", ("Id", "Big"), ((2, True),)), Mutation("delete", "Regions", keys=KeySet(keys=((11,),))),
    ])
    return db.query("SELECT Id, Name, Big FROM Regions")


scene("mutations", _mutations, f"SELECT Id, CASE Id WHEN 0 THEN 'ZERO' WHEN 2 THEN NULL ELSE Name END AS Name, Id IN (1, 2) AS Big FROM {REGIONS} UNION ALL SELECT 10, 'TEN', false UNION ALL SELECT 12, NULL, true")


def _groups(db: Database) -> DataFrame:
    done = db.apply_groups([[Mutation("insert", "Regions", ("Id", "Name"), ((20, "A"),))], [Mutation("insert", "Regions", ("Id", "Name"), ((21, "B"), (0, "C")))], [Mutation("delete", "Traders", keys=KeySet(all=True))]])
    rows = [(f"group {k}", type(e).__name__ if e else "done") for k, e in enumerate(done)]
    rows += [("regions", str(db.scalar("SELECT COUNT(*) FROM Regions"))), ("traders", str(db.scalar("SELECT COUNT(*) FROM Traders")))]
    return db.spark.createDataFrame(rows, "what string, result string")


scene("batch_write", _groups, "SELECT * FROM (VALUES ('group 0', 'done'), ('group 1', 'AlreadyExists'), ('group 2', 'done'), ('traders', '0')) v(what, result) UNION ALL SELECT 'regions', CAST(COUNT(*) + 1 AS VARCHAR) FROM region")


def _reads(db: Database) -> DataFrame:
    found = [db.read("Nations", keys, ["Id", "Nation"], limit) for keys, limit in ((KeySet(keys=((1, 1), (2, 8), (9, 9))), 0), (KeySet(ranges=(KeyRange((3,), (4,), True, False),)), 0), (KeySet(all=True), 3))]
    out = None
    for k, d in enumerate(found):
        d = d.selectExpr(f"{k}L AS read", "Id", "Nation")
        out = d if out is None else out.unionAll(d)
    return out


scene("key_reads", _reads, f"SELECT CAST(0 AS BIGINT) AS read, Id, Nation FROM {NATIONS} WHERE (Id, Nation) IN ((1, 1), (2, 8), (9, 9)) UNION ALL SELECT 1, Id, Nation FROM {NATIONS} WHERE Id = 3 UNION ALL SELECT 2, Id, Nation FROM (SELECT * FROM {NATIONS} ORDER BY Id, Nation DESC LIMIT 3)")


def _range_delete(db: Database) -> DataFrame:
    db.apply([Mutation("delete", "Nations", keys=KeySet(ranges=(KeyRange((1,), (3,), False, True),)))])
    return db.query("SELECT Id, Nation FROM Nations")


scene("range_delete", _range_delete, f"SELECT Id, Nation FROM {NATIONS} WHERE Id NOT IN (2, 3)")


# transactions, state, clearing
def _transaction(db: Database) -> DataFrame:
    rows = []
    with db.transaction() as tx:
        tx.execute("DELETE FROM Nations WHERE Id < 2")
        rows.append(("outside", db.scalar("SELECT COUNT(*) FROM Nations")))
        rows.append(("inside", tx.scalar("SELECT COUNT(*) FROM Nations")))
    rows.append(("committed", db.scalar("SELECT COUNT(*) FROM Nations")))
    try:
        with db.transaction() as tx:
            tx.execute("DELETE FROM Nations WHERE TRUE")
            raise ValueError
    except ValueError:
        rows.append(("rolled back", db.scalar("SELECT COUNT(*) FROM Nations")))
    try:
        with db.transaction(read_only=True) as tx:
            tx.execute("DELETE FROM Nations WHERE TRUE")
    except EngineError:
        rows.append(("read only", db.scalar("SELECT COUNT(*) FROM Nations")))
    return db.spark.createDataFrame(rows, "state string, n bigint")


scene("transactions", _transaction, "SELECT 'outside' AS state, COUNT(*) AS n FROM nation UNION ALL SELECT s, (SELECT COUNT(*) FROM nation WHERE n_regionkey >= 2) FROM (VALUES ('inside'), ('committed'), ('rolled back'), ('read only')) v(s)")


def _state(db: Database) -> DataFrame:
    path = f"{folder(db.spark)}/state-{uuid.uuid4().hex}"
    db.export_state(path)
    db.clear(schema=True)
    other = Database(db.spark)
    other.import_state(path)
    return other.query("SELECT n.Id, n.Nation, r.Label FROM Nations n JOIN Regions r ON n.Id = r.Id")


scene("state_files", _state, f"SELECT n.Id, n.Nation, r.Label FROM {NATIONS} n JOIN {REGIONS} r ON n.Id = r.Id")


def _clear(db: Database) -> DataFrame:
    db.clear()
    rows = [("rows", db.scalar("SELECT COUNT(*) FROM Regions"))]
    db.clear(schema=True)
    return db.spark.createDataFrame([*rows, ("tables", db.scalar("SELECT COUNT(*) FROM INFORMATION_SCHEMA.TABLES"))], "what string, n bigint")


scene("clear_all", _clear, values("what, n", ("rows", 0), ("tables", 0)))


# sequences, TTL, plans
def _sequence(db: Database) -> DataFrame:
    db.ddl("CREATE TABLE Numbered (K INT64 NOT NULL, Name STRING(MAX)) PRIMARY KEY (K)")
    for _ in range(3):
        db.execute("INSERT INTO Numbered (K, Name) SELECT GET_NEXT_SEQUENCE_VALUE(SEQUENCE Numbers), n_name FROM nation")
    one = [db.scalar("SELECT GET_NEXT_SEQUENCE_VALUE(SEQUENCE Numbers)") for _ in range(3)]
    return db.query(f"SELECT Name, COUNT(*) AS n, LOGICAL_AND(K > 0) AS positive, {str(len(set(one)) == 3).upper()} AS apart FROM Numbered GROUP BY Name")


scene("sequence_values", _sequence, "SELECT n_name AS Name, CAST(3 AS BIGINT) AS n, true AS positive, true AS apart FROM nation")
scene("sequence_state", lambda db: db.spark.createDataFrame([(db.scalar("SELECT GET_INTERNAL_SEQUENCE_STATE(SEQUENCE Numbers)"), db.scalar("SELECT GET_NEXT_SEQUENCE_VALUE(SEQUENCE Numbers)"), db.scalar("SELECT GET_INTERNAL_SEQUENCE_STATE(SEQUENCE Numbers)"))], "before bigint, value bigint, after bigint"), "SELECT CAST(NULL AS BIGINT) AS before, CAST(4611686018427387904 AS BIGINT) AS value, CAST(1 AS BIGINT) AS after", fill=False)


def _ttl(db: Database) -> DataFrame:
    db.ddl("CREATE TABLE Old (K INT64 NOT NULL, At TIMESTAMP) PRIMARY KEY (K), ROW DELETION POLICY (OLDER_THAN(At, INTERVAL 30 DAY))")
    db.execute("INSERT INTO Old (K, At) SELECT n_nationkey, IF(n_regionkey = 0, NULL, TIMESTAMP_SUB(CURRENT_TIMESTAMP(), INTERVAL (n_nationkey * 2) DAY)) FROM nation")
    return db.query("SELECT K FROM Old")


scene("row_deletion_policy", _ttl, "SELECT CAST(n_nationkey AS BIGINT) AS K FROM nation WHERE n_regionkey = 0 OR n_nationkey * 2 < 30")
scene("commit_timestamp", lambda db: (db.ddl("CREATE TABLE Seen (K INT64 NOT NULL, At TIMESTAMP OPTIONS (allow_commit_timestamp = true)) PRIMARY KEY (K)"), db.execute("INSERT INTO Seen (K, At) SELECT n_nationkey, PENDING_COMMIT_TIMESTAMP() FROM nation"), db.query("SELECT K, At > TIMESTAMP '2024-01-01 00:00:00+00' AS late FROM Seen"))[-1], "SELECT CAST(n_nationkey AS BIGINT) AS K, true AS late FROM nation")


def _plans(db: Database) -> DataFrame:
    plan = db.explain("SELECT Name FROM Nations WHERE Score > 3")
    return db.spark.createDataFrame([("Scan parquet" in plan, "PushedFilters: [IsNotNull(Score), GreaterThan(Score,3)]" in plan)], "scans boolean, pushed boolean")


def _partitions(db: Database) -> DataFrame:
    out = None
    for k, p in enumerate(db.partition_query("SELECT Nation, Name FROM Nations WHERE Id <> 2", count=4)):
        d = p.frame().selectExpr("Nation", "Name")
        out = d if out is None else out.unionAll(d)
    return out


scene("partition_reads", _partitions, f"SELECT Nation, Name FROM {NATIONS} WHERE Id <> 2")


def _profile(db: Database) -> DataFrame:
    p = db.profile("SELECT Nation FROM Nations WHERE Id = 1")
    return db.spark.createDataFrame([("rows", p["rows_returned"]), ("timed", int(p["elapsed"] >= 0)), ("planned", int("Scan parquet" in p["plan"]))], "what string, n bigint")


scene("query_profile", _profile, "SELECT 'rows' AS what, COUNT(*) AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT * FROM (VALUES ('timed', 1), ('planned', 1))")


def _observed(db: Database) -> DataFrame:
    seen = []

    def fail_deletes(text: str) -> None:
        seen.append(text.split()[0])
        if text.startswith("DELETE"):
            raise Unavailable("injected")

    db.observers.append(fail_deletes)
    db.scalar("SELECT COUNT(*) FROM Nations")
    result = outcome(db, "UPDATE Nations SET Score = 1 WHERE Id = 1", "DELETE FROM Nations WHERE TRUE").collect()
    db.observers.clear()
    rows = [(f"step {r['step']}", "changed" if r["result"].isdigit() else r["result"]) for r in result] + [("log", ",".join(seen)), ("left", str(db.scalar("SELECT COUNT(*) FROM Nations")))]
    return db.spark.createDataFrame(rows, "what string, result string")


scene("faults_and_log", _observed, "SELECT * FROM (VALUES ('step 0', 'changed'), ('step 1', 'Unavailable'), ('log', 'SELECT,UPDATE,DELETE')) v(what, result) UNION ALL SELECT 'left', CAST(COUNT(*) AS VARCHAR) FROM nation")
scene("query_plan", _plans, "SELECT true AS scans, true AS pushed")

#: Statements outside the dialect, or wrong, with the error each must raise.
ERRORS = (
    ("SELECT 7 % 2 AS x", "Unimplemented"), ("SELECT LAST_DAY(DATE '2024-01-01') AS x", "Unimplemented"), ("SELECT ARRAY_SUM([1, 2]) AS x", "Unimplemented"), ("SELECT ARRAY_AVG([1, 2]) AS x", "Unimplemented"),
    ("SELECT GENERATE_TIMESTAMP_ARRAY(CURRENT_TIMESTAMP(), CURRENT_TIMESTAMP(), INTERVAL 1 DAY) AS x", "Unimplemented"), ("SELECT JSON_EXTRACT('{}', '$') AS x", "Unimplemented"), ("SELECT JSON_EXTRACT_SCALAR('{}', '$') AS x", "Unimplemented"),
    ("SELECT n_name LIKE ANY ('A%') AS x FROM nation", "Unimplemented"), ("SELECT n_name LIKE ALL ('A%', '%a') AS x FROM nation", "Unimplemented"), ("SELECT n_name FROM nation ORDER BY n_name NULLS LAST", "Unimplemented"), ("SELECT ROW_NUMBER() OVER (ORDER BY n_name) AS x FROM nation", "Unimplemented"),
    ("SELECT SUM(n_nationkey) AS x FROM nation WHERE SUM(n_nationkey) > 1", "InvalidArgument"), ("SELECT n_name, COUNT(*) AS x FROM nation", "InvalidArgument"), ("SELECT n_nationkey FROM nation GROUP BY ROLLUP (n_nationkey)", "NotFound"),
    ("SELECT COUNT(*) FILTER (WHERE TRUE) AS x FROM nation", "InvalidArgument"), ("SELECT nothing FROM nation", "NotFound"), ("SELECT NO_SUCH(1) AS x", "NotFound"), ("SELECT 1 / 0 AS x", "OutOfRange"),
    ("SELECT CAST('x' AS INT64) AS x", "InvalidArgument"), ("SELECT 9223372036854775807 + n_nationkey AS x FROM nation", "OutOfRange"), ("SELECT ERROR('said so') AS x", "InvalidArgument"), ("SELECT [1, 2][OFFSET(2)] AS x", "InvalidArgument"), ("SELECT 1 UNION SELECT 2", "InvalidArgument"),
    ("SELECT CORR(n_nationkey, n_regionkey) AS x FROM nation", "NotFound"),
)


def errors_raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of the error that each statement of ERRORS raises."""
    db, rows = database(spark, sf_dir, "nation region"), []
    for sql, _ in ERRORS:
        try:
            db.rows(sql)
            rows.append((sql, "none"))
        except EngineError as e:
            rows.append((sql, type(e).__name__))
    return spark.createDataFrame(rows, "statement string, error string")


QUERIES["errors_raised"] = errors_raised
ORACLES["errors_raised"] = values("statement, error", *ERRORS)


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user with gaps of two hours, the batch form of the streaming extension."""
    from pyspark.sql import functions as F

    from .streaming.windows import sessions

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    d = sessions(events, "ts", "2 hours", ("user_id",), n=F.count("*"))
    return d.select("user_id", "n", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("start"))


QUERIES["session_windows"] = session_windows
ORACLES["session_windows"] = "SELECT user_id, COUNT(*) AS n, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS start FROM (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events read as a stream, with a watermark, into a table in the shared folder."""
    from pyspark.sql import functions as F

    from .streaming.windows import windowed

    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*events*.parquet" if not sf_dir.startswith("viewfs") else "*").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    d = windowed(stream, "ts", "1 hour", n=F.count("*"))
    name = f"lq_stream_{os.path.basename(path)[-8:]}"
    q = d.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "n")


QUERIES["streamed_windows"] = streamed_windows
ORACLES["streamed_windows"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, COUNT(*) AS n FROM events GROUP BY ALL"
change("insert_select_append", "INSERT INTO region (r_regionkey, r_name) SELECT n_nationkey + 100, n_name FROM nation", "INSERT INTO region (r_regionkey, r_name) VALUES (90, 'a'), (91, 'b')", then="SELECT r_regionkey, r_name FROM region", oracle="SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation UNION ALL SELECT * FROM (VALUES (90, 'a'), (91, 'b'))")
