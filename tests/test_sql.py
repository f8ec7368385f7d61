"""Queries, data changes, constraints, catalog and transactions on small tables."""

import datetime

import pytest

from lumenql import AlreadyExists, Database, FailedPrecondition, InvalidArgument, KeyRange, KeySet, Mutation, NotFound, OutOfRange
from lumenql.sql.parser import parse


@pytest.fixture()
def db(spark):
    d = Database(spark)
    d.ddl("CREATE TABLE Singers (Id INT64 NOT NULL, Name STRING(20), Born DATE, Tags ARRAY<STRING(MAX)>, Upper STRING(MAX) AS (UPPER(Name)) STORED) PRIMARY KEY (Id)")
    d.ddl("CREATE TABLE Albums (Id INT64 NOT NULL, Album INT64 NOT NULL, Title STRING(MAX), Sales INT64 DEFAULT (0), CONSTRAINT positive CHECK (Sales >= 0)) PRIMARY KEY (Id, Album), INTERLEAVE IN PARENT Singers ON DELETE CASCADE")
    d.execute("INSERT INTO Singers (Id, Name, Born, Tags) VALUES (1, 'Ann', DATE '1990-01-01', ['x', 'y']), (2, 'Bob', NULL, []), (3, NULL, DATE '1980-05-05', NULL)")
    d.execute("INSERT INTO Albums (Id, Album, Title, Sales) VALUES (1, 1, 'A', 10), (1, 2, 'B', 20), (2, 1, 'C', DEFAULT)")
    return d


def values(db, sql, params=None):
    return [tuple(r) for r in db.rows(sql, params)]


def test_select(db):
    assert values(db, "SELECT Name, Upper FROM Singers ORDER BY Id") == [("Ann", "ANN"), ("Bob", "BOB"), (None, None)]
    assert values(db, "SELECT s.Name, t FROM Singers s CROSS JOIN UNNEST(s.Tags) AS t ORDER BY t") == [("Ann", "x"), ("Ann", "y")]
    assert values(db, "SELECT s.Id, t FROM Singers s LEFT JOIN UNNEST(s.Tags) AS t ORDER BY s.Id, t") == [(1, "x"), (1, "y"), (2, None), (3, None)]
    assert values(db, "SELECT Id, COUNT(*) AS n FROM Singers JOIN Albums USING (Id) GROUP BY Id ORDER BY Id") == [(1, 2), (2, 1)]
    assert values(db, "SELECT SUM(Sales HAVING MAX Id) AS s, ARRAY_AGG(Title ORDER BY Title DESC LIMIT 2) AS t FROM Albums") == [(0, ["C", "B"])]
    assert values(db, "SELECT ARRAY_AGG(Name ORDER BY Id) AS n, STRING_AGG(Name, '+' ORDER BY Id) AS t FROM Singers") == [(["Ann", "Bob", None], "Ann+Bob")]
    assert values(db, "SELECT Id FROM Singers WHERE EXISTS (SELECT 1 FROM UNNEST(Tags) AS t WHERE t = 'x')") == [(1,)]
    assert values(db, "SELECT * EXCEPT (Tags, Born) REPLACE (Id * 2 AS Id) FROM Singers WHERE Id = @id", {"id": 1}) == [(2, "Ann", "ANN")]
    assert values(db, "SELECT Id, Title FROM Albums WHERE TRUE QUALIFY IS_FIRST(1) OVER (PARTITION BY Id ORDER BY Sales DESC) ORDER BY Id") == [(1, "B"), (2, "C")]
    assert values(db, "WITH RECURSIVE t AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT SUM(n) AS s FROM t") == [(6,)]
    assert values(db, "SELECT x FROM (SELECT 1 AS x UNION ALL SELECT 2) ORDER BY x DESC LIMIT 1") == [(2,)]
    assert values(db, "SELECT SUM(a.Sales) / SUM(a.Album) AS r FROM Albums a") == [(7.5,)]
    assert values(db, "SELECT NOT Id = 1 AS n FROM Singers ORDER BY Id") == [(False,), (True,), (True,)]
    assert values(db, "SELECT AS STRUCT Id, Name FROM Singers WHERE Id = 1")[0][0].asDict() == {"Id": 1, "Name": "Ann"}
    assert values(db, "SELECT COUNT(*) AS n FROM Singers TABLESAMPLE RESERVOIR (2 ROWS)") == [(2,)]
    assert "Singers" not in db.compile("SELECT 1 AS x") and "Physical Plan" in db.explain("SELECT Id FROM Singers")
    with pytest.raises(NotFound):
        db.rows("SELECT nothing FROM Singers")
    with pytest.raises(InvalidArgument):
        db.rows("SELECT Id FROM Singers s JOIN Albums a ON s.Id = a.Id")


def test_precedence():
    assert parse("SELECT NOT a = 1").items[0].expr.arg.kind == "compare"
    assert parse("SELECT 1 + 2 * 3").items[0].expr.op == "+"


def test_insert(db):
    with pytest.raises(AlreadyExists):
        db.execute("INSERT INTO Singers (Id) VALUES (1)")
    with pytest.raises(FailedPrecondition):
        db.execute("INSERT INTO Singers (Id) VALUES (NULL)")
    with pytest.raises(FailedPrecondition):
        db.execute("INSERT INTO Singers (Id, Name) VALUES (9, '012345678901234567890')")
    with pytest.raises(NotFound):
        db.execute("INSERT INTO Albums (Id, Album) VALUES (99, 1)")
    with pytest.raises(OutOfRange):
        db.execute("INSERT INTO Albums (Id, Album, Sales) VALUES (1, 9, -1)")
    assert db.execute("INSERT OR IGNORE INTO Singers (Id, Name) VALUES (1, 'no'), (4, 'Dan')") == 1
    assert db.execute("INSERT OR UPDATE INTO Singers (Id, Name) VALUES (1, 'Amy')") == 1
    assert values(db, "SELECT Name, Upper, Born FROM Singers WHERE Id = 1") == [("Amy", "AMY", datetime.date(1990, 1, 1))]
    got = db.execute("INSERT INTO Singers (Id, Name) VALUES (1, 'z'), (5, 'Eve') ON CONFLICT (Id) DO UPDATE SET Name = CONCAT(Singers.Name, EXCLUDED.Name) THEN RETURN WITH ACTION AS act Id, Name")
    assert sorted(map(tuple, got.collect())) == [(1, "Amyz", "UPDATE"), (5, "Eve", "INSERT")]
    assert db.execute("INSERT INTO Singers (Id) VALUES (1) ON CONFLICT DO NOTHING") == 0


def test_update_delete(db):
    assert db.execute("UPDATE Albums SET Sales = Sales + 1 WHERE Id = 1") == 2
    assert [tuple(r) for r in db.execute("UPDATE Singers SET Name = 'Zed' WHERE Id = 3 THEN RETURN Id, Upper").collect()] == [(3, "ZED")]
    with pytest.raises(InvalidArgument):
        db.execute("UPDATE Singers SET Id = 7 WHERE TRUE")
    with pytest.raises(InvalidArgument):
        db.execute("DELETE FROM Singers")
    assert db.execute("DELETE FROM Singers WHERE Id = 1") == 1
    assert values(db, "SELECT Id FROM Albums") == [(2,)]
    assert db.batch(["DELETE FROM Albums WHERE TRUE", "DELETE FROM Singers WHERE Id = 2"]) == [1, 1]


def test_constraints(db):
    db.ddl("CREATE UNIQUE INDEX ByName ON Singers (Name)")
    with pytest.raises(AlreadyExists):
        db.execute("UPDATE Singers SET Name = 'Ann' WHERE Id = 2")
    db.ddl("CREATE TABLE Prizes (P INT64, Singer INT64, CONSTRAINT fk FOREIGN KEY (Singer) REFERENCES Singers (Id)) PRIMARY KEY (P)")
    db.execute("INSERT INTO Prizes (P, Singer) VALUES (1, 3), (2, NULL)")
    with pytest.raises(FailedPrecondition):
        db.execute("INSERT INTO Prizes (P, Singer) VALUES (3, 77)")
    with pytest.raises(FailedPrecondition):
        db.execute("DELETE FROM Singers WHERE Id = 3")
    assert db.scalar("SELECT COUNT(*) FROM Singers") == 3


def test_schema(db):
    db.ddl("ALTER TABLE Singers ADD COLUMN Age INT64")
    db.ddl("CREATE VIEW Adults SQL SECURITY INVOKER AS SELECT Id, Name FROM Singers WHERE Id < 3")
    assert values(db, "SELECT a.Name FROM Adults a ORDER BY a.Name") == [("Ann",), ("Bob",)]
    assert values(db, "SELECT COLUMN_NAME FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_NAME = 'Singers' ORDER BY ORDINAL_POSITION")[-1] == ("Age",)
    db.ddl("ALTER TABLE Singers DROP COLUMN Age")
    db.ddl("ALTER TABLE Albums ALTER COLUMN Title STRING(5)")
    with pytest.raises(FailedPrecondition):
        db.ddl("DROP TABLE Singers")
    with pytest.raises(AlreadyExists):
        db.ddl("CREATE TABLE Albums (x INT64) PRIMARY KEY (x)")
    db.ddl("CREATE SEQUENCE Seq OPTIONS (sequence_kind = 'bit_reversed_positive')")
    assert db.scalar("SELECT GET_NEXT_SEQUENCE_VALUE(SEQUENCE Seq)") == 1 << 62
    assert db.scalar("SELECT GET_INTERNAL_SEQUENCE_STATE(SEQUENCE Seq)") == 1
    db.ddl("CREATE CHANGE STREAM Watch FOR Singers (Name), Albums")
    assert values(db, "SELECT TABLE_NAME, ALL_COLUMNS FROM INFORMATION_SCHEMA.CHANGE_STREAM_TABLES ORDER BY TABLE_NAME") == [("Albums", True), ("Singers", False)]
    db.ddl("CREATE INDEX BySales ON Albums (Sales DESC)")
    assert values(db, "SELECT COLUMN_ORDERING FROM INFORMATION_SCHEMA.INDEX_COLUMNS WHERE INDEX_NAME = 'BySales'") == [("DESC",)]
    for table in ("TABLES", "INDEXES", "TABLE_CONSTRAINTS", "CONSTRAINT_COLUMN_USAGE", "CONSTRAINT_TABLE_USAGE", "REFERENTIAL_CONSTRAINTS", "CHECK_CONSTRAINTS", "SCHEMATA", "VIEWS", "SEQUENCES", "SEQUENCE_OPTIONS", "COLUMN_OPTIONS", "KEY_COLUMN_USAGE", "DATABASE_OPTIONS", "CHANGE_STREAMS", "CHANGE_STREAM_COLUMNS", "CHANGE_STREAM_OPTIONS", "SPANNER_STATISTICS"):
        db.rows(f"SELECT * FROM INFORMATION_SCHEMA.{table}")
    db.ddl("CREATE TABLE Old (K INT64, At TIMESTAMP) PRIMARY KEY (K), ROW DELETION POLICY (OLDER_THAN(At, INTERVAL 1 DAY))")
    db.execute("INSERT INTO Old (K, At) VALUES (1, TIMESTAMP '2000-01-01 00:00:00+00'), (2, CURRENT_TIMESTAMP())")
    assert values(db, "SELECT K FROM Old") == [(2,)]


def test_mutations_and_reads(db):
    db.apply([Mutation("insert", "Singers", ("Id", "Name"), ((7, "Gil"), (8, "Hal"))), Mutation("delete", "Singers", keys=KeySet(keys=((3,),)))])
    assert [r[0] for r in db.read("Singers", KeySet(all=True), ["Id"]).collect()] == [1, 2, 7, 8]
    with pytest.raises(AlreadyExists):
        db.apply([Mutation("insert", "Singers", ("Id",), ((20,),)), Mutation("insert", "Singers", ("Id",), ((1,),))])
    assert [r[0] for r in db.read("Singers", KeySet(ranges=(KeyRange((2,), (8,)),)), ["Id"]).collect()] == [2, 7]
    assert [tuple(r) for r in db.read("Albums", KeySet(ranges=(KeyRange((1,), (1,), True, True),)), ["Id", "Album"], limit=1).collect()] == [(1, 1)]
    with pytest.raises(NotFound):
        db.apply([Mutation("update", "Singers", ("Id", "Name"), ((99, "x"),))])
    done = db.apply_groups([[Mutation("replace", "Singers", ("Id", "Name"), ((1, "New"),))], [Mutation("insert", "Singers", ("Id",), ((1,),))]])
    assert done[0] is None and isinstance(done[1], AlreadyExists)


def test_transactions_and_state(db, tmp_path, spark):
    with db.transaction() as tx:
        tx.execute("DELETE FROM Albums WHERE TRUE")
        assert db.scalar("SELECT COUNT(*) FROM Albums") == 3
    assert db.scalar("SELECT COUNT(*) FROM Albums") == 0
    with pytest.raises(RuntimeError), db.transaction() as tx:
        tx.execute("DELETE FROM Singers WHERE TRUE")
        raise RuntimeError
    assert db.scalar("SELECT COUNT(*) FROM Singers") == 3
    with pytest.raises(FailedPrecondition), db.transaction() as tx:
        tx.execute("DELETE FROM Singers WHERE Id = 1")
        db.execute("DELETE FROM Singers WHERE Id = 2")
    db.export_state(str(tmp_path / "state"))
    other = Database(spark)
    other.import_state(str(tmp_path / "state"))
    assert other.scalar("SELECT COUNT(*) FROM Singers") == 2
    with pytest.raises(AlreadyExists):
        other.execute("INSERT INTO Singers (Id) VALUES (1)")
    db.clear()
    assert db.scalar("SELECT COUNT(*) FROM Singers") == 0


def test_sequence_values_are_given_once(spark):
    db = Database(spark)
    db.ddl("CREATE SEQUENCE Seq OPTIONS (sequence_kind = 'bit_reversed_positive')")
    db.ddl("CREATE TABLE T (K INT64 NOT NULL, N INT64) PRIMARY KEY (K)")
    db.register("src", spark.range(50).repartition(5))
    one = [db.scalar("SELECT GET_NEXT_SEQUENCE_VALUE(SEQUENCE Seq)") for _ in range(2)]
    for _ in range(3):
        db.execute("INSERT INTO T (K, N) SELECT GET_NEXT_SEQUENCE_VALUE(SEQUENCE Seq), id FROM src")
    one += [db.scalar("SELECT GET_NEXT_SEQUENCE_VALUE(SEQUENCE Seq)") for _ in range(2)]
    got = [r[0] for r in db.rows("SELECT K FROM T")] + one
    assert len(got) == len(set(got)) == 154 and min(got) > 0


def test_inserts_append(spark):
    """An INSERT writes its own rows only; the table reads the files of all of them."""
    db = Database(spark)
    db.ddl("CREATE TABLE T (K INT64 NOT NULL, V STRING(MAX)) PRIMARY KEY (K)")
    for k in range(4):
        assert db.execute(f"INSERT INTO T (K, V) VALUES ({2 * k}, 'a'), ({2 * k + 1}, 'b')") == 2
    paths = db.catalog.table("T").df._lq_paths
    assert len(paths) == 4 and [spark.read.parquet(p).count() for p in paths] == [2] * 4
    assert db.scalar("SELECT COUNT(*) FROM T") == 8
    with pytest.raises(AlreadyExists):
        db.execute("INSERT INTO T (K) VALUES (3)")
    assert db.execute("UPDATE T SET V = 'c' WHERE K > 5") == 2
    assert len(db.catalog.table("T").df._lq_paths) == 1
