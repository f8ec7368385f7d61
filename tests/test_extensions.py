"""The fluent API and event-time windows."""

import datetime

import pytest
from pyspark.sql import functions as F

from lumenql import Database
from lumenql.operators.relational import Relation
from lumenql.streaming.windows import sessions, windowed


@pytest.fixture(scope="module")
def db(spark):
    return Database(spark).register("t", spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 1)], "k bigint, g string, v bigint"), ["k"])


def test_relation(db):
    t = Relation(db, "t")
    got = t.where("v > @x").group_by("g", total="SUM(v)").having("SUM(v) > 1").order_by("g").frame({"x": 0})
    assert [tuple(r) for r in got.collect()] == [("a", 12)]
    assert [r[0] for r in t.is_first(1, "g", "v DESC").select("k").order_by("k").frame().collect()] == [2, 3]
    assert t.join(t.group_by("g", n="COUNT(*)"), "t.g = r.g").select("k", "n").where("n = 2").frame().count() == 2
    assert t.union_all(t).select("k").distinct().limit(5).frame().count() == 3


def test_windows(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    events = spark.createDataFrame([(at(0), "a"), (at(1), "a"), (at(9), "a"), (at(20), "b")], "ts timestamp, u string")
    got = windowed(events, "ts", "5 minutes", keys=("u",), n=F.count("*")).orderBy("window_start").collect()
    assert [(r["u"], r["n"]) for r in got] == [("a", 2), ("a", 1), ("b", 1)]
    assert sorted(r["n"] for r in sessions(events, "ts", "5 minutes", ("u",), n=F.count("*")).collect()) == [1, 1, 2]
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "5 minutes", late="1 minute", n=F.count("*"))
    q = stream.writeStream.outputMode("update").format("memory").queryName("lq_windows").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM lq_windows").first()[0] == 4
