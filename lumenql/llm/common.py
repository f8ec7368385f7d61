"""What the operators share: landing intermediate tables, checked broadcasts, packed shuffles, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes, up to which a table may be broadcast; beyond either joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 24_000_000
#: Bytes of text whose tokens one part of a packed shuffle holds; the number of parts grows with the texts.
PART_BYTES = 32_000_000
#: Rows, and bytes, of texts or packed sets that Spark and Python hold of a batch at a time, each in several copies.
BATCH_ROWS, BATCH_BYTES = 1000, 4_000_000

#: Paths that the innermost scratch() has landed.
_SCRATCH: ContextVar[list | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="lumenql-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def land(df: DataFrame, name: str = "part", options: dict | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder, with options of the writer, and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (mine := _SCRATCH.get()) is not None:
        mine.append(path)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes what is landed inside once the block ends, but for tables given to the function it yields.

    Those belong to the block around it, if there is one, and stay otherwise.
    """
    mine, outer, kept = [], _SCRATCH.get(), []
    token = _SCRATCH.set(mine)

    def keep(df: DataFrame, name: str = "part") -> DataFrame:
        out = land(df, name)
        kept.append(mine.pop())
        return out

    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        if outer is not None:
            outer += kept
        for path in mine:
            delete(spark, path)
        tidy(spark)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs that are done; it does so once the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def release(df: DataFrame) -> None:
    """Deletes the files of a landed table that nothing will read again, and what tidy() does."""
    for f in df.inputFiles()[:1]:
        delete(df.sparkSession, f.rpartition("/")[0])
    tidy(df.sparkSession)


@contextmanager
def small_batches(spark: SparkSession, rows: int, size: int | None = None):
    """What is planned inside sends at most so many rows, and about so many bytes if given, to Python at a time."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows} | ({"spark.sql.execution.arrow.maxBytesPerBatch": size} if size else {})
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _bytes(field: T.StructField):
    """Column of the bytes that a value of the field takes, roughly: what has no fixed width is measured."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType)):
        return F.greatest(F.size(F.col(field.name)), F.lit(0)) * 64 + 16
    return F.lit(48 if isinstance(field.dataType, T.StructType) else 8)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and BROADCAST_BYTES, else as it is, so that joins with it shuffle."""
    rows = BROADCAST_ROWS if rows is None else rows
    size = sum((_bytes(f) for f in df.schema.fields), F.lit(0).cast("bigint"))
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= BROADCAST_BYTES else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def parts_for(docs: DataFrame) -> int:
    """Parts of a packed shuffle of what is made of docs (text): grows with the texts, four a shuffle partition at least."""
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return max(4 * partitions(docs.sparkSession), -(-size // PART_BYTES))


def by_part(batches, column: int = 0):
    """Lists of rows (as tuples) of one part each from batches sorted by the part."""
    held, now = [], None
    for x in batches:
        for row in zip(*[c.to_pylist() for c in x.columns], strict=True):
            if held and row[column] != now:
                yield held
                held = []
            now = row[column]
            held.append(row)
    if held:
        yield held


def arrow_batches(batches, columns: dict[str, pa.DataType]):
    """Record batches from an iterator of dicts of sequences; never yields nothing at all."""
    schema = pa.schema(list(columns.items()))
    for x in batches:
        yield pa.RecordBatch.from_arrays([pa.array(x[k], type=t) for k, t in columns.items()], schema=schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: two bigint columns. Returns (node, root), root being the least node of the component; nodes without an
    edge to another node are left out. Minima are combined before each shuffle and the joins are plain ones, which
    adaptive execution splits for hot hubs, so no neighbour list is ever gathered in one task. Each round is landed.
    """
    e = land(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("e")).select("e.u", "e.v").distinct()
        old, e = e, land(e, "edges")
        release(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Forest:
    """Union-find over a dictionary; the least member is the root."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        up = self.up
        r = x
        while (y := up.get(r, r)) != r:
            r = y
        while (y := up.get(x, x)) != r:
            up[x] = r
            x = y
        return r

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if x > y:
            x, y = y, x
        self.up[y] = x
        self.up.setdefault(x, x)
        return True
