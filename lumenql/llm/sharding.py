"""Operator 3: sharding in the order of a Hilbert curve over several metadata dimensions (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import land, small

#: Bits a dimension is quantised to.
BITS = 5
#: Ranges, at least, that the order is cut into for ranking, and rows that one has on average; each is sorted by itself.
RANGES, RANGE_ROWS = 2048, 50_000


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of cells, non-negative integers below 2**bits, after Skilling's transform.

    The coordinates are folded, bit by bit, as one array in higher-order functions, so the expression stays small.
    """
    n = len(cells)
    x = F.array(*[c.cast("bigint") for c in cells])
    put = lambda a, i, v: F.concat(F.slice(a, 1, i), F.array(v), F.slice(a, i + 2, n)) if i else F.concat(F.array(v), F.slice(a, 2, n))

    def step(i: int, q: Column, low: Column):
        def at(b: Column) -> Column:
            swap = (b[0].bitwiseXOR(b[i])).bitwiseAND(low)
            other = put(put(b, 0, b[0].bitwiseXOR(swap)), i, b[i].bitwiseXOR(swap)) if i else b
            return F.when(b[i].bitwiseAND(q) != 0, put(b, 0, b[0].bitwiseXOR(low))).otherwise(other)

        return at

    def unfold(a: Column, q: Column) -> Column:
        for i in range(n):
            # steps of one level depend on each other: each is a lambda over an array of one, so nothing is repeated
            a = F.transform(F.array(a), step(i, q, q - 1))[0]
        return a

    a = F.aggregate(F.array(*[F.lit(1 << b).cast("bigint") for b in range(bits - 1, 0, -1)]), x, unfold)
    gray = F.transform(F.array(a), lambda b: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.aggregate(F.slice(b, F.lit(1), k), F.lit(0).cast("bigint"), lambda s, v: s.bitwiseXOR(v))))[0]

    def untwist(b: Column) -> Column:
        t = F.aggregate(F.array(*[F.lit(1 << k).cast("bigint") for k in range(bits - 1, 0, -1)]), F.lit(0).cast("bigint"), lambda s, q: F.when(b[n - 1].bitwiseAND(q) != 0, s.bitwiseXOR(q - 1)).otherwise(s))
        return F.transform(F.array(t), lambda m: F.transform(b, lambda v: v.bitwiseXOR(m)))[0]

    twisted = F.transform(F.array(gray), untwist)[0]
    return F.transform(F.array(twisted), lambda b: F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("bigint"), lambda s, k: F.aggregate(b, s, lambda u, v: u * 2 + F.getbit(v, k))))[0]


def ranked(rows: DataFrame, name: str, cells: int) -> DataFrame:
    """value of a text column -> its cell, by the running share of rows, so that cells hold like numbers of rows."""
    d = rows.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    run = Window.orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return land(d.select("value", F.floor(F.coalesce(F.sum("n").over(run), F.lit(0)) * cells / F.sum("n").over(Window.partitionBy())).cast("bigint").alias("cell")), "cells")


def hilbert_shards(rows: DataFrame, shards: int, dims: tuple[str, ...] = ("lang", "source"), size: str = "size", tie: tuple[str, ...] = ("doc_id", "text_crc32")) -> DataFrame:
    """rows with curve (index), shard and slot added, the rows law: counts of shards are at most one apart.

    Each text column of dims is quantised by its share of rows, size by the logarithm; the curve over the cells orders
    the rows, a hash of the tie columns orders those of a cell, and the order is cut into runs. The rank is exact and
    needs no task that sees all rows: counts of (cell, hash range) are summed up over RANGES ranges or more, and only
    inside a range are rows sorted. A cell with a third of the rows is cut into as many ranges as its count asks for.
    Null values have a cell of their own before all others. Equal rows take neighbouring slots in any order. Empty
    input gives an empty result. Other columns pass through; those named curve, shard or slot are replaced.
    """
    rows = rows.drop("curve", "shard", "slot")
    extra = [f"__{x}" for x in (*dims, "tie", "part", "rank", "n", "before", "ranges")]
    d = rows
    for x, name in zip(dims, extra, strict=False):
        cells = small(ranked(rows, x, 1 << BITS).select(F.col("value").alias("__v"), F.col("cell").alias(name)))
        d = d.join(cells, F.col(x).eqNullSafe(F.col("__v")), "left").drop("__v")
    log = F.least(F.floor(F.log2(F.greatest(F.col(size), F.lit(1)).cast("double")) * 1.5), F.lit((1 << BITS) - 1)).cast("bigint")
    d = d.withColumn("curve", hilbert_index([*[F.coalesce(F.col(x), F.lit(0)) for x in extra[: len(dims)]], log])).drop(*extra[: len(dims)])
    d = d.withColumn("__tie", F.shiftrightunsigned(F.xxhash64(*tie), 40))
    d = land(d, "curve")
    counts = land(d.groupBy("curve").agg(F.count("*").alias("__n")), "counts")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    ranges = counts.select("curve", F.greatest(F.lit(1), F.ceil(F.col("__n") * max(RANGES, total // RANGE_ROWS) / max(1, total))).cast("bigint").alias("__ranges"))
    d = d.join(small(ranges), "curve").withColumn("__part", F.shiftright(F.col("__tie") * F.col("__ranges"), 24)).drop("__ranges")
    sums = land(d.groupBy("curve", "__part").agg(F.count("*").alias("__n")), "sums")
    sums = land(sums.select("curve", "__part", (F.sum("__n").over(Window.orderBy("curve", "__part")) - F.col("__n")).alias("__before")), "before")
    inside = Window.partitionBy("curve", "__part").orderBy("__tie", *tie)
    d = d.join(small(sums), ["curve", "__part"]).withColumn("__rank", F.col("__before") + F.row_number().over(inside) - 1)
    shard = F.expr(f"__rank * {shards} div {max(1, total)}")
    return d.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("__rank") - F.expr(f"(shard * {max(1, total)} + {shards - 1}) div {shards}")).cast("bigint")).drop(*extra)


def described(docs: DataFrame) -> DataFrame:
    """documents with size (UTF-8 bytes plus 16) and text_crc32; null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("size", (F.octet_length(text) + 16).cast("bigint")).withColumn("text_crc32", F.crc32(F.encode(text, "UTF-8")).cast("bigint"))


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder of Parquet a shard, rows by slot; file statistics then bound every dimension of the curve."""
    n = rows.select("shard").distinct().count()
    rows.repartitionByRange(max(1, n), "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_shard(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards along the curve over lang, source and size."""
    docs = described(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "lang", "source", "size", "text_crc32")
    d = hilbert_shards(docs, 40)
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
