"""Operator 1: mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import land, scratch, small

WORD = r"[^\x20\x09-\x0D]+"
#: Levels and bits a level of the hash that the histograms resolve.
LEVELS, BITS = 5, 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size -> target: each gets share of all sizes by weight, at most `most` times its size.

    What a full source leaves is shared by weight among the others. Level filling in closed form: ordered by
    size/weight, the first k sources are full, k being the largest for which the level of the rest is not below theirs.
    """
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * float(most)
    d = sizes.withColumn("weight", w).withColumn("full", full)
    by = Window.orderBy((F.col("full") / F.col("weight")), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({
        "total": F.sum("source_size").over(every) * float(share),
        "used": F.coalesce(F.sum("full").over(before), F.lit(0.0)),
        "rest": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    d = d.withColumn("level", (F.col("total") - F.col("used")) / F.col("rest"))
    d = d.withColumn("is_full", F.col("level") * F.col("weight") >= F.col("full"))
    level = F.max(F.when(~F.col("is_full"), F.struct(-F.col("full") / F.col("weight"), F.col("level"))).alias("x")).over(every)["level"]
    return d.withColumn("final", level).select("source", "source_size", F.least("full", F.coalesce(F.col("final") * F.col("weight"), F.col("full"))).alias("target"))


def mix_to_weights(rows: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """rows: (source, size, h) and others -> the same with source_size, target and copies, how often the mix takes the row.

    A source's target is whole copies of it plus a rest below its size. The rest is taken where the row's hash lies
    below a threshold: sizes are summed by source and hash bucket, the bucket in which the budget ends is found from
    the running sums, and only that bucket's rows are summed again by the next bits, LEVELS times. No row is sorted.
    Rows with one hash stand or fall together, so a source misses its rest by half its largest such group at most.
    Thresholds are nested: a larger budget takes a superset. Empty input gives empty output; a source of size 0
    takes nothing; null is a source of its own, after all others.
    """
    return mixed(rows, thresholds(rows, weights, share, most))


def mixed(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """rows: (source, h) and others -> the same with source_size, target and copies by landed thresholds()."""
    d = rows.alias("r").join(small(goal).alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    return d.select("r.*", "g.source_size", "g.target", (F.col("g.whole") + (F.col("r.h") < F.col("g.bound")).cast("bigint")).alias("copies"))


def thresholds(rows: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, whole and bound: a row of the source is taken whole times, and once more if h < bound."""
    sizes = land(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    goal = land(targets(sizes, list(weights), share, most).withColumns({
        "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"),
    }).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("bound", F.lit(0).cast("bigint")), "goal")
    same = F.col("r.source").eqNullSafe(F.col("g.source"))  # sources are few
    total = LEVELS * BITS
    for level in range(LEVELS):
        shift = total - BITS * (level + 1)
        inside = F.lit(True) if level == 0 else F.shiftright("r.h", total - BITS * level) == F.shiftright("g.bound", total - BITS * level)
        bucket = rows.alias("r").join(small(goal).alias("g"), same).where((F.col("g.rest") > 0) & inside).groupBy(F.col("r.source").alias("source"), F.shiftright("r.h", shift).alias("bucket")).agg(F.sum("r.size").alias("size"))
        run = Window.partitionBy("source").orderBy("bucket")
        ended = bucket.withColumn("upto", F.sum("size").over(run)).alias("b").join(small(goal).alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).where("b.upto > g.rest").groupBy(F.col("b.source").alias("source")).agg(F.min(F.struct("b.bucket", F.col("b.upto").alias("upto"), F.col("b.size").alias("size"))).alias("end"))
        last = level == LEVELS - 1
        nearest = F.when(F.col("end.upto") - F.col("g.rest") < F.col("g.rest") - (F.col("end.upto") - F.col("end.size")), F.col("end.bucket") + 1).otherwise(F.col("end.bucket"))
        goal = land(goal.alias("g").join(small(ended).alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left").select(
            "g.source", "g.source_size", "g.target", "g.whole",
            F.when(F.col("end").isNull(), F.col("g.rest")).otherwise(F.col("g.rest") - (F.col("end.upto") - F.col("end.size"))).alias("rest"),
            F.when(F.col("end").isNull(), F.when(F.col("g.rest") > 0, F.lit(1 << total) if level == 0 else F.col("g.bound") + (1 << (total - BITS * level))).otherwise(F.col("g.bound"))).otherwise(F.shiftleft(nearest if last else F.col("end.bucket"), shift)).cast("bigint").alias("bound"),
        ), "goal")
    return goal


def position() -> Column:
    """The hash of a document that is held against thresholds."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - LEVELS * BITS)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of documents, landed as every level reads it."""
    return land(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), position().alias("h")), "sized")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns kept, each row as often as the mix takes it (see mix_to_weights()); rows with no copy go.

    Texts are only held against the thresholds of their source, a small table, so they are not shuffled.
    """
    with scratch(docs.sparkSession) as keep:
        goal = keep(thresholds(sized(docs), **options).select(F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("bound").alias("__bound")), "goal")
    d = docs.join(small(goal), F.col("source").eqNullSafe(F.col("__source")))
    copies = F.col("__whole") + (position() < F.col("__bound")).cast("bigint")
    d = d.withColumn("__copies", copies).where("__copies > 0")
    return d.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))).select(*docs.columns)


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 5, 2, 1 to 150% of their words; taken counts repeats."""
    d = mix_to_weights(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
