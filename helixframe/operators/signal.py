"""Coverage signal and duplicate marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(blocks: DataFrame, weight: Column, keys: tuple[str, ...] = ("chr", "strand")) -> DataFrame:
    """Keys, start, end (half-open), value: maximal stretches of one coverage above 0.

    Block ends become +/- weight events, which are summed per place before a running sum; no base is exploded. The
    running sum runs per (keys), which is per chromosome strand."""
    ev = blocks.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), weight.alias("d")), F.struct((F.col("end") + 1).alias("pos"), (-weight).alias("d")))).alias("e"))
    steps = ev.groupBy(*keys, "e.pos").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("pos")
    run = steps.withColumn("value", F.round(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6)).withColumn("end", F.lead("pos").over(w))
    return run.where("value > 0 and end is not null").select(*keys, F.col("pos").alias("start"), "end", "value")


def per_million(reads: DataFrame) -> DataFrame:
    """Factors 1e6 / unique and 1e6 / (unique + sum 1/nh). reads: nh, a row for each alignment."""
    return reads.agg((1e6 / F.count(F.when(F.col("nh") == 1, 1))).alias("unique_factor"), (1e6 / F.sum(1 / F.col("nh"))).alias("all_factor"))


def transfrags(bedgraph: DataFrame, keys: tuple[str, ...] = ("chr", "strand"), gap: int = 0) -> DataFrame:
    """Touching stretches joined: keys, start, end, area, peak."""
    w = Window.partitionBy(*keys).orderBy("start")
    prior = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))  # W3: the furthest end so far
    new = (F.col("start") > prior + gap) | prior.isNull()
    marked = bedgraph.withColumn("_new", new.cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum((F.col("end") - F.col("start")) * F.col("value")).alias("area"), F.max("value").alias("peak")).drop("_island")


def insert_coverage(aligns: DataFrame, bins: int = 100) -> DataFrame:
    """1/nh-weighted coverage over the length of transcripts, in bins. aligns: start, end (0-based in the
    transcript), length, nh."""
    at = lambda c: F.least(F.lit(bins - 1), F.floor(F.col(c) * bins / F.col("length")))
    hit = aligns.withColumn("bin", F.explode(F.sequence(at("start"), at("end"))))
    return hit.groupBy("bin").agg(F.sum(1 / F.col("nh")).alias("weight"))


def mark_duplicates(aligns: DataFrame, keys: tuple[str, ...], score: str, tie: tuple[str, ...]) -> DataFrame:
    """All but the best-scored (ties: first) alignment of equal keys are duplicates."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *tie)
    return aligns.withColumn("duplicate", F.row_number().over(w) > 1)
