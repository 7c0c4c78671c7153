"""Sparse count matrices in long form (gene, cb, n): statistics, merging, comparison (A22-A24, A41, A42, A47, A52, J23-J25,
U2, U8, K8, K9, W11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_cell(m: DataFrame) -> DataFrame:
    """Cb, umis, genes."""
    return m.groupBy("cb").agg(F.sum("n").alias("umis"), F.count(F.when(F.col("n") > 0, 1)).alias("genes"))


def cell_summary(cells: DataFrame) -> DataFrame:
    """Number, integer mean, and median as the element at place n / 2 of the sorted list."""
    out = []
    for c in ("umis", "genes"):
        out += [F.expr(f"cast(sum({c}) as bigint) div count(*)").alias(f"mean_{c}"), F.get(F.sort_array(F.collect_list(c), asc=True), F.expr("cast(count(*) div 2 as int)")).alias(f"median_{c}")]
    return cells.agg(F.count("*").alias("cells"), *out)


def read_flags(reads: DataFrame, flags: list[str], key: str = "cb") -> DataFrame:
    """Per cell, null included, the reads with each flag."""
    return reads.groupBy(key).agg(*[F.sum(F.col(f).cast("int")).alias(f) for f in flags])


def library_metrics(reads: DataFrame) -> DataFrame:
    """Reads, share with barcode, share mapped, share of good bases, saturation. reads: cb, umi, gene, good, bases."""
    molecules = F.countDistinct("cb", "umi", "gene")
    hit = F.count(F.when(F.col("cb").isNotNull() & F.col("gene").isNotNull(), 1))
    return reads.agg(F.count("*").alias("reads"), (F.count("cb") / F.count("*")).alias("valid_barcodes"), (F.count("gene") / F.count("*")).alias("mapped"), (F.sum("good") / F.sum("bases")).alias("q30"), (1 - molecules / hit).alias("saturation"))


def sorted_umis(cells: DataFrame) -> DataFrame:
    """K9: rank, umis, from the largest. The ranks are taken per count first, so that no task holds all cells."""
    by = cells.groupBy("umis").agg(F.count("*").alias("cells"))
    return by.withColumn("first_rank", F.coalesce(F.sum("cells").over(Window.orderBy(F.desc("umis")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)


def totals(m: DataFrame, passing: DataFrame) -> DataFrame:
    """Umis of each cell, and whether it is among those passing."""
    return m.groupBy("cb").agg(F.sum("n").alias("umis")).join(passing.select("cb").distinct().withColumn("passing", F.lit(True)), "cb", "left").withColumn("passing", F.coalesce("passing", F.lit(False)))


def from_tags(tags: DataFrame) -> DataFrame:
    """Distinct UB of each (GX, CB); '-' is no value."""
    return tags.where("gx <> '-' and cb <> '-' and ub <> '-'").groupBy("gx", "cb").agg(F.countDistinct("ub").alias("n"))


def side_by_side(tables: DataFrame, key: str, sample: str, value: str, samples: list) -> DataFrame:
    """A47."""
    return tables.groupBy(key).pivot(sample, samples).agg(F.sum(value)).na.fill(0)


def append_features(gex: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gex with the features' rows below it, cells without gex left out; and how many rows and cells that is."""
    cells = gex.select("cb").distinct()
    both = gex.withColumn("kind", F.lit("gene")).unionByName(features.join(cells, "cb", "left_semi").withColumn("kind", F.lit("feature")))
    lost = features.join(cells, "cb", "left_anti").agg(F.count("*").alias("rows"), F.countDistinct("cb").alias("cells"))
    return both, lost


def reindex(m: DataFrame, col: str, to: str) -> DataFrame:
    """Dense ids from 1 in order of the values. One row for each value is ranked, then joined."""
    ids = m.select(col).distinct().withColumn(to, F.row_number().over(Window.orderBy(col)))
    return m.join(ids, col)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per gene over the cells both have: sums, mean absolute relative difference, correlation of log1p."""
    common = a.select("cb").distinct().join(b.select("cb").distinct(), "cb")
    x = a.join(common, "cb").select("gene", "cb", F.col("n").alias("a"))
    y = b.join(common, "cb").select("gene", "cb", F.col("n").alias("b"))
    both = x.join(y, ["gene", "cb"], "full").na.fill(0)
    return both.groupBy("gene").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.avg(F.abs(F.col("a") - F.col("b")) / (F.col("a") + F.col("b"))).alias("mard"), F.corr(F.log1p("a"), F.log1p("b")).alias("r"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Unique plus multi-gene counts."""
    return a.unionByName(b).groupBy("gene", "cb").agg(F.sum("n").alias("n"))


def signal_ratio(m: DataFrame, pattern: str) -> DataFrame:
    """Share of all counts in the features that match."""
    return m.agg((F.sum(F.when(F.col("gene").rlike(pattern), F.col("n")).otherwise(0)) / F.sum("n")).alias("ratio"))


def value_histogram(m: DataFrame) -> DataFrame:
    """A52/A48."""
    return m.groupBy("n").agg(F.count("*").alias("entries"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Shared, only_a, only_b, jaccard of two masks."""
    both = a.select(*keys).distinct().withColumn("a", F.lit(1)).join(b.select(*keys).distinct().withColumn("b", F.lit(1)), keys, "full")
    n = lambda c: F.count(F.when(c, 1))
    x, y = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.agg(n(x & y).alias("shared"), n(x & ~y).alias("only_a"), n(~x & y).alias("only_b"), (n(x & y) / F.count("*")).alias("jaccard"))
