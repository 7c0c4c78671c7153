"""Streaming forms of the counting operators. The reference has none; these follow the same semantics on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_molecules(reads: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A8 as a stream: molecules of each cell and gene, a (cb, gene, umi) counted once as long as its repeats come within the
    watermark, which also bounds the state."""
    once = reads.withWatermark(time, late).dropDuplicatesWithinWatermark(["cb", "gene", "umi"])
    return once.groupBy("cb", "gene").agg(F.count("*").alias("n_umi"))


def live_pileup(bases: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """A29 per window: window, chr, pos, n, k."""
    return bases.withWatermark(time, late).groupBy(F.window(time, window), "chr", "pos").agg(F.count("*").alias("n"), F.count(F.when(F.col("mismatch"), 1)).alias("k"))


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All input there is, as a table in memory: for tests and small tables."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
