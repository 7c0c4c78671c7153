"""Sequencing roles played by the star-schema tables, as frames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read, cb, gene, umi (four bases), value."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    base = lambda d: F.substring(F.lit("ACGT"), (F.floor(k / d) % 4).cast("int") + 1, F.lit(1))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("read"), F.col("user_id").alias("cb"), F.col("event_type").alias("gene"), F.concat(*[base(d) for d in (64, 16, 4, 1)]).alias("umi"), "value")


READS = """reads AS (SELECT event_id AS read, user_id AS cb, event_type AS gene, value,
  substr('ACGT', CAST((k // 64) % 4 + 1 AS INT), 1) || substr('ACGT', CAST((k // 16) % 4 + 1 AS INT), 1)
  || substr('ACGT', CAST((k // 4) % 4 + 1 AS INT), 1) || substr('ACGT', CAST(k % 4 + 1 AS INT), 1) AS umi
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))"""


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cb, gene, umi, n (reads)."""
    return reads(spark, sf_dir).groupBy("cb", "gene", "umi").agg(F.count("*").alias("n"))


MOLECULES = READS + ", mol AS (SELECT cb, gene, umi, count(*) AS n FROM reads GROUP BY cb, gene, umi)"


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, gene, tr, start, end (closed), strand."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("chr"), F.col("p_type").alias("gene"), F.col("p_partkey").alias("tr"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"))


EXONS = "exons AS (SELECT p_brand AS chr, p_type AS gene, p_partkey AS tr, p_partkey AS start, p_partkey + p_size AS \"end\", CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)"


def aligns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read, block, chr, start, end (closed), strand, nh (lines of the order)."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    nh = li.groupBy("l_orderkey").agg(F.count("*").alias("nh"))
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(nh, "l_orderkey")
    return rows.select(F.col("l_orderkey").alias("read"), F.col("l_linenumber").alias("block"), F.col("p_brand").alias("chr"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint") - 1).alias("end"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), "nh")


ALIGNS = """aligns AS (SELECT l.l_orderkey AS read, l.l_linenumber AS block, p.p_brand AS chr, l.l_partkey AS start,
  l.l_partkey + CAST(l.l_quantity AS BIGINT) - 1 AS "end", CASE WHEN l.l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
  count(*) OVER (PARTITION BY l.l_orderkey) AS nh FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read, chr, start, gap, motif (0-6), sample, unique (boolean), overhang."""
    li = table(spark, sf_dir, "lineitem")
    nh = li.groupBy("l_orderkey").agg(F.count("*").alias("nh"))
    return li.join(nh, "l_orderkey").select(F.col("l_orderkey").alias("read"), F.col("l_suppkey").alias("chr"), F.col("l_partkey").alias("start"), F.col("l_quantity").cast("int").alias("gap"), ((F.col("l_partkey") + F.col("l_quantity").cast("bigint")) % 7).cast("int").alias("motif"), F.col("l_linestatus").alias("sample"), (F.col("nh") == 1).alias("unique"), (F.round(F.col("l_discount") * 100).cast("int") + 2).alias("overhang"))


JUNCTIONS = """juncs AS (SELECT l_orderkey AS read, l_suppkey AS chr, l_partkey AS start, CAST(l_quantity AS INT) AS gap,
  CAST((l_partkey + CAST(l_quantity AS BIGINT)) % 7 AS INT) AS motif, l_linestatus AS sample,
  count(*) OVER (PARTITION BY l_orderkey) = 1 AS uniq, CAST(round(l_discount * 100) AS INT) + 2 AS overhang FROM lineitem)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cb (customer), gene (part type), n (lines)."""
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("o_custkey").alias("cb"), F.col("p_type").alias("gene")).agg(F.count("*").alias("n"))


CELLS = """cells AS (SELECT o_custkey AS cb, p_type AS gene, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_type)"""
