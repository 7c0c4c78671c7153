"""Whole runs as compositions (Z1, Z2, Z6, Z7) and queries on the operators they add."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import barcodes, cells, features, flex, matrix, quant, slam, tables, umi

from .catalog import register
from .roles import MOLECULES, READS, molecules, reads, table
from .roles import cells as cell_matrix


@dataclass(frozen=True)
class Counting:
    """Settings of a counting run; presets below."""

    dedup: str = "one_hop"
    multi_gene: bool = False
    expected: int = 3000
    posterior: float = 0.975
    pseudo: int = 0


PRESETS = {"plain": Counting(dedup="exact"), "ranger": Counting(multi_gene=True), "all": Counting(dedup="connected"), "probes": Counting(dedup="clique")}


def count_cells(tagged: DataFrame, whitelist: DataFrame, how: Counting = Counting()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Raw counts (cb, gene, n) and the cells kept. tagged: read, seq (cell sequence), qual (its worst), umi, gene."""
    found = barcodes.match(tagged, whitelist)
    exact = found.where("match = 'exact'")
    n = exact.groupBy("cb").agg(F.count("*").alias("n"))
    saved = barcodes.rescue(found.where("match <> 'exact'"), n, threshold=how.posterior, pseudo=how.pseudo).drop("posterior")
    mol = exact.unionByName(saved).groupBy("cb", "gene", "umi").agg(F.count("*").alias("n"))
    if how.multi_gene:
        mol = umi.multi_gene(mol)
    rule = {"one_hop": umi.one_hop, "connected": umi.connected, "directional": umi.directional, "clique": umi.clique}.get(how.dedup)
    counts = (umi.exact(mol) if rule is None else umi.count_corrected(rule(mol))).select("cb", "gene", F.col("count").alias("n"))
    return counts, cells.knee(counts.groupBy("cb").agg(F.sum("n").alias("n")), how.expected)


def combine(genes: DataFrame, guides: DataFrame, kept: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """The joint matrix of the kept cells, and the guide calls of each. guides: feature, cb, n."""
    both, _ = matrix.append_features(genes.join(kept.select("cb"), "cb", "left_semi"), guides.select(F.col("feature").alias("gene"), "cb", "n"))
    own = guides.join(kept.select("cb"), "cb", "left_semi")
    return both, features.calls_per_cell(features.gmm_calls(own, kept, least))


def _run(s, d):
    tagged = reads(s, d).select("read", F.col("umi").alias("seq"), F.lit(20).alias("qual"), F.col("cb").cast("string").alias("umi"), "gene")
    listed = reads(s, d).select(F.col("umi").alias("cb")).distinct().where("cb < 'C'")
    counts, kept = count_cells(tagged, listed, PRESETS["plain"])
    return matrix.per_cell(counts.join(kept.select("cb"), "cb", "left_semi"))


register("z1_counting_run", _run)
register("j4_edit_distance", lambda s, d: barcodes.match_edits(reads(s, d).select(F.col("umi").alias("read"), F.col("umi").alias("seq")).distinct(), s.createDataFrame([("ACGTA",), ("CCCAC",)], "cb string")), f"WITH {READS}, u AS (SELECT DISTINCT umi AS read FROM reads), c(cb) AS (VALUES ('ACGTA'), ('CCCAC')), n AS (SELECT read, cb, levenshtein(read, cb) AS distance FROM u, c WHERE levenshtein(read, cb) <= 2) SELECT read, cb, CAST(distance AS INT) AS distance FROM n QUALIFY distance = min(distance) OVER (PARTITION BY read)")
register("j6_inline_correction", lambda s, d: barcodes.correct_inline(reads(s, d).select("read", F.when(F.col("read") % 5 == 0, F.concat(F.substring("umi", 1, 2), F.lit("NN"))).otherwise(F.col("umi")).alias("seq")), s.createDataFrame([("AACC",), ("AATT",), ("CCGG",), ("ATAT",)], "cb string")).groupBy("status").agg(F.count("*").alias("n")), f"""WITH {READS}, r AS (SELECT read, CASE WHEN read % 5 = 0 THEN substr(umi, 1, 2) || 'NN' ELSE umi END AS s FROM reads), c(cb) AS (VALUES ('AACC'), ('AATT'), ('CCGG'), ('ATAT')),
  k AS (SELECT read, s, count(cb) FILTER (cb = s) AS e, count(cb) FILTER (hamming(cb, s) = 1) AS o, count(cb) FILTER (s LIKE '%NN' AND substr(cb, 1, 2) = substr(s, 1, 2)) AS f FROM r, c GROUP BY read, s)
  SELECT CASE WHEN e > 0 THEN 'exact' WHEN s LIKE '%NN' THEN CASE WHEN f = 1 THEN 'rescued' ELSE 'none' END WHEN o = 1 THEN 'corrected' WHEN o > 1 THEN 'ambiguous' ELSE 'none' END AS status, count(*) AS n FROM k GROUP BY ALL""")
register("j29_external_weights", lambda s, d: slam.join_weights(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.5).alias("weight")), ["l_orderkey", "l_linenumber"]).groupBy("l_suppkey").agg(F.sum("weight").alias("weight")), "SELECT l_suppkey, sum(CASE WHEN o_orderkey IS NOT NULL THEN 0.5 ELSE 1 END)::DOUBLE AS weight FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 2 = 0 AND l_linenumber = 1 GROUP BY l_suppkey")
register("a32_trim_quality", lambda s, d: slam.base_composition(reads(s, d).select((F.col("cb") % 2 + 1).alias("mate"), F.col("umi").alias("seq"), F.lit("I5I5").alias("qual"))), f"""WITH {READS}, e AS (SELECT cb % 2 + 1 AS mate, i - 1 AS pos, umi[i] AS b, CASE WHEN i % 2 = 1 THEN 40 ELSE 20 END AS q FROM reads, range(1, 5) t(i)) SELECT mate, pos, count(*) FILTER (b = 'A') AS "A", count(*) FILTER (b = 'C') AS "C", count(*) FILTER (b = 'G') AS "G", count(*) FILTER (b = 'T') AS "T", count(*) FILTER (b = 'N') AS "N", avg(q) AS mean_qual FROM e GROUP BY ALL""")
register("o6_seeded_order", lambda s, d: flex.downsample(reads(s, d).select("read"), 1 << 30, "read", 777))
register("u10_concatenate", lambda s, d: tables.concatenate([table(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), table(s, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey")], "part"), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS part FROM orders")
register("x1_strings", lambda s, d: table(s, d, "nation").select("n_nationkey", F.substring("n_name", 2, 3).alias("mid"), F.rpad(F.lower("n_name"), 20, ".").alias("pad"), F.contains(F.lower("n_name"), F.lit("an")).alias("an")), "SELECT n_nationkey, substr(n_name, 2, 3) AS mid, rpad(lower(n_name), 20, '.') AS pad, contains(lower(n_name), 'an') AS an FROM nation")
_model_lines = lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
_model_bases = lambda s, d: _model_lines(s, d).select(F.col("l_orderkey").alias("read"), F.lit(8).alias("length"), (F.col("l_partkey") % 4).alias("ref"), F.when(F.col("l_suppkey") % 10 > 0, F.col("l_partkey") % 4).otherwise((F.col("l_partkey") + 1) % 4).alias("base"), F.col("l_linenumber").alias("at"))
register("m10_error_model", lambda s, d: quant.error_model(_model_bases(s, d), 2).select(F.col("bin").cast("int").alias("bin"), "before", "state", (F.floor(F.col("logp") * 1e6 + 0.5) / 1e6).alias("logp")))
register("m15_flex_empty_drops", lambda s, d: cells.flex_empty_drops(cell_matrix(s, d), cell_matrix(s, d).groupBy("cb").agg(F.sum("n").alias("n")), 1000, 45, 60, rounds=100))
register("z4_sample_filter", lambda s, d: cells.sample_summary(cells.filter_samples(cell_matrix(s, d).withColumn("gem", F.col("cb")).withColumn("tag", F.col("cb") % 2).drop("cb"), 100, crowded=1)))
register("a2_partial_merge", lambda s, d: tables.merge_partials([molecules(s, d).where("cb < 40").groupBy("gene").agg(F.sum("n").alias("reads")), molecules(s, d).where("cb >= 40").groupBy("gene").agg(F.sum("n").alias("reads"), F.count("*").alias("late"))], ["gene"]), f"WITH {MOLECULES} SELECT gene, CAST(sum(n) AS BIGINT) AS reads, count(*) FILTER (cb >= 40) AS late FROM mol GROUP BY gene")
