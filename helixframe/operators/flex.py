"""Probe-based assays (S11-S13, F5, F7, F22, M23, O7, G9) and general read filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def probe_status(probes: DataFrame, genes: DataFrame, length: int = 50) -> DataFrame:
    """adds status: deprecated, excluded, no_gene or ok, the first that holds. An invalid sequence raises. probes: gene_id,
    probe_seq, probe_id, included."""
    known = probes.join(genes.select("gene_id").distinct().withColumn("_known", F.lit(True)), "gene_id", "left")
    bad = ~F.col("probe_seq").rlike(f"^[ACGT]{{{length}}}$")
    status = F.when(F.upper("probe_id").contains("DEPRECATED"), "deprecated").when(F.upper("included") != "TRUE", "excluded").when(bad, F.raise_error(F.concat(F.lit("invalid probe sequence of "), F.col("probe_id")))).when(F.col("_known").isNull(), "no_gene").otherwise("ok")
    return known.withColumn("status", status).drop("_known")


def probe_index(probes: DataFrame, most: int | None = 32767) -> DataFrame:
    """Index from 1 in order of gene, probe; without deprecated ones, up to ``most`` (None: all). Genes are ranked over their
    counts first, so that no task holds all probes."""
    kept = probes.where(~F.upper("probe_id").contains("DEPRECATED"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_gene").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    genes = kept.groupBy(F.col("gene_id").alias("_gene")).agg(F.count("*").alias("_n")).select("_gene", before.alias("_before"))
    ranked = kept.withColumn("_r", F.row_number().over(Window.partitionBy("gene_id").orderBy("probe_id"))).join(genes, F.col("gene_id").eqNullSafe(F.col("_gene")))
    index = ranked.withColumn("index", (F.col("_before") + F.col("_r")).cast("int")).drop("_gene", "_before", "_r")
    return index if most is None else index.where(F.col("index") <= most)


def tag_variants(variants: DataFrame, most: int = 8) -> DataFrame:
    """Distinct 8-mers over ACGT, ``most`` for each sample in their order."""
    ok = variants.where(F.col("variant").rlike("^[ACGT]{8}$")).dropDuplicates(["sample", "variant"])
    return ok.withColumn("_r", F.row_number().over(Window.partitionBy("sample").orderBy("variant"))).where(F.col("_r") <= most).drop("_r")


def probe_alignments(aligns: DataFrame, max_nm: int | None = None, max_rate: float = 0.1, least_mapq: int = 255) -> DataFrame:
    """adds drop, the reason or null. aligns: read, contig, cigar, nm, mapq, length, gene (null for none)."""
    probe = F.col("contig").startswith("ENSG")
    reason = F.when(probe & ~F.col("cigar").isin("40S50M", "50M40S", "50M"), "cigar")
    reason = reason.when(F.col("nm") > max_nm, "nm") if max_nm is not None else reason.when(F.col("nm") / F.col("length") > max_rate, "nm_rate")
    return aligns.withColumn("drop", reason.when(~probe & (F.col("mapq") < least_mapq), "mapq").when(~probe & F.col("gene").isNull(), "no_gene"))


def resolve_gene(aligns: DataFrame) -> DataFrame:
    """Read, gene, reason. The best-scored probe alignments decide where there are any, else the best genomic ones; one gene
    resolves. aligns: read, probe (boolean), gene, score, kept ones only."""
    w = Window.partitionBy("read", "probe")
    best = aligns.withColumn("_b", F.max("score").over(w)).where("score = _b")
    per = best.groupBy("read").agg(*[f(F.when(c, F.col("gene"))).alias(n) for n, f, c in (("pa", F.min, F.col("probe")), ("pb", F.max, F.col("probe")), ("ga", F.min, ~F.col("probe")), ("gb", F.max, ~F.col("probe")))])
    gene = F.when(F.col("pa").isNotNull(), F.when(F.col("pa") == F.col("pb"), F.col("pa"))).when(F.col("ga") == F.col("gb"), F.col("ga"))
    reason = F.when(F.col("pa").isNotNull() & (F.col("pa") != F.col("pb")), "PROBE_DISAGREE").when(F.col("pa").isNull() & F.col("ga").isNull(), "NO_CANDIDATES").when(F.col("pa").isNull() & (F.col("ga") != F.col("gb")), "GENOMIC_DISAGREE")
    return per.select("read", gene.alias("gene"), reason.alias("reason"))


def one_gene(reads: DataFrame) -> DataFrame:
    """of several genes the first in order."""
    return reads.withColumn("gene", F.array_min("genes"))


def mapped_filter(reads: DataFrame, least_score: float = 0.66, least_match: float = 0.66, most_mm: int = 10, most_mm_share: float = 0.3, most_places: int = 10) -> DataFrame:
    """F1: adds unmapped, the first rule that fails: other, short, mismatch or multi; null for mapped. reads: windows, score,
    matched, mismatches, mapped_length, places, length."""
    room = F.col("length") - 1
    rule = F.when(F.col("windows") == 0, "other").when((F.col("score") < least_score * room) | (F.col("matched") < least_match * room), "short").when((F.col("mismatches") > most_mm) | (F.col("mismatches") > most_mm_share * F.col("mapped_length")), "mismatch").when(F.col("places") > most_places, "multi")
    return reads.withColumn("unmapped", rule)


def score_range(aligns: DataFrame, room: int = 1) -> DataFrame:
    """F2: alignments with score + room >= the read's best; adds primary, the best (ties: first id)."""
    w = Window.partitionBy("read")
    kept = aligns.withColumn("_b", F.max("score").over(w)).where(F.col("score") + room >= F.col("_b")).drop("_b")
    return kept.withColumn("primary", F.row_number().over(w.orderBy(F.desc("score"), "id")) == 1)


def strand_filter(reads: DataFrame, mode: int) -> DataFrame:
    """F8: 0 keeps all, 1 sense, 2 antisense (opposite)."""
    return reads if mode == 0 else reads.where(F.col("opposite") == F.lit(mode == 2))


def mate_overlap_filter(bases: DataFrame, ignore: bool = True) -> DataFrame:
    """without the second mate's bases where the mates overlap."""
    return bases.where(~(F.col("second_mate") & F.col("overlap"))) if ignore else bases


def pileup_bases(bases: DataFrame, least_mapq: int = 20, least_qual: int = 20) -> DataFrame:
    """no secondary or supplementary alignments, enough quality."""
    return bases.where((F.col("mapq") >= least_mapq) & (F.col("qual") >= least_qual) & (F.col("flag").bitwiseAND(0x900) == 0))


def signal_reads(aligns: DataFrame) -> DataFrame:
    """no duplicates, at least one place."""
    return aligns.where((F.col("flag").bitwiseAND(0x400) == 0) & (F.coalesce("nh", F.lit(1)) > 0))


def split_by_name(reads: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """reads in the set of names, and the others."""
    return reads.join(names.distinct(), "name", "left_semi"), reads.join(names.distinct(), "name", "left_anti")


def background_sites(sites: DataFrame, excluded: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """N sites drawn by a keyed hash, without those excluded, in order of place."""
    kept = sites.join(excluded, ["chr", "pos"], "left_anti").distinct()
    return kept.orderBy(F.xxhash64(F.lit(seed), "chr", "pos"), "chr", "pos").limit(n).orderBy("chr", "pos")


def downsample(reads: DataFrame, n: int, key: str, seed: int | None = None) -> DataFrame:
    """The first n in order of the key, or n drawn by a keyed hash."""
    return reads.orderBy(*([key] if seed is None else [F.xxhash64(F.lit(seed), key), key])).limit(n)
