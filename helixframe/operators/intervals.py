"""Interval joins and what is built on them (J12-J22, A1, P15, P17, F9, F17, F18). Intervals are closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], width: int = 64, how: str = "overlap") -> DataFrame:
    """Pairs of rows with equal ``on`` whose [start, end] meet; right's bounds come as start2, end2.

    Both sides are dealt to bins of ``width`` and equi-joined on bin and ``on``; a pair is kept in one bin only, that of
    the greater start, so that no deduplication follows. how: overlap, or contained (left within right)."""
    bins = lambda df, s, e: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    r = right.withColumnRenamed("start", "start2").withColumnRenamed("end", "end2")
    pairs = bins(left.where("start <= end"), "start", "end").join(bins(r.where("start2 <= end2"), "start2", "end2"), [*on, "_bin"])
    pairs = pairs.where((F.col("start") <= F.col("end2")) & (F.col("start2") <= F.col("end")) & (F.col("_bin") == F.floor(F.greatest("start", "start2") / width)))
    if how == "contained":
        pairs = pairs.where("start2 <= start and end <= end2")
    return pairs.drop("_bin")


def overlap_length() -> Column:
    return F.least("end", "end2") - F.greatest("start", "start2") + 1


def block_genes(blocks: DataFrame, exons: DataFrame) -> DataFrame:
    """Read, block, strand, gene, gene_strand of every overlap."""
    e = exons.select("chr", "start", "end", "gene", F.col("strand").alias("gene_strand"))
    return overlap_join(blocks, e, ["chr"]).select("read", "block", "strand", "gene", "gene_strand").distinct()


def gene_counts(blocks: DataFrame, exons: DataFrame) -> DataFrame:
    """A1/K6: gene, unstranded, forward, reverse read counts, with rows N_multimapping, N_noFeature and N_ambiguous.

    Reads of more than one place (nh > 1) are counted once in N_multimapping. Any two genes make a read ambiguous."""
    multi = blocks.where("nh > 1").select("read").distinct().agg(F.count("*").alias("n")).select(F.lit("N_multimapping").alias("gene"), *[F.col("n").alias(c) for c in ("unstranded", "forward", "reverse")])
    one = blocks.where("nh = 1")
    hits = block_genes(one, exons)
    same = F.col("strand") == F.col("gene_strand")
    cols = {"unstranded": F.lit(True), "forward": same, "reverse": ~same}
    aggs = []
    for name, cond in cols.items():
        g = F.when(cond, F.col("gene"))
        aggs += [F.min(g).alias(f"{name}_a"), F.max(g).alias(f"{name}_b")]
    per = one.select("read").distinct().join(hits.groupBy("read").agg(*aggs), "read", "left")
    kind = lambda c: F.when(F.col(f"{c}_a").isNull(), "N_noFeature").when(F.col(f"{c}_a") != F.col(f"{c}_b"), "N_ambiguous").otherwise(F.col(f"{c}_a"))
    long = per.select(F.explode(F.array(*[F.struct(F.lit(c).alias("mode"), kind(c).alias("gene")) for c in cols])).alias("x")).select("x.*")
    counts = long.groupBy("gene").agg(*[F.count(F.when(F.col("mode") == c, 1)).alias(c) for c in cols])
    return multi.unionByName(counts)


def containment(aligns: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Reads whose whole alignment lies in a transcript. aligns: read, chr, start, end."""
    return overlap_join(aligns, transcripts, ["chr"], 256, "contained")


def concordance(blocks: DataFrame, exons: DataFrame, min_overlap: int = 0) -> DataFrame:
    """Read, tr, class of each transcript that contains the alignment: exonic where each block lies in an exon,
    intronic where none meets one by more than min_overlap, spanning otherwise. exons: chr, tr, start, end."""
    span = blocks.groupBy("read", "chr").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("blocks"))
    trs = exons.groupBy("chr", "tr").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    inside = containment(span, trs).select("read", "chr", "tr", "blocks")
    met = overlap_join(blocks.select("read", "chr", "start", "end"), exons.select("chr", "tr", "start", "end"), ["chr"])
    per = met.groupBy("read", "tr").agg(F.count(F.when(F.expr("start2 <= start and end <= end2"), 1)).alias("within"), F.max(overlap_length()).alias("most"))
    both = inside.join(per, ["read", "tr"], "left")
    kind = F.when(F.col("within") == F.col("blocks"), "exonic").when(F.coalesce("most", F.lit(0)) <= min_overlap, "intronic").otherwise("spanning")
    return both.select("read", "tr", kind.alias("class"))


def exon_over_intron(exonic: DataFrame, genic: DataFrame) -> DataFrame:
    """A read's concordant genes where it has any, else the genes that hold it. Both: read, gene."""
    return exonic.select("read", "gene").unionByName(genic.join(exonic.select("read").distinct(), "read", "left_anti").select("read", "gene"))


def half_exonic(blocks: DataFrame, exons: DataFrame, genes: DataFrame) -> DataFrame:
    """Read, gene, level of the first level present: 1 exonic, 2 exonic antisense, 3 over half exonic, 4 the same
    antisense, 5 intronic, 6 intronic antisense. An antisense winner has no gene."""
    length = blocks.groupBy("read").agg(F.sum(F.col("end") - F.col("start") + 1).alias("length"))
    hit = lambda df: overlap_join(blocks, df.select("chr", "start", "end", "gene", F.col("strand").alias("gene_strand")), ["chr"]).withColumn("anti", F.col("strand") != F.col("gene_strand"))
    ex = hit(exons).groupBy("read", "gene", "anti").agg(F.sum(overlap_length()).alias("bases")).join(length, "read")
    ex = ex.select("read", "gene", "anti", F.when(F.col("bases") >= F.col("length"), 1).when(2 * F.col("bases") > F.col("length"), 3).alias("level")).where("level is not null")
    body = hit(genes).select("read", "gene", "anti", F.lit(5).alias("level")).distinct()
    every = ex.unionByName(body).withColumn("level", F.col("level") + F.col("anti").cast("int"))
    best = every.withColumn("first", F.min("level").over(Window.partitionBy("read"))).where("level = first")
    return best.select("read", F.when(~F.col("anti"), F.col("gene")).alias("gene"), "level").distinct()


def lenient_overlap(blocks: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Read, tr where at least half of the alignment lies in the transcript."""
    length = blocks.groupBy("read").agg(F.sum(F.col("end") - F.col("start") + 1).alias("length"))
    per = overlap_join(blocks, transcripts.select("chr", "tr", "start", "end"), ["chr"]).groupBy("read", "tr").agg(F.sum(overlap_length()).alias("bases"))
    return per.join(length, "read").where("2 * bases >= length").select("read", "tr", "bases")


def intronic_genes(aligns: DataFrame, introns: DataFrame) -> DataFrame:
    """Read, gene where an alignment of one block meets introns of more than one transcript of the gene."""
    per = overlap_join(aligns.where("blocks = 1"), introns.select("chr", "tr", "gene", "start", "end"), ["chr"]).groupBy("read", "gene").agg(F.countDistinct("tr").alias("trs"))
    return per.where("trs > 1").select("read", "gene")


def mask_reads(bases: DataFrame, mask: DataFrame) -> DataFrame:
    """Without all reads that have a base at a masked place."""
    bad = bases.join(mask.select("chr", "pos"), ["chr", "pos"], "left_semi").select("read").distinct()
    return bases.join(bad, "read", "left_anti")


def snp_alleles(blocks: DataFrame, snps: DataFrame) -> DataFrame:
    """Read, chr, pos, allele (1, 2; 3 for neither) of each SNP in a block. snps: chr, pos, a1, a2; blocks: base."""
    s = snps.select("chr", F.col("pos").alias("start"), F.col("pos").alias("end"), "a1", "a2")
    hit = overlap_join(blocks, s, ["chr"])
    return hit.select("read", "chr", F.col("start2").alias("pos"), F.when(F.col("base") == F.col("a1"), 1).when(F.col("base") == F.col("a2"), 2).otherwise(3).alias("allele"))


def wasp(alleles: DataFrame, reads: DataFrame) -> DataFrame:
    """codes that need no second mapping: 2 for reads of several places, 3 for a base that is neither allele, 7 for
    too many SNPs (over 10); null where a second mapping must decide. reads: read, nh."""
    per = alleles.groupBy("read").agg(F.count("*").alias("snps"), F.max("allele").alias("worst"))
    return per.join(reads, "read").select("read", F.when(F.col("nh") > 1, 2).when(F.col("worst") == 3, 3).when(F.col("snps") > 10, 7).alias("code"))


def liftover(intervals: DataFrame, chain: DataFrame) -> DataFrame:
    """Key, start, end, lifted. A left end between blocks moves to the next block's start, a right end to the last
    block's end before it; null bounds and lifted false if no block is left. chain: chr, start, end, shift."""
    hit = overlap_join(intervals, chain, ["chr"])
    per = hit.groupBy("key").agg(F.min(F.struct("start2", "shift", "start")).alias("a"), F.max(F.struct("end2", "shift", "end")).alias("b"))
    out = per.select("key", (F.greatest("a.start2", "a.start") + F.col("a.shift")).alias("start"), (F.least("b.end2", "b.end") + F.col("b.shift")).alias("end"))
    return intervals.select("key").join(out, "key", "left").withColumn("lifted", F.col("start").isNotNull())


def y_reads(aligns: DataFrame, y: str) -> DataFrame:
    """Read and whether any of its alignments is on the Y chromosome."""
    return aligns.groupBy("read").agg(F.max(F.col("chr") == y).alias("y"))


def to_transcript(blocks: DataFrame, exons: DataFrame) -> DataFrame:
    """Read, block, tr, place in the transcript of each block that lies in an exon. exons: chr, tr, start, end."""
    before = F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(Window.partitionBy("tr").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = exons.select("chr", "tr", "start", "end").withColumn("before", before)
    return overlap_join(blocks, e, ["chr"], how="contained").select("read", "block", "tr", (F.col("before") + F.col("start") - F.col("start2")).alias("place"))
