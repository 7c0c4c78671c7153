"""Splice junctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: thresholds by motif class (not canonical, GT/AG, GC/AG, AT/AC) and by reads of a junction
UNIQUE_MIN, TOTAL_MIN, OVERHANG_MIN = (3, 1, 1, 1), (3, 1, 1, 1), (30, 12, 12, 12)
MAX_GAP = (50000, 100000, 200000)
DISTANCE_MIN = (10, 0, 5, 10)


def _at(values: tuple[int, ...], i: Column) -> Column:
    return F.get(F.lit(list(values)), i.cast("int"))


def collapse(events: DataFrame, keys: tuple[str, ...] = ("chr", "start", "gap")) -> DataFrame:
    """A3: n_unique, n_multi, largest overhang, motif and annot of each junction. Raises where motifs disagree."""
    out = events.groupBy(*keys).agg(F.count(F.when(F.col("unique"), 1)).alias("n_unique"), F.count(F.when(~F.col("unique"), 1)).alias("n_multi"), F.max("overhang").alias("overhang"), F.min("motif").alias("motif"), F.max("motif").alias("_m"))
    return out.withColumn("motif", F.when(F.col("motif") == F.col("_m"), F.col("motif")).otherwise(F.raise_error(F.lit("motifs of one junction disagree")).cast("int"))).drop("_m")


def per_read(events: DataFrame) -> DataFrame:
    """Each junction once per read: n_unique, n_multi."""
    return events.select("read", "chr", "start", "gap", "unique").distinct().groupBy("chr", "start", "gap").agg(F.count(F.when(F.col("unique"), 1)).alias("n_unique"), F.count(F.when(~F.col("unique"), 1)).alias("n_multi"))


def motif_class() -> Column:
    return F.floor((F.col("motif") + 1) / 2)


def passes(unique_min=UNIQUE_MIN, total_min=TOTAL_MIN, overhang_min=OVERHANG_MIN, max_gap=MAX_GAP) -> Column:
    """A5: annotated, or enough reads, overhang, and a gap that so many reads may have."""
    m, total = motif_class(), F.col("n_unique") + F.col("n_multi")
    enough = (F.col("n_unique") >= _at(unique_min, m)) | (total >= _at(total_min, m))
    gap = (total > len(max_gap)) | (F.col("gap") <= _at(max_gap, total - 1))
    return F.col("annot") | (enough & (F.col("overhang") >= _at(overhang_min, m)) & gap)


def across_samples(junctions: DataFrame) -> DataFrame:
    """A6."""
    return junctions.groupBy("chr", "start", "gap").agg(F.sum("n_unique").alias("n_unique"), F.sum("n_multi").alias("n_multi"), F.max("overhang").alias("overhang"), F.countDistinct("sample").alias("samples"))


def far_from_neighbours(junctions: DataFrame, least=DISTANCE_MIN) -> DataFrame:
    """Junctions whose donor and acceptor each lie at least least[motif class] from the next other one."""
    j = junctions.withColumn("donor", F.col("start")).withColumn("acceptor", F.col("start") + F.col("gap"))
    for c in ("donor", "acceptor"):
        places = j.select("chr", c).distinct()
        w = Window.partitionBy("chr").orderBy(c)
        near = F.least(F.col(c) - F.lag(c).over(w), F.lead(c).over(w) - F.col(c))
        j = j.join(places.withColumn(f"{c}_near", near), ["chr", c])
    m = motif_class()
    ok = lambda c: F.coalesce(F.col(f"{c}_near") >= _at(least, m), F.lit(True))
    return j.where(ok("donor") & ok("acceptor")).drop("donor", "acceptor", "donor_near", "acceptor_near")


def by_junction_out(reads: DataFrame, rejected: DataFrame) -> DataFrame:
    """reads (read, chr, start, gap) none of whose junctions was rejected."""
    bad = reads.join(rejected.select("chr", "start", "gap"), ["chr", "start", "gap"], "left_semi").select("read").distinct()
    return reads.select("read").distinct().join(bad, "read", "left_anti")


def introns(exons: DataFrame) -> DataFrame:
    """Between neighbouring exons of a transcript: chr, start, end, strand; each once."""
    nxt = F.lead("start").over(Window.partitionBy("tr").orderBy("start", "end"))
    gaps = exons.withColumn("_next", nxt).select("chr", (F.col("end") + 1).alias("start"), (F.col("_next") - 1).alias("end"), "strand")
    return gaps.where("start <= end").distinct()


def merge_inserted(lists: DataFrame) -> DataFrame:
    """Of entries of one (chr, start, end) the best: priority, then canonical motif, then left-most repeat shift."""
    w = Window.partitionBy("chr", "start", "end").orderBy(F.desc("priority"), (F.col("motif") == 0).cast("int"), "shift", "strand")
    return lists.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def annotate(junctions: DataFrame, known: DataFrame) -> DataFrame:
    """J22."""
    return junctions.join(known.select("chr", "start", "gap").distinct().withColumn("annot", F.lit(True)), ["chr", "start", "gap"], "left").withColumn("annot", F.coalesce("annot", F.lit(False)))


def bed12(junctions: DataFrame, flank: int = 10) -> DataFrame:
    """Chr, chrom_start (0-based), chrom_end, block_sizes, block_starts."""
    s, e = F.col("start") - 1 - flank, F.col("start") - 1 + F.col("gap") + flank
    return junctions.select("chr", s.alias("chrom_start"), e.alias("chrom_end"), F.lit(f"{flank},{flank}").alias("block_sizes"), F.concat(F.lit("0,"), (F.col("gap") + flank).cast("string")).alias("block_starts"))


def gtf_rows(junctions: DataFrame, flank: int = 10) -> DataFrame:
    """The two flanking exons as rows: chr, part, start, end."""
    parts = F.explode(F.array(F.struct(F.lit(1).alias("part"), (F.col("start") - flank).alias("s"), (F.col("start") - 1).alias("e")), F.struct(F.lit(2).alias("part"), (F.col("start") + F.col("gap")).alias("s"), (F.col("start") + F.col("gap") + flank - 1).alias("e"))))
    return junctions.select("chr", "start", "gap", parts.alias("x")).select("chr", F.col("start").alias("junction"), "gap", "x.part", F.col("x.s").alias("start"), F.col("x.e").alias("end"))


def motif_filter(reads: DataFrame, mode: str = "canonical") -> DataFrame:
    """canonical drops reads with a non-canonical junction; unannotated only where it isn't annotated; strand drops
    reads whose junctions are of both strands. reads: read, motifs (array), annots (array of boolean)."""
    if mode == "canonical":
        return reads.where(~F.exists("motifs", lambda m: m == 0))
    if mode == "unannotated":
        return reads.where(~F.exists(F.arrays_zip("motifs", "annots"), lambda x: (x["motifs"] == 0) & ~x["annots"]))
    strands = F.filter(F.transform("motifs", lambda m: F.when(m > 0, 2 - m % 2)), lambda s: s.isNotNull())
    return reads.where(F.size(F.array_distinct(strands)) <= 1)


def circular(junctions: DataFrame, max_distance: int | None = 1_000_000, slack: int = 5) -> DataFrame:
    """F16: both ends on one chromosome and strand, the acceptor before the donor, near (max_distance None: at any distance), and
    the mates' spans within."""
    near = F.lit(True) if max_distance is None else F.col("pos1") - F.col("pos2") < max_distance
    return junctions.where((F.col("chr1") == F.col("chr2")) & (F.col("strand1") == F.col("strand2")) & (F.col("pos1") > F.col("pos2")) & near & (F.col("span1") + F.col("span2") <= F.col("pos1") - F.col("pos2") + 2 * slack))


def chimeric_pairs(aligns: DataFrame, score_range: int = 10, most: int = 10) -> DataFrame:
    """Pairs of a read's alignments that don't overlap on the read, on consistent strands, with a summed score within
    score_range of the read's best; none for reads with more than ``most``. aligns: read, id, rs, re, strand, score."""
    b = aligns.select("read", *[F.col(c).alias(f"{c}2") for c in ("id", "rs", "re", "strand", "score")])
    pairs = aligns.join(b, "read").where((F.col("re") < F.col("rs2")) & (F.col("strand") == F.col("strand2"))).withColumn("total", F.col("score") + F.col("score2"))
    w = Window.partitionBy("read")
    kept = pairs.withColumn("best", F.max("total").over(w)).where(F.col("total") + score_range >= F.col("best")).withColumn("n", F.count("*").over(w)).where(F.col("n") <= most)
    return kept.select("read", "id", "id2", "total", "n")
