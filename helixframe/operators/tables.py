"""Rules on whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters N between two short contigs.
SPACER = 60


def merge_partials(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """A2: counts of several runs, added up by key; columns that a part lacks count 0 there."""
    every = concatenate(parts)
    values = [c for c in every.columns if c not in keys]
    return every.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in values])


def concatenate(parts: list[DataFrame], source: str | None = None) -> DataFrame:
    """All rows of all parts; source: a column with the part's number, from 0."""
    numbered = [p.withColumn(source, F.lit(i)) if source else p for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def with_covariates(counts: DataFrame, covariates: DataFrame, missing: float | None = None) -> DataFrame:
    """The covariates of each cell beside its counts; ``missing`` where a cell has none."""
    names = [c for c in covariates.columns if c != "cb"]
    out = counts.join(covariates, "cb", "left")
    return out if missing is None else out.na.fill(missing, names)


def best(rows: DataFrame, group: list[str], score: str, tie: list[str], n: int = 2) -> DataFrame:
    """The n best rows of each group, with their rank from 1."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), *tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def place_order(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """O1/K3: by chr and pos, rows without chr last, ties by read; ``parts`` ranges whose order is that of their numbers."""
    key = [F.col("chr").asc_nulls_last(), F.col("pos"), F.col("read")]
    return rows.orderBy(*key) if parts is None else rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)


def first_rows(rows: DataFrame, n: int, by: str) -> DataFrame:
    """The detection window, a feature of the runs that have one."""
    return rows.orderBy(by).limit(n)


def without(cells: DataFrame, gone: DataFrame, by: str = "cb") -> DataFrame:
    """U6."""
    return cells.join(gone.select(by).distinct(), by, "left_anti")


def contig_name(header: Column) -> Column:
    """The first word of a FASTA header; leading digits, X or Y become chr and those, MT... becomes chrM."""
    name = F.substring_index(F.regexp_replace(header, "^>", ""), " ", 1)
    prefix = F.regexp_extract(name, "^([0-9]+|[XY])", 1)
    return F.when(prefix != "", F.concat(F.lit("chr"), prefix)).when(name.startswith("MT"), F.lit("chrM")).otherwise(name)


def unversioned(identifier: Column) -> Column:
    """An identifier without its version."""
    return F.regexp_replace(identifier, r"\.\d+$", "")


def transcript_sequence(exons: DataFrame) -> DataFrame:
    """Tr, seq: the exons' sequences (tr, start, seq) in order of place; an exon of a transcript is one row."""
    x = F.array_sort(F.collect_list(F.struct("start", "seq")))
    return exons.groupBy("tr").agg(F.array_join(F.transform(x, lambda e: e["seq"]), "").alias("seq"))


def super_contigs(contigs: DataFrame, pack: str) -> DataFrame:
    """Contigs (contig, length) of each pack one after another, ``SPACER`` letters between them: adds shift, where a
    contig begins."""
    w = Window.partitionBy(pack).orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)
    return contigs.withColumn("shift", F.coalesce(F.sum(F.col("length") + SPACER).over(w), F.lit(0)))


def run_log(reads: DataFrame, splices: DataFrame) -> DataFrame:
    """One row of a run's metrics. reads: length, kind (unique, multi, too_many, mismatches, short, other), mapped,
    mismatches, deletions, deleted, insertions, inserted (of unique reads), chimeric; splices: motif (0-6), annotated, n."""
    n = F.count("*")
    of = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    unique = lambda c: F.coalesce(F.sum(F.when(F.col("kind") == "unique", F.col(c))), F.lit(0))
    share = lambda a, b, scale=1.0: F.when(b > 0, a * scale / b).otherwise(0.0)
    out = [n.alias("input_reads"), F.when(n > 0, F.floor(F.sum("length") / n)).otherwise(0).alias("mean_length"), of("unique").alias("unique"), share(of("unique"), n, 100.0).alias("unique_percent"), share(unique("mapped"), of("unique")).alias("mean_mapped_length")]
    out += [share(unique(a), unique("mapped"), 100.0).alias(b) for a, b in (("mismatches", "mismatch_percent"), ("deleted", "deletion_percent"), ("inserted", "insertion_percent"))]
    out += [share(unique("deleted"), unique("deletions")).alias("deletion_length"), share(unique("inserted"), unique("insertions")).alias("insertion_length")]
    for kind in ("multi", "too_many", "mismatches", "short", "other"):
        out += [of(kind).alias(f"{kind}_reads"), share(of(kind), n, 100.0).alias(f"{kind}_percent")]
    chimeric = F.count(F.when(F.col("chimeric"), 1))
    out += [chimeric.alias("chimeric_reads"), share(chimeric, n, 100.0).alias("chimeric_percent")]
    at = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)
    m = F.col("motif")
    spliced = splices.agg(at(F.lit(True), "splices"), at(F.col("annotated"), "splices_annotated"), at(m.isin(1, 2), "splices_gt_ag"), at(m.isin(3, 4), "splices_gc_ag"), at(m.isin(5, 6), "splices_at_ac"), at(m == 0, "splices_other"))
    return reads.agg(*out).crossJoin(spliced)  # one row each
