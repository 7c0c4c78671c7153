"""Writers (K1-K26): each forms the rows of a format in Spark and leaves the writing to Spark, a folder of parts; ``one`` brings
small reports into one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.matrix import reindex


def _tsv(df: DataFrame, path: str, header: bool = False, one: bool = False, sep: str = "\t") -> None:
    (df.coalesce(1) if one else df).write.mode("overwrite").options(sep=sep, header=str(header).lower(), quote="", nullValue="", emptyValue="").csv(path)


def sam_lines(aligns: DataFrame) -> DataFrame:
    """K1: value, a line for each alignment; tags in order of their names."""
    tags = F.array_join(F.transform(F.array_sort(F.map_keys("tags")), lambda k: F.concat(k, F.when(F.element_at("tags", k).rlike("^-?[0-9]+$"), ":i:").otherwise(":Z:"), F.element_at("tags", k))), "\t")
    cols = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    return aligns.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols], F.nullif(tags, F.lit(""))).alias("value"))


def coordinate_sorted(aligns: DataFrame, parts: int) -> DataFrame:
    """K2/K3: in order of place, unmapped last, ties by name; by ranges, so that parts are in order too."""
    key: list[Column] = [F.col("rname").asc_nulls_last(), F.col("pos"), F.col("qname")]
    return aligns.repartitionByRange(parts, *key).sortWithinPartitions(*key)


def write_sam(aligns: DataFrame, path: str) -> None:
    sam_lines(aligns).write.mode("overwrite").text(path)


def write_junctions(j: DataFrame, path: str) -> None:
    """K4: chr, start, end, strand, motif, annot, n_unique, n_multi, overhang."""
    strand = F.when(F.col("motif") == 0, 0).otherwise(2 - F.col("motif") % 2)
    _tsv(j.select("chr", "start", (F.col("start") + F.col("gap") - 1).alias("end"), strand, "motif", F.col("annot").cast("int"), "n_unique", "n_multi", "overhang").orderBy("chr", "start", "end"), path)


def write_chimeric(pairs: DataFrame, path: str) -> None:
    """K5: all columns, in their order, with a header."""
    _tsv(pairs, path, True)


def write_gene_counts(counts: DataFrame, path: str) -> None:
    """K6: the summary rows, then the genes."""
    first = F.when(F.col("gene").startswith("N_"), 0).otherwise(1)
    _tsv(counts.select("gene", "unstranded", "forward", "reverse").orderBy(first, "gene"), path, one=True)


def write_bedgraph(signal: DataFrame, path: str) -> None:
    """K7."""
    _tsv(signal.select("chr", F.col("start") - 1, F.col("end") - 1, F.format_string("%.5f", "value")).orderBy("chr", "start"), path)


def write_mex(m: DataFrame, features: DataFrame, barcodes: DataFrame, path: str) -> None:
    """Matrix, features and barcodes; rows and columns numbered from 1 in order of name. All barcodes given are
    columns (raw: the whole list; filtered: those passing)."""
    f, b = reindex(features.select("gene").distinct(), "gene", "row"), reindex(barcodes.select("cb").distinct(), "cb", "column")
    entries = m.join(f, "gene").join(b, "cb").select("row", "column", "n")
    size = entries.agg(F.count("*").alias("n")).first().n
    kind = "integer" if dict(m.dtypes)["n"] in ("int", "bigint") else "real"
    spark = m.sparkSession
    head = spark.createDataFrame([(0, 0, f"%%MatrixMarket matrix coordinate {kind} general"), (0, 1, f"{f.count()} {b.count()} {size}")], "a bigint, c bigint, value string")
    lines = entries.select(F.col("column").alias("a"), F.col("row").alias("c"), F.concat_ws(" ", F.col("row").cast("string"), F.col("column").cast("string"), F.col("n").cast("string")).alias("value"))
    head.unionByName(lines).orderBy("a", "c").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/matrix.mtx")
    for frame, col, name in ((f, "row", "features.tsv"), (b, "column", "barcodes.tsv")):
        frame.orderBy(col).select(F.col("gene" if col == "row" else "cb").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def metric_rows(summary: DataFrame) -> DataFrame:
    """Metric, value of a one-row frame."""
    return summary.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in summary.columns])).alias("x")).select("x.*")


def write_metrics(summary: DataFrame, path: str) -> None:
    _tsv(metric_rows(summary), path, one=True, sep=",")


def write_quant(q: DataFrame, path: str) -> None:
    """K11."""
    six = lambda c: F.format_string("%.6f", c)
    _tsv(q.select(F.col("tx").alias("Name"), F.format_string("%.0f", "length").alias("Length"), six("eff").alias("EffectiveLength"), six("tpm").alias("TPM"), six("count").alias("NumReads")), path, True)


def write_conversions(genes: DataFrame, path: str) -> None:
    """Gene, symbol, reads, conversions, coverage, ntr, map, sigma, log likelihood."""
    _tsv(genes.select(F.col("gene").alias("Gene"), F.col("symbol").alias("Symbol"), F.col("reads").alias("ReadCount"), F.col("conversions").alias("Conversions"), F.col("coverage").alias("Coverage"), F.col("ntr").alias("NTR"), F.col("ntr").alias("MAP"), F.col("sigma").alias("Sigma"), F.col("log_likelihood").alias("LogLikelihood")), path, True)


def write_report(df: DataFrame, path: str) -> None:
    """A table with a header, in one file."""
    _tsv(df, path, True, True)


def report_json(df: DataFrame, **about) -> DataFrame:
    """Value, one JSON document with the given facts and all rows of a small report frame."""
    rows = df.agg(F.collect_list(F.struct(*df.columns)).alias("positions"))
    return rows.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in about.items()], "positions")).alias("value"))


def write_mask(sites: DataFrame, path: str) -> None:
    """BED, in order."""
    _tsv(sites.select("chr", F.col("pos") - 1, "pos").orderBy("chr", "pos"), path)


def write_dump(reads: DataFrame, path: str, by: str = "file_idx") -> None:
    """Parquet by file; the key is a hash of read, gene and place."""
    reads.write.mode("overwrite").partitionBy(by).parquet(path)


def write_calls(calls: DataFrame, path: str) -> None:
    """K17."""
    _tsv(calls.select(F.col("cb").alias("cell_barcode"), "num_features", "feature_call", "num_umis").orderBy("cell_barcode"), path, True, sep=",")


def fastq_lines(reads: DataFrame, group: str) -> DataFrame:
    """Group, value: the four lines of each read."""
    return reads.select(group, F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value"))


def write_fastq(reads: DataFrame, path: str, group: str) -> None:
    fastq_lines(reads, group).write.mode("overwrite").partitionBy(group).text(path)


def overlap_tags(reads: DataFrame) -> DataFrame:
    """ZG, the genes, and ZX, the class; antisense and over-half classes count as what they are of, intergenic as none."""
    kind = F.when(F.col("class").startswith("exonic") | (F.col("class") == "over_half"), "exonic").when(F.col("class").startswith("intronic"), "intronic").when(F.col("class") == "intergenic", "none").otherwise(F.col("class"))
    return reads.select("read", F.array_join(F.array_distinct("genes"), ",").alias("ZG"), kind.alias("ZX"))


def write_tag_table(tags: DataFrame, path: str) -> None:
    """K24."""
    _tsv(tags.select("read", "cb", "ub", "status"), path)


#: Tags of the presets (K1).
TAGS = {"none": [], "standard": ["NH", "HI", "AS", "nM"], "all": ["NH", "HI", "AS", "nM", "NM", "MD", "jM", "jI", "MC", "ch"]}


def mapping_quality(hits: Column, unique: int = 255) -> Column:
    """K1: unique for one place, 3 for two, 1 for three or four, 0 beyond."""
    return F.when(hits >= 5, 0).when(hits >= 3, 1).when(hits == 2, 3).otherwise(unique)


def with_preset(aligns: DataFrame, preset: str = "standard", flag_or: int = 0, flag_and: int = 65535, unique: int = 255) -> DataFrame:
    """K1: the preset's tags (of the column tags, which has NH), flags combined with both masks, quality by the number of places."""
    keep = F.array(*map(F.lit, TAGS[preset])) if TAGS[preset] else F.array().cast("array<string>")
    hits = F.coalesce(F.col("tags")["NH"].cast("int"), F.lit(1))
    flag = F.col("flag").cast("int").bitwiseOR(F.lit(flag_or)).bitwiseAND(F.lit(flag_and))
    return aligns.withColumn("mapq", mapping_quality(hits, unique)).withColumn("flag", flag).withColumn("tags", F.map_filter("tags", lambda k, _: F.array_contains(keep, k)))
