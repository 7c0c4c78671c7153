"""Readers of sequencing text formats (S1-S23). All of them go through Spark's own file readers, so that paths may be of any
store and compressed files are read as they are; schemas are explicit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line (from 0), value. Lines are counted in each file block, and the blocks' counts are summed up: a file may be
    split, and no task needs more than its block."""
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            file, block = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = np.empty(b.num_rows, np.int64)
            for i, key in enumerate(zip(file, block, strict=True)):
                n = n + 1 if key == last else 0
                last = key
                at[i] = n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["file", "block", "value", "at"])

    lines = raw.mapInArrow(count, "file string, block bigint, value string, at bigint")
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))  # a row for each block
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(sizes.withColumn("before", before), ["file", "block"]).select("file", (F.col("before") + F.col("at")).alias("line"), "value")


def fastq(spark: SparkSession, paths: str | list[str], mate: int = 1) -> DataFrame:
    """File, read (from 0), name (first word, without /1 or /2), seq, qual, mate."""
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    rows = numbered_lines(spark, paths).groupBy("file", F.expr("line div 4").alias("read")).agg(part(0).alias("name"), part(1).alias("seq"), part(3).alias("qual"))
    name = F.regexp_replace(F.regexp_extract("name", r"^@(\S*)", 1), r"/[12]$", "")
    return rows.select("file", "read", name.alias("name"), "seq", "qual", F.lit(mate).alias("mate"))


def mates(one: DataFrame, two: DataFrame) -> DataFrame:
    """Both mates of each read, by read name."""
    b = two.select("name", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    return one.join(b, "name")


def fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """File, contig, seq. Lines are numbered, a header opens a contig; a contig's lines meet in one row."""
    lines = numbered_lines(spark, paths)
    heads = lines.where("value like '>%'").select("file", F.col("line").alias("start"), F.regexp_extract("value", r"^>(\S*)", 1).alias("contig"))
    heads = heads.withColumn("stop", F.coalesce(F.lead("start").over(Window.partitionBy("file").orderBy("start")), F.lit(1 << 62)))
    body = lines.where("value not like '>%' and value <> ''")
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    both = body.select("file", "line", "value", F.lit(None).cast("string").alias("contig")).unionByName(heads.select("file", F.col("start").alias("line"), F.lit(None).cast("string").alias("value"), "contig"))
    named = both.withColumn("contig", F.last("contig", True).over(w)).where("value is not null")
    return named.groupBy("file", "contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "").alias("seq"))


def _fields(spark: SparkSession, paths, schema: str, comment: str | None = "#", sep: str = "\t", header: bool = False) -> DataFrame:
    options = {"sep": sep, "header": str(header).lower(), "quote": ""} | ({"comment": comment} if comment else {})
    return spark.read.options(**options).schema(schema).csv(paths)


def sam(spark: SparkSession, paths) -> DataFrame:
    """Alignment columns with tags, a map."""
    raw = spark.read.text(paths).where("value not like '@%'").select(F.split("value", "\t").alias("f"))
    at = lambda i, kind="string": F.get("f", F.lit(i)).cast(kind)
    tags = F.map_from_entries(F.transform(F.slice("f", F.lit(12), F.greatest(F.lit(0), F.size("f") - 11)), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 30))))
    return raw.select(at(0).alias("qname"), at(1, "int").alias("flag"), at(2).alias("rname"), at(3, "bigint").alias("pos"), at(4, "int").alias("mapq"), at(5).alias("cigar"), at(6).alias("rnext"), at(7, "bigint").alias("pnext"), at(8, "int").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"), tags.alias("tags"))


def _attribute(name: str) -> Column:
    return F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{name}[ =]"?([^";]*)"?', 1), F.lit(""))


def gtf(spark: SparkSession, paths, lengths: DataFrame | None = None, feature: str = "exon") -> DataFrame:
    """Exons with gene, tr, gene_name, gene_type; missing ones get stand-ins. lengths (chr, length): exons that end beyond
    are left out."""
    raw = _fields(spark, paths, "chr string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attributes string").where(F.col("feature") == feature)
    gene = F.coalesce(_attribute("gene_id"), F.lit("MissingGeneID"))
    tr = F.coalesce(_attribute("transcript_id"), F.concat_ws("_", F.lit("tr"), "chr", "start", "end"))
    out = raw.select("chr", "start", "end", "strand", gene.alias("gene"), tr.alias("tr"), F.coalesce(_attribute("gene_name"), gene).alias("gene_name"), F.coalesce(_attribute("gene_type"), _attribute("gene_biotype"), F.lit("MissingGeneType")).alias("gene_type"))
    return out if lengths is None else out.join(lengths, "chr").where(F.col("end") <= F.col("length")).drop("length")


def junction_list(spark: SparkSession, paths) -> DataFrame:
    """S6."""
    return _fields(spark, paths, "chr string, start bigint, end bigint, strand string")


def _vcf(spark: SparkSession, paths) -> DataFrame:
    return _fields(spark, paths, "chr string, pos bigint, id string, ref string, alt string, qual string, filter string, info string, format string, sample string")


def vcf_genotypes(spark: SparkSession, paths, hetero_only: bool = False) -> DataFrame:
    """Chr, pos, a1, a2 of SNVs that aren't homozygous reference."""
    v = _vcf(spark, paths).where("ref rlike '^[ACGT]$' and alt rlike '^[ACGT]$'")
    gt = F.regexp_replace(F.split("sample", ":")[0], r"\|", "/")
    v = v.withColumn("g", F.split(gt, "/")).where((F.size("g") == 2) & (F.array_max("g") != "0"))
    v = v.where(F.col("g")[0] != F.col("g")[1]) if hetero_only else v
    base = lambda i: F.when(F.col("g")[i] == "0", F.col("ref")).otherwise(F.col("alt"))
    return v.select("chr", "pos", base(0).alias("a1"), base(1).alias("a2"))


def vcf_mask(spark: SparkSession, paths, mode: str = "gt", only_pass: bool = True) -> tuple[DataFrame, DataFrame]:
    """Places (chr, pos), each once; and how many lines met which fate, the first that holds."""
    v = _vcf(spark, paths)
    gt = F.regexp_replace(F.split("sample", ":")[0], r"\|", "/")
    fate = F.when(~F.col("ref").rlike("^[ACGT]$") | ~F.col("alt").rlike("^[ACGT]$"), "not_snv").when(F.lit(only_pass) & ~F.col("filter").isin("PASS", "."), "filtered")
    if mode == "gt":
        fate = fate.when(gt.isNull() | gt.contains("."), "no_genotype").when(gt == "0/0", "reference")
    v = v.withColumn("fate", fate.otherwise("kept"))
    return v.where("fate = 'kept'").select(F.regexp_replace("chr", "^chr", "").alias("chr"), "pos").distinct(), v.groupBy("fate").agg(F.count("*").alias("n"))


def bed(spark: SparkSession, paths) -> DataFrame:
    """Chr, start (0-based), end (half-open)."""
    return _fields(spark, paths, "chr string, start bigint, end bigint")


def bed_places(intervals: DataFrame) -> DataFrame:
    """Chr, pos (1-based), each once."""
    return intervals.where("start < end").select("chr", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("pos")).distinct()


def whitelist(spark: SparkSession, paths) -> DataFrame:
    """Cb, each once."""
    return spark.read.text(paths).select(F.regexp_extract("value", r"^(\S+)", 1).alias("cb")).where("cb <> ''").distinct()


def csv_table(spark: SparkSession, paths, schema: str, required: list[str]) -> DataFrame:
    """A table with a header line; raises where a required column is missing."""
    found = [c.strip() for c in spark.read.options(header="true", comment="#").csv(paths).columns]
    missing = [c for c in required if c not in found]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    raw = spark.read.options(header="true", comment="#").csv(paths)
    fields = [x.strip().split() for x in schema.split(",")]
    return raw.select(*[(F.col(n).cast(t) if n in found else F.lit(None).cast(t)).alias(n) for n, t in fields])


PROBES = "gene_id string, probe_seq string, probe_id string, included string, region string, gene_name string"
FEATURES = "id string, name string, read string, pattern string, sequence string, feature_type string"


def probes(spark: SparkSession, paths) -> DataFrame:
    """S11."""
    return csv_table(spark, paths, PROBES, ["gene_id", "probe_seq", "probe_id"])


def feature_reference(spark: SparkSession, paths) -> DataFrame:
    """With place (1-based, of the barcode in the pattern) and anchor (what stands before it)."""
    f = csv_table(spark, paths, FEATURES, ["id", "sequence", "pattern"])
    anchor = F.regexp_replace(F.substring_index("pattern", "(BC)", 1), r"^\^|^5P|N", "")
    return f.withColumn("place", F.instr(F.regexp_replace("pattern", r"^\^|^5P", ""), "(BC)")).withColumn("anchor", anchor)


def mex(spark: SparkSession, folder: str, suffix: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries (gene, cb, value), features and barcodes of a matrix folder."""
    lines = numbered_lines(spark, f"{folder}/matrix.mtx{suffix}").where("value not like '%\\%%'").select("line", F.split(F.trim("value"), r"\s+").alias("f"))
    size = lines.agg(F.min("line").alias("first"))
    body = lines.join(F.broadcast(size), F.col("line") > F.col("first"))  # a single number
    entries = body.select(F.col("f")[0].cast("bigint").alias("row"), F.col("f")[1].cast("bigint").alias("column"), F.col("f")[2].cast("double").alias("value"))
    feats = numbered_lines(spark, f"{folder}/features.tsv{suffix}").select((F.col("line") + 1).alias("row"), F.split("value", "\t").alias("f")).select("row", F.col("f")[0].alias("gene"), F.get("f", F.lit(1)).alias("name"), F.get("f", F.lit(2)).alias("type"))
    bcs = numbered_lines(spark, f"{folder}/barcodes.tsv{suffix}").select((F.col("line") + 1).alias("column"), F.col("value").alias("cb"))
    return entries.join(feats.select("row", "gene"), "row").join(bcs, "column").select("gene", "cb", "value"), feats, bcs


def quant_sf(spark: SparkSession, paths) -> DataFrame:
    """Tx, length, eff, tpm, count."""
    return _fields(spark, paths, "tx string, length double, eff double, tpm double, count double", None, header=True)


def tx2gene(spark: SparkSession, paths) -> DataFrame:
    """S15."""
    return _fields(spark, paths, "tx string, gene string", None)


def equivalence_classes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Names (tid, tx) and classes (tids, weights, count) of a class file: two counts, the names, the classes."""
    lines = numbered_lines(spark, path)
    n = int(lines.where("line = 0").first().value)
    names = lines.where(f"line >= 2 and line < {n + 2}").select((F.col("line") - 2).alias("tid"), F.col("value").alias("tx"))
    f = lines.where(f"line >= {n + 2} and value <> ''").select(F.split("value", r"\s+").alias("f")).withColumn("k", F.col("f")[0].cast("int"))
    tids = F.transform(F.slice("f", F.lit(2), F.col("k")), lambda x: x.cast("int"))
    weights = F.when(F.size("f") >= 2 * F.col("k") + 2, F.transform(F.slice("f", F.col("k") + 2, F.col("k")), lambda x: x.cast("double"))).otherwise(F.transform(tids, lambda x: 1.0 / F.col("k")))
    return names, f.select(tids.alias("tids"), weights.alias("weights"), F.element_at("f", -1).cast("double").alias("count"))


def fragment_lengths(spark: SparkSession, path: str) -> DataFrame:
    """F, p from lines of length, count and probability, or of one value each."""
    lines = numbered_lines(spark, path).where("value not like '#%'").select("line", F.split(F.trim("value"), r"\s+").alias("f"))
    f = F.when(F.size("f") >= 3, F.col("f")[0].cast("bigint")).otherwise(F.col("line"))
    return lines.where(F.col("f")[0].try_cast("double").isNotNull()).select(f.alias("f"), F.element_at("f", -1).cast("double").alias("p"))


def multi_config(text: str) -> dict[str, list[dict[str, str]] | dict[str, str]]:
    """The sections of a multi-library config: libraries and features as rows, others as settings."""
    out: dict = {}
    name, header = None, None
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("["):
            name, header = line.strip("[] ,"), None
            out[name] = [] if name in ("libraries", "samples", "feature") and name == "libraries" or name == "samples" else {}
            continue
        cells = [c.strip() for c in line.split(",")]
        if isinstance(out[name], list):
            if header is None:
                header = cells
            else:
                out[name].append(dict(zip(header, cells, strict=False)))
        else:
            out[name][cells[0]] = cells[1] if len(cells) > 1 else ""
    return out


def assignments(spark: SparkSession, paths) -> DataFrame:
    """Cb, sample, tag, status."""
    return _fields(spark, paths, "cb string, sample int, tag string, status string")


def pair_files(names: list[str]) -> dict[str, dict[str, list[str]]]:
    """Files of each sample by read token (R1, R2, R3), in order of name."""
    import re

    out: dict[str, dict[str, list[str]]] = {}
    for n in sorted(names):
        m = re.match(r"(?:.*/)?(.+?)_(R[123])(?:_\d+)?\.f(?:ast)?q(?:\.gz)?$", n)
        if m:
            out.setdefault(m[1], {}).setdefault(m[2], []).append(n)
    return out


def chain(spark: SparkSession, path: str) -> DataFrame:
    """Chr, start, end, shift of each block of a chain file (0-based half-open)."""
    lines = numbered_lines(spark, path).where("value <> ''").select("line", F.split(F.trim("value"), r"\s+").alias("f"))
    head = F.when(F.col("f")[0] == "chain", F.struct(F.col("line").alias("id"), F.col("f")[2].alias("chr"), F.col("f")[5].cast("bigint").alias("s"), F.col("f")[10].cast("bigint").alias("q")))
    w = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)  # a chain file is a small side input
    rows = lines.withColumn("h", F.last(head, True).over(w)).where(F.col("f")[0] != "chain")
    num = lambda i: F.coalesce(F.get("f", F.lit(i)).cast("bigint"), F.lit(0))
    before = Window.partitionBy("h.id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    t = F.coalesce(F.sum(num(0) + num(1)).over(before), F.lit(0)) + F.col("h.s")
    q = F.coalesce(F.sum(num(0) + num(2)).over(before), F.lit(0)) + F.col("h.q")
    return rows.select(F.col("h.chr").alias("chr"), t.alias("start"), (t + num(0)).alias("end"), (q - t).alias("shift"))


def slam_dump(spark: SparkSession, path: str) -> DataFrame:
    """S20."""
    return spark.read.parquet(path)
