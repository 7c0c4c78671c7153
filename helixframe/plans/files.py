"""Queries on readers and writers (S1-S26, K3-K26): the tables' rows are written in a format to the shared folder, and read again;
the SQL is on the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import features, matrix
from helixframe.sources import readers, writers
from helixframe.sources.shared import put_lines, scratch

from .catalog import register
from .roles import CELLS, JUNCTIONS, READS, junctions, reads, table
from .roles import cells as cell_matrix


def _line(*columns, sep: str = "\t") -> Column:
    return F.concat_ws(sep, *[(c if isinstance(c, Column) else F.col(c)).cast("string") for c in columns]).alias("value")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _c(name: str) -> Column:
    return F.col(name).cast("string")


def _back(spark: SparkSession, write: Callable[[str], None], label: str, skip: str | None = None) -> DataFrame:
    """The lines that a writer leaves, without its header."""
    path = scratch(spark, label)
    write(path)
    lines = spark.read.text(path)
    return lines if skip is None else lines.where(~F.col("value").startswith(skip))


# reads
def _fastq(s, d, mate: int = 1) -> DataFrame:
    seq = F.col("umi") if mate == 1 else F.reverse("umi")
    lines = reads(s, d).select(_text("@read", _c("read"), f"/{mate} run:1\n", seq, "\n+\n", F.expr("repeat('I', length(umi))")).alias("value"))
    return readers.fastq(s, put_lines(lines, "fastq"), mate)


register("s1_fastq", lambda s, d: _fastq(s, d).select("name", "seq", "qual", "mate"), f"WITH {READS} SELECT 'read' || read AS name, umi AS seq, 'IIII' AS qual, 1 AS mate FROM reads")
register("s1_mates", lambda s, d: readers.mates(_fastq(s, d), _fastq(s, d, 2)).select("name", "seq", "seq2"), f"WITH {READS} SELECT 'read' || read AS name, umi AS seq, reverse(umi) AS seq2 FROM reads")
register("s2_scan_limit", lambda s, d: reads(s, d).orderBy("read").limit(500).groupBy("gene").agg(F.count("*").alias("n")), f"WITH {READS} SELECT gene, count(*) AS n FROM (SELECT gene FROM reads ORDER BY read LIMIT 500) GROUP BY gene")


def _sam(s, d) -> DataFrame:
    li = table(s, d, "lineitem")
    tags = F.create_map(F.lit("NH"), _c("l_linenumber"), F.lit("CB"), F.col("l_returnflag"), F.lit("GX"), _text("g", _c("l_suppkey")))
    return li.select(_text("r", _c("l_orderkey")).alias("qname"), (F.col("l_orderkey") % 16).alias("flag"), _text("c", _c("l_suppkey")).alias("rname"), F.col("l_partkey").alias("pos"), F.lit(255).alias("mapq"), _text(F.col("l_quantity").cast("int").cast("string"), "M").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.lit("*").alias("seq"), F.lit("*").alias("qual"), tags.alias("tags"))


def _sam_back(s, d) -> DataFrame:
    path = scratch(s, "sam")
    writers.write_sam(_sam(s, d), path)
    return readers.sam(s, path)


register("s3_sam", lambda s, d: _sam_back(s, d).select("qname", "flag", "rname", "pos", "cigar", F.col("tags")["NH"].cast("int").alias("nh")), "SELECT 'r' || l_orderkey AS qname, l_orderkey % 16 AS flag, 'c' || l_suppkey AS rname, l_partkey AS pos, CAST(l_quantity AS INT) || 'M' AS cigar, l_linenumber AS nh FROM lineitem")
register("s26_tags", lambda s, d: _sam_back(s, d).groupBy(F.col("tags")["CB"].alias("cb"), F.col("tags")["GX"].alias("gx")).agg(F.count("*").alias("n")), "SELECT l_returnflag AS cb, 'g' || l_suppkey AS gx, count(*) AS n FROM lineitem GROUP BY ALL")
register("s4_fasta", lambda s, d: readers.fasta(s, put_lines(table(s, d, "part").select(_text(">c", _c("p_partkey"), " made up\n", F.col("p_brand"), "\n", F.col("p_container") if "p_container" in table(s, d, "part").columns else F.col("p_type"), "\n").alias("value")), "fasta")).select("contig", "seq"), "SELECT 'c' || p_partkey AS contig, p_brand || p_type AS seq FROM part")


# annotation
def _gtf(s, d) -> DataFrame:
    k = F.col("p_partkey")
    gene = F.when(k % 5 == 0, "").otherwise(_text('gene_id "', F.col("p_type"), '"; '))
    tr = F.when(k % 7 == 0, "").otherwise(_text('transcript_id "t', _c("p_partkey"), '"; '))
    kind = F.when(k % 3 == 0, 'gene_biotype "coding";').otherwise("")
    lines = table(s, d, "part").select(_line(F.col("p_brand"), F.lit("src"), F.when(F.col("p_size") % 4 == 0, "CDS").otherwise("exon"), k, k + F.col("p_size"), F.lit("."), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-"), F.lit("."), _text(gene, tr, kind)))
    return readers.gtf(s, put_lines(lines, "gtf"))


register("s5_gtf", _gtf, """SELECT p_brand AS chr, p_partkey AS start, p_partkey + p_size AS "end", CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN p_partkey % 5 = 0 THEN 'MissingGeneID' ELSE p_type END AS gene,
  CASE WHEN p_partkey % 7 = 0 THEN 'tr_' || p_brand || '_' || p_partkey || '_' || (p_partkey + p_size) ELSE 't' || p_partkey END AS tr, CASE WHEN p_partkey % 5 = 0 THEN 'MissingGeneID' ELSE p_type END AS gene_name, CASE WHEN p_partkey % 3 = 0 THEN 'coding' ELSE 'MissingGeneType' END AS gene_type FROM part WHERE p_size % 4 <> 0""")
register("s6_junction_list", lambda s, d: readers.junction_list(s, put_lines(junctions(s, d).select(_line("chr", "start", F.col("start") + F.col("gap") - 1, F.when(F.col("motif") % 2 == 0, "+").otherwise("-"))), "junctions")).withColumn("chr", F.col("chr").cast("bigint")), f"""WITH {JUNCTIONS} SELECT chr, start, start + gap - 1 AS "end", CASE WHEN motif % 2 = 0 THEN '+' ELSE '-' END AS strand FROM juncs""")

# variants: reference and alternative base by part, genotype by line
_GT = ["0/0", "0/1", "1|1", "1/0", "0|1", "1/1", "0|0"]


def _vcf_path(s, d) -> str:
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    base = lambda e: F.substring(F.lit("ACGT"), (e % 4).cast("int") + 1, F.lit(1))
    alt = F.when(k % 11 == 0, "AT").otherwise(base(k + 1))
    lines = table(s, d, "lineitem").select(_line(_text("chr", _c("l_suppkey")), k, F.lit("."), base(k), alt, F.lit("."), F.when(F.col("l_returnflag") == "R", "q10").otherwise("PASS"), F.lit("."), F.lit("GT"), _text(F.element_at(F.array(*map(F.lit, _GT)), n), ":9")))
    return put_lines(F.broadcast(s.createDataFrame([("##fileformat=VCFv4.2",)], "value string")).unionByName(lines), "vcf")


_VCF = f"""v AS (SELECT 'chr' || l_suppkey AS chr, l_partkey AS pos, substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1) AS ref, CASE WHEN l_partkey % 11 = 0 THEN 'AT' ELSE substr('ACGT', CAST((l_partkey + 1) % 4 AS INT) + 1, 1) END AS alt,
  CASE WHEN l_returnflag = 'R' THEN 'q10' ELSE 'PASS' END AS filter, replace(list_extract({_GT!r}, l_linenumber), '|', '/') AS gt FROM lineitem)"""
register("s7_vcf_genotypes", lambda s, d: readers.vcf_genotypes(s, _vcf_path(s, d)), f"WITH {_VCF} SELECT chr, pos, CASE WHEN gt[1] = '0' THEN ref ELSE alt END AS a1, CASE WHEN gt[3] = '0' THEN ref ELSE alt END AS a2 FROM v WHERE length(alt) = 1 AND gt <> '0/0'")
register("s7_vcf_hetero", lambda s, d: readers.vcf_genotypes(s, _vcf_path(s, d), True), f"WITH {_VCF} SELECT chr, pos, CASE WHEN gt[1] = '0' THEN ref ELSE alt END AS a1, CASE WHEN gt[3] = '0' THEN ref ELSE alt END AS a2 FROM v WHERE length(alt) = 1 AND gt[1] <> gt[3]")
register("s8_vcf_mask", lambda s, d: readers.vcf_mask(s, _vcf_path(s, d))[0], f"WITH {_VCF} SELECT DISTINCT substr(chr, 4) AS chr, pos FROM v WHERE length(alt) = 1 AND filter = 'PASS' AND gt <> '0/0'")
register("s8_vcf_rejects", lambda s, d: readers.vcf_mask(s, _vcf_path(s, d))[1], f"WITH {_VCF} SELECT CASE WHEN length(alt) > 1 THEN 'not_snv' WHEN filter <> 'PASS' THEN 'filtered' WHEN gt = '0/0' THEN 'reference' ELSE 'kept' END AS fate, count(*) AS n FROM v GROUP BY ALL")
register("s9_bed", lambda s, d: readers.bed_places(readers.bed(s, put_lines(table(s, d, "lineitem").select(_line(_text("c", _c("l_suppkey")), "l_partkey", F.col("l_partkey") + F.col("l_quantity").cast("bigint"))), "bed"))).groupBy("chr").agg(F.count("*").alias("places"), F.sum("pos").alias("at")), "SELECT chr, count(*) AS places, CAST(sum(pos) AS BIGINT) AS at FROM (SELECT DISTINCT 'c' || l_suppkey AS chr, unnest(range(l_partkey + 1, l_partkey + CAST(l_quantity AS BIGINT) + 1)) AS pos FROM lineitem) GROUP BY chr")
register("s10_whitelist", lambda s, d: readers.whitelist(s, put_lines(reads(s, d).select(_line("umi", "gene")), "whitelist")), f"WITH {READS} SELECT DISTINCT umi AS cb FROM reads")


# tables with a header
def _csv(frame: DataFrame, label: str) -> str:
    path = scratch(frame.sparkSession, label)
    frame.write.options(header="true").csv(path)
    return path


register("s11_probes", lambda s, d: readers.probes(s, _csv(table(s, d, "part").select(_text("G", _c("p_partkey")).alias("gene_id"), F.expr("repeat('ACGTA', 10)").alias("probe_seq"), _text("p", _c("p_size")).alias("probe_id"), F.when(F.col("p_size") % 2 == 0, "TRUE").otherwise("FALSE").alias("included"), F.col("p_brand").alias("gene_name")), "probes")), "SELECT 'G' || p_partkey AS gene_id, repeat('ACGTA', 10) AS probe_seq, 'p' || p_size AS probe_id, CASE WHEN p_size % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS included, CAST(NULL AS VARCHAR) AS region, p_brand AS gene_name FROM part")


def _mex_back(s, d) -> DataFrame:
    m, path = cell_matrix(s, d), scratch(s, "mex")
    writers.write_mex(m, m.select("gene"), m.select("cb"), path)
    return readers.mex(s, path)[0].select("gene", F.col("cb").cast("bigint").alias("cb"), F.col("value").cast("bigint").alias("n"))


register("s14_mex", _mex_back, f"WITH {CELLS} SELECT gene, cb, n FROM cells")
_quant = lambda s, d: table(s, d, "supplier").select(F.col("s_name").alias("tx"), (F.col("s_suppkey") * 10).cast("double").alias("length"), (F.col("s_suppkey") * 9.5).alias("eff"), F.col("s_acctbal").alias("tpm"), (F.col("s_nationkey") * 1.25).alias("count"))


def _quant_back(s, d) -> DataFrame:
    path = scratch(s, "quant")
    writers.write_quant(_quant(s, d), path)
    return readers.quant_sf(s, path)


register("s15_quant_sf", _quant_back, "SELECT s_name AS tx, (s_suppkey * 10)::DOUBLE AS length, s_suppkey * 9.5::DOUBLE AS eff, s_acctbal AS tpm, s_nationkey * 1.25::DOUBLE AS count FROM supplier")
register("s15_tx2gene", lambda s, d: readers.tx2gene(s, put_lines(table(s, d, "part").select(_line(_text("t", _c("p_partkey")), "p_type")), "tx2gene")), "SELECT 't' || p_partkey AS tx, p_type AS gene FROM part")
register("k11_quant_lines", lambda s, d: _back(s, lambda p: writers.write_quant(_quant(s, d), p), "quant", "Name"), "SELECT concat_ws(chr(9), s_name, s_suppkey * 10, printf('%.6f', s_suppkey * 9.5::DOUBLE), printf('%.6f', s_acctbal), printf('%.6f', s_nationkey * 1.25::DOUBLE)) AS value FROM supplier")


def _ordered(rows: DataFrame, label: str) -> str:
    """One file of the lines in order of a and b."""
    path = scratch(rows.sparkSession, label)
    rows.orderBy("a", "b").select("value").coalesce(1).write.text(path)
    return path


_tids = lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey") - 1)).alias("tids"), F.count("*").alias("n"))


def _ec(s, d) -> DataFrame:
    sup, cl = table(s, d, "supplier"), _tids(s, d)
    head = sup.agg(F.count("*").cast("string").alias("value")).select(F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("b"), "value").unionByName(cl.agg(F.count("*").cast("string").alias("value")).select(F.lit(1).alias("a"), F.lit(0).cast("bigint").alias("b"), "value"))
    names = sup.select(F.lit(2).alias("a"), F.col("s_suppkey").alias("b"), F.col("s_name").alias("value"))
    body = cl.select(F.lit(3).alias("a"), F.col("l_orderkey").alias("b"), F.concat_ws(" ", F.size("tids").cast("string"), F.array_join(F.col("tids").cast("array<string>"), " "), _c("n")).alias("value"))
    _, classes = readers.equivalence_classes(s, _ordered(head.unionByName(names).unionByName(body), "classes"))
    return classes.select(F.array_join(F.col("tids").cast("array<string>"), ",").alias("tids"), F.size("weights").cast("bigint").alias("k"), F.col("count").cast("bigint").alias("n"))


register("s16_equivalence_classes", _ec, "SELECT string_agg(DISTINCT CAST(l_suppkey - 1 AS VARCHAR), ',' ORDER BY l_suppkey - 1) AS tids, count(DISTINCT l_suppkey) AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey".replace("string_agg(DISTINCT CAST(l_suppkey - 1 AS VARCHAR), ',' ORDER BY l_suppkey - 1)", "array_to_string(list_sort(list(DISTINCT l_suppkey - 1)), ',')"))
register("s17_fragment_lengths", lambda s, d: readers.fragment_lengths(s, put_lines(table(s, d, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("f")).agg(F.count("*").alias("n")).select(_line("f", "n", F.format_string("%.4f", F.col("f") / 1000))), "lengths")), "SELECT CAST(l_quantity AS BIGINT) AS f, CAST(l_quantity AS INT) / 1000.0::DOUBLE AS p FROM lineitem GROUP BY ALL")


def _config(s, d) -> DataFrame:
    names = [r.r_name for r in table(s, d, "region").orderBy("r_regionkey").collect()]  # five rows
    text = "# made up\n[gene-expression]\nreference,/ref\n[libraries]\nfastq_id,fastqs,feature_types\n" + "".join(f"{n},/data/{n},{'Gene Expression' if i % 2 else 'Antibody Capture'}\n" for i, n in enumerate(names))
    return s.createDataFrame([(x["fastq_id"], x["fastqs"], x["feature_types"]) for x in readers.multi_config(text)["libraries"]], "fastq_id string, fastqs string, feature_types string")


register("s18_multi_config", _config, "SELECT r_name AS fastq_id, '/data/' || r_name AS fastqs, CASE WHEN r_regionkey % 2 = 1 THEN 'Gene Expression' ELSE 'Antibody Capture' END AS feature_types FROM region")
register("s19_feature_reference", lambda s, d: readers.feature_reference(s, _csv(table(s, d, "nation").select(_text("f", _c("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.lit("R2").alias("read"), _text("^", F.expr("repeat('N', n_regionkey)"), "ACGT(BC)NNN").alias("pattern"), F.lit("ACGTACGTAC").alias("sequence")), "features")).select("id", "name", "place", "anchor"), "SELECT 'f' || n_nationkey AS id, n_name AS name, n_regionkey + 5 AS place, 'ACGT' AS anchor FROM nation")


def _dump(s, d) -> DataFrame:
    path = scratch(s, "dump")
    writers.write_dump(table(s, d, "lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_suppkey").alias("gene"), (F.col("l_linenumber") % 3).alias("file_idx"), F.col("l_discount").alias("weight")), path)
    return readers.slam_dump(s, path).select("read", "gene", F.col("file_idx").cast("int").alias("file_idx"), "weight")


register("s20_slam_dump", _dump, "SELECT l_orderkey AS read, l_suppkey AS gene, l_linenumber % 3 AS file_idx, l_discount AS weight FROM lineitem")
register("s21_assignments", lambda s, d: readers.assignments(s, put_lines(table(s, d, "customer").select(_line("c_custkey", F.col("c_nationkey") % 4, _text("BC", _c("c_nationkey")), "c_mktsegment")), "assignments")), "SELECT CAST(c_custkey AS VARCHAR) AS cb, c_nationkey % 4 AS sample, 'BC' || c_nationkey AS tag, c_mktsegment AS status FROM customer")


def _pairs(s, d) -> DataFrame:
    names = [r.r_name.replace(" ", "-") for r in table(s, d, "region").collect()]  # five rows
    found = readers.pair_files([f"/data/{n}_R{k}_001.fastq.gz" for n in names for k in (1, 2)] + ["/data/notes.txt"])
    return s.createDataFrame([(a, t, f) for a, by in found.items() for t, fs in by.items() for f in fs], "sample string, token string, file string")


register("s22_paired_files", _pairs, "SELECT replace(r_name, ' ', '-') AS sample, 'R' || k AS token, '/data/' || replace(r_name, ' ', '-') || '_R' || k || '_001.fastq.gz' AS file FROM region, range(1, 3) t(k)")


def _chain(s, d) -> DataFrame:
    n = table(s, d, "nation")
    head = n.groupBy("n_regionkey").agg(F.count("*").alias("k")).select(F.col("n_regionkey").alias("a"), F.lit(-1).alias("b"), _text("chain 1 r", _c("n_regionkey"), " 9999 + 100 9999 q 9999 + ", (F.col("n_regionkey") * 10).cast("string"), " 9999 1").alias("value"))
    body = n.select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"), F.concat_ws(" ", F.length("n_name").cast("string"), _c("n_nationkey"), F.lit("2")).alias("value"))
    return readers.chain(s, _ordered(head.unionByName(body), "chain"))


register("s23_chain", _chain, """WITH b AS (SELECT n_regionkey AS r, length(n_name) AS size, coalesce(sum(length(n_name) + n_nationkey) OVER w, 0) + 100 AS t, coalesce(sum(length(n_name) + 2) OVER w, 0) + n_regionkey * 10 AS q FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT 'r' || r AS chr, CAST(t AS BIGINT) AS start, CAST(t + size AS BIGINT) AS "end", CAST(q - t AS BIGINT) AS shift FROM b""")

# writers
register("k3_sorted_lines", lambda s, d: writers.sam_lines(writers.coordinate_sorted(_sam(s, d), 4)).select(F.substring_index("value", "\t", 4).alias("value")), "SELECT concat_ws(chr(9), 'r' || l_orderkey, l_orderkey % 16, 'c' || l_suppkey, l_partkey) AS value FROM lineitem")
_JROWS = f"{JUNCTIONS}, j AS (SELECT chr, start, gap, motif, count(*) FILTER (uniq) AS u, count(*) FILTER (NOT uniq) AS m, max(overhang) AS o FROM juncs GROUP BY ALL)"
_jrows = lambda s, d: junctions(s, d).groupBy("chr", "start", "gap", "motif").agg(F.count(F.when(F.col("unique"), 1)).alias("n_unique"), F.count(F.when(~F.col("unique"), 1)).alias("n_multi"), F.max("overhang").alias("overhang")).withColumn("annot", F.col("start") % 2 == 0)
register("k4_junction_lines", lambda s, d: _back(s, lambda p: writers.write_junctions(_jrows(s, d), p), "sj"), f"WITH {_JROWS} SELECT concat_ws(chr(9), chr, start, start + gap - 1, CASE WHEN motif = 0 THEN 0 ELSE 2 - motif % 2 END, motif, CASE WHEN start % 2 = 0 THEN 1 ELSE 0 END, u, m, o) AS value FROM j")
register("k5_chimeric_lines", lambda s, d: _back(s, lambda p: writers.write_chimeric(table(s, d, "lineitem").select(_text("c", _c("l_suppkey")).alias("chr1"), F.col("l_partkey").alias("pos1"), F.col("l_linestatus").alias("strand1"), F.col("l_orderkey").alias("read")), p), "chimeric", "chr1"), "SELECT concat_ws(chr(9), 'c' || l_suppkey, l_partkey, l_linestatus, l_orderkey) AS value FROM lineitem")


def _gene_counts(s, d) -> DataFrame:
    r = reads(s, d)
    at = lambda c: F.count(F.when(c, 1))
    genes = r.groupBy("gene").agg(F.count("*").alias("unstranded"), at(F.col("cb") % 2 == 0).alias("forward"), at(F.col("cb") % 2 == 1).alias("reverse"))
    return genes.unionByName(r.where("value < 5").agg(F.count("*").alias("unstranded"), at(F.col("cb") % 2 == 0).alias("forward"), at(F.col("cb") % 2 == 1).alias("reverse")).withColumn("gene", F.lit("N_noFeature")))


register("k6_gene_count_lines", lambda s, d: _back(s, lambda p: writers.write_gene_counts(_gene_counts(s, d), p), "genes"), f"WITH {READS}, a AS (SELECT gene, count(*) AS u, count(*) FILTER (cb % 2 = 0) AS f, count(*) FILTER (cb % 2 = 1) AS r FROM reads GROUP BY gene UNION ALL SELECT 'N_noFeature', count(*), count(*) FILTER (cb % 2 = 0), count(*) FILTER (cb % 2 = 1) FROM reads WHERE value < 5) SELECT concat_ws(chr(9), gene, u, f, r) AS value FROM a")
register("k7_bedgraph_lines", lambda s, d: _back(s, lambda p: writers.write_bedgraph(table(s, d, "lineitem").groupBy(_text("c", _c("l_suppkey")).alias("chr"), F.col("l_partkey").alias("start")).agg(F.max(F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("end"), F.sum(F.col("l_linenumber") * F.lit(0.25)).alias("value")), p), "bedgraph"), "SELECT concat_ws(chr(9), 'c' || l_suppkey, l_partkey - 1, max(l_partkey + CAST(l_quantity AS BIGINT)) - 1, printf('%.5f', sum(l_linenumber * 0.25::DOUBLE))) AS value FROM lineitem GROUP BY l_suppkey, l_partkey")
register("k12_conversion_lines", lambda s, d: _back(s, lambda p: writers.write_conversions(table(s, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("symbol"), F.col("p_size").alias("reads"), (F.col("p_size") % 7).alias("conversions"), (F.col("p_size") * 20).alias("coverage"), F.lit(0.5).alias("ntr"), F.lit(0.25).alias("sigma"), F.lit(-1.5).alias("log_likelihood")), p), "conversions", "Gene"), "SELECT concat_ws(chr(9), p_partkey, p_brand, p_size, p_size % 7, p_size * 20, '0.5', '0.5', '0.25', '-1.5') AS value FROM part")
register("k13_transition_lines", lambda s, d: _back(s, lambda p: writers.write_report(table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), p), "transitions", "l_returnflag"), "SELECT concat_ws(chr(9), l_returnflag, l_linestatus, count(*)) AS value FROM lineitem GROUP BY l_returnflag, l_linestatus")
register("k15_mask_lines", lambda s, d: _back(s, lambda p: writers.write_mask(table(s, d, "lineitem").select(_text("c", _c("l_suppkey")).alias("chr"), F.col("l_partkey").alias("pos")).distinct(), p), "mask"), "SELECT DISTINCT concat_ws(chr(9), 'c' || l_suppkey, l_partkey - 1, l_partkey) AS value FROM lineitem")
register("k16_weights", lambda s, d: _dump(s, d).groupBy("file_idx").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 2).alias("weight")), "SELECT l_linenumber % 3 AS file_idx, count(*) AS n, round(sum(l_discount), 2) AS weight FROM lineitem GROUP BY ALL")
register("k17_call_lines", lambda s, d: _back(s, lambda p: writers.write_calls(features.calls_per_cell(cell_matrix(s, d).where("n > 2").select(F.regexp_replace("gene", " ", "_").alias("feature"), "cb", "n")), p), "calls", "cell_barcode"), f"WITH {CELLS}, x AS (SELECT replace(gene, ' ', '_') AS g, cb, n FROM cells WHERE n > 2) SELECT concat_ws(',', cb, count(*), string_agg(g, '|' ORDER BY g), string_agg(CAST(n AS VARCHAR), '|' ORDER BY g)) AS value FROM x GROUP BY cb")
_cells_line = lambda s, d: _back(s, lambda p: writers.write_metrics(matrix.cell_summary(matrix.per_cell(cell_matrix(s, d))), p), "metrics")
register("k25_metric_lines", _cells_line, f"WITH {CELLS}, c AS (SELECT cb, CAST(sum(n) AS BIGINT) AS umis, count(*) AS genes FROM cells GROUP BY cb), one AS (SELECT count(*) AS cells, CAST(sum(umis) AS BIGINT) // count(*) AS mean_umis, list_sort(list(umis))[count(*) // 2 + 1] AS median_umis, CAST(sum(genes) AS BIGINT) // count(*) AS mean_genes, list_sort(list(genes))[count(*) // 2 + 1] AS median_genes FROM c) SELECT name || ',' || value AS value FROM (UNPIVOT one ON COLUMNS(*)) u(name, value)")
register("k22_unmapped_fastq", lambda s, d: (lambda p: (writers.write_fastq(reads(s, d).where("gene = 'error'").select(_text("read", _c("read")).alias("name"), F.col("umi").alias("seq"), F.lit("IIII").alias("qual"), (F.col("cb") % 2).alias("mate")), p, "mate"), readers.fastq(s, f"{p}/*/*"))[1])(scratch(s, "unmapped")).select("name", "seq"), f"WITH {READS} SELECT 'read' || read AS name, umi AS seq FROM reads WHERE gene = 'error'")
register("k19_split_fastq", lambda s, d: (lambda p: (writers.write_fastq(reads(s, d).select(_text("read", _c("read")).alias("name"), F.col("umi").alias("seq"), F.lit("IIII").alias("qual"), (F.col("cb") % 3).alias("y")), p, "y"), readers.fastq(s, f"{p}/y=1/*"))[1])(scratch(s, "split")).select("name", "seq"), f"WITH {READS} SELECT 'read' || read AS name, umi AS seq FROM reads WHERE cb % 3 = 1")
register("k24_tag_lines", lambda s, d: _back(s, lambda p: writers.write_tag_table(reads(s, d).select("read", "cb", F.col("umi").alias("ub"), F.when(F.col("value") > 10, "ok").otherwise("low").alias("status")), p), "tags"), f"WITH {READS} SELECT concat_ws(chr(9), read, cb, umi, CASE WHEN value > 10 THEN 'ok' ELSE 'low' END) AS value FROM reads")
register("k26_stage_lines", lambda s, d: _back(s, lambda p: writers.write_report(cell_matrix(s, d).groupBy("cb").agg(F.sum("n").alias("umis"), F.count("*").alias("genes")), p), "stages", "cb"), f"WITH {CELLS} SELECT concat_ws(chr(9), cb, sum(n), count(*)) AS value FROM cells GROUP BY cb")
register("k21_histogram_json", lambda s, d: writers.report_json(features.umi_histogram(cell_matrix(s, d).withColumnRenamed("gene", "feature")).groupBy("n").agg(F.sum("cells").alias("cells")), kind="umis").select(F.explode(F.from_json("value", "struct<kind:string,positions:array<struct<n:bigint,cells:bigint>>>")["positions"]).alias("x")).select("x.*"), f"WITH {CELLS} SELECT n, count(*) AS cells FROM cells GROUP BY n")


def _joint(s, d) -> DataFrame:
    genes = cell_matrix(s, d)
    guides = genes.groupBy("cb").agg(F.sum("n").alias("n")).select(F.lit("guide").alias("gene"), "cb", "n")
    both, _ = matrix.append_features(genes, guides)
    path = scratch(s, "joint")
    suffixed = both.withColumn("cb", _text(_c("cb"), "-1"))
    writers.write_mex(suffixed, suffixed.select("gene"), suffixed.select("cb"), path)
    return readers.mex(s, path)[0].select("gene", "cb", F.col("value").cast("bigint").alias("n"))


register("k20_joint_matrix", _joint, f"WITH {CELLS} SELECT gene, cb || '-1' AS cb, n FROM cells UNION ALL SELECT 'guide', cb || '-1', CAST(sum(n) AS BIGINT) FROM cells GROUP BY cb")
