"""Queries on output rows, trimming and text parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators import matrix, tables, trimming
from helixframe.sources import writers

from .catalog import register
from .roles import ALIGNS, CELLS, aligns, table
from .roles import cells as cell_matrix


def _sam(s, d):
    li = table(s, d, "lineitem")
    tags = F.create_map(F.lit("NH"), F.col("l_linenumber").cast("string"), F.lit("CB"), F.col("l_returnflag"))
    return li.select(F.concat(F.lit("r"), "l_orderkey").alias("qname"), (F.col("l_orderkey") % 16).alias("flag"), F.concat(F.lit("c"), "l_suppkey").alias("rname"), F.col("l_partkey").alias("pos"), F.lit(255).alias("mapq"), F.concat(F.col("l_quantity").cast("int"), F.lit("M")).alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.lit("*").alias("seq"), F.lit("*").alias("qual"), tags.alias("tags"))


register("k1_sam_lines", lambda s, d: writers.sam_lines(_sam(s, d)), "SELECT concat_ws(chr(9), 'r' || l_orderkey, l_orderkey % 16, 'c' || l_suppkey, l_partkey, 255, CAST(l_quantity AS INT) || 'M', '*', 0, 0, '*', '*', 'CB:Z:' || l_returnflag, 'NH:i:' || l_linenumber) AS value FROM lineitem")
register("k2_coordinate_sorted", lambda s, d: writers.coordinate_sorted(_sam(s, d), 4).select("qname", "rname", "pos"), "SELECT 'r' || l_orderkey AS qname, 'c' || l_suppkey AS rname, l_partkey AS pos FROM lineitem")
register("k8_matrix_entries", lambda s, d: matrix.reindex(matrix.reindex(cell_matrix(s, d), "gene", "row"), "cb", "column").select("row", "column", "n"), f'WITH {CELLS} SELECT dense_rank() OVER (ORDER BY gene) AS row, dense_rank() OVER (ORDER BY cb) AS "column", n FROM cells')
register("k10_run_summary", lambda s, d: writers.metric_rows(aligns(s, d).agg(F.count("*").alias("blocks"), F.countDistinct("read").alias("reads"))), f"WITH {ALIGNS} SELECT 'blocks' AS metric, CAST(count(*) AS VARCHAR) AS value FROM aligns UNION ALL SELECT 'reads', CAST(count(DISTINCT read) AS VARCHAR) FROM aligns")
register("k14_report_json", lambda s, d: writers.report_json(table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("position")).agg(F.count("*").alias("cov"), F.sum(F.col("l_quantity").cast("bigint")).alias("mm")), version="1").select(F.get_json_object("value", "$.version").alias("version"), F.explode(F.from_json(F.get_json_object("value", "$.positions"), "array<struct<position:int,cov:bigint,mm:bigint>>")).alias("x")).select("version", "x.*"), "SELECT '1' AS version, l_linenumber AS position, count(*) AS cov, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS mm FROM lineitem GROUP BY ALL")
register("k19_fastq_lines", lambda s, d: writers.fastq_lines(table(s, d, "supplier").select(F.col("s_name").alias("name"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"), (F.col("s_nationkey") % 2).alias("y")), "y"), "SELECT s_nationkey % 2 AS y, '@' || s_name || chr(10) || 'ACGT' || chr(10) || '+' || chr(10) || 'IIII' AS value FROM supplier")
register("k23_overlap_tags", lambda s, d: writers.overlap_tags(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("read")).agg(F.sort_array(F.collect_set(F.concat(F.lit("g"), F.col("l_suppkey") % 5))).alias("genes"), F.when(F.max("l_suppkey") > 80, "exonic_antisense").when(F.max("l_suppkey") > 40, "over_half").when(F.max("l_suppkey") > 20, "intronic").otherwise("intergenic").alias("class"))), "SELECT l_orderkey AS read, string_agg(DISTINCT 'g' || (l_suppkey % 5), ',' ORDER BY 'g' || (l_suppkey % 5)) AS ZG, CASE WHEN max(l_suppkey) > 40 THEN 'exonic' WHEN max(l_suppkey) > 20 THEN 'intronic' ELSE 'none' END AS ZX FROM lineitem GROUP BY l_orderkey")
_texts = lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("read"), F.translate("text", "eatsn", "ACGTA").alias("seq"))
register("p3_adapter_place", lambda s, d: _texts(s, d).select("read", trimming.find_adapter("AG", 0)("seq").alias("place")), "SELECT doc_id AS read, instr(translate(text, 'eatsn', 'ACGTA'), 'AG') - 1 AS place FROM documents")
register("p6_adapter_trim", lambda s, d: _texts(s, d).select("read", trimming.adapter_cuts("AGATCGGAAGAGC")("seq").alias("kept")))
register("p7_adapter_trim_32", lambda s, d: _texts(s, d).select("read", trimming.adapter_cuts("AGATCGGAAGAGC", parity="3.2")("seq").alias("kept")))
register("p8_trim_pairs", lambda s, d: trimming.trim_pairs(_texts(s, d).select(F.col("read").cast("string").alias("name"), "seq", F.expr("repeat('I', length(seq))").alias("qual"), F.reverse("seq").alias("seq2"), F.expr("repeat('I', length(seq) - 10) || repeat('#', least(length(seq), 10))").alias("qual2")), "AGATCGGAAGAGC").select("name", F.length("seq").alias("n1"), F.length("seq2").alias("n2")))
register("p13_mismatch_tags", lambda s, d: trimming.mismatches(table(s, d, "nation").select("n_name", F.rpad("n_name", 12, "x").alias("read_bases"), F.rpad(F.lit("ARGENTINA"), 12, "x").alias("ref_bases"))).select("n_name", "nm", "md"))
register("p21_contig_names", lambda s, d: table(s, d, "supplier").select("s_suppkey", tables.unversioned(F.concat(F.lit("ENSG"), "s_suppkey", F.lit("."), "s_nationkey")).alias("gene")), "SELECT s_suppkey, 'ENSG' || s_suppkey AS gene FROM supplier")
register("p22_transcript_sequence", lambda s, d: tables.transcript_sequence(table(s, d, "lineitem").select(F.col("l_orderkey").alias("tr"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("start"), F.substring(F.lit("ACGTACGTAC"), (F.col("l_partkey") % 7).cast("int") + 1, F.lit(3)).alias("seq"))), "SELECT l_orderkey AS tr, string_agg(substr('ACGTACGTAC', CAST(l_partkey % 7 AS INT) + 1, 3), '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem GROUP BY l_orderkey")
register("p23_super_contigs", lambda s, d: tables.super_contigs(table(s, d, "nation").select(F.col("n_nationkey").alias("contig"), F.length("n_name").alias("length"), "n_regionkey"), "n_regionkey").select(F.col("contig").alias("n_nationkey"), "shift"), "SELECT n_nationkey, CAST(coalesce(sum(length(n_name) + 60) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM nation")
register("x4_phred", lambda s, d: table(s, d, "nation").select("n_nationkey", (F.floor(S.error_probability(F.substring("n_name", 1, 1)) * 1e6 + 0.5) / 1e6).alias("p")), "SELECT n_nationkey, floor(pow(10::DOUBLE, -(ascii(n_name[1]) - 33) / 10.0::DOUBLE) * 1e6 + 0.5) / 1e6 AS p FROM nation")
register("x5_log_factorial", lambda s, d: table(s, d, "part").select("p_partkey", (F.floor(S.log_factorial(F.col("p_size")) * 1e6 + 0.5) / 1e6).alias("lf")), "SELECT p_partkey, floor(lgamma(p_size + 1) * 1e6 + 0.5) / 1e6 AS lf FROM part")
register("x9_hashes", lambda s, d: table(s, d, "nation").select("n_nationkey", F.md5("n_name").alias("md5"), F.sha2("n_name", 256).alias("sha")), "SELECT n_nationkey, md5(n_name) AS md5, sha256(n_name) AS sha FROM nation")
register("x11_json", lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")), "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events")
register("x13_percentile", lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.9)).alias("p90")), "SELECT l_returnflag, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
register("x12_arrays", lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("q")).select("l_orderkey", F.array_max("q").alias("top"), F.exists("q", lambda x: x > 45).alias("large")), "SELECT l_orderkey, max(l_quantity) AS top, max(l_quantity) > 45 AS large FROM lineitem GROUP BY l_orderkey")
