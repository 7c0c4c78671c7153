"""Queries on what completes an operator: presets, hashes, occupancy, pruning, whole tables, requantification."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators import barcodes, cells, features, quant, slam, tables, trimming
from helixframe.sources import writers

from .analytics import _BASES, _TOT, _bases, _q, _r, _tot
from .catalog import register
from .files import _sam
from .roles import ALIGNS, JUNCTIONS, READS, aligns, junctions, reads, table
from .workflows import _model_bases

# K1: presets
_PRESET = lambda flag, tags: f"SELECT concat_ws(chr(9), 'r' || l_orderkey, {flag}, 'c' || l_suppkey, l_partkey, CASE WHEN l_linenumber >= 5 THEN 0 WHEN l_linenumber >= 3 THEN 1 WHEN l_linenumber = 2 THEN 3 ELSE 60 END, CAST(l_quantity AS INT) || 'M', '*', 0, 0, '*', '*'{tags}) AS value FROM lineitem"
register("k1_preset_standard", lambda s, d: writers.sam_lines(writers.with_preset(_sam(s, d), "standard", 4, 1023, 60)), _PRESET("((l_orderkey % 16) | 4) & 1023", ", 'NH:i:' || l_linenumber"))
register("k1_preset_none", lambda s, d: writers.sam_lines(writers.with_preset(_sam(s, d), "none", 0, 7, 60)), _PRESET("(l_orderkey % 16) & 7", ""))

# Name hashes
_FOLD = lambda start, body: f"list_reduce(list_prepend({start}::HUGEINT, list_transform(range(1, length(n_name) + 1), lambda i: ascii(n_name[i])::HUGEINT)), lambda h, c: {body})"
register("x9_name_hashes", lambda s, d: table(s, d, "nation").select("n_nationkey", S.fnv1a(F.col("n_name")).alias("fnv"), S.djb2(F.col("n_name")).alias("djb")), f"SELECT n_nationkey, lpad(lower(hex({_FOLD(0xCBF29CE484222325, '(xor(h, c) * 1099511628211) % 18446744073709551616')}::UBIGINT)), 16, '0') AS fnv, lpad(lower(hex({_FOLD(5381, '(h * 33 + c) % 18446744073709551616')}::UBIGINT)), 16, '0') AS djb FROM nation")

# occupancy
_gems = lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("gem"), F.col("o_orderpriority").alias("tag")).distinct()
_GEMS = "g AS (SELECT DISTINCT o_custkey AS gem, o_orderpriority AS tag FROM orders)"
register("m18_tags_per_gem", lambda s, d: cells.tags_per_gem(_gems(s, d), 5000, 0.5).select(_r("rate")), f"WITH {_GEMS} SELECT {_q('count(*) / greatest(count(DISTINCT gem), 2500)::DOUBLE')} AS rate FROM g")
register("m18_hash_occupancy", lambda s, d: cells.hash_occupancy(table(s, d, "customer").select(F.col("c_name").alias("cb")), 40, 0.9, 20), "WITH c AS (SELECT c_name AS cb, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(c_name) + 1), lambda i: ascii(c_name[i])::BIGINT)), lambda h, c: (h * 31 + c) % 40) AS p FROM customer), k AS (SELECT p, count(*) AS k FROM c GROUP BY p) SELECT cb FROM c JOIN k USING (p) WHERE k <= (SELECT quantile_cont(k, 0.9) FROM k)")
register("k18_sample_table", lambda s, d: cells.sample_table(_stages(s, d).drop("n"), _stages(s, d).select("sample", "cb", "n"), s.createDataFrame([(0, 40), (1, 50), (2, 60)], "sample bigint, expected bigint")), f"""WITH {_TOT}, st AS (SELECT cb % 3 AS sample, cb, n, n >= 10 AS r, n >= 50 AS si, n BETWEEN 20 AND 49 AS t, n >= 30 AS p, n > 70 AS c FROM tot), e(sample, "Expected") AS (VALUES (0, 40), (1, 50), (2, 60)),
  per AS (SELECT CAST(sample AS VARCHAR) AS "Sample", any_value("Expected") AS "Expected", count(*) FILTER (r) AS "Retain", count(*) FILTER (si) AS "Simple_ED", count(*) FILTER (t) AS "Tail_Tested", count(*) FILTER (p) AS "ED_Pass", count(*) FILTER (p AND c) AS "Occ_Rem", count(*) FILTER (p AND NOT c) AS "Final", CAST(coalesce(sum(n) FILTER (p AND NOT c), 0) AS BIGINT) AS "Total_UMIs" FROM st JOIN e USING (sample) GROUP BY sample)
  SELECT * FROM per UNION ALL SELECT 'TOTAL', {", ".join(f'CAST(sum("{c}") AS BIGINT)' for c in ("Expected", "Retain", "Simple_ED", "Tail_Tested", "ED_Pass", "Occ_Rem", "Final", "Total_UMIs"))} FROM per""")


def _stages(s, d):
    n = F.col("n")
    return _tot(s, d).select((F.col("cb") % 3).alias("sample"), "cb", "n", (n >= 10).alias("retained"), (n >= 50).alias("simple"), n.between(20, 49).alias("tested"), (n >= 30).alias("passed"), (n > 70).alias("crowded"))


# Pruning; weights by the supplier. Halves are rounded to even, as SQL's printf does: format_string would round 5/64 up
_weighted = lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("tids")).groupBy("tids").agg(F.count("*").alias("count")).withColumn("weights", F.transform("tids", lambda t: (t % 7 + 1) / 8.0))
_WEIGHTED = "cl AS (SELECT tids, count(*) AS n FROM (SELECT list_sort(list(DISTINCT l_suppkey)) AS tids FROM lineitem GROUP BY l_orderkey) GROUP BY tids), el AS (SELECT tids AS ts, n, unnest(tids) AS t FROM cl), w AS (SELECT *, (t % 7 + 1) / 8.0::DOUBLE AS w FROM el)"
_out = lambda c: c.select(F.array_join(F.col("tids").cast("array<string>"), ",").alias("tids"), F.array_join(F.transform("weights", lambda w: F.call_function("format_number", w, F.lit("0.00000"))), ",").alias("weights"), "count").groupBy("tids", "weights").agg(F.sum("count").alias("count"))
_SHOWN = "SELECT tids, weights, CAST(sum(n) AS BIGINT) AS count FROM (SELECT string_agg(t, ',' ORDER BY t) AS tids, string_agg(printf('%.5f', w / total), ',' ORDER BY t) AS weights, n FROM (SELECT *, sum(w) OVER (PARTITION BY ts) AS total FROM k) GROUP BY ts, n) GROUP BY ALL"
register("m11_prune_local", lambda s, d: _out(quant.prune_local(_weighted(s, d), 0.4)), f"WITH {_WEIGHTED}, k AS (SELECT * FROM w WHERE w >= 0.4::DOUBLE) {_SHOWN}")
register("m11_prune_abundance", lambda s, d: _out(quant.prune_abundance(_weighted(s, d), 300.0)), f"WITH {_WEIGHTED}, k AS (SELECT * FROM w WHERE t NOT IN (SELECT t FROM w GROUP BY t HAVING sum(n * w) < 300)) {_SHOWN}")

# P2, P3, P5, P21
_tagged = lambda s, d: reads(s, d).select("read", F.concat(F.expr("repeat('T', CAST(read % 4 AS INT))"), F.lit("GGACG"), "umi", F.lit("AAAA")).alias("seq"))
register("p2_anchored_barcode", lambda s, d: _tagged(s, d).withColumn("at", trimming.find_adapter("GGACG", 0)("seq")).select("read", trimming.anchored_slice(F.col("seq"), F.col("at"), 5, 3, 0, 4).alias("cb"), trimming.anchored_slice(F.col("seq"), F.col("at"), 5, 1, -4, 4).alias("end")), f"WITH {READS} SELECT read, umi AS cb, 'AAAA' AS \"end\" FROM reads")
_tails = lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("CCCCC"), F.expr("repeat('A', CAST(l_quantity AS INT))"), F.when(F.col("l_linenumber") == 2, "G").otherwise(""), F.expr("repeat('A', CAST(l_suppkey % 9 AS INT))")).alias("seq"))
register(
    "p3_poly_tail",
    lambda s, d: _tails(s, d).select("l_orderkey", "l_linenumber", S.poly_tail(F.col("seq")).alias("tail")),
    """WITH q AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS a, l_linenumber = 2 AS g, CAST(l_suppkey % 9 AS INT) AS b FROM lineitem)
      SELECT l_orderkey, l_linenumber, CAST(CASE WHEN NOT g THEN CASE WHEN a + b >= 20 THEN a + b ELSE 0 END WHEN (b + a - 2) * 10 >= (b + a + 1) * 7 AND b + a - 2 >= 20 THEN a + b + 1 ELSE 0 END AS INT) AS tail FROM q""",
)
register("p21_contig_rules", lambda s, d: table(s, d, "orders").select("o_orderkey", tables.contig_name(F.concat(F.lit(">"), F.element_at(F.array(*map(F.lit, ["", "X", "MT", "KI27"])), (F.col("o_orderkey") % 4 + 1).cast("int")), F.col("o_custkey"), F.lit(" made up"))).alias("contig")), "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'chr' || o_custkey WHEN 1 THEN 'chrX' WHEN 2 THEN 'chrM' ELSE 'KI27' || o_custkey END AS contig FROM orders")

# J9 at distance 2
_LIST = [("f1", "ACGTAC"), ("f2", "CATGAC"), ("f3", "TTTTTT")]
register("j9_two_mismatches", lambda s, d: features.match_features(reads(s, d).select("read", F.concat("umi", F.lit("AC")).alias("seq")), s.createDataFrame(_LIST, "feature string, sequence string"), [1], 6, 2), f"WITH {READS}, f(feature, q) AS (VALUES {', '.join(map(str, _LIST))}), h AS (SELECT read, feature, hamming(umi || 'AC', q) AS distance FROM reads, f WHERE hamming(umi || 'AC', q) <= 2), b AS (SELECT *, count(*) OVER (PARTITION BY read) AS n FROM (SELECT * FROM h QUALIFY distance = min(distance) OVER (PARTITION BY read))) SELECT read, feature, CAST(distance AS INT) AS distance FROM b WHERE n = 1")

# A run's metrics
_KINDS = ["unique", "multi", "too_many", "mismatches", "short", "other"]
_run_reads = lambda s, d: table(s, d, "lineitem").select(F.col("l_quantity").cast("int").alias("length"), F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_suppkey") % 6 + 1).cast("int")).alias("kind"), (F.col("l_quantity").cast("int") - F.col("l_linenumber")).alias("mapped"), (F.col("l_partkey") % 3).alias("mismatches"), (F.col("l_partkey") % 2).alias("deletions"), (F.col("l_partkey") % 2 * 2).alias("deleted"), (F.col("l_linenumber") % 2).alias("insertions"), (F.col("l_linenumber") % 2 * 3).alias("inserted"), (F.col("l_returnflag") == "R").alias("chimeric"))
_splices = lambda s, d: junctions(s, d).groupBy("motif", (F.col("start") % 2 == 0).alias("annotated")).agg(F.count("*").alias("n"))


def _log_sql() -> str:
    u = "FILTER (l_suppkey % 6 = 0)"
    cols = ["count(*)::DOUBLE AS input_reads", "floor(sum(q) / count(*))::DOUBLE AS mean_length", f"(count(*) {u})::DOUBLE AS \"unique\"", f"100.0::DOUBLE * (count(*) {u}) / count(*) AS unique_percent", f"sum(q - l_linenumber) {u} / (count(*) {u})::DOUBLE AS mean_mapped_length"]
    m = f"sum(q - l_linenumber) {u}"
    cols += [f"100.0::DOUBLE * (sum({e}) {u}) / ({m}) AS {n}" for e, n in (("l_partkey % 3", "mismatch_percent"), ("l_partkey % 2 * 2", "deletion_percent"), ("l_linenumber % 2 * 3", "insertion_percent"))] + ["2.0::DOUBLE AS deletion_length", "3.0::DOUBLE AS insertion_length"]
    for i, k in enumerate(_KINDS[1:], 1):
        cols += [f"(count(*) FILTER (l_suppkey % 6 = {i}))::DOUBLE AS {k}_reads", f"100.0::DOUBLE * (count(*) FILTER (l_suppkey % 6 = {i})) / count(*) AS {k}_percent"]
    cols += ["(count(*) FILTER (l_returnflag = 'R'))::DOUBLE AS chimeric_reads", "100.0::DOUBLE * (count(*) FILTER (l_returnflag = 'R')) / count(*) AS chimeric_percent"]
    j = [("true", "splices"), ("start % 2 = 0", "splices_annotated"), ("motif IN (1, 2)", "splices_gt_ag"), ("motif IN (3, 4)", "splices_gc_ag"), ("motif IN (5, 6)", "splices_at_ac"), ("motif = 0", "splices_other")]
    spl = ", ".join(f"(count(*) FILTER ({c}))::DOUBLE AS {n}" for c, n in j)
    return f"WITH {JUNCTIONS}, l AS (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem), a AS (SELECT {', '.join(cols)} FROM l), b AS (SELECT {spl} FROM juncs), one AS (SELECT * FROM a, b) SELECT name AS metric, round(value, 4) AS value FROM (UNPIVOT one ON COLUMNS(*)) u(name, value)"


register("k10_run_log", lambda s, d: writers.metric_rows(tables.run_log(_run_reads(s, d), _splices(s, d))).select("metric", F.round(F.col("value").cast("double"), 4).alias("value")), _log_sql())
register("a25_run_rates", lambda s, d: tables.run_log(_run_reads(s, d), _splices(s, d)).select("input_reads", F.round("unique_percent", 4).alias("unique_percent"), F.round("mismatch_percent", 4).alias("mismatch_percent")), "SELECT count(*) AS input_reads, round(100.0::DOUBLE * (count(*) FILTER (l_suppkey % 6 = 0)) / count(*), 4) AS unique_percent, round(100.0::DOUBLE * (sum(l_partkey % 3) FILTER (l_suppkey % 6 = 0)) / (sum(CAST(l_quantity AS INT) - l_linenumber) FILTER (l_suppkey % 6 = 0)), 4) AS mismatch_percent FROM lineitem")

# Errors of alignments under the model
_ST = """l AS (SELECT l_orderkey, l_linenumber, x.p AS l_partkey, x.s AS l_suppkey FROM (SELECT l_orderkey, l_linenumber, min(struct_pack(p := l_partkey, s := l_suppkey)) AS x FROM lineitem GROUP BY ALL)),
  b AS (SELECT l_orderkey AS read, l_linenumber AS place, least(1, l_linenumber * 2 // 8) AS bin, (l_partkey % 4) * 10 AS hit, (l_partkey % 4) * 9 + CASE WHEN l_suppkey % 10 > 0 THEN l_partkey % 4 ELSE (l_partkey + 1) % 4 END AS state FROM l),
  t AS (SELECT read, bin, lag(state) OVER w AS prior, state, lag(hit) OVER w AS hit_prior, hit FROM b WINDOW w AS (PARTITION BY read ORDER BY place)), n AS (SELECT bin, prior, state, count(*) AS n FROM t WHERE prior IS NOT NULL GROUP BY ALL),
  m AS (SELECT bin, prior, state, ln((n + 1.0::DOUBLE) / sum(n + 1.0::DOUBLE) OVER (PARTITION BY bin, prior)) AS logp FROM n)"""
register("m10_error_likelihood", lambda s, d: quant.error_likelihood(_model_bases(s, d), quant.error_model(_model_bases(s, d), 2), 2).select("read", F.round("err", 4).alias("err")), f"WITH {_ST} SELECT t.read, round(coalesce(sum(a.logp), 0) - coalesce(sum(z.logp), 0), 4) AS err FROM t LEFT JOIN m a ON a.bin = t.bin AND a.prior = t.prior AND a.state = t.state LEFT JOIN m z ON z.bin = t.bin AND z.prior = t.hit_prior AND z.state = t.hit WHERE t.prior IS NOT NULL GROUP BY t.read")


# Rates again, with other trims and a mask
def _again(s, d):
    b = _bases(s, d).select("read", F.concat(F.lit("g"), F.col("chr") % 5).alias("gene"), "strand", "ref", "alt", F.col("at").alias("pos"), F.lit(9).alias("length"), "chr", F.col("pos").alias("gpos"), F.lit(1.0).alias("weight"))
    mask = table(s, d, "supplier").select(F.col("s_suppkey").alias("chr"), (F.col("s_suppkey") * 3 + 1).alias("pos"))
    return slam.requantify(b, 2, 1, mask).select("gene", F.col("reads").cast("bigint").alias("reads"))


register(
    "z3_requantify",
    _again,
    f"""WITH {_BASES}, x AS (SELECT *, 'g' || (chr % 5) AS gene FROM b), bad AS (SELECT DISTINCT read FROM x JOIN supplier ON s_suppkey = chr AND s_suppkey * 3 + 1 = pos), k AS (SELECT DISTINCT read FROM x WHERE ln >= 2 AND ln < 8 AND read NOT IN (SELECT read FROM bad)), g AS (SELECT read, min(gene) AS gene FROM x GROUP BY read)
      SELECT gene, count(*) AS reads FROM k JOIN g USING (read) GROUP BY gene""",
)
# the caller's predicate by itself
register("f13_snp_predicate", lambda s, d: slam.snp_binomial(slam.pileup(_bases(s, d).withColumn("pos", F.expr("pos div 50")).withColumn("mismatch", F.col("ref") != F.col("alt"))), 0.3, 0.2, 4, 2, 0.5).select("chr", "pos", "n", "k"), f"WITH {_BASES}, st AS (SELECT chr, pos // 50 AS pos, count(*) AS n, count(*) FILTER (ref <> alt) AS k FROM b GROUP BY ALL), t AS (SELECT n, k, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.3::DOUBLE) + (n - i) * ln(0.7::DOUBLE))) AS tail FROM (SELECT DISTINCT n, k FROM st), range(0, 3000) r(i) WHERE i >= k AND i <= n GROUP BY ALL) SELECT chr, pos, n, k FROM st JOIN t USING (n, k) WHERE n >= 4 AND k >= 2 AND k / n::DOUBLE >= 0.5::DOUBLE AND tail < 0.2::DOUBLE")
# reads' weights by gene, W12 by name
register("m24_gene_weights", lambda s, d: slam.read_weights(aligns(s, d).withColumn("tpm", F.col("start") % 5).withColumn("read", F.col("read")), "tpm", ["read"]).groupBy("chr").agg(F.round(F.sum("weight"), 4).alias("weight")), f"WITH {ALIGNS} SELECT chr, round(sum(w), 4) AS weight FROM (SELECT chr, CASE WHEN sum(start % 5) OVER o > 0 THEN (start % 5) / (sum(start % 5) OVER o)::DOUBLE ELSE 1.0::DOUBLE / count(*) OVER o END AS w FROM aligns WINDOW o AS (PARTITION BY read)) GROUP BY chr")
# Cells that pass either way
register("u5_either_way", lambda s, d: cells.passers(_tot(s, d).where("n >= 60"), _tot(s, d).where("n % 2 = 0")), f"WITH {_TOT} SELECT cb FROM tot WHERE n >= 60 OR n % 2 = 0")
register("j1_match_kinds", lambda s, d: barcodes.match(reads(s, d).select("read", F.col("umi").alias("seq"), F.lit(20).alias("qual")), reads(s, d).select(F.col("umi").alias("cb")).distinct().where("cb < 'C'")).groupBy("match").agg(F.countDistinct("read").alias("reads")), f"WITH {READS}, wl AS (SELECT DISTINCT umi AS cb FROM reads WHERE umi < 'C'), c AS (SELECT read, count(*) FILTER (wl.cb = umi) AS e, count(*) FILTER (hamming(wl.cb, umi) = 1) AS o FROM reads, wl GROUP BY read, umi) SELECT CASE WHEN e > 0 THEN 'exact' WHEN o = 1 THEN 'one' ELSE 'multi' END AS match, count(*) AS reads FROM c WHERE e > 0 OR o > 0 GROUP BY ALL")
