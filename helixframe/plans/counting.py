"""Queries on barcodes, molecules and sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators import barcodes, umi

from .catalog import register
from .roles import MOLECULES, READS, molecules, reads, table

W = Window


def _out(df):
    return df.select("cb", "gene", F.col("count").cast("bigint").alias("n_umi"))


register("a7_umi_nodedup", lambda s, d: _out(umi.no_dedup(molecules(s, d))), f"WITH {READS} SELECT cb, gene, count(*) AS n_umi FROM reads GROUP BY cb, gene")
register("a8_umi_exact", lambda s, d: _out(umi.exact(molecules(s, d))), f"WITH {READS} SELECT cb, gene, count(DISTINCT umi) AS n_umi FROM reads GROUP BY cb, gene")

_ONE_HOP = f"""{MOLECULES}, best AS (SELECT a.cb, a.gene, a.umi, arg_max(b.umi, b.n * 1000 + ascii(b.umi[1]) * 0 + idx.i) AS best
  FROM mol a JOIN mol b ON a.cb = b.cb AND a.gene = b.gene AND hamming(a.umi, b.umi) = 1 AND (b.n > a.n OR (b.n = a.n AND b.umi > a.umi))
  JOIN (SELECT umi, row_number() OVER (ORDER BY umi) AS i FROM (SELECT DISTINCT umi FROM mol)) idx ON idx.umi = b.umi GROUP BY ALL),
  cor AS (SELECT mol.*, coalesce(best.best, mol.umi) AS corrected FROM mol LEFT JOIN best USING (cb, gene, umi))"""
register("a10_umi_1mm_cr", lambda s, d: _out(umi.count_corrected(umi.one_hop(molecules(s, d)))), f"WITH {_ONE_HOP} SELECT cb, gene, count(DISTINCT corrected) AS n_umi FROM cor GROUP BY cb, gene")
register(
    "a9_umi_1mm_all",
    lambda s, d: _out(umi.count_corrected(umi.connected(molecules(s, d)))),
    f"""WITH RECURSIVE {MOLECULES}, walk AS (SELECT cb, gene, umi, umi AS root FROM mol UNION
      SELECT b.cb, b.gene, b.umi, w.root FROM walk w JOIN mol b ON b.cb = w.cb AND b.gene = w.gene AND hamming(b.umi, w.umi) = 1),
      lab AS (SELECT cb, gene, umi, min(root) AS root FROM walk GROUP BY ALL) SELECT cb, gene, count(DISTINCT root) AS n_umi FROM lab GROUP BY cb, gene""",
)
register("a11_umi_directional", lambda s, d: _out(umi.count_corrected(umi.directional(molecules(s, d)))))
register("a11_umi_directional_tools", lambda s, d: _out(umi.count_corrected(umi.directional(molecules(s, d), -1))))
register("a16_umi_clique", lambda s, d: _out(umi.count_corrected(umi.clique(molecules(s, d)))))
register("a12_multi_gene", lambda s, d: umi.multi_gene(molecules(s, d)).groupBy("cb", "gene").agg(F.count("*").alias("n_umi")), f"WITH {MOLECULES}, w AS (SELECT *, max(n) OVER (PARTITION BY cb, umi) AS top, count(*) OVER (PARTITION BY cb, umi) AS g FROM mol) SELECT cb, gene, count(*) AS n_umi FROM w WHERE n = top AND (g = 1 OR top > 1) GROUP BY cb, gene")
register("a13_multi_gene_all", lambda s, d: umi.multi_gene_all(molecules(s, d)).groupBy("cb", "gene").agg(F.count("*").alias("n_umi")), f"WITH {MOLECULES}, w AS (SELECT *, count(*) OVER (PARTITION BY cb, umi) AS g FROM mol) SELECT cb, gene, count(*) AS n_umi FROM w WHERE g = 1 GROUP BY cb, gene")
register(
    "a14_multi_gene_cr",
    lambda s, d: umi.multi_gene_corrected(umi.one_hop(molecules(s, d))).groupBy("cb", "gene").agg(F.count("*").alias("n_umi")),
    f"""WITH {_ONE_HOP}, aft AS (SELECT cb, gene, corrected AS umi, sum(n) AS m FROM cor GROUP BY ALL),
      w AS (SELECT *, max(m) OVER (PARTITION BY cb, umi) AS top FROM aft), t AS (SELECT *, count(*) OVER (PARTITION BY cb, umi) AS ties FROM w WHERE m = top),
      raw AS (SELECT cb, gene, umi FROM (SELECT *, max(n) OVER (PARTITION BY cb, umi) AS top FROM mol) WHERE n < top)
      SELECT cb, gene, count(*) AS n_umi FROM t ANTI JOIN raw USING (cb, gene, umi) WHERE ties = 1 GROUP BY cb, gene""",
)
register("a15_molecule_counts", lambda s, d: umi.molecule_table(reads(s, d), ["cb", "umi", "gene"]).groupBy("cb", "gene").agg(F.count("*").alias("molecules"), F.sum("n").alias("reads")), f"WITH {MOLECULES} SELECT cb, gene, count(*) AS molecules, CAST(sum(n) AS BIGINT) AS reads FROM mol GROUP BY cb, gene")


def _umi_genes(s, d):
    o, li, p = (table(s, d, t) for t in ("orders", "lineitem", "part"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("o_custkey").alias("cb"), (F.col("l_orderkey") % 3).alias("umi"), F.col("l_orderkey").alias("read"), F.col("p_type").alias("gene")).distinct()


_UMI_GENES = """rg AS (SELECT DISTINCT o_custkey AS cb, l_orderkey % 3 AS umi, l_orderkey AS read, p_type AS gene FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
  nr AS (SELECT cb, umi, count(DISTINCT read) AS reads FROM rg GROUP BY ALL), hit AS (SELECT cb, umi, gene, count(DISTINCT read) AS hits FROM rg GROUP BY ALL),
  com AS (SELECT cb, umi, gene, count(*) OVER (PARTITION BY cb, umi) AS genes FROM hit JOIN nr USING (cb, umi) WHERE hits = reads)"""
_r6 = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6
register("u4_common_genes", lambda s, d: umi.common_genes(_umi_genes(s, d)), f"WITH {_UMI_GENES} SELECT * FROM com")
register(
    "a18_multi_gene_allocation",
    lambda s, d: umi.allocate(umi.common_genes(_umi_genes(s, d))).select("cb", "gene", *[_r6(c).alias(c) for c in ("unique", "uniform", "prop_unique", "rescue")]),
    f"""WITH {_UMI_GENES}, u AS (SELECT cb, gene, count(*)::DOUBLE AS "unique" FROM com WHERE genes = 1 GROUP BY ALL), f AS (SELECT cb, gene, sum(1.0::DOUBLE / genes) AS uniform FROM com WHERE genes > 1 GROUP BY ALL),
      per AS (SELECT cb, gene, coalesce("unique", 0) AS "unique", coalesce(uniform, 0) AS uniform FROM u FULL JOIN f USING (cb, gene)),
      m AS (SELECT com.*, per."unique", per.uniform, sum(per."unique") OVER (PARTITION BY cb, umi) AS su, sum(per."unique" + per.uniform) OVER (PARTITION BY cb, umi) AS sr FROM com JOIN per USING (cb, gene) WHERE genes > 1),
      sh AS (SELECT cb, gene, sum(CASE WHEN su > 0 THEN "unique" / su ELSE 1.0::DOUBLE / genes END) AS p, sum(("unique" + uniform) / sr) AS r FROM m GROUP BY ALL)
      SELECT cb, gene, floor("unique" * 1e6 + 0.5) / 1e6 AS "unique", floor(uniform * 1e6 + 0.5) / 1e6 AS uniform, floor(coalesce(p, 0) * 1e6 + 0.5) / 1e6 AS prop_unique, floor(coalesce(r, 0) * 1e6 + 0.5) / 1e6 AS rescue FROM per LEFT JOIN sh USING (cb, gene)""",
)
register("m5_multi_gene_em", lambda s, d: umi.em_allocate(umi.common_genes(_umi_genes(s, d))).select("cb", "gene", _r6("em").alias("em")))


def _velocity(s, d):
    r = reads(s, d)
    return r.select("cb", "umi", "read", F.concat("gene", F.when(F.col("value") > 20, "-b").otherwise("-a")).alias("tr"), "gene", F.when(F.col("value") > 50, 2).when(F.col("value") > 10, 1).otherwise(3).alias("bits"))


register(
    "a19_velocity",
    lambda s, d: umi.velocity(_velocity(s, d)),
    f"""WITH {READS}, v AS (SELECT cb, umi, read, gene || CASE WHEN value > 20 THEN '-b' ELSE '-a' END AS tr, gene, CASE WHEN value > 50 THEN 2 WHEN value > 10 THEN 1 ELSE 3 END AS bits FROM reads),
      nr AS (SELECT cb, umi, count(DISTINCT read) AS reads FROM v GROUP BY ALL), k AS (SELECT cb, umi, tr, gene, count(DISTINCT read) AS hits, bit_or(bits) AS bits FROM v GROUP BY ALL),
      t AS (SELECT cb, umi, min(gene) AS gene, min(bits) AS low, max(bits) AS high FROM k JOIN nr USING (cb, umi) WHERE hits = reads GROUP BY cb, umi HAVING min(gene) = max(gene))
      SELECT cb, gene, count(*) FILTER (high = 1) AS spliced, count(*) FILTER (high > 1 AND low >= 2) AS unspliced, count(*) FILTER (high > 1 AND low < 2) AS ambiguous FROM t GROUP BY cb, gene""",
)
register("a20_smart_seq", lambda s, d: umi.smart_seq(reads(s, d).select("cb", "gene", F.floor("value").alias("start"), F.length("umi").alias("length"))), f"WITH {READS} SELECT cb, gene, count(*) AS reads, count(DISTINCT floor(value)) AS molecules FROM reads GROUP BY cb, gene")


# barcodes: listed are tags of the users with more than a third of the reads of the largest; sequences are four letters
def _listed(s, d):
    return reads(s, d).groupBy("umi").agg(F.count("*").alias("n")).where("n % 3 = 0").select(F.col("umi").alias("cb"))


_LISTED = f"{READS}, wl AS (SELECT umi AS cb FROM reads GROUP BY umi HAVING count(*) % 3 = 0)"
_seqs = lambda s, d: reads(s, d).select("read", F.col("umi").alias("seq"), (F.floor("value").cast("int") % 40).alias("qual"))
_MATCH = f"""{_LISTED}, sq AS (SELECT read, umi AS seq, CAST(floor(value) AS INT) % 40 AS qual FROM reads),
  ex AS (SELECT sq.*, wl.cb FROM sq JOIN wl ON seq = cb), nr AS (SELECT sq.*, wl.cb FROM sq ANTI JOIN ex USING (read) JOIN wl ON hamming(seq, cb) = 1),
  cand AS (SELECT *, 'exact' AS match FROM ex UNION ALL SELECT *, CASE WHEN count(*) OVER (PARTITION BY read) = 1 THEN 'one' ELSE 'multi' END FROM nr)"""
register("j1_whitelist_exact", lambda s, d: barcodes.match(_seqs(s, d), _listed(s, d)).where("match = 'exact'").groupBy("cb").agg(F.count("*").alias("n")), f"WITH {_MATCH} SELECT cb, count(*) AS n FROM ex GROUP BY cb")
register("j2_whitelist_one_mismatch", lambda s, d: barcodes.match(_seqs(s, d), _listed(s, d)).select("read", "cb", "match"), f"WITH {_MATCH} SELECT read, cb, match FROM cand")


def _rescue(pseudo):
    def run(s, d):
        c = barcodes.match(_seqs(s, d), _listed(s, d))
        n = c.where("match = 'exact'").groupBy("cb").agg(F.count("*").alias("n"))
        return barcodes.rescue(c.where("match <> 'exact'"), n, threshold=0.6, pseudo=pseudo).select("read", "cb", _r6("posterior").alias("posterior"))

    return run


def _rescue_sql(pseudo, op):
    return f"""WITH {_MATCH}, ne AS (SELECT cb, count(*) AS n FROM ex GROUP BY cb), sc AS (SELECT c.read, c.cb, (coalesce(n, 0) + {pseudo}) * pow(10::DOUBLE, -least(qual, 33) / 10.0::DOUBLE) AS w FROM cand c LEFT JOIN ne USING (cb) WHERE match <> 'exact'),
      p AS (SELECT *, sum(w) OVER (PARTITION BY read) AS t, row_number() OVER (PARTITION BY read ORDER BY w DESC, cb) AS r FROM sc WHERE w > 0)
      SELECT read, cb, floor(w / t * 1e6 + 0.5) / 1e6 AS posterior FROM p WHERE r = 1 AND {op}"""


register("j5_posterior", _rescue(0), _rescue_sql(0, "w >= 0.6::DOUBLE * t"))
register("j8_feature_rescue", _rescue(1), _rescue_sql(1, "w / t > 0.6::DOUBLE"))


def _bayes(s, d):
    # the first and the last letter are less sure, by the read
    r = _seqs(s, d).withColumn("qual", F.concat(F.substring(F.lit("#+5?"), (F.col("read") % 4).cast("int") + 1, F.lit(1)), F.lit("55"), F.substring(F.lit("#+5?"), (F.col("read") % 3).cast("int") + 1, F.lit(1))))
    c = barcodes.match(r, _listed(s, d)).where("match <> 'exact'").select("read", "cb", F.lit(0.01).alias("prior"))
    return barcodes.bayes(r, c, 0.5, 1.5).select("read", "cb", _r6("posterior").alias("posterior"))


register(
    "j7_bayes",
    _bayes,
    f"""WITH {_MATCH}, q AS (SELECT c.read, c.cb, c.seq, substr('#+5?', CAST(read % 4 AS INT) + 1, 1) || '55' || substr('#+5?', CAST(read % 3 AS INT) + 1, 1) AS qual FROM cand c WHERE match <> 'exact'),
      e AS (SELECT read, cb, sum(CASE WHEN seq[i] = cb[i] THEN ln(1 - pow(10::DOUBLE, -(ascii(qual[i]) - 33) / 10.0::DOUBLE)) ELSE ln(pow(10::DOUBLE, -(ascii(qual[i]) - 33) / 10.0::DOUBLE) / 3) END) AS ll FROM q, range(1, 5) t(i) GROUP BY ALL),
      p AS (SELECT read, cb, exp(ll) / sum(exp(ll)) OVER (PARTITION BY read) AS p FROM e), r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(p) OVER w, 0) AS second FROM p WINDOW w AS (PARTITION BY read ORDER BY p DESC, cb))
      SELECT read, cb, floor(p * 1e6 + 0.5) / 1e6 AS posterior FROM r WHERE r = 1 AND p >= 0.5::DOUBLE AND p >= 1.5::DOUBLE * second""",
)
register("j10_sample_tag", lambda s, d: barcodes.sample_tag(reads(s, d).select("read", F.concat("umi", "umi").alias("seq")), s.createDataFrame([("ACG", "s1"), ("GTA", "s2"), ("TTT", "s3")], "tag string, sample string"), offset=3, length=3), f"""WITH {READS}, t(turn, pos) AS (VALUES (0, 3), (1, 2), (2, 4), (3, 1), (4, 5)), g(tag, sample) AS (VALUES ('ACG', 's1'), ('GTA', 's2'), ('TTT', 's3'))
  SELECT read, arg_min(sample, turn) AS sample FROM reads, t JOIN g ON substr(umi || umi, pos, 3) = tag GROUP BY read""")


def _demux(s, d):
    r = reads(s, d).select("read", F.col("gene").alias("tag"), (F.col("cb") % 2).alias("library"))
    n = table(s, d, "region")
    probes = r.select("tag").distinct().where("tag <> 'error'").withColumn("probe", F.length("tag").cast("bigint"))
    samples = n.select((F.col("r_regionkey") % 2).cast("bigint").alias("library"), (F.col("r_regionkey") + 4).cast("bigint").alias("probe"), F.col("r_name").alias("sample"))
    return barcodes.demux(r, probes, samples).groupBy("bucket").agg(F.count("*").alias("n"))


register("j11_demux", _demux, f"WITH {READS}, r AS (SELECT gene AS tag, cb % 2 AS library FROM reads) SELECT CASE WHEN tag = 'error' THEN 'unknown' WHEN r_name IS NULL THEN 'unmapped' ELSE r_name END AS bucket, count(*) AS n FROM r LEFT JOIN region ON r_regionkey % 2 = library AND r_regionkey + 4 = length(tag) AND tag <> 'error' GROUP BY ALL")
register("f6_umi_validity", lambda s, d: reads(s, d).select(F.coalesce(S.umi_status(F.col("umi")), F.lit("ok")).alias("status")).groupBy("status").agg(F.count("*").alias("n")), f"WITH {READS} SELECT CASE WHEN umi SIMILAR TO '(A+|C+|G+|T+)' THEN 'homopolymer' ELSE 'ok' END AS status, count(*) AS n FROM reads GROUP BY ALL")
register("j26_tag_injection", lambda s, d: barcodes.add_tags(table(s, d, "lineitem").select(F.col("l_orderkey").alias("read")), reads(s, d).where("read % 3 > 0").select("read", F.when(F.col("read") % 3 == 1, F.col("cb")).alias("cb"), F.col("umi").alias("ub"))).groupBy("cb", "ub").agg(F.count("*").alias("n")), f"WITH {READS}, t AS (SELECT read, CASE WHEN read % 3 = 1 THEN cb END AS cb, CASE WHEN read % 3 = 1 THEN umi END AS ub FROM reads WHERE read % 3 > 0) SELECT cb, ub, count(*) AS n FROM lineitem LEFT JOIN t ON l_orderkey = read GROUP BY ALL")

# sequences: words of documents and of URLs as reads
_docs = lambda s, d: table(s, d, "documents").select("doc_id", F.translate("text", " .,\n", "ACGT").alias("seq"))
_DOCS = "sq AS (SELECT doc_id, translate(substr(text, 1, 60), ' .,' || chr(10), 'ACGT') AS seq FROM documents)"
register("p1_fixed_barcode", lambda s, d: _docs(s, d).select("doc_id", S.fixed_slice(F.col("seq"), 1, 16).alias("cb"), S.fixed_slice(F.col("seq"), 17, 10).alias("umi")), f"WITH {_DOCS} SELECT doc_id, rpad(substr(seq, 1, 16), 16, 'N') AS cb, rpad(substr(seq, 17, 10), 10, 'N') AS umi FROM sq")
register("p9_reverse_complement", lambda s, d: reads(s, d).select("read", S.reverse_complement(F.col("umi")).alias("rc"), S.two_bit(F.col("umi")).alias("code"), S.n_class(F.regexp_replace("umi", "GG", "GN")).alias("n")), f"WITH {READS} SELECT read, reverse(translate(umi, 'ACGT', 'TGCA')) AS rc, CAST((CASE WHEN true THEN k END) AS BIGINT) AS code, CASE WHEN instr(u, 'N') = 0 THEN -1 WHEN length(replace(u, 'N', '')) = 3 THEN instr(u, 'N') - 1 ELSE -2 END AS n FROM (SELECT read, umi, (instr('ACGT', umi[1]) - 1) * 64 + (instr('ACGT', umi[2]) - 1) * 16 + (instr('ACGT', umi[3]) - 1) * 4 + instr('ACGT', umi[4]) - 1 AS k, regexp_replace(umi, 'GG', 'GN', 'g') AS u FROM reads)")
register("x2_hamming", lambda s, d: reads(s, d).select("umi").distinct().crossJoin(s.createDataFrame([("ACGT",)], "b string")).select("umi", S.hamming(F.col("umi"), F.col("b")).alias("h")), f"WITH {READS} SELECT DISTINCT umi, hamming(umi, 'ACGT') AS h FROM reads")
register("p10_read_names", lambda s, d: table(s, d, "orders").select("o_orderkey", S.read_name(F.concat(F.lit("@r"), F.col("o_orderkey"), F.lit("/1 "), F.col("o_orderpriority"))).alias("name")), "SELECT o_orderkey, 'r' || o_orderkey AS name FROM orders")
register("p19_composite_barcode", lambda s, d: barcodes.split_composite(_docs(s, d).select("doc_id", F.rpad("seq", 24, "N").alias("barcode"))).select("doc_id", "cell", "tag"), f"WITH {_DOCS} SELECT doc_id, substr(rpad(seq, 24, 'N'), 1, 16) AS cell, right(rpad(seq, 24, 'N'), 8) AS tag FROM sq")
register("p20_feature_translation", lambda s, d: reads(s, d).select("read", S.translate_feature_barcode(F.concat("umi", "umi", "umi")).alias("cb")), f"WITH {READS} SELECT read, substr(u, 1, 7) || translate(substr(u, 8, 2), 'ACGT', 'TGCA') || substr(u, 10) AS cb FROM (SELECT read, umi || umi || umi AS u FROM reads)")
register("p4_quality_trim", lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("read")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: x["l_quantity"].cast("int")).alias("q")).select("read", S.quality_cut(F.col("q"), 25).alias("kept3"), S.quality_cut(F.reverse("q"), 25).alias("kept5")))
register("p12_cigar_span", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.cigar_span(F.concat_ws("", F.col("l_linenumber"), F.lit("S"), F.col("l_quantity").cast("int"), F.lit("M"), F.col("l_suppkey"), F.lit("N10M2I3D"))).cast("bigint").alias("span")), "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) + l_suppkey + 13 AS span FROM lineitem")
register("p11_cigar_blocks", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(S.cigar_blocks(F.concat_ws("", F.col("l_quantity").cast("int"), F.lit("M"), F.col("l_suppkey") + 1, F.lit("N10M")), F.col("l_partkey"))).alias("i", "b")).select("l_orderkey", "l_linenumber", "i", "b.start", "b.end"), """SELECT l_orderkey, l_linenumber, 0 AS i, l_partkey AS start, l_partkey + CAST(l_quantity AS INT) - 1 AS "end" FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 1, l_partkey + CAST(l_quantity AS INT) + l_suppkey + 1, l_partkey + CAST(l_quantity AS INT) + l_suppkey + 10 FROM lineitem""")
register("p14_strand_tag", lambda s, d: table(s, d, "orders").select("o_orderkey", S.strand_tag((F.col("o_orderkey") % 256).cast("int")).alias("xs")), "SELECT o_orderkey, CASE WHEN (((o_orderkey % 256) & 16) != 0) = (((o_orderkey % 256) & 128) != 0) THEN '+' ELSE '-' END AS xs FROM orders")
register("x10_hash31", lambda s, d: table(s, d, "nation").select("n_name", S.hash31(F.col("n_name"), 115).alias("h")))
register("x6_binomial_tail", lambda s, d: s.range(1, 40).select("id", (F.floor(S.binomial_tail(F.col("id"), F.col("id") % 7, 0.1) * 1e6 + 0.5) / 1e6).alias("tail")), "SELECT id, floor((1 - coalesce(s, 0)) * 1e6 + 0.5) / 1e6 AS tail FROM range(1, 40) t(id) LEFT JOIN (SELECT n, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.1::DOUBLE) + (n - i) * ln(0.9::DOUBLE))) AS s FROM range(1, 40) a(n), range(0, 7) b(i) WHERE i < n % 7 GROUP BY n) ON n = id")
register("x15_length_penalty", lambda s, d: table(s, d, "part").select("p_partkey", S.alignment_score(F.col("p_size") * 1000).alias("score")), "SELECT p_partkey, CAST(greatest(0, ceil(log2((p_size * 1000)::DOUBLE) * 0.25::DOUBLE - 0.5::DOUBLE)) AS INT) AS score FROM part")
register("x14_candidate_score", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.candidate_score((F.col("l_suppkey") % 3).cast("int"), (F.col("l_linenumber") - 3).cast("int")).alias("score")), "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey % 3 WHEN l_linenumber >= 3 THEN 3 - l_linenumber ELSE 0 END AS score FROM lineitem")
