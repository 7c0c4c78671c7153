"""Readers and writers, by small files and round trips."""

import gzip

from pyspark.sql import functions as F

from helixframe.operators import trimming
from helixframe.sources import readers, writers


def put(folder, name, text):
    path = folder / name
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


def test_fastq_and_split(spark, tmp_path):
    text = "".join(f"@r{i}/1 extra\n{'ACGT' * (i % 5 + 1)}\n+\n{'@' * (4 * (i % 5 + 1))}\n" for i in range(500))
    for name in ("a.fastq", "b.fastq.gz"):
        path = put(tmp_path, name, text)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        try:
            rows = readers.fastq(spark, path).orderBy("read").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(r.read, r.name, r.seq) for r in rows] == [(i, f"r{i}", "ACGT" * (i % 5 + 1)) for i in range(500)]
    writers.write_fastq(readers.fastq(spark, path).withColumn("y", F.col("read") % 2 == 0), str(tmp_path / "out"), "y")
    back = readers.fastq(spark, str(tmp_path / "out" / "y=true"))
    assert back.count() == 250


def test_fasta(spark, tmp_path):
    rows = readers.fasta(spark, put(tmp_path, "g.fa", ">c1 x\nACGT\nAC\n>c2\nGG\n\nTT\n")).collect()
    assert {r.contig: r.seq for r in rows} == {"c1": "ACGTAC", "c2": "GGTT"}


def test_sam_round_trip(spark, tmp_path):
    text = "@HD\tVN:1\nr1\t0\tc1\t5\t255\t4M\t*\t0\t0\tACGT\tIIII\tNH:i:1\tCB:Z:AC\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n"
    a = readers.sam(spark, put(tmp_path, "x.sam", text))
    assert {r.qname: r.tags for r in a.collect()} == {"r1": {"NH": "1", "CB": "AC"}, "r2": {}}
    writers.write_sam(a, str(tmp_path / "o"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect()) == ["r1\t0\tc1\t5\t255\t4M\t*\t0\t0\tACGT\tIIII\tCB:Z:AC\tNH:i:1", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII"]


def test_gtf_vcf_bed(spark, tmp_path):
    text = '#c\nc1\ts\texon\t1\t10\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_name "N";\nc1\ts\texon\t90\t120\t.\t+\t.\tgene_id "G2";\nc1\ts\tgene\t1\t10\t.\t+\t.\tgene_id "G1";\nc1\ts\texon\t20\t30\t.\t-\t.\ttranscript_id "T3";\n'
    rows = readers.gtf(spark, put(tmp_path, "a.gtf", text), spark.createDataFrame([("c1", 100)], "chr string, length bigint")).orderBy("start").collect()
    assert [(r.gene, r.tr, r.gene_name, r.gene_type) for r in rows] == [("G1", "T1", "N", "MissingGeneType"), ("MissingGeneID", "T3", "MissingGeneID", "MissingGeneType")]
    vcf = put(tmp_path, "a.vcf", "##x\n#CHROM\n" + "".join(f"chr1\t{p}\t.\t{r}\t{a}\t.\t{f}\t.\tGT\t{g}\n" for p, r, a, f, g in ((1, "A", "C", "PASS", "0|1"), (2, "A", "CC", "PASS", "0/1"), (3, "A", "G", "q10", "1/1"), (4, "A", "G", "PASS", "0/0"), (5, "T", "G", "PASS", "1/1"), (1, "A", "C", "PASS", "0|1"))))
    assert {(r.pos, r.a1, r.a2) for r in readers.vcf_genotypes(spark, vcf).collect()} == {(1, "A", "C"), (3, "G", "G"), (5, "G", "G")}
    assert {r.pos for r in readers.vcf_genotypes(spark, vcf, True).collect()} == {1}
    places, fate = readers.vcf_mask(spark, vcf)
    assert sorted(r.pos for r in places.collect()) == [1, 5] and {r.fate: r.n for r in fate.collect()} == {"kept": 3, "not_snv": 1, "filtered": 1, "reference": 1}
    assert readers.bed_places(readers.bed(spark, put(tmp_path, "a.bed", "c1\t4\t7\nc1\t6\t8\n"))).count() == 4


def test_mex_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("g2", "AA", 3), ("g1", "CC", 1), ("g1", "AA", 7)], "gene string, cb string, n bigint")
    writers.write_mex(m, spark.createDataFrame([("g1",), ("g2",), ("g3",)], "gene string"), spark.createDataFrame([("AA",), ("BB",), ("CC",)], "cb string"), str(tmp_path / "m"))
    head = [r.value for r in spark.read.text(str(tmp_path / "m/matrix.mtx")).collect()][:3]
    assert head == ["%%MatrixMarket matrix coordinate integer general", "3 3 3", "1 1 7"]
    entries, feats, bcs = readers.mex(spark, str(tmp_path / "m"))
    assert {(r.gene, r.cb, r.value) for r in entries.collect()} == {("g2", "AA", 3.0), ("g1", "CC", 1.0), ("g1", "AA", 7.0)}
    assert feats.count() == 3 and bcs.count() == 3


def test_quant_ec_chain_config(spark, tmp_path):
    q = spark.createDataFrame([("t1", 1000.0, 800.0, 100.0, 80.0)], "tx string, length double, eff double, tpm double, count double")
    writers.write_quant(q, str(tmp_path / "q"))
    assert [tuple(r) for r in readers.quant_sf(spark, str(tmp_path / "q")).collect()] == [("t1", 1000.0, 800.0, 100.0, 80.0)]
    names, classes = readers.equivalence_classes(spark, put(tmp_path, "ec.txt", "2\n2\ntA\ntB\n1\t0\t5\n2\t0\t1\t0.25\t0.75\t7\n"))
    assert names.count() == 2 and {(tuple(r.tids), tuple(r.weights), r["count"]) for r in classes.collect()} == {((0,), (1.0,), 5.0), ((0, 1), (0.25, 0.75), 7.0)}
    c = readers.chain(spark, put(tmp_path, "a.chain", "chain 1 c1 100 + 10 60 d1 100 + 20 75 1\n10 5 10\n20 0 5\n15\n\n"))
    assert sorted((r.start, r.end, r["shift"]) for r in c.collect()) == [(10, 20, 10), (25, 45, 15), (45, 60, 20)]
    conf = readers.multi_config("[gene-expression]\nreference,/x\n[libraries]\nfastq_id,fastqs,feature_types\na,/f,Gene Expression\n")
    assert conf == {"gene-expression": {"reference": "/x"}, "libraries": [{"fastq_id": "a", "fastqs": "/f", "feature_types": "Gene Expression"}]}
    assert readers.pair_files(["s_S1_L001_R2_001.fastq.gz", "s_S1_L001_R1_001.fastq.gz", "x.txt"]) == {"s_S1_L001": {"R1": ["s_S1_L001_R1_001.fastq.gz"], "R2": ["s_S1_L001_R2_001.fastq.gz"]}}
    f = readers.fragment_lengths(spark, put(tmp_path, "fld.tsv", "#len\tcount\tprob\n3\t5\t0.25\n4\t15\t0.75\n"))
    assert sorted((r.f, r.p) for r in f.collect()) == [(3, 0.25), (4, 0.75)]


def test_side_tables(spark, tmp_path):
    p = readers.probes(spark, put(tmp_path, "p.csv", "#v=1\ngene_id,probe_seq,probe_id\nG1,ACGT,P1\n")).first()
    assert (p.gene_id, p.included) == ("G1", None)
    f = readers.feature_reference(spark, put(tmp_path, "f.csv", "id,name,read,pattern,sequence,feature_type\na,b,R2,5PNNNNNNNNNN(BC),ACGT,Antibody Capture\n")).first()
    assert f.place == 11
    try:
        readers.probes(spark, put(tmp_path, "q.csv", "gene_id\nG1\n"))
        raise AssertionError
    except ValueError as e:
        assert "probe_seq" in str(e)
    assert readers.whitelist(spark, put(tmp_path, "w.txt.gz", "AAA\nAAA x\nCCC\n\n")).count() == 2


def test_reports(spark, tmp_path):
    one = spark.createDataFrame([(3, 0.5)], "reads bigint, share double")
    assert [tuple(r) for r in writers.metric_rows(one).collect()] == [("reads", "3"), ("share", "0.5")]
    assert writers.report_json(one, version="1").first().value == '{"version":"1","positions":[{"reads":3,"share":0.5}]}'
    t = writers.overlap_tags(spark.createDataFrame([(1, ["a", "a", "b"], "exonic_antisense"), (2, [], "intergenic")], "read int, genes array<string>, class string")).orderBy("read").collect()
    assert [tuple(r) for r in t] == [(1, "a,b", "exonic"), (2, "", "none")]


def test_adapter_places(spark):
    df = spark.createDataFrame([("TTTACGTCCC",), ("TTTACCTCCC",), ("AC",)], "seq string")
    got = df.select("seq", trimming.find_adapter("ACGT", 1)("seq").alias("at")).select("at", trimming.anchored_slice(F.col("seq"), F.col("at"), 4, 3, 0, 2).alias("s")).collect()
    assert [tuple(r) for r in got] == [(3, "CC"), (3, "CC"), (-1, None)]
    md = trimming.mismatches(spark.createDataFrame([("ACGT", "AGGA")], "read_bases string, ref_bases string")).first()
    assert (md.nm, md.md) == (2, "1G1A0")


def test_trimming_queries_take_whole_texts(spark, tmp_path):
    from helixframe.plans import catalog

    adapter = "AGATCGGAAGAGC"
    texts = ["C" * 60 + adapter + "C" * 9, "C" * 25, "C" * 50, "C" * 5, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda q: catalog.queries()[q](spark, str(tmp_path)).collect()
    for q in ("p6_adapter_trim", "p7_adapter_trim_32"):
        assert {r[0]: r[1] for r in run(q)} == {0: 60, 1: 25, 2: 50, 3: 5, 4: None, 5: 0}
    # the second mate loses its ten last letters to quality; pairs under 20 letters go
    assert {r.name: (r.n1, r.n2) for r in run("p8_trim_pairs")} == {"0": (60, 72), "2": (50, 40)}
