"""Queries on small tables made up for what shows at size only, against their SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import flex, quant, trimming
from helixframe.plans import catalog

from .test_kernels import brute_cut, plain_adapter_cut


def same(spark, folder, name, **tables):
    """The query's rows, which equal its SQL's."""
    con = duckdb.connect()
    for t, frame in tables.items():
        frame.write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = catalog.queries()[name](spark, str(folder)), con.sql(catalog.oracles()[name])
    rows = sorted(tuple(r[c] for c in want.columns) for r in got.collect())
    assert rows == sorted(want.fetchall())
    return rows


def test_circular_junctions_at_any_distance(spark, tmp_path):
    lines = spark.createDataFrame([(k, p, 3, 10.0, "O") for k, p in enumerate((301, 1_000_201, 1_200_001, 3_000_000_001))], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_linestatus string")
    assert len(same(spark, tmp_path, "f16_circular", lineitem=lines)) == 4


def test_every_probe_has_an_index(spark, tmp_path):
    parts = spark.range(40_000).selectExpr("id AS p_partkey", "concat('blue bolt', id % 7) AS p_name", "concat('T', id % 3) AS p_type", "cast(id % 50 + 1 AS int) AS p_size")
    rows = same(spark, tmp_path, "s12_probe_index", part=parts)
    assert [r[1] for r in sorted(rows, key=lambda r: r[1])] == list(range(1, 39_201))


def test_probe_index_up_to_a_limit(spark):
    probes = spark.createDataFrame([(None, "z"), ("b", "y"), ("a", "x"), ("a", "w"), ("a", "v-Deprecated"), ("b", None)], "gene_id string, probe_id string")
    got = lambda *most: {(r.gene_id, r.probe_id): r["index"] for r in flex.probe_index(probes, *most).collect()}
    assert got() == got(None) == {(None, "z"): 1, ("a", "w"): 2, ("a", "x"): 3, ("b", "y"): 4}
    assert got(2) == {(None, "z"): 1, ("a", "w"): 2}


@pytest.mark.parametrize("name", ["m11_prune_local", "m11_prune_abundance"])
def test_pruned_weights_round_halves_to_even(spark, tmp_path, name):
    # suppliers that weigh 7, 7, 7, 7, 6, 7, 5, 7, 5 and 6 eighths: of 64, 5 are 0.078125
    suppliers = [6, 13, 20, 27, 5, 34, 4, 41, 11, 12]
    lines = spark.range(600).selectExpr("id AS l_orderkey", f"explode(array({', '.join(f'{s}L' for s in suppliers)})) AS l_suppkey")
    ((_, weights, count),) = same(spark, tmp_path, name, lineitem=lines)
    assert "0.07812" in weights.split(",") and count == 600


@pytest.mark.parametrize("method", ["em", "vb"])
def test_quantified_classes_stay_dealt_over_tasks(spark, monkeypatch, method):
    r, n, rows = random.Random(5), 32, {}
    for sample in ("a", None, "b"):
        for _ in range(150):
            tids = tuple(sorted(r.sample(range(n - 2), r.randrange(0, 6))))
            rows[sample, tids] = ([r.choice([0.0, 1.0, r.random()]) for _ in tids], r.randrange(1, 50))
    classes = spark.createDataFrame([(s, list(t), w, k) for (s, t), (w, k) in rows.items()], "sample string, tids array<bigint>, weights array<double>, count bigint").repartition(4)
    eff = np.array([50.0 + i * 7 % 40 for i in range(n)])
    lengths = spark.createDataFrame(list(enumerate(eff.tolist())), "tid bigint, eff double")
    # a block holds no more than some members of one sample, wherever they come from
    monkeypatch.setattr(quant, "_LEAST", 10)
    blocks = quant._blocks(classes, spark.sparkContext.broadcast(eff), 1).select("sample", (F.length("tid") / 4).alias("members"), F.spark_partition_id().alias("task")).collect()
    assert len({b.task for b in blocks}) == 4 and sum(b.members for b in blocks) == sum(len(t) for _, t in rows)
    how = {"rounds": 4, "least": 4}
    for held in (n, 2 * n, 1 << 22):  # one sample after another, two, all at once
        monkeypatch.setattr(quant, "_HELD", held)
        got = quant.quantify(classes, lengths, method, "sample", **how).toPandas()
        assert len(got) == 3 * n
        for sample in ("a", None, "b"):
            x = [(t, *wk) for (s, t), wk in rows.items() if s == sample]
            want = getattr(quant, method)(quant.ClassTable([t for t, _, _ in x], [w for _, w, _ in x], np.array([k for _, _, k in x]), n, eff), **how)
            mine = got[got["sample"].isna() if sample is None else got["sample"] == sample].sort_values("tid")
            assert np.allclose(mine["count"], want, rtol=1e-9, atol=1e-12) and abs(mine["tpm"].sum() - 1e6) < 1e-3


def test_adapters_in_long_reads(monkeypatch):
    rng, adapter = np.random.default_rng(11), "AGATCGGAAGAGC"
    filled, table = [], trimming._table
    monkeypatch.setattr(trimming, "_table", lambda reads, *a: filled.append(sum(map(len, reads))) or table(reads, *a))
    reads = []
    for k in range(120):
        r = "".join(rng.choice(list("ACGTo é𝄞" if k % 2 else "ACGTohu"), rng.integers(0, 900)))
        for _ in range(rng.integers(0, 4)):  # whole or cut adapters with errors
            x = list(adapter[: rng.integers(1, 14)] if rng.integers(2) else adapter)
            for _ in range(rng.integers(0, 3)):
                i = rng.integers(0, len(x))
                x[i] = ["", "T", x[i] + "A", x[i].lower()][rng.integers(4)]
            i = len(r) if rng.integers(3) == 0 else rng.integers(0, len(r) + 1)
            r = r[:i] + "".join(x) + r[i:]
        reads.append(r)
    for rate in (0.0, 0.1, 0.2, 0.34):
        for overlap, parity in ((1, None), (3, None), (1, "3.2")):
            assert trimming.adapter_cut(reads, adapter, overlap, rate, parity).tolist() == [plain_adapter_cut(r, adapter, overlap, rate, parity) for r in reads], (rate, overlap, parity)
    filled.clear()
    trimming.adapter_cut(["the quick brown fox " * 5000, "é" * 9000 + adapter + "x" * 9000], adapter)
    assert sum(filled) < 300  # the table is filled around what can be an adapter only


def test_kept_by_quality():
    r = random.Random(2)
    for n in [0, 1, 63, 64, 65, 300, 2000]:
        for top in (24, 41):
            q = [r.randrange(2, top) for _ in range(n)]
            assert trimming.quality_kept("".join(chr(33 + x) for x in q), 20) == brute_cut(q, 20)


def test_pairs_are_cut_in_one_pass(spark):
    text = "ACGTACGTACGTACGTACGTACGTAGATCGGAAGAGCTT"
    rows = [("a", text, "I" * 39, text, "I" * 30 + "#" * 9), ("b", text, None, text, "I" * 39), ("c", None, "I", None, "I"), ("d", text, "I" * 39, "", ""), ("e", text, "I" * 39, None, None)]
    out = trimming.trim_pairs(spark.createDataFrame(rows, "name string, seq string, qual string, seq2 string, qual2 string"), "AGATCGGAAGAGC")
    assert {(r.name, len(r.seq), len(r.qual), r.seq2 and len(r.seq2), r.qual2 and len(r.qual2)) for r in out.collect()} == {("a", 24, 24, 24, 24), ("e", 24, 24, None, None)}
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    front = trimming.trim_pairs(spark.createDataFrame([("a", text, "###" + "I" * 36, text, "I" * 39)], "name string, seq string, qual string, seq2 string, qual2 string"), "AGATCGGAAGAGC", five_prime=True).first()
    assert (front.seq, front.seq2) == (text[3:24], text[:24])
