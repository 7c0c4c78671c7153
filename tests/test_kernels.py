"""Numeric kernels and grouped rules, against brute force and invariants."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators import cells, features, quant, slam, trimming, umi


def brute_cut(q, cutoff):
    total = best = 0
    cut = len(q)
    for i in range(len(q) - 1, -1, -1):
        total += cutoff - q[i]
        if total < 0:
            break
        if total > best:
            best, cut = total, i
    return cut


def test_quality_cut(spark):
    r = random.Random(1)
    rows = [(i, [r.randrange(2, 41) for _ in range(r.randrange(0, 30))]) for i in range(200)]
    got = spark.createDataFrame(rows, "i int, q array<int>").select("i", S.quality_cut(F.col("q"), 20).alias("k")).collect()
    q = dict(rows)
    assert all(x.k == brute_cut(q[x.i], 20) for x in got)


def test_adapter_trim():
    cut = lambda r, a: trimming.adapter_cut([r], a)[0]
    read = "ACGTACGTACGTACGT"
    adapter = "AGATCGGAAGAGC"
    assert cut(read + adapter, adapter) == 16
    assert cut(read + adapter[:5], adapter) == 16
    assert cut("C" * 16, "AGATCGGAAGAGC") == 16
    assert cut(read.lower() + adapter.lower(), adapter) == 16
    assert cut(read + "AGATCGGTAGAGC", adapter) == 16  # a mismatch
    assert cut(read + "AGATCGGAGAGC", adapter) == 16  # a deletion
    assert cut("", adapter) == 0


# fixed values: adapter, least overlap, rate, then reads and where they are cut
ADAPTER_CUTS = [
    ("AGATCGGAAGAGC", 1, 0.1, "ACGTACGTACGTACGTAGATCGGAAGAGC", 16),
    ("AGATCGGAAGAGC", 1, 0.1, "ACGTACGTACGTACGTACGTACGTAGA", 24),
    ("AGATCGGAAGAGC", 1, 0.1, "ACGTACGTACGTACGTACGTACGTA", 24),
    ("AGATCGGAAGAGC", 1, 0.1, "ACGTACGTACGTACGTAGATCGGTAGAGC", 16),
    ("AGATCGGAAGAGC", 1, 0.1, "ACGTACGTACGTACGTACGTACGTACGT", 28),
    ("AGATCGGAAGAGC", 1, 0.1, "ACGTACGTAGATCGGAAGAGCACGTACGT", 8),
    ("AGATCGGAAGAGC", 1, 0.1, "AGATCGGAAGAGCACGTACGTAAGAGC", 0),
    ("AGATCGGAAGAGC", 1, 0.1, "ACGTACGTACGTACGTACGTACGTAG", 24),
    ("AGATCGGAAGAGC", 1, 0.1, "AGATCGGAAGAGC", 0),
    ("AGATCGGAAGAGC", 1, 0.15, "ACGTACGTACGTACGTAGAXTCGGAAGAGC", 16),
    ("AGATCGGAAGAGC", 1, 0.15, "ACGTACGTACGTACGTAGATCGAAGAGC", 16),
    ("AGATCGGAAGAGC", 3, 0.1, "ACGTACGTACGTACGTACGTACGTAG", 26),
    ("AGATCGGAAGAGC", 1, 0.1, "AGATCGGACGTAAGAGCAGATCGGAAGAGC", 17),
    ("AGATCGGAAGAGC", 1, 0.1, "ACGTAGA", 4),
    ("AGATCGGAAGAGC", 1, 0.1, "ACGTACGTACGTACGTagatcggaagagc", 16),
]


def test_adapter_cuts_of_the_golden_reads():
    for parity in (None, "3.2"):
        for adapter, overlap, rate, read, want in ADAPTER_CUTS:
            assert trimming.adapter_cut([read], adapter, overlap, rate, parity)[0] == want, (read, parity)


def plain_adapter_cut(read: str, adapter: str, least_overlap: int = 1, rate: float = 0.1, parity: str | None = None) -> int:
    """The table letter by letter."""
    a, r = adapter.upper(), read.upper()
    m, n = len(a), len(r)
    cost, score, origin = list(range(m + 1)), [-2 * i for i in range(m + 1)], [0] * (m + 1)
    best: tuple[int, int, int, int] | None = None  # score, errors, start, length

    def offer(found: tuple[int, int, int, int]) -> None:
        nonlocal best
        s, e, start, length = found
        if length < least_overlap or e > int(rate * length):
            return
        if best is None:
            best = found
        elif parity == "3.2":
            if (length - e, -e) > (best[3] - best[1], -best[1]):
                best = found
        elif s > best[0] and (start <= best[2] + m // 2 or length > best[3]):
            best = found

    for j in range(1, n + 1):
        up = (cost[0], score[0], origin[0])
        cost[0], score[0], origin[0] = 0, 0, j
        for i in range(1, m + 1):
            diagonal, left, above = up, (cost[i], score[i], origin[i]), (cost[i - 1], score[i - 1], origin[i - 1])
            up = left
            if a[i - 1] == r[j - 1]:
                cost[i], score[i], origin[i] = diagonal[0], diagonal[1] + 1, diagonal[2]
            else:
                options = ((diagonal[0] + 1, diagonal[1] - 1, diagonal[2]), (left[0] + 1, left[1] - 2, left[2]), (above[0] + 1, above[1] - 2, above[2]))
                cost[i], score[i], origin[i] = min(options, key=lambda o: (o[0], -o[1]))
        offer((score[m], cost[m], origin[m], m))
        if best is not None and best[1] == 0 and best[3] == m:
            return best[2]
    for i in range(1, m + 1):
        offer((score[i], cost[i], origin[i], i))
    return n if best is None else best[2]


def test_adapter_cuts_match_the_plain_table():
    rng = np.random.default_rng(4)
    for adapter in ("AGATCGGAAGAGC", "ACAC", "AAAAAAAA"):
        for rate in (0.0, 0.1, 0.3):
            for parity in (None, "3.2"):
                reads = ["".join(rng.choice(list("ACGT"), rng.integers(0, 40))) for _ in range(60)]
                reads += [r[:12] + adapter[: rng.integers(1, len(adapter) + 1)] + r[12:20] for r in reads[:40]]
                assert trimming.adapter_cut(reads, adapter, 1, rate, parity).tolist() == [plain_adapter_cut(r, adapter, 1, rate, parity) for r in reads]


def test_trim_pairs(spark):
    rows = [("a", "ACGTACGTACGTACGTACGTACGT", "I" * 24, "ACGTACGTACGTACGTACGTACGT", "I" * 24), ("b", "ACGTAGATCGGAAGAGC", "I" * 17, "ACGTACGTACGTACGTACGTACGT", "I" * 24), ("c", "ACGTACGTACGTACGTACGTACGT", "I" * 20 + "####", "A" * 24, "I" * 24)]
    out = {r.name: r for r in trimming.trim_pairs(spark.createDataFrame(rows, "name string, seq string, qual string, seq2 string, qual2 string"), "AGATCGGAAGAGC", least=10).collect()}
    assert set(out) == {"a", "c"} and len(out["c"].seq) == 20


def test_umi_modes(spark):
    r = random.Random(4)
    rows = {(c, g, "".join(r.choice("ACGT") for _ in range(3))): r.randrange(1, 9) for c in range(3) for g in "xy" for _ in range(20)}
    mol = spark.createDataFrame([(*k, v) for k, v in rows.items()], "cb int, gene string, umi string, n bigint")
    get = lambda df: {(x.cb, x.gene): x["count"] for x in df.collect()}
    exact, hop, conn, direc, tools = (get(f) for f in (umi.exact(mol), umi.count_corrected(umi.one_hop(mol)), umi.count_corrected(umi.connected(mol)), umi.count_corrected(umi.directional(mol)), umi.count_corrected(umi.directional(mol, -1))))
    near = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) == 1
    for key in exact:
        own = {u: n for (c, g, u), n in rows.items() if (c, g) == key}
        fix = {u: max([u, *[v for v in own if near(u, v) and (own[v], v) > (own[u], u)]], key=lambda v: (own[v], v)) for u in own}
        assert hop[key] == len(set(fix.values()))
        root = {u: u for u in own}
        for _ in own:
            for a in own:
                for b in own:
                    if near(a, b):
                        root[a] = root[b] = min(root[a], root[b])
        assert conn[key] == len(set(root.values()))
        to, done = {}, []
        for u in sorted(own, key=lambda v: (-own[v], v)):
            p = next((v for v in done if near(u, v) and own[v] >= 2 * own[u]), None)
            to[u] = u if p is None else to[p]
            done.append(u)
        assert direc[key] == len(set(to.values()))
        assert 1 <= conn[key] <= tools[key] <= direc[key] <= exact[key]


def test_clique_cap(spark):
    mol = spark.createDataFrame([(1, "g", u, n) for u, n in (("AAAA", 10), ("AAAC", 2), ("CCCC", 3), ("CCCA", 2), ("GGGG", 5))], "cb int, gene string, umi string, n bigint")
    out = {r.umi: r.corrected for r in umi.clique(mol).collect()}
    assert out == {"AAAA": "AAAA", "AAAC": "AAAA", "CCCC": "CCCC", "CCCA": "CCCA", "GGGG": "GGGG"}


def test_digamma_and_em():
    assert abs(quant.digamma(np.array([1.0]))[0] + 0.5772156649) < 1e-9
    assert abs(quant.digamma(np.array([10.5]))[0] - (math.log(10.5) - 1 / 21 - 1 / (12 * 10.5**2) + 1 / (120 * 10.5**4))) < 1e-7
    t = quant.ClassTable([[0], [0, 1], [1, 2]], [[1.0], [0.5, 0.5], [0.5, 0.5]], np.array([100.0, 50.0, 10.0]), 3, np.array([100.0, 100.0, 100.0]))
    for solve in (quant.em, quant.vb):
        c = solve(t)
        assert abs(c.sum() - 160) < 1e-6 and c[0] > 140 and (c >= 0).all()


def test_tximport_worked_example(spark):
    rows = [("gene1", 100.0, 80.0, 1000.0, 800.0), ("gene1", 50.0, 20.0, 500.0, 400.0), ("gene2", 200.0, 360.0, 2000.0, 1800.0), ("gene2", 100.0, 130.0, 1500.0, 1300.0), ("gene3", 0.0, 0.0, 800.0, 600.0), ("gene4", 75.0, 75.0, 1200.0, 1000.0)]
    q = spark.createDataFrame(rows, "gene string, tpm double, count double, length double, eff double")
    out = {r.gene: (round(r["count"], 6), round(r.length, 3)) for r in quant.tximport(q).collect()}
    assert out == {"gene1": (100.0, 666.667), "gene2": (490.0, 1633.333), "gene3": (0.0, 600.0), "gene4": (75.0, 1000.0)}


def test_new_to_total_recovers():
    rng = np.random.default_rng(0)
    n_t = rng.integers(5, 40, 4000)
    new = rng.random(4000) < 0.3
    k = rng.binomial(n_t, np.where(new, 0.05, 0.001))
    pi, sigma, _ = slam.solve(n_t, k, np.ones(4000))
    assert abs(pi - 0.3) < 0.04 and sigma > 0
    assert slam.solve(n_t, np.zeros(4000, int), np.ones(4000))[0] < 0.05


def test_snp_em(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 40, int(rng.binomial(40, 0.5 if i < 20 else 0.95 if i < 30 else 0.002))) for i in range(3000)]
    found, kept = slam.snp_em(spark.createDataFrame(rows, "pos int, n bigint, k bigint"))
    assert {r.pos for r in kept.collect()} == set(range(30)) and found["p_err"] < 0.01


def test_auto_trim():
    y = np.concatenate([np.linspace(1.0, 0.2, 6), np.full(24, 0.2) + np.linspace(0, 0.01, 24), np.linspace(0.2, 1.2, 5)])
    t5, t3 = slam.auto_trim(pd.DataFrame({"pos": range(len(y)), "value": y}), 5000)
    assert 2 <= t5 <= 8 and 1 <= t3 <= 8
    assert slam.auto_trim(pd.DataFrame({"pos": range(len(y)), "value": y}), 10) == (0, 0)


def test_good_turing_and_occupancy():
    p = cells.good_turing(pd.Series([0, 0, 1, 1, 1, 2, 2, 5, 9]))
    assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()
    assert cells.occupancy_threshold(0.0005, 1000, 2_000_000) == 1 and cells.occupancy_threshold(3.0, 1000, 20000) >= 3


def test_empty_drops_separates(spark):
    rng = np.random.default_rng(2)
    rows, profile = [], np.array([0.7, 0.1, 0.1, 0.1])
    for cb in range(300):
        counts = rng.multinomial(30, profile if cb >= 20 else [0.05, 0.05, 0.1, 0.8])
        rows += [(cb, f"g{i}", int(c)) for i, c in enumerate(counts) if c]
    m = spark.createDataFrame(rows, "cb int, gene string, n bigint")
    prof = spark.createDataFrame([(f"g{i}", float(p)) for i, p in enumerate(profile)], "gene string, share double")
    out = {r.cb: r.p_adjusted for r in cells.empty_drops(m, prof, m.select("cb").distinct(), 400).collect()}
    assert all(out[c] < 0.05 for c in range(20)) and sum(out[c] < 0.05 for c in range(20, 300)) < 20


def test_guide_mixtures(spark):
    rng = np.random.default_rng(3)
    cells_ = spark.createDataFrame([(i, 1000.0) for i in range(300)], "cb int, umis double")
    rows = [(i, "g", int(rng.poisson(80 if i < 30 else 1))) for i in range(300)]
    counts = spark.createDataFrame([r for r in rows if r[2] > 0], "cb int, feature string, n bigint")
    hit = {r.cb for r in features.mixture_calls(counts, cells_).collect()}
    assert set(range(30)) <= hit and len(hit) <= 40
    # the dispersion is that of all cells, so that the guide's own cells widen the background
    assert {r.cb for r in features.mixture_calls(counts, cells_, "nb").collect()} <= hit
    hit = {r.cb for r in features.gmm_calls(counts, cells_).collect()}
    assert set(range(30)) <= hit and len(hit) <= 40


def test_streaming_matches_batch(spark):
    from helixframe.plans import roles
    from helixframe.streaming import live

    path = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).parquet("/root/testdata/sf0.001", pathGlobFilter="events.parquet")
    reads = raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("cb"), F.col("event_type").alias("gene"), F.col("props").alias("umi"))
    got = {(r.cb, r.gene): r.n_umi for r in live.run_once(live.live_molecules(reads, late="10000 days"), "live_molecules").collect()}
    want = {(r.cb, r.gene): r["count"] for r in umi.exact(roles.molecules(spark, "/root/testdata/sf0.001")).collect()}
    assert got == want


def test_library_format_is_strict(spark):
    with pytest.raises(ValueError):
        quant.library_format(spark.createDataFrame([(i, "ISF" if i % 2 else "ISR") for i in range(10)], "read int, format string"), 10)
