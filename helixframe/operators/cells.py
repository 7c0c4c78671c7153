"""Cell calling (M13-M18, W1, W8, O2-O4, F20, A40, U5, U6). Cells: cb, n (molecules).

Ranks are by n descending, then cb. A rank needs one order of all cells; what is ranked are pairs (cb, n), and the two-step
rank in :func:`ranked` keeps even those from one task."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequences import hash31, log_factorial


def ranked(cells: DataFrame) -> DataFrame:
    """Rank from 1. Cells of one count are ranked together, counts are ranked by their cells' running number."""
    by = cells.groupBy("n").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.select("n", before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy("n").orderBy("cb"))
    return cells.withColumn("_inner", inner).join(by, "n").withColumn("rank", F.col("_before") + F.col("_inner")).drop("_before", "_inner")


def top_cells(cells: DataFrame, n: int) -> DataFrame:
    """O2: cells with at least as many molecules as the one at place n (from 0); ties stay."""
    at = ranked(cells).where(F.col("rank") == n + 1).select(F.col("n").alias("_t"))
    return cells.crossJoin(F.broadcast(at)).where("n >= _t").drop("_t")  # a single number


def knee(cells: DataFrame, expected: int = 3000, percentile: float = 0.99, ratio: float = 10.0) -> DataFrame:
    """Cells with n >= max(1, round(robust maximum / ratio)); robust maximum: n at rank round(expected * (1 - p))."""
    place = round(expected * (1 - percentile))
    at = ranked(cells).where(F.col("rank") == place + 1).select(F.greatest(F.lit(1), F.floor(F.col("n") / ratio + 0.5)).alias("_t"))
    return cells.crossJoin(F.broadcast(at)).where("n >= _t").drop("_t")  # a single number


def low_umi(cells: DataFrame, least: int | None = None, of_median: float | None = None) -> DataFrame:
    """cells of at least ``least`` molecules, or that share of the median."""
    if least is not None:
        return cells.where(F.col("n") >= least)
    at = cells.agg((F.percentile("n", F.lit(0.5)) * of_median).alias("_t"))
    return cells.crossJoin(F.broadcast(at)).where("n >= _t").drop("_t")  # a single number


def candidates(cells: DataFrame, simple: int, most: int, least: int) -> DataFrame:
    """Ranks after the simple cells, up to ``most``, while n >= least."""
    return ranked(cells).where((F.col("rank") > simple) & (F.col("rank") <= most) & (F.col("n") >= least))


def ambient(matrix: DataFrame, cells: DataFrame, low: int, high: int) -> DataFrame:
    """Gene, count, share over the cells with rank in (low, high]."""
    chosen = ranked(cells).where((F.col("rank") > low) & (F.col("rank") <= high)).select("cb")
    per = matrix.join(chosen, "cb", "left_semi").groupBy("gene").agg(F.sum("n").alias("count"))
    total = per.agg(F.sum("count").alias("_all"))
    return per.crossJoin(F.broadcast(total)).select("gene", "count", (F.col("count") / F.col("_all")).alias("share"))  # a single number


def log_probability(matrix: DataFrame, profile: DataFrame) -> DataFrame:
    """Cb, total, multinomial log probability of its counts under the profile (gene, share); genes without share are
    left out of both."""
    known = matrix.join(profile.where("share > 0").select("gene", "share"), "gene")
    per = known.groupBy("cb").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("share") - log_factorial(F.col("n"))).alias("_s"))
    return per.select("cb", "total", (F.col("_s") + log_factorial(F.col("total"))).alias("logp"))


def simulate(profile: np.ndarray, totals: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Rounds x totals log probabilities; in each round one multinomial grows through the sorted totals."""
    order = np.argsort(totals)
    out = np.empty((rounds, len(totals)))
    logs = np.log(profile)
    lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(totals.max(initial=0)) + 1)))])
    for r in range(rounds):
        rng, counts, at = np.random.default_rng([seed, r]), np.zeros(len(profile), np.int64), 0
        for k in order:
            if totals[k] > at:
                counts += rng.multinomial(int(totals[k] - at), profile)
                at = int(totals[k])
            out[r, k] = (counts * logs).sum() - lf[counts].sum() + lf[at]
    return out


def empty_drops(matrix: DataFrame, profile: DataFrame, tested: DataFrame, rounds: int = 1000, seed: int = 19760110, batch: int = 25) -> DataFrame:
    """Cb, total, logp, p, p_adjusted of the tested cells. Simulated rounds are dealt over the tasks; a task returns for
    each distinct total how many of its rounds lie below each observed value. The profile (genes) and the distinct totals
    (at most the molecules of the largest cell) are what the tasks get."""
    spark = matrix.sparkSession
    seen = log_probability(matrix.join(tested.select("cb"), "cb", "left_semi"), profile)
    shares = [r.share for r in profile.where("share > 0").orderBy("gene").select("share").collect()]
    sizes = [r.total for r in seen.select("total").distinct().orderBy("total").collect()]

    def kernel(it):
        p = np.array(shares) / sum(shares)
        for pdf in it:
            for r in pdf["id"]:
                v = simulate(p, np.array(sizes), 1, seed + int(r))[0]
                yield pd.DataFrame({"total": sizes, "sim": v})

    if not sizes:
        return seen.withColumn("p", F.lit(None).cast("double")).withColumn("p_adjusted", F.lit(None).cast("double"))
    sims = spark.range(0, rounds, 1, max(1, rounds // batch)).mapInPandas(kernel, "total bigint, sim double")
    by = sims.groupBy("total").agg(F.sort_array(F.collect_list("sim")).alias("sims"))  # rounds values for each total
    p = seen.join(by, "total").withColumn("p", (1 + F.size(F.filter("sims", lambda x: x < F.col("logp")))) / F.lit(1.0 + rounds)).drop("sims")
    return adjust(p)


def adjust(tested: DataFrame) -> DataFrame:
    """Benjamini-Hochberg p_adjusted: the running minimum, from the largest p, of p * n / rank. The windows run over one
    row for each distinct p."""
    by = tested.groupBy("p").agg(F.count("*").alias("_m"))
    up = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("_rank", F.sum("_m").over(up)).withColumn("_n", F.sum("_m").over(everything))
    down = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumn("p_adjusted", F.least(F.lit(1.0), F.min(F.col("p") * F.col("_n") / F.col("_rank")).over(down)))
    return tested.join(by.select("p", "p_adjusted"), "p")


def good_turing(counts: pd.Series, linear: bool = True) -> np.ndarray:
    """Share of each gene (0 counts included): Good-Turing, with the unseen mass N1/N shared equally. linear: the
    frequencies of frequencies are smoothed by a log-log line."""
    c = counts.to_numpy().astype(np.int64)
    total, zero = c.sum(), int((c == 0).sum())
    r, n = np.unique(c[c > 0], return_counts=True)
    if total == 0 or not len(r):
        return np.full(len(c), 1 / max(1, len(c)))
    p0 = (n[r == 1].sum() / total) if zero else 0.0
    p0 = min(p0, 1 - 1e-9)
    star = r.astype(float)
    if linear and len(r) > 2:
        z = np.empty(len(r))
        for i in range(len(r)):
            low = r[i - 1] if i else 0
            high = r[i + 1] if i + 1 < len(r) else 2 * r[i] - low
            z[i] = 2 * n[i] / (high - low)
        slope = np.polyfit(np.log(r), np.log(z), 1)[0]
        if slope < -1:
            star = r * (1 + 1 / r) ** (slope + 1)
    value = dict(zip(r, star, strict=True))
    raw = np.array([value.get(x, 0.0) for x in c])
    out = (1 - p0) * raw / raw.sum()
    out[c == 0] = p0 / zero if zero else 0
    return out


def order_of_magnitude(cells: DataFrame, grid: int = 2000, quantile: float = 0.99, ratio: float = 0.1, most: int = 45000) -> DataFrame:
    """M16 core: recovered, baseline, cutoff: of ``grid`` log2-spaced numbers of cells r the one that least misses the
    number f of cells with n within an order of magnitude of the (1 - quantile) place: least (f - r)^2 / r."""
    steps = [round(x) for x in np.unique(np.round(2 ** np.linspace(1, math.log2(most), grid)).astype(int))]
    r = ranked(cells)
    trial = cells.sparkSession.createDataFrame([(s, max(1, round(s * (1 - quantile)))) for s in steps], "r int, place int")
    base = trial.join(r.select(F.col("rank").cast("int").alias("place"), F.col("n").alias("baseline")), "place")
    base = base.withColumn("cutoff", F.greatest(F.lit(1), F.floor(F.col("baseline") * ratio + 0.5)))
    # cells at or above each cutoff: a running count over the distinct counts
    by = cells.groupBy("n").agg(F.count("*").alias("m")).unionByName(base.select(F.col("cutoff").cast("bigint").alias("n")).distinct().withColumn("m", F.lit(0).cast("bigint")))
    at = by.groupBy("n").agg(F.sum("m").alias("m")).withColumn("f", F.sum("m").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)))
    loss = base.join(at.select(F.col("n").alias("cutoff"), "f"), "cutoff").withColumn("loss", F.pow(F.col("f") - F.col("r"), 2) / F.col("r"))
    return loss.orderBy("loss", "r").limit(1).select(F.col("f").alias("recovered"), "baseline", "cutoff")


def simple_fallback(n_ambient: int, n_candidates: int, n_rescued: int, least: tuple[int, int, int] = (100, 100, 50)) -> bool:
    """Whether the Monte-Carlo test is given up for the order-of-magnitude cells."""
    return n_ambient < least[0] or n_candidates < least[1] or n_rescued < least[2]


def share_expected(cells: DataFrame, expected: int, quantile: float = 0.95) -> DataFrame:
    """Tag, expected cells: by the tags' molecules, cells above the tag's quantile counted as that."""
    top = cells.groupBy("tag").agg(F.percentile("n", F.lit(quantile)).alias("_top"))
    per = cells.join(top, "tag").groupBy("tag").agg(F.sum(F.least(F.col("n").cast("double"), F.col("_top"))).alias("_w"))
    all_ = per.agg(F.sum("_w").alias("_all"))
    return per.crossJoin(F.broadcast(all_)).select("tag", (F.lit(float(expected)) * F.col("_w") / F.col("_all")).alias("expected"))  # a single number


def occupancy_threshold(tags_per_gem: float, partitions: int, rounds: int = 1_000_000, percentile: float = 0.999, tags: int = 4, seed: int = 1) -> int:
    """The percentile of distinct tags in simulated non-empty partitions: Poisson(tags_per_gem) cells of random tags."""
    rng = np.random.default_rng(seed)
    n = rng.poisson(tags_per_gem, rounds)
    n = n[n > 0]
    held = np.zeros((len(n), tags), bool)
    for k in range(int(n.max(initial=0))):
        live = np.flatnonzero(n > k)
        held[live, rng.integers(0, tags, len(live))] = True
    return int(np.ceil(np.quantile(held.sum(1), percentile))) if len(n) else 0


def tags_per_gem(cells: DataFrame, partitions: int = 115000, recovery: float = 0.6) -> DataFrame:
    """One row, rate: cells for each GEM that could be seen, partitions * recovery of them (the seen ones at least). cells: gem,
    tag."""
    per = cells.groupBy("gem").agg(F.count("*").alias("k"))
    n = F.count("*")
    return per.agg((F.sum("k") / F.greatest(n, F.lit(int(partitions * recovery)))).alias("rate"))


def hash_occupancy(cells: DataFrame, partitions: int = 115000, percentile: float = 0.999, letters: int = 16) -> DataFrame:
    """M18, the other mode: cells (cb) of partitions (a hash of the barcode's first letters) with more cells than the percentile
    of the occupied ones go."""
    placed = cells.withColumn("_p", hash31(F.substring(F.col("cb").cast("string"), 1, letters), partitions))
    per = placed.groupBy("_p").agg(F.count("*").alias("_k"))
    most = per.agg(F.percentile("_k", F.lit(percentile)).alias("_most"))
    full = per.crossJoin(F.broadcast(most)).where(F.col("_k") > F.col("_most")).select("_p")  # a single number
    return placed.join(full, "_p", "left_anti").drop("_p")


def remove_crowded(cells: DataFrame, threshold: int) -> DataFrame:
    """All cells of a GEM barcode with more tags than the threshold go. cells: gem, tag."""
    crowded = cells.groupBy("gem").agg(F.countDistinct("tag").alias("tags")).where(F.col("tags") > threshold).select("gem")
    return cells.join(crowded, "gem", "left_anti")


def passers(simple: DataFrame, tested: DataFrame) -> DataFrame:
    """U5."""
    return simple.select("cb").unionByName(tested.select("cb")).distinct()


def flex_empty_drops(matrix: DataFrame, totals: DataFrame, retain: int, ambient_most: int = 100, least: int = 500, p: float = 0.01, rounds: int = 10000, seed: int = 1) -> DataFrame:
    """Cb, p of the cells that pass. Ambient are the cells of at most ambient_most molecules within the first ``retain``; all
    genes get a Good-Turing share of them; candidates have at least ``least`` molecules; the gate is on p itself."""
    window = ranked(totals).where(F.col("rank") <= retain)
    low = matrix.join(window.where(F.col("n") <= ambient_most).select("cb"), "cb", "left_semi").groupBy("gene").agg(F.sum("n").alias("count"))
    genes = matrix.select("gene").distinct().join(low, "gene", "left").na.fill(0, ["count"]).orderBy("gene").toPandas()  # a row for each gene
    genes["share"] = good_turing(genes["count"])
    profile = matrix.sparkSession.createDataFrame(genes[["gene", "share"]])
    tested = empty_drops(matrix, profile, window.where(F.col("n") >= least), rounds, seed)
    return tested.where(F.col("p") <= p).select("cb", "p")


def filter_samples(matrix: DataFrame, expected: int, retain: int = 80000, crowded: int | None = None, least: tuple[int, int, int] = (100, 100, 50), **how) -> DataFrame:
    """Gem, tag, molecules of the cells called in each sample tag. matrix: gem, tag, gene, n. A tag's cells are those
    of the order-of-magnitude call and, unless too few cells could be tested or were rescued, those that pass the test; cells of
    crowded GEM barcodes go. The loop runs over the tags, of which an assay has a few."""
    m = matrix.withColumn("cb", F.concat_ws("-", "gem", "tag"))
    total = m.groupBy("gem", "tag", "cb").agg(F.sum("n").alias("n"))
    out = None
    for tag in [r.tag for r in total.select("tag").distinct().orderBy("tag").collect()]:
        own, mine = total.where(F.col("tag") == tag), m.where(F.col("tag") == tag)
        cut = order_of_magnitude(own.select("cb", "n"), most=max(2, expected)).first()
        simple = own.where(F.col("n") >= cut.cutoff)
        low, high = own.where("n <= 100").count(), own.where("n >= 500").count()
        called = simple.select("cb")
        if low >= least[0] and high >= least[1]:
            rescued = flex_empty_drops(mine.select("cb", "gene", "n"), own.select("cb", "n"), retain, **how).select("cb").join(called, "cb", "left_anti")
            if not simple_fallback(low, high, rescued.count(), least):
                called = passers(called, rescued)
        part = own.join(called, "cb", "left_semi")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return total.select("gem", "tag", "n").limit(0)
    return (remove_crowded(out, crowded) if crowded is not None else out).select("gem", "tag", "n")


def sample_summary(called: DataFrame) -> DataFrame:
    """Tag, cells, molecules, with a TOTAL row."""
    return called.rollup("tag").agg(F.count("*").alias("cells"), F.sum("n").alias("molecules")).select(F.coalesce(F.col("tag").cast("string"), F.lit("TOTAL")).alias("tag"), "cells", "molecules")


def sample_table(stages: DataFrame, molecules: DataFrame, expected: DataFrame) -> DataFrame:
    """Sample, Expected, Retain, Simple_ED, Tail_Tested, ED_Pass, Occ_Rem, Final, Total_UMIs, and a TOTAL row. stages: sample,
    cb, and whether the cell was retained, simple, tested, passed and crowded; molecules: sample, cb, n; expected: sample,
    expected."""
    n = lambda c: F.count(F.when(c, 1))
    final = F.col("passed") & ~F.col("crowded")
    s = stages.join(molecules, ["sample", "cb"], "left")
    per = s.groupBy("sample").agg(n(F.col("retained")).alias("Retain"), n(F.col("simple")).alias("Simple_ED"), n(F.col("tested")).alias("Tail_Tested"), n(F.col("passed")).alias("ED_Pass"), n(F.col("passed") & F.col("crowded")).alias("Occ_Rem"), n(final).alias("Final"), F.coalesce(F.sum(F.when(final, F.col("n"))), F.lit(0)).alias("Total_UMIs"))
    per = per.join(expected.select("sample", F.col("expected").alias("Expected")), "sample").withColumn("Sample", F.col("sample").cast("string"))
    names = ["Expected", "Retain", "Simple_ED", "Tail_Tested", "ED_Pass", "Occ_Rem", "Final", "Total_UMIs"]
    total = per.agg(*[F.sum(c).alias(c) for c in names]).withColumn("Sample", F.lit("TOTAL"))
    return per.select("Sample", *names).unionByName(total.select("Sample", *names))
