"""Nucleotide-conversion quantification."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conversions(bases: DataFrame) -> DataFrame:
    """Read, n_t, k: T>C on the forward strand, A>G on the reverse. bases: read, strand, ref, alt."""
    plus = F.col("strand") == "+"
    at = F.when(plus, F.col("ref") == "T").otherwise(F.col("ref") == "A")
    hit = at & F.when(plus, F.col("alt") == "C").otherwise(F.col("alt") == "G")
    return bases.groupBy("read").agg(F.count(F.when(at, 1)).alias("n_t"), F.count(F.when(hit, 1)).alias("k"))


def histogram(reads: DataFrame) -> DataFrame:
    """Gene, n_t, k, w. reads: gene, n_t, k, w."""
    return reads.groupBy("gene", "n_t", "k").agg(F.sum("w").alias("w"))


def gene_totals(hist: DataFrame) -> DataFrame:
    """Gene, reads, conversions, coverage."""
    return hist.groupBy("gene").agg(F.sum("w").alias("reads"), F.sum(F.col("w") * F.col("k")).alias("conversions"), F.sum(F.col("w") * F.col("n_t")).alias("coverage"))


def transitions(bases: DataFrame, category: str = "category") -> DataFrame:
    """Category, ref, alt, w, with totals over alt and over ref and alt (nulls)."""
    return bases.rollup(category, "ref", "alt").agg(F.sum("w").alias("w")).where(F.col(category).isNotNull())


def pileup(bases: DataFrame) -> DataFrame:
    """Chr, pos, n, k. bases: chr, pos, mismatch (boolean)."""
    return bases.groupBy("chr", "pos").agg(F.count("*").alias("n"), F.count(F.when(F.col("mismatch"), 1)).alias("k"))


def position_quality(bases: DataFrame) -> DataFrame:
    """Pos, n, mean and population deviation of quality and of the conversion indicator."""
    return bases.groupBy("pos").agg(F.count("*").alias("n"), F.avg("qual").alias("mean_qual"), F.stddev_pop("qual").alias("sd_qual"), F.avg("hit").alias("rate"), F.stddev_pop("hit").alias("sd_rate"))


def error_rate(bases: DataFrame, trim5: Column | int, trim3: Column | int) -> DataFrame:
    """Conversions over covered positions between the trims; none count where the trims meet."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    inside = (as_col(trim5) + as_col(trim3) < F.col("length")) & (F.col("pos") >= as_col(trim5)) & (F.col("pos") < F.col("length") - as_col(trim3))
    return bases.where(inside).agg((F.sum("hit") / F.count("*")).alias("rate"))


def solve(n_t: np.ndarray, k: np.ndarray, w: np.ndarray, p_err: float = 0.001, p_conv: float = 0.05, start: float = 0.1, rounds: int = 1000, tol: float = 1e-6) -> tuple[float, float, float]:
    """M1: new-to-total ratio, its deviation and log likelihood of a two-binomial mixture."""
    old = k * math.log(p_err) + (n_t - k) * math.log1p(-p_err)
    new = k * math.log(p_conv) + (n_t - k) * math.log1p(-p_conv)
    choose = np.array([math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1) for a, b in zip(n_t, k, strict=True)])
    pi, last, total = start, -np.inf, w.sum()
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            a, b = np.log(1 - pi) + old, np.log(pi) + new
        top = np.maximum(a, b)
        lse = top + np.log(np.exp(a - top) + np.exp(b - top))
        ll = float((w * (lse + choose)).sum())
        nxt = float((w * np.exp(b - lse)).sum() / total)
        done = abs(nxt - pi) < tol and abs(ll - last) < tol
        pi, last = nxt, ll
        if done:
            break
    return pi, math.sqrt(max(pi * (1 - pi), 0) / total), last


def new_to_total(hist: DataFrame, p_err: float = 0.001, p_conv: float = 0.05) -> DataFrame:
    """M1: gene, reads, ntr, sigma, log_likelihood. A gene's histogram has at most (n_t, k) cells, whatever its reads."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_t", "k"])
        pi, sigma, ll = solve(g["n_t"].to_numpy(), g["k"].to_numpy(), g["w"].to_numpy(float), p_err, p_conv)
        return pd.DataFrame({"gene": [g["gene"].iloc[0]], "reads": [g["w"].sum()], "ntr": [pi], "sigma": [sigma], "log_likelihood": [ll]})

    return hist.groupBy("gene").applyInPandas(kernel, "gene string, reads double, ntr double, sigma double, log_likelihood double")


def snp_knee(sites: DataFrame, least_cover: int = 10, bins: int = 100, least_sites: int = 1000, weak: float = 0.02, fallback: float = 0.22, low: float = 0.10, high: float = 0.60) -> DataFrame:
    """One row: threshold. Sites of enough cover are binned by k / n; of the log1p of the number of sites at or
    above each bin, scaled to [0, 1], the bin with the largest y + x - 1 is the knee; few sites or a weak knee fall back."""
    hist = sites.where((F.col("n") >= least_cover) & (F.col("k") > 0)).withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("k") / F.col("n") * bins)).cast("int")).groupBy("bin").agg(F.count("*").alias("m"))
    all_bins = sites.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = all_bins.join(hist, "bin", "left").na.fill(0, ["m"])
    down = full.withColumn("c", F.log1p(F.sum("m").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)).cast("double")))
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lo, hi = F.min("c").over(whole), F.max("c").over(whole)
    y = F.when(hi > lo, (F.col("c") - lo) / (hi - lo)).otherwise(0.0)
    x = F.col("bin") / F.lit(bins - 1.0)
    d = down.withColumn("gain", y + x - 1).withColumn("sites", F.sum("m").over(whole))
    best = d.agg(F.max_by("bin", F.struct("gain", -F.col("bin"))).alias("bin"), F.max("gain").alias("gain"), F.max("sites").alias("sites"))
    value = F.when((F.col("sites") < least_sites) | (F.col("gain") < weak), F.lit(fallback)).otherwise((F.col("bin") + 0.5) / bins)
    return best.select(F.least(F.lit(high), F.greatest(F.lit(low), value)).alias("threshold"), "sites")


def snp_em(sites: DataFrame, rounds: int = 50, tol: float = 1e-7, posterior: float = 0.99) -> tuple[dict[str, float], DataFrame]:
    """M3: sites with posterior of the heterozygous or homozygous component >= posterior, and the parameters.

    The EM runs on the histogram of (n, k), whose size is bounded by the coverage, not the sites."""
    hist = sites.groupBy("n", "k").agg(F.count("*").alias("m")).toPandas()
    n, k, m = (hist[c].to_numpy(float) for c in ("n", "k", "m"))
    quiet = k / np.maximum(n, 1) <= 0.01
    err = min(max((k[quiet] * m[quiet]).sum() / max((n[quiet] * m[quiet]).sum(), 1), 1e-6), 0.1) if len(n) else 0.001
    pi, p, last = np.array([0.999, 0.0009, 0.0001]), np.array([err, 0.5, 0.95]), None
    for _ in range(rounds):
        ll = np.log(pi) + k[:, None] * np.log(p) + (n - k)[:, None] * np.log1p(-p)
        top = ll.max(1, keepdims=True)
        lse = top[:, 0] + np.log(np.exp(ll - top).sum(1))
        resp = np.exp(ll - lse[:, None]) * m[:, None]
        total = float((lse * m).sum())
        pi = np.maximum(resp.sum(0) / max(m.sum(), 1), 1e-12)
        p[0] = min(max((resp[:, 0] * k).sum() / max((resp[:, 0] * n).sum(), 1e-12), 1e-6), 0.1)
        if last is not None and abs(total - last) <= tol * abs(last):
            break
        last = total
    part = [F.lit(math.log(a)) + F.col("k") * F.lit(math.log(b)) + (F.col("n") - F.col("k")) * F.lit(math.log1p(-b)) for a, b in zip(pi, p, strict=True)]
    top = F.greatest(*part)
    norm = sum((F.exp(x - top) for x in part[1:]), F.exp(part[0] - top))
    scored = sites.withColumn("posterior", 1 - F.exp(part[0] - top) / norm)
    return {"p_err": float(p[0]), "pi_err": float(pi[0]), "pi_het": float(pi[1]), "pi_hom": float(pi[2])}, scored.where(F.col("posterior") >= posterior)


def min_alt_counts(spark, p_err: float, p_value: float, most: int = 1024) -> DataFrame:
    """M4: n, least_k: the least k whose upper binomial tail is below the p-value, for every cover up to ``most``."""
    rows = []
    for n in range(1, most + 1):
        log_pmf = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p_err) + (n - i) * math.log1p(-p_err) for i in range(n + 1)]
        tail = np.cumsum(np.exp(log_pmf)[::-1])[::-1]
        hit = np.flatnonzero(tail < p_value)
        rows.append((n, int(hit[0]) if len(hit) else n + 1))
    return spark.createDataFrame(rows, "n bigint, least_k int")


def snp_binomial(sites: DataFrame, p_err: float = 0.001, p_value: float = 1e-3, least_cover: int = 6, least_alt: int = 2, ratio: float = 0.2, most: int = 1024) -> DataFrame:
    """Sites of enough cover, alternatives and ratio whose tail is below the p-value; covers beyond the table are
    scaled down to its end."""
    lookup = F.broadcast(min_alt_counts(sites.sparkSession, max(p_err, 0.001), p_value, most).withColumnRenamed("n", "_n"))  # ``most`` rows
    kept = sites.where((F.col("n") >= least_cover) & (F.col("k") >= least_alt) & (F.col("k") / F.col("n") >= ratio)).withColumn("_n", F.least(F.col("n"), F.lit(most)).cast("bigint"))
    scaled = F.floor(F.col("k") * F.col("_n") / F.col("n"))
    return kept.join(lookup, "_n").where(scaled >= F.col("least_k")).drop("_n", "least_k")


def smooth(curve: DataFrame, keys: list[str], half: int = 2) -> DataFrame:
    """Median of the values at most ``half`` places away; nulls are left out."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-half, half) if keys else Window.orderBy("pos").rowsBetween(-half, half)
    return curve.withColumn("smooth", F.percentile("value", F.lit(0.5)).over(w))


def interpolate(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Null values between two others by the straight line; at the ends the nearest value."""
    base = Window.partitionBy(*keys).orderBy("pos") if keys else Window.orderBy("pos")
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("pos").alias("p"), F.col("value").alias("v")))
    before = F.last(known, True).over(base.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, True).over(base.rowsBetween(0, Window.unboundedFollowing))
    c = curve.withColumn("_a", before).withColumn("_b", after)
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("pos") - F.col("_a.p")) / (F.col("_b.p") - F.col("_a.p"))
    return c.withColumn("filled", F.coalesce("value", line, F.col("_a.v"), F.col("_b.v"))).drop("_a", "_b")


def two_segments(y: np.ndarray, least: int = 3) -> tuple[int | None, float, float]:
    """Break of the better two-line fit, BIC of one line, BIC of two; from prefix sums. None if one is better."""
    x = np.arange(len(y), dtype=float)
    ok = ~np.isnan(y)
    s = [np.concatenate([[0.0], np.cumsum(np.where(ok, v, 0.0))]) for v in (np.ones(len(y)), x, y, x * x, x * y, y * y)]

    def sse(a: int, b: int) -> float:
        n, sx, sy, sxx, sxy, syy = (v[b] - v[a] for v in s)
        if n < 2:
            return 0.0
        vx = sxx - sx * sx / n
        slope = (sxy - sx * sy / n) / vx if vx > 0 else 0.0
        return max(0.0, syy - sy * sy / n - slope * (sxy - sx * sy / n))

    n = int(ok.sum())
    bic = lambda e, k: n * math.log(max(e, 1e-12) / max(n, 1)) + k * math.log(max(n, 2))
    one = bic(sse(0, len(y)), 2)
    cuts = range(least, len(y) - least + 1)
    if not len(cuts):
        return None, one, math.inf
    best = min(cuts, key=lambda c: sse(0, c) + sse(c, len(y)))
    two = bic(sse(0, best) + sse(best, len(y)), 5)
    return (best if two < one else None), one, two


def auto_trim(curve: pd.DataFrame, reads: int, least_reads: int = 1000, most: int = 15, least: int = 3) -> tuple[int, int]:
    """trim5, trim3 from the deviation curve (pos, value): cropped to its non-zero part, zeros left out, smoothed, each
    half fitted with one or two lines."""
    c = curve.sort_values("pos")
    y = c["value"].to_numpy(float)
    nz = np.flatnonzero(y > 0)
    if reads < least_reads or len(nz) < 2 * least + 1:
        return 0, 0
    low, high = nz[0], nz[-1] + 1
    y = np.where(y == 0, np.nan, y)[low:high]
    with np.errstate(all="ignore"):
        med = np.array([np.nanmedian(y[max(0, i - 2) : i + 3]) if not np.isnan(y[max(0, i - 2) : i + 3]).all() else np.nan for i in range(len(y))])
    half = len(med) // 2
    if min((~np.isnan(med[:half])).sum(), (~np.isnan(med[half:])).sum()) < 2:
        return 0, 0
    left, right = two_segments(med[:half], least)[0], two_segments(med[half:], least)[0]
    size = len(c)
    trim5 = low + left if left is not None else low
    trim3 = size - 1 - (low + half + right) if right is not None else size - high
    return int(min(trim5, most)), int(min(max(trim3, 0), most))


def read_weights(aligns: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Value over its sum in the read; equal shares where that is 0."""
    w = Window.partitionBy(*keys)
    total = F.sum(value).over(w)
    return aligns.withColumn("weight", F.when(total > 0, F.col(value) / total).otherwise(1 / F.count("*").over(w)))


def top_positions(sites: DataFrame, n: int) -> DataFrame:
    """O5."""
    return sites.orderBy(F.desc("k"), "chr", "pos").limit(n)


def join_weights(dump: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Dumped reads with their external weights, by a hash of the key columns (and the columns themselves); 1 where there is
    none."""
    w = weights.select(*keys, "weight").withColumn("_h", F.xxhash64(*keys))
    return dump.drop("weight").withColumn("_h", F.xxhash64(*keys)).join(w, ["_h", *keys], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).drop("_h")


def base_composition(reads: DataFrame) -> DataFrame:
    """Mate, pos, a column for each base, mean quality. reads: mate, seq, qual."""
    each = reads.select("mate", F.posexplode(F.zip_with(F.split("seq", ""), F.split("qual", ""), lambda b, q: F.struct(b.alias("b"), (F.ascii(q) - 33).alias("q")))).alias("pos", "x"))
    return each.groupBy("mate", "pos").agg(*[F.count(F.when(F.col("x.b") == c, 1)).alias(c) for c in "ACGTN"], F.avg("x.q").alias("mean_qual"))


def requantify(dump: DataFrame, trim5: int, trim3: int, mask: DataFrame | None = None, **how) -> DataFrame:
    """Rates again from dumped bases (read, gene, strand, ref, alt, pos, length, chr, gpos, weight) with other trims or
    another mask; reads with a masked place go."""
    kept = dump.where((F.lit(trim5 + trim3) < F.col("length")) & (F.col("pos") >= trim5) & (F.col("pos") < F.col("length") - trim3))
    if mask is not None:
        bad = dump.join(mask.select("chr", F.col("pos").alias("gpos")), ["chr", "gpos"], "left_semi").select("read").distinct()
        kept = kept.join(bad, "read", "left_anti")
    per = conversions(kept).join(dump.groupBy("read").agg(F.min("gene").alias("gene"), F.min("weight").alias("w")), "read")
    return new_to_total(histogram(per), **how)
