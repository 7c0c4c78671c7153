"""Feature barcodes and guide calls."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .barcodes import neighbourhood


def match_features(reads: DataFrame, features: DataFrame, offsets: list[int], length: int, distance: int = 1) -> DataFrame:
    """Read, feature, distance of the best match at any offset (1-based); several best features give none.
    features: feature, sequence, all of ``length``. Equi-joins with the features and their neighbourhood, which holds about
    (4 * length) ** distance / distance! sequences a feature."""
    exact = features.select(F.col("sequence").alias("k"), "feature", F.lit(0).alias("distance"))
    near = exact
    for d in range(1, distance + 1):
        # one more letter changed; the least number of changes counts
        hood = neighbourhood(near.select(F.col("k").alias("cb")).distinct(), "cb", "ACGTN").select("variant", F.col("cb").alias("k"))
        wider = near.where(F.col("distance") == d - 1).join(hood, "k").select(F.col("variant").alias("k"), "feature", F.lit(d).alias("distance"))
        near = near.unionByName(wider).groupBy("k", "feature").agg(F.min("distance").alias("distance"))
    tried = reads.select("read", F.explode(F.array_distinct(F.array(*[F.substring("seq", o, length) for o in offsets]))).alias("k"))
    hit = tried.join(near, "k").groupBy("read", "feature").agg(F.min("distance").alias("distance"))
    best = hit.withColumn("_b", F.min("distance").over(Window.partitionBy("read"))).where("distance = _b")
    return best.withColumn("_n", F.count("*").over(Window.partitionBy("read"))).where("_n = 1").drop("_b", "_n")


def detect_offset(reads: DataFrame, features: DataFrame, length: int, most: int, least: float = 0.5) -> int:
    """The offset at which most reads hold a feature; raises where no offset has that share of the hits."""
    places = reads.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda o: F.substring(F.col("seq"), o, F.lit(length)))).alias("o", "k"))
    rows = places.join(features.select(F.col("sequence").alias("k")), "k").groupBy("o").count().orderBy(F.desc("count"), "o").collect()  # ``most`` rows at most
    if not rows or rows[0]["count"] < least * sum(r["count"] for r in rows):
        raise ValueError("no single offset")
    return rows[0]["o"] + 1


def clique_counts(molecules: DataFrame, stringency: int = 0, least: int = 0) -> DataFrame:
    """Cb, feature, n. Components of tags at distance 1 in a cell, across features; 0: every feature with more reads
    than ``least`` gets one; up to 999: the one feature with more than stringency/1000 of the reads and more than
    ``least`` of them; above: components of one feature only. molecules: cb, umi, feature, n."""
    from .umi import _labels

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        umis = sorted(g["umi"].unique())
        root = dict(zip(umis, _labels(umis), strict=True))
        per = g.assign(root=g["umi"].map(root)).groupby(["root", "feature"], as_index=False)["n"].sum()
        out = []
        for _, c in per.groupby("root"):
            total = c["n"].sum()
            if stringency == 0:
                out += c.loc[c["n"] > least, "feature"].tolist()
            elif stringency >= 1000:
                if len(c) == 1 and total > least:
                    out.append(c["feature"].iloc[0])
            elif total > least:
                top = c[c["n"] == c["n"].max()]
                if len(top) == 1 and top["n"].iloc[0] > total * stringency / 1000:
                    out.append(top["feature"].iloc[0])
        n = pd.Series(out, dtype=object).value_counts()
        return pd.DataFrame({"cb": g["cb"].iloc[0], "feature": n.index, "n": n.to_numpy("int64")})

    kinds = dict(molecules.dtypes)
    return molecules.groupBy("cb").applyInPandas(kernel, f"cb {kinds['cb']}, feature {kinds['feature']}, n bigint")


def dominant(counts: DataFrame, least: int = 2, fraction: float = 0.8, margin: int = 1) -> DataFrame:
    """Cb, call (null unless assigned), status: None, Assigned or Ambiguous. The fraction is of all counts."""
    w = Window.partitionBy("cb")
    r = counts.where("n > 0").withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "feature")))
    per = r.groupBy("cb").agg(F.max(F.when(F.col("_r") == 1, F.col("n"))).alias("top"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("n"))), F.lit(0)).alias("second"), F.max(F.when(F.col("_r") == 1, F.col("feature"))).alias("feature"), F.sum("n").alias("total"))
    status = F.when(F.col("top") < least, "None").when((F.col("top") >= fraction * F.col("total")) & (F.col("top") - F.col("second") >= margin), "Assigned").otherwise("Ambiguous")
    return per.select("cb", F.when(status == "Assigned", F.col("feature")).alias("call"), status.alias("status"))


def two_gaussians(x: np.ndarray, starts: int = 10, rounds: int = 100, tol: float = 1e-3, seed: int = 0) -> np.ndarray:
    """Posterior of the higher of two normal components of one variance, the best of several starts."""
    rng, best = np.random.default_rng(seed), None
    for s in range(starts):
        mu = np.quantile(x, [0.25, 0.95]) if s == 0 else rng.choice(x, 2)
        var, pi, last = max(float(x.var()), 1e-6), np.array([0.5, 0.5]), -np.inf
        for _ in range(rounds):
            ll = np.log(pi) - 0.5 * (np.log(2 * math.pi * var) + (x[:, None] - mu) ** 2 / var)
            top = ll.max(1, keepdims=True)
            lse = top[:, 0] + np.log(np.exp(ll - top).sum(1))
            resp = np.exp(ll - lse[:, None])
            total = resp.sum(0)
            mu, pi = (resp * x[:, None]).sum(0) / np.maximum(total, 1e-12), np.maximum(total / len(x), 1e-12)
            var = max(float((resp * (x[:, None] - mu) ** 2).sum() / len(x)), 1e-6)
            if abs(lse.sum() - last) < tol:
                break
            last = lse.sum()
        if best is None or lse.sum() > best[0]:
            best = (lse.sum(), resp[:, int(mu.argmax())], abs(mu[0] - mu[1]))
    return best[1] if best[2] > 0 else np.zeros(len(x))


def gmm_calls(counts: DataFrame, cells: DataFrame, least: int = 3, seed: int = 0) -> DataFrame:
    """Feature, cb, n, threshold of the positive cells. All cells count, those without the feature at 0: their number
    is what a feature's task gets, not their rows."""
    n_cells = cells.select("cb").distinct().count()

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cb")
        x = np.log10(1 + np.concatenate([g["n"].to_numpy(float), np.zeros(max(0, n_cells - len(g)))]))
        hit = (two_gaussians(x, seed=seed)[: len(g)] > 0.5) & (g["n"].to_numpy() >= least)
        out = g.loc[hit, ["feature", "cb", "n"]]
        return out.assign(threshold=out["n"].min() if len(out) else 0)

    kinds = dict(counts.dtypes)
    return counts.groupBy("feature").applyInPandas(kernel, f"feature {kinds['feature']}, cb {kinds['cb']}, n bigint, threshold bigint")


def poisson_fit(y: np.ndarray, design: np.ndarray, w: np.ndarray, offset: np.ndarray, start: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weighted Poisson regression by iterated least squares."""
    beta = start.copy()
    for _ in range(rounds):
        eta = np.clip(design @ beta + offset, -20, 20)
        mu = np.exp(eta)
        a = design.T @ (design * (w * mu)[:, None]) + 1e-8 * np.eye(design.shape[1])
        step = np.linalg.solve(a, design.T @ (w * (y - mu)))
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def poisson_mixture(y: np.ndarray, covariates: np.ndarray, phi: float | None = None, rounds: int = 50) -> np.ndarray:
    """Posterior of the shifted component: background Poisson (or, with dispersion phi, negative binomial) regression on
    an intercept and log1p covariates, and the same times exp(delta), delta in [-5, 10], halved up to 6 times where a
    step lowers the likelihood."""
    d = np.column_stack([np.ones(len(y)), np.log1p(covariates)]) if covariates.size else np.ones((len(y), 1))
    lg = np.array([math.lgamma(v + 1) for v in y])

    def log_pmf(mu: np.ndarray) -> np.ndarray:
        if phi is None:
            return y * np.log(mu) - mu - lg
        return np.array([math.lgamma(v + phi) for v in y]) - math.lgamma(phi) - lg + phi * np.log(phi / (phi + mu)) + y * np.log(mu / (phi + mu))

    def loglik(b: np.ndarray, dl: float, q: float):
        mu = np.exp(np.clip(d @ b, -20, 20))
        parts = np.column_stack([np.log1p(-q) + log_pmf(mu), np.log(q) + log_pmf(mu * math.exp(dl))])
        top = parts.max(1, keepdims=True)
        lse = top[:, 0] + np.log(np.exp(parts - top).sum(1))
        return float(lse.sum()), np.exp(parts[:, 1] - lse)

    beta = poisson_fit(y, d, np.ones(len(y)), np.zeros(len(y)), np.concatenate([[math.log(max(float(np.median(y)), 0.1))], np.zeros(d.shape[1] - 1)]))
    delta, q = 2.0, 0.05
    ll, r = loglik(beta, delta, q)
    for _ in range(rounds):
        q2 = min(max(float(r.mean()), 1e-6), 0.5)
        mu = np.exp(np.clip(d @ beta, -20, 20))
        d2 = min(10.0, max(-5.0, math.log(max((r * y).sum(), 1e-9) / max((r * mu).sum(), 1e-9))))
        b2 = poisson_fit(y, d, np.ones(len(y)), np.log1p(r * (math.exp(d2) - 1)), beta, 5)
        scale = 1.0
        for _half in range(6):
            b3, d3 = beta + scale * (b2 - beta), delta + scale * (d2 - delta)
            new, r3 = loglik(b3, d3, q2)
            if new >= ll:
                break
            scale /= 2
        done = abs(new - ll) < 1e-6 * max(1.0, abs(ll))
        beta, delta, q, ll, r = b3, d3, q2, new, r3
        if done:
            break
    return r if delta > 0 else 1 - r


def mixture_calls(counts: DataFrame, covariates: DataFrame, kind: str = "poisson", posterior: float = 0.8, fallback: int = 5) -> DataFrame:
    """Feature, cb, n, posterior of the positive cells. covariates: cb and number columns, one row for each cell. A feature's
    task gets its cells; a fit that fails falls back to n >= fallback."""
    names = [c for c in covariates.columns if c != "cb"]
    features = counts.select("feature").distinct()
    full = features.crossJoin(covariates).join(counts, ["feature", "cb"], "left").na.fill(0, ["n"])  # every cell counts for every feature

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cb")
        y = g["n"].to_numpy(float)
        try:
            phi = None
            if kind == "nb":
                mean, var = y.mean(), y.var(ddof=1)
                phi = 1e4 if mean == 0 or var <= mean else min(max(mean * mean / (var - mean), 1e-3), 1e4)
            p = poisson_mixture(y, g[names].to_numpy(float), phi)
            if not np.isfinite(p).all():
                raise FloatingPointError
            hit = (p >= posterior) & (y > 0)
        except (np.linalg.LinAlgError, FloatingPointError, ValueError):
            p = (y >= fallback).astype(float)
            hit = y >= fallback
        return g.loc[hit, ["feature", "cb", "n"]].assign(posterior=p[hit])

    kinds = dict(counts.dtypes)
    return full.groupBy("feature").applyInPandas(kernel, f"feature {kinds['feature']}, cb {kinds['cb']}, n bigint, posterior double")


def calls_per_cell(positive: DataFrame) -> DataFrame:
    """K17/M22 high: cb, num_features, feature_call, num_umis, each list joined by '|' in order of features."""
    x = F.array_sort(F.collect_list(F.struct(F.col("feature").cast("string").alias("f"), F.col("n").cast("string").alias("n"))))
    return positive.groupBy("cb").agg(x.alias("x")).select("cb", F.size("x").alias("num_features"), F.array_join(F.transform("x", lambda a: a["f"]), "|").alias("feature_call"), F.array_join(F.transform("x", lambda a: a["n"]), "|").alias("num_umis"))


def low_moi(positive: DataFrame, margin: float = 0.05) -> DataFrame:
    """M22 low: cb, call: the most probable feature; Multiplet where the next is closer than the margin."""
    w = Window.partitionBy("cb").orderBy(F.desc("posterior"), "feature")
    r = positive.withColumn("_r", F.row_number().over(w)).withColumn("_s", F.lead("posterior").over(w)).where("_r = 1")
    return r.select("cb", F.when(F.col("posterior") - F.col("_s") < margin, F.lit("Multiplet")).otherwise(F.col("feature").cast("string")).alias("call"))


def call_summary(calls: DataFrame) -> DataFrame:
    """Call, cells, percent, median molecules. calls: call, n."""
    all_ = calls.agg(F.count("*").alias("_all"))
    per = calls.groupBy("call").agg(F.count("*").alias("cells"), F.percentile("n", F.lit(0.5)).alias("median_umis"))
    return per.crossJoin(F.broadcast(all_)).select("call", "cells", (100.0 * F.col("cells") / F.col("_all")).alias("percent"), "median_umis")  # a single number


def multiplicity(counts: DataFrame, cells: DataFrame, least: int = 1) -> DataFrame:
    """p0, lambda = -ln p0, expected and observed share of cells with several features."""
    per = cells.select("cb").distinct().join(counts.where(F.col("n") >= least).groupBy("cb").agg(F.count("*").alias("k")), "cb", "left").na.fill(0, ["k"])
    a = per.agg((F.count(F.when(F.col("k") == 0, 1)) / F.count("*")).alias("p0"), (F.count(F.when(F.col("k") > 1, 1)) / F.count("*")).alias("observed_multi"))
    lam = -F.log("p0")
    return a.select("p0", lam.alias("lambda"), (1 - F.col("p0") - lam * F.col("p0")).alias("expected_multi"), "observed_multi")


def dispersion(counts: DataFrame, most: float = 1e4, least: float = 1e-3) -> DataFrame:
    """phi = mean^2 / (variance - mean), clamped; the largest where that isn't over-dispersed."""
    m, v = F.avg("n"), F.var_samp("n")
    return counts.agg(F.when((m > 0) & (v > m), F.least(F.lit(most), F.greatest(F.lit(least), m * m / (v - m)))).otherwise(F.lit(most)).alias("phi"))


def feature_totals(counts: DataFrame, raw: DataFrame) -> DataFrame:
    """Feature, deduplicated and raw totals."""
    return counts.groupBy("feature").agg(F.sum("n").alias("molecules")).join(raw.groupBy("feature").agg(F.sum("n").alias("reads")), "feature", "full").na.fill(0)


def umi_histogram(counts: DataFrame) -> DataFrame:
    """A48."""
    return counts.groupBy("feature", "n").agg(F.count("*").alias("cells"))
