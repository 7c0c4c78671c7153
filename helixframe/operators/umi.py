"""Molecule counting: deduplication modes and multi-gene rules (A7-A20). Input: cb, gene, umi, n (reads)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .barcodes import neighbourhood

GROUP = ["cb", "gene"]


def no_dedup(mol: DataFrame) -> DataFrame:
    """A7."""
    return mol.groupBy(GROUP).agg(F.sum("n").alias("count"))


def exact(mol: DataFrame) -> DataFrame:
    """Distinct tags."""
    return mol.groupBy(GROUP).agg(F.countDistinct("umi").alias("count"))


def one_hop(mol: DataFrame) -> DataFrame:
    """A10: every tag is replaced, once, by the greatest of its neighbours at distance 1 with more reads (ties: later
    in the alphabet). Adds corrected. The neighbours come from an equi-join with the tags' own neighbourhood."""
    near = neighbourhood(mol.select(F.col("umi").alias("u")).distinct(), "u").select(F.col("cb").alias("umi"), "variant")
    pairs = mol.join(near, "umi").withColumnRenamed("variant", "umi2")
    other = mol.select(*GROUP, F.col("umi").alias("umi2"), F.col("n").alias("n2"))
    better = pairs.join(other, [*GROUP, "umi2"]).where((F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("umi2") > F.col("umi"))))
    best = better.groupBy(*GROUP, "umi").agg(F.max_by("umi2", F.struct("n2", "umi2")).alias("to"))
    return mol.join(best, [*GROUP, "umi"], "left").withColumn("corrected", F.coalesce("to", "umi")).drop("to")


def count_corrected(corrected: DataFrame) -> DataFrame:
    return corrected.groupBy(GROUP).agg(F.countDistinct("corrected").alias("count"))


def _near(a: str, b: str) -> bool:
    return sum(x != y for x, y in zip(a, b, strict=True)) == 1


def _neighbours(umis: list[str]) -> list[list[int]]:
    """Indices at distance 1 of each tag, by trying the substitutions."""
    at = {u: i for i, u in enumerate(umis)}
    return [[at[v] for p in range(len(u)) for c in "ACGT" if c != u[p] and (v := u[:p] + c + u[p + 1 :]) in at] for u in umis]


def _labels(umis: list[str]) -> list[int]:
    root, near = list(range(len(umis))), _neighbours(umis)
    for i in range(len(umis)):
        if root[i] != i:
            continue
        todo = [i]
        while todo:
            for j in near[todo.pop()]:
                if root[j] == j and j != i:
                    root[j] = i
                    todo.append(j)
    return root


def _all_connected(g: pd.DataFrame) -> list[str]:
    g = g.sort_values("umi")
    umis = g["umi"].tolist()
    return dict(zip(umis, (umis[r] for r in _labels(umis)), strict=True))


def _directional(add: int) -> Callable[[pd.DataFrame], dict[str, str]]:
    def run(g: pd.DataFrame) -> dict[str, str]:
        g = g.sort_values(["n", "umi"], ascending=[False, True])
        umis, n = g["umi"].tolist(), g["n"].tolist()
        near, to = _neighbours(umis), {}
        for i, u in enumerate(umis):
            parent = next((j for j in sorted(near[i]) if j < i and n[j] >= 2 * n[i] + add), None)
            to[u] = u if parent is None else to[umis[parent]]
        return to

    return run


def _clique(cap: int, ratio: float, parity: bool) -> Callable[[pd.DataFrame], dict[str, str]]:
    """A component of more than cap tags stays as it is (parity: it is cut at cap, in alphabetical search order)."""

    def run(g: pd.DataFrame) -> dict[str, str]:
        g = g.sort_values("umi")
        umis, n = g["umi"].tolist(), dict(zip(g["umi"], g["n"], strict=True))
        near, seen, to = _neighbours(umis), set(), {u: u for u in umis}
        for i in range(len(umis)):
            if i in seen:
                continue
            part, todo = [i], [i]
            seen.add(i)
            while todo:
                for j in near[todo.pop(0)]:
                    if j not in seen and not (parity and len(part) >= cap):
                        seen.add(j)
                        part.append(j)
                        todo.append(j)
            if 1 < len(part) <= cap:
                by = sorted((umis[k] for k in part), key=lambda u: (-n[u], u))
                if n[by[0]] >= ratio * n[by[1]]:
                    to |= {u: by[0] for u in by}
        return to

    return run


def _grouped(mol: DataFrame, rule: Callable[[pd.DataFrame], dict[str, str]]) -> DataFrame:
    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        return g.assign(corrected=g["umi"].map(rule(g)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mol.schema.fields)
    return mol.groupBy(GROUP).applyInPandas(kernel, f"{schema}, corrected string")


def connected(mol: DataFrame) -> DataFrame:
    """The first tag of each connected component of the distance-1 graph. A group's tags are bounded by the tag
    length, and go to one task."""
    return _grouped(mol, _all_connected)


def directional(mol: DataFrame, add: int = 0) -> DataFrame:
    """By reads descending, ties by tag, merge into the first earlier tag with n >= 2 n + add; chained."""
    return _grouped(mol, _directional(add))


def clique(mol: DataFrame, cap: int = 4, ratio: float = 2.0, parity: bool = False) -> DataFrame:
    """A16."""
    return _grouped(mol, _clique(cap, ratio, parity))


def multi_gene(mol: DataFrame) -> DataFrame:
    """Of a tag's genes in a cell those with most reads stay; none if that is a single read each of several."""
    w = Window.partitionBy("cb", "umi")
    top, genes = F.max("n").over(w), F.count("*").over(w)
    return mol.withColumn("_top", top).withColumn("_genes", genes).where((F.col("n") == F.col("_top")) & ((F.col("_genes") == 1) | (F.col("_top") > 1))).drop("_top", "_genes")


def multi_gene_all(mol: DataFrame) -> DataFrame:
    """Tags of several genes go altogether."""
    return mol.withColumn("_genes", F.count("*").over(Window.partitionBy("cb", "umi"))).where("_genes = 1").drop("_genes")


def multi_gene_corrected(corrected: DataFrame) -> DataFrame:
    """A corrected tag belongs to the one gene with most reads after correction, which must also have most
    reads before it; ties drop the tag. Returns cb, gene, umi."""
    after = corrected.groupBy("cb", "gene", F.col("corrected").alias("umi")).agg(F.sum("n").alias("m"))
    before = corrected.select("cb", "gene", "umi", "n")
    w = Window.partitionBy("cb", "umi")
    best = after.withColumn("top", F.max("m").over(w)).where("m = top")
    best = best.withColumn("ties", F.count("*").over(w)).where("ties = 1")
    raw = before.withColumn("top", F.max("n").over(w)).where("n < top").select("cb", "gene", "umi")
    return best.select("cb", "gene", "umi").join(raw, ["cb", "gene", "umi"], "left_anti")


def molecule_table(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Reads of each molecule."""
    return reads.groupBy(*keys).agg(F.count("*").alias("n"))


def common_genes(read_genes: DataFrame) -> DataFrame:
    """Genes that all reads of a tag hit, with their number. Input: cb, umi, read, gene."""
    per = read_genes.groupBy("cb", "umi", "gene").agg(F.countDistinct("read").alias("hits"))
    n = read_genes.groupBy("cb", "umi").agg(F.countDistinct("read").alias("reads"))
    kept = per.join(n, ["cb", "umi"]).where("hits = reads").select("cb", "umi", "gene")
    return kept.withColumn("genes", F.count("*").over(Window.partitionBy("cb", "umi")))


def allocate(common: DataFrame) -> DataFrame:
    """Cb, gene, unique, uniform, prop_unique, rescue counts. A multi-gene tag is shared equally; by unique counts
    (equally where they are all 0); or by unique plus uniform counts."""
    unique = common.where("genes = 1").groupBy("cb", "gene").agg(F.count("*").cast("double").alias("unique"))
    multi = common.where("genes > 1")
    uniform = multi.groupBy("cb", "gene").agg(F.sum(1 / F.col("genes")).alias("uniform"))
    per = unique.join(uniform, ["cb", "gene"], "full").na.fill(0.0)
    w = Window.partitionBy("cb", "umi")
    m = multi.join(per, ["cb", "gene"]).withColumn("su", F.sum("unique").over(w)).withColumn("sr", F.sum(F.col("unique") + F.col("uniform")).over(w))
    prop = F.when(F.col("su") > 0, F.col("unique") / F.col("su")).otherwise(1 / F.col("genes"))
    shares = m.groupBy("cb", "gene").agg(F.sum(prop).alias("prop_unique"), F.sum((F.col("unique") + F.col("uniform")) / F.col("sr")).alias("rescue"))
    return per.join(shares, ["cb", "gene"], "left").na.fill(0.0)


def em_allocate(common: DataFrame, rounds: int = 100, tol: float = 0.01) -> DataFrame:
    """M5: cb, gene, em: EM shares of multi-gene tags in each cell, from uniform plus unique counts."""
    import numpy as np

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        genes, at = np.unique(g["gene"], return_inverse=True)
        tags, tag = np.unique(g["umi"], return_inverse=True)
        n = np.bincount(tag)
        single = n[tag] == 1
        unique = np.bincount(at[single], minlength=len(genes)).astype(float)
        a, t = at[~single], tag[~single]
        now = unique + np.bincount(a, 1 / n[t], len(genes))
        for _ in range(rounds):
            now = np.where(now < 0.01, 0, now)
            total = np.bincount(t, now[a], len(tags))
            share = np.where(total[t] > 0, now[a] / np.where(total[t] > 0, total[t], 1), 0)
            new = unique + np.bincount(a, share, len(genes))
            done = np.abs(new - now).max(initial=0) < tol
            now = new
            if done:
                break
        return pd.DataFrame({"cb": g["cb"].iloc[0], "gene": genes, "em": now - unique})

    kinds = dict(common.dtypes)
    return common.groupBy("cb").applyInPandas(kernel, f"cb {kinds['cb']}, gene {kinds['gene']}, em double")


def velocity(reads: DataFrame) -> DataFrame:
    """Cb, gene, spliced, unspliced, ambiguous molecules. Input: cb, umi, read, tr, gene, bits (1 exonic, 2 intronic).
    Transcripts are those that all reads of a tag hit, their bits are joined, and tags of several genes go."""
    per = reads.groupBy("cb", "umi", "tr", "gene").agg(F.countDistinct("read").alias("hits"), F.bit_or("bits").alias("bits"))
    n = reads.groupBy("cb", "umi").agg(F.countDistinct("read").alias("reads"))
    kept = per.join(n, ["cb", "umi"]).where("hits = reads")
    tag = kept.groupBy("cb", "umi").agg(F.min("gene").alias("gene"), F.max("gene").alias("g2"), F.min("bits").alias("low"), F.max("bits").alias("high")).where("gene = g2")
    kind = F.when(F.col("high") == 1, "spliced").when(F.col("low") >= 2, "unspliced").otherwise("ambiguous")
    sums = [F.count(F.when(kind == k, 1)).alias(k) for k in ("spliced", "unspliced", "ambiguous")]
    return tag.groupBy("cb", "gene").agg(*sums)


def smart_seq(reads: DataFrame) -> DataFrame:
    """Reads, and distinct (start, length), of each cell and gene."""
    return reads.groupBy("cb", "gene").agg(F.count("*").alias("reads"), F.countDistinct("start", "length").alias("molecules"))
