"""Barcodes: exact and one-mismatch matching, posterior rescue (J1-J8, J26), sample tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequences import error_probability


def neighbourhood(whitelist: DataFrame, col: str = "cb", alphabet: str = "ACGT") -> DataFrame:
    """Every sequence one substitution away from a listed one: variant, cb, pos. 3 * length rows each, made once."""
    pos = F.explode(F.sequence(F.lit(1), F.length(col))).alias("pos")
    places = whitelist.select(F.col(col).alias("cb"), pos)
    letters = places.withColumn("letter", F.explode(F.array(*[F.lit(c) for c in alphabet])))
    own = F.expr("substring(cb, pos, 1)")
    return letters.where(own != F.col("letter")).select(F.expr("concat(substring(cb, 1, pos - 1), letter, substring(cb, pos + 1))").alias("variant"), "cb", "pos")


def match(reads: DataFrame, whitelist: DataFrame, seq: str = "seq", multi: bool = True) -> DataFrame:
    """Read columns with cb (candidate) and match: exact, one, multi. A sequence found exactly has no other
    candidates; with several one-mismatch candidates all stay if multi, else none. N stands for any letter.

    Equi-joins only: with the list, and with its neighbourhood."""
    listed = whitelist.select(F.col("cb"))
    exact = reads.join(listed, F.col(seq) == F.col("cb"), "left")
    hit = exact.where(F.col("cb").isNotNull()).withColumn("match", F.lit("exact"))
    near = neighbourhood(listed, "cb", "ACGTN").select(F.col("variant"), "cb")
    rest = exact.where(F.col("cb").isNull()).drop("cb").join(near, F.col(seq) == F.col("variant")).drop("variant")
    n = F.count("*").over(Window.partitionBy("read"))
    rest = rest.withColumn("match", F.when(n == 1, "one").otherwise("multi"))
    return hit.unionByName(rest if multi else rest.where("match = 'one'"))


def posterior(candidates: DataFrame, weight: Column, threshold: float = 0.975, strict: bool = False) -> DataFrame:
    """Of a read's candidates the heaviest, if it holds the threshold's share of all weight. Ties by barcode."""
    w = Window.partitionBy("read")
    scored = candidates.withColumn("_w", weight).where("_w > 0").withColumn("_sum", F.sum("_w").over(w))
    share = F.col("_w") / F.col("_sum")
    first = F.row_number().over(w.orderBy(F.desc("_w"), "cb")) == 1
    ok = share > threshold if strict else F.col("_w") >= threshold * F.col("_sum")
    return scored.withColumn("posterior", share).withColumn("_first", first).where(F.col("_first") & ok).drop("_w", "_sum", "_first")


def rescue(candidates: DataFrame, exact_reads: DataFrame, quality: str = "qual", threshold: float = 0.975, pseudo: int = 0) -> DataFrame:
    """weight = (reads of the barcode matched exactly + pseudo) * error probability at the mismatch. J8: pseudo 1."""
    counted = candidates.join(exact_reads.select("cb", F.col("n").alias("_n")), "cb", "left")
    q = F.pow(F.lit(10.0), -F.least(F.col(quality), F.lit(33)) / 10.0)
    return posterior(counted, (F.coalesce("_n", F.lit(0)) + pseudo) * q, threshold, pseudo > 0).drop("_n")


def bayes(reads: DataFrame, candidates: DataFrame, least: float = 0.9, ratio: float = 2.0) -> DataFrame:
    """Per-base log likelihood of each candidate (match 1-e, mismatch e/3, N 1/4) plus its log prior; accepted at
    posterior >= least and ratio times the runner-up. reads: read, seq, qual; candidates: read, cb, prior."""
    letters = F.zip_with(F.zip_with(F.split("seq", ""), F.split("cb", ""), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.split("qual", ""), lambda x, q: F.struct(x["a"].alias("a"), x["b"].alias("b"), error_probability(q).alias("e")))
    term = lambda x: F.when(x["a"] == "N", F.log(F.lit(0.25))).when(x["a"] == x["b"], F.log(F.greatest(F.lit(1e-12), 1 - x["e"]))).otherwise(F.log(F.greatest(F.lit(1e-12), x["e"] / 3)))
    scored = candidates.join(reads, "read").withColumn("ll", F.aggregate(letters, F.lit(0.0), lambda s, x: s + term(x)) + F.log("prior"))
    w = Window.partitionBy("read")
    top = F.max("ll").over(w)
    scored = scored.withColumn("p", F.exp(F.col("ll") - top) / F.sum(F.exp(F.col("ll") - top)).over(w))
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("p"), "cb"))).withColumn("second", F.lead("p", 1, 0.0).over(w.orderBy(F.desc("p"), "cb")))
    return ranked.where((F.col("rank") == 1) & (F.col("p") >= least) & (F.col("p") >= ratio * F.col("second"))).select("read", "cb", F.col("p").alias("posterior"))


def sample_tag(reads: DataFrame, tags: DataFrame, seq: str = "seq", offset: int = 1, length: int = 8, shifts: tuple[int, ...] = (0, -1, 1, -2, 2)) -> DataFrame:
    """The sample whose tag stands at the offset, else at the nearest shift, in the order given. tags: tag, sample."""
    places = [F.struct(F.lit(i).alias("turn"), F.substring(F.col(seq), max(1, offset + s), length).alias("tag")) for i, s in enumerate(shifts) if offset + s >= 1]
    tried = reads.select("read", F.explode(F.array(*places)).alias("t")).select("read", "t.turn", "t.tag")
    return tried.join(tags, "tag").groupBy("read").agg(F.min_by("sample", "turn").alias("sample"))


def demux(reads: DataFrame, probes: DataFrame, samples: DataFrame) -> DataFrame:
    """Tag -> probe -> (library, probe) -> sample, with buckets for unknown tags and unmapped probes."""
    known = reads.join(probes, "tag", "left").join(samples, ["library", "probe"], "left")
    return known.withColumn("bucket", F.when(F.col("probe").isNull(), "unknown").when(F.col("sample").isNull(), "unmapped").otherwise(F.col("sample")))


def split_composite(df: DataFrame, col: str = "barcode", tag: int = 8) -> DataFrame:
    """Cell part and tag, the last letters."""
    return df.withColumn("cell", F.expr(f"substring({col}, 1, length({col}) - {tag})")).withColumn("tag", F.expr(f"right({col}, {tag})"))


def add_tags(aligned: DataFrame, tags: DataFrame, key: str = "read", need_cb: bool = True) -> DataFrame:
    """CB and UB of each read; UB only with CB unless need_cb is false."""
    t = tags.select(key, "cb", F.when(F.col("cb").isNotNull() | F.lit(not need_cb), F.col("ub")).alias("ub"))
    return aligned.join(t, key, "left")


def _deletions(col: Column, most: int) -> Column:
    """All strings left by up to ``most`` deletions."""
    once = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    out = F.array(col)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(F.filter(out, lambda s: F.length(s) > 1), once))))
    return out


def match_edits(reads: DataFrame, whitelist: DataFrame, seq: str = "seq", most: int = 2) -> DataFrame:
    """Read, cb, distance of the listed sequences within ``most`` edits, the least distance of a read only. Two strings that
    near share one that both become by as many deletions, which is what is joined on."""
    a = reads.select("read", F.col(seq).alias("_s"), F.explode(_deletions(F.col(seq), most)).alias("_k"))
    b = whitelist.select("cb", F.explode(_deletions(F.col("cb"), most)).alias("_k"))
    near = a.join(b, "_k").select("read", "_s", "cb").distinct().withColumn("distance", F.levenshtein("_s", "cb")).where(F.col("distance") <= most)
    best = near.withColumn("_b", F.min("distance").over(Window.partitionBy("read"))).where("distance = _b")
    return best.select("read", "cb", "distance")


def correct_inline(reads: DataFrame, whitelist: DataFrame, seq: str = "seq") -> DataFrame:
    """Read, cb, status: exact, corrected (one variant), rescued (up to two N, one listed sequence), ambiguous (several
    variants, cb null) or none."""
    listed = whitelist.select("cb")
    ns = F.length(seq) - F.length(F.replace(F.col(seq), F.lit("N"), F.lit("")))
    r = reads.select("read", F.col(seq).alias("_s"), ns.alias("_n"))
    exact = r.join(listed, F.col("_s") == F.col("cb")).select("read", "cb", F.lit("exact").alias("status"))
    rest = r.join(exact.select("read"), "read", "left_anti")
    one = rest.where("_n = 0").join(neighbourhood(listed).select("variant", "cb"), F.col("_s") == F.col("variant")).select("read", "cb", F.lit("corrected").alias("status"))
    fill = rest.where("_n between 1 and 2").withColumn("_t", F.explode(F.array(*[F.lit(c) for c in "ACGT"]))).withColumn("_t2", F.explode(F.when(F.col("_n") == 2, F.array(*[F.lit(c) for c in "ACGT"])).otherwise(F.array(F.lit("N")))))
    at = F.instr("_s", "N")
    first = F.concat(F.expr("substring(_s, 1, instr(_s, 'N') - 1)"), "_t", F.expr("substring(_s, instr(_s, 'N') + 1)"))
    both = F.when(F.col("_n") == 2, F.replace(first, F.lit("N"), F.col("_t2"))).otherwise(first)
    rescued = fill.where(at > 0).withColumn("_f", both).join(listed, F.col("_f") == F.col("cb")).select("read", "cb", F.lit("rescued").alias("status")).distinct()
    n = F.count("*").over(Window.partitionBy("read"))
    near = one.unionByName(rescued).withColumn("_c", n)
    single = near.where("_c = 1").drop("_c")
    several = near.where("_c > 1 and status = 'corrected'").select("read").distinct().select("read", F.lit(None).cast("string").alias("cb"), F.lit("ambiguous").alias("status"))
    known = exact.unionByName(single).unionByName(several)
    return reads.select("read").join(known, "read", "left").withColumn("status", F.coalesce("status", F.lit("none")))
