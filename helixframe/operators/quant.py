"""Transcript quantification."""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.sources.shared import scratch


def equivalence_classes(aligns: DataFrame) -> DataFrame:
    """Tids (ordered ids), count, weights (summed element by element). aligns: read, tid, w; a read's ids in order of tid."""
    per = aligns.groupBy("read").agg(F.array_sort(F.collect_list(F.struct("tid", "w"))).alias("x"))
    per = per.select(F.transform("x", lambda a: a["tid"]).alias("tids"), F.transform("x", lambda a: a["w"]).alias("w"))
    long = per.select("tids", F.posexplode("w").alias("i", "w")).groupBy("tids", "i").agg(F.sum("w").alias("w"), F.count("*").alias("count"))
    return long.groupBy("tids").agg(F.max("count").alias("count"), F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda a: a["w"]).alias("weights"))


def softmax(aligns: DataFrame, score: str = "logw") -> DataFrame:
    """M9: weight of each alignment in its read: softmax of the log scores."""
    w = Window.partitionBy("read")
    top = F.max(score).over(w)
    return aligns.withColumn("w", F.exp(F.col(score) - top) / F.sum(F.exp(F.col(score) - top)).over(w))


def prune_global(classes: DataFrame, least: float) -> DataFrame:
    """Ids whose weight is below least times the class's largest go; the rest is scaled to sum 1."""
    top = F.array_max("weights")
    kept = F.filter(F.arrays_zip("tids", "weights"), lambda x: x["weights"] >= least * top)
    c = classes.withColumn("_k", kept)
    total = F.aggregate("_k", F.lit(0.0), lambda s, x: s + x["weights"])
    return c.select(F.transform("_k", lambda x: x["tids"]).alias("tids"), F.transform("_k", lambda x: x["weights"] / total).alias("weights"), "count")


def prune_local(classes: DataFrame, least: float) -> DataFrame:
    """Ids of weight below least go from their class, the rest is scaled to sum 1; classes without a rest go."""
    kept = F.filter(F.arrays_zip("tids", "weights"), lambda x: x["weights"] >= least)
    return _rescaled(classes.withColumn("_k", kept))


def prune_abundance(classes: DataFrame, least: float) -> DataFrame:
    """Ids whose count times weight over all classes is below least go from every class, the rest is scaled to sum 1;
    classes without a rest go."""
    x = classes.select("tids", "weights", "count", F.posexplode(F.arrays_zip("tids", "weights")).alias("i", "x"))
    rare = x.groupBy(F.col("x.tids").alias("tid")).agg(F.sum(F.col("count") * F.col("x.weights")).alias("_a")).where(F.col("_a") < least).select("tid")
    each = x.select("tids", "weights", "count", "i", "x", F.col("x.tids").alias("tid")).join(rare, "tid", "left_anti")
    kept = each.groupBy("tids", "weights", "count").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("_k"))
    return _rescaled(kept)


def _rescaled(classes: DataFrame) -> DataFrame:
    total = F.aggregate("_k", F.lit(0.0), lambda s, x: s + x["weights"])
    out = classes.where(F.size("_k") > 0)
    return out.select(F.transform("_k", lambda x: x["tids"]).alias("tids"), F.transform("_k", lambda x: F.when(total > 0, x["weights"] / total).otherwise(x["weights"])).alias("weights"), "count")


def best_hits(aligns: DataFrame, fraction: float = 0.65) -> DataFrame:
    """Alignments with score >= fraction of the read's best; decoys that beat all others drop the read."""
    w = Window.partitionBy("read")
    best, decoy = F.max(F.when(~F.col("decoy"), F.col("score"))).over(w), F.max(F.when(F.col("decoy"), F.col("score"))).over(w)
    s = aligns.withColumn("_b", best).withColumn("_d", decoy)
    return s.where(~F.col("decoy") & (F.col("score") >= fraction * F.col("_b")) & (F.col("_d").isNull() | (F.col("_d") <= F.col("_b")))).drop("_b", "_d")


def digamma(x: np.ndarray) -> np.ndarray:
    """By shifting to x >= 6 and the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


class ClassTable:
    """Equivalence classes as flat arrays, for one sample."""

    def __init__(self, tids: list, weights: list, counts: np.ndarray, n: int, lengths: np.ndarray):
        sizes = np.array([len(t) for t in tids])
        self.cls, self.tid = np.repeat(np.arange(len(tids)), sizes), np.concatenate([np.asarray(t, int) for t in tids]) if len(tids) else np.zeros(0, int)
        w = np.concatenate([np.asarray(x, float) for x in weights]) if len(tids) else np.zeros(0)
        self.aux, self.counts, self.n, self.lengths = w / np.maximum(lengths[self.tid], 1e-9), np.asarray(counts, float), n, lengths

    def expected(self, theta: np.ndarray) -> np.ndarray:
        v = theta[self.tid] * self.aux
        total = np.bincount(self.cls, v, len(self.counts))
        ok = total[self.cls] > 0
        return np.bincount(self.tid[ok], self.counts[self.cls[ok]] * v[ok] / total[self.cls[ok]], self.n)


def _rounds(total: float, n: int, theta: Callable, rounds: int = 10000, least: int = 100, tol: float = 0.01, seen: float = 5e6) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Yields weights of the transcripts, takes the counts expected by them, and returns the last. Starts at projected counts mixed
    with equal ones by min(0.999, total / seen)."""
    share = min(0.999, total / seen)
    now = share * (yield np.ones(n)) + (1 - share) * total / max(n, 1)
    for r in range(rounds):
        new = yield theta(now)
        big = new > 0.01
        change = np.abs(new - now)[big] / new[big]
        now = new
        if r + 1 >= least and change.max(initial=0) < tol:
            break
    return np.where(now <= 1e-8, 0, now)


def _em(total: float, n: int, **how) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    return _rounds(total, n, lambda now: now, **how)


def _vb(total: float, n: int, prior: float = 0.01, **how) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    def theta(now: np.ndarray) -> np.ndarray:
        alpha = now + prior
        return np.where(alpha > 1e-10, np.exp(digamma(np.maximum(alpha, 1e-10)) - digamma(np.array([alpha.sum()]))[0]), 0)

    return _rounds(total, n, theta, **how)


def _solved(solver: Generator[np.ndarray, np.ndarray, np.ndarray], expected: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    theta = next(solver)
    while True:
        try:
            theta = solver.send(expected(theta))
        except StopIteration as end:
            return end.value


def em(t: ClassTable, **how) -> np.ndarray:
    """M6: expected counts. how: rounds, least, tol, seen."""
    return _solved(_em(t.counts.sum(), t.n, **how), t.expected)


def vb(t: ClassTable, **how) -> np.ndarray:
    """M7: variational Bayes counts. how: prior, and as for :func:`em`."""
    return _solved(_vb(t.counts.sum(), t.n, **how), t.expected)


#: Members of a block of classes, at least and at most; in between as many as there are transcripts.
_LEAST, _MOST = 1 << 18, 1 << 21
#: Arrays that a block of classes carries, as bytes: of its members, then of its classes.
_PARTS = {"tid": np.int32, "aux": np.float64, "size": np.int32, "count": np.float64}
#: Numbers that the driver holds at once as weights of samples.
_HELD = 1 << 22


def _blocks(classes: DataFrame, lengths: Broadcast, n: int) -> DataFrame:
    """sample, total (of counts), and the arrays of up to some 10^6 members in a row. classes: sample, tids, weights, count."""
    schema = pa.schema([("sample", pa.string()), ("total", pa.float64()), *[(c, pa.binary()) for c in _PARTS]])
    enough = min(max(n, _LEAST), _MOST)

    def block(sample: str | None, held: list[tuple]) -> pa.RecordBatch:
        parts = [np.concatenate(x) for x in zip(*held, strict=True)]
        total, full = parts[3].sum(), parts[2] > 0
        parts[2:] = parts[2][full], parts[3][full]
        return pa.RecordBatch.from_pylist([{"sample": sample, "total": float(total)} | {c: x.astype(t).tobytes() for (c, t), x in zip(_PARTS.items(), parts, strict=True)}], schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, members, of = [], 0, None
        for b in batches:
            size = b.column("tids").value_lengths().fill_null(0).to_numpy()
            tid, w = b.column("tids").flatten().to_numpy().astype(np.int32), b.column("weights").flatten().to_numpy(zero_copy_only=False)
            aux, count, ends = w / np.maximum(lengths.value[tid], 1e-9), b.column("count").to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(size)])
            names = b.column("sample").dictionary_encode(null_encoding="encode")
            code = names.indices.to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)] if len(code) else [0]
            for lo, hi in zip(bounds, bounds[1:]):
                sample, (first, last) = names.dictionary[int(code[lo])].as_py(), (ends[lo], ends[hi])
                if held and (sample != of or members >= enough):
                    yield block(of, held)
                    held, members = [], 0
                held.append((tid[first:last], aux[first:last], size[lo:hi], count[lo:hi]))
                members, of = members + last - first, sample
        if held:
            yield block(of, held)

    order = classes.sortWithinPartitions("sample", "tids")  # sums don't depend on the order in which rows come
    return order.mapInArrow(pack, "sample string, total double, tid binary, aux binary, size binary, count binary")


def _expected(blocks: DataFrame, theta: dict[str | None, np.ndarray], n: int) -> dict[str | None, np.ndarray]:
    """As :meth:`ClassTable.expected`, for the samples of theta: each task sums up its blocks."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(theta)
    schema = pa.schema([("sample", pa.string()), ("sums", pa.binary())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str | None, np.ndarray] = {}
        for b in batches:
            for i, sample in enumerate(b.column("sample").to_pylist()):
                tid, aux, size, count = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in _PARTS.items())
                if sample not in shared.value or not len(size):
                    continue
                v = shared.value[sample][tid] * aux
                total = np.add.reduceat(v, np.cumsum(size) - size)
                none = ~(total > 0)
                if none.any():
                    v[np.repeat(none, size)], total[none] = 0, 1
                v /= np.repeat(total, size)
                v *= np.repeat(count, size)
                got = np.bincount(tid, v, n)
                out[sample] = out[sample] + got if sample in out else got
        yield pa.RecordBatch.from_pylist([{"sample": s, "sums": x.tobytes()} for s, x in out.items()], schema)

    found = {s: np.zeros(n) for s in theta}
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"  # a record is a whole block
    before = spark.conf.get(limit)
    spark.conf.set(limit, 4)
    try:
        for r in blocks.mapInArrow(sums, "sample string, sums binary").collect():
            found[r["sample"]] += np.frombuffer(r["sums"])
    finally:
        spark.conf.set(limit, before)
        shared.destroy()
    return found


def quantify(classes: DataFrame, lengths: DataFrame, method: str = "em", sample: str | None = None, **how) -> DataFrame:
    """M6/M7: sample, tid, count, tpm. classes: [sample,] tids, weights, count; lengths: tid (dense from 0), eff.

    Classes stay dealt over the tasks, in blocks on the executors' disks, so that no task holds a sample's; the rounds are run here,
    each a pass over the blocks that returns a sum for each transcript and task. The driver holds a number for each transcript
    of some samples at once; samples beyond :data:`_HELD` numbers follow one after another."""
    spark = classes.sparkSession
    eff = lengths.orderBy("tid").select("eff").toPandas()["eff"].to_numpy(float)
    n, solver = len(eff), {"em": _em, "vb": _vb}[method]
    shared = spark.sparkContext.broadcast(eff)
    named = classes.select((F.col(sample).cast("string") if sample else F.lit("all")).alias("sample"), "tids", F.col("weights").cast("array<double>").alias("weights"), F.col("count").cast("double").alias("count"))
    blocks = _blocks(named, shared, n).persist(StorageLevel.DISK_ONLY)
    schema = "sample string, tid bigint, count double, tpm double"
    try:
        totals = {r["sample"]: r["total"] for r in blocks.groupBy("sample").agg(F.sum("total").alias("total")).collect()}
        names = sorted(totals, key=lambda s: (s is not None, s or ""))
        at_once, dealt, out = max(1, _HELD // max(n, 1)), blocks.coalesce(spark.sparkContext.defaultParallelism), []
        for k in range(0, len(names), at_once):
            some = names[k : k + at_once]
            part = dealt if len(some) == len(names) else dealt.where(F.col("sample").isin([s for s in some if s is not None]) | (F.col("sample").isNull() & F.lit(None in some)))
            running = {s: solver(totals[s], n, **how) for s in some}
            theta, counts = {s: next(g) for s, g in running.items()}, {}
            while theta:
                for s, x in _expected(part, theta, n).items():
                    try:
                        theta[s] = running[s].send(x)
                    except StopIteration as end:
                        counts[s] = end.value
                        del theta[s]
            out.append(spark.createDataFrame(pa.concat_tables([_shown(s, counts[s], eff) for s in some]), schema))
            if len(some) < len(names):
                path = scratch(spark, "quantify")
                out[-1].write.parquet(path)
                out[-1] = spark.read.schema(schema).parquet(path)
    finally:
        blocks.unpersist()
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


def _shown(sample: str | None, count: np.ndarray, eff: np.ndarray) -> pa.Table:
    rate = count / np.maximum(eff, 1e-9)
    tpm = rate / rate.sum() * 1e6 if rate.sum() else rate
    return pa.table({"sample": pa.array([sample] * len(eff), pa.string()), "tid": np.arange(len(eff)), "count": count, "tpm": tpm})


def effective_lengths(transcripts: DataFrame, pmf: DataFrame) -> DataFrame:
    """M8: tid, length, eff = sum over f <= length of pmf[f] * (length - f + 1), within [1, length]. transcripts: tid,
    length; pmf: f, p, a bounded number of fragment lengths. By prefix sums: one row is looked up for each transcript."""
    w = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    cum = pmf.select("f", F.sum("p").over(w).alias("sp"), F.sum(F.col("p") * F.col("f")).over(w).alias("sf"))
    top = cum.agg(F.max("f").alias("_top"))
    t = transcripts.crossJoin(F.broadcast(top)).withColumn("f", F.least("length", "_top"))  # a single number
    j = t.join(cum, "f", "left")
    eff = F.col("sp") * (F.col("length") + 1) - F.col("sf")
    return j.select("tid", "length", F.least(F.col("length").cast("double"), F.greatest(F.lit(1.0), F.coalesce(eff, F.lit(1.0)))).alias("eff"))


def fragment_lengths(observed: DataFrame, mean: float = 250.0, sd: float = 25.0, most: int = 1000) -> DataFrame:
    """F, p: a normal prior of weight 1 over 0..most plus, for each observed fragment (f, n), its weight spread by a
    Binomial(4, 1/2) kernel."""
    x = np.arange(most + 1)
    cdf = lambda v: 0.5 * (1 + math.erf((v - mean) / (sd * math.sqrt(2))))
    prior = np.array([cdf(i + 0.5) - cdf(i - 0.5) for i in x])
    prior = observed.sparkSession.createDataFrame([(int(i), float(p)) for i, p in zip(x, prior / prior.sum(), strict=True)], "f int, w double")
    kernel = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(c / 16).alias("c")) for d, c in zip((-2, -1, 0, 1, 2), (1, 4, 6, 4, 1), strict=True)]))
    spread = observed.select(F.least("f", F.lit(most)).alias("f"), "n", kernel.alias("k")).select(F.greatest(F.lit(0), F.least(F.lit(most), F.col("f") + F.col("k.d"))).cast("int").alias("f"), (F.col("n") * F.col("k.c")).alias("w"))
    every = prior.unionByName(spread).groupBy("f").agg(F.sum("w").alias("w"))
    return every.select("f", (F.col("w") / F.sum("w").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("p"))


def observed_lengths(pairs: DataFrame, low: int = 0, high: int = 1000) -> DataFrame:
    """F, n, p of the absolute template lengths in [low, high]."""
    n = pairs.select(F.abs("tlen").alias("f")).where((F.col("f") >= low) & (F.col("f") <= high)).groupBy("f").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def gc_histogram(fragments: DataFrame) -> DataFrame:
    """Bin (0-100), share. fragments: seq, w."""
    gc = F.length("seq") - F.length(F.translate("seq", "GCgc", ""))
    h = fragments.select(F.floor(gc * 100 / F.length("seq") + 0.5).alias("bin"), "w").groupBy("bin").agg(F.sum("w").alias("w"))
    return h.select("bin", (F.col("w") / F.sum("w").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("share"))


def gc_bias(observed: DataFrame, expected: DataFrame, most: float = 10.0) -> DataFrame:
    """Bin, ratio within [1/most, most]; 1 where nothing is expected."""
    both = expected.select("bin", F.col("share").alias("e")).join(observed.select("bin", F.col("share").alias("o")), "bin", "left")
    return both.select("bin", F.when(F.col("e") <= 0, 1.0).otherwise(F.least(F.lit(most), F.greatest(F.lit(1 / most), F.coalesce("o", F.lit(0.0)) / F.col("e")))).alias("ratio"))


def by_gene(quant: DataFrame) -> DataFrame:
    """Gene, tpm, count, length, eff: lengths weighted by tpm, plain means where that is 0."""
    t = F.sum("tpm")
    mean = lambda c: F.when(t > 0, F.sum(F.col("tpm") * F.col(c)) / t).otherwise(F.avg(c))
    return quant.groupBy("gene").agg(t.alias("tpm"), F.sum("count").alias("count"), mean("length").alias("length"), mean("eff").alias("eff"))


def tximport(quant: DataFrame, mode: str = "lengthScaledTPM") -> DataFrame:
    """Gene, tpm, count, length. scaledTPM and lengthScaledTPM keep the total of all counts."""
    g = by_gene(quant).select("gene", "tpm", F.col("count").alias("_n"), F.col("eff").alias("length"))
    if mode == "no":
        return g.withColumnRenamed("_n", "count")
    raw = F.col("tpm") * F.col("length") if mode == "lengthScaledTPM" else F.col("tpm")
    total = g.agg((F.sum("_n") / F.sum(raw)).alias("_scale"))
    return g.crossJoin(F.broadcast(total)).select("gene", "tpm", (raw * F.col("_scale")).alias("count"), "length")  # a single number


def gene_order(df: DataFrame) -> DataFrame:
    """O9."""
    return df.orderBy(F.lower("gene"), F.length("gene"), "gene")


def to_genes(tx: DataFrame, tx2gene: DataFrame) -> tuple[DataFrame, DataFrame]:
    """With genes; number of transcripts without."""
    j = tx.join(tx2gene, "tx", "left")
    return j.where("gene is not null"), j.where("gene is null").agg(F.count("*").alias("missing"))


def type_vote(read_tx: DataFrame, types: DataFrame) -> DataFrame:
    """Type, reads all of whose transcripts are of that type."""
    per = read_tx.join(types, "tx").groupBy("read").agg(F.min("type").alias("type"), F.max("type").alias("_t")).where("type = _t")
    return per.groupBy("type").agg(F.count("*").alias("reads"))


def library_format(fragments: DataFrame, first: int, least: float = 0.85) -> str:
    """The format of most of the first fragments (by read); raises where it is ambiguous."""
    rows = fragments.orderBy("read").limit(first).groupBy("format").count().orderBy(F.desc("count"), "format").collect()
    if not rows or rows[0]["count"] < least * sum(r["count"] for r in rows):
        raise ValueError("ambiguous library format")
    return rows[0]["format"]


# fixed values: orientations that a library format admits
COMPATIBLE = {"IU": ("ISF", "ISR"), "ISF": ("ISF",), "ISR": ("ISR",), "MU": ("MSF", "MSR"), "OU": ("OSF", "OSR"), "U": ("SF", "SR"), "SF": ("SF",), "SR": ("SR",)}


def compatible(aligns: DataFrame, format_: str) -> DataFrame:
    """F14."""
    return aligns.where(F.col("orientation").isin(*COMPATIBLE[format_]))


def error_model(bases: DataFrame, bins: int = 6, pseudo: float = 1.0) -> DataFrame:
    """Bin, before, state, logp: transitions between neighbouring states of an alignment (state = reference base * 9 + read
    base), for each stretch of the read. bases: read, at, length, ref, base (0-8)."""
    s = _states(bases, bins).where("before is not null").groupBy("bin", "before", "state").agg(F.count("*").alias("n"))
    total = F.sum(F.col("n") + pseudo).over(Window.partitionBy("bin", "before"))
    return s.select("bin", "before", "state", F.log((F.col("n") + pseudo) / total).alias("logp"))


def _states(bases: DataFrame, bins: int) -> DataFrame:
    s = bases.select("read", "at", F.least(F.lit(bins - 1), F.floor(F.col("at") * bins / F.col("length"))).alias("bin"), (F.col("ref") * 9 + F.col("base")).alias("state"), (F.col("ref") * 9 + F.col("ref")).alias("match"))
    w = Window.partitionBy("read").orderBy("at")
    return s.withColumn("before", F.lag("state").over(w)).withColumn("match_before", F.lag("match").over(w))


def error_likelihood(bases: DataFrame, model: DataFrame, bins: int = 6) -> DataFrame:
    """Read, err: log transitions of the alignment less those of the same reference without errors."""
    s = _states(bases, bins).where("before is not null")
    front = s.join(model, ["bin", "before", "state"], "left").groupBy("read").agg(F.sum("logp").alias("front"))
    back = s.select("read", "bin", F.col("match_before").alias("before"), F.col("match").alias("state")).join(model, ["bin", "before", "state"], "left").groupBy("read").agg(F.sum("logp").alias("back"))
    return front.join(back, "read").select("read", (F.coalesce("front", F.lit(0.0)) - F.coalesce("back", F.lit(0.0))).alias("err"))
