"""Operator 9: embedding near-dedup by a pivot-permutation index.

At most ``pivots`` reference vectors of each vector length are drawn far apart from a bounded sample of the data, so that the members of a
dense group are described by pivots outside it, on which they agree. A vector is described by its ``nearest`` pivots in
order, and enters the inverted list of each. Two vectors of one label that share a pivot and
``shared`` pivots in all are compared by cosine in double precision; those at ``threshold`` or more are linked. A pair
is compared in the list of its least shared pivot only, so each link counts once.

Equal vectors of a label are one class from the start: its members are linked with each other without being paired,
and one stands for all. Lists are cut into blocks of ``block`` vectors, block pairs are dealt over the
tasks, and a task returns per block pair the links of each vector and a spanning forest of them, never the pairs.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, and one with a null label,
is linked with nothing; vectors of unequal length never are. A row is a vector: rows that repeat an id are vectors of
their own, and share the component. A null id can't be linked or named: its row comes back with null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, local_components
from .frames import cut

#: Vectors that pivots are chosen from, for each pivot.
SAMPLE = 16
#: No two pivots are nearer than this cosine, so that a dense group can't take most of them.
NEAR = 0.8


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str):
    v = F.col("vector")
    good = v.isNotNull() & (F.size(v) > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = good & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))
    good = good & F.exists(v, lambda x: x != 0)
    plus = lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)  # one zero
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("vector"))
    return rows.select("vec_id", "label", F.when(good, F.transform("vector", plus)).alias("vector"))


def draw_pivots(classes: DataFrame, pivots: int, seed: int) -> dict[int, np.ndarray]:
    """Per vector length at most ``pivots`` unit vectors: of the first about ``SAMPLE`` times as many distinct ones by hash
    the first, then again and again the one farthest from those drawn, until all have one at cosine ``NEAR``."""
    seen = classes.select("vector", F.size("vector").alias("width"), F.xxhash64(F.lit(seed), F.col("vector")).alias("h"))
    # twice the share of the hashes that holds the sample of a length; all of a length that has few
    part = F.lit(2.0 * SAMPLE * pivots) / F.count("*")
    shares = seen.groupBy("width").agg(F.when(part >= 1, F.lit(2**63 - 1)).otherwise((part * 2.0**64 - 2.0**63).cast("bigint")).alias("last"))
    got: dict[int, list] = {}
    for r in seen.join(shares, "width").where("h <= last").select("width", "h", "vector").distinct().collect():
        got.setdefault(r.width, []).append((r.h, r.vector))
    return {width: _spread(_unit(np.array([v for _, v in sorted(got[width])[: SAMPLE * pivots]])), pivots) for width in sorted(got)}


def _spread(x: np.ndarray, pivots: int) -> np.ndarray:
    drawn, near = [0], x @ x[0]
    while len(drawn) < min(pivots, len(x)):
        far = int(near.argmin())
        if near[far] >= NEAR:
            break
        drawn.append(far)
        near = np.maximum(near, x @ x[far])
    return x[drawn]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def describe(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """The classes with near: the nearest pivots of their length, in order. Pivots of all lengths are numbered through."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # pivots x dimensions of each length
    schema = classes.schema
    at = schema.fieldNames().index("vector")

    def kernel(batches):
        drawn = shared.value
        first = dict(zip(drawn, np.cumsum([0, *map(len, drawn.values())]).tolist(), strict=False))
        for batch in batches:
            col = batch.column(at)
            flat, off = col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.array([len(x) for x in col]))]).astype(int)
            near: list = [None] * len(col)
            width = np.diff(off)
            for w in np.unique(width).tolist():
                rows, p = np.flatnonzero(width == w), drawn[w]
                x = _unit(np.stack([flat[off[i] : off[i + 1]] for i in rows]))
                for i, found in zip(rows.tolist(), np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :nearest], strict=True):
                    near[i] = (found + first[w]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=[*schema.fieldNames(), "near"])

    return classes.mapInArrow(kernel, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields) + ", near array<int>")


def _compare(one: list, other: list | None, pivot: int, shared: int, threshold: float):
    """Links in one block pair. one, other: (class id, size, near, vector) rows; other None: one with itself."""
    both = one + (other or [])
    ids, size = np.array([r[0] for r in both]), np.array([r[1] for r in both])
    n, width = len(one), np.array([len(r[3]) for r in both])
    top = max(int(max(r[2])) for r in both) + 1
    member = np.zeros((len(both), top), np.float32)
    for i, r in enumerate(both):
        member[i, r[2]] = 1
    right = slice(n, None) if other is not None else slice(0, n)
    # where fewer pivots describe a length, all of them must be shared
    mask = (member[:n] @ member[right].T >= np.minimum(shared, [len(r[2]) for r in one])[:, None]) & (member[:n, :pivot] @ member[right, :pivot].T == 0)
    mask &= width[:n, None] == width[right][None, :]
    if other is None:
        mask = np.triu(mask, 1)
    a, b = np.nonzero(mask)
    if not len(a):
        return None
    b = b + (n if other is not None else 0)
    widest = int(width.max())
    x = np.zeros((len(both), widest))
    for i, r in enumerate(both):
        x[i, : len(r[3])] = r[3]
    raw = x
    x = _unit(x)
    near = (x[:n] @ x[right].T)[a, b - (n if other is not None else 0)]
    ok = near >= threshold - 1e-9
    a, b = a[ok], b[ok]
    # at the threshold the plain formula decides
    close = np.flatnonzero(near[ok] < threshold + 1e-9)
    if len(close):
        u, w = raw[a[close]], raw[b[close]]
        exact = (u * w).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((w * w).sum(1)))
        drop = close[exact < threshold]
        a, b = np.delete(a, drop), np.delete(b, drop)
    links = np.bincount(a, size[b], len(both)) + np.bincount(b, size[a], len(both))
    root = ids[local_components(a, b, len(both))]
    hit = links > 0
    return ids[hit], links[hit].astype(np.int64), root[hit]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, pivots: int = 128, nearest: int = 12, shared: int = 3, block: int = 512, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    rows = cut(_classes(vectors, id_col, vector_col, label_col))
    key = F.xxhash64("label", "vector")
    good = rows.where("vector is not null")
    # keyed by the whole vector, so that unequal vectors with one hash stay apart
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), key.alias("key"))
    classes = cut(classes)
    drawn = draw_pivots(classes.select("vector"), pivots, seed)
    if not len(drawn):
        return rows.select(F.col("vec_id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    described = cut(describe(classes, drawn, nearest))
    # blocks of each list: numbered by a hash, so that no task ever ranks a list
    listed = described.select("label", F.explode("near").alias("pivot"), "first", "n", "near", "vector")
    counts = listed.groupBy("label", "pivot").agg(F.count("*").alias("m"))
    blocks = counts.select("label", "pivot", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    placed = listed.join(blocks, ["label", "pivot"]).withColumn("own", F.pmod(F.xxhash64(F.lit(seed), "first", "n"), F.col("blocks")).cast("int"))
    # a vector goes to each pair of blocks that holds its own
    sent = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("label", "pivot", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "first", "n", "near", "vector")

    def kernel(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a block pair: two blocks' vectors
        pivot, i, j = (k.as_py() for k in key[1:])
        held: dict[int, list] = {i: [], j: []}
        for batch in batches:
            for own, first, n, near, vector in zip(*(batch.column(c).to_pylist() for c in ("own", "first", "n", "near", "vector")), strict=True):
                held[own].append((first, n, near, np.array(vector)))
        found = None
        if held[i] and held[j] and not (i == j and len(held[i]) < 2):
            found = _compare(held[i], None if i == j else held[j], pivot, shared, threshold)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], names=["first", "links", "root"])

    found = cut(sent.groupBy("label", "pivot", "i", "j").applyInArrow(kernel, "first bigint, links bigint, root bigint"))
    links = found.groupBy("first").agg(F.sum("links").alias("links"))
    edges = found.where("first <> root").select(F.col("first").alias("a"), F.col("root").alias("b"))
    comp = components(edges)
    per = classes.join(links, "first", "left").join(comp.withColumnRenamed("node", "first"), "first", "left")
    per = per.select(F.col("label").alias("_l"), F.col("vector").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    joined = rows.join(per, (F.col("label") == F.col("_l")) & (F.col("vector") == F.col("_v")), "left")
    return joined.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
