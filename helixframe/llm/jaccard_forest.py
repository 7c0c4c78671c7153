"""Operator 10: n-gram Jaccard join by a MinHash LSH forest.

A text's shingles are its runs of ``SHINGLE`` words between ASCII white space (all its words where there are fewer).
Texts with equal words in equal order are one class; the least id stands for it.

1. Signatures: ``TREES`` trees of ``DEPTH`` min-hashes of one byte each. A tree's bytes, most significant first, are one
   64-bit key, so that sorted keys are the tree's prefix trie, and a node at depth d is the keys with d equal leading
   bytes.
2. Matched prefixes are shortened from the full depth, level by level, until the recall, measured on the pairs found so far,
   reaches the target (:func:`candidates`). A node is compared at the depth where it gains members, child against child.
3. In each node, blocks of signatures are compared; pairs whose signatures agree in too few bytes for the threshold (by
   more than five standard deviations) fall out, and of the rest a spanning forest is returned.
4. The forests' components are the candidate groups. In each, blocks of exact shingle sets are intersected, and every
   pair with Jaccard >= threshold is a link. Pairs are counted where they are found and never become rows.

Defined results: null and empty texts (no words) are linked with nothing, each a class of its own; a row with a null id
gets null class and group and counts for nobody; rows that repeat an id are documents of their own, of one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_pairs, run_groups
from .components import components, local_components
from .frames import map_batches, release, stored, temporary
from .vec import SpanHash, mix64, slices, text_buffer, white_words

SHINGLE = 5
TREES, DEPTH = 24, 8
_RNG = np.random.default_rng(97)
_MULTIPLY = (_RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_FLIP = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def estimate(agree):
    """Likeness of signatures by the bytes that agree, of which one in 256 does by chance."""
    return np.clip((np.asarray(agree) / (TREES * DEPTH) - 1 / 256) / (1 - 1 / 256), 0, 1)


def chance(likeness, depth: int):
    """That two signatures of this likeness share a prefix of this depth in one tree at least."""
    return 1 - (1 - likeness**depth) ** TREES


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, SpanHash, np.ndarray]:
    """Hashes of all shingles of a batch, the n+1 offsets of the rows in them, the words' hash and their offsets."""
    start, stop, word_off = white_words(buf, offsets)
    words = SpanHash(SpanHash(buf.astype(np.uint64) + np.uint64(1), narrow=True)(start, stop))
    n = np.diff(word_off)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    off = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    first = word_off[:-1][row] + np.arange(off[-1]) - off[:-1][row]
    return words(first, np.minimum(first + SHINGLE, word_off[1:][row])), off, words, word_off


def tree_keys(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x TREES keys; rows without shingles get zeros."""
    out = np.zeros((len(off) - 1, TREES), np.uint64)
    full = np.flatnonzero(np.diff(off))
    if not len(full):
        return out
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    at = off[:-1][full]
    work = np.empty_like(x)
    for k in range(TREES * DEPTH):
        np.bitwise_xor(x, _FLIP[k], out=work)
        np.multiply(work, _MULTIPLY[k], out=work)
        least = np.minimum.reduceat(work, at)
        tree, level = divmod(k, DEPTH)
        byte = (mix64(least.astype(np.uint64)) & np.uint64(255)) << np.uint64(8 * (DEPTH - 1 - level))
        out[full, tree] |= byte
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, c1, c2 (128-bit hash of the words; null without words), trees."""

    def kernel(batches):
        for batch in slices(batches, "text", 1 << 20):
            buf, off = text_buffer(batch.column(1))
            h, shingle_off, words, word_off = shingles(buf, off)
            keys = tree_keys(h, shingle_off)
            c1 = words(word_off[:-1], word_off[1:])
            c2 = SpanHash(mix64(h))(shingle_off[:-1], shingle_off[1:])
            empty = np.diff(word_off) == 0
            trees = pa.ListArray.from_arrays(pa.array(np.arange(0, len(off) * TREES, TREES)[: len(off)].astype(np.int32)), pa.array(keys.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c1.view(np.int64), mask=empty), pa.array(c2.view(np.int64), mask=empty), trees], names=["doc_id", "c1", "c2", "trees"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, kernel, "doc_id bigint, c1 bigint, c2 bigint, trees array<bigint>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """The columns and the sorted distinct shingles of text, where text is the one that c1 stands for."""
    names = [c for c in texts.columns if c != "text"]

    def kernel(batches):
        for batch in slices(batches, "text", 1 << 20):
            buf, off = text_buffer(batch.column(batch.schema.get_field_index("text")))
            h, so, words, word_off = shingles(buf, off)
            own = words(word_off[:-1], word_off[1:]).view(np.int64) == batch.column(batch.schema.get_field_index("c1")).to_numpy()
            row = np.repeat(np.arange(len(so) - 1), np.diff(so))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(so) - 1))]).astype(np.int32)), pa.array(h[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), sets], names=[*names, "set"]).filter(pa.array(own))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "text")
    return map_batches(texts, kernel, f"{schema}, set array<bigint>")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Orders the rows of a block pair: indices of block i, of block j (the same where i = j)."""
    own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
    if i[0] == j[0]:
        return np.arange(len(own)), np.arange(len(own))
    return np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = table.column(name).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    off = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]


def alike(least: int, depth: int, threshold: float):
    """Of a node: a spanning forest (a, b) of the pairs whose signatures agree in ``least`` bytes and that the node's children
    don't hold already; and rows without a that count (seen), by the bytes that agree (b), the pairs that seem to reach the threshold,
    each in the node where it is met first."""

    def kernel(table: pa.Table) -> pa.RecordBatch | None:
        a, b = _sides(table)
        if not len(a) or not len(b):
            return None
        first, tree = table.column("first").to_numpy(), int(table.column("tree")[0].as_py())
        flat, _ = _flat(table, "trees")
        # bytes of a key, most significant first
        sig = flat.view(np.uint8).reshape(len(first), TREES, DEPTH)[:, :, ::-1]
        whole = np.ascontiguousarray(sig).reshape(len(first), TREES * DEPTH)
        child = whole[:, tree * DEPTH + depth] if depth < DEPTH else None
        left, right, agree = [], [], []
        for at in range(0, len(a), 64):
            some = a[at : at + 64]
            same = (whole[some, None, :] == whole[None, b, :]).sum(2, dtype=np.int16)
            hit = (same >= least) & (some[:, None] != b[None, :])
            if child is not None:
                hit &= child[some][:, None] != child[b][None, :]
            x, y = np.nonzero(hit)
            left.append(some[x])
            right.append(b[y])
            agree.append(same[x, y])
        x, y, n = np.concatenate(left), np.concatenate(right), np.concatenate(agree)
        root = local_components(x, y, len(first))
        joined = np.flatnonzero(root != np.arange(len(first)))
        # each pair once: in the first tree whose prefixes of this depth agree, in one order
        count = np.flatnonzero((estimate(n) >= threshold) & (first[x] < first[y]))
        seen = np.zeros(TREES * DEPTH + 1, np.int64)
        for cut in range(0, len(count), 1 << 14):
            k = count[cut : cut + (1 << 14)]
            met = (sig[x[k], : tree + 1, :depth] == sig[y[k], : tree + 1, :depth]).all(2)
            k = k[met.argmax(1) == tree]
            if depth < DEPTH:  # and not in any tree at a greater depth
                k = k[~(sig[x[k], :, : depth + 1] == sig[y[k], :, : depth + 1]).all(2).any(1)]
            seen += np.bincount(n[k], minlength=len(seen))
        some = np.flatnonzero(seen)
        one = pa.concat_arrays([pa.array(first[joined]), pa.nulls(len(some), pa.int64())])
        return pa.RecordBatch.from_arrays([one, pa.array(np.concatenate([first[root[joined]], some])), pa.array(np.concatenate([np.zeros(len(joined), np.int64), seen[some]]))], names=["a", "b", "seen"])

    return kernel


def candidates(keys: DataFrame, threshold: float, target: float, block: int) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Edges a, b, whose components hold the candidates; and the depths taken, with the recall measured at each. keys: first, trees.

    The tries are read from the full depth up. At each depth the nodes are compared that have members of several children, and
    only those with each other. Then the recall is measured: each pair found that seems to reach the threshold stands for the
    1 / chance(likeness, depth) pairs there should be of it; one pair right at the threshold is assumed to be missed besides, so
    that few pairs prove nothing. Prefixes are shortened until that reaches the target."""
    spark = keys.sparkSession
    share = threshold + (1 - threshold) / 256
    least = int(TREES * DEPTH * share - 5 * (TREES * DEPTH * share * (1 - share)) ** 0.5)
    edges, depths, seen = None, [], np.zeros(TREES * DEPTH + 1)
    for depth in range(DEPTH, 0, -1):
        node = F.transform("trees", lambda k: F.shiftrightunsigned(k, 8 * (DEPTH - depth)))
        nodes = keys.select("first", F.posexplode(F.arrays_zip(node.alias("node"), F.col("trees").alias("leaf"))).alias("tree", "x")).select("first", "tree", "x.node", F.shiftrightunsigned(F.col("x.leaf"), 8 * max(0, DEPTH - depth - 1)).alias("child"))
        several = F.min("child") < F.max("child") if depth < DEPTH else F.count("*") > 1
        grown = nodes.groupBy("tree", "node").agg(several.alias("grown")).where("grown").select("tree", "node")
        with temporary(spark):
            members = nodes.drop("child").join(grown, ["tree", "node"]).join(keys.select("first", "trees"), "first")
            found = stored(run_groups(block_pairs(members, ["tree", "node"], ["first"], block), alike(least, depth, threshold), "a bigint, b bigint, seen bigint"), "forest", True)
        new = found.where("a is not null").select("a", "b")
        edges = new if edges is None else edges.unionByName(new)
        for r in found.where("a is null").groupBy("b").agg(F.sum("seen").alias("n")).collect():  # a row for each number of bytes
            seen[r.b] += r.n
        some = np.flatnonzero(seen)
        missed = (seen[some] * (1 / chance(estimate(some), depth) - 1)).sum()
        recall = seen.sum() / (seen.sum() + missed + 1 - chance(threshold, depth)) if len(some) else float(chance(threshold, depth))
        depths.append((depth, recall))
        if recall >= target:
            break
    return edges, depths


def shared_counts(values: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray, columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of the sets of rows a with those of rows b, exact."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    _, value, count = np.unique(values, return_inverse=True, return_counts=True)
    often = count > 1  # a value in a single set meets nothing
    rank = np.cumsum(often) - 1
    keep = often[value]
    row, value = row[keep], rank[value[keep]]
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(often.sum()), columns):
        s = slice(np.searchsorted(value, low), np.searchsorted(value, low + columns))
        m = np.zeros((len(off) - 1, min(columns, int(often.sum()) - low)), np.float32)
        m[row[s], value[s] - low] = 1
        out += m[a] @ m[b].T
    return out


def linked(threshold: float):
    """Links of each class of a candidate group's block pair, and a spanning forest of them."""

    def kernel(table: pa.Table) -> pa.RecordBatch | None:
        a, b = _sides(table)
        if not len(a) or not len(b):
            return None
        first, n = table.column("first").to_numpy(), table.column("n").to_numpy()
        values, off = _flat(table, "set")
        size = np.diff(off)
        both = shared_counts(values, off, a, b)
        union = size[a][:, None] + size[b][None, :] - both
        hit = both >= threshold * union - 1e-9
        if a is b or (len(a) == len(b) and (a == b).all()):
            hit = np.triu(hit, 1)
        x, y = np.nonzero(hit)
        x, y = a[x], b[y]
        links = np.bincount(x, n[y], len(first)) + np.bincount(y, n[x], len(first))
        root = local_components(x, y, len(first))
        some = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(first[some]), pa.array(links[some].astype(np.int64)), pa.array(first[root[some]])], names=["first", "links", "root"]) if len(some) else None

    return kernel


def near_duplicates(docs: DataFrame, threshold: float = 0.8, target: float = 0.9995, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, class_id (least id with equal words), n_links (other documents linked directly), component_id
    (least id reachable by links), kept (id = component_id)."""
    rows = stored(signatures(docs, id_col, text_col), "signatures")
    ok = F.col("c1").isNotNull() & F.col("doc_id").isNotNull()
    classes = stored(rows.where(ok).groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    keys = rows.where(ok).join(classes, ["c1", "c2"]).where("doc_id = first").dropDuplicates(["c1", "c2"]).select("first", "c1", "n", "trees")
    keys = stored(keys, "class-trees")
    forest, _ = candidates(keys.select("first", "trees"), threshold, target, block)
    groups = stored(components(forest), "candidate-groups")
    release(keys.sparkSession)
    # exact sets of the candidates
    chosen = groups.join(keys.select(F.col("first").alias("node"), "c1", "n"), "node").select(F.col("node").alias("first"), "c1", "n", "component")
    texts = docs.select(F.col(id_col).cast("bigint").alias("first"), F.col(text_col).alias("text"))
    sets = shingle_sets(texts.join(chosen, "first").dropDuplicates(["first", "c1", "text"]))
    found = stored(run_groups(block_pairs(sets, ["component"], ["first"], block), linked(threshold), "first bigint, links bigint, root bigint"), "links")
    links = found.groupBy("first").agg(F.sum("links").alias("links"))
    comp = components(found.where("first <> root").select(F.col("first").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("first"), "component")
    per = classes.join(links, "first", "left").join(comp, "first", "left")
    per = per.select("c1", "c2", F.col("first").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    out = rows.drop("trees").join(per, ["c1", "c2"], "left")
    own = F.coalesce(F.col("component_id"), F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(False)).alias("kept"))
