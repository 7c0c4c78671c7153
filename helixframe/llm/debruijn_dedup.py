"""Operator 6: substring dedup by De Bruijn compaction.

The graph's nodes are the 12-grams of words, its edges the 13-grams (``WINDOW`` words between ASCII white space). A
document is a walk; it is cut where the least 5-gram hash of the edge changes, so that equal edges always come to
lie in runs with one key, and a run of up to 13 edges is a nonbranching path as far as its document goes.

1. Keys that occur in two documents or more are the repeated part of the graph. A sketch of them, of fixed size, keeps
   the other runs from being shuffled; the join with the keys themselves is exact.
2. Runs with equal words compact to one path, which carries the least document that walks it: the source.
3. Where the paths of a key differ, the graph branches there: they are taken apart into edges, and each edge gets the
   least source of all paths that hold it.
4. Each run meets its path again: an edge whose source is a smaller document is repeated. Neighbouring repeated
   edges of a document join to spans, with their source documents, and the words they cover are removed.

Defined results: null and empty texts have no words; documents with equal ids don't remove words from each other, but a
third with a greater id loses what either holds; a row with a null id keeps all words and is nobody's source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import release, stored
from .sieve import passes, sieve
from .vec import SpanHash, anchor_runs, ragged, row_of, slices, text_buffer, white_words

WINDOW, GRAM = 13, 5


def _walks(buf: np.ndarray, offsets: np.ndarray):
    """key, first edge, edge after the last, and row of each run; the words' hash; offsets of the rows in words."""
    start, stop, word_off = white_words(buf, offsets)
    words = SpanHash(SpanHash(buf.astype(np.uint64) + np.uint64(1), narrow=True)(start, stop))
    key, lo, hi = anchor_runs(words.sliding(GRAM), word_off, WINDOW, GRAM)
    return key, lo, hi, row_of(lo, word_off), words, word_off


def _keys(texts: DataFrame) -> DataFrame:
    """key, doc_id of every run."""

    def kernel(batches):
        for batch in slices(batches, "text", 2 << 20):
            key, _, _, row, _, _ = _walks(*text_buffer(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(row))], names=["key", "doc_id"])

    return texts.select("doc_id", "text").mapInArrow(kernel, "key bigint, doc_id bigint")


def _runs(texts: DataFrame, bitmap) -> DataFrame:
    """key, path (hash of the run's words), doc_id, row (hash of the text), lo (first edge), n, edges of the runs that
    pass the sieve."""

    def kernel(batches):
        for batch in slices(batches, "text", 2 << 20):
            key, lo, hi, row, words, word_off = _walks(*text_buffer(batch.column(1)))
            some = passes(bitmap.value, key)
            key, lo, hi, row = key[some], lo[some], hi[some], row[some]
            path = words(lo, hi - 1 + WINDOW)
            each = ragged(lo, hi - lo)
            edges = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32)), pa.array(words(each, each + WINDOW).view(np.int64)))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(path.view(np.int64)), batch.column(0).take(at), batch.column(2).take(at), pa.array((lo - word_off[row]).astype(np.int32)), edges], names=["key", "path", "doc_id", "row", "lo", "edges"])

    return texts.mapInArrow(kernel, "key bigint, path bigint, doc_id bigint, row bigint, lo int, edges array<bigint>")


def repeated_edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, spans: array of (lo, mask, source): bit t of mask is set where edge lo + t of the document also
    starts in a smaller one; source: the least document that walks the run's path."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("row")).where("doc_id is not null")
    shared = _keys(texts).groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    shared = stored(shared, "shared-keys")
    release(spark)
    runs = stored(_runs(texts, sieve(shared, "key")).join(shared, "key"), "runs")
    release(spark)
    slim = runs.select("key", "path", "doc_id", "row", "lo", F.size("edges").alias("n"))
    paths = stored(runs.groupBy("key", "path").agg(F.min("doc_id").alias("source")), "paths")
    release(spark)
    forks = paths.groupBy("key").agg(F.count("*").alias("ways")).where("ways > 1").select("key")
    apart = paths.join(forks, "key")
    held = runs.select("key", "path", "doc_id", "edges").join(apart, ["key", "path"]).where("doc_id = source").dropDuplicates(["key", "path"])
    edges = stored(held.select("key", "path", "source", F.posexplode("edges").alias("t", "edge")), "edges")
    release(spark)
    least = edges.groupBy("edge").agg(F.min("source").alias("least"))
    sources = edges.join(least, "edge").groupBy("key", "path").agg(F.array_sort(F.collect_list(F.struct("t", "least"))).alias("ts"))
    sources = sources.select("key", "path", F.transform("ts", lambda x: x["least"]).alias("leasts"))
    met = slim.join(paths, ["key", "path"]).join(sources, ["key", "path"], "left")
    ones = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0), lambda acc, t: acc + F.when(F.get("leasts", t) < F.col("doc_id"), F.call_function("shiftleft", F.lit(1), t)).otherwise(F.lit(0)))
    whole = F.when(F.col("source") < F.col("doc_id"), F.call_function("shiftleft", F.lit(1), F.col("n")) - 1).otherwise(F.lit(0))
    mask = F.when(F.col("leasts").isNull(), whole).otherwise(ones)
    hit = met.select("doc_id", "row", "lo", mask.alias("mask"), "source").where("mask <> 0")
    return hit.groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "mask", "source")).alias("spans"))


def covered(n_words: int, spans: pa.Scalar) -> np.ndarray:
    """Which words of a document its repeated edges cover."""
    out = np.zeros(n_words + WINDOW + 1, np.int64)
    values = spans.values
    lo = values.field("lo").to_numpy()
    mask = values.field("mask").to_numpy().astype(np.int64)
    for t in range(WINDOW):
        at = lo[(mask >> t) & 1 == 1] + t
        np.add.at(out, at, 1)
        np.add.at(out, at + WINDOW, -1)
    return np.cumsum(out)[:n_words] > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts_out: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256; kept_text instead of the digest if texts_out."""
    spark = docs.sparkSession
    spans = stored(repeated_edges(docs, id_col, text_col), "spans").withColumnsRenamed({"doc_id": "_d", "row": "_r"})
    release(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    joined = rows.join(spans, (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_r")), "left").select("doc_id", "text", "spans")
    last = "kept_text" if texts_out else "kept_sha256"

    def kernel(batches):
        for batch in slices(batches, "text"):
            buf, off = text_buffer(batch.column(1))
            start, stop, word_off = white_words(buf, off)
            n = np.diff(word_off)
            removed, kept = np.zeros(len(n), np.int64), []
            for i in range(len(n)):
                a, b = start[word_off[i] : word_off[i + 1]], stop[word_off[i] : word_off[i + 1]]
                spans = batch.column(2)[i]
                if spans.is_valid:
                    gone = covered(int(n[i]), spans)
                    removed[i] = gone.sum()
                    a, b = a[~gone], b[~gone]
                # each word with one space after it
                size = b - a + 1
                out = buf[np.minimum(ragged(a, size), max(len(buf) - 1, 0))].copy()
                out[np.cumsum(size) - 1] = 32
                raw = out[:-1].tobytes()
                kept.append(raw.decode("utf-8", "surrogatepass") if texts_out else hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(removed), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", last])

    return joined.mapInArrow(kernel, f"doc_id bigint, n_words bigint, n_removed bigint, {last} string").withColumnRenamed("doc_id", id_col)
