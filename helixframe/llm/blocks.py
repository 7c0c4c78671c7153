"""Work on groups of any size as pairs of bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches


def block_pairs(rows: DataFrame, group: list[str], member: list[str], block: int) -> DataFrame:
    """Each row once for every pair of blocks of its group that holds its own block.

    A group of m rows has ceil(m / block) blocks, which a hash of the member columns deals it to. Adds i <= j (the
    pair), own (the row's block) and g, a hash of group, i and j by which :func:`run_groups` brings a pair together.
    Groups of a single row go.
    """
    counts = rows.groupBy(*group).agg(F.count("*").alias("_m")).where("_m > 1")
    counts = counts.withColumn("_blocks", F.ceil(F.col("_m") / block).cast("int")).drop("_m")
    placed = rows.join(counts, group).withColumn("own", F.pmod(F.xxhash64(F.lit(5), *member), F.col("_blocks")).cast("int"))
    sent = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    sent = sent.withColumn("i", F.least("own", "_with")).withColumn("j", F.greatest("own", "_with")).drop("_with", "_blocks")
    return sent.withColumn("g", F.xxhash64(*group, "i", "j"))


def run_groups(rows: DataFrame, kernel: Callable[[pa.Table], pa.RecordBatch | None], schema: str, batch_rows: int = 20_000) -> DataFrame:
    """kernel applied to all rows of each value of g, many values in a task one after another."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        out: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(batch.schema.get_field_index("g")).to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and g[a] != last:
                    done = kernel(pa.Table.from_batches(held))
                    held = []
                    if done is not None:
                        out.append(done)
                        n += done.num_rows
                        if n >= batch_rows:
                            yield from out
                            out, n = [], 0
                held.append(batch.slice(a, b - a))
                last = g[a]
        if held:
            done = kernel(pa.Table.from_batches(held))
            if done is not None:
                out.append(done)
        yield from out

    return map_batches(rows.repartition("g").sortWithinPartitions("g"), each, schema)


def run_packs(rows: DataFrame, key: str, kernel: Callable[[pa.Table], pa.RecordBatch], schema: str, pack: int) -> DataFrame:
    """kernel applied to packs of whole key groups, of about ``pack`` rows each; no group may be larger than that."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < pack:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            k = table.column(key).to_numpy()
            cuts = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, 0)  # starts of groups; the last group stays
            start = 0
            while True:
                later = cuts[(cuts > start) & (cuts <= start + pack)]
                if table.num_rows - start < pack or not len(later):
                    break
                yield kernel(table.slice(start, int(later.max()) - start))
                start = int(later.max())
            held, n = table.slice(start).to_batches(), table.num_rows - start
        if held:
            yield kernel(pa.Table.from_batches(held))

    return map_batches(rows.repartition(key).sortWithinPartitions(key), each, schema)
