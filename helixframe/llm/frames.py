"""Spark plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own in the warehouse only where that is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def cut(frame: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there, so that lost executors cost no recomputation."""
    spark = frame.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return frame.checkpoint(eager=True)


#: Tables written since temporary() was entered, of each nesting in turn.
_OPEN: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables that are stored within are deleted at the end; what is to stay has to be stored by then outside of it, or read."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        release(spark)


def stored(frame: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """As :func:`cut`, as a Parquet table, which later reads prune by column. outer: it outlives the innermost temporary()."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if len(_OPEN) > outer:
        _OPEN[-1 - outer].append(path)
    with _hash_joins(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Size, as it is shuffled, up to which every part of a join's side has to be for the join to go by hash table, without sorting.
HASHED = "8m"


@contextlib.contextmanager
def _hash_joins(spark: SparkSession):
    """Joins that run within go by hash table where Spark has found that the parts of a side are small."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, HASHED)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(kernel: Callable) -> Callable:
    """The kernel, which returns what it freed to the system at its end: workers are kept for later tasks, of which only some
    are busy at a time, and the allocators of those that wait hold on to it."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def map_batches(frame: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with the columns in the schema's types; see :func:`lean`."""
    return frame.mapInArrow(lean(kernel), schema)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs that nothing refers to any more: it finds them when the driver's
    memory is collected, which may be long after. Executors collect theirs too, and give back what heap and buffers are free:
    between steps they hold next to nothing, but keep all that the largest step took."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    # as many tasks as there are cores, so that no executor is left out
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()
