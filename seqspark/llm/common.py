"""Helpers shared by the corpus operators: tables, scratch tables, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to a Python worker. Long texts make rows large.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python workers by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose column holds at most `limit` bytes each (one row at least)."""
    if not batch.num_rows:
        return
    if batch.column(column).nbytes <= limit:
        yield batch
    elif batch.num_rows == 1:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), column, limit)
        yield from slices(batch.slice(half), column, limit)


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def release() -> None:
    """Give freed memory back to the system, which a reused Python worker would otherwise keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which gives its memory back when a task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a local one only on a single machine that sets none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return found or "/tmp/checkpoints/seqspark"


def most_files(spark: SparkSession) -> int | None:
    """Tasks that write a scratch table at most: three for each core, and one for eight shuffle partitions.

    A file costs more than its bytes (on a local file system each starts processes that set its mode). None,
    no bound, where the number of cores changes while jobs run.
    """
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return None
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


class Scratch:
    """Tables written to the shared folder. They cut the lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{scratch_dir(spark)}/{uuid.uuid4().hex}", []

    def save(self, df: DataFrame, name: str = "t", few: bool = False) -> DataFrame:
        """Write df and read it back. few: its rows are few for the tasks that make them, so gather them into full files."""
        path = f"{self.root}/{name}-{len(self.paths)}"
        self.paths.append(path)
        schema = df.schema
        most = most_files(self.spark)
        df = df.hint("rebalance") if few else df
        (df.coalesce(most) if most else df).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        release()  # plans that Python still names would stay in the driver's memory


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges(a, b): rows (id, component), component the smallest id.

    Alternates large-star and small-star steps (both keep connectivity and only lower labels), so chains
    halve each round; tables are written between rounds. Vertices without an edge have no row. An empty
    edge table gives an empty result; self loops and repeated edges change nothing.
    """
    e = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")

    def star(d: DataFrame, large: bool) -> DataFrame:
        """Edges (u, v): join u's neighbours to the smallest of them and u. Small: only neighbours below u."""
        n = d.union(d.select("b", "a")).toDF("u", "v") if large else d.toDF("u", "v")
        m = n.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        j = n.join(m, "u")
        if large:
            return j.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return j.select(F.col("v").alias("a"), F.col("m").alias("b")).union(m.select("u", "m")).where("a <> b")

    def mark(d: DataFrame) -> tuple:
        r = d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    before = mark(e)
    for _ in range(max_rounds):
        new = scratch.save(star(star(e, True).distinct(), False).distinct(), "cc")
        now = mark(new)
        scratch.drop(e)
        e = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
