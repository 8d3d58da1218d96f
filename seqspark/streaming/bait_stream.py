"""Screening of a stream of reads: each micro-batch is joined to the bait k-mers, as a batch of reads is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqspark.operators import bait


def screen(reads: DataFrame, baits: DataFrame, k: int, least: int) -> DataFrame:
    """(read_id, hits) of reads(read_id, seq) with hits of at least `least` bait k-mers; baits may be of any size."""
    return bait.hits(reads, baits, k, "read_id").where(F.col("hits") >= least)


def start(reads: DataFrame, baits: DataFrame, k: int, least: int, path: str, checkpoint: str) -> StreamingQuery:
    """Screens a stream of reads into a Parquet table at path, one partition `batch` for each micro-batch.

    A batch that runs again after a failure replaces its own partition, so each read is counted once.
    """

    def put(batch: DataFrame, number: int) -> None:
        screen(batch, baits, k, least).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
