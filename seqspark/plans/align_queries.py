"""Queries of alignments and of normalisation in order, which SQL can't express; they are tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.operators import banded, normalise, overlap
from seqspark.plans.adapter import reads
from seqspark.plans.read_queries import _placed_kmers, saver
from seqspark.plans.registry import query


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of the weightiest overlap on each side of a read, each pair once."""
    best = overlap.paired_top(_placed_kmers(spark, sf_dir), saver(spark), 1, 2)
    turned = F.col("rid1") < F.col("rid2")
    pairs = best.select(F.greatest("rid1", "rid2").alias("rid1"), F.least("rid1", "rid2").alias("rid2"), F.when(turned, -F.col("eoffset")).otherwise(F.col("eoffset")).alias("eoffset")).distinct()
    own = reads(spark, sf_dir).select("read_id", "seq")
    # where read 2 begins in read 1
    rows = pairs.join(own.select(F.col("read_id").alias("rid1"), F.col("seq").alias("seq1")), "rid1").join(own.select(F.col("read_id").alias("rid2"), F.col("seq").alias("seq2")), "rid2")
    # alignments cost far more than their bytes tell, so partitions must not be put together by size
    return banded.alignments(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rid1", "rid2"), with_text=False)


@query()
def overlap_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).drop("aligned1", "aligned2")


@query()
def alignment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted alignments as edges of both reads, heaviest first for each: (rid1, rid2, weight, ratio, rank)."""
    return banded.edges(_aligned(spark, sf_dir))


@query()
def alignment_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose alignment was not accepted, which are not tried again: (lo, hi)."""
    return banded.bans(_aligned(spark, sf_dir))


@query()
def normalised_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each language that are kept where a k-mer needs three; ids two by two are pairs, long reads are good."""
    r = reads(spark, sf_dir).select("read_id", F.col("lang").alias("rg"), "seq")
    pairs = r.withColumn("good", F.length("seq") >= 1000).withColumn("partner", F.col("read_id") + F.when(F.col("read_id") % 2 == 0, 1).otherwise(-1))
    return normalise.normalise(normalise.steps(pairs).withColumn("masked", F.lit(True)), 12, saver(spark), 3)
