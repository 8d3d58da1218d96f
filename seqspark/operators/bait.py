"""Screening of reads against bait k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions import scalar
from seqspark.operators import kmers


def bait_kmers(baits: DataFrame, k: int) -> DataFrame:
    """Distinct k-mers of baits.seq on both strands."""
    one = kmers.kmers(baits, k).distinct()
    return one.union(one.select(scalar.reverse_complement(F.col("kmer")))).distinct()


def hits(reads: DataFrame, baits: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys..., hits): positions of each read whose k-mer a bait has; reads without any have no row.

    Equal k-mers of a read are summed before the join, so a repetitive read costs one row per distinct k-mer.
    """
    own = kmers.kmers(reads, k, *keys).groupBy(*keys, "kmer").agg(F.count("*").alias("n"))
    return own.join(bait_kmers(baits, k), "kmer").groupBy(*keys).agg(F.sum("n").alias("hits"))


def wanted(length, k: int, least: int):
    """Hits that a read needs: least if above 0, else its number of k-mers plus least, 0 at least."""
    return F.lit(least) if least > 0 else F.greatest(F.lit(0), length - (k - 1) + least)


def take(reads: DataFrame, baits: DataFrame, k: int, least: int, *keys: str) -> DataFrame:
    """reads with hits and taken."""
    out = reads.join(hits(reads, baits, k, *keys), list(keys), "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("taken", F.col("hits") >= wanted(F.length("seq"), k, least))


def rescue(taken: DataFrame, template: str) -> DataFrame:
    """taken with `kept`: a read stays if any of its template is taken."""
    mates = taken.groupBy(template).agg(F.max("taken").alias("kept"))
    return taken.join(mates, template)
