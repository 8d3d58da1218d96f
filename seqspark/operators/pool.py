"""Pools of reads: orders, buckets, groups, filters by library hits, chimera cuts and mates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspark.operators import bait, kmers


def by_name_order(reads: DataFrame, order: DataFrame) -> DataFrame:
    """reads in the order of order(name, nth), those it does not name last, by name."""
    rows = reads.join(order.groupBy("name").agg(F.min("nth").alias("_n")), "name", "left")
    return rows.orderBy(F.col("_n").asc_nulls_last(), "name").drop("_n")


def sorted_pool(reads: DataFrame) -> DataFrame:
    """reads(mapping, strain, seq, name): those to be mapped first, then by strain, the longest first, and name."""
    return reads.orderBy(F.desc("mapping"), "strain", F.length("seq").desc(), "name")


def bucket(pair_size, valid):
    """Where a read is written: debris, paired or unpaired."""
    return F.when(~valid, "debris").when(pair_size == 2, "paired").otherwise("unpaired")


def match_group(wanted: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """wanted with the id of the group that equals it in all keys, nulls included; null where none does."""
    of = groups.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("id").alias("group_id"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return wanted.join(of, same, "left").drop(*(f"_{k}" for k in keys))


def library_matches(reads: DataFrame, library: DataFrame, k: int, least: int, *keys: str) -> DataFrame:
    """reads(keys..., seq) that share at least `least` k-mers with a library, with hits. A control phage takes 11."""
    return bait.hits(reads, library, k, *keys).where(F.col("hits") >= least)


def adaptor_clips(reads: DataFrame, adaptors: DataFrame, k: int, least: int) -> DataFrame:
    """(read_id, right): where the leftmost of at least `least` k-mers of one adaptor begins, for the adaptor with most.

    reads(read_id, seq), adaptors(adaptor_id, seq). Of adaptors with equally many the one that begins first, then that of
    the smallest id, counts.
    """
    own = kmers.kmers(adaptors, k, "adaptor_id").distinct()
    hits = kmers.positioned(reads, k, "read_id").join(own, "kmer")
    each = hits.groupBy("read_id", "adaptor_id").agg(F.count("*").alias("n"), F.min("pos").alias("right")).where(F.col("n") >= least)
    return each.groupBy("read_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "right", "adaptor_id")).alias("x")).select("read_id", "x.right", "x.adaptor_id")


def repeat_positions(flags: DataFrame, k: int) -> DataFrame:
    """flags(read_id, pos, fork_f, fork_r) -> (read_id, pos): a forward fork k - 1 before and a reverse fork k - 1 after."""
    before = flags.where("fork_f").select("read_id", (F.col("pos") + k - 1).alias("pos"))
    after = flags.where("fork_r").select("read_id", (F.col("pos") - (k - 1)).alias("pos"))
    return before.join(after, ["read_id", "pos"], "left_semi")


def chimera_cuts(steps: DataFrame, k: int) -> DataFrame:
    """steps(read_id, start, stop) of overlap coverage -> (read_id, left, right, parts).

    Stretches that an uncovered one of at least 2k - 2 parts are parts of a chimera; the longest is kept, the
    first of equals.
    """
    w = W.partitionBy("read_id").orderBy("start")
    rows = steps.withColumn("new", F.when(F.col("start") - F.lag("stop").over(w) < 2 * k - 2, 0).otherwise(1)).withColumn("part", F.sum("new").over(w))
    parts = rows.groupBy("read_id", "part").agg(F.min("start").alias("left"), F.max("stop").alias("right"))
    best = F.max(F.struct((F.col("right") - F.col("left")).alias("n"), (-F.col("left")).alias("l"), "left", "right"))
    return parts.groupBy("read_id").agg(best.alias("x"), F.count("*").alias("parts")).select("read_id", "x.left", "x.right", "parts")


def mates(placed: DataFrame) -> DataFrame:
    """placed(template, segment, contig, pos) with mate_contig and mate_pos, null unless a template has two reads."""
    w = W.partitionBy("template")
    order = w.orderBy("segment", "contig", "pos")
    rows = placed.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(order)})
    other = lambda c: F.when(F.col("_n") == 2, F.when(F.col("_k") == 1, F.lead(c).over(order)).otherwise(F.lag(c).over(order)))
    return rows.select(*placed.columns, other("contig").alias("mate_contig"), other("pos").alias("mate_pos"))


def gene_summary(features: DataFrame) -> DataFrame:
    """(contig, locus, names, first, last): features of one locus put together, names in order without repetition."""
    return features.groupBy("contig", "locus").agg(F.array_join(F.array_sort(F.collect_set("name")), ","), F.min("lo"), F.max("hi")).toDF("contig", "locus", "names", "first", "last")


#: Coverages from which a warning is worded more strongly.
COVERAGE_RUNGS = (80, 150, 300)


def high_coverage(contigs: DataFrame, most: float) -> DataFrame:
    """contigs(cov) with a warning where the whole coverage is above `most`: 1, and 2, 3, 4 for pretty high, very high and absurd ones."""
    cov, level = F.floor("cov"), F.lit(1)
    for k, rung in enumerate(COVERAGE_RUNGS, 2):
        level = F.when(cov >= rung, k).otherwise(level)
    return contigs.withColumn("warning", F.when(cov > most, level).otherwise(0))
