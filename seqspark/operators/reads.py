"""Clips, junk filters and pairs of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons for which a read is set aside.
OK, TOO_SHORT, POLY_RUN, LOW_QUALITY = 0, 1, 2, 3


def lower_front(seq: Column) -> Column:
    """Length of the leading stretch of lower case letters, N and X."""
    return F.length(F.regexp_extract(seq, "^[a-zNX]*", 0))


def lower_back(seq: Column) -> Column:
    return F.length(F.regexp_extract(seq, "[a-z]*$", 0))


def poly_junk(seq: Column, base: str, sure: int, maybe: int, percent: int) -> Column:
    """A run of `sure` bases, or of `maybe` with less than `percent` (rounded down) other bases, of a read within its clips.

    Case does not matter, and N neither ends a run nor counts as a base.
    """
    s = F.replace(F.translate(seq, "acgtn", "ACGTN"), F.lit("N"), F.lit(""))
    other = F.length(F.replace(s, F.lit(base), F.lit("")))
    return s.contains(base * sure) | (s.contains(base * maybe) & (F.floor(F.lit(100.0) / F.greatest(F.lit(1), F.length(s)) * other) < percent))


def debris(seq: Column, quality: Column, least: int, least_quality: int) -> Column:
    """Reason code; the first that applies."""
    return F.when(F.length(seq) < least, TOO_SHORT).when(poly_junk(seq, "A", 20, 12, 20) | poly_junk(seq, "T", 20, 12, 20), POLY_RUN).when(quality < least_quality, LOW_QUALITY).otherwise(OK)


def resolve_pairs(reads: DataFrame, template: str, segment: str, name: str) -> DataFrame:
    """reads with partner and pair_size; templates of other than two reads have no partners."""
    groups = reads.groupBy(template).agg(F.count("*").alias("pair_size"), F.min(name).alias("lo"), F.max(name).alias("hi"))
    partner = F.when(F.col("pair_size") == 2, F.when(F.col(name) == F.col("lo"), F.col("hi")).otherwise(F.col("lo")))
    return reads.join(groups, template).select(*reads.columns, "pair_size", partner.alias("partner"))


def sam_flags(pairs: DataFrame, low: int, high: int) -> DataFrame:
    """pairs(template, pos1, len1, rev1, pos2, len2, rev2) -> flag1, flag2, tlen, proper.

    A proper pair has reads that face each other and a template length within the range widened by 5% of it.
    """
    start, stop = F.least("pos1", "pos2"), F.greatest(F.col("pos1") + F.col("len1"), F.col("pos2") + F.col("len2"))
    tlen, slack = stop - start, (high - low) * 0.05
    facing = F.when(F.col("pos1") <= F.col("pos2"), ~F.col("rev1") & F.col("rev2")).otherwise(F.col("rev1") & ~F.col("rev2"))
    proper = facing & (tlen >= low - slack) & (tlen <= high + slack)
    bit = lambda c, v: F.when(c, v).otherwise(0)
    flag = lambda own, mate, nth: F.lit(1 + nth) + bit(proper, 2) + bit(F.col(own), 16) + bit(F.col(mate), 32)
    return pairs.select("template", flag("rev1", "rev2", 64).alias("flag1"), flag("rev2", "rev1", 128).alias("flag2"), tlen.alias("tlen"), proper.alias("proper"))


def infer_templates(sizes: DataFrame, least: int = 100) -> DataFrame:
    """sizes(rg, tlen) -> mean and deviation of template sizes within 3 deviations, of groups of enough samples."""
    one = sizes.groupBy("rg").agg(F.avg("tlen").alias("m"), F.stddev_samp("tlen").alias("d"), F.count("*").alias("n")).where(F.col("n") >= least)
    inner = sizes.join(one.select("rg", "m", "d"), "rg").where(F.abs(F.col("tlen") - F.col("m")) <= 3 * F.col("d"))
    return inner.groupBy("rg").agg(F.count("*").alias("n"), F.avg("tlen").alias("mean_size"), F.stddev_samp("tlen").alias("stddev_size"))
