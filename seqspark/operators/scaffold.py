"""Scaffolds: contigs put in order by mates, as layouts of contigs with gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.operators import layout
from seqspark.operators.chains import Save


def links(mates: DataFrame, lengths: DataFrame, size: int, least: int = 2, near: int | None = None) -> DataFrame:
    """(a, b, d, e, w): links between contigs, seen from the one of the smaller id, as layout() takes overlaps.

    mates(c1, pos1, len1, dir1, c2, pos2, len2, dir2) are pairs of reads that face each other, `size` apart from end to
    end; lengths(read_id, n) are those of contigs. A read points at the end of its contig that lies in its direction, and only counts
    where that is less than `near` away (size, if None). Pairs that link the same ends of two contigs are one link of w
    pairs, `least` at least, whose gap is their mean, rounded down; e is where b begins in a's direction.
    """
    near = size if near is None else near
    rows = mates.where("c1 <> c2").join(lengths.select(F.col("read_id").alias("c1"), F.col("n").alias("n1")), "c1").join(lengths.select(F.col("read_id").alias("c2"), F.col("n").alias("n2")), "c2")
    reach = lambda k: F.when(F.col(f"dir{k}") == 1, F.col(f"n{k}") - F.col(f"pos{k}")).otherwise(F.col(f"pos{k}") + F.col(f"len{k}"))
    rows = rows.withColumns({"r1": reach(1), "r2": reach(2)}).where((F.col("r1") <= near) & (F.col("r2") <= near))
    swap = F.col("c1") > F.col("c2")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    rows = rows.select(pick("c1", "c2").alias("a"), pick("c2", "c1").alias("b"), pick("dir1", "dir2").alias("da"), pick("dir2", "dir1").alias("db"), pick("n1", "n2").alias("na"), pick("n2", "n1").alias("nb"), (size - F.col("r1") - F.col("r2")).alias("gap"))
    each = rows.groupBy("a", "b", "da", "db", "na", "nb").agg(F.floor(F.avg("gap")).cast("long").alias("gap"), F.count("*").alias("w")).where(F.col("w") >= least)
    # contigs do not lie within each other: a gap reaches at most half into the shorter one
    gap = F.greatest(F.col("gap"), -F.floor(F.least("na", "nb") / 2))
    e = F.when(F.col("da") == 1, F.col("na") + gap).otherwise(-gap - F.col("nb"))
    return each.select("a", "b", F.when(F.col("da") == F.col("db"), -1).otherwise(1).alias("d"), e.cast("long").alias("e"), "w")


def scaffolds(found: DataFrame, lengths: DataFrame, save: Save) -> DataFrame:
    """(scaffold, contig, offset, dir, rank, ring) of every contig of lengths(read_id, n), by the heaviest link of each end that both ends share."""
    return layout.layout(found, lengths, save).select(F.col("contig").alias("scaffold"), F.col("read_id").alias("contig"), "offset", "dir", "rank", "ring")


def unused(found: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b, d, e, w): links that contradict the scaffolds: between contigs of different ones, or not of neighbours in the linked direction."""
    one = lambda k, c: placed.select(F.col("contig").alias(k), *(F.col(x).alias(f"{x}_{c}") for x in ("scaffold", "dir", "rank", "ring")))
    rows = found.join(one("a", "a"), "a").join(one("b", "b"), "b")
    same = (F.col("scaffold_a") == F.col("scaffold_b")) & (F.col("dir_a") * F.col("dir_b") == F.col("d"))
    # b follows a on a's own right side, so in the scaffold's direction if a has it
    step = F.when(F.col("e") > 0, F.col("dir_a")).otherwise(-F.col("dir_a"))
    next_ = (F.col("rank_b") - F.col("rank_a") == step) | F.col("ring_a") & (F.abs(F.col("rank_b") - F.col("rank_a")) > 1)
    return rows.where(~(same & F.coalesce(next_, F.lit(False)))).select(*found.columns)
