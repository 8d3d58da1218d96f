"""Intervals on contigs by bins of positions, so that no task holds a whole contig."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions of a bin, and rows of a partition that is sorted or grouped.
BIN, ROWS = 4096, 1_000_000


def bin_of(position, width: int = BIN):
    return F.floor(position / width).cast("long")


def touching(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of left(contig, lo, hi, ...) and right(contig, start, stop, ...) that share a position; hi and stop are exclusive.

    Both are replicated to the bins they reach into, and a pair counts in the bin where the later one begins.
    Columns besides contig must differ; empty intervals touch nothing.
    """
    a = left.where("hi > lo").withColumn("_bin", F.explode(F.sequence(bin_of(F.col("lo"), width), bin_of(F.col("hi") - 1, width))))
    b = right.where("stop > start").withColumn("_bin", F.explode(F.sequence(bin_of(F.col("start"), width), bin_of(F.col("stop") - 1, width))))
    met = a.join(b, ["contig", "_bin"]).where((F.col("lo") < F.col("stop")) & (F.col("start") < F.col("hi")))
    return met.where(F.col("_bin") == bin_of(F.greatest("lo", "start"), width)).drop("_bin")


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows dealt out by keys, n of them into partitions of ROWS at most, about, so that what a task holds does not grow with the table."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n // ROWS)), *keys)


def running(events: DataFrame, width: int = BIN) -> DataFrame:
    """events(contig, at, d) with the sum of d up to and with each place where it changes, and the next such place: (contig, at, next, total).

    Sums run within bins; what comes before a bin, and the first place after it, are carried from one row for each bin.
    """
    n = events.count()
    net = dealt(events, n, "contig", "at").groupBy("contig", "at").agg(F.sum("d").alias("d")).where("d <> 0")
    rows = dealt(net.withColumn("_bin", bin_of(F.col("at"), width)), n, "contig", "_bin")
    each = rows.groupBy("contig", "_bin").agg(F.sum("d").alias("_s"), F.min("at").alias("_first"))
    w = W.partitionBy("contig").orderBy("_bin")
    carried = each.select("contig", "_bin", F.coalesce(F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(w).alias("_after"))
    own = W.partitionBy("contig", "_bin").orderBy("at")
    rows = rows.select("contig", "_bin", "at", F.lead("at").over(own).alias("_next"), F.sum("d").over(own).alias("_sum"))
    return rows.join(carried, ["contig", "_bin"]).select("contig", "at", F.coalesce("_next", "_after").alias("next"), (F.col("_sum") + F.col("_before")).alias("total"))
