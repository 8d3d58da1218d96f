"""Coverage, order statistics of lengths, masks and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspark.operators import intervals


def coverage(placed: DataFrame) -> DataFrame:
    """placed(contig, start, len) -> (contig, start, stop, cov): stretches of equal coverage above 0.

    Each interval is two events, so intervals are never spread over their positions.
    """
    events = placed.select("contig", F.col("start").alias("at"), F.lit(1).alias("d")).union(placed.select("contig", F.col("start") + F.col("len"), F.lit(-1)))
    steps = intervals.running(events)
    return steps.select("contig", F.col("at").alias("start"), F.col("next").alias("stop"), F.col("total").alias("cov")).where("cov > 0")


def coverage_stats(steps: DataFrame) -> DataFrame:
    """Minimum, maximum, sum, mean and population deviation over covered positions of each contig."""
    n = F.col("stop") - F.col("start")
    mean = F.sum(n * F.col("cov")) / F.sum(n)
    agg = steps.groupBy("contig").agg(
        F.min("cov").alias("min_cov"), F.max("cov").alias("max_cov"), F.sum(n * F.col("cov")).alias("sum_cov"), F.sum(n).alias("positions"), F.sum(n * F.col("cov") * F.col("cov")).alias("sq"), mean.alias("mean_cov")
    )
    return agg.select("contig", "min_cov", "max_cov", "sum_cov", "positions", "mean_cov", F.sqrt(F.greatest(F.lit(0.0), F.col("sq") / F.col("positions") - F.col("mean_cov") * F.col("mean_cov"))).alias("stddev_cov"))


def second_order(steps: DataFrame) -> DataFrame:
    """Mean of coverage within a third and three times the mean; the deviation divides by all positions."""
    n = F.col("stop") - F.col("start")
    mean = steps.groupBy("contig").agg((F.sum(n * F.col("cov")) / F.sum(n)).alias("m"), F.sum(n).alias("every"))
    inner = steps.join(mean, "contig").where((F.col("cov") >= F.col("m") / 3) & (F.col("cov") <= F.col("m") * 3))
    agg = inner.groupBy("contig").agg(F.max("every").alias("every"), F.sum(n).alias("positions"), F.sum(n * F.col("cov")).alias("s"), F.sum(n * F.col("cov") * F.col("cov")).alias("sq"))
    mean2 = F.col("s") / F.col("positions")
    return agg.select("contig", "positions", mean2.alias("mean_cov"), F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("s") * mean2) / F.col("every")).alias("stddev_cov"))


def span_means(steps: DataFrame, width: int) -> DataFrame:
    """(contig, span, mean_cov): whole-number mean coverage of spans of `width` positions; 0 where one is uncovered."""
    span, stop = F.col("span"), F.col("stop")
    rows = steps.withColumn("span", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((stop - 1) / width))))
    n = F.least(stop, (span + 1) * width) - F.greatest(F.col("start"), span * width)
    sums = rows.select("contig", "span", n.alias("n"), (n * F.col("cov")).alias("s")).groupBy("contig", "span").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return sums.select("contig", "span", F.when(F.col("n") < width, F.lit(0).cast("long")).otherwise(F.expr(f"s div {width}")).alias("mean_cov"))


def n_stats(lengths: DataFrame, *fractions: float) -> DataFrame:
    """(contigs, total, longest, n50...): the length at which the running sum of lengths, longest first, reaches each fraction.

    Equal lengths are summed first, so what is ordered is one row per length.
    """
    by_len = lengths.groupBy("len").agg((F.count("*") * F.col("len")).alias("s"), F.count("*").alias("n"))
    run = by_len.select("len", "n", "s", F.expr("sum(s) over (order by len desc)").alias("run"), F.expr("sum(s) over ()").alias("total"))
    return run.agg(
        F.sum("n").alias("contigs"), F.max("total").alias("total"), F.max("len").alias("longest"), *(F.max(F.when(F.col("run") >= F.col("total") * f, F.col("len"))).alias(f"n{round(f * 100)}") for f in fractions)
    )


def islands(rows: DataFrame, key: str, at: str, least: int = 1) -> DataFrame:
    """(key, start, stop, n): runs of consecutive positions of at least `least`."""
    w = W.partitionBy(key).orderBy(at)
    runs = rows.select(key, at, (F.col(at) - F.row_number().over(w)).alias("g"))
    return runs.groupBy(key, "g").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count("*").alias("n")).where(F.col("n") >= least).drop("g")


def erode(mask: DataFrame, key: str, at: str, thickness: int, column: str = "m") -> DataFrame:
    return mask.withColumn(column, F.min(column).over(W.partitionBy(key).orderBy(at).rowsBetween(-thickness, thickness)))


def dilate(mask: DataFrame, key: str, at: str, thickness: int, column: str = "m") -> DataFrame:
    return mask.withColumn(column, F.max(column).over(W.partitionBy(key).orderBy(at).rowsBetween(-thickness, thickness)))


def closed_islands(steps: DataFrame, reach: int, least: int) -> DataFrame:
    """(contig, start, stop, n): what dilate(), erode() and islands() make of steps(contig, start, stop, m) without a row for each position.

    Dilation and erosion count covered positions, so steps are placed by how many of these lie before them; zones of
    marked ones are widened, joined, narrowed and laid over the steps again.
    """
    w, size = W.partitionBy("contig").orderBy("start"), F.col("stop") - F.col("start")
    before = F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = steps.select("contig", "start", "m", before.alias("r0"), (before + size).alias("r1"), F.sum(size).over(W.partitionBy("contig")).alias("every"))
    near = F.col("r0") - F.lag("r1").over(w) <= 2 * reach
    zone = rows.where("m").withColumn("zone", F.sum(F.when(near, 0).otherwise(1)).over(w)).groupBy("contig", "zone", "every").agg(F.min("r0").alias("a"), F.max("r1").alias("b"))
    # widened by reach and narrowed again a zone is what it was, but where it meets an end of the contig
    lo, hi = F.when(F.col("a") <= reach, 0).otherwise(F.col("a")), F.when(F.col("b") + reach >= F.col("every"), F.col("every")).otherwise(F.col("b"))
    met = intervals.touching(zone.select("contig", lo.cast("long").alias("lo"), hi.alias("hi")), rows.select("contig", F.col("start").alias("at"), F.col("r0").alias("start"), F.col("r1").alias("stop")))
    piece = met.select("contig", "lo", (F.col("at") + F.greatest("lo", "start") - F.col("start")).alias("p0"), (F.col("at") + F.least("hi", "stop") - F.col("start")).alias("p1"))
    v = W.partitionBy("contig", "lo").orderBy("p0")
    runs = piece.withColumn("run", F.sum(F.when(F.col("p0") == F.lag("p1").over(v), 0).otherwise(1)).over(v))
    out = runs.groupBy("contig", "lo", "run").agg(F.min("p0").alias("start"), F.max("p1").alias("p1"))
    return out.select("contig", "start", (F.col("p1") - 1).alias("stop"), (F.col("p1") - F.col("start")).alias("n")).where(F.col("n") >= least)


def yield_limit(rows: DataFrame, key: str, length: str, most: int, width: int = 1000) -> DataFrame:
    """Rows in order of a whole-number key while the lengths before them sum to less than `most`.

    Sums of key ranges of `width` are ordered first, and then the rows inside each range.
    """
    part = F.floor(F.col(key) / width)
    sums = rows.groupBy(part.alias("part")).agg(F.sum(length).alias("s"))
    starts = sums.select("part", F.coalesce(F.expr("sum(s) over (order by part rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias("base")).where(F.col("base") < most)
    inside = F.coalesce(F.sum(length).over(W.partitionBy("part").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("part", part).join(starts, "part").withColumn("before", F.col("base") + inside).where(F.col("before") < most).drop("part", "base", "before")


def weighted_median(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., median) of rows(keys..., cov, n): cov stands n times; the mean of the two middle ones of an even number.

    Equal values are summed first, so what is ordered is one row per value.
    """
    by_cov = rows.groupBy(*keys, "cov").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys)
    run = by_cov.select(*keys, "cov", F.sum("n").over(w.orderBy("cov")).alias("upto"), F.sum("n").over(w).alias("size"))
    low = F.min(F.when(F.col("upto") >= F.expr("(size + 1) div 2"), F.col("cov")))
    high = F.min(F.when(F.col("upto") >= F.expr("size div 2 + 1"), F.col("cov")))
    return run.groupBy(*keys).agg(((low + high) / 2).alias("median"))


def median_coverage(steps: DataFrame) -> DataFrame:
    """(contig, median_cov) over covered positions."""
    return weighted_median(steps.withColumn("n", F.col("stop") - F.col("start")), "contig").withColumnRenamed("median", "median_cov")


def feature_coverage(steps: DataFrame, features: DataFrame) -> DataFrame:
    """features(contig, lo, hi) with their median coverage and deviation, and a verdict against the contig.

    The contig counts by the median of its positions within a third and three times the mean and their deviation.
    A feature is normal, or a CNV_down, deletion or CNV_up that is possible at one deviation of both and
    probable at two (for CNV_up, two of its own). All is compared in whole numbers. Uncovered positions of a
    feature count as 0.
    """
    n = F.col("stop") - F.col("start")
    mean = steps.groupBy("contig").agg((F.sum(n * F.col("cov")) / F.sum(n)).alias("m"))
    inner = steps.join(mean, "contig").where((F.col("cov") >= F.col("m") / 3) & (F.col("cov") <= F.col("m") * 3))
    whole = median_coverage(inner).join(second_order(steps), "contig").select("contig", F.col("median_cov").alias("cm"), F.col("stddev_cov").alias("cs"))
    # features end with their last position
    hit = intervals.touching(features.select("contig", "lo", (F.col("hi") + 1).alias("hi")), steps).withColumn("hi", F.col("hi") - 1)
    hit = hit.select("contig", "lo", "hi", "cov", (F.least("stop", F.col("hi") + 1) - F.greatest("start", "lo")).alias("n"))
    bare = features.join(hit.groupBy("contig", "lo", "hi").agg(F.sum("n").alias("s")), ["contig", "lo", "hi"], "left")
    every = hit.union(bare.select("contig", "lo", "hi", F.lit(0).cast("long"), F.col("hi") - F.col("lo") + 1 - F.coalesce("s", F.lit(0)))).where("n > 0")
    sums = every.groupBy("contig", "lo", "hi").agg((F.sum(F.col("n") * F.col("cov")) / F.sum("n")).alias("a"), (F.sum(F.col("n") * F.col("cov") * F.col("cov")) / F.sum("n")).alias("q"))
    dev = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("a") * F.col("a")))
    rows = weighted_median(every, "contig", "lo", "hi").join(sums, ["contig", "lo", "hi"]).join(whole, "contig").withColumn("fs", dev)
    whole_number = lambda x: x.cast("long")
    fm, fs, cm, cs = F.col("median"), F.col("fs"), whole_number(F.col("cm")), whole_number(F.col("cs"))
    down = lambda k: whole_number(fm + k * fs) < cm - k * cs
    up = lambda k: whole_number(fm - k * fs) > cm + cs
    sure = lambda x: F.when(x, "probable").otherwise("possible")
    verdict = F.when(down(1), F.concat(sure(down(2)), F.when(fm < F.col("cs"), "_deletion").otherwise("_CNV_down"))).when(up(1), F.concat(sure(up(2)), F.lit("_CNV_up"))).otherwise("normal")
    return rows.select("contig", "lo", "hi", fm.alias("median_cov"), fs.alias("stddev_cov"), verdict.alias("verdict"))


def large_contigs(contigs: DataFrame, least: int, coverage: float) -> DataFrame:
    """contigs(len, cov, repeats) with large.

    A contig is large if it has the least length and coverage; or twice the length, two thirds of the coverage, and
    is not made of repeats alone.
    """
    sure = (F.col("len") >= least) & (F.col("cov") >= coverage)
    rescued = ~F.col("repeats") & (F.col("len") >= 2 * least) & (F.col("cov") >= coverage * (2.0 / 3))
    return contigs.withColumn("large", sure | rescued)


#: Percentages of chimeras below which a verdict holds, and the verdicts.
CHIMERA_RUNGS, CHIMERA_VERDICTS = (0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0), ("excellent", "could be better", "not good", "mediocre", "bad", "very bad", "catastrophic", "unusable")


def chimera_verdict(percent):
    """Verdict on a percentage of chimeras; null where there are none."""
    return F.when(percent > 0, ladder(percent, CHIMERA_RUNGS, CHIMERA_VERDICTS))


def ladder(value, rungs: tuple, names: tuple):
    """The name of the first rung that the value lies below, else the last name."""
    out = F.lit(names[-1])
    for rung, name in reversed(list(zip(rungs, names))):
        out = F.when(value < rung, name).otherwise(out)
    return out
