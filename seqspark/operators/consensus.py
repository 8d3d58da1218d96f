"""Consensus by group qualities, and of columns to which several technologies contribute.

Columns come as groups(contig, pos, base, n, fwd, bwd, quality) of pileup.groups(), five at most for each column and
technology, so that a column's groups are one short array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions import scalar

BASES = "ACGT*"
#: A group of this quality is good, one within NEAR of the best is as good, and three reads on both strands are from LESSER on.
GOOD, NEAR, LESSER = 30, 5, 20
SANGER, SHORT, FLOW, ION, TEXT, LONG = "sanger", "short", "flow", "ion", "text", "long"
#: Fixed values: (size, quality) of levels 0 and 1 of a group on both strands, and the size of level 3 where a technology sees one base only.
LEVELS = {SANGER: ((0, 35), (0, 25), 3), FLOW: ((12, 35), (8, 25), 6), LONG: ((12, 35), (8, 25), 6), ION: ((8, 35), (6, 25), 4), TEXT: ((8, 35), (6, 25), 4)}
#: The same for short reads, with level 2, and the size and quality of level 3 and the quality of level 4.
SHORT_LEVELS, SHORT_SINGLE, SHORT_LEAST = ((12, 35), (8, 30), (6, 25)), (4, 20), 10
#: Short-read groups this much below the best one are left out.
SHORT_RANGE = 30


def _order(base: Column) -> Column:
    return F.instr(F.lit(BASES), base)


def _bits(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a.bitwiseOR(scalar.base_bits(x.base)))


def _sum(array: Column, what: str) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x[what])


def _last_largest(array: Column, size) -> Column:
    """The group for which size() is most; of equal ones the last in the order A, C, G, T, gap."""
    return F.array_max(F.transform(array, lambda x: F.struct(size(x).alias("size"), x.o.alias("o"), x.base.alias("base"), x.quality.alias("quality"))))


def quality_calls(grouped: DataFrame, single: bool = False) -> DataFrame:
    """(contig, pos, letter, quality, chosen): the call of each column by group qualities, and the bases that were chosen.

    Chosen are good groups, those near the best, and those of three reads on both strands from a lesser quality on.
    One chosen group, or the only one that is good on both strands, is the call; its quality is the best less those of all
    other groups. Several make an IUPAC letter of their mean quality, or a gap if that alone is the best; `single`
    takes the largest group instead, with groups on both strands counting double.
    """
    g = F.array_sort(F.collect_list(F.struct(_order(F.col("base")).alias("o"), "base", "n", "fwd", "bwd", "quality")))
    cols = grouped.groupBy("contig", "pos").agg(g.alias("g"), F.max("quality").alias("most"), F.sum("quality").alias("all"))
    both = lambda x: (x.fwd > 0) & (x.bwd > 0)
    chosen = F.filter("g", lambda x: (x.quality >= GOOD) | (x.quality + NEAR >= F.col("most")) | ((x.n >= 3) & (x.quality >= LESSER) & both(x)))
    cols = cols.withColumn("c", chosen).withColumn("good", F.filter("c", lambda x: (x.quality >= GOOD) & both(x)))
    one = F.when(F.size("c") == 1, F.col("c")[0]).when(F.size("good") == 1, F.col("good")[0])
    sure = F.greatest(F.lit(0), F.col("most") - (F.col("all") - one.quality))
    if single:
        top = _last_largest(F.col("c"), lambda x: F.when(both(x), x.n * 2).otherwise(x.n))
        letter, quality = top.base, top.quality
    else:
        best = F.filter("g", lambda x: x.quality == F.col("most"))
        gap = (F.size(best) == 1) & (best[0].base == "*")
        letter = F.when(gap, "*").otherwise(scalar.iupac_letter(_bits(F.col("c"))))
        quality = F.when(gap, F.col("most")).otherwise(F.floor(_sum(F.col("c"), "quality") / F.size("c")))
    return cols.select(
        "contig", "pos", F.when(one.isNotNull(), one.base).otherwise(letter).alias("letter"), F.when(one.isNotNull(), sure).otherwise(quality).cast("long").alias("quality"), F.transform("c", lambda x: x.base).alias("chosen")
    )


def goodness(tech: Column, n: Column, fwd: Column, bwd: Column, quality: Column, bases: Column) -> Column:
    """Level of a group, 0 the best: both strands, size and quality by technology; bases: how many its technology chose."""
    both, out = (fwd > 0) & (bwd > 0), F.lit(None).cast("int")
    for name, (first, second, single) in LEVELS.items():
        level = F.when(both & (n >= first[0]) & (quality >= first[1]), 0).when(both & (n >= second[0]) & (quality >= second[1]), 1).when(both, 2).when((n >= single) & (bases == 1), 3).otherwise(4)
        out = F.when(tech == name, level).otherwise(out)
    short = F
    for k, (size, least) in enumerate(SHORT_LEVELS):
        short = short.when(both & (n >= size) & (quality >= least), k)
    short = short.when((quality >= SHORT_SINGLE[1]) & (n >= SHORT_SINGLE[0]) & (bases == 1), 3).when(quality >= SHORT_LEAST, 4).otherwise(5)
    return F.when(tech == SHORT, short).otherwise(out)


def hybrid_calls(grouped: DataFrame, calls: DataFrame, several: bool) -> DataFrame:
    """(contig, pos, letter, quality) of columns with groups of several technologies.

    grouped(contig, pos, tech, base, n, fwd, bwd, quality); calls(contig, pos, tech, letter, chosen): what each technology
    calls by itself and the bases it chose. Where all chose one base, that is the call. Else groups within two levels of the
    best stay, then, if several bases do, no short-read groups far below the best of them. `several` lets those
    within one level make an IUPAC letter of the mean quality of the groups it covers; otherwise those of the best level stay,
    and of several bases the only one that technologies called, or else the most frequent is taken. A single base
    has its best group's quality, or three quarters of the sum of its groups if that is more. X with quality 0 where nothing stays.
    """
    own = calls.select("contig", "pos", "tech", F.size("chosen").alias("bases"))
    rows = grouped.join(own, ["contig", "pos", "tech"])
    level = goodness(F.col("tech"), F.col("n"), F.col("fwd"), F.col("bwd"), F.col("quality"), F.col("bases"))
    g = F.array_sort(F.collect_list(F.struct(_order(F.col("base")).alias("o"), "base", "tech", "n", "quality", level.alias("level"))))
    cols = rows.groupBy("contig", "pos").agg(g.alias("g"), F.min(level).alias("best"), F.max(F.when(F.col("tech") == SHORT, F.col("quality"))).alias("top"))
    pick = F.when(_order(F.col("letter")) > 0, F.col("letter"))
    told = calls.groupBy("contig", "pos").agg(F.array_distinct(F.flatten(F.collect_list("chosen"))).alias("possible"), F.collect_set(pick).alias("picks"))
    cols = cols.join(told, ["contig", "pos"])
    distinct = lambda a: F.array_distinct(F.transform(a, lambda x: x.base))
    within = lambda a, k: F.filter(a, lambda x: x.level <= F.col("best") + k)
    near = lambda a: F.filter(a, lambda x: (x.tech != SHORT) | (x.quality >= F.when(F.col("top") > SHORT_RANGE, F.col("top") - SHORT_RANGE).otherwise(0)))
    many = F.size("possible") > 1
    cols = cols.withColumn("k", within(F.col("g"), 2))
    cols = cols.withColumn("k", F.when(F.size(distinct(F.col("k"))) > 1, near(F.col("k"))).otherwise(F.col("k")))
    cols = cols.withColumn("k", F.when(F.size(distinct(F.col("k"))) > 1, near(within(F.col("k"), 1 if several else 0))).otherwise(F.col("k")))
    cols = cols.withColumn("left", F.when(many, distinct(F.col("k"))).otherwise(F.col("possible")))
    counts = lambda b: _sum(F.filter("k", lambda x: x.base == b), "n")
    most = F.array_max(F.transform("left", lambda b: F.struct(counts(b).alias("n"), _order(b).alias("o"), b.alias("base")))).base
    called = F.when(F.size("picks") == 1, F.when(F.array_contains("left", F.col("picks")[0]), F.col("picks")[0]).otherwise("*"))
    one = F.when(F.size("left") == 1, F.col("left")[0])
    cols = cols.withColumn("base", one if several else F.coalesce(one, called, most))
    same = F.filter("g", lambda x: x.base == F.col("base"))
    single = F.greatest(F.array_max(F.transform(same, lambda x: x.quality)), F.floor(_sum(same, "quality") * 75 / 100))
    bits = F.aggregate("left", F.lit(0), lambda a, b: a.bitwiseOR(scalar.base_bits(b)))
    cols = cols.withColumn("bits", bits)
    covered = F.filter("g", lambda x: (x.base == "*") | (scalar.base_bits(x.base).bitwiseAND(F.col("bits")) > 0))
    letter = F.coalesce("base", scalar.iupac_letter(F.col("bits")))
    quality = F.when(F.col("base").isNotNull(), F.coalesce(single, F.lit(0))).otherwise(F.floor(_sum(covered, "quality") / F.size(covered)))
    none = F.size("left") == 0  # the best level is held by short-read groups that are left out
    return cols.select("contig", "pos", F.when(none, "X").otherwise(letter).alias("letter"), F.when(none, 0).otherwise(quality).cast("long").alias("quality"))


def by_strain(grouped: DataFrame, single: bool = True) -> DataFrame:
    """(contig, strain, pos, letter, quality) of groups with a strain: each strain called by itself."""
    key = F.struct("contig", "strain")
    return quality_calls(grouped.withColumn("contig", key), single).select("contig.contig", "contig.strain", "pos", "letter", "quality")


def sequences(calls: DataFrame, *key: str) -> DataFrame:
    """(key..., seq, unpadded, quals) of calls(key..., pos, letter, quality), positions without a call left out; unpadded has no gaps."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "letter", "quality")))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.letter), "")
    found = calls.groupBy(*key).agg(rows.alias("r"))
    kept = F.filter("r", lambda x: x.letter != "*")
    return found.select(*key, text(F.col("r")).alias("seq"), text(kept).alias("unpadded"), F.transform(kept, lambda x: x.quality).alias("quals"))


def short_chosen(grouped: DataFrame) -> DataFrame:
    """(contig, pos, letter, chosen) by weighted short-read groups, weighed as in pileup.short_read_consensus().

    Chosen are groups of half the most weight, or with two reads on each strand; letter is the first base of most weight.
    """
    w = F.when((F.col("fwd") >= 2) & (F.col("bwd") >= 2), F.col("n") * 2).when((F.col("fwd") >= 1) & (F.col("bwd") >= 1), F.floor(F.col("n") * 3 / 2)).otherwise(F.col("n"))
    g = F.array_sort(F.collect_list(F.struct(_order(F.col("base")).alias("o"), "base", ((F.col("fwd") >= 2) & (F.col("bwd") >= 2)).alias("sure"), w.alias("w"))))
    cols = grouped.groupBy("contig", "pos").agg(g.alias("g"), F.max(w).alias("most"))
    kept = F.filter("g", lambda x: (x.w >= F.floor(F.col("most") / 2)) | x.sure)
    return cols.select("contig", "pos", F.filter("g", lambda x: x.w == F.col("most"))[0].base.alias("letter"), F.transform(kept, lambda x: x.base).alias("chosen"))
