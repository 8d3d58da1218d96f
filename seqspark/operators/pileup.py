"""Columns of placed bases: group qualities, consensus rules, differences between strains, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspark.functions import scalar


def groups(pile: DataFrame) -> DataFrame:
    """pile(contig, pos, base, qual, rev) -> size, strands and quality of each base of a column.

    Quality is the best of each strand plus a tenth (whole numbers) of the sum of the second best, 90 at most.
    Only the two best of each strand are kept, so a deep column stays small.
    """
    w = W.partitionBy("contig", "pos", "base", "rev").orderBy(F.desc("qual"))
    ranked = pile.withColumn("r", F.row_number().over(w))
    best, second = F.sum(F.when(F.col("r") == 1, F.col("qual")).otherwise(0)), F.sum(F.when(F.col("r") == 2, F.col("qual")).otherwise(0))
    return ranked.groupBy("contig", "pos", "base").agg(
        F.count("*").alias("n"), F.sum((~F.col("rev")).cast("int")).cast("long").alias("fwd"), F.sum(F.col("rev").cast("int")).cast("long").alias("bwd"), F.least(F.lit(90), best + F.floor(second / 10)).cast("long").alias("quality")
    )


def majority(grouped: DataFrame) -> DataFrame:
    """The base of most reads of each column; ties in the order A, C, G, T, gap."""
    order = F.when(F.col("base") == "*", 9).otherwise(F.instr(F.lit("ACGT"), F.col("base")))
    return grouped.groupBy("contig", "pos").agg(F.max(F.struct("n", (-order).alias("o"), "base", "quality")).alias("m")).select("contig", "pos", "m.base", "m.n", "m.quality")


def short_read_consensus(grouped: DataFrame) -> DataFrame:
    """Weighted groups of a column and the IUPAC letter of those that stay.

    A group weighs double with two reads on each strand, and half as much again (whole numbers) with one on
    each. Groups of half the most weight, or with two reads on each strand, stay.
    """
    w = F.when((F.col("fwd") >= 2) & (F.col("bwd") >= 2), F.col("n") * 2).when((F.col("fwd") >= 1) & (F.col("bwd") >= 1), F.floor(F.col("n") * 3 / 2)).otherwise(F.col("n"))
    rows = grouped.withColumn("w", w)
    most = rows.groupBy("contig", "pos").agg(F.max("w").alias("most"))
    kept = rows.join(most, ["contig", "pos"]).where((F.col("w") >= F.floor(F.col("most") / 2)) | ((F.col("fwd") >= 2) & (F.col("bwd") >= 2)))
    bits = kept.groupBy("contig", "pos").agg(F.bit_or(scalar.base_bits(F.col("base"))).alias("bits"), F.count("*").alias("groups"))
    return bits.select("contig", "pos", scalar.iupac_letter(F.col("bits")).alias("letter"), "groups")


def strain_differences(consensus: DataFrame) -> DataFrame:
    """consensus(strain, pos, base) -> (pos, strain1, strain2, base1, base2): pairs of strains that differ."""
    a, b = consensus.toDF("strain1", "pos", "base1"), consensus.toDF("strain2", "pos", "base2")
    return a.join(b, "pos").where((F.col("strain1") < F.col("strain2")) & (F.col("base1") != F.col("base2")))


def tag_precedence(tags: DataFrame, masters: list[str], unwanted: list[str]) -> DataFrame:
    """tags(contig, start, id) without the unwanted ones that begin where a master tag does."""
    at = tags.where(F.col("id").isin(masters)).select("contig", "start").distinct()
    return tags.where(~F.col("id").isin(unwanted)).union(tags.where(F.col("id").isin(unwanted)).join(at, ["contig", "start"], "left_anti").select(*tags.columns))


def _groups_of_columns(grouped: DataFrame) -> DataFrame:
    """(contig, pos, g): the groups of a column, the largest first, among equals the last of A, C, G, T, gap."""
    order = F.when(F.col("base") == "*", 5).otherwise(F.instr(F.lit("ACGT"), F.col("base")))
    g = F.struct(F.col("n"), order.alias("o"), F.col("base"), F.col("quality"))
    return grouped.groupBy("contig", "pos").agg(F.sort_array(F.collect_list(g), False).alias("g"))


def largest_group_consensus(grouped: DataFrame, gap_yields: bool) -> DataFrame:
    """(contig, pos, letter, quality) by the largest group of a column.

    gap_yields: a gap gives way to a runner-up with 40% of both or more. Groups of equal size make an IUPAC letter
    of their mean quality. One that leads by less than 10 has its quality less that of the runner-up, at
    least 10 where that is negative.
    """
    top, second = F.col("g")[0], F.get("g", F.lit(1))
    runner = F.coalesce(second.n, F.lit(0))
    swap = (top.base == "*") & (runner > 0) & (F.floor(100 * runner / (top.n + runner)) >= 40) if gap_yields else F.lit(False)
    cols = _groups_of_columns(grouped).select("contig", "pos", "g", F.when(swap, runner).otherwise(top.n).alias("most"), F.when(swap, top.n).otherwise(runner).alias("next"), F.coalesce(F.when(swap, top.quality).otherwise(second.quality), F.lit(0)).alias("next_quality"))
    tied = F.filter("g", lambda x: x.n == F.col("most"))
    cols = cols.withColumn("tied", tied).withColumn("total", F.aggregate("tied", F.lit(0).cast("long"), lambda a, x: a + x.quality))
    doubted = F.when((F.col("next") > 0) & (F.col("most") - F.col("next") < 10), F.col("total") - F.col("next_quality")).otherwise(F.col("total"))
    one = F.size("tied") == 1
    bits = F.aggregate("tied", F.lit(0), lambda a, x: a.bitwiseOR(scalar.base_bits(x.base)))
    letter = F.when(one, F.col("tied")[0].base).otherwise(scalar.iupac_letter(bits))
    quality = F.when(one, F.when(doubted < 0, F.greatest(F.abs(doubted), F.lit(10))).otherwise(doubted)).otherwise(F.floor(F.col("total") / F.size("tied")))
    return cols.select("contig", "pos", letter.alias("letter"), quality.cast("long").alias("quality"))


def text_consensus(grouped: DataFrame) -> DataFrame:
    """(contig, pos, base, quality, chosen): the first largest group, and all bases of half its size or more."""
    cols = _groups_of_columns(grouped)
    most = F.col("g")[0].n
    inorder = F.array_sort(F.transform("g", lambda x: F.struct(x.o.alias("o"), x.n.alias("n"), x.base.alias("base"), x.quality.alias("quality"))))
    first = F.filter(inorder, lambda x: x.n == most)[0]
    chosen = F.array_join(F.transform(F.filter(inorder, lambda x: x.n >= F.floor(most / 2)), lambda x: x.base), "")
    return cols.select("contig", "pos", first.base.alias("base"), first.quality.alias("quality"), chosen.alias("chosen"))
