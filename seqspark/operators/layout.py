"""Contigs as layouts of reads: mutual best overlaps make chains, contained reads follow their containers.

An overlap is seen from read a: read b, in direction d (1 or -1), begins at e in a's own direction. A read that
lies within a longer one (or an equal one of a smaller id) is contained and points at its weightiest
container. Of the other reads each side takes its weightiest overlap that extends it; where both ends of an
overlap take it, the reads are neighbours. A read then is two nodes, one for each direction, of two chains that mirror
each other; positions come from pointer doubling, so no task holds a contig.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspark.operators.chains import Save, chains


def views(overlaps: DataFrame, lengths: DataFrame) -> DataFrame:
    """Overlaps (a, b, d, e, w) with lengths (read_id, n), from both of their reads: (a, b, d, e, w, na, nb). Overlaps of a read with itself are left out."""
    rows = overlaps.where("a <> b").join(lengths.select(F.col("read_id").alias("a"), F.col("n").alias("na")), "a").join(lengths.select(F.col("read_id").alias("b"), F.col("n").alias("nb")), "b")
    back = F.when(F.col("d") == 1, -F.col("e")).otherwise(F.col("e") + F.col("nb") - F.col("na"))
    one = rows.select("a", "b", "d", "e", "w", "na", "nb")
    return one.union(rows.select("b", "a", "d", back, "w", "nb", "na")).distinct()


def containers(seen: DataFrame) -> DataFrame:
    """(r, p, d, e, n, np): each contained read r of length n lies at e of its weightiest container p, of length np."""
    inside = (F.col("e") >= 0) & (F.col("e") + F.col("nb") <= F.col("na")) & ((F.col("nb") < F.col("na")) | (F.col("b") > F.col("a")))
    rank = F.row_number().over(W.partitionBy("b").orderBy(F.desc("w"), F.desc("na"), "a", "d", "e"))
    return seen.where(inside).withColumn("k", rank).where("k = 1").select(F.col("b").alias("r"), F.col("a").alias("p"), "d", "e", F.col("nb").alias("n"), F.col("na").alias("np"))


def neighbours(seen: DataFrame, contained: DataFrame) -> DataFrame:
    """(a, b, d, e, na, nb, right): overlaps that both ends take, from both; right tells the side of a."""
    out = contained.select(F.col("r").alias("x"))
    own = seen.join(out, F.col("a") == F.col("x"), "left_anti").join(out, F.col("b") == F.col("x"), "left_anti")
    right = F.when((F.col("e") > 0) & (F.col("e") + F.col("nb") > F.col("na")), True).when((F.col("e") < 0) & (F.col("e") + F.col("nb") < F.col("na")), False)
    rank = F.row_number().over(W.partitionBy("a", "right").orderBy(F.desc("w"), "b", "d", "e"))
    best = own.withColumn("right", right).where("right is not null").withColumn("k", rank).where("k = 1").drop("k")
    back = F.when(F.col("d") == 1, -F.col("e")).otherwise(F.col("e") + F.col("nb") - F.col("na"))
    other = best.select(F.col("b").alias("a"), F.col("a").alias("b"), "d", back.alias("e"))
    return best.join(other, ["a", "b", "d", "e"], "left_semi").select("a", "b", "d", "e", "na", "nb", "right")


def _node(read, direction):
    """One long for a read in a direction: twice the id, one more for the reverse."""
    return read * 2 + F.when(direction == 1, 0).otherwise(1)


def _settled(inside: DataFrame, save: Save) -> DataFrame:
    """containers() with p the outermost container; containers are longer or of smaller id, so there are no rings."""
    at = save(inside)
    going = at.limit(1).count()
    while going:
        far = at.select(F.col("r").alias("p"), F.col("p").alias("p2"), F.col("d").alias("d2"), F.col("e").alias("e2"), F.col("np").alias("np2"))
        place = F.when(F.col("d2") == 1, F.col("e2") + F.col("e")).otherwise(F.col("e2") + F.col("np") - F.col("e") - F.col("n"))
        met = at.join(far, "p", "left")
        on = F.col("p2").isNotNull()
        seen = Observation()
        new = met.select(
            "r", F.coalesce("p2", "p").alias("p"), F.when(on, F.col("d") * F.col("d2")).otherwise(F.col("d")).cast("int").alias("d"), F.when(on, place).otherwise(F.col("e")).alias("e"), "n", F.coalesce("np2", "np").alias("np"), on.alias("on")
        ).observe(seen, F.count_if("on").alias("moved"))
        at = save(new.drop("on"))
        going = seen.get["moved"]
    return at


def layout(overlaps: DataFrame, lengths: DataFrame, save: Save) -> DataFrame:
    """(contig, read_id, offset, dir, rank, ring, contained) of every read of lengths(read_id, n), single ones included.

    overlaps(a, b, d, e, w): w the weight; of equal ones the smaller other read counts, then the smaller direction
    and place. A contig is named after its first read and laid out in the direction in which that is the smaller of
    both ends; a ring begins at its smallest read, in its own direction. rank counts a contig's reads without
    contained ones, which have null. Null ids and lengths are no reads; repeated overlaps count once.
    """
    lengths = lengths.where("read_id is not null and n is not null")
    seen = save(views(overlaps, lengths))
    inside = _settled(containers(seen), save)
    near = neighbours(seen, inside)
    step = F.when(F.col("right"), F.col("e")).otherwise(F.col("na") - F.col("e") - F.col("nb"))
    way = F.when(F.col("right"), 1).otherwise(-1)
    links = near.select(_node(F.col("b"), F.col("d") * way).alias("id"), _node(F.col("a"), way).alias("prev"), step.alias("step"))
    outer = lengths.join(inside.select(F.col("r").alias("read_id")), "read_id", "left_anti")
    nodes = outer.select(F.explode(F.array(F.col("read_id") * 2, F.col("read_id") * 2 + 1)).alias("id"))
    at = chains(save(nodes.join(links, "id", "left")), save)
    # of both directions the one whose chain has the smaller head
    read = F.floor(F.col("id") / 2).cast("long")
    rows = at.groupBy(read.alias("read_id")).agg(F.min(F.struct("head", "id", "far", "rank", "ring")).alias("x"))
    direction = F.when(F.pmod(F.col("x.id"), F.lit(2)) == 0, 1).otherwise(-1)
    main = save(rows.select(F.floor(F.col("x.head") / 2).cast("long").alias("contig"), "read_id", F.col("x.far").alias("offset"), direction.alias("dir"), "x.rank", "x.ring"))
    root = main.select(F.col("read_id").alias("p"), "contig", F.col("offset").alias("o"), F.col("dir").alias("dd"), "ring")
    place = F.when(F.col("dd") == 1, F.col("o") + F.col("e")).otherwise(F.col("o") + F.col("np") - F.col("e") - F.col("n"))
    within = inside.join(root, "p").select("contig", F.col("r").alias("read_id"), place.cast("long").alias("offset"), (F.col("d") * F.col("dd")).cast("int").alias("dir"), F.lit(None).cast("long").alias("rank"), "ring", F.lit(True).alias("contained"))
    return main.withColumn("contained", F.lit(False)).union(within)


def contig_lengths(placed: DataFrame, lengths: DataFrame) -> DataFrame:
    """(contig, reads, length) of a layout."""
    rows = placed.join(lengths, "read_id")
    return rows.groupBy("contig").agg(F.count("*").alias("reads"), (F.max(F.col("offset") + F.col("n")) - F.min("offset")).alias("length"))
