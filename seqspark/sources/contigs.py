"""Contigs with placed reads as SAM and CAF.

Placed reads (name, contig, start, dir, seq, qual, rg, template, segment) lie on padded contigs (contig, seq, qual): start is
a padded place from 0, seq is in the contig's direction with * for gaps, one quality for each letter of it; dir is 1 or -1.
Contigs are cut into pieces that carry the number of bases before them, so that no read meets a whole contig.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspark.functions import scalar
from seqspark.operators.intervals import BIN, bin_of
from seqspark.sources import records


def bases(seq: Column) -> Column:
    """Letters that are no gaps."""
    return F.length(F.replace(seq, F.lit("*"), F.lit("")))


def pieces(contigs: DataFrame, width: int = BIN) -> DataFrame:
    """(contig, bin, piece, before): stretches of `width` padded places, with the bases of the contig before them."""
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), bin_of(F.length("seq") - 1, width)).cast("int"))
    rows = contigs.where(F.length("seq") > 0).select("contig", F.posexplode(F.transform(at, lambda k: F.substring(F.col("seq"), k * width + 1, F.lit(width)))).alias("bin", "piece"))
    rows = rows.withColumn("bin", F.col("bin").cast("long")).withColumn("n", bases(F.col("piece")).cast("long"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("contig").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.select("contig", "bin", "piece", before.alias("before"))


def unpadded(places: DataFrame, contigs: DataFrame, width: int = BIN) -> DataFrame:
    """places(contig, at, ...) with how many bases stand before the padded place `at`: column base."""
    cut = pieces(contigs, width)
    rows = places.withColumn("bin", bin_of(F.col("at"), width)).join(cut, ["contig", "bin"])
    return rows.withColumn("base", F.col("before") + bases(F.substring(F.col("piece"), F.lit(1), (F.col("at") - F.col("bin") * width).cast("int")))).drop("bin", "piece", "before")


def on_contig(placed: DataFrame, contigs: DataFrame, width: int = BIN) -> DataFrame:
    """placed with ref, the contig's letters under the read, and pos, the unpadded place from 0 of the first base there.

    A read over an insertion at its very beginning has the place of the next base. Reads that reach beyond a contig have a shorter ref.
    """
    end = F.col("start") + F.length("seq")
    spread = placed.select("name", "contig", "start", F.explode(F.sequence(bin_of(F.col("start"), width), bin_of(F.greatest(end - 1, F.col("start")), width))).alias("bin"))
    met = spread.join(pieces(contigs, width), ["contig", "bin"]).groupBy("name", "contig", "start")
    parts = met.agg(F.array_sort(F.collect_list(F.struct("bin", "piece"))).alias("p"), F.min("bin").alias("first"), F.min("before").alias("before"))
    text = F.array_join(F.transform("p", lambda x: x.piece), "")
    skip = (F.col("start") - F.col("first") * width).cast("int")
    rows = placed.join(parts, ["name", "contig", "start"])
    return rows.select(*(placed[c] for c in placed.columns), F.substring(text, skip + 1, F.length("seq")).alias("ref"), (F.col("before") + bases(F.substring(text, F.lit(1), skip))).cast("long").alias("pos"))


def sam(placed: DataFrame, contigs: DataFrame, low: int = 0, high: int = 1 << 30, width: int = BIN) -> DataFrame:
    """SAM columns of placed reads: name, flag, contig, pos, mapq, cigar, mate_contig, mate_pos, tlen, seq, qual, rg.

    Templates of two reads are pairs: first and second by segment, proper where they face each other on one contig within
    low and high. Names of SAM are the templates, or the reads' own. Letters that are gaps have no quality.
    """
    rows = on_contig(placed, contigs, width)
    kept = F.filter(F.arrays_zip(F.split("seq", "").alias("s"), F.col("qual").alias("q")), lambda x: x.s != "*")
    text = F.array_join(F.transform(kept, lambda x: F.char(F.coalesce(x.q, F.lit(0)) + 33)), "")
    cigar = records.cigar(F.col("seq"), F.col("ref"), F.lit(0), F.lit(0))
    rows = rows.select("name", "contig", "dir", "rg", "template", "segment", "pos", bases(F.col("ref")).cast("long").alias("len"), cigar.alias("cigar"), F.replace("seq", F.lit("*"), F.lit("")).alias("seq"), text.alias("qual"))
    # reads without a template are pairs with none
    w = W.partitionBy("template", F.when(F.col("template").isNull(), F.col("name")))
    order = w.orderBy("segment", "name")
    paired = F.col("template").isNotNull() & (F.count("*").over(w) == 2)
    first = F.row_number().over(order) == 1
    mate = lambda c: F.when(paired, F.coalesce(F.lead(c).over(order), F.lag(c).over(order)))
    rows = rows.select("*", paired.alias("paired"), first.alias("first"), *(mate(c).alias(f"m_{c}") for c in ("contig", "pos", "len", "dir")))
    one = F.col("paired") & (F.col("contig") == F.col("m_contig"))
    left = (F.col("pos") < F.col("m_pos")) | (F.col("pos") == F.col("m_pos")) & F.col("first")
    span = F.greatest(F.col("pos") + F.col("len"), F.col("m_pos") + F.col("m_len")) - F.least("pos", "m_pos")
    facing = F.when(left, (F.col("dir") == 1) & (F.col("m_dir") == -1)).otherwise((F.col("dir") == -1) & (F.col("m_dir") == 1))
    bit = lambda c, v: F.when(c, v).otherwise(0)
    flag = bit(F.col("paired"), 1) + bit(one & facing & (span >= low) & (span <= high), 2) + bit(F.col("dir") == -1, 16) + bit(F.col("paired") & (F.col("m_dir") == -1), 32) + bit(F.col("paired") & F.col("first"), 64) + bit(F.col("paired") & ~F.col("first"), 128)
    name = F.when(F.col("paired"), F.col("template")).otherwise(F.col("name"))
    return rows.select(
        name.alias("name"), flag.alias("flag"), "contig", (F.col("pos") + 1).alias("pos"), F.lit(255).alias("mapq"), "cigar", F.col("m_contig").alias("mate_contig"), (F.col("m_pos") + 1).alias("mate_pos"), F.when(one, F.when(left, span).otherwise(-span)).alias("tlen"), "seq", "qual", "rg"
    )


def sam_text(rows: DataFrame) -> DataFrame:
    """(value): SAM lines of sam(), with the read group."""
    return rows.select(F.concat(records.sam_line(), F.when(F.col("rg").isNotNull(), F.concat(F.lit("\tRG:Z:"), F.col("rg").cast("string"))).otherwise("")).alias("value"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Columns of sam() of the alignment lines of SAM files; pos, mate_pos from 1, null where there is no mate."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(p) >= 11))
    mate = F.when(p[6] == "=", p[2]).when(p[6] != "*", p[6])
    rg = F.get(F.filter(p, lambda x: x.startswith("RG:Z:")), F.lit(0))
    return rows.select(
        p[0].alias("name"), p[1].cast("int").alias("flag"), p[2].alias("contig"), p[3].cast("long").alias("pos"), p[4].cast("int").alias("mapq"), p[5].alias("cigar"), mate.alias("mate_contig"), F.when(mate.isNotNull(), p[7].cast("long")).alias("mate_pos"), F.when(p[8].cast("long") != 0, p[8].cast("long")).alias("tlen"), p[9].alias("seq"), p[10].alias("qual"), F.substring(rg, 6, 1 << 20).alias("rg")
    )


def caf(placed: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig, part, at, name, value): lines of CAF in the order of the first four columns.

    Reads are written in their own direction; a reversed one is assembled from a place above its end.
    """
    back = F.col("dir") == -1
    seq = F.when(back, scalar.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.when(back, F.reverse("qual")).otherwise(F.col("qual"))
    lines = lambda s: F.regexp_replace(F.replace(s, F.lit("*"), F.lit("-")), "(.{60})(?=.)", "$1\n")
    numbers = lambda q: F.array_join(q.cast("array<string>"), " ")
    n = F.length("seq").cast("string")
    told = F.when(F.col("template").isNotNull(), F.concat(F.lit("\nTemplate "), F.col("template"))).otherwise("")
    read = F.concat(F.lit("Sequence : "), F.col("name"), F.lit("\nIs_read\nPadded"), told, F.lit("\n\nDNA : "), F.col("name"), F.lit("\n"), lines(seq), F.lit("\n\nBaseQuality : "), F.col("name"), F.lit("\n"), numbers(qual), F.lit("\n"))
    lo, hi = (F.col("start") + 1).cast("string"), (F.col("start") + F.length("seq")).cast("string")
    at = F.concat_ws(" ", F.lit("Assembled_from"), "name", F.when(back, hi).otherwise(lo), F.when(back, lo).otherwise(hi), F.lit("1"), n)
    own = placed.select("contig", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), "name", read.alias("value"))
    lines_of = placed.select("contig", F.lit(2), F.col("start").cast("long"), "name", at)
    top = F.concat(F.lit("Sequence : "), F.col("contig"), F.lit("\nIs_contig\nPadded"))
    end = F.concat(F.lit("\nDNA : "), F.col("contig"), F.lit("\n"), lines(F.col("seq")), F.lit("\n\nBaseQuality : "), F.col("contig"), F.lit("\n"), numbers(F.col("qual")), F.lit("\n"))
    zero, none = F.lit(0).cast("long"), F.lit("")
    return own.union(lines_of).union(contigs.select("contig", F.lit(1), zero, none, top)).union(contigs.select("contig", F.lit(3), zero, none, end))


def write_caf(placed: DataFrame, contigs: DataFrame, path: str) -> None:
    """A contig stands in one file, its reads before it."""
    caf(placed, contigs).repartitionByRange("contig").sortWithinPartitions("contig", "part", "at", "name").select("value").write.text(path)


def read_caf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reads, contigs) of CAF files, with the columns of placed reads and contigs; free reads have a null contig and start."""
    blocks = spark.read.text(path, lineSep="\n\n").where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^\s*(\w+) : (\S+)", 1)
    rows = blocks.select(head.alias("kind"), F.regexp_extract("value", r"^\s*(\w+) : (\S+)", 2).alias("name"), F.regexp_replace("value", r"^\s*\w+ : \S+\n?", "").alias("body"))
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("body")))
    found = rows.groupBy("name").agg(one("Sequence").alias("head"), one("DNA").alias("dna"), one("BaseQuality").alias("quals"))
    seq = F.replace(F.regexp_replace(F.coalesce("dna", F.lit("")), r"\s", ""), F.lit("-"), F.lit("*"))
    qual = F.transform(F.filter(F.split(F.coalesce("quals", F.lit("")), r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
    found = found.select("name", "head", seq.alias("seq"), qual.alias("qual"), F.nullif(F.regexp_extract("head", r"(?m)^Template (\S+)", 1), F.lit("")).alias("template"))
    contigs = found.where(F.col("head").rlike(r"(?m)^Is_contig"))
    line = F.explode(F.regexp_extract_all("head", F.lit(r"(?m)^Assembled_from (\S+ \d+ \d+)"), F.lit(1))).alias("a")
    p = F.split("a", " ")
    at = contigs.select(F.col("name").alias("contig"), line).select("contig", p[0].alias("name"), (F.least(p[1].cast("long"), p[2].cast("long")) - 1).alias("start"), F.when(p[1].cast("long") <= p[2].cast("long"), 1).otherwise(-1).alias("dir"))
    back = F.col("dir") == -1
    reads = found.where(F.col("head").rlike(r"(?m)^Is_read")).join(at, "name", "left")
    reads = reads.select("name", "contig", "start", F.coalesce("dir", F.lit(1)).alias("dir"), F.when(back, scalar.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"), "template")
    return reads, contigs.select(F.col("name").alias("contig"), "seq", "qual")
