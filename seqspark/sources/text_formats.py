"""Readers and writers of sequence text formats as DataFrames of the model's schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions import codes
from seqspark.sources.blocks import read_fastq  # noqa: F401

BASES = "^[ACGTNXRYKMSWBDHVacgtnxrykmswbdhv*@-]*$"


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """One row per record; Spark splits uncompressed files between separators."""
    return spark.read.text(path, lineSep=separator).where(F.length("value") > 0)


def read_fasta(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(name, comment, seq) of a FASTA file; check fails on records without a name or with illegal bases."""
    lines = F.split(F.regexp_replace("value", "^>", ""), "\r?\n")
    head = F.element_at(lines, 1)
    out = _records(spark, path, "\n>").select(
        F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("comment"), F.array_join(F.transform(F.slice(lines, F.lit(2), F.size(lines)), F.trim), "").alias("seq")
    )
    if not check:
        return out
    bad = F.when(F.col("name") == "", F.raise_error(F.lit("record without a name"))).when(~F.col("seq").rlike(BASES), F.raise_error(F.concat(F.lit("illegal base in "), F.col("name"))))
    return out.select("name", "comment", F.coalesce(bad.cast("string"), F.col("seq")).alias("seq"))


def read_fasta_qual(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """(name, qual) of a file of whole-number qualities."""
    lines = F.split(F.regexp_replace("value", "^>", ""), "\r?\n")
    numbers = F.filter(F.split(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), " "), r"\s+"), lambda x: x != "")
    rows = _records(spark, path, "\n>").select(F.regexp_extract(F.element_at(lines, 1), r"^(\S*)", 1).alias("name"), F.transform(numbers, lambda x: x.try_cast("int")).alias("qual"))
    bad = F.when(F.exists("qual", lambda q: q.isNull() | (q < 0) | (q > most)), F.raise_error(F.concat(F.lit("bad quality in "), F.col("name"))))
    return rows.select("name", F.coalesce(bad.cast("array<int>"), F.col("qual")).alias("qual"))


def with_qualities(seqs: DataFrame, quals: DataFrame) -> DataFrame:
    """Sequences joined to their qualities by name; fails where the lengths differ or a name is on one side only."""
    both = seqs.withColumn("_s", F.lit(True)).join(quals, "name", "full").withColumn("_q", F.col("qual").isNotNull())
    bad = F.when(F.col("_s").isNull() | ~F.col("_q"), F.raise_error(F.concat(F.lit("sequence and quality don't match: "), F.col("name")))).when(F.size("qual") != F.length("seq"), F.raise_error(F.concat(F.lit("lengths differ in "), F.col("name"))))
    return both.withColumn("qual", F.coalesce(bad.cast("array<int>"), F.col("qual"))).drop("_s", "_q")


def infer_offset(quals: DataFrame) -> int:
    """Offset 33, 59 or 64 from raw qualities (read with offset 0) and the longest read.

    33 holds from 200 bases on, and where qualities are all equal, begin below 59 or end at 73 at most.
    """
    r = quals.agg(F.min(F.array_min("qual")).alias("low"), F.max(F.array_max("qual")).alias("high"), F.max(F.size("qual")).alias("n")).first()
    if r.low is None or r.low < 59 or r.high <= 73 or r.low == r.high or r.n >= 200:
        return 33
    return 59 if r.low < 64 else 64


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, source, type, start, stop, score, strand, phase, attributes) of the feature lines of a GFF3 file."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(p) >= 9))
    return rows.select(p[0].alias("seqid"), p[1].alias("source"), p[2].alias("type"), p[3].cast("int").alias("start"), p[4].cast("int").alias("stop"), p[5].alias("score"), p[6].alias("strand"), p[7].alias("phase"), codes.gff3_attributes(p[8]).alias("attributes"))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a text of keys and values; # begins a comment."""
    clean = F.trim(F.regexp_replace("value", "#.*$", ""))
    part = F.split(clean, r"\s+", 2)
    return spark.read.text(path).where(clean != "").select(part[0].alias("key"), F.coalesce(F.get(part, F.lit(1)), F.lit("")).alias("value"))


def write_fasta(reads: DataFrame, path: str, width: int = 60) -> None:
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    reads.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), body)).write.text(path)


def write_fastq(reads: DataFrame, path: str, offset: int = 33) -> None:
    quals = F.array_join(F.transform("qual", lambda q: F.char(q + offset)), "")
    reads.select(F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), quals)).write.text(path)


def write_gff3(features: DataFrame, path: str) -> None:
    attrs = codes.gff3_attribute_text(F.col("attributes"))
    features.select(F.concat_ws("\t", "seqid", "source", "type", F.col("start").cast("string"), F.col("stop").cast("string"), "score", "strand", "phase", attrs)).write.text(path)


def write_wiggle(spans: DataFrame, path: str, step: int = 4) -> None:
    """spans(contig, span, mean_cov) as variable-step coverage lines."""
    spans.select(F.concat_ws("\t", F.col("contig").cast("string"), (F.col("span") * step + 1).cast("string"), F.col("mean_cov").cast("string"))).write.text(path)
