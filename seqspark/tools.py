"""Command-line tools: bait, mer, diff, convert. `python -m seqspark.tools TOOL ...`"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.operators import bait, kmers
from seqspark.sources import records, text_formats


def file_type(path: str) -> tuple[str, str]:
    """(type, path) of `type::file`, else by the file's suffix, that of a compressed one left out."""
    if "::" in path:
        kind, path = path.split("::", 1)
        return kind.lower(), path
    names = {"fa": "fasta", "fna": "fasta", "fq": "fastq", "gff": "gff3", "gbk": "genbank", "gb": "genbank"}
    parts = [p for p in Path(path).name.lower().split(".")[1:] if p not in ("gz", "bz2", "zst")]
    kind = parts[-1] if parts else ""
    return names.get(kind, kind), path


def load(spark: SparkSession, path: str) -> DataFrame:
    """Reads (name, seq, qual) of a file of any type that has them; qualities are null where there are none."""
    kind, path = file_type(path)
    if kind == "fastq":
        return text_formats.read_fastq(spark, path).select("name", "seq", "qual")
    if kind == "fasta":
        return text_formats.read_fasta(spark, path).select("name", "seq", F.lit(None).cast("array<int>").alias("qual"))
    if kind == "phd":
        return records.read_phd(spark, path).select("name", "seq", "qual")
    if kind == "exp":
        return records.read_exp(spark, path).select("name", "seq", "qual")
    if kind == "maf":
        return records.read_maf_reads(spark, path).select("name", "seq", "qual")
    if kind == "genbank":
        return records.read_genbank(spark, path)[0].select(F.col("accession").alias("name"), "seq", F.lit(None).cast("array<int>").alias("qual"))
    raise ValueError(f"can't read files of type {kind!r}")


def save(reads: DataFrame, path: str, default_quality: int = 30) -> None:
    """Writes reads in the type of a path; reads without qualities get the default."""
    kind, path = file_type(path)
    quals = F.coalesce("qual", F.call_function("array_repeat", F.lit(default_quality), F.length("seq")))
    full = reads.withColumns({"qual": quals, "rg": F.lit(0), "ql": F.lit(0), "qr": F.length("seq")})
    if kind == "fasta":
        text_formats.write_fasta(reads, path)
    elif kind == "fastq":
        text_formats.write_fastq(full, path)
    elif kind in ("maf", "caf", "qual"):
        {"maf": records.maf_read, "caf": records.caf_read, "qual": records.fasta_qual}[kind](full).write.text(path)
    else:
        raise ValueError(f"can't write files of type {kind!r}")


def stats_of(reads: DataFrame, k: int) -> DataFrame:
    return kmers.count(kmers.kmers(reads.withColumn("seqtype", F.lit(0)), k, "seqtype"), k)


def run_bait(spark: SparkSession, a: argparse.Namespace) -> None:
    taken = bait.take(load(spark, a.reads), load(spark, a.baits), a.k, a.hits, "name")
    save(taken.where("taken").select("name", "seq", "qual"), a.match)
    if a.miss:
        save(taken.where("not taken").select("name", "seq", "qual"), a.miss)


def run_mer(spark: SparkSession, a: argparse.Namespace) -> None:
    stats = records.load_kmers(spark, a.input) if a.table else stats_of(load(spark, a.input), a.k)
    stats = kmers.filter_and(stats, a.forward, a.reverse, a.total)
    if a.action == "create":
        records.save_kmers(stats, a.output)
    elif a.action == "dump":
        kmers.dump_text(kmers.ordered(stats, "count_down")).write.text(a.output)
    elif a.action == "fasta":
        kmers.dump_fasta(stats).write.text(a.output)
    elif a.action == "histogram":
        stats.groupBy(kmers.total().alias("n")).count().orderBy("n").write.csv(a.output)
    else:
        records.kmer_header(stats).write.json(a.output)


def run_diff(spark: SparkSession, a: argparse.Namespace) -> None:
    one, two = (kmers.filter_andor(stats_of(load(spark, p), a.k), 4, 4, 20) for p in (a.first, a.second))
    for name, x, y in (("a_not_b", one, two), ("b_not_a", two, one)):
        kmers.dump_text(kmers.ordered(kmers.difference(x, y), "count_down")).write.text(f"{a.output}/{name}")


def run_convert(spark: SparkSession, a: argparse.Namespace) -> None:
    reads = load(spark, a.input)
    if a.least:
        reads = reads.where(F.length("seq") >= a.least)
    if a.names:
        wanted = text_formats.read_key_values(spark, a.names).select(F.col("key").alias("name")).distinct()
        reads = reads.join(wanted, "name", "left_anti" if a.invert else "left_semi")
    for path in a.output:
        save(reads, path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqspark", description=__doc__)
    sub = p.add_subparsers(dest="tool", required=True)
    b = sub.add_parser("bait", help="reads that share k-mers with baits")
    b.add_argument("baits")
    b.add_argument("reads")
    b.add_argument("match")
    b.add_argument("--miss")
    b.add_argument("-k", type=int, default=31)
    b.add_argument("-n", "--hits", type=int, default=1)
    m = sub.add_parser("mer", help="k-mer tables")
    m.add_argument("action", choices=["create", "dump", "fasta", "histogram", "info"])
    m.add_argument("input")
    m.add_argument("output")
    m.add_argument("--table", action="store_true", help="the input is a saved table")
    m.add_argument("-k", type=int, default=31)
    for name in ("forward", "reverse", "total"):
        m.add_argument(f"--{name}", type=int, default=0, help=f"least {name} count")
    d = sub.add_parser("diff", help="k-mers of one set of reads that another lacks")
    d.add_argument("first")
    d.add_argument("second")
    d.add_argument("output")
    d.add_argument("-k", type=int, default=31)
    c = sub.add_parser("convert", help="from one type of file to others")
    c.add_argument("input")
    c.add_argument("output", nargs="+")
    c.add_argument("-x", "--least", type=int, default=0, help="least length")
    c.add_argument("-n", "--names", help="file of names to keep")
    c.add_argument("--invert", action="store_true", help="drop these names instead")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    {"bait": run_bait, "mer": run_mer, "diff": run_diff, "convert": run_convert}[a.tool](spark, a)


if __name__ == "__main__":
    main()
